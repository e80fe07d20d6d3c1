"""Golden rows of rules, and order-dependent folds against plain Python."""

import datetime as dt
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from pricewright import plans  # noqa: F401  fills the registry
from pricewright.functions import numbers as n
from pricewright.functions import text as t
from pricewright.operators import matching as m
from pricewright.operators import metrics, monitoring, series
from pricewright.sources import extract, ingest


def value(spark, column, **row):
    kinds = {str: "string", int: "bigint", float: "double", bool: "boolean"}
    frame = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in row.items())) if row else spark.range(1)
    return frame.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("text, want", [
    ("512 GB", "512gb"), ("512ГБ", "512gb"), ("0.5 TB", "512gb"), ("8/256 ГБ", "8+256"), ("8 ГБ / 256 ГБ", "8+256"), ("12+1 TB", "12+1024"), ("no storage", None),
])
def test_storage(spark, text, want):
    assert value(spark, t.storage(F.col("x")), x=text) == want


@pytest.mark.parametrize("a, b, want", [("128gb", "12+128", True), ("128gb", "256gb", False), ("8+128", "12+128", True)])
def test_storage_compatible(spark, a, b, want):
    assert value(spark, t.storage_compatible(F.col("a"), F.col("b")), a=a, b=b) is want


@pytest.mark.parametrize("text, want", [("Midnight", "black"), ("Чёрный", "black"), ("Obsidian", "black"), ("Porcelain", "white"), ("Indigo", "purple"), ("Hazel", "beige"), ("xyz", None)])
def test_color(spark, text, want):
    assert value(spark, t.color(F.col("x")), x=text) == want


@pytest.mark.parametrize("f, text, want", [
    (t.volume_ml, "1 л", 1000), (t.volume_ml, "1000 мл", 1000), (t.volume_ml, "Гель Fairy 1.5 л", 1500), (t.package_count, "6 шт", 6), (t.package_count, "уп. 12", 12), (t.first_price, "от 12 990 ₽", 12990),
    (t.first_price, "бесплатно", 0), (t.slug, "Ünï Code 42!", "u-ni-code-42"), (t.slug, "---", "item"),
])
def test_text_rules(spark, f, text, want):
    assert value(spark, f(F.col("x")), x=text) == want


def test_fnv1a(spark):
    def plain(s):
        h = 0x811C9DC5
        for c in s[:200]:
            h = ((h ^ ord(c)) * 0x01000193) & 0xFFFFFFFF
        return f"{h:x}"

    for s in ("a", "iphone 15", "сим"):
        assert value(spark, t.fnv1a(F.col("x")), x=s) == plain(s)


@pytest.mark.parametrize("mp, raw, want", [("wildberries", "wb-123", "123"), ("ozon", "OZON-77", "77"), ("yandex_market", "yandex_9", "9"), ("megamarket", "mega-1234567", "1234567"), ("aliexpress", "ali-12", "12"), ("dns", "x", "x")])
def test_bare_id(spark, mp, raw, want):
    assert value(spark, t.bare_id(F.col("m"), F.col("x")), m=mp, x=raw) == want


def test_stable_article(spark):
    for x, want in (("1234", True), ("123", False), ("abc123", True), ("unknown", False), ("yandex-", False), ("", False)):
        assert value(spark, t.stable_article(F.col("x")), x=x) is want


def test_confidence_and_rounding(spark):
    assert value(spark, n.confidence(F.col("x")), x=0.876) == 88
    assert value(spark, n.round_half_up(F.col("x")), x=-2.5) == -2.0
    assert value(spark, n.percent(F.col("a"), F.col("b")), a=1, b=0) == 0.0


def test_drops_differ_between_client_and_server(spark):
    row = {"before": 1000.0, "now": 985.0, "rub": 100.0, "pct": 1.0}
    args = [F.col(c) for c in ("before", "now", "rub", "pct")]
    assert value(spark, n.dropped_client(*args), **row) is True
    assert value(spark, n.dropped_server(*args), **row) is False


def test_economics_golden_row(spark):
    figures = spark.createDataFrame([(80, 40, 40, 2, 30, 40, 20, 2.0)], "checks bigint, scrapes bigint, cache_hits bigint, errors bigint, paid_scrapes bigint, active bigint, unique_targets bigint, avg_subscribers double")
    got = metrics.economics(figures, 10).first()
    assert (got["dedup_factor"], got["cache_hit_rate_pct"], got["checks_per_day"], got["scrapes_per_day"]) == (2.0, 50.0, 8.0, 4.0)
    assert (got["estimated_scrapes_saved"], got["scrapes_per_active"], got["scrapes_per_unique"]) == (120.0, 1.0, 2.0)


def test_alert_golden_rows(spark):
    day = spark.createDataFrame([("wildberries", 4, 25.0), ("ozon", 10, 50.0), ("aliexpress", 0, 100.0)], "marketplace string, total_requests bigint, success_rate_pct double")
    assert {r["marketplace"]: r["alert"] for r in metrics.alerts(day).collect()} == {"wildberries": False, "ozon": True, "aliexpress": False}


def test_promotion_golden_rows(spark):
    fields = "accepts bigint, rejects bigint, accept_days bigint, distinct_users bigint, avg_confidence bigint, recent_rejects bigint"
    for row, want in (((2, 0, 1, 2, 80, 0), "insufficient_accept_days"), ((2, 0, 2, 2, 80, 0), "ok"), ((2, 0, 2, 1, 80, 0), "insufficient_distinct_users"), ((2, 2, 2, 2, 80, 0), "reject_ratio")):
        assert m.promotion(spark.createDataFrame([row], fields)).first()["reason"] == want


def test_insight_golden_rows(spark):
    day = dt.datetime(2024, 1, 1)

    def kind(prices, now, old):
        history = spark.createDataFrame([("p", float(p), day) for p in prices], "product_id string, price double, recorded_at timestamp_ntz")
        return series.insights(history, ["product_id"], spark.createDataFrame([("p", float(now), float(old))], "product_id string, current_price double, old_price double"), 5).first()["kind"]

    assert kind([215609], 215609, 277490) == "unconfirmed_strikethrough"
    assert kind([215609] * 6, 215609, 277490) == "fake_discount"
    assert kind([215609, 277000, 230000, 240000, 250000], 215609, 277490) == "great_deal"


def test_monitoring_key(spark):
    key = monitoring.monitoring_key(F.col("m"), F.col("p"), F.col("u"))
    assert value(spark, key, m="ozon", p="12345", u="") == "ozon:12345"
    assert value(spark, key, m="ozon", p="", u="https://www.ozon.ru/product/x-1435731950/") == "ozon:1435731950"
    assert value(spark, key, m="ozon", p="", u="no link") is None


def test_kept_points_against_plain_python(spark):
    draw, start = random.Random(3), dt.datetime(2024, 1, 1)
    points = [(draw.randrange(4), start + dt.timedelta(minutes=draw.randrange(3000), microseconds=k), draw.randrange(3)) for k in range(400)]
    frame = spark.createDataFrame(points, "k bigint, at timestamp_ntz, price bigint")
    got = sorted(tuple(r) for r in series.without_repeats(frame, ["k"], "at", "price", 30 * 60 * 1_000_000).collect())
    want, last = [], {}
    for k, at, price in sorted(points, key=lambda p: (p[1], p[2])):
        if k in last and last[k][1] == price and at - last[k][0] < dt.timedelta(minutes=30):
            continue
        last[k] = (at, price)
        want.append((k, at, price))
    assert got == sorted(want)


def test_stream_cooldown_equals_batch(spark, sf_dir):
    from pricewright.registry import QUERIES

    stream = sorted((r["user_id"], r["price"]) for r in QUERIES["r7_cooldown_stream"](spark, sf_dir).select("user_id", F.col("value").alias("price")).collect())
    batch = sorted((r["user_id"], r["price"]) for r in QUERIES["w7_drop_cooldown"](spark, sf_dir).collect())
    assert stream == batch


def test_extraction(spark):
    html = """<html><h1>Phone <b>X</b></h1><script type="application/ld+json">{"@graph": [{"review": [{"reviewBody": "A very good phone indeed", "ratingValue": 5}, {"text": "short"}]}]}</script>
    <p class="review-text">It broke after two days &amp; more</p><span itemprop="price" content="12 990"></span><del>15 000 ₽</del> 4,8 из 5 <script type="application/json">{broken</script></html>"""
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id bigint, html string")
    assert [(r["text"], r["rating"]) for r in extract.json_reviews(pages).collect()] == [("A very good phone indeed", 5.0)]
    assert [r["text"] for r in extract.markup_reviews(pages).collect()] == ["It broke after two days & more"]
    card = extract.card(pages).where("page_id = 1").first()
    assert (card["title"], card["price"], card["old_price"], card["rating"]) == ("Phone X", 12990.0, 15000.0, 4.8)


def test_markup_reviews_read_every_entity(spark):
    """Each block's text is read with the entities of its own call, not with the block's place."""
    html = '<p class="review-text">Good &quot;deal&quot; &lt;here&gt;&nbsp;&#39;s <b>fine</b></p><div itemprop="reviewBody">A second  block of &amp;amp; text</div><p class="review-text">short</p>'
    pages = spark.createDataFrame([(1, html), (2, None)], "page_id bigint, html string")
    got = [tuple(r) for r in extract.markup_reviews(pages).orderBy("place").collect()]
    assert got == [(1, 0, "Good \"deal\" <here> 's fine"), (1, 1, "A second block of &amp; text")]


def test_ingest(spark):
    raw = spark.createDataFrame([("loud", "s", "n" * 99, "Eldorado", True, 12.5, None, "m" * 999, "{}", 1000, dt.datetime(2024, 1, 1))], "level string, stage string, name string, marketplace string, success boolean, elapsed_ms double, error_code string, error_message string, payload string, client_ms bigint, received timestamp_ntz")
    row = ingest.telemetry(raw).first()
    assert (row["level"], len(row["name"]), row["marketplace"], row["elapsed_ms"], len(row["error_message"])) == ("info", 64, "mvideo", 13, 300)


def test_slugs_unfold_as_decomposition_does(spark):
    def plain(x):
        s = unicodedata.normalize("NFKD", x).lower()
        s = re.sub("[^a-z0-9]+", "-", s).strip("-")
        return s[:80].rstrip("-") or "item"

    texts = ["élan vital", "Crème", "ﬁne ½ №5 ① Ⅷ ㎏ ℡", "Ａｂｃ１２", "straße", "ёлка", "İstanbul ığ", "x²", "K", "", "--", "Œ œ æ", "ﷺ a", "日本 x", "é", "a" * 100 + "é", "é" * 60]
    rows = spark.createDataFrame(list(enumerate(texts)), "i bigint, x string").select("i", t.slug(F.col("x")).alias("v")).orderBy("i").collect()
    assert [r["v"] for r in rows] == [plain(x) for x in texts]


def test_compaction_against_a_plain_one(spark):
    now, draw = dt.datetime(2024, 6, 30), random.Random(12)
    rows = [(f"{k:04}", draw.randrange(2), "m", f"p{draw.randrange(2)}", draw.choice([1.0, 2.0, 3.0, None]), now - dt.timedelta(days=draw.randrange(900), hours=draw.randrange(5))) for k in range(800)]
    frame = spark.createDataFrame(rows, "id string, user_id bigint, marketplace string, product_id string, price double, recorded_at timestamp_ntz").withColumn("n", F.lit("clash"))
    at = F.lit(now).cast("timestamp_ntz")

    def bucket(row):
        age, t = now - row[5], row[5]
        return None if age <= dt.timedelta(days=30) else ("week", t.date() - dt.timedelta(days=t.weekday())) if age <= dt.timedelta(days=365) else ("month", t.date().replace(day=1))

    groups, want, gone = {}, set(), {"week": 0, "month": 0}
    for row in rows:
        groups.setdefault((*row[1:4], bucket(row)), []).append(row)
    for key, some in groups.items():
        if key[-1] is None:
            want |= {r[0] for r in some}
            continue
        low = min(some, key=lambda r: (r[4] is not None, r[4] or 0, r[5], r[0]))  # an unknown price counts as the cheapest
        high = min(some, key=lambda r: (r[4] is None, -(r[4] or 0), r[5], r[0]))
        want |= {low[0], high[0]}
        gone[key[-1][0]] += len(some) - len({low[0], high[0]})
    assert {r["id"] for r in series.compacted(frame, at).collect()} == want
    assert {r["tier"]: r["deleted"] for r in series.compacted_away(frame, at).collect()} == gone
    assert series.compacted(frame, at).columns == [*frame.columns, "tier"]
