"""Queries do the whole job: no row or line of their inputs is passed over. Small tables whose results are known."""

import random

from pyspark.sql import functions as F

from pricewright import plans  # noqa: F401  fills the registry
from pricewright.operators import catalog, matching, series
from pricewright.registry import QUERIES
from pricewright.streaming import jobs


def test_titles_of_every_color(spark, tmp_path):
    names = ["Midnight lamp", "Porcelain cup", "navy hat", "silver pen", "Grey mat", "green tea", "red box", "gold ring", "indigo ink", "pink bow", "hazel nut", "brown bag", "orange cap", "Lemon  Grass oil", "plain jar"]
    spark.createDataFrame(list(enumerate(names)), "p_partkey bigint, p_name string").write.parquet(f"file://{tmp_path}/part.parquet")
    got = {r["p_partkey"]: r for r in QUERIES["x5_x18_d13_all_titles"](spark, f"file://{tmp_path}").collect()}
    want = "black white blue silver gray green red gold purple pink beige brown orange yellow".split() + [None]
    assert [got[k]["color"] for k in range(len(names))] == want
    assert [got[k]["brand"] for k in range(8)] == ["xiaomi", "redmi", "poco", "huawei", "honor", "apple", "dyson", None]
    # the other title of 0 to 7 is Xiaomi's, of 8 to 14 Redmi's
    assert [got[k]["compatible"] for k in range(8)] == [True, True, True, False, False, False, False, True]
    assert [got[k]["compatible"] for k in range(8, 12)] == [True, True, True, False]


def test_every_product_and_user_is_on_a_side(spark, sf_dir):
    products = {r[0] for r in spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey").distinct().collect()}
    for name in ("m12_merge_all", "j14_all_alert_pairs"):
        assert {r["product"] for r in QUERIES[name](spark, sf_dir).collect()} == products
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").collect()
    store = lambda r: (r["o_custkey"], ("wildberries", "ozon", "yandex_market")[r["o_orderkey"] % 3], str(r["o_orderkey"] % 200))
    want = {store(r) for r in orders if r["o_orderstatus"] != "F"} - {store(r) for r in orders if r["o_orderpriority"] == "1-URGENT"}
    got = [tuple(r) for r in QUERIES["j12_reconcile_all"](spark, sf_dir).select("user_id", "marketplace", "product_id").collect()]
    assert len(got) == len(set(got)) and set(got) == want and {u % 3 for u, _, _ in got} == {0, 1, 2}


def test_places_of_all_products(spark, sf_dir):
    got = QUERIES["t13_all_my_products"](spark, sf_dir).collect()
    assert len(got) == spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey").distinct().count() > 100
    for name in ("by_added", "by_price", "by_title"):
        assert sorted(r[name] for r in got) == list(range(1, len(got) + 1))


def test_places_of_ranges_with_ties_and_nulls(spark):
    rows = [(k, None if k % 3 == 0 else float(k % 7)) for k in range(500)]
    got = catalog.placed(spark.createDataFrame(rows, "id bigint, low double").repartition(9), [F.asc_nulls_last("low"), F.col("id")], "place").collect()
    want = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0]))
    assert [r["id"] for r in sorted(got, key=lambda r: r["place"])] == [r[0] for r in want] and {r["place"] for r in got} == set(range(1, 501))


def test_titles_of_every_line(spark, tmp_path):
    texts = [(1, "Phone 8/256 GB\n\nGel 1.5 л\r\nSocks 6 шт\rDisk 1 TB"), (2, None), (3, ""), (4, "one line\n"), (5, "4373219979016299 шт\n98765432109876543210987654321 шт, x 3")]
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = sorted(QUERIES["x1_titles"](spark, f"file://{tmp_path}").collect(), key=lambda r: (r["doc_id"], r["line"] or 0))
    assert [tuple(r) for r in got] == [
        (1, 0, "phone 8 256 gb", "8+256", None, None, "phone-8-256-gb"), (1, 1, "", None, None, None, "item"), (1, 2, "gel 1 5 л", None, 1500, None, "gel-1-5"),
        (1, 3, "socks 6 шт", None, None, 6, "socks-6"), (1, 4, "disk 1 tb", "1024gb", None, None, "disk-1-tb"),
        (2, None, None, None, None, None, None), (3, 0, "", None, None, None, "item"), (4, 0, "one line", None, None, None, "one-line"), (4, 1, "", None, None, None, "item"),
        (5, 0, "4373219979016299 шт", None, None, None, "4373219979016299"), (5, 1, "98765432109876543210987654321 шт x 3", None, None, 3, "98765432109876543210987654321-x-3"),
    ]


def test_clusters_of_chains(spark):
    n = 40
    items = spark.createDataFrame([(k,) for k in range(n + 3)], "id bigint")
    chain = [(k, k + 1) for k in range(n - 1)][::-1] + [(n, n + 1)]
    got = {r["id"]: r["component"] for r in catalog.clusters(items, spark.createDataFrame(chain, "first bigint, id bigint")).collect()}
    assert got == {k: 0 for k in range(n)} | {n: n, n + 1: n, n + 2: n + 2}


def test_offers_of_edges(spark):
    edge = lambda target, pid, rank, status="active": ("ozon", 1, target, pid, 80, rank, status)
    edges = [edge("wildberries", 10, 0), edge("wildberries", 11, 1), edge("wildberries", 12, 2), edge("wildberries", 13, 3), edge("yandex_market", 20, 0), edge("yandex_market", 21, 1), edge("yandex_market", 22, 2), edge("aliexpress", 30, 0, "disputed"), edge("megamarket", 40, 1), edge("ozon", 2, 0)]
    cache = [("ozon", 1, 50.0), ("wildberries", 10, 60.0), ("wildberries", 11, -1.0), ("wildberries", 12, 30.0), ("wildberries", 13, 5.0), ("yandex_market", 20, 20.0), ("yandex_market", 21, 21.0), ("yandex_market", 22, 22.0), ("megamarket", 40, 10.0), ("aliexpress", 30, 1.0), ("ozon", 2, 2.0)]
    e = spark.createDataFrame(edges, "source_marketplace string, source_product_id bigint, target_marketplace string, target_product_id bigint, confidence bigint, rank bigint, status string")
    c = spark.createDataFrame(cache, "marketplace string, product_id bigint, price double")
    stores = ("wildberries", "ozon", "yandex_market", "megamarket", "aliexpress")
    assert [r["product_id"] for r in matching.offers_snapshot(e, c, stores).orderBy("place").collect()] == [1, 10, 12, 20, 21, 22]
    assert [r["target_product_id"] for r in matching.cheap_offers(e, c, stores).orderBy("place").collect()] == [40, 20]


def test_lists_of_every_user(spark, sf_dir):
    rows = QUERIES["j13_pending"](spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/orders.parquet").count() and {r["pending"] for r in rows} == {True, False}
    links = QUERIES["t14_unique_links"](spark, sf_dir).collect()
    assert len({(r["user_id"], r["product_url"]) for r in links}) == len(links) and all(r["kept"] == (r["place"] <= 20) for r in links)


def by_key(frame, key, order):
    out = {}
    for row in sorted(frame.to_dict("records"), key=lambda x: tuple(x[o] for o in order)):
        out.setdefault(tuple(row[k] for k in key), []).append(row)
    return out


def test_rate_limit_state_is_a_shard_s(spark, tmp_path):
    """Users share states, of which there are few however many users; events without a user share a limit; rows are those of a plain fold, in several slices."""
    rows = [(k, k * 7919 % 3000 if k % 50 else None, 1_700_000_000_000 + k * 104729 % 30_000_000) for k in range(12_000)]
    table = spark.createDataFrame(rows, "event_id bigint, user_id bigint, ms bigint").selectExpr("event_id", "user_id", "cast(timestamp_millis(ms) as timestamp_ntz) ts", "'view' event_type", "1.0D value")
    table.toPandas().assign(user_id=lambda x: x["user_id"].astype("Int64")).to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")
    want, passed = {}, {}
    for event, user, ms in sorted(rows, key=lambda r: (r[2], r[0])):
        times = [t for t in passed.get(user, []) if ms - t < 3_600_000]
        want[event] = (user, ms, len(times) < 3)
        passed[user] = times + [ms] * want[event][2]
    sliced = lambda: jobs.limited(jobs.slices(spark, str(tmp_path), 4000), jobs.HOUR, 3)
    assert {r["event_id"]: (r["user_id"], r["ms"], r["allowed"]) for r in jobs.run(sliced(), "append").collect()} == want
    spark.conf.set(jobs.STORE, jobs.ROCKS)
    try:
        query = sliced().writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset(jobs.STORE)
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) <= 256


def test_rate_limit_and_failures_against_plain_folds(spark, sf_dir):
    """The streams' keyed state gives what plain folds over sorted events give, in one micro-batch and in several slices of time."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", "user_id", "event_type", "unix_millis(cast(ts as timestamp)) ms").toPandas()
    want, failing = {}, {}
    for (user,), rows in by_key(events, ["user_id"], ["ms", "event_id"]).items():
        passed, count = [], 0
        for row in rows:
            passed = [t for t in passed if row["ms"] - t < 3_600_000]
            want[row["event_id"]] = len(passed) < 3
            if want[row["event_id"]]:
                passed.append(row["ms"])
            count = count + 1 if row["event_type"] == "error" else 0
        failing[user] = count
    assert {r["event_id"]: r["allowed"] for r in QUERIES["r5_rate_limit_stream"](spark, sf_dir).collect()} == want
    assert {r["user_id"]: r["failures"] for r in QUERIES["r8_failure_stream"](spark, sf_dir).collect()} == failing
    sliced = lambda: jobs.slices(spark, sf_dir, len(events) // 4)
    assert {r["event_id"]: r["allowed"] for r in jobs.run(jobs.limited(sliced(), jobs.HOUR, 3), "append").collect()} == want
    assert {r["user_id"]: r["failures"] for r in jobs.run(jobs.failures(sliced()), "update", ["user_id"]).collect()} == failing
    cooled = lambda s: sorted(map(tuple, jobs.run(jobs.cooled(s.where("event_type = 'view'"), 8 * jobs.HOUR), "append").collect()))
    assert cooled(sliced()) == cooled(jobs.slices(spark, sf_dir)) != []


def test_mapping_history_against_a_plain_fold(spark):
    """Evidence only rises, closed edges open by hand only, disputes and failures count."""
    draw, events = random.Random(6), []
    for k in range(400):
        events.append((draw.randrange(12), k, k, draw.choice(["upsert", "upsert", "dispute", "fail"]), draw.choice(["auto", "multi_user", "manual"]), draw.randrange(101)))
    rank, want = ["auto", "multi_user", "manual"], {}
    for edge, _, _, action, evidence, confidence in events:
        s = want.get(edge)
        if action == "upsert":
            if s and s[3] in ("disputed", "dead") and evidence != "manual":
                continue
            hits, known, status, failures = (s[0], s[2], s[3], s[4]) if s else (0, None, None, 0)
            known = evidence if known is None else max(known, evidence, key=rank.index)
            open_ = status not in ("disputed", "dead")
            want[edge] = (hits + 1, confidence, known, ("unverified" if evidence == "manual" and confidence < 70 else "active") if open_ else status, failures)
        elif s and action == "dispute":
            want[edge] = (max(0, s[0] - 2), max(0, s[1] - 35), s[2], "disputed", s[4])
        elif s:
            want[edge] = (*s[:3], "dead" if s[4] + 1 >= 3 else "active", s[4] + 1)
    got = catalog.mapping_state(spark.createDataFrame(events, "edge bigint, at bigint, id bigint, action string, evidence string, confidence bigint")).collect()
    assert {r["edge"]: (r["hits"], r["confidence"], r["evidence"], r["status"], r["failures"]) for r in got} == want


def test_target_cooldown_and_card_opens_against_plain_folds(spark):
    draw = random.Random(3)
    rows = [(draw.randrange(5), draw.randrange(200) * 3_600, float(draw.randrange(50))) for _ in range(300)]
    frame = spark.createDataFrame(rows, "key bigint, s bigint, price double").selectExpr("key", "timestamp_seconds(s)::timestamp_ntz AS at", "price", "s")
    for rest, deeper in ((24, None), (8, 0.98)):
        want = []
        for key in range(5):
            last = None
            for _, s, price in sorted(r for r in rows if r[0] == key):
                if last is None or s - last[0] >= rest * 3600 or (deeper and price < last[1] * deeper):
                    want.append((key, s, price))
                    last = s, price
        got = series.cooled_alerts(frame, ["key"], "at", "price", rest * series.HOUR, deeper)
        assert sorted((r["key"], r["s"], r["price"]) for r in got.collect()) == sorted(want)
