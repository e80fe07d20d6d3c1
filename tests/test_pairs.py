"""Joins of titles find every pair that the score accepts; lists are paired and merged as a plain loop does."""

import random

import pytest
from pyspark.sql import functions as F

from pricewright.functions import numbers as n
from pricewright.functions import titles as ti
from pricewright.operators import lists
from pricewright.operators import match_score as ms
from pricewright.sources import relations as r
from pricewright.sources.shared import stored

#: Kept by D1's gates though memory, maker, model or price is missing or written otherwise.
TITLES = [
    ("Redmi Note 13 8/128 ГБ", 100.0), ("Redmi Note 13", 101.0), ("Redmi Note 13 12/128 ГБ", 99.0), ("Redmi Note 13 128GB", None), ("Xiaomi Redmi Note 13", 0.0), ("Смартфон Apple iPhone 15 Pro Max 256GB", 900.0),
    ("iPhone 15 Pro Max", 1150.0), ("Apple iPhone 15 Pro Max чёрный", None), ("Наушники Xiaomi Redmi Buds 5", 40.0), ("Redmi Buds 5", 45.0), ("Sony WH-1000XM5", 300.0), ("Наушники Sony WH-1000XM5 чёрные", 310.0),
    ("Шампунь 400 мл", 5.0), ("Шампунь ментол 400 мл", 5.5), ("Кроссовки кожа размер 42", 70.0), ("Nike Air кроссовки кожа размер 42", 75.0), ("", 1.0), (None, 2.0), ("Redmi Note 13", 101.0), ("Redmi Note 13", 101.0),
]


@pytest.fixture(scope="module")
def sides(spark, sf_dir):
    known = r.listings(spark, sf_dir).select("product", "title", "specs", "price").where("product <= 90").union(spark.createDataFrame([(1000 + k, t, None, p) for k, (t, p) in enumerate(TITLES)], "p bigint, t string, s string, price double"))
    known = stored(known.select("product", "price", ti.features_of("title", "specs").alias("f")), "test-features")
    return known.select(F.col("product").alias("reference"), F.col("price").alias("price_a"), F.col("f").alias("a")), known.select(F.col("product").alias("candidate"), F.col("price").alias("price_b"), F.col("f").alias("b"))


@pytest.fixture(scope="module")
def accepted(sides):
    """Of every pair whatever that D1 accepts, its score."""
    a, b = sides
    near = n.prices_compatible(F.col("price_a"), F.col("price_b"), n.price_ratio_for(F.col("a.category")))
    rows = a.crossJoin(b).where(near & (F.col("reference") != F.col("candidate"))).select("reference", "candidate", F.explode(F.array(ms.scored_of("a", "b")["score"])).alias("score")).where("score >= 0.55")
    return {(r["reference"], r["candidate"]): r["score"] for r in rows.collect()}


@pytest.mark.parametrize("size", [512, 2])
def test_blocks_hold_every_accepted_pair_once(sides, accepted, size):
    found = [(r[0], r[1]) for r in ms.blocked(*sides, size=size).select("reference", "candidate").collect()]
    assert len(found) == len(set(found)) and set(accepted) <= set(found)
    assert (1000, 1001) in accepted and (1001, 1003) in accepted and len(found) < 0.2 * (90 + len(TITLES)) ** 2


def test_entities_are_the_best_of_all_pairs(sides, accepted):
    want = []
    for reference in {a for a, _ in accepted}:
        best = sorted(((-s, c) for (a, c), s in accepted.items() if a == reference))[:3]
        want += [(reference, c, round(-s, 9), k + 1) for k, (s, c) in enumerate(best)]
    got = ms.entities(*sides)
    assert sorted((r["reference"], r["candidate"], round(r["score"], 9), r["place"]) for r in got.collect()) == sorted(want)
    with pytest.raises(ValueError):
        ms.entities(*sides, least=0.3)


def test_entities_of_many_offers_of_few_titles(spark):
    """Thousands of offers of a few titles, at prices near and far, unknown ones and no numbers: as the plain loop has it, though only different titles are told."""
    names, drawn = [t for t, _ in TITLES[:16]], random.Random(5)
    f = spark.createDataFrame(list(enumerate(names)), "text bigint, title string").select("text", ti.features_of("title").alias("f"))
    texts = stored(f, "few-texts")
    x, y = texts.select(F.col("text").alias("i"), F.col("f").alias("a")), texts.select(F.col("text").alias("j"), F.col("f").alias("b"))
    score = {(r["i"], r["j"]): r["s"] for r in x.crossJoin(y).select("i", "j", F.explode(F.array(ms.scored_of("a", "b")["score"])).alias("s")).collect()}
    strict = {r["text"]: r["r"] for r in texts.select("text", n.price_ratio_for(F.col("f.category")).alias("r")).collect()}
    category = {r["text"]: r["c"] for r in texts.select("text", F.col("f.category").alias("c")).collect()}
    price = lambda: drawn.choice([None, 0.0, float("nan"), float("inf")]) if drawn.random() < 0.04 else round(drawn.uniform(60, 260), 1)
    rows = [(k, price(), drawn.randrange(len(names))) for k in range(2400)]
    known = lambda p: p is not None and p != 0
    number = lambda p: p == p and p != float("inf")

    def near(p, q, ratio):
        return not (known(p) and known(q)) or (number(p) and number(q) and max(p, q) / min(p, q) <= ratio)

    want = []
    for i, p, s in rows:
        ok = {t for t in range(len(names)) if score[s, t] >= 0.55 and category[s] == category[t]}
        best = sorted((-score[s, t], j) for j, q, t in rows if t in ok and j != i and near(p, q, strict[s]))[:3]
        want += [(i, j, round(-v, 9), k + 1) for k, (v, j) in enumerate(best)]
    table = spark.createDataFrame(rows, "product bigint, price double, text bigint")
    got = ms.entities_of_texts(table.withColumnRenamed("product", "reference"), table.withColumnRenamed("product", "candidate"), texts)
    assert sorted((r["reference"], r["candidate"], round(r["score"], 9), r["place"]) for r in got.collect()) == sorted(want)


def test_no_tile_is_large(spark, sides):
    """A title that half of all rows repeat is dealt to tiles."""
    a, b = sides
    same = spark.range(300).select((F.col("id") + 5000).alias("id"))
    many = lambda side, name: side.union(side.where(f"{name} = 1001").drop(name).crossJoin(same).select(F.col("id").alias(name), *[c for c in side.columns if c != name]))
    few = ms.blocked(many(a, "reference"), many(b, "candidate"), size=32)
    assert few.where("reference >= 5000 AND candidate >= 5000").count() == 300 * 299
    assert few.select("reference", "candidate").distinct().count() == few.count()


def plain_pairs(left, right):
    """The loop that pairing stands for."""
    out, used = [], set()
    for owner, place, keys in sorted(left):
        partner = next((p for o, p, k in sorted(right) if o == owner and (o, p) not in used and set(k) & set(keys)), None) if keys else None
        if partner is not None:
            used.add((owner, partner))
        out.append((owner, place, partner))
    return out + [(o, None, p) for o, p, _ in right if (o, p) not in used]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_pairs_equal_the_plain_loop(spark, seed):
    draw = random.Random(seed)
    side = lambda n: [(draw.randrange(4), k, [f"k{draw.randrange(12)}" for _ in range(draw.randrange(4))]) for k in range(n)]
    left, right = side(60), side(50)
    left += [(9, k, ["one"]) for k in range(40)] + [(8, k, ["x", None]) for k in range(5)]  # a key by itself, of many rows
    right += [(9, 1000 + k, ["one"]) for k in range(30)] + [(8, 1, ["x", "y"]), (8, 2, None)]
    frame = lambda rows: spark.createDataFrame(rows, "owner bigint, place bigint, keys array<string>").withColumn("b", F.lit("clash"))
    got = [tuple(r) for r in lists.paired(frame(left), frame(right)).collect()]
    want = plain_pairs(left, [(o, p, [x for x in k or [] if x]) for o, p, k in right])
    assert sorted(got, key=str) == sorted(want, key=str)
    assert lists.paired(frame(left).limit(0), frame(right)).count() == len(right)


def plain_lists(rows):
    """M16 as a loop over all records for each row."""
    out = []
    for row in rows:
        for n, kept in enumerate(out):
            if kept["owner"] == row["owner"] and lists._keys(kept) & lists._keys(row) and not lists._unlike(kept, row):
                out[n] = lists._join(kept, row)
                break
        else:
            out.append(row | {"members": 1})
    return [(x["owner"], x["place"], x["title"], x["category"], x["members"], sorted(":".join(k) for k in lists._keys(x))) for x in out]


def test_merged_lists_equal_the_plain_loop(spark):
    draw, stores = random.Random(4), ["ozon", "wb", "mvideo"]
    rows = []
    for k in range(400):
        at = lambda of: {s: f"{s}{draw.randrange(30)}" for s in stores if draw.random() < 0.3} if of else None
        title, maker, category = draw.choice([("Galaxy A55", "samsung", "smartphones"), ("Galaxy A55 8/256 blue", "samsung", "smartphones"), ("iPhone", "apple", "smartphones"), ("box", None, "generic"), (None, None, "generic")])
        rows.append((draw.randrange(5), k, draw.choice([*stores, None]), draw.choice([None, f"u{draw.randrange(60)}"]), draw.choice([None, " ", f"a{draw.randrange(20)}"]), at(draw.random() < 0.5), at(draw.random() < 0.3), title, maker, category))
    names = "owner place source url article urls articles title maker category".split()
    kind = "owner bigint, place bigint, source string, url string, article string, urls map<string,string>, articles map<string,string>, title string, maker string, category string"
    got = lists.merged_lists(spark.createDataFrame(rows, kind)).collect()
    want = plain_lists([dict(zip(names, r, strict=True)) | {"urls": r[5] or {}, "articles": r[6] or {}} for r in rows])
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))
    assert len(got) < len(rows) and lists.merged_lists(spark.createDataFrame([], kind)).count() == 0


def test_merged_record_keys_decide_later_merges():
    row = lambda place, source, url, **more: {"owner": 1, "place": place, "source": source, "url": url, "article": None, "urls": {}, "articles": {}, "title": "t" * place, "maker": None, "category": "generic"} | more
    kept = lists._List()
    for x in (row(1, "ozon", "u1"), row(2, "wb", "w1", urls={"ozon": "u1"}), row(3, "mvideo", "w1"), row(4, "wb", "w1", maker="sony"), row(5, "ozon", "other", maker="hp", urls={"wb": "w1"})):
        kept.add(x)
    # the second brings w1 to the first, so the third and fourth join it; the fourth's longer title brings a maker that bars the fifth
    assert [(r["place"], r["members"], r["title"]) for r in kept.records] == [(1, 4, "tttt"), (5, 1, "ttttt")]


def test_merged_lists_are_dealt_to_all_cores(spark):
    """However small the rows, lists are folded in several tasks a core; lists that end are sent on together, none is lost or split."""
    kind = "owner bigint, place bigint, source string, url string, article string, urls map<string,string>, articles map<string,string>, title string, maker string, category string"
    rows = [(k // 2, k, "ozon", f"u{k // 2}", None, None, None, "box", None, "generic") for k in range(2 * lists.TOGETHER + 200)]
    got = lists.merged_lists(spark.createDataFrame(rows, kind))
    seen = got.select("owner", "members", F.spark_partition_id().alias("at")).collect()
    assert len({r["at"] for r in seen}) >= 2 * spark.sparkContext.defaultParallelism
    assert sorted(r["owner"] for r in seen) == list(range(len(rows) // 2)) and {r["members"] for r in seen} == {2}


def test_rounds_of_pairing_read_only_keys_of_both_sides(spark, monkeypatch):
    """Keys that one side lacks are in no round's rows; pairs and rows without partner are the same."""
    kept = []
    monkeypatch.setattr(lists, "stored", lambda df, tag: kept.append((tag, out := stored(df, tag))) or out)
    left = spark.createDataFrame([(1, 1, ["x", "l1"]), (1, 2, ["x", "y"]), (1, 3, ["l2"]), (2, 4, ["y"])], "owner long, place long, keys array<string>")
    right = spark.createDataFrame([(1, 7, ["x", "r1"]), (1, 8, ["y", "r2"]), (1, 9, ["r3"])], "owner long, place long, keys array<string>")
    assert sorted(map(repr, map(tuple, lists.paired(left, right).collect()))) == sorted(map(repr, [(1, 1, 7), (1, 2, 8), (1, 3, None), (2, 4, None), (1, None, 9)]))
    rounds = [df for tag, df in kept if tag == "edges"][2:]
    assert rounds and {r["key"] for df in rounds for r in df.select("key").collect()} <= {"x", "y"}
