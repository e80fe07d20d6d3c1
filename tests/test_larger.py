"""Queries that agree with their SQL on the smallest tables, on rows that only larger ones have; and rules that were too slow on long texts."""

from __future__ import annotations

import time

import duckdb
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from pricewright.functions import text as t
from pricewright.functions import titles as ti
from pricewright.operators import match_score as ms
from pricewright.operators import matching as m


def test_cards_with_entities_and_without_headings(spark, tmp_path):
    """s21_cards gives its SQL's titles for quoted headings, meta titles and pages without a heading."""
    pages = ["<title>t</title><h1>a = &quot;b&quot; &amp; <b>c</b>\n d</h1>", '<meta property="og:title" content="other"><h1>mine &lt;x&gt; &nbsp;</h1>', "<title>only</title>", "", None, "<h1></h1>"]
    rows = spark.createDataFrame(list(enumerate(pages)), "page_id bigint, html string")
    rows.toPandas().to_parquet(tmp_path / "pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet'")
    assert {tuple(r) for r in queries()["s21_cards"](spark, str(tmp_path)).collect()} == set(con.sql(oracle_sql()["s21_cards"]).fetchall())


def test_slugs_of_other_alphabets_are_quick(spark):
    """Characters that no Latin letter comes from aren't held against thousands of others one by one; numero signs, ligatures and accents are read as before."""
    told = spark.createDataFrame([("№5 ½ ﬁne ＡＢ Crème K²",), ("ёлка",), (None,)], "x string").select(t.slug(F.col("x"))).collect()
    assert [r[0] for r in told] == ["no5-1-2-fine-ab-cre-me-k2", "item", None]
    lines = spark.range(20_000).select(F.concat(F.lit("Очень длинная строка обычного русского текста со словами, которую переводят в имя страницы "), F.col("id")).alias("x")).repartition(4)
    start = time.time()
    assert lines.select(F.count_distinct(t.slug(F.col("x")))).first()[0] == 20_000
    assert time.time() - start < 10


def test_pairs_of_equal_texts_are_told_once(spark):
    """Rows of equal titles share a number, and what pairs tell is computed once for each different pair of texts: a random number is the same for all its rows."""
    rows = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "b", "s"), (4, None, None), (5, None, None), (6, "b", "s")], "i int, title string, specs string")
    seen, texts = ti.numbered(rows, ["title", "specs"], f=F.struct(F.upper("title").alias("x")))
    number = {r["i"]: r["text"] for r in seen.collect()}
    assert sorted(number) == [1, 2, 3, 4, 5, 6] and number[1] == number[2] and number[3] == number[6] and number[4] == number[5] and len(set(number.values())) == texts.count() == 3
    pairs = spark.createDataFrame([(1, 3), (2, 6), (1, 4), (2, 5), (3, 1)], "reference int, candidate int")
    side = lambda name, k: seen.select(F.col("i").alias(name), F.col("text").alias(f"text_{k}"))
    told = ms.told_of_texts(pairs.join(side("reference", "a"), "reference").join(side("candidate", "b"), "candidate"), texts, texts, False, x=F.col("a.x"), y=F.col("b.x"), chance=F.rand()).collect()
    assert {(r["reference"], r["candidate"], r["x"], r["y"]) for r in told} == {(1, 3, "A", "B"), (2, 6, "A", "B"), (1, 4, "A", None), (2, 5, "A", None), (3, 1, "B", "A")}
    chance = {(r["reference"], r["candidate"]): r["chance"] for r in told}
    assert chance[1, 3] == chance[2, 6] and chance[1, 4] == chance[2, 5] and len(set(chance.values())) == 3


def test_pairs_of_one_block_are_dealt_out(spark):
    """the pairs of one block are made in several tasks, and are those of the plain rule: unknown prices, bounds of the ratio and odd prices too."""
    prices = [None, 0.0, -1.0, float("nan"), float("inf"), 1.0, 1.3, 1.69, 100.0, 130.0, 130.1, *(50 * 1.02**i for i in range(150))]
    rows = spark.createDataFrame([(i, f"t{i}", "b", "c", p) for i, p in enumerate(prices)], "product bigint, title string, brand string, category string, price double")
    a, b = rows.where("product % 5 <> 1"), rows.where("product % 7 <> 1")
    got = m.pairs_by_block(a, b, ["brand", "category"], 1.3, 16).select("reference", "candidate", F.spark_partition_id().alias("task")).collect()
    low, high = F.least("x.price", "y.price"), F.greatest("x.price", "y.price")
    plain = a.alias("x").join(b.alias("y"), F.expr("x.brand = y.brand AND x.category = y.category AND x.product <> y.product")).where((low > 0) & (high / low <= 1.3)).select("x.product", "y.product").collect()
    assert len(got) == len(plain) > 2000 and {tuple(r)[:2] for r in got} == {tuple(r) for r in plain}
    assert len({r["task"] for r in got}) > 4


def test_features_of_titles_are_not_sent_whole_to_the_driver(spark, sf_dir):
    """Titles, features and scores meet by sorting: no table of them is collected and sent to every executor, however small its file."""
    limit = "spark.sql.maxBroadcastTableSize"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "1000b")
    try:
        assert all(queries()[name](spark, sf_dir).count() > 0 for name in ("t8_d27_search_pick", "t7_best_with_fallback", "j17_entities"))
    finally:
        spark.conf.set(limit, before)
