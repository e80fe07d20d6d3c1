"""Queries over published pages: two runs of publishing, and a refresh of their offers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import titles as ti
from ..operators import publishing as pub
from ..registry import query
from ..sources import relations as r


def _candidates(spark, d, second: bool):
    """A page for each part; in the second run every seventh is of another quality."""
    k = F.col("p_partkey")
    size = F.when(k % 7 == 0, F.col("p_size") % 10 + 1).otherwise(F.col("p_size") % 10) if second else F.col("p_size") % 10
    quality = size.cast("double")
    offers = F.array(F.struct(F.lit("ozon").alias("marketplace"), F.when(k % 5 != 0, F.col("p_retailprice")).alias("price"), F.lit("u").alias("url")))
    part = ti.with_told(r.table(spark, d, "part"), ["p_name"], base=t.slug(F.col("p_name")))
    return part.select(
        k.cast("string").alias("key"), "base", F.concat_ws("|", "p_brand", "p_name").alias("canon"), F.sha2(F.concat_ws("|", "p_name", "p_brand", size.cast("string")), 256).alias("hash"),
        quality.alias("quality"), F.when(quality < 4, "low_quality").alias("reason"), F.when(k % 3 != 0, F.col("p_retailprice")).alias("price"), offers.alias("offers"),
    )


RUNS = """WITH b AS (SELECT p_partkey, p_partkey::VARCHAR AS key, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS base, p_brand || '|' || p_name AS canon, (p_size % 10)::DOUBLE AS q1, (p_size % 10 + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END)::DOUBLE AS q2, p_retailprice FROM part),
n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY key) AS n FROM b),
o AS (SELECT *, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS slug, CASE WHEN q1 = q2 THEN 'unchanged' WHEN q2 >= 4 THEN 'published' WHEN q1 >= 4 THEN 'kept' ELSE 'rejected' END AS outcome FROM n),
f AS (SELECT *, CASE WHEN q2 >= 4 OR q1 >= 4 THEN 'published' ELSE 'rejected' END AS status, CASE WHEN outcome = 'kept' THEN q1 ELSE q2 END AS quality, CASE WHEN q1 >= 4 THEN 1 ELSE 2 END AS since FROM o),
p AS (SELECT *, first_value(slug) OVER w AS first_slug, first_value(key) OVER w AS first_key FROM f WINDOW w AS (PARTITION BY canon, status ORDER BY quality DESC, since, key))"""


@query("n4_publish", RUNS + """ SELECT key, outcome, status, slug, quality, status <> 'published' OR key = first_key AS "primary", CASE WHEN status = 'published' AND key <> first_key THEN first_slug END AS primary_slug FROM p""")
def n4(spark, d):
    """All parts published, then published again after a seventh has changed: what the second run does with each, and the pages after it."""
    store = pub.Store.new(spark)
    pub.publish(store, 1, _candidates(spark, d, False))
    said = pub.publish(store, 2, _candidates(spark, d, True))
    return said.join(store.pages(), "key").select("key", "outcome", "status", "slug", "quality", "primary", "primary_slug")


@query("n7_refresh_offers", """WITH b AS (SELECT p_partkey, p_partkey::VARCHAR AS key, p_brand || '|' || p_name AS canon, (p_size % 10)::DOUBLE AS quality, p_retailprice AS price FROM part),
p AS (SELECT *, quality >= 4 AS live, first_value(key) OVER (PARTITION BY canon, quality >= 4 ORDER BY quality DESC, key) AS first_key FROM b),
x AS (SELECT *, CASE WHEN NOT live THEN 'unpublished' WHEN key <> first_key THEN 'alias' WHEN p_partkey % 4 = 0 THEN CASE WHEN p_partkey % 5 <> 0 OR p_partkey % 3 <> 0 THEN 'worse' WHEN p_partkey % 15 = 0 THEN 'unchanged' END WHEN p_partkey % 4 = 1 THEN 'updated' ELSE 'unchanged' END AS outcome FROM p)
SELECT x.key, x.outcome, CASE WHEN x.outcome = 'updated' THEN x.price * 0.9::DOUBLE WHEN x.p_partkey % 3 <> 0 THEN x.price END AS price FROM x""")  # fmt: skip
def n7(spark, d):
    """New offers for all published pages: a quarter without any price, a quarter at nine tenths, the others the same."""
    store, k = pub.Store.new(spark), F.col("key").cast("bigint")
    first = _candidates(spark, d, False)
    pub.publish(store, 1, first)
    cut = lambda p: F.when(k % 4 == 0, None).when(k % 4 == 1, p * 0.9).otherwise(p)
    full = F.when(k % 4 == 1, F.lit(0.9)).otherwise(1.0)
    base = r.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("key"), F.col("p_retailprice").alias("whole"))
    new = first.join(base, "key").select("key", F.when(k % 4 == 1, F.col("whole") * full).otherwise(cut(F.col("price"))).alias("price"), F.transform("offers", lambda o: F.struct(o["marketplace"], cut(o["price"]).alias("price"), o["url"])).alias("offers"))
    said = pub.refresh(store, 2, new)
    return said.join(store.pages(), "key").select("key", "outcome", "price")
