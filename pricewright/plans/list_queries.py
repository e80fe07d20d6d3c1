"""Queries over users' lists (pairing of tracked and compared rows, merging of records) and over an index of pages."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import titles as ti
from ..operators import lists, text_index
from ..registry import query
from ..sources import relations as r

COMPARED_KEYS = "['url:' || l_partkey % 50, CASE WHEN l_partkey % 2 = 0 THEN 'art:' || min(l_suppkey) % 20 END]"
TRACKED_KEYS = "['url:' || o_orderkey % 50, 'art:' || o_orderkey % 20]"


@query("j16_my_products", f"""WITH RECURSIVE p AS (SELECT o_custkey AS owner, l_partkey AS a, {COMPARED_KEYS} AS keys FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey),
c AS (SELECT owner, a, [k for k in keys if k IS NOT NULL] AS keys, row_number() OVER (PARTITION BY owner ORDER BY a) AS n FROM p),
t AS (SELECT o_custkey AS owner, list({{'b': o_orderkey, 'keys': {TRACKED_KEYS}}} ORDER BY o_orderkey) AS rows FROM orders GROUP BY 1),
steps AS (SELECT owner, 0::BIGINT AS n, NULL::BIGINT AS a, NULL::BIGINT AS b, []::BIGINT[] AS used FROM t
  UNION ALL SELECT owner, n, a, b, CASE WHEN b IS NULL THEN used ELSE list_append(used, b) END FROM (
    SELECT s.owner, c.n, c.a, list_filter(t.rows, lambda x: list_has_any(x.keys, c.keys) AND NOT list_contains(s.used, x.b))[1].b AS b, s.used FROM steps s JOIN c ON c.owner = s.owner AND c.n = s.n + 1 JOIN t ON t.owner = s.owner))
SELECT owner, a, b FROM steps WHERE n > 0 UNION ALL SELECT o_custkey, NULL, o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT b FROM steps WHERE b IS NOT NULL)""")  # fmt: skip
def j16(spark, d):
    """Each user's compared products (those of their orders), one to one with the first tracked row (an order) that is free and shares a link or article."""
    orders = r.table(spark, d, "orders").select(F.col("o_custkey").alias("owner"), "o_orderkey")
    key = lambda kind, x, of: F.concat(F.lit(f"{kind}:"), (F.col(x) % of).cast("string"))
    tracked = orders.select("owner", F.col("o_orderkey").alias("place"), F.array(key("url", "o_orderkey", 50), key("art", "o_orderkey", 20)).alias("keys"))
    items = r.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("owner", "l_partkey").agg(F.min("l_suppkey").alias("l_suppkey"))
    keys = F.array(key("url", "l_partkey", 50), F.when(F.col("l_partkey") % 2 == 0, key("art", "l_suppkey", 20)))
    compared = items.select("owner", F.col("l_partkey").alias("place"), keys.alias("keys"))
    return lists.paired(compared, tracked)


@query("j15_m16_merged_lists")
def m16(spark, d):
    """The records of each user's list (their line items) after merging in order, by links and articles, guarded by maker and category of the title."""
    items = r.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(r.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    titles = r.listings(spark, d).select(F.col("product").alias("l_partkey"), "title")
    named = ti.with_told(titles, ["title"], maker=t.family_of(t.brand_of(F.col("title"))), category=ti.category_of(F.col("title")))
    store, other = r.pick(r.WATCHED, F.col("l_suppkey")), r.pick(r.WATCHED, F.col("l_partkey"))
    url, article = F.concat(F.lit("https://shop.example/"), (F.col("l_partkey") % 97).cast("string")), F.when(F.col("l_linenumber") % 3 != 0, (F.col("l_partkey") % 89).cast("string"))
    elsewhere = F.when(F.col("l_linenumber") % 4 == 0, F.create_map(other, F.concat(F.lit("https://other.example/"), (F.col("l_suppkey") % 40).cast("string"))))
    rows = items.join(named, "l_partkey").select(
        F.col("o_custkey").alias("owner"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"), store.alias("source"), url.alias("url"), article.alias("article"), elsewhere.alias("urls"),
        F.lit(None).cast("map<string,string>").alias("articles"), "title", "maker", "category",
    )
    return lists.merged_lists(rows)


#: Forms of the queries that are asked of the index: all words, a phrase, alternatives with an exclusion, a phrase or a word without another, exclusions alone.
FORMS = ("{a} {b}", '"{a} {b}"', "{a} or {c} -{b}", '-{c} "{b} {c}" OR {a}', "-{a} -{c}", '{b} OR -"{a} {b}"')


@query("x59_x60_indexed_search", r"""WITH p AS (SELECT p_partkey AS id, [w for w in string_split_regex(lower(p_name), '[^\p{L}\p{N}]+') if w <> ''] AS n, [w for w in string_split_regex(lower(p_brand), '[^\p{L}\p{N}]+') if w <> ''] AS b, [w for w in string_split_regex(lower(p_type), '[^\p{L}\p{N}]+') if w <> ''] AS t FROM part),
x AS (SELECT *, ' ' || array_to_string(n, ' ') || ' | ' || array_to_string(b, ' ') || ' | ' || array_to_string(t, ' ') || ' ' AS w FROM p),
names AS (SELECT DISTINCT p_name AS q FROM part), k AS (SELECT q, length(q) % 6 AS f, split_part(q, ' ', 1) AS a, split_part(q, ' ', 2) AS b2, CASE WHEN length(q) % 2 = 0 THEN 'steel' ELSE 'red' END AS c FROM names),
h AS (SELECT q, f, id, n, b, t, a AS wa, b2 AS wb, c AS wc, contains(w, ' ' || a || ' ') AS ha, contains(w, ' ' || b2 || ' ') AS hb, contains(w, ' ' || c || ' ') AS hc, contains(w, ' ' || a || ' ' || b2 || ' ') AS hab, contains(w, ' ' || b2 || ' ' || c || ' ') AS hbc FROM k, x),
r AS (SELECT *, CASE f WHEN 0 THEN [wa, wb] WHEN 1 THEN [wa, wb] WHEN 2 THEN [wa, wc] WHEN 3 THEN [wb, wc, wa] WHEN 4 THEN []::VARCHAR[] ELSE [wb] END AS asked FROM h
WHERE CASE f WHEN 0 THEN ha AND hb WHEN 1 THEN hab WHEN 2 THEN (ha OR hc) AND NOT hb WHEN 3 THEN NOT hc AND (hbc OR ha) WHEN 4 THEN NOT ha AND NOT hc ELSE hb OR NOT hab END)
SELECT q AS query, id, CASE WHEN len(asked) = 0 THEN 0.0::DOUBLE ELSE list_sum([CASE WHEN list_contains(n, z) OR list_contains(b, z) THEN 1.0::DOUBLE WHEN list_contains(t, z) THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END for z in list_distinct(asked)]) / len(list_distinct(asked)) END AS rank FROM r""")  # fmt: skip
def x60(spark, d):
    """The pages that answer a query made of each different product name, by an inverted index of names, brands and types."""
    part = r.table(spark, d, "part")
    index = text_index.build(part, "p_partkey", [("p_name", "A"), ("p_brand", "A"), ("p_type", "B")])
    q = F.col("p_name")
    a, b, c = F.split_part(q, F.lit(" "), F.lit(1)), F.split_part(q, F.lit(" "), F.lit(2)), F.when(F.length(q) % 2 == 0, "steel").otherwise("red")
    text = lambda form: F.concat(*[{"{a}": a, "{b}": b, "{c}": c}.get(x, F.lit(x)) for x in re.split(r"({\w})", form) if x])
    form = F.length(q) % len(FORMS)
    queries = part.select("p_name").distinct().select(q.alias("query"), F.coalesce(*[F.when(form == k, text(f)) for k, f in enumerate(FORMS)]).alias("text"))
    return text_index.search(index, queries, part.select(F.col("p_partkey").alias("id")))
