"""Queries that do the whole of a rule on values that exercise each of its parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import reviews as rv
from ..functions import text as t
from ..functions import titles as ti
from ..operators import catalog as c
from ..operators import offers as o
from ..registry import query
from ..sources import ingest
from ..sources import relations as r
from ..sources.relations import with_views


@query("m11_merged_reviews", """WITH x AS (SELECT source, text, lang, doc_id, CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 2 END AS grp FROM documents WHERE text IS NOT NULL)
SELECT source, doc_id, grp FROM x QUALIFY row_number() OVER (PARTITION BY source, text ORDER BY grp, doc_id) = 1""")
def m11(spark, d):
    """Reviews of each source from three groups in order: of equal texts the first stays."""
    x = r.table(spark, d, "documents").select("source", "text", "doc_id", F.when(F.col("lang") == "en", 0).when(F.col("lang") == "de", 1).otherwise(2).alias("grp"))
    return rv.merged(x, ["source"], ["grp", "doc_id"]).select("source", "doc_id", "grp")


RIVALS = """SELECT product, marketplace, CASE WHEN status = 'probable' THEN NULL WHEN confidence % 4 = 0 THEN 'https://x/search?text=a' ELSE 'https://x/p/1' END AS url, price, status = 'needs_choice' AS pick, CASE WHEN status = 'needs_choice' THEN confidence % 3 ELSE 0 END AS candidates, confidence AS seq FROM offers"""


@query("m13_richer_offers", with_views(f"""WITH x AS ({RIVALS}) SELECT product, marketplace FROM x QUALIFY row_number() OVER (PARTITION BY product ORDER BY coalesce(price > 0, false) AND coalesce(NOT regexp_matches(url, 'search\\?', 'i'), false) AND NOT pick DESC,
pick AND candidates > 0 DESC, CASE WHEN pick THEN candidates ELSE 0 END DESC, seq DESC, marketplace) = 1"""))
def m13(spark, d):
    """The offer that wins a product's slot: a priced card, then one that waits for a choice, of those the one of more candidates, then the newer."""
    x = r.offers(spark, d)
    pick = F.col("status") == "needs_choice"
    url = F.when(F.col("status") == "probable", None).when(F.col("confidence") % 4 == 0, "https://x/search?text=a").otherwise("https://x/p/1")
    rows = x.select("product", "marketplace", url.alias("url"), "price", pick.alias("pick"), F.when(pick, F.col("confidence") % 3).otherwise(0).alias("candidates"), F.col("confidence").alias("at"))
    return o.richer(rows, ["product"], "marketplace").select("product", "marketplace")


@query("m19_merged_offers", with_views("""WITH x AS (SELECT l_partkey % 500 AS product, l_orderkey * 10 + l_linenumber AS seq, l_suppkey % 3 AS store, l_suppkey % 5 AS item, CASE WHEN l_orderkey % 3 <> 0 THEN l_quantity ELSE 0 END AS price, CASE WHEN l_linenumber % 2 = 0 THEN 'u' || l_orderkey END AS url, l_partkey, l_suppkey FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY seq, l_partkey, l_suppkey) AS turn FROM x),
b AS (SELECT product, store, item, min(turn) AS first, arg_min({'turn': turn, 'price': price, 'url': url}, (NOT price > 0, turn)) AS base FROM n GROUP BY 1, 2, 3),
f AS (SELECT b.product, b.store, b.item, b.first, b.base.price AS price, coalesce(b.base.url, arg_min(n.url, n.turn) FILTER (n.turn > b.base.turn AND n.url IS NOT NULL)) AS url FROM b JOIN n ON n.product = b.product AND n.store = b.store AND n.item = b.item GROUP BY b.product, b.store, b.item, b.first, b.base)
SELECT product, store, item, price, url, row_number() OVER (PARTITION BY product ORDER BY first) AS place FROM f QUALIFY place <= 6"""))
def m19(spark, d):
    """Offers of each product merged by store and item: the first priced, a missing link filled from later ones, the six that came first."""
    x = r.table(spark, d, "lineitem").select(
        (F.col("l_partkey") % 500).alias("product"), F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"), "l_partkey", "l_suppkey").alias("turn"), (F.col("l_suppkey") % 3).alias("store"), (F.col("l_suppkey") % 5).alias("item"),
        F.when(F.col("l_orderkey") % 3 != 0, F.col("l_quantity")).otherwise(0).alias("price"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("u"), F.col("l_orderkey").cast("string"))).alias("url"),
    )
    return o.merged_offers(x, "product", ["store", "item"], "turn").select("product", "store", "item", "price", "url", "place")


@query("s2_s3_typed_events", """SELECT event_id, left(coalesce(CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type || repeat('!', 20) END, CASE WHEN event_id % 2 = 0 OR event_id % 5 = 0 THEN 'info' ELSE 'warn' END), 16) AS level, left(coalesce(CASE WHEN event_id % 4 <> 0 THEN repeat(event_type, 7) END, 'system'), 32) AS stage,
left(event_type || repeat('n', user_id % 90), 64) AS name, CASE event_id % 4 WHEN 0 THEN 'mvideo' WHEN 1 THEN 'ozon' WHEN 2 THEN NULL END AS marketplace, CASE WHEN event_id % 2 <> 0 AND event_id % 5 <> 0 THEN left(repeat('p', user_id % 100 + 1), 64) END AS product_id,
CASE WHEN event_id % 2 <> 0 AND event_id % 5 <> 0 THEN left(repeat('h', user_id % 50 + 1), 32) END AS query_hash, floor(value + 0.5::DOUBLE)::BIGINT AS elapsed_ms, CASE WHEN event_id % 2 <> 0 AND event_id % 5 <> 0 THEN left(repeat('e', user_id * 7 % 400 + 1), 300) END AS error_message,
CASE WHEN event_id % 5 <> 0 OR event_id % 2 = 0 THEN epoch_us(ts) // 1000 END AS client_ms FROM events""")
def s2(spark, d):
    """Raw events as the ingest sink types them: cut, rounded, known stores only, ids taken from funnel and operations events (every second, every fifth); operations rows have no client time."""
    k, u = F.col("event_id"), F.col("user_id")
    many = lambda x, n: F.repeat(F.lit(x), n.cast("int"))
    raw = r.table(spark, d, "events").select(
        "event_id", F.when(k % 3 != 0, F.concat("event_type", F.lit("!" * 20))).alias("level"), F.when(k % 4 != 0, F.repeat("event_type", 7)).alias("stage"), F.concat("event_type", many("n", u % 90)).alias("name"),
        F.element_at(F.array(*map(F.lit, ("eldorado", "ozon", "nowhere")), F.lit(None).cast("string")), (k % 4 + 1).cast("int")).alias("marketplace"), many("p", u % 100 + 1).alias("product_id"), many("h", u % 50 + 1).alias("query_hash"),
        F.col("value").alias("elapsed_ms"), many("e", u * 7 % 400 + 1).alias("error_message"), F.unix_millis(F.col("ts").cast("timestamp")).alias("client_ms"), (k % 2 == 0).alias("funnel"), ((k % 5 == 0) & (k % 2 != 0)).alias("ops"),
    )
    return ingest.typed(raw).select("event_id", "level", "stage", "name", "marketplace", "product_id", "query_hash", "elapsed_ms", "error_message", "client_ms")


TITLES = ("p_name", "'SEO smoke ' || p_name", "'a test-fixture of ' || p_name", "'12345' || p_size", "'asdf ' || p_name", "'ABC_-' || p_size || 'x'", "left(p_name, 5)", "'   ' || left(p_name, 6) || '   '", "'Smokefixture ' || p_name", "NULL", "'LONG-SKU-LIKE-NAME-' || p_size", "'tested ' || p_name")


@query("f23_weak_titles", rf"""SELECT p_partkey, length(trim(x)) < 8 OR regexp_matches(x, '\b(seo\s*smoke|smoke\s*fixture|test\s*fixture)\b', 'i') OR regexp_matches(x, '^(test|fixture|asdf|xxx)\b', 'i') OR regexp_matches(x, '^\d{{5,}}$') OR (regexp_matches(x, '^[a-z0-9_-]{{6,}}$', 'i') AND length(x) < 20) AS weak
FROM (SELECT p_partkey, trim(coalesce(CASE {' '.join(f'WHEN p_partkey % {len(TITLES)} = {k} THEN {x}' for k, x in enumerate(TITLES))} END, '')) AS x FROM part)""")
def f23(spark, d):
    """Which titles say too little to be published: short ones, fixtures, bare numbers, article-like words."""
    title = F.coalesce(*[F.when(F.col("p_partkey") % len(TITLES) == k, F.expr(x)) for k, x in enumerate(TITLES)])
    return r.table(spark, d, "part").select("p_partkey", c.weak_title(title).alias("weak"))


STEMS = t.PRAISE + t.COMPLAINT
SAID = f"[{', '.join(repr(s) for s in STEMS)}]"


@query("d52_stem_sentiments", f"""WITH x AS (SELECT doc_id, lower(coalesce(text, '') || ' ' || upper({SAID}[(doc_id % {len(STEMS)} + 1)::INT]) || ' ' || {SAID}[(doc_id // 7 % {len(STEMS)} + 1)::INT] || ' ' || {SAID}[(doc_id // 50 % {len(STEMS)} + 1)::INT]) AS x FROM documents),
n AS (SELECT doc_id, len([s for s in {list(t.PRAISE)} if contains(x, s)]) AS p, len([s for s in {list(t.COMPLAINT)} if contains(x, s)]) AS n FROM x) SELECT doc_id, CASE WHEN p + n = 0 THEN 0.0::DOUBLE ELSE (p - n)::DOUBLE / (p + n) END AS sentiment FROM n""")
def d52(spark, d):
    """Sentiment of every document followed by three of the fixed stems."""
    pick = lambda x: r.pick(STEMS, F.expr(x))
    text = F.concat_ws(" ", F.coalesce("text", F.lit("")), F.upper(pick("doc_id")), pick("doc_id div 7"), pick("doc_id div 50"))
    return r.table(spark, d, "documents").select("doc_id", t.sentiment(text).alias("sentiment"))


ACCENTS = ("élan", "Crème Brûlée", "Ångström 10", "naïve", "Œuvre", "ёлка x", "straße", "Señor", "Zoë", "plain")


@query("x31_unfolded_slugs", f"""SELECT p_partkey, CASE WHEN s = '' THEN 'item' ELSE regexp_replace(left(s, 80), '-$', '') END AS slug FROM (SELECT p_partkey, regexp_replace(regexp_replace(lower(array_to_string([CASE WHEN strip_accents(ch) <> ch THEN strip_accents(ch) || '-' ELSE ch END for ch in string_split(x, '')], '')), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS s
FROM (SELECT p_partkey, {r._sql_pick(ACCENTS, 'p_partkey')} || ' ' || p_name || ' ' || {r._sql_pick(ACCENTS, 'p_partkey // 10')} AS x FROM part))""")
def x31(spark, d):
    """Slugs of names with accented letters: the letters stay, their marks become hyphens."""
    name = F.concat_ws(" ", r.pick(ACCENTS, F.col("p_partkey")), "p_name", r.pick(ACCENTS, F.expr("p_partkey div 10")))
    return ti.spread(r.table(spark, d, "part")).select("p_partkey", t.slug(name).alias("slug"))


IDS = ("'WB-' || p_partkey", "'ozon-' || p_partkey", "'MM-9' || (100000 + p_partkey) || 'x'", "'ae-77' || (1000000 + p_partkey)", "'eldorado:' || p_partkey % 100", "'Yandex-' || p_partkey", "'ym-' || p_partkey", "' ' || p_partkey || ' '", "NULL", "'mega-1' || (p_partkey % 90)")
ID_STORES = ("wildberries", "ozon", "megamarket", "aliexpress", "mvideo", "yandex_market", "yandex_market", "wildberries", "ozon", "megamarket")


@query("x39_bare_articles", f"""SELECT p_partkey, CASE p_partkey % 10 WHEN 2 THEN '9' || (100000 + p_partkey) WHEN 3 THEN '77' || (1000000 + p_partkey) WHEN 4 THEN (p_partkey % 100)::VARCHAR WHEN 8 THEN '' WHEN 9 THEN '1' || (p_partkey % 90) ELSE p_partkey::VARCHAR END AS article FROM part""")
def x39(spark, d):
    """Articles of clients' product ids, in every store's form."""
    raw = F.coalesce(*[F.when(F.col("p_partkey") % len(IDS) == k, F.expr(x)) for k, x in enumerate(IDS)])
    return r.table(spark, d, "part").select("p_partkey", t.bare_article(r.pick(ID_STORES, F.col("p_partkey")), raw).alias("article"))


@query("n3_publish_pages", """WITH g AS (SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_partkey DESC) AS place, CASE WHEN p_size % 10 < 4 THEN 'low_quality' WHEN p_partkey % 7 < 3 AND p_partkey % 400 < 200 THEN 'insufficient_reviews' END AS reason FROM part)
SELECT ((place - 1) // 100) AS page, coalesce(reason, 'published') AS outcome, count(*) AS pages FROM g GROUP BY 1, 2""")
def n3(spark, d):
    """What publishing page by page comes to, newest pages first, a hundred each: outcomes and reasons of every page."""
    k, s = F.col("p_partkey"), F.col("p_size")
    reason = F.when(s % 10 < 4, "low_quality").when((k % 7 < 3) & (k % 400 < 200), "insufficient_reviews")
    rows = r.table(spark, d, "part").select("p_partkey", "p_size", reason.alias("reason"))
    return c.outcomes_by_page(rows, [F.desc("p_size"), F.desc("p_partkey")], F.coalesce("reason", F.lit("published")), 100)
