"""Queries over listings: attributes of titles, models and roles, match scores, ranked candidates, queries to search with.

The SQL checks the rules that its patterns can say: DuckDB's dialect has the same ASCII word borders as the rules, but no look-around.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import identity as ident
from ..functions import numbers as n
from ..functions import titles as ti
from ..operators import match_score as ms
from ..operators import matching as m
from ..registry import query
from ..sources import relations as r
from ..sources.shared import stored
from ..sources.relations import with_views


def _sql_rules(rules, subject: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({subject}, '{p.replace(chr(39), chr(39) * 2)}', 'i') THEN '{v}'" for v, p in rules) + " END"


TEXT = "(title || ' ' || coalesce(specs, ''))"
BLOCKS = {
    "x13_connector": ("connector", ti.connector_of, ti.CONNECTORS), "x14_condition": ("condition", ti.condition_of, ti.CONDITIONS), "x15_authenticity": ("authenticity", ti.authenticity_of, ti.AUTHENTICITY),
    "x16_region": ("region", ti.region_of, ti.REGIONS), "x17_edition": ("edition", ti.edition_of, ti.EDITIONS), "x12_scent": ("scent", ti.scent_of, ti.SCENTS),
}


def _texts(spark, d):
    """Each listing's title and specs as one text x."""
    return r.listings(spark, d).select("product", F.concat_ws(" ", "title", F.coalesce("specs", F.lit(""))).alias("x"))


def _attribute(name, column, rule, rules):
    @query(name, with_views(f"SELECT product, {_sql_rules(rules, TEXT)} AS {column} FROM listings"))
    def attribute(spark, d):
        return ti.with_told(_texts(spark, d), ["x"], **{column: rule(F.col("x"))}).select("product", column)


for _name, (_column, _rule, _rules) in BLOCKS.items():
    _attribute(_name, _column, _rule, _rules)

MATERIAL_SQL = "CASE " + " ".join(f"WHEN contains(lower({TEXT}), '{w}') THEN '{v}'" for w, v in ti.MATERIALS.items()) + " END"


@query("x11_material", with_views(f"SELECT product, {MATERIAL_SQL} AS material FROM listings"))
def x11(spark, d):
    """Material of every listing."""
    return ti.with_told(_texts(spark, d), ["x"], material=ti.material_of(F.col("x"))).select("product", "material")


@query("x20_n5_categories")
def x20(spark, d):
    """Category of every listing, by the ordered table of words."""
    return ti.with_told(_texts(spark, d), ["x"], category=ti.category_of(F.col("x"))).select("product", "category")


@query("x8_x10_sizes")
def x8(spark, d):
    """Weight, size and colour (x6) of every listing."""
    x = F.col("x")
    return ti.with_told(_texts(spark, d), ["x"], weight_g=ti.weight_g(x), size=ti.size_of(x), color=ti.color_of(x)).select("product", "weight_g", "size", "color")


@query("x21_lineage")
def x21(spark, d):
    """Product line and generation of every listing."""
    return ti.with_told(r.listings(spark, d).select("product", "title"), ["title"], line=ti.lineage_of(F.col("title"))).select("product", "line.*")


@query("x22_entities")
def x22(spark, d):
    """What every listing is: a device, or a part, supply or accessory of a host; and what to search for (x55)."""
    rows = ti.with_told(r.listings(spark, d).select("product", "title", "specs"), ["title", "specs"], e=ti.entity_of(F.col("title"), F.col("specs")))
    return rows.select("product", "e.*", ti.entity_query(F.col("e")).alias("query"), ti.entity_query_with_host(F.col("e")).alias("query_with_host"))


def _featured(spark, d):
    return ti.with_told(r.listings(spark, d), ["title", "specs"], f=ti.features_of("title", "specs")).select("product", "price", "store", "f")


@query("x19_x23_features")
def x23(spark, d):
    """Features of every listing, with model (x19), tokens (x2) and words."""
    f = F.col("f")
    kept = ("brand", "category", "storage", "color", "volume", "weight", "package_count", "size", "series", "gender", "material", "mpn", "connector", "condition", "authenticity", "region", "edition", "tokens")
    return _featured(spark, d).select("product", *[f[k].alias(k) for k in kept], f["e"]["model"]["model"].alias("model"), f["e"]["model"]["query"].alias("query"))


def _pairs(spark, d):
    """Search results with both sides' features: each title's features are computed once, in the joined rows they are columns."""
    known = stored(_featured(spark, d), "features")
    a = known.select(F.col("product").alias("reference"), F.col("price").alias("price_a"), F.col("f").alias("a"))
    b = known.select(F.col("product").alias("candidate"), F.col("price").alias("price_b"), F.col("store"), F.col("f").alias("b"))
    return r.found_listings(spark, d).join(a, "reference").join(b, "candidate")


def _told_pairs(spark, d, scores=True, **told):
    """Search results with both prices and what both sides' features tell, once for each different pair of texts; and the features of each number of a text."""
    rows, texts = ti.numbered(r.listings(spark, d), ["title", "specs"], f=ti.features_of("title", "specs"))
    known = stored(rows.select("product", "price", "text"), "listings")
    side = lambda name, k: known.select(F.col("product").alias(name), F.col("price").alias(f"price_{k}"), F.col("text").alias(f"text_{k}"))
    pairs = stored(r.found_listings(spark, d).join(side("reference", "a").hint("merge"), "reference").join(side("candidate", "b").hint("merge"), "candidate"), "pairs")
    return ms.told_of_texts(pairs, texts, texts, scores, **told), texts


@query("d1_d3_scores")
def d1(spark, d):
    """Score of every search result, its gate and diagnosis (d3), what to warn of (d24), feature score (d4, d5)."""
    a, b, s = F.col("a"), F.col("b"), F.col("s")
    rows, _ = _told_pairs(spark, d, said=ms.diagnosis(s, a, b), warn=ms.warn_kind(s, a, b, n.confidence(s["score"]).cast("bigint")), features=ms.feature_score(a, b, a["category"]))
    return rows.select("reference", "candidate", s["score"].alias("score"), s["gate"].alias("gate"), "said.*", "warn", "features")


@query("d7_d12_d18_parts")
def d7(spark, d):
    """The parts of a score by themselves: token overlap, compatible models (d12), lines (d14) and roles (d15), categories (d16), penalties of category (d17) and variant."""
    a, b = F.col("a"), F.col("b")
    parts = {
        "token_overlap": ms.token_overlap(a, b), "models": ms.models_compatible(a["e"]["model"]["model"], b["e"]["model"]["model"]), "lines": ms.lines_compatible(a["line"], b["line"]),
        "roles": ~ms.roles_clash(a["e"]["entity"], b["e"]["entity"]), "categories": ~ms.categories_clash(a["category"], b["category"]), "category_penalty": ms.category_penalty(a["category"], a, b), "variant_penalty": ms.variant_penalty(a, b),
    }
    rows, _ = _told_pairs(spark, d, False, **parts)
    return rows.select("reference", "candidate", *parts)


@query("t5_t6_top_matches")
def t6(spark, d):
    """Up to three candidates of every reference, from 0.85 of the least score and 1.4 times its category's price ratio; place 1 with a score above 0.55 is the best match (t5)."""
    rows, _ = _told_pairs(spark, d, category=F.col("a.category"))
    return ms.best(rows, 0.55 * 0.85, n.price_ratio_for(F.col("category")) * 1.4, 3).select("reference", "candidate", "score", "place")


@query("t7_best_with_fallback")
def t7(spark, d):
    """The strict match of every reference, else the best above 0.5 within 1.3 times the usual price ratio."""
    rows, _ = _told_pairs(spark, d, category=F.col("a.category"))
    ok = lambda least, ratio: (F.col("score") > least) & n.prices_compatible(F.col("price_a"), F.col("price_b"), ratio)
    tier = F.when(ok(0.55, n.price_ratio_for(F.col("category"))), 0).when(ok(0.5, 1.3 * 1.3), 1)
    place = F.row_number().over(Window.partitionBy("reference").orderBy("tier", F.desc("score"), "position"))
    return rows.withColumn("tier", tier).where("tier IS NOT NULL").withColumn("n", place).where("n = 1").select("reference", "candidate", "score", "tier")


@query("t8_d27_search_pick")
def t8(spark, d):
    """Search results from 0.38 within a price ratio of 1.5, then those of any score, then of the same category: of each reference the first tier that has any,
    its ten best re-ranked by priority."""
    rows, _ = _told_pairs(spark, d, clash=ms.categories_clash(F.col("a.category"), F.col("b.category")))
    near = n.prices_compatible(F.col("price_a"), F.col("price_b"), 1.5)
    tier = F.when((F.col("score") >= 0.38) & near, 0).when((F.col("score") > 0) & near, 1).when(~F.col("clash"), 2)
    w = Window.partitionBy("reference")
    best = rows.withColumn("tier", tier).where("tier IS NOT NULL").withColumn("first", F.min("tier").over(w)).where("tier = first")
    ten = best.withColumn("n", F.row_number().over(w.orderBy(F.desc("score"), "position"))).where("n <= 10")
    priority = m.priority(n.confidence(F.col("score")), F.col("price_b"), F.col("price_a"), F.lit(None).cast("double"), F.lit(True))
    place = F.row_number().over(w.orderBy(F.desc("priority"), F.desc("score"), "position"))
    return ten.withColumn("priority", priority).withColumn("place", place.cast("bigint")).select("reference", "candidate", "tier", "priority", "place")


@query("d28_offers_from_ranked")
def d28(spark, d):
    """The offer of each reference from its ranked candidates: the best one verified or probable, or a choice among them, or nothing found."""
    top = ms.best(_told_pairs(spark, d)[0], 0.38, 1.5, 3).withColumn("confidence", n.confidence(F.col("score")))
    best = top.groupBy("reference").agg(F.max(F.when(F.col("place") == 1, F.col("confidence"))).alias("best"), F.max(F.when(F.col("place") == 2, F.col("confidence"))).alias("second"), (F.count(F.lit(1)) - 1).alias("alternatives"), F.max(F.when(F.col("place") == 1, F.struct("candidate", "price_b"))).alias("top"))
    o = m.outcome(F.col("best"), F.col("second"), F.col("alternatives"))
    said = r.listings(spark, d).select(F.col("product").alias("reference")).join(best.withColumn("o", o), "reference", "left")
    picked = F.col("o.auto_pick")
    return said.select("reference", F.when(picked, F.col("top.candidate")).alias("candidate"), F.when(picked, F.col("top.price_b")).alias("price"), F.coalesce("o.status", F.lit("not_found")).alias("status"), F.coalesce("alternatives", F.lit(0)).alias("alternatives"))


@query("d26_card_verify")
def d26(spark, d):
    """Each reference's best result checked against the card behind it: verified from 90 (from 95 where it was alone), at the lower of both prices; else a choice."""
    rows, texts = _told_pairs(spark, d)
    top = ms.best(rows, 0.38, 1.5, 2).withColumn("alone", F.count(F.lit(1)).over(Window.partitionBy("reference")) == 1).where("place = 1")
    card = r.listings(spark, d).select(F.col("product").alias("candidate"), F.concat("title", F.when(F.col("product") % 3 == 0, " оригинал").otherwise("")).alias("card_title"), (F.col("price") * F.when(F.col("product") % 4 == 0, 0.9).otherwise(1.1)).alias("card_price"))
    seen, card_texts = ti.numbered(card, ["card_title"], f=ti.features_of("card_title"))
    met = top.withColumn("first", n.confidence(F.col("score"))).drop("text_b", "s", "score").join(seen.select("candidate", "card_price", F.col("text").alias("text_b")), "candidate")
    rows = ms.told_of_texts(stored(met, "cards"), texts, card_texts).withColumn("again", n.confidence(F.col("score")))
    sure = (F.col("again") >= 90) | (F.col("alone") & (F.col("first") >= 95))
    return rows.select("reference", "candidate", F.col("again").alias("confidence"), F.when(sure, "verified").otherwise("needs_choice").alias("status"), F.when(sure, F.least("price_b", "card_price")).alias("price"))


@query("j17_entities")
def j17(spark, d):
    """Products of one store matched to those of another: every pair that the gates on category, maker, model and price let through is scored, the three best from 0.55 kept."""
    rows, texts = ti.numbered(r.listings(spark, d).where("store IN (0, 1)"), ["title", "specs"], f=ti.features_of("title", "specs"))
    side = lambda store, name: rows.where(F.col("store") == store).select(F.col("product").alias(name), "price", "text")
    return ms.entities_of_texts(side(0, "reference"), side(1, "candidate"), texts)


SQL_TOKENS = "[w for w in string_split(lower({x}), ' ') if len(w) > 2]"


@query("d11_serp_confidence", with_views(rf"""WITH s AS (SELECT a.product, a.title AS x, b.title AS y FROM listings a JOIN listings b ON b.product = a.product + 40),
m AS (SELECT *, regexp_extract_all(x, '(\d+)\s*(?:gb|гб)', 1, 'i') AS gx, regexp_extract_all(y, '(\d+)\s*(?:gb|гб)', 1, 'i') AS gy, regexp_matches(x, '{ident.PHONE_WORDS}', 'i') AS phone, regexp_matches(y, '{ident.JUNK}|{ident.FURNITURE_WORDS}|{ident.REPLICA_WORDS}', 'i') AS junk,
regexp_matches(x, '{ident.REPLICA_WORDS}', 'i') OR regexp_matches(x, '{ident.JUNK}', 'i') AS asked, try_cast(regexp_extract(x, '(\d{{1,2}})\s*/\s*(\d{{2,4}})\s*(?:gb|гб)?', 2, 'i') AS INT) AS rom FROM s),
z AS (SELECT *, [v for v in list_transform(gx, lambda g: g::INT) if v BETWEEN 32 AND 2048] AS sx, [v for v in list_transform(gy, lambda g: g::INT) if v BETWEEN 32 AND 2048] AS sy, {SQL_TOKENS.format(x='x')} AS wx, {SQL_TOKENS.format(x='y')} AS wy FROM m)
SELECT product, CASE WHEN junk AND phone AND NOT asked THEN 0 WHEN len(sx) = 1 AND len(sy) = 1 AND sx[1] <> sy[1] THEN 0 WHEN rom >= 32 AND len(sy) = 1 AND sy[1] <> rom THEN 0
WHEN len(wx) = 0 THEN 50 ELSE floor(len([w for w in wx if list_contains(wy, w)]) * 100.0::DOUBLE / len(wx) + 0.5::DOUBLE)::BIGINT END AS confidence FROM z"""))  # fmt: skip
def d11(spark, d):
    """Confidence of a search result on stores whose results hold junk: 0 for accessories, furniture or dummies of a phone, 0 for other memory, else the shared words."""
    x = r.listings(spark, d)
    pairs = x.select("product", F.col("title").alias("x")).join(x.select((F.col("product") - 40).alias("product"), F.col("title").alias("y")), "product")
    return pairs.select("product", ident.serp_confidence(F.col("x"), F.col("y"), ident.JUNK).cast("bigint").alias("confidence"))


@query("x24_x25_fingerprints")
def x24(spark, d):
    """Identity of every offer (article, line, generation, title) and of its card (brand, model, memory, colour, article); canonical id (x26)."""
    f, article = ti.features_of("title", "specs", ident.OF_FINGERPRINTS), F.col("product").cast("string")
    told = {
        "named": ti.let(f, lambda f: F.struct(ident.offer_fingerprint(f["title"], F.lit(None).cast("string"), f["line"]).alias("offer"), ident.canonical_id(f["brand"], f["e"]["model"]["model"], f["storage"], f["category"]).alias("canonical"), ident.card_parts(f).alias("card"), ident.card_bare(f["title"]).alias("bare")))
    }
    x = F.col("named")
    rows = ti.with_told(r.listings(spark, d), ["title", "specs"], **told)
    return rows.select("product", ident.with_article(article, x["offer"]).alias("offer"), ident.card_of(x["card"], article, x["bare"]).alias("card"), x["canonical"].alias("canonical"))


@query("f12_identity_excluded")
def f12(spark, d):
    """Offers that a rejected identity bars: the same, of the same article, or of the same line and generation."""
    named = ident.offer_fingerprint(F.col("title"), F.lit(None).cast("string"), ti.lineage_of(F.col("title")))
    rows = ti.with_told(r.listings(spark, d).select("product", "title"), ["title"], named=named)
    prints = rows.select("product", ident.with_article(F.lpad(F.col("product").cast("string"), 6, "0"), F.col("named")).alias("print"))
    rejected = prints.select((F.col("product") + 41).alias("product"), F.array("print").alias("rejected"))
    return prints.join(rejected, "product", "left").select("product", ident.identity_excluded(F.col("print"), F.coalesce("rejected", F.array().cast("array<string>"))).alias("excluded"))


@query("f21_search_gate", with_views("""WITH c AS (SELECT p_partkey, ['apparel', 'shoes', 'smartphones', 'cosmetics', 'generic', 'pet_food', 'sports'][(p_partkey % 7 + 1)::INT] AS category, ['lamoda', 'mvideo', 'dns', 'citilink', 'ozon'][(p_partkey // 7 % 5 + 1)::INT] AS store FROM part)
SELECT p_partkey, CASE WHEN store = 'lamoda' THEN CASE WHEN category NOT IN ('apparel', 'shoes', 'sports', 'kids', 'cosmetics') THEN 'fashion_only' END WHEN store IN ('mvideo', 'dns', 'citilink') AND category IN ('apparel', 'shoes', 'cosmetics', 'detergents', 'pet_food', 'home_textile') THEN 'electronics_only' END AS reason FROM c"""))
def f21(spark, d):
    """Why a store isn't asked for a product."""
    k = F.col("p_partkey")
    category = r.pick(("apparel", "shoes", "smartphones", "cosmetics", "generic", "pet_food", "sports"), k)
    return r.table(spark, d, "part").select("p_partkey", ident.search_gate(r.pick(("lamoda", "mvideo", "dns", "citilink", "ozon"), F.expr("p_partkey div 7")), category).alias("reason"))


@query("x55_x56_queries")
def x55(spark, d):
    """Up to three different queries for every listing (x56): the entity's, by features, by model and memory, by model."""
    return _featured(spark, d).select("product", ident.query_set(F.col("f")).alias("queries"))


@query("n35_query_variants")
def n35(spark, d):
    """The query of each of five strategies for every listing, and whether it would find the host only (n36)."""
    rows = _featured(spark, d).select("product", F.col("f"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("variant"))
    q = ident.query_variant(F.col("f"), F.col("variant"), F.when(F.col("product") % 2 == 0, F.col("product").cast("string")))
    return rows.select("product", "variant", q.alias("query"), ident.host_only(q, F.col("f.e.entity")).alias("host_only"))


@query("d65_exact_model_query", with_views(f"""SELECT product, NOT regexp_matches(q, '{ident.CONSTRAINT}', 'i') AND len(q) BETWEEN 1 AND 80 AND len(string_split(q, ' ')) <= 8 AS exact
FROM (SELECT product, trim(regexp_replace(lower(CASE WHEN product % 5 = 0 THEN title || ' до 30000' ELSE title END), '\\s+', ' ', 'g')) AS q FROM listings)"""))
def d65(spark, d):
    """Whether a query names a model: short, and without words of a budget."""
    q = F.when(F.col("product") % 5 == 0, F.concat("title", F.lit(" до 30000"))).otherwise(F.col("title"))
    return r.listings(spark, d).select("product", ident.names_model(q, ident.CONSTRAINT).alias("exact"))


@query("d34_pick_history")
def d34(spark, d):
    """What a user's earlier picks of a model add to a candidate's score: by url 5 to 2 hundredths, by title 3 to 1, the latest pick first."""
    f = F.col("f")
    rows = _featured(spark, d).select("product", f["title"].alias("title"), ms.compact(f["e"]["model"]["query"]).alias("model"), F.concat(F.lit("https://x/p/"), F.col("product") % 500).alias("url"))
    order = Window.partitionBy("model").orderBy(F.desc("product"))
    picks = rows.withColumn("turn", F.row_number().over(order) - 1).where("turn < 5").select("model", "turn", F.col("url").alias("past_url"), F.col("title").alias("past_title"))
    hit = F.when(F.lower("url").contains(F.lower("past_url")), F.greatest(F.lit(2), 5 - F.col("turn"))).when(F.lower("title").contains(F.substring(F.lower("past_title"), 1, 24)), F.greatest(F.lit(1), 3 - F.col("turn")))
    # of several picks that a candidate is like, the latest counts
    found = rows.join(picks, "model").withColumn("hit", hit).where("hit IS NOT NULL").groupBy("product").agg(F.min_by("hit", "turn").alias("boost"))
    return rows.select("product").join(found, "product", "left").select("product", F.coalesce("boost", F.lit(0)).alias("boost"), (F.coalesce("boost", F.lit(0)) * 0.01).alias("delta"))
