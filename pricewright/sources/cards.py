"""Price and title of product cards by their store's rules, tier after tier: structured data, meta data, embedded state, style classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import trees
from .extract import GONE
from .shared import stored

#: Patterns of cards. Stores whose structured data may lie at any depth, whose offers may be sold out, and their least meta price.
SCRIPT = r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"
BARRED, BARRED_WITHIN, BARRED_ANYWHERE = r"(?i)captcha|access.?denied|challenge|robot.?check", 8000, r"(?i)showcaptcha"
META = (r"(?i)itemprop=[\"']price[\"'][^>]*content=[\"'](\d+(?:[.,]\d+)?)[\"']", r"(?i)content=[\"'](\d+(?:[.,]\d+)?)[\"'][^>]*itemprop=[\"']price[\"']", r"(?i)property=[\"']product:price:amount[\"'][^>]*content=[\"'](\d+(?:[.,]\d+)?)[\"']")
STYLED, OG_TITLE, PAGE_TITLE = r"(?i)class=[\"'][^\"']*price__main-value[^\"']*[\"'][^>]*>\s*([\d\s]+)", r"(?i)property=[\"']og:title[\"'][^>]*content=[\"']([^\"']+)[\"']", r"(?i)<title[^>]*>([^<]+)"
PRICES_VALUE, SALE, BASIC = r"\"prices\"\s*:\s*\{[^}]{0,120}\"value\"\s*:\s*\"?(\d+)", r"\"salePriceU\"\s*:\s*(\d+)", r"\"priceU\"\s*:\s*(\d+)"
NAME_STATE, BRAND_STATE = r"\"imt_name\"\s*:\s*\"((?:\\.|[^\"\\])*)\"", r"\"brand\"\s*:\s*\"((?:\\.|[^\"\\])*)\""
DEEP, BY_OFFER, STYLED_STORES, LEAST_META, DEPTH = ("yandex_market",), ("megamarket", "aliexpress", "mvideo"), ("mvideo",), {"mvideo": 100}, 10


def _amount(v: Column) -> Column:
    """A price that is a number or a text with spaces and a comma; positive, else null."""
    n = F.regexp_replace(F.regexp_replace(F.try_variant_get(v, "$", "string"), r"\s", ""), ",", ".").try_cast("double")
    return F.when(n > 0, n)


def _digits(v: Column) -> Column:
    """A number as it is, of a text the digits; positive, else null."""
    n = F.coalesce(trees.number(v), F.regexp_replace(trees.text(v), r"\D", "").try_cast("double"))
    return F.when(n > 0, n)


def _structured(pages: DataFrame) -> DataFrame:
    """page_id, price and title of the first product with a price in the structured data: anywhere in it where the store is DEEP, else through arrays and @graph, passing over what is sold out."""
    store = F.col("store")
    rows = pages.where(store.isin(*DEEP, *BY_OFFER)).select("page_id", "store", F.posexplode(F.regexp_extract_all("html", F.lit(SCRIPT), F.lit(1))).alias("script", "text")).withColumn("tree", F.try_parse_json(F.trim("text")))
    nodes = trees.descend(rows, ["page_id", "store", "script"], "tree", DEPTH, lambda name, node: store.isin(*DEEP) | name.isNull() | (name == "@graph"))
    m = trees.fields(F.col("node"))
    at = lambda k: F.try_element_at(m, F.lit(k))
    kind = F.coalesce(trees.text(at("@type")), F.array_join(F.transform(trees.items(at("@type")), trees.text), ","), F.lit(""))
    offers = F.coalesce(trees.items(at("offers")), F.when(trees.fields(at("offers")).isNotNull(), F.array(at("offers"))), F.array().cast("array<variant>"))
    of = lambda o, k: F.try_variant_get(o, f"$.{k}", "variant")
    first = F.try_element_at(offers, F.lit(1))
    told = F.coalesce(*[F.when(F.try_variant_get(v, "$", "string").isNotNull(), v) for v in (of(first, "price"), of(first, "lowPrice"), at("price"))])
    by_offer = F.when(kind.rlike("(?i)product") & ~F.coalesce(trees.text(of(first, "availability")).rlike(GONE), F.lit(False)), _amount(told))
    any_offer = F.try_element_at(F.filter(F.transform(offers, lambda o: F.coalesce(_digits(of(o, "price")), F.when(of(o, "price").isNull(), _digits(of(o, "lowPrice"))))), lambda p: p.isNotNull()), F.lit(1))
    deep = F.when(kind.contains("Product") | F.coalesce(F.try_variant_get(at("name"), "$", "string") != "", F.lit(False)), any_offer)
    brand = F.coalesce(trees.text(at("brand")), F.try_variant_get(at("brand"), "$.name", "string"))
    full = F.trim(F.concat_ws(" ", F.nullif(brand, F.lit("")), F.nullif(F.trim(trees.text(at("name"))), F.lit(""))))
    found = nodes.where(m.isNotNull()).select("page_id", "script", "path", F.when(store.isin(*DEEP), deep).otherwise(by_offer).alias("price"), F.when(store.isin(*DEEP), trees.text(at("name"))).otherwise(F.nullif(full, F.lit(""))).alias("title"))
    return found.where("price IS NOT NULL").groupBy("page_id").agg(F.min_by(F.struct("price", "title"), F.struct("script", "path")).alias("told"))


def cards(pages: DataFrame) -> DataFrame:
    """page_id, price (whole) and title of each card (page_id, store, html), nulls where it has none or keeps robots out; each tier is tried where the ones before it gave no price."""
    pages = stored(pages.select("page_id", "store", "html"), "cards")
    html, store = F.col("html"), F.col("store")
    open_ = F.when(store.isin(*BY_OFFER), ~F.substring(html, 1, BARRED_WITHIN).rlike(BARRED)).when(store.isin(*DEEP), ~html.rlike(BARRED_ANYWHERE)).otherwise(html.isNotNull())
    got = lambda pattern: F.nullif(F.regexp_extract(html, pattern, 1), F.lit(""))
    number = lambda x: F.regexp_replace(F.regexp_replace(x, r"\s", ""), ",", ".").try_cast("double")
    least = F.coalesce(*[F.when(store == s, F.lit(v)) for s, v in LEAST_META.items()], F.lit(0))
    said = number(F.coalesce(got(META[0]), got(META[1]), F.when(~store.isin(*DEEP), got(META[2])), F.when(store.isin(*STYLED_STORES), got(STYLED))))
    meta = F.when((said > 0) & (said >= least) & store.isin(*DEEP, *BY_OFFER), said)
    og = F.trim(F.coalesce(got(OG_TITLE), F.when(store.isin(*DEEP), got(PAGE_TITLE))))
    rubles = lambda x: F.when(x >= 1000, F.floor(x / 100 + 0.5)).when(x > 0, x)
    state = F.when(store == "wildberries", F.coalesce(rubles(number(got(SALE))), rubles(number(got(BASIC)))))
    decoded = lambda x: F.coalesce(F.try_variant_get(F.try_parse_json(F.concat(F.lit('"'), x, F.lit('"'))), "$", "string"), x)
    named = F.nullif(F.trim(F.concat_ws(" ", decoded(got(BRAND_STATE)), decoded(got(NAME_STATE)))), F.lit(""))
    embedded = F.when(store.isin(*DEEP), number(got(PRICES_VALUE)))
    rows = pages.join(_structured(pages), "page_id", "left").where(F.coalesce(open_, F.lit(False)))
    tier = F.coalesce(
        F.when(F.col("told").isNotNull(), F.struct(F.col("told.price").alias("price"), F.col("told.title").alias("title"))), F.when(meta.isNotNull(), F.struct(meta.alias("price"), og.alias("title"))),
        F.when(embedded > 0, F.struct(embedded.alias("price"), F.lit(None).cast("string").alias("title"))), F.when(state.isNotNull(), F.struct(state.alias("price"), named.alias("title"))),
    )
    priced = rows.select("page_id", tier.alias("c"))
    return pages.select("page_id").join(priced, "page_id", "left").select("page_id", F.floor(F.col("c.price") + 0.5).alias("price"), "c.title")
