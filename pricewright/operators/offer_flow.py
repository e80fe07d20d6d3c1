"""Offers on their way through a comparison: useful or pending, finalised, folded onto a product's slots, rejected, merged, researched.

An offer is a struct (or the columns of a row) of price, url, status, error, rating, specs, manual and pool, an array of candidates (url, price, confidence, priority).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import has_price

#: Statuses that end a slot; most rejected urls, fingerprints and pool candidates that are kept.
TERMINAL = ("oos", "not_found", "blocked", "loading_card")
MOST_URLS, MOST_PRINTS, MOST_POOL = 20, 40, 3
#: Hours that a pool and a stored comparison stay fresh.
POOL_HOURS, COMPARE_HOURS = 7 * 24, 6


def pending(o: Column) -> Column:
    """Waits for the user's choice among candidates."""
    return F.coalesce(o["manual"], F.lit(False)) & (F.coalesce(F.size(o["pool"]), F.lit(0)) > 0)


def rated(o: Column) -> Column:
    return F.coalesce(o["rating"].between(1, 5), F.lit(False))


def useful(o: Column) -> Column:
    return pending(o) | has_price(o["price"]) | rated(o) | (F.coalesce(o["specs"], F.lit("")) != "")


def finalised(o: Column) -> Column:
    """struct(status, price, found): a choice if candidates wait, as it is if priced, out of stock if that is said, else not found."""
    choice = (F.coalesce(o["manual"], F.lit(False)) | F.coalesce(o["status"] == "needs_choice", F.lit(False))) & (F.coalesce(F.size(o["pool"]), F.lit(0)) > 0)
    priced = has_price(o["price"]) & ~F.coalesce(o["manual"], F.lit(False))
    gone = F.coalesce(o["status"] == "oos", F.lit(False)) | F.coalesce(o["error"].rlike("(?iu)нет в наличии|out of stock|sold out"), F.lit(False))
    status = F.when(choice, "needs_choice").when(priced, o["status"]).when(gone, "oos").otherwise("not_found")
    return F.struct(status.alias("status"), F.when(~choice & priced, o["price"]).alias("price"), (~choice & priced).alias("found"))


def folded(offers: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Last known good of each slot after its offers (price, status, rating, url) in order: a price until a terminal status or a newer price, the last valid
    rating, the last url that is bound, which a terminal status clears. Windows over the slot's offers, so no slot is held in memory."""
    c = F.col
    so_far = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = c("status").isin(*TERMINAL)
    rows = offers.withColumn("__epoch", F.count(F.when(ends, 1)).over(so_far)).withColumn("__last", F.row_number().over(Window.partitionBy(*key).orderBy(*[F.desc(o) for o in order])))
    within = Window.partitionBy(*key, "__epoch").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    good = has_price(c("price")) & ~ends
    rows = rows.select(
        *key, "__last", F.last(F.when(good, c("price")), True).over(within).alias("price"), F.last(F.when(good, c("url")), True).over(within).alias("url"), F.last("status", True).over(so_far).alias("status"),
        F.last(F.when(c("rating").between(1, 5), c("rating")), True).over(so_far).alias("rating"),
    )
    return rows.where("__last = 1").drop("__last")


def capped_unique(old: Column, new: Column, most: int) -> Column:
    """The first `most` different entries of old and then new, blanks left out, in their order."""
    return F.slice(F.array_distinct(F.filter(F.concat(F.coalesce(old, F.array().cast("array<string>")), F.array(new)), lambda x: F.coalesce(x, F.lit("")) != "")), 1, most)


def loosely_same(a: Column, b: Column) -> Column:
    return (a == b) | a.contains(b) | b.contains(a)


def open_pool(pool: Column, rejected: Column) -> Column:
    """Candidates that no rejected url bars, by priority (confidence without one) and confidence; the first few."""
    left = F.filter(pool, lambda p: ~F.exists(rejected, lambda u: loosely_same(p["url"], u)))
    rank = lambda p: F.coalesce(p["priority"], p["confidence"])
    order = lambda a, b: F.when(rank(a) > rank(b), -1).when(rank(a) < rank(b), 1).when(a["confidence"] > b["confidence"], -1).when(a["confidence"] < b["confidence"], 1).otherwise(0)
    return F.slice(F.array_sort(left, order), 1, MOST_POOL)


def rejected_slot(o: Column, url: Column, print_: Column) -> Column:
    """struct(urls, prints, pool, status, next): the slot after its candidate at url is rejected: barred, the others kept for a choice, or nothing left."""
    urls = capped_unique(o["rejected_urls"], url, MOST_URLS)
    pool = open_pool(o["pool"], urls)
    return F.struct(
        urls.alias("urls"), capped_unique(o["rejected_prints"], F.lower(F.trim(print_)), MOST_PRINTS).alias("prints"), pool.alias("pool"), F.when(F.size(pool) > 0, "needs_choice").otherwise("not_found").alias("status"),
        F.try_element_at(pool, F.lit(1))["url"].alias("next"),
    )


def preserved(manual: Column, o: Column) -> Column:
    """Whether a new search keeps a slot: set by hand, or verified with a price and a product page."""
    return F.coalesce(manual, F.lit(False)) | (F.coalesce(o["status"] == "verified", F.lit(False)) & has_price(o["price"]) & F.coalesce(o["url"].rlike("(?i)/product|/card|/catalog/[1-9]|/item/|/p/"), F.lit(False)) & ~F.coalesce(o["manual"], F.lit(False)))


def fresh_pool(age_hours: Column) -> Column:
    return F.coalesce(age_hours < POOL_HOURS, F.lit(False))


def fresh_comparison(priced: Column, age_hours: Column) -> Column:
    return F.coalesce(priced & (age_hours < COMPARE_HOURS), F.lit(False))


def products_merged(a: Column, b: Column) -> Column:
    """One product of two (title, offers map, urls map, pools map, compared_at, rejected map): new entries over old ones, but a priced offer over one without, old pools
    where the new are empty, the longer title, the later time; a slot whose offer waits for a choice keeps no url."""
    better = lambda k, x, y: F.when(x.isNull(), y).when(y.isNull(), x).when(has_price(x["price"]) & ~has_price(y["price"]), x).otherwise(y)
    longer = lambda k, x, y: F.when(F.coalesce(F.size(y), F.lit(0)) > 0, y).otherwise(x)
    latest = lambda k, x, y: F.coalesce(y, x)
    offers = F.map_zip_with(a["offers"], b["offers"], better)
    urls = F.map_filter(F.map_zip_with(a["urls"], b["urls"], latest), lambda k, v: ~F.coalesce(F.try_element_at(offers, k)["status"] == "needs_choice", F.lit(False)))
    return F.struct(
        F.when(F.length(b["title"]) > F.length(a["title"]), b["title"]).otherwise(a["title"]).alias("title"), offers.alias("offers"), urls.alias("urls"), F.map_zip_with(a["pools"], b["pools"], longer).alias("pools"),
        F.greatest(a["compared_at"], b["compared_at"]).alias("compared_at"),
    )


def offers_of(products: DataFrame, stores: tuple[str, ...], offers: DataFrame) -> DataFrame:
    """A row for each product (product, source, source_price) and store: its stored offer, the product's own on its source store, or not found."""
    grid = products.select("product", "source", "source_price", F.explode(F.array(*map(F.lit, stores))).alias("marketplace"))
    rows = grid.join(offers.select("product", "marketplace", "price", "status"), ["product", "marketplace"], "left")
    own = (F.col("marketplace") == F.col("source")) & F.col("status").isNull()
    return rows.select(
        "product", "marketplace", F.when(own, F.col("source_price")).otherwise(F.col("price")).alias("price"),
        F.when(own & has_price(F.col("source_price")), "verified").otherwise(F.coalesce("status", F.lit("not_found"))).alias("status"),
    )


def ids_match(a: Column, b: Column) -> Column:
    """Equal, or one ends with the other."""
    return (a == b) | a.endswith(b) | b.endswith(a)


def upserted_candidates(rows: DataFrame, key: list[str], slot: Column) -> DataFrame:
    """Search results by slot: the place of the first, and price and title of the cheapest priced (the first of equal ones), else of the first."""
    cheap = F.when(has_price(F.col("price")), F.col("price"))
    by = rows.withColumn("slot", slot).groupBy(*key, "slot").agg(F.min("position").alias("position"), F.min(F.struct(cheap.isNull().alias("none"), cheap.alias("price"), F.col("position").alias("at"), "title")).alias("m"))
    return by.select(*key, "slot", "position", F.col("m.price").alias("price"), F.col("m.title").alias("title"))


def research_verified(confidence: Column, price: Column, reference: Column, least: int = 55) -> Column:
    """Sure enough, and priced between 0.35 and 2.8 times the reference where both are known."""
    known = has_price(price) & has_price(reference)
    return (confidence >= least) & (~known | (price / reference).between(0.35, 2.8))


def research_targets(valid: Column, source: Column, requested: Column) -> Column:
    """Valid stores but the source, in their order; only those requested, if any are."""
    base = F.filter(valid, lambda s: s != source)
    wanted = F.transform(F.coalesce(requested, F.array().cast("array<string>")), lambda s: F.trim(s))
    return F.when(F.size(wanted) == 0, base).otherwise(F.filter(base, lambda s: F.array_contains(wanted, s)))


def first_found(rows: DataFrame, key: list[str], sources: tuple[str, ...], most: int = 30) -> DataFrame:
    """Results (source, position) of all sources of a key in the order of sources, the first `most`."""
    order = F.array_position(F.array(*map(F.lit, sources)), F.col("source"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy(order, "position"))
    return rows.withColumn("place", place.cast("bigint")).where(F.col("place") <= most)


def agent_step(phase, steps, searches, cost, seconds, matched, exact, most=(6, 3, 1.0, 45), enough=3):
    """parse, search, evaluate, rank or answer: what an agent does next; over a budget it answers."""
    stop = (seconds >= most[3]) | (steps >= most[0]) | (cost >= most[2])
    no_search = stop | (searches >= most[1])
    return (
        F.when(phase == "ranked", "answer").when(phase == "start", F.when(stop, "answer").when(exact, "search").otherwise("parse")).when(phase == "parsed", F.when(no_search, "answer").otherwise("search"))
        .when(phase == "searched", F.when(stop, "answer").otherwise("evaluate")).when(matched >= enough, F.when(stop, "answer").otherwise("rank")).when(no_search, "answer").otherwise("search")
    )
