"""Rules that complete others: targets and configuration, related pages, digests, limits, publishing, promotion, rule packs, ingest of searches and requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def target_rank(url: Column, tier: Column) -> Column:
    """Known link, programming interface, others, browser tab."""
    return F.when(url.isNotNull(), 0).when(tier == "api", 1).when(tier == "tab", 3).otherwise(2)


def clamped(value: Column, default: Column, low: int, high: int) -> Column:
    """A setting within its range; the default where it isn't given."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(value, default)))


def related_pages(pages: DataFrame, links: DataFrame, most: int) -> DataFrame:
    """Up to `most` pages for each page (page, brand, category): those that it is linked to, then of its brand, then of its category, smaller ids first.

    Peers are not joined with each other: the first most + 1 pages of each brand and category are all that any page can need.
    """
    firsts = []
    for k, key in enumerate(("brand", "category")):
        order = F.row_number().over(Window.partitionBy(key).orderBy("page"))
        few = pages.where(F.col(key).isNotNull()).withColumn("n", order).where(F.col("n") <= most + 1).select(key, F.col("page").alias("other"))
        firsts.append(pages.select("page", key).join(few, key).select("page", "other", F.lit(k + 1).alias("turn")))
    every = links.select("page", "other", F.lit(0).alias("turn")).unionByName(firsts[0]).unionByName(firsts[1]).where("page <> other")
    one = every.groupBy("page", "other").agg(F.min("turn").alias("turn"))
    place = F.row_number().over(Window.partitionBy("page").orderBy("turn", "other"))
    return one.withColumn("place", place.cast("bigint")).where(F.col("place") <= most)


def hub_counts(pages: DataFrame, key: str, label: str, order: list[str], least: int = 2) -> DataFrame:
    """Keys of `least` pages or more, with the last label that isn't null."""
    last = F.max_by(label, F.when(F.col(label).isNotNull(), F.struct(*order)))
    return pages.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("pages"), last.alias("label")).where(F.col("pages") >= least)


def write_allowed(before: Column, active: Column, deleted: Column, stored: Column, was_deleted: Column, limit: int) -> Column:
    """Deleted rows always; stored ones unless they come back from deletion; others below the limit."""
    return deleted | (stored & ~was_deleted) | (active < limit)


def premium_users(premium: DataFrame, keys: DataFrame, now: Column) -> DataFrame:
    """Users whose own term and license, which is active, have not run out."""
    lasting = lambda c: F.col(c).isNull() | (F.col(c) > now)
    good = keys.where(F.col("is_active") & lasting("license_expires_at"))
    return premium.where(lasting("expires_at")).join(good, F.col("license_key_id") == F.col("id"), "left_semi").select("user_id").distinct()


def top_drops(moves: DataFrame, by: list[str], most: int = 3) -> DataFrame:
    """Each group's deepest drops (delta below 0)."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy("delta", "product_id"))
    return moves.where("move = 'down'").withColumn("place", place.cast("bigint")).where(F.col("place") <= most)


def promotion_outcome(reason: Column, status: Column, evidence: Column) -> Column:
    """What a promotion does to a mapping: nothing with a reason against it, or for one that is disputed, dead, or set by hand; else a shared, active one."""
    return F.when(reason != "ok", reason).when(status.isin("disputed", "dead"), F.concat(F.lit("status_"), status)).when(evidence == "manual", "manual_kept").otherwise("promoted")


def version_at_least(version: Column, least: tuple[int, ...]) -> Column:
    """Whether a dotted version is not below another; anything that isn't numbers is."""
    parts = F.transform(F.split(version, r"\."), lambda p: p.try_cast("int"))
    at = lambda i: F.coalesce(F.try_element_at(parts, F.lit(i + 1)), F.when(F.size(parts) <= i, 0))
    whole = F.forall(parts, lambda p: p.isNotNull())
    above = F.struct(*[at(i).alias(f"p{i}") for i in range(len(least))]) >= F.struct(*[F.lit(v).alias(f"p{i}") for i, v in enumerate(least)])
    return F.coalesce(whole & above, F.lit(False))


def pack_error(pack: Column, least: tuple[int, ...] = (1, 0, 0)) -> Column:
    """Why a rule pack (version, min_confidence, roles and hosts as arrays of (id, pattern), relations) is refused, or null."""
    filled = lambda a: a.isNotNull() & F.forall(a, lambda e: (F.trim(F.coalesce(e["id"], F.lit(""))) != "") & (F.trim(F.coalesce(e["pattern"], F.lit(""))) != ""))
    given = F.trim(F.coalesce(pack["version"], F.lit(""))) != ""
    sound = F.coalesce(pack["min_confidence"].between(0, 1), F.lit(False)) & filled(pack["roles"]) & filled(pack["hosts"]) & pack["relations"].isNotNull()
    return F.when(~given, "invalid_payload").when(~version_at_least(pack["version"], least), "invalid_version").when(~sound, "invalid_payload")


def packs_merged(base: Column, overlay: Column) -> Column:
    """The overlay's parts where they aren't empty, else the base's."""
    part = lambda k: F.when(F.coalesce(F.size(overlay[k]), F.lit(0)) > 0, overlay[k]).otherwise(base[k]).alias(k)
    merged = F.struct(overlay["version"].alias("version"), F.coalesce(overlay["min_confidence"], base["min_confidence"]).alias("min_confidence"), part("roles"), part("hosts"), part("relations"))
    return F.when(F.coalesce(overlay["version"], F.lit("")) == "", base).otherwise(merged)


def redacted_payload(payload: Column, private: str = r"(?i)prompt|password|token|email|authorization") -> Column:
    """A map without private keys; links without their query, titles at most 80 characters, queries 60, other values 300."""
    cut = lambda v, most: F.when(F.length(v) <= most, v).otherwise(F.concat(F.substring(v, 1, most - 1), F.lit("…")))
    kept = F.map_filter(payload, lambda k, v: ~k.rlike(private))
    low = F.lower
    return F.transform_values(kept, lambda k, v: F.when(low(k).contains("url"), F.substring(F.regexp_replace(v, r"[?#].*$", ""), 1, 200)).when(low(k).contains("query"), cut(F.trim(v), 60)).when(low(k).contains("title"), cut(F.trim(v), 80)).otherwise(cut(v, 300)))


def like_pattern(query: Column) -> Column:
    """What a search box gives as a pattern: characters with a meaning of their own left out."""
    return F.concat(F.lit("%"), F.regexp_replace(F.trim(query), r"[%_,.()]", ""), F.lit("%"))
