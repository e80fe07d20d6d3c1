"""Offers as they are kept and shown: merging, ranking with fallbacks, publishing gates, groups of products, mapping history."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import dropped_client, has_price
from ..sources.shared import shared_folder


def alertable(o: DataFrame) -> Column:
    """Priced, in stock, linked to a card, and verified or probable (columns price, status, url)."""
    return has_price(F.col("price")) & F.col("status").isin("verified", "probable", "serp_only") & F.coalesce(~F.col("url").rlike(r"(?i)search\?"), F.lit(False))


def merged(old: DataFrame, new: DataFrame, key: list[str], ending: tuple[str, ...] = ("oos", "blocked")) -> DataFrame:
    """Last known good: the new price unless it is missing; a new status of `ending` clears the price; other fields are filled up."""
    both = old.select(*key, F.col("price").alias("p0"), F.col("status").alias("s0"), F.col("rating").alias("r0")).join(new.select(*key, F.col("price").alias("p1"), F.col("status").alias("s1"), F.col("rating").alias("r1")), key, "full")
    price = F.when(F.col("s1").isin(*ending), F.lit(None)).otherwise(F.when(has_price(F.col("p1")), F.col("p1")).otherwise(F.col("p0")))
    return both.select(*key, price.alias("price"), F.coalesce("s1", "s0").alias("status"), F.coalesce("r1", "r0").alias("rating"))


def with_fallback(candidates: DataFrame, key: str, order: list[Column], tiers: list[Column]) -> DataFrame:
    """Of each key, the best row of the first tier that has any: a relaxation ladder in one window."""
    tier = F.coalesce(*[F.when(t, F.lit(k)) for k, t in enumerate(tiers)])
    rows = candidates.withColumn("tier", tier).where("tier IS NOT NULL")
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy("tier", *order))).where("__n = 1").drop("__n")


def shown(o: DataFrame, key: str, source: Column, rows: int = 4) -> DataFrame:
    """Order of a product's offers in a table: its own store, priced ones by price, the rest; and which are visible."""
    rank = F.when(source, 0).when(has_price(F.col("price")), 1).otherwise(3)
    place = F.row_number().over(Window.partitionBy(key).orderBy(rank, F.when(rank == 1, F.col("price")), "marketplace"))
    return o.withColumn("place", place.cast("bigint")).withColumn("visible", F.col("place") <= rows)


def placed(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their place from 1 in an order without ties: sorted into ranges, then numbered by the rows before each range.

    The sorted ranges are stored, for a second sort might cut them elsewhere. No task holds more than a range.
    """
    path = shared_folder(rows.sparkSession, "placed")
    ranges = rows.orderBy(*order).withColumn("__range", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    schema = ranges.schema
    ranges.write.parquet(path)
    stored = rows.sparkSession.read.schema(schema).parquet(path)
    sizes = stored.groupBy("__range").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("__before", F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("__range")) - F.col("n")).select("__range", "__before")
    return stored.join(F.broadcast(before), "__range").withColumn(name, F.col("__before") + F.col("__at") + 1).drop("__range", "__at", "__before")


def outcomes_by_page(rows: DataFrame, order: list[Column], outcome: Column, size: int) -> DataFrame:
    """page (from 0), outcome, pages: rows in order are cut into pages of `size`, and counted by outcome."""
    at = placed(rows.withColumn("outcome", outcome), order, "place")
    return at.groupBy(F.floor((F.col("place") - 1) / size).alias("page"), "outcome").agg(F.count(F.lit(1)).alias("pages"))


def weak_title(x: Column) -> Column:
    t = F.trim(F.coalesce(x, F.lit("")))
    return (F.length(t) < 8) | t.rlike(r"(?i)(^|[^a-z0-9_])(seo\s*smoke|smoke\s*fixture|test\s*fixture)($|[^a-z0-9_])") | t.rlike(r"(?i)^(test|fixture|asdf|xxx)($|[^a-z0-9_])") | t.rlike(r"^\d{5,}$") | (t.rlike(r"(?i)^[a-z0-9_-]{6,}$") & (F.length(t) < 20))


def gate(score: Column, source: Column, reviews: Column, overview: Column, pros: Column, cons: Column, title: Column, at_least: float, few: int, long: int) -> Column:
    """First reason against publishing, or null."""
    return F.coalesce(
        F.when(score.isNull(), "empty_analysis"), F.when(source == "local", "local_source"), F.when(score < at_least, "low_quality"), F.when((reviews < few) & (overview < long), "insufficient_reviews"),
        F.when((pros < 1) | (cons < 1), "thin_content"), F.when(weak_title(title), "weak_title"),
    )


def compare_alerts(old: DataFrame, new: DataFrame, source: str, rub: float, pct: float) -> DataFrame:
    """Plans of two kinds from a product's old and new offers (product, marketplace, price): 'drop' on the same store, unless it falls below 35 % by more than 20 000;
    'cheaper_elsewhere' than the old price of the source store, where the other store got cheaper than before but by no drop of its own."""
    pairs = new.select("product", "marketplace", F.col("price").alias("now")).join(old.select("product", "marketplace", F.col("price").alias("before")), ["product", "marketplace"], "left")
    own = old.where(F.col("marketplace") == source).select("product", F.col("price").alias("own"))
    rows = pairs.join(own, "product", "left").where(F.col("now") > 0)
    limits = F.lit(float(rub)), F.lit(float(pct))
    flag = lambda c: F.coalesce(c, F.lit(False))
    fell = flag(dropped_client(F.col("before"), F.col("now"), *limits))
    absurd = flag((F.col("now") < F.col("before") * 0.35) & (F.col("before") - F.col("now") > 20_000))
    cheaper = flag((F.col("marketplace") != source) & dropped_client(F.col("own"), F.col("now"), *limits) & (F.col("now") < F.col("before"))) & ~fell
    kind = F.when(fell & ~absurd, "drop").when(cheaper, "cheaper_elsewhere")
    return rows.select("product", "marketplace", "before", "now", kind.alias("kind")).where("kind IS NOT NULL")


def same_products(items: DataFrame, keys: str) -> DataFrame:
    """Pairs of items that share any key of an array column: exploded and joined by key, from each key's smallest item to the others."""
    one = items.select("id", F.explode(F.array_distinct(keys)).alias("key"))
    low = one.groupBy("key").agg(F.min("id").alias("first"))
    return one.join(low, "key").where("id <> first").select("first", "id").distinct()


def clusters(items: DataFrame, links: DataFrame) -> DataFrame:
    """id, component of every item: the smallest id that links (two columns) lead to. Each round takes the smallest label of the neighbours, then that label's own."""
    spark = items.sparkSession

    def stored(df: DataFrame) -> DataFrame:
        path = shared_folder(spark, "clusters")
        schema = df.schema
        df.write.parquet(path)
        return spark.read.schema(schema).parquet(path)

    pairs = links.toDF("a", "b")
    both = stored(pairs.union(pairs.select("b", "a")).distinct())
    labels = stored(items.select("id", F.col("id").alias("component")).distinct())
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        met = stored(labels.join(near, "id", "left").select("id", F.least("component", "near").alias("low"), F.col("component").alias("was")))
        jump = met.join(met.select(F.col("id").alias("low"), F.col("low").alias("further")), "low", "left")
        new = stored(jump.select("id", F.least("low", "further").alias("component"), "was"))
        if not new.where("component <> was").limit(1).count():
            return new.select("id", "component")
        labels = new.select("id", "component")


def mapping_state(events: DataFrame) -> DataFrame:
    """Fold of mapping events (edge, at, id, action, evidence, confidence) in order: hits, confidence, evidence, status and failures of each edge.

    An upsert never revives a disputed or dead edge unless it is manual; evidence only rises (auto, multi_user, manual); a manual one below 70 is unverified. A
    dispute takes 35 of confidence and 2 hits; the third failure kills. One edge's events stay together; only its state is held.
    """
    rank = {"auto": 0, "multi_user": 1, "manual": 2}

    def step(state: dict | None, action: str, evidence: str, confidence: int) -> dict | None:
        s = dict(state) if state else {"hits": 0, "confidence": 0, "evidence": None, "status": None, "failures": 0}
        closed = s["status"] in ("disputed", "dead")
        if action == "upsert":
            if closed and evidence != "manual":
                return state
            weak = evidence == "manual" and confidence < 70
            s["evidence"] = s["evidence"] if s["evidence"] and rank[s["evidence"]] > rank[evidence] else evidence
            s["status"] = s["status"] if closed else "unverified" if weak else "active"
            s["hits"], s["confidence"] = s["hits"] + 1, confidence
        elif state is None:
            return None
        elif action == "dispute":
            s |= {"status": "disputed", "confidence": max(0, s["confidence"] - 35), "hits": max(0, s["hits"] - 2)}
        else:
            s["failures"] += 1
            s["status"] = "dead" if s["failures"] >= 3 else "active"
        return s

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        row = lambda: pd.DataFrame([{"edge": last, **state}])
        for rows in batches:
            for edge, action, evidence, confidence in zip(rows["edge"], rows["action"], rows["evidence"], rows["confidence"], strict=True):
                if edge != last:
                    if state:
                        yield row()
                    last, state = edge, None
                state = step(state, action, evidence, int(confidence))
        if state:
            yield row()

    ordered = events.repartition("edge").sortWithinPartitions("edge", "at", "id")
    return ordered.mapInPandas(fold, "edge bigint, hits bigint, confidence bigint, evidence string, status string, failures bigint")
