"""Pages published from a stored snapshot: only what changed is judged and written, and a replay writes the same.

A store is a folder of numbered deltas, each with the rows that one run changed; the present pages are each key's row of the last delta. Run k reads the deltas before k and (over)writes
delta k, so a micro-batch that foreachBatch repeats changes nothing more.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import has_price
from ..sources.shared import shared_folder, stored

OFFERS = "array<struct<marketplace:string,price:double,url:string>>"
PAGE = f"key string, slug string, canon string, hash string, quality double, status string, reason string, primary boolean, primary_slug string, price double, offers {OFFERS}, fingerprint string, since bigint"


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    path: str

    @classmethod
    def new(cls, spark: SparkSession) -> Store:
        return cls(spark, shared_folder(spark, "pages"))

    def _numbers(self) -> list[int]:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(int(f.getPath().getName()[1:]) for f in files.listStatus(where)) if files.exists(where) else []

    def delta(self, number: int) -> DataFrame:
        return self.spark.read.schema(PAGE).parquet(f"{self.path}/d{number}")

    def pages(self, before: int | None = None) -> DataFrame:
        """The pages after the runs with smaller numbers (all runs, without one), with the run that wrote each as `run`."""
        known = [n for n in self._numbers() if before is None or n < before]
        out = self.spark.createDataFrame([], f"{PAGE}, run bigint")
        for n in known:
            out = out.union(self.delta(n).withColumn("run", F.lit(n).cast("bigint")))
        last = out.groupBy("key").agg(F.max_by(F.struct("*"), "run").alias("p")) if len(known) > 1 else out.select("key", F.struct("*").alias("p"))
        return last.select("p.*")

    def write(self, number: int, rows: DataFrame) -> DataFrame:
        rows.select(*[c.split()[0] for c in PAGE.split(", ")]).write.mode("overwrite").parquet(f"{self.path}/d{number}")
        return self.delta(number)


def offers_fingerprint(offers: Column, price: Column) -> Column:
    """The same for the same priced offers in any order and the same price."""
    told = F.transform(F.array_sort(offers), lambda o: F.concat_ws("|", o["marketplace"], F.coalesce(o["price"].cast("string"), F.lit("-")), F.coalesce(o["url"], F.lit(""))))
    return F.sha2(F.concat_ws(";", F.coalesce(price.cast("string"), F.lit("-")), F.array_join(told, ";")), 256)


def slugs(new: DataFrame, taken: DataFrame) -> DataFrame:
    """key and slug of new rows (key, base): their base, or from 2 on the smallest numbers behind it that no other page has; the smaller key first. taken: slugs of other pages.

    Of each base the i-th row gets the i-th free number, found among the taken ones in one sorted pass. A numbered slug may be another row's base: of rows that get one slug
    the smallest key keeps it and the others try again, knowing what is taken, until all differ.
    """
    taken, left, done = taken.select("slug").distinct(), new.select("key", "base"), []
    while True:
        tail = F.regexp_extract("slug", r"^(.+)-([1-9]\d{0,8})$", 2)
        numbered = taken.where(tail.try_cast("bigint") >= 2).select(F.regexp_extract("slug", r"^(.+)-(\d+)$", 1).alias("base"), tail.try_cast("bigint").alias("n"))
        used = taken.select(F.col("slug").alias("base"), F.lit(1).cast("bigint").alias("n")).union(numbered).join(left.select("base").distinct(), "base", "left_semi")
        # below the j-th taken number t lie t - j free ones: the i-th row passes the taken numbers with t - j < i
        by_base = lambda *o: Window.partitionBy("base").orderBy(*o)
        marks = used.select("base", (F.col("n") - F.row_number().over(by_base("n"))).alias("at"), F.lit(1).alias("mark"), F.lit(None).cast("string").alias("key"))
        rows = left.select("base", F.row_number().over(by_base("key")).cast("bigint").alias("at"), F.lit(0).alias("mark"), "key")
        passed = F.sum("mark").over(by_base("at", "mark").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        given = rows.union(marks).withColumn("n", F.col("at") + passed).where("mark = 0").select("key", "base", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("n").cast("string"))).alias("slug"))
        given = stored(given.withColumn("first", F.min("key").over(Window.partitionBy("slug")) == F.col("key")), "slugs")
        done.append(given.where("first").select("key", "slug"))
        left = given.where("NOT first").select("key", "base")
        if not left.limit(1).count():
            break
        taken = stored(taken.union(done[-1].select("slug")), "slugs")
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def publish(store: Store, number: int, candidates: DataFrame) -> DataFrame:
    """Judge candidates (key, base, canon, hash, quality, reason, price, offers; key unique, reason null where the gates let it pass) against the store and write what changed as run `number`.
    Returns key and outcome of each: unchanged (same hash), rejected, kept (rejected now, but published before: the old page stays) or published.

    A page keeps its slug and the run since which it is published. Of published pages of one canon the primary is that of the best quality, then the longest published, then the smallest key;
    the others name its slug. Pages whose place in the group changes are written too, others are not.
    """
    before = stored(store.pages(number), "before")
    old = before.select("key", *[F.col(c).alias(f"old_{c}") for c in ("slug", "hash", "status", "since")])
    same = F.coalesce(F.col("hash") == F.col("old_hash"), F.lit(False))
    live = F.coalesce(F.col("old_status") == "published", F.lit(False))
    outcome = F.when(same, "unchanged").when(F.col("reason").isNull(), "published").when(live, "kept").otherwise("rejected")
    judged = stored(candidates.select("key", "base", "canon", "hash", "quality", "reason", "price", "offers").join(old, "key", "left").withColumn("outcome", outcome), "judged")
    changed = judged.where(F.col("outcome").isin("published", "rejected"))
    fresh = slugs(changed.where("old_slug IS NULL"), before)
    rows = changed.join(fresh, "key", "left").select(
        "key", F.coalesce("old_slug", "slug").alias("slug"), "canon", "hash", "quality", F.col("outcome").alias("status"), "reason", F.lit(True).alias("primary"), F.lit(None).cast("string").alias("primary_slug"), "price", F.col("offers").cast(OFFERS).alias("offers"),
        offers_fingerprint(F.col("offers").cast(OFFERS), F.col("price")).alias("fingerprint"), F.when(F.col("outcome") == "published", F.when(live, F.col("old_since")).otherwise(number)).cast("bigint").alias("since"),
    )
    rows = stored(rows, "changed")
    # the groups that a changed page enters or leaves
    groups = rows.select("canon").union(before.join(rows.select("key"), "key", "left_semi").select("canon")).where("canon IS NOT NULL").distinct()
    peers = before.drop("run").join(groups, "canon", "left_semi").join(rows.select("key"), "key", "left_anti").where("status = 'published'")
    together = stored(rows.withColumn("changed", F.lit(True)).unionByName(peers.withColumn("changed", F.lit(False))), "groups")
    best = together.where("status = 'published' AND canon IS NOT NULL").groupBy("canon").agg(F.min_by(F.struct("key", "slug"), F.struct(-F.coalesce("quality", F.lit(-1.0)), "since", "key")).alias("best"))
    placed = together.join(best, "canon", "left").withColumn("first", (F.col("status") != "published") | F.coalesce(F.col("best.key") == F.col("key"), F.lit(True)))
    new_slug = F.when(~F.col("first"), F.col("best.slug"))
    moved = F.col("changed") | (F.col("first") != F.col("primary")) | ~F.col("primary_slug").eqNullSafe(new_slug)
    store.write(number, placed.where(moved).withColumn("primary", F.col("first")).withColumn("primary_slug", new_slug))
    return judged.select("key", "outcome")


def refresh(store: Store, number: int, offers: DataFrame) -> DataFrame:
    """New offers (key, price, offers) of published primary pages, written as run `number` where they differ: key and outcome of each page that has new offers. worse: a page with a price or a
    priced offer never loses all of them. A new price that is missing leaves the old one. Aliases take their primary's offers."""
    before = stored(store.pages(number).drop("run"), "before")
    priced = lambda o: F.exists(F.coalesce(o, F.array().cast(OFFERS)), lambda x: F.coalesce(has_price(x["price"]), F.lit(False)))
    given = offers.select("key", F.col("price").alias("new_price"), F.col("offers").cast(OFFERS).alias("new_offers"))
    page = before.join(given, "key")
    paid = lambda c: F.coalesce(has_price(F.col(c)), F.lit(False))
    mark = offers_fingerprint(F.col("new_offers"), F.when(paid("new_price"), F.col("new_price")).otherwise(F.col("price")))
    worse = (priced(F.col("offers")) | paid("price")) & ~priced(F.col("new_offers")) & ~paid("new_price")
    outcome = F.when(F.col("status") != "published", "unpublished").when(~F.col("primary"), "alias").when(worse, "worse").when(mark == F.col("fingerprint"), "unchanged").otherwise("updated")
    judged = stored(page.withColumn("mark", mark).withColumn("outcome", outcome), "refreshed")
    new = judged.where("outcome = 'updated'")
    own = new.withColumn("price", F.when(paid("new_price"), F.col("new_price")).otherwise(F.col("price"))).withColumn("offers", F.col("new_offers")).withColumn("fingerprint", F.col("mark")).select(*before.columns)
    theirs = new.select("canon", F.col("new_offers").alias("offers")).where("canon IS NOT NULL")
    aliases = before.where("status = 'published' AND NOT primary").drop("offers").join(theirs, "canon").withColumn("fingerprint", offers_fingerprint(F.col("offers"), F.col("price"))).select(*before.columns)
    store.write(number, own.unionByName(aliases))
    return judged.select("key", "outcome")
