"""Rules on offers of a product and on tracked rows: choosing, ordering, identity, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import has_price
from ..functions.text import stable_article


def within_budget(price: Column, budget: Column) -> Column:
    """An unknown price passes."""
    return price.isNull() | (price <= budget)


def track_allowed(rows: DataFrame, owner: str, order: list[str], limit: int) -> DataFrame:
    """Whether each row may be added, given the owner's rows before it: deleted ones always, others below the limit."""
    before = Window.partitionBy(owner).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("allowed", F.col("deleted") | (F.count(F.when(~F.col("deleted"), 1)).over(before) < limit))


def tie_window(offers: DataFrame, key: str, order: list[Column], close: int) -> DataFrame:
    """Best and second confidence of each key, whether they tie, and how far prices of close ones lie apart."""
    by = Window.partitionBy(key)
    ranked = offers.withColumn("n", F.row_number().over(by.orderBy(*order))).withColumn("top", F.max("confidence").over(by))
    near = F.when((F.col("top") - F.col("confidence") <= close) & has_price(F.col("price")), F.col("price"))
    two = ranked.groupBy(key).agg(
        F.max(F.when(F.col("n") == 1, F.col("confidence"))).alias("best"), F.max(F.when(F.col("n") == 2, F.col("confidence"))).alias("second"), (F.max(near) - F.min(near)).alias("spread")
    )
    return two.withColumn("tie", F.coalesce(F.col("best") - F.col("second") <= close, F.lit(False)))


def richer_first() -> list[Column]:
    """Order of rival offers for one slot: priced, then waiting for a choice, then the surer one (columns price, status, confidence)."""
    return [has_price(F.col("price")).desc(), (F.col("status") == "needs_choice").desc(), F.desc("confidence")]


def article_of(field: Column, url: Column, product_id: Column) -> Column:
    """The first stable article of a field, a link's last number, an id."""
    from_url = F.regexp_extract(F.coalesce(url, F.lit("")), r"(\d+)/?$", 1)
    return F.coalesce(*[F.when(stable_article(x), x) for x in (field, from_url, product_id)])


def same_identity(store_a: Column, article_a: Column, url_a: Column, store_b: Column, article_b: Column, url_b: Column) -> Column:
    """Why two rows are one product ('article', 'url'), or null."""
    return F.when(store_a != store_b, None).when(article_a == article_b, "article").when((url_a == url_b) & article_a.isNotNull(), "url")


def settled(status: Column, price: Column, candidates: Column) -> Column:
    """What an offer that was still loading becomes."""
    return F.when(status != "loading", status).when(candidates > 0, "needs_choice").when(has_price(price), "serp_only").otherwise("not_found")


def polyline(points: DataFrame, key: list[str], time: str, value: str, width: float, height: float) -> DataFrame:
    """Points of each key scaled into a box: time to the right, the largest value at the top; one value lies in the middle."""
    by = Window.partitionBy(*key)
    n, low, high = F.count(F.lit(1)).over(by), F.min(value).over(by), F.max(value).over(by)
    place = F.row_number().over(by.orderBy(time, value))
    x = F.when(n > 1, (place - 1) * width / (n - 1)).otherwise(F.lit(width / 2))
    y = F.when(high > low, height - (F.col(value) - low) * height / (high - low)).otherwise(F.lit(height / 2))
    return points.select(*key, place.alias("place"), x.alias("x"), y.alias("y"))


def richer(offers: DataFrame, key: list[str], tie: str) -> DataFrame:
    """The offer that wins each slot (columns price, url, pick: a user must choose, candidates: their number, at): a priced card that isn't a search page and waits for no choice, then one that
    waits with candidates, of those the one with more, then the newer, then the smaller `tie`."""
    card = F.coalesce(has_price(F.col("price")), F.lit(False)) & F.coalesce(~F.col("url").rlike(r"(?i)search\?"), F.lit(False)) & ~F.col("pick")
    waits = F.col("pick") & (F.col("candidates") > 0)
    order = F.struct((~card).alias("a"), (~waits).alias("b"), (-F.when(waits, F.col("candidates")).otherwise(0)).alias("c"), (-F.col("at")).alias("d"), F.col(tie).alias("e"))
    rest = [c for c in offers.columns if c not in key]
    return offers.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("__best")).select(*key, "__best.*")


def merged_offers(offers: DataFrame, product: str, identity: list[str], turn: str, most: int = 6) -> DataFrame:
    """Offers (price, url) of a product merged by identity in the order of `turn`, which no two share: the first with a price, else the first; where it has no link the next later one that
    has gives it. The `most` whose identity came first, with their place."""
    key, priced = [product, *identity], F.coalesce(has_price(F.col("price")), F.lit(False))
    base = offers.groupBy(*key).agg(F.min(turn).alias("first"), F.min_by(F.struct(F.col(turn).alias("turn"), "price", "url"), F.struct(~priced, turn)).alias("base"))
    bare = base.where("coalesce(base.url, '') = ''").select(*key, F.col("base.turn").alias("__from"))
    later = offers.where("url <> ''").select(*key, F.col(turn).alias("__turn"), "url").join(bare, key).where("__turn > __from")
    filled = later.groupBy(*key).agg(F.min_by("url", "__turn").alias("filled"))
    place = F.row_number().over(Window.partitionBy(product).orderBy("first"))
    out = base.join(filled, key, "left").select(*key, "first", "base.price", F.coalesce(F.nullif(F.col("base.url"), F.lit("")), "filled").alias("url"))
    return out.withColumn("place", place.cast("bigint")).where(F.col("place") <= most).drop("first")
