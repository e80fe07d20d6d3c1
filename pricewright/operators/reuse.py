"""Whether an earlier analysis may be used again: confidence of sameness, reasons, freshness of reviews, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as t
from .match_score import categories_clash, compact, family_of, half_up, models_compatible

#: Weights of what two products agree in; limits of confidence; price moves that count.
WEIGHTS = {"brand": 30, "model": 30, "article": 15, "storage": 10, "color": 5, "category": 10}
REUSE, SOFT, REJECTED, VARIANT_CAP, AUTO = 80, 70, 20, 55, 85
MOVE_ABS, MOVE_SHARE = 500, 0.1


def confidence(a: Column, b: Column, article_a: Column, article_b: Column) -> Column:
    """struct(score, rejected): weighted share of what is known on both sides and agrees, 50 without any; a model, memory or colour that differs caps it;
    another category or maker rejects. a and b have brand, model, storage, color and category."""
    brands = family_of(a["brand"]), family_of(b["brand"])
    same_maker = (brands[0] == brands[1]) | t.brands_compatible(a["brand"], b["brand"])
    both = lambda x, y: (F.coalesce(x, F.lit("")) != "") & (F.coalesce(y, F.lit("")) != "")
    agree = {
        "brand": F.when(both(a["brand"], b["brand"]), same_maker), "model": F.when(both(a["model"], b["model"]), models_compatible(a["model"], b["model"])),
        "article": F.when(both(article_a, article_b), compact(article_a) == compact(article_b)), **{k: F.when(both(a[k], b[k]), compact(a[k]) == compact(b[k])) for k in ("storage", "color", "category")},
    }
    known = sum((F.when(v.isNotNull(), WEIGHTS[k]).otherwise(0) for k, v in agree.items()), F.lit(0))
    got = sum((F.when(v, WEIGHTS[k]).otherwise(0) for k, v in agree.items()), F.lit(0))
    share = F.when(known > 0, half_up(got * 100.0 / known)).otherwise(50)
    capped = F.coalesce(~agree["model"], F.lit(False)) | F.coalesce(~agree["storage"], F.lit(False)) | F.coalesce(~agree["color"], F.lit(False))
    rejected = F.coalesce(categories_clash(a["category"], b["category"]), F.lit(False)) | F.coalesce(~agree["brand"], F.lit(False))
    score = F.when(rejected, REJECTED).when(capped, F.least(share, F.lit(VARIANT_CAP))).otherwise(share)
    return F.struct(score.cast("bigint").alias("score"), rejected.alias("rejected"))


def price_moved(then: Column, now: Column) -> Column:
    moved = F.abs(now - then)
    return F.coalesce((then > 0) & (now > 0) & ((moved >= MOVE_ABS) | (moved >= then * MOVE_SHARE)), F.lit(False))


def mapping_allows(status: Column, evidence: Column, sure: Column) -> Column:
    """Whether a mapping to another store lends its analysis: active, and set by hand, by several users, or surely by itself."""
    active = status.isNull() | (status == "active")
    known = F.coalesce(evidence, F.lit("auto"))
    return active & (known.isin("manual", "multi_user") | ((known == "auto") & (F.coalesce(sure, F.lit(0)) >= AUTO)))


def decision(score: Column, rejected: Column, fresh: Column, moved: Column, forced: Column, soft: Column, mapped: Column, same_sku: Column, same_reviews: Column) -> Column:
    """struct(reuse, reason, score) by the first rule that holds. mapped is null where no mapping to another store is in play."""
    new, high = F.lit("NEW_ANALYSIS"), score >= REUSE
    reason = (
        F.when(forced | ~fresh | (moved & ~soft) | rejected, new).when(soft, F.when((score >= SOFT) | same_sku, "SOFT_REFRESH").otherwise(new))
        .when(F.coalesce(mapped, F.lit(False)), F.when(high, "CROSS_MARKETPLACE").otherwise(new)).when(same_sku & same_reviews, "REVIEWS_MATCH").when(same_sku, "SAME_SKU")
        .when(same_reviews & high, "REVIEWS_MATCH").when(high, "LOCAL_CACHE").otherwise(new)
    )
    least = F.when(same_sku & (reason == "REVIEWS_MATCH"), 90).when(reason == "SAME_SKU", 85).otherwise(0)
    return F.struct((reason != new).alias("reuse"), reason.alias("reason"), F.greatest(score, least).cast("bigint").alias("score"))


def reviews_hash(reviews: Column, sep: str = "\x1e") -> Column:
    """Number of reviews and the starts of the first five, the middle three and the last three."""
    many = F.size(reviews)
    starts = lambda a: F.array_join(F.transform(a, lambda x: F.regexp_replace(F.substring(x, 1, 48), r"\s+", " ")), sep)
    middle = F.greatest(F.lit(0), F.floor(many / 2).cast("int") - 1) + 1
    last = F.greatest(F.lit(1), many - 2)
    return F.concat_ws("|", many.cast("string"), starts(F.slice(reviews, 1, 5)), starts(F.slice(reviews, middle, 3)), starts(F.slice(reviews, last, 3)))


def reviews_reusable(analysed: Column, age_hours: Column, then: Column, now: Column, count_then: Column, count_now: Column, least: int = 3) -> Column:
    """Within six hours always, later with equal hashes, within a week if the number of reviews moved by 12 % at most; never of too few reviews."""
    alike = (count_then > 0) & (count_now > 0) & (F.abs(count_now - count_then) / F.greatest(count_then, F.lit(1)) <= 0.12)
    return (analysed >= least) & ((age_hours < 6) | (then == now) | ((age_hours < 7 * 24) & alike & (count_now >= least)))
