"""Scalar rules on numbers: rounding, percentages, prices, ratings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column, digits: int = 0) -> Column:
    """floor(x * 10^digits + 0.5) / 10^digits, as a double."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / F.lit(scale)


def percent(part: Column, whole: Column) -> Column:
    """Share in percent with one decimal; 0 where the whole is 0."""
    return F.when(whole == 0, 0.0).otherwise(F.floor(part * 1000.0 / whole + 0.5) / 10.0)


def first_nonzero(a: Column, b: Column) -> Column:
    return F.when(a != 0, a).otherwise(b)


def confidence(score: Column) -> Column:
    """A score in [0, 1] as whole percent; beyond that it is clamped."""
    return F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)) * 100 + 0.5)


def prices_compatible(a: Column, b: Column, ratio: float | Column) -> Column:
    """The larger is at most `ratio` times the smaller; an unknown or non-positive price is compatible with any."""
    known = (F.coalesce(a, F.lit(0.0)) > 0) & (F.coalesce(b, F.lit(0.0)) > 0)
    return ~known | (F.greatest(a, b) / F.least(a, b) <= ratio)


#: Categories whose prices must lie closer together, and the two ratios.
STRICT_CATEGORIES, STRICT_RATIO, USUAL_RATIO = ("laptops", "gpus", "desktops", "monoblocks", "pc_components", "smartphones", "consoles"), 1.35, 1.3


def price_ratio_for(category: Column) -> Column:
    return F.when(category.isin(*STRICT_CATEGORIES), STRICT_RATIO).otherwise(USUAL_RATIO)


def serp_outlier(reference: Column, price: Column, ratio: float = 2.0) -> Column:
    """Both prices are known and lie further apart than search results may."""
    return F.coalesce((reference > 0) & (price > 0), F.lit(False)) & ~prices_compatible(reference, price, ratio)


def too_cheap(reference: Column, price: Column, fraction: float = 0.2) -> Column:
    return F.coalesce((reference > 0) & (price > 0) & (price < reference * fraction), F.lit(False))


def has_price(price: Column) -> Column:
    return F.coalesce(price > 0, F.lit(False))


def whole_rubles(kopecks: Column) -> Column:
    """Prices from 1000 on are in hundredths."""
    return F.when(kopecks >= 1000, F.floor(kopecks / 100 + 0.5)).otherwise(F.floor(kopecks + 0.5))


def quality_score(x: Column) -> Column:
    """1 to 10 with one decimal; 10 to 100 counts as tenths; others are null."""
    n = F.when((x > 10) & (x <= 100), x / 10).otherwise(x)
    return F.when((n >= 1) & (n <= 10), round_half_up(n, 1))


def rating(x: Column) -> Column:
    """1 to 5 with one decimal, else null."""
    return F.when((x >= 1) & (x <= 5), round_half_up(x, 1))


def current_and_old(prices: Column) -> Column:
    """From an array of prices: the smallest positive one, and the largest if over 2 % above it."""
    good = F.filter(prices, lambda p: p > 0)
    low, high = F.array_min(good), F.array_max(good)
    return F.struct(low.alias("price"), F.when(high > low * 1.02, high).alias("old_price"))


def back_off(failures: Column) -> Column:
    """How many times longer a product rests after so many failures in a row."""
    n = F.coalesce(failures, F.lit(0))
    return F.when(n <= 1, 1).when(n <= 3, 4).otherwise(12)


def duration_bucket(ms: Column) -> Column:
    return F.when(ms.isNull() | (ms < 1000), "lt_1s").when(ms < 3000, "1_3s").when(ms < 10_000, "3_10s").when(ms < 30_000, "10_30s").otherwise("30s_plus")


def cost_units(source: Column) -> Column:
    return F.when(source == "scrappey", 10).when(source == "tab", 3).when(source.isin("legacy", "api"), 1).otherwise(0)


def dropped_client(before: Column, now: Column, rub: Column, pct: Column) -> Column:
    """Either limit suffices; a limit that isn't positive is always passed."""
    fell = before - now
    return (now < before) & ((pct <= 0) | (fell / before * 100 >= pct) | (rub <= 0) | (fell >= rub))


def dropped_server(before: Column, now: Column, rub: Column, pct: Column) -> Column:
    """Both limits must be reached."""
    fell = before - now
    return (now < before) & (before > 0) & ((pct <= 0) | (fell / before * 100 >= pct)) & (fell >= rub)


def suspicious_drop(before: Column, now: Column, identity_ok: Column) -> Column:
    fell = before - now
    return ~identity_ok & (before > 0) & (now > 0) & (now < before) & ((fell / before >= 0.4) | (fell >= 5000))


def significant_change(before: Column, now: Column) -> Column:
    moved = F.abs(now - before)
    return F.coalesce((before > 0) & (now > 0) & ((moved >= 500) | (moved >= before * 0.1)), F.lit(False))


def near_minimum(price: Column, low: Column, points: Column) -> Column:
    """How far a price lies above the 90-day minimum."""
    above = (price - low) / low * 100
    return (
        F.when((points < 3) | low.isNull() | ~(low > 0) | ~(price > 0), "insufficient")
        .when(above <= 3, "near_min").when(above <= 10, "below_avg").when(above <= 25, "above_avg").otherwise("far")
    )
