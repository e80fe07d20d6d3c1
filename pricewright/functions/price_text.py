"""Prices in the text of listings and cards: which numbers are prices, and which of them is the base, the pay-card and the old one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .titles import has, let, rx

#: Labels of prices that a bank card or a pay service gives, and of a price for one piece.
BANK = r"с\s+банками|ozon\s*банк|озон\s*банк|card\s*price|по\s+карте\s+ozon|с\s+картой\s+ozon|с\s+другими\s+банками|другими\s+банками"
PAY = r"п[еэ]й|pay|ya\.?pay|яндекс.?п[еэ]й"
PIECE = r"\s*(?:\/\s*шт\.?|за\s*(?:1\s*)?шт\.?|за\s*единицу|цена\s*за\s*1(?:\s*шт\.?)?)"
BADGE = r"(?:−|-|–)\s*\d{1,2}\s*%"
BREAKDOWN = "struct<price:bigint,base:bigint,pay:bigint,old:bigint>"


def listing_prices(x: Column) -> Column:
    """All rouble amounts of 50 to 50 million in order, but for prices of one piece."""
    plain = F.translate(x, " ", " ")
    found = F.regexp_extract_all(plain, F.lit(rx(rf"(\d[\d\s]*)\s*(?:₽|руб\.?)(?!{PIECE})")), F.lit(1))
    return F.filter(F.transform(found, lambda p: F.regexp_replace(p, r"\s", "").try_cast("bigint")), lambda p: (p >= 50) & (p < 50_000_000))


def without_unit_prices(prices: Column) -> Column:
    """Ascending different prices without those at the start of which the next is 2 to 6 times as much, within 8 %, while three are left."""
    def more(state: Column, p: Column) -> Column:
        """Skip the first while the one after it is a pack of it; what has been kept stays."""
        rest = state["rest"]
        a, b = rest[0], rest[1]
        pack = F.exists(F.array(*[F.lit(k) for k in range(2, 7)]), lambda k: F.abs(a * k - b) / b <= 0.08)
        skip = (F.size(rest) >= 3) & ~state["done"] & pack
        return F.struct(F.when(skip, F.slice(rest, 2, 1 << 20)).otherwise(rest).alias("rest"), (state["done"] | ~skip).alias("done"))

    return F.aggregate(prices, F.struct(prices.alias("rest"), F.lit(False).alias("done")), more, lambda s: s["rest"])


def _different(prices: Column) -> Column:
    return F.array_sort(F.array_distinct(prices))


def block_breakdown(x: Column, labels: str, old_above: float, near: tuple[float, float]) -> Column:
    """struct(price, base, pay, old) of a price block's text, null without prices.

    The largest is the old price if a discount badge is shown and it is over 5 % above the smallest, or three prices are shown and it is over `old_above` times
    that. Of the others, with a label of pay prices the smallest is the pay price and the largest over 1 % above it the base; without one, two whose ratio is in
    `near` are pay and base; else the smallest is the base.
    """
    def read(r: Column) -> Column:
        p = r["prices"]
        low, high = F.array_min(p), F.array_max(p)
        old = F.when(((F.size(p) >= 2) & r["badge"] & (high > low * 1.05)) | ((F.size(p) >= 3) & (high > low * old_above)), high)
        left = F.filter(p, lambda v: old.isNull() | (v < old * 0.98))
        return F.struct(F.when(F.size(left) > 0, left).otherwise(F.array(low)).alias("left"), old.alias("old"), r["label"].alias("label"))

    def told(r: Column) -> Column:
        low, high = F.array_min(r["left"]), F.array_max(r["left"])
        base = F.when(high > low * 1.01, high)
        pair = (F.size(r["left"]) >= 2) & (high / low >= near[0]) & (high / low <= near[1])
        price = F.when(r["label"], F.coalesce(base, low)).when(pair, high).otherwise(low)
        return F.struct(price.alias("price"), F.when(r["label"], base).when(pair, high).otherwise(low).alias("base"), F.when(r["label"] | pair, low).alias("pay"), F.when(r["old"] > price, r["old"]).alias("old"))

    given = F.struct(_different(listing_prices(x)).alias("prices"), has(x, BADGE).alias("badge"), has(x, labels).alias("label"))
    return let(given, lambda g: F.when(F.size(g["prices"]) > 0, let(let(g, read), told))).cast(BREAKDOWN)


def ozon_block(x: Column) -> Column:
    return block_breakdown(x, BANK, 1.08, (1.005, 1.08))


def yandex_block(x: Column) -> Column:
    return block_breakdown(x, PAY, 1.12, (1.04, 1.35))


def ozon_numbers(prices: Column) -> Column:
    """The same of bare numbers: prices of one piece go first; of three or more the largest is old, of the rest below 0.98 of it the largest is the base."""
    def told(r: Column) -> Column:
        p = r["p"]
        low, high = F.array_min(p), F.array_max(p)
        mid = F.filter(p, lambda v: v < high * 0.98)
        three, pair = (F.size(p) >= 3) & (high > low * 1.08), (high / low >= 1.005) & (high / low <= 1.08)
        base, pay = F.array_max(mid), F.array_min(mid)
        price = F.when(three, base).when(pair, high).otherwise(low)
        return F.when(F.size(p) > 0, F.struct(
            price.alias("price"), price.alias("base"), F.when(three, F.when(pay < base * 0.99, pay)).when(pair, low).alias("pay"), F.when((F.size(p) >= 2) & (three | (~pair & (high > low * 1.05))), high).alias("old")
        ))

    positive = _different(F.filter(prices, lambda v: v > 0))
    return let(let(positive, lambda p: F.struct(without_unit_prices(p).alias("p"))), told).cast(BREAKDOWN)


def offer_prices(b: Column) -> Column:
    """A breakdown as an offer shows it: the pay price only if it is 1 % below the price or stands alone, the old one only above the price."""
    price = F.coalesce(b["base"], b["pay"], b["price"])
    pay = F.when((b["pay"] < price * 0.99) | b["base"].isNull(), b["pay"])
    return F.struct(price.alias("price"), b["base"].alias("base"), pay.alias("pay"), F.when(b["old"] > price, b["old"]).alias("old"))


def without_shipping(prices: Column) -> Column:
    """Ascending different rounded prices without courier fees: those below a floor that depends on the largest, from 1000 on."""
    def told(r: Column) -> Column:
        p = r["p"]
        high = F.array_max(p)
        floor = F.when(high >= 5000, F.greatest(F.lit(500), F.floor(high * 0.12))).otherwise(F.greatest(F.lit(400), F.floor(high * 0.4)))
        kept = F.filter(p, lambda v: v >= floor)
        return F.when((F.size(p) <= 1) | (high < 1000) | (F.size(kept) == 0), p).otherwise(kept)

    return let(F.struct(_different(F.transform(F.filter(prices, lambda v: v > 0), lambda v: F.floor(v + 0.5))).alias("p")), told)


def base_price(prices: Column, old: Column) -> Column:
    """The largest price below 0.98 of the old one, else the largest."""
    p = F.array_distinct(F.filter(prices, lambda v: v > 0))
    below = F.filter(p, lambda v: old.isNull() | (v < old * 0.98))
    return F.coalesce(F.array_max(below), F.array_max(p))
