"""Candidates on the search pages of stores, tier by tier: tiles, links with their text, and bare ids with a title from the characters around them.

A match's place is known from the pieces between the matches, so a window of characters around it can be read without leaving the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identity as ident
from ..functions.titles import let


@dataclass(frozen=True)
class Tier:
    """A form in which a page holds candidates: matches of `pattern`; the id is the first group of the first of `ids` that the link has; links like `not_` don't count. title: 'tile' (a heading in the match),
    'link' (an attribute in the `before` characters before it, else its text) or 'around' (an attribute from 120 before to 220 after its start, else no candidate). priced: a price is looked for in the match,
    and before it if it is a link."""

    pattern: str
    ids: tuple[str, ...]
    title: str
    before: int = 280
    priced: bool = False
    not_: str | None = None


#: Forms of search pages by store, in the order in which they are tried; fewest digits of an id.
TIERS = {
    "megamarket": (
        Tier(r"data-(?:product|goods)-id=[\"'](\d{6,})[\"'][^>]*>([\s\S]{0,1200}?)</(?:div|article|li|a)", (r"-id=[\"'](\d{6,})",), "tile", priced=True),
        Tier(r"href=[\"']([^\"']*/catalog/details/[^\"'?#]+(?:\?[^\"']*)?)[\"'][^>]*>([\s\S]{0,400}?)</a>", (r"/catalog/details/[^/?#\"']*?(\d{6,})",), "link", before=200),
    ),
    "aliexpress": (
        Tier(r"href=[\"']([^\"']*/item/(\d{8,})(?:\.html)?[^\"']*)[\"'][^>]*>([\s\S]{0,500}?)</a>", (r"/item/(\d{8,})",), "link", priced=True),
        Tier(r"/item/(\d{8,})(?:\.html)?", (r"/item/(\d{8,})",), "around"),
    ),
    "mvideo": (
        Tier(r"href=[\"']([^\"']*/products/[^\"'?#]+(?:\?[^\"']*)?)[\"'][^>]*>([\s\S]{0,500}?)</a>", (r"/products/[^/?#\"']*?(\d{6,})",), "link", priced=True, not_=r"product-list-page|/search"),
        Tier(r"href=[\"']([^\"']*(?:/item/\d+|/cat/detail/[^\"'?#]+|/catalog/product/[^\"'?#]+)(?:\?[^\"']*)?)[\"'][^>]*>([\s\S]{0,500}?)</a>", (r"/item/(\d{6,})", r"/(?:cat/detail|catalog/product)/[^/?#\"']*?(\d{5,})"), "link"),
        Tier(r"/products/[^/?#]*?(\d{6,})", (r"/products/[^/?#]*?(\d{6,})",), "around"),
    ),
}
DIGITS = {"megamarket": 6, "aliexpress": 8, "mvideo": 6}
#: Shortest page and title that count, longest title; words of pages that keep robots out, which count on pages below a size.
SHORTEST_PAGE, SHORTEST, LONGEST, BARRED, BARRED_BELOW = 200, 3, 200, r"(?i)captcha|access.?denied|cf-browser-verification|robot.?check", 50_000


def located(x: Column, pattern: str) -> Column:
    """array<struct<at,text>>: matches of a pattern with their places (from 0)."""
    kind = "array<struct<at:int,text:string>>"
    texts = F.regexp_extract_all(x, F.lit(f"(?i){pattern}"), F.lit(0))

    def placed(m: Column) -> Column:
        pairs = F.zip_with(F.slice(m["pieces"], 1, F.size(m["texts"])), m["texts"], lambda piece, text: F.struct(piece.alias("piece"), text.alias("text")))
        step = lambda s, p: F.struct(
            (s["end"] + F.length(p["piece"]) + F.length(p["text"])).alias("end"), F.concat(s["found"], F.array(F.struct((s["end"] + F.length(p["piece"])).alias("at"), p["text"].alias("text")))).alias("found")
        )
        return F.aggregate(pairs, F.struct(F.lit(0).alias("end"), F.array().cast(kind).alias("found")), step, lambda s: s["found"])

    return let(F.struct(F.split(x, f"(?i){pattern}", -1).alias("pieces"), texts.alias("texts")), placed)


def _first(x: Column, *patterns: str) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(x, f"(?i){p}", 1), F.lit("")) for p in patterns])


def _plain(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"<[^>]+>", " "), r"\s+", " "))


TITLE, ALT, HEADING, PRICE = r"title=[\"']([^\"']{4,180})[\"']", r"alt=[\"']([^\"']{4,180})[\"']", r"<(?:h[23]|span|a)[^>]*>([^<]{4,180})</(?:h[23]|span|a)>", r"(\d[\d\s]{1,})\s*(?:₽|руб|RUB)"


def _candidates(html: Column, tier: Tier) -> Column:
    """array<struct<id,title,price,link>> of a tier's matches, in order."""
    def read(m: Column) -> Column:
        at, text = m["at"], m["text"]
        before = F.substring(html, F.greatest(at - tier.before, F.lit(0)) + 1, F.least(at, F.lit(tier.before)))
        inner = F.regexp_replace(text, r"^[^>]*>", "")
        attributes = (TITLE,) if tier.before < 280 else (TITLE, ALT)
        if tier.title == "tile":
            title = F.coalesce(_first(inner, HEADING), F.substring(_plain(F.regexp_replace(inner, r"</\w*$", "")), 1, 160))
        elif tier.title == "link":
            title = F.coalesce(_first(before, *attributes), _plain(inner))
        else:
            start = F.greatest(at - 120, F.lit(0))
            title = F.coalesce(_first(F.substring(html, start + 1, at + 220 - start), TITLE, ALT), F.lit(""))
        price = F.coalesce(_first(inner, PRICE), _first(before, PRICE) if tier.title == "link" else F.lit(None)) if tier.priced else F.lit(None).cast("string")
        link = F.regexp_extract(text, r"^[^>]*", 0)
        amount = F.regexp_replace(price, r"\s", "").try_cast("double")
        ok = F.lit(True) if tier.not_ is None else ~link.rlike(f"(?i){tier.not_}")
        return F.when(ok, F.struct(_first(link, *tier.ids).alias("id"), F.substring(F.trim(F.regexp_replace(title, r"\s+", " ")), 1, LONGEST).alias("title"), F.when(amount > 0, amount).alias("price"), link.contains("eldorado.ru").alias("other")))

    return F.transform(located(html, tier.pattern), read)


def candidates(pages: DataFrame, most: int = 8) -> DataFrame:
    """page_id, place, id, title, price, url and confidence of the candidates on search pages (page_id, store, html, reference): each id once, the first that has a title and is at all like the
    reference's, the first `most`. Short pages and those that keep robots out have none."""
    html, store = F.col("html"), F.col("store")
    open_ = (F.length(html) >= SHORTEST_PAGE) & ~(html.rlike(BARRED) & (F.length(html) < BARRED_BELOW))
    found = F.coalesce(*[F.when((store == s) & open_, F.concat(*[_candidates(html, t) for t in tiers])) for s, tiers in TIERS.items()])
    like = lambda c: ident.serp_confidence(F.col("reference"), c["title"], ident.JUNK)
    digits = F.coalesce(*[F.when(store == s, n) for s, n in DIGITS.items()])
    sound = F.filter(found, lambda c: c.isNotNull() & (F.length(c["id"]) >= digits) & (F.length(c["title"]) >= SHORTEST))
    rated = F.filter(F.transform(sound, lambda c: F.struct(c["id"].alias("id"), c["title"].alias("title"), c["price"].alias("price"), c["other"].alias("other"), like(c).cast("bigint").alias("confidence"))), lambda c: c["confidence"] > 0)
    kept_of = lambda rs: F.aggregate(rs, F.slice(rs, 1, 0), lambda kept, c: F.when((F.size(kept) >= most) | F.exists(kept, lambda k: k["id"] == c["id"]), kept).otherwise(F.concat(kept, F.array(c))))
    once = let(rated, kept_of)
    rows = pages.select("page_id", "store", once.alias("found")).select("page_id", "store", F.posexplode("found").alias("place", "c"))
    url = F.coalesce(
        F.when(F.col("store") == "megamarket", F.concat(F.lit("https://megamarket.ru/catalog/details/"), "c.id", F.lit("/"))), F.when(F.col("store") == "aliexpress", F.concat(F.lit("https://aliexpress.ru/item/"), "c.id", F.lit(".html"))),
        F.when(F.col("c.other"), F.concat(F.lit("https://www.eldorado.ru/cat/detail/"), "c.id", F.lit("/"))), F.concat(F.lit("https://www.mvideo.ru/products/"), "c.id"),
    )
    return rows.select("page_id", "place", "c.id", "c.title", "c.price", url.alias("url"), "c.confidence")
