"""Links of stores: which store, which product, whether a product page, canonical forms, redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .titles import let, part

#: Hosts of stores, tried in order.
HOSTS = {
    "wildberries": r"(^|\.)wildberries\.ru$", "ozon": r"(^|\.)ozon\.ru$", "yandex_market": r"(^market\.yandex\.ru$)|(^(www\.)?ya\.ru$)", "megamarket": r"(^|\.)(sber)?megamarket\.ru$", "aliexpress": r"(^|\.)aliexpress\.(ru|com)$",
    "mvideo": r"(^|\.)(mvideo|eldorado)\.ru$", "dns": r"(^|\.)dns-shop\.ru$", "citilink": r"(^|\.)citilink\.ru$", "lamoda": r"(^|\.)lamoda\.ru$",
}
#: Where a store's links hold the product's number, tried in order; and what its product pages look like.
ARTICLES = {
    "wildberries": (r"/catalog/(\d+)",), "ozon": (r"/product/[^/?#]*?(\d{5,})/?(?:[?#]|$)", r"/id/(\d+)"), "yandex_market": (r"/card/[^/]+/(\d+)", r"/product(?:--[^/]+)?/(\d+)"), "megamarket": (r"/catalog/details/[^/?#]*?(\d{6,})",),
    "aliexpress": (r"/item/(\d{8,})",), "mvideo": (r"/products/[^/?#]*?(\d{5,})",), "dns": (r"/product/([0-9a-f]{6,})",), "citilink": (r"/product/[^/?#]*?(\d{5,})",), "lamoda": (r"/p/([a-z0-9]+)",),
}
PAGES = {
    "wildberries": r"/catalog/[1-9]\d*", "ozon": r"/product/[^/]+|/context/detail/id/\d+|/t/[a-z0-9]+", "yandex_market": r"/(product|card)(--[^/]+)?/|/cc/[a-z0-9]+", "megamarket": r"/catalog/details/", "aliexpress": r"/item/\d{8,}", "mvideo": r"/products/",
    "dns": r"/product/", "citilink": r"/product/", "lamoda": r"/p/",
}


def _whole(url: Column) -> Column:
    """Links may lack a scheme."""
    x = F.trim(url)
    return F.when(x.rlike(r"^[a-z]+://"), x).when(x.rlike(r"^(?i)[a-z0-9.-]+\.[a-z]{2,}(/|$)"), F.concat(F.lit("https://"), x)).otherwise(x)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(_whole(url), r"^[a-z]+://([^/?#:]+)", 1))


def store_of(url: Column) -> Column:
    """The store whose host the link has; null for others, whatever their path says."""
    return let(host_of(url), lambda host: F.coalesce(*[F.when(host.rlike(p), F.lit(s)) for s, p in HOSTS.items()]))


def plain_url(url: Column) -> Column:
    """Scheme, host and path, without a last slash."""
    return F.regexp_replace(F.regexp_replace(_whole(url), r"[?#].*$", ""), "/$", "")


def article_of(url: Column) -> Column:
    """The product's number in a store's link, or null."""
    return let(store_of(url), lambda store: F.coalesce(*[F.when(store == s, part(url, p, 1)) for s, ps in ARTICLES.items() for p in ps]))


def product_page(url: Column) -> Column:
    page = let(store_of(url), lambda store: F.coalesce(*[F.when((store == s) & url.rlike(f"(?i){p}"), F.lit(True)) for s, p in PAGES.items()], F.lit(False)))
    return page & ~url.rlike(r"(?i)search\.aspx|/search[/?]|/feedbacks(/|$)")


def canonical_url(url: Column) -> Column:
    """One link for each product: rebuilt from the number where a store's links vary, else plain."""
    def built(x: Column) -> Column:
        store, article, plain = x["store"], x["article"], x["plain"]
        return (
            F.when((store == "wildberries") & (article != "0"), F.concat(F.lit("https://www.wildberries.ru/catalog/"), article, F.lit("/detail.aspx")))
            .when((store == "aliexpress") & article.isNotNull(), F.concat(F.lit("https://aliexpress.ru/item/"), article, F.lit(".html")))
            .when(store == "megamarket", F.regexp_replace(plain, r"(?i)^[a-z]+://([^/]*\.)?sbermegamarket\.ru", "https://megamarket.ru"))
            .when(store == "mvideo", F.regexp_replace(plain, r"(?i)^([a-z]+)://(mvideo|eldorado)\.ru", "$1://www.$2.ru")).otherwise(plain)
        )

    return let(F.struct(store_of(url).alias("store"), article_of(url).alias("article"), plain_url(url).alias("plain")), built)


def redacted(url: Column) -> Column:
    """Without query and fragment, at most 200 characters."""
    return F.substring(F.regexp_replace(url, r"[?#].*$", ""), 1, 200)


def truncated(title: Column, most: int = 80) -> Column:
    x = F.trim(title)
    return F.when(F.coalesce(x, F.lit("")) == "", None).when(F.length(x) <= most, x).otherwise(F.concat(F.substring(x, 1, most - 1), F.lit("…")))


def parsed_link(text: Column) -> Column:
    """struct(store, article, url, hint) of the first link in a text; the hint is what the text says besides."""
    def read(url: Column) -> Column:
        hint = F.trim(F.regexp_replace(F.replace(text, url, F.lit(" ")), r"\s+", " "))
        return F.when(url != "", F.struct(store_of(url).alias("store"), article_of(url).alias("article"), canonical_url(url).alias("url"), F.nullif(hint, F.lit("")).alias("hint")))

    return let(F.regexp_extract(text, r"https?://[^\s<>\"']+", 0), read)
