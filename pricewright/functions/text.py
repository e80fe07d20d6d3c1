"""Scalar rules on strings: titles, ids, attributes, links, prices in text, reviews."""

from __future__ import annotations

import functools
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say nothing in a title.
STOP_WORDS = ("товар", "видеокарта", "смартфон", "ноутбук", "наушники", "для", "the", "and", "with", "гб", "шт", "new", "pro")
#: Brands that count as one family.
FAMILIES = {"xiaomi": "xiaomi", "redmi": "xiaomi", "poco": "xiaomi", "huawei": "huawei", "honor": "honor"}
#: Prefixes of product ids, and articles that identify nothing.
PREFIXES = {"wildberries": "wb-", "ozon": "ozon-", "yandex_market": "ym-", "megamarket": "mm-", "aliexpress": "ae-", "mvideo": "mv-"}
UNSTABLE = ("", "ym", "0", "unknown", "null", "undefined")
#: Colour words of each family, in the order in which they are tried.
COLORS = {
    "black": ("black", "чёрный", "черный", "чёрная", "черная", "midnight", "space black", "spaceblack", "jet black", "graphite", "графит", "obsidian"),
    "white": ("white", "белый", "белая", "starlight", "ivory", "porcelain"),
    "blue": ("blue", "синий", "синяя", "navy"),
    "silver": ("silver", "серебристый", "серебряный"),
    "gray": ("gray", "grey", "серый", "серая"),
    "green": ("green", "зелёный", "зеленый"),
    "red": ("red", "красный"),
    "gold": ("gold", "золотой"),
    "purple": ("purple", "фиолетовый", "violet", "indigo"),
    "pink": ("pink", "розовый"),
    "beige": ("beige", "бежевый", "hazel"),
    "brown": ("brown", "коричневый"),
    "orange": ("orange", "оранжевый"),
    "yellow": ("yellow", "жёлтый", "желтый", "lemongrass", "lemon grass", "светло-желтый", "светло-жёлтый"),
}
#: Brands in the order in which they are looked for.
BRANDS = (
    "apple", "samsung", "xiaomi", "redmi", "poco", "huawei", "honor", "realme", "oneplus", "google", "fujifilm", "canon", "nikon", "sony", "lg", "asus", "lenovo", "hp", "dell", "acer", "msi", "gigabyte",
    "palit", "zotac", "nvidia", "amd", "bosch", "makita", "metabo", "deko", "intel", "nike", "adidas", "puma", "reebok", "persil", "ariel", "fairy", "domestos", "jbl", "amazfit", "roborock", "dreame",
    "redmond", "polaris", "loreal", "l'oreal", "oral-b", "oralb", "braun", "maybelline", "optimum", "dyson", "nespresso",
)
#: Stems of praise and complaint, and phrases of template reviews.
PRAISE = (
    "отличн", "хорош", "рекоменд", "качеств", "доволен", "супер", "класс", "удобн", "быстр", "красив", "нравит", "топ", "замечательн", "прекрасн", "стоит", "идеальн", "понрав", "отлично", "превосход", "благодар",
)
COMPLAINT = (
    "плох", "брак", "разочар", "вернул", "обман", "ужас", "не рекоменд", "сломал", "дефект", "некачеств", "жалоб", "отврат", "мусор", "неудобн", "не соответств", "разочаров", "не купил", "не советую", "отвратительн", "худш",
)
TEMPLATES = ("рекомендую", "отличный товар", "всё супер", "все супер", "пять звезд", "5 звезд", "заказываю не первый раз")


def let(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def matched(x: Column, pattern: str, group: int = 0) -> Column:
    """The first match of a pattern in Java's dialect, or null."""
    return let(F.regexp_extract(x, pattern, group), lambda found: F.when(found != "", found))


def normal_title(x: Column) -> Column:
    """Lower case, letters and digits only, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}\s]", " "), r"\s+", " "))


def title_words(x: Column) -> Column:
    """Different words of over two characters that aren't stop words."""
    words = F.split(normal_title(x), " ")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS)))


def word_overlap(a: Column, b: Column) -> Column:
    """Shared words over the larger number of words; 0 if either has none."""
    x, y = title_words(a), title_words(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y)))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length, lower case, white space collapsed."""
    x, y = (F.trim(F.regexp_replace(F.lower(c), r"\s+", " ")) for c in (a, b))
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(longest == 0, 0.0).otherwise(1 - F.levenshtein(x, y) / longest)


def title_score(a: Column, b: Column) -> Column:
    """Percent of a's words of over two characters that b has; repeats count; 50 if a has none."""
    long = lambda c: F.filter(F.split(F.lower(c), r"\s+"), lambda w: F.length(w) > 2)
    x, y = long(a), long(b)
    hits = F.size(F.filter(x, lambda w: F.array_contains(y, w)))
    return F.when(F.size(x) == 0, 50).otherwise(F.floor(hits * 100.0 / F.size(x) + 0.5))


def brand_of(x: Column, brands: tuple[str, ...] = BRANDS) -> Column:
    """The first brand of the list that the title contains."""
    return let(F.lower(x), lambda low: F.coalesce(*[F.when(low.contains(b), F.lit(b)) for b in brands]))


def family_of(brand: Column) -> Column:
    chain = None
    for b, f in FAMILIES.items():
        chain = F.when(brand == b, f) if chain is None else chain.when(brand == b, f)
    return chain.otherwise(brand)


def brands_compatible(a: Column, b: Column) -> Column:
    """Unknown brands are compatible with all, others with their family."""
    return a.isNull() | b.isNull() | (family_of(a) == family_of(b))


def bare_id(marketplace: Column, x: Column) -> Column:
    """A product id without its marketplace's prefix; of three stores only the digits, if there are enough."""
    raw = F.trim(x)
    digits = F.regexp_replace(F.regexp_replace(raw, r"(?i)^(megamarket:|mega-|aliexpress:|ali-|mvideo:|eldorado:)", ""), r"\D", "")
    stripped = F.regexp_replace(raw, r"(?i)^(megamarket:|mega-|aliexpress:|ali-|mvideo:|eldorado:)", "")
    out = F.when(F.lit(False), raw)
    for m, p in PREFIXES.items():
        out = out.when((marketplace == m) & F.startswith(F.lower(raw), F.lit(p)), F.substring(raw, len(p) + 1, 1 << 20))
    return (
        out.when((marketplace == "yandex_market") & raw.rlike(r"(?i)^yandex[_-]?"), F.regexp_replace(raw, r"(?i)^yandex[_-]?", ""))
        .when(marketplace.isin("megamarket", "mvideo"), F.when(F.length(digits) >= 6, digits).otherwise(stripped))
        .when(marketplace == "aliexpress", F.when(F.length(digits) >= 8, digits).otherwise(stripped)).otherwise(raw)
    )


#: Prefixes that clients put before article numbers, by store; the fewest digits that are an article by themselves.
ARTICLE_PREFIXES = {"wildberries": "wb-", "ozon": "ozon-", "megamarket": "megamarket:|mm-|mega-", "aliexpress": "aliexpress:|ae-|ali-", "mvideo": "mvideo:|mv-|eldorado:", "yandex_market": "yandex_market-|yandex-|ym-"}
ARTICLE_DIGITS = {"megamarket": 6, "aliexpress": 8, "mvideo": 6}


def bare_article(marketplace: Column, x: Column) -> Column:
    """A client's article without its store's prefix; of three stores only the digits, if there are enough. Empty for null."""
    raw = F.trim(F.coalesce(x, F.lit("")))
    stripped = F.coalesce(*[F.when(marketplace == m, F.regexp_replace(raw, f"(?i)^({p})", "")) for m, p in ARTICLE_PREFIXES.items()], raw)
    digits = F.regexp_replace(stripped, r"\D", "")
    return F.coalesce(*[F.when((marketplace == m) & (F.length(digits) >= n), digits) for m, n in ARTICLE_DIGITS.items()], stripped)


def prefixed_id(marketplace: Column, x: Column) -> Column:
    bare = bare_id(marketplace, x)
    prefix = F.element_at(F.create_map(*[F.lit(v) for kv in PREFIXES.items() for v in kv]), marketplace)
    return F.when(bare == "", "").otherwise(F.concat(prefix, bare))


def stable_article(x: Column) -> Column:
    a = F.trim(F.coalesce(x, F.lit("")))
    return ~F.lower(a).isin(*UNSTABLE) & (a.rlike(r"^\d{4,}$") | ((F.length(a) >= 6) & ~a.rlike(r"(?i)^yandex-?$")))


def storage(x: Column) -> Column:
    """RAM+ROM as '8+256', else ROM as '512gb'; terabytes count 1024."""
    end = r"(?![a-zа-яё])"
    tb = lambda c: F.floor(F.translate(c, ",", ".").cast("double") * 1024 + 0.5).cast("string")
    plus_tb, plus = rf"(\d{{1,2}})\s*\+\s*(\d(?:[.,]\d)?)\s*(?:тб|tb){end}", rf"(\d{{1,2}})\s*[+/]\s*(\d{{2,4}})\s*(?:gb|гб)?{end}"
    both, only_tb, only_gb = rf"(\d{{1,2}})\s*(?:gb|гб)\s*[+/]\s*(\d{{2,4}})\s*(?:gb|гб){end}", rf"(\d(?:[.,]\d)?)\s*(?:тб|tb){end}", rf"(\d{{2,4}})\s*(?:gb|гб){end}"
    join = lambda a, b: F.concat(a, F.lit("+"), b)
    gb = lambda c: F.concat(c, F.lit("gb"))

    def told(t: Column) -> Column:
        two = lambda p, of=lambda c: c: F.when(t.rlike(p), join(matched(t, p, 1), of(matched(t, p, 2))))
        return F.coalesce(two(plus_tb, tb), two(plus), two(both), gb(tb(matched(t, only_tb, 1))), gb(matched(t, only_gb, 1)))

    return let(F.trim(F.translate(F.lower(x), " ", " ")), told)


def storage_compatible(a: Column, b: Column) -> Column:
    """Equal, or equal in ROM; null if either is unknown."""
    rom = lambda c: F.regexp_replace(F.regexp_replace(c, r"^\d+\+", ""), "gb$", "")
    return F.when(a.isNotNull() & b.isNotNull(), (a == b) | (rom(a) == rom(b)))


def color(x: Column) -> Column:
    """Family of a colour word: the word itself, else the first of two words that the text contains, else the first of one."""
    words = [(w, f) for f, ws in COLORS.items() for w in ws]
    order = [*[wf for wf in words if " " in wf[0]], *[wf for wf in words if " " not in wf[0]]]
    told = lambda low: F.coalesce(*[F.when(low == w, F.lit(f)) for w, f in words], *[F.when(low.contains(w), F.lit(f)) for w, f in order])
    return let(F.trim(F.regexp_replace(F.lower(x), r"\s+", " ")), told)


def volume_ml(x: Column) -> Column:
    number = lambda t, p: matched(t, p, 1).cast("double")
    whole = lambda value, scale: let(value, lambda v: F.when(v > 0, F.floor(v * scale + 0.5)))
    litres, ml = r"(\d+(?:\.\d+)?)\s*(?:л|l|литр(?:а|ов)?)(?![a-zа-яё])", r"(\d+(?:\.\d+)?)\s*(?:мл|ml)(?![a-zа-яё])"
    return let(F.translate(F.translate(F.lower(x), " ", " "), ",", "."), lambda t: F.coalesce(whole(number(t, litres), 1000), whole(number(t, ml), 1)))


def package_count(x: Column) -> Column:
    patterns = (r"(\d+)\s*(?:шт|pcs|pc)(?![a-zа-яё])", r"уп\.?\s*(?:по\s*)?(\d+)", r"(\d+)\s*(?:в\s*)?уп", r"x\s*(\d+)(?![a-z0-9_])", r"(\d+)\s*pack(?![a-z0-9_])")
    counted = lambda found: let(found, lambda n: F.when(n.cast("double").between(1, 500), n.try_cast("int")))
    return let(F.translate(F.lower(x), " ", " "), lambda t: F.coalesce(*[counted(matched(t, p, 1)) for p in patterns]))


def first_price(x: Column) -> Column:
    """The first run of digits, spaces inside it dropped; 0 without one."""
    run = F.regexp_extract(F.translate(x, " ", " "), r"(\d[\d\s]*\d|\d)", 1)
    return F.coalesce(F.regexp_replace(run, r"\s", "").try_cast("bigint"), F.lit(0))


def marketplace_of(url: Column) -> Column:
    return F.when(url.rlike(r"(?i)wildberries\.ru"), "wildberries").when(url.rlike(r"(?i)ozon\.ru"), "ozon").when(url.rlike(r"(?i)market\.yandex\.ru"), "yandex_market")


def image_score(url: Column) -> Column:
    u = F.lower(url)
    points = lambda pattern, n: F.when(u.rlike(pattern), n).otherwise(0)
    return (
        points(r"product-medias|product-images|/product/", 50) + points(r"img\.mvideo\.ru|a\.lmcdn\.ru|lmcdn\.ru|cdn\.citilink\.ru|alicdn\.com", 30)
        - points(r"width=150|img46x66|width:55|height:55", 15) - points(r"width:1920|height:80|nw_banne", 80)
    )


def _ranges(chars) -> str:
    """A class of characters as ranges: classes of many single characters are tried one by one."""
    runs = []
    for code in sorted(map(ord, chars)):
        if runs and runs[-1][1] == code - 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs) + "]"


@functools.cache
def _unfolding() -> tuple[str, str, dict[str, str]]:
    """Of characters whose compatibility decomposition has Latin letters or digits: those that come to one such and marks behind it, with what they come to, in two texts of equal length; and
    the others with what they come to, all else in them a hyphen."""
    plain, to, others = [], [], {}
    for code in range(0x80, 0x30000):
        told = unicodedata.normalize("NFKD", chr(code))
        if told == chr(code) or not re.search("[A-Za-z0-9]", told):
            continue
        if re.fullmatch(r"[A-Za-z0-9][^A-Za-z0-9]+", told):
            plain.append(chr(code))
            to.append(told[0])
        else:
            others[chr(code)] = re.sub("[^a-z0-9]+", "-", told.lower())
    return "".join(plain), "".join(to), others


def unfolded(x: Column) -> Column:
    """Decomposed as NFKD does, so far as it leads to Latin letters and digits: an accented letter becomes the letter and a hyphen for its marks, a ligature its letters."""
    marked, letters, others = _unfolding()
    single = {c: v for c, v in others.items() if len(v) == 1}
    several = {c: v for c, v in others.items() if len(v) != 1}
    table = F.create_map(*[F.lit(v) for pair in several.items() for v in pair])
    # few texts have any of these; the map is only searched for them
    spelled = lambda v: F.array_join(F.transform(F.split(v, ""), lambda c: F.when(c.rlike(_ranges(several)), F.coalesce(F.try_element_at(table, c), c)).otherwise(c)), "")
    rare = lambda v: F.when(v.rlike(_ranges(several)), spelled(v)).otherwise(v)
    plain = lambda v: F.when(v.rlike(_ranges(others)), let(F.translate(v, "".join(single), "".join(single.values())), rare)).otherwise(v)
    bare = lambda v: F.translate(F.regexp_replace(v, f"({_ranges(marked)})", "$1-"), marked, letters)
    return F.when(x.rlike(r"[^\x00-\x7f]"), let(plain(x), lambda v: F.when(v.rlike(_ranges(marked)), bare(v)).otherwise(v))).otherwise(x)


def slug(x: Column, longest: int = 80) -> Column:
    """Unfolded, lower case, everything but a-z and 0-9 to single hyphens, at most `longest` characters; 'item' if nothing is left."""
    whole = F.regexp_replace(F.regexp_replace(F.lower(unfolded(x)), r"[^a-z0-9]+", "-"), "^-|-$", "")
    return let(F.regexp_replace(F.substring(whole, 1, longest), "-$", ""), lambda cut: F.when(F.length(cut) == 0, "item").otherwise(cut))


def sentiment(x: Column, good: tuple[str, ...] = PRAISE, bad: tuple[str, ...] = COMPLAINT) -> Column:
    """(good - bad) / (good + bad) over different stems that the text contains; 0 without any."""
    low = F.lower(x)
    count = lambda stems: sum((F.when(low.contains(s), 1).otherwise(0) for s in stems), F.lit(0))
    p, n = count(good), count(bad)
    return F.when(p + n == 0, 0.0).otherwise((p - n) / (p + n))


def failure_kind(error: Column, timed_out: Column, nothing: Column) -> Column:
    """Why a fetch failed: the first rule that holds."""
    e = F.lower(F.coalesce(error, F.lit("")))
    return (
        F.when(timed_out | e.contains("timeout"), "timeout").when(e.contains("captcha") | e.contains("still_blocked") | e.contains("challenge"), "captcha")
        .when(e.rlike(r"5\d\d"), "http_5xx").when(F.startswith(e, F.lit("identity:")), "identity").when(nothing, "unavailable").otherwise("exception")
    )


def funnel_failure(error: Column) -> Column:
    s = F.lower(F.coalesce(error, F.lit("")))
    return (
        F.when(F.trim(s) == "", "unknown").when(s.rlike("timeout|timed out|превышено время"), "timeout").when(s.rlike("network|fetch|econn|offline|нет сети|cors"), "network_error")
        .when(s.rlike("parse|json"), "parser_error").when(s.rlike("unavailable|503|502|blocked|captcha|marketplace"), "marketplace_unavailable")
        .when(s.rlike("not found|не найден|no results|product_not_found"), "product_not_found").when(s.rlike("match|категор|отклон|confidence"), "matching_failed").otherwise("unknown")
    )


def fnv1a(x: Column, most: int = 200) -> Column:
    """32-bit FNV-1a of the first `most` characters, in hexadecimal; characters up to U+FFFF count as one unit."""
    codes = F.transform(F.filter(F.split(F.substring(x, 1, most), ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))
    step = lambda h, c: (h.bitwiseXOR(c) * 16777619).bitwiseAND(0xFFFFFFFF)
    return F.lower(F.hex(F.aggregate(codes, F.lit(2166136261).cast("bigint"), step)))


#: Tails of titles that a store adds, and badges that stand where a title should.
STORE_TAIL, BUY_TAIL = r"(?iu)\s*[|/–—-]\s*(Wildberries|Ozon|Вайлдберриз|Озон).*$", r"(?iu)\s+купить.*$"
PROMO = r"(?iu)^\d+\s*балл|баллов|скидк|доставк|завтра|рассроч|кэшбэк|купон|акци|распрод|осталось\s*\d|рекомен|(?<![A-Za-z0-9_])хит(?![A-Za-zА-Яа-яЁё0-9_])|новинк|выбор\s+покупател|^\d+\s*шт\.?\s*$"
KNOWN_NAMES = r"(?iu)(?<![A-Za-z0-9_])(?:canon|nikon|sony|fuji|eos|iphone|samsung|nike|adidas|xiaomi|redmi|trace)(?![A-Za-z0-9_])"


def clean_title(x: Column) -> Column:
    """Without what a store or a seller appends."""
    return F.trim(F.regexp_replace(F.regexp_replace(x, STORE_TAIL, ""), BUY_TAIL, ""))


def promo_title(x: Column) -> Column:
    """Whether a text is a badge or an offer line and no product name: nothing, too short, or such words in a short line without a known name."""
    s = F.trim(F.coalesce(x, F.lit("")))
    short = (F.length(s) < 6) & ~s.rlike(r"(?iu)[a-zа-яё]{4,}")
    return (s == "") | short | (s.rlike(PROMO) & (F.length(s) < 48) & ~s.rlike(KNOWN_NAMES)) | s.rlike(r"(?iu)^(осталось\s+\d+|\d+\s*балл)")


def serp_title(title: Column, lines: Column, fallback: str = "Товар") -> Column:
    """The title, unless it is a badge; else the longest line of its tile that is none; else the fallback; at most 200 characters."""
    good = F.filter(F.transform(F.split(F.coalesce(lines, F.lit("")), r"[\n|•]"), lambda v: F.trim(v)), lambda v: (F.length(v) >= 8) & ~promo_title(v))
    longest = F.try_element_at(F.array_sort(good, lambda a, b: F.length(b) - F.length(a)), F.lit(1))
    return F.substring(F.coalesce(F.when(~promo_title(title), F.trim(title)), longest, F.lit(fallback)), 1, 200)
