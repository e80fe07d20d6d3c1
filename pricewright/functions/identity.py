"""What identifies an offer, and what to search for: fingerprints, canonical ids, exclusion of rejected ones, search queries and their guards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as t
from .titles import DEPENDENT, entity_query, entity_query_with_host, has, let, part, rx, spaced

#: Words of phones and laptops, of furniture and food, of dummies.
PHONE_WORDS = r"смартфон|телефон|iphone|pixel|galaxy|redmi|xiaomi|poco|realme|honor|huawei|samsung|smartphone|ноутбук|laptop|macbook|notebook"
FURNITURE_WORDS = r"комод|диван|кровать|шкаф|стол\b|стул|крабов|палочк|йогурт|молоко"
REPLICA_WORDS = r"муляж|имитац|реквизит|нефункционал|не\s*рабоч|игрушк|dummy|mockup|display\s*model|реплик|копия"
#: Categories that a fashion store has, and those that electronics stores don't.
FASHION, NOT_ELECTRONIC, ELECTRONICS_STORES = ("apparel", "shoes", "sports", "kids", "cosmetics"), ("apparel", "shoes", "cosmetics", "detergents", "pet_food", "home_textile"), ("mvideo", "dns", "citilink")


#: Words of accessories among search results, and words that limit a price or a size in a query.
JUNK = r"чехол|стекл[оа]\s*защит|кабель|провод|адаптер|наушник|кейc|\bcase\b|\bcover\b|\bsleeve\b|\bpouch\b|\bcharger\b|\badapter\b|\btempered\s+glass\b|\bscreen\s+protector\b|\bcharging\s+cable\b|плёнк|пленк|защитн\w*\s+(?:стекл|плёнк|пленк)|держатель|подставк|сумк\w*\s+для\s+(?:ноут|laptop)|\blaptop\s+(?:sleeve|bag|case)\b"
CONSTRAINT = r"(?:^|[\s,.:;!?])(?:до|от|не\s+менее|не\s+более|бюджет|дешевле|не\s+дороже|минимум|максимум)(?:$|[\s,.:;!?\d])"


def serp_confidence(reference: Column, candidate: Column, accessory_words: str) -> Column:
    """0 for an accessory, furniture or a dummy of a phone or laptop, 0 for other memory, else the share of words (see text.title_score)."""
    gigabytes = lambda x: F.filter(F.transform(F.regexp_extract_all(x, F.lit(rx(r"(\d+)\s*(?:gb|гб)")), F.lit(1)), lambda g: g.cast("int")), lambda g: g.between(32, 2048))
    mine, other = gigabytes(reference), gigabytes(candidate)
    one = lambda a: F.when(F.size(a) == 1, F.try_element_at(a, F.lit(1)))
    junk = has(candidate, f"{accessory_words}|{FURNITURE_WORDS}|{REPLICA_WORDS}") & has(reference, PHONE_WORDS) & ~has(reference, f"{accessory_words}|{REPLICA_WORDS}")
    rom = part(reference, r"(\d{1,2})\s*/\s*(\d{2,4})\s*(?:gb|гб)?", 2).cast("int")
    no = lambda c: F.coalesce(c, F.lit(False))
    return F.when(junk | no(one(mine) != one(other)) | no((rom >= 32) & (one(other) != rom)), 0).otherwise(t.title_score(reference, candidate))


def _token(x: Column) -> Column:
    return F.substring(F.regexp_replace(F.lower(x), "[^a-zа-яё0-9]+", ""), 1, 48)


def offer_fingerprint(title: Column, article: Column, line: Column) -> Column:
    """article|line|generation|title, without parts that are unknown."""
    gen = F.coalesce(line["gen_key"], F.when(line["gen"] > 0, line["gen"].cast("string")))
    plain = F.substring(F.regexp_replace(title, rx(r"\b(?:карта\s+памяти|microsd(?:xc|hc)?|смартфон|телефон)\b"), " "), 1, 80)
    parts = F.filter(F.array(article, _token(line["lineage"]), gen, _token(plain)), lambda p: F.coalesce(p, F.lit("")) != "")
    return F.array_join(parts, "|")


def with_article(article: Column, named: Column) -> Column:
    """offer_fingerprint() of an article, from that of the same title without one."""
    return F.concat_ws("|", F.nullif(article, F.lit("")), F.nullif(named, F.lit("")))


def identity_excluded(print_: Column, rejected: Column) -> Column:
    """Whether a rejected fingerprint is the same, or shares the article (of five characters or more), or line and generation."""
    at = lambda x, i: F.nullif(F.coalesce(F.try_element_at(F.split(x, r"\|"), F.lit(i)), F.lit("")), F.lit(""))
    same = lambda x, i: F.coalesce(at(print_, i) == at(x, i), F.lit(False))
    return (F.coalesce(print_, F.lit("")) != "") & F.exists(rejected, lambda x: (x == print_) | (same(x, 1) & (F.length(at(x, 1)) >= 5)) | (same(x, 2) & same(x, 3)))


#: Features that fingerprints and canonical ids are made of.
OF_FINGERPRINTS = ("title", "brand", "category", "storage", "color", "line", "e")


def _card_part(x: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"\s+", "")


def card_parts(f: Column) -> Column:
    """brand|model|memory|colour, without parts that are unknown."""
    return F.array_join(F.filter(F.transform(F.array(f["brand"], f["e"]["model"]["model"], f["storage"], f["color"]), _card_part), lambda p: p != ""), "|")


def card_bare(title: Column) -> Column:
    return F.substring(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}]+", ""), 1, 64)


def card_of(parts: Column, article: Column, bare: Column) -> Column:
    """brand|model|memory|colour|article, at most 160 characters, without parts that are unknown; the title's letters and digits if all are."""
    whole = F.concat_ws("|", F.nullif(parts, F.lit("")), F.nullif(_card_part(article), F.lit("")))
    return F.when(whole == "", bare).otherwise(F.substring(whole, 1, 160))


def card_fingerprint(f: Column, article: Column) -> Column:
    return card_of(card_parts(f), article, card_bare(f["title"]))


def canonical_id(brand: Column, model: Column, storage: Column, category: Column) -> Column:
    """canon:brand|model|memory|category, null without brand or model."""
    norm = lambda x: F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[\s().,]+", "")
    parts = F.filter(F.array(norm(brand), norm(model), norm(storage), F.coalesce(category, F.lit(""))), lambda p: p != "")
    return F.when((norm(brand) != "") & (norm(model) != ""), F.substring(F.concat(F.lit("canon:"), F.array_join(parts, "|")), 1, 160))


def memory_of(title: Column) -> Column:
    """Memory as page groups write it: '128gb', '1tb', or empty."""
    whole = part(title, r"(\d+)\s*(?:gb|гб|tb|тб)(?![a-zа-яё])")
    unit = F.when(F.lower(F.regexp_replace(whole, r"^\d+\s*", "")).rlike("^[tт]"), "tb").otherwise("gb")
    return F.when(whole.isNull(), "").otherwise(F.concat(F.regexp_extract(whole, r"^\d+", 0), unit))


def search_gate(store: Column, category: Column) -> Column:
    return F.when((store == "lamoda") & ~category.isin(*FASHION), "fashion_only").when(store.isin(*ELECTRONICS_STORES) & category.isin(*NOT_ELECTRONIC), "electronics_only")


def names_model(query: Column, constraint: str) -> Column:
    q = spaced(F.lower(F.coalesce(query, F.lit(""))))
    return ~has(q, constraint) & F.length(q).between(1, 80) & (F.size(F.split(q, " ")) <= 8)


def feature_query(f: Column) -> Column:
    """Brand, unless the model says it, model, series, memory, volume, and colour where it tells products apart; at most 100 characters."""
    model, brand = f["e"]["model"]["model"], f["brand"]
    lead = F.when(model == "", brand).when(brand.isNotNull() & ~F.lower(model).contains(brand), F.concat_ws(" ", brand, model)).otherwise(model)
    memory = F.regexp_replace(F.replace(f["storage"], F.lit("+"), F.lit(" ")), "gb$", "")
    volume = F.when(f["volume"] >= 1000, F.concat(F.regexp_replace(F.format_string("%.3f", f["volume"] / 1000.0), r"\.?0+$", ""), F.lit(" л"))).when(f["volume"] > 0, F.concat(f["volume"].cast("string"), F.lit(" мл")))
    color = F.when(~f["category"].isin("smartphones", "memory_cards"), f["color"])
    return F.substring(F.trim(F.concat_ws(" ", lead, f["series"], memory, volume, color)), 1, 100)


def cleaned_query(query: Column, f: Column) -> Column:
    """Without bracketed articles, noise words, doubled words and lone units; with the generation that the title has; at most 80 characters, cut between words."""
    plain = F.regexp_replace(query, r"\([^)]*\)", " ")
    for pattern in (r"\brmx\d{4,7}\b", r"\b(смартфон|телефон|android|nano-?sim)\b", r"\b(gray|grey)\b", r"(?<!\d)(?:\s|^)(?:гб|gb)\b", r"\s*,[,\s]*"):
        plain = F.regexp_replace(plain, rx(pattern), " ")
    line = f["line"]

    def told(q: Column) -> Column:
        missing = line["lineage"].isin("pixel", "iphone") & ~F.lower(F.regexp_replace(q, r"\s+", "")).contains(F.concat(line["lineage"], line["gen"].cast("string")))
        return F.when(F.coalesce(missing, F.lit(False)), F.concat_ws(" ", q, line["lineage"], line["gen"].cast("string"))).otherwise(q)

    short = lambda q: F.trim(F.when(F.length(q) <= 80, q).otherwise(F.regexp_replace(F.substring(q, 1, 80), r"(?<=^.{40,79})\s\S*$", "")))
    return let(let(spaced(F.regexp_replace(plain, rx(r"\b([A-Za-zА-Яа-яЁё]{2,})\s+\1\b"), "$1")), told), short)


def query_set(f: Column) -> Column:
    """Up to three different queries of three characters or more: the entity's for parts and accessories, by features, by model and memory, by model."""
    e, model = f["e"]["entity"], f["e"]["model"]
    dependent = e["role"].isin(*DEPENDENT)
    memory = F.regexp_replace(F.replace(f["variant_storage"], F.lit("+"), F.lit(" ")), "gb$", "")
    some = F.array(
        F.when(dependent, entity_query(e)), F.when(dependent, entity_query_with_host(e)), feature_query(f), F.substring(F.concat_ws(" ", model["query"], memory), 1, 100), model["query"],
        F.when(f["variant_storage"].isNotNull(), F.substring(F.concat_ws(" ", model["model"], f["variant_storage"]), 1, 100)),
    )
    good = F.filter(F.transform(F.array_compact(some), lambda q: cleaned_query(q, f)), lambda q: F.length(q) >= 3)
    first = lambda g: F.filter(g["good"], lambda q, i: F.array_position(g["low"], F.lower(q)) == i + 1)
    both = let(good, lambda qs: F.struct(qs.alias("good"), F.transform(qs, lambda q: F.lower(q)).alias("low")))
    return F.slice(let(both, first), 1, 3)


def query_variant(f: Column, variant: Column, article: Column) -> Column:
    """Query of a strategy: 0 model, 1 short model, 2 the store's own article, 3 leading words, or the entity with its host, 4 as 0."""
    e, model = f["e"]["entity"], f["e"]["model"]
    lead = F.coalesce(F.nullif(entity_query(e), F.lit("")), model["query"])
    leading = F.substring(F.array_join(F.slice(F.filter(F.split(f["title"], r"\s+"), lambda w: F.length(w) > 2), 1, 5), " "), 1, 80)
    of_entity = F.when(variant == 1, F.substring(e["entity"], 1, 80)).when((variant == 2) & article.isNotNull(), article).when(variant == 3, F.coalesce(entity_query_with_host(e), lead)).otherwise(lead)
    of_model = (
        F.when(variant == 1, F.substring(model["model"], 1, 80)).when(variant == 2, F.coalesce(article, F.when(F.length(model["query"]) >= 4, model["query"]), F.substring(f["title"], 1, 80)))
        .when(variant == 3, leading).otherwise(F.when(F.length(model["query"]) >= 4, model["query"]).otherwise(F.substring(f["title"], 1, 120)))
    )
    return F.when(e["role"].isin(*DEPENDENT) & (F.length(e["entity"]) >= 3), of_entity).otherwise(of_model)


def host_only(query: Column, e: Column) -> Column:
    """Whether a query for a part or accessory says nothing but its host."""
    q, low = spaced(F.lower(query)), F.lower(e["entity"])
    tokens = F.filter(F.split(low, r"\s+"), lambda w: F.length(w) >= 4)
    names = F.exists(tokens, lambda w: q.contains(w))
    host = F.lower(e["host"])
    like_host = F.coalesce((q == host) | host.contains(q) | q.contains(F.split(host, r"\s+")[0]), F.lit(False))
    console = (e["family"] == "console") & has(q, r"\b(?:playstation|ps\s*[45]|xbox|nintendo\s+switch)\b")
    phone = (e["family"] == "phone") & has(q, r"\b(?:iphone|galaxy|смартфон)\b") & ~has(F.coalesce(e["noun"], e["entity"]), "чехол|case") & (e["role"] == "accessory") & ~has(q, "чехол|case|плёнк|пленк|стекл")
    return e["role"].isin(*DEPENDENT) & (F.length(q) >= 3) & ~names & F.coalesce(like_host | F.coalesce(console, F.lit(False)) | F.coalesce(phone, F.lit(False)), F.lit(False))


def page_group(title: Column, brand: Column, category: Column) -> Column:
    """Group of pages of one product: brand (the first word unless given), the four words after it, memory, category."""
    words = F.filter(F.split(spaced(title), " "), lambda w: w != "")
    return canonical_id(F.coalesce(brand, F.try_element_at(words, F.lit(1))), F.array_join(F.slice(words, 2, 4), " "), F.nullif(memory_of(title), F.lit("")), category)
