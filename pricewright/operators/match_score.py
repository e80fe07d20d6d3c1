"""Pairs of titles: gates, feature match, score and its diagnosis, and ranked candidates of each reference.

a and b are structs of titles.features(), the reference's and the candidate's. They are columns of the pair's row, so nothing of a title is computed once a pair.
"""

from __future__ import annotations

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as n
from ..functions import text as t
from ..functions.titles import DEPENDENT, PLACEHOLDER, SURE, let, spread
from ..sources.shared import stored

#: Weights of features by category, features whose conflict counts, that are soft, that are ignored.
PROFILES = {
    "memory_cards": ("brand 25 model 45 storage 25 price 5", "brand model", "", "color size volume weight package_count gender"),
    "accessories": ("brand 25 model 25 connector 25 authenticity 15 condition 10 color 10 price 10", "connector", "color storage", "size volume package_count"),
    "tvs": ("brand 30 model 35 price 10", "brand model", "color", "storage size volume package_count"),
    "monitors": ("brand 30 model 35 price 10", "brand model", "color", "storage size volume package_count"),
    "smartphones": ("brand 30 model 40 storage 20 region 10 condition 10 color 3 price 5", "brand model", "color", "size volume weight package_count"),
    "gpus": ("brand 30 model 40 color 5 price 10", "brand model", "color", "storage size volume package_count"),
    "monoblocks": ("brand 25 model 30 storage 15 color 5 price 10", "brand model", "color", "size volume package_count"),
    "desktops": ("brand 25 model 30 storage 15 color 5 price 10", "brand model", "color", "size volume package_count"),
    "laptops": ("brand 25 model 30 storage 20 region 10 condition 10 color 5 price 5", "brand model", "color", "size volume package_count"),
    "pc_components": ("brand 30 model 40 storage 15 price 10", "brand model", "", "color size volume package_count"),
    "headphones": ("brand 30 model 40 connector 20 authenticity 15 condition 10 color 10 price 5", "brand model connector", "color", "storage size volume package_count"),
    "wearables": ("brand 30 model 40 series 10 color 10 price 5", "brand model", "color", "storage size volume package_count weight"),
    "lenses": ("brand 30 model 40 series 10 color 5 price 5", "brand model", "color", "storage size volume package_count weight gender"),
    "cameras": ("brand 30 model 45 series 10 color 5 price 5", "brand model", "color", "storage size volume package_count weight"),
    "consoles": ("brand 25 model 45 series 10 color 10 price 5", "brand model", "color", "storage size volume package_count weight"),
    "networking": ("brand 35 model 40 series 10 price 5", "brand model", "color", "storage size volume gender"),
    "power_tools": ("brand 35 model 40 series 10 price 5", "brand model", "color", "storage size volume gender"),
    "appliances": ("brand 30 model 35 series 15 volume 10 weight 10 price 5", "brand", "color volume weight", "storage size gender"),
    "home_textile": ("brand 25 series 25 model 15 color 15 material 10 price 5", "brand", "size color model", "storage volume package_count gender"),
    "home_goods": ("brand 25 series 25 model 15 color 15 material 10 price 5", "brand", "model color", "storage size volume gender package_count"),
    "kids": ("brand 25 model 25 color 15 gender 10 material 10 price 5", "brand", "size gender model", "storage volume package_count"),
    "sports": ("brand 25 model 20 series 15 weight 20 volume 15 color 10 price 5", "brand", "size model color", "storage gender"),
    "shoes": ("brand 30 model 30 color 15 material 10 price 5", "brand", "size", "storage volume package_count"),
    "apparel": ("brand 30 model 25 color 25 material 10 gender 10 price 5", "brand color", "size gender", "storage volume package_count"),
    "detergents": ("brand 30 series 25 model 15 volume 20 package_count 15 price 5", "brand package_count", "color", "storage size"),
    "cosmetics": ("brand 30 series 20 model 15 volume 20 color 15 price 5", "brand", "", "storage size package_count"),
    "grocery": ("brand 30 series 15 model 10 weight 20 package_count 15 price 5", "brand", "model color", "storage size connector"),
    "pet_food": ("brand 30 series 20 model 10 weight 20 package_count 10 price 5", "brand package_count", "", "storage size color"),
    "generic": ("brand 40 model 35 storage 15 color 5 price 5", "brand model", "", ""),
}
#: Categories whose models may differ, in which memory says nothing, and that are devices of their own.
SOFT_MODEL = ("apparel", "shoes", "home_textile", "home_goods", "kids", "sports", "detergents", "cosmetics", "pet_food", "grocery", "tvs", "monitors", "accessories")
NO_STORAGE = (
    "apparel", "shoes", "home_textile", "home_goods", "kids", "sports", "detergents", "cosmetics", "pet_food", "grocery", "headphones", "wearables", "cameras", "lenses", "consoles", "networking", "power_tools", "appliances", "tvs",
    "monitors", "accessories",
)
DEVICES = ("smartphones", "laptops", "tvs", "monitors", "cameras", "headphones", "wearables", "gpus", "desktops", "monoblocks", "consoles")
#: Limits of scores and confidences.
LEAST, PICK, WARN, CAP_GENERIC, CAP_CONNECTOR, REJECT_PENALTY = 55, 70, 65, 0.35, 0.69, 0.95

_WEIGHTS = {c: dict(zip(w.split()[::2], map(int, w.split()[1::2]), strict=True)) for c, (w, *_) in PROFILES.items()}
KEYS = sorted({k for w in _WEIGHTS.values() for k in w})


def _in(category: Column, key: str, place: int) -> Column:
    return category.isin(*[c for c, p in PROFILES.items() if key in p[place].split()] or [""])


def _weight(category: Column, key: str) -> Column:
    """The feature's weight in the category, null where it has none."""
    chain = None
    for c, w in _WEIGHTS.items():
        if key in w:
            chain = F.when(category == c, w[key]) if chain is None else chain.when(category == c, w[key])
    return chain


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def compact(x: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[\s()]+", "")


def family_of(brand: Column) -> Column:
    """Brands of one maker in feature matches."""
    return F.when(brand.isin("redmi", "poco", "xiaomi"), "xiaomi").otherwise(brand)


def categories_clash(a: Column, b: Column) -> Column:
    return (a != b) & (a != "generic") & (b != "generic")


def accessory_for_device(a: Column, b: Column) -> Column:
    """A candidate with an accessory's words against a reference that is a device."""
    named = ((a["category"] == "generic") & a["marks"]["phone_brand"]) | a["marks"]["device"] | a["category"].isin(*DEVICES)
    return b["marks"]["accessory"] & ~a["marks"]["accessory"] & (a["category"] != "accessories") & named


def roles_clash(e: Column, f: Column) -> Column:
    """One is a host, the other a part or accessory for hosts of its family, and one of them is surely so."""
    dependent = lambda x: x["role"].isin(*DEPENDENT)
    sides = (dependent(e) & (f["role"] == "primary")) | ((e["role"] == "primary") & dependent(f))
    return F.coalesce(sides & (e["family"] == f["family"]) & (F.greatest(e["confidence"], f["confidence"]) >= SURE), F.lit(False))


def lines_compatible(a: Column, b: Column) -> Column:
    """Same product line: same generation. Other lines are compatible, but for memory cards; unknown ones with all."""
    kind = lambda x: F.split(x["lineage"], ":")[0]
    unknown = lambda x: x["gen_key"].isNull() | (x["gen_key"] == "0")
    same_gen = F.when(unknown(a) | unknown(b), F.when((a["gen"] > 0) & (b["gen"] > 0), a["gen"] == b["gen"]).otherwise(True)).otherwise(a["gen_key"] == b["gen_key"])
    differ = a["lineage"] != b["lineage"]
    return (
        F.when(a.isNull() | b.isNull(), True).when(differ & (kind(a) == "flash") & (kind(b) == "flash"), False)
        .when(differ & ~((kind(a) == "buds") & (kind(b) == "buds")), True).otherwise(same_gen)
    )


def tier(k: Column, *names: tuple[str, str], other: str = "base") -> Column:
    return F.coalesce(*[F.when(k.contains(w), F.lit(v)) for w, v in names], F.lit(other))


#: Tiers of the lines whose models are told apart by them.
PHONE_TIERS, TABLET_TIERS, LAPTOP_TIERS = (("promax", "promax"), ("pro", "pro"), ("plus", "plus"), ("mini", "mini")), (("pro", "pro"), ("air", "air"), ("mini", "mini")), (("pro", "pro"), ("air", "air"))


def models_compatible(a: Column, b: Column) -> Column:
    """Whether two model names may be one product: lines with tiers by tier, others if one contains most of the other."""

    def judged(p: Column) -> Column:
        x, y = p["x"], p["y"]
        both = lambda word: x.contains(word) & y.contains(word)
        same = lambda *names, other="base": tier(x, *names, other=other) == tier(y, *names, other=other)
        pods = lambda k: F.coalesce(
            *[F.when(k.contains(w), F.lit(w)) for w in ("max", "pro", "anc")], F.nullif(F.regexp_extract(k, r"airpods(\d)", 1), F.lit("")), F.when(k.isin("airpods", "appleairpods"), "generic").otherwise("other")
        )
        gen = lambda k, p: F.nullif(F.regexp_extract(k, p, 1), F.lit(""))
        phones = F.coalesce(gen(x, r"iphone(\d{1,2})") == gen(y, r"iphone(\d{1,2})"), F.lit(True)) & same(*PHONE_TIERS)
        cards = same(("canvasgo", "go"), ("canvasselect", "select"), ("canvasreact", "react"), ("canvasendurance", "endurance"), other="other")
        whole = lambda k: k.rlike(r"(?<![a-z0-9_])canvas(?![a-z0-9_])")
        sony = r"wh1000xm(\d)"
        return (
            F.when((x == "") | (y == "") | (x == y), True).when(both("airpods"), pods(x) == pods(y)).when(both("macbook"), same(*LAPTOP_TIERS)).when(whole(x) & whole(y), cards)
            .when(both("ipad"), same(*TABLET_TIERS)).when(both("iphone"), phones)
            .when(gen(x, sony).isNotNull() & gen(y, sony).isNotNull(), gen(x, sony) == gen(y, sony)).otherwise(contained(x, y) >= 0.85)
        )

    return let(F.struct(compact(a).alias("x"), compact(b).alias("y")), judged)


def contained(x: Column, y: Column) -> Column:
    """Share of the longer of two names that the shorter makes up if it lies in it, else 0."""
    return F.when((x != "") & (y != "") & (x.contains(y) | y.contains(x)), F.least(F.length(x), F.length(y)) / F.greatest(F.length(x), F.length(y))).otherwise(0.0)


def equal_features(a: Column, b: Column) -> dict[str, Column]:
    """Of each feature, whether two titles agree: null if either side lacks it."""
    known = lambda k: a[k].isNotNull() & b[k].isNotNull()
    near = lambda k, share: F.when(known(k), F.greatest(a[k], b[k]) <= F.least(a[k], b[k]) * share)
    same = lambda k: F.when(known(k), a[k] == b[k])
    x, y = compact(a["e"]["model"]["model"]), compact(b["e"]["model"]["model"])
    s, r = compact(a["series"]), compact(b["series"])
    out = {k: same(k) for k in ("color", "package_count", "size", "material", "connector", "condition", "authenticity", "region", "edition")}
    return out | {
        "brand": F.when(known("brand"), (family_of(a["brand"]) == family_of(b["brand"])) | t.brands_compatible(a["brand"], b["brand"])), "model": F.when((x != "") & (y != ""), (x == y) | (contained(x, y) >= 0.7)),
        "storage": F.when(known("storage"), t.storage_compatible(a["storage"], b["storage"])), "volume": near("volume", 1.05), "weight": near("weight", 1.08),
        "series": F.when((s != "") & (r != ""), s.contains(r) | r.contains(s)), "gender": F.when(known("gender"), (a["gender"] == "unisex") | (b["gender"] == "unisex") | (a["gender"] == b["gender"])),
    }


def feature_score(a: Column, b: Column, category: Column) -> Column:
    """0 to 100 by the category's weights, spread over the features that either side has."""
    equal = equal_features(a, b)
    x, y = compact(a["e"]["model"]["model"]), compact(b["e"]["model"]["model"])
    share = F.when((x != "") & (x == y), 1.0).otherwise(contained(x, y))
    brands = family_of(a["brand"]), family_of(b["brand"])
    same_brand = F.coalesce(brands[0] == brands[1], F.lit(False))
    present = lambda side, k: compact(side["e"]["model"]["model"]) != "" if k == "model" else side[k].isNotNull()
    credit, weight = {}, {}
    for k in KEYS:
        if k == "price":
            credit[k], weight[k] = F.lit(1.0), F.coalesce(_weight(category, k), F.lit(0))
            continue
        soft = F.when(equal[k].isNull(), 0.5).when(equal[k], 1.0).otherwise(0.45)
        hit = {"model": F.when(share >= 0.99, 1.0).otherwise(F.greatest(F.lit(0.7), share)), "brand": F.when(same_brand, 1.0).otherwise(0.5)}.get(k, F.lit(1.0))
        neither = F.when(~present(a, k) & ~present(b, k), {"brand": 0.25, "model": 0.15}[k]).otherwise(0.4) if k in ("brand", "model") else F.lit(0.4)
        hard = F.when(equal[k].isNull(), neither).when(equal[k], hit).otherwise(0.0)
        credit[k] = F.when(_in(category, k, 2), soft).otherwise(hard)
        counted = ~_in(category, k, 3) & (present(a, k) | present(b, k))
        weight[k] = F.when(counted, F.coalesce(_weight(category, k), F.lit(0))).otherwise(0)
    usual = F.least(F.lit(100.0), sum((credit[k] * weight[k] for k in KEYS), F.lit(0.0)) * 100.0 / F.greatest(sum((weight[k] for k in KEYS), F.lit(0)), F.lit(1)))
    hard = lambda k: _in(category, k, 1) & ~_in(category, k, 2) & ~_in(category, k, 3) & F.coalesce(~equal[k], F.lit(False))
    clash = F.coalesce((brands[0] != brands[1]) & ~t.brands_compatible(a["brand"], b["brand"]), F.lit(False))
    of = lambda k, usually: F.coalesce(_weight(category, k), F.lit(usually))
    other_memory = F.coalesce(~category.isin(*NO_STORAGE) & (a["storage"] != b["storage"]), F.lit(False))
    memory = of("brand", 30) * F.when(same_brand, 1.0).otherwise(0.5) + of("model", 20) * share * 0.3 + F.when(F.coalesce(a["color"] == b["color"], F.lit(False)), of("color", 5)).otherwise(0) + of("price", 5)
    return (
        F.when(clash, 8).when(hard("brand") | hard("model"), F.least(F.lit(35), half_up(of("brand", 20) * 0.4))).when(other_memory, F.least(F.lit(42), half_up(memory))).otherwise(half_up(usual)).cast("bigint")
    )


def token_overlap(a: Column, b: Column) -> Column:
    """Shared tokens over the larger number of tokens; of the same graphics chip and another token over the smaller, and 0.55 at least."""
    x, y = a["tokens"], b["tokens"]
    shared = F.size(F.array_intersect(x, y))
    chip = lambda z: F.try_element_at(F.filter(z, lambda w: w.startswith("rtx")), F.lit(1))
    same_chip = F.coalesce(chip(x) == chip(y), F.lit(False)) & (shared >= 2)
    few, many = F.least(F.size(x), F.size(y)), F.greatest(F.size(x), F.size(y))
    return F.when(shared <= 0, 0.0).when(same_chip, F.greatest(F.lit(0.55), shared / few)).otherwise(shared / many)


def word_overlap(a: Column, b: Column) -> Column:
    shared, few = F.size(F.array_intersect(a["words"], b["words"])), F.least(F.size(a["words"]), F.size(b["words"]))
    return F.when(few <= 0, 0.0).otherwise(shared / F.greatest(F.size(a["words"]), F.size(b["words"])))


def variant_penalty(a: Column, b: Column) -> Column:
    """What different memory and colour take from a score."""
    differs = lambda k: F.coalesce(a[k] != b[k], F.lit(False))
    return F.least(F.lit(0.75), F.when(differs("variant_storage"), 0.55).otherwise(0.0) + F.when(differs("color"), 0.3).otherwise(0.0))


def category_penalty(category: Column, a: Column, b: Column) -> Column:
    """What a candidate of another kind takes from the score of a reference of the category."""
    m, k = a["marks"], b["marks"]
    only_accessory = lambda x: x["accessory"] & ~x["device"]
    named = m["device"] | m["phone_brand"]
    accessory = (k["accessory"] & ~m["accessory"] & named) | (only_accessory(m) != only_accessory(k))
    rules = {
        "accessories": accessory, "smartphones": accessory, "laptops": ~k["laptop"] & (k["intruder"] | only_accessory(k)), "gpus": ~(k["graphics"] & ~k["laptop"]) & (k["laptop"] | k["tower"]),
        "desktops": k["monoblock"] | (~(k["desktop"] & ~k["laptop"]) & (k["laptop"] | k["stencil"] | k["component"])), "monoblocks": ~k["monoblock"] & (k["desktop"] | k["laptop"] | k["component"] | k["chip"]),
        "pc_components": ~(k["component"] | k["chip"]) & (k["monoblock"] | k["laptop"] | k["desktop"]), "tvs": ~k["tv"] & ((k["monitor"] & ~k["tv_word"]) | only_accessory(k)), "monitors": ~(k["monitor"] & ~k["tv_word"]) & k["smart_tv"],
    }
    body = F.coalesce(m["body"] != k["body"], F.lit(False))
    return F.coalesce(*[F.when((category == c) & rule, REJECT_PENALTY) for c, rule in rules.items()], F.when((category == "cameras") & body, 0.65), F.lit(0.0))


def gate(a: Column, b: Column) -> Column:
    """The first reason for which a candidate cannot be the reference's product, or null."""
    c, d = a["category"], b["category"]
    differ = lambda k: F.coalesce(a[k] != b[k], F.lit(False))
    x, y = a["e"]["model"]["model"], b["e"]["model"]["model"]
    buds = F.coalesce((a["line"]["gen"] == b["line"]["gen"]) & a["line"]["lineage"].startswith("buds:") & b["line"]["lineage"].startswith("buds:"), F.lit(False))
    genuine, copied = ("original", "oem"), ("replica", "analog", "compatible")
    fake = (a["authenticity"].isin(*genuine) & b["authenticity"].isin(*copied)) | (a["authenticity"].isin(*copied) & b["authenticity"].isin(*genuine))
    replica = b["authenticity"].isin("replica", "analog") & ~F.coalesce(a["authenticity"].isin(*copied), F.lit(False)) & (c != "accessories")
    editions = F.concat_ws("|", F.array_sort(F.array(a["edition"], b["edition"]))).isin("digital|disc", "body|kit")
    no = lambda condition, reason: F.when(F.coalesce(condition, F.lit(False)), reason)
    return F.coalesce(
        no(blank_title(a) | blank_title(b), "empty_title"), no(categories_clash(c, d), "category"), no(accessory_for_device(a, b), "accessory"), no(roles_clash(a["e"]["entity"], b["e"]["entity"]), "entity_role"),
        no((a["marks"]["fits"] != b["marks"]["fits"]) & (c != "accessories") & (d != "accessories"), "compatibility"), no(~lines_compatible(a["line"], b["line"]), "lineage_generation"),
        no(~t.brands_compatible(a["brand"], b["brand"]), "brand"), no(~c.isin(*SOFT_MODEL) & (x != "") & (y != "") & ~models_compatible(x, y) & ~buds, "model"),
        no(~c.isin(*NO_STORAGE) & ~t.storage_compatible(a["storage"], b["storage"]), "storage"), no(c.isin("headphones", "accessories") & differ("connector"), "connector"), no(differ("condition"), "condition"),
        no(fake, "authenticity"), no(replica, "replica"), no(differ("region"), "region"), no(editions, "edition"), no(c.isin("detergents", "pet_food") & differ("package_count"), "package_count"),
        no(c.isin("cosmetics", "detergents") & differ("scent"), "scent"),
    )


def _terms(a: Column, b: Column, features: Column) -> Column:
    """struct of all that a score is made of but the likeness of the wordings."""
    c, d = a["category"], b["category"]
    x, y = a["e"]["model"]["model"], b["e"]["model"]["model"]
    named = (x != "") & (y != "")
    queries = t.word_overlap(a["e"]["model"]["query"], b["e"]["model"]["query"])
    floor = F.when(~named, 0.0).when(compact(x) == compact(y), 0.95).when(models_compatible(x, y), 0.75).otherwise(queries * 0.85)
    soft_color = _in(c, "color", 2) | _in(c, "color", 3)
    both_colors, same_color = a["color"].isNotNull() & b["color"].isNotNull(), F.coalesce(a["color"] == b["color"], F.lit(False))
    other_color = both_colors & ~same_color
    electronic = F.greatest(F.lit(0.0), variant_penalty(a, b) - F.when(soft_color & other_color, 0.3).otherwise(0.0))
    variant = F.when(c.isin(*NO_STORAGE), F.when(other_color & ~soft_color, 0.2).otherwise(0.0)).otherwise(electronic)
    one_connector = c.isin("headphones", "accessories") & (a["connector"].isNull() != b["connector"].isNull())
    return F.struct(
        (features / 100.0).alias("base"), named.alias("named"), floor.alias("floor"), variant.alias("variant"), (soft_color & same_color).alias("hue"), (soft_color & other_color).alias("other_hue"),
        category_penalty(c, a, b).alias("penalty"), ((c == "generic") != (d == "generic")).alias("generic"), one_connector.alias("one_connector"),
    )


def _total(p: Column, title: Column) -> Column:
    """The score of _terms() and the likeness of the wordings; it never falls where the likeness grows."""
    low = lambda v: F.greatest(F.lit(0.0), v)
    score = F.when(p["named"], F.greatest(p["base"], F.least(title, F.lit(0.72)))).otherwise(F.greatest(p["base"], title * 0.85))
    score = low(F.greatest(score, p["floor"]) - p["variant"])
    score = F.when(p["hue"], F.least(F.lit(1.0), score + 0.04)).when(p["other_hue"], low(score - 0.06)).otherwise(score)
    score = low(score - p["penalty"])
    score = F.when(p["generic"], F.least(score, F.lit(CAP_GENERIC))).otherwise(score)
    return F.when(p["one_connector"], F.least(score, F.lit(CAP_CONNECTOR))).otherwise(score)


def alike(a: Column, b: Column) -> Column:
    """Likeness of two titles' wordings, 0 to 1."""
    return F.greatest(word_overlap(a, b), token_overlap(a, b), t.edit_similarity(a["title"], b["title"]))


def scored(a: Column, b: Column) -> Column:
    """struct(score, gate, title): 0 where a gate is closed, else 0 to 1 by features, titles, models, variant and category."""

    def told(r: Column) -> Column:
        score = let(_terms(a, b, r["features"]), lambda p: _total(p, r["title"]))
        return F.struct(F.when(r["gate"].isNotNull(), 0.0).otherwise(score).alias("score"), r["gate"].alias("gate"), word_overlap(a, b).alias("title"))

    # behind a closed gate nothing else is looked at
    opened = lambda g: F.struct(g.alias("gate"), F.when(g.isNull(), feature_score(a, b, a["category"])).alias("features"), F.when(g.isNull(), alike(a, b)).alias("title"))
    return let(let(gate(a, b), opened), told)


def terms(a: Column, b: Column) -> Column:
    """struct(p, low, high) of two cores (core_of): _terms() and the scores of the least and the most alike wordings; null behind a closed gate."""
    p = let(feature_score(a, b, a["category"]), lambda features: _terms(a, b, features))
    return let(F.when(gate(a, b).isNull(), p), lambda p: F.when(p.isNotNull(), F.struct(p.alias("p"), _total(p, F.lit(0.0)).alias("low"), _total(p, F.lit(1.0)).alias("high"))))


#: Features that gates and terms read; of the title they read only whether it is blank.
CORE = (
    "brand", "category", "storage", "variant_storage", "color", "volume", "weight", "package_count", "size", "series", "gender", "material", "connector", "condition", "authenticity", "region", "edition", "scent", "line", "marks",
)


def blank_title(f: Column) -> Column:
    return (F.coalesce(f["title"], F.lit("")) == "") | (f["title"] == PLACEHOLDER)


def core_of(f: Column) -> Column:
    """Features without the wording: pairs of titles of two cores differ in their scores only by how alike() they are."""
    e, m = f["e"]["entity"], f["e"]["model"]
    entity = F.struct(F.struct(*[e[k].alias(k) for k in ("role", "family", "confidence")]).alias("entity"), F.struct(m["model"].alias("model"), m["query"].alias("query")).alias("model"))
    return F.struct(F.when(blank_title(f), "").otherwise("-").alias("title"), *[f[k].alias(k) for k in CORE], entity.alias("e"))


_built: dict[tuple, Column] = {}


def scored_of(a: str, b: str) -> Column:
    """scored() of named columns; built once a session, for it is a large expression."""
    key = SparkContext._active_spark_context.applicationId, a, b
    if key not in _built:
        _built[key] = scored(F.col(a), F.col(b))
    return _built[key]


def diagnosis(s: Column, a: Column, b: Column) -> Column:
    """struct(confidence, reject, reason) of a pair's scored(): the factor that decided."""
    confidence = n.confidence(s["score"])
    models = models_compatible(a["e"]["model"]["model"], b["e"]["model"]["model"])
    known = (a["e"]["model"]["model"] != "") & (b["e"]["model"]["model"] != "")
    reject = F.coalesce(
        F.when(s["gate"] == "empty_title", "empty_title"), F.when(categories_clash(a["category"], b["category"]), "category"), F.when(roles_clash(a["e"]["entity"], b["e"]["entity"]), "entity_role"),
        F.when(~lines_compatible(a["line"], b["line"]) & (s["score"] <= 0.15), "lineage_generation"), F.when(~t.brands_compatible(a["brand"], b["brand"]), "brand"),
        F.when(known & ~models & ~a["category"].isin(*SOFT_MODEL) & (s["score"] <= 0.15), "model"), F.when(confidence < LEAST, "confidence"),
    )
    names = {"category": "category_incompatible", "entity_role": "entity_role_incompatible", "lineage_generation": "lineage_mismatch", "brand": "brand_mismatch", "model": "model_mismatch", "confidence": "below_min_confidence"}
    reason = F.coalesce(*[F.when(reject == k, v) for k, v in names.items()], reject, F.when(confidence < PICK, "needs_choice_or_probable").otherwise("auto_pick_eligible"))
    return F.struct(confidence.cast("bigint").alias("confidence"), F.when(confidence < LEAST, reject).alias("reject"), reason.alias("reason"))


def warn_kind(s: Column, a: Column, b: Column, confidence: Column) -> Column:
    """What to warn of in a pair that is shown as a match: 'category', 'confidence' or nothing."""
    weak = F.coalesce(confidence < WARN, F.lit(False))
    alike = F.greatest(word_overlap(a, b), token_overlap(a, b))
    one_generic = (a["category"] == "generic") != (b["category"] == "generic")
    blank = (F.coalesce(a["title"], F.lit("")) == "") | (F.coalesce(b["title"], F.lit("")) == "") | (b["title"] == PLACEHOLDER)
    return (
        F.when(blank, None).when(categories_clash(a["category"], b["category"]) | roles_clash(a["e"]["entity"], b["e"]["entity"]), "category").when(one_generic & (weak | (s["score"] <= CAP_GENERIC)), "category")
        .when(~lines_compatible(a["line"], b["line"]), "confidence").when(weak & (alike < 0.55) & (s["score"] < 0.55), "confidence")
    )


def with_scores(pairs: DataFrame) -> DataFrame:
    """pairs (a, b) with their scored() as s and its score; stored, so that filters and windows on the score don't compute it again."""
    return stored(pairs.withColumn("s", scored_of("a", "b")), "scores").withColumn("score", F.col("s.score"))


def _dealt(rows: DataFrame, *by: str) -> DataFrame:
    """rows dealt by columns to four tasks a core, however few bytes they are: what follows is a long computation."""
    spark = rows.sparkSession
    return rows.repartition(4 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by)


def told_of_texts(pairs: DataFrame, texts_a: DataFrame, texts_b: DataFrame, scores: bool = True, **told: Column) -> DataFrame:
    """pairs (text_a, text_b: numbers of titles.numbered()) with what both texts' features (column f of texts_a and texts_b) tell: the columns told, of a and b and, with scores,
    of their scored() s, which comes too, and its score. Computed once for each different pair of texts, on every core, and stored; pairs stay narrow. pairs should be stored, for they are read twice."""
    side = lambda texts, k: _dealt(texts.select(F.col("text").alias(f"text_{k}"), F.col("f").alias(k)), f"text_{k}").hint("merge")
    # no side is sent whole to the driver and every executor: features repeat, so files of very many are small
    different = _dealt(_dealt(pairs.select("text_a", "text_b").distinct(), "text_a").join(side(texts_a, "a"), "text_a"), "text_b").join(side(texts_b, "b"), "text_b")
    if scores:
        # explode computes the score once, for itself and what is told of it
        different = different.select("text_a", "text_b", "a", "b", F.explode(F.array(scored_of("a", "b"))).alias("s"))
    known = stored(different.select("text_a", "text_b", *["s"] * scores, *[c.alias(name) for name, c in told.items()]), "scores")
    rows = pairs.join(known.hint("merge"), ["text_a", "text_b"])
    return rows.withColumn("score", F.col("s.score")) if scores else rows


def best(rows: DataFrame, least: float, ratio: Column | float, top: int) -> DataFrame:
    """The `top` best candidates of each reference: rows (reference, candidate, price_a, price_b, position, score) with their place. Prices must be
    compatible and the score `least` at least; ties go to the earlier position."""
    place = F.row_number().over(Window.partitionBy("reference").orderBy(F.desc("score"), "position"))
    kept = rows.where(n.prices_compatible(F.col("price_a"), F.col("price_b"), ratio) & (F.col("score") >= least))
    return kept.withColumn("place", place.cast("bigint")).where(F.col("place") <= top)


def ranked(pairs: DataFrame, least: float, ratio: Column | float, top: int) -> DataFrame:
    """best() of pairs (a, b), scored here."""
    return best(with_scores(pairs.where(n.prices_compatible(F.col("price_a"), F.col("price_b"), ratio))), least, ratio, top)


#: Rows of a side that meet in one task, of each key.
TILE = 512


def model_keys(model: Column) -> Column:
    """Texts of which two models that models_compatible() accepts share one: the tier of their line, and every part that is at least 0.85 of a name."""
    k = compact(model)
    size = F.length(k)
    shortest = F.ceil(size * 0.85 - 1e-9).cast("int")
    parts = F.flatten(F.transform(F.sequence(shortest, size), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: k.substr(i, n))))
    lines = F.array(
        F.when(k.contains("airpods"), "line:airpods"), F.when(k.contains("macbook"), F.concat(F.lit("line:macbook:"), tier(k, *LAPTOP_TIERS))), F.when(k.contains("canvas"), "line:canvas"),
        F.when(k.contains("ipad"), F.concat(F.lit("line:ipad:"), tier(k, *TABLET_TIERS))), F.when(k.contains("iphone"), F.concat(F.lit("line:iphone:"), tier(k, *PHONE_TIERS))), F.when(k.rlike(r"wh1000xm\d"), "line:wh1000xm"),
    )
    return F.when(k == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(F.filter(lines, lambda x: x.isNotNull()), parts)))


def block_keys(f: Column, price: Column, steps: tuple[int, ...]) -> Column:
    """Hashes of which two titles share one if no gate on category, maker and model parts them and their prices are compatible. Each says which of maker, model and price
    either side knows, and holds those that both know; prices lie in steps of their category's ratio: one side names its step, the other the steps around its own."""
    category, model = f["category"], compact(f["e"]["model"]["model"])
    priced, named, branded = F.coalesce(price, F.lit(0.0)) > 0, (model != "") & ~category.isin(*SOFT_MODEL), f["brand"].isNotNull()
    step = F.floor(F.ln(F.when(priced & (price < float("inf")), price)) / (F.ln(n.price_ratio_for(category)) * 1.0001))
    buds = F.when(f["line"]["lineage"].startswith("buds:"), F.concat_ws(":", F.lit("line:buds"), f["line"]["gen"]))
    models = F.array_distinct(F.concat(model_keys(f["e"]["model"]["model"]), F.filter(F.array(buds), lambda x: x.isNotNull())))
    hashed = lambda head, texts, around: F.flatten(F.transform(texts, lambda m: F.transform(around, lambda s: F.xxhash64(head, m, s))))
    out = []
    for mode in range(8):  # what the other side knows
        other = [F.lit(bool(mode >> i & 1)) for i in range(3)]
        both = [mine & theirs for mine, theirs in zip((branded, named, priced), other, strict=True)]
        # each pair of bits is written in an order that both sides agree on: reference first
        sides = [F.concat(*[F.when(x, "1").otherwise("0") for x in pair]) for pair in (zip((branded, named, priced), other, strict=True) if len(steps) > 1 else zip(other, (branded, named, priced), strict=True))]
        head = F.concat_ws("|", category, *sides, F.when(both[0], family_of(f["brand"])).otherwise(""))
        around = F.when(both[2], F.array(*[step + s for s in steps])).otherwise(F.array(F.lit(0).cast("bigint")))
        texts = F.when(both[1], models).otherwise(F.array(F.lit("")))
        out.append(hashed(head, texts, around))
    return F.array_distinct(F.flatten(F.array(*out)))


def _met(references: DataFrame, offers: DataFrame, size: int) -> DataFrame:
    """Pairs of rows of both sides that share a key of block_keys(), once each. Of keys on both sides each row goes to tiles of about `size` rows of either side, so no key's rows
    meet in one task; a pair that shares several keys meets at the smallest."""
    sides = []
    for rows, name, f, price, steps in ((references, "reference", "a", "price_a", (-1, 0, 1)), (offers, "candidate", "b", "price_b", (0,))):
        kept = stored(rows.select(name, f, price, block_keys(F.col(f), F.col(price), steps).alias(f"keys_{f}")), "blocks")
        sides.append((kept, name, f, kept.select(name, F.explode(f"keys_{f}").alias("key"))))
    counts = [light.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / size).alias(f"tiles_{f}")) for _, _, f, light in sides]
    shared = stored(counts[0].join(counts[1].hint("merge"), "key"), "block-sizes")
    dealt = []
    for (kept, name, f, light), other in zip(sides, ("b", "a"), strict=True):
        own = F.pmod(F.xxhash64(name, F.lit(7)), F.col(f"tiles_{f}")).alias(f"tile_{f}")
        tiles = light.join(shared.hint("merge"), "key").select(name, "key", own, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"tiles_{other}") - 1)).alias(f"tile_{other}"))
        dealt.append(tiles.join(kept.hint("merge"), name))
    at_first = F.array_min(F.array_intersect("keys_a", "keys_b")) == F.col("key")
    return dealt[0].join(dealt[1].hint("merge"), ["key", "tile_a", "tile_b"]).where(at_first)


def blocked(references: DataFrame, offers: DataFrame, size: int = TILE) -> DataFrame:
    """Pairs of references (reference, a, price_a) and offers (candidate, b, price_b) that no gate on category, maker and model parts and whose prices are compatible; no other
    pair scores more than CAP_GENERIC. position orders ties."""
    near = n.prices_compatible(F.col("price_a"), F.col("price_b"), n.price_ratio_for(F.col("a.category")))
    pairs = _met(references, offers, size).where((F.col("reference") != F.col("candidate")) & near)
    return pairs.select("reference", "candidate", "a", "b", "price_a", "price_b", F.col("candidate").alias("position"))


#: A category's price ratio is cut into PARTS steps: prices of steps up to SURELY apart are compatible, those up to PERHAPS apart may be; steps of prices that are no numbers, and of unknown ones.
PARTS, SURELY, PERHAPS, NO_NUMBER, UNKNOWN = 4, 2, 4, 1 << 40, 1 << 41


def price_step(category: Column, price: Column) -> Column:
    step = F.floor(F.ln(price) / (F.ln(n.price_ratio_for(category)) * 1.0001) * PARTS)
    return F.when(F.coalesce(price, F.lit(0.0)) > 0, F.when(price < float("inf"), step).otherwise(NO_NUMBER)).otherwise(UNKNOWN).cast("bigint")


def _first(rows: DataFrame, by: list[str], most: int, *order: Column | str) -> DataFrame:
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("turn") <= most)


def core_pairs(a: DataFrame, b: DataFrame, cores: DataFrame, least: float) -> DataFrame:
    """core_a, core_b with their terms p, low and high, of cores (core, c) of rows a and b (core, step, price) that may score `least`. They meet by block_keys() of each core and
    whole price step, and each pair of cores is told once."""

    def classes(rows: DataFrame, name: str, f: str) -> DataFrame:
        kinds = rows.groupBy("core", F.expr(f"step div {PARTS}").alias("whole")).agg(F.min("price").alias(f"price_{f}"))
        return _dealt(kinds, "core").join(_dealt(cores, "core").hint("merge"), "core").select(F.struct("core", "whole").alias(name), F.col("c").alias(f), f"price_{f}")

    met = _met(classes(a, "reference", "a"), classes(b, "candidate", "b"), TILE).select(F.col("reference.core").alias("core_a"), F.col("candidate.core").alias("core_b")).distinct()
    side = lambda k: _dealt(cores.select(F.col("core").alias(f"core_{k}"), F.col("c").alias(k)), f"core_{k}").hint("merge")
    # explode computes the terms once, for the filter and the columns
    told = _dealt(_dealt(met, "core_a").join(side("a"), "core_a"), "core_b").join(side("b"), "core_b").select("core_a", "core_b", F.explode(F.array(terms(F.col("a"), F.col("b")))).alias("s"))
    return stored(told.where(F.col("s.high") >= least).select("core_a", "core_b", "s.*"), "core-pairs")


def text_pairs(met: DataFrame, a: DataFrame, b: DataFrame, wordings: DataFrame, size: int = TILE) -> DataFrame:
    """text_a, text_b and their score, of the texts of rows a and b (core, text) whose cores are met (core_a, core_b, p, floor), where it is `floor` at least. A core's texts are
    dealt to tiles of about `size`, so no two cores' texts meet in one task."""
    pairs = met
    for rows, k in ((a, "a"), (b, "b")):
        own = rows.select(F.col("core").alias(f"core_{k}"), F.col("text").alias(f"text_{k}")).distinct()
        tiles = own.groupBy(f"core_{k}").agg(F.ceil(F.count(F.lit(1)) / size).alias("tiles"))
        pairs = pairs.join(tiles.hint("merge"), f"core_{k}").withColumn(f"tile_{k}", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1))).drop("tiles")
        dealt = own.join(tiles.hint("merge"), f"core_{k}").withColumn(f"tile_{k}", F.pmod(F.xxhash64(f"text_{k}"), F.col("tiles"))).drop("tiles")
        worded = dealt.join(wordings.select(F.col("text").alias(f"text_{k}"), F.col("w").alias(k)).hint("merge"), f"text_{k}")
        b_side = F.sort_array(F.collect_list(F.struct(f"text_{k}", k))).alias(f"tile_of_{k}")
        pairs = pairs.join(worded.groupBy(f"core_{k}", f"tile_{k}").agg(b_side).hint("merge"), [f"core_{k}", f"tile_{k}"])
    each = spread(pairs.select("p", "floor", "tile_of_a", "tile_of_b")).select("p", "floor", F.explode("tile_of_a").alias("x"), "tile_of_b").select("p", "floor", "x", F.explode("tile_of_b").alias("y"))
    score = F.explode(F.array(_total(F.col("p"), alike(F.col("x.a"), F.col("y.b"))))).alias("score")
    return each.select("x.text_a", "y.text_b", "floor", score).where(F.col("score") >= F.col("floor")).drop("floor")


def entities_of_texts(references: DataFrame, offers: DataFrame, texts: DataFrame, least: float = LEAST / 100, top: int = 3) -> DataFrame:
    """entities() of references (reference, price, text) and offers (candidate, price, text), whose features are f of texts (text, f).

    Titles of one core (core_of) differ in their scores only by their wording, whose part is bounded: so pairs of cores are told, not of offers. The references of a core and price step can only
    be matched by cores whose highest score reaches what their best `top` offers have at least; wordings are compared for those of them where they count. Of offers that one score and one step
    put on a par the first by number count, and offers whose prices may be too far off are looked at one by one only where they would come before those.
    """
    if least <= CAP_GENERIC:
        raise ValueError("pairs of one generic title are not looked for, and score up to CAP_GENERIC")
    most = top + 1  # one more, for a reference isn't its own offer
    known = stored(texts.select("text", core_of(F.col("f")).alias("c"), F.struct(*[F.col("f")[k].alias(k) for k in ("title", "tokens", "words")]).alias("w")), "wordings")
    cores = stored(known.select("c").distinct().withColumn("core", F.monotonically_increasing_id()), "cores")
    of_text = stored(known.select("text", "c").join(cores.hint("merge"), "c").select("text", "core", F.col("c.category").alias("category")), "text-cores")
    sides = [stored(rows.join(of_text.hint("merge"), "text").withColumn("step", price_step(F.col("category"), F.col("price"))).drop("category"), "sides") for rows in (references, offers)]
    a, b = (rows.withColumnsRenamed({c: f"{c}_{k}" for c in ("price", "text", "core", "step")}) for rows, k in zip(sides, "ab", strict=True))
    pairs = core_pairs(*sides, cores, least)

    apart, counted = F.abs(F.col("step_a") - F.col("step_b")), (F.col("step_a") < NO_NUMBER) & (F.col("step_b") < NO_NUMBER)
    surely = (F.col("step_a") == UNKNOWN) | (F.col("step_b") == UNKNOWN) | (counted & (apart <= SURELY))
    met = pairs.drop("p").join(a.select("core_a", "step_a").distinct().hint("merge"), "core_a").join(b.groupBy("core_b", "step_b").agg(F.least(F.count(F.lit(1)), F.lit(most)).alias("n")).hint("merge"), "core_b")
    met = met.where(surely | (counted & (apart <= PERHAPS))).withColumn("surely", surely)
    group = Window.partitionBy("core_a", "step_a")
    so_far = F.sum(F.when(F.col("surely"), F.col("n"))).over(group.orderBy(F.desc("low")).rowsBetween(Window.unboundedPreceding, 0))
    floor = F.coalesce(F.max(F.when(F.col("so_far") >= most, F.col("low"))).over(group), F.lit(0.0))
    kept = stored(met.withColumn("so_far", so_far).withColumn("floor", F.greatest(floor, F.lit(least))).where("high >= floor").select("core_a", "step_a", "core_b", "step_b", "surely", "low", "high", "floor"), "kept")
    even, offer = kept.where("low = high").withColumn("score", F.col("low")), ["candidate", "price_b"]
    at = ["core_a", "step_a"]
    firsts = _first(b, ["core_b", "step_b"], most, "candidate").select("core_b", "step_b", *offer)
    by_core = stored(_first(even.where("surely").join(firsts.hint("merge"), ["core_b", "step_b"]), at, most, F.desc("score"), "candidate").select(*at, *offer, "score", "turn"), "by-core")
    last = by_core.where(F.col("turn") == most).select(*at, F.col("score").alias("last_score"), F.col("candidate").alias("last"))
    better = F.col("last").isNull() | (F.col("score") > F.col("last_score")) | ((F.col("score") == F.col("last_score")) & (F.col("candidate") < F.col("last")))
    by_core_perhaps = even.where("NOT surely").join(b.hint("merge"), ["core_b", "step_b"]).join(last.hint("merge"), at, "left").where(better).select(*at, *offer, "score")

    uneven = kept.where("low < high").groupBy("core_a", "core_b").agg(F.min("floor").alias("floor")).join(pairs.select("core_a", "core_b", "p").hint("merge"), ["core_a", "core_b"])
    told = stored(text_pairs(uneven, *sides, known.select("text", "w")), "text-pairs")
    of = ["text_a", "step_a"]
    ways = told.join(a.select("text_a", "core_a", "step_a").distinct().hint("merge"), "text_a")
    first_texts = _first(b, ["text_b", "step_b"], most, "candidate").select("text_b", "step_b", *offer)
    by_text = _first(ways.join(first_texts.hint("merge"), "text_b").where(surely), of, most, F.desc("score"), "candidate").select(*of, *offer, "score")
    by_text_perhaps = ways.join(b.select("text_b", "step_b", *offer).hint("merge"), "text_b").where(~surely & counted & (apart <= PERHAPS)).join(last.hint("merge"), at, "left").where(better).select(*of, *offer, "score")

    rows = a.join(of_text.select(F.col("text").alias("text_a"), "category").hint("merge"), "text_a")
    found = rows.join(by_core.drop("turn").unionByName(by_core_perhaps).hint("merge"), at).select("reference", "price_a", "category", *offer, "score")
    found = found.unionByName(rows.join(by_text.unionByName(by_text_perhaps).hint("merge"), of).select("reference", "price_a", "category", *offer, "score"))
    near = n.prices_compatible(F.col("price_a"), F.col("price_b"), n.price_ratio_for(F.col("category")))
    return _first(found.where(near & (F.col("reference") != F.col("candidate"))), ["reference"], top, F.desc("score"), "candidate").select("reference", "candidate", "score", F.col("turn").cast("bigint").alias("place"))


def entities(references: DataFrame, offers: DataFrame, least: float = LEAST / 100, top: int = 3) -> DataFrame:
    """reference, candidate, score and place of the `top` best offers (candidate, b, price_b) of each reference (reference, a, price_a), of all that score `least` at least (above CAP_GENERIC); ties
    go to the smaller candidate."""
    texts = stored(references.select(F.col("a").alias("f")).union(offers.select(F.col("b").alias("f"))).distinct().withColumn("text", F.monotonically_increasing_id()), "texts")
    side = lambda rows, name, k: rows.join(texts.hint("merge"), F.col(k).eqNullSafe(F.col("f"))).select(name, F.col(f"price_{k}").alias("price"), "text")
    return entities_of_texts(side(references, "reference", "a"), side(offers, "candidate", "b"), texts, least, top)
