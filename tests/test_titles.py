"""Golden rows of title rules, match scores, price texts, reuse decisions and offers on their way."""

from functools import partial

import pytest
from pyspark.sql import functions as F

from pricewright.functions import identity as ident
from pricewright.functions import links as lk
from pricewright.functions import price_text as pt
from pricewright.functions import reviews as rv
from pricewright.functions import search as se
from pricewright.functions import text as t
from pricewright.functions import titles as ti
from pricewright.operators import match_score as ms
from pricewright.operators import offer_flow as of
from pricewright.operators import reuse as ru
from pricewright.sources import relations as r


def values(spark, rule, texts):
    """rule of each text, in order."""
    rows = spark.createDataFrame(list(enumerate(texts)), "i bigint, x string").select("i", rule(F.col("x")).alias("v"))
    return [r["v"] for r in rows.orderBy("i").collect()]


def test_attributes(spark):
    assert values(spark, ti.connector_of, ["Наушники Type-C", "кабель Lightning", "Jack 3,5", "USB A", "нет"]) == ["usb-c", "lightning", "3.5mm", "usb-a", None]
    assert values(spark, ti.condition_of, ["refurbished", "CPO iPhone", "б/у", "новый", "x"]) == ["refurbished", "cpo", "used", "new", None]
    assert values(spark, ti.authenticity_of, ["Оригинальный", "OEM", "муляж телефона", "аналог", "реплика", "x"]) == ["original", "oem", "replica", "analog", "replica", None]
    assert values(spark, ti.region_of, ["Global", "Ростест", "eSIM only", "nano-SIM", "x"]) == ["global", "ru", "esim_only", "sim_physical", None]
    assert values(spark, ti.edition_of, ["PS5 Digital Edition", "PS5 disc", "Canon kit", "body"]) == ["digital", "disc", "kit", "body"]
    assert values(spark, ti.scent_of, ["Ментол", "Citrus", "алое", "x"]) == ["menthol", "citrus", "aloe", None]
    assert values(spark, ti.material_of, ["из хлопка хлопок", "экокожа", "x"]) == ["cotton", "leather", None]
    assert values(spark, ti.weight_g, ["2 kg", "1,5kg", "500g", "x"]) == [2000, 1500, 500, None]
    assert values(spark, ti.size_of, ["размер 42,5", "Футболка, XL", "size m", "45 x", "x"]) == ["42.5", "XL", "M", "45", None]
    assert values(spark, ti.color_of, ["Чёрный", "Midnight", "space  black", "Redmi", "x"]) == ["black", "black", "black", "red", None]


def test_categories_and_lines(spark):
    assert values(spark, ti.category_of, [
        "Чехол для iPhone 15", "Смартфон Samsung", "Ноутбук ASUS", "Видеокарта RTX 4070", "Игровая приставка PlayStation 5", "Аккумулятор для Nikon D5100", "Зеркальный фотоаппарат Canon EOS 650D", "Корм для кошек", "Кондиционер для белья", "Кондиционер LG", "что-то",
    ]) == ["accessories", "smartphones", "laptops", "gpus", "consoles", "accessories", "cameras", "pet_food", "detergents", "appliances", "generic"]
    got = values(spark, ti.lineage_of, ["Redmi Buds 5", "Galaxy Buds 2", "AirPods 3", "iPhone 15 Pro Max", "Google Pixel 9a", "Sony WH-1000XM5", "Kingston Canvas Go! Plus microSD Gen4", "Canvas Select", "Dyson Supersonic HD07", "GSB 18V-50", "Робот-пылесос Roborock S8 Ultra", "x"])
    assert [None if v is None else tuple(v) for v in got] == [
        ("buds:redmi", 5, None), ("buds:galaxy", 2, None), ("airpods", 3, None), ("iphone", 15, "15promax"), ("pixel", 9, "9a"), ("sony_wh1000xm", 5, "xm5"), ("flash:go_plus", 4, "4"), ("flash:select", 0, "0"), ("dyson:supersonic", 7, "hd07"),
        ("tool:gsb", 18, "gsb18v-50"), ("robot:model", 8, "s8ultra"), None,
    ]


def test_entities(spark):
    got = values(spark, ti.entity_of, ["Геймпад Sony DualSense для PlayStation 5", "Игровая приставка Sony PlayStation 5 + DualSense", "Картридж HP 12A для LaserJet 1020", "Капсулы для кофемашины Nespresso Lungo", "Смартфон Apple iPhone 15", "", None])
    assert [(e["role"], e["family"], e["entity"], e["confidence"]) for e in got] == [
        ("accessory", "console", "контроллер DualSense", 0.85), ("primary", "console", "PlayStation 5", 0.7), ("consumable", "printer", "картридж HP 12A", 0.75), ("supply", "coffee", "капсулы Nespresso", 0.85), ("primary", "phone", "iPhone 15", 0.7),
        ("primary", None, "", 0.0), ("primary", None, "", 0.0),
    ]


PAIRS = [
    ("Смартфон Apple iPhone 15 Pro Max 256GB чёрный", "Apple iPhone 15 Pro Max 256 ГБ Black", None, (0.9, 1)), ("Смартфон Apple iPhone 15 128GB", "Apple iPhone 14 128GB", "lineage_generation", (0, 0)),
    ("Геймпад Sony DualSense для PlayStation 5", "Игровая приставка Sony PlayStation 5", "category", (0, 0)), ("Смартфон Apple iPhone 15 128GB", "Чехол для iPhone 15", "category", (0, 0)),
    ("Samsung Galaxy S24", "Soft case Galaxy S24", "category", (0, 0)), ("Смартфон Apple iPhone 15 128GB", "Смартфон Apple iPhone 15 256GB", "storage", (0, 0)), ("Наушники Redmi Buds 5", "Наушники Redmi Buds 6", "lineage_generation", (0, 0)),
    ("Ноутбук ASUS VivoBook X1504VA 16/512", "Ноутбук ASUS VivoBook X1504VA 16/512 ГБ", None, (0.9, 1)), ("Смартфон Xiaomi Redmi Note 13 8/256", "Смартфон Samsung Galaxy A55 8/256", "brand", (0, 0)),
    ("Смартфон Xiaomi 13 8/256", "Смартфон POCO F5 8/256", "model", (0, 0)), ("Шампунь Head & Shoulders Ментол 400 мл", "Шампунь Head & Shoulders Цитрус 400 мл", "scent", (0, 0)), ("MacBook Air M2", "MacBook Pro M2", "model", (0, 0)),
    ("Kingston Canvas Go Plus 128GB microSD", "Kingston Canvas Select Plus 128GB microSD", "lineage_generation", (0, 0)), ("Смартфон Apple iPhone 15 128GB", "Смартфон Apple iPhone 15 128GB муляж", "replica", (0, 0)),
    ("Смартфон Apple iPhone 15 128GB refurbished", "Смартфон Apple iPhone 15 128GB новый", "condition", (0, 0)), ("Гель для стирки Persil 12 шт", "Гель для стирки Persil 24 шт", "package_count", (0, 0)),
    ("Телевизор Haier 55 Smart TV S1", "Телевизор Haier 55 Smart TV S2", None, (0.55, 1)), ("", "x", "empty_title", (0, 0)), (None, None, "empty_title", (0, 0)),
]


def test_match_scores(spark):
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, *_) in enumerate(PAIRS)], "i bigint, x string, y string").select("i", ti.features_of("x").alias("a"), ti.features_of("y").alias("b"))
    s, a, b = F.col("s"), F.col("a"), F.col("b")
    got = ms.with_scores(rows).select("i", "s", ms.diagnosis(s, a, b).alias("d"), ms.warn_kind(s, a, b, F.lit(90)).alias("warn"), ms.word_overlap(a, b).alias("words"), t.word_overlap(F.col("a.title"), F.col("b.title")).alias("again")).orderBy("i").collect()
    for r, (x, y, gate, (low, high)) in zip(got, PAIRS, strict=True):
        assert r["s"]["gate"] == gate, (x, y)
        assert low <= r["s"]["score"] <= high, (x, y, r["s"]["score"])
        assert (r["d"]["reason"] == "auto_pick_eligible") == (r["s"]["score"] >= 0.695)
        assert r["words"] == r["again"] or not x
    assert got[1]["d"]["reason"] == "lineage_mismatch" and got[8]["d"]["reject"] == "brand" and got[2]["warn"] == "category" and got[0]["warn"] is None


def test_models_compatible(spark):
    cases = [("AirPods Max", "AirPods Pro", False), ("AirPods", "Apple AirPods", True), ("iPhone 15", "iPhone 15 Pro", False), ("iPhone 15 Pro", "iphone 15 pro", True), ("WH-1000XM5", "WH 1000XM5", False), ("wh1000xm5", "sony wh1000xm6", False), ("iPad Pro 11", "iPad Air 11", False), ("ABC-1234", "ABC-1234X", True), ("ABC-1234", "ABC-1234 and more", False), ("", "x", True)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i bigint, a string, b string, want boolean")
    got = rows.select("i", "want", ms.models_compatible(F.col("a"), F.col("b")).alias("v")).orderBy("i").collect()
    assert [r["v"] for r in got] == [c[2] for c in cases]


def test_price_blocks(spark):
    as_tuples = lambda rows: [None if v is None else tuple(v) for v in rows]
    assert values(spark, pt.listing_prices, ["1 234 ₽ и 99 руб.", "500 ₽/шт 3 000 ₽", "10 ₽", "нет"]) == [[1234, 99], [3000], [], []]
    assert as_tuples(values(spark, pt.ozon_block, ["12 990 ₽", "12 000 ₽ с банками 12 500 ₽ 15 000 ₽ −20%", "1000 ₽ 1050 ₽", "-30% 700 ₽ 1000 ₽", "нет"])) == [(12990, 12990, None, None), (12500, 12500, 12000, 15000), (1050, 1050, 1000, None), (700, 700, None, 1000), None]
    assert as_tuples(values(spark, pt.yandex_block, ["Пэй 900 ₽ 1000 ₽", "900 ₽ 1200 ₽", "900 ₽ 950 ₽ 1300 ₽"])) == [(1000, 1000, 900, None), (1200, 1200, 900, None), (950, 950, 900, 1300)]
    numbers = lambda rule, *rows: [r["v"] for r in spark.createDataFrame([(i, list(x)) for i, x in enumerate(rows)], "i bigint, x array<bigint>").select("i", rule(F.col("x")).alias("v")).orderBy("i").collect()]
    assert numbers(pt.without_unit_prices, (100, 300, 310), (100, 205, 1000, 2100), (1000, 1050, 1500), (5, 10), ()) == [[300, 310], [1000, 2100], [1000, 1050, 1500], [5, 10], []]
    assert as_tuples(numbers(pt.ozon_numbers, (1000,), (1000, 1050), (1000, 1060, 1500), (1000, 2000), ())) == [(1000, 1000, None, None), (1050, 1050, 1000, None), (1060, 1060, 1000, 1500), (1000, 1000, None, 2000), None]
    assert numbers(pt.without_shipping, (637, 1999), (280, 16489, 17000), (300, 500), ()) == [[1999], [16489, 17000], [300, 500], []]


def test_review_rules(spark):
    assert values(spark, rv.said_rating, ["Оценка: 4.5", "3/5", "5 звезд", "⭐⭐⭐⭐", "⭐", "нет"]) == [4.5, 3, 5, 4, 1, None]
    assert [tuple(v) for v in values(spark, rv.rating_and_count, ["4,8 из 5 · 1 200 отзывов", "Рейтинг: 4.5", "x"])] == [(4.8, 1200), (4.5, None), (None, None)]
    texts = [("a", "отличное качество, рекомендую", None), ("a", "хорошее качество", None), ("a", "качество ужас, брак", 1.0), ("b", "доставка нормальная", None)]
    got = {r["k"]: r for r in rv.analysis(spark.createDataFrame(texts, "k string, text string, stars double"), ["k"]).collect()}
    # 'качеств' praises wherever it stands: the third text has as much praise as complaint and counts for neither side
    assert got["a"]["pros"] == ["Хвалят качество"] and got["a"]["cons"] == ["Встречаются брак и поломки"] and got["a"]["rating"] == 3.3
    assert got["b"]["reviews"] == 1 and got["b"]["risk"] == "medium" and got["b"]["pros"] == [] and got["b"]["verdict"] == "not_recommended"


def test_reuse(spark):
    part = "brand string, model string, storage string, color string, category string"
    cases = [
        (("apple", "iPhone 15", "128gb", "black", "smartphones"), ("apple", "iPhone 15", "128gb", "black", "smartphones"), 100, False), (("apple", "iPhone 15", "128gb", None, "smartphones"), ("apple", "iPhone 15", "256gb", None, "smartphones"), 55, False),
        (("apple", "iPhone 15", None, None, "smartphones"), ("samsung", "Galaxy", None, None, "smartphones"), 20, True), ((None,) * 5, (None,) * 5, 50, False), (("apple", None, None, None, "laptops"), ("apple", None, None, None, "smartphones"), 20, True),
    ]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, *_) in enumerate(cases)], f"i bigint, a struct<{part.replace(' ', ':').replace(',:', ',')}>, b struct<{part.replace(' ', ':').replace(',:', ',')}>")
    none = F.lit(None).cast("string")
    got = rows.select("i", ru.confidence(F.col("a"), F.col("b"), none, none).alias("c")).orderBy("i").collect()
    assert [tuple(r["c"]) for r in got] == [c[2:] for c in cases]


def test_identity(spark):
    line = F.lit(None).cast("struct<lineage:string,gen:int,gen_key:string>")
    assert values(spark, lambda x: ident.offer_fingerprint(x, F.lit("12345"), line), ["Смартфон Apple iPhone"]) == ["12345|смартфонappleiphone"]
    bar = lambda mine, *theirs: spark.range(1).select(ident.identity_excluded(F.lit(mine), F.array(*map(F.lit, theirs))).alias("v")).first()["v"]
    assert bar("12345|x", "12345|y") and bar("1|iphone|15|a", "2|iphone|15|b") and not bar("1234|x", "1234|y") and not bar("a|b", "c|d") and bar("q", "q")
    assert values(spark, lambda x: ident.search_gate(F.lit("lamoda"), x), ["laptops", "shoes"]) == ["fashion_only", None]
    assert values(spark, ident.memory_of, ["iPhone 128GB", "1 ТБ", "x"]) == ["128gb", "1tb", ""]


def test_links_and_search(spark):
    urls = ["https://www.wildberries.ru/catalog/123/detail.aspx?x", "https://aliexpress.com/item/1005001234567890.html?a=1", "https://mvideo.ru/products/tv-12345678", "https://example.com/ozon.ru/product/x-12345", None]
    assert values(spark, lk.store_of, urls) == ["wildberries", "aliexpress", "mvideo", None, None]
    assert values(spark, lk.canonical_url, urls[:3]) == ["https://www.wildberries.ru/catalog/123/detail.aspx", "https://aliexpress.ru/item/1005001234567890.html", "https://www.mvideo.ru/products/tv-12345678"]
    assert values(spark, lk.truncated, ["a" * 100, " b ", ""]) == ["a" * 79 + "…", "b", None]
    texts = ["red shoes for men", "blue shoes", "red hat", ""]
    for asked, want in {"red shoes": [1, 0, 0, 0], '"shoes for"': [1, 0, 0, 0], "shoes OR hat": [1, 1, 1, 0], "shoes -red": [0, 1, 0, 0], "red blue OR hat": [0, 0, 1, 0]}.items():
        assert values(spark, partial(se.matches, query=asked), texts) == [bool(w) for w in want], asked


def test_folded_offers(spark):
    rows = [(1, 1, 100.0, "verified", 4.0, "u1"), (1, 2, None, "probable", 9.0, "u2"), (1, 3, None, "oos", None, None), (2, 1, 50.0, "verified", None, "v"), (2, 2, 60.0, "verified", 3.0, "w"), (3, 1, 10.0, "oos", None, None), (3, 2, 11.0, "serp_only", None, "z")]
    got = of.folded(spark.createDataFrame(rows, "slot bigint, at bigint, price double, status string, rating double, url string"), ["slot"], ["at"]).orderBy("slot").collect()
    assert [tuple(r) for r in got] == [(1, None, None, "oos", 4.0), (2, 60.0, "w", "verified", 3.0), (3, 11.0, "z", "serp_only", None)]


@pytest.mark.parametrize("text, clean, promo", [("iPhone 15 | Ozon", "iPhone 15", False), ("Часы купить в Москве", "Часы", False), ("Осталось 3 шт", "Осталось 3 шт", True), ("Смартфон Xiaomi распродажа", "Смартфон Xiaomi распродажа", False), ("", "", True)])
def test_titles_of_stores(spark, text, clean, promo):
    assert values(spark, t.clean_title, [text]) == [clean] and values(spark, t.promo_title, [text]) == [promo]


def test_texts_are_read_once_for_all_rows(spark):
    """Rows of equal texts share what is computed of them, nulls too, and no rows are lost."""
    rows = spark.createDataFrame([(1, "Чехол a", None), (2, "Чехол a", None), (3, None, "x"), (4, None, None), (5, "Чехол a", "x"), (6, None, None)], "id int, title string, specs string")
    got = {r["id"]: (r["c"], r["n"]) for r in ti.with_told(rows, ["title", "specs"], c=ti.category_of(F.col("title")), n=F.length("specs")).collect()}
    assert got == {1: ("accessories", None), 2: ("accessories", None), 3: ("generic", 1), 4: ("generic", None), 5: ("accessories", 1), 6: ("generic", None)}


def test_hosts_may_hold_any_characters(spark):
    """A host that ends a quoted pattern is taken out of its title as any other text."""
    row = spark.range(1).select(F.lit(r"Чехол для a\Eb iPhone 15").alias("t")).select(ti.entity_of(F.col("t")).alias("e")).first()
    assert row["e"]["role"] == "accessory" and r"a\Eb" in row["e"]["host"] and r"\E" not in row["e"]["entity"]


def test_categories_take_long_titles(spark):
    """Barred words are looked for from a word of the category on only: 40000 characters are read once, not once for each start."""
    import time

    start = time.time()
    rows = spark.createDataFrame([("x" * 40_000,), ("держатель " + "x" * 40_000 + " смартфон",), ("смартфон " + "x" * 40_000 + " держатель",)], "t string")
    assert [r[0] for r in rows.select(ti.category_of(F.col("t"))).collect()] == ["generic", "smartphones", "accessories"]
    assert time.time() - start < 20


def test_rules_search_only_texts_that_have_their_words(spark):
    """What a pattern needs is found in every text that it matches, in any case and with letters that fold to others; borders know no folded ranges."""
    assert ti.needed(r"\b(?:redmi|xiaomi)\s+buds\s*\d{1,2}\b") == {"xiaomi", "redmi"} and ti.needed(r"(?=телефон|\bphone\b)(?!.*для)") == {"телефон", "phone"}
    assert not ti.needed(r"\b[a-z]{1,4}-\d+\b|pro") and not ti.needed(r"(?:case)?\s*\d") and "[A-Za-z0-9_]" not in ti.rx(r"\bcase\b")
    texts = ["ЧЕХОЛ для IPHONE 15", "ıPhone 15 ſmartphone", "Kingston CANVAS Go microSD", "_case", "case", "Фотоаппарат Canon EOS 650D", "ноутбук", "Кабель USB-C", "", "ᲀидеокарта RTX 4070", "шоколад цвета", "для кошек"]
    patterns = [p for _, p in [*ti.CATEGORIES, *ti.MARKS.items(), *((n, p) for n, p in enumerate([*ti.MODELS, *ti.BODIES])), *((f, p) for f, p, _ in ti.HOSTS), *((f, p) for f, _, p in ti.ROLES)]]
    x = F.col("x")
    missed = spark.createDataFrame([(v,) for v in texts], "x string").select(*[F.sum((x.rlike(ti.rx(p)) & ~ti.may_have(ti.folded(x), p)).cast("int")).alias(str(i)) for i, p in enumerate(patterns)]).first()
    assert not any(missed)


def test_features_that_are_asked_for(spark, sf_dir):
    """F15, F16: fingerprints ask for the features that they are made of, and get those that all features hold."""
    rows = r.listings(spark, sf_dir)
    some = rows.select("product", ti.features_of("title", "specs", ident.OF_FINGERPRINTS).alias("some"), ti.features_of("title", "specs").alias("all")).collect()
    assert set(some[0]["some"].asDict()) == set(ident.OF_FINGERPRINTS)
    assert [row["some"].asDict() for row in some] == [{k: row["all"][k] for k in row["some"].asDict()} for row in some]


def test_entities_where_specs_alone_say_the_host(spark):
    rows = [("Насадка универсальная", "для Dyson V15"), (None, "Чехол для iPhone 15"), ("Case ıphone", None), ("", "")]
    told = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "i bigint, title string, specs string").select("i", ti.entity_of(F.col("title"), F.col("specs")).alias("e")).orderBy("i").collect()
    assert [(row["e"]["role"], row["e"]["family"], row["e"]["host"], row["e"]["noun"]) for row in told] == [
        ("primary", "vacuum", "Dyson V15", None), ("accessory", "phone", "iPhone 15", "чехол"), ("accessory", "phone", None, "чехол"), ("primary", None, None, None),
    ]
