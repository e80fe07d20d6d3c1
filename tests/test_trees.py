"""JSON trees of unknown depth: structured data, reviews, redaction, widget states; and the index of texts."""

import json

import pytest
from pyspark.sql import functions as F

from pricewright.functions import search as se
from pricewright.operators import text_index
from pricewright.sources import extract, search_pages, trees


def test_products_only_where_they_may_be(spark):
    product = lambda n: {"@type": "Product", "name": n, "offers": [{"price": "1 200,50"}]}
    pages = {
        1: [json.dumps(product("a"))], 2: [json.dumps({"@graph": [{"@type": "WebPage"}, [product("b")], {"@graph": product("c")}]})], 3: [json.dumps({"mainEntity": product("no")})], 4: ["{bad", json.dumps([[{"@type": ["Thing", "Product"], "offers": {"lowPrice": 5}}]])],
        5: [json.dumps(product("d") | {"@graph": [product("e")]})], 6: [json.dumps("text"), "null", ""], 7: None, 8: [json.dumps({"@type": ["Thing"], "name": "no"})],
    }
    rows = spark.createDataFrame(list(pages.items()), "page_id bigint, scripts array<string>")
    got = trees.structured_products(rows, F.col("scripts")).orderBy("page_id", "place").collect()
    assert [tuple(r)[:4] for r in got] == [(1, 0, "a", 1200.5), (2, 0, "b", 1200.5), (2, 1, "c", 1200.5), (4, 0, None, 5.0), (5, 0, "d", 1200.5), (5, 1, "e", 1200.5)]
    assert json.loads(got[0]["json"]) == product("a")


def test_reviews_at_any_depth(spark):
    long = "a text that is long enough"
    tree = {"props": [[{"x": {"ReviewBody": f" {long} ", "Grade": 4}}], {"text": "short", "body": long + "!", "stars": 9, "score": 2.5}], "z": {"comment": long, "rating": "5"}}
    for _ in range(10):
        tree = {"deeper": tree}
    script = lambda x: f'<script type="application/ld+json">{x}</script>'
    far = {"text": long}
    for _ in range(17):
        far = [far]
    many = [{"text": f"{long} {k}"} for k in range(60)]
    rows = [(1, script(json.dumps(tree))), (2, script("{bad") + script(json.dumps({"text": long + "?", "ratingValue": 5}))), (3, script(json.dumps(far))), (4, script(json.dumps(many))), (5, None), (6, "")]
    got = extract.json_reviews(spark.createDataFrame(rows, "page_id bigint, html string")).orderBy("page_id", "place").collect()
    assert [tuple(r) for r in got if r[0] < 4] == [(1, 0, long, 4.0), (1, 1, long + "!", 2.5), (2, 0, long + "?", 5.0)]
    assert [r["text"] for r in got if r[0] == 4] == [f"{long} {k}" for k in range(40)]


def plain_redacted(data):
    out = {}
    for k, v in sorted(data.items()):
        key = k.lower()
        if any(w in key for w in ("prompt", "password", "token", "email", "authorization")):
            continue
        if isinstance(v, str):
            most = 60 if "query" in key else 80 if "title" in key else 300
            if "url" in key:
                out[k] = v.split("?")[0].split("#")[0][:200]
            elif most == 300 or v.strip():
                v = v.strip() if most < 300 else v
                out[k] = v if len(v) <= most else v[: most - 1] + "…"
        elif isinstance(v, list):
            out[k] = [x[:120] if isinstance(x, str) else x for x in v[:20]]
        else:
            out[k] = plain_redacted(v) if isinstance(v, dict) else v
    return out


def test_redaction_at_any_depth(spark):
    deep = {"note": 'say "hi"\n', "userToken": 1}
    for k in range(12):
        deep = {"a": deep, f"Title{k}": "t" * (75 + k), "list": [k, None, "z" * 200, {"password": "kept as it is"}] * 8, "queryText": "q" * 70, "pageUrl": "https://x/y?z#1", "Email": {"deep": 1}}
    cases = [deep, {}, {"x": {}}, {"title": "  "}, {"a": True, "b": None, "c": 1.5}]
    rows = [(k, json.dumps(c)) for k, c in enumerate(cases)] + [(90, "[1]"), (91, "{bad"), (92, None)]
    got = {r["id"]: r["redacted"] for r in trees.redacted(spark.createDataFrame(rows, "id bigint, payload string"), "id", "payload").collect()}
    assert [json.loads(got[k]) for k in range(len(cases))] == [plain_redacted(c) for c in cases]
    assert [got[k] for k in (90, 91, 92)] == [None] * 3
    assert trees.redacted(spark.createDataFrame([], "id bigint, payload string"), "id", "payload").count() == 0


def test_widget_states(spark):
    s = json.dumps
    cases = {
        1: {"webProductHeading": s({"title": "Xiaomi Redmi Buds 8 Active белые", "price": "2 499 ₽", "originalPrice": "3 999 ₽", "totalScore": 4.7, "reviewsCount": 120})},
        2: {"webPrice-312345": s({"priceV2": {"price": [{"text": "2 199 ₽"}, {"text": "2 499 ₽"}]}, "atom": {"text": "Xiaomi Redmi Buds 8 Active"}})},
        3: {"pdpMain": s({"nested": {"webSale": {"title": "Наушники Xiaomi", "cardPrice": "1899"}}})},
        4: {"product2": s({"title": "first", "price": 5}), "product1": s({"title": "last", "price": 7, "originalPrice": 6}), "reviewScore": s({"score": 4.25, "count": "1 200 отзывов"})},
        5: {"other": s({"in": [s({"price": 3, "title": "in a string of an array"})]}), "pdp": s({"x": {"price": "4"}})},
        6: {"search": s({"items": [{"title": "no price"}, {"title": "found", "price": 9}]})},
        7: {"x": "{bad", "y": s([1]), "z": "plain"},
        8: {"webPrice": s({"webPrice": {"price": "1 500", "cardPrice": "9"}})},
    }
    rows = [(k, s(v)) for k, v in cases.items()] + [(9, None), (10, "[]")]
    got = {r["page_id"]: tuple(r)[1:] for r in extract.widget_offers(spark.createDataFrame(rows, "page_id bigint, states string")).collect()}
    assert got[1] == ("Xiaomi Redmi Buds 8 Active белые", 2499.0, 3999.0, 4.7, 120) and got[2][:2] == ("Xiaomi Redmi Buds 8 Active", 2199.0) and got[3][:2] == ("Наушники Xiaomi", 1899.0)
    assert got[4] == ("last", 7.0, None, 4.3, 1200) and got[5][:2] == (extract.UNTITLED, 4.0)
    # a search item without a page's product: depth finds an object with a price in any widget first
    assert got[6][:2] == ("found", 9.0) and got[7] == (None,) * 5 and got[8][:2] == (extract.UNTITLED, 1500.0) and got[9] == got[10] == (None,) * 5


def test_index_gives_the_scan(spark):
    texts = ["red shoes for men", "blue shoes, Red", "red hat", "", None, "for red shoes and red hat", "hat\n\nRED-shoes"]
    pages = spark.createDataFrame([(k, t, "shoes" if k % 2 else None, "x") for k, t in enumerate(texts)], "id bigint, t string, kind string, token string")
    asked = ["red shoes", '"red shoes"', "shoes OR hat", "shoes -red", "red blue OR hat", "-red", '-"red shoes" hat', "or", "", "-", "nothing", 'red OR -hat', "red red", '"hat red"', "OR blue"]
    index = text_index.build(pages, "id", [("t", "A"), ("kind", "B")], buckets=4)
    queries = spark.createDataFrame(list(enumerate(asked)), "query bigint, text string")
    got = text_index.search(index, queries, pages.select("id"), buckets=4).collect()
    both = F.concat_ws(" | gap | ", F.col("t"), F.col("kind"))  # no phrase reaches across fields
    for q, text in enumerate(asked):
        want = [r["id"] for r in pages.where(se.matches(both, text)).collect()] if any(c.isalnum() for c in text.replace("or", "").replace("OR", "")) else []
        assert sorted(r["id"] for r in got if r["query"] == q) == sorted(want), text
    rank = {(r["query"], r["id"]): r["rank"] for r in got}
    assert rank[0, 0] == 1.0 and rank[2, 2] == pytest.approx(0.5) and rank[2, 1] == pytest.approx(0.5) and rank[5, 3] == 0.0


def test_index_reads_only_the_words_asked_for(spark):
    pages = spark.createDataFrame([(k, f"w{k} common") for k in range(200)], "id bigint, t string")
    index = text_index.build(pages, "id", [("t", "A")])
    found = text_index.search(index, spark.createDataFrame([(1, "w7"), (2, "w9")], "query bigint, text string"), pages.select("id"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("#", " #").replace("bucket #", "bucket#") or "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert sorted(tuple(r) for r in found.collect()) == [(1, 7, 1.0), (2, 9, 1.0)]


def test_forms_of_search_pages(spark):
    pad = "." * 300
    pages = [
        (1, "aliexpress", f'{pad}<a href="/item/12345678.html">Redmi Note 13</a><a href="/item/12345678.html">Redmi Note 13 again</a>{pad} title="Redmi Note 13 bare" /item/87654321.html {pad} /item/11112222 {pad} /item/87654321', "Redmi Note 13"),
        (2, "megamarket", f'<li data-goods-id="222222">Redmi <b>Note</b> 13 case 2 000 руб</li>{pad}<a href="/catalog/details/chehol-333333/">чехол Redmi Note 13</a><a href="/catalog/details/x-222222/">Redmi</a>', "Redmi Note 13"),
        (3, "mvideo", f'{pad}<a href="/products/tv-12345">too short</a><a href="/products/search/tv-123456">Sony TV</a><a href="/item/777777">Sony TV one</a>{pad}/products/tv-888888" alt="Sony TV two"', "Sony TV"),
        (4, "mvideo", "short", "x"), (5, "mvideo", "captcha" + pad + '<a href="/products/tv-999999">Sony TV</a>', "Sony TV"), (6, "mvideo", None, "x"), (7, "elsewhere", pad, "x"),
        (8, "aliexpress", pad + "".join(f'<a href="/item/{10_000_000 + k}.html">Sony TV {k}</a>' for k in range(20)), "Sony TV"),
    ]
    got = search_pages.candidates(spark.createDataFrame(pages, "page_id bigint, store string, html string, reference string")).orderBy("page_id", "place").collect()
    told = [(r["page_id"], r["place"], r["id"], r["title"], r["price"]) for r in got]
    assert told[:2] == [(1, 0, "12345678", "Redmi Note 13", None), (1, 1, "87654321", "Redmi Note 13 bare", None)]
    assert [t for t in told if t[0] == 3] == [(3, 0, "777777", "Sony TV one", None), (3, 1, "888888", "Sony TV two", None)]
    assert {t[0] for t in told} <= {1, 2, 3, 8} and [t[2] for t in told if t[0] == 8] == [str(10_000_000 + k) for k in range(8)]
    assert all(t[2] != "333333" for t in told)


def test_places_of_matches(spark):
    row = spark.createDataFrame([("abXXcXXXdX",)], "x string").select(search_pages.located(F.col("x"), "X+").alias("m")).first()["m"]
    assert [(m["at"], m["text"]) for m in row] == [(2, "XX"), (5, "XXX"), (9, "X")]
