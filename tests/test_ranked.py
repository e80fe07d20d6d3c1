"""Ranked candidates, fallbacks, picks and offers against plain Python over the scores of all search results."""

import math

import pytest
from pyspark.sql import functions as F

from pricewright import plans  # noqa: F401  fills the registry
from pricewright.functions import numbers as n
from pricewright.operators import match_score as ms
from pricewright.operators import matching as m
from pricewright.plans import title_queries as tq
from pricewright.registry import QUERIES
from pricewright.sources import relations as r


@pytest.fixture(scope="module")
def scored(spark, sf_dir):
    """Of each reference, its candidates with scores."""
    rows = ms.with_scores(tq._pairs(spark, sf_dir)).select("reference", "candidate", "position", "price_a", "price_b", "score", F.col("a.category").alias("ca"), F.col("b.category").alias("cb")).collect()
    out = {}
    for row in rows:
        out.setdefault(row["reference"], []).append(row)
    return out


def near(row, ratio):
    a, b = row["price_a"], row["price_b"]
    return not (a and b and a > 0 and b > 0) or max(a, b) / min(a, b) <= ratio


def ratio(category):
    return n.STRICT_RATIO if category in n.STRICT_CATEGORIES else n.USUAL_RATIO


def best(rows, least, of, top):
    return sorted((x for x in rows if x["score"] >= least and near(x, of(x["ca"]))), key=lambda x: (-x["score"], x["position"]))[:top]


def confidence(score):
    return math.floor(min(1, max(0, score)) * 100 + 0.5)


def same(got, want, columns):
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    have = sorted((tuple(plain(row[c]) for c in columns) for row in got), key=str)
    assert have == sorted((tuple(map(plain, w)) for w in want), key=str) and have


def test_top_matches(spark, sf_dir, scored):
    want = [(ref, x["candidate"], x["score"], k + 1) for ref, rows in scored.items() for k, x in enumerate(best(rows, 0.55 * 0.85, lambda c: ratio(c) * 1.4, 3))]
    same(QUERIES["t5_t6_top_matches"](spark, sf_dir).collect(), want, ["reference", "candidate", "score", "place"])


def test_best_with_fallback(spark, sf_dir, scored):
    want = []
    for ref, rows in scored.items():
        tier = lambda x: 0 if x["score"] > 0.55 and near(x, ratio(x["ca"])) else 1 if x["score"] > 0.5 and near(x, 1.3 * 1.3) else None
        some = [x for x in rows if tier(x) is not None]
        if some:
            x = min(some, key=lambda x: (tier(x), -x["score"], x["position"]))
            want.append((ref, x["candidate"], x["score"], tier(x)))
    same(QUERIES["t7_best_with_fallback"](spark, sf_dir).collect(), want, ["reference", "candidate", "score", "tier"])


def priority(match, price, reference):
    money, known = 0, price and reference and price > 0 and reference > 0
    if known:
        at = price / reference
        money = 8 if 0.7 <= at <= 1.2 else 3 if 0.55 <= at <= 1.4 else 0
        money += 8 if price <= reference else 4 if price <= reference * 1.1 else -12 if price > reference * 1.35 else -6 if price > reference * 1.2 else 0
    elif price and price > 0:
        money = 1
    return min(120, max(0, math.floor(match + money + 5 + 0.5)))


def test_search_pick(spark, sf_dir, scored):
    want = []
    for ref, rows in scored.items():
        clash = lambda x: x["ca"] != x["cb"] and "generic" not in (x["ca"], x["cb"])
        tier = lambda x: 0 if x["score"] >= 0.38 and near(x, 1.5) else 1 if x["score"] > 0 and near(x, 1.5) else None if clash(x) else 2  # noqa: E731, B023
        first = min((tier(x) for x in rows if tier(x) is not None), default=None)
        ten = sorted((x for x in rows if tier(x) == first and first is not None), key=lambda x: (-x["score"], x["position"]))[:10]
        by = sorted(ten, key=lambda x: (-priority(confidence(x["score"]), x["price_b"], x["price_a"]), -x["score"], x["position"]))
        want += [(ref, x["candidate"], first, priority(confidence(x["score"]), x["price_b"], x["price_a"]), k + 1) for k, x in enumerate(by)]
    same(QUERIES["t8_d27_search_pick"](spark, sf_dir).collect(), want, ["reference", "candidate", "tier", "priority", "place"])


def test_offers_from_ranked(spark, sf_dir, scored):
    want = []
    for row in r.listings(spark, sf_dir).select("product").collect():
        top = best(scored.get(row["product"], []), 0.38, lambda c: 1.5, 3)
        if not top:
            want.append((row["product"], None, None, "not_found", 0))
            continue
        first, second = confidence(top[0]["score"]), confidence(top[1]["score"]) if len(top) > 1 else None
        tie = second is not None and first >= m.PICK and second >= m.COMPARE and first - second <= m.TIE
        more = len(top) - 1
        if first < m.COMPARE:
            said = "needs_choice" if more else "not_found"
        elif first < m.PICK or tie:
            said = "needs_choice"
        else:
            said = "verified" if first >= 85 and not more else "probable"
        picked = first >= m.PICK and not tie
        want.append((row["product"], top[0]["candidate"] if picked else None, top[0]["price_b"] if picked else None, said, more))
    same(QUERIES["d28_offers_from_ranked"](spark, sf_dir).collect(), want, ["reference", "candidate", "price", "status", "alternatives"])


def test_pick_history(spark, sf_dir):
    f = F.col("f")
    rows = tq._featured(spark, sf_dir).select("product", f["title"].alias("title"), ms.compact(f["e"]["model"]["query"]).alias("model")).collect()
    by_model = {}
    for row in sorted(rows, key=lambda x: -x["product"]):
        by_model.setdefault(row["model"], []).append(row)
    want = []
    for row in rows:
        boost = 0
        for turn, past in enumerate(by_model[row["model"]][:5]):
            url, old = (f"https://x/p/{x['product'] % 500}" for x in (row, past))
            if old in url:
                boost = max(2, 5 - turn)
            elif past["title"].lower()[:24] in row["title"].lower():
                boost = max(1, 3 - turn)
            if boost:
                break
        want.append((row["product"], boost, boost * 0.01))
    same(QUERIES["d34_pick_history"](spark, sf_dir).collect(), want, ["product", "boost", "delta"])


def test_queries_to_search_with(spark, sf_dir):
    known = {x["product"]: x["title"] for x in r.listings(spark, sf_dir).select("product", "title").collect()}
    got = QUERIES["x55_x56_queries"](spark, sf_dir).collect()
    assert {x["product"] for x in got} == set(known)
    for x in got:
        low = [q.lower() for q in x["queries"]]
        assert 1 <= len(low) <= 3 and len(set(low)) == len(low) and all(3 <= len(q) <= 100 and q == " ".join(q.split()) for q in low)
        # the words of a query are words of its title, but for the host of a part and the names of features
        assert any(w in known[x["product"]].lower() for q in low for w in q.split())
    variants = QUERIES["n35_query_variants"](spark, sf_dir).collect()
    assert sorted((x["product"], x["variant"]) for x in variants) == sorted((p, v) for p in known for v in range(5))
    assert sum(x["query"] is None for x in variants) < len(variants) / 2
