"""Text search over pages: weighted token vectors, and queries with phrases, alternatives and exclusions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of fields of class A to D.
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}


def tokens(x: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(x, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def weighted_vector(*fields: tuple[Column, str]) -> Column:
    """Map of each token to the greatest weight of a field that has it: fields in falling weight, each adding the tokens that none before it has."""
    out = F.create_map().cast("map<string,double>")
    for x, k in sorted(fields, key=lambda f: -WEIGHTS[f[1]]):
        new = F.array_except(tokens(x), F.map_keys(out))  # a hash set, not a search for each token
        out = F.map_concat(out, F.map_from_arrays(new, F.transform(new, lambda _: F.lit(WEIGHTS[k]))))  # noqa: B023  built at once
    return out


def rank(vector: Column, query: Column) -> Column:
    """Mean weight of the query's different tokens."""
    asked = F.array_distinct(tokens(query))
    return F.when(F.size(asked) == 0, 0.0).otherwise(F.aggregate(asked, F.lit(0.0), lambda s, w: s + F.coalesce(F.try_element_at(vector, w), F.lit(0.0))) / F.size(asked))


def matches(text: Column, query: str) -> Column:
    """Whether a text answers a web-style query: words must all occur, "a phrase" in order, either side of OR, and no -word."""
    import re

    words = F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" "))
    groups: list[list[tuple[bool, str]]] = [[]]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query):
        if word.lower() == "or" and not minus:
            groups.append([])
            continue
        plain = " ".join(w for w in re.split(r"[^\w]+|_", (phrase or word).lower()) if w)
        if plain:
            groups[-1].append((bool(minus), plain))
    # OR joins the term before it and the term after it; all else must hold
    terms: list[list[tuple[bool, str]]] = []
    for k, group in enumerate(groups):
        for i, term in enumerate(group):
            if k and i == 0 and terms:
                terms[-1].append(term)
            else:
                terms.append([term])
    holds = lambda term: ~words.contains(f" {term[1]} ") if term[0] else words.contains(f" {term[1]} ")
    out = F.lit(True)
    for alternatives in terms:
        any_ = F.lit(False)
        for term in alternatives:
            any_ = any_ | holds(term)
        out = out & any_
    return out
