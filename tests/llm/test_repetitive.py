"""Repetitive texts take no longer than others, and give what brute force gives."""

import random
import time

import numpy as np
import pytest

from pricewright.llm import decontam, queries, toxicity


@pytest.mark.parametrize("period", [1, 2, 3, 7, 11])
def test_periodic_items_against_brute_force(period):
    draw = random.Random(period)
    words = [f"w{k}" for k in range(period)]
    items = [("long", " ".join(words * (60 // period))), ("twice", " ".join(words * (60 // period))), ("mixed", " ".join(draw.choice(words) for _ in range(40))), ("short", " ".join(words[:5] * 2)[:20].strip()), ("one", "w0")]
    texts = [" ".join(words * 12), " ".join(draw.choice([*words, "other"]) for _ in range(200)), "w0 " * 9, "w0 " * 10, " ".join(["x", *words * 5, "y", *words * 9]), ""]
    built = decontam.automaton(items, 10)
    want = decontam.brute_force(list(enumerate(texts)), items)
    for text, row in zip(texts, want, strict=True):
        n, spans, ids = decontam.scan(text.encode(), built)
        assert (n, sum(s["last"] - s["first"] + 1 for s in spans), len(ids)) == tuple(row[1:4])


def test_a_megabyte_of_one_word_is_scanned_in_seconds():
    item, text = "same " * 50_000, "Same, " * 200_000
    began = time.perf_counter()
    n, spans, ids = decontam.scan(text.encode(), decontam.automaton([("a", item), ("b", item + "end"), ("c", "same same")], 10))
    assert (n, len(spans), spans[0]["last"], ids) == (200_000, 1, 199_999, ["a", "b", "c"])
    assert time.perf_counter() - began < 20


def test_spared_hits_against_all_pairs():
    draw = random.Random(2)
    entries, phrases = {" bad ": 2.0, " ba": 0.5, " nasty ": 1.0, " worse ": 3.0}, ("nasty test", "not bad", "bad nasty bad", "worse")
    automaton = _automaton(entries, phrases)
    for _ in range(200):
        text = " " + " ".join(draw.choice(["bad", "nasty", "test", "not", "worse", "fine", "bats"]) for _ in range(draw.randrange(30))) + " "
        hits, spared = [], []
        for end, (size, weight) in automaton.iter(text):
            (spared if weight is None else hits).append((end - size + 1, end, weight))
        want = sum(w for a, b, w in hits if not any(s <= a and b <= e for s, e, _ in spared))
        assert toxicity.Lexicon.weigh(None, text, automaton) == pytest.approx(want)


def _automaton(entries, phrases):
    class Made:
        pass

    made = Made()
    made.entries, made.exceptions = entries, phrases
    return toxicity.Lexicon.automaton(made)


def test_a_hundred_thousand_spared_hits_take_seconds():
    automaton = _automaton({" nasty ": 1.0}, ("nasty test",))
    began = time.perf_counter()
    assert toxicity.Lexicon.weigh(None, " " + "nasty test " * 100_000 + "nasty ", automaton) == pytest.approx(1.0)
    assert time.perf_counter() - began < 10


def test_toxicity_recall_on_held_out_rows(spark):
    """Over all held-out labelled rows of sf0.1, through the query itself."""
    sf_dir = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [(labels[r["doc_id"]], r["predicted"]) for r in queries.op5_toxicity(spark, sf_dir).where("held_out").collect() if labels.get(r["doc_id"]) is not None]
    toxic = [p for y, p in rows if y == 1]
    assert len(toxic) > 80 and np.mean(toxic) >= 0.9
    assert sum(p for y, p in rows if y == 0) <= 0.01 * len(rows)
