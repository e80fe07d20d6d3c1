"""Whitening and product codes against plain numpy, language models against their own sums, a plain model and held-out rows."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricewright.llm import language, queries, vector_codes, whitening

VECTORS = "vec_id bigint, embedding array<double>, label int"


def made(spark, rows):
    # columns that operators use themselves
    return spark.createDataFrame(rows, VECTORS).withColumn("x", F.lit("clash")).withColumn("code", F.lit(1)).withColumn("error", F.lit("e")).withColumn("n", F.lit(0))


def odd_rows():
    nan, inf = float("nan"), float("inf")
    return [(900, None, 1), (901, [1.0, None, 0.0], 1), (902, [nan, 0.0, 0.0], None), (903, [inf, 0.0, 0.0], 2), (None, [0.25, -0.5, 0.125], 1), (904, [0.5], None), (905, [], 3), (7, [0.1, 0.2, 0.3], 1), (7, [0.1, 0.2, 0.3], 1)]


def padded(rows, dims):
    kept = [(v, [*e, *[0.0] * (dims - len(e))], lab) for v, e, lab in rows if e is not None and all(c is not None and math.isfinite(c) for c in e)]
    return kept, np.array([[math.floor(256 * c) for c in e] for _, e, _ in kept], object).reshape(len(kept), dims)


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(3)
    spread = draw.normal(size=(150, 3)) @ np.array([[2.0, 0.3, 0.0], [0.0, 1.0, 0.2], [0.0, 0.0, 0.4]])
    out = [(k, v.tolist(), k % 4) for k, v in enumerate(spread)]
    return [*out, *[(1000 + k, out[0][1], None) for k in range(300)], *odd_rows()]  # a vector of two thirds of all rows


def test_whitening_against_numpy(spark, rows):
    frame = made(spark, rows)
    model = whitening.fit(frame)
    got = whitening.transform(frame, model).collect()
    kept, x = padded(rows, 3)
    distinct = np.unique(x.astype(np.int64), axis=0)
    n, sums = len(distinct), distinct.sum(0)
    e, axes = np.linalg.eigh(np.cov(distinct.T.astype(float), bias=True))
    e, axes = e[::-1], axes[:, ::-1]
    assert len(got) == 3 * len(kept) and {r["n"] for r in got} == {n} and model.sums == sums.tolist()
    assert np.allclose(model.eigenvalues, e) and model.identity_error < 1e-9
    white = (x.astype(float) - sums / n) @ axes / np.sqrt(e)
    deviation = ((n * x - sums.astype(object)) ** 2).sum(1)
    sign = np.sign((model.axes * axes).sum(0))
    want = sorted((str(v), k + 1, int(deviation[i]), round(float(white[i, k] * sign[k]), 7), round(e[k] / e.sum(), 9)) for i, (v, _, _) in enumerate(kept) for k in range(3))
    have = sorted((str(r["vec_id"]), r["component"], r["deviation"], round(r["whitened"], 7), round(r["explained"], 9)) for r in got)
    assert [h[:3] for h in have] == [w[:3] for w in want]
    assert np.allclose([h[3:] for h in have], [w[3:] for w in want], atol=1e-6)
    assert len({r["identity_error"] for r in got}) == 1


def test_whitening_without_variance(spark):
    for rows in ([], [(1, None, 0)], [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], [(1, [], 0)]):
        frame = made(spark, rows)
        assert whitening.transform(frame, whitening.fit(frame)).count() == 0
    # variance along one line: one component, however many are asked for
    line = made(spark, [(k, [float(k), 2.0 * k, 0.0], 0) for k in range(5)])
    assert {r["component"] for r in whitening.transform(line, whitening.fit(line)).collect()} == {1}


def test_deviations_beyond_64_bits():
    x = np.array([[1 << 40, 0], [0, 1]], np.int64)
    assert whitening.deviations(x, 1 << 20, [0, 5]) == [(1 << 120) + 25, ((1 << 20) - 5) ** 2]


def brute_codes(rows, parts, entries, rounds, dims):
    """Everything summed anew in each round, in Python integers."""
    kept, x = padded(rows, dims)
    x = [[[int(v) for v in row[p * dims // parts : (p + 1) * dims // parts]] for p in range(parts)] for row in x]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, x[i]))
    books = [[x[i][p] for i in order[:entries]] for p in range(parts)]
    far = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b, strict=True))
    nearest = lambda: [[min(range(len(books[p])), key=lambda e, p=p, row=row: (far(row[p], books[p][e]), e)) for p in range(parts)] for row in x]
    for _ in range(rounds):
        codes = nearest()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [row[p] for row, c in zip(x, codes, strict=True) if c[p] == e]
                if own:
                    books[p][e] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    codes = nearest()
    errors = [sum(far(row[p], books[p][c[p]]) for p in range(parts)) for row, c in zip(x, codes, strict=True)]
    by_label = {}
    for (_, _, lab), e in zip(kept, errors, strict=True):
        by_label[lab] = by_label.get(lab, 0) + e
    sha = hashlib.sha256(",".join(str(v) for book in books for entry in book for v in entry).encode()).hexdigest()
    return sorted((str(v), "".join(f"{c:02x}" for c in code), e, by_label[lab], sha) for (v, _, lab), code, e in zip(kept, codes, errors, strict=True))


@pytest.mark.parametrize("parts,entries,rounds", [(2, 16, 2), (3, 200, 3), (1, 4, 6), (2, 5, 0)])
def test_codes_against_brute_force(spark, rows, parts, entries, rounds):
    dims = -(-3 // parts) * parts
    got = vector_codes.encode(made(spark, rows), parts=parts, entries=entries, rounds=rounds)
    assert sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in got.collect()) == brute_codes(rows, parts, entries, rounds, dims)


def test_codes_of_large_numbers_and_of_nothing(spark):
    rows = [(k, [1e12 * k, -3e13 + k], 0) for k in range(6)]
    got = vector_codes.encode(made(spark, rows), parts=2, entries=2)
    kept, x = padded(rows, 2)
    want = brute_codes(rows, 2, 2, 2, 2)
    assert sorted((str(r["vec_id"]), r["code"], r["error"], r["codebooks_sha256"]) for r in got.collect()) == [(v, c, min(e, 2**63 - 1), s) for v, c, e, _, s in want]
    assert vector_codes.encode(made(spark, [])).count() == 0
    assert vector_codes.encode(made(spark, [(1, None, 0)])).count() == 0


def test_only_changed_parts_are_moved(spark, rows):
    """The second round's contributions are those of changed parts, and lead to the sums of all."""
    frame = made(spark, rows)
    books, coded = vector_codes.train(frame, parts=2, entries=8, rounds=1)
    changed = coded.where(F.col("was") != F.col("code"))
    moves = vector_codes._changes(coded, books, 4)
    assert 0 < changed.count() < coded.count()
    assert sum(c for _, _, c, _ in moves) == 0  # what leaves an entry joins another
    books.move(moves)
    _, x = padded(rows, 4)
    codes = [(r["x"], r["code"]) for r in coded.collect()]
    for p in range(2):
        for e in range(8):
            own = [[*v, 0, 0, 0, 0][2 * p : 2 * p + 2] for v, c in codes if c[p] == e]
            assert books.counts[p, e] == len(own) and list(books.sums[p, e]) == ([sum(col) for col in zip(*own, strict=True)] or [0, 0])


def texts_of(draw, alphabet, n):
    return [" ".join("".join(draw.choice(alphabet) for _ in range(draw.randrange(2, 8))) for _ in range(draw.randrange(3, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def tongues(spark):
    draw = random.Random(5)
    rows = [(k, t, "aa") for k, t in enumerate(texts_of(draw, "abcde", 300))] + [(1000 + k, t, "bb") for k, t in enumerate(texts_of(draw, "cdefg", 300))]
    rows += [(5000, None, "aa"), (5001, "", "bb"), (5002, "12 34 !", "aa"), (5003, "abc", None), (None, "gggg", "aa"), (5004, "AB́ \U00010400", "aa"), (5005, "cd" * 1_500_000, "bb")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("v", F.lit("clash")).withColumn("h", F.lit(1))


def test_models_sum_to_one_and_equal_a_plain_one(spark):
    draw = random.Random(8)
    texts = {"aa": texts_of(draw, "abc", 30), "bb": texts_of(draw, "bcd", 40)}
    frame = spark.createDataFrame([(lang, t) for lang, some in texts.items() for t in some], "lang string, text string")
    for entries in (10**6, 150):
        model = language.estimate(frame, 3, entries)
        if entries == 150:
            assert sum(len(g) for of in model.grams for g, _ in of) <= entries
        alphabet = "abcd "  # one more share is for what no model has seen
        for context in ("  ", "ab", "xy", "d "):
            codes = np.concatenate([np.array([ord(c) for c in context + s], np.uint32) for s in [*alphabet, "?"]])
            at = np.arange(2, len(codes), 3)
            p = np.exp(-model.surprise(language.hashes(codes, 3), at))
            assert np.allclose(p.sum(1), 1, atol=1e-5)
    model = language.estimate(frame, 3)
    # a plain interpolated Kneser-Ney model of strings
    for n, lang in enumerate(model.langs):
        levels = {3: {}}
        for t in texts[lang]:
            s = "  " + t + " "
            for i in range(2, len(s)):
                levels[3][s[i - 2 : i + 1]] = levels[3].get(s[i - 2 : i + 1], 0) + 1
        for k in (2, 1):
            levels[k] = {}
            for g in levels[k + 1]:
                levels[k][g[1:]] = levels[k].get(g[1:], 0) + 1

        def p(context, symbol, levels=levels):
            out = 1 / 6  # five symbols, one for others
            for k in (1, 2, 3):
                counts, h = levels[k], context[len(context) - k + 1 :] if k > 1 else ""
                n1, n2 = (sum(c == x for c in counts.values()) for x in (1, 2))
                d = min(max(n1 / (n1 + 2 * n2), 0.1), 0.9) if n1 else 0.1
                after = {g: c for g, c in counts.items() if g[:-1] == h}
                if after:
                    total = sum(after.values())
                    out = max(after.get(h + symbol, d) - d, 0) / total + d * len(after) / total * out
            return out

        for text in ("abc cab", "dd bc", "a"):
            s = "  " + text + " "
            want = -sum(math.log(p(s[i - 2 : i], s[i])) for i in range(2, len(s))) / (len(s) - 2)
            got, size, letters = model.entropies(iter([text]), 1)
            assert size[0] == len(s) - 2 and letters[0] and got[0, n] == pytest.approx(want, rel=1e-4)


def test_symbols_in_pieces(monkeypatch):
    text = "  Ab, ć -- D1eﬁ \U00010400"
    whole = np.concatenate([c for c, _ in language.symbols(text)])
    assert "".join(map(chr, whole)) == "ab ć d eﬁ \U00010428 "
    for size in (1, 2, 5):
        monkeypatch.setattr(language, "PIECE", size)
        assert np.array_equal(np.concatenate([c for c, _ in language.symbols(text)]), whole)
    assert [list(c) for c, _ in language.symbols("")] == [] and not any(some for _, some in language.symbols("1 2"))


def test_stretches_give_the_same_entropies(spark, tongues, monkeypatch):
    model = language.estimate(tongues.where("doc_id < 2000"), 4)
    texts = ["abc dea", None, "", "cdefg gfedc cde", "abcde " * 50, "99"]
    want = model.entropies(iter(texts), len(texts))
    for stretch in (1, 7, 60):
        monkeypatch.setattr(language, "STRETCH", stretch)
        monkeypatch.setattr(language, "PIECE", 11)
        got = model.entropies(iter(texts), len(texts))
        assert np.allclose(got[0], want[0]) and np.array_equal(got[1], want[1]) and np.array_equal(got[2], want[2])


def test_language_of_made_texts(spark, tongues):
    model = language.learn(tongues, reject=0.05)
    got = {r["doc_id"]: r for r in language.identify(tongues, model).collect()}
    assert len(got) == tongues.count()
    assert all(got[k]["lang_pred"] == "aa" and got[1000 + k]["lang_pred"] == "bb" for k in range(300))
    assert [got[k]["lang_pred"] for k in (5000, 5001, 5002)] == ["und"] * 3 and [got[k]["score"] for k in (5000, 5001, 5002)] == [0.0] * 3
    assert got[5003]["lang_pred"] == "aa" and got[None]["lang_pred"] == "bb" and not got[None]["held_out"] and got[5005]["lang_pred"] == "bb"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    # what is like no language is rejected, and little else
    assert sum(r["rejected"] for r in got.values()) < 60
    strange = spark.createDataFrame([(1, "xyz zyx " * 9, "s", 7), (2, "abcde ebcda", "s", 8)], "doc_id bigint, text string, lang string, v int")
    assert [r["doc_id"] for r in language.clean(strange, model, ["aa", "bb"]).collect()] == [2]
    assert language.clean(strange, model, ["aa"]).columns == strange.columns


def test_language_of_nothing(spark, tongues):
    empty = tongues.limit(0)
    model = language.learn(empty)
    assert language.identify(empty, model).count() == 0
    assert {(r["lang_pred"], r["score"]) for r in language.identify(tongues.limit(5), model).collect()} == {("und", 0.0)}


def test_language_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()}
    got = queries.op12_language(spark, sf_dir).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r["held_out"]]
    assert len(held) > 300 and sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.98 * len(held)
    for lang in set(truth.values()):
        own = [r for r in held if truth[r["doc_id"]] == lang]
        assert sum(r["lang_pred"] == lang for r in own) >= 0.95 * len(own)


@pytest.mark.parametrize("name", ["op11_whitening", "op13_vector_codes"])
def test_queries_cover_all_vectors(spark, sf_dir, name):
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    assert queries.QUERIES[name](spark, sf_dir).select("vec_id").distinct().count() == n


def test_calibration_reads_every_row(spark):
    """Settings and limits come from all measured rows: equal to plain numpy over 20000 of them, whose last ones differ from the first 8000."""
    rng = np.random.default_rng(5)
    n = 20_000
    own, size = rng.integers(0, 2, n), rng.integers(1, 400, n).astype(float)
    e = np.abs(rng.normal(2, 0.4, (n, 2)) + np.where(np.arange(n) > 8000, 3, 0)[:, None] + (np.arange(2)[None] != own[:, None]) * 0.3)
    frame = spark.createDataFrame([(int(o), float(s), x.tolist()) for o, s, x in zip(own, size, e)], "own int, size double, e array<double>").repartition(5)
    model = language.Model(3, ["aa", "bb"], 0.1, [], [], [])
    language.calibrate(model, frame, 0.01)
    mine = e[np.arange(n), own]
    usual = [float(np.median(mine[own == k])) for k in range(2)]
    odd = (mine - np.array(usual)[own]) * np.sqrt(size)
    slack = [float(np.sort(odd[own == k])[int(np.ceil(((own == k).sum() + 1) * 0.99)) - 1]) for k in range(2)]
    assert np.allclose(model.usual, usual, rtol=0, atol=1e-12) and np.allclose(model.slack, slack, rtol=0, atol=1e-9)
    plain = {}
    for model_power, model_sharpness in language.SETTINGS:
        other = language.Model(3, ["aa", "bb"], 0.1, [], [], [], power=model_power, sharpness=model_sharpness)
        plain[model_power, model_sharpness] = -np.log(np.maximum(other.shares(e, size)[np.arange(n), own], 1e-12)).mean()
    assert plain[model.power, model.sharpness] <= min(plain.values()) + 2e-4
    values = spark.createDataFrame([(0, v) for v in (5, -3, 5, 2**62, -(2**63), 0)] + [(1, 7)], "k int, v bigint")
    assert language.order_statistics(values, {(0, r) for r in range(1, 7)} | {(1, 1)}) == {(0, 1): -(2**63), (0, 2): -3, (0, 3): 0, (0, 4): 5, (0, 5): 5, (0, 6): 2**62, (1, 1): 7}
