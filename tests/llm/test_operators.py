"""Each operator on small tables: against brute force or an exact round trip, with nulls, empty and very long texts, repeats and clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricewright.llm import components, decontam, mixing, near_dup, quality, substrings, suffix_sort, token_count, token_file, topk, toxicity, warc
from pricewright.llm.common import shared_path

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(draw, n, size=60):
    return " ".join(f"w{draw.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(11)
    base = [words(draw, 40, 500) for _ in range(25)]
    texts = [*base, base[0], base[1] + " tail", base[2].replace("w1", "w2", 1), None, "", "one", "one two three", "ONE two three", "a" * 300, words(draw, 30_000, 9000), base[3][:90] + words(draw, 5) + base[4][20:150]]
    out = [(k * 3, t, "en", f"src{k % 3}" if k % 7 else None, 0) for k, t in enumerate(texts)]
    return [*out, (0, base[0], "en", "src0", 0), (None, base[5], None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    # columns that operators use themselves
    return spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("clash")).withColumn("size", F.lit(1)).withColumn("label", F.lit(2)).withColumn("key", F.lit(3))


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def brute_groups(rows):
    def shingles(text):
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        w = [x for x in "".join(" " if ord(c) in (32, *range(9, 14)) else c for c in low).split(" ") if x]
        return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)} if w else set()

    found = [(d, shingles(t)) for d, t, *_ in rows]
    parent = {d: d for d, _ in found if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(found):
        for b, y in found[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 85 * len(x | y):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return sorted(((d, len(s), None if d is None else root(d)) for d, s in found), key=str)


def test_near_duplicates_against_brute_force(spark, docs, rows, nothing):
    got = near_dup.groups(docs)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()), key=str) == brute_groups(rows)
    kept = near_dup.clean(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids))
    assert set(ids) == {c for d, _, c in brute_groups(rows) if d == c or d is None}
    assert near_dup.groups(nothing).count() == 0


def test_near_duplicates_of_a_large_group(spark):
    draw = random.Random(5)
    base = [f"w{draw.randrange(900)}" for _ in range(60)]
    texts = []
    for k in range(1300):
        copy = list(base)
        for _ in range(draw.randrange(4)):
            copy[draw.randrange(60)] = f"x{k}"
        texts.append((k, " ".join(copy)))
    got = near_dup.groups(spark.createDataFrame(texts, "doc_id bigint, text string"))
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()), key=str) == brute_groups(texts)


@pytest.mark.parametrize("tile, shingles", [(2, 1 << 20), (1, 1 << 20), (1024, 40)])
def test_near_duplicates_in_tiles_of_few_nodes(spark, docs, rows, monkeypatch, tile, shingles):
    monkeypatch.setattr(near_dup, "TILE", tile)
    monkeypatch.setattr(near_dup, "TILE_SHINGLES", shingles)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dup.groups(docs).collect()), key=str) == brute_groups(rows)


def test_near_duplicates_of_groups_that_share_half(spark, monkeypatch):
    # groups of copies whose members share much, but not enough, with other groups: one cluster of many tiles and several components
    monkeypatch.setattr(near_dup, "TILE", 4)
    draw, texts = random.Random(8), []
    common = [f"c{draw.randrange(900)}" for _ in range(80)]
    for g in range(8):
        own = [f"g{g}x{i}" for i in range(30 + 8 * g)]
        for k in range(9):
            copy = common + own
            copy[draw.randrange(len(copy))] = f"y{g}x{k}"
            texts.append((len(texts) * 7 % 72, " ".join(copy)))
    got = near_dup.groups(spark.createDataFrame(texts, "doc_id bigint, text string"))
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()), key=str) == brute_groups(texts)


def test_components_by_stars_and_by_one_task(spark, monkeypatch):
    draw = random.Random(4)
    pairs = [(draw.randrange(400), draw.randrange(400)) for _ in range(300)]
    edges = spark.createDataFrame(pairs, "a bigint, b bigint")
    once = sorted(map(tuple, components.components(edges).collect()))
    monkeypatch.setattr(components, "FOLD", 10)
    assert sorted(map(tuple, components.components(edges).collect())) == once


def test_pigeonhole_finds_all_pairs_within_the_distance():
    draw = np.random.default_rng(0)
    most = near_dup.CHUNKS * (near_dup.ERRORS + 1) - 1
    signs = draw.integers(0, 1 << 16, (200, near_dup.VALUES)).astype(np.uint16)
    other = signs.copy()
    for k in range(200):
        at = draw.choice(near_dup.VALUES, most, replace=False)
        other[k, at] ^= 1
    assert all(set(a) & set(b) for a, b in zip(near_dup.keys(signs).tolist(), near_dup.keys(other).tolist(), strict=True))


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(1000, 1002), (1002, 1001)], "a bigint, b bigint")
    got = {r["id"]: r["component"] for r in components.components(edges).collect()}
    assert got == {k: 0 for k in range(301)} | {1000: 1000, 1001: 1000, 1002: 1000}


def test_suffix_array():
    draw = np.random.default_rng(1)
    for k in range(120):
        text = draw.integers(0, (2, 3, 5, 60)[k % 4], draw.integers(1, 400)).astype(np.uint8)
        order = suffix_sort.suffix_array(text)
        heads = [text.tobytes()[i : i + suffix_sort.DEPTH].ljust(suffix_sort.DEPTH, b"\0") for i in order]
        assert sorted(order.tolist()) == list(range(len(text))) and heads == sorted(heads)
        shared = suffix_sort.common_prefixes(text, order)
        for a, b, n in zip(heads, heads[1:], shared[1:], strict=False):
            assert a[:n] == b[:n] and (n == suffix_sort.DEPTH or a[n] != b[n])


@pytest.mark.parametrize("hot", [substrings.HOT, 0])
def test_substrings_against_brute_force(docs, rows, nothing, hot):
    want = substrings.brute_force([(r[0], r[1]) for r in rows])
    assert sorted((tuple(r) for r in substrings.report(docs, hot=hot).collect()), key=str) == sorted(want, key=str)
    assert substrings.report(nothing).count() == 0


def test_decontamination_against_brute_force(spark, docs, rows, nothing):
    items = [(1, "x " + rows[0][1][:80].upper() + " y"), (2, "one two"), (3, None), (4, ""), (2, "one two"), (None, rows[6][1])]
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit("clash"))
    want = decontam.brute_force([(r[0], r[1]) for r in rows], [("" if i is None else i, t) for i, t in items])
    for block in (decontam.BLOCK_BYTES, 64):
        assert sorted((tuple(r) for r in decontam.report(docs, bench, block_bytes=block).collect()), key=str) == sorted(want, key=str)
    left = decontam.clean(docs, bench)
    assert left.columns == docs.columns and left.count() == sum(not w[5] for w in want)
    assert decontam.report(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontam.report(nothing, bench).count() == 0
    text = "Ünï — " + rows[0][1][:80] + "!!"
    n, spans, _ = decontam.scan(text.encode(), decontam.automaton([("1", rows[0][1][:80])], 10))
    assert len(spans) == 1 and text.encode()[spans[0]["start"] : spans[0]["end"]].decode() in rows[0][1]


def test_mixing_targets_and_copies(spark, docs, rows, nothing):
    got = mixing.plan(docs).collect()
    size = {(r[0], r[3]): len([w for w in (r[1] or "").split()]) for r in rows}
    totals = {}
    for r in rows:
        totals[r[3]] = totals.get(r[3], 0) + len((r[1] or "").split())
    weights = dict(zip(sorted((s for s in totals if s is not None)) + [None], (3, 1, 2, 3), strict=True))
    left, targets = 1.5 * sum(totals.values()), {}
    open_ = dict(weights)
    while True:  # sources over their cap stop there, the rest share what is left
        level = left / sum(open_.values())
        over = [s for s in open_ if 2 * totals[s] <= level * open_[s]]
        if not over:
            targets |= {s: level * w for s, w in open_.items()}
            break
        for s in over:
            targets[s] = 2.0 * totals[s]
            left -= targets[s]
            del open_[s]
    assert len(got) == len(rows)
    for r in got:
        assert r["size"] == size[r["doc_id"], r["source"]] and r["source_size"] == totals[r["source"]]
        assert r["target"] == pytest.approx(targets[r["source"]]) and r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
    assert sorted(map(str, mixing.plan(docs).collect())) == sorted(map(str, got))
    assert mixing.emit(docs).count() == sum(r["copies"] for r in got) and mixing.emit(docs).columns == docs.columns
    assert mixing.plan(nothing).count() == 0 and mixing.emit(nothing).count() == 0
    many = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("source"))
    for r in mixing.plan(many).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r["taken"] / r["target"] - 1) < 0.05


def test_token_counts_equal_the_library(docs, rows, nothing):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=token_count.model_path())
    odd = ["  two  spaces ", "a\tb\nc", "▁x ▁ y", "<s> </s> <unk>", "naïve café — ok", "x" * 5000, "あ い う", " lead", "trail ", "\x00 \x01"]
    assert token_count.count(__import__("pyarrow").array(odd), token_count.model_path()).tolist() == [len(model.encode(x)) for x in odd]
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_count.token_counts(docs).collect()), key=str)
    want = sorted(((r[0], len((r[1] or "").encode()), k := len(model.encode(r[1] or "")), k > 4096) for r in rows), key=str)
    assert got == want and token_count.token_counts(nothing).count() == 0
    raw = np.frombuffer(rows[34][1].encode(), np.uint8)
    assert b"".join(s.tobytes() for s in token_count.stretches(raw, False, 1000)) == raw.tobytes()


def test_token_files_round_trip(spark, docs, rows, nothing):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_file.tokenizer_path())
    got = token_file.round_trip(docs).collect()
    start, left = 0, sorted(got, key=lambda r: r["start"])
    for r in left:
        assert r["start"] == start
        start += r["n_tokens"]
    assert [r["doc_id"] for r in left] == sorted((r[0] for r in rows), key=lambda d: -1 if d is None else d)
    want = sorted((str(r[0]), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for r in rows for ids in [library.encode(r[1] or "", add_special_tokens=False).ids + [2]])
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == want
    assert token_file.round_trip(nothing).count() == 0
    special = ["<|endoftext|>", "a<|endoftext|> b", "x  y\n\nz ", "don't stop."]
    parts = list(token_file.encode(__import__("pyarrow").array(special), token_file.tokenizer_path()))
    assert np.concatenate([p[2] for p in parts]).tolist() == [i for s in special for i in library.encode(s, add_special_tokens=False).ids]


@pytest.mark.parametrize("width", [1, 7, 8, 15, 16, 17, 31, 32])
def test_packing(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 20_011, dtype=np.uint64).astype(np.uint32)
    assert (token_file.unpack(token_file.pack(ids, width), width, len(ids)) == ids).all()
    counts = np.array([5, 0, 20_000, 6])
    s = token_file.Shard(token_file.shard(1, 2, width, [7, None, 9, 10], counts, ids) + b"\n")
    assert (s.ids() == ids).all() and (s.ids_of(2) == ids[5:20_005]).all() and (s.ids_of(3) == ids[20_005:]).all()
    with pytest.raises(ValueError):
        token_file.Shard(token_file.shard(1, 2, width, [7], np.array([len(ids)]), ids)[:-3] + b"abc\n")


def test_warc_round_trip_and_salvage(spark):
    big, odd = "<p>" + "x" * 200 + "</p>", "naïve \r\n\r\nWARC/1.1\r\n é" * 9
    pages = [(5, "http://a/ b\r\n", big), (2, None, big), (9, "u", big), (3, "u", "short"), (4, "u", "short"), (6, "u", None), (7, "u", ""), (8, "u", odd), (5, "v", big)]
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("digest", F.lit("clash"))
    path = shared_path(spark, "test-warc")
    warc.write(frame, path)
    got = warc.read(spark, path).collect()
    assert {r["kind"] for r in got} == {"record"}
    want = sorted((p, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), "revisit" if h == big and p != 2 else "response", 2 if h == big and p != 2 else -1) for p, _, h in pages)
    assert sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], -1 if r["refers_to"] is None else r["refers_to"]) for r in got) == want
    assert {r["page_id"]: bytes(r["payload"]) for r in got if r["record_type"] == "response"}[8] == odd.encode()
    empty = shared_path(spark, "test-warc")
    warc.write(frame.limit(0), empty)
    assert warc.read(spark, empty).count() == 0

    record = lambda k, text: warc.record(k, "u", text.encode(), hashlib.sha256(text.encode()).hexdigest(), len(text.encode()), None)
    for wrap in (lambda b: b, warc.member):
        parts = [wrap(record(k, f"page {k} " * 40)) for k in range(5)]
        hurt = bytearray(parts[2])
        hurt[len(hurt) // 2] ^= 0x55
        data = b"junk" + parts[0] + parts[1] + bytes(hurt) + parts[3] + parts[4][:-7]
        out = list(warc.salvage(data, "f"))
        assert [r["page_id"] for r in out if r["kind"] == "record"] == [0, 1, 3]
        at = len(b"junk" + parts[0] + parts[1])
        assert [(r["start"], r["stop"]) for r in out if r["kind"] == "gap"] == [(0, 4), (at, at + len(hurt)), (at + len(hurt) + len(parts[3]), len(data))]
        covered = sum(r["stop"] - r["start"] for r in out)
        assert covered == len(data)


def brute_top(rows, k, scale=64):
    good = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q % 20 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), c) for c, b in good if c != q)[:k]
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 1e7])
def test_top_k_against_brute_force(spark, scale):
    draw = random.Random(2)
    vectors = [(k, [round(draw.uniform(-1, 1), 1) * scale for _ in range(6)]) for k in range(130)]
    vectors += [(200, None), (201, [None] * 6), (202, [float("nan")] * 6), (203, [float("inf")] * 6), (None, [1.0] * 6), (220, []), (221, [1.0, 2.0])]
    frame = spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>").withColumn("rank", F.lit("clash"))
    got = topk.top_k(frame, F.col("vec_id") % 20 == 0, k=7)
    assert sorted(tuple(r) for r in got.collect()) == brute_top(vectors, 7)
    assert topk.top_k(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def labelled_docs(spark, kind):
    draw = random.Random(9)
    rows, labels = [], []
    for k in range(600):
        text, bad = words(draw, draw.randrange(5, 80), 300), k % 4 == 0
        if bad and kind == "toxic":
            text += " " + draw.choice(["nastyword", "vileterm"]) + " " + words(draw, 5, 300)
        elif bad:
            text = " ".join(w + "$$$%%%" for w in text.split())
        rows.append((k, text))
        labels.append((k, int(not bad), int(bad)))
    rows += [(900, None), (901, ""), (0, rows[0][1])]
    return spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("label", F.lit("clash")), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark, nothing):
    docs, labels = labelled_docs(spark, "toxic")
    lexicon = toxicity.learn(docs, labels)
    got = toxicity.classify(docs, lexicon).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in got) >= 0.98 * len(got)
    assert {r["score"] for r in toxicity.classify(docs, lexicon).where("doc_id >= 900").collect()} == {0.0}
    disguised = spark.createDataFrame([(1, "you n4styw0rd"), (2, "a vіleterm"), (3, "a nas​tyword!!"), (4, "plain words")], "doc_id bigint, text string")
    assert [r["predicted"] for r in toxicity.classify(disguised, lexicon).orderBy("doc_id").collect()] == [1, 1, 1, 0]
    spared = toxicity.Lexicon(lexicon.entries, ("nastyword test",), lexicon.power, lexicon.half)
    assert [r["predicted"] for r in toxicity.classify(spark.createDataFrame([(1, "a nastyword test"), (2, "a nastyword rest")], "doc_id bigint, text string"), spared).orderBy("doc_id").collect()] == [0, 1]
    assert toxicity.clean(docs, lexicon).columns == docs.columns
    assert toxicity.classify(docs, toxicity.learn(docs, labels.limit(0))).where("predicted = 1").count() == 0
    assert toxicity.classify(nothing, lexicon).count() == 0


def test_quality_on_held_out_rows(spark, nothing):
    docs, labels = labelled_docs(spark, "quality")
    model = quality.fit(docs, labels)
    got = quality.classify(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) >= 0.95 * len(got)
    scores = [r["score"] for r in quality.classify(docs, model).collect()]
    assert len(scores) == 603 and all(0 <= s <= 1 for s in scores)
    assert all(r["score"] == pytest.approx(0.3) for r in quality.classify(docs, quality.fit(docs, labels.limit(0))).collect())
    assert quality.classify(nothing, model).count() == 0
