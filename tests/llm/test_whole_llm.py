"""Text-collection operators and stages do the whole job where small tables of the other tests don't show it."""

import base64
import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from pricewright.llm import common, decontam, mixing, near_dup, quality, toxicity, warc
from pricewright.llm.common import shared_path


def test_near_copies_from_the_stages_similarity(spark):
    # 104 words have 100 shingles; two far words changed leave 90 of 110: 0.818. Three leave 85 of 115: 0.739
    texts = []
    for k in range(12):
        base = [f"w{k}x{i}" for i in range(104)]
        two = [f"new{k}x{i}" if i in (20, 60) else w for i, w in enumerate(base)]
        three = [f"other{k}x{i}" if i in (30, 50, 80) else w for i, w in enumerate(base)]
        texts += [(3 * k, " ".join(base)), (3 * k + 1, " ".join(two)), (3 * k + 2, " ".join(three))]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.without_near_copies(spark, docs, "").collect()) == [i for i in range(36) if i % 3 != 1]
    assert near_dup.clean(docs).count() == 36


def test_warc_urls_of_any_length(spark):
    urls = {1: "http://a/" + "x" * 70_000, 2: "http://b/" + "yz" * 500_000, 3: "http://c/WARC/1.1"}
    path = shared_path(spark, "test-warc")
    warc.write(spark.createDataFrame([(k, u, f"page {k}") for k, u in urls.items()], "page_id bigint, url string, html string"), path)
    got = warc.read(spark, path).collect()
    assert {r["kind"] for r in got} == {"record"} and {r["page_id"]: r["url"] for r in got} == urls


def test_warc_records_of_other_writers():
    def made(kind, block, *more):
        head = [f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:1>", *more, f"Content-Length: {len(block)}"]
        return b"WARC/1.0\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    http, page = "Content-Type: application/http; msgtype=response", b"<p>page</p>"
    answer = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n" + page
    sha1 = base64.b32encode(hashlib.sha1(page).digest()).decode()
    good = [
        (made("warcinfo", b"software: x\r\n", "Content-Type: application/warc-fields"), b"software: x\r\n", None),
        (made("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", "Content-Type: application/http; msgtype=request"), b"", None),
        (made("response", answer, http), page, None),
        (made("response", answer, http, f"WARC-Payload-Digest: sha1:{sha1}"), page, f"sha1:{sha1}"),
        (made("response", answer, http, "WARC-Payload-Digest: blake3:abc"), page, "blake3:abc"),
        (made("response", b"dns", "Content-Type: text/dns"), b"dns", None),
        (made("metadata", b"via: b\r\n\r\nrest", "Content-Type: application/warc-fields"), b"via: b\r\n\r\nrest", None),
        (made("revisit", b"", http, f"WARC-Payload-Digest: sha1:{sha1}"), b"", f"sha1:{sha1}"),
    ]
    bad = made("response", answer.replace(b"page", b"pale"), http, f"WARC-Payload-Digest: sha1:{sha1}")
    for wrap in (lambda b: b, warc.member):
        out = list(warc.salvage(b"".join(wrap(g[0]) for g in good) + wrap(bad)))
        assert [r["kind"] for r in out] == ["record"] * len(good) + ["gap"]
        assert [(r["payload"], r["payload_digest"]) for r in out[:-1]] == [g[1:] for g in good]
        assert [r["record_type"] for r in out[:-1]] == ["warcinfo", "request", "response", "response", "response", "response", "metadata", "revisit"]
        assert out[-1]["reason"] == "payload digest differs"


def test_warc_members_of_several_records():
    record = lambda k: warc.record(k, "u", b"page %d" % k, hashlib.sha256(b"page %d" % k).hexdigest(), 6, None)
    two, hurt = warc.member(record(1) + record(2)), warc.member(record(3) + record(4).replace(b"page 4", b"pale 4") + record(5))
    out = list(warc.salvage(two + hurt + warc.member(record(6))))
    assert [(r["kind"], r["page_id"]) for r in out] == [("record", 1), ("record", 2), ("record", 3), ("record", 5), ("gap", None), ("record", 6)]
    assert (out[4]["start"], out[4]["stop"]) == (len(two), len(two) + len(hurt))


def test_warc_shared_digests_beyond_what_is_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "SMALL", 2)
    big = [f"<p>{k}</p>" * 40 for k in range(6)]
    pages = [(k, "u", big[k % 6] if k % 3 else "short") for k in range(60)] + [(100, None, None), (4, "again", big[4])]
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    got = {(r["page_id"], r["url"]): r["response_id"] for r in warc.plan(frame).collect()}
    first = {}
    for k, _, h in pages:
        first[h] = min(first.get(h, k), k)
    # of pages that repeat the smallest page_id of a payload, each is a response
    assert got == {(k, u): first[h] if h in big and first[h] != k else None for k, u, h in pages}


def test_mixing_with_many_sources(spark, monkeypatch):
    rows = [(k, "a b c d" * (k % 5), f"s{k % 40}" if k % 4 else None) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    once = sorted(map(str, mixing.plan(docs).collect())), sorted(map(str, mixing.emit(docs).collect()))
    monkeypatch.setattr(common, "SMALL", 3)
    assert (sorted(map(str, mixing.plan(docs).collect())), sorted(map(str, mixing.emit(docs).collect()))) == once


def test_names_that_operators_use(spark):
    rows = [(1, "one two three four five six", "s", 7, 8, 9), (1, "one two three four five six", "s", 7, 8, 9), (1, "seven eight nine ten eleven", "s", 1, 2, 3), (2, "one two three four five six", None, 4, 5, 6), (None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, `row` bigint, v0 bigint, `turn` bigint").withColumn("score", F.lit(1)).withColumn("rate", F.lit(2)).withColumn("component", F.lit(3)).withColumn("n", F.lit(4)).withColumn("a.b", F.lit(5))
    bench = spark.createDataFrame([("i", "seven eight")], "item_id string, text string")
    lexicon = toxicity.Lexicon({" seven": 9.0}, (), 0.5, 1.0)
    for out in (toxicity.clean(docs, lexicon), near_dup.clean(docs), decontam.clean(docs, bench), mixing.emit(docs)):
        assert out.columns == docs.columns and out.count() <= 10
    # of rows that repeat a doc_id only equal texts go
    kept = [(r["doc_id"], r["text"], r["row"]) for r in near_dup.clean(docs).collect()]
    assert sorted(kept, key=str) == sorted([(1, rows[0][1], 7), (1, rows[2][1], 1), (None, None, None)], key=str)
    nothing = docs.limit(0)
    for out in (toxicity.clean(nothing, lexicon), near_dup.clean(nothing), decontam.clean(nothing, bench), mixing.emit(nothing)):
        assert out.columns == docs.columns and out.count() == 0


def test_decontamination_in_passes(spark):
    draw = random.Random(3)
    vocabulary = [f"w{k}" for k in range(30)]
    items = [(str(k), " ".join(draw.choice(vocabulary) for _ in range(draw.randrange(2, 40)))) for k in range(12)]
    rows = [(k, " ".join(draw.choice(vocabulary) for _ in range(30)) + " " + " ".join(items[k % 12][1].split()[3:18])) for k in range(40)]
    docs, bench = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id string, text string")
    want = sorted(decontam.brute_force(rows, items))
    assert sorted(tuple(r) for r in decontam.report(docs, bench, block_bytes=200).collect()) == want
    assert sorted(r["doc_id"] for r in decontam.clean(docs, bench, block_bytes=200).collect()) == sorted(w[0] for w in want if not w[5])


def test_held_out_documents(spark):
    """Both classifiers on labelled rows of documents that they did not learn from."""
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    got = quality.classify(docs, quality.fit(docs, labels)).join(labels, "doc_id").where("held_out AND quality IS NOT NULL").collect()
    assert len(got) > 50 and sum(r["predicted"] == r["quality"] for r in got) >= 0.97 * len(got)
    got = toxicity.classify(docs, toxicity.learn(docs, labels)).join(labels, "doc_id").where("held_out AND toxic IS NOT NULL").collect()
    assert len(got) > 50 and sum(r["predicted"] == r["toxic"] for r in got) >= 0.95 * len(got)
    clean = [r for r in got if r["toxic"] == 0]
    assert sum(r["predicted"] for r in clean) <= 0.02 * len(clean)


def test_very_long_texts(spark):
    long = "word " * 400_000
    docs = spark.createDataFrame([(1, long + "nasty"), (2, "short"), (3, "あ" * 300_000)], "doc_id bigint, text string")
    model = quality.rank(np.zeros((0, len(quality.NAMES))), np.zeros(0))
    assert quality.classify(docs, model).count() == 3
    scores = {r["doc_id"]: r["score"] for r in toxicity.classify(docs, toxicity.Lexicon({" nasty": 5.0}, (), 0.0, 1.0)).collect()}
    assert scores[1] > 0.5 and scores[2] == scores[3] == 0
    path = shared_path(spark, "test-warc")
    warc.write(docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html")), path)
    assert {r["page_id"]: r["payload_bytes"] for r in warc.read(spark, path).collect()} == {1: 2_000_005, 2: 5, 3: 900_000}
