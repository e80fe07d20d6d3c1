"""The pipeline's stages, one after the other, against what each operator decides by itself."""

from pyspark.sql import functions as F

import corpus_pipeline
from pricewright.llm import decontam, mixing, near_dup, toxicity
from pricewright.llm.common import save, table


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages(spark, sf_dir):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dup", "decontam", "mixing", "token_ids"]
    docs = table(spark, sf_dir, "documents").withColumn("score", F.lit("clash"))
    counts, seen = [docs.count()], [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = save(stage(spark, seen[-1], sf_dir), f"test-{name}")
        if name != "token_ids":
            assert out.columns == docs.columns
        seen.append(out)
        counts.append(out.count())
    judged = toxicity.classify(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))
    assert ids(seen[1]) == ids(judged.where("predicted = 0"))
    assert ids(seen[2]) == ids(near_dup.groups(seen[1], corpus_pipeline.NEAR).where("kept")) and counts[2] < counts[1]
    assert counts[3] <= counts[2] and counts[5] == counts[4]
    gone = decontam.brute_force([(r["doc_id"], r["text"]) for r in seen[2].collect()], [(r["item_id"], r["text"]) for r in table(spark, sf_dir, "benchmark").collect()])
    assert counts[3] == sum(not g[5] for g in gone)
    assert counts[4] == mixing.plan(seen[3]).agg(F.sum("copies")).first()[0]
    assert corpus_pipeline.run(spark, sf_dir).count() == counts[5]


def test_toxic_documents_go(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = table(spark, sf_dir, "documents")
    toxic = toxicity.classify(docs, toxicity.learn(docs, table(spark, sf_dir, "labels"))).where("predicted = 1")
    kept = corpus_pipeline.without_toxic(spark, docs, sf_dir)
    assert toxic.count() > 10 and sorted(ids(kept) + ids(toxic)) == ids(docs)


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Nothing, and texts that are null or empty, pass through all stages."""
    docs = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    tables = {"labels": ([], "doc_id bigint, quality int, toxic int"), "benchmark": ([], "item_id bigint, text string")}
    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a few words", "en", None, 11), (4, "a few words more", None, "s", 16), (5, None, "en", "s", None)]
    for name, rows in (("nothing", []), ("odd", odd)):
        folder = f"file://{tmp_path}/{name}"
        spark.createDataFrame(rows, docs).write.parquet(f"{folder}/documents.parquet")
        for t, (content, kind) in tables.items():
            spark.createDataFrame(content, kind).write.parquet(f"{folder}/{t}.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        assert (len(got) > 0) == bool(rows) and {r["doc_id"] for r in got} <= {r[0] for r in rows}


def test_near_dup_refuses_similarities_that_it_would_miss(spark):
    import pytest

    assert near_dup.miss(85) < 1e-5 and near_dup.miss(80) < 3e-4
    with pytest.raises(ValueError):
        near_dup.groups(spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string"), 50)
