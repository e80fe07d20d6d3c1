"""Publishing against a plain model; runs that change nothing write nothing, and replays write the same."""

import random

from pyspark.sql import functions as F

from pricewright.functions import text as t
from pricewright.operators import publishing as pub

KIND = f"key string, base string, canon string, hash string, quality double, reason string, price double, offers {pub.OFFERS}"


def frame(spark, rows):
    return spark.createDataFrame(rows, KIND).withColumn("slug", F.lit("clash")).withColumn("run", F.lit(9))


def page(key, base="a", canon=None, hash_="h", quality=5.0, reason=None, price=1.0, offers=(("ozon", 1.0, "u"),)):
    return (key, base, canon, hash_, quality, reason, price, [dict(zip(("marketplace", "price", "url"), o, strict=True)) for o in offers])


def test_slugs_fill_gaps_and_never_clash(spark):
    def plain(new, taken):
        taken, out, left = set(taken), {}, dict(new)
        while left:
            given = {}
            for base in set(left.values()):
                n = 0
                for key in sorted(k for k, b in left.items() if b == base):
                    while True:
                        n += 1
                        slug = base if n == 1 else f"{base}-{n}"
                        if slug not in taken:
                            break
                    given.setdefault(slug, []).append(key)
            for slug, keys in given.items():
                out[min(keys)] = slug
                taken.add(slug)
                del left[min(keys)]
        return out

    draw = random.Random(1)
    for _ in range(3):
        taken = {draw.choice(["a", "b", "a-2", "a-3", "b-2-2", "a-5", "a-02", "a-1", "b-7"]) for _ in range(6)}
        new = {f"k{i:03}": draw.choice(["a", "b", "a-2", "b-2", "a-2-2", "c"]) for i in range(40)}
        rows = spark.createDataFrame(list(new.items()), "key string, base string")
        got = {r["key"]: r["slug"] for r in pub.slugs(rows, spark.createDataFrame([(s,) for s in taken], "slug string")).collect()}
        assert got == plain(new, taken) and len(set(got.values()) | taken) == len(got) + len(taken)


def outcomes(df):
    return {r["key"]: r["outcome"] for r in df.collect()}


def test_only_changes_are_written(spark):
    store = pub.Store.new(spark)
    rows = [page("k1", canon="c"), page("k2", canon="c", quality=7.0), page("k3", reason="thin"), page("k4", base="b", canon="d")]
    assert outcomes(pub.publish(store, 1, frame(spark, rows))) == {"k1": "published", "k2": "published", "k3": "rejected", "k4": "published"}
    state = {r["key"]: r for r in store.pages().collect()}
    assert [state[k]["slug"] for k in ("k1", "k2", "k3", "k4")] == ["a", "a-2", "a-3", "b"]
    assert [state[k]["primary"] for k in ("k1", "k2", "k3", "k4")] == [False, True, True, True] and state["k1"]["primary_slug"] == "a-2"
    # the same again: nothing is written
    assert set(outcomes(pub.publish(store, 2, frame(spark, rows))).values()) == {"unchanged"} and store.delta(2).count() == 0
    # one changed row that stays what it is in its group: one row is written
    rows[3] = page("k4", base="b", canon="d", hash_="h2")
    pub.publish(store, 3, frame(spark, rows))
    assert [r["key"] for r in store.delta(3).collect()] == ["k4"] and {r["key"]: r["run"] for r in store.pages().collect()} == {"k1": 1, "k2": 1, "k3": 1, "k4": 3}
    # k1 becomes the primary: its peer is written too, and loses its place
    rows[0] = page("k1", base="other", canon="c", hash_="h3", quality=9.0)
    for _ in range(2):  # a replay writes the same
        pub.publish(store, 4, frame(spark, rows))
        assert sorted((r["key"], r["slug"], r["primary"], r["primary_slug"], r["since"]) for r in store.delta(4).collect()) == [("k1", "a", True, None, 1), ("k2", "a-2", False, "a", 1)]
    # a published page that would be rejected stays; a new page of a taken slug gets the next number
    rows = [page("k2", hash_="h4", reason="thin"), page("k9"), page("k0", base="a-2")]
    assert outcomes(pub.publish(store, 5, frame(spark, rows))) == {"k2": "kept", "k9": "published", "k0": "published"}
    assert {r["key"]: r["slug"] for r in store.delta(5).collect()} == {"k9": "a-4", "k0": "a-2-2"}
    assert pub.publish(store, 6, frame(spark, rows).limit(0)).count() == 0 and store.pages().count() == 6


def test_offers_are_refreshed(spark):
    store = pub.Store.new(spark)
    rows = [page("p", canon="c", quality=9.0), page("alias", canon="c"), page("no", reason="thin"), page("same"), page("bare", price=None, offers=()), page("worse")]
    pub.publish(store, 1, frame(spark, rows))
    offer = lambda *o: [dict(zip(("marketplace", "price", "url"), x, strict=True)) for x in o]
    new = [("p", None, offer(("wb", 3.0, "w"), ("ozon", None, None))), ("alias", 1.0, []), ("no", 1.0, []), ("same", 1.0, offer(("ozon", 1.0, "u"))), ("bare", None, []), ("worse", 0.0, offer(("ozon", 0.0, "u"))), ("unknown", 1.0, [])]
    new = spark.createDataFrame(new, f"key string, price double, offers {pub.OFFERS}")
    for _ in range(2):
        assert outcomes(pub.refresh(store, 2, new)) == {"p": "updated", "alias": "alias", "no": "unpublished", "same": "unchanged", "bare": "unchanged", "worse": "worse"}
        assert sorted(r["key"] for r in store.delta(2).collect()) == ["alias", "p"]
    state = {r["key"]: r for r in store.pages().collect()}
    assert state["p"]["price"] == 1.0 and [o["price"] for o in state["alias"]["offers"]] == [3.0, None]
    # the same offers in another order change nothing
    assert outcomes(pub.refresh(store, 3, new.withColumn("offers", F.reverse("offers")))) ["p"] == "unchanged" and store.delta(3).count() == 0


def test_replayed_micro_batches(spark, tmp_path):
    """publish() as the sink of a stream: a batch that comes twice leaves the pages as they were."""
    source = f"file://{tmp_path}/in"
    spark.createDataFrame([page("k1"), page("k2")], KIND).write.parquet(source)
    store = pub.Store.new(spark)
    twice = lambda batch, n: [pub.publish(store, n, batch) for _ in range(2)]
    stream = spark.readStream.schema(KIND).parquet(source)
    stream.writeStream.option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).foreachBatch(twice).start().awaitTermination()
    assert sorted((r["key"], r["slug"], r["run"]) for r in store.pages().collect()) == [("k1", "a", 0), ("k2", "a-2", 0)]


def test_equal_names_are_slugged_once(spark, sf_dir):
    """Bases of slugs come from the stored table of different names, not from a slug for each part."""
    from pricewright.plans import publish_queries as pq

    rows = pq._candidates(spark, sf_dir, True)
    assert "pricewright-told-" in rows._jdf.queryExecution().toString()
    names = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("string").alias("key"), t.slug(F.col("p_name")).alias("want"))
    assert rows.count() == names.count() == rows.join(names, "key").where("base = want").count()
