"""Text search by an inverted index: postings by token with field weights and places, web-style queries as joins of postings.

The index is a stored table, partitioned by a hash of the token, so that a set of queries reads only the partitions of its words. Queries come from a table: words must all
occur, "a phrase" in order, either side of OR, and no -word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.search import WEIGHTS, tokens
from ..sources.shared import shared_folder

#: Partitions of an index.
BUCKETS = 64
#: Places between one field's words and the next's: no phrase reaches across.
GAP = 1


def bucket_of(token: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def build(pages: DataFrame, key: str, fields: list[tuple[str, str]], buckets: int = BUCKETS) -> DataFrame:
    """The stored postings of pages: token, id, weight (the greatest of the fields that hold it), places; fields are (column, class A to D), in order. A page's own key
    must be unique; pages without a word have no postings."""
    words = [tokens(F.col(name)) for name, _ in fields]
    entries, before = [], F.lit(0)
    for w, (_, kind) in zip(words, fields, strict=True):
        start, weight = before, F.lit(WEIGHTS[kind])
        entries.append((w, start, weight))
        before = before + F.size(w) + F.lit(GAP)
    placed = lambda w, start, weight: F.transform(w, lambda token, at: F.struct(token.alias("token"), (at + start).alias("place"), weight.alias("weight")))
    one = pages.select(F.col(key).alias("id"), F.explode(F.concat(*[placed(*e) for e in entries])).alias("e")).select("id", "e.*")
    postings = one.groupBy("token", "id").agg(F.max("weight").alias("weight"), F.sort_array(F.collect_list("place")).alias("places")).withColumn("bucket", bucket_of(F.col("token"), buckets))
    path = shared_folder(pages.sparkSession, "postings")
    # a partition's tokens come sorted, so that row groups tell them apart too; common tokens are cut into several files
    postings.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("bucket", "token").write.partitionBy("bucket").parquet(path)
    return pages.sparkSession.read.schema(postings.schema).parquet(path)


def parsed(query: Column) -> Column:
    """Of a query text, its conditions: each an array of alternatives (minus, words). OR joins the term before it and the one after it."""
    term = lambda x: F.struct(F.startswith(x, F.lit("-")).alias("minus"), tokens(x).alias("words"))
    kind = "array<array<struct<minus:boolean,words:array<string>>>>"

    def step(state: Column, x: Column) -> Column:
        t, groups = term(x), state["groups"]
        last = F.size(groups)
        more = F.when(state["either"] & (last > 0), F.concat(F.slice(groups, 1, last - 1), F.array(F.concat(F.element_at(groups, -1), F.array(t))))).otherwise(F.concat(groups, F.array(F.array(t))))
        return F.when(F.lower(x) == "or", F.struct(groups.alias("groups"), F.lit(True).alias("either"))).when(F.size(t["words"]) == 0, state).otherwise(F.struct(more.alias("groups"), F.lit(False).alias("either")))

    terms = F.regexp_extract_all(F.coalesce(query, F.lit("")), F.lit(r'-?"[^"]*"|\S+'), F.lit(0))
    return F.aggregate(terms, F.struct(F.array().cast(kind).alias("groups"), F.lit(False).alias("either")), step, lambda s: s["groups"])


def search(index: DataFrame, queries: DataFrame, pages: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """query, id, rank of the pages that answer each query (columns query, text); pages (id) is read only for queries that name nothing but what must not occur. rank: mean
    weight of the words that are asked for. A query without words has no answers."""
    terms = queries.select("query", F.posexplode(parsed(F.col("text"))).alias("g", "alternatives")).select("query", "g", F.posexplode("alternatives").alias("alt", "t"), F.exists("alternatives", lambda t: t["minus"]).alias("negated"))
    terms = terms.select("query", "g", "alt", "negated", "t.minus", "t.words")
    words = terms.select("query", "g", "alt", "minus", "negated", F.size("words").alias("n"), F.posexplode("words").alias("nth", "token"))
    needed = [r[0] for r in words.select(bucket_of(F.col("token"), buckets)).distinct().collect()]  # at most `buckets` numbers
    here = index.where(F.col("bucket").isin(needed))
    found = words.join(here.drop("bucket"), "token")
    single = found.where("n = 1").select("query", "g", "alt", "minus", "negated", "id")
    starts = found.where("n > 1").select("query", "g", "alt", "minus", "negated", "n", "nth", "id", F.explode("places").alias("place")).groupBy("query", "g", "alt", "minus", "negated", "n", "id", (F.col("place") - F.col("nth")).alias("start"))
    phrases = starts.agg(F.count(F.lit(1)).alias("hit")).where("hit = n").select("query", "g", "alt", "minus", "negated", "id")
    held = single.union(phrases).distinct()
    # a condition without minus holds where an alternative does; one with minus fails only where all its minus terms occur and no other
    positive = held.where("NOT negated").groupBy("query", "id").agg(F.count_distinct("g").alias("held"))
    asked = terms.groupBy("query").agg(F.count_distinct(F.when(~F.col("negated"), F.col("g"))).alias("wanted"))
    some = positive.join(asked, "query").where("held = wanted").select("query", "id")
    bare = asked.where("wanted = 0").select("query")
    all_ = F.broadcast(bare).crossJoin(pages.select("id")) if bare.limit(1).count() else some.limit(0)  # what these queries ask for is all pages but some
    minuses = terms.where("negated").groupBy("query", "g").agg(F.count_if("minus").alias("minuses"))
    barred = held.where("negated").groupBy("query", "g", "id").agg(F.count_if("minus").alias("m"), F.count_if(~F.col("minus")).alias("p")).join(minuses, ["query", "g"]).where("m = minuses AND p = 0").select("query", "id").distinct()
    answers = some.union(all_).join(barred, ["query", "id"], "left_anti")
    wanted = words.where("NOT minus").select("query", "token").distinct()
    count = wanted.groupBy("query").agg(F.count(F.lit(1)).alias("words"))
    weights = wanted.join(here.select("token", "id", "weight"), "token").groupBy("query", "id").agg(F.sum("weight").alias("total"))
    ranked = answers.join(weights, ["query", "id"], "left").join(count, "query", "left")
    return ranked.select("query", "id", F.coalesce(F.col("total") / F.col("words"), F.lit(0.0)).alias("rank"))
