"""Users' lists: one-to-one pairing of two lists by shared keys, and merging of records of one product in the order of a list."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import ship, stored
from .catalog import placed


def _edges(rows: DataFrame, owner: str, place: str, keys: str) -> DataFrame:
    return rows.select(F.col(owner).alias("owner"), F.col(place).alias("place"), F.explode(F.array_distinct(F.filter(keys, lambda k: k.isNotNull()))).alias("key"), F.size(F.array_distinct(F.filter(keys, lambda k: k.isNotNull()))).alias("n"))


def _of_lonely_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys whose rows on both sides have no other key pair off in order, however many rows share one: place by place, numbered by ranges of a sort."""
    most = lambda e, name: e.groupBy("owner", "key").agg(F.max("n").alias(name))
    alone = stored(most(a, "x").join(most(b, "y"), ["owner", "key"]).where("x = 1 AND y = 1").select("owner", "key"), "lonely")
    numbered = []
    for e, name in ((a, "a"), (b, "b")):
        at = stored(placed(e.join(alone, ["owner", "key"]).select("owner", "key", "place"), [F.col("owner"), F.col("key"), F.col("place")], "at"), "numbered")
        first = at.groupBy("owner", "key").agg(F.min("at").alias("first"))
        numbered.append(at.join(first, ["owner", "key"]).select("owner", "key", (F.col("at") - F.col("first")).alias("nth"), F.col("place").alias(name)))
    return numbered[0].join(numbered[1], ["owner", "key", "nth"]).select("owner", "a", "b")


def paired(left: DataFrame, right: DataFrame, owner: str = "owner", place: str = "place", keys: str = "keys") -> DataFrame:
    """owner, a, b: each left row with its partner on the right, as if each owner's left rows, in order of place, took the first right row that is free and shares a key with it;
    rows without partner stand alone (a full join). A place names one row of an owner's list; rows without key, and null keys, have no partner.

    Rounds: who is first in line both ways is a pair for good (the left row's first free partner, all of whose other suitors come later), and leaves. Each key passes on
    only its first free row of either side, so no round forms pairs of a key's rows. In each owner's list the first row that can still be paired is paired in each round,
    so the rounds end; keys that stand by themselves, of any number of rows, are paired off before them at once.
    """
    a, b = stored(_edges(left, owner, place, keys), "edges"), stored(_edges(right, owner, place, keys), "edges")
    # a key that one side lacks pairs nothing in any round
    shared = stored(a.select("owner", "key").distinct().join(b.select("owner", "key").distinct(), ["owner", "key"]), "shared-keys")
    a, b = (stored(e.join(shared, ["owner", "key"]), "edges") for e in (a, b))
    found = stored(_of_lonely_keys(a, b), "pairs")
    done = [found]
    while True:
        a = stored(a.join(done[-1].select("owner", F.col("a").alias("place")), ["owner", "place"], "left_anti"), "edges")
        b = stored(b.join(done[-1].select("owner", F.col("b").alias("place")), ["owner", "place"], "left_anti"), "edges")
        first = lambda e, name: e.groupBy("owner", "key").agg(F.min("place").alias(name))
        heads = stored(first(a, "a").join(first(b, "b"), ["owner", "key"]), "heads")
        wants = a.join(heads.select("owner", "key", "b"), ["owner", "key"]).groupBy("owner", F.col("place").alias("a")).agg(F.min("b").alias("b"))
        asked = b.join(heads.select("owner", "key", "a"), ["owner", "key"]).groupBy("owner", F.col("place").alias("b")).agg(F.min("a").alias("a"))
        found = stored(wants.join(asked, ["owner", "a", "b"]), "pairs")
        if not found.limit(1).count():
            break
        done.append(found)
    pairs = done[0]
    for more in done[1:]:
        pairs = pairs.union(more)
    mine, theirs = (side.select(F.col(owner).alias("owner"), F.col(place).alias(name)) for side, name in ((left, "a"), (right, "b")))
    return mine.join(pairs, ["owner", "a"], "left").select("owner", "a", "b").union(theirs.join(pairs, ["owner", "b"], "left_anti").select("owner", F.lit(None).cast(mine.schema["a"].dataType).alias("a"), "b"))


def _unlike(a: dict, b: dict) -> bool:
    """Different makers, or different categories that both say something."""
    makers = a["maker"] is not None and b["maker"] is not None and a["maker"] != b["maker"]
    return makers or (a["category"] != b["category"] and "generic" not in (a["category"], b["category"]))


def _keys(x: dict) -> set[tuple[str, str]]:
    links = {("url", u) for u in (x["url"], *x["urls"].values()) if u}
    return links | {(store, a.strip()) for store, a in ((x["source"], x["article"]), *x["articles"].items()) if store and a and a.strip()}


def _join(kept: dict, new: dict) -> dict:
    """The record of both: later links and articles of a store replace earlier ones, the longest title wins and brings its maker and category."""
    told = new if len(new["title"] or "") > len(kept["title"] or "") else kept
    urls, articles = kept["urls"] | new["urls"], kept["articles"] | new["articles"]
    if new["source"]:
        urls |= {new["source"]: new["url"]} if new["url"] else {}
        articles |= {new["source"]: new["article"]} if new["article"] else {}
    return kept | {"title": told["title"], "maker": told["maker"], "category": told["category"], "article": kept["article"] or new["article"], "urls": urls, "articles": articles, "members": kept["members"] + 1}


class _List:
    """An owner's merged records, found by their present keys."""

    def __init__(self):
        self.records, self.keys, self.holders = [], [], {}

    def add(self, row: dict) -> None:
        keys = _keys(row)
        near = sorted({n for key in keys for n in self.holders.get(key, ())})
        at = next((n for n in near if not _unlike(self.records[n], row)), None)
        if at is None:
            at = len(self.records)
            self.records.append(row | {"members": 1})
            self.keys.append(set())
        else:
            self.records[at] = _join(self.records[at], row)
            keys = _keys(self.records[at])
            for key in self.keys[at] - keys:
                self.holders[key].discard(at)
        for key in keys - self.keys[at]:
            self.holders.setdefault(key, set()).add(at)
        self.keys[at] = keys


#: Records of ended lists that are sent on together.
TOGETHER = 4096
RECORD = "owner bigint, place bigint, title string, category string, members bigint, keys array<string>"


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    owner, kept = None, None

    def told() -> pa.RecordBatch:
        text = lambda name: pa.array([x[name] for x in ended], pa.string())
        whole = lambda name: pa.array([x[name] for x in ended], pa.int64())
        columns = [whole("owner"), whole("place"), text("title"), text("category"), whole("members"), pa.array([x["keys"] for x in ended], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(columns, ["owner", "place", "title", "category", "members", "keys"])

    def end() -> None:
        ended.extend(x | {"keys": sorted(map(":".join, keys))} for x, keys in zip(kept.records, kept.keys, strict=True))

    ended: list[dict] = []
    for batch in batches:
        names = batch.schema.names
        for values in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns)), strict=True):
            row = dict(zip(names, values, strict=True))
            if kept is None or row["owner"] != owner:
                if kept is not None:
                    end()
                    if len(ended) >= TOGETHER:
                        yield told()
                        ended.clear()
                owner, kept = row["owner"], _List()
            row["urls"], row["articles"] = dict(row["urls"] or ()), dict(row["articles"] or ())
            kept.add(row)
    if kept is not None:
        end()
    if ended:
        yield told()


def merged_lists(rows: DataFrame) -> DataFrame:
    """Records of one product merged in each owner's list, in order of place (J15's rule in M16's order): each row joins the first record, as merged so far, that shares
    a link or a store's article with it and is not of another maker or category; else it begins a record, which keeps its place.

    rows: owner, place, source (its store), url, article, urls and articles (maps by store, or null), title, maker, category ('generic' if it says nothing). Order decides, so an owner's list is folded
    over sorted rows; of it only its merged records are held.
    """
    ship(rows.sparkSession)
    text = [F.col(c).cast("string").alias(c) for c in ("source", "url", "article")]
    maps = [F.col(c).cast("map<string,string>").alias(c) for c in ("urls", "articles")]
    sent = rows.select(F.col("owner").cast("bigint"), F.col("place").cast("bigint"), *text, *maps, "title", "maker", F.coalesce("category", F.lit("generic")).alias("category"))
    # a number of partitions, for by sizes they'd be joined to one more than there are cores, and the last would run alone
    spark = rows.sparkSession
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return sent.repartition(parts, "owner").sortWithinPartitions("owner", "place", "source", "url", "article", "title").mapInArrow(_fold, RECORD)
