"""MinHash near duplicates by a multi-index Hamming join of b-bit signatures, confirmed on whole shingle sets.

A signature is VALUES minima of BITS bits. It is split into CHUNKS; two signatures that differ in at most
CHUNKS * (ERRORS + 1) - 1 values agree, by pigeonhole, in some chunk but for ERRORS values. Each chunk is therefore
indexed once for every choice of ERRORS values left out, and such pairs always share a key. (At a similarity of 0.85 a
pair shares no key with a probability of 6e-6, at 0.8 of 2e-4; similarities at which it is over MISSED are refused.) The pairs that are compared on whole sets are those that share a key, in groups of
every size; pairs that are connected already are passed over.

What is emitted is never all pairs of a group:

1. Equal sets become one node (the smallest doc_id) before anything else.
2. A task joins the nodes of its batch that share a key to the smallest of them, and passes on one row a key and batch:
   a key held by a third of all rows reaches the shuffle as one row a batch. Nodes that meet nobody are done. Nodes that reach each other are a cluster.
3. Tiles of bounded size: a cluster, if it fits; of a larger one, the nodes whose home is the same key (that which most others hold), dealt by a
   hash. A tile's nodes are linked within; a home's tiles meet its first tile. So a group of like nodes is one component by now.
4. Of the keys of larger clusters whose nodes lie in several components, the nodes outside the key's largest component meet each other and that
   one, in tiles of about equal set sizes: sets too unlike in size for a link never meet. This ends it: no pair is left that shares a key and isn't connected or compared.
5. Nodes are compared by counting one node's shingles in all others at once. Only links that connect what is not yet connected are emitted:
   fewer than a task has nodes.

Defined results: texts without words have no shingles, no links and themselves as component; texts of any length count with their whole set, one text's set in
memory at a time; null doc_id is never linked and has a null component (kept); ties in a size, key or home are decided by the smaller id or key; rows
that repeat a doc_id are one document, linked by any of its texts; an empty table gives no rows; other columns are ignored by
groups() and kept by clean(), whatever their names. clean() never drops a text for its doc_id alone: of rows that repeat a doc_id with texts unlike,
every different text stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, flat_text, meet, save, ship, slices, tidy
from .components import components
from .shingles import VALUES, digest, mix, sets, shingle_hashes, signature, word_hashes

#: Links: 100 * common >= percent * all shingles of both; PERCENT unless a caller gives another. Chunks of a signature, values that may differ in one.
PERCENT, CHUNKS, ERRORS = 85, 8, 1
#: Nodes of a tile and shingles of a tile, about.
TILE, TILE_SHINGLES = 1024, 1 << 20
WIDTH = VALUES // CHUNKS
#: How likely a pair at the similarity that is asked for may share no key, at most.
MISSED = 1e-3

_KEY = np.random.default_rng(77).integers(1, 2**64, (CHUNKS, WIDTH), dtype=np.uint64) | np.uint64(1)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offs = flat_text(batch.column("text"))
        for lo, hi in slices(np.diff(offs)):
            hashes, at = shingle_hashes(*word_hashes(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]), hi - lo)
            signs = signature(hashes, at)
            different = [np.unique(hashes[at[k] : at[k + 1]]) for k in range(hi - lo)]
            digests = [digest(d) for d in different]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").slice(lo, hi - lo), pa.array([len(d) for d in different], pa.int64()),
                pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()), pa.array([s.tobytes() for s in signs], pa.binary()),
            ], ["doc_id", "n_shingles", "set_a", "set_b", "sig"])
    tidy()


def keys(signs: np.ndarray) -> np.ndarray:
    """The keys of each signature: of every chunk, each choice of one value left out (ERRORS = 1)."""
    out = np.empty((len(signs), CHUNKS * WIDTH), np.uint64)
    wide = signs.astype(np.uint64) + np.uint64(1)
    for c in range(CHUNKS):
        terms = mix(wide[:, c * WIDTH : (c + 1) * WIDTH] * _KEY[c])
        whole = terms.sum(1, dtype=np.uint64)
        for e in range(WIDTH):
            out[:, c * WIDTH + e] = mix(whole - terms[:, e] + np.uint64(c * WIDTH + e + 1))
    return out


def _signs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, VALUES)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of nodes of a batch with the smallest that shares a key (key null), and that smallest for each key."""
    for batch in batches:
        nodes = batch.column("node").to_numpy()
        all_keys = keys(_signs(batch.column("sig")))
        flat, owner = all_keys.reshape(-1), np.repeat(nodes, all_keys.shape[1])
        order = np.lexsort((owner, flat))
        flat, owner = flat[order], owner[order]
        new = np.concatenate([[True], flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, bool)
        lowest = owner[new][np.cumsum(new) - 1]
        met = owner != lowest
        pairs = np.unique(np.stack([lowest[met], owner[met]]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.nulls(pairs.shape[1], pa.int64()), pa.array(pairs[0], pa.int64()), pa.array(pairs[1], pa.int64())], ["key", "a", "b"])
        yield pa.RecordBatch.from_arrays([pa.array(flat[new].view(np.int64)), pa.array(owner[new], pa.int64()), pa.nulls(int(new.sum()), pa.int64())], ["key", "a", "b"])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        all_keys = keys(_signs(batch.column("sig")))
        each = [np.repeat(batch.column(n).to_numpy(), all_keys.shape[1]) for n in ("node", "n_shingles")]
        yield pa.RecordBatch.from_arrays([pa.array(all_keys.reshape(-1).view(np.int64)), *(pa.array(e, pa.int64()) for e in each)], ["key", "node", "n_shingles"])


def spanning(node: np.ndarray, label: np.ndarray, sig: np.ndarray, hashes: list[np.ndarray], guest: np.ndarray | None, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that connect all similar nodes that share a key and have different labels: of every node with every other, or of guests with the rest.

    A node's shingles are marked in an array over all shingles of the task; sums of the marks over the others' lists are the
    sizes of all intersections at once.
    """
    sizes = np.array([len(h) for h in hashes])
    label = np.unique(label, return_inverse=True)[1]
    if label.max() == 0:
        return []
    _, ids = np.unique(np.concatenate(hashes), return_inverse=True)
    begin = np.cumsum(sizes) - sizes
    mark = np.zeros(ids.max() + 1, np.int32)
    out = []
    for g in range(len(node)) if guest is None else np.flatnonzero(guest).tolist():
        others = np.arange(g) if guest is None else np.flatnonzero(~guest)
        others = others[label[others] != label[g]]
        others = others[100 * np.minimum(sizes[others], sizes[g]) >= percent * np.maximum(sizes[others], sizes[g])]
        differ = (sig[others] != sig[g]).reshape(-1, CHUNKS, WIDTH).sum(2)
        others = others[differ.min(1) <= ERRORS] if len(others) else others
        if not len(others):
            continue
        mine = ids[begin[g] : begin[g] + sizes[g]]
        mark[mine] = 1
        each = sizes[others]
        take = np.repeat(begin[others], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        common = np.add.reduceat(mark[ids[take]], np.cumsum(each) - each)
        mark[mine] = 0
        for o in others[100 * common >= percent * (each + sizes[g] - common)].tolist():
            if label[o] != label[g]:
                out.append((int(min(node[o], node[g])), int(max(node[o], node[g]))))
                label[label == label[o]] = label[g]
    return out


def _runs(percent: int):
    """Rows (meeting, guest, node, label, sig, hashes) come sorted by meeting; those of a meeting are a call of spanning(): of its guests with the others,
    or without guests of all."""

    def links_of(rows: pa.Table) -> list[tuple[int, int]]:
        guest = rows["guest"].to_numpy(zero_copy_only=False).astype(bool)
        if guest.all():  # whom they should meet has gone into no row
            return []
        hashes = [np.frombuffer(h.as_buffer(), np.uint64) for h in rows["hashes"]]
        signs = np.frombuffer(b"".join(rows["sig"].to_pylist()), np.uint16).reshape(-1, VALUES)
        return spanning(rows["node"].to_numpy(), rows["label"].to_numpy(), signs, hashes, guest if guest.any() else None, percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        last = None

        def emit() -> Iterator[pa.RecordBatch]:
            found = links_of(pa.Table.from_batches(parts)) if sum(p.num_rows for p in parts) > 1 else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

        for batch in batches:
            meeting = batch.column("meeting").to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(meeting[1:] != meeting[:-1]) + 1, [batch.num_rows]])
            for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if parts and meeting[i] != last:
                    yield from emit()
                    parts = []
                parts.append(batch.slice(i, j - i))
                last = meeting[i]
        if parts:
            yield from emit()
        parts.clear()
        tidy()

    return run


def _linked(rows: DataFrame, percent: int) -> DataFrame:
    """Links of all meetings; a saved table."""
    ready = rows.select("meeting", "guest", "node", "label", "sig", "hashes").repartition("meeting").sortWithinPartitions("meeting")
    return save(ready.mapInArrow(_runs(percent), "a bigint, b bigint"), "links")


def _tiles():
    """How many tiles a group needs (aggregate of its nodes)."""
    return F.ceil(F.greatest(F.count(F.lit(1)) / TILE, F.sum("n_shingles") / TILE_SHINGLES)).cast("bigint")


def _labelled(rows: DataFrame, links: list[DataFrame]) -> DataFrame:
    """rows with the component of their node by the links so far."""
    found = links[0]
    for more in links[1:]:
        found = found.union(more)
    return rows.join(components(found).select(F.col("id").alias("node"), F.col("component").alias("of")), "node", "left").withColumn("label", F.coalesce("of", "node")).drop("of")


def _leftover(keyed: DataFrame, percent: int) -> DataFrame:
    """(meeting, guest, node, label) of the nodes of keys (key, node, n_shingles, label) that lie in several components."""
    by_label = keyed.groupBy("key", "label").agg(F.count(F.lit(1)).alias("many"))
    largest = by_label.groupBy("key").agg(F.max(F.struct("many", F.negative("label").alias("minus"))).alias("top"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    # a set and those that it may link with lie in the same or in neighbouring classes of size
    size = F.floor(F.log(F.col("n_shingles").cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9).cast("bigint")
    largest = save(largest.select("key", F.negative("top.minus").alias("major"), F.col("top.many").alias("weight")), "largest")
    found = meet(keyed, largest, "key", "weight", F.xxhash64("node")).where("major IS NOT NULL")
    members = save(found.select("key", "node", "label", "n_shingles", (F.col("label") == F.col("major")).alias("inner"), size.alias("size")), "members")
    slots = save(members.groupBy("key", "inner", "size").agg(_tiles().alias("tiles"), F.count(F.lit(1)).alias("weight")), "slots")
    place = lambda inner, size, turn: F.xxhash64("key", inner, size, turn)
    turns = lambda tiles: F.explode(F.sequence(F.lit(0).cast("bigint"), tiles - 1))
    other = slots.select("key", F.col("inner").alias("inner2"), F.col("size").alias("size2"), F.col("tiles").alias("tiles2"))
    near = F.abs(F.col("size") - F.col("size2")) <= 1
    once = F.col("inner2") | (F.col("size2") >= F.col("size"))
    pairs = slots.where("NOT inner").join(other, "key").where(near & once)
    pairs = pairs.withColumn("turn", turns(F.col("tiles"))).withColumn("turn2", turns(F.col("tiles2"))).where(F.col("inner2") | (F.col("size2") > F.col("size")) | (F.col("turn2") >= F.col("turn")))
    meetings = save(pairs.select(place("inner", "size", "turn").alias("host"), place("inner2", "size2", "turn2").alias("guest_tile")).distinct(), "meetings")
    slot = F.struct("key", "inner", "size").alias("slot")
    dealt = meet(members.select("node", "label", slot), slots.select(slot, "tiles", "weight"), "slot", "weight", F.xxhash64("node")).select("node", "label", "tiles", "slot.*")
    tiled = dealt.select("node", "label", place("inner", "size", F.pmod(F.xxhash64("node"), F.col("tiles"))).alias("tile"))
    meeting = F.xxhash64("host", "guest_tile").alias("meeting")
    hosts = tiled.join(meetings, F.col("tile") == F.col("host")).select(meeting, F.lit(False).alias("guest"), "node", "label")
    guests = tiled.join(meetings.where("host <> guest_tile"), F.col("tile") == F.col("guest_tile")).select(meeting, F.lit(True).alias("guest"), "node", "label")
    return hosts.union(guests)


def links(docs: DataFrame, measured: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Confirmed links (a, b) that connect all that is similar and shares a key; a saved table."""
    one = measured.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)).groupBy("doc_id", "set_a", "set_b").agg(F.min(F.struct("n_shingles", "sig")).alias("s"))
    nodes = save(one.groupBy("set_a", "set_b").agg(F.min(F.struct("doc_id", "s.n_shingles", "s.sig")).alias("m")).select("set_a", "set_b", F.col("m.doc_id").alias("doc_id"), F.col("m.doc_id").alias("node"), "m.n_shingles", "m.sig"), "nodes")
    # a document of several rows may lend its id to one set only; its others get numbers beyond all ids
    several = save(nodes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("set_a", "set_b")).alias("first")).where("n > 1").select("doc_id", "first"), "several")
    if several.limit(1).count():
        beyond = F.lit(1 << 62) + F.pmod(F.xxhash64("set_a", "set_b"), F.lit(1 << 61))
        own = F.col("first").isNull() | (F.col("first") == F.struct("set_a", "set_b"))
        numbered = save(nodes.join(several, "doc_id", "left").withColumn("node", F.when(own, F.col("doc_id")).otherwise(beyond)).select(*nodes.columns), "nodes")
        drop(nodes)
        nodes = numbered
    copies = one.select("doc_id", "set_a", "set_b").join(nodes.select("set_a", "set_b", "node"), ["set_a", "set_b"]).where("doc_id <> node").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))

    met = save(nodes.select("node", "sig").mapInArrow(_meet, "key bigint, a bigint, b bigint"), "met")
    # at most a row a batch of nodes for each key
    by_key = met.where("key is not null").withColumn("lowest", F.min("a").over(Window.partitionBy("key"))).where("a <> lowest").select(F.col("lowest").alias("a"), F.col("a").alias("b"))
    clusters = components(by_key.union(met.where("key is null").select("a", "b")))
    drop(met)
    involved = save(nodes.join(clusters.select(F.col("id").alias("node"), "component"), "node"), "involved")
    size = save(involved.groupBy("component").agg(_tiles().alias("tiles")), "cluster-sizes")
    wanted = involved.join(size, "component").select("doc_id", "node", "component", "tiles", "sig", "set_a", "set_b")
    sets_of = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(wanted, "doc_id").mapInArrow(_whole, "node bigint, component bigint, tiles bigint, sig binary, hashes binary, n_shingles bigint")
    rows = save(sets_of.dropDuplicates(["node"]), "sets")

    small = rows.where("tiles = 1").select(F.col("component").alias("meeting"), F.lit(False).alias("guest"), "node", F.col("node").alias("label"), "sig", "hashes")
    large = rows.where("tiles > 1")
    found = [_linked(small, percent)]
    if size.where("tiles > 1").limit(1).count():
        keyed = large.select("node", "n_shingles", "sig").mapInArrow(_keyed, "key bigint, node bigint, n_shingles bigint")
        held = save(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("many"), F.count(F.lit(1)).alias("weight"), _tiles().alias("tiles")).where("many > 1"), "held")
        shared = save(meet(keyed, held, "key", "weight", F.xxhash64("node")).where("many IS NOT NULL"), "shared")
        homes = shared.groupBy("node").agg(F.max(F.struct("many", "key", "tiles")).alias("home")).select("node", F.col("home.key").alias("home"), F.pmod(F.xxhash64("node"), F.col("home.tiles")).alias("turn"))
        tiled = save(large.join(homes, "node").select("node", "home", "turn", "sig", "hashes"), "tiled")
        within = tiled.select(F.xxhash64("home", "turn").alias("meeting"), F.lit(False).alias("guest"), "node", F.col("node").alias("label"), "sig", "hashes")
        found.append(_linked(within, percent))
        others = tiled.where("turn > 0")
        ends = others.select("home", "turn").distinct()
        hosts = tiled.where("turn = 0").drop("turn").join(ends, "home").withColumn("guest", F.lit(False))
        first = hosts.unionByName(others.withColumn("guest", F.lit(True))).withColumn("meeting", F.xxhash64("home", "turn"))
        found.append(_linked(_labelled(first, found), percent))
        rest = _leftover(_labelled(shared.select("key", "node", "n_shingles"), found), percent)
        found.append(_linked(rest.join(tiled.select("node", "sig", "hashes"), "node"), percent))
        drop(held, shared, tiled)
    out = copies
    for more in found:
        out = out.union(more)
    out = save(out, "links")
    drop(*found, rows, size, involved, nodes, several, clusters)
    return out


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted shingle hashes of the rows whose set is the wanted one."""
    for batch in batches:
        want = list(zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True))
        found = [(k, s) for k, s in sets(batch.column("text")) if digest(s) == want[k]]
        some = pa.array([f[0] for f in found], pa.int64())
        yield pa.RecordBatch.from_arrays([
            *(batch.column(n).take(some) for n in ("node", "component", "tiles", "sig")),
            pa.array([s.tobytes() for _, s in found], pa.binary()), pa.array([len(s) for _, s in found], pa.int64()),
        ], ["node", "component", "tiles", "sig", "hashes", "n_shingles"])


def miss(percent: int) -> float:
    """Probability that a pair of that similarity shares no key: each value agrees with the similarity, a chunk is shared with ERRORS values that don't at most."""
    s = percent / 100
    shared = sum(comb(WIDTH, k) * s ** (WIDTH - k) * (1 - s) ** k for k in range(ERRORS + 1))
    return (1 - shared) ** CHUNKS


def _measured(docs: DataFrame) -> DataFrame:
    ship(docs.sparkSession)
    return save(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_measure, "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, sig binary"), "measured")


def _grouped(docs: DataFrame, measured: DataFrame, percent: int) -> DataFrame:
    if miss(percent) > MISSED:
        raise ValueError(f"at {percent} % a pair shares no key with a probability of {miss(percent):.1g}: more chunks or errors are needed")
    found = links(docs, measured, percent)
    labels = components(found)
    drop(found)
    rows = measured.select("doc_id", "n_shingles").join(labels.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left")
    return rows.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text)."""
    return _grouped(docs, _measured(docs), percent)


def clean(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each group: that of the group's smallest doc_id. All columns as they were."""
    measured = _measured(docs)
    again = measured.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("set_a", "set_b")).alias("low"), F.max(F.struct("set_a", "set_b")).alias("high")).where("n > 1")
    repeats = save(again.select("doc_id", (F.col("low") != F.col("high")).alias("unlike")), "repeats")
    gone = _grouped(docs, measured, percent).where(~F.col("kept")).select("doc_id").distinct().join(repeats.where("unlike"), "doc_id", "left_anti")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    left = rows.join(save(gone, "gone"), "doc_id", "left_anti")
    drop(measured)
    if repeats.limit(1).count():
        ids = repeats.select("doc_id")
        order = Window.partitionBy("doc_id", "text").orderBy(F.to_json("row"))
        first = left.join(ids, "doc_id", "left_semi").withColumn("turn", F.row_number().over(order)).where("turn = 1").drop("turn")
        left = left.join(ids, "doc_id", "left_anti").unionByName(first)
    return left.select("row.*")


ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) END AS s FROM words
), shingles AS (
  SELECT doc_id, unnest(s) AS x FROM sets
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN sets sa ON sa.doc_id = a JOIN sets sb ON sb.doc_id = b WHERE 100 * n >= 85 * (len(sa.s) + len(sb.s) - n)
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) l ON l.a = r.other
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept FROM sets JOIN reach USING (doc_id) GROUP BY doc_id, s
"""
