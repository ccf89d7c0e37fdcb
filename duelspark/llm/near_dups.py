"""MinHash near-dedup by fast similarity sketching, banding and exact verification.

A document's set is its distinct 5-word shingles. The sketch has ``COORDINATES`` bins: round i throws
every element at a hashed bin with the value i + hash; after as many rounds, round i fills bin
i - COORDINATES by force, so every bin is filled, and a document stops at the first round that leaves
none empty. Equal sets are one class (128-bit hash of the set). Bands of four bins give candidates.

Links are found without pairing up a bucket's members: round 1 verifies each member against its
bucket's least member on full sets. Buckets whose members then lie in several components are looked
at again: members outside the bucket's largest component meet all others in blocks of bounded size.
A block with few pairs that may be linked, by their sketches, hands these over to be verified; a
block with many gets its members' texts and verifies them where they are, by an inverted list of the
block's shingles, and hands over only a forest of links. So no pair of linked texts that shares a
bucket ends in different components; a pair at the threshold shares none with probability under 1e-5.

Defined results: a null or empty text has an empty set and no links; rows that share doc_id are one
document for links (a row keeps its own n_shingles); rows without doc_id are never linked, have no
component and are kept. Repeated rows and ties take the least doc_id. Empty tables give empty results.
Columns other than doc_id and text pass through ``dedup``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, free, mix, prepare, read_table, spans, stored, strings, windows

SHINGLE = 5
COORDINATES, BAND = 128, 4
#: Linked: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Equal sketch bins (of 128) below which a pair at the threshold lies with probability under 1e-9.
LEAST_EQUAL = 66
#: Members of one verification group, and of either side of a block of an unresolved bucket.
GROUP, BLOCK = 64, 1024
#: A block with more likely pairs than this times its members is verified in place.
DENSE = 2
_BASE = 0xDA942042E4DD58B5
_NONE = np.uint64((1 << 64) - 1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of consecutive texts, sorted within each, and the texts' bounds."""
    words = Words(data, offsets)
    h, bounds, counts = words.hashes(lower=True), words.bounds, words.counts()
    grams = windows(h, k, _BASE)
    sets = []
    for a, n in zip(bounds[:-1], counts):
        if n >= k:
            sets.append(np.unique(grams[a : a + n - k + 1]))
        elif n:
            sets.append(windows(np.append(h[a : a + n], np.uint64(n)), n + 1, _BASE))
        else:
            sets.append(np.empty(0, np.uint64))
    return (np.concatenate(sets) if sets else np.empty(0, np.uint64)), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def sketches(items: np.ndarray, bounds: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """A (texts, t) table of sketch values; texts without items keep the largest value."""
    n = len(bounds) - 1
    out = np.full((n, t), _NONE, np.uint64)
    flat = out.reshape(-1)
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(n), sizes)
    open_ = sizes > 0
    for i in range(2 * t):
        if not len(owner):
            break
        h = mix(items, 1000 + i)
        value = (np.uint64(i) << np.uint64(48)) | (h >> np.uint64(16))
        at = owner * t + ((h & np.uint64(0xFFFF)) % np.uint64(t)).astype(np.int64) if i < t else owner * t + (i - t)
        np.minimum.at(flat, at, value)
        if i >= t and i < 2 * t - 1 and i % 8:
            continue
        open_ &= (out == _NONE).any(axis=1)
        stay = open_[owner]
        if not stay.all():
            items, owner = items[stay], owner[stay]
    return out


def band_keys(table: np.ndarray, rows: int = BAND) -> np.ndarray:
    """(texts, bands) hashes of consecutive bins, salted with the band's number."""
    n, t = table.shape
    grouped = mix(table, 31).reshape(n, t // rows, rows)
    key = np.broadcast_to(np.arange(t // rows, dtype=np.uint64), (n, t // rows)).copy()
    for r in range(rows):
        key = mix(key * np.uint64(_BASE) + grouped[:, :, r], 32 + r)
    return key


_SKETCH = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = strings(batch, "text")
        doc = batch.column(batch.schema.get_field_index("doc_id"))
        for a, b, data, offsets in spans(column):
            items, bounds = shingle_sets(data, offsets)
            sizes = np.diff(bounds)
            table = sketches(items, bounds)
            both = [np.add.reduceat(np.append(mix(items, s), np.uint64(0)), np.minimum(bounds[:-1], len(items))) for s in (61, 62)]
            h1, h2 = (np.where(sizes > 0, x, np.uint64(0)).astype(np.int64) for x in both)
            keys = band_keys(table).astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32)), pa.array(keys.reshape(-1)))
            small = (mix(table, 33) & np.uint64(0xFF)).astype(np.uint8)
            rows = pa.array([x.tobytes() for x in small], pa.binary())
            yield pa.RecordBatch.from_arrays([doc.slice(a, b - a), pa.array(sizes), pa.array(h1), pa.array(h2), lists, rows], schema=_SKETCH)


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _verified(table: pa.Table) -> pa.Table:
    """One leader and some members with their texts: the links, on full sets."""
    rows = table.to_pylist()
    leaders = [r for r in rows if r["member"] is None]
    members = [r for r in rows if r["member"] is not None]
    own = [_set_of(r["text"]) for r in leaders]
    found = []
    for r in members:
        other = _set_of(r["text"])
        for mine in own:
            inside = len(np.intersect1d(mine, other, assume_unique=True))
            if inside and 100 * inside >= PERCENT * (len(mine) + len(other) - inside):
                found.append((r["leader"], r["member"]))
                break
    return pa.table([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])


def _set_of(text: str | None) -> np.ndarray:
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    return shingle_sets(data, np.array([0, len(data)]))[0]


def verify(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked; ``docs``: doc_id and text of all candidates. A leader's members are dealt out in groups of bounded size."""
    pairs = stored(pairs, "pairs")
    groups = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("groups"))
    salted = pairs.join(groups, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("groups")).alias("salt"))
    asked = salted.select(F.col("b").alias("doc_id"), F.col("a").alias("leader"), "salt", F.col("b").alias("member")).unionByName(
        salted.select(F.col("a").alias("doc_id"), F.col("a").alias("leader"), "salt", F.lit(None).cast("long").alias("member")).distinct()
    )
    texts = docs.join(asked.hint("merge"), "doc_id").select("leader", "salt", "member", "text")
    return texts.groupBy("leader", "salt").applyInArrow(_verified, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node with a link: alternating star contraction to the least node."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    held = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = stored(small, "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == held:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        held = now


def _across(table: pa.Table) -> pa.Table:
    """Likely links of one block between components; if many, one row without ids stands for the block."""
    stray = table.column("stray").to_numpy(zero_copy_only=False)
    node, comp = table.column("node").to_numpy(), table.column("component").to_numpy()
    every = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(table), -1)
    others, theirs, ids = every[~stray], comp[~stray], node[~stray]
    a, b = [], []
    for k in np.flatnonzero(stray):
        near = np.flatnonzero(((every[k] == others).sum(axis=1) >= LEAST_EQUAL) & (theirs != comp[k]))
        a.append(np.minimum(node[k], ids[near]))
        b.append(np.maximum(node[k], ids[near]))
    a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b))
    place = {c: table.column(c)[0].as_py() for c in ("key", "i", "j")}
    if len(a) > DENSE * len(table):
        return pa.table({**{c: [v] for c, v in place.items()}, "a": pa.array([None], pa.int64()), "b": pa.array([None], pa.int64())})
    return pa.table({**{c: np.full(len(a), v) for c, v in place.items()}, "a": a, "b": b})


def _verified_block(table: pa.Table) -> pa.Table:
    """A forest of the links between the components of one block, on full sets."""
    stray = table.column("stray").to_numpy(zero_copy_only=False)
    node, comp = table.column("node").to_numpy(), table.column("component").to_numpy()
    texts = table.column("text").to_pylist()
    rows = np.flatnonzero(~stray)
    sets = [_set_of(texts[k]) for k in rows]
    sizes = np.array([len(x) for x in sets])
    items, owner = np.concatenate([*sets, np.empty(0, np.uint64)]), np.repeat(np.arange(len(rows)), sizes)
    by = np.argsort(items, kind="stable")
    items, owner = items[by], owner[by]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = x = parent.get(parent[x], parent[x])
        return x

    found = []
    for k in np.flatnonzero(stray):
        mine = _set_of(texts[k])
        low, high = np.searchsorted(items, mine), np.searchsorted(items, mine, "right")
        n = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        inside = np.bincount(owner[at], minlength=len(rows))
        for x in np.flatnonzero((inside > 0) & (100 * inside >= PERCENT * (sizes + len(mine) - inside)) & (comp[rows] != comp[k])):
            p, q = root(int(comp[k])), root(int(comp[rows[x]]))
            if p != q:
                parent[p] = q
                found.append(sorted((int(node[k]), int(node[rows[x]]))))
    return pa.table([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])


def blocks_of(members: DataFrame, comps: DataFrame) -> DataFrame:
    """(key, i, j, node, component, stray): the buckets with several components, cut into blocks.

    In block (i, j) the i-th part of the bucket's strays, those outside its largest component, meets the j-th part of all."""
    label = members.join(comps, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    sizes = label.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    split = sizes.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("m"), F.max("n").alias("most"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    inside = label.join(split, "key").withColumn("rows", F.ceil((F.col("m") - F.col("most")) / BLOCK)).withColumn("columns", F.ceil(F.col("m") / BLOCK))
    one = lambda i, j, stray: F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"), F.lit(stray).alias("stray"))
    place = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), n)
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    as_member = F.transform(upto(F.col("rows")), lambda i: one(i, place(F.col("columns"), 1), False))
    as_stray = F.transform(upto(F.col("columns")), lambda j: one(place(F.col("rows"), 2), j, True))
    dealt = F.when(F.col("component") != F.col("main"), F.concat(as_member, as_stray)).otherwise(as_member)
    return inside.select("key", "node", "component", F.inline(dealt))


def links_across(docs: DataFrame, members: DataFrame, comps: DataFrame, sketch: DataFrame) -> DataFrame | None:
    """Verified links between components that share a bucket; None if no pair is likely."""
    blocks = blocks_of(members, comps)
    cell = ["key", "i", "j"]
    likely = stored(blocks.join(sketch, "node").groupBy(*cell).applyInArrow(_across, "key long, i long, j long, a long, b long"), "likely")
    if likely.isEmpty():
        return None
    few = verify(docs, likely.filter("a is not null").select("a", "b").distinct())
    inside = blocks.join(likely.filter("a is null").select(*cell), cell, "left_semi")
    many = docs.withColumnRenamed("doc_id", "node").join(inside.hint("merge"), "node").groupBy(*cell).applyInArrow(_verified_block, "a long, b long")
    return few.unionByName(many).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each of ``docs``."""
    spark = docs.sparkSession
    prepare(spark)
    slim = _slim(docs)
    sketch = stored(slim.mapInArrow(_sketched, "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>, sketch binary"), "sketches")
    known = sketch.filter("doc_id is not null and n_shingles > 0")
    classes = stored(known.groupBy("h1", "h2").agg(F.min("doc_id").alias("node")), "classes")
    heads = known.join(classes, ["h1", "h2"], "left_semi").join(classes.select("h1", "h2", F.col("node").alias("doc_id")), ["h1", "h2", "doc_id"], "left_semi")
    heads = heads.select(F.col("doc_id").alias("node"), "bands", "sketch").dropDuplicates(["node", "sketch"])
    buckets = heads.select("node", F.explode("bands").alias("key"))
    leaders = buckets.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last")).filter("leader < last").select("key", "leader")
    members = stored(buckets.join(leaders, "key"), "buckets")
    same_doc = known.groupBy("doc_id").agg(F.min(F.struct("h1", "h2")).alias("x"), F.max(F.struct("h1", "h2")).alias("y")).filter("x <> y")
    rows = known.join(same_doc.select("doc_id"), "doc_id", "left_semi").join(classes, ["h1", "h2"])
    shared = rows.select(F.col("node").alias("a"), F.col("doc_id").alias("b"))  # classes that meet in one doc_id
    # texts are moved once, all by doc_id; what follows moves candidates' texts only
    texts = stored(slim.join(members.select(F.col("node").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi"), "candidate-texts")
    links = stored(verify(texts, members.filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()).unionByName(shared), "links")
    comps = stored(components(links), "components")
    sketch_of = heads.select("node", "sketch")
    late = links_across(texts, members.select("key", "node"), comps, sketch_of)
    if late is not None:
        comps = stored(components(links.unionByName(stored(late, "links-across"))), "components")
    owner = classes.join(comps, "node", "left").select("h1", "h2", F.coalesce("component", "node").alias("component_id"))
    joined = sketch.select("doc_id", "n_shingles", "h1", "h2").join(owner, ["h1", "h2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.least("component_id", "doc_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return joined.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents whose component has a smaller doc_id; rows without doc_id stay."""
    name = free(docs, "__gone")
    gone = stored(near_duplicates(docs).filter("not kept").select(F.col("doc_id").alias(name)), "dropped").distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == F.col(name), "left_anti")


def op8_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
