"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are normalised to lower-cased runs of letters and digits with single blanks. An item
of m characters may differ by e = floor(ERROR_RATE * m) edits; cut into e + 1 pieces, at least one
piece must then occur unchanged. An automaton over all pieces finds them, and Myers' bit-parallel
distance verifies the item around each hit. An item too short for any edit must stand between word ends.
Items go to the workers in blocks of bounded size, one block after the other: no worker holds two automata,
and a block's broadcast is gone before the next.

Defined results: null, empty and symbol-only texts or items match nothing; repeated items each match,
repeated rows each count. Null ids are carried along. An empty benchmark leaves all documents. Columns
other than doc_id and text pass through ``decontaminate``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, read_table, stored, strings

#: Edits per character of an item.
ERROR_RATE = 0.08
#: Characters of the items in one block (one broadcast, one pass over the documents).
BLOCK_CHARS = 4_000_000

_RUNS = re.compile(r"[^\W_]+")


def normalised(text: str) -> str:
    return " ".join(_RUNS.findall(text.lower()))


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """(offset, piece): edits + 1 parts of nearly equal length."""
    cuts = [len(item) * k // (edits + 1) for k in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(masks: dict[str, int], m: int, text: str, edits: int) -> tuple[int, int] | None:
    """(distance, end) of the best place of the pattern in ``text``, None if beyond ``edits``."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, now, best, at = full, 0, m, edits + 1, -1
    get = masks.get
    for k, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            now += 1
        elif mh & top:
            now -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if now < best:
            best, at = now, k + 1
            if not best:
                break
    return (best, at) if at >= 0 else None


class Matcher:
    """All items of one block."""

    def __init__(self, items: list[tuple[int | None, str]], error_rate: float = ERROR_RATE):
        import ahocorasick

        self.items = []
        places: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            item = normalised(text or "")
            if not item:
                continue
            edits = int(error_rate * len(item))
            masks: dict[str, int] = {}
            for k, c in enumerate(item):
                masks[c] = masks.get(c, 0) | 1 << k
            for offset, piece in pieces(item, edits):
                places.setdefault(piece, []).append((len(self.items), offset))
            self.items.append((item_id, item, edits, masks))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int | None, int, int]]:
        """(item id, distance, start of the search window) of each item that occurs, at its best place."""
        if not self.items:
            return []
        body = normalised(text)
        hits: dict[int, set[int]] = {}
        for end, (n, where) in self.automaton.iter(body):
            for k, offset in where:
                hits.setdefault(k, set()).add(end + 1 - n - offset)
        out = []
        for k, starts in hits.items():
            item_id, item, edits, masks = self.items[k]
            places = (s for s in sorted(starts) if s >= 0 and body.startswith(item, s))
            if not edits:
                places = (s for s in places if (not s or body[s - 1] == " ") and body[s + len(item) : s + len(item) + 1] in ("", " "))
            exact = next(places, None)
            if exact is not None:
                out.append((item_id, 0, exact))
            if exact is not None or not edits:
                continue
            best, done = None, -len(item)  # a text may begin inside the item: hits down to 1 - len(item)
            for s in sorted(starts):
                if s <= done:  # within the window that was searched last
                    continue
                a, b = max(0, s - edits), s + len(item) + 2 * edits
                done = s + edits
                found = myers(masks, len(item), body[a:b], edits)
                if found and (best is None or found[0] < best[0]):
                    best = (found[0], max(0, a + found[1] - len(item)))
            if best:
                out.append((item_id, *best))
        return out


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int | None, str]]]:
    """The items in blocks whose size is checked first."""
    slim = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = slim.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // block_chars)
    for k in range(n):
        rows = slim.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        if rows:
            yield [(r["item_id"], r["text"]) for r in rows]


_held: list = []


def _matcher(items: list, error_rate: float) -> Matcher:
    """The block's matcher; a worker keeps the last one from task to task."""
    if not _held or _held[0] is not items or _held[1] != error_rate:
        _held[:] = [items, error_rate, Matcher(items, error_rate)]
    return _held[2]


def matches(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, start): items that occur in a document, at their best place."""
    spark = docs.sparkSession
    prepare(spark)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, distance int, start long"

    def scan(shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(shared.value, error_rate)
            for batch in batches:
                ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
                rows = [(doc, *found) for doc, text in zip(ids, strings(batch, "text").to_pylist()) for found in matcher.find(text)]
                columns = list(zip(*rows)) or [()] * 4
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "item_id", "distance", "start"])

        return slim.mapInArrow(run, schema)

    parts: list[DataFrame] = []
    for shared, more in _shared_blocks(docs, benchmark, block_chars):
        parts.append(stored(scan(shared), "benchmark-matches") if more else scan(shared))
        if more:
            shared.destroy()
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def _shared_blocks(docs: DataFrame, benchmark: DataFrame, block_chars: int) -> Iterator[tuple[Broadcast, bool]]:
    """Each block as a broadcast, and whether another one follows."""
    blocks = _blocks(benchmark, block_chars)
    items = next(blocks, None)
    while items is not None:
        following = next(blocks, None)
        yield docs.sparkSession.sparkContext.broadcast(items), following is not None
        items = following


def decontaminate(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` without those in which an item occurs; nothing is shuffled. After each block but the last the
    documents left are written."""
    prepare(docs.sparkSession)
    for shared, more in _shared_blocks(docs, benchmark, block_chars):

        def run(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(shared.value, error_rate)
            for batch in batches:
                keep = [not matcher.find(text) for text in strings(batch, "text").to_pylist()]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        if more:
            docs = stored(docs, "decontaminated")
            shared.destroy()
    return docs


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
