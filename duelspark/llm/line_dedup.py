"""Line dedup: range-partitioned line hashes, first occurrences found by streaming.

Line hashes (128 bits) with document and position are range-partitioned and sorted by (hash,
document, position). Each sorted partition is streamed once with constant memory. A hash may run
over several partitions (a hot line is split by document and position); the rows of a partition's
leading run are decided by the least document among the partitions' edges, of which there are two
per partition. What comes back is a compressed bitmap of kept lines per document, not text.

Defined results: a null text is one empty line; keys shorter than ``min_chars`` code points are
never dropped; rows that share doc_id count as one document, so a repeated row keeps its lines
where its doc_id is the smallest holder. Rows without doc_id hold no line against others and keep
all lines. Empty tables give empty results; columns other than doc_id and text pass through.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free, prepare, read_table, stored, strings, width

MIN_CHARS = 10
#: Fixed: the white space that a line's key loses at both ends.
BLANK = " \t\n\x0b\x0c\r"

_LINES = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("body", pa.int64()), ("pos", pa.int32())])
_FOUND = pa.schema([("kind", pa.int8()), *_LINES])
_DROP, _HEAD, _EDGE = 0, 1, 2


def line_keys(text: str, min_chars: int) -> Iterator[tuple[int, bytes]]:
    """(position, digest) of each line whose key is long enough."""
    for pos, line in enumerate(text.split("\n")):
        key = line.strip(BLANK)
        if len(key) >= min_chars:  # on bytes, lower() changes A-Z only
            yield pos, xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass").lower())


def body_hash(text: str) -> int:
    """Tells rows of one doc_id with different texts apart."""
    return int.from_bytes(xxhash.xxh3_64_digest(text.encode("utf-8", "surrogatepass")), "big", signed=True)


def _explode(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, docs, bodies, places = [], [], [], []
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            for doc, text in zip(ids, strings(batch, "text").to_pylist()):
                if doc is None:
                    continue
                body = body_hash(text)
                for pos, digest in line_keys(text, min_chars):
                    digests.append(digest)
                    docs.append(doc)
                    bodies.append(body)
                    places.append(pos)
            both = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
            arrays = [pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(docs, pa.int64()), pa.array(bodies, pa.int64()), pa.array(places, pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, schema=_LINES)

    return run


def _first_occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sorted partition: rows that lose to a smaller document here, the leading run, the edges."""
    seen = None  # hash of the run that the last batch ended in, and its first document
    first_doc, leading = 0, True
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, doc = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        n = len(h1)
        new = np.ones(n, bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        began = seen is None
        new[0] = began or (h1[0], h2[0]) != seen
        run = np.cumsum(new) - 1
        firsts = doc[new]
        if new[0]:
            owner = firsts[run]
        else:
            owner = np.concatenate([[first_doc], firsts])[run + 1]
        head = np.zeros(n, bool)
        if leading:
            limit = int(np.flatnonzero(new)[int(began)]) if new.sum() > int(began) else n
            head[:limit] = True
            if began:
                edge = [pa.array([x]) for x in (h1[0], h2[0], doc[0])]
                yield _rows(_EDGE, edge[0], edge[1], edge[2], pa.array([0]), pa.array([0], pa.int32()))
            leading = limit == n
        for kind, chosen in ((_HEAD, head), (_DROP, ~head & (owner != doc))):
            if chosen.any():
                part = batch.filter(pa.array(chosen))
                yield _rows(kind, *(part.column(k) for k in range(5)))
        seen, first_doc = (h1[-1], h2[-1]), int(owner[-1])
    if seen is not None:
        edge = [pa.array([x]) for x in (seen[0], seen[1], first_doc)]
        yield _rows(_EDGE, edge[0], edge[1], edge[2], pa.array([0]), pa.array([0], pa.int32()))


def _rows(kind: int, *columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), kind, np.int8)), *columns], schema=_FOUND)


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, body, pos) of every line that a smaller document holds already."""
    spark = docs.sparkSession
    prepare(spark)
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _explode(min_chars), "h1 long, h2 long, doc_id long, body long, pos int"
    )
    keys = ["h1", "h2", "doc_id", "pos"]
    ordered = lines.repartitionByRange(width(spark), *keys).sortWithinPartitions(*keys)
    found = stored(ordered.mapInArrow(_first_occurrences, "kind byte, h1 long, h2 long, doc_id long, body long, pos int"), "lines")
    edges = found.filter(F.col("kind") == _EDGE).groupBy("h1", "h2").agg(F.min("doc_id").alias("owner"))
    heads = found.filter(F.col("kind") == _HEAD).join(F.broadcast(edges), ["h1", "h2"])  # at most two edges a partition
    late = heads.filter(F.col("doc_id") != F.col("owner"))
    return found.filter(F.col("kind") == _DROP).select("doc_id", "body", "pos").unionByName(late.select("doc_id", "body", "pos"))


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by document and position: one compressed bitmap of dropped lines per document."""
    schema = pa.schema([("doc_id", pa.int64()), ("body", pa.int64()), ("bitmap", pa.binary())])
    held: tuple[int, int] | None = None
    places: list[np.ndarray] = []

    def made() -> pa.RecordBatch:
        at = np.concatenate(places)
        bits = np.zeros(int(at.max()) + 1, np.uint8)
        bits[at] = 1
        return pa.RecordBatch.from_arrays([pa.array([held[0]]), pa.array([held[1]]), pa.array([zlib.compress(np.packbits(bits).tobytes(), 1)])], schema=schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        doc, body, pos = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        cut = np.flatnonzero((doc[1:] != doc[:-1]) | (body[1:] != body[:-1])) + 1
        for a, b in zip([0, *cut], [*cut, len(doc)]):
            key = (int(doc[a]), int(body[a]))
            if held is not None and key != held:
                yield made()
                places = []
            held = key
            places.append(pos[a:b])
    if held is not None:
        yield made()


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, body, bitmap): documents that lose lines, a set bit for each dropped line, zlib-compressed."""
    drops = repeated_lines(docs, min_chars)
    ordered = drops.repartition(width(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "body", "pos")
    return ordered.mapInArrow(_bitmaps, "doc_id long, body long, bitmap binary")


def _attach(docs: DataFrame, min_chars: int) -> tuple[DataFrame, str]:
    """``docs`` with the bitmaps of each row's doc_id as a last column, and that column's name."""
    key, name = free(docs, "__doc"), free(docs, "__maps")
    maps = keep_bitmaps(docs, min_chars).select(F.col("doc_id").alias(key), F.struct("body", "bitmap").alias("entry"))
    grouped = maps.groupBy(key).agg(F.map_from_entries(F.collect_list("entry")).alias(name))
    return docs.join(grouped, docs["doc_id"].cast("long") == F.col(key), "left").drop(key), name


def _kept(text: str, maps: list | None) -> tuple[list[str], int]:
    lines = text.split("\n")
    if maps:
        body = body_hash(text)
        for key, packed in maps:
            if key == body:
                bits = np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8))[: len(lines)]
                drop = np.zeros(len(lines), bool)
                drop[: len(bits)] = bits.astype(bool)
                return [x for x, gone in zip(lines, drop) if not gone], len(lines)
    return lines, len(lines)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the lines dropped from ``text``; all other columns as they were."""
    names = docs.columns
    attached, name = _attach(docs, min_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = batch.column(len(names))
            if maps.null_count == len(maps):
                yield batch.select(names)
                continue
            column = batch.column(batch.schema.get_field_index("text")).to_pylist()
            texts = [x if m is None else "\n".join(_kept(x or "", m)[0]) for x, m in zip(column, maps.to_pylist())]
            out = batch.select(names)
            yield out.set_column(names.index("text"), "text", pa.array(texts, pa.string()))

    return attached.select(*names, name).mapInArrow(run, docs.schema)


def line_digest(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, kept_sha256 of the kept lines joined by a newline."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            maps = batch.column(batch.schema.get_field_index(name)).to_pylist()
            for text, m in zip(strings(batch, "text").to_pylist(), maps):
                lines, n = _kept(text, m)
                rows.append((n, n - len(lines), hashlib.sha256("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest()))
            n, gone, sha = zip(*rows) if rows else ((), (), ())
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], schema=schema)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    attached, name = _attach(slim, min_chars)
    return attached.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digest(read_table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, line, pos,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
owners AS (SELECT k, min(doc_id) AS owner FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
judged AS (SELECT keyed.doc_id, line, pos, coalesce(owner <> keyed.doc_id, false) AS gone FROM keyed LEFT JOIN owners USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, sum(gone::INT)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
