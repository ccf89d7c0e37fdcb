"""Substring dedup by recompression: words that lie in a repeated window of ``window`` words go.

Texts are packed into chunks once; later rounds move chunks, never rows of words. In each chunk a
fixed number of recompression rounds renames, first, runs of equal symbols and, second, neighbouring
pairs whose sides (a hash bit of the name) are left and right. A name is a hash of what it stands
for, so all chunks give equal passages the same names without talking to each other. Every symbol
carries the words that decided it; where these fit into a window, every copy of that window holds
the same symbol. A window's representative is its highest such symbol (least hash among equals);
single words always fit, so each window has one, in long periodic runs too.

Spark round 1 finds the representatives that occur again anywhere; round 2 compares 128-bit hashes
of the windows around them. Both send one entry per chunk and name (copies within a chunk meet
there), spread over hash ranges, and get back bitmaps over the chunk's sorted entries.

Defined results: a null or empty text has no words. Windows are judged on the input; a repeated row
is another occurrence, whatever its doc_id. Texts shorter than the window lose nothing. An empty
table gives an empty result; columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, mix, prepare, read_table, spans, stored, strings, width, windows

WINDOW = 35
#: Bytes of text in a chunk (a longer document is a chunk by itself).
CHUNK_BYTES = 3 << 20
ROUNDS = 6
#: Chunks whose entries a hash range holds; the number of ranges grows with the input beyond it.
RANGE_CHUNKS = 8
#: Rounds that name runs too (later runs are of longer symbols and rare), and the first round whose
#: symbols may represent a window; windows without one are represented by a single word.
RUN_LEVELS = (1, 3)
LEAST_LEVEL = 4
_BASE_A, _BASE_B = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_FAR = np.int32(1 << 30)
_NONE = np.uint64((1 << 64) - 1)
_LOG2 = np.floor(np.log2(np.maximum(1, np.arange(4096)))).astype(np.int8)


def recompress(names: np.ndarray, doc: np.ndarray, window: int, rounds: int = ROUNDS) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(level, names, first deciding word, end of deciding words) of the symbols decided by at most ``window`` words."""
    n = len(names)
    low = np.arange(n, dtype=np.int32)
    high = low + np.int32(1)
    size = np.ones(n, np.int32)
    for level in range(1, rounds + 1):
        if len(names) < 2:
            return
        same_doc = doc[1:] == doc[:-1]
        if level in RUN_LEVELS:  # a symbol's neighbours decide where its run ends
            joined = (names[1:] == names[:-1]) & same_doc
            first = np.flatnonzero(np.concatenate([[True], ~joined]))
            length = np.diff(np.append(first, len(names)))
            before = np.concatenate([[-_FAR], np.where(same_doc, low[:-1], -_FAR)]).astype(np.int32)
            after = np.concatenate([np.where(same_doc, high[1:], _FAR), [_FAR]]).astype(np.int32)
            lows, highs = np.minimum(low, before), np.maximum(high, after)
            low, high = np.minimum.reduceat(lows, first), np.maximum.reduceat(highs, first)
            size = np.add.reduceat(size, first)
            names = np.where(length > 1, mix(names[first] + length.astype(np.uint64) * np.uint64(_BASE_B), 3), names[first])
            doc = doc[first]
            same_doc = doc[1:] == doc[:-1]
        right = (mix(names, 100 + level) & np.uint64(1)).astype(bool)
        pair = np.concatenate([~right[:-1] & right[1:] & same_doc & (size[1:] + size[:-1] <= window), [False]])
        second = np.concatenate([[False], pair[:-1]])
        before = np.concatenate([[-_FAR], np.where(same_doc, low[:-1], -_FAR)]).astype(np.int32)
        after = np.concatenate([np.where(same_doc, high[1:], _FAR), [_FAR]]).astype(np.int32)
        # a pair is decided by its two symbols; a left one alone by what follows, a right one alone by what precedes
        low_now = np.where(pair | ~right, low, np.minimum(low, before))
        high_now = np.where(pair | ~right, np.maximum(high, after), high)
        following = np.append(names[1:], np.uint64(0))
        made = np.where(pair, mix(names * np.uint64(_BASE_A) + mix(following, 5), 6), names)
        keep = ~second
        low_now = np.where(pair, np.minimum(low_now, np.append(low[1:], _FAR)), low_now)
        names, low, high, doc = made[keep], low_now[keep].astype(np.int32), high_now[keep].astype(np.int32), doc[keep]
        size = (size + np.where(pair, np.append(size[1:], 0), 0))[keep]
        fits = (high - low <= window) & (low > -_FAR) & (high < _FAR)
        if level >= LEAST_LEVEL and fits.any():
            yield level, names[fits], low[fits], high[fits]


def _least(n: int, window: int, deciding: list[tuple[np.ndarray, np.ndarray]], keys: list[np.ndarray]) -> np.ndarray:
    """Per start of a window, the least key of the symbols whose deciding words lie in the window."""
    steps = max(1, int(window).bit_length())
    least = [np.full(n, _NONE, np.uint64) for _ in range(steps)]
    for (low, high), key in zip(deciding, keys):
        a, b = np.maximum(high - window, 0), low  # it lies in the windows that start from a to b
        k = _LOG2[b - a + 1] if window < len(_LOG2) else np.floor(np.log2(b - a + 1)).astype(int)
        for step in range(steps):
            at = np.flatnonzero(k == step)
            if len(at):
                np.minimum.at(least[step], a[at], key[at])
                np.minimum.at(least[step], b[at] - (1 << step) + 1, key[at])
    for step in range(steps - 1, 0, -1):
        half = 1 << step - 1
        np.minimum(least[step - 1], least[step], out=least[step - 1])
        np.minimum(least[step - 1][half:], least[step][:-half], out=least[step - 1][half:])
    return least[0]


class Chunk:
    """Windows of one chunk: where they start, their representatives, the representatives' counts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int = WINDOW):
        words = Words(data, offsets)
        self.counts, self.bounds, self.window = words.counts(), words.bounds, window
        h = words.hashes()
        self.hashes = h
        doc = np.repeat(np.arange(len(self.counts), dtype=np.int32), self.counts)
        n = len(h)
        if n < window:
            self.starts, self.pivots = np.empty(0, np.int64), np.empty(0, np.uint64)
            self.names, self.local = np.empty(0, np.uint64), np.empty(0, bool)
            return
        self.starts = np.flatnonzero(doc[window - 1 :] == doc[: n - window + 1])
        found = list(recompress(h, doc, window))
        keys = [(np.uint64(15 - level) << np.uint64(60)) | (mix(names, 9) >> np.uint64(4)) for level, names, _, _ in found]
        least = _least(n, window, [(low, high) for _, _, low, high in found], keys)
        bare = self.starts[least[self.starts] == _NONE]  # windows without a long symbol: their least word
        if len(bare):
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, bare, 1)
            np.add.at(edge, bare + window, -1)
            words_in = np.flatnonzero(np.cumsum(edge)[:-1]).astype(np.int32)
            word_key = (np.uint64(15) << np.uint64(60)) | (mix(h[words_in], 9) >> np.uint64(4))
            single = _least(n, window, [(words_in, words_in + np.int32(1))], [word_key])
            least[bare] = single[bare]
            keys.append(word_key)
        self.pivots = least[self.starts]
        self.names = np.unique(self.pivots)
        count = np.zeros(len(self.names), np.int64)
        for key in keys if len(self.names) else ():
            at = np.minimum(np.searchsorted(self.names, key), len(self.names) - 1)
            count += np.bincount(at[self.names[at] == key], minlength=len(self.names))
        self.local = count > 1

    def order(self, ranges: int) -> tuple[np.ndarray, np.ndarray]:
        """The chunk's names by (hash range, name), and their ranges."""
        part = (mix(self.names, 21) % np.uint64(ranges)).astype(np.int64)
        by = np.argsort(part, kind="stable")
        return self.names[by], part[by]

    def candidates(self, flagged: np.ndarray) -> np.ndarray:
        """Starts of windows whose representative occurs again; ``flagged``: sorted names found elsewhere."""
        again = np.union1d(self.names[self.local], flagged)
        return self.starts[np.isin(self.pivots, again)]

    def window_names(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = self.hashes
        if not len(starts):
            return np.empty(0, np.uint64), np.empty(0, np.uint64)
        return windows(h, self.window, _BASE_A)[starts], windows(mix(h, 77), self.window, _BASE_B)[starts]


class Windows:
    """Distinct 128-bit names of a chunk's candidate windows, by (range, name)."""

    def __init__(self, chunk: Chunk, starts: np.ndarray, ranges: int):
        self.starts = starts
        a, b = chunk.window_names(starts)
        part = (mix(a, 22) % np.uint64(ranges)).astype(np.int64)
        self.by = np.lexsort((b, a, part))
        a, b, part = a[self.by], b[self.by], part[self.by]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        self.group = np.cumsum(new) - 1
        self.a, self.b, self.part = a[new], b[new], part[new]
        self.local = np.bincount(self.group, minlength=len(self.a)) > 1 if len(a) else np.empty(0, bool)

    def repeated(self, found: np.ndarray) -> np.ndarray:
        """Starts of the windows that occur again; ``found``: per distinct name, whether another chunk has it."""
        again = self.local | found
        return self.starts[self.by[again[self.group]]]


_CHUNKS = pa.schema([("chunk", pa.int64()), ("ids", pa.binary()), ("ends", pa.binary()), ("body", pa.binary())])
_PARTS = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), ("names", pa.binary())])
_BITS = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), ("bits", pa.binary())])


def pack(docs: DataFrame) -> DataFrame:
    """Chunks of whole texts: doc ids (and which are known), ends of the texts, compressed bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, number = zstandard.ZstdCompressor(3), TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        texts: list[bytes] = []
        size = 0

        def made() -> pa.RecordBatch:
            known = np.array([x is not None for x in ids], np.uint8).tobytes()
            ends = np.cumsum([len(x) for x in texts]).astype("<i8").tobytes()
            columns = [number, np.array([x or 0 for x in ids], "<i8").tobytes() + known, ends, squeeze.compress(b"".join(texts))]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(columns, _CHUNKS)], schema=_CHUNKS)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), strings(batch, "text").to_pylist()):
                body = text.encode("utf-8", "surrogatepass")
                if texts and size + len(body) > CHUNK_BYTES:
                    yield made()
                    number, ids, texts, size = number + 1, [], [], 0
                ids.append(doc)
                texts.append(body)
                size += len(body)
        if ids:
            yield made()

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(slim.mapInArrow(run, "chunk long, ids binary, ends binary, body binary"), "chunks")


def _opened(ends: bytes, body: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(body, max_output_size=max(1, int(np.frombuffer(ends, "<i8")[-1]))), np.uint8)
    return data, np.concatenate([[0], np.frombuffer(ends, "<i8")])


def _slices(chunk: int, part: np.ndarray, blob: bytes, each: int) -> pa.RecordBatch:
    """One row per hash range with a chunk's sorted entries of ``each`` bytes."""
    cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.empty(0, int)
    ends = np.append(cut[1:], len(part))
    rows = [blob[a * each : b * each] for a, b in zip(cut, ends)]
    return pa.RecordBatch.from_arrays([pa.array(part[cut], pa.int64()), pa.array(np.full(len(cut), chunk), pa.int64()), pa.array(rows, pa.binary())], schema=_PARTS)


def _meet(each: int):
    """Per hash range: which entries of each chunk another chunk has too, as a bitmap in the chunk's order."""

    def run(table: pa.Table) -> pa.Table:
        blobs = table.column("names").to_pylist()
        sizes = [len(b) // each for b in blobs]
        flat = np.frombuffer(b"".join(blobs), "<u8").reshape(-1, each // 8)
        by = np.lexsort(flat.T[::-1])
        ordered = flat[by]
        new = np.ones(len(by), bool)
        new[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
        group = np.cumsum(new) - 1
        again = np.empty(len(by), bool)
        again[by] = (np.bincount(group) > 1)[group]
        bits, at = [], 0
        for n in sizes:
            bits.append(np.packbits(again[at : at + n]).tobytes())
            at += n
        return pa.table([table.column("part"), table.column("chunk"), pa.array(bits, pa.binary())], schema=_BITS)

    return run


def _found(part: np.ndarray, bits: list | None) -> np.ndarray:
    """Flags over entries in (range, name) order from the ranges' bitmaps."""
    out = np.zeros(len(part), bool)
    for row in bits or []:
        a, b = np.searchsorted(part, [row["part"], row["part"] + 1])
        out[a:b] = np.unpackbits(np.frombuffer(row["bits"], np.uint8))[: b - a].astype(bool)
    return out


def _per_chunk(bits: DataFrame, name: str) -> DataFrame:
    return bits.groupBy("chunk").agg(F.collect_list(F.struct("part", "bits")).alias(name))  # a bit per entry of the chunk


def repeated_passages(docs: DataFrame, window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked, the kept words as ``kept_text``."""
    spark = docs.sparkSession
    prepare(spark)
    chunks = pack(docs)
    ranges = max(4 * width(spark), chunks.count() // RANGE_CHUNKS)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(*_opened(row["ends"], row["body"]), window)
                names, part = chunk.order(ranges)
                yield _slices(row["chunk"], part, names.astype("<u8").tobytes(), 8)

    def narrowed(row: dict) -> tuple[Chunk, Windows]:
        chunk = Chunk(*_opened(row["ends"], row["body"]), window)
        names, part = chunk.order(ranges)
        flagged = names[_found(part, row["names"])]
        return chunk, Windows(chunk, chunk.candidates(flagged), ranges)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, found = narrowed(row)
                yield _slices(row["chunk"], found.part, np.stack([found.a, found.b], 1).astype("<u8").tobytes(), 16)

    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
    schema = pa.schema(fields + ([("kept_text", pa.string())] if with_text else []))

    def third(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk, found = narrowed(row)
                starts = found.repeated(_found(found.part, row["windows"]))
                edge = np.zeros(len(chunk.hashes) + 1, np.int64)
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + window, -1)
                keep = np.cumsum(edge)[:-1] == 0
                data, offsets = _opened(row["ends"], row["body"])
                data = data.tobytes()
                n = len(offsets) - 1
                ids, known = np.frombuffer(row["ids"], "<i8", n), np.frombuffer(row["ids"], np.uint8, n, 8 * n)
                kept, gone = [], []
                for k in range(n):
                    stay = keep[chunk.bounds[k] : chunk.bounds[k + 1]]
                    kept.append(b" ".join(compress(data[offsets[k] : offsets[k + 1]].split(), stay)))
                    gone.append(int(len(stay) - stay.sum()))
                columns = [pa.array(ids, mask=known == 0), pa.array(chunk.counts, pa.int64()), pa.array(gone, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
                if with_text:
                    columns.append(pa.array([x.decode("utf-8", "replace") for x in kept], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    ddl = "part long, chunk long, names binary"
    names = _per_chunk(chunks.mapInArrow(first, ddl).groupBy("part").applyInArrow(_meet(8), "part long, chunk long, bits binary"), "names")
    marked = stored(names, "names-again")
    with_names = chunks.join(marked, "chunk", "left").select("chunk", "ends", "body", "names")
    found = with_names.mapInArrow(second, ddl).groupBy("part").applyInArrow(_meet(16), "part long, chunk long, bits binary")
    wide = chunks.join(marked, "chunk", "left").join(_per_chunk(found, "windows"), "chunk", "left")
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    return wide.mapInArrow(third, out)


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(read_table(spark, sf_dir, "documents"), with_text=False)
