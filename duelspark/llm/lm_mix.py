"""LM scoring: online logistic context mixing over the running text, bit by bit.

A document is the stream of its lower-cased words, each closed by a blank, and one end mark. A byte's bits
are its path in a Huffman code of the training bytes. Bit predictors are hashed contexts: the last 2, 3, 4
and 6 bytes, the word so far, and it with ``LEAD`` bytes before it; a cell keeps how often 0 and 1 followed in
the training documents. For the first ``HEAD`` bytes of a word contexts reach back across word ends; later ones
stay in the word.
The predictors' log odds are mixed by weights gated by the bit's place in its byte and the byte's place in
its word, and an adaptive probability map refines the mix. Weights and map are learnt online, batch after
batch, over all training text; each bit is predicted with its own occurrence taken out of the counts, in
training documents' scores too. Last, a word's probability, the product over its bits, is refined by what
the document itself has shown (``refined``): the words it has used so far, and what followed the same word
in it before, each with a share that adapts to how often it was right. The sum over all words is the score,
and ``bits_per_byte`` is that over the bytes of the text.

What decides a bit's probability is its unit: ``LEAD`` bytes with the head of a word, or a word whose bytes
after the head are scored. So every unit is worked on once for the whole corpus, with its training
count as weight: chunks send their distinct units to hash ranges and get scores and counts back. Units are
keyed rows and grow with the corpus, and so does the number of ranges (``RANGE_BYTES``), so that a range
doesn't. The cells of the predictors are of a fixed number (``SIZES``), which is what is broadcast.

Defined results: a null or empty text has only its end token. Without training documents counts are 0 and
the score is that of an unlearnt mix. Documents without doc_id train nothing and have held_out null. Repeated
rows count as often as they occur. Empty tables give an empty result; columns other than doc_id and text
aren't read. The weights depend on how units are dealt to ranges, not on the order or partitions of rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import LOWER, Words, mix, powers, prepare, read_table, spans, stored, strings, trim, width

#: Bytes of text in a chunk (a longer document is a chunk by itself), and of text whose units meet in a range.
CHUNK_BYTES, RANGE_BYTES = 6 << 20, 64 << 20
#: First bytes of a word that see across word ends, and how far back they see.
HEAD, LEAD = 3, 4
#: Bytes of context of the first predictors, and the cells of all six.
LENGTHS = (2, 3, 4, 6)
SIZES = (1 << 20, *(1 << 21,) * 4, 1 << 22)
ORDERS = len(SIZES)
#: Cells whose partial counts travel together.
SLICE = 1 << 19
#: Bytes of units in one vectorised step, and bytes after which weights and map learn.
STEP_BYTES, BATCH_BYTES = 1 << 14, 1 << 13
#: Bytes of a word that its context hashes at most.
REACH = 32
BLANK, END = 0x20, 0x0A
PRIOR = 0.4
#: Weight sets: heads and rests of words by a byte's first bit, its second one, and the others.
PLACES = 3
GATES = 2 * PLACES
#: Learning: weight at the start, damping of a step, share of the curvature.
WEIGHT, DAMPING, CURVATURE = 0.27, 45.0, 0.3
LIMIT, MAP_CELLS, MAP_PRIOR = 11.0, 64, 30.0
LEAST_P = 1e-5
#: Units of a log10 probability that travels.
UNIT = 1 << 14
#: Tokens after which a document's own words have their full share, that share, and the same for pairs.
SHOWN, SHARE, PAIRS_SHOWN = 10, 0.5, 3
#: Counts that a cell's state keeps exactly; all other states are log odds in equal steps.
EXACT = 13
#: Where a context keeps an inner node of the code: side by side, those near the root first.
_NODE = (255 - np.arange(256)).astype(np.uint32)
_BASE = 0x5851F42D4C957F2D


# ---- bits, contexts and states ------------------------------------------------------------------


class Code:
    """Huffman code of bytes: per byte its path of (inner node, bit)."""

    def __init__(self, counts: np.ndarray):
        heap = [(int(c) + 1, k) for k, c in enumerate(counts)]
        heapq.heapify(heap)
        sons: dict[int, tuple[int, int]] = {}
        for node in range(256, 511):
            (n, a), (m, b) = heapq.heappop(heap), heapq.heappop(heap)
            sons[node] = (a, b)
            heapq.heappush(heap, (n + m, node))
        paths: list[list[int]] = [[]] * 256
        todo: list[tuple[int, list[int]]] = [(510, [])]
        while todo:
            node, path = todo.pop()
            if node < 256:
                paths[node] = path
            else:
                todo += [(son, [*path, (node - 256) * 2 + bit]) for bit, son in enumerate(sons[node])]
        self.length = np.array([len(p) for p in paths])
        self.at = np.cumsum(self.length) - self.length
        self.steps = np.array([x for p in paths for x in p], np.int64)

    def bits(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all bits of the bytes: number of the byte, depth, inner node, bit."""
        n = self.length[data]
        place = np.repeat(np.arange(len(data), dtype=np.int32), n)
        depth = np.arange(len(place)) - (np.cumsum(n) - n)[place]
        step = self.steps[self.at[data][place] + depth]
        return place, depth, step >> 1, step & 1

    def classes(self, data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """The same in PLACES parts: the bytes' first bits, their second ones, and all others."""
        n, at = self.length[data], self.at[data]
        for low, high in ((0, 1), (1, 2), (2, 256)):
            size = np.clip(n - low, 0, high - low)
            row = np.repeat(np.arange(len(data)), size)
            if not len(row):
                continue
            depth = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + low
            step = self.steps[at[row] + depth]
            yield row, depth, step >> 1, step & 1


def streamed(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The streams of consecutive texts, one after the other, and where each ends."""
    edge = np.zeros(len(words.data) + 1, np.int8)
    edge[words.start] += 1
    edge[words.end] -= 1
    body = LOWER[words.data[np.cumsum(edge[:-1], dtype=np.int8).view(bool)]]
    sizes, n = words.end - words.start, len(words.bounds) - 1
    out = np.full(len(body) + len(sizes) + n, BLANK, np.uint8)
    text = np.repeat(np.arange(n), words.counts())
    out[np.arange(len(body)) + np.repeat(np.arange(len(sizes)) + text, sizes)] = body
    ends = np.concatenate([[0], np.cumsum(sizes + 1)])[words.bounds[1:]] + np.arange(1, n + 1)
    out[ends - 1] = END
    return out, ends


def contexts(data: np.ndarray, place: np.ndarray, inside: np.ndarray) -> list[np.ndarray]:
    """Per order a hash of what precedes each byte; ``place``: bytes of the unit before it, ``inside``: of the word."""
    n = len(data)
    symbol = data.astype(np.uint64) + np.uint64(1)
    last, out = np.zeros(n, np.uint64), []
    for k in range(1, LENGTHS[-1] + 1):
        before = np.zeros(n, np.uint64)
        before[k:] = symbol[: max(0, n - k)]
        before[place < k] = 0
        last = last * np.uint64(257) + before
        if k in LENGTHS:
            out.append(mix(last, k).astype(np.uint32))
    up, down = powers(n + 1, _BASE)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(symbol, 3) * up[:n], out=total[1:])
    for seed, size in ((9, np.clip(inside, 0, REACH)), (10, np.minimum(place, np.clip(inside, 0, REACH) + LEAD))):
        first = np.arange(n) - size
        so_far = (total[:n] - total[first]) * down[first]
        out.append(mix(mix(so_far, 4) + size.astype(np.uint64), seed).astype(np.uint32))
    return out


def cells(context: np.ndarray, node: np.ndarray, order: int) -> np.ndarray:
    return (context + _NODE[node]) & np.uint32(SIZES[order] - 1)


def _states() -> tuple[np.ndarray, np.ndarray]:
    """State of small counts (0, 1), and per state the log odds: as they are, without one 0, without one 1."""
    number, odds = np.zeros((EXACT + 1, EXACT + 1), np.uint8), np.zeros((3, 256), np.float32)
    made = 0
    for n0 in range(EXACT + 1):
        for n1 in range(EXACT + 1 - n0):
            number[n0, n1] = made
            for k, (a, b) in enumerate(((n0, n1), (max(n0 - 1, 0), n1), (n0, max(n1 - 1, 0)))):
                odds[k, made] = np.log((b + PRIOR) / (a + PRIOR))
            made += 1
    odds[:, made:] = np.linspace(-LIMIT, LIMIT, 256 - made)
    return number, odds


_NUMBER, ODDS = _states()
_ODDS_FLAT = ODDS.ravel()
#: States that stand for exact counts.
_SMALL = (EXACT + 1) * (EXACT + 2) // 2


def state(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """One byte for a cell's counts: exact if they are few, their log odds in equal steps if not."""
    odds = np.clip(np.log((n1 + PRIOR) / (n0 + PRIOR)), -LIMIT, LIMIT)
    far = np.rint((odds + LIMIT) * ((255 - _SMALL) / (2 * LIMIT))).astype(np.uint8) + np.uint8(_SMALL)
    few = n0 + n1 <= EXACT
    return np.where(few, _NUMBER[np.where(few, n0, 0).astype(np.int64), np.where(few, n1, 0).astype(np.int64)], far)


# ---- units --------------------------------------------------------------------------------------


class Units:
    """Byte strings that decide probabilities. The first byte tells the kind: how many bytes before the word a head
    has, or ``WORD`` for a whole word with its closing blank, whose bytes after the head are scored."""

    WORD = 255

    def __init__(self, flat: np.ndarray, ends: np.ndarray):
        self.flat, self.ends = flat, ends.astype(np.int64)

    def __len__(self) -> int:
        return len(self.ends)

    @classmethod
    def of(cls, array: pa.Array) -> Units:
        ends = np.frombuffer(array.buffers()[1], np.int32, len(array) + 1)[1:] if len(array) else np.empty(0, np.int32)
        return cls(np.frombuffer(array.buffers()[2], np.uint8) if len(array) else np.empty(0, np.uint8), ends)

    def array(self) -> pa.Array:
        offsets = np.concatenate([[0], self.ends]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(self), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(self.flat))])

    def take(self, rows: np.ndarray) -> Units:
        return Units.of(self.array().take(pa.array(rows)))

    def dumps(self) -> tuple[bytes, bytes]:
        squeeze = zstandard.ZstdCompressor(1)
        return squeeze.compress(np.diff(self.ends, prepend=0).astype("<u4").tobytes()), squeeze.compress(self.flat.tobytes())

    @classmethod
    def loads(cls, sizes: bytes, flat: bytes) -> Units:
        return cls(np.frombuffer(_open(flat), np.uint8), np.cumsum(np.frombuffer(_open(sizes), "<u4"), dtype=np.int64))

    def sorted(self) -> np.ndarray:
        """The numbers of the units in the order of their bytes."""
        return pc.sort_indices(self.array()).to_numpy().astype(np.int64)

    def words(self) -> np.ndarray:
        """Which units are whole words."""
        return self.flat[self.ends - np.diff(self.ends, prepend=0)] == self.WORD

    def hashes(self) -> np.ndarray:
        return np.fromiter(map(xxh3_64_intdigest, self.array().to_pylist()), np.uint64, len(self))

    def steps(self, rows: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Scored bytes of the units in ``rows``, about ``most`` bytes at a time: (numbers in ``rows``, bytes, head or not, contexts)."""
        sizes = np.diff(self.ends, prepend=0)
        begin, size = (self.ends - sizes)[rows] + 1, sizes[rows] - 1
        kind = self.flat[begin - 1].astype(np.int64)
        lead = np.where(kind == self.WORD, 0, kind)
        skip = np.where(kind == self.WORD, HEAD, lead)
        cut = np.searchsorted(np.cumsum(size), np.arange(most, int(size.sum()) + most, most))
        a = 0
        for b in np.minimum(cut + 1, len(rows)).tolist():
            if a == b:
                continue
            n = size[a:b]
            number = np.repeat(np.arange(a, b), n)
            place = np.arange(len(number)) - np.repeat(np.cumsum(n) - n, n)
            data = self.flat[place + begin[number]]
            found = contexts(data, place, place - lead[number])
            scored = np.flatnonzero(place >= skip[number])
            number = number[scored]
            yield number, data[scored], kind[number] != self.WORD, [c[scored] for c in found]
            a = b


def units_of(data: np.ndarray, ends: np.ndarray) -> tuple[Units, np.ndarray, Units, np.ndarray, np.ndarray]:
    """Of streams: distinct heads, each token's head, distinct words, each token's word (-1: end), tokens of each document."""
    closes = np.flatnonzero((data == BLANK) | (data == END))
    begins = np.concatenate([[0], closes[:-1] + 1]) if len(closes) else closes
    starts = np.concatenate([[0], ends[:-1]])
    last = np.searchsorted(closes, ends - 1)
    lengths = np.diff(last, prepend=-1)
    lead = np.minimum(LEAD, begins - np.repeat(starts, lengths))
    heads, head = _distinct(data, begins - lead, np.minimum(begins + HEAD, closes + 1), lead)
    inner = data[closes] == BLANK
    words, number = _distinct(data, begins[inner], closes[inner] + 1, np.full(int(inner.sum()), Units.WORD))
    word = np.full(len(closes), -1, np.int64)
    word[inner] = number
    return heads, head, words, word, lengths


def _distinct(data: np.ndarray, a: np.ndarray, b: np.ndarray, kind: np.ndarray) -> tuple[Units, np.ndarray]:
    """Distinct slices [a, b) of ``data``, each after its kind, and their numbers."""
    size = b - a + 1
    ends = np.cumsum(size)
    begin = ends - size
    source = np.repeat((a - 1 - begin).astype(np.int32), size)  # slices fit into an Arrow array, so into 32 bits
    source += np.arange(len(source), dtype=np.int32)
    flat = data[np.maximum(source, 0, out=source)]
    flat[begin] = kind
    encoded = Units(flat, ends).array().dictionary_encode()
    return Units.of(encoded.dictionary), encoded.indices.to_numpy().astype(np.int64)


class Counter:
    """Counts of 0 and 1 in every cell."""

    def __init__(self, code: Code) -> None:
        self.code, self.tables = code, [np.zeros(2 * size, np.int64) for size in SIZES]

    def add(self, units: Units, weight: np.ndarray) -> None:
        rows = np.flatnonzero(weight)
        for number, data, _, found in units.steps(rows, STEP_BYTES):
            place, _, node, bit = self.code.bits(data)
            each = weight[rows][number][place]
            for order, context in enumerate(found):
                np.add.at(self.tables[order], cells(context[place], node, order).astype(np.int64) * 2 + bit, each)

    def rows(self) -> Iterator[tuple[int, bytes, bytes]]:
        """(slice, bitmap of the counts that aren't 0, these counts)."""
        squeeze = zstandard.ZstdCompressor(3)
        for order, table in enumerate(self.tables):
            for k in range(0, len(table), 2 * SLICE):
                part = table[k : k + 2 * SLICE]
                used = part != 0
                if used.any():
                    counts = part[used]
                    kind = "1" if counts.max() < 256 else "8"
                    yield order << 16 | k // (2 * SLICE), squeeze.compress(np.packbits(used).tobytes()), kind.encode() + squeeze.compress(counts.astype("<u" + kind).tobytes())


# ---- mixing -------------------------------------------------------------------------------------


class Mixer:
    """Weights and probability map over fixed states."""

    def __init__(self, tables: list[np.ndarray], code: Code, model: bytes | None = None):
        self.tables, self.code = tables, code
        self.weights = np.full((GATES, ORDERS), WEIGHT, np.float32)
        self.map = np.zeros((GATES, MAP_CELLS))
        if model is not None:
            both = np.frombuffer(model, np.float64)
            self.weights = both[: GATES * ORDERS].reshape(GATES, ORDERS).astype(np.float32)
            self.map = both[GATES * ORDERS :].reshape(GATES, MAP_CELLS).copy()
        self.curvature, self.miss, self.used = np.zeros(GATES), np.zeros((GATES, MAP_CELLS)), np.zeros((GATES, MAP_CELLS))

    def dumps(self) -> bytes:
        return np.concatenate([self.weights.astype(np.float64).ravel(), self.map.ravel()]).tobytes()

    def bits(self, data: np.ndarray, head: np.ndarray, found: list[np.ndarray], own: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """By gate: (gate, numbers of the bytes, bits, log odds, mix, its map cells, refined probability of a 1).

        ``own``: each bit's own occurrence is taken out of its cell."""
        for kind in (0, 1):
            of = np.flatnonzero(head == bool(kind))
            here = [c[of] for c in found]
            for k, (row, _, node, bit) in enumerate(self.code.classes(data[of])):
                gate = kind * PLACES + k
                x = np.empty((ORDERS, len(row)), np.float32)
                shift = ((bit + 1) << 8 if own else np.zeros(len(bit))).astype(np.uint16)
                for order, context in enumerate(here):
                    np.take(_ODDS_FLAT, self.tables[order][cells(context[row], node, order)] + shift, out=x[order])
                z = np.clip(self.weights[gate] @ x, -LIMIT, LIMIT)
                p = 1 / (1 + np.exp(-z))
                cell = ((z + LIMIT) * ((MAP_CELLS - 1) / (2 * LIMIT))).astype(np.int64)
                refined = np.clip(p + self.map[gate][cell], LEAST_P, 1 - LEAST_P)
                yield gate, of[row], bit, x, p, cell, refined

    def learn(self, units: Units, weight: np.ndarray) -> float:
        """One online pass over the units as often as they occur; the bits seen."""
        rows, seen = np.flatnonzero(weight), 0.0
        for number, data, head, found in units.steps(rows, BATCH_BYTES):
            often = weight[rows][number].astype(np.float64)
            for gate, byte, bit, x, p, cell, _ in self.bits(data, head, found, True):
                times, error = often[byte], (bit - p) * often[byte]
                self.miss[gate] += np.bincount(cell, error, MAP_CELLS)
                self.used[gate] += np.bincount(cell, times, MAP_CELLS)
                self.map[gate] = self.miss[gate] / (self.used[gate] + MAP_PRIOR)
                self.curvature[gate] += (p * (1 - p) * times * np.einsum("ij,ij->j", x, x)).sum()
                self.weights[gate] += (x @ error.astype(np.float32)) / (DAMPING + CURVATURE * self.curvature[gate])
                seen += times.sum()
        return seen

    def score(self, units: Units, rows: np.ndarray, own: bool) -> np.ndarray:
        """log10 probability of the scored bytes of the units in ``rows``."""
        out = np.zeros(len(rows))
        for number, data, head, found in units.steps(rows, STEP_BYTES):
            for _, byte, bit, _, _, _, refined in self.bits(data, head, found, own):
                low, high = int(number[0]), int(number[-1]) + 1
                out[low:high] += np.bincount(number[byte] - low, np.log10(np.where(bit == 1, refined, 1 - refined)), high - low)
        return out


# ---- chunks and what they exchange --------------------------------------------------------------

_DOC = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("train", "u1"), ("size", "<i8"), ("n", "<i8")])
_CHUNKS = "chunk long, part long, docs binary, heads binary, words binary, places binary, sizes binary, flat binary, counts binary"
_RANGES = "types long, tokens long, ends long, bytes binary, sizes binary, flat binary, counts binary, chunks binary, places binary"
_ANSWERS = "chunk long, part long, counts binary, scores binary"


def earlier(key: np.ndarray) -> np.ndarray:
    """How often each entry occurs before its own place."""
    by = np.argsort(key, kind="stable")
    new = np.diff(key[by], prepend=key[by][:1] - 1) != 0
    out = np.empty(len(key), np.int64)
    out[by] = np.arange(len(key)) - np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    return out


def refined(logs: np.ndarray, word: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """log10 probabilities of tokens, mixed with the shares of the same word in the document so far.

    Each mix's gate is the share of its hits in the tokens before: words that had occurred in the document, and
    words that had followed the word before them there. ``word``: numbers of words, -1 for the end."""
    first = np.repeat(np.cumsum(lengths) - lengths, lengths)
    doc, place = np.repeat(np.arange(len(lengths)), lengths), np.arange(len(word)) - first
    upto = lambda flags: (c := np.cumsum(flags) - flags) - c[first]
    size = int(word.max(initial=0)) + 2
    _, single = np.unique(doc * size + word + 1, return_inverse=True)
    before = np.roll(single, 1)
    before[place == 0] = -1
    used = earlier(single)
    gate = SHARE * upto(used > 0) / (place + SHOWN)
    p = (1 - gate) * 10.0**logs + gate * used / np.maximum(place, 1)
    _, pair = np.unique((before + 1) * (int(single.max(initial=0)) + 1) + single, return_inverse=True)
    tries, hits = earlier(before + len(word) * (before < 0)), earlier(pair)
    tries[place == 0] = 0
    gate = np.where(tries > 0, upto((hits > 0) & (place > 0)) / (upto(tries > 0) + PAIRS_SHOWN), 0)
    return np.log10((1 - gate) * p + gate * hits / np.maximum(tries, 1))


def _open(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32, byte by byte, compressed."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(3).compress(planes.tobytes())


def opened(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_open(blob), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(fields)], names=[f for f, _ in fields])


def trains(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 != 2


def chunked(docs: DataFrame, ranges: int) -> DataFrame:
    """Per chunk one row of documents and their tokens' units (part null), and its distinct units per hash range.

    An entry's count is twice the occurrences in training documents, plus one if others hold it too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, chunk = zstandard.ZstdCompressor(3), TaskContext.get().partitionId() << 32
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        size = 0

        def made() -> Iterator[pa.RecordBatch]:
            trim(1)
            rows = np.array([x for part in held for x in part[0]], _DOC)
            data = np.concatenate([x for _, x, _ in held])
            heads, head, words, word, lengths = units_of(data, np.cumsum(np.concatenate([x for _, _, x in held])))
            rows["n"] = lengths
            learns = np.repeat(rows["train"], lengths).astype(bool)
            every = Units(np.concatenate([heads.flat, words.flat]), np.concatenate([heads.ends, words.ends + len(heads.flat)]))
            word = np.where(word < 0, -1, word + len(heads))
            both = np.concatenate([head, word[word >= 0]])
            trained = np.bincount(both, np.concatenate([learns, learns[word >= 0]]), len(every)).astype(np.int64)
            counts = 2 * trained + (np.bincount(both, minlength=len(every)) > trained)
            part = (every.hashes() % np.uint64(ranges)).astype(np.int64)
            by = every.sorted()
            by = by[np.argsort(part[by], kind="stable")]  # by range, then bytes
            place = np.empty(len(by), np.int64)
            place[by] = np.arange(len(by))
            common = by[np.argsort(-np.bincount(both, minlength=len(every))[by], kind="stable")]  # tokens hold ranks by frequency, then place
            rank = np.empty(len(by) + 1, np.int64)
            rank[common] = np.arange(1, len(by) + 1)
            rank[-1] = 0  # of end tokens
            tokens = [packed(x) for x in (rank[head], rank[word], np.diff(place[common], prepend=0) & 0xFFFFFFFF)]
            yield _batch([(chunk, None, rows.tobytes(), *tokens, None, None, None)], _CHUNKS)
            cut = np.flatnonzero(np.diff(part[by], prepend=-1))
            for a, b in zip(cut.tolist(), np.append(cut[1:], len(by)).tolist()):
                yield _batch([(chunk, int(part[by[a]]), None, None, None, None, *every.take(by[a:b]).dumps(), squeeze.compress(counts[by[a:b]].astype("<u4").tobytes()))], _CHUNKS)

        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            for a, b, data, offsets in spans(strings(batch, "text")):
                if held and size + len(data) > CHUNK_BYTES:
                    yield from made()
                    chunk, held, size = chunk + 1, [], 0
                stream, ends = streamed(Words(data, offsets))
                held.append(([(d or 0, d is not None, trains(d), n, 0) for d, n in zip(ids[a:b], np.diff(offsets).tolist())], stream, np.diff(ends, prepend=0)))
                size += len(data)
        if held:
            yield from made()

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(slim.mapInArrow(run, _CHUNKS), "lm-chunks")


def _meet(table: pa.Table) -> pa.Table:
    """A hash range's distinct units with their counts over all chunks, in the order of their bytes, and each chunk's places."""
    trim(1)
    slices = [Units.loads(s, f) for s, f in zip(table.column("sizes").to_pylist(), table.column("flat").to_pylist())]
    counts = np.concatenate([np.frombuffer(_open(c), "<u4") for c in table.column("counts").to_pylist()]).astype(np.int64)
    encoded = pa.concat_arrays([x.array() for x in slices]).dictionary_encode()
    units, number = Units.of(encoded.dictionary), encoded.indices.to_numpy()
    by = units.sorted()
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))
    units, place = units.take(by), rank[number]
    trained = np.zeros(len(units), np.int64)
    np.add.at(trained, place, counts >> 1)
    others = np.bincount(place, counts & 1, len(units)) > 0
    words, ends = units.words(), units.flat[units.ends - 1] == END
    held = np.zeros(256, np.int64)
    for row, data, _, _ in units.steps(np.arange(len(units)), STEP_BYTES):
        np.add.at(held, data, trained[row])
    chunk, part = table.column("chunk").to_numpy(), table.column("part").to_numpy()
    squeeze, sizes = zstandard.ZstdCompressor(1), [len(x) for x in slices]
    places = np.stack([chunk, part, sizes]).astype("<i8").tobytes()
    gaps = np.diff(place, prepend=0)  # both sides are in the order of bytes, so places go up
    begin = np.cumsum(sizes) - sizes
    gaps[begin] = place[begin]
    figures = [int((words & (trained > 0)).sum()), int(trained[words].sum()), int(trained[ends].sum())]
    row = (*figures, held.astype("<i8").tobytes(), *units.dumps(), squeeze.compress((2 * trained + others).astype("<i8").tobytes()), places, packed(gaps))
    return pa.Table.from_batches([_batch([row], _RANGES)])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Units, np.ndarray, np.ndarray]]:
    """(row, units, training counts, whether others hold them) of the ranges."""
    for batch in batches:
        for row in batch.to_pylist():
            trim(1)
            counts = np.frombuffer(_open(row["counts"]), "<i8")
            yield row, Units.loads(row["sizes"], row["flat"]), counts >> 1, counts & 1 > 0


def counted(ranges: DataFrame, code: Code) -> list[np.ndarray]:
    """The states of all cells, summed by slices over all ranges; of a fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(code)
        for _, units, trained, _ in _rows(batches):
            counter.add(units, trained)
        for row in counter.rows():
            yield _batch([row], "slice long, used binary, counts binary")
        del counter
        trim(1)

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * SLICE, np.int64)
        for batch in batches:
            for used, counts in zip(batch.column("used").to_pylist(), batch.column("counts").to_pylist()):
                flags = np.unpackbits(np.frombuffer(_open(used), np.uint8)).view(bool)
                total[: len(flags)][flags] += np.frombuffer(_open(counts[1:]), "<u" + counts[:1].decode()).astype(np.int64)
        states = zstandard.ZstdCompressor(3).compress(state(total[0::2], total[1::2]).tobytes())
        yield _batch([(key[0].as_py(), states)], "slice long, states binary")

    partial = ranges.select("sizes", "flat", "counts").mapInArrow(count, "slice long, used binary, counts binary")
    summed = partial.groupBy("slice").applyInArrow(add, "slice long, states binary")
    tables = [np.full(size, state(np.zeros(1), np.zeros(1))[0], np.uint8) for size in SIZES]
    for row in summed.toLocalIterator():  # one row a slice: at most sum(SIZES) bytes
        order, k = row["slice"] >> 16, (row["slice"] & 0xFFFF) * SLICE
        part = np.frombuffer(_open(bytes(row["states"])), np.uint8)
        tables[order][k : k + SLICE] = part[: len(tables[order]) - k]
    return tables


def learnt(ranges: DataFrame, tables: Broadcast, code: Code) -> bytes | None:
    """Weights and map that each range learns online, averaged by the bits they saw."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, units, trained, _ in _rows(batches):
            mixer = Mixer(tables.value, code)
            by = np.argsort(units.hashes(), kind="stable")  # not by bytes: batches must be alike
            seen = mixer.learn(units.take(by), trained[by])
            if seen:
                yield _batch([(int(seen), mixer.dumps())], "bits long, model binary")

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, total = 0, 0.0
        for batch in batches:
            for n, model in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                bits, total = bits + n, total + n * np.frombuffer(model, np.float64)
        if bits:
            yield _batch([(bits, (total / bits).tobytes())], "bits long, model binary")

    models = ranges.select("sizes", "flat", "counts").mapInArrow(learn, "bits long, model binary")
    found = models.mapInArrow(average, "bits long, model binary").repartition(1).mapInArrow(average, "bits long, model binary").first()  # one model a task
    return bytes(found["model"]) if found else None


def document_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    spark = docs.sparkSession
    prepare(spark)
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    chunks = chunked(docs, max(width(spark), size // RANGE_BYTES))
    entries = chunks.filter("part is not null").select("chunk", "part", "sizes", "flat", "counts")
    ranges = stored(entries.groupBy("part").applyInArrow(_meet, _RANGES), "lm-ranges")
    figures = ranges.agg(*[F.sum(x) for x in ("types", "tokens", "ends")]).first()
    types, words, ends = (x or 0 for x in figures)
    total, distinct = words + ends, types + (ends > 0)

    def byte_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(256, np.int64)
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                held += np.frombuffer(blob, "<i8")
        yield _batch(list(enumerate(held.tolist())), "byte long, n long")

    summed = ranges.select("bytes").mapInArrow(byte_counts, "byte long, n long").groupBy("byte").agg(F.sum("n").alias("n"))
    held = {r["byte"]: r["n"] for r in summed.collect()}  # 256 rows
    code = Code(np.array([held.get(k, 0) for k in range(256)]))
    tables = spark.sparkContext.broadcast(counted(ranges, code))
    model = learnt(ranges, tables, code)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(1)
        mixer = Mixer(tables.value, code, model)
        for row, units, trained, others in _rows(batches):
            scores = np.zeros((2, len(units)), np.int64)
            for k, some in enumerate((np.flatnonzero(others), np.flatnonzero(trained))):
                scores[k, some] = np.rint(mixer.score(units, some, k == 1) * -UNIT)
            gaps, a = opened(row["places"]), 0
            for chunk, part, n in np.frombuffer(row["chunks"], "<i8").reshape(3, -1).T.tolist():
                mine = np.cumsum(gaps[a : a + n])
                a += n
                yield _batch([(chunk, part, squeeze.compress(trained[mine].astype("<i8").tobytes()), packed(scores[:, mine].ravel()))], _ANSWERS)

    answers = ranges.select("sizes", "flat", "counts", "chunks", "places").mapInArrow(score, _ANSWERS)
    per_chunk = answers.groupBy("chunk").agg(F.collect_list(F.struct("part", "counts", "scores")).alias("known"))  # a row per unit of the chunk at most
    joined = chunks.filter("part is null").select("chunk", "docs", "heads", "words", "places").join(per_chunk, "chunk", "left")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                trim(4)
                rows = np.frombuffer(row["docs"], _DOC)
                place = np.concatenate([[-1], np.cumsum(opened(row["places"])) & 0xFFFFFFFF])
                head, word = place[opened(row["heads"])], place[opened(row["words"])]
                found = sorted(row["known"] or [], key=lambda r: r["part"])
                counts = np.concatenate([*(np.frombuffer(_open(r["counts"]), "<i8") for r in found), [ends]])  # the last: end tokens
                scores = np.concatenate([*(opened(r["scores"]).reshape(2, -1) for r in found), np.zeros((2, 1))], axis=1) / -UNIT
                own = np.repeat(rows["train"], rows["n"])
                first = np.cumsum(rows["n"]) - rows["n"]
                score = np.add.reduceat(refined(scores[own, head] + scores[own, word], word, rows["n"]), first)
                base = np.add.reduceat(np.log10((counts[word] + 1) / (total + distinct + 1)), first)
                n_known = np.add.reduceat((counts[word] > 0).astype(np.int64), first)
                unknown = rows["known"] == 0
                bits = -score / np.log10(2) / np.maximum(1, rows["size"])
                columns = [pa.array(rows["doc_id"], mask=unknown), pa.array(rows["train"] == 0, mask=unknown), pa.array(rows["n"]), pa.array(n_known), pa.array(np.full(len(rows), total)), pa.array(base), pa.array(score), pa.array(bits, mask=rows["size"] == 0)]
                yield pa.RecordBatch.from_arrays(columns, names=_NAMES)

    return joined.mapInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")


_NAMES = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_scores(read_table(spark, sf_dir, "documents"))
