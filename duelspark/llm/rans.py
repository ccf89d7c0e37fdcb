"""Static range asymmetric numeral system over token ids, vectorised across interleaved lanes.

One frequency table serves all blocks. A block holds whole token runs; symbol k belongs to lane
k mod lanes, each lane is a 64-bit state renormalised by 32-bit words, and all lanes of a step are
one numpy operation. A block of ``PARTS`` steps or more has at least ``PARTS`` checkpoints: there the decoder's
states and stream position are kept, so that any part can be decoded alone, or all parts side by side. The
head with the checkpoints carries a crc32, and so does the stream of each part.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"RNS1"
_LOW = np.uint64(1 << 31)
_HEAD = struct.Struct("<4sBHIII")  # magic, scale, lanes, tokens, interval, words
#: Most lanes of a block, steps that a block has at least before it gets more lanes, and its checkpoints.
MAX_LANES, LEAST_STEPS, PARTS = 1024, 1024, 16


class Table:
    """Frequencies over 2**scale slots; every counted symbol has at least one slot."""

    def __init__(self, symbols: np.ndarray, freqs: np.ndarray, scale: int):
        self.symbols, self.scale = symbols.astype(np.uint32), scale
        self.freqs = freqs.astype(np.uint64)
        self.starts = np.concatenate([[0], np.cumsum(freqs)[:-1]]).astype(np.uint64)
        #: Place of each id in ``symbols``; ids of a vocabulary are dense.
        self.place = np.full(int(self.symbols.max()) + 1 if len(self.symbols) else 0, -1, np.int32)
        self.place[self.symbols] = np.arange(len(self.symbols), dtype=np.int32)
        self.slot = np.repeat(np.arange(len(symbols), dtype=np.uint32), freqs) if len(symbols) else np.empty(0, np.uint32)

    @classmethod
    def of(cls, symbols: np.ndarray, counts: np.ndarray, least_scale: int = 20) -> Table:
        order = np.argsort(symbols)
        symbols, counts = np.asarray(symbols)[order], np.asarray(counts, np.float64)[order]
        scale = max(least_scale, int(max(1, len(symbols) - 1)).bit_length() + 3)
        if not len(symbols):
            return cls(symbols, np.empty(0, np.int64), scale)
        total = 1 << scale
        freqs = np.maximum(1, np.floor(counts * (total / counts.sum()))).astype(np.int64)
        spare = total - int(freqs.sum())
        by_size = np.argsort(-freqs, kind="stable")
        if spare > 0:
            freqs[by_size[0]] += spare
        while spare < 0:  # take from the largest, never below one slot
            for k in by_size:
                cut = min(int(freqs[k]) // 2, -spare)
                freqs[k] -= cut
                spare += cut
                if spare == 0:
                    break
        return cls(symbols, freqs, scale)

    def dumps(self) -> bytes:
        body = np.diff(self.symbols.astype(np.int64), prepend=0).astype("<u4").tobytes() + self.freqs.astype("<u4").tobytes()
        return struct.pack("<BI", self.scale, len(self.symbols)) + zlib.compress(body, 6)

    @classmethod
    def loads(cls, data: bytes) -> Table:
        scale, n = struct.unpack_from("<BI", data)
        both = np.frombuffer(zlib.decompress(data[5:]), "<u4").astype(np.int64)
        return cls(np.cumsum(both[:n]), both[n:], scale)


def encode_block(tokens: np.ndarray, table: Table, parts: int = PARTS) -> bytes:
    n = len(tokens)
    lanes = min(MAX_LANES, 1 << max(0, int(n // LEAST_STEPS).bit_length() - 1))
    steps = -(-n // lanes)
    interval = max(1, steps // parts)
    if n and int(tokens.max()) >= len(table.place):
        raise ValueError("a token isn't in the frequency table")
    index = table.place[tokens]
    if n and index.min() < 0:
        raise ValueError("a token isn't in the frequency table")
    freqs, starts = table.freqs[index], table.starts[index]
    scale = np.uint64(table.scale)
    limits = freqs << np.uint64(63 - table.scale)
    state = np.full(lanes, _LOW, np.uint64)
    out: list[np.ndarray] = []
    states: list[np.ndarray] = []
    for t in range(steps - 1, -1, -1):
        a, b = t * lanes, min(n, (t + 1) * lanes)
        s, f = state[: b - a], freqs[a:b]
        full = s >= limits[a:b]
        words = s[full].astype(np.uint32)
        s = np.where(full, s >> np.uint64(32), s)
        high = s // f
        state[: b - a] = (high << scale) + (s - high * f) + starts[a:b]
        out.append(words)
        if t % interval == 0:
            states.append(state.copy())
    out.reverse()
    states.reverse()
    sizes = np.cumsum([0] + [len(w) for w in out])
    marks = sizes[np.arange(0, steps, interval)] if steps else np.empty(0, np.int64)
    stream = (np.concatenate(out) if out else np.empty(0, np.uint32)).astype("<u4").tobytes()
    edges = np.append(marks, len(stream) // 4) * 4
    crcs = np.array([zlib.crc32(stream[a:b]) for a, b in zip(edges, edges[1:])], "<u4")
    body = marks.astype("<u4").tobytes() + crcs.tobytes() + b"".join(s.astype("<u8").tobytes() for s in states)
    head = _HEAD.pack(MAGIC, table.scale, lanes, n, interval, len(stream) // 4)
    return head + struct.pack("<I", zlib.crc32(head + body)) + body + stream


def decode_block(block: bytes, table: Table, first: int = 0, parts: int | None = None) -> np.ndarray:
    """Tokens of a block, or of ``parts`` parts from the ``first`` one on.

    Every part is entered at its own checkpoint, and all go forward together, one step of each at a time."""
    magic, scale, lanes, n, interval, n_words = _HEAD.unpack_from(block)
    if magic != MAGIC or scale != table.scale:
        raise ValueError("not a block of this table")
    steps = -(-n // lanes)
    n_marks = -(-steps // interval)
    at = _HEAD.size + 4
    end = at + n_marks * (8 + 8 * lanes)
    if zlib.crc32(block[: _HEAD.size] + block[at:end]) != struct.unpack_from("<I", block, _HEAD.size)[0]:
        raise ValueError("checksum mismatch")
    last = n_marks if parts is None else min(n_marks, first + parts)
    if first >= last:
        return np.empty(0, np.uint32)
    marks = np.append(np.frombuffer(block, "<u4", n_marks, at), n_words).astype(np.int64)
    for k, crc in enumerate(np.frombuffer(block, "<u4", n_marks, at + 4 * n_marks)[first:last].tolist(), first):
        if zlib.crc32(block[end + 4 * marks[k] : end + 4 * marks[k + 1]]) != crc:
            raise ValueError("checksum mismatch")
    words = np.frombuffer(block, "<u4", n_words, end)
    state = np.frombuffer(block, "<u8", n_marks * lanes, at + 8 * n_marks).reshape(n_marks, lanes)[first:last].astype(np.uint64)
    place = marks[first:last].copy()
    ends = np.minimum(n, np.arange(first + 1, last + 1) * interval * lanes)  # tokens up to the end of each part
    out = np.empty((last - first, interval, lanes), np.uint32)
    low, bits = np.uint64((1 << scale) - 1), np.uint64(scale)
    begins = np.arange(first, last) * interval * lanes
    for t in range(interval):
        left = ends - begins - t * lanes  # only the last part may have fewer steps, or a step of fewer lanes
        if left[-1] < lanes:
            rows, rest = last - first - 1, max(0, int(left[-1]))
            pieces = [(slice(0, rows), lanes), (slice(rows, rows + 1), rest)]
        else:
            pieces = [(slice(0, last - first), lanes)]
        for rows, width in pieces:
            s = state[rows, :width]
            if not s.size:
                continue
            slot = s & low
            index = table.slot[slot]
            s = table.freqs[index] * (s >> bits) + slot - table.starts[index]
            short = s < _LOW
            taken = short.sum(axis=1)
            row, lane = np.nonzero(short)
            source = np.arange(len(row)) + np.repeat(place[rows] - (np.cumsum(taken) - taken), taken)
            s[row, lane] = (s[row, lane] << np.uint64(32)) | words[source].astype(np.uint64)
            place[rows] += taken
            state[rows, :width] = s
            out[rows, t, :width] = index
    return table.symbols[out.reshape(-1)[: int(ends[-1] - begins[0])]]
