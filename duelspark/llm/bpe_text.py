"""BPE encoding and decoding with tree concatenation for long unsplit text.

A text's pieces are cut by an equivalent of the vocabulary's pattern where no library version disputes a
character (see vocab.py), else by the library's own normaliser and pre-tokeniser; only a text that holds a
special token's string goes through the library whole. Pieces are encoded once per worker. A piece longer than
``LEAF`` letters is halved until its parts are short; the parts are encoded on their own, and each join
re-encodes a window around the seam that grows until its first token is the left side's token there and its
last token the right side's. Neighbouring tokens that a vocabulary would itself produce next to each other
decide a BPE encoding pair by pair, so a window that agrees with both sides is exact.

Texts of more than ``LONG_BYTES`` are cut into parts of ``PART`` letters that are dealt to tasks; the task that
gets a text's encoded parts back only joins them, in the same way.

Defined results: a null or empty text has no tokens and decodes to the empty text. All other
columns pass through ``encode_text``.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free, prepare, read_table, stored, strings, width
from .vocab import DIGITS, LETTERS, SPACES, Pieces, as_letters, disputed, tokenizer_json

#: Letters (bytes of the piece) of a part that is encoded whole.
LEAF = 256
#: Bytes beyond which a text's pieces are dealt to tasks, and letters (bytes) of a part.
LONG_BYTES, PART = 4 << 20, 1 << 18
#: Distinct words a worker keeps; lower-cased words recur more than pieces with blanks and capitals.
WORD_PIECES = 250_000


class WordBpe:
    """The vocabulary with word ends, lower-casing, white space dropped."""

    def __init__(self, source: str, leaf: int = LEAF):
        from tokenizers import Tokenizer

        spec = json.loads(source)
        self.library = Tokenizer.from_str(source)
        self.library.no_truncation()
        self.library.no_padding()
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        steps = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.known = steps == ["NFC", "Replace", "Lowercase"]
        inner = dict(spec, model=dict(spec["model"], end_of_word_suffix=None))
        self.last, self.inner, self.leaf = self.library.model, Tokenizer.from_str(json.dumps(inner)).model, leaf
        self.letters = {v: k for k, v in self.library.get_vocab(with_added_tokens=True).items()}
        self.pattern = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^{SPACES}{LETTERS}{DIGITS}]+")
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.joins = 0
        self.pieces = Pieces(lambda piece: [t for t, _ in self.tree(as_letters(piece), True)], WORD_PIECES)

    def _sized(self, letters: str, final: bool):
        return (self.last if final else self.inner).tokenize(letters)

    def lengths(self, ids: list[int]) -> list[int]:
        out = []
        for i in ids:
            x = self.letters[i]
            out.append(len(x) - len(self.suffix) if self.suffix and x.endswith(self.suffix) and len(x) > len(self.suffix) else len(x))
        return out

    def leafs(self, letters: str, final: bool) -> list[tuple[int, int]]:
        ids = [t.id for t in self._sized(letters, final)]
        return list(zip(ids, self.lengths(ids)))

    def tree(self, letters: str, final: bool) -> list[tuple[int, int]]:
        if len(letters) <= self.leaf:
            return self.leafs(letters, final)
        half = len(letters) // 2
        return self.join(letters, half, self.tree(letters[:half], False), self.tree(letters[half:], final), final)

    def join(self, letters: str, half: int, left: list[tuple[int, int]], right: list[tuple[int, int]], final: bool) -> list[tuple[int, int]]:
        k = 2
        self.joins += 1
        while True:
            a, b = left[-k:], right[:k]
            begin, end = half - sum(n for _, n in a), half + sum(n for _, n in b)
            whole_left, whole_right = k >= len(left), k >= len(right)
            middle = self.leafs(letters[begin:end], final and whole_right)
            if (whole_left or middle[0] == a[0]) and (whole_right or middle[-1] == b[-1]):
                return left[: len(left) - len(a)] + middle + right[len(b) :]
            k *= 2

    def encode(self, text: str) -> np.ndarray:
        if self.known and not disputed(text):
            return np.frombuffer(b"".join(map(self.pieces.__getitem__, self.pattern.findall(text.lower()))), "<u4")
        words = self.words(text)
        if words is None:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array([t for w in words for t, _ in self.tree(w, True)], "<u4")

    def words(self, text: str) -> list[str] | None:
        """The letters of each piece, from the library's own normaliser and pre-tokeniser; None: a special token may stand in the text."""
        if any(x in text for x in self.special) or self.library.pre_tokenizer is None:
            return None
        clean = self.library.normalizer.normalize_str(text) if self.library.normalizer is not None else text
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(clean)]

    def joined(self, letters: list[str], parts: list[list[tuple[int, int]]], final: bool = True) -> list[tuple[int, int]]:
        """The encoding of consecutive parts from theirs, as a tree."""
        if len(parts) == 1:
            return parts[0]
        half = len(parts) // 2
        left, right = self.joined(letters[:half], parts[:half], False), self.joined(letters[half:], parts[half:], final)
        return self.join("".join(letters), sum(map(len, letters[:half])), left, right, final)

    def decode(self, ids: np.ndarray) -> str:
        """As the library: no decoder is set, so tokens are joined by a blank."""
        return " ".join(map(self.letters.__getitem__, ids.tolist()))


_coders: dict[int, WordBpe] = {}


def _coder(source: str) -> WordBpe:
    key = hash(source)
    if key not in _coders:
        _coders.clear()
        _coders[key] = WordBpe(source)
    return _coders[key]


def _long(text: str = "text", most: int = LONG_BYTES) -> Column:
    return F.coalesce(F.octet_length(F.col(text).cast("string")) > most, F.lit(False))


def encode_long(texts: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """(row, ids) of long texts (row, text): parts of their pieces are encoded by many tasks, then joined per text."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(tokenizer_json(tokenizer_path, "word_bpe_49k.json"))
    ddl = "row long, piece long, part long, final boolean, letters string, ids binary, sizes binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value)
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), strings(batch, "text").to_pylist()):
                words = coder.words(text)
                if words is None:  # a special token: whole, by the library
                    yield _part(row, 0, 0, True, "", coder.encode(text), [])
                    continue
                run: list[str] = []  # short pieces up to the next long one, one row
                for k, word in enumerate(words):
                    if len(word) <= PART:
                        run.append(word)
                    if run and (len(word) > PART or k == len(words) - 1 or len(run) == 1 << 16):
                        yield _part(row, k - len(run) + (len(word) <= PART), 0, True, "", [t for w in run for t, _ in coder.tree(w, True)], [])
                        run = []
                    if len(word) > PART:
                        for j in range(0, len(word), PART):
                            yield _part(row, k, j // PART, j + PART >= len(word), word[j : j + PART], None, [])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value)
        for batch in batches:
            for r in batch.to_pylist():
                if r["ids"] is not None:
                    yield _part(r["row"], r["piece"], r["part"], r["final"], "", np.frombuffer(r["ids"], "<u4"), [])
                else:
                    made = coder.tree(r["letters"], r["final"])
                    yield _part(r["row"], r["piece"], r["part"], r["final"], r["letters"], [t for t, _ in made], [n for _, n in made])

    def join(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, out = _coder(shared.value), []
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["piece"], r["part"]))  # of one text
        for _, group in itertools.groupby(rows, key=lambda r: (r["piece"], bool(r["letters"]))):
            parts = list(group)
            if not parts[0]["letters"]:
                out.append(np.frombuffer(b"".join(p["ids"] for p in parts), "<u4"))
                continue
            encoded = [list(zip(np.frombuffer(p["ids"], "<u4").tolist(), np.frombuffer(p["sizes"], "<u4").tolist())) for p in parts]
            out.append(np.array([t for t, _ in coder.joined([p["letters"] for p in parts], encoded)], "<u4"))
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([np.concatenate(out).astype("<u4").tobytes()], pa.binary())], names=["row", "ids"])

    parts = texts.mapInArrow(cut, ddl).repartition(width(spark), "row", "piece", "part").mapInArrow(encode, ddl)
    return parts.groupBy("row").applyInArrow(join, "row long, ids binary")


def _part(row: int, piece: int, part: int, final: bool, letters: str, ids, sizes) -> pa.RecordBatch:
    values = [row, piece, part, final, letters, None if ids is None else np.asarray(ids, "<u4").tobytes(), np.asarray(sizes, "<u4").tobytes()]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=["row", "piece", "part", "final", "letters", "ids", "sizes"])


def _numbered(docs: DataFrame, text: str, most: int) -> tuple[DataFrame, str] | None:
    """The rows with long texts, numbered in the named column and written once; None if there are none."""
    long, name = docs.filter(_long(text, most)), free(docs, "__row")
    if long.isEmpty():
        return None
    return stored(long.withColumn(name, F.monotonically_increasing_id()), "long-texts"), name


def encode_text(docs: DataFrame, tokenizer_path: str | None = None, text: str = "text", ids: str = "ids", long_bytes: int = LONG_BYTES) -> DataFrame:
    """``docs`` with an array column of token ids after its own columns (a clashing one is replaced)."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json(tokenizer_path, "word_bpe_49k.json"))
    kept = [c for c in docs.columns if c != ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value)
        for batch in batches:
            rows = [coder.encode(x) for x in strings(batch, text).to_pylist()]
            yield _with_ids(batch.select(kept), rows, ids)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.frombuffer(x or b"", "<u4") for x in batch.column(len(kept)).to_pylist()]
            yield _with_ids(batch.select(kept), rows, ids)

    slim = docs.select(*kept)
    schema = T.StructType([*slim.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])
    found = _numbered(slim, text, long_bytes)
    if found is None:
        return slim.mapInArrow(run, schema)
    long, row = found
    made = encode_long(long.select(F.col(row).alias("row"), F.col(text).cast("string").alias("text")), tokenizer_path).select(F.col("row").alias(row), F.col("ids").alias(free(slim, "__ids")))
    rest = long.join(made, row, "left").drop(row).mapInArrow(unpack, schema)
    return slim.filter(~_long(text, long_bytes)).mapInArrow(run, schema).unionByName(rest)


def _with_ids(out: pa.RecordBatch, rows: list[np.ndarray], name: str) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    flat = np.concatenate(rows).astype(np.int32) if rows else np.empty(0, np.int32)
    made = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
    return pa.RecordBatch.from_arrays([*out.columns, made], names=[*out.schema.names, name])


def decode_ids(frame: DataFrame, tokenizer_path: str | None = None, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``frame`` with the decoded text of an array column of ids (null: empty)."""
    prepare(frame.sparkSession)
    shared = frame.sparkSession.sparkContext.broadcast(tokenizer_json(tokenizer_path, "word_bpe_49k.json"))
    kept = [c for c in frame.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            made = pa.array([coder.decode(np.array(x or [], np.int64)) for x in column], pa.string())
            out = batch.select(kept)
            yield pa.RecordBatch.from_arrays([*out.columns, made], names=[*kept, text])

    slim = frame.select(*kept)
    return slim.mapInArrow(run, T.StructType([*slim.schema.fields, T.StructField(text, T.StringType())]))


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def bpe_digest(docs: DataFrame, tokenizer_path: str | None = None, long_bytes: int = LONG_BYTES) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text; encodes and decodes in one pass over the texts."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json(tokenizer_path, "word_bpe_49k.json"))
    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def digests(doc: pa.Array, rows: Iterator[np.ndarray]) -> pa.RecordBatch:
        coder, counts, ids_sha, text_sha = _coder(shared.value), [], [], []
        for ids in rows:
            counts.append(len(ids))
            ids_sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
            text_sha.append(hashlib.sha256(coder.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
        return pa.RecordBatch.from_arrays([doc, pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], schema=_DIGEST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value)
        for batch in batches:
            yield digests(batch.column(0), map(coder.encode, strings(batch, "text").to_pylist()))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield digests(batch.column(0), (np.frombuffer(x or b"", "<u4") for x in batch.column(1).to_pylist()))

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = _numbered(slim, "text", long_bytes)
    if found is None:
        return slim.mapInArrow(run, ddl)
    long = found[0].withColumnRenamed(found[1], "row")
    rest = long.select("row", "doc_id").join(encode_long(long.select("row", "text"), tokenizer_path), "row", "left").select("doc_id", "ids").mapInArrow(unpack, ddl)
    return slim.filter(~_long("text", long_bytes)).mapInArrow(run, ddl).unionByName(rest)


def op10_bpe_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(read_table(spark, sf_dir, "documents"))
