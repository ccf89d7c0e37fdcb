"""Quality classifier: hashed word n-gram logistic regression, follow-the-regularised-leader updates.

Features of a text are hashed words and word pairs, plus hashed shape marks of its words and lines
(share of digits, of punctuation, of capitals, mean length, repeats), each once with a weight that
falls with the text's number of features. Training goes through at most ``sample_rows`` labelled
rows, those with the smallest hash of doc_id (``sample_rows`` is the documented bound of the labelled
sample); one executor task runs the updates and returns 2**bits weights. Scoring is a sum of the
weights at a text's features, over whole texts and all rows.

Defined results: a null or empty text has only its bias, and gets a score; without labelled rows
every score is the prior 0.5. A document labelled twice counts twice. Labels or documents without
doc_id don't train; such documents are scored, held_out null. Extra columns are left alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import IS_SPACE, Words, mix, prepare, read_table, spans, strings, windows

BITS = 20
SAMPLE_ROWS = 12_000
THRESHOLD = 0.7
ALPHA, BETA, L1, L2, EPOCHS = 0.3, 1.0, 0.02, 0.5, 3
_PAIR_BASE = 0x2545F4914F6CDD1D


def _kinds() -> np.ndarray:
    kind = np.zeros(256, np.uint8)  # 0 letter, 1 digit, 2 capital, 3 punctuation, 4 blank, 5 newline
    kind[0x21:0x30] = kind[0x3A:0x41] = kind[0x5B:0x61] = kind[0x7B:0x7F] = 3
    kind[0x30:0x3A] = 1
    kind[0x41:0x5B] = 2
    kind[IS_SPACE] = 4
    kind[0x0A] = 5
    return kind


_KIND = _kinds()


def features(column: pa.Array, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For consecutive rows: feature slots, their weights, and bounds of each row's features.

    Word and pair slots of a text weigh 1/sqrt(their number); shape marks weigh 1."""
    mask = np.uint64((1 << bits) - 1)
    for _, _, data, offsets in spans(column):
        words = Words(data, offsets)
        hashes, bounds, n = words.hashes(lower=True), words.bounds, words.counts()
        pairs = windows(hashes, 2, _PAIR_BASE)
        kinds = _KIND[data]
        per = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])
        size = np.maximum(1, np.diff(offsets))
        shares = [per(kinds == k) / size for k in (1, 2, 3, 5)]
        long_words = np.concatenate([[0], np.cumsum(words.end - words.start)])
        mean_length = np.diff(long_words[bounds]) / np.maximum(1, n)
        slots, weights, ends = [], [], [0]
        for k in range(len(n)):
            a, b = bounds[k], bounds[k + 1]
            h = hashes[a:b]
            grams = np.concatenate([h, pairs[a : max(a, b - 1)]])
            repeated = 1 - len(np.unique(h)) / max(1, len(h))
            line_words = n[k] / (1 + shares[3][k] * size[k])
            marks = [*(int(40 * s[k] ** 0.5) for s in shares), int(4 * mean_length[k]), int(20 * repeated), int(2 * np.log2(1 + n[k])), int(3 * np.log2(1 + line_words))]
            shape = mix(np.array([1 << 16 | j << 10 | min(1023, m) for j, m in enumerate(marks)] + [0], np.uint64), 91)
            slots += [grams & mask, shape & mask]
            weights += [np.full(len(grams), 1 / max(1, len(grams)) ** 0.5), np.ones(len(shape))]
            ends.append(ends[-1] + len(grams) + len(shape))
        yield np.concatenate(slots).astype(np.int64), np.concatenate(weights), np.array(ends)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS, seed: int = 7) -> np.ndarray:
    """Follow-the-regularised-leader proximal updates, one example at a time."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)

    def weights(slots: np.ndarray) -> np.ndarray:
        part = z[slots]
        return np.where(np.abs(part) <= L1, 0.0, (np.sign(part) * L1 - part) / ((BETA + np.sqrt(n[slots])) / ALPHA + L2))

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            slots, x, label = rows[k]
            w = weights(slots)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - label) * x
            sigma = (np.sqrt(n[slots] + g * g) - np.sqrt(n[slots])) / ALPHA
            z[slots] += g - sigma * w
            n[slots] += g * g
    return weights(np.arange(1 << bits)).astype(np.float32)


def _merged(slots: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, inverse = np.unique(slots, return_inverse=True)
    return at, np.bincount(inverse, x)


def training_rows(docs: DataFrame, labels: DataFrame, sample_rows: int, folds: bool) -> DataFrame:
    """(text, label) of at most ``sample_rows`` labelled rows; with folds, none that is held out."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    if folds:
        marks = marks.filter(~held_out(F.col("doc_id")))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").select(F.xxhash64("doc_id").alias("place"), "text", "label")


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, folds: bool = True, bits: int = BITS) -> bytes:
    """2**bits float32 weights, trained in one task from the bounded sample's features."""
    prepare(docs.sparkSession)
    sample = training_rows(docs, labels, sample_rows, folds)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots, xs = [], []
            for s, x, ends in features(strings(batch, "text"), bits):
                for a, b in zip(ends[:-1], ends[1:]):
                    at, w = _merged(s[a:b], x[a:b])
                    slots.append(at.astype("<u4").tobytes())
                    xs.append(w.astype("<f4").tobytes())
            keep = [batch.column(batch.schema.get_field_index(c)) for c in ("place", "label")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(slots, pa.binary()), pa.array(xs, pa.binary())], names=["place", "label", "slots", "xs"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for r in batch.to_pylist():
                rows.append((r["place"], r["slots"], r["xs"], r["label"]))
        rows.sort()
        ready = [(np.frombuffer(s, "<u4").astype(np.int64), np.frombuffer(x, "<f4").astype(float), y) for _, s, x, y in rows]
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(ftrl(ready, bits).tobytes(), 1)], pa.binary())], names=["weights"])

    rows = sample.mapInArrow(hashed, "place long, label int, slots binary, xs binary")
    return rows.repartition(1).mapInArrow(fit, "weights binary").first()["weights"]  # at most sample_rows rows


def score(docs: DataFrame, weights: bytes, threshold: float = THRESHOLD, bits: int = BITS) -> DataFrame:
    """``docs`` with quality_score and quality_predicted after its own columns (clashing ones are replaced)."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2**bits numbers
    kept = [c for c in docs.columns if c not in ("quality_score", "quality_predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.frombuffer(zlib.decompress(shared.value), np.float32)
        for batch in batches:
            sums = [np.add.reduceat(w[s] * x, ends[:-1]) for s, x, ends in features(strings(batch, "text"), bits)]
            total = np.concatenate(sums) if sums else np.empty(0)
            p = 1 / (1 + np.exp(-np.clip(total.astype(float), -30, 30)))
            out = batch.select(kept)
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*kept, "quality_score", "quality_predicted"])

    slim = docs.select(*kept)
    added = [T.StructField("quality_score", T.DoubleType()), T.StructField("quality_predicted", T.IntegerType())]
    return slim.mapInArrow(run, T.StructType([*slim.schema.fields, *added]))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    weights = train(docs, read_table(spark, sf_dir, "labels"))
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), weights)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_predicted").alias("predicted"))
