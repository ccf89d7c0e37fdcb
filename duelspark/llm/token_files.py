"""Token-id files: one shared frequency table, rANS blocks in ascending doc_id order, parallel decoding.

The files are two Parquet tables in one folder (Spark's commit protocol keeps retried tasks from leaving
half a file). ``blocks``: ``shard, block, at`` (tokens of the shard before the block), ``n_tokens``, ``docs``
(doc ids and lengths, compressed) and ``payload`` (see rans.py). Shards are ranges of doc_id, so shard, block
and place in block give the order of all documents. ``table``: one row with the frequency table, the
vocabulary's sha256 and the end id. The folder alone is enough to decode.

Defined results: a null text is an empty one, whose only token is the end id; rows with equal
doc_id stand next to each other, by text; a null doc_id stands first. Empty tables give an empty
result. Columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import prepare, read_table, shared_dir, stored, strings, width
from .rans import Table, decode_block, encode_block
from .vocab import ByteBpe, tokenizer_json

END_ID = 0
#: A block is closed when it holds so many tokens; documents aren't cut.
BLOCK_TOKENS = 1 << 20

_TOKENS = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
_BLOCKS = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("docs", pa.binary()), ("payload", pa.binary())])
_BLOCKS_DDL = "shard long, block long, at long, n_tokens long, docs binary, payload binary"
_coders: dict[int, ByteBpe] = {}


def _coder(source: str) -> ByteBpe:
    key = hash(source)
    if key not in _coders:
        _coders.clear()
        _coders[key] = ByteBpe(source)
    return _coders[key]


def encode_documents(docs: DataFrame, source: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, tie, n_tokens, ids): ids with the end id, zstd-compressed 32-bit integers."""
    shared = docs.sparkSession.sparkContext.broadcast(source)  # one vocabulary file, of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, pack = _coder(shared.value), zstandard.ZstdCompressor(3)
        for batch in batches:
            counts, blobs, ties = [], [], []
            for text in strings(batch, "text").to_pylist():
                ids = coder.encode(text)
                ids = np.append(ids, ids.dtype.type(end_id))
                counts.append(len(ids))
                blobs.append(pack.compress(_packed(ids)))
                ties.append(zlib.crc32(text.encode("utf-8", "surrogatepass")))
            doc = batch.column(batch.schema.get_field_index("doc_id"))
            yield pa.RecordBatch.from_arrays([doc, pa.array(ties, pa.int64()), pa.array(counts, pa.int64()), pa.array(blobs, pa.binary())], schema=_TOKENS)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, tie long, n_tokens long, ids binary")


def _packed(ids: np.ndarray) -> bytes:
    return bytes([ids.dtype.itemsize]) + ids.tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    return np.frombuffer(raw, "<u2" if raw[:1] == b"\2" else "<u4", offset=1).astype(np.uint32)


def token_counts(tokens: DataFrame) -> DataFrame:
    """(token, n) over all documents; each task sends one row per token it has seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            blobs = batch.column(0).to_pylist()
            for k in range(0, len(blobs), 64):
                found = np.bincount(np.concatenate([_unpacked(b) for b in blobs[k : k + 64]]))
                if len(found) > len(total):
                    total = np.pad(total, (0, len(found) - len(total)))
                total[: len(found)] += found
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["token", "n"])

    return tokens.select("ids").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def write_blocks(tokens: DataFrame, table: bytes, path: str, block_tokens: int = BLOCK_TOKENS) -> None:
    """Encode in ascending doc_id order and write the block table."""
    spark = tokens.sparkSession
    shared = spark.sparkContext.broadcast(table)  # at most one entry per id of the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freqs, shard = Table.loads(shared.value), TaskContext.get().partitionId()
        ids: list[int | None] = []
        runs: list[np.ndarray] = []
        held = at = block = 0

        def made() -> pa.RecordBatch:
            stream = np.concatenate(runs)
            lengths = np.array([len(x) for x in runs], "<u4")
            known = np.array([x is not None for x in ids], np.uint8)
            docs = zlib.compress(np.array([x or 0 for x in ids], "<i8").tobytes() + lengths.tobytes() + known.tobytes(), 1)
            columns = [shard, block, at, held, docs, encode_block(stream, freqs)]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(columns, _BLOCKS)], schema=_BLOCKS)

        for batch in batches:
            for doc, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(doc)
                runs.append(_unpacked(blob))
                held += len(runs[-1])
                if held >= block_tokens:
                    yield made()
                    at, block, held, ids, runs = at + held, block + 1, 0, [], []
        if runs:
            yield made()

    ordered = tokens.repartitionByRange(width(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    ordered.select("doc_id", "ids").mapInArrow(run, _BLOCKS_DDL).write.option("compression", "zstd").parquet(path)


def read_blocks(blocks: DataFrame, table: bytes) -> DataFrame:
    """(shard, doc_id, at, n_tokens, ids_crc32) per document; each block is decoded on its own, all its parts
    from their checkpoints side by side."""
    shared = blocks.sparkSession.sparkContext.broadcast(table)
    schema = pa.schema([("shard", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freqs = Table.loads(shared.value)
        for batch in batches:
            for row in batch.to_pylist():
                raw = zlib.decompress(row["docs"])
                n = len(raw) // 13
                ids, lengths, known = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "<u4", n, 8 * n).astype(np.int64), np.frombuffer(raw, np.uint8, n, 12 * n)
                tokens = decode_block(row["payload"], freqs).astype("<u4")
                ends = np.cumsum(lengths)
                crcs = [zlib.crc32(tokens[e - m : e].tobytes()) for e, m in zip(ends, lengths)]
                columns = [np.full(n, row["shard"]), pa.array(ids, mask=known == 0), row["at"] + ends - lengths, lengths, np.array(crcs, np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) if isinstance(x, np.ndarray) else x for x in columns], schema=schema)

    return blocks.select("shard", "at", "docs", "payload").mapInArrow(run, "shard long, doc_id long, at long, n_tokens long, ids_crc32 long")


def write_token_file(docs: DataFrame, folder: str, tokenizer_path: str | None = None, end_id: int = END_ID) -> None:
    """Encode ``docs`` and write blocks, frequency table and the vocabulary's digest to ``folder``."""
    spark = docs.sparkSession
    prepare(spark)
    source = tokenizer_json(tokenizer_path, "byte_bpe_50k.json")
    tokens = stored(encode_documents(docs, source, end_id), "token-ids")
    counts = token_counts(tokens).toPandas()  # at most one row per id of the vocabulary
    table = Table.of(counts["token"].to_numpy(np.int64), counts["n"].to_numpy(np.float64)).dumps()
    write_blocks(tokens, table, f"{folder}/blocks")
    row = (bytearray(table), hashlib.sha256(source.encode()).hexdigest(), end_id)
    spark.createDataFrame([row], "frequencies binary, vocabulary_sha256 string, end_id long").coalesce(1).write.parquet(f"{folder}/table")


def read_token_file(spark: SparkSession, folder: str, tokenizer_path: str | None = None) -> DataFrame:
    """doc_id, start (tokens of all documents before it), n_tokens and ids_crc32, from the files alone.

    With a vocabulary, its digest must be the files' own."""
    prepare(spark)
    row = spark.read.parquet(f"{folder}/table").first()  # one row
    if tokenizer_path is not None and hashlib.sha256(tokenizer_json(tokenizer_path, "").encode()).hexdigest() != row["vocabulary_sha256"]:
        raise ValueError("the files were written with another vocabulary")
    blocks = spark.read.schema(_BLOCKS_DDL).parquet(f"{folder}/blocks")
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # one row per shard
    before = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    read = read_blocks(blocks, bytes(row["frequencies"])).join(F.broadcast(before), "shard")
    return read.select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    write_token_file(read_table(spark, sf_dir, "documents"), folder)
    return read_token_file(spark, folder)
