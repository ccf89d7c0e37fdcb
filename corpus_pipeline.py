"""Corpus pipeline: quality filter, line dedup, near-duplicate removal, decontamination, BPE ids.

Each stage takes the rows that the stage before it kept, written and read again. Defined results: a null text is
an empty one and stays null until its ids are made; an empty or unlabelled table passes through; rows without
doc_id train nothing, lose no lines, are nobody's duplicates and stay unless a filter rejects their text. Of
near-duplicates the least doc_id stays, with all rows that carry it; repeated rows are otherwise kept or dropped
alike. All columns of ``documents`` come through the first four stages, clashing names included; the last one
adds ``ids`` and ``n_tokens`` (clashing ones are replaced).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelspark.llm import bpe_text, decontaminate, line_dedup, near_dups, quality
from duelspark.llm.common import read_table, stored


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it is trained on labelled rows of the same documents."""
    weights = quality.train(docs, read_table(spark, sf_dir, "labels"))
    return quality.score(docs, weights).filter("quality_predicted = 1").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least doc_id stays."""
    return near_dups.dedup(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def bpe_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_text.encode_text(docs).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", dedup_lines),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("BPE encoding and decoding", bpe_ids),
]

#: A trained classifier and sketches aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage-{k + 1}")
    return docs
