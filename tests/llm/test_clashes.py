"""Operators that pass columns through: names that clash with inner ones, and empty tables."""

import pytest

from duelspark.llm import bpe_text, decontaminate, exact_digest, line_dedup, near_dups, quality

from .helpers import AWKWARD, frame

CLASHING = ["__doc", "__maps", "__body", "__gone", "__row", "__ids", "row", "key", "node", "digest", "canon", "__run", "quality_score", "entry", "Fingerprint"]


def clashing(spark, rows):
    docs = frame(spark, rows)
    for name in CLASHING:
        docs = docs.withColumn(name, docs["lang"])
    return docs


@pytest.mark.parametrize("empty", [False, True])
def test_clashing_columns(spark, empty):
    rows = [*AWKWARD, (20, "A line all share here\none"), (21, "A line all share here\ntwo"), (30, "same words in both of these"), (31, "same words in both of these")]
    docs = clashing(spark, rows)
    docs = docs.limit(0) if empty else docs
    bench = spark.createDataFrame([(1, "a line all share here")], "item_id long, text string")
    n = docs.count()
    deduped = line_dedup.dedup_lines(docs)
    assert deduped.columns == docs.columns and deduped.count() == n and (empty or deduped.filter("doc_id = 21").first()["text"] == "two")
    left = near_dups.dedup(docs)
    assert left.columns == docs.columns and left.filter("doc_id = 31").count() == 0
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns and clean.count() == (0 if empty else n - 2)
    for most in (bpe_text.LONG_BYTES, 1000):
        encoded = bpe_text.encode_text(docs, long_bytes=most)
        assert encoded.columns == [*(c for c in docs.columns if c != "ids"), "ids"] and encoded.count() == n
    grouped = exact_digest.exact_groups(docs.drop("Fingerprint"))
    assert grouped.columns[-2:] == ["fingerprint", "group_id"] and grouped.count() == n
    scored = quality.score(docs, quality.train(docs, spark.createDataFrame([], "doc_id long, quality int")))
    assert scored.columns[-2:] == ["quality_score", "quality_predicted"] and scored.count() == n
