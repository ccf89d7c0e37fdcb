import random

from pyspark.sql import functions as F

import corpus_pipeline
from duelspark.llm import decontaminate

from .helpers import AWKWARD, frame


def test_stages_on_a_small_corpus(spark, tmp_path):
    rng = random.Random(8)
    good, bad = ["the", "river", "was", "calm", "and", "clear", "today", "we", "walked", "along"], ["buy", "$$$", "now", "click", "###"]
    text = lambda pool: " ".join(rng.choice(pool) + str(rng.randrange(40)) for _ in range(60))
    item = " ".join(good[:8]) * 3
    data = [(k, text(bad if k % 5 == 0 else good)) for k in range(200)]
    near = data[1][1].split()
    data += [(900, " ".join([*near[:58], "other", "end"])), (901, text(good) + " " + item + " " + text(good)), (902, "A line all share here\n" + text(good)), (903, "A line all share here\n" + text(good))]
    labels = [(d, int(d % 5 > 0), 0) for d, _ in data[:200]]
    frame(spark, data + AWKWARD).drop("h1", "pos", "chunk", "ids", "node").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "quality classifier":
            assert not {k for k in range(0, 200, 5)} & set(after) and {k for k in range(200) if k % 5} <= set(after)
        elif name == "line dedup":
            assert after[902] == before[902] and after[903] == before[903].split("\n")[1] and set(after) == set(before)
        elif name == "MinHash near-dedup":
            assert set(before) - set(after) == {900}
        elif name == "benchmark decontamination":
            matcher = decontaminate.Matcher([(1, item)])
            assert set(before) - set(after) == {d for d, t in before.items() if matcher.find(t or "")} == {901}
        else:
            assert set(after) == set(before) and docs.filter("n_tokens <> size(ids)").count() == 0
    assert len(corpus_pipeline.STAGES) == 5


def test_stages_take_empty_tables_nulls_and_clashing_columns(spark, tmp_path):
    rows = [*AWKWARD, (20, "one two three four five six"), (20, "one two three four five six"), (21, "one two three four five six")]
    docs = frame(spark, rows).withColumn("__maps", F.lit("m")).withColumn("__gone", F.lit(1)).withColumn("quality_score", F.lit(0.5))
    spark.createDataFrame([(20, 1, 0), (21, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (None, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for given in (docs, docs.limit(0)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, given, str(tmp_path))
            wanted = given.columns if k < 4 else [*(c for c in given.columns if c not in ("ids", "n_tokens")), "ids", "n_tokens"]
            assert out.columns == wanted and out.count() <= given.count()
    kept = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in kept if r["doc_id"] in (20, 21)} == {20: 2}  # repeated rows of one id stay together


def test_run_applies_the_stages_in_order(spark, tmp_path):
    data = [(k, " ".join("good" + str((k * j) % 97) for j in range(1, 60))) for k in range(40)]
    frame(spark, data).drop("h1", "pos", "chunk", "ids", "node").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, data[3][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/s{k}")
        docs = spark.read.parquet(f"{tmp_path}/s{k}")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == docs.columns and sorted(map(str, got.collect())) == sorted(map(str, docs.collect())) and got.filter("doc_id = 3").count() == 0
