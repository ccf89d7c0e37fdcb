"""Canonical exact digest, DataFrame functions only.

Canonical form: Unicode NFKC, full case folding and NFKC again (ICU's static methods, which Spark ships,
called with ``java_method``), white space runs folded to one blank, ends trimmed. The digest is 128 bits of
two differently seeded xxhash64 runs. Inside every bucket of equal digests the canonical bytes are
compared; should two differ, the bucket's texts get a rank after the digest, so that fingerprints
are equal exactly where canonical texts are.

Defined results: a null text is an empty one; rows with equal doc_id stand next to each other by
text; rows without doc_id come last. Columns other than those named aren't touched. Empty tables
give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free, read_table, stored, width

#: Runs of neighbouring documents, cut by count, for each shuffle partition; a run is sorted in one task.
RUNS = 4


def canonical(text: Column) -> Column:
    whole = F.coalesce(text, F.lit(""))
    composed = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), whole, F.lit(True))
    folded = F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), composed, F.lit(True))
    again = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), folded, F.lit(True))
    return F.trim(F.regexp_replace(again, "[\\s\\p{Z}]+", " "))


def digest(canon: Column) -> Column:
    """128-bit xxhash as 32 hex digits: two chains that start from different seeds."""
    part = lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")
    return F.concat(part(F.xxhash64(canon)), part(F.xxhash64(F.lit("second"), canon)))


def collisions(docs: DataFrame) -> DataFrame:
    """(digest, canon, rank) of buckets whose canonical texts aren't all the same bytes; expected empty.

    Texts of digests that occur once aren't compared. A digest that holds more than a task's share of the rows
    never meets in one task: each task sends on its least and greatest text."""
    keyed = docs.select(canonical(F.col("text")).alias("canon")).withColumn("digest", digest(F.col("canon")))
    shared = stored(keyed.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "shared-digests")
    parts = width(docs.sparkSession)
    share = F.lit(max(1000, (shared.agg(F.sum("n")).first()[0] or 0) // parts))
    hot = shared.filter(F.col("n") > share).select("digest")  # at most one per shuffle partition
    few = keyed.join(F.broadcast(hot), "digest", "left_anti").join(shared.filter(F.col("n") <= share).select("digest"), "digest", "left_semi")
    many = keyed.join(F.broadcast(hot), "digest", "left_semi")
    ends = [F.min(F.encode("canon", "utf-8")).alias("low"), F.max(F.encode("canon", "utf-8")).alias("high")]
    odd = few.groupBy("digest").agg(*ends).unionByName(many.groupBy("digest").agg(*ends)).filter("low <> high").select("digest")
    texts = keyed.join(odd, "digest", "left_semi").distinct()
    return texts.withColumn("rank", F.row_number().over(Window.partitionBy("digest").orderBy("canon")))


def fingerprint(docs: DataFrame, clashes: DataFrame | None, text: str, name: str) -> DataFrame:
    """``docs`` with the column ``name``; clashes: what collisions() found, None if nothing."""
    if clashes is None:
        return docs.withColumn(name, digest(canonical(F.col(text))))
    keyed = docs.withColumn("__canon", canonical(F.col(text))).withColumn("__digest", digest(F.col("__canon")))
    ranks = clashes.select(F.col("digest").alias("__d"), F.col("canon").alias("__c"), F.col("rank").alias("__rank"))
    joined = keyed.join(ranks, (F.col("__digest") == F.col("__d")) & (F.col("__canon") == F.col("__c")), "left")
    return joined.withColumn(name, F.concat_ws("-", "__digest", F.col("__rank").cast("string"))).drop("__canon", "__digest", "__d", "__c", "__rank")


def exact_groups(docs: DataFrame) -> DataFrame:
    """``docs`` with fingerprint and group_id, the least doc_id with equal canonical text, as last columns; clashing
    ones are replaced."""
    kept = docs.drop("fingerprint", "group_id")
    inner = kept.select("doc_id", "text", F.struct(*kept.columns).alias(free(kept, "__row")))
    marked = fingerprint(inner, known_clashes(kept), "text", "fingerprint")
    least = marked.groupBy("fingerprint").agg(F.min("doc_id").alias("group_id"))
    return marked.join(least, "fingerprint").select(f"{inner.columns[-1]}.*", "fingerprint", "group_id")


def known_clashes(docs: DataFrame) -> DataFrame | None:
    found = stored(collisions(docs), "digest-clashes")
    return None if found.isEmpty() else found


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` with next_<column> of the row after it in descending doc_id order, cyclically.

    Runs of neighbouring ids, cut at quantiles of doc_id so that they hold like numbers of rows, are windows of
    their own; the first row of each run is handed to the run before it."""
    runs = RUNS * width(docs.sparkSession)
    cuts = docs.agg(F.percentile_approx("doc_id", [k / runs for k in range(1, runs)], 20 * runs)).first()[0] or []
    edges = F.array(*[F.lit(x).cast("long") for x in sorted(set(cuts))]) if cuts else F.array().cast("array<long>")
    number = F.size(F.filter(edges, lambda x: x < F.col("doc_id")))  # a few cuts a shuffle partition
    keyed = docs.withColumn("__run", F.coalesce(F.when(F.col("doc_id").isNotNull(), number), F.lit(-1)))
    window = Window.partitionBy("__run").orderBy(F.desc_nulls_last("doc_id"), F.asc("text"))
    led = keyed.select("*", F.lead(F.struct(*columns)).over(window).alias("__next"), F.row_number().over(window).alias("__place"))
    firsts = led.filter("__place = 1").select(F.col("__run").alias("__after"), F.struct(*columns).alias("__first"))
    order = Window.orderBy(F.desc("__run"))  # one number a run
    after = keyed.select("__run").distinct().select("__run", F.coalesce(F.lead("__run").over(order), F.max("__run").over(Window.partitionBy())).alias("__after"))
    handed = after.join(firsts, "__after").select("__run", "__first")
    joined = led.join(handed, "__run")
    following = F.coalesce("__next", "__first")
    return joined.select(*docs.columns, *[following[c].alias(f"next_{c}") for c in columns])


def digest_report(docs: DataFrame) -> DataFrame:
    """Per document: fingerprints of its text and its edited text, and their likeness (1 equal, 0 not)."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    clashes = known_clashes(slim)
    marked = fingerprint(slim, clashes, "text", "fingerprint")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 3) as int))"), F.expr("substring(next_text, 1, cast(floor(length(text) / 3) as int))"))
    both = with_next(marked, ["text", "fingerprint"]).withColumn("edited", edited)
    both = fingerprint(both, clashes, "edited", "edited_fingerprint")
    alike = lambda other: (F.col("fingerprint") == F.col(other)).cast("double")
    return both.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        alike("edited_fingerprint").alias("near_edited"),
        alike("next_fingerprint").alias("near_next"),
    )


def op9_exact_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_report(read_table(spark, sf_dir, "documents"))
