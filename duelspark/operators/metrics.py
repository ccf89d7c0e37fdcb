"""Probability metrics, exact ROC-AUC, calibration, baselines, validated joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N


def metric_columns(y: Column, p: Column) -> list[Column]:
    y = y.cast("double")
    return [
        F.count(F.lit(1)).alias("sample_count"),
        F.avg(y).alias("base_rate"),
        F.avg(N.row_log_loss(y, p)).alias("log_loss"),
        F.avg((p - y) * (p - y)).alias("brier_score"),
        F.avg(((p >= 0.5).cast("int") == y.cast("int")).cast("double")).alias("accuracy"),
        F.avg(p).alias("mean_probability"),
        F.min(p).alias("min_probability"),
        F.max(p).alias("max_probability"),
    ]


def roc_auc(frame: DataFrame, keys: list[str], y: str, p: str) -> DataFrame:
    """Exact area by mid-ranks; null for one class. Ties are aggregated before anything is ordered."""
    cells = frame.groupBy(*keys, p).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*keys).orderBy(p).rowsBetween(Window.unboundedPreceding, -1)
    ranked = cells.withColumn("less", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("rank", F.col("less") + (F.col("n") + 1) / 2)
    sums = ranked.groupBy(*keys).agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("a"), F.sum(F.col("n") - F.col("pos")).alias("b"))
    area = F.try_divide(F.col("r") - F.col("a") * (F.col("a") + 1) / 2, (F.col("a") * F.col("b")).cast("double"))
    return sums.select(*keys, F.when((F.col("a") > 0) & (F.col("b") > 0), area).alias("roc_auc"))


def probability_metrics(frame: DataFrame, keys: list[str], y: str, p: str) -> DataFrame:
    return frame.groupBy(*keys).agg(*metric_columns(F.col(y), F.col(p))).join(roc_auc(frame, keys, y, p), keys)


def year_and_combined(frame: DataFrame, keys: list[str], year: str = "year") -> DataFrame:
    """Each row once in its year's segment and once in the combined one."""
    return frame.withColumn("segment", F.explode(F.array(F.col(year).cast("string"), F.lit("combined"))))


def calibration_table(frame: DataFrame, keys: list[str], y: str, p: str) -> DataFrame:
    """Per tenth of probability: count, mean prediction, observed rate, error; empty bins are absent."""
    binned = frame.withColumn("bin", N.calibration_bin(F.col(p)))
    table = binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_predicted"), F.avg(F.col(y).cast("double")).alias("observed_rate"))
    label = F.format_string("%.2f-%.2f", F.col("bin") / 10.0, (F.col("bin") + 1) / 10.0)
    return table.withColumn("label", label).withColumn("calibration_error", F.col("observed_rate") - F.col("mean_predicted"))


def calibration_summary(table: DataFrame, keys: list[str]) -> DataFrame:
    error = F.abs("calibration_error")
    return table.groupBy(*keys).agg((F.sum(error * F.col("n")) / F.sum("n")).alias("expected_calibration_error"), F.max(error).alias("maximum_calibration_error"))


def bookmaker_baseline(frame: DataFrame, keys: list[str], y: str, p: str, odds: tuple[str, str]) -> DataFrame:
    """On rows with valid odds: model against the no-margin market."""
    a, b = (F.col(c) for c in odds)
    valid = frame.filter(N.odds_pair_valid(a, b)).withColumn("market", N.no_vig(a, b)).withColumn("overround", N.overround(a, b))
    own = valid.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.avg("overround").alias("mean_overround"),
        F.min("overround").alias("min_overround"),
        F.max("overround").alias("max_overround"),
        *[F.avg(x).alias(f"{name}_{m}") for name, q in (("model", p), ("market", "market")) for m, x in (("log_loss", N.row_log_loss(F.col(y).cast("double"), F.col(q))), ("brier", F.pow(F.col(q) - F.col(y).cast("double"), 2)))],
    )
    return own.withColumn("log_loss_improvement", F.col("market_log_loss") - F.col("model_log_loss")).withColumn("brier_improvement", F.col("market_brier") - F.col("model_brier"))


def join_validated(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """LEFT join that fails if a key occurs twice on the right."""
    if right.groupBy(key).count().filter("count > 1").limit(1).count():
        raise ValueError(f"{key} isn't unique on the right side")
    return left.join(right, key, "left")


def validate_predictions(frame: DataFrame, p1: str, p2: str, tolerance: float = 1e-9 + 1e-5) -> None:
    bad = frame.agg(
        F.count_if(~F.coalesce(F.col(p1).between(0, 1) & F.col(p2).between(0, 1), F.lit(False))).alias("outside"),
        F.count_if(F.abs(F.col(p1) + F.col(p2) - 1) > tolerance).alias("sums"),
        (F.count("match_id") - F.count_distinct("match_id")).alias("duplicates"),
    ).first()
    if any(bad):
        raise ValueError(f"invalid predictions: {bad.asDict()}")
