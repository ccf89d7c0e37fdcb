"""Reports of whole stages: named tables that ``sources.artifacts.write_bundle`` writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import BankrollConfig, ValueThresholds
from ..functions import numbers as N
from . import bankroll, canonical, decisions, markets, metrics, models, records, resample


def training_summary(frame: DataFrame, features: tuple[str, ...], part: str = "part") -> DataFrame:
    """Per partition: rows, wins, class balance, first and last date, nulls per feature."""
    return frame.groupBy(part).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.col("y").cast("long")).alias("wins"),
        F.avg(F.col("y").cast("double")).alias("positive_rate"),
        F.min("match_date").alias("first_date"),
        F.max("match_date").alias("last_date"),
        *[F.count_if(F.col(f).isNull()).alias(f"null_{f}") for f in features],
    )


def validate_partitions(frame: DataFrame, parts: tuple[str, ...], part: str = "part") -> None:
    """Each partition has rows of both classes, and no id is in two."""
    found = {r[part]: r for r in frame.groupBy(part).agg(F.count_distinct("y").alias("classes")).collect()}
    bad = [p for p in parts if p not in found or found[p]["classes"] < 2]
    shared = frame.groupBy("match_id").agg(F.count_distinct(part).alias("n")).filter("n > 1").limit(1).count()
    if bad or shared:
        raise ValueError(f"partitions without both classes: {bad}; ids in several partitions: {bool(shared)}")


def compare_on_same_rows(frame: DataFrame, keys: list[str], y: str, p: str, other: str) -> DataFrame:
    """Both probabilities on the rows that have the second; skipped rows are counted."""
    t = F.col(y).cast("double")
    has = F.col(other).isNotNull()
    out = frame.groupBy(*keys).agg(
        F.count_if(has).alias("compared_rows"),
        F.count_if(~has).alias("skipped_rows"),
        F.avg(F.when(has, N.row_log_loss(t, F.col(p)))).alias("model_log_loss"),
        F.avg(F.when(has, N.row_log_loss(t, F.col(other)))).alias("other_log_loss"),
        F.avg(F.when(has, F.pow(F.col(p) - t, 2))).alias("model_brier"),
        F.avg(F.when(has, F.pow(F.col(other) - t, 2))).alias("other_brier"),
    )
    return out.withColumn("log_loss_improvement", F.col("other_log_loss") - F.col("model_log_loss"))


def coverage_by(frame: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows and the share of non-null values of each column."""
    return frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *[F.avg(F.col(c).isNotNull().cast("double")).alias(f"share_{c}") for c in columns])


def best_source(frame: DataFrame, keys: list[str], y: str = "y", p: str = "probability") -> DataFrame:
    """Source with the least log loss of its own no-margin probability; ties go to the first name."""
    losses = frame.groupBy(*keys, "source").agg(F.avg(N.row_log_loss(F.col(y).cast("double"), F.col(p))).alias("loss"))
    return losses.groupBy(*keys).agg(F.min(F.struct("loss", "source")).alias("best")).select(*keys, F.col("best.source").alias("source"), F.col("best.loss").alias("raw_market_log_loss"))


def evaluation(predictions: DataFrame, part: str, y: str, p: str, odds: tuple[str, str]) -> dict[str, DataFrame]:
    table = metrics.calibration_table(predictions, [part], y, p)
    return {
        "metrics.parquet": metrics.probability_metrics(predictions, [part], y, p),
        "calibration.parquet": table,
        "calibration_summary.parquet": metrics.calibration_summary(table, [part]),
        "surface_metrics.parquet": metrics.probability_metrics(predictions, [part, "surface"], y, p),
        "bookmaker.parquet": metrics.bookmaker_baseline(predictions, [part], y, p, odds),
    }


def decisions_bundle(predictions: DataFrame, limits: ValueThresholds) -> dict[str, DataFrame]:
    assessed = decisions.assess(predictions, limits)
    chosen = assessed.filter("has_recommendation")
    return {
        "assessments.parquet": assessed.orderBy("match_date", "partition", "match_id"),
        "summary.json": decisions.value_summary(assessed),
        "skip_reasons.csv": decisions.reason_counts(assessed),
        "by_surface.csv": chosen.groupBy("surface").count(),
        "by_partition.csv": chosen.groupBy("partition").count(),
    }


def backtest(assessed: DataFrame, config: BankrollConfig) -> dict[str, DataFrame]:
    book = bankroll.ledger(records.require(assessed, records.recommendation_rules()), config)
    return {
        "ledger.parquet": book,
        "curve.parquet": bankroll.drawdown(book, config.start),
        "streaks.csv": bankroll.longest_streaks(book),
        "summary.json": bankroll.ledger_summary(book, config),
        **{f"by_{k}.csv": bankroll.performance(book, [k]) for k in ("surface", "edge_bucket", "odds_bucket")},
    }


def architecture_report(rows: DataFrame, samples: int = resample.SAMPLES) -> dict[str, DataFrame]:
    """Metrics, calibration, direction and block bootstrap of architectures, by year and combined.

    The recalibrated probability of a match is put beside its other architectures by one window."""
    segments = metrics.year_and_combined(rows, [])
    keys = ["architecture", "segment"]
    table = metrics.calibration_table(segments, keys, "y", "p")
    bucketed = rows.withColumn("bucket", F.explode(F.array(N.bucket(F.col("correction"), N.SIGNED_BUCKETS), F.lit("all"))))
    recalibrated = rows.filter("architecture = 'market_recalibration'").select("match_id", "fold", F.col("p").alias("recalibrated"))
    both = segments.join(recalibrated, ["match_id", "fold"], "left")
    loss = lambda c: N.row_log_loss(F.col("y"), F.col(c))
    blocks = {name: resample.block_sums(both, keys, loss(c) - loss("p")) for name, c in (("raw_market", "market_probability"), ("market_recalibration", "recalibrated"))}
    return {
        "metrics.parquet": metrics.probability_metrics(segments, keys, "y", "p").join(metrics.calibration_summary(table, keys), keys),
        "compared.parquet": markets.compared(segments, keys, "y", "p", "market_probability"),
        "direction.parquet": markets.compared(bucketed, ["architecture", "bucket"], "y", "p", "market_probability"),
        "slope.csv": markets.direction_slope(rows.withColumn("residual", F.col("y") - F.col("market_probability")), ["architecture"], "residual", "correction"),
        "sensitivity.csv": markets.sensitivity(rows, ["architecture"], "y", "p", "market_probability"),
        **{f"bootstrap_{name}.parquet": resample.block_bootstrap(b.filter("total is not null"), keys, samples) for name, b in blocks.items()},
    }


def price_audit(raw: DataFrame) -> dict[str, DataFrame]:
    flagged = markets.quality_flags(raw).withColumn("year", F.year("match_date"))
    return {"flags.parquet": flagged, "overround.csv": markets.overround_by(flagged, ["odds_source", "year"]), "sources.json": canonical.counts_map(flagged, "odds_source", "odds_sources")}


def missingness(frame: DataFrame, columns: tuple[str, ...] = (*models.NUMERIC, *models.BINARY)) -> DataFrame:
    counts = frame.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in columns])))
