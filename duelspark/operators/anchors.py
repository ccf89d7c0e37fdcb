"""Each market source as the anchor: predictions, metrics by segment, block bootstrap, summary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Fold
from ..functions import numbers as N
from . import markets, metrics, models, resample

# Scopes and architectures.
SCOPES = ("source_specific", "common_all_sources")
RAW, RECALIBRATED, FORM = "raw_market", "market_recalibration", "free_form_workload"
FITTED = {RECALIBRATED: (models.MARKET,), FORM: (models.MARKET, *models.FORM)}
KEYS = ["source", "scope", "segment"]
PLACE = ["source", "scope", "fold", "match_id", "match_date", "year", "y", "market_probability"]


def by_scope(frame: DataFrame) -> DataFrame:
    """Rows of each source on all of its matches, and once more on those that every source has."""
    scopes = F.when(F.col("common"), F.array(*[F.lit(s) for s in SCOPES])).otherwise(F.array(F.lit(SCOPES[0])))
    long = markets.by_source(frame).filter("available").withColumn("scope", F.explode(scopes))
    return long.withColumn("market_probability", F.col("probability")).withColumn(models.MARKET, N.logit(F.col("probability")))


def scored(frame: DataFrame, folds: tuple[Fold, ...]) -> DataFrame:
    """(source, scope, fold, match_id, match_date, year, y, market_probability) of evaluation rows, and a probability named after each architecture.

    ``frame``: match features with y and the prices of all sources; the fits read it many times. All fits are made at once."""
    number = reduce(lambda a, b: a.when(F.col("source") == b[1], b[0]), enumerate(markets.SOURCES), F.when(F.lit(False), -1))
    rows = models.fold_rows(by_scope(frame), folds).withColumn("g", (F.col("fold") * 10 + number * 2 + (F.col("scope") == SCOPES[1]).cast("int")).cast("long"))
    fitted = models.fit_variants(rows.filter("role = 'train'"), FITTED)
    out = rows.filter("role = 'evaluate'").withColumn(RAW, F.col("market_probability"))
    for name in FITTED:
        out = models.predict_groups(out, fitted[name], name)
    return out.select(*PLACE, RAW, *FITTED)


def predictions(scored: DataFrame) -> DataFrame:
    """(architecture, source, scope, fold, match_id, match_date, year, y, market_probability, p) of scored rows."""
    each = F.inline(F.array(*[F.struct(F.lit(name).alias("architecture"), F.col(name).alias("p")) for name in (RAW, *FITTED)]))
    return scored.select(*PLACE, each).select("architecture", *PLACE, "p")


def anchor_metrics(predicted: DataFrame) -> DataFrame:
    """Per source, scope, year or combined, and architecture: metrics, calibration error, correction, improvements."""
    rows = metrics.year_and_combined(predicted, [])
    keys = [*KEYS, "architecture"]
    table = metrics.probability_metrics(rows, keys, "y", "p").select(*keys, "sample_count", "log_loss", "brier_score", "accuracy", "roc_auc", F.col("mean_probability").alias("mean_model_probability"))
    error = metrics.calibration_summary(metrics.calibration_table(rows, keys, "y", "p"), keys).select(*keys, "expected_calibration_error")
    means = rows.groupBy(*keys).agg(F.avg("market_probability").alias("mean_market_probability"), F.avg(F.abs(F.col("p") - F.col("market_probability"))).alias("mean_absolute_correction"))
    loss = lambda name: F.max(F.when(F.col("architecture") == name, F.col("log_loss")))
    others = table.groupBy(*KEYS).agg(loss(RAW).alias("raw_market_log_loss"), loss(RECALIBRATED).alias("__recalibrated"))  # a few architectures a group
    out = table.join(error, keys).join(means, keys).join(others, KEYS)
    better = F.when(F.col("architecture") == FORM, F.col("__recalibrated") - F.col("log_loss"))
    return out.withColumn("log_loss_improvement_vs_raw_market", F.col("raw_market_log_loss") - F.col("log_loss")).withColumn("log_loss_improvement_vs_recalibration", better).drop("__recalibrated")


def anchor_bootstrap(scored: DataFrame, samples: int = resample.SAMPLES) -> DataFrame:
    """Block bootstrap of the form model's log loss against the raw and the recalibrated market, by segment."""
    loss = lambda name: N.row_log_loss(F.col("y"), F.col(name))
    against = F.inline(F.array(*[F.struct(F.lit(name).alias("comparator"), (loss(name) - loss(FORM)).alias("difference")) for name in (RAW, RECALIBRATED)]))
    rows = metrics.year_and_combined(scored, []).select(*KEYS, "match_date", against)
    keys = [*KEYS, "comparator"]
    return resample.block_bootstrap(resample.block_sums(rows, keys, F.col("difference")), keys, samples)


def anchor_summary(bootstrap: DataFrame) -> DataFrame:
    """Per source, scope and comparator, over all years: the interval, and whether it excludes no improvement."""
    pooled = bootstrap.filter("segment = 'combined'")
    return pooled.select("source", "scope", "comparator", "ci_lower", "ci_upper", (F.col("ci_lower") > 0).alias("beats_comparator"), ((F.col("ci_lower") > 0) | (F.col("ci_upper") < 0)).alias("interval_excludes_zero"))
