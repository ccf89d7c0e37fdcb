"""Price audits and market diagnostics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N

# Sources with their price columns, pairs of sources, quantiles; names of flags and filters below.
SOURCES = {"Bet365": ("odds_1", "odds_2"), "Pinnacle/PS": ("ps_1", "ps_2"), "Average": ("avg_1", "avg_2")}
PAIRS = (("Bet365", "Pinnacle/PS"), ("Bet365", "Average"), ("Pinnacle/PS", "Average"))
QUANTILES = (0.01, 0.05, 0.25, 0.50, 0.75, 0.95, 0.99)


def quality_flags(frame: DataFrame) -> DataFrame:
    """Eight row flags of winner_odds, loser_odds and odds_source; a null condition is false."""
    w, l, source = F.col("winner_odds"), F.col("loser_odds"), F.coalesce("odds_source", F.lit(""))
    over = N.overround(w, l)
    flags = {
        "used_fallback_source": source == "Average",
        "overround_below_1_00": over < 1.00,
        "overround_above_1_12": over > 1.12,
        "either_odd_below_1_02": (w < 1.02) | (l < 1.02),
        "either_odd_above_30": (w > 30) | (l > 30),
        "missing_paired_odds": w.isNull() | l.isNull(),
        "suspected_maximum_odds": source == "Maximum",
        "large_market_reference_disagreement": (w > l) & (source != "Missing"),
    }
    out = frame.withColumn("overround", over)
    for name, condition in flags.items():
        out = out.withColumn(name, F.coalesce(condition, F.lit(False)))
    return out.withColumn("bookmaker_to_bookmaker_disagreement", F.lit(False))


def overround_by(frame: DataFrame, keys: list[str]) -> DataFrame:
    o = "overround"
    return frame.filter("overround is not null").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(o).alias("mean_overround"), F.percentile(o, F.lit(0.5)).alias("median_overround"),
        F.min(o).alias("min_overround"), F.max(o).alias("max_overround"), F.percentile(o, F.lit(0.05)).alias("p05_overround"), F.percentile(o, F.lit(0.95)).alias("p95_overround"),
    )


def side_integrity(frame: DataFrame, books: tuple[str, ...], tolerance: float = 1e-12) -> tuple[DataFrame, DataFrame]:
    """Row log and per-book summary of the winner/loser to player 1/2 price mapping."""
    rows = F.array(
        *[
            F.struct(
                F.lit(b).alias("source"),
                F.col(f"source_winner_{b}_odds").alias("w"),
                F.col(f"source_loser_{b}_odds").alias("l"),
                F.col(f"player_1_{b}_odds").alias("a"),
                F.col(f"player_2_{b}_odds").alias("b"),
                F.coalesce(F.col(f"{b}_pair_available"), F.lit(False)).alias("available"),
            )
            for b in books
        ]
    )
    long = frame.select("match_id", "player_1_won", F.inline(rows))
    first, second = F.when(F.col("player_1_won"), F.col("w")).otherwise(F.col("l")), F.when(F.col("player_1_won"), F.col("l")).otherwise(F.col("w"))
    difference = F.greatest(F.abs(F.col("a") - first), F.abs(F.col("b") - second))
    checked = long.withColumn("difference", F.when(F.col("available"), difference))
    checked = checked.withColumn("mapping_failure", F.coalesce(F.col("difference") > tolerance, F.lit(False)))
    checked = checked.withColumn("consistency_failure", F.col("available") != (F.col("w").isNotNull() & F.col("l").isNotNull()))
    summary = checked.groupBy("source").agg(
        F.count_if("available").alias("rows_with_valid_source_pair"),
        F.count_if(~F.col("available")).alias("rows_with_missing_source_pair"),
        F.count_if("mapping_failure").alias("odds_side_mapping_failures"),
        F.count_if("consistency_failure").alias("source_pair_consistency_failures"),
        F.max("difference").alias("maximum_absolute_mapping_difference"),
    )
    return checked.filter("available or consistency_failure"), summary


def review_rows(frame: DataFrame, most: int = 20) -> DataFrame:
    """Top rows by disagreement of two books, flagged rows and controls: three bounded top-k reports."""
    a, b = N.no_vig(F.col("odds_1"), F.col("odds_2")), N.no_vig(F.col("ps_1"), F.col("ps_2"))
    rows = frame.withColumn("b365_probability", a).withColumn("ps_probability", b).withColumn("disagreement", F.abs(F.col("b365_probability") - F.col("ps_probability")))
    flag = F.coalesce(F.col("odds_1") > F.col("odds_2"), F.lit(False))
    parts = [
        rows.orderBy(F.desc_nulls_last("disagreement"), "match_id").limit(most).withColumn("review_category", F.lit("largest_disagreement")),
        rows.filter(flag).orderBy("match_id").limit(most).withColumn("review_category", F.lit("market_reference_disagreement")),
        rows.filter(~flag).orderBy("match_id").limit(most).withColumn("review_category", F.lit("unflagged_control")),
    ]
    return reduce(DataFrame.unionByName, parts).select("match_id", "review_category", "b365_probability", "ps_probability", "disagreement")


def _available(a: str, b: str) -> Column:
    return N.odds_pair_valid(F.col(a), F.col(b))


def by_source(frame: DataFrame) -> DataFrame:
    """One row per match and source: overround, probability, availability, and whether all sources have it."""
    every = reduce(lambda x, y: x & y, [_available(*c) for c in SOURCES.values()])
    rows = F.array(*[F.struct(F.lit(s).alias("source"), N.no_vig(F.col(a), F.col(b)).alias("probability"), N.overround(F.col(a), F.col(b)).alias("overround"), _available(a, b).alias("available")) for s, (a, b) in SOURCES.items()])
    return frame.select("*", every.alias("common"), F.inline(rows))


def anchor_coverage(frame: DataFrame) -> DataFrame:
    long = by_source(frame)
    scopes = F.inline(F.array(F.struct(F.lit("source_specific").alias("scope"), F.col("available").alias("inside")), F.struct(F.lit("common_all_sources").alias("scope"), (F.col("available") & F.col("common")).alias("inside"))))
    return long.select("source", "year", scopes).groupBy("source", "scope", "year").agg(F.count_if("inside").alias("included_rows"), F.count_if(~F.col("inside")).alias("excluded_rows"))


def source_diagnostics(frame: DataFrame) -> DataFrame:
    o = F.when(F.col("available"), F.col("overround"))
    return by_source(frame).groupBy("source").agg(
        F.count_if("available").alias("valid_paired_rows"),
        F.count_if(~F.col("available")).alias("missing_paired_rows"),
        F.avg(o).alias("mean_overround"),
        F.min(o).alias("minimum_overround"),
        F.max(o).alias("maximum_overround"),
        *[F.percentile(o, F.lit(q)).alias(f"p{round(q * 100):02d}_overround") for q in QUANTILES],
        F.count_if(o < 1.00).alias("rows_below_overround_1_00"),
        F.count_if(o > 1.12).alias("rows_above_overround_1_12"),
    )


def mid_ranks(frame: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """(keys, value, mid-rank); ties are aggregated before they are ordered."""
    cells = frame.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return cells.select(*keys, value, (F.coalesce(F.sum("__n").over(before), F.lit(0)) + (F.col("__n") + 1) / 2).alias(name))


def probability_disagreement(frame: DataFrame) -> DataFrame:
    """Per pair of sources on their common rows: difference statistics, Pearson and Spearman correlation."""
    common = frame.filter(reduce(lambda x, y: x & y, [_available(*c) for c in SOURCES.values()]))
    p = {s: N.no_vig(F.col(a), F.col(b)) for s, (a, b) in SOURCES.items()}
    rows = F.array(*[F.struct(F.lit(f"{x} versus {y}").alias("pair"), p[x].alias("x"), p[y].alias("y")) for x, y in PAIRS])
    long = common.select(F.inline(rows))
    ranked = long.join(mid_ranks(long, ["pair"], "x", "rx"), ["pair", "x"]).join(mid_ranks(long, ["pair"], "y", "ry"), ["pair", "y"])
    d = F.col("x") - F.col("y")
    return ranked.groupBy("pair").agg(
        F.count(F.lit(1)).alias("rows"), F.avg(d).alias("mean_signed_difference"), F.avg(F.abs(d)).alias("mean_absolute_difference"),
        F.percentile(F.abs(d), F.lit(0.5)).alias("median_absolute_difference"), F.percentile(F.abs(d), F.lit(0.95)).alias("p95_absolute_difference"),
        F.max(F.abs(d)).alias("maximum_absolute_difference"), F.corr("x", "y").alias("pearson_correlation"), F.corr("rx", "ry").alias("spearman_correlation"),
    )


# ---- corrections ----------------------------------------------------------------------------------


def correction_summary(frame: DataFrame, keys: list[str], c: str = "correction") -> DataFrame:
    x, a = F.col(c), F.abs(F.col(c))
    share = lambda cond: F.avg(cond.cast("double"))
    return frame.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(x).alias("mean_correction"), F.avg(a).alias("mean_absolute_correction"),
        F.percentile(a, F.lit(0.5)).alias("median_absolute_correction"), F.stddev_pop(x).alias("standard_deviation"), F.min(x).alias("minimum"), F.max(x).alias("maximum"),
        *[F.percentile(x, F.lit(q)).alias(f"p{round(q * 100):02d}") for q in QUANTILES],
        share(a < 0.01).alias("share_below_001"), share(a < 0.02).alias("share_below_002"), share(a < 0.05).alias("share_below_005"), share(a > 0.10).alias("share_above_010"),
    )


def compared(frame: DataFrame, keys: list[str], y: str, model: str, market: str) -> DataFrame:
    """Model and market losses side by side, with improvements."""
    t = F.col(y).cast("double")
    out = frame.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        *[x for n, p in (("model", model), ("market", market)) for x in (F.avg(N.row_log_loss(t, F.col(p))).alias(f"{n}_log_loss"), F.avg(F.pow(F.col(p) - t, 2)).alias(f"{n}_brier"), F.avg(((F.col(p) >= 0.5).cast("int") == t.cast("int")).cast("double")).alias(f"{n}_accuracy"))],
    )
    return out.withColumn("log_loss_improvement", F.col("market_log_loss") - F.col("model_log_loss")).withColumn("brier_improvement", F.col("market_brier") - F.col("model_brier"))


def direction_slope(frame: DataFrame, keys: list[str], residual: str, correction: str) -> DataFrame:
    """Slope of residual on correction; 0 for fewer than two rows or a constant correction."""
    return frame.groupBy(*keys).agg(F.coalesce(F.regr_slope(residual, correction), F.lit(0.0)).alias("slope"), F.count(F.lit(1)).alias("rows"))


def tagged(frame: DataFrame, filters: dict[str, Column]) -> DataFrame:
    """Each row once per filter, marked whether it passes: all filters in one pass, empty ones kept."""
    rows = F.array(*[F.struct(F.lit(k).alias("filter"), F.coalesce(c, F.lit(False)).alias("passes")) for k, c in filters.items()])
    return frame.select("*", F.inline(rows))


def sensitivity(frame: DataFrame, keys: list[str], y: str, model: str, market: str) -> DataFrame:
    o, source = F.col("overround"), F.col("odds_source")
    filters = {
        "all_valid_paired_odds": F.lit(True),
        "normal_overround": o.between(1.00, 1.10),
        "strict_overround": o.between(1.02, 1.08),
        "same_source_paired_odds": source.isNotNull(),
        "pinnacle_only": source.isin("PS", "Pinnacle"),
        "bet365_only": source == "B365",
    }
    t = F.col(y).cast("double")
    inside = lambda x: F.avg(F.when(F.col("passes"), x))
    out = tagged(frame, filters).groupBy(*keys, "filter").agg(
        F.count_if("passes").alias("included_rows"), F.count_if(~F.col("passes")).alias("excluded_rows"),
        inside(N.row_log_loss(t, F.col(model))).alias("model_log_loss"), inside(N.row_log_loss(t, F.col(market))).alias("raw_market_log_loss"),
    )
    return out.withColumn("log_loss_improvement_vs_market", F.col("raw_market_log_loss") - F.col("model_log_loss"))
