"""Command line: each stage reads Parquet (or raw files) and writes a bundle of tables.

    python -m duelspark.cli ingest RAW OUT
    python -m duelspark.cli clean OUT/raw_matches.parquet OUT2
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import FOLDS, BankrollConfig, ValueThresholds
from .functions.text import name_keys
from .operators import canonical, history, linkage, markets, models, ratings, reports, stats
from .sources import artifacts, seasons, statistics

Stage = Callable[[SparkSession, argparse.Namespace], dict[str, DataFrame]]
STAGES: dict[str, Stage] = {}


def stage(name: str) -> Callable[[Stage], Stage]:
    def add(f: Stage) -> Stage:
        STAGES[name] = f
        return f

    return add


def short_names(matches: DataFrame) -> DataFrame:
    """Canonical columns under the names the history operators use."""
    renamed = matches.withColumnsRenamed({"player_1_rank": "rank_1", "player_2_rank": "rank_2", "player_1_odds": "odds_1", "player_2_odds": "odds_2", **{f"player_{n}_{b}_odds": f"{b}_{n}" for n in (1, 2) for b in ("ps", "avg")}})
    return renamed.withColumn("day", F.unix_date("match_date")).withColumn("year", F.year("match_date"))


@stage("ingest")
def ingest(spark, args):
    got = seasons.ingest(spark, args.input)
    errors = spark.createDataFrame([(e.source_file, e.message) for e in got.errors], "source_file string, message string")
    return {"raw_matches.parquet": got.data, "report.json": got.report, "errors.json": errors}


@stage("clean")
def clean(spark, args):
    done = canonical.clean(spark.read.parquet(args.input))
    return {"matches.parquet": canonical.in_order(done.matches), "rejected.csv": done.rejected, "report.json": done.report}


@stage("build-ratings")
def build_ratings(spark, args):
    rated = ratings.add_ratings(short_names(spark.read.parquet(args.input)))
    return {"rated.parquet": rated, "report.json": ratings.rating_report(rated)}


@stage("build-features")
def build_features(spark, args):
    features = history.build_features(spark.read.parquet(args.input))
    return {"features.parquet": features, "report.json": history.feature_report(features, [*models.NUMERIC, *models.BINARY])}


@stage("train")
def train(spark, args):
    """Walk-forward predictions of all inputs, coefficients and missing values."""
    rows = models.fold_rows(models.prepare(spark.read.parquet(args.input)), FOLDS).withColumn("g", F.col("fold").cast("long"))
    fitted = models.fit_groups(rows.filter("role = 'train'"), (models.MARKET, *models.NUMERIC, *models.BINARY), models.BINARY)
    predictions = models.predict_groups(rows.filter("role = 'evaluate'"), fitted, "predicted_player_1_probability")
    predictions = predictions.withColumn("predicted_player_2_probability", 1 - F.col("predicted_player_1_probability")).withColumn("partition", F.lit("test"))
    named = predictions.withColumnsRenamed({"odds_1": "player_1_odds", "odds_2": "player_2_odds"}).withColumn("actual_player_1_won", F.col("player_1_won"))
    return {"predictions.parquet": named, "coefficients.csv": models.coefficients(spark, fitted), "missing.csv": reports.missingness(rows.filter("role = 'train'"))}


@stage("evaluate")
def evaluate(spark, args):
    frame = spark.read.parquet(args.input).withColumn("y", F.col("actual_player_1_won").cast("int"))
    return reports.evaluation(frame, "partition", "y", "predicted_player_1_probability", ("player_1_odds", "player_2_odds"))


@stage("assess-value")
def assess_value(spark, args):
    limits = ValueThresholds(args.minimum_probability, args.minimum_edge, args.minimum_expected_value, args.minimum_odds, args.maximum_odds)
    return reports.decisions_bundle(spark.read.parquet(args.input), limits)


@stage("backtest")
def backtest(spark, args):
    return reports.backtest(spark.read.parquet(args.input), BankrollConfig(args.starting_bankroll, args.stake_fraction, args.partition))


@stage("experiment")
def experiment(spark, args):
    return reports.architecture_report(models.architectures(models.prepare(spark.read.parquet(args.input)).persist(), FOLDS), args.bootstrap_samples)


@stage("ablate")
def ablate(spark, args):
    return {"ablation.csv": models.ablation(models.prepare(spark.read.parquet(args.input)).persist(), FOLDS)}


@stage("audit-odds")
def audit_odds(spark, args):
    return reports.price_audit(spark.read.parquet(args.input))


@stage("benchmark-markets")
def benchmark_markets(spark, args):
    frame = spark.read.parquet(args.input)
    return {"coverage.csv": markets.anchor_coverage(frame), "sources.csv": markets.source_diagnostics(frame), "disagreement.csv": markets.probability_disagreement(frame), "review.csv": markets.review_rows(frame)}


@stage("external-features")
def external_features(spark, args):
    external = statistics.load(spark, args.statistics).matches
    project = spark.read.parquet(args.input)
    won = F.col("player_1_won")
    for side, a, b in (("winner", 1, 2), ("loser", 2, 1)):
        project = project.withColumn(f"{side}_normalized", F.when(won, F.col(f"player_{a}_normalized")).otherwise(F.col(f"player_{b}_normalized")))
        project = project.withColumn(f"{side}_keys", name_keys(F.col(f"{side}_normalized")))
    links = linkage.link(project, external, statistics.load_aliases(spark, args.aliases) if args.aliases else None)
    sides = stats.player_stats(external)
    return {
        "links.parquet": links,
        "suggestions.csv": linkage.manual_suggestions(links, project, external),
        "rates_by_round.csv": linkage.link_rates(links, project, "round"),
        "rates.parquet": stats.decayed_rates(sides),
        "surface_rates.parquet": stats.decayed_rates(sides, by_surface=True),
        "workload.parquet": stats.workload(sides),
    }


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="duelspark", description=__doc__)
    out.add_argument("stage", choices=sorted(STAGES))
    out.add_argument("input")
    out.add_argument("output")
    limits, money = ValueThresholds(), BankrollConfig()
    for name, value in (("minimum-probability", limits.probability), ("minimum-edge", limits.edge), ("minimum-expected-value", limits.expected_value), ("minimum-odds", limits.min_odds), ("maximum-odds", limits.max_odds), ("starting-bankroll", money.start), ("stake-fraction", money.fraction)):
        out.add_argument(f"--{name}", type=float, default=value)
    out.add_argument("--partition", default=money.partition)
    out.add_argument("--bootstrap-samples", type=int, default=10_000)
    out.add_argument("--statistics", default="")
    out.add_argument("--aliases", default="")
    return out


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> dict[str, str]:
    args = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName(f"duelspark {args.stage}").getOrCreate()
    return artifacts.write_bundle(STAGES[args.stage](spark, args), args.output)


if __name__ == "__main__":
    main()
