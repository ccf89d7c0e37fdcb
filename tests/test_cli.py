import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from duelspark import cli
from duelspark.operators import records


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    folder, rng = tmp_path_factory.mktemp("raw"), random.Random(1)
    lines = ["Date,Tournament,Surface,Round,Best of,Winner,Loser,WRank,LRank,B365W,B365L,PSW,PSL,AvgW,AvgL,Comment"]
    for k in range(240):
        a, b = rng.sample([f"Player{c} {c}." for c in "ABCDEFGHIJ"], 2)
        day = date(2020 + k // 40, 1, 1) + timedelta(days=3 * (k % 40))
        odds = [f"{rng.uniform(1.3, 3.4):.2f}" for _ in range(6)]
        lines.append(f"{day},Cup {k % 5},{rng.choice(['Hard', 'Clay', 'Grass'])},QF,3,{a},{b},{rng.randrange(1, 90)},{rng.randrange(1, 90)},{','.join(odds)},Completed")
    (folder / "all.csv").write_text("\n".join(lines) + "\n")
    return folder


def test_stages_chain_through_files(spark, raw, tmp_path):
    run = lambda stage, source, *more: cli.main([stage, source, f"{tmp_path}/{stage}", *more], spark)
    read = lambda path: spark.read.parquet(path)
    matches = run("clean", run("ingest", str(raw))["raw_matches.parquet"])["matches.parquet"]
    assert read(matches).count() == 240
    features = run("build-features", run("build-ratings", matches)["rated.parquet"])["features.parquet"]
    assert {"overall_elo_diff", "recent_rate_diff", "log_rank_diff"} <= set(read(features).columns)
    predictions = run("train", features)["predictions.parquet"]
    assert read(predictions).filter("predicted_player_1_probability between 0 and 1").count() == 120
    assert read(run("evaluate", predictions)["metrics.parquet"]).first()["sample_count"] == 120
    assessed = run("assess-value", predictions, "--minimum-probability", "0.5", "--minimum-edge", "0.01")["assessments.parquet"]
    ledger = read(run("backtest", assessed)["ledger.parquet"])
    assert ledger.count() == read(assessed).filter("has_recommendation").count() > 0
    assert records.violations(ledger, records.bet_rules()).agg(F.sum("rows")).first()[0] == 0
    coverage = spark.read.csv(run("benchmark-markets", features)["coverage.csv"], header=True)
    assert coverage.count() == 3 * 2 * 6


def test_rules_name_what_is_broken(spark):
    rows = [("x", "A", "A", "Ice", 4, 0, 1, 1.0, 2.0)]
    frame = spark.createDataFrame(rows, "match_id string, player_1 string, player_2 string, surface string, best_of long, rank_1 long, rank_2 long, odds_1 double, odds_2 double")
    with pytest.raises(ValueError, match="same player: 1"):
        records.require(frame, records.canonical_rules())
    assert cli.parser().parse_args(["clean", "a", "b"]).minimum_odds == 1.5
