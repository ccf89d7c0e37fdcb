"""Each query with SQL, on the smallest tables, against another engine."""

import math
import numbers
import os

import duckdb
import pandas as pd
import pytest

from duelspark.plans import catalogue as every
from duelspark.plans import queries as catalogue

assert every.QUERIES is catalogue.QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")


def cell(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "year"):
        return str(v)[:10]
    return round(float(v), 5) if isinstance(v, numbers.Number) and not isinstance(v, bool) else v


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(cell(v) for v in r) for r in frame[columns].itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{FOLDER}/orders.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, duck, name):
    columns, got = rows(catalogue.QUERIES[name](spark, FOLDER).toPandas())
    names, want = rows(duck.sql(catalogue.ORACLES[name]).df())
    assert columns == names and len(got) == len(want)
    for g, w in zip(got, want):
        assert g == pytest.approx(w, abs=2e-5) if all(isinstance(x, (int, float)) for x in g) else g == w


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_other_queries_give_rows(spark, name):
    assert catalogue.QUERIES[name](spark, FOLDER).count() > 0


def test_every_metric_and_surface_is_held_against_sql(duck):
    from duelspark.operators import stats

    assert set(catalogue.EVERY_METRIC) == set(stats.METRICS)
    for name in ("tour_priors_every_metric", "decayed_rates_every_metric"):
        assert {r[0] for r in duck.sql(f"SELECT DISTINCT metric FROM ({catalogue.ORACLES[name]})").fetchall()} == set(stats.METRICS)
    surfaces = {r[0] for r in duck.sql(f"SELECT DISTINCT surface FROM ({catalogue.ORACLES['tour_priors_every_metric']})").fetchall()}
    assert "*" in surfaces and len(surfaces) > 1


def test_bootstrap_ci_is_the_whole_job(spark):
    import numpy as np

    frame = catalogue._segments(spark, FOLDER).filter("year >= 1998").select("segment", "match_id", "y", "p_model", "market_probability").toPandas()
    got = {(r["segment"], r["metric"]): r for r in catalogue.bootstrap_ci(spark, FOLDER).collect()}
    assert set(got) == {(s, m) for s in frame["segment"] for m in ("log_loss", "brier")}
    for segment, part in frame.groupby("segment"):
        part = part.sort_values("match_id")
        y, p, q = (part[c].to_numpy(float) for c in ("y", "p_model", "market_probability"))
        loss = lambda x: -(y * np.log(x) + (1 - y) * np.log(1 - x))
        for metric, d, seed in (("log_loss", loss(q) - loss(p), 42), ("brier", (q - y) ** 2 - (p - y) ** 2, 43)):
            drawn = d[np.random.default_rng(seed).integers(0, len(d), size=(10_000, len(d)))].mean(axis=1)
            r = got[segment, metric]
            want = (len(d), d.mean(), np.median(drawn), *np.percentile(drawn, [2.5, 97.5]), (drawn > 0).mean())
            assert tuple(r[c] for c in ("sample_count", "mean_improvement", "median_improvement", "ci_lower", "ci_upper", "probability_better")) == pytest.approx(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 21 and set(entry.oracle_sql()) <= set(entry.queries())


def test_models_keep_only_the_columns_that_they_read(spark):
    from duelspark.operators import models

    kept = catalogue._model_rows(spark, FOLDER)
    kept.unpersist()
    assert set(kept.columns) == {"match_id", "match_date", "year", "part", "y", "market_probability", "overround", "odds_source", models.MARKET, *models.NUMERIC, *models.BINARY}


def test_anchor_rows_are_made_once_and_compared_row_by_row(spark, monkeypatch):
    import numpy as np
    from pyspark.sql import functions as F

    from duelspark.operators import anchors
    from duelspark.plans import extended

    made, rows = spark.sparkContext.accumulator(0), extended._anchor_rows(spark, FOLDER)

    @F.udf("double")
    def counted(y):
        made.add(1)
        return y

    monkeypatch.setattr(extended, "_anchor_rows", lambda *_: rows.withColumn("y", counted("y")))
    try:
        scored = extended._scored_anchors(spark, FOLDER)
        long = anchors.predictions(scored).toPandas()
        got = {(r["source"], r["scope"], r["segment"], r["comparator"]): r for r in anchors.anchor_bootstrap(scored, 50).collect()}
        assert made.value == rows.count()  # whatever the number of passes
    finally:
        spark.catalog.clearCache()
    long["loss"] = -np.log(np.where(long["y"] == 1, long["p"], 1 - long["p"]))
    wide = long.pivot_table(index=["source", "scope", "fold", "match_id", "match_date"], columns="architecture", values="loss").reset_index()
    wide["block"] = [f"{d.year}-W{d.isocalendar()[1]:02d}" for d in wide["match_date"]]
    for (source, scope), part in wide.groupby(["source", "scope"]):
        for other in (anchors.RAW, anchors.RECALIBRATED):
            sums = (part[other] - part[anchors.FORM]).groupby(part["block"]).agg(["sum", "count"]).sort_index()
            at = np.random.default_rng(42).integers(0, len(sums), size=(50, len(sums)))
            drawn = sums["sum"].to_numpy()[at].sum(1) / sums["count"].to_numpy()[at].sum(1)
            r = got[source, scope, "combined", other]
            assert r["sample_count"] == len(part) and (r["ci_lower"], r["ci_upper"]) == pytest.approx(np.percentile(drawn, [2.5, 97.5]))


def test_market_coefficients_need_no_ratings_and_make_features_once(spark, monkeypatch):
    from pyspark.sql import functions as F

    from duelspark.operators import models

    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(key):
        made.add(1)
        return key

    monkeypatch.setattr(catalogue.ratings, "add_ratings", None)
    table = catalogue.market_coefficients(spark, FOLDER).collect()
    spark.catalog.clearCache()
    assert {r["g"] for r in table} == {1, 2, 3} and {models.MARKET, *models.FORM, "intercept"} <= {r["feature"] for r in table}
    ids = [("a",), ("b",), ("a",), (None,), ("c",)]
    frame = spark.createDataFrame(ids, "match_id string").select(counted.asNondeterministic()("match_id").alias("match_id"), F.lit(None).cast("date").alias("match_date"), F.lit(True).alias("player_1_won"), F.lit("Clay").alias("surface"))
    assert sorted((r["match_id"], r["duplicate_id"]) for r in models.eligibility(frame).collect()) == [("a", True), ("a", True), ("b", False), ("c", False)]
    assert made.value == len(ids)
