import math
import random
from collections import defaultdict, deque
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from duelspark.config import BankrollConfig, Fold, RatingConfig, RollingConfig, SplitConfig, ValueThresholds
from duelspark.functions import numbers as N
from duelspark.functions import text as T
from duelspark.operators import bankroll, canonical, decisions, history, linkage, markets, metrics, models, ratings, resample, stats

MATCH = "match_id string, day int, surface string, tournament string, round string, player_1 string, player_2 string, player_1_won boolean, is_retirement boolean"


def played(n=400, players=12, days=120, seed=1):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        a, b = sorted(rng.sample([f"p{i:02d}" for i in range(players)], 2))
        out.append((f"m{k:04d}", rng.randrange(days), rng.choice(["Hard", "Clay", "Grass"]), f"t{rng.randrange(4)}", rng.choice("FSQ"), a, b, rng.random() < 0.5, rng.random() < 0.1))
    rng.shuffle(out)
    return out


def by_day(rows):
    days = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[1], r[3], r[4], r[0])):
        days[r[1]].append(r)
    return sorted(days.items())


def loop_history(rows, config=RollingConfig()):
    wins, surface_wins, count, last, dates = defaultdict(lambda: deque(maxlen=config.window)), defaultdict(lambda: deque(maxlen=config.window)), defaultdict(int), {}, defaultdict(list)
    out = {}
    for day, games in by_day(rows):
        for m in games:
            for side, p in ((1, m[5]), (2, m[6])):
                w, s = wins[p], surface_wins[p, m[2]]
                out[m[0], side] = (
                    count[p], sum(w) / len(w) if w else config.neutral_rate, len(s), sum(s) / len(s) if s else config.neutral_rate,
                    float(day - last[p]) if p in last else None, sum(day - config.schedule_days <= d < day for d in dates[p]),
                )
        for m in games:
            if not m[8]:
                for p, won in ((m[5], m[7]), (m[6], not m[7])):
                    wins[p].append(int(won))
                    surface_wins[p, m[2]].append(int(won))
                    count[p] += 1
                    last[p] = day
                    dates[p].append(day)
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_history_equals_a_loop(spark, parts):
    rows = played()
    got = history.player_history(spark.createDataFrame(rows, MATCH).repartition(parts)).collect()
    want = loop_history(rows)
    assert len(got) == len(want)
    for r in got:
        assert tuple(r[c] for c in history.SIDE_COLUMNS) == pytest.approx(want[r["match_id"], r["side"]])


def test_first_match_and_density_bounds(spark):
    rows = [("a", 100, "Hard", "t", "F", "x", "y", True, False), ("b", 101, "Hard", "t", "F", "x", "z", True, False), ("c", 109, "Hard", "t", "F", "x", "w", True, True), ("d", 115, "Hard", "t", "F", "x", "v", True, False)]
    got = {(r["match_id"], r["player"]): r for r in history.player_history(spark.createDataFrame(rows, MATCH)).collect()}
    first = got["a", "x"]
    assert (first["recent_rate"], first["rest_days"], first["matches_in_schedule"], first["prior_matches"]) == (0.5, None, 0, 0)
    assert got["d", "x"]["matches_in_schedule"] == 1  # the bound at 14 days counts, the day before it and the retirement don't


def test_validation_messages(spark):
    good = spark.createDataFrame(played(5), MATCH)
    history.validate(good)
    for bad, message in ((good.drop("round"), "missing columns"), (good.union(good), "duplicate"), (good.withColumn("surface", F.lit("Ice")), "unsupported"), (good.withColumn("player_2", F.col("player_1")), "same player")):
        with pytest.raises(ValueError, match=message):
            history.validate(bad)


def loop_ratings(rows, c=RatingConfig()):
    overall, surface, out = defaultdict(lambda: c.initial), defaultdict(lambda: c.initial), {}
    for _, games in by_day(rows):
        for m in games:
            out[m[0]] = (overall[m[5]], overall[m[6]], surface[m[5], m[2]], surface[m[6], m[2]])
        for m in games:
            if m[8]:
                continue
            for table, x, y in ((overall, m[5], m[6]), (surface, (m[5], m[2]), (m[6], m[2]))):
                shift = c.k * (int(m[7]) - 1 / (1 + 10 ** ((table[y] - table[x]) / c.scale)))
                table[x] += shift
                table[y] -= shift
    return out


def test_ratings_goldens_and_loop(spark):
    assert ratings.updated(1500, 1500, 1, RatingConfig()) == (1516, 1484)
    assert ratings.updated(1000, 1000, 1, RatingConfig(1000, 20, 200)) == (1010, 990)
    with pytest.raises(ValueError):
        ratings.updated(1500, 1500, 0.5, RatingConfig())
    rows = played(250, seed=3)
    want = loop_ratings(rows)
    for parts in (1, 5):
        got = ratings.add_ratings(spark.createDataFrame(rows, MATCH).repartition(parts)).collect()
        assert all((r["overall_1"], r["overall_2"], r["surface_1"], r["surface_2"]) == pytest.approx(want[r["match_id"]]) for r in got) and len(got) == 250
    pooled = ratings.add_ratings(spark.createDataFrame(rows, MATCH).withColumn("tour", F.lit("a")), pool="tour")
    assert pooled.count() == 250


def test_pools_stream_in_batches(spark):
    rows = played(120, seed=4)
    pooled = [(*r, tour) for r in rows for tour in ("a", "b")]
    frame = spark.createDataFrame([(f"{r[-1]}{r[0]}", *r[1:]) for r in pooled], f"{MATCH}, tour string")
    want, size = loop_ratings(rows), "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = spark.conf.get(size)
    spark.conf.set(size, "7")  # a pool and a day pass over many batches
    try:
        rated = ratings.add_ratings(frame, pool="tour")
        got = rated.collect()
        report = ratings.rating_report(rated).first()
    finally:
        spark.conf.set(size, held)
    assert "FlatMapGroupsInPandas" not in rated._jdf.queryExecution().toString()  # which holds a whole pool in one Python process
    assert len(got) == 240 and all((r["overall_1"], r["overall_2"], r["surface_1"], r["surface_2"]) == pytest.approx(want[r["match_id"][1:]]) for r in got)
    assert (report["matches"], report["updates"], report["players"]) == (240, sum(not r[8] for r in rows) * 2, 12)


def test_decisions(spark):
    schema = "match_id string, surface string, player_1 string, player_2 string, player_1_odds double, player_2_odds double, predicted_player_1_probability double, predicted_player_2_probability double, is_retirement boolean"
    rows = [
        ("a", "Hard", "A", "B", 2.0, 2.0, 0.6, 0.4, False),
        ("b", "Hard", "A", "B", 2.0, None, 0.6, 0.4, False),
        ("c", "Ice", "A", "a", 2.0, 1.0, 0.6, 0.6, True),
        (" ", "Clay", "A", "B", 2.0, 2.0, 0.54, 0.46, False),
        ("e", "Clay", "A", "B", 3.6, 1.3, 0.56, 0.44, False),
    ]
    got = {r["match_id"]: r for r in decisions.assess(spark.createDataFrame(rows, schema)).collect()}
    a = got["a"]
    assert (a["recommended_side"], a["recommended_player"], a["decision_reason_codes"]) == ("player_1", "A", "")
    assert a["player_1_edge"] == pytest.approx(0.1) and a["player_1_expected_value"] == pytest.approx(0.2)
    assert got["b"]["player_1_reason_codes"] == "unsupported_match|missing_odds"
    assert got["c"]["player_2_reason_codes"] == "same_player|unsupported_surface|unsupported_match|retirement|invalid_odds|invalid_probability"
    assert got[" "]["player_1_reason_codes"] == "missing_match_id|probability_below_threshold"
    assert "odds_above_maximum" in got["e"]["player_1_reason_codes"]
    exact = [("x", "Hard", "A", "B", 1.5, 3.0, 0.7067, 0.2933, False)]
    edge = decisions.assess(spark.createDataFrame(exact, schema), ValueThresholds(probability=0.7067, min_odds=1.5)).first()
    assert edge["recommended_side"] == "player_1"  # limits are inclusive


def book(spark, results, odds=2.0, start=date(2025, 1, 1), gap=60):
    schema = "match_id string, match_date date, surface string, partition string, has_recommendation boolean, recommended_side string, actual_player_1_won boolean, is_retirement boolean, recommended_odds double, recommended_edge double"
    rows = [(f"m{k:03d}", start + timedelta(days=gap * k), "Hard", "test", True, "player_1", r == "W", r == "V", odds, 0.05) for k, r in enumerate(results)]
    return spark.createDataFrame(rows, schema).repartition(3)


def test_ledger_goldens(spark):
    rows = bankroll.ledger(book(spark, "WWL")).orderBy("bet_sequence").collect()
    assert [r["bankroll_before"] for r in rows] == pytest.approx([10000, 10050, 10100.25])
    assert [r["stake"] for r in rows] == pytest.approx([50, 50.25, 50.50125])
    streaks = {r["result"]: r["longest"] for r in bankroll.longest_streaks(bankroll.ledger(book(spark, "WVWLL"))).collect()}
    assert streaks == {"won": 2, "lost": 2}
    curve = spark.createDataFrame([(1, date(2025, 1, 1), 10500.0), (2, date(2025, 6, 1), 9450.0), (3, date(2025, 12, 1), 9900.0)], "bet_sequence long, match_date date, bankroll_after double")
    worst = bankroll.drawdown(curve, 10_000).agg(F.max("drawdown"), F.max("drawdown_percentage")).first()
    assert tuple(worst) == pytest.approx((1050, 0.10))
    summary = bankroll.ledger_summary(bankroll.ledger(book(spark, "WVWLL")), BankrollConfig()).first()
    assert (summary["wins"], summary["losses"], summary["voids"], summary["win_rate"]) == (2, 2, 1, 0.5)


def test_ledger_equals_a_loop(spark):
    rng = random.Random(2)
    results = "".join(rng.choice("WLV") for _ in range(150))
    money, want = 10_000.0, []
    for r in results:
        money += 0.005 * money * {"W": 1.4, "L": -1, "V": 0}[r]
        want.append(money)
    got = [r["bankroll_after"] for r in bankroll.ledger(book(spark, results, 2.4, gap=9)).orderBy("bet_sequence").collect()]
    assert got == pytest.approx(want)


def test_text_functions(spark):
    frame = spark.createDataFrame([("O’Connell,  Christopher",), ("FIne Straße Đ",), ("",), (None,), ("de la Cruz J.",)], "n string")
    rows = T.with_comparable(frame, ["n"]).withColumn("shown", T.display_text(F.col("n"))).withColumn("keys", T.name_keys(F.col("n_normalized"))).collect()
    assert rows[0]["shown"] == "O'Connell, Christopher" and rows[0]["n_normalized"] == "o connell christopher"
    assert rows[1]["n_normalized"] == "fine strasse" and rows[2]["n_normalized"] is None and rows[3]["keys"] == []
    assert {"de la cruz j", "delacruzj", "j dlc", "dlc j", "jdlc", "cruzj dlc"} <= set(rows[4]["keys"])
    status = spark.createDataFrame([("W/O",), ("walk over",), ("Retired hurt",), ("two sets",), (None,)], "s string").select(T.status_text(F.col("s")).rlike(T.WALKOVER).alias("w"), T.status_text(F.col("s")).rlike(T.RETIREMENT).alias("r")).collect()
    assert [(x["w"], x["r"]) for x in status] == [(True, False), (True, False), (False, True), (False, False), (False, False)]


def test_number_functions(spark):
    raw = [("1.80", "2024-01-02"), ("N/A", "03/01/2024"), ("1.00", "11-06-2025"), ("1.5f", "bad-date"), (" 2 ", "12/31/2024"), (None, None)]
    rows = spark.createDataFrame(raw, "o string, d string").select(N.valid_odds(N.number(F.col("o"))).alias("o"), N.parse_date(F.col("d")).alias("d")).collect()
    assert [r["o"] for r in rows] == [1.8, None, None, None, 2.0, None]
    assert [r["d"] for r in rows] == [date(2024, 1, 2), date(2024, 1, 3), date(2025, 6, 11), None, date(2024, 12, 31), None]
    p = spark.createDataFrame([(x,) for x in (0.0, 0.1, 0.3, 0.55, 0.6, 1.0)], "p double").select(N.calibration_bin(F.col("p")).alias("b")).collect()
    assert [r["b"] for r in p] == [0, 1, 3, 5, 6, 9]
    block = spark.createDataFrame([(date(2023, 1, 1),)], "d date").select(N.iso_block(F.col("d")).alias("b")).first()["b"]
    assert block == "2023-W52"
    market = spark.createDataFrame([(1.8, 2.1), (None, 2.0), (0.0, 2.0)], "a double, b double").select(N.overround(F.col("a"), F.col("b")).alias("o"), N.odds_pair_valid(F.col("a"), F.col("b")).alias("v")).collect()
    assert market[0]["o"] == pytest.approx(1 / 1.8 + 1 / 2.1) and [r["v"] for r in market] == [True, False, False]


def test_metrics_against_numpy(spark):
    rng = np.random.default_rng(0)
    p, y = np.round(rng.random(500), 2), (rng.random(500) < 0.5).astype(int)
    frame = spark.createDataFrame([("g", int(a), float(b)) for a, b in zip(y, p)], "k string, y int, p double")
    row = metrics.probability_metrics(frame, ["k"], "y", "p").first()
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]])
    assert row["roc_auc"] == pytest.approx(auc) and row["brier_score"] == pytest.approx(np.mean((p - y) ** 2))
    assert metrics.probability_metrics(frame.filter("y = 1"), ["k"], "y", "p").first()["roc_auc"] is None
    table = metrics.calibration_table(spark.createDataFrame([("t", 1, 0.0), ("t", 0, 1.0), ("t", 1, 0.55)], "k string, y int, p double"), ["k"], "y", "p")
    assert sorted(r["label"] for r in table.collect()) == ["0.00-0.10", "0.50-0.60", "0.90-1.00"]
    with pytest.raises(ValueError):
        metrics.join_validated(frame, frame, "k")


def test_duplicates(spark):
    rows = [("a", 1, None, "f1"), ("a", 2, None, "f2"), ("b", 3, 1.0, "f"), ("b", 4, 2.0, "f"), ("c", 5, 1.0, "f")]
    got = {r["n"]: r["duplicate_status"] for r in canonical.duplicate_status(spark.createDataFrame(rows, "id string, n int, x double, file string"), "id", "n", ("file",)).collect()}
    assert got == {1: None, 2: "exact_duplicate", 3: "conflicting_duplicate", 4: "conflicting_duplicate", 5: None}


def test_linkage_cascade(spark):
    keyed = lambda f: f.withColumn("winner_keys", T.name_keys(F.col("winner_normalized"))).withColumn("loser_keys", T.name_keys(F.col("loser_normalized")))
    d = date(2024, 5, 1)
    project = keyed(spark.createDataFrame([("m1", d, "rome", "F", "sinner j", "ruud c"), ("m2", d, "rome", "SF", "sinner j", "paul t"), ("m3", d, "rome", "QF", "kid a", "new b"), ("m4", d, "rome", "R16", "twin a", "other b"), ("m5", d, "rome", "R32", "nobody x", "none y")], "match_id string, match_date date, tournament_normalized string, round string, winner_normalized string, loser_normalized string"))
    ext = [(1, d, "rome", "F", "jannik sinner", "casper ruud", 1, 2), (2, d, "else", "SF", "jannik sinner", "tommy paul", 1, 3), (3, d, "rome", "QF", "completely different", "also different", 7, 8), (4, d, "rome", "R16", "adam twin", "bob other", 4, 5), (5, d, "rome", "R16", "adam twin", "bob other", 4, 5)]
    external = keyed(spark.createDataFrame(ext, "external_row long, match_date date, tournament_normalized string, round string, winner_normalized string, loser_normalized string, winner_id long, loser_id long"))
    aliases = spark.createDataFrame([("kid a", 99, 1), ("kid a", 7, 2), ("new b", 8, 3)], "name string, player_id long, line long")
    got = {r["match_id"]: (r["tier"], r["external_row"], r["failure_reason"]) for r in linkage.link(project, external, aliases).collect()}
    assert got["m1"] == ("strict", 1, None) and got["m2"] == ("unique_date_player", 2, None)
    assert got["m3"][1] == 3 and got["m4"] == (None, None, "ambiguous") and got["m5"] == (None, None, "unmatched")
    assert linkage.manual_suggestions(linkage.link(project, external), project, external).filter("match_id = 'm5'").count() == 5


def external_rows(n=120, seed=4):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        w, l = rng.sample(range(8), 2)
        side = lambda: (rng.randrange(5), rng.randrange(4), 60 + rng.randrange(20), 40, 30, 8, 3, 5)
        out.append((k, rng.randrange(60), rng.choice(["Hard", "Clay"]), w, l, rng.choice([None, 90.0, 120.0]), rng.random() < 0.05, rng.random() < 0.1, *side(), *side()))
    return out


def test_decayed_rates_equal_a_loop(spark):
    rows = external_rows()
    names = ", ".join(f"{s}_{c} int" for s in ("winner", "loser") for c in stats.COUNTS)
    frame = spark.createDataFrame(rows, f"external_row long, day int, surface string, winner_id long, loser_id long, minutes double, is_walkover boolean, is_retirement boolean, {names}").repartition(5)
    got = {(r["external_row"], r["side"]): r["rate"] for r in stats.decayed_rates(stats.player_stats(frame)).filter("metric = 'serve_points_won_pct'").collect()}
    decay, state, prior, want = 0.5 ** (1 / 20), defaultdict(lambda: [0.0, 0.0]), [0.0, 0.0], {}
    days = defaultdict(list)
    for r in rows:
        days[r[1]].append(r)
    for _, games in sorted(days.items()):
        for r in games:
            for side, p in ((1, r[3]), (2, r[4])):
                s, t = state[p]
                want[r[0], side] = (s + 200 * prior[0] / prior[1]) / (t + 200) if prior[1] else None
        for r in games:
            if r[6] or r[7]:
                continue
            for p, own in ((r[3], r[8:16]), (r[4], r[16:24])):
                s, t = own[4] + own[5], own[2]
                state[p] = [decay * state[p][0] + s, decay * state[p][1] + t]
                prior[0] += s
                prior[1] += t
    assert got == pytest.approx(want)


def test_matches_that_share_an_external_match_ask_for_their_own_days(spark):
    names = ", ".join(f"{s}_{c} int" for s in ("winner", "loser") for c in stats.COUNTS)
    rows = external_rows()
    frame = spark.createDataFrame(rows, f"external_row long, day int, surface string, winner_id long, loser_id long, minutes double, is_walkover boolean, is_retirement boolean, {names}")
    project = spark.createDataFrame([("early", 20, "Hard", True), ("late", 55, "Hard", True)], "match_id string, day int, surface string, player_1_won boolean")
    links = spark.createDataFrame([("early", 3), ("late", 3)], "match_id string, external_row long")
    got = {r["match_id"]: r for r in stats.prematch_features(project, frame, links).collect()}
    valid = [r for r in rows if not r[6] and not r[7]]
    for name, day in (("early", 20), ("late", 55)):
        for n, player in ((1, rows[3][3]), (2, rows[3][4])):
            earlier = [r for r in valid if player in r[3:5] and r[1] < day]
            assert got[name][f"player_{n}_point_stats_match_count"] == len(earlier)
            assert got[name][f"player_{n}_surface_point_stats_match_count"] == sum(r[2] == "Hard" for r in earlier)
            assert got[name][f"player_{n}_minutes_last_7d"] == sum(r[5] or 0 for r in earlier if r[1] >= day - 7)


def test_stat_pairs_and_bounds(spark):
    names = ", ".join(f"{s}_{c} int" for s in ("winner", "loser") for c in stats.COUNTS)
    row = (1, 1, "Hard", 1, 2, 90.0, False, False, 5, 1, 50, 30, 24, 10, 3, 4, 2, 2, 60, 40, 20, 8, 4, 8)
    frame = spark.createDataFrame([row], f"external_row long, day int, surface string, winner_id long, loser_id long, minutes double, is_walkover boolean, is_retirement boolean, {names}")
    got = {r["metric"]: (r["s"], r["t"]) for r in stats.metric_rows(stats.player_stats(frame)).filter("side = 1").collect()}
    assert got["serve_points_won_pct"] == (34, 50) and got["return_points_won_pct"] == (32, 60) and got["first_serve_points_won_pct"] == (24, 30)
    assert got["second_serve_points_won_pct"] == (10, 20) and got["break_points_saved_pct"] == (3, 4) and got["break_points_converted_pct"] == (4, 8)
    assert not stats.player_stats(frame.withColumn("winner_first_in", F.lit(99))).first()["valid"]


def test_logistic_fit_is_the_penalised_optimum(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 2))
    x[rng.random(400) < 0.2, 1] = np.nan
    y = (rng.random(400) < 1 / (1 + np.exp(-(x[:, 0] + 0.3)))).astype(float)
    frame = spark.createDataFrame([(int(k % 2), float(b), float(a[0]), None if math.isnan(a[1]) else float(a[1])) for k, (a, b) in enumerate(zip(x, y))], "g long, y double, history_count_min double, log_rank_diff double")
    fitted = models.fit_groups(frame, ("history_count_min", "log_rank_diff"))
    assert set(fitted) == {0, 1}
    for g, m in fitted.items():
        rows = x[g::2]
        z = m.prepared.matrix(rows)
        assert m.prepared.medians[1] == pytest.approx(np.nanmedian(rows[:, 1])) and m.prepared.names()[-1] == "missing_log_rank_diff"
        assert z.mean(0) == pytest.approx(np.zeros(3), abs=1e-9) and z.std(0) == pytest.approx(np.ones(3))
        q = 1 / (1 + np.exp(-(z @ m.weights + m.intercept)))
        assert z.T @ (q - y[g::2]) + m.weights == pytest.approx(np.zeros(3), abs=1e-6)
        assert (q - y[g::2]).sum() == pytest.approx(0, abs=1e-6)
    scored = models.predict_groups(frame, fitted).collect()
    assert all(0 < r["probability"] < 1 for r in scored)
    with pytest.raises(ValueError, match="leak"):
        models.fit_groups(frame, ("profit_loss",))


def test_medians_are_exact_without_a_table_of_values(spark, monkeypatch):
    monkeypatch.setattr(models, "BINS", 4)  # several passes
    rng = np.random.default_rng(8)
    columns = {"a": rng.normal(size=301), "b": rng.integers(-2, 3, 301).astype(float), "c": np.where(rng.random(301) < 0.5, np.nan, rng.normal(size=301) * 1e9), "d": np.full(301, 7.0), "e": rng.choice([-1.7e308, 1.7e308, 1.0], 301)}
    rows = [(k % 3, *(None if math.isnan(v[k]) else float(v[k]) for v in columns.values())) for k in range(301)]
    frame = spark.createDataFrame(rows, "g long, a double, b double, c double, d double, e double")
    got = models._medians(frame, tuple(columns))
    for g in range(3):
        for k, v in enumerate(columns.values()):
            own = np.sort(v[g::3][~np.isnan(v[g::3])])
            assert got[g, k] == 0.5 * own[(len(own) - 1) // 2] + 0.5 * own[len(own) // 2]


def test_variants_are_fitted_together_as_alone(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 2))
    rows = [(int(k % 2), float(rng.random() < 1 / (1 + math.exp(-a))), float(a), None if k % 7 == 0 else float(b), int(k % 3 == 0)) for k, (a, b) in enumerate(x)]
    frame = spark.createDataFrame(rows, "g long, y double, market_logit double, log_rank_diff double, best_of_5 long").persist()
    variants = {"one": ("market_logit",), "two": ("best_of_5", "log_rank_diff"), "all": ("market_logit", "log_rank_diff", "best_of_5")}
    together = models.fit_variants(frame, variants, models.BINARY)
    for name, features in variants.items():
        for g, alone in models.fit_groups(frame, features, tuple(f for f in features if f in models.BINARY)).items():
            got = together[name][g]
            assert got.prepared.names() == alone.prepared.names() and (*got.weights, got.intercept) == pytest.approx((*alone.weights, alone.intercept), abs=1e-9)


def test_the_descent_passes_over_blocks(spark, monkeypatch):
    from pyspark.sql import GroupedData

    monkeypatch.setattr(GroupedData, "applyInPandas", None)  # holds a fold in one Python process
    rng = np.random.default_rng(10)
    rows = [(int(k % 2), float(rng.random() < 0.6), float(rng.normal()), None if k % 9 == 0 else float(rng.normal() * 9)) for k in range(200)]
    frame = spark.createDataFrame(rows, "g long, y double, market_logit double, rest_days_diff double")
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = spark.conf.get(size)
    spark.conf.set(size, "7")
    try:
        fitted = models.fit_fixed_offset(frame, ("rest_days_diff",))
    finally:
        spark.conf.set(size, held)
    for g, m in fitted.items():
        data = np.array([[math.nan if v is None else v for v in r[1:]] for r in rows if r[0] == g])
        y, base, x, w, b, before = data[:, 0], data[:, 1], m.prepared.matrix(data[:, 2:]), np.zeros(2), 0.0, math.inf
        for steps in range(1, 601):
            error = 1 / (1 + np.exp(-(base + b + x @ w))) - y
            w, b = w - 0.05 * (x.T @ error + w) / len(y), b - 0.05 * error.mean()
            q = 1 / (1 + np.exp(-(base + b + x @ w)))
            loss = -(y * np.log(q) + (1 - y) * np.log(1 - q)).mean()
            if abs(before - loss) < 1e-8:
                break
            before = loss
        assert m.iterations == steps and (*m.weights, m.intercept) == pytest.approx((*w, b))


def test_fixed_offset_cap_and_folds(spark):
    rng = np.random.default_rng(6)
    rows = [(1, float(rng.random() < 0.5), float(rng.normal()), float(rng.normal() * 9)) for _ in range(200)]
    frame = spark.createDataFrame(rows, "g long, y double, market_logit double, rest_days_diff double")
    fitted = models.fit_fixed_offset(frame, ("rest_days_diff",))
    capped = models.predict_groups(frame, fitted, "p", "market_logit", 0.01).collect()
    assert all(abs(math.log(r["p"] / (1 - r["p"])) - r["market_logit"]) <= 0.0100001 for r in capped)
    assert fitted[1].iterations <= 600
    years = spark.createDataFrame([(y,) for y in range(2019, 2027)], "year int")
    got = models.fold_rows(years, (Fold(1, 2020, 2022, 2023), Fold(2, 2020, 2023, 2024))).groupBy("fold", "role").agg(F.min("year"), F.max("year")).collect()
    assert {(r[0], r[1]): (r[2], r[3]) for r in got} == {(1, "train"): (2020, 2022), (1, "evaluate"): (2023, 2023), (2, "train"): (2020, 2023), (2, "evaluate"): (2024, 2024)}


def test_bootstrap_is_the_seeded_sequence(spark, monkeypatch):
    values = np.random.default_rng(1).normal(0.1, 1, 97)
    whole = values[np.random.default_rng(42).integers(0, 97, size=(500, 97))].mean(axis=1)
    monkeypatch.setattr(resample, "CHUNK", 97 * 7)
    assert resample.paired(values, 500) == pytest.approx(whole)
    frame = spark.createDataFrame([("s", f"m{k:03d}", float(v)) for k, v in enumerate(values)], "s string, match_id string, d double").repartition(4)
    row = resample.bootstrap(frame, ["s"], "d", samples=500).first()
    assert row["ci_lower"] == pytest.approx(np.percentile(whole, 2.5)) and row["sample_count"] == 97
    blocks = spark.createDataFrame([("s", "b1", 2.0, 4), ("s", "b2", -1.0, 2), ("s", "b3", 3.0, 3)], "s string, block string, total double, n long")
    at = np.random.default_rng(42).integers(0, 3, size=(300, 3))
    want = np.array([2.0, -1, 3])[at].sum(1) / np.array([4, 2, 3])[at].sum(1)
    assert resample.block_bootstrap(blocks, ["s"], 300).first()["ci_upper"] == pytest.approx(np.percentile(want, 97.5))


def test_slope_of_constant_and_buckets(spark):
    frame = spark.createDataFrame([("a", 1.0, 0.1), ("a", 2.0, 0.1), ("b", 1.0, 0.1), ("c", 1.0, 0.0), ("c", 3.0, 1.0)], "k string, r double, c double")
    assert {r["k"]: r["slope"] for r in markets.direction_slope(frame, ["k"], "r", "c").collect()} == {"a": 0.0, "b": 0.0, "c": 2.0}
    edges = spark.createDataFrame([(x,) for x in (-0.05, -0.0500001, 0.01, 0.05)], "x double").select(N.bucket(F.col("x"), N.SIGNED_BUCKETS).alias("b")).collect()
    assert [r["b"] for r in edges] == ["-0.05_to_-0.02", "below_-0.05", "0.01_to_0.02", "above_0.05"]


def test_configs_reject_bad_values():
    for bad in (lambda: RatingConfig(k=0), lambda: RollingConfig(window=0), lambda: ValueThresholds(min_odds=4), lambda: BankrollConfig(fraction=0), lambda: BankrollConfig(partition="x"), lambda: Fold(1, 2020, 2023, 2023), lambda: SplitConfig(validation=(date(2023, 1, 1), date(2024, 1, 1)))):
        with pytest.raises(ValueError):
            bad()


def test_text_forms_equal_the_standard_library(spark):
    import re
    import unicodedata

    names = ["José  O’Neil", "Čepanović  A.", "İstanbul ŞÖLEN", "ﬁne Ⅳ ①", "Ångström–Ǆ", "é ẛ̣", "Σίσυφος ΑΒΓ", "Žluťoučký kůň", "zero​width", "“q” — t", "straße", "plain ascii ", "\t", "½ ½x", "Đoković", "Łódź Ø"]
    table = str.maketrans(T._FOLD_FROM[: len(T._FOLD_TO)], T._FOLD_TO, T.INVISIBLE)
    shown = lambda t: re.sub(r"\s+", " ", unicodedata.normalize("NFC", t.translate(table))).strip() or None
    letters = lambda t: "".join(c for c in unicodedata.normalize("NFKD", shown(t).casefold()) if not unicodedata.combining(c))
    rows = T.with_comparable(spark.createDataFrame([(x,) for x in names], "n string"), ["n"]).select("n", "n_normalized", T.display_text(F.col("n")).alias("shown")).collect()
    for r in rows:
        assert r["shown"] == shown(r["n"])
        assert r["n_normalized"] == (" ".join(re.findall("[a-z0-9A-Z]+", letters(r["n"]))) or None if shown(r["n"]) else None), r["n"]


def test_a_balance_beyond_a_double_is_not_a_broken_sum(spark):
    from duelspark.operators import records

    rows = [("won", 5.0, 10.0, 1000.0, 1010.0), ("lost", 5.0, -5.0, 1000.0, 900.0), ("won", 5.0, 5.0, 1000.0, math.inf), ("void", math.inf, math.nan, math.inf, math.inf), ("lost", math.inf, -math.inf, math.inf, math.inf)]
    book = spark.createDataFrame(rows, "result string, stake double, profit_loss double, bankroll_before double, bankroll_after double")
    assert {r["rule"]: r["rows"] for r in records.violations(book, records.bet_rules()).collect()} == {"open bet with a result": 0, "stake isn't positive": 0, "balance doesn't add up": 2}
