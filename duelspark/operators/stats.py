"""Point statistics before a match: validated pairs, exponential decay with tour-wide priors, workload."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import join_validated

# Metrics and the (successes, trials) they are made of, from own (o) and opposing (x) counts.
METRICS = {
    "serve_points_won_pct": ("o_first_won + o_second_won", "o_svpt"),
    "return_points_won_pct": ("x_svpt - x_first_won - x_second_won", "x_svpt"),
    "first_serve_in_pct": ("o_first_in", "o_svpt"),
    "first_serve_points_won_pct": ("o_first_won", "o_first_in"),
    "second_serve_points_won_pct": ("o_second_won", "o_svpt - o_first_in"),
    "ace_rate": ("o_ace", "o_svpt"),
    "double_fault_rate": ("o_df", "o_svpt"),
    "break_points_saved_pct": ("o_bp_saved", "o_bp_faced"),
    "break_points_converted_pct": ("x_bp_faced - x_bp_saved", "x_bp_faced"),
}
COUNTS = ("ace", "df", "svpt", "first_in", "first_won", "second_won", "bp_saved", "bp_faced")
OVERALL_HALF_LIFE, SURFACE_HALF_LIFE = 20, 12
RATE_WEIGHT, BREAK_WEIGHT = 200.0, 20.0


def half_life_decay(matches: float) -> float:
    return 0.5 ** (1 / matches)


def valid_side(prefix: str) -> Column:
    c = lambda name: F.col(f"{prefix}_{name}")
    ok = (
        (c("svpt") > 0)
        & c("first_in").between(0, c("svpt"))
        & c("first_won").between(0, c("first_in"))
        & c("second_won").between(0, c("svpt") - c("first_in"))
        & c("bp_saved").between(0, c("bp_faced"))
        & (c("ace") >= 0)
        & (c("df") >= 0)
    )
    return F.coalesce(ok, F.lit(False))


def player_stats(external: DataFrame) -> DataFrame:
    """Two rows a match: player, day, surface, order, and o_/x_ counts, valid only if both sides are."""
    ok = valid_side("winner") & valid_side("loser") & ~F.col("is_walkover") & ~F.col("is_retirement")
    rows = []
    for side, own, other in ((1, "winner", "loser"), (2, "loser", "winner")):
        rows.append(F.struct(F.lit(side).alias("side"), F.col(f"{own}_id").alias("player"), *[F.col(f"{own}_{c}").cast("double").alias(f"o_{c}") for c in COUNTS], *[F.col(f"{other}_{c}").cast("double").alias(f"x_{c}") for c in COUNTS]))
    return external.withColumn("valid", ok).select("external_row", "day", "surface", "minutes", "valid", F.explode(F.array(*rows)).alias("s")).select("external_row", "day", "surface", "minutes", "valid", "s.*").filter("player is not null")


def metric_rows(stats: DataFrame) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.expr(s).alias("s"), F.expr(t).alias("t")) for m, (s, t) in METRICS.items()])
    return stats.select("external_row", "side", "player", "day", "surface", "valid", F.inline(pairs))


def tour_priors(metrics: DataFrame) -> DataFrame:
    """(day, metric, surface or '*', s, t): sums over all days before; pre-aggregated by day first."""
    daily = metrics.filter("valid").groupBy("metric", "surface", "day").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    return _priors(daily, metrics.select("day").distinct())


def _priors(daily: DataFrame, days: DataFrame) -> DataFrame:
    both = daily.unionByName(daily.groupBy("metric", "day").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).withColumn("surface", F.lit("*")))
    grid = days.crossJoin(both.select("metric", "surface").distinct())  # days x 36, of fixed metrics and surfaces
    filled = grid.join(both, ["metric", "surface", "day"], "left")
    before = Window.partitionBy("metric", "surface").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    return filled.select("metric", "surface", "day", F.sum("s").over(before).alias("prior_s"), F.sum("t").over(before).alias("prior_t"))


def decayed(metrics: DataFrame, keys: list[str], half_life: float) -> DataFrame:
    """Per row the decayed sums before its day: S <- d * S + s for each earlier valid match, in order.

    One group is one player's history of nine numbers a match, streamed in order."""
    d = half_life_decay(half_life)
    wide = metrics.groupBy("external_row", "side", "player", "day", "surface", "valid").agg(F.map_from_entries(F.collect_list(F.struct("metric", F.struct("s", "t")))).alias("m"))
    names = list(METRICS)
    slim = wide.select("external_row", "side", "player", "day", "surface", "valid", *[F.col("m")[n][x].alias(f"{x}{k}") for k, n in enumerate(names) for x in ("s", "t")])
    columns = [f"{x}{k}" for k in range(len(names)) for x in ("s", "t")]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["day", "external_row", "side"], kind="mergesort")
        values, valid, days = frame[columns].to_numpy(), frame["valid"].to_numpy(), frame["day"].to_numpy()
        held, count, out, counts = np.zeros(len(columns)), 0, np.zeros(values.shape), []
        at = 0
        while at < len(days):
            end = at
            while end < len(days) and days[end] == days[at]:
                out[end] = held
                counts.append(count)
                end += 1
            for k in range(at, end):
                if valid[k]:
                    held = d * held + values[k]
                    count += 1
            at = end
        made = frame[["external_row", "side"]].copy()
        made["matches_before"] = counts
        made[columns] = out
        return made

    schema = "external_row long, side int, matches_before long, " + ", ".join(f"{c} double" for c in columns)
    done = slim.groupBy(*keys).applyInPandas(run, schema)
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"s{k}").alias("decayed_s"), F.col(f"t{k}").alias("decayed_t")) for k, n in enumerate(names)])
    return done.select("external_row", "side", "matches_before", F.inline(pairs))


def decayed_rates(stats: DataFrame, by_surface: bool = False) -> DataFrame:
    """(external_row, side, metric, rate): (S + w * prior) / (T + w); null without a prior."""
    metrics = metric_rows(stats)
    half_life, keys = (SURFACE_HALF_LIFE, ["player", "surface"]) if by_surface else (OVERALL_HALF_LIFE, ["player"])
    sums = decayed(metrics, keys, half_life).join(metrics.select("external_row", "side", "metric", "day", "surface"), ["external_row", "side", "metric"])
    priors = tour_priors(metrics)
    if not by_surface:
        priors = priors.filter("surface = '*'").drop("surface")
    joined = sums.join(priors, ["metric", "day", "surface"] if by_surface else ["metric", "day"], "left")
    weight = F.when(F.col("metric").startswith("break_points"), BREAK_WEIGHT).otherwise(RATE_WEIGHT)
    prior = F.try_divide(F.col("prior_s"), F.col("prior_t"))
    rate = (F.col("decayed_s") + weight * prior) / (F.col("decayed_t") + weight)
    return joined.select("external_row", "side", "metric", "matches_before", "decayed_t", rate.alias("rate"))


def workload(stats: DataFrame, days: tuple[int, ...] = (3, 7, 14)) -> DataFrame:
    """Minutes, known and missing durations in the days before, of valid matches; one shuffle, one sort."""
    out = stats
    minutes = F.when(F.col("valid") & (F.col("minutes") >= 0), F.col("minutes").cast("double"))
    missing = F.when(F.col("valid") & ~F.coalesce(F.col("minutes") >= 0, F.lit(False)), 1)
    for k in days:
        frame = Window.partitionBy("player").orderBy("day").rangeBetween(-k, -1)
        out = out.withColumn(f"minutes_last_{k}d", F.coalesce(F.sum(minutes).over(frame), F.lit(0.0)))
        out = out.withColumn(f"known_last_{k}d", F.count(minutes).over(frame)).withColumn(f"missing_last_{k}d", F.count(missing).over(frame))
    return out.select("external_row", "side", "player", *[f"{x}_last_{k}d" for k in days for x in ("minutes", "known", "missing")])


def _weight(metric: str) -> float:
    return BREAK_WEIGHT if metric.startswith("break_points") else RATE_WEIGHT


def day_states(stats: DataFrame, asked: DataFrame) -> DataFrame:
    """(player, day, surface) of ``asked`` with what all valid matches before the day say.

    All of a player's matches of a day see the same state, so a day's matches are summed first, each weighted by the
    decay of those after it; a player's days, not matches, are then chained in order. Columns: per metric the
    decayed rate, overall and on the surface; numbers of matches; decayed points; workload."""
    keys = ["player", "day", "surface"]
    names = [f"{x}{k}" for k in range(len(METRICS)) for x in "st"]
    decays = {"o": half_life_decay(OVERALL_HALF_LIFE), "f": half_life_decay(SURFACE_HALF_LIFE)}
    valid = stats.filter("valid")
    sums = [e for s, t in METRICS.values() for e in (F.expr(s), F.expr(t))]
    known = F.col("minutes") >= 0
    rows = valid.repartition("player", "day")
    for x, pool in (("o", keys[:2]), ("f", keys)):
        later = F.row_number().over(Window.partitionBy(*pool).orderBy(F.desc("external_row"), F.desc("side"))) - 1
        rows = rows.withColumn(f"w{x}", F.pow(F.lit(decays[x]), later))
    daily = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f"w{x}") * e).alias(f"{x}{name}") for x in decays for name, e in zip(names, sums)],
        F.sum(F.when(known, F.col("minutes").cast("double"))).alias("minutes"), F.count_if(F.coalesce(known, F.lit(False))).alias("known"), F.count_if(~F.coalesce(known, F.lit(False))).alias("missing"),
    )
    every = daily.withColumn("asked", F.lit(False)).unionByName(asked.select(*keys).distinct().withColumn("asked", F.lit(True)), allowMissingColumns=True)
    load = []
    for k in (3, 7, 14):
        frame = Window.partitionBy("player").orderBy("day").rangeBetween(-k, -1)
        load += [F.coalesce(F.sum("minutes").over(frame), F.lit(0.0)).alias(f"minutes_last_{k}d"), *[F.coalesce(F.sum(c).over(frame), F.lit(0)).alias(f"{c}_duration_matches_last_{k}d") for c in ("known", "missing")]]
    loads = [f"{c}_last_{k}d" for k in (3, 7, 14) for c in ("minutes", "known_duration_matches", "missing_duration_matches")]
    every = every.select(*keys, "asked", F.coalesce("n", F.lit(0)).alias("n"), *[F.coalesce(f"{x}{c}", F.lit(0.0)).alias(f"{x}{c}") for x in decays for c in names], *load)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("day", kind="mergesort")
        days, pools, n = frame["day"].to_numpy(), frame["surface"].to_numpy(object), frame["n"].to_numpy()
        today = {x: frame[[f"{x}{c}" for c in names]].to_numpy() for x in decays}
        out, counts = {x: np.zeros(today[x].shape) for x in decays}, {x: np.zeros(len(days), dtype=np.int64) for x in decays}
        held: dict = {}
        at = 0
        while at < len(days):
            end = at
            while end < len(days) and days[end] == days[at]:
                end += 1
            for k in range(at, end):  # every row of a day sees what the day began with
                out["o"][k], counts["o"][k] = held.get("o", (0.0, 0))
                out["f"][k], counts["f"][k] = held.get(("f", pools[k]), (0.0, 0))
            state, count = held.get("o", (0.0, 0))
            total = int(n[at:end].sum())
            held["o"] = decays["o"] ** total * state + today["o"][at:end].sum(axis=0), count + total
            for k in range(at, end):
                state, count = held.get(("f", pools[k]), (0.0, 0))
                held["f", pools[k]] = decays["f"] ** int(n[k]) * state + today["f"][k], count + int(n[k])
            at = end
        made = frame[[*keys, *loads]].copy()
        for x in decays:
            made[[f"{x}{c}" for c in names]] = out[x]
            made[f"{x}n"] = counts[x]
        return made[frame["asked"].to_numpy()]

    types = dict(every.dtypes)
    schema = [f"{c} {types[c]}" for c in (*keys, *loads)] + [f"{x}{c} double" for x in decays for c in names] + [f"{x}n long" for x in decays]
    states = every.groupBy("player").applyInPandas(run, ", ".join(schema))
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"s{k}").alias("s"), F.col(f"t{k}").alias("t")) for k, m in enumerate(METRICS)])
    tour = valid.groupBy("surface", "day").agg(*[F.sum(e).alias(c) for c, e in zip(names, sums)]).select("surface", "day", F.inline(pairs))
    priors = _priors(tour, asked.select("day").union(stats.select("day")).distinct())
    wide = priors.groupBy("surface", "day").agg(*[F.max(F.when(F.col("metric") == m, F.try_divide("prior_s", "prior_t"))).alias(f"p{k}") for k, m in enumerate(METRICS)])  # a row a metric
    whole = wide.filter("surface = '*'").select("day", *[F.col(f"p{k}").alias(f"op{k}") for k in range(len(METRICS))])
    own = wide.filter("surface <> '*'").select("day", "surface", *[F.col(f"p{k}").alias(f"fp{k}") for k in range(len(METRICS))])
    joined = states.join(whole, "day", "left").join(own, ["day", "surface"], "left")
    rate = lambda x, k, m: ((F.col(f"{x}s{k}") + _weight(m) * F.col(f"{x}p{k}")) / (F.col(f"{x}t{k}") + _weight(m)))
    rates = [c for x, prefix in (("o", ""), ("f", "surface_")) for c in (*[rate(x, k, m).alias(f"{prefix}ewm_{m}") for k, m in enumerate(METRICS)], F.col(f"{x}n").alias(f"{prefix}point_stats_match_count"))]
    points = [F.col(f"ot{list(METRICS).index(m)}").alias(c) for m, c in (("serve_points_won_pct", "decayed_service_points"), ("return_points_won_pct", "decayed_return_points"))]
    return joined.select(*keys, *rates, *points, *loads)


def prematch_features(project: DataFrame, external: DataFrame, links: DataFrame) -> DataFrame:
    """One row per linked match: what both players' external matches before its day say.

    ``project``: match_id, day, surface, player_1_won; ``links``: match_id and external_row. A linked match asks for
    its players' states before its day, on its own surface. Columns: per metric the decayed rate of both players and
    their difference, overall and on the surface; numbers of earlier valid matches; decayed points; workload. A
    match_id that is linked twice keeps the row of its earlier external match."""
    ids = external.select("external_row", "winner_id", "loser_id")
    first = links.filter("external_row is not null").groupBy("match_id").agg(F.min("external_row").alias("external_row"))
    asked = project.select("match_id", "day", "surface", "player_1_won").join(first, "match_id").join(ids, "external_row")
    own = F.when(F.col("player_1_won"), F.col("winner_id")).otherwise(F.col("loser_id"))
    other = F.when(F.col("player_1_won"), F.col("loser_id")).otherwise(F.col("winner_id"))
    asked = asked.select("match_id", "day", "surface", own.alias("one"), other.alias("two")).filter("one is not null and two is not null")
    states = day_states(player_stats(external), asked.select("day", "surface", F.explode(F.array("one", "two")).alias("player")))
    names = [c for c in states.columns if c not in ("player", "day", "surface")]
    # States and matches meet by day; both players' states then come by windows inside it, without moving wide rows again.
    offered = states.select("day", "surface", F.col("player").alias("one"), F.col("player").alias("two"), F.struct(*names).alias("state"))
    both = asked.unionByName(offered, allowMissingColumns=True).repartition("day")
    for n, side in ((1, "one"), (2, "two")):
        both = both.withColumn(f"__{n}", F.first("state", ignorenulls=True).over(Window.partitionBy("day", "surface", side)))
    both = both.filter("state is null").select("match_id", *[F.col(f"__{n}.{c}").alias(f"player_{n}_{c}") for n in (1, 2) for c in names])
    differ = [c for c in names if "ewm_" in c or c.startswith("minutes_")]
    least = [c for c in names if c.endswith("point_stats_match_count")]
    return both.select(
        "match_id", *[f"player_{n}_{c}" for c in names for n in (1, 2)], *[(F.col(f"player_1_{c}") - F.col(f"player_2_{c}")).alias(f"{c}_diff") for c in differ], *[F.least(f"player_1_{c}", f"player_2_{c}").alias(f"{c}_min") for c in least]
    )


def enrich(base: DataFrame, features: DataFrame) -> DataFrame:
    """``base`` with the pre-match columns beside its own; fails if a match_id has several feature rows."""
    return join_validated(base, features, "match_id")


def leakage_audit(project: DataFrame, external: DataFrame, links: DataFrame, features: DataFrame) -> DataFrame:
    """One row: linked rows, days of external matches, players with and without earlier point history, and rows
    whose counts exceed the player's valid matches before the day (leaks; computed, not assumed)."""
    counts = features.select("match_id", F.inline(F.array(*[F.struct(F.lit(n).alias("n"), F.col(f"player_{n}_point_stats_match_count").alias("count"), F.col(f"player_{n}_surface_point_stats_match_count").alias("on_surface")) for n in (1, 2)])))
    valid = player_stats(external).filter("valid").groupBy("player", "day").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("player").orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = valid.select("player", F.col("day").alias("from_day"), F.coalesce(F.lead("day").over(Window.partitionBy("player").orderBy("day")), F.lit(2**31 - 1)).alias("to_day"), F.sum("n").over(upto).alias("upto"))
    first = links.filter("external_row is not null").groupBy("match_id").agg(F.min("external_row").alias("external_row"))
    who = project.select("match_id", "day", "player_1_won").join(first, "match_id").join(external.select("external_row", "winner_id", "loser_id"), "external_row")
    one = F.when(F.col("player_1_won"), F.col("winner_id")).otherwise(F.col("loser_id"))
    two = F.when(F.col("player_1_won"), F.col("loser_id")).otherwise(F.col("winner_id"))
    rows = who.select("match_id", "day", F.inline(F.array(F.struct(F.lit(1).alias("n"), one.alias("player")), F.struct(F.lit(2).alias("n"), two.alias("player"))))).join(counts, ["match_id", "n"])
    on = (rows["player"] == total["player"]) & (total["from_day"] < rows["day"]) & (rows["day"] <= total["to_day"])
    judged = rows.join(total, on, "left").select(rows["match_id"], rows["player"], "count", "on_surface", F.coalesce("upto", F.lit(0)).alias("upto"))
    distinct = lambda c: F.count_distinct(F.when(c, F.col("player")))
    audit = judged.agg(
        F.count_distinct("match_id").alias("target_rows"), F.count_if((F.col("count") > F.col("upto")) | (F.col("on_surface") > F.col("upto"))).alias("leaks"), distinct(F.col("count") == 0).alias("players_with_zero_prior_point_history"),
        distinct(F.col("count") > 0).alias("players_with_overall_history"), distinct(F.col("on_surface") > 0).alias("players_with_surface_history"),
    )
    return audit.crossJoin(external.agg(F.count_distinct("day").alias("same_day_groups_processed")))  # one row each


def invalid_counts(external: DataFrame) -> DataFrame:
    """(side, check, rows): how often each check of a side's counts fails; a side with a missing count fails one of its own."""
    rows = []
    for side in ("winner", "loser"):
        c = lambda name: F.col(f"{side}_{name}")  # noqa: B023, E731
        missing = F.greatest(*[c(n).isNull().cast("int") for n in COUNTS]) > 0
        checks = {
            "missing": missing,
            "no service points": c("svpt") <= 0,
            "first_in outside svpt": ~c("first_in").between(0, c("svpt")),
            "first_won outside first_in": ~c("first_won").between(0, c("first_in")),
            "second_won outside second serves": ~c("second_won").between(0, c("svpt") - c("first_in")),
            "bp_saved outside bp_faced": ~c("bp_saved").between(0, c("bp_faced")),
            "negative ace or df": (c("ace") < 0) | (c("df") < 0),
        }
        rows += [F.struct(F.lit(side).alias("side"), F.lit(name).alias("check"), F.coalesce(bad if name == "missing" else ~missing & bad, F.lit(False)).alias("bad")) for name, bad in checks.items()]
    return external.select(F.inline(F.array(*rows))).groupBy("side", "check").agg(F.count_if("bad").alias("rows"))
