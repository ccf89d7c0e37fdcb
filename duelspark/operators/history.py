"""Point-in-time form features: everything a player did before today, nothing of today.

Two rows per match (one a side) go through one shuffle by player; all frames share that partitioning.
Retirements get features but never enter a history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import RollingConfig

#: Chronological order of matches within a date.
ORDER = ("tournament", "round", "match_id")
SIDE_COLUMNS = ("prior_matches", "recent_rate", "surface_prior_matches", "surface_recent_rate", "rest_days", "matches_in_schedule")


def sides(matches: DataFrame) -> DataFrame:
    """One row per match and side: player, opponent, result as 0/1, eligible."""
    both = F.explode(
        F.array(
            F.struct(F.lit(1).alias("side"), F.col("player_1").alias("player"), F.col("player_1_won").cast("int").alias("result")),
            F.struct(F.lit(2).alias("side"), F.col("player_2").alias("player"), (1 - F.col("player_1_won").cast("int")).alias("result")),
        )
    )
    base = matches.select("match_id", "day", "surface", "tournament", "round", (~F.col("is_retirement")).alias("eligible"), both.alias("s"))
    return base.select("match_id", "day", "surface", "tournament", "round", "eligible", "s.*")


def _recent(keys: list[str], window: int) -> tuple:
    """Running figures of eligible rows in (day, order), and the frame of all days before today."""
    running = Window.partitionBy(*keys, "eligible").orderBy("day", *ORDER)
    wins = F.sum("result").over(running.rowsBetween(Window.unboundedPreceding, 0))
    older = F.sum("result").over(running.rowsBetween(Window.unboundedPreceding, -window))
    seq = F.row_number().over(running)
    before = Window.partitionBy(*keys).orderBy("day").rangeBetween(Window.unboundedPreceding, -1)
    return seq, wins - F.coalesce(older, F.lit(0)), before


def player_history(matches: DataFrame, config: RollingConfig = RollingConfig()) -> DataFrame:
    """Per match and side: counts, recent rates overall and on the surface, rest days, schedule density."""
    rows = sides(matches)
    out = rows
    for prefix, keys in (("", ["player"]), ("surface_", ["player", "surface"])):
        seq, last_wins, before = _recent(keys, config.window)
        out = out.withColumn("__state", F.struct(seq.alias("n"), last_wins.alias("w")))
        state = F.max(F.when(F.col("eligible"), F.col("__state"))).over(before)
        out = out.withColumn("__last", state)
        n, w = F.coalesce(F.col("__last.n"), F.lit(0)), F.col("__last.w")
        rate = F.when(n == 0, F.lit(config.neutral_rate)).otherwise(w / F.least(n, F.lit(config.window)))
        count = n if not prefix else F.least(n, F.lit(config.window))
        out = out.withColumn(f"{prefix}prior_matches", count.cast("long")).withColumn(f"{prefix}recent_rate", rate)
        if not prefix:
            eligible_day = F.when(F.col("eligible"), F.col("day"))
            schedule = Window.partitionBy("player").orderBy("day").rangeBetween(-config.schedule_days, -1)
            out = out.withColumn("rest_days", (F.col("day") - F.max(eligible_day).over(before)).cast("double"))
            out = out.withColumn("matches_in_schedule", F.count(eligible_day).over(schedule))
    return out.select("match_id", "side", "player", "surface", *SIDE_COLUMNS)


def add_history(matches: DataFrame, config: RollingConfig = RollingConfig()) -> DataFrame:
    """``matches`` with both sides' features, their differences (1 minus 2) and the smaller history."""
    history = player_history(matches, config)
    wide = history.groupBy("match_id").agg(*[F.max(F.when(F.col("side") == s, F.col(c))).alias(f"player_{s}_{c}") for s in (1, 2) for c in SIDE_COLUMNS])
    joined = matches.join(wide, "match_id")
    for c in ("recent_rate", "surface_recent_rate", "rest_days", "matches_in_schedule"):
        joined = joined.withColumn(f"{c}_diff", F.col(f"player_1_{c}") - F.col(f"player_2_{c}"))
    return joined.withColumn("history_count_min", F.least("player_1_prior_matches", "player_2_prior_matches"))


def build_features(rated: DataFrame, config: RollingConfig = RollingConfig()) -> DataFrame:
    """Model features of rated matches: form, rank and format columns."""
    frame = add_history(rated, config)
    return (
        frame.withColumn("rank_diff", F.col("rank_2") - F.col("rank_1"))
        .withColumn("log_rank_diff", F.log1p(F.col("rank_2").cast("double")) - F.log1p(F.col("rank_1").cast("double")))
        .withColumn("rank_missing", F.col("rank_1").isNull() | F.col("rank_2").isNull())
        .withColumn("best_of_5", (F.coalesce("best_of", F.lit(3)) == 5).cast("long"))
        .withColumn("surface_clay", (F.col("surface") == "Clay").cast("long"))
        .withColumn("surface_grass", (F.col("surface") == "Grass").cast("long"))
    )


def validate(matches: DataFrame, surfaces: tuple[str, ...] = ("Hard", "Clay", "Grass")) -> None:
    """Fails on missing columns, duplicate or null ids, bad dates, surfaces, results or players; one pass."""
    needed = {"match_id", "day", "surface", "tournament", "round", "player_1", "player_2", "player_1_won", "is_retirement"}
    missing = sorted(needed - set(matches.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    bad = {
        "null dates": F.col("day").isNull(),
        "unsupported surfaces": ~F.coalesce(F.col("surface").isin(*surfaces), F.lit(False)),
        "missing results": F.col("player_1_won").isNull() | F.col("is_retirement").isNull(),
        "missing players": F.col("player_1").isNull() | F.col("player_2").isNull(),
        "same player twice": F.col("player_1") == F.col("player_2"),
    }
    repeated = matches.groupBy("match_id").count().filter("count > 1 or match_id is null").limit(1).count()
    counts = matches.agg(*[F.coalesce(F.sum(c.cast("int")), F.lit(0)).alias(k) for k, c in bad.items()]).first().asDict()
    found = [f"{k}: {v}" for k, v in counts.items() if v] + (["duplicate or null match ids"] if repeated else [])
    if found:
        raise ValueError("; ".join(found))


def feature_report(features: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: nulls, minimum, maximum."""
    wide = features.agg(*[x for c in columns for x in (F.count_if(F.col(c).isNull()).alias(f"{c}|n"), F.min(F.col(c).cast("double")).alias(f"{c}|lo"), F.max(F.col(c).cast("double")).alias(f"{c}|hi"))])
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"{c}|n").alias("nulls"), F.col(f"{c}|lo").alias("minimum"), F.col(f"{c}|hi").alias("maximum")) for c in columns]
    return wide.select(F.inline(F.array(*rows)))
