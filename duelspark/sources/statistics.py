"""External point statistics: one CSV a season, missing columns filled with null and reported."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T

# The file's column for each canonical count, prefixed w_ or l_ there.
COUNT_COLUMNS = {"ace": "ace", "df": "df", "svpt": "svpt", "first_in": "1stIn", "first_won": "1stWon", "second_won": "2ndWon", "sv_gms": "SvGms", "bp_saved": "bpSaved", "bp_faced": "bpFaced"}
PLAIN = ("tourney_id", "tourney_name", "surface", "tourney_date", "match_num", "winner_id", "winner_name", "loser_id", "loser_name", "score", "best_of", "round", "minutes")


@dataclass(frozen=True)
class Loaded:
    matches: DataFrame
    missing_columns: dict[str, list[str]]


def load(spark: SparkSession, folder: str, pattern: str = "atp_matches_*.csv") -> Loaded:
    wanted = [*PLAIN, *(f"{s}_{c}" for s in "wl" for c in COUNT_COLUMNS.values())]
    parts, missing = [], {}
    for k, path in enumerate(sorted(Path(folder).glob(pattern))):
        frame = spark.read.csv(str(path), header=True, inferSchema=False)
        gone = [c for c in wanted if c not in frame.columns]
        if gone:
            missing[path.name] = gone
        columns = [F.col(f"`{c}`") if c in frame.columns else F.lit(None).cast("string").alias(c) for c in wanted]
        parts.append(frame.select(*columns, F.lit(path.name).alias("source_file"), (F.lit(k << 40) + F.monotonically_increasing_id()).alias("external_row")))
    raw = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], ", ".join(f"{c} string" for c in wanted) + ", source_file string, external_row long")
    return Loaded(normalise(raw), missing)


def normalise(raw: DataFrame) -> DataFrame:
    named = T.with_comparable(raw.withColumnsRenamed({"winner_name": "winner", "loser_name": "loser", "tourney_name": "tournament", "surface": "raw_surface", "round": "raw_round"}), ["winner", "loser", "tournament", "raw_round"])
    score = F.coalesce("score", F.lit(""))
    date = F.to_date(F.try_to_timestamp("tourney_date", F.lit("yyyyMMdd")))
    counts = [N.number(F.col(f"{s}_{c}")).alias(f"{side}_{name}") for s, side in (("w", "winner"), ("l", "loser")) for name, c in COUNT_COLUMNS.items()]
    return named.select(
        "external_row",
        "source_file",
        "tourney_id",
        "tournament_normalized",
        date.alias("match_date"),
        F.unix_date(date).alias("day"),
        T.external_surface(F.col("raw_surface")).alias("surface"),
        T.round_name(F.col("raw_round_normalized")).alias("round"),
        *[N.number(F.col(c)).cast("long").alias(c) for c in ("match_num", "winner_id", "loser_id", "best_of")],
        "winner",
        "loser",
        "winner_normalized",
        "loser_normalized",
        T.name_keys(F.col("winner_normalized")).alias("winner_keys"),
        T.name_keys(F.col("loser_normalized")).alias("loser_keys"),
        F.when(N.number(F.col("minutes")) >= 0, N.number(F.col("minutes"))).alias("minutes"),
        score.rlike(T.SCORE_WALKOVER).alias("is_walkover"),
        score.rlike(T.SCORE_RETIREMENT).alias("is_retirement"),
        F.concat_ws("|", "tourney_id", "match_num").alias("external_match_key"),
        *counts,
    )


def load_aliases(spark: SparkSession, path: str) -> DataFrame | None:
    """(name, player_id, line) of a two-column CSV; the last line of a name counts; no file, no aliases."""
    if not Path(path).is_file():
        return None
    raw = spark.read.csv(path, header=True, inferSchema=False)
    name, ident = raw.columns[:2]
    named = T.with_comparable(raw.select(F.col(name).alias("n"), N.number(F.col(ident)).cast("long").alias("player_id"), F.monotonically_increasing_id().alias("line")), ["n"])
    return named.select(F.col("n_normalized").alias("name"), "player_id", "line").filter("name is not null and player_id is not null")
