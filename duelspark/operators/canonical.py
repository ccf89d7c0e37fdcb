"""Canonical matches: ordered rejection, neutral orientation, duplicate handling, quality report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

BOOKS = ("b365", "ps", "avg", "max")


@dataclass(frozen=True)
class Cleaned:
    matches: DataFrame
    rejected: DataFrame
    report: DataFrame


def rejection_reason() -> Column:
    """First failing rule of a raw row with comparable columns; null where the row is good."""
    walkover = T.status_text(F.col("status_or_comment")).rlike(T.WALKOVER)
    return (
        F.when(F.col("match_date").isNull(), "invalid_match_date")
        .when(T.folded(F.col("winner")).isNull(), "missing_winner")
        .when(T.folded(F.col("loser")).isNull(), "missing_loser")
        .when(walkover, "walkover")
        .when(F.col("winner_normalized").isNull() | F.col("loser_normalized").isNull(), "missing_winner_result")
        .when(F.col("winner_normalized") == F.col("loser_normalized"), "same_player")
        .when(~T.surface_name(F.col("surface_normalized")).isin(*T.SURFACES), "unsupported_surface")
        .when(~F.coalesce("best_of", F.lit(3)).isin(3, 5), "invalid_best_of")
    )


def orient(raw: DataFrame) -> DataFrame:
    """Player 1 is the one whose comparable name sorts first; winner and loser columns follow."""
    swapped = F.col("winner_normalized") > F.col("loser_normalized")
    columns = [
        T.folded(F.col("tournament")).alias("tournament"),
        F.col("tournament_normalized"),
        T.surface_name(F.col("surface_normalized")).alias("surface"),
        T.round_name(F.col("round_normalized")).alias("round"),
        F.coalesce("best_of", F.lit(3)).cast("long").alias("best_of"),
        (~swapped).alias("player_1_won"),
        T.status_text(F.col("status_or_comment")).rlike(T.RETIREMENT).alias("is_retirement"),
    ]
    for n, flip in ((1, False), (2, True)):
        a, b = ("winner", "loser") if not flip else ("loser", "winner")
        columns += [
            F.when(swapped, T.display_text(F.col(b))).otherwise(T.display_text(F.col(a))).alias(f"player_{n}"),
            F.when(swapped, F.col(f"{b}_normalized")).otherwise(F.col(f"{a}_normalized")).alias(f"player_{n}_normalized"),
            F.when(swapped, F.col(f"{b}_rank")).otherwise(F.col(f"{a}_rank")).alias(f"player_{n}_rank"),
            F.when(swapped, F.col(f"{b}_odds")).otherwise(F.col(f"{a}_odds")).alias(f"player_{n}_odds"),
        ]
        for book in BOOKS:
            columns.append(F.when(swapped, F.col(f"{b}_{book}_odds")).otherwise(F.col(f"{a}_{book}_odds")).alias(f"player_{n}_{book}_odds"))
    for book in BOOKS:
        columns += [F.col(f"winner_{book}_odds").alias(f"source_winner_{book}_odds"), F.col(f"loser_{book}_odds").alias(f"source_loser_{book}_odds"), F.col(f"{book}_pair_available")]
    oriented = raw.select("row_index", "match_date", "odds_source", "source_file", *columns)
    ident = T.match_id(F.col("match_date"), F.col("tournament_normalized"), F.col("round"), F.col("player_1_normalized"), F.col("player_2_normalized"))
    return oriented.withColumn("match_id", ident)


def duplicate_status(frame: DataFrame, key: str, order: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """Adds duplicate_status: null to keep, exact_duplicate (all but the first of equal rows), conflicting_duplicate.

    Rows of a key are compared by all columns but ``ignore``; nulls compare equal."""
    content = F.struct(*[c for c in frame.columns if c not in (*ignore, key, order)])
    by_key = Window.partitionBy(key)
    differ = ~F.min(content).over(by_key).eqNullSafe(F.max(content).over(by_key))
    status = F.when(differ, "conflicting_duplicate").when(F.row_number().over(by_key.orderBy(order)) > 1, "exact_duplicate")
    return frame.withColumn("duplicate_status", status)


def clean(raw: DataFrame) -> Cleaned:
    """Raw rows (with row_index) to canonical matches, rejected rows and a one-row report."""
    named = T.with_comparable(raw, ["winner", "loser", "tournament", "surface", "round"])
    judged = named.withColumn("rejection_reason", rejection_reason())
    oriented = duplicate_status(orient(judged.filter("rejection_reason is null")), "match_id", "row_index", ("source_file",))
    matches = oriented.filter("duplicate_status is null").drop("duplicate_status")
    late = oriented.filter("duplicate_status is not null").select("row_index", F.col("duplicate_status").alias("rejection_reason"), "source_file")
    rejected = judged.filter("rejection_reason is not null").select("row_index", "rejection_reason", "source_file").unionByName(late)
    report = quality_report(raw, matches, rejected)
    return Cleaned(matches.drop("row_index"), rejected, report)


def in_order(matches: DataFrame) -> DataFrame:
    """Canonical matches in the order that files hold them."""
    return matches.orderBy("match_date", "tournament_normalized", "round", "match_id")


def counts_map(frame: DataFrame, column: str, name: str) -> DataFrame:
    """One row with the map value -> count."""
    counted = frame.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("Missing")).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return counted.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("v", "n")))).alias(name))


def quality_report(raw: DataFrame, matches: DataFrame, rejected: DataFrame) -> DataFrame:
    total = raw.agg(F.count(F.lit(1)).alias("rows_received"))
    good = matches.agg(F.count(F.lit(1)).alias("rows_accepted"), F.min("match_date").alias("first_date"), F.max("match_date").alias("last_date"))
    out = total.crossJoin(good)  # every part is one row
    for frame, column, name in ((rejected, "rejection_reason", "rejections"), (matches, "surface", "surfaces"), (matches, "round", "rounds"), (matches, "source_file", "files"), (raw, "surface", "original_surfaces")):
        out = out.crossJoin(counts_map(frame, column, name))
    rate = F.coalesce(F.try_divide(F.col("rows_accepted"), F.col("rows_received")), F.lit(0.0))
    return out.withColumn("acceptance_rate", rate)
