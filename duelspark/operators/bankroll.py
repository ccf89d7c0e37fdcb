"""Compounding paper ledger in closed form, drawdown, streaks, grouped performance.

Each bet stakes a fixed share f of the bankroll, so the bankroll after bet n is B0 times the product of
(1 + f * g) with g = odds - 1, -1 or 0. The product runs over the recommended rows of one partition.
To keep that sequence off a single task, bets are cut into ordered slices: products inside slices are
windows of their own, and the slices' products, one row each, are chained.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BankrollConfig
from ..functions import numbers as N

#: Days of bets in one slice of the ledger.
SLICE_DAYS = 90


def settle(config: BankrollConfig) -> Column:
    won = (F.col("recommended_side") == "player_1") == F.col("actual_player_1_won")
    void = F.col("is_retirement") & F.lit(config.retirements == "void")
    return F.when(void, "void").when(won, "won").otherwise("lost")


def ledger(assessed: DataFrame, config: BankrollConfig = BankrollConfig()) -> DataFrame:
    bets = assessed.filter((F.col("partition") == config.partition) & F.col("has_recommendation")).withColumn("result", settle(config))
    gain = F.when(F.col("result") == "won", F.col("recommended_odds") - 1).when(F.col("result") == "lost", -1.0).otherwise(0.0)
    bets = bets.withColumn("__factor", 1 + config.fraction * gain).withColumn("__slice", F.floor(F.unix_date("match_date") / SLICE_DAYS))
    slices = bets.groupBy("__slice").agg(F.product("__factor").alias("p"), F.count(F.lit(1)).alias("n"))
    chain = Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.select("__slice", F.coalesce(F.product("p").over(chain), F.lit(1.0)).alias("__before"), F.coalesce(F.sum("n").over(chain), F.lit(0)).alias("__count"))
    inside = Window.partitionBy("__slice").orderBy("match_date", "match_id")
    rows = bets.join(starts, "__slice")
    before = F.coalesce(F.product("__factor").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0))
    out = rows.withColumn("bet_sequence", F.col("__count") + F.row_number().over(inside))
    out = out.withColumn("bankroll_before", config.start * F.col("__before") * before).withColumn("stake", config.fraction * F.col("bankroll_before"))
    out = out.withColumn("profit_loss", F.col("stake") * gain).withColumn("bankroll_after", F.col("bankroll_before") * F.col("__factor"))
    out = out.withColumn("edge_bucket", N.bucket(F.col("recommended_edge"), N.EDGE_BUCKETS)).withColumn("odds_bucket", N.odds_bucket(F.col("recommended_odds")))
    return out.drop("__slice", "__factor", "__before", "__count")


def drawdown(book: DataFrame, start: float) -> DataFrame:
    """Per bet: running peak (the start counts), drawdown and its share of the peak; balances count to 8 digits."""
    sliced = book.withColumn("__slice", F.floor(F.unix_date("match_date") / SLICE_DAYS)).withColumn("__after", F.round("bankroll_after", 8))
    chain = Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    peaks = sliced.groupBy("__slice").agg(F.max("__after").alias("m")).select("__slice", F.coalesce(F.max("m").over(chain), F.lit(start)).alias("__peak"))
    inside = Window.partitionBy("__slice").orderBy("bet_sequence").rowsBetween(Window.unboundedPreceding, 0)
    peak = F.greatest(F.max("__after").over(inside), F.col("__peak"), F.lit(start))
    out = sliced.join(peaks, "__slice").withColumn("running_peak", peak)
    out = out.withColumn("drawdown", F.col("running_peak") - F.col("__after")).withColumn("drawdown_percentage", F.col("drawdown") / F.col("running_peak"))
    return out.drop("__slice", "__peak", "__after")


def longest_streaks(book: DataFrame) -> DataFrame:
    """(result, longest): longest runs of wins and losses, voids passed over.

    Runs are found inside slices; only a slice's first and last run, which may go on in its neighbours, are chained."""
    bets = book.filter("result in ('won', 'lost')").select("result", "bet_sequence", F.floor(F.unix_date("match_date") / SLICE_DAYS).alias("slice"))
    inside = Window.partitionBy("slice").orderBy("bet_sequence")
    runs = bets.withColumn("run", F.row_number().over(inside) - F.row_number().over(Window.partitionBy("slice", "result").orderBy("bet_sequence")))
    runs = runs.groupBy("slice", "result", "run").agg(F.count(F.lit(1)).alias("n"), F.min("bet_sequence").alias("at"))
    placed = runs.select("slice", "result", "n", "at", F.row_number().over(Window.partitionBy("slice").orderBy("at")).alias("place"), F.count(F.lit(1)).over(Window.partitionBy("slice")).alias("runs"))
    inner = placed.filter("place > 1 and place < runs").groupBy("result").agg(F.max("n").alias("n"))
    edges = placed.filter("place = 1 or place = runs")  # at most two rows a slice
    chain = Window.orderBy("at")
    starts = (F.col("result") != F.lag("result", 1, "").over(chain)) | (F.col("place") > 1)
    joined = edges.withColumn("island", F.sum(starts.cast("long")).over(chain)).groupBy("result", "island").agg(F.sum("n").alias("n"))
    return joined.select("result", "n").unionByName(inner).groupBy("result").agg(F.max("n").alias("longest"))


def performance(book: DataFrame, keys: list[str]) -> DataFrame:
    return book.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("bets"),
        *[F.count_if(F.col("result") == r).alias(n) for r, n in (("won", "wins"), ("lost", "losses"), ("void", "voids"))],
        F.sum("stake").alias("total_staked"),
        F.sum("profit_loss").alias("profit_loss"),
        F.try_divide(F.sum("profit_loss"), F.sum("stake")).alias("roi"),
        F.avg("recommended_odds").alias("average_odds"),
        F.avg("recommended_edge").alias("average_edge"),
    )


def ledger_summary(book: DataFrame, config: BankrollConfig) -> DataFrame:
    falls = drawdown(book, config.start)
    won, lost = (F.count_if(F.col("result") == r) for r in ("won", "lost"))
    return falls.agg(
        F.count(F.lit(1)).alias("bets_placed"),
        won.alias("wins"),
        lost.alias("losses"),
        F.count_if(F.col("result") == "void").alias("voids"),
        (F.lit(config.start) + F.coalesce(F.sum("profit_loss"), F.lit(0.0))).alias("ending_bankroll"),
        F.coalesce(F.sum("stake"), F.lit(0.0)).alias("total_staked"),
        F.try_divide(F.sum("profit_loss"), F.sum("stake")).alias("roi"),
        F.try_divide(won.cast("double"), (won + lost).cast("double")).alias("win_rate"),
        F.coalesce(F.max("drawdown"), F.lit(0.0)).alias("maximum_drawdown"),
        F.coalesce(F.max("drawdown_percentage"), F.lit(0.0)).alias("maximum_drawdown_percentage"),
    )
