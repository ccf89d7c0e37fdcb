"""Sequential ratings with start-of-day snapshots.

Opponents couple, so a pool of players is one sequence; pools (tours, leagues, or connected components
given as a column) run in parallel. Each pool streams through Python in order; held are one float per player
and surface and the games of a day.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RatingConfig
from .history import ORDER

OUTPUT = (
    "overall_1 double, overall_2 double, surface_1 double, surface_2 double, prior_1 long, prior_2 long, "
    "expected_1 double, surface_expected_1 double"
)
NAMES = [c.split()[0] for c in OUTPUT.split(", ")]
TYPES = [pa.int64() if c.endswith(" long") else pa.float64() for c in OUTPUT.split(", ")]
GAME = ("day", "player_1", "player_2", "surface", "player_1_won", "is_retirement")


def expected(a: float, b: float, scale: float) -> float:
    return 1 / (1 + 10 ** ((b - a) / scale))


def updated(a: float, b: float, won: float, config: RatingConfig) -> tuple[float, float]:
    """Both ratings after a result (1: a won); what one gains the other loses."""
    if won not in (0, 1):
        raise ValueError("a result is 0 or 1")
    shift = config.k * (won - expected(a, b, config.scale))
    return a + shift, b - shift


def rate_rows(rows: Iterable[tuple], config: RatingConfig) -> Iterator[tuple]:
    """Snapshots of (pool, day, player_1, player_2, surface, player_1_won, is_retirement), which come by day and in order.

    Rows of a date all see the ratings it began with, then update one by one. Held: ratings and today's games."""
    pools: dict = {}
    games: list = []
    start, today = config.initial, None
    for pool, day, p1, p2, s, won, retired in rows:
        if day != today:
            for ratings, played, a, b, on, result in games:
                for x, y in ((a, b), ((a, on), (b, on))):
                    ratings[x], ratings[y] = updated(ratings.get(x, start), ratings.get(y, start), int(result), config)
                played[a], played[b] = played.get(a, 0) + 1, played.get(b, 0) + 1
            games, today = [], day
        ratings, played = pools.setdefault(pool, ({}, {}))
        o1, o2 = ratings.get(p1, start), ratings.get(p2, start)
        s1, s2 = ratings.get((p1, s), start), ratings.get((p2, s), start)
        yield o1, o2, s1, s2, played.get(p1, 0), played.get(p2, 0), expected(o1, o2, config.scale), expected(s1, s2, config.scale)
        if not retired:
            games.append((ratings, played, p1, p2, s, won))


def rate_in_order(frame: pd.DataFrame, config: RatingConfig) -> pd.DataFrame:
    """Snapshots of one pool, in any order of rows."""
    rows = frame.sort_values(["day", *ORDER], kind="mergesort")
    games = rows[list(GAME)].itertuples(index=False, name=None)
    made = pd.DataFrame(rate_rows((("all", *g) for g in games), config), columns=NAMES)
    made.insert(0, "match_id", rows["match_id"].to_numpy())
    return made


def add_ratings(matches: DataFrame, config: RatingConfig = RatingConfig(), pool: str | None = None) -> DataFrame:
    """``matches`` with rating columns and differences; ``pool``: column of independent sequences.

    Spark sorts (and spills) the rows; Python takes them in batches, whatever a pool's length."""
    slim = matches.select("match_id", (F.col(pool) if pool else F.lit("all")).alias("__pool"), *GAME, *[c for c in ORDER if c != "match_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: deque = deque()

        def games() -> Iterator[tuple]:
            for batch in (b for b in batches if b.num_rows):
                ids.append(batch.column(0))
                yield from zip(*(c.to_pylist() for c in batch.columns[1 : 2 + len(GAME)]))

        rated = rate_rows(games(), config)
        for first in rated:
            own = ids.popleft()
            rest = islice(rated, len(own) - 1)
            yield pa.RecordBatch.from_arrays([own, *(pa.array(c, t) for c, t in zip(zip(first, *rest), TYPES))], names=["match_id", *NAMES])

    in_order = slim.repartition("__pool").sortWithinPartitions(*[F.col(c).asc_nulls_last() for c in ("day", *ORDER)])
    rated = in_order.mapInArrow(run, f"match_id string, {OUTPUT}")
    joined = matches.join(rated, "match_id")
    return joined.withColumn("overall_elo_diff", F.col("overall_1") - F.col("overall_2")).withColumn("surface_elo_diff", F.col("surface_1") - F.col("surface_2"))


def rating_report(rated: DataFrame) -> DataFrame:
    """One row: matches, updates, distinct players, least and greatest rating; one pass, a row a player is added up."""
    columns = ["overall_1", "overall_2", "surface_1", "surface_2"]
    sides = F.inline(F.array(*[F.struct(F.col(f"player_{n}").alias("p"), F.lit(n).alias("side")) for n in (1, 2)]))
    once = F.col("side") == 1
    players = rated.select("is_retirement", F.least(*columns).alias("lo"), F.greatest(*columns).alias("hi"), sides).groupBy("p").agg(
        F.count_if(once).alias("m"), F.count_if(once & ~F.col("is_retirement")).alias("u"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )
    return players.agg(
        F.coalesce(F.sum("m"), F.lit(0)).alias("matches"),
        F.coalesce(F.sum("u"), F.lit(0)).alias("updates"),
        F.min("lo").alias("minimum_rating"),
        F.max("hi").alias("maximum_rating"),
        F.count("p").alias("players"),
    )
