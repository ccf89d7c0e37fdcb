"""Named queries over the driver's tables with the SQL that another engine checks them by.

Doubles are rounded on both sides; counts are 64-bit. ``QUERIES`` maps a name to a function of
(spark, folder), ``ORACLES`` to DuckDB SQL over the same tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import BankrollConfig, Fold
from ..functions import numbers as N
from ..functions import text as T
from ..operators import bankroll, canonical, decisions, history, linkage, markets, metrics, models, ratings, records, reports, resample, stats
from .views import duck, matches

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FOLDS = (Fold(1, 1995, 1997, 1998), Fold(2, 1995, 1998, 1999), Fold(3, 1995, 1999, 2000))
FOLDS_SQL = "(SELECT * FROM (VALUES (1, 1995, 1997, 1998), (2, 1995, 1998, 1999), (3, 1995, 1999, 2000)) AS f(fold, a, b, e))"


def tidy(frame: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, integers widened, so that both engines hash alike."""
    kinds = {"double": lambda c: F.round(c, digits), "int": lambda c: c.cast("long"), "float": lambda c: F.round(c.cast("double"), digits)}
    return frame.select(*[kinds[t](F.col(c)).alias(c) if t in kinds else F.col(c) for c, t in frame.dtypes])


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = lambda spark, folder: tidy(f(spark, folder))
        if sql:
            ORACLES[name] = duck(sql)
        return f

    return add


def r(expression: str, name: str) -> str:
    return f"round(cast({expression} AS double), 6) AS {name}"


VALID = "coalesce(odds_1 > 1 AND odds_2 > 1, false)"
MARKET = "(1 / odds_1) / (1 / odds_1 + 1 / odds_2)"
OVER = "(1 / odds_1 + 1 / odds_2)"
LL = lambda y, p: f"-({y} * ln(least(greatest({p}, 1e-15), 1 - 1e-15)) + (1 - {y}) * ln(1 - least(greatest({p}, 1e-15), 1 - 1e-15)))"


# ---- prices ---------------------------------------------------------------------------------------


@query("novig_market", f"SELECT match_id, {r(MARKET, 'market_1')}, {r('1 - ' + MARKET, 'market_2')}, {r(OVER, 'overround')}, {r(f'ln(least(greatest({MARKET}, 1e-6), 1 - 1e-6) / (1 - least(greatest({MARKET}, 1e-6), 1 - 1e-6)))', 'logit')} FROM mv WHERE {VALID}")
def novig_market(spark, folder):
    m = models.market_features(matches(spark, folder))
    return m.select("match_id", F.col("market_probability").alias("market_1"), (1 - F.col("market_probability")).alias("market_2"), "overround", F.col(models.MARKET).alias("logit"))


def _quantiles(o: str, *pairs: tuple[float, str]) -> str:
    return ", ".join(r(f"quantile_cont({o}, {q})", n) for q, n in pairs)


OVERROUND_SQL = f"count(*)::BIGINT AS rows, {r('avg(o)', 'mean_overround')}, {_quantiles('o', (0.5, 'median_overround'))}, {r('min(o)', 'min_overround')}, {r('max(o)', 'max_overround')}, {_quantiles('o', (0.05, 'p05_overround'), (0.95, 'p95_overround'))}"


@query("overround_by_surface_year", f"SELECT surface, year::BIGINT AS year, {OVERROUND_SQL} FROM (SELECT *, {OVER} AS o FROM mv WHERE {VALID}) GROUP BY surface, year")
def overround_by_surface_year(spark, folder):
    m = models.market_features(matches(spark, folder))
    return markets.overround_by(m.withColumn("year", F.col("year").cast("long")), ["surface", "year"])


WL = "(SELECT *, CASE WHEN player_1_won THEN odds_1 ELSE odds_2 END AS w, CASE WHEN player_1_won THEN odds_2 ELSE odds_1 END AS l FROM mv)"
FLAGS = ["used_fallback_source", "overround_below_1_00", "overround_above_1_12", "either_odd_below_1_02", "either_odd_above_30", "missing_paired_odds", "suspected_maximum_odds", "large_market_reference_disagreement", "bookmaker_to_bookmaker_disagreement"]


def _winner_loser(m: DataFrame) -> DataFrame:
    won = F.col("player_1_won")
    return m.withColumn("winner_odds", F.when(won, F.col("odds_1")).otherwise(F.col("odds_2"))).withColumn("loser_odds", F.when(won, F.col("odds_2")).otherwise(F.col("odds_1")))


@query("odds_quality_flags", f"""SELECT match_id, {r('1 / w + 1 / l', 'overround')}, odds_source = 'Average' AS used_fallback_source,
  coalesce(1 / w + 1 / l < 1, false) AS overround_below_1_00, coalesce(1 / w + 1 / l > 1.12, false) AS overround_above_1_12,
  coalesce(w < 1.02 OR l < 1.02, false) AS either_odd_below_1_02, coalesce(w > 30 OR l > 30, false) AS either_odd_above_30,
  w IS NULL OR l IS NULL AS missing_paired_odds, odds_source = 'Maximum' AS suspected_maximum_odds,
  coalesce(w > l, false) AND odds_source <> 'Missing' AS large_market_reference_disagreement, false AS bookmaker_to_bookmaker_disagreement FROM {WL}""")
def odds_quality_flags(spark, folder):
    return markets.quality_flags(_winner_loser(matches(spark, folder))).select("match_id", "overround", *FLAGS)


@query("overround_by_source", f"SELECT odds_source, year::BIGINT AS year, {OVERROUND_SQL} FROM (SELECT *, 1 / w + 1 / l AS o FROM {WL}) WHERE o IS NOT NULL GROUP BY odds_source, year")
def overround_by_source(spark, folder):
    flagged = markets.quality_flags(_winner_loser(matches(spark, folder))).withColumn("year", F.col("year").cast("long"))
    return markets.overround_by(flagged, ["odds_source", "year"])


@query("price_buckets", f"""SELECT match_id, CASE WHEN odds_1 >= 1.5 AND odds_1 < 1.75 THEN '1.50-1.75' WHEN odds_1 >= 1.75 AND odds_1 < 2 THEN '1.75-2.00'
  WHEN odds_1 >= 2 AND odds_1 < 2.5 THEN '2.00-2.50' WHEN odds_1 >= 2.5 AND odds_1 <= 3.5 THEN '2.50-3.50' ELSE 'other' END AS odds_bucket,
  CASE WHEN e < 0.04 THEN '<0.04' WHEN e < 0.06 THEN '0.04-0.06' WHEN e < 0.08 THEN '0.06-0.08' WHEN e < 0.12 THEN '0.08-0.12' ELSE '0.12+' END AS edge_bucket,
  strftime(match_date, '%G') <> '' AS dated, concat(year::INT, '-W', lpad(week(match_date)::VARCHAR, 2, '0')) AS block FROM (SELECT *, p_model - {MARKET} AS e FROM mv WHERE {VALID})""")
def price_buckets(spark, folder):
    m = models.market_features(matches(spark, folder))
    edge = F.col("p_model") - F.col("market_probability")
    return m.select("match_id", N.odds_bucket(F.col("odds_1")).alias("odds_bucket"), N.bucket(edge, N.EDGE_BUCKETS).alias("edge_bucket"), F.lit(True).alias("dated"), N.iso_block(F.col("match_date")).alias("block"))


# ---- text and canonical matches -------------------------------------------------------------------

RAW = """(SELECT k AS row_index, CASE WHEN k % 53 = 0 THEN NULL ELSE match_date END AS match_date,
  concat(' ', upper(tournament), ' - open ') AS tournament,
  CASE WHEN k % 97 = 0 THEN 'H' WHEN k % 89 = 0 THEN ' c ' WHEN k % 83 = 0 THEN 'G' ELSE CASE k % 8 WHEN 0 THEN 'Indoor Hard' WHEN 1 THEN 'clay' WHEN 2 THEN 'Red Clay' WHEN 3 THEN 'GRASS' WHEN 4 THEN 'Carpet' WHEN 5 THEN 'hardcourt' WHEN 6 THEN 'Hard (i)' ELSE 'Grass' END END AS surface,
  CASE k % 9 WHEN 0 THEN '1st Round' WHEN 1 THEN 'Quarterfinals' WHEN 2 THEN 'The Final' WHEN 3 THEN 'Semi-Finals' WHEN 4 THEN 'round of 16' WHEN 5 THEN 'RR' WHEN 6 THEN NULL WHEN 7 THEN 'Bronze Medal' ELSE 'somewhere' END AS round,
  CASE WHEN k % 61 = 0 THEN 4 WHEN k % 5 = 0 THEN NULL ELSE best_of END AS best_of,
  CASE WHEN k % 59 = 0 THEN '  ' ELSE concat(CASE WHEN player_1_won THEN player_1 ELSE player_2 END, '-Smith  J.') END AS winner,
  CASE WHEN k % 73 = 0 THEN concat(CASE WHEN player_1_won THEN player_1 ELSE player_2 END, ' SMITH, J') ELSE concat(CASE WHEN player_1_won THEN player_2 ELSE player_1 END, ' O''Neil K') END AS loser,
  CASE WHEN k % 67 = 0 THEN 'W/O' WHEN k % 71 = 0 THEN 'Retired (knee)' WHEN k % 3 = 0 THEN NULL ELSE 'Completed' END AS status_or_comment,
  concat('season_', cast(cast(year AS bigint) AS string), '.csv') AS source_file FROM mv)"""
WORDS = lambda c: f"nullif(trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g')), '')"
SURFACE_SQL = f"""CASE WHEN {WORDS('surface')} LIKE '%hard%' AND {WORDS('surface')} NOT LIKE '%clay%' OR {WORDS('surface')} = 'h' THEN 'Hard' WHEN {WORDS('surface')} IN ('clay', 'c') OR {WORDS('surface')} LIKE '% clay' THEN 'Clay'
  WHEN {WORDS('surface')} IN ('grass', 'g') OR {WORDS('surface')} LIKE '% grass' THEN 'Grass' ELSE 'Other' END"""
ROUND_SQL = "CASE " + " ".join(f"WHEN {WORDS('round')} = '{text}' THEN '{name}'" for text, name in T.ROUNDS.items()) + " ELSE 'Unknown' END"
REASON_SQL = f"""CASE WHEN match_date IS NULL THEN 'invalid_match_date' WHEN nullif(trim(winner), '') IS NULL THEN 'missing_winner' WHEN nullif(trim(loser), '') IS NULL THEN 'missing_loser'
  WHEN regexp_matches(coalesce(status_or_comment, ''), '(?i)\\b(walk\\s*-?\\s*over|w\\s*/?\\s*o|wo)\\b') THEN 'walkover' WHEN {WORDS('winner')} = {WORDS('loser')} THEN 'same_player'
  WHEN {SURFACE_SQL} = 'Other' THEN 'unsupported_surface' WHEN coalesce(best_of, 3) NOT IN (3, 5) THEN 'invalid_best_of' END"""


def raw_matches(spark: SparkSession, folder: str) -> DataFrame:
    m = matches(spark, folder)
    raw = spark.sql("SELECT * FROM " + RAW.replace("FROM mv", "FROM {mv}"), mv=m)
    prices = [F.lit(None).cast("double").alias(f"{s}_{b}_odds") for s in ("winner", "loser") for b in canonical.BOOKS]
    return raw.select(
        "*", *[F.lit(None).cast("long").alias(f"{s}_rank") for s in ("winner", "loser")], *[F.lit(None).cast("double").alias(f"{s}_odds") for s in ("winner", "loser")], F.lit("Missing").alias("odds_source"), *prices, *[F.lit(False).alias(f"{b}_pair_available") for b in canonical.BOOKS]
    )


@query("reject_reasons", f"SELECT row_index::BIGINT AS row_index, {REASON_SQL} AS rejection_reason FROM {RAW}")
def reject_reasons(spark, folder):
    named = T.with_comparable(raw_matches(spark, folder), ["winner", "loser", "surface"])
    return named.select("row_index", canonical.rejection_reason().alias("rejection_reason"))


@query("normalized_names", f"SELECT row_index::BIGINT AS row_index, {WORDS('winner')} AS winner_normalized, {WORDS('tournament')} AS tournament_normalized, {SURFACE_SQL} AS surface, {ROUND_SQL} AS round FROM {RAW}")
def normalized_names(spark, folder):
    named = T.with_comparable(raw_matches(spark, folder), ["winner", "tournament", "surface", "round"])
    return named.select("row_index", "winner_normalized", "tournament_normalized", T.surface_name(F.col("surface_normalized")).alias("surface"), T.round_name(F.col("round_normalized")).alias("round"))


CANON = f"""(SELECT *, substr(sha256(concat(strftime(match_date, '%Y-%m-%d'), '|', tn, '|', rd, '|', least(wn, ln), '|', greatest(wn, ln))), 1, 24) AS match_id
  FROM (SELECT *, {WORDS('winner')} AS wn, {WORDS('loser')} AS ln, {WORDS('tournament')} AS tn, {ROUND_SQL} AS rd, {SURFACE_SQL} AS sf FROM {RAW} WHERE {REASON_SQL} IS NULL))"""


@query("canonical_matches", f"""SELECT match_id, match_date, tn AS tournament_normalized, sf AS surface, rd AS round, coalesce(best_of, 3)::BIGINT AS best_of, least(wn, ln) AS player_1_normalized,
  greatest(wn, ln) AS player_2_normalized, wn < ln AS player_1_won, regexp_matches(coalesce(status_or_comment, ''), '(?i)\\b(ret|retired|retirement|abandoned)\\b') AS is_retirement
  FROM {CANON} QUALIFY count(DISTINCT concat_ws('~', trim(tournament), sf, coalesce(best_of, 3), trim(winner), trim(loser), regexp_matches(coalesce(status_or_comment, ''), '(?i)\\b(ret|retired|retirement|abandoned)\\b'))) OVER (PARTITION BY match_id) = 1
    AND row_number() OVER (PARTITION BY match_id ORDER BY row_index) = 1""")
def canonical_matches(spark, folder):
    return canonical.clean(raw_matches(spark, folder)).matches.select("match_id", "match_date", "tournament_normalized", "surface", "round", "best_of", "player_1_normalized", "player_2_normalized", "player_1_won", "is_retirement")


DUPES = """(SELECT match_id, best_of, surface, k FROM mv UNION ALL SELECT match_id, best_of, surface, k + 1000000000 FROM mv WHERE k % 7 = 0 UNION ALL SELECT match_id, best_of + 2, surface, k + 2000000000 FROM mv WHERE k % 11 = 0)"""


@query("dedupe_exact_conflict", f"""SELECT match_id, k::BIGINT AS k, CASE WHEN count(DISTINCT concat(best_of, surface)) OVER (PARTITION BY match_id) > 1 THEN 'conflicting_duplicate'
  WHEN row_number() OVER (PARTITION BY match_id ORDER BY k) > 1 THEN 'exact_duplicate' END AS duplicate_status FROM {DUPES}""")
def dedupe_exact_conflict(spark, folder):
    m = matches(spark, folder).select("match_id", "best_of", "surface", "k")
    rows = m.unionByName(m.filter("k % 7 = 0").withColumn("k", F.col("k") + 1000000000)).unionByName(m.filter("k % 11 = 0").withColumn("k", F.col("k") + 2000000000).withColumn("best_of", F.col("best_of") + 2))
    return canonical.duplicate_status(rows, "match_id", "k").select("match_id", "k", "duplicate_status")


@query("quality_report", f"SELECT coalesce({REASON_SQL}, 'accepted') AS outcome, count(*)::BIGINT AS n, min(match_date) AS first_date, max(match_date) AS last_date FROM {RAW} GROUP BY 1")
def quality_report(spark, folder):
    named = T.with_comparable(raw_matches(spark, folder), ["winner", "loser", "surface"])
    outcome = F.coalesce(canonical.rejection_reason(), F.lit("accepted")).alias("outcome")
    return named.groupBy(outcome).agg(F.count(F.lit(1)).alias("n"), F.min("match_date").alias("first_date"), F.max("match_date").alias("last_date"))


# ---- point-in-time history ------------------------------------------------------------------------

SIDES = """l AS (SELECT match_id, day, surface, tournament, round, NOT is_retirement AS ok, 1 AS side, player_1 AS player, player_1_won::INT AS won FROM mv
  UNION ALL SELECT match_id, day, surface, tournament, round, NOT is_retirement, 2, player_2, 1 - player_1_won::INT FROM mv)"""


def _recent_sql(keys: str, cap: bool) -> str:
    same = " AND ".join(f"b.{k} = e.{k}" for k in keys.split(", "))
    n = "least(n, 10)" if cap else "n"
    return f"""WITH {SIDES}, e AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY day, tournament, round, match_id) AS seq FROM l WHERE ok),
  b AS (SELECT *, count(*) FILTER (WHERE ok) OVER (PARTITION BY {keys} ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM l)
  SELECT b.match_id, b.side::BIGINT AS side, any_value({n})::BIGINT AS prior, round(coalesce(avg(e.won), 0.5), 6) AS rate
  FROM b LEFT JOIN e ON {same} AND e.seq <= b.n AND e.seq > b.n - 10 GROUP BY b.match_id, b.side"""


@query("recent10_win_rate", _recent_sql("player", False))
def recent10_win_rate(spark, folder):
    return history.player_history(matches(spark, folder)).select("match_id", "side", F.col("prior_matches").alias("prior"), F.col("recent_rate").alias("rate"))


@query("surface_recent10", _recent_sql("player, surface", True))
def surface_recent10(spark, folder):
    return history.player_history(matches(spark, folder)).select("match_id", "side", F.col("surface_prior_matches").alias("prior"), F.col("surface_recent_rate").alias("rate"))


@query("rest_and_schedule", f"""WITH {SIDES} SELECT match_id, side::BIGINT AS side,
  (day - max(CASE WHEN ok THEN day END) OVER (PARTITION BY player ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::DOUBLE AS rest_days,
  count(*) FILTER (WHERE ok) OVER (PARTITION BY player ORDER BY day RANGE BETWEEN 14 PRECEDING AND 1 PRECEDING) AS matches_in_schedule FROM l""")
def rest_and_schedule(spark, folder):
    return history.player_history(matches(spark, folder)).select("match_id", "side", "rest_days", "matches_in_schedule")


@query("rolling_diffs", f"""WITH {SIDES}, w AS (SELECT match_id, side, day - max(CASE WHEN ok THEN day END) OVER b AS rest, count(*) FILTER (WHERE ok) OVER b AS n,
  count(*) FILTER (WHERE ok) OVER (PARTITION BY player ORDER BY day RANGE BETWEEN 14 PRECEDING AND 1 PRECEDING) AS s FROM l
  WINDOW b AS (PARTITION BY player ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT a.match_id, (a.rest - b.rest)::DOUBLE AS rest_days_diff, (a.s - b.s)::BIGINT AS matches_in_schedule_diff, least(a.n, b.n)::BIGINT AS history_count_min
  FROM w a JOIN w b ON a.match_id = b.match_id AND a.side = 1 AND b.side = 2""")
def rolling_diffs(spark, folder):
    return history.add_history(matches(spark, folder)).select("match_id", "rest_days_diff", "matches_in_schedule_diff", "history_count_min")


@query("rank_features", f"""SELECT match_id, (rank_2 - rank_1)::BIGINT AS rank_diff, {r('ln(1 + rank_2) - ln(1 + rank_1)', 'log_rank_diff')}, rank_1 IS NULL OR rank_2 IS NULL AS rank_missing,
  (coalesce(best_of, 3) = 5)::BIGINT AS best_of_5, (surface = 'Clay')::BIGINT AS surface_clay, (surface = 'Grass')::BIGINT AS surface_grass FROM mv""")
def rank_features(spark, folder):
    return history.build_features(matches(spark, folder)).select("match_id", "rank_diff", "log_rank_diff", "rank_missing", "best_of_5", "surface_clay", "surface_grass")


def rated_features(spark: SparkSession, folder: str) -> DataFrame:
    return history.build_features(ratings.add_ratings(matches(spark, folder)))


@query("elo_ratings")
def elo_ratings(spark, folder):
    return ratings.add_ratings(matches(spark, folder)).select("match_id", "overall_1", "overall_2", "surface_1", "surface_2", "prior_1", "prior_2", "expected_1", "overall_elo_diff", "surface_elo_diff")


@query("elo_report", "SELECT count(*)::BIGINT AS matches, (count(*) FILTER (WHERE NOT is_retirement))::BIGINT AS updates, (SELECT count(DISTINCT p)::BIGINT FROM (SELECT player_1 AS p FROM mv UNION ALL SELECT player_2 FROM mv)) AS players FROM mv")
def elo_report(spark, folder):
    return ratings.rating_report(ratings.add_ratings(matches(spark, folder))).select("matches", "updates", "players")


# ---- external statistics --------------------------------------------------------------------------

EXTERNAL = """(SELECT k AS external_row, day, match_date, surface, (k * 3) % 120 AS winner_id, (k * 7 + 1) % 120 AS loser_id, k % 23 = 0 AS is_retirement, k % 37 = 0 AS is_walkover,
  CASE WHEN k % 19 = 0 THEN NULL ELSE cast(40 + k % 140 AS double) END AS minutes,
  60 + k % 50 AS winner_svpt, CASE WHEN k % 31 = 0 THEN 500 ELSE 30 + k % 25 END AS winner_first_in, 20 + k % 10 AS winner_first_won, 3 + k % 4 AS winner_second_won, k % 12 AS winner_ace, k % 5 AS winner_df, k % 4 AS winner_bp_saved, 4 + k % 5 AS winner_bp_faced,
  55 + k % 45 AS loser_svpt, 28 + k % 22 AS loser_first_in, 15 + k % 12 AS loser_first_won, 2 + k % 3 AS loser_second_won, k % 7 AS loser_ace, k % 6 AS loser_df, k % 3 AS loser_bp_saved, 3 + k % 7 AS loser_bp_faced
  FROM mv WHERE (k * 3) % 120 <> (k * 7 + 1) % 120)"""
EXT_SIDES = f"""x AS (SELECT *, coalesce(winner_svpt > 0 AND winner_first_in BETWEEN 0 AND winner_svpt AND winner_first_won BETWEEN 0 AND winner_first_in AND winner_second_won BETWEEN 0 AND winner_svpt - winner_first_in
    AND winner_bp_saved BETWEEN 0 AND winner_bp_faced AND loser_svpt > 0 AND loser_first_in BETWEEN 0 AND loser_svpt AND loser_first_won BETWEEN 0 AND loser_first_in
    AND loser_second_won BETWEEN 0 AND loser_svpt - loser_first_in AND loser_bp_saved BETWEEN 0 AND loser_bp_faced, false) AND NOT is_walkover AND NOT is_retirement AS valid FROM {EXTERNAL}),
  s AS (SELECT external_row, 1 AS side, winner_id AS player, day, surface, minutes, valid, winner_first_won + winner_second_won AS sv, winner_svpt AS st, loser_bp_faced - loser_bp_saved AS bv, loser_bp_faced AS bt FROM x
    UNION ALL SELECT external_row, 2, loser_id, day, surface, minutes, valid, loser_first_won + loser_second_won, loser_svpt, winner_bp_faced - winner_bp_saved, winner_bp_faced FROM x)"""


def external_matches(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql("SELECT * FROM " + EXTERNAL.replace("FROM mv", "FROM {mv}"), mv=matches(spark, folder))


def _load_sql(k: int) -> str:
    w = f"OVER (PARTITION BY player ORDER BY day RANGE BETWEEN {k} PRECEDING AND 1 PRECEDING)"
    return f"coalesce(sum(CASE WHEN valid THEN minutes END) {w}, 0)::DOUBLE AS minutes_last_{k}d, count(CASE WHEN valid THEN minutes END) {w} AS known_last_{k}d, count(CASE WHEN valid AND minutes IS NULL THEN 1 END) {w} AS missing_last_{k}d"


@query("workload_3_7_14", f"WITH {EXT_SIDES} SELECT external_row::BIGINT AS external_row, side::BIGINT AS side, player::BIGINT AS player, {', '.join(_load_sql(k) for k in (3, 7, 14))} FROM s")
def workload(spark, folder):
    return stats.workload(stats.player_stats(external_matches(spark, folder)))


@query("tour_priors", f"""WITH {EXT_SIDES}, d AS (SELECT surface, day, sum(sv) AS sv, sum(st) AS st FROM s WHERE valid GROUP BY surface, day)
  SELECT g.surface, g.day::BIGINT AS day, (SELECT sum(sv)::DOUBLE FROM d WHERE d.surface = g.surface AND d.day < g.day) AS prior_s, (SELECT sum(st)::DOUBLE FROM d WHERE d.surface = g.surface AND d.day < g.day) AS prior_t
  FROM (SELECT DISTINCT x.day, v.surface FROM x, (SELECT DISTINCT surface FROM s WHERE valid) v) g""")
def tour_priors(spark, folder):
    metrics_ = stats.metric_rows(stats.player_stats(external_matches(spark, folder)))
    return stats.tour_priors(metrics_).filter("metric = 'serve_points_won_pct' and surface <> '*'").select("surface", "day", "prior_s", "prior_t")


def _decay_sql(v: str, t: str, metric: str, weight: int) -> str:
    d = "pow(0.5, 1 / 20.0)"
    return f"""SELECT external_row::BIGINT AS external_row, side::BIGINT AS side, '{metric}' AS metric, n::BIGINT AS matches_before, {r(f'tb', 'decayed_t')},
    {r(f'(sb + {weight} * ps / pt) / (tb + {weight})', 'rate')} FROM (SELECT q.*, coalesce(a * pow({d}, n), 0) AS sb, coalesce(c * pow({d}, n), 0) AS tb,
      (SELECT sum({v})::DOUBLE FROM s z WHERE z.valid AND z.day < q.day) AS ps, (SELECT sum({t})::DOUBLE FROM s z WHERE z.valid AND z.day < q.day) AS pt
      FROM (SELECT *, count(*) FILTER (WHERE valid) OVER b AS n, sum(CASE WHEN valid THEN {v} * pow({d}, -seq) END) OVER b AS a, sum(CASE WHEN valid THEN {t} * pow({d}, -seq) END) OVER b AS c
        FROM (SELECT *, row_number() OVER (PARTITION BY player, valid ORDER BY day, external_row, side) AS seq FROM s)
        WINDOW b AS (PARTITION BY player ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) q)"""


@query("decayed_rates", f"WITH {EXT_SIDES} {_decay_sql('sv', 'st', 'serve_points_won_pct', 200)} UNION ALL {_decay_sql('bv', 'bt', 'break_points_converted_pct', 20)}")
def decayed_rates(spark, folder):
    rates = stats.decayed_rates(stats.player_stats(external_matches(spark, folder)))
    return rates.filter("metric in ('serve_points_won_pct', 'break_points_converted_pct')")


#: Successes and trials of each metric from own (o_) and opposing (x_) counts, and the prior's weight.
EVERY_METRIC = {
    "serve_points_won_pct": ("o_first_won + o_second_won", "o_svpt", 200),
    "return_points_won_pct": ("x_svpt - (x_first_won + x_second_won)", "x_svpt", 200),
    "first_serve_in_pct": ("o_first_in", "o_svpt", 200),
    "first_serve_points_won_pct": ("o_first_won", "o_first_in", 200),
    "second_serve_points_won_pct": ("o_second_won", "o_svpt - o_first_in", 200),
    "ace_rate": ("o_ace", "o_svpt", 200),
    "double_fault_rate": ("o_df", "o_svpt", 200),
    "break_points_saved_pct": ("o_bp_saved", "o_bp_faced", 20),
    "break_points_converted_pct": ("x_bp_faced - x_bp_saved", "x_bp_faced", 20),
}


def _every_side(side: int, own: str, other: str) -> str:
    counts = ", ".join(f"{v} AS v{k}, {t} AS t{k}" for k, (v, t, _) in enumerate(EVERY_METRIC.values()))
    return f"SELECT external_row, {side} AS side, {own}_id AS player, day, surface, valid, {counts} FROM x".replace("o_", f"{own}_").replace("x_", f"{other}_")


EVERY_SIDES = f"{EXT_SIDES[: EXT_SIDES.index(',\n  s AS (')]}, s AS ({_every_side(1, 'winner', 'loser')} UNION ALL {_every_side(2, 'loser', 'winner')})"


def _prior_sql(k: int, metric: str) -> str:
    prior = lambda x: f"(SELECT sum(z.{x}{k})::DOUBLE FROM d z WHERE z.surface = g.surface AND z.day < g.day)"
    return f"SELECT '{metric}' AS metric, g.surface, g.day::BIGINT AS day, {prior('v')} AS prior_s, {prior('t')} AS prior_t FROM g"


EVERY_DAY = ", ".join(f"sum({x}{k}) AS {x}{k}" for k in range(len(EVERY_METRIC)) for x in "vt")


@query("tour_priors_every_metric", f"""WITH {EVERY_SIDES}, d AS (SELECT surface, day, {EVERY_DAY} FROM s WHERE valid GROUP BY ALL UNION ALL SELECT '*', day, {EVERY_DAY} FROM s WHERE valid GROUP BY ALL),
  g AS (SELECT DISTINCT x.day, d.surface FROM x, (SELECT DISTINCT surface FROM d) d) {' UNION ALL '.join(_prior_sql(k, m) for k, m in enumerate(EVERY_METRIC))}""")
def tour_priors_every_metric(spark, folder):
    return stats.tour_priors(stats.metric_rows(stats.player_stats(external_matches(spark, folder))))


@query("decayed_rates_every_metric", f"WITH {EVERY_SIDES} {' UNION ALL '.join(_decay_sql(f'v{k}', f't{k}', m, w) for k, (m, (_, _, w)) in enumerate(EVERY_METRIC.items()))}")
def decayed_rates_every_metric(spark, folder):
    return stats.decayed_rates(stats.player_stats(external_matches(spark, folder)))


# ---- record linkage -------------------------------------------------------------------------------

PROJECT = """(SELECT match_id, k, match_date, tournament AS tournament_normalized, round, concat(CASE WHEN player_1_won THEN player_1 ELSE player_2 END, ' a') AS winner_normalized,
  concat(CASE WHEN player_1_won THEN player_2 ELSE player_1 END, ' a') AS loser_normalized FROM mv)"""
LISTED = """(SELECT k AS external_row, match_date, CASE WHEN k % 4 = 0 THEN 'elsewhere' ELSE tournament END AS tournament_normalized, round,
  concat('alan ', CASE WHEN player_1_won THEN player_1 ELSE player_2 END) AS winner_normalized, concat('alan ', CASE WHEN player_1_won THEN player_2 ELSE player_1 END) AS loser_normalized,
  k % 1000 AS winner_id, (k + 1) % 1000 AS loser_id FROM mv WHERE k % 10 <> 0
  UNION ALL SELECT k + 1000000000, match_date, 'copy', round, concat('alan ', CASE WHEN player_1_won THEN player_1 ELSE player_2 END), concat('alan ', CASE WHEN player_1_won THEN player_2 ELSE player_1 END), 1, 2 FROM mv WHERE k % 12 = 0)"""
LINK_SQL = f"""WITH p AS (SELECT *, split_part(winner_normalized, ' ', 1) AS w, split_part(loser_normalized, ' ', 1) AS l FROM {PROJECT}),
  e AS (SELECT *, split_part(winner_normalized, ' ', 2) AS w, split_part(loser_normalized, ' ', 2) AS l FROM {LISTED}),
  j AS (SELECT p.match_id, e.external_row, p.tournament_normalized = e.tournament_normalized AND p.round = e.round AS same FROM p JOIN e USING (match_date, w, l)),
  t AS (SELECT match_id, count(*) FILTER (WHERE same) AS n1, max(external_row) FILTER (WHERE same) AS r1, count(*) AS n2, max(external_row) AS r2 FROM j GROUP BY match_id),
  links AS (SELECT p.match_id, p.match_date, CASE WHEN n1 = 1 THEN 'strict' WHEN n2 = 1 THEN 'unique_date_player' END AS tier, (CASE WHEN n1 = 1 THEN r1 WHEN n2 = 1 THEN r2 END)::BIGINT AS external_row,
    CASE WHEN coalesce(n1, 0) <> 1 AND coalesce(n2, 0) <> 1 THEN CASE WHEN coalesce(n2, 0) > 1 THEN 'ambiguous' ELSE 'unmatched' END END AS failure_reason FROM p LEFT JOIN t USING (match_id))"""


def _linked(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    m = matches(spark, folder)
    keyed = lambda f: f.withColumn("winner_keys", T.name_keys(F.col("winner_normalized"))).withColumn("loser_keys", T.name_keys(F.col("loser_normalized")))
    project = keyed(spark.sql("SELECT * FROM " + PROJECT.replace("FROM mv", "FROM {mv}"), mv=m))
    external = keyed(spark.sql("SELECT * FROM " + LISTED.replace("FROM mv", "FROM {mv}"), mv=m))
    return linkage.link(project, external), project, external


@query("link_cascade", f"{LINK_SQL} SELECT match_id, tier, external_row, failure_reason FROM links")
def link_cascade(spark, folder):
    return _linked(spark, folder)[0]


@query("manual_suggestions", f"{LINK_SQL}, f AS (SELECT external_row, match_date, row_number() OVER (PARTITION BY match_date ORDER BY external_row) AS rank FROM e QUALIFY rank <= 5) SELECT links.match_id, f.rank::BIGINT AS rank, f.external_row::BIGINT AS external_row FROM links JOIN f USING (match_date) WHERE failure_reason IS NOT NULL")
def manual_suggestions(spark, folder):
    links, project, external = _linked(spark, folder)
    return linkage.manual_suggestions(links, project, external)


@query("link_rates", f"{LINK_SQL} SELECT round, count(*)::BIGINT AS n, {r('avg((links.external_row IS NOT NULL)::INT)', 'rate')} FROM links JOIN p USING (match_id) GROUP BY round")
def link_rates(spark, folder):
    links, project, _ = _linked(spark, folder)
    return linkage.link_rates(links, project, "round")


# ---- splits ---------------------------------------------------------------------------------------


@query("eligibility_flags", "SELECT match_id, match_date IS NULL AS invalid_date, player_1_won IS NULL AS invalid_target, false AS invalid_surface, count(*) OVER (PARTITION BY match_id) > 1 AS duplicate_id, is_retirement FROM mv")
def eligibility_flags(spark, folder):
    return models.eligibility(matches(spark, folder)).select("match_id", "invalid_date", "invalid_target", "invalid_surface", "duplicate_id", "is_retirement")


PREPARED = f"(SELECT *, {MARKET} AS q, {OVER} AS o, player_1_won::INT AS y, p_model - {MARKET} AS c FROM mv WHERE {VALID} AND NOT is_retirement)"


def prepared(spark: SparkSession, folder: str) -> DataFrame:
    return models.prepare(matches(spark, folder)).withColumn("correction", F.col("p_model") - F.col("market_probability"))


@query("date_partitions", f"SELECT part, count(*)::BIGINT AS n, sum(y)::BIGINT AS wins, min(match_date) AS first_date, max(match_date) AS last_date FROM {PREPARED} GROUP BY part")
def date_partitions(spark, folder):
    return prepared(spark, folder).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("long").alias("wins"), F.min("match_date").alias("first_date"), F.max("match_date").alias("last_date"))


@query("walk_forward_rows", f"SELECT match_id, fold::BIGINT AS fold, CASE WHEN year = e THEN 'evaluate' ELSE 'train' END AS role FROM {PREPARED}, {FOLDS_SQL} WHERE year BETWEEN a AND b OR year = e")
def walk_forward_rows(spark, folder):
    return models.fold_rows(prepared(spark, folder), FOLDS).select("match_id", "fold", "role")


# ---- metrics --------------------------------------------------------------------------------------

METRIC_SQL = f"count(*)::BIGINT AS sample_count, {r('avg(y)', 'base_rate')}, {r(f'avg({LL("y", "p")})', 'log_loss')}, {r('avg((p - y) * (p - y))', 'brier_score')}, {r('avg(((p >= 0.5)::INT = y)::INT)', 'accuracy')}, {r('avg(p)', 'mean_probability')}, {r('min(p)', 'min_probability')}, {r('max(p)', 'max_probability')}"
ELIGIBLE = "(SELECT *, player_1_won::INT AS y, p_model AS p FROM mv WHERE NOT is_retirement)"


def _predictions(spark: SparkSession, folder: str) -> DataFrame:
    return matches(spark, folder).filter("not is_retirement").withColumn("y", F.col("player_1_won").cast("int"))


@query("prob_metrics", f"""SELECT part, {METRIC_SQL}, (SELECT {r('avg(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END * a.n * b.n) / avg(a.n * b.n)', 'auc').rsplit(' AS ', 1)[0]}
  FROM (SELECT p, count(*) AS n FROM {ELIGIBLE} i WHERE y = 1 AND i.part = t.part GROUP BY p) a, (SELECT p, count(*) AS n FROM {ELIGIBLE} i WHERE y = 0 AND i.part = t.part GROUP BY p) b) AS roc_auc FROM {ELIGIBLE} t GROUP BY part""")
def prob_metrics(spark, folder):
    return metrics.probability_metrics(_predictions(spark, folder), ["part"], "y", "p_model")


@query("surface_metrics", f"SELECT part, surface, {METRIC_SQL} FROM {ELIGIBLE} GROUP BY part, surface")
def surface_metrics(spark, folder):
    return metrics.probability_metrics(_predictions(spark, folder), ["part", "surface"], "y", "p_model").drop("roc_auc")


BIN = "CASE " + " ".join(f"WHEN p >= {k / 10.0}::DOUBLE THEN {k}" for k in range(9, 0, -1)) + " ELSE 0 END"
CALIBRATION = f"(SELECT part, {BIN} AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS orate FROM {ELIGIBLE} GROUP BY ALL)"


@query("calibration_bins", f"SELECT part, bin::BIGINT AS bin, n::BIGINT AS n, {r('mp', 'mean_predicted')}, {r('orate', 'observed_rate')}, {r('orate - mp', 'calibration_error')} FROM {CALIBRATION}")
def calibration_bins(spark, folder):
    return metrics.calibration_table(_predictions(spark, folder), ["part"], "y", "p_model").drop("label")


@query("ece_mce", f"SELECT part, {r('sum(abs(orate - mp) * n) / sum(n)', 'expected_calibration_error')}, {r('max(abs(orate - mp))', 'maximum_calibration_error')} FROM {CALIBRATION} GROUP BY part")
def ece_mce(spark, folder):
    table = metrics.calibration_table(_predictions(spark, folder), ["part"], "y", "p_model")
    return metrics.calibration_summary(table, ["part"])


COMPARE = lambda m, q: f"{r(f'avg({LL("y", m)})', 'model_log_loss')}, {r(f'avg(({m} - y) * ({m} - y))', 'model_brier')}, {r(f'avg({LL("y", q)})', 'market_log_loss')}, {r(f'avg(({q} - y) * ({q} - y))', 'market_brier')}, {r(f'avg({LL("y", q)}) - avg({LL("y", m)})', 'log_loss_improvement')}, {r(f'avg(({q} - y) * ({q} - y)) - avg(({m} - y) * ({m} - y))', 'brier_improvement')}"


@query("bookmaker_baseline", f"SELECT part, count(*)::BIGINT AS sample_count, {r('avg(o)', 'mean_overround')}, {r('min(o)', 'min_overround')}, {r('max(o)', 'max_overround')}, {COMPARE('p_model', 'q')} FROM {PREPARED} GROUP BY part")
def bookmaker_baseline(spark, folder):
    return metrics.bookmaker_baseline(_predictions(spark, folder), ["part"], "y", "p_model", ("odds_1", "odds_2"))


# ---- decisions and ledger -------------------------------------------------------------------------


def _side_sql(s: str, p: str, o: str, other: str) -> str:
    market = f"((1 / {o}) / (1 / {o} + 1 / {other}))"
    return f"""CASE WHEN ok THEN {p} - {market} END AS edge_{s}, CASE WHEN ok THEN {p} * {o} - 1 END AS ev_{s}, concat_ws('|',
      CASE WHEN NOT ok THEN 'unsupported_match' END, CASE WHEN is_retirement THEN 'retirement' END, CASE WHEN odds_1 IS NULL OR odds_2 IS NULL THEN 'missing_odds' WHEN NOT ok THEN 'invalid_odds' END,
      CASE WHEN ok AND {p} < 0.55 THEN 'probability_below_threshold' END, CASE WHEN ok AND {p} - {market} < 0.04 THEN 'edge_below_threshold' END,
      CASE WHEN ok AND {p} * {o} - 1 < 0.03 THEN 'expected_value_below_threshold' END, CASE WHEN ok AND {o} < 1.5 THEN 'odds_below_minimum' END, CASE WHEN ok AND {o} > 3.5 THEN 'odds_above_maximum' END) AS why_{s}"""


ASSESS = f"""a AS (SELECT *, {_side_sql('1', 'p_model', 'odds_1', 'odds_2')}, {_side_sql('2', '(1 - p_model)', 'odds_2', 'odds_1')} FROM (SELECT *, {VALID} AS ok FROM mv)),
  v AS (SELECT *, CASE WHEN why_1 = '' AND why_2 = '' THEN CASE WHEN (-ev_1, -edge_1) <= (-ev_2, -edge_2) THEN 1 ELSE 2 END WHEN why_1 = '' THEN 1 WHEN why_2 = '' THEN 2 END AS pick FROM a)"""


def assessed(spark: SparkSession, folder: str) -> DataFrame:
    m = matches(spark, folder)
    frame = m.select(
        "match_id", "match_date", "surface", "player_1", "player_2", F.col("player_1_won").alias("actual_player_1_won"), F.col("odds_1").alias("player_1_odds"), F.col("odds_2").alias("player_2_odds"),
        F.col("p_model").alias("predicted_player_1_probability"), (1 - F.col("p_model")).alias("predicted_player_2_probability"), "is_retirement", F.col("part").alias("partition"),
    )
    return decisions.assess(frame)


@query("value_assess", f"""WITH {ASSESS} SELECT match_id, why_1 AS player_1_reason_codes, why_2 AS player_2_reason_codes, {r('edge_1', 'player_1_edge')}, {r('ev_2', 'player_2_expected_value')},
  CASE pick WHEN 1 THEN 'player_1' WHEN 2 THEN 'player_2' ELSE 'none' END AS recommended_side, CASE pick WHEN 1 THEN player_1 WHEN 2 THEN player_2 END AS recommended_player, {r('CASE pick WHEN 1 THEN edge_1 WHEN 2 THEN edge_2 END', 'recommended_edge')} FROM v""")
def value_assess(spark, folder):
    return assessed(spark, folder).select("match_id", "player_1_reason_codes", "player_2_reason_codes", "player_1_edge", "player_2_expected_value", "recommended_side", "recommended_player", "recommended_edge")


@query("value_reason_counts", f"""WITH {ASSESS}, u AS (SELECT why_1 AS w FROM v UNION ALL SELECT why_2 FROM v UNION ALL SELECT CASE WHEN pick IS NULL THEN array_to_string(list_distinct(string_split(concat_ws('|', nullif(why_1, ''), nullif(why_2, '')), '|')), '|')
  WHEN why_1 = '' AND why_2 = '' THEN 'multiple_eligible_selections' ELSE '' END FROM v) SELECT reason, count(*)::BIGINT AS n FROM (SELECT unnest(string_split(w, '|')) AS reason FROM u) WHERE reason <> '' GROUP BY reason""")
def value_reason_counts(spark, folder):
    return decisions.reason_counts(assessed(spark, folder))


@query("value_summary", f"""WITH {ASSESS} SELECT count(*)::BIGINT AS rows_assessed, (count(*) FILTER (WHERE ok))::BIGINT AS rows_with_valid_odds, count(pick)::BIGINT AS rows_with_recommendations,
  (count(*) FILTER (WHERE pick = 1))::BIGINT AS recommendations_player_1, (count(*) FILTER (WHERE pick = 2))::BIGINT AS recommendations_player_2, {r('avg((pick IS NOT NULL)::INT)', 'recommendation_rate')},
  {r('avg(CASE pick WHEN 1 THEN p_model WHEN 2 THEN 1 - p_model END)', 'average_probability')}, {r('avg(CASE pick WHEN 1 THEN odds_1 WHEN 2 THEN odds_2 END)', 'average_odds')}, {r('avg(CASE pick WHEN 1 THEN edge_1 WHEN 2 THEN edge_2 END)', 'average_edge')} FROM v""")
def value_summary(spark, folder):
    return decisions.value_summary(assessed(spark, folder)).drop("average_market_probability", "average_expected_value")


LEDGER = f"""{ASSESS}, b AS (SELECT match_id, match_date, surface, CASE pick WHEN 1 THEN odds_1 ELSE odds_2 END AS odds, CASE pick WHEN 1 THEN edge_1 ELSE edge_2 END AS edge,
    CASE WHEN is_retirement THEN 'void' WHEN (pick = 1) = player_1_won THEN 'won' ELSE 'lost' END AS result FROM v WHERE pick IS NOT NULL AND part = 'test'),
  g AS (SELECT *, CASE result WHEN 'won' THEN odds - 1 WHEN 'lost' THEN -1 ELSE 0 END AS gain FROM b),
  k AS (SELECT *, row_number() OVER (ORDER BY match_date, match_id) AS bet_sequence, 10000 * product(1 + 0.005 * gain) OVER (ORDER BY match_date, match_id ROWS UNBOUNDED PRECEDING) AS after FROM g),
  z AS (SELECT *, after / (1 + 0.005 * gain) AS before, round(after, 8) AS held, greatest(10000, max(round(after, 8)) OVER (ORDER BY bet_sequence ROWS UNBOUNDED PRECEDING)) AS peak FROM k)"""


def _book(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger; reports read it several times, so it is kept."""
    return bankroll.ledger(assessed(spark, folder)).persist()


@query("bankroll_ledger", f"WITH {LEDGER} SELECT bet_sequence::BIGINT AS bet_sequence, match_id, result, {r('before', 'bankroll_before')}, {r('0.005 * before', 'stake')}, {r('0.005 * before * gain', 'profit_loss')}, {r('after', 'bankroll_after')} FROM z")
def bankroll_ledger(spark, folder):
    return _book(spark, folder).select("bet_sequence", "match_id", "result", "bankroll_before", "stake", "profit_loss", "bankroll_after")


@query("drawdown", f"WITH {LEDGER} SELECT bet_sequence::BIGINT AS bet_sequence, {r('peak', 'running_peak')}, {r('peak - held', 'drawdown')}, {r('(peak - held) / peak', 'drawdown_percentage')} FROM z")
def drawdown(spark, folder):
    return bankroll.drawdown(_book(spark, folder), 10_000.0).select("bet_sequence", "running_peak", "drawdown", "drawdown_percentage")


@query("longest_streak", f"WITH {LEDGER}, i AS (SELECT result, row_number() OVER (ORDER BY bet_sequence) - row_number() OVER (PARTITION BY result ORDER BY bet_sequence) AS island FROM z WHERE result <> 'void') SELECT result, max(n)::BIGINT AS longest FROM (SELECT result, island, count(*) AS n FROM i GROUP BY ALL) GROUP BY result")
def longest_streak(spark, folder):
    return bankroll.longest_streaks(_book(spark, folder))


@query("perf_by_surface", f"""WITH {LEDGER} SELECT surface, count(*)::BIGINT AS bets, (count(*) FILTER (WHERE result = 'won'))::BIGINT AS wins, (count(*) FILTER (WHERE result = 'lost'))::BIGINT AS losses, (count(*) FILTER (WHERE result = 'void'))::BIGINT AS voids,
  {r('sum(0.005 * before)', 'total_staked')}, {r('sum(0.005 * before * gain)', 'profit_loss')}, {r('sum(before * gain) / sum(before)', 'roi')}, {r('avg(odds)', 'average_odds')}, {r('avg(edge)', 'average_edge')} FROM z GROUP BY surface""")
def perf_by_surface(spark, folder):
    return bankroll.performance(_book(spark, folder), ["surface"])


@query("ledger_summary", f"""WITH {LEDGER} SELECT count(*)::BIGINT AS bets_placed, (count(*) FILTER (WHERE result = 'won'))::BIGINT AS wins, (count(*) FILTER (WHERE result = 'lost'))::BIGINT AS losses, (count(*) FILTER (WHERE result = 'void'))::BIGINT AS voids,
  {r('max(peak - held)', 'maximum_drawdown')}, {r('max((peak - held) / peak)', 'maximum_drawdown_percentage')} FROM z""")
def ledger_summary(spark, folder):
    return bankroll.ledger_summary(_book(spark, folder), BankrollConfig()).select("bets_placed", "wins", "losses", "voids", "maximum_drawdown", "maximum_drawdown_percentage")


# ---- corrections and markets ----------------------------------------------------------------------

SEGMENTS = f"(SELECT p.*, unnest([year::BIGINT::VARCHAR, 'combined']) AS segment FROM {PREPARED} p)"


def _segments(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.year_and_combined(prepared(spark, folder).withColumn("year", F.col("year").cast("long")), [])


@query("correction_summary", f"""SELECT segment, count(*)::BIGINT AS rows, {r('avg(c)', 'mean_correction')}, {r('avg(abs(c))', 'mean_absolute_correction')}, {r('quantile_cont(abs(c), 0.5)', 'median_absolute_correction')}, {r('stddev_pop(c)', 'standard_deviation')},
  {r('min(c)', 'minimum')}, {r('max(c)', 'maximum')}, {_quantiles('c', *[(q, f'p{round(q * 100):02d}') for q in markets.QUANTILES])}, {r('avg((abs(c) < 0.01)::INT)', 'share_below_001')}, {r('avg((abs(c) < 0.02)::INT)', 'share_below_002')},
  {r('avg((abs(c) < 0.05)::INT)', 'share_below_005')}, {r('avg((abs(c) > 0.10)::INT)', 'share_above_010')} FROM {SEGMENTS} GROUP BY segment""")
def correction_summary(spark, folder):
    return markets.correction_summary(_segments(spark, folder), ["segment"])


def _bucket_sql(value: str, table: tuple) -> str:
    return "CASE " + " ".join("WHEN " + (" AND ".join([f"{value} >= {lo}::DOUBLE"] * (lo is not None) + [f"{value} < {hi}::DOUBLE"] * (hi is not None))) + f" THEN '{label}'" for lo, hi, label in table) + " END"


COMPARED = f"count(*)::BIGINT AS rows, {COMPARE('p_model', 'q')}, {r('avg(((p_model >= 0.5)::INT = y)::INT)', 'model_accuracy')}, {r('avg(((q >= 0.5)::INT = y)::INT)', 'market_accuracy')}"


@query("correction_buckets", f"SELECT segment, {_bucket_sql('abs(c)', N.CORRECTION_BUCKETS)} AS bucket, {COMPARED} FROM {SEGMENTS} GROUP BY ALL")
def correction_buckets(spark, folder):
    rows = _segments(spark, folder).withColumn("bucket", N.bucket(F.abs("correction"), N.CORRECTION_BUCKETS))
    return markets.compared(rows, ["segment", "bucket"], "y", "p_model", "market_probability")


@query("signed_buckets", f"SELECT {_bucket_sql('c', N.SIGNED_BUCKETS)} AS bucket, {COMPARED} FROM {PREPARED} GROUP BY ALL")
def signed_buckets(spark, folder):
    rows = prepared(spark, folder).withColumn("bucket", N.bucket(F.col("correction"), N.SIGNED_BUCKETS))
    return markets.compared(rows, ["bucket"], "y", "p_model", "market_probability")


@query("direction_slope", f"SELECT surface, {r('coalesce(regr_slope(y - q, c), 0)', 'slope')}, count(*)::BIGINT AS rows FROM {PREPARED} GROUP BY surface")
def direction_slope(spark, folder):
    rows = prepared(spark, folder).withColumn("residual", F.col("y") - F.col("market_probability"))
    return markets.direction_slope(rows, ["surface"], "residual", "correction")


FILTERS_SQL = "(SELECT *, unnest(['all_valid_paired_odds', 'normal_overround', 'strict_overround', 'same_source_paired_odds', 'pinnacle_only', 'bet365_only']) AS filter, unnest([true, o BETWEEN 1.00 AND 1.10, o BETWEEN 1.02 AND 1.08, odds_source IS NOT NULL, odds_source IN ('PS', 'Pinnacle'), odds_source = 'B365']) AS passes FROM {})"


@query("odds_sensitivity", f"""SELECT surface, filter, (count(*) FILTER (WHERE passes))::BIGINT AS included_rows, (count(*) FILTER (WHERE NOT passes))::BIGINT AS excluded_rows, {r(f'avg({LL("y", "p_model")}) FILTER (WHERE passes)', 'model_log_loss')},
  {r(f'avg({LL("y", "q")}) FILTER (WHERE passes)', 'raw_market_log_loss')}, {r(f'avg({LL("y", "q")}) FILTER (WHERE passes) - avg({LL("y", "p_model")}) FILTER (WHERE passes)', 'log_loss_improvement_vs_market')} FROM {FILTERS_SQL.format(PREPARED)} GROUP BY surface, filter""")
def odds_sensitivity(spark, folder):
    return markets.sensitivity(prepared(spark, folder), ["surface"], "y", "p_model", "market_probability")


SOURCES_SQL = """(SELECT *, coalesce(odds_1 > 1 AND odds_2 > 1, false) AND coalesce(ps_1 > 1 AND ps_2 > 1, false) AND avg_1 > 1 AND avg_2 > 1 AS common, unnest(['Bet365', 'Pinnacle/PS', 'Average']) AS source,
  unnest([coalesce(odds_1 > 1 AND odds_2 > 1, false), coalesce(ps_1 > 1 AND ps_2 > 1, false), avg_1 > 1 AND avg_2 > 1]) AS available, unnest([1 / odds_1 + 1 / odds_2, 1 / ps_1 + 1 / ps_2, 1 / avg_1 + 1 / avg_2]) AS o FROM mv)"""


@query("anchor_coverage", f"SELECT source, scope, year::BIGINT AS year, (count(*) FILTER (WHERE inside))::BIGINT AS included_rows, (count(*) FILTER (WHERE NOT inside))::BIGINT AS excluded_rows FROM (SELECT source, year, unnest(['source_specific', 'common_all_sources']) AS scope, unnest([available, available AND common]) AS inside FROM {SOURCES_SQL}) GROUP BY ALL")
def anchor_coverage(spark, folder):
    return markets.anchor_coverage(matches(spark, folder).withColumn("year", F.col("year").cast("long")))


@query("source_diagnostics", f"""SELECT source, (count(*) FILTER (WHERE available))::BIGINT AS valid_paired_rows, (count(*) FILTER (WHERE NOT available))::BIGINT AS missing_paired_rows, {r('avg(v)', 'mean_overround')}, {r('min(v)', 'minimum_overround')}, {r('max(v)', 'maximum_overround')},
  {_quantiles('v', *[(q, f'p{round(q * 100):02d}_overround') for q in markets.QUANTILES])}, (count(*) FILTER (WHERE v < 1))::BIGINT AS rows_below_overround_1_00, (count(*) FILTER (WHERE v > 1.12))::BIGINT AS rows_above_overround_1_12
  FROM (SELECT *, CASE WHEN available THEN o END AS v FROM {SOURCES_SQL}) GROUP BY source""")
def source_diagnostics(spark, folder):
    return markets.source_diagnostics(matches(spark, folder))


DISAGREE = """d AS (SELECT match_id, unnest(['Bet365 versus Pinnacle/PS', 'Bet365 versus Average', 'Pinnacle/PS versus Average']) AS pair, unnest([b, b, p]) AS x, unnest([p, a, a]) AS y FROM
  (SELECT match_id, (1 / odds_1) / (1 / odds_1 + 1 / odds_2) AS b, (1 / ps_1) / (1 / ps_1 + 1 / ps_2) AS p, (1 / avg_1) / (1 / avg_1 + 1 / avg_2) AS a FROM mv WHERE coalesce(odds_1 > 1 AND odds_2 > 1, false) AND ps_1 > 1 AND ps_2 > 1 AND avg_1 > 1 AND avg_2 > 1)),
  k AS (SELECT *, rank() OVER (PARTITION BY pair ORDER BY x) + (count(*) OVER (PARTITION BY pair, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY pair ORDER BY y) + (count(*) OVER (PARTITION BY pair, y) - 1) / 2.0 AS ry FROM d)"""


@query("probability_disagreement", f"""WITH {DISAGREE} SELECT pair, count(*)::BIGINT AS rows, {r('avg(x - y)', 'mean_signed_difference')}, {r('avg(abs(x - y))', 'mean_absolute_difference')}, {r('quantile_cont(abs(x - y), 0.5)', 'median_absolute_difference')},
  {r('quantile_cont(abs(x - y), 0.95)', 'p95_absolute_difference')}, {r('max(abs(x - y))', 'maximum_absolute_difference')}, {r('corr(x, y)', 'pearson_correlation')}, {r('corr(rx, ry)', 'spearman_correlation')} FROM k GROUP BY pair""")
def probability_disagreement(spark, folder):
    return markets.probability_disagreement(matches(spark, folder))


INTEGRITY = """(SELECT match_id, player_1_won, odds_1 AS a, CASE WHEN k % 47 = 0 THEN odds_2 + 0.5 ELSE odds_2 END AS b, CASE WHEN player_1_won THEN odds_1 ELSE odds_2 END AS w, CASE WHEN player_1_won THEN odds_2 ELSE odds_1 END AS l, odds_1 IS NOT NULL OR k % 82 = 0 AS available FROM mv)"""


@query("side_integrity", f"""SELECT 'b365' AS source, (count(*) FILTER (WHERE available))::BIGINT AS rows_with_valid_source_pair, (count(*) FILTER (WHERE NOT available))::BIGINT AS rows_with_missing_source_pair,
  (count(*) FILTER (WHERE available AND coalesce(df > 1e-12, false)))::BIGINT AS odds_side_mapping_failures, (count(*) FILTER (WHERE available <> (w IS NOT NULL AND l IS NOT NULL)))::BIGINT AS source_pair_consistency_failures,
  {r('max(CASE WHEN available THEN df END)', 'maximum_absolute_mapping_difference')} FROM (SELECT *, greatest(abs(a - CASE WHEN player_1_won THEN w ELSE l END), abs(b - CASE WHEN player_1_won THEN l ELSE w END)) AS df FROM {INTEGRITY})""")
def side_integrity(spark, folder):
    rows = spark.sql("SELECT * FROM " + INTEGRITY.replace("FROM mv", "FROM {mv}"), mv=matches(spark, folder))
    named = rows.select("match_id", "player_1_won", F.col("w").alias("source_winner_b365_odds"), F.col("l").alias("source_loser_b365_odds"), F.col("a").alias("player_1_b365_odds"), F.col("b").alias("player_2_b365_odds"), F.col("available").alias("b365_pair_available"))
    return markets.side_integrity(named, ("b365",))[1]


REVIEW = """q AS (SELECT match_id, odds_1, odds_2, (1 / odds_1) / (1 / odds_1 + 1 / odds_2) AS b, (1 / ps_1) / (1 / ps_1 + 1 / ps_2) AS p FROM mv), d AS (SELECT *, abs(b - p) AS x, coalesce(odds_1 > odds_2, false) AS flag FROM q)"""
TOP = lambda name, where, order: f"(SELECT match_id, '{name}' AS review_category, {r('b', 'b365_probability')}, {r('p', 'ps_probability')}, {r('x', 'disagreement')} FROM d {where} ORDER BY {order} LIMIT 20)"


@query("manual_review_topk", f"WITH {REVIEW} {TOP('largest_disagreement', '', 'x DESC NULLS LAST, match_id')} UNION ALL {TOP('market_reference_disagreement', 'WHERE flag', 'match_id')} UNION ALL {TOP('unflagged_control', 'WHERE NOT flag', 'match_id')}")
def manual_review_topk(spark, folder):
    return markets.review_rows(matches(spark, folder))


# ---- resampling and models ------------------------------------------------------------------------


def _improvement() -> Column:
    return N.row_log_loss(F.col("y"), F.col("market_probability")) - N.row_log_loss(F.col("y"), F.col("p_model"))


@query("block_sums", f"SELECT concat(year::INT, '-W', lpad(week(match_date)::VARCHAR, 2, '0')) AS block, {r(f'sum({LL("y", "q")} - ({LL("y", "p_model")}))', 'total')}, count(*)::BIGINT AS n FROM {PREPARED} GROUP BY 1")
def block_sums(spark, folder):
    return resample.block_sums(prepared(spark, folder), [], _improvement())


@query("bootstrap_ci")
def bootstrap_ci(spark, folder):
    rows = _segments(spark, folder).filter("year >= 1998")
    differences = {"log_loss": _improvement(), "brier": F.pow(F.col("market_probability") - F.col("y"), 2) - F.pow(F.col("p_model") - F.col("y"), 2)}
    drawn = [resample.bootstrap(rows.withColumn("metric", F.lit(m)).withColumn("difference", d), ["segment", "metric"], "difference", seed=resample.SEED + k) for k, (m, d) in enumerate(differences.items())]
    return reduce(DataFrame.unionByName, drawn)


@query("block_bootstrap_ci")
def block_bootstrap_ci(spark, folder):
    rows = _segments(spark, folder).filter("year >= 1998")
    return resample.block_bootstrap(resample.block_sums(rows, ["segment"], _improvement()), ["segment"])


def _model_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Prepared rows with all model features; read many times by the fits, so kept."""
    keep = ["match_id", "match_date", "year", "part", "y", "market_probability", "overround", "odds_source", models.MARKET, *models.NUMERIC, *models.BINARY]
    return models.prepare(rated_features(spark, folder)).select(*keep).persist()


def _form_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Prepared rows with what the market and form model reads, which needs no ratings; kept as above."""
    rows = models.prepare(history.build_features(matches(spark, folder)))
    return rows.select("year", "y", models.MARKET, *models.FORM).persist()


@query("logit_v1")
def logit_v1(spark, folder):
    rows = _model_rows(spark, folder).withColumn("g", F.lit(1).cast("long"))
    fitted = models.fit_groups(rows.filter("part = 'train'"), (*models.NUMERIC, *models.BINARY), models.BINARY)
    scored = models.predict_groups(rows, fitted, "p")
    return metrics.probability_metrics(scored, ["part"], "y", "p")


@query("walk_forward_architectures")
def walk_forward_architectures(spark, folder):
    rows = models.architectures(_model_rows(spark, folder), FOLDS)
    segments = metrics.year_and_combined(rows.withColumn("year", F.col("year").cast("long")), [])
    return markets.compared(segments, ["architecture", "segment"], "y", "p", "market_probability")


@query("ablation")
def ablation(spark, folder):
    return models.ablation(_model_rows(spark, folder), FOLDS)


@query("market_coefficients")
def market_coefficients(spark, folder):
    rows = models.fold_rows(_form_rows(spark, folder), FOLDS).withColumn("g", F.col("fold").cast("long"))
    table = models.coefficients(spark, models.fit_groups(rows.filter("role = 'train'"), (models.MARKET, *models.FORM)))
    return table.withColumn("category", F.when(F.col("feature") == models.MARKET, models.market_category(F.col("coefficient"))))


# ---- reports --------------------------------------------------------------------------------------


@query("training_summary", f"SELECT part, count(*)::BIGINT AS rows, sum(y)::BIGINT AS wins, {r('avg(y)', 'positive_rate')}, min(match_date) AS first_date, max(match_date) AS last_date, (count(*) FILTER (WHERE rank_1 IS NULL))::BIGINT AS null_rank_1 FROM {PREPARED} GROUP BY part")
def training_summary(spark, folder):
    return reports.training_summary(prepared(spark, folder), ("rank_1",))


@query("market_comparison", f"SELECT part, (count(*) FILTER (WHERE m IS NOT NULL))::BIGINT AS compared_rows, (count(*) FILTER (WHERE m IS NULL))::BIGINT AS skipped_rows, {r(f'avg({LL("y", "p")}) FILTER (WHERE m IS NOT NULL)', 'model_log_loss')}, {r(f'avg({LL("y", "m")}) FILTER (WHERE m IS NOT NULL)', 'other_log_loss')}, {r('avg((p - y) * (p - y)) FILTER (WHERE m IS NOT NULL)', 'model_brier')}, {r('avg((m - y) * (m - y))', 'other_brier')}, {r(f'avg({LL("y", "m")}) FILTER (WHERE m IS NOT NULL) - avg({LL("y", "p")}) FILTER (WHERE m IS NOT NULL)', 'log_loss_improvement')} FROM (SELECT *, CASE WHEN {VALID} THEN {MARKET} END AS m FROM {ELIGIBLE}) GROUP BY part")
def market_comparison(spark, folder):
    frame = _predictions(spark, folder)
    a, b = F.col("odds_1"), F.col("odds_2")
    return reports.compare_on_same_rows(frame.withColumn("m", F.when(N.odds_pair_valid(a, b), N.no_vig(a, b))), ["part"], "y", "p_model", "m")


@query("coverage_by_year", f"SELECT year::BIGINT AS year, surface, count(*)::BIGINT AS rows, {r('avg((odds_1 IS NOT NULL)::INT)', 'share_odds_1')}, {r('avg((rank_1 IS NOT NULL)::INT)', 'share_rank_1')} FROM mv GROUP BY year, surface")
def coverage_by_year(spark, folder):
    return reports.coverage_by(matches(spark, folder).withColumn("year", F.col("year").cast("long")), ["year", "surface"], ["odds_1", "rank_1"])


@query("best_source_by_year", f"""SELECT year, arg_min(source, (loss, source)) AS source, {r('min(loss)', 'raw_market_log_loss')} FROM (SELECT year::BIGINT AS year, source, avg({LL('player_1_won::INT', 'q')}) AS loss
  FROM (SELECT *, CASE source WHEN 'Bet365' THEN 1 / odds_1 / (1 / odds_1 + 1 / odds_2) WHEN 'Average' THEN 1 / avg_1 / (1 / avg_1 + 1 / avg_2) ELSE 1 / ps_1 / (1 / ps_1 + 1 / ps_2) END AS q FROM {SOURCES_SQL}) WHERE available GROUP BY ALL) GROUP BY year""")
def best_source_by_year(spark, folder):
    long = markets.by_source(matches(spark, folder).withColumn("y", F.col("player_1_won").cast("int")).withColumn("year", F.col("year").cast("long")))
    return reports.best_source(long.filter("available"), ["year"])


@query("record_rules", "SELECT unnest(['same player', 'rank isn''t positive', 'odds aren''t above 1']) AS rule, unnest([count(*) FILTER (WHERE player_1 = player_2), count(*) FILTER (WHERE rank_1 <= 0 OR rank_2 <= 0), count(*) FILTER (WHERE odds_1 <= 1 OR odds_2 <= 1)])::BIGINT AS rows FROM mv")
def record_rules(spark, folder):
    return records.violations(matches(spark, folder), records.canonical_rules()).filter(F.col("rule").isin("same player", "rank isn't positive", "odds aren't above 1"))


@query("ledger_rules", "SELECT unnest(['open bet with a result', 'stake isn''t positive', 'balance doesn''t add up']) AS rule, 0::BIGINT AS rows")
def ledger_rules(spark, folder):
    return records.violations(_book(spark, folder), records.bet_rules())
