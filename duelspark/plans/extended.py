"""More named queries: pre-match statistics, market anchors, cleaning reports, parsing and whole decision rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..operators import anchors, canonical, decisions, history, linkage, markets, metrics, models, records, stats
from . import queries as Q
from .queries import LL, query, r
from .views import matches

# ---- pre-match statistics -------------------------------------------------------------------------

METRICS = list(Q.EVERY_METRIC)
LINKED = "(SELECT match_id, k AS external_row, CASE WHEN player_1_won THEN 1 ELSE 2 END AS s FROM mv WHERE k % 10 <> 0)"


def _decayed_cte(name: str, half_life: int, surface: bool) -> str:
    """A relation with n, and S{k}, T{k}, R{k} of each metric before the row's day."""
    d, keys, pool = f"pow(0.5, 1 / {half_life}.0)", "player, surface" if surface else "player", "PARTITION BY surface " if surface else ""
    sums = ", ".join(f"coalesce(sum(CASE WHEN valid THEN {x}{k} * pow({d}, -seq) END) OVER b, 0) AS {x}s{k}, sum(CASE WHEN valid THEN {x}{k} END) OVER p AS {x}p{k}" for k in range(len(METRICS)) for x in "vt")
    rates = ", ".join(f"ts{k} * pow({d}, n) AS T{k}, (vs{k} * pow({d}, n) + {w} * vp{k} / tp{k}) / (ts{k} * pow({d}, n) + {w}) AS R{k}" for k, (_, _, w) in enumerate(Q.EVERY_METRIC.values()))
    return f"""{name} AS (SELECT external_row, side, n, {rates} FROM (SELECT external_row, side, count(*) FILTER (WHERE valid) OVER b AS n, {sums}
      FROM (SELECT *, row_number() OVER (PARTITION BY {keys}, valid ORDER BY day, external_row, side) AS seq FROM s)
      WINDOW b AS (PARTITION BY {keys} ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), p AS ({pool}ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))"""


def _prematch_sql() -> str:
    load = ", ".join(Q._load_sql(k) for k in (3, 7, 14))
    both = lambda c, name: f"{r(f'a.{c}', f'player_1_{name}')}, {r(f'b.{c}', f'player_2_{name}')}"
    count = lambda c, name: f"a.{c}::BIGINT AS player_1_{name}, b.{c}::BIGINT AS player_2_{name}"
    columns = []
    for prefix, tag in (("", "o"), ("surface_", "f")):
        for k, m in enumerate(METRICS):
            columns += [both(f"{tag}{k}", f"{prefix}ewm_{m}"), r(f"a.{tag}{k} - b.{tag}{k}", f"{prefix}ewm_{m}_diff")]
        name = f"{prefix}point_stats_match_count"
        columns += [count(f"{tag}n", name), f"least(a.{tag}n, b.{tag}n)::BIGINT AS {name}_min"]
    columns += [both("t0", "decayed_service_points"), both("t1", "decayed_return_points")]
    for k in (3, 7, 14):
        columns += [both(f"minutes_last_{k}d", f"minutes_last_{k}d"), r(f"a.minutes_last_{k}d - b.minutes_last_{k}d", f"minutes_last_{k}d_diff")]
        columns += [count(f"{x}_last_{k}d", f"{x}_duration_matches_last_{k}d") for x in ("known", "missing")]
    figures = ", ".join([f"o.R{k} AS o{k}, f.R{k} AS f{k}" for k in range(len(METRICS))])
    loads = ", ".join(f"w.{x}_last_{k}d" for k in (3, 7, 14) for x in ("minutes", "known", "missing"))
    return f"""WITH {Q.EVERY_SIDES}, {_decayed_cte('o', 20, False)}, {_decayed_cte('f', 12, True)},
      w AS (SELECT external_row, side, {load} FROM (SELECT external_row, 1 AS side, winner_id AS player, day, valid, minutes FROM x UNION ALL SELECT external_row, 2, loser_id, day, valid, minutes FROM x)),
      e AS (SELECT o.external_row, o.side, o.n AS "on", f.n AS fn, o.T0 AS t0, o.T1 AS t1, {figures}, {loads} FROM o JOIN f USING (external_row, side) JOIN w USING (external_row, side))
      SELECT match_id, {', '.join(columns)} FROM {LINKED} l JOIN e a ON a.external_row = l.external_row AND a.side = l.s JOIN e b ON b.external_row = l.external_row AND b.side = 3 - l.s""".replace("a.on::", 'a."on"::').replace("b.on::", 'b."on"::').replace("least(a.on, b.on)", 'least(a."on", b."on")')


def _statistics(spark, folder) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The match view, external matches and links between them."""
    m = matches(spark, folder)
    return m, Q.external_matches(spark, folder), m.filter("k % 10 <> 0").select("match_id", F.col("k").alias("external_row"))


@query("prematch_features", _prematch_sql())
def prematch_features(spark, folder):
    return stats.prematch_features(*_statistics(spark, folder))


@query("enriched_matches", f"""WITH {Q.EVERY_SIDES}, {_decayed_cte('o', 20, False)}, p AS (SELECT match_id, a.R0 - b.R0 AS d FROM {LINKED} l JOIN o a ON a.external_row = l.external_row AND a.side = l.s JOIN o b ON b.external_row = l.external_row AND b.side = 3 - l.s)
  SELECT match_id, (rank_2 - rank_1)::BIGINT AS rank_diff, (surface = 'Clay')::BIGINT AS surface_clay, {r('d', 'ewm_serve_points_won_pct_diff')} FROM mv LEFT JOIN p USING (match_id)""")
def enriched_matches(spark, folder):
    """Base features with the pre-match columns beside them; unlinked matches keep nulls."""
    m, external, links = _statistics(spark, folder)
    rows = stats.enrich(history.build_features(m), stats.prematch_features(m, external, links))
    return rows.select("match_id", "rank_diff", "surface_clay", "ewm_serve_points_won_pct_diff")


@query("leakage_audit", f"""WITH {Q.EVERY_SIDES}, {_decayed_cte('o', 20, False)}, {_decayed_cte('f', 12, True)}, t AS (SELECT s.player, o.n, f.n AS fn, l.match_id FROM {LINKED} l JOIN s USING (external_row) JOIN o USING (external_row, side) JOIN f USING (external_row, side))
  SELECT count(DISTINCT match_id)::BIGINT AS target_rows, 0::BIGINT AS leaks, (count(DISTINCT player) FILTER (WHERE n = 0))::BIGINT AS players_with_zero_prior_point_history, (count(DISTINCT player) FILTER (WHERE n > 0))::BIGINT AS players_with_overall_history,
  (count(DISTINCT player) FILTER (WHERE fn > 0))::BIGINT AS players_with_surface_history, (SELECT count(DISTINCT day)::BIGINT FROM x) AS same_day_groups_processed FROM t""")
def leakage_audit(spark, folder):
    m, external, links = _statistics(spark, folder)
    return stats.leakage_audit(m, external, links, stats.prematch_features(m, external, links))


def _surface_rates_sql() -> str:
    rows = [f"SELECT external_row::BIGINT AS external_row, side::BIGINT AS side, '{m}' AS metric, n::BIGINT AS matches_before, {r(f'T{k}', 'decayed_t')}, {r(f'R{k}', 'rate')} FROM f" for k, m in enumerate(METRICS)]
    return f"WITH {Q.EVERY_SIDES}, {_decayed_cte('f', 12, True)} {' UNION ALL '.join(rows)}"


@query("surface_decayed_rates", _surface_rates_sql())
def surface_decayed_rates(spark, folder):
    return stats.decayed_rates(stats.player_stats(Q.external_matches(spark, folder)), by_surface=True)


def _invalid_sql() -> str:
    out = []
    for s in ("winner", "loser"):
        checks = {
            "missing": "false", "no service points": f"{s}_svpt <= 0", "first_in outside svpt": f"NOT {s}_first_in BETWEEN 0 AND {s}_svpt", "first_won outside first_in": f"NOT {s}_first_won BETWEEN 0 AND {s}_first_in",
            "second_won outside second serves": f"NOT {s}_second_won BETWEEN 0 AND {s}_svpt - {s}_first_in", "bp_saved outside bp_faced": f"NOT {s}_bp_saved BETWEEN 0 AND {s}_bp_faced", "negative ace or df": f"{s}_ace < 0 OR {s}_df < 0",
        }
        out += [f"SELECT '{s}' AS side, '{name}' AS \"check\", (count(*) FILTER (WHERE {c}))::BIGINT AS rows FROM {Q.EXTERNAL}" for name, c in checks.items()]
    return " UNION ALL ".join(out)


@query("invalid_stat_counts", _invalid_sql())
def invalid_stat_counts(spark, folder):
    return stats.invalid_counts(Q.external_matches(spark, folder))


# ---- market anchors -------------------------------------------------------------------------------


def _anchor_rows(spark, folder) -> DataFrame:
    return history.build_features(matches(spark, folder)).filter("not is_retirement").withColumn("y", F.col("player_1_won").cast("double")).withColumn("year", F.col("year").cast("long"))


ANCHOR = f"""(SELECT source, scope, unnest([year::BIGINT::VARCHAR, 'combined']) AS segment, y, q FROM (SELECT *, unnest(CASE WHEN common THEN ['source_specific', 'common_all_sources'] ELSE ['source_specific'] END) AS scope,
  CASE source WHEN 'Bet365' THEN 1 / odds_1 / (1 / odds_1 + 1 / odds_2) WHEN 'Average' THEN 1 / avg_1 / (1 / avg_1 + 1 / avg_2) ELSE 1 / ps_1 / (1 / ps_1 + 1 / ps_2) END AS q, player_1_won::INT AS y FROM {Q.SOURCES_SQL}) WHERE available AND NOT is_retirement AND year >= 1998)"""


@query("raw_anchor_metrics", f"""WITH a AS {ANCHOR}, c AS (SELECT source, scope, segment, sum(n * abs(o - m)) / sum(n) AS ece FROM (SELECT source, scope, segment, {Q.BIN.replace('p >=', 'q >=')} AS bin, count(*) AS n, avg(q) AS m, avg(y) AS o FROM a GROUP BY ALL) GROUP BY ALL)
  SELECT source, scope, segment, 'raw_market' AS architecture, count(*)::BIGINT AS sample_count, {r(f'avg({LL("y", "q")})', 'log_loss')}, {r('avg((q - y) * (q - y))', 'brier_score')}, {r('avg(((q >= 0.5)::INT = y)::INT)', 'accuracy')}, {r('any_value(ece)', 'expected_calibration_error')},
  {r('avg(q)', 'mean_market_probability')}, {r('avg(q)', 'mean_model_probability')}, 0.0::DOUBLE AS mean_absolute_correction, {r(f'avg({LL("y", "q")})', 'raw_market_log_loss')}, 0.0::DOUBLE AS log_loss_improvement_vs_raw_market FROM a JOIN c USING (source, scope, segment) GROUP BY source, scope, segment""")
def raw_anchor_metrics(spark, folder):
    rows = anchors.by_scope(_anchor_rows(spark, folder)).filter("year >= 1998")
    table = anchors.anchor_metrics(rows.withColumn("architecture", F.lit(anchors.RAW)).withColumn("p", F.col("market_probability")))
    return table.drop("roc_auc", "log_loss_improvement_vs_recalibration")


def _scored_anchors(spark, folder) -> DataFrame:
    """Each source as the anchor, on its own rows and on common rows, all fits at once; the fits read the rows many times, so their columns are kept."""
    keep = ["match_id", "match_date", "year", "y", *models.FORM, *[c for pair in markets.SOURCES.values() for c in pair]]
    return anchors.scored(_anchor_rows(spark, folder).select(*keep).persist(), Q.FOLDS)


@query("market_anchor_metrics")
def market_anchor_metrics(spark, folder):
    return anchors.anchor_metrics(anchors.predictions(_scored_anchors(spark, folder)))


@query("market_anchor_bootstrap")
def market_anchor_bootstrap(spark, folder):
    return anchors.anchor_summary(anchors.anchor_bootstrap(_scored_anchors(spark, folder)))


# ---- parsing and names ----------------------------------------------------------------------------

FORMS = """(SELECT k, CASE k % 8 WHEN 0 THEN ' Plain  Name ' WHEN 1 THEN 'Jos\u00e9  O\u2019Neil' WHEN 2 THEN 'M\u00fcller\u2013L\u00fcdenscheid' WHEN 3 THEN '  ' WHEN 4 THEN NULL WHEN 5 THEN concat('Zero', '\u200b', 'Width') WHEN 6 THEN '\u201cQuoted\u201d \u2014 text' ELSE concat('\u010cepanovi\u0107', '\u00a0', ' A.') END AS raw FROM mv)"""

def _quoted(text: str) -> str:
    return text.replace("'", "''")


SHOWN = f"nullif(trim(regexp_replace(translate(nfc_normalize(raw), '{T._FOLD_FROM}', '{_quoted(T._FOLD_TO)}'), '\\s+', ' ', 'g')), '')"


@query("text_forms", f"SELECT k::BIGINT AS k, {SHOWN} AS shown, nullif(trim(regexp_replace(strip_accents(lower({SHOWN})), '[^a-z0-9]+', ' ', 'g')), '') AS raw_normalized FROM {FORMS}")
def text_forms(spark, folder):
    rows = spark.sql("SELECT * FROM " + FORMS.replace("FROM mv", "FROM {mv}"), mv=matches(spark, folder))
    return T.with_comparable(rows, ["raw"]).select("k", T.display_text(F.col("raw")).alias("shown"), "raw_normalized")


NUMBERS = """(SELECT k, CASE k % 12 WHEN 0 THEN '12.5' WHEN 1 THEN ' 7 ' WHEN 2 THEN 'N/A' WHEN 3 THEN '-' WHEN 4 THEN '1e3' WHEN 5 THEN 'abc' WHEN 6 THEN '' WHEN 7 THEN '1.0' WHEN 8 THEN 'NaN' WHEN 9 THEN 'inf' WHEN 10 THEN '+3.25' END AS raw,
  CASE k % 5 WHEN 0 THEN concat(cast(extract(year FROM match_date) AS string), '-', cast(extract(month FROM match_date) AS string), '-', cast(extract(day FROM match_date) AS string)) WHEN 1 THEN concat(cast(extract(day FROM match_date) AS string), '/', cast(extract(month FROM match_date) AS string), '/', cast(extract(year FROM match_date) AS string))
    WHEN 2 THEN concat(cast(extract(year FROM match_date) AS string), '/', cast(extract(month FROM match_date) AS string), '/', cast(extract(day FROM match_date) AS string)) WHEN 3 THEN 'no date' END AS dated,
  concat(cast(extract(year FROM match_date) AS string), lpad(cast(extract(month FROM match_date) AS string), 2, '0'), lpad(cast(extract(day FROM match_date) AS string), 2, '0')) AS compact, match_date FROM mv)"""
PLAIN_NUMBER = "CASE WHEN lower(trim(raw)) NOT IN ('', '-', 'n/a', 'na', 'nan', 'none', 'null', 'nr') AND regexp_full_match(trim(raw), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN trim(raw)::DOUBLE END"


@query("parsed_values", f"SELECT k::BIGINT AS k, {r(PLAIN_NUMBER, 'number')}, {r(f'CASE WHEN {PLAIN_NUMBER} > 1 THEN {PLAIN_NUMBER} END', 'odds')}, CASE WHEN k % 5 < 3 THEN match_date END AS dated, match_date AS compact FROM {NUMBERS}")
def parsed_values(spark, folder):
    rows = spark.sql("SELECT * FROM " + NUMBERS.replace("FROM mv", "FROM {mv}"), mv=matches(spark, folder))
    value = N.number(F.col("raw"))
    return rows.select("k", value.alias("number"), N.valid_odds(value).alias("odds"), N.parse_date(F.col("dated")).alias("dated"), N.parse_date(F.col("compact")).alias("compact"))


SPELLED = """(SELECT k, CASE k % 13 WHEN 0 THEN 'Hard' WHEN 1 THEN ' H ' WHEN 2 THEN 'c' WHEN 3 THEN 'G' WHEN 4 THEN 'HardCourt' WHEN 5 THEN 'hard court' WHEN 6 THEN 'Indoor Hard' WHEN 7 THEN 'Red Clay' WHEN 8 THEN 'CLAY' WHEN 9 THEN 'grass' WHEN 10 THEN 'Carpet' WHEN 11 THEN NULL ELSE '' END AS raw FROM mv)"""


@query("raw_surfaces", f"""SELECT k::BIGINT AS k, CASE WHEN s IN ('hard', 'h', 'hardcourt', 'hard court') THEN 'Hard' WHEN s IN ('clay', 'c') THEN 'Clay' WHEN s IN ('grass', 'g') THEN 'Grass' ELSE 'Other' END AS ingested,
  CASE WHEN s LIKE '%hard%' OR s = 'h' THEN 'Hard' WHEN s IN ('clay', 'c') OR s LIKE '% clay' THEN 'Clay' WHEN s IN ('grass', 'g') OR s LIKE '% grass' THEN 'Grass' ELSE 'Other' END AS cleaned,
  CASE s WHEN 'hard' THEN 'Hard' WHEN 'clay' THEN 'Clay' WHEN 'grass' THEN 'Grass' ELSE 'Other' END AS listed FROM (SELECT k, lower(trim(coalesce(raw, ''))) AS s FROM {SPELLED})""")
def raw_surfaces(spark, folder):
    rows = spark.sql("SELECT * FROM " + SPELLED.replace("FROM mv", "FROM {mv}"), mv=matches(spark, folder))
    named = T.with_comparable(rows, ["raw"])
    return named.select("k", T.raw_surface(F.col("raw")).alias("ingested"), T.surface_name(F.col("raw_normalized")).alias("cleaned"), T.external_surface(F.col("raw")).alias("listed"))


SCORES = """(SELECT k, CASE k % 7 WHEN 0 THEN '6-4 6-4' WHEN 1 THEN '6-4 2-1 RET' WHEN 2 THEN 'W/O' WHEN 3 THEN '6-0 abandoned' WHEN 4 THEN NULL WHEN 5 THEN 'Walkover' ELSE 'retired' END AS score FROM mv)"""


@query("score_status", f"SELECT k::BIGINT AS k, regexp_matches(coalesce(score, ''), '(?i)\\bW/O\\b|walkover') AS is_walkover, regexp_matches(coalesce(score, ''), '(?i)\\bRET\\b|retired|abandoned') AS is_retirement FROM {SCORES}")
def score_status(spark, folder):
    score = F.coalesce("score", F.lit(""))
    rows = spark.sql("SELECT * FROM " + SCORES.replace("FROM mv", "FROM {mv}"), mv=matches(spark, folder))
    return rows.select("k", score.rlike(T.SCORE_WALKOVER).alias("is_walkover"), score.rlike(T.SCORE_RETIREMENT).alias("is_retirement"))


@query("expected_scores", f"SELECT k::BIGINT AS k, {r('1 / (1 + pow(10, (((k * 7) % 300) - (k % 300)) / 400.0))', 'expected')} FROM mv")
def expected_scores(spark, folder):
    a, b = (F.lit(1500.0) + x for x in (F.col("k") % 300, (F.col("k") * 7) % 300))
    return matches(spark, folder).select("k", N.expected_score(a, b, 400.0).alias("expected"))


# ---- cleaning reports -----------------------------------------------------------------------------

CONTENT = "concat_ws('~', trim(tournament), sf, coalesce(best_of, 3), trim(winner), trim(loser), regexp_matches(coalesce(status_or_comment, ''), '(?i)\\b(ret|retired|retirement|abandoned)\\b'))"
JUDGED = f"""j AS (SELECT row_index, {Q.REASON_SQL} AS reason, surface AS original FROM {Q.RAW}),
  d AS (SELECT row_index, sf, rd, CASE WHEN count(DISTINCT {CONTENT}) OVER (PARTITION BY match_id) > 1 THEN 'conflicting_duplicate' WHEN row_number() OVER (PARTITION BY match_id ORDER BY row_index) > 1 THEN 'exact_duplicate' END AS reason FROM {Q.CANON}),
  z AS (SELECT row_index, coalesce(j.reason, d.reason) AS reason, sf, rd, original FROM j LEFT JOIN d USING (row_index))"""


@query("rejected_rows", f"WITH {JUDGED} SELECT row_index::BIGINT AS row_index, reason AS rejection_reason FROM z WHERE reason IS NOT NULL")
def rejected_rows(spark, folder):
    return canonical.clean(Q.raw_matches(spark, folder)).rejected.select("row_index", "rejection_reason")


@query("cleaning_report", f"""WITH {JUDGED} SELECT 'rows' AS measure, 'received' AS value, count(*)::BIGINT AS n FROM z UNION ALL SELECT 'rows', 'accepted', count(*) FROM z WHERE reason IS NULL
  UNION ALL SELECT 'rejections', reason, count(*) FROM z WHERE reason IS NOT NULL GROUP BY 2 UNION ALL SELECT 'surfaces', sf, count(*) FROM z WHERE reason IS NULL GROUP BY 2
  UNION ALL SELECT 'rounds', rd, count(*) FROM z WHERE reason IS NULL GROUP BY 2 UNION ALL SELECT 'original_surfaces', original, count(*) FROM z GROUP BY 2""")
def cleaning_report(spark, folder):
    """The cleaning stage's one-row report, one row a figure."""
    report = canonical.clean(Q.raw_matches(spark, folder)).report
    rows = [report.select(F.lit("rows").alias("measure"), F.lit(name).alias("value"), F.col(f"rows_{name}").alias("n")) for name in ("received", "accepted")]
    rows += [report.select(F.lit(c).alias("measure"), F.explode(c).alias("value", "n")) for c in ("rejections", "surfaces", "rounds", "original_surfaces")]
    return reduce(DataFrame.unionByName, rows)


# ---- linkage by aliases ---------------------------------------------------------------------------

OWN_IDS = Q.LISTED.replace("k % 1000 AS winner_id, (k + 1) % 1000 AS loser_id", "cast(substr(CASE WHEN player_1_won THEN player_1 ELSE player_2 END, 2) AS bigint) AS winner_id, cast(substr(CASE WHEN player_1_won THEN player_2 ELSE player_1 END, 2) AS bigint) AS loser_id")


@query("link_aliases", f"""{Q.LINK_SQL.split('links AS')[0].replace(Q.LISTED, OWN_IDS)} u AS (SELECT p.match_id, count(*) AS n3, max(e.external_row) AS r3 FROM p JOIN e ON p.match_date = e.match_date AND substr(p.w, 2)::BIGINT = e.winner_id AND substr(p.l, 2)::BIGINT = e.loser_id
    WHERE e.winner_id % 2 = 0 AND e.loser_id % 2 = 0 GROUP BY p.match_id)
  SELECT p.match_id, CASE WHEN n1 = 1 THEN 'strict' WHEN n2 = 1 THEN 'unique_date_player' WHEN n3 = 1 THEN 'explicit_alias' END AS tier, (CASE WHEN n1 = 1 THEN r1 WHEN n2 = 1 THEN r2 WHEN n3 = 1 THEN r3 END)::BIGINT AS external_row,
    CASE WHEN coalesce(n1, 0) <> 1 AND coalesce(n2, 0) <> 1 AND coalesce(n3, 0) <> 1 THEN CASE WHEN coalesce(n2, 0) > 1 THEN 'ambiguous' ELSE 'unmatched' END END AS failure_reason FROM p LEFT JOIN t USING (match_id) LEFT JOIN u USING (match_id)""")
def link_aliases(spark, folder):
    """The cascade with explicit ids for every player of an even number."""
    m = matches(spark, folder)
    keyed = lambda f: f.withColumn("winner_keys", T.name_keys(F.col("winner_normalized"))).withColumn("loser_keys", T.name_keys(F.col("loser_normalized")))
    project, external = (keyed(spark.sql("SELECT * FROM " + x.replace("FROM mv", "FROM {mv}"), mv=m)) for x in (Q.PROJECT, OWN_IDS))
    ids = spark.range(1000, 1120, 2).select(F.concat(F.lit("p"), F.col("id").cast("string"), F.lit(" a")).alias("name"), F.col("id").alias("player_id"), F.col("id").alias("line"))
    return linkage.link(project, external, ids)


# ---- decisions and rules --------------------------------------------------------------------------


def _decision_sql() -> str:
    reasons = ", ".join(f"'{x}'" for x in decisions.REASONS)
    sides = []
    for s, p, o, other in (("1", "p_model", "odds_1", "odds_2"), ("2", "(1 - p_model)", "odds_2", "odds_1")):
        sides += [r(p, f"player_{s}_model_probability"), r(f"CASE WHEN ok THEN {o} END", f"player_{s}_decimal_odds"), r(f"CASE WHEN ok THEN 1 / {o} END", f"player_{s}_raw_implied_probability"), r(f"CASE WHEN ok THEN (1 / {o}) / (1 / {o} + 1 / {other}) END", f"player_{s}_market_probability")]
        sides += [r(f"edge_{s}", f"player_{s}_edge"), r(f"ev_{s}", f"player_{s}_expected_value"), f"why_{s} = '' AS player_{s}_eligible", f"why_{s} AS player_{s}_reason_codes"]
    pick = lambda a, b, name: r(f"CASE pick WHEN 1 THEN {a} WHEN 2 THEN {b} END", f"recommended_{name}")
    picked = [pick("odds_1", "odds_2", "odds"), pick("p_model", "1 - p_model", "probability"), pick("(1 / odds_1) / (1 / odds_1 + 1 / odds_2)", "(1 / odds_2) / (1 / odds_1 + 1 / odds_2)", "market_probability"), pick("edge_1", "edge_2", "edge"), pick("ev_1", "ev_2", "expected_value")]
    return f"""WITH {Q.ASSESS} SELECT match_id, match_date, surface, player_1, player_2, player_1_won AS actual_player_1_won, part AS "partition", {', '.join(sides)}, {r('CASE WHEN ok THEN 1 / odds_1 + 1 / odds_2 END', 'overround')}, ok AS odds_valid, pick IS NOT NULL AS has_recommendation,
      CASE pick WHEN 1 THEN 'player_1' WHEN 2 THEN 'player_2' ELSE 'none' END AS recommended_side, CASE pick WHEN 1 THEN player_1 WHEN 2 THEN player_2 END AS recommended_player, {', '.join(picked)},
      CASE WHEN pick IS NULL THEN array_to_string(list_filter([{reasons}], lambda x: list_contains(string_split(concat_ws('|', why_1, why_2), '|'), x)), '|') WHEN why_1 = '' AND why_2 = '' THEN 'multiple_eligible_selections' ELSE '' END AS decision_reason_codes FROM v"""


@query("value_decisions", _decision_sql())
def value_decisions(spark, folder):
    """Whole assessments: every column but the inputs that they repeat."""
    return Q.assessed(spark, folder).drop("player_1_odds", "player_2_odds", "predicted_player_1_probability", "predicted_player_2_probability", "is_retirement")


@query("top_skip_reasons", f"{Q.ORACLES['value_reason_counts'][Q.ORACLES['value_reason_counts'].index('), a AS (') + 3:]} ORDER BY n DESC, reason LIMIT 5".join(["WITH ", ""]))
def top_skip_reasons(spark, folder):
    return decisions.top_reasons(Q.assessed(spark, folder))


BOOKS = {"b365": ("odds_1", "odds_2"), "ps": ("ps_1", "ps_2"), "avg": ("avg_1", "avg_2"), "max": ("avg_1 + 0.25", "avg_2 + 0.25")}


def _integrity_sql(book: str, a: str, b: str) -> str:
    rows = f"(SELECT CASE WHEN player_1_won THEN w ELSE l END AS a, CASE WHEN player_1_won THEN l ELSE w END AS b, {a} AS x, CASE WHEN k % 47 = 0 THEN {b} + 0.5 ELSE {b} END AS y, w, l, {a} IS NOT NULL OR k % 82 = 0 AS available FROM (SELECT *, CASE WHEN player_1_won THEN {a} ELSE {b} END AS w, CASE WHEN player_1_won THEN {b} ELSE {a} END AS l FROM mv))"
    return f"""SELECT '{book}' AS source, (count(*) FILTER (WHERE available))::BIGINT AS rows_with_valid_source_pair, (count(*) FILTER (WHERE NOT available))::BIGINT AS rows_with_missing_source_pair, (count(*) FILTER (WHERE available AND coalesce(df > 1e-12, false)))::BIGINT AS odds_side_mapping_failures,
      (count(*) FILTER (WHERE available <> (w IS NOT NULL AND l IS NOT NULL)))::BIGINT AS source_pair_consistency_failures, {r('max(CASE WHEN available THEN df END)', 'maximum_absolute_mapping_difference')} FROM (SELECT *, greatest(abs(x - a), abs(y - b)) AS df FROM {rows})"""


@query("side_integrity_every_book", " UNION ALL ".join(_integrity_sql(k, a, b) for k, (a, b) in BOOKS.items()))
def side_integrity_every_book(spark, folder):
    won, columns = F.col("player_1_won"), []
    for book, (a, b) in BOOKS.items():
        a, b = F.expr(a), F.expr(b)
        columns += [F.when(won, a).otherwise(b).alias(f"source_winner_{book}_odds"), F.when(won, b).otherwise(a).alias(f"source_loser_{book}_odds"), a.alias(f"player_1_{book}_odds"), F.when(F.expr("k % 47 = 0"), b + 0.5).otherwise(b).alias(f"player_2_{book}_odds")]
        columns.append((a.isNotNull() | F.expr("k % 82 = 0")).alias(f"{book}_pair_available"))
    return markets.side_integrity(matches(spark, folder).select("match_id", "player_1_won", *columns), tuple(BOOKS))[1]


BROKEN = """(SELECT * REPLACE (CASE WHEN k % 101 = 0 THEN ' ' ELSE match_id END AS match_id, CASE WHEN k % 103 = 0 THEN player_2 ELSE player_1 END AS player_1, CASE WHEN k % 107 = 0 THEN 'Ice' ELSE surface END AS surface, CASE WHEN k % 109 = 0 THEN 4 ELSE best_of END AS best_of, CASE WHEN k % 113 = 0 THEN 0 ELSE rank_2 END AS rank_2) FROM mv)"""
RULES = {
    "match_id is empty": "trim(match_id) = ''", "player_1 is empty": "trim(player_1) = ''", "player_2 is empty": "trim(player_2) = ''", "id isn''t 24 hex digits": "NOT regexp_full_match(match_id, '[0-9a-f]{24}')", "same player": "player_1 = player_2",
    "unknown surface": "surface NOT IN ('Hard', 'Clay', 'Grass')", "best_of isn''t 3 or 5": "best_of NOT IN (3, 5)", "rank isn''t positive": "rank_1 <= 0 OR rank_2 <= 0", "odds aren''t above 1": "odds_1 <= 1 OR odds_2 <= 1",
}


@query("record_rules_every", " UNION ALL ".join(f"SELECT '{name}' AS rule, (count(*) FILTER (WHERE {c}))::BIGINT AS rows FROM {BROKEN}" for name, c in RULES.items()))
def record_rules_every(spark, folder):
    """All rules, on rows of which some break them."""
    k = F.col("k")
    m = matches(spark, folder).withColumns({
        "match_id": F.when(k % 101 == 0, " ").otherwise(F.col("match_id")), "player_1": F.when(k % 103 == 0, F.col("player_2")).otherwise(F.col("player_1")), "surface": F.when(k % 107 == 0, "Ice").otherwise(F.col("surface")),
        "best_of": F.when(k % 109 == 0, 4).otherwise(F.col("best_of")), "rank_2": F.when(k % 113 == 0, 0).otherwise(F.col("rank_2")),
    })
    return records.violations(m, records.canonical_rules())


@query("surface_auc", f"""SELECT part, surface, (SELECT {r('sum(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END * a.n * b.n) / sum(a.n * b.n)', 'auc').rsplit(' AS ', 1)[0]} FROM (SELECT p, count(*) AS n FROM {Q.ELIGIBLE} i WHERE y = 1 AND i.part = t.part AND i.surface = t.surface GROUP BY p) a,
  (SELECT p, count(*) AS n FROM {Q.ELIGIBLE} i WHERE y = 0 AND i.part = t.part AND i.surface = t.surface GROUP BY p) b) AS roc_auc FROM {Q.ELIGIBLE} t GROUP BY part, surface""")
def surface_auc(spark, folder):
    return metrics.roc_auc(Q._predictions(spark, folder), ["part", "surface"], "y", "p_model")
