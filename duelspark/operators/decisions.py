"""Value decisions: per side reasons, at most one recommendation per match."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ValueThresholds
from ..functions import numbers as N
from ..functions.text import SURFACES, blank_to_null

# Reason codes in their order of report.
REASONS = (
    "missing_match_id", "same_player", "unsupported_surface", "unsupported_match", "retirement", "walkover",
    "missing_odds", "invalid_odds", "invalid_probability", "probability_below_threshold", "edge_below_threshold",
    "expected_value_below_threshold", "odds_below_minimum", "odds_above_maximum", "multiple_eligible_selections",
)
SIDES = ("player_1", "player_2")
PICKED = ("player", "odds", "probability", "market_probability", "edge", "expected_value")
#: Columns that an assessment adds; older ones of these names are replaced.
MADE = (
    *[f"{s}_{c}" for s in SIDES for c in ("model_probability", "decimal_odds", "raw_implied_probability", "market_probability", "edge", "expected_value", "eligible", "reason_codes")],
    "overround", "odds_valid", "has_recommendation", "recommended_side", "decision_reason_codes", *[f"recommended_{c}" for c in PICKED],
)


def codes(conditions: dict[str, Column]) -> Column:
    """The reasons whose condition holds, in report order, joined by bars."""
    return F.concat_ws("|", *[F.when(conditions[r], F.lit(r)) for r in REASONS if r in conditions])


def any_of(conditions: dict[str, Column]) -> Column:
    """Whether any condition holds, as plain booleans: what a filter on it pushes down stays small."""
    return reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in conditions.values()])


def _optional(frame: DataFrame, name: str, default: Column) -> Column:
    return F.coalesce(F.col(name), default) if name in frame.columns else default


def assess(frame: DataFrame, limits: ValueThresholds = ValueThresholds()) -> DataFrame:
    """Flat assessments of prediction rows: match_id, players, surface, odds and predicted probabilities."""
    frame = frame.drop(*MADE)
    o1, o2 = F.col("player_1_odds"), F.col("player_2_odds")
    p1, p2 = F.col("predicted_player_1_probability"), F.col("predicted_player_2_probability")
    market_ok = N.odds_pair_valid(o1, o2)
    pair_ok = F.coalesce(p1.between(0, 1) & p2.between(0, 1) & (F.abs(p1 + p2 - 1) <= 1e-9 + 1e-5), F.lit(False))
    common = {
            "missing_match_id": blank_to_null(F.col("match_id")).isNull(),
            "same_player": F.lower("player_1") == F.lower("player_2"),
            "unsupported_surface": ~F.coalesce(F.col("surface").isin(*SURFACES), F.lit(False)),
            "unsupported_match": _optional(frame, "odds_source", F.lit("")) == "inconsistent",
            "retirement": _optional(frame, "is_retirement", F.lit(False)),
            "walkover": _optional(frame, "is_walkover", F.lit(False)),
            "missing_odds": o1.isNull() | o2.isNull(),
            "invalid_odds": o1.isNotNull() & o2.isNotNull() & ~market_ok,
            "invalid_probability": ~pair_ok,
    }
    figures, own = [], {}
    for side, odds, p, other in (("player_1", o1, p1, o2), ("player_2", o2, p2, o1)):
        model, market, price = F.when(pair_ok, p), F.when(market_ok, N.no_vig(odds, other)), F.when(market_ok, odds)
        figures += [
            model.alias(f"{side}_model_probability"),
            price.alias(f"{side}_decimal_odds"),
            F.try_divide(F.lit(1.0), price).alias(f"{side}_raw_implied_probability"),
            market.alias(f"{side}_market_probability"),
            (model - market).alias(f"{side}_edge"),
            (model * price - 1).alias(f"{side}_expected_value"),
        ]
        model, market, price, edge, value = (F.col(f"{side}_{c}") for c in ("model_probability", "market_probability", "decimal_odds", "edge", "expected_value"))
        own[side] = {
            "unsupported_match": F.col("__unsupported_match") | model.isNull() | market.isNull(),
            "probability_below_threshold": market.isNotNull() & (model < limits.probability),
            "edge_below_threshold": edge < limits.edge,
            "expected_value_below_threshold": value < limits.expected_value,
            "odds_below_minimum": model.isNotNull() & (price < limits.min_odds),
            "odds_above_maximum": model.isNotNull() & (price > limits.max_odds),
        }
    # each step's booleans are columns of the next, so no expression is worked out twice
    flag = lambda c, name: F.coalesce(c, F.lit(False)).alias(name)
    out = frame.select("*", *[flag(c, f"__{r}") for r, c in common.items()], F.when(market_ok, N.overround(o1, o2)).alias("overround"), *figures)
    out = out.select("*", *[flag(c, f"__{side}_{r}") for side in SIDES for r, c in own[side].items()])
    why = {side: {**{r: F.col(f"__{r}") for r in common}, **{r: F.col(f"__{side}_{r}") for r in own[side]}} for side in SIDES}
    out = out.select("*", *[(~any_of(why[s])).alias(f"{s}_eligible") for s in SIDES], *[codes(why[s]).alias(f"{s}_reason_codes") for s in SIDES])
    out = out.withColumn("__pick", F.least(*[_choice(s) for s in SIDES]))  # nulls are passed over
    first, second = (F.col(f"{s}_eligible") for s in SIDES)
    both = codes({r: why["player_1"][r] | why["player_2"][r] for r in why["player_1"]})
    decision = F.when(first & second, "multiple_eligible_selections").when(first | second, "").otherwise(both)
    picked = [F.col(f"__pick.{c}").alias(f"recommended_{c}") for c in PICKED]
    out = out.select("*", (first | second).alias("has_recommendation"), F.coalesce("__pick.side", F.lit("none")).alias("recommended_side"), *picked, decision.alias("decision_reason_codes"), F.col("overround").isNotNull().alias("odds_valid"))
    return out.drop("__pick", *[f"__{r}" for r in common], *[f"__{side}_{r}" for side in SIDES for r in own[side]])


def _choice(side: str) -> Column:
    """Sort key first: larger value, larger edge, name, side."""
    return F.when(
        F.col(f"{side}_eligible"),
        F.struct(
            (-F.col(f"{side}_expected_value")).alias("k1"),
            (-F.col(f"{side}_edge")).alias("k2"),
            F.lower(F.col(side)).alias("k3"),
            F.lit(side).alias("side"),
            F.col(side).alias("player"),
            F.col(f"{side}_decimal_odds").alias("odds"),
            F.col(f"{side}_model_probability").alias("probability"),
            F.col(f"{side}_market_probability").alias("market_probability"),
            F.col(f"{side}_edge").alias("edge"),
            F.col(f"{side}_expected_value").alias("expected_value"),
        ),
    )


def reason_counts(assessed: DataFrame) -> DataFrame:
    """How often each reason stands in the three reason columns."""
    columns = ("player_1_reason_codes", "player_2_reason_codes", "decision_reason_codes")
    tokens = F.explode(F.concat(*[F.split(F.col(c), r"\|") for c in columns])).alias("reason")
    return assessed.select(tokens).filter("reason <> ''").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def top_reasons(assessed: DataFrame, most: int = 5) -> DataFrame:
    """The commonest reasons (a top-k report); ties go by name."""
    return reason_counts(assessed).orderBy(F.desc("n"), "reason").limit(most)


def value_summary(assessed: DataFrame) -> DataFrame:
    picked = F.col("has_recommendation")
    return assessed.agg(
        F.count(F.lit(1)).alias("rows_assessed"),
        F.count_if("odds_valid").alias("rows_with_valid_odds"),
        F.count_if(picked).alias("rows_with_recommendations"),
        F.count_if(F.col("recommended_side") == "player_1").alias("recommendations_player_1"),
        F.count_if(F.col("recommended_side") == "player_2").alias("recommendations_player_2"),
        F.coalesce(F.avg(picked.cast("double")), F.lit(0.0)).alias("recommendation_rate"),
        *[F.avg(f"recommended_{c}").alias(f"average_{c}") for c in ("probability", "odds", "market_probability", "edge", "expected_value")],
    )
