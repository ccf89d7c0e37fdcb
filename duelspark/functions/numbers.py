"""Odds, probabilities, buckets, losses and dates as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens that mean "missing" in raw files, after trimming and lower-casing.
MISSING = ("", "-", "n/a", "na", "nan", "none", "null", "nr")
# Date patterns in order of preference.
DATE_PATTERNS = ("yyyy-M-d", "d/M/yyyy", "d-M-yyyy", "M/d/yyyy", "yyyy-M-d H:m:s", "yyyy/M/d", "d MMM yyyy", "MMM d, yyyy", "yyyyMMdd")

# Edges and labels of all buckets, here and in ``odds_bucket``.
EDGE_BUCKETS = ((None, 0.04, "<0.04"), (0.04, 0.06, "0.04-0.06"), (0.06, 0.08, "0.06-0.08"), (0.08, 0.12, "0.08-0.12"), (0.12, None, "0.12+"))
CORRECTION_BUCKETS = ((0.0, 0.01, "0.00-0.01"), (0.01, 0.02, "0.01-0.02"), (0.02, 0.05, "0.02-0.05"), (0.05, 0.10, "0.05-0.10"), (0.10, None, "0.10+"))
SIGNED_BUCKETS = (
    (None, -0.05, "below_-0.05"),
    (-0.05, -0.02, "-0.05_to_-0.02"),
    (-0.02, -0.01, "-0.02_to_-0.01"),
    (-0.01, 0.01, "-0.01_to_0.01"),
    (0.01, 0.02, "0.01_to_0.02"),
    (0.02, 0.05, "0.02_to_0.05"),
    (0.05, None, "above_0.05"),
)


def present(raw: Column) -> Column:
    """A raw text value, null where it is one of the missing tokens."""
    text = F.trim(raw.cast("string"))
    return F.when(~F.lower(text).isin(*MISSING), text)


def number(raw: Column) -> Column:
    """Plain decimal notation as a double; anything else, NaN and infinities are null."""
    text = present(raw)
    value = F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text).try_cast("double")
    return finite(value)


def finite(value: Column) -> Column:
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


def valid_odds(value: Column) -> Column:
    return F.when(finite(value) > 1.0, value)


def parse_date(raw: Column) -> Column:
    text = present(raw)
    return F.coalesce(*[F.to_date(F.try_to_timestamp(text, F.lit(p))) for p in DATE_PATTERNS])


def overround(a: Column, b: Column) -> Column:
    return F.try_divide(F.lit(1.0), a) + F.try_divide(F.lit(1.0), b)


def no_vig(a: Column, b: Column) -> Column:
    """The first side's probability with the margin removed in proportion."""
    return F.try_divide(F.try_divide(F.lit(1.0), a), overround(a, b))


def odds_pair_valid(a: Column, b: Column) -> Column:
    return F.coalesce((finite(a) > 1) & (finite(b) > 1), F.lit(False))


def expected_score(a: Column, b: Column, scale: float) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), (b - a) / scale))


def logit(p: Column, epsilon: float = 1e-6) -> Column:
    c = F.least(F.greatest(p, F.lit(epsilon)), F.lit(1 - epsilon))
    return F.log(c / (1 - c))


def bucket(value: Column, table: tuple) -> Column:
    """Half-open buckets [low, high); None is unbounded."""
    out = None
    for low, high, label in table:
        inside = F.lit(True)
        if low is not None:
            inside = inside & (value >= low)
        if high is not None:
            inside = inside & (value < high)
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return F.when(value.isNotNull(), out)


def odds_bucket(odds: Column) -> Column:
    return (
        F.when((odds >= 1.5) & (odds < 1.75), "1.50-1.75")
        .when((odds >= 1.75) & (odds < 2.0), "1.75-2.00")
        .when((odds >= 2.0) & (odds < 2.5), "2.00-2.50")
        .when((odds >= 2.5) & (odds <= 3.5), "2.50-3.50")
        .otherwise("other")
    )


def calibration_bin(p: Column) -> Column:
    """Number of the tenth that holds p: edges are k/10, the last one closed."""
    ladder = None
    for k in range(9, 0, -1):
        ladder = F.when(p >= k / 10.0, k) if ladder is None else ladder.when(p >= k / 10.0, k)
    return ladder.otherwise(0)


def row_log_loss(y: Column, p: Column, clip: float = 1e-15) -> Column:
    q = F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    return -(y * F.log(q) + (1 - y) * F.log(1 - q))


def iso_block(date: Column) -> Column:
    """Calendar year with the ISO week's number."""
    return F.format_string("%d-W%02d", F.year(date), F.weekofyear(date))


def day_number(date: Column) -> Column:
    return F.unix_date(date)
