"""Logistic models with train-only preparation, many at a time.

A fit is a group (fold, variant, source ...). Medians, missing indicators, scales and the Newton steps of
all groups are grouped aggregates: one pass over the rows per step, whatever the number of groups. Only
per-group matrices of (features + 1) squared reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import ExitStack
from dataclasses import dataclass, field
from tempfile import TemporaryFile

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..config import Fold
from ..functions import numbers as N

# Model inputs of the three generations.
NUMERIC = ("overall_elo_diff", "surface_elo_diff", "log_rank_diff", "recent_rate_diff", "surface_recent_rate_diff", "rest_days_diff", "matches_in_schedule_diff", "history_count_min")
BINARY = ("best_of_5", "surface_clay", "surface_grass")
FORM = ("recent_rate_diff", "surface_recent_rate_diff", "rest_days_diff", "matches_in_schedule_diff")
MARKET = "market_logit"
#: Parts into which a pass for medians cuts a range.
BINS = 1024
FORBIDDEN = ("match_id", "match_date", "player_1", "player_2", "player_1_won", "odds_1", "odds_2", "is_retirement", "bankroll_before", "bankroll_after", "profit_loss", "stake", "result")
VARIANTS = {
    "B_market_recalibration": (MARKET,),
    "C_market_plus_overall_elo": (MARKET, "overall_elo_diff"),
    "D_market_plus_elo_package": (MARKET, "overall_elo_diff", "surface_elo_diff", "history_count_min"),
    "E_market_plus_ranking": (MARKET, "log_rank_diff"),
    "F_market_plus_form_workload": (MARKET, *FORM),
    "G_full": (MARKET, *NUMERIC, *BINARY),
}


def check_features(names: tuple[str, ...]) -> None:
    leaks = sorted(set(names) & set(FORBIDDEN))
    if leaks:
        raise ValueError(f"features that leak the result: {', '.join(leaks)}")


def eligibility(frame: DataFrame) -> DataFrame:
    """Exclusion flags of feature rows; a row may have several. All copies of a repeated id are out."""
    copies = F.count(F.lit(1)).over(Window.partitionBy("match_id"))  # not a join, which would make all features twice
    return frame.filter("match_id is not null").select(
        "*",
        (copies > 1).alias("duplicate_id"),
        F.col("match_date").isNull().alias("invalid_date"),
        F.col("player_1_won").isNull().alias("invalid_target"),
        (~F.coalesce(F.col("surface").isin("Hard", "Clay", "Grass"), F.lit(False))).alias("invalid_surface"),
    )


def market_features(frame: DataFrame, a: str = "odds_1", b: str = "odds_2") -> DataFrame:
    """Rows with valid odds, with the market's probability, its logit and the overround."""
    x, y = F.col(a), F.col(b)
    valid = frame.filter(N.odds_pair_valid(x, y)).withColumn("market_probability", N.no_vig(x, y)).withColumn("overround", N.overround(x, y))
    return valid.withColumn(MARKET, N.logit(F.col("market_probability")))


def prepare(frame: DataFrame) -> DataFrame:
    """Rows fit for training: valid odds, result and surface, no retirement, unique ids."""
    flagged = eligibility(frame).filter("not (duplicate_id or invalid_date or invalid_target or invalid_surface) and not is_retirement")
    kept = market_features(flagged).drop("duplicate_id", "invalid_date", "invalid_target", "invalid_surface")
    return kept.withColumn("y", F.col("player_1_won").cast("double"))


def fold_rows(frame: DataFrame, folds: tuple[Fold, ...], year: str = "year") -> DataFrame:
    """Each row once per fold it belongs to, with its role; the folds are literals, nothing is joined."""
    y = F.col(year)
    roles = F.array_compact(F.array(*[F.when(y.between(f.train_from, f.train_to), F.struct(F.lit(f.fold).alias("fold"), F.lit("train").alias("role"))).when(y == f.evaluate, F.struct(F.lit(f.fold).alias("fold"), F.lit("evaluate").alias("role"))) for f in folds]))
    return frame.select("*", F.inline(roles))


@dataclass(frozen=True)
class Prepared:
    """Train-only figures of one group: medians, which features get a missing indicator, means, scales."""

    features: tuple[str, ...]
    medians: np.ndarray
    indicators: tuple[int, ...]
    means: np.ndarray
    scales: np.ndarray

    def matrix(self, raw: np.ndarray) -> np.ndarray:
        missing = np.isnan(raw)
        full = np.where(missing, self.medians, raw)
        full = np.concatenate([full, missing[:, list(self.indicators)].astype(float)], axis=1)
        return (full - self.means) / self.scales

    def names(self) -> list[str]:
        return [*self.features, *(f"missing_{self.features[k]}" for k in self.indicators)]


@dataclass(frozen=True)
class Fitted:
    prepared: Prepared
    weights: np.ndarray
    intercept: float
    iterations: int
    extra: dict = field(default_factory=dict)

    def predict_logit(self, raw: np.ndarray) -> np.ndarray:
        return self.prepared.matrix(raw) @ self.weights + self.intercept


def _medians(train: DataFrame, features: tuple[str, ...]) -> dict[tuple[int, int], float]:
    """Exact median of each (group, feature's place); memory doesn't grow with the distinct values.

    Each pass cuts the range that holds the middle into ``BINS``, with counts and ends, until it is one value."""
    values = F.array(*[F.struct(F.lit(k).alias("f"), F.col(f).cast("double").alias("v")) for k, f in enumerate(features)])
    long = train.select("g", F.inline(values)).filter("v is not null and not isnan(v)")
    spans = {(r["g"], r["f"]): (r["lo"], r["hi"], (r["n"] - 1) // 2, r["n"] // 2) for r in long.groupBy("g", "f").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n")).collect()}
    out = {key: lo for key, (lo, hi, _, _) in spans.items() if lo == hi}
    v, lo, hi = F.col("v"), F.col("from"), F.col("to")
    place = F.floor(F.coalesce(F.try_divide(v / 2 - lo / 2, hi / 2 - lo / 2), F.lit(0.0)) * BINS)
    place = F.when(v <= lo, 0).when(v >= hi, BINS).otherwise(F.least(place, F.lit(BINS - 1)))
    while spans := {key: span for key, span in spans.items() if key not in out}:
        table = train.sparkSession.createDataFrame([(*key, *span[:2]) for key, span in spans.items()], "g long, f int, from double, to double")
        inside = long.join(F.broadcast(table), ["g", "f"]).filter(v.between(lo, hi))
        found: dict[tuple[int, int], list] = {}
        for r in inside.groupBy("g", "f", place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect():
            found.setdefault((r["g"], r["f"]), []).append((r["bin"], r["n"], r["lo"], r["hi"]))
        for key, bins in found.items():
            _, _, first, second = spans[key]  # ranks of the two middle values, from the range's least
            bins.sort()
            for k, (_, n, least, greatest) in enumerate(bins):
                if first < n:
                    break
                first, second = first - n, second - n
            if second >= n:  # the two lie on both sides of a cut
                out[key] = 0.5 * greatest + 0.5 * bins[k + 1][2]
            elif least == greatest:
                out[key] = least
            else:
                spans[key] = (least, greatest, first, second)
    return out


def _figures(train: DataFrame, features: tuple[str, ...], binary: tuple[str, ...]) -> dict[int, Prepared]:
    """Per group: exact medians (mode for binaries), null counts, then means and population deviations."""
    c = lambda f: F.col(f).cast("double")
    counts = train.groupBy("g").agg(*[F.mode(c(f)).alias(f"m_{f}") for f in features if f in binary], *[F.count_if(F.col(f).isNull()).alias(f"n_{f}") for f in features])
    rows = {r["g"]: r for r in counts.collect()}  # one row per fit
    if not rows:
        return {}
    numeric = tuple(f for f in features if f not in binary)
    middle = _medians(train, numeric) if numeric else {}
    medians = {g: [k[f"m_{f}"] if f in binary else middle.get((g, numeric.index(f))) for f in features] for g, k in rows.items()}
    table = train.sparkSession.createDataFrame([(g, *m) for g, m in medians.items()], "g long, " + ", ".join(f"m_{f} double" for f in features))
    filled = train.join(F.broadcast(table), "g")
    value = lambda f: F.coalesce(c(f), F.col(f"m_{f}"), F.lit(0.0))
    gap = lambda f: F.col(f).isNull().cast("double")
    second = filled.groupBy("g").agg(*[x for f in features for x in (F.avg(value(f)).alias(f"a_{f}"), F.stddev_pop(value(f)).alias(f"s_{f}"), F.avg(gap(f)).alias(f"ga_{f}"), F.stddev_pop(gap(f)).alias(f"gs_{f}"))])
    out = {}
    for r in second.collect():
        k = rows[r["g"]]
        gaps = tuple(i for i, f in enumerate(features) if k[f"n_{f}"] and f not in binary)
        means = [0.0 if f in binary else r[f"a_{f}"] for f in features] + [r[f"ga_{features[i]}"] for i in gaps]
        scales = [1.0 if f in binary else r[f"s_{f}"] or 1.0 for f in features] + [r[f"gs_{features[i]}"] or 1.0 for i in gaps]
        out[r["g"]] = Prepared(features, np.array([0.0 if m is None else m for m in medians[r["g"]]]), gaps, np.array(means), np.array(scales))
    return out


def _matrix(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """Columns of doubles as a matrix, nulls as NaN."""
    return np.column_stack([batch.column(n).to_numpy(zero_copy_only=False).astype(float) for n in names])


def fit_groups(train: DataFrame, features: tuple[str, ...], binary: tuple[str, ...] = (), c: float = 1.0, max_iter: int = 50, tolerance: float = 1e-10) -> dict[int, Fitted]:
    """L2 logistic regression of every group ``g`` of ``train`` (label ``y``): minimum of |w|^2/2 + c * loss."""
    return fit_variants(train, {"": features}, binary, c, max_iter, tolerance)[""]


def fit_variants(train: DataFrame, variants: dict[str, tuple[str, ...]], binary: tuple[str, ...] = (), c: float = 1.0, max_iter: int = 50, tolerance: float = 1e-10) -> dict[str, dict[int, Fitted]]:
    """``fit_groups`` for several lists of features: figures are taken once, and a Newton step of all fits is one pass."""
    features = tuple(dict.fromkeys(f for names in variants.values() for f in names))
    check_features(features)
    whole = _figures(train, features, binary)
    prepared, columns = {}, {}  # of each fit, by variant and group; columns: its places in the group's whole matrix
    for name, own in variants.items():
        at = [features.index(f) for f in own]
        for g, p in whole.items():
            gaps = [i for i in at if i in p.indicators]
            columns[name, g] = at + [len(features) + p.indicators.index(i) for i in gaps]
            prepared[name, g] = Prepared(own, p.medians[at], tuple(at.index(i) for i in gaps), p.means[columns[name, g]], p.scales[columns[name, g]])
    state = {fit: np.zeros(len(p.means) + 1) for fit, p in prepared.items()}
    slim = train.select("g", F.col("y").cast("double").alias("y"), *[F.col(f).cast("double") for f in features])
    order = list(state)
    open_ = set(state)
    rounds = {fit: 0 for fit in state}
    for _ in range(max_iter):
        if not open_:
            break
        shared: dict[int, list] = {}
        for k, (name, g) in enumerate(order):
            if (name, g) in open_:
                shared.setdefault(g, []).append((k, columns[name, g], state[name, g]))

        def step(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                groups, rows = batch.column("g").to_numpy(zero_copy_only=False), _matrix(batch, ["y", *features])
                for g in np.unique(groups).tolist():
                    if g not in shared:
                        continue
                    part = rows[groups == g]
                    full = np.column_stack([whole[g].matrix(part[:, 1:]), np.ones(len(part))])
                    for k, own, w in shared[g]:
                        x = full[:, [*own, -1]]
                        q = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
                        made = np.concatenate([x.T @ (q - part[:, 0]), ((x * (q * (1 - q))[:, None]).T @ x).ravel()])
                        sums[k] = made if k not in sums else sums[k] + made
            rows = [(fit, k, v) for fit, s in sums.items() for k, v in enumerate(s.tolist())]
            made = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(made[0], pa.int64()), pa.array(made[1], pa.int64()), pa.array(made[2], pa.float64())], names=["fit", "k", "v"])

        found: dict[tuple, dict[int, float]] = {}
        for r in slim.mapInArrow(step, "fit long, k long, v double").groupBy("fit", "k").agg(F.sum("v").alias("v")).collect():
            found.setdefault(order[r["fit"]], {})[r["k"]] = r["v"]
        for fit in list(open_):
            if fit not in found:
                open_.discard(fit)
                continue
            n = len(state[fit])
            flat = np.array([found[fit][k] for k in range(n + n * n)])
            penalty = np.append(np.ones(n - 1), 0.0) / c
            gradient = flat[:n] + penalty * state[fit]
            hessian = flat[n:].reshape(n, n) + np.diag(penalty) + 1e-12 * np.eye(n)
            move = np.linalg.solve(hessian, gradient)
            state[fit] = state[fit] - move
            rounds[fit] += 1
            if np.abs(move).max() < tolerance:
                open_.discard(fit)
    return {name: {g: Fitted(prepared[name, g], state[name, g][:-1], float(state[name, g][-1]), rounds[name, g]) for g in whole} for name in variants}


def predict_groups(frame: DataFrame, fitted: dict[int, Fitted], output: str = "probability", offset: str | None = None, cap: float | None = None) -> DataFrame:
    """``frame`` with the probability of its group's model; groups without one give null."""
    features = next(iter(fitted.values())).prepared.features if fitted else ()

    def run(g: pd.Series, base: pd.Series, *columns: pd.Series) -> pd.Series:
        raw = np.column_stack([c.to_numpy(float) for c in columns])
        out = np.full(len(g), np.nan)
        for key in g.unique():
            if key in fitted:
                at = (g == key).to_numpy()
                z = fitted[key].predict_logit(raw[at])
                if cap is not None:
                    z = np.clip(z, -cap, cap)
                out[at] = 1 / (1 + np.exp(-np.clip(z + base.to_numpy(float)[at], -40, 40)))
        return pd.Series(out)

    udf = F.pandas_udf(run, DoubleType())
    base = F.col(offset) if offset else F.lit(0.0)
    return frame.withColumn(output, F.nanvl(udf(F.col("g"), base, *[F.col(f).cast("double") for f in features]), F.lit(None).cast("double")))


def fit_fixed_offset(train: DataFrame, features: tuple[str, ...], offset: str = MARKET, c: float = 1.0, rate: float = 0.05, max_iter: int = 600, tolerance: float = 1e-8) -> dict[int, Fitted]:
    """Correction on top of a fixed offset by full-batch gradient descent with early stop, per group.

    The descent needs every row of a group at each of its steps: one task writes a group's scaled rows to a file of
    its own and passes over that block by block, so that its memory doesn't grow with the group."""
    check_features(features)
    prepared = _figures(train, features, ())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups, rows = batch.column("g").to_numpy(zero_copy_only=False), _matrix(batch, ["y", offset, *features])
            for g in np.unique(groups).tolist():
                part = rows[groups == g]
                block = np.column_stack([part[:, :2], prepared[g].matrix(part[:, 2:])])
                yield pa.RecordBatch.from_arrays([pa.array([g], pa.int64()), pa.array([block.T.tobytes()], pa.binary())], names=["g", "columns"])

    def descend(blocks: Callable[[], Iterator[np.ndarray]], m: int) -> tuple[np.ndarray, float, int]:
        def sums(w: np.ndarray, b: float) -> tuple[np.ndarray, float, float, int]:
            """Summed errors times rows, errors, losses and the count at a point."""
            slope, error, loss, n = np.zeros(m), 0.0, 0.0, 0
            for block in blocks():
                y, base, x = block[0], block[1], block[2:]
                q = 1 / (1 + np.exp(-np.clip(base + b + w @ x, -40, 40)))
                slope, error, n = slope + x @ (q - y), error + (q - y).sum(), n + len(y)
                q = np.clip(q, 1e-15, 1 - 1e-15)
                loss -= np.log(np.where(y == 1, q, 1 - q)).sum()
            return slope, error, loss, n

        w, b, before, steps = np.zeros(m), 0.0, np.inf, 0
        slope, error, _, n = sums(w, b)
        for steps in range(1, max_iter + 1):
            w, b = w - rate * (slope + w / c) / n, b - rate * error / n
            slope, error, loss, n = sums(w, b)
            if abs(before - loss / n) < tolerance:
                break
            before = loss / n
        return w, float(b), steps

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ExitStack() as stack:
            files, lengths = {}, {}
            for batch in batches:
                for g, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                    if g not in files:
                        files[g], lengths[g] = stack.enter_context(TemporaryFile()), []
                    lengths[g].append(files[g].write(data.as_buffer()) // 8)
            for g, file in files.items():
                m = len(prepared[g].means)
                file.flush()

                def blocks(file=file, sizes=lengths[g], m=m) -> Iterator[np.ndarray]:
                    file.seek(0)
                    for size in sizes:
                        yield np.frombuffer(file.read(size * 8)).reshape(m + 2, -1)

                w, b, steps = descend(blocks, m)
                yield pa.RecordBatch.from_arrays([pa.array([g], pa.int64()), pa.array([w.tolist()], pa.list_(pa.float64())), pa.array([b], pa.float64()), pa.array([steps], pa.int32())], names=["g", "w", "b", "steps"])

    slim = train.select("g", F.col("y").cast("double").alias("y"), F.col(offset).cast("double").alias(offset), *[F.col(f).cast("double") for f in features])
    packed = slim.mapInArrow(pack, "g long, columns binary").repartition("g")
    rows = packed.mapInArrow(run, "g long, w array<double>, b double, steps int").collect()  # one row per fit
    return {r["g"]: Fitted(prepared[r["g"]], np.array(r["w"]), r["b"], r["steps"]) for r in rows}


def coefficients(spark, fitted: dict[int, Fitted]) -> DataFrame:
    rows = [(int(g), name, float(v)) for g, m in fitted.items() for name, v in [*zip(m.prepared.names(), m.weights), ("intercept", m.intercept)]]
    return spark.createDataFrame(rows, "g long, feature string, coefficient double").withColumn("sign", F.signum("coefficient"))


def market_category(coefficient: Column) -> Column:
    return F.when(coefficient < 0.9, "below_market").when(coefficient <= 1.1, "near_market").otherwise("above_market")


def ablation(prepared: DataFrame, folds: tuple[Fold, ...]) -> DataFrame:
    """(variant, fold, log loss, Brier) of the market itself and six fitted variants."""
    rows = fold_rows(prepared, folds).withColumn("g", F.col("fold").cast("long"))
    train, test = rows.filter("role = 'train'"), rows.filter("role = 'evaluate'")
    fitted = fit_variants(train, VARIANTS, BINARY)
    scored = test
    for name in VARIANTS:
        scored = predict_groups(scored, fitted[name], f"p_{name}")
    pairs = {"A_market_baseline": "market_probability"} | {name: f"p_{name}" for name in VARIANTS}
    every = scored.select("fold", "y", F.inline(F.array(*[F.struct(F.lit(name).alias("variant"), F.col(p).alias("p")) for name, p in pairs.items()])))
    return every.groupBy("variant", "fold").agg(F.count(F.lit(1)).alias("n"), F.avg(N.row_log_loss(F.col("y"), F.col("p"))).alias("log_loss"), F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"))


def architectures(prepared: DataFrame, folds: tuple[Fold, ...], cap: float = 0.15) -> DataFrame:
    """Evaluation rows of four architectures: recalibration, free form, fixed offset, fixed offset capped."""
    rows = fold_rows(prepared, folds).withColumn("g", F.col("fold").cast("long"))
    train, test = rows.filter("role = 'train'"), rows.filter("role = 'evaluate'")
    fixed = fit_fixed_offset(train, FORM)
    parts = {
        "market_recalibration": predict_groups(test, fit_groups(train, (MARKET,)), "p"),
        "free_form_workload": predict_groups(test, fit_groups(train, (MARKET, *FORM)), "p"),
        "fixed_offset_form_workload": predict_groups(test, fixed, "p", MARKET),
        "fixed_offset_form_workload_capped": predict_groups(test, fixed, "p", MARKET, cap),
    }
    keep = ["fold", "year", "match_id", "match_date", "y", "market_probability", "overround", "odds_source", "p"]
    out = None
    for name, part in parts.items():
        part = part.select(F.lit(name).alias("architecture"), *keep)
        out = part if out is None else out.unionByName(part)
    return out.withColumn("correction", F.col("p") - F.col("market_probability"))
