"""Bootstrap intervals of paired differences, by row and by block.

Parity with a seeded generator needs one ordered sequence per segment: eight bytes a row (or one row a
block, summed in Spark) go to one task, which draws resamples in chunks of bounded memory.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N

SAMPLES, SEED = 10_000, 42
#: Drawn indices held at a time.
CHUNK = 4_000_000
SCHEMA = "sample_count long, mean_improvement double, median_improvement double, ci_lower double, ci_upper double, probability_better double"


def _summary(n: int, mean: float, drawn: np.ndarray) -> dict:
    low, high = np.percentile(drawn, [2.5, 97.5])
    return {"sample_count": n, "mean_improvement": mean, "median_improvement": float(np.median(drawn)), "ci_lower": float(low), "ci_upper": float(high), "probability_better": float((drawn > 0).mean())}


def paired(values: np.ndarray, samples: int = SAMPLES, seed: int = SEED) -> np.ndarray:
    """Means of ``samples`` resamples of the values."""
    if not len(values) or samples <= 0:
        raise ValueError("needs values and a positive number of samples")
    rng, out, each = np.random.default_rng(seed), np.empty(samples), max(1, CHUNK // len(values))
    for a in range(0, samples, each):
        b = min(samples, a + each)
        out[a:b] = values[rng.integers(0, len(values), size=(b - a, len(values)))].mean(axis=1)
    return out


def bootstrap(frame: DataFrame, keys: list[str], difference: str, order: str = "match_id", samples: int = SAMPLES, seed: int = SEED) -> DataFrame:
    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        values = part.sort_values("__order", kind="mergesort")["d"].to_numpy(float)
        return pd.DataFrame([dict(zip(keys, key)) | _summary(len(values), float(values.mean()), paired(values, samples, seed))])

    slim = frame.select(*keys, F.col(order).alias("__order"), F.col(difference).cast("double").alias("d"))
    types = dict(slim.dtypes)
    return slim.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {types[k]}" for k in keys) + ", " + SCHEMA)


def block_sums(frame: DataFrame, keys: list[str], difference: Column, date: str = "match_date") -> DataFrame:
    """(block, total, n): the heavy part, one row per calendar year and ISO week."""
    return frame.withColumn("block", N.iso_block(F.col(date))).groupBy(*keys, "block").agg(F.sum(difference).alias("total"), F.count(F.lit(1)).alias("n"))


def block_bootstrap(blocks: DataFrame, keys: list[str], samples: int = SAMPLES, seed: int = SEED) -> DataFrame:
    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("block")
        total, n = part["total"].to_numpy(float), part["n"].to_numpy(float)
        rng, drawn, each = np.random.default_rng(seed), np.empty(samples), max(1, CHUNK // len(total))
        for a in range(0, samples, each):
            b = min(samples, a + each)
            at = rng.integers(0, len(total), size=(b - a, len(total)))
            drawn[a:b] = total[at].sum(axis=1) / n[at].sum(axis=1)
        return pd.DataFrame([dict(zip(keys, key)) | _summary(int(n.sum()), float(total.sum() / n.sum()), drawn)])

    types = dict(blocks.dtypes)
    return blocks.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {types[k]}" for k in keys) + ", " + SCHEMA)
