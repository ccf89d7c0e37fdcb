"""Bundles of results: each table to Parquet, JSON or CSV by its name's suffix; file hashes for lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_bundle(tables: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """name.parquet, name.json or name.csv -> path written."""
    written = {}
    for name, frame in tables.items():
        path, kind = f"{folder.rstrip('/')}/{name}", name.rsplit(".", 1)[-1]
        writer = frame.write.mode("overwrite")
        if kind == "csv":
            nested = [c for c, t in frame.dtypes if t.startswith(("map", "array", "struct"))]
            frame.withColumns({c: F.to_json(c) for c in nested}).write.mode("overwrite").csv(path, header=True)
        elif kind == "json":
            writer.json(path, ignoreNullFields=False)
        else:
            writer.parquet(path)
        written[name] = path
    return written


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of every file below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def histogram(frame: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Plot data: counts of equal-width bins, outer values in the outer bins."""
    place = F.floor((F.col(column) - low) / ((high - low) / bins))
    return frame.filter(F.col(column).isNotNull()).groupBy(F.least(F.greatest(place, F.lit(0)), F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
