"""The match view: contests derived from ``orders`` by arithmetic that any SQL engine repeats exactly.

One template serves both engines; only the hash function's name differs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_VIEW = """
SELECT substr({sha}, 1, 24) AS match_id, o_orderkey AS k,
  cast(o_orderdate AS date) AS match_date,
  {day} AS day,
  CASE o_orderkey % 3 WHEN 0 THEN 'Hard' WHEN 1 THEN 'Clay' ELSE 'Grass' END AS surface,
  concat('event ', cast(o_orderkey % 40 AS string)) AS tournament,
  CASE o_orderkey % 5 WHEN 0 THEN 'F' WHEN 1 THEN 'SF' WHEN 2 THEN 'QF' WHEN 3 THEN 'R16' ELSE 'R32' END AS round,
  concat('p', cast(1000 + least(o_custkey % 120, (o_orderkey * 7 + 3) % 120) AS string)) AS player_1,
  concat('p', cast(1000 + greatest(o_custkey % 120, (o_orderkey * 7 + 3) % 120) AS string)) AS player_2,
  cast(floor(o_totalprice) AS bigint) % 2 = 0 AS player_1_won,
  o_orderkey % 50 = 0 AS is_retirement,
  CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE cast(1 + o_custkey % 300 AS bigint) END AS rank_1,
  cast(1 + o_orderkey % 280 AS bigint) AS rank_2,
  cast(CASE WHEN o_orderkey % 4 = 0 THEN 5 ELSE 3 END AS bigint) AS best_of,
  CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE round(cast(1.2 AS double) + (o_orderkey % 37) * cast(0.1 AS double), 8) END AS odds_1,
  CASE WHEN o_orderkey % 43 = 0 THEN cast(1.0 AS double) ELSE round(cast(1.2 AS double) + ((o_orderkey * 5) % 37) * cast(0.1 AS double), 8) END AS odds_2,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE round(cast(1.25 AS double) + ((o_orderkey * 3) % 41) * cast(0.08 AS double), 8) END AS ps_1,
  round(cast(1.22 AS double) + ((o_orderkey * 11) % 43) * cast(0.07 AS double), 8) AS ps_2,
  round(cast(1.21 AS double) + ((o_orderkey * 13) % 31) * cast(0.11 AS double), 8) AS avg_1,
  round(cast(1.23 AS double) + ((o_orderkey * 19) % 33) * cast(0.09 AS double), 8) AS avg_2,
  CASE o_orderkey % 3 WHEN 0 THEN 'B365' WHEN 1 THEN 'Average' ELSE 'Missing' END AS odds_source,
  round(cast(0.02 AS double) + (o_orderkey % 97) * cast(0.01 AS double), 8) AS p_model,
  extract(year FROM o_orderdate) AS year,
  CASE WHEN extract(year FROM o_orderdate) <= 1997 THEN 'train' WHEN extract(year FROM o_orderdate) = 1998 THEN 'validation' ELSE 'test' END AS part
FROM orders WHERE o_custkey % 120 <> (o_orderkey * 7 + 3) % 120
"""

SPARK_VIEW = _VIEW.format(sha="sha2(cast(o_orderkey AS string), 256)", day="unix_date(cast(o_orderdate AS date))")
DUCK_VIEW = _VIEW.format(sha="sha256(cast(o_orderkey AS varchar))", day="cast(cast(o_orderdate AS date) - date '1970-01-01' AS bigint)")


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return spark.sql(SPARK_VIEW.replace("FROM orders", "FROM {orders}"), orders=orders)


def duck(sql: str) -> str:
    """A DuckDB query over the view ``mv``."""
    return f"WITH mv AS ({DUCK_VIEW}) {sql}" if not sql.lstrip().upper().startswith("WITH ") else f"WITH mv AS ({DUCK_VIEW}), {sql.lstrip()[5:]}"
