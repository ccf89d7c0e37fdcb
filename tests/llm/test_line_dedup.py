import hashlib
import random

import duckdb
import pytest

from duelspark.llm import line_dedup

from .helpers import AWKWARD, LOWER, frame


def brute(rows, least=10):
    owner, holders = {}, {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            k = line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
            if d is not None and len(k) >= least:
                owner[k] = min(owner.get(k, d), d)
                holders.setdefault(k, set()).add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        keys = [x.strip(" \t\n\x0b\x0c\r").translate(LOWER) for x in lines]
        kept = [x for x, k in zip(lines, keys) if d is None or len(k) < least or len(holders[k]) < 2 or owner[k] == d]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def rows(seed):
    rng = random.Random(seed)
    pool = [f"Shared line number {k}  " for k in range(6)] + ["short", "", "UPPER case line here", "upper CASE line here\t"]
    return [(rng.randrange(40), "\n".join(rng.choice(pool) for _ in range(rng.randrange(9)))) for _ in range(60)] + AWKWARD


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    data = rows(seed)
    got = line_dedup.line_digest(frame(spark, data)).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(data)


def test_hot_line_over_many_partitions(spark):
    data = [(k, "the very same hot line\nown line %d of mine" % k) for k in range(400)]
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.line_digest(frame(spark, data)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert got[0] == 0 and all(got[k] == 1 for k in range(1, 400))


def test_dedup_keeps_columns_and_empty_table(spark):
    docs = frame(spark, rows(3))
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert line_dedup.line_digest(docs.limit(0)).count() == 0


def test_oracle_sql(spark):
    data = [(k, t) for k, (_, t) in enumerate(rows(4))]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", data)
    want = sorted(con.execute("SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM (" + line_dedup.ORACLE_SQL + ")").fetchall())
    assert sorted(tuple(r) for r in line_dedup.line_digest(frame(spark, data)).collect()) == want
