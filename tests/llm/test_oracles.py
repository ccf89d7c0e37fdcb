"""The SQL of the queries against the operators, on awkward rows."""

import random

import duckdb
import pytest

from duelspark.llm import near_dups, passages
from duelspark.llm import queries as llm

from .helpers import AWKWARD, frame


@pytest.mark.parametrize(("name", "run"), [("op5_passages", lambda d: passages.repeated_passages(d, with_text=False)), ("op8_near_dups", near_dups.near_duplicates)])
def test_sql_equals_operator(spark, name, run):
    rng = random.Random(3)
    base = ["w%d" % rng.randrange(400) for _ in range(200)]
    texts = [" ".join(base[k : k + 90] if k % 4 else [x if rng.random() > 0.02 else "Z" for x in base[:90]]) for k in range(30)] + [t for _, t in AWKWARD]
    data = list(enumerate(texts))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", data)
    got = run(frame(spark, data))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({llm.ORACLES[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
