"""Words whose polynomial hashes modulo 2**64 are equal for every base must stay apart everywhere."""

import numpy as np
import pytest

from duelspark.llm import lm_mix, near_dups, passages
from duelspark.llm.common import Words

from .helpers import frame


def thue_morse(n):
    return "".join("ab"[bin(k).count("1") % 2] for k in range(n)), "".join("ba"[bin(k).count("1") % 2] for k in range(n))


@pytest.mark.parametrize("size", [1024, 4096])
def test_thue_morse_words_stay_apart(spark, size):
    one, other = thue_morse(size)
    rows = near_dups.near_duplicates(frame(spark, [(1, one), (2, other)])).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in rows) == [(1, 1, True), (2, 2, True)]
    texts = [" ".join([word, *(f"w{k}" for k in range(17))] * 2 + [word]) for word in (one, other)]
    removed = {r["doc_id"]: r["n_removed"] for r in passages.repeated_passages(frame(spark, list(enumerate(texts)))).collect()}
    assert removed == {0: 0, 1: 0}
    train = [k for k in range(50) if lm_mix.trains(k)][0]
    held = [k for k in range(50) if not lm_mix.trains(k)][0]
    scored = {r["doc_id"]: r["n_known"] for r in lm_mix.document_scores(frame(spark, [(train, one), (held, other)])).collect()}
    assert scored == {train: 2, held: 1}  # the end token is known, the other word isn't


def test_distinct_words_by_bytes():
    data = np.frombuffer("Ab ab\tAB éc".encode() + b"ab", np.uint8)
    words = Words(data, np.array([0, 12, 14]))
    spelled, number = words.distinct(lower=True)
    assert [spelled[k].as_py() for k in number.tolist()] == [b"ab", b"ab", b"ab", "éc".encode(), b"ab"]
    assert len(set(words.hashes(lower=True).tolist())) == 2 and len(set(words.hashes().tolist())) == 4
