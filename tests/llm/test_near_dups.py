import random

import numpy as np
import pytest

from duelspark.llm import near_dups

from .helpers import AWKWARD, LOWER, frame, words


def shingles(text):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = {d: d for d, _ in rows if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j in range(i):
            b = rows[j][0]
            if a is None or b is None or not sets[i] or not sets[j]:
                continue
            inside = len(sets[i] & sets[j])
            if 100 * inside >= 75 * (len(sets[i]) + len(sets[j]) - inside):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return sorted([(d, len(s), root(d) if d is not None else None, d is None or root(d) == d) for (d, _), s in zip(rows, sets)], key=str)


def edited(rng, w, share):
    return [("z%d" % rng.randrange(10**6) if rng.random() < share else x) for x in w]


def groups(seed, hubs=3, copies=30):
    """Hubs with edited copies that are alike the hub, but often not alike each other; ids are dealt at random."""
    rng = random.Random(seed)
    texts = []
    for h in range(hubs):
        hub = ["w%d" % rng.randrange(3000) for _ in range(150)]
        texts += [" ".join(hub)] + [" ".join(edited(rng, hub, rng.choice([0.01, 0.03, 0.035, 0.05, 0.2]))) for _ in range(copies)] + [" ".join(hub).upper()] * 3
    ids = rng.sample(range(100, 5000), len(texts))
    return list(zip(ids, texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    data = groups(seed) + AWKWARD
    got = near_dups.near_duplicates(frame(spark, data)).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(data)


def test_blocks_and_dense_buckets(spark, monkeypatch):
    """Many copies of a hub that isn't there itself: most pairs lie just below the threshold."""
    monkeypatch.setattr(near_dups, "BLOCK", 16)
    rng = random.Random(9)
    hub = ["w%d" % rng.randrange(3000) for _ in range(150)]
    data = [(500 - k, " ".join(edited(rng, hub, rng.choice([0.01, 0.025, 0.03, 0.04])))) for k in range(70)]
    got = near_dups.near_duplicates(frame(spark, data)).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(data)


def test_long_chain_is_one_component(spark):
    rng = random.Random(5)
    w = ["c%d" % k for k in range(120)]
    data = []
    for k in range(40):  # each text drops a word and gains one: neighbours are linked, the ends are not
        data.append((1000 - k, " ".join(w)))
        w = w[3:] + ["n%d" % rng.randrange(10**6) for _ in range(3)]
    assert {r["component_id"] for r in near_dups.near_duplicates(frame(spark, data)).collect()} == {961}


def test_dedup_and_empty(spark):
    docs = frame(spark, groups(4, 2, 5) + AWKWARD)
    out = near_dups.dedup(docs)
    assert out.columns == docs.columns
    kept = near_dups.near_duplicates(docs).filter("kept").count()
    assert out.count() == kept
    assert near_dups.near_duplicates(docs.limit(0)).count() == 0


def test_sketch_fills_every_bin_and_estimates():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 400).astype(np.uint64)
    near = np.concatenate([base[:343], rng.integers(0, 2**63, 57).astype(np.uint64)])  # Jaccard 0.75
    one = base[:1]
    table = near_dups.sketches(np.concatenate([base, near, one]), np.array([0, 400, 800, 801]))
    assert (table != near_dups._NONE).all()
    assert near_dups.LEAST_EQUAL <= (table[0] == table[1]).sum() <= 115
