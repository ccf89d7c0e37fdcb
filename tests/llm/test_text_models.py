import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from duelspark.llm import lm_mix, quality

from .helpers import AWKWARD, LOWER, frame, words


def documents(n=120, seed=3):
    rng = random.Random(seed)
    good, bad = ["the", "river", "was", "calm", "and", "clear", "today", "we", "walked"], ["buy", "$$$", "now", "click", "###", "win", "free"]
    return [(1000 + k, " ".join(rng.choice(good if k % 3 else bad) for _ in range(rng.randrange(20, 90)))) for k in range(n)]


def test_quality_held_out_accuracy(spark, tmp_path):
    data = documents(400)
    frame(spark, data + AWKWARD).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(d, int((d - 1000) % 3 > 0), 0) for d, _ in data] + [(None, 1, 0), (5, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: r for r in quality.op2_quality(spark, str(tmp_path)).collect()}
    assert len(got) == len(data) + len({d for d, _ in AWKWARD})
    held = [d for d, _ in data if zlib.crc32(str(d).encode()) % 4 == 2]
    assert all(got[d]["held_out"] for d in held) and got[None]["held_out"] is None
    assert np.mean([got[d]["predicted"] == int((d - 1000) % 3 > 0) for d in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())


def test_quality_without_labels(spark):
    docs = frame(spark, documents(5) + AWKWARD)
    weights = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r["quality_score"] for r in quality.score(docs, weights).collect()} == {0.5}
    assert quality.score(docs.limit(0), weights).count() == 0


def test_ftrl_is_sparse_and_learns():
    rows = [(np.array([1, 2 + k % 2, 9]), np.array([1.0, 1.0, 0.01]), k % 2) for k in range(400)]
    w = quality.ftrl(rows, bits=4, epochs=2)
    assert w[2] < 0 < w[3] and w[9] == 0 and w[12] == 0


def test_lm_base_score_and_counts(spark):
    data = documents(150) + AWKWARD
    got = lm_mix.document_scores(frame(spark, data)).collect()
    train = [d is not None and zlib.crc32(str(d).encode()) % 7 != 2 for d, _ in data]
    tokens = [words((t or "").translate(LOWER)) + [None] for _, t in data]
    c = Counter(x for t, ok in zip(tokens, train) if ok for x in t)
    n, v = sum(c.values()), len(c)
    want = sorted((str(d), len(t), sum(c[x] > 0 for x in t), round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t), 6)) for (d, _), t in zip(data, tokens))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {n}
    held = [r for r in got if r["held_out"]]
    assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_lm_without_training_documents(spark):
    got = lm_mix.document_scores(frame(spark, [(None, "a b"), (None, None)])).collect()
    assert len(got) == 2 and all(math.isfinite(r["score"]) and r["n_known"] == 0 for r in got)
    assert lm_mix.document_scores(frame(spark, [(1, "a")]).limit(0)).count() == 0


class Plain:
    """The model by plain loops: one bit at a time, dictionaries for counts, Python floats for weights."""

    def __init__(self, data):
        self.tokens = [[*((w + " ").encode() for w in words((t or "").translate(LOWER))), b"\n"] for _, t in data]
        self.train = [lm_mix.trains(d) for d, _ in data]
        self.units = [list(self.split(t)) for t in self.tokens]
        learnt = b"".join(x for t, ok in zip(self.tokens, self.train) if ok for x in t)
        self.code = lm_mix.Code(np.bincount(np.frombuffer(learnt, np.uint8), minlength=256))
        self.counts = {}
        for units, ok in zip(self.units, self.train):
            for unit in units if ok else ():
                for _, _, bit, cells in self.bits(unit):
                    for c in cells:
                        self.counts.setdefault(c, [0, 0])[bit] += 1

    @staticmethod
    def split(tokens):
        """(bytes, bytes before the word, first scored byte): the head of every token, then the rest of its word."""
        before = b""
        for t in tokens:
            lead = before[-lm_mix.LEAD :]
            yield lead + t[: lm_mix.HEAD], len(lead), len(lead)
            yield t, 0, lm_mix.HEAD
            before += t

    def bits(self, unit):
        flat, lead, skip = unit
        place = np.arange(len(flat))
        found = [c.tolist() for c in lm_mix.contexts(np.frombuffer(flat, np.uint8), place, place - lead)]
        for i in range(skip, len(flat)):
            byte = flat[i]
            for depth, step in enumerate(self.code.steps[self.code.at[byte] : self.code.at[byte] + self.code.length[byte]].tolist()):
                node, bit = divmod(step, 2)
                cells = [(k, (c[i] + int(lm_mix._NODE[node])) % lm_mix.SIZES[k]) for k, c in enumerate(found)]
                yield min(depth, 2) + (3 if skip == lead else 0), i, bit, cells

    def odds(self, cell, bit, own):
        n0, n1 = self.counts.get(cell, [0, 0])
        raw = lambda a, b: math.log((b + lm_mix.PRIOR) / (a + lm_mix.PRIOR))
        if n0 + n1 > lm_mix.EXACT:
            step = 2 * lm_mix.LIMIT / (255 - lm_mix._SMALL)
            return round((max(-lm_mix.LIMIT, min(lm_mix.LIMIT, raw(n0, n1))) + lm_mix.LIMIT) / step) * step - lm_mix.LIMIT
        return raw(n0 - (own and bit == 0), n1 - (own and bit == 1))

    def score(self, unit, own, weights):
        total = 0.0
        for gate, _, bit, cells in self.bits(unit):
            z = sum(w * self.odds(c, bit, own) for w, c in zip(weights[gate], cells))
            p = max(lm_mix.LEAST_P, min(1 - lm_mix.LEAST_P, 1 / (1 + math.exp(-max(-lm_mix.LIMIT, min(lm_mix.LIMIT, z))))))
            total += math.log10(p if bit else 1 - p)
        return total

    def document(self, k, weights):
        """Sum over the tokens, each refined by the document's own words and pairs so far."""
        total, seen, follow, again, tries, hits = 0.0, Counter(), {}, 0, 0, 0
        for i, token in enumerate(self.tokens[k]):
            p = 10 ** sum(self.score(u, self.train[k], weights) for u in self.units[k][2 * i : 2 * i + 2])
            gate = lm_mix.SHARE * again / (i + lm_mix.SHOWN)
            p = (1 - gate) * p + gate * seen[token] / max(i, 1)
            after = follow.setdefault(self.tokens[k][i - 1], Counter()) if i else Counter()
            if after:
                gate = hits / (tries + lm_mix.PAIRS_SHOWN)
                p = (1 - gate) * p + gate * after[token] / sum(after.values())
            total += math.log10(p)
            again += seen[token] > 0
            tries += bool(after)
            hits += after[token] > 0
            seen[token] += 1
            after[token] += 1
        return total


def lm_corpus():
    rng = random.Random(12)
    data = [(d, t[: rng.randrange(20, 260)]) for d, t in documents(40)] + [(7, None), (8, "é ü ß same same"), (None, "the river was calm and clear"), (9, "x" * 150 + " the river " + "y" * 90 + " was")]
    return data + [(500 + k, "One passage that several documents hold, word for word, to the end") for k in range(4)]


def test_lm_score_equals_a_plain_loop_over_bits(spark, monkeypatch):
    data = lm_corpus()
    plain = Plain(data)
    weights = [[0.1 + 0.05 * gate + 0.03 * k for k in range(lm_mix.ORDERS)] for gate in range(lm_mix.GATES)]
    model = np.concatenate([np.array(weights).ravel(), np.zeros(lm_mix.GATES * lm_mix.MAP_CELLS)]).tobytes()
    monkeypatch.setattr(lm_mix, "learnt", lambda *_: model)
    want = {d: (plain.document(k, weights), t) for k, (d, t) in enumerate(data)}
    got = lm_mix.document_scores(frame(spark, data, 5)).collect()
    assert len(got) == len(data)
    for r in got:
        score, text = want[r["doc_id"]]
        assert r["score"] == pytest.approx(score, rel=1e-4, abs=1e-3), r["doc_id"]
        size = len((text or "").encode())
        assert r["bits_per_byte"] == (pytest.approx(-score / math.log10(2) / size, rel=1e-3) if size else None)


def test_lm_learning_equals_a_plain_loop(monkeypatch):
    monkeypatch.setattr(lm_mix, "BATCH_BYTES", 40)
    plain = Plain(lm_corpus())
    stream = np.frombuffer(b"".join(b"".join(t) for t, ok in zip(plain.tokens, plain.train) if ok), np.uint8)
    heads, head, _, _, _ = lm_mix.units_of(stream, np.flatnonzero(stream == lm_mix.END) + 1)
    tables = [np.full(size, lm_mix.state(np.zeros(1), np.zeros(1))[0]) for size in lm_mix.SIZES]
    for (order, at), (n0, n1) in plain.counts.items():
        tables[order][at] = lm_mix.state(np.array([n0]), np.array([n1]))[0]
    often = np.bincount(head)
    mixer = lm_mix.Mixer(tables, plain.code)
    mixer.learn(heads, often)
    weights, curve = np.full((lm_mix.GATES, lm_mix.ORDERS), lm_mix.WEIGHT), np.zeros(lm_mix.GATES)
    miss, used = np.zeros((lm_mix.GATES, lm_mix.MAP_CELLS)), np.zeros((lm_mix.GATES, lm_mix.MAP_CELLS))
    units, size, batch, batches = heads.array().to_pylist(), 0, [], []
    for k, u in enumerate(units):
        batch.append((u[1:], u[0], u[0], often[k]))
        if size // 40 != (size + len(u) - 1) // 40:  # a batch ends with the unit that reaches a multiple of its bytes
            batches.append(batch)
            batch = []
        size += len(u) - 1
    for batch in [*batches, batch]:
        for gate in range(lm_mix.GATES):
            gradient, bend, news = np.zeros(lm_mix.ORDERS), 0.0, []
            for *unit, n in batch:
                for g, _, bit, cells in plain.bits(unit):
                    if g == gate:
                        x = np.array([plain.odds(c, bit, True) for c in cells])
                        z = max(-lm_mix.LIMIT, min(lm_mix.LIMIT, float(x @ weights[gate])))
                        p = 1 / (1 + math.exp(-z))
                        gradient += (bit - p) * x * n
                        bend += p * (1 - p) * n * float(x @ x)
                        news.append((int((z + lm_mix.LIMIT) * (lm_mix.MAP_CELLS - 1) / (2 * lm_mix.LIMIT)), (bit - p) * n, n))
            for cell, error, n in news:
                miss[gate, cell] += error
                used[gate, cell] += n
            curve[gate] += bend
            weights[gate] += gradient / (lm_mix.DAMPING + lm_mix.CURVATURE * curve[gate])
    assert mixer.weights == pytest.approx(weights, rel=1e-3, abs=1e-4) and not (mixer.weights[3:] == np.float32(lm_mix.WEIGHT)).any()
    assert mixer.map[3:].sum(1) == pytest.approx((miss / (used + lm_mix.MAP_PRIOR))[3:].sum(1), abs=2e-2)


def test_lm_scores_do_not_depend_on_partitions(spark, monkeypatch):
    data = documents(60) + [(5, "long " * 3000 + "z" * 40000 + " end"), (6, None)]
    once = {r["doc_id"]: r["score"] for r in lm_mix.document_scores(frame(spark, data, 1)).collect()}
    monkeypatch.setattr(lm_mix, "CHUNK_BYTES", 2000)
    again = {r["doc_id"]: r["score"] for r in lm_mix.document_scores(frame(spark, data, 7)).collect()}
    assert again == pytest.approx(once, rel=1e-6)


def test_lm_document_seen_elsewhere_costs_less(spark):
    rng = random.Random(2)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(80))
    data = [(k, text()) for k in range(80)]
    twice = [k for k in range(80) if lm_mix.trains(k)][:5]
    data += [(100 + k, data[k][1]) for k in twice]
    bits = {r["doc_id"]: r["bits_per_byte"] for r in lm_mix.document_scores(frame(spark, data)).collect()}
    once = [bits[k] for k in range(80) if k not in twice and lm_mix.trains(k)]
    assert np.mean([bits[k] for k in twice]) < np.mean(once) - 2 * np.std(once)


def test_lm_code_is_complete():
    """The bits of all bytes form a full binary tree, so the probabilities of a next byte sum to one."""
    code = lm_mix.Code(np.array([k * k % 97 for k in range(256)]))
    assert sum(2.0 ** -int(n) for n in code.length) == 1
    place, depth, node, bit = code.bits(np.arange(256, dtype=np.uint8))
    assert len({(n, b) for n, b in zip(node.tolist(), bit.tolist())}) == 510 and (depth[np.diff(place, prepend=-1) > 0] == 0).all()


def test_lm_states_keep_small_counts():
    for n0 in range(lm_mix.EXACT + 1):
        for n1 in range(lm_mix.EXACT + 1 - n0):
            s = lm_mix.state(np.array([n0]), np.array([n1]))[0]
            for row, (a, b) in enumerate(((n0, n1), (max(0, n0 - 1), n1), (n0, max(0, n1 - 1)))):
                assert lm_mix.ODDS[row, s] == pytest.approx(math.log((b + 0.4) / (a + 0.4)), rel=1e-6)


def test_ftrl_equals_a_plain_loop():
    rng = random.Random(5)
    rows = [(np.array(sorted(rng.sample(range(16), 4))), np.array([rng.random() + 0.1 for _ in range(4)]), rng.randrange(2)) for _ in range(60)]
    z, n = [0.0] * 16, [0.0] * 16
    weight = lambda k: 0.0 if abs(z[k]) <= quality.L1 else (math.copysign(quality.L1, z[k]) - z[k]) / ((quality.BETA + math.sqrt(n[k])) / quality.ALPHA + quality.L2)
    order = np.random.default_rng(7)
    for _ in range(3):
        for k in order.permutation(len(rows)):
            slots, x, label = rows[k]
            w = [weight(s) for s in slots.tolist()]
            p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x.tolist()))))
            for s, v, a in zip(slots.tolist(), x.tolist(), w):
                g = (p - label) * v
                z[s] += g - (math.sqrt(n[s] + g * g) - math.sqrt(n[s])) / quality.ALPHA * a
                n[s] += g * g
    assert quality.ftrl(rows, bits=4, epochs=3) == pytest.approx([weight(k) for k in range(16)], rel=1e-5, abs=1e-7)


def test_quality_scores_equal_plain_sums(spark, tmp_path):
    """A score is the logistic of the weights of a text's words, word pairs and shape marks."""
    from xxhash import xxh3_64_intdigest

    from duelspark.llm.common import windows

    data = documents(60) + AWKWARD
    labels = [(d, int((d - 1000) % 3 > 0)) for d, _ in data[:60]]
    weights = quality.train(frame(spark, data), spark.createDataFrame(labels, "doc_id long, quality int"))
    table = np.frombuffer(zlib.decompress(weights), np.float32)
    got = {(r["doc_id"], r["text"]): r["quality_score"] for r in quality.score(frame(spark, data), weights).collect()}
    marks = {}  # the shape marks of each text, as the operator itself gives them
    import pyarrow as pa

    for slots, x, ends in quality.features(pa.array([t or "" for _, t in data])):
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            marks[len(marks)] = (slots[a:b], x[a:b])
    for k, (d, t) in enumerate(data):
        hashes = [xxh3_64_intdigest(w.translate(LOWER).encode()) for w in words(t)]
        pairs = windows(np.array(hashes, np.uint64), 2, quality._PAIR_BASE).tolist()
        grams = [h & ((1 << quality.BITS) - 1) for h in [*hashes, *pairs]]
        slots, x = marks[k]
        assert slots[: len(grams)].tolist() == grams and x[: len(grams)].tolist() == [1 / max(1, len(grams)) ** 0.5] * len(grams)
        total = sum(float(table[g]) for g in grams) / max(1, len(grams)) ** 0.5 + sum(float(table[s]) for s in slots[len(grams) :].tolist())
        assert got[d, t] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-5)
