import hashlib
import random
import re
import unicodedata
from collections import Counter

import pytest

from duelspark.llm import decontaminate, exact_digest, licenses, passages

from .helpers import AWKWARD, LOWER, frame, words


def test_passages_match_brute_force(spark):
    rng = random.Random(2)
    base = [["w%d" % rng.randrange(500) for _ in range(90)] for _ in range(4)] + [["same"] * 200, ["a", "b"] * 60]
    data = [(k, " ".join(sum((b[rng.randrange(20) : rng.randrange(40, 90)] for b in rng.sample(base, 2)), ["x%d" % rng.randrange(99)]))) for k in range(60)] + AWKWARD
    seen = Counter(tuple(w[i : i + 35]) for _, t in data for w in [words(t)] for i in range(len(w) - 34))
    want = []
    for d, t in data:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    docs = frame(spark, data)
    assert sorted(map(str, (tuple(r) for r in passages.repeated_passages(docs).collect()))) == sorted(map(str, want))
    assert passages.repeated_passages(docs.limit(0)).count() == 0


def distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(4)
    items = [(k, " ".join("".join(rng.choice("aeiotnsr") for _ in range(rng.randrange(2, 8))) for _ in range(18))) for k in range(6)] + [(6, None), (7, "?!"), (8, items_short := "Tiny Item")]
    data = list(AWKWARD)
    for k in range(40):
        text = list(rng.choice(items[:6])[1])
        for _ in range(rng.randrange(14)):
            text[rng.randrange(len(text))] = rng.choice(["", "q", "zz", "e"])
        data.append((100 + k, "Before it, " + "".join(text).upper() + " -- after"))
    data += [(300, "clean text of no interest"), (301, "a tiny item!"), (302, None), (303, "botany itemised"), (304, "no, TINY   ITEM, yes")]
    want = set()
    for d, t in data:
        body = decontaminate.normalised(t or "")
        for i, x in items:
            item = decontaminate.normalised(x or "")
            edits = int(decontaminate.ERROR_RATE * len(item))
            if item and distance(item, body) <= edits and (edits or f" {item} " in f" {body} "):
                want.add((d, i, distance(item, body)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, data)
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.matches(docs, bench).collect()} == want
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.matches(docs, bench, block_chars=150).collect()} == want
    flagged = {d for d, _, _ in want}
    kept = decontaminate.decontaminate(docs, bench, block_chars=200)
    assert kept.columns == docs.columns and kept.count() == sum(d not in flagged for d, _ in data)
    assert decontaminate.matches(docs, bench.limit(0)).count() == 0 and items_short
    assert decontaminate.matches(docs.limit(0), bench).count() == 0 and decontaminate.decontaminate(docs.limit(0), bench).count() == 0


def test_decontamination_at_both_ends_of_a_text():
    rng = random.Random(14)
    item = decontaminate.normalised("The item, " + " ".join("".join(rng.choice("aeiotnsr") for _ in range(rng.randrange(2, 8))) for _ in range(20)))
    edits = int(decontaminate.ERROR_RATE * len(item))
    matcher = decontaminate.Matcher([(1, item)])
    found = 0
    for gone in range(edits + 3):
        for body in (item[gone:], item[gone:] + " and more after it", item[: len(item) - gone], "some before " + item[: len(item) - gone], "x" + item[gone:]):
            least = distance(item, decontaminate.normalised(body))
            assert [(i, d) for i, d, _ in matcher.find(body)] == ([(1, least)] if least <= edits else []), (gone, body)
            found += least <= edits
    assert found >= 5 * edits


def test_licenses_base_places(spark):
    rng = random.Random(6)
    parts = ["GNU General-Public License", "apache, license", "CC BY", "cc-by-nc 4.0", "MIT License", "MIT Licensees", "plain", "é", "ccby", "All rights reserved"]
    data = [(k, " ".join(rng.choice(parts) for _ in range(rng.randrange(7)))) for k in range(80)] + AWKWARD
    want = []
    for d, t in data:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        found = [(i, label) for p, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        at = sorted(i for i, _ in found)
        want.append((d, len(w), len(found), at[0] if at else None, at[-1] if at else None, ",".join(sorted({x for _, x in found}))))
    rows = licenses.scan_licenses(frame(spark, data)).collect()
    assert sorted(map(str, (tuple(r)[:6] for r in rows))) == sorted(map(str, want))
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in rows)
    assert licenses.scan_licenses(frame(spark, data).limit(0)).count() == 0


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("licensed under the MIT License.", ["mit"]),
        ("SPDX-License-Identifier: GPL-3.0", ["gpl"]),
        ("CC BY-NC-ND 4.0", ["cc-by-nc-nd"]),
        ("GNU Lesser General Public License v2.1", ["lgpl"]),
        ("Creative Commons Attribution-ShareAlike 4.0", ["cc-by-sa"]),
        ("dedicated to the public domain", ["public-domain"]),
        ("nothing here", []),
    ],
)
def test_license_suppression(text, labels):
    assert len(licenses.RULES) >= 240 and len({x.split('|', 4)[4] for x in licenses.SIGNATURES.strip().splitlines()}) == len(licenses.RULES)
    assert [r.label for _, _, r in licenses.detections(text.lower().encode())] == labels


def spelled_out(pattern):
    """A text that the pattern of a signature accepts: first alternatives, all options, no version."""
    text = pattern.replace(" V", "").replace(".{1,80}?", "them").replace("v?", "v").replace(" ?", "").replace(r"\?", "")
    while "(?:" in text:
        text = re.sub(r"\(\?:([^()|]*)[^()]*\)\??", r"\1", text)
    return re.sub(r"\[(.)[^]]*\]\+?", r"\1", text).replace("?", "")


def plain_detections(lowered):
    """Every rule everywhere, then suppression pair by pair."""
    found = [(m.start(), m.end(), r) for r in licenses.RULES for m in r.pattern.finditer(lowered)]
    kept = []
    for a, b, r in sorted(found, key=lambda x: (-x[2].priority, x[0] - x[1], x[0])):
        if not any(a < d and c < b for c, d, _ in kept):
            kept.append((a, b, r))
    return sorted(kept, key=lambda x: x[:2])


@pytest.mark.parametrize("gap", [" ", "\n", "  ", "-", " -\r\n\t", "\n * "])
def test_license_rules_accept_any_gap(gap):
    for line in licenses.SIGNATURES.strip().splitlines():
        label, priority, _, keywords, pattern = licenses.fields(line)
        text = gap.join(f"some {spelled_out(pattern)} here".split()).encode()
        rule = next(r for r in licenses.RULES if r.label == label and r.priority == int(priority) and r.pattern.search(text))
        assert rule and any(k.strip().encode() in licenses.folded(text) for k in keywords.split(",")), (line, text)
        kept = licenses.detections(text)
        assert kept and kept == plain_detections(text), (line, text)


def test_license_detections_match_brute_force(spark):
    rng = random.Random(21)
    every = [spelled_out(licenses.fields(x)[4]) for x in licenses.SIGNATURES.strip().splitlines()]
    data = list(AWKWARD)
    for k in range(60):
        parts = [w for _ in range(rng.randrange(1, 7)) for w in [*rng.choice(every).split(), "and"][: rng.randrange(1, 30)]]
        data.append((100 + k, "".join(w.upper() + rng.choice([" ", "\n", " -- ", "  "]) if rng.random() < 0.2 else w + rng.choice([" ", "\n", "-"]) for w in parts)))
    got = {r["doc_id"]: r for r in licenses.scan_licenses(frame(spark, data)).collect() if r["doc_id"] is not None and r["doc_id"] > 99}
    for d, text in data[len(AWKWARD) :]:
        kept = plain_detections(text.lower().encode())
        base = {label for phrase, label in licenses.BASE.items() if re.search(r"(?<![0-9a-z])" + "[^0-9a-z]+".join(phrase.split()) + r"(?![0-9a-z])", text.lower())}
        assert got[d]["labels"] == ",".join(sorted(base | {r.label for _, _, r in kept}))
        rest = 1.0
        for _, _, r in kept:
            rest *= 1 - r.confidence
        assert got[d]["score"] == pytest.approx(1 - rest if kept else 0.5 if base else 0.0)


def test_wrapped_licenses_get_labels(spark):
    data = ["GNU Lesser General\nPublic License v2.1", "dedicated to the public\ndomain", "All\nrights reserved", "All rights\nreserved", "Permission is hereby\n  granted, free of charge, to any person obtaining a copy", "use in source\nRedistribution and use in source and binary\n * forms", "Zero-Clause BSD"]
    rows = {r["doc_id"]: r for r in licenses.scan_licenses(frame(spark, list(enumerate(data)))).collect()}
    assert [rows[k]["labels"] for k in range(len(data))] == ["lgpl", "public-domain", "proprietary", "proprietary", "mit", "bsd", "0bsd"]
    assert all(r["score"] > 0 for r in rows.values())


def canonical(text):
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text or "").casefold())).strip()


def test_exact_digest(spark, tmp_path):
    data = [(k, t) for k, t in enumerate(["Café  AU lait", "café au LAIT", "ﬁne", "fine", "straße", "STRASSE", None, "", "x" * 999, "tail"] * 3)]
    frame(spark, data).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in exact_digest.op9_exact_digest(spark, str(tmp_path)).collect()}
    texts = [t or "" for _, t in data]
    for k, t in enumerate(texts):
        following = texts[k - 1]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + following[:cut]
        assert rows[k]["n_chars"] == len(t)
        assert rows[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert rows[k]["near_edited"] == float(canonical(edited) == canonical(t))
        assert rows[k]["near_next"] == float(canonical(following) == canonical(t))
        for j in range(len(texts)):
            assert (rows[k]["fingerprint"] == rows[j]["fingerprint"]) == (canonical(t) == canonical(texts[j]))
    groups = {r["doc_id"]: r["group_id"] for r in exact_digest.exact_groups(frame(spark, data)).collect()}
    assert groups[1] == 0 and groups[13] == 2 and groups[5] == 4


@pytest.mark.parametrize("far", [0, 10**15])
def test_exact_digest_runs_and_ids(spark, monkeypatch, far):
    monkeypatch.setattr(exact_digest, "RUNS", 5)
    data = [(k * 17 % 1009 * 10**6 + far * (k == 7), "t%d" % k * 5) for k in range(50)] + [(None, "n"), (None, None)]
    rows = exact_digest.digest_report(frame(spark, data)).collect()
    ordered = sorted((d for d, _ in data if d is not None), reverse=True)
    by = {d: t for d, t in data}
    for r in rows:
        if r["doc_id"] is not None and r["doc_id"] != ordered[-1]:
            t, following = by[r["doc_id"]], by[ordered[ordered.index(r["doc_id"]) + 1]]
            cut = len(t) // 3
            assert r["edited_sha256"] == hashlib.sha256((t[: len(t) - cut] + following[:cut]).encode()).hexdigest()
    assert len(rows) == 52
    assert exact_digest.digest_report(frame(spark, data).limit(0)).count() == 0


def test_colliding_digests_get_ranks(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_digest, "digest", lambda canon: F.lpad(F.length(canon).cast("string"), 32, "0"))
    docs = frame(spark, [(1, "ab"), (2, "cd"), (3, "AB"), (4, "xyz")])
    groups = {r["doc_id"]: r["group_id"] for r in exact_digest.exact_groups(docs).collect()}
    assert groups == {1: 1, 2: 2, 3: 1, 4: 4}


def test_exact_digest_of_awkward_rows(spark):
    """Very long texts, equal ids with different texts, clashing columns, a digest that most rows share."""
    data = AWKWARD + [(9, "another text of the same id"), (9, "word " * 4000), (11, "Ä" * 300_000)] + [(1000 + k, "Shared  TEXT") for k in range(2500)]
    docs = frame(spark, data).withColumnRenamed("h1", "fingerprint").withColumnRenamed("pos", "digest").withColumnRenamed("chunk", "canon")
    got = exact_digest.digest_report(docs).collect()
    ordered = sorted(data, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = []
    for k, (d, t) in enumerate(ordered):
        t, following = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + following[:cut]
        want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), float(canonical(edited) == canonical(t)), float(canonical(following) == canonical(t))))
    assert sorted(map(str, ((r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in got))) == sorted(map(str, want))
    texts = {}
    for r in exact_digest.exact_groups(docs.select("doc_id", "text")).collect():
        texts.setdefault(r["fingerprint"], set()).add(canonical(r["text"]))
    assert all(len(x) == 1 for x in texts.values()) and len(texts) == len({canonical(t) for _, t in data})


def test_canonical_form_is_closed(spark):
    forms = ["ͅα", "ΐ", "ﬃ", "\u0345\u0301", "Å", "e\u0301", "ẞß"]
    rows = spark.createDataFrame([(x,) for x in forms], "text string").select("text", exact_digest.canonical(exact_digest.F.col("text")).alias("once"))
    again = rows.select("once", exact_digest.canonical(exact_digest.F.col("once")).alias("twice")).collect()
    assert all(r["once"] == r["twice"] for r in again)
