import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from duelspark.llm import bpe_text, token_files
from duelspark.llm.rans import Table, decode_block, encode_block
from duelspark.llm.vocab import ByteBpe, tokenizer_json

from .helpers import AWKWARD, frame

BYTES, WORDS = "byte_bpe_50k.json", "word_bpe_49k.json"
ODD = ["<|endoftext|> a", "don't we'll 'S", "ﬁ É İI ŉ ſ", "\x1c x\x85y z", "１２3", "a" * 3000, "x́y", "🙂🙂 ok", "  a\n\n b \t", " \n x  ", "ÀÉ tHe²³"]


def library(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_truncation()
    t.no_padding()
    return t


def test_rans_round_trip_and_partial_decoding():
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 17, 600, 5000, 70_001, 1 << 20, (1 << 20) + 12_345):
        tokens = np.minimum(rng.geometric(0.01, n) * 7, 50_000).astype(np.uint32)
        symbols, counts = np.unique(tokens, return_counts=True)
        table = Table.loads(Table.of(symbols, counts).dumps())
        block = encode_block(tokens, table)
        assert (decode_block(block, table) == tokens).all()
        if n < 5000:
            continue
        parts, k = [], 0
        while len(part := decode_block(block, table, k, 1)):  # each part alone, from its own checkpoint
            parts.append(part)
            k += 1
        assert len(parts) >= 16 and (np.concatenate(parts) == tokens).all()
        assert (decode_block(block, table, 3, 2) == np.concatenate(parts[3:5])).all()
        bad = bytearray(block)
        bad[-3] ^= 1  # near the end: the parts before can still be read
        with pytest.raises(ValueError, match="checksum"):
            decode_block(bytes(bad), table)
        assert (decode_block(bytes(bad), table, 0, len(parts) - 2) == np.concatenate(parts[:-2])).all()
    with pytest.raises(ValueError, match="table"):
        encode_block(np.array([4], np.uint32), Table.of(np.array([1]), np.array([1])))


def test_table_keeps_every_symbol():
    table = Table.of(np.arange(50_000), np.array([10**9] + [1] * 49_999))
    assert table.freqs.min() >= 1 and int(table.freqs.sum()) == 1 << table.scale


def test_token_files_match_the_library(spark, tmp_path):
    """Written by one call, decoded from the folder alone."""
    rng = random.Random(1)
    data = AWKWARD + [(100 - k, x) for k, x in enumerate(ODD)] + [(200 + k, " ".join(rng.choice(["the", "Of", "naïve", "42"]) for _ in range(rng.randrange(80)))) for k in range(30)]
    lib, folder = library(BYTES), f"{tmp_path}/files"
    ids = [(d, lib.encode(t or "", add_special_tokens=False).ids + [0]) for d, t in data]
    token_files.write_token_file(frame(spark, data), folder)
    assert spark.read.parquet(f"{folder}/blocks").agg({"n_tokens": "sum"}).first()[0] == sum(len(x) for _, x in ids)
    rows = token_files.read_token_file(spark, folder, public_tokenizers.path(BYTES)).collect()
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in rows)
    assert got == sorted((d is not None, d or 0, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in ids)
    with pytest.raises(ValueError, match="vocabulary"):
        token_files.read_token_file(spark, folder, public_tokenizers.path(WORDS))


def test_starts_follow_doc_id(spark, tmp_path):
    data = [(k * 3 % 101, "word " * k) for k in range(101)]
    frame(spark, data).write.parquet(f"{tmp_path}/documents.parquet")
    rows = sorted((r["doc_id"], r["start"], r["n_tokens"]) for r in token_files.op1_token_files(spark, str(tmp_path)).collect())
    assert [s for _, s, _ in rows] == [sum(n for _, _, n in rows[:k]) for k in range(101)]
    frame(spark, data).limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert token_files.op1_token_files(spark, f"{tmp_path}/none").count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_byte_pieces_equal_the_library(text):
    assert _bytes().encode(text).tolist() == _lib(BYTES).encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_word_pieces_equal_the_library(text):
    coder, lib = _words(), _lib(WORDS)
    ids = coder.encode(text)
    assert ids.tolist() == lib.encode(text, add_special_tokens=False).ids
    assert coder.decode(ids) == lib.decode(ids.tolist(), skip_special_tokens=False)


_held = {}


def _lib(name):
    return _held.setdefault(name, library(name))


def _bytes():
    return _held.setdefault("b", ByteBpe(tokenizer_json(None, BYTES)))


def _words(leaf=16):
    return _held.setdefault(leaf, bpe_text.WordBpe(tokenizer_json(None, WORDS), leaf))


@pytest.mark.parametrize("leaf", [1, 4, 16])
def test_tree_concatenation_is_exact(leaf):
    coder, lib, rng = _words(leaf), _lib(WORDS), random.Random(leaf)
    for _ in range(400):
        kind = rng.choice(["abcdefghijklmnopqrstuvwxyz", "theraininspain", "ab", "éaoxß"])
        text = "".join(rng.choice(kind) for _ in range(rng.randint(1, 300)))
        assert coder.encode(text).tolist() == lib.encode(text, add_special_tokens=False).ids


def test_digest_and_columns(spark):
    data = AWKWARD + [(50 + k, x) for k, x in enumerate(ODD)]
    docs, lib = frame(spark, data), library(WORDS)
    want = []
    for d, t in data:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(str, (tuple(r) for r in bpe_text.bpe_digest(docs).collect()))) == sorted(map(str, want))
    encoded = bpe_text.encode_text(docs)
    assert encoded.columns == [c for c in docs.columns if c != "ids"] + ["ids"]
    assert bpe_text.decode_ids(encoded).filter("doc_id = 9").first()["decoded"].startswith("word</w> word</w>")
    assert bpe_text.encode_text(docs.limit(0)).count() == 0


SCRIPTS = {"latin": "abcdefghijklmnop", "cyrillic": "абвгдежзийклмнопрст", "chinese": "的一是不了人我在有他这中大来上国"}


@pytest.mark.parametrize("script", SCRIPTS)
def test_long_unsplit_text_goes_through_tasks(spark, script):
    """One word of millions of letters: its parts are encoded by different tasks and joined."""
    rng, letters = random.Random(7), SCRIPTS[script]
    word = "".join(rng.choices(letters, k=5_000_000 if script == "latin" else 600_000))
    data = [(1, f"Before <br> {word} after 12"), (2, "short " + word[:50]), (None, word[:70_000] + "\n" + word[::-1][:70_000])]
    lib = _lib(WORDS)
    want = []
    for d, t in data:
        ids = lib.encode(t, add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = bpe_text.bpe_digest(frame(spark, data), long_bytes=100_000).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    encoded = {r["doc_id"]: r["ids"] for r in bpe_text.encode_text(frame(spark, data), long_bytes=100_000).collect()}
    assert len(encoded) == 3 and encoded[1] == lib.encode(data[0][1], add_special_tokens=False).ids


@pytest.mark.parametrize("leaf", [1, 4, 16])
def test_tree_runs_for_every_script(leaf):
    coder, lib, rng = _words(leaf), _lib(WORDS), random.Random(leaf)
    before = coder.joins
    for kind in [*SCRIPTS.values(), "αβγδέήίό", "カタカナひらがな", "éÉÜß", "🙂🙃", "ŉſİ", "x\u0301y"]:
        text = "".join(rng.choices(kind, k=200)) + " I'll go"
        assert coder.encode(text).tolist() == lib.encode(text, add_special_tokens=False).ids
    assert coder.joins > before + 50
