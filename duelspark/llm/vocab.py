"""Word-cached BPE with the tokenizers library: pieces of text recur, so each worker encodes a piece once.

A text of only long-established Latin letters, digits and punctuation is cut into pieces by an
equivalent of the vocabulary's pattern over exactly those characters; each distinct piece goes
through the library's BPE model. Any other text, and any that may hold a special token's string,
goes through the library whole, so that its normaliser and pattern decide.
"""

from __future__ import annotations

import json
import os
import re
from struct import pack

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces a worker keeps; beyond it pieces are encoded anew each time, with the same result.
CACHE_PIECES = 1_000_000

#: Fixed: characters whose class, case and normal form no library version disputes.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-įı-ɏ"
DIGITS = "0-9²³¹¼-¾"
SPACES = "\\t-\\r "
DISPUTED = re.compile("[^\\t-\\r -~¡-įı-ɏ‐-‧‰-⁞]|<\\|")
_PLAIN = bytes([*range(0x09, 0x0E), *range(0x20, 0x7F)])


def disputed(text: str) -> bool:
    """Whether the library must see the whole text."""
    if text.isascii():
        return bool(text.encode().translate(None, _PLAIN)) or "<|" in text
    return bool(DISPUTED.search(text))


def tokenizer_json(path: str | None, name: str) -> str:
    """The vocabulary file's content, read on the driver; ``path`` None: the public file ``name``."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    with open(path, encoding="utf-8") as f:
        return f.read()


def byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write each byte as one printable character."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + k)
    return out


class Pieces(dict):
    """piece -> its ids as little-endian integers of ``width`` bytes; encodes what it doesn't hold."""

    def __init__(self, encode, most: int = CACHE_PIECES, width: int = 4):
        super().__init__()
        self.encode, self.most, self.code = encode, most, "H" if width == 2 else "I"

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(piece)
        packed = pack(f"<{len(ids)}{self.code}", *ids)
        if len(self) < self.most and len(piece) <= 64:
            self[piece] = packed
        return packed


_LATIN = byte_letters()
#: Characters below U+0250 as their bytes' letters, for str.translate.
_SHORT = {k: "".join(_LATIN[b] for b in chr(k).encode("utf-8")) for k in range(0x250)}


def as_letters(piece: str) -> str:
    if piece.isalnum() and piece.isascii():
        return piece
    if max(piece) < "ɐ":
        return piece.translate(_SHORT)
    return "".join(map(_LATIN.__getitem__, piece.encode("utf-8")))


class ByteBpe:
    """The byte-level vocabulary with leading blanks inside pieces."""

    def __init__(self, source: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(source)
        self.library.no_truncation()
        self.library.no_padding()
        pre = json.loads(source).get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.known = plain and self.library.normalizer is None
        self.pattern = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{DIGITS}]+| ?[^{SPACES}{LETTERS}{DIGITS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
        model = self.library.model
        width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{width}")
        self.pieces = Pieces(lambda piece: [t.id for t in model.tokenize(as_letters(piece))], width=width)

    def encode(self, text: str) -> np.ndarray:
        if not self.known or disputed(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind)
        return np.frombuffer(b"".join(map(self.pieces.__getitem__, self.pattern.findall(text))), self.kind)
