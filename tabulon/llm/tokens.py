"""Token ids of whole texts, at the speed of a table of words.

A tokenizer that drops white space and never joins across it gives a text the
ids of its words one after another, so ids are kept per word. Only the library
turns words into ids; its BPE model alone is asked where the steps before it
leave a word as it is.
"""

from __future__ import annotations

import codecs
import json
import re
import struct
import zlib
from collections.abc import Callable

import numpy as np

from .common import Bounded

#: Words kept by one Python worker (twice as many at most).
WORDS = 300_000

#: ASCII marks that are neither letter, digit, space nor apostrophe.
MARKS = bytes(b for b in range(33, 127) if b != 39 and not chr(b).isalnum())
#: Composed Latin letters, once they are lowered.
LATIN = re.compile("[a-zß-öø-ɏ]+")

_made: dict[str, Callable[[str], bytes]] = {}


def word_end_bpe(spec: dict) -> bool:
    """Whether words of small ASCII letters go to the model as they are.

    So it is with the normalizer NFC, white space to blank, lower case, and with
    a pattern whose classes are letters, digits and other signs, all without
    white space; anything else is encoded whole.
    """
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"  # a fixed value of the format
    return (
        [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"]
        and steps[1]["content"] == " "
        and steps[1]["pattern"] == {"Regex": "\\s+"}
        and [p["type"] for p in pre] == ["Split", "ByteLevel"]
        and pre[0]["pattern"] == {"Regex": pattern}
        and pre[0]["invert"]
        and not pre[1]["use_regex"]
        and not pre[1]["add_prefix_space"]
        and all(re.fullmatch(r"<\|\w+\|>", t["content"]) for t in spec["added_tokens"])
    )


def byte_chars() -> list[str]:
    """The printable character that byte-level models use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + rest.index(b)) for b in range(256)]


def encoder(path: str) -> Callable[[str], bytes]:
    """Text -> its ids as little-endian unsigned 32-bit integers.

    One per worker, which keeps a bounded number of words.
    """
    if path in _made:
        return _made[path]
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    def pack(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    if not word_end_bpe(spec):
        _made[path] = lambda text: pack(whole.encode(text, add_special_tokens=False).ids)
        return _made[path]
    tokenize, added = whole.model.tokenize, [t["content"] for t in spec["added_tokens"]]
    chars = "".join(byte_chars())
    packed = [pack([i]) for i in range(max(whole.get_vocab().values()) + 1)]

    def of_piece(piece: bytes) -> bytes:
        # Printable ASCII stands for itself.
        text = piece.decode() if piece.isascii() else codecs.charmap_decode(piece, "strict", chars)[0]
        return b"".join([packed[t.id] for t in tokenize(text)])

    def of_word(word: bytes) -> bytes:
        if word.isalpha():
            return of_piece(word.lower())
        if b"<|" not in word or not any(a in word.decode() for a in added):
            core = word.rstrip(MARKS)
            if not core:
                return of_piece(word)
            low = core.decode().lower()
            if LATIN.fullmatch(low):
                return words[core] + words[word[len(core) :]] if len(core) < len(word) else of_piece(low.encode())
        return pack(whole.encode(word.decode(), add_special_tokens=False).ids)

    words = Bounded(of_word, WORDS)

    def encode(text: str) -> bytes:
        # Of bytes, lower() and split() know ASCII only; the rest is left to the library.
        data = text.encode("utf-8", "replace")
        return b"".join(map(words.__getitem__, (data if b"<|" in data else data.lower()).split()))

    _made[path] = encode
    return encode


def crc(ids: bytes) -> int:
    return zlib.crc32(ids)


def narrow(ids: bytes) -> bytes:
    """A byte that says the width, then the ids in 2 bytes each where all fit."""
    v = np.frombuffer(ids, "<u4")
    return b"\2" + v.astype("<u2").tobytes() if len(v) and v.max() < 1 << 16 else b"\4" + ids


def wide(kept: bytes) -> np.ndarray:
    return np.frombuffer(kept, "<u2" if kept[0] == 2 else "<u4", offset=1)
