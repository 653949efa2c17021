"""Hashes of words and shingles of many texts at once, in numpy.

A word's hash is a polynomial over its bytes with a random 64-bit value for each
byte, so that a whole batch is hashed by a few array operations and no table of
words is kept, however many words a corpus has.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import xxhash

MIX = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text hashed at once, about; bytes of a word beyond which it is hashed by itself.
AT_ONCE, LONG = 1 << 19, 512


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of bytes, powers of the base, and which bytes are white space."""
    rng = np.random.default_rng(64)
    value = rng.integers(0, 1 << 64, 256, dtype=np.uint64)
    value[65:91] = value[97:123]  # capitals as small letters, ASCII only
    base = np.full(LONG, int(rng.integers(0, 1 << 61)) * 8 + 5, np.uint64)
    base[0] = 1
    space = np.zeros(256, bool)
    space[[*range(9, 14), 32]] = True
    return value, np.cumprod(base, dtype=np.uint64), space


VALUE, POWER, SPACE = _tables()


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the input moves every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(texts: Sequence[str], most: int = AT_ONCE) -> Iterator[slice]:
    """Slices of ``texts`` of about ``most`` characters each, one text at least."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield slice(start, i)
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


def hashed_words(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and how many each text has.

    Words are runs of bytes other than ASCII white space, ASCII letters lowered.
    """
    each = [t.encode("utf-8", "replace") for t in texts]
    raw = b"\n".join([*each, b""])
    data = np.frombuffer(raw, np.uint8)
    inside = ~SPACE[data]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    text_ends = np.cumsum([len(x) + 1 for x in each])
    sizes = np.diff(np.searchsorted(starts, text_ends), prepend=0)
    if not len(starts):
        return np.empty(0, np.uint64), sizes
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    long = np.flatnonzero(lengths > LONG)
    if len(long):
        np.minimum(place, LONG - 1, out=place)
    h = np.add.reduceat(VALUE[data[inside]] * POWER[place], first)
    h = mixed(h + lengths.astype(np.uint64) * MIX)
    for i in long:
        h[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]].lower())
    return h, sizes


def shingle_sets(texts: Sequence[str], k: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of the k-word shingles of each text.

    A text of fewer than k words has its whole sequence as its one shingle; a
    text without words has none.
    """
    for part in runs(texts):
        h, sizes = hashed_words(texts[part])
        out = np.full(max(0, len(h) - k + 1), np.uint64(k))
        for i in range(k):
            out = mixed(out * MIX + h[i : len(h) - k + 1 + i])
        end = 0
        for n in sizes.tolist():
            start, end = end, end + n
            if n >= k:
                yield np.unique(out[start : end - k + 1])
            elif n:
                one = np.full(1, np.uint64(n))
                for x in h[start:end]:
                    one = mixed(one * MIX + x)
                yield one
            else:
                yield np.empty(0, np.uint64)
