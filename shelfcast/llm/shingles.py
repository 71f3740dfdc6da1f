"""Hashed word shingles of whole texts, with NumPy over a batch at a time."""

from __future__ import annotations

import numpy as np

from .common import mixed

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ROOT = 0x9E3779B97F4A7C15
_INVERSE = pow(_ROOT, -1, 1 << 64)


_CACHE: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    known = _CACHE.get(base)
    if known is None or len(known) < n:
        steps = np.full(1 << max(18, (n - 1).bit_length()), base, np.uint64)
        steps[0] = 1
        known = np.cumprod(steps, dtype=np.uint64)
        if len(known) <= 1 << 23:  # a longer text's powers aren't kept
            _CACHE[base] = known
    return known[:n]


_LETTER = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ROOT))


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts (A-Z in lower case), and each text's number of words.

    A word's hash is a polynomial in its bytes, read off one running sum over the whole batch.
    """
    joined = b" ".join([*texts, b""])
    data = np.frombuffer(joined.lower() if lower else joined, np.uint8)
    blank = np.concatenate([[True], _SPACE[data], [True]])
    begin = np.flatnonzero(blank[:-1] & ~blank[1:])
    end = np.flatnonzero(~blank[:-1] & blank[1:])
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTER[data] * _powers(_ROOT, len(data)), dtype=np.uint64, out=run[1:])
    words = (run[end] - run[begin]) * _powers(_INVERSE, len(data) + 1)[begin]
    words = mixed(words + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    starts = np.cumsum([0, *[len(t) + 1 for t in texts]])
    return words, np.diff(np.searchsorted(begin, starts))


def shingle_sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its ``width``-word shingles.

    A text with fewer words has its whole sequence as one; one without words an empty set. Equal
    hashes stand for equal shingles: among a thousand million shingles two differing ones meet
    with a probability of one in forty.
    """
    words, counts = word_hashes(texts)
    weights = mixed(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
    ends = np.cumsum(counts)
    full = max(0, len(words) - width + 1)
    hashes = np.zeros(full, np.uint64)
    for k in range(width):
        hashes += words[k : k + full] * weights[k]
    hashes = mixed(hashes)
    sets = []
    for end, n in zip(ends.tolist(), counts.tolist(), strict=True):
        if n >= width:
            found = np.sort(hashes[end - n : end - width + 1])
            sets.append(found[np.concatenate([[True], found[1:] != found[:-1]])])
        elif n:
            whole = (words[end - n : end] * weights[:n]).sum(dtype=np.uint64) + np.uint64(n)
            sets.append(mixed(np.array([whole], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def parity_bitmap(hashes: np.ndarray, bits: int) -> np.ndarray:
    """A signature of ``bits`` bits (a power of two), each the parity of the elements that hash to it.

    Two sets' signatures differ in no more bits than the sets have elements of their own, so
    ``(|x| + |y| - differing bits) / 2`` bounds the overlap from above.
    """
    odd = np.bincount((hashes >> np.uint64(20)) % np.uint64(bits), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def wide_bitmap(hashes: np.ndarray) -> np.ndarray:
    """A signature with a bit for each element at least, so that large sets are told apart too."""
    return parity_bitmap(hashes, max(1024, 1 << (len(hashes) - 1).bit_length()))


def differing_bits(x: bytes, y: bytes) -> int:
    """Differing bits of two signatures; the wider is folded to the width of the other."""
    one, two = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if len(one) < len(two):
        one, two = two, one
    one = np.bitwise_xor.reduce(one.reshape(-1, len(two)), axis=0)
    return int(np.bitwise_count(one ^ two).sum())
