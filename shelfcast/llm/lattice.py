"""A double-array trie of subword pieces, and lattices of many words at once.

Words are bytes; an edge of a word's lattice is a piece found in the trie at some byte, or the
single byte itself (byte fallback). All words of one length walk the trie together, a byte at a
time, as NumPy arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

MARK = "▁".encode()


@dataclass
class Trie:
    """State ``s`` goes with byte ``b`` to ``base[s] + b + 1`` if ``check`` there is ``s``.

    ``piece`` has the number of the piece that ends in a state, or -1.
    """

    base: np.ndarray
    check: np.ndarray
    piece: np.ndarray
    longest: int

    @property
    def plain(self) -> tuple:
        """Arrays and a number, which a broadcast may hold; ``Trie(*plain)`` is the trie again."""
        return self.base, self.check, self.piece, self.longest

    @staticmethod
    def of(pieces: dict[bytes, int]) -> Trie:
        """The trie of the given byte strings; the root is state 0."""
        keys = sorted(k for k in pieces if k)
        size = 260 * (2 + len(keys)) + sum(map(len, keys)) + 600  # brothers: as many parents as keys at most
        base, check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        piece, used = np.full(size, -1, np.int32), bytearray(size)
        used[0], hole, top = 1, 1, 1
        todo = [(0, 0, len(keys), 0)]
        while todo:
            state, low, high, depth = todo.pop()
            if low < high and len(keys[low]) == depth:
                piece[state] = pieces[keys[low]]
                low += 1
            groups: list[tuple[int, int, int]] = []
            at = low
            while at < high:
                byte, begin = keys[at][depth], at
                while at < high and keys[at][depth] == byte:
                    at += 1
                groups.append((byte, begin, at))
            if not groups:
                continue
            first = groups[0][0] + 1
            if len(groups) == 1:  # a single child fills a hole
                while used[hole] or hole < first:
                    hole += 1
                start = hole - first
            else:  # brothers go behind the last state, or a little before
                start = max(0, top - 64 - first)
                while any(used[start + byte + 1] for byte, _, _ in groups):
                    start += 1
            base[state] = start
            for byte, begin, end in groups:
                child = start + byte + 1
                used[child], check[child] = 1, state
                top = max(top, child + 1)
                todo.append((child, begin, end, depth + 1))
        top += 260  # a walk may look beyond the last state
        return Trie(base[:top].copy(), check[:top].copy(), piece[:top].copy(), max(map(len, keys), default=0))

    def find(self, data: bytes) -> int:
        """The number of the piece that equals ``data``, or -1."""
        state = 0
        for byte in data:
            to = int(self.base[state]) + byte + 1
            if self.check[to] != state:
                return -1
            state = to
        return int(self.piece[state])


def by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The words' positions and their bytes as a matrix, for each length that occurs (0 left out)."""
    sizes = np.array([len(w) for w in words], np.int64)
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order])) + 1
    for part in np.split(order, cuts):
        if len(part) and (size := int(sizes[part[0]])):
            joined = b"".join([words[i] for i in part.tolist()])
            yield part, np.frombuffer(joined, np.uint8).reshape(len(part), size)


def edges(trie: Trie, letters: np.ndarray, begin: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(end, rows, pieces)``: the pieces that start at byte ``begin`` of the rows' words."""
    rows = np.arange(len(letters))
    state = np.zeros(len(letters), np.int32)
    for end in range(begin + 1, min(letters.shape[1], begin + trie.longest) + 1):
        to = trie.base[state] + letters[rows, end - 1] + 1
        going = trie.check[to] == state
        rows, state = rows[going], to[going]
        if not len(rows):
            return
        found = trie.piece[state]
        some = found >= 0
        if some.any():
            yield end, rows[some], found[some]


def best_paths(
    trie: Trie, scores: np.ndarray, byte_scores: np.ndarray, words: list[bytes], byte_piece: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The best segmentation of each word: for each length of words their positions, how many pieces
    each has, and the piece numbers one after another.

    Ties go to the segmentation whose last piece starts earliest. ``byte_piece`` numbers the single
    bytes, which stand in wherever no better piece does.
    """
    for at, letters in by_length(words):
        n, size = letters.shape
        # a row for each byte, so that what one step reads and writes lies together
        best = np.full((size + 1, n), -np.inf)
        best[0] = 0
        step = np.zeros((size + 1, n), np.int32)  # the piece that ends here
        back = np.zeros((size + 1, n), np.int32)  # and where it starts
        for begin in range(size):
            bytes_, ahead = letters[:, begin], best[begin]
            for end, rows, found in edges(trie, letters, begin):
                value = ahead[rows] + scores[found]
                better = value > best[end, rows]
                rows = rows[better]
                best[end, rows], step[end, rows], back[end, rows] = value[better], found[better], begin
            value = ahead + byte_scores[bytes_]
            rows = np.flatnonzero(value > best[begin + 1])
            best[begin + 1, rows], step[begin + 1, rows], back[begin + 1, rows] = (
                value[rows], byte_piece[bytes_[rows]], begin
            )
        live, ends = np.arange(n), np.full(n, size)
        taken = []
        while len(live):
            line = np.full(n, -1, np.int32)
            line[live] = step[ends, live]
            ends = back[ends, live]
            live, ends = live[ends > 0], ends[ends > 0]
            taken.append(line)
        table = np.array(taken[::-1]).T
        some = table >= 0
        yield at, some.sum(axis=1), table[some]


def viterbi(
    trie: Trie, scores: np.ndarray, byte_scores: np.ndarray, words: list[bytes], byte_piece: np.ndarray
) -> list[np.ndarray]:
    """``best_paths`` as one array for each word, in the order of the words."""
    out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
    for at, sizes, found in best_paths(trie, scores, byte_scores, words, byte_piece):
        for word, path in zip(at.tolist(), np.split(found, np.cumsum(sizes)[:-1]), strict=True):
            out[word] = path
    return out


def forward(
    trie: Trie, scores: np.ndarray, byte_scores: np.ndarray, letters: np.ndarray
) -> np.ndarray:
    """Log of the summed probability of all segmentations of each prefix of each word."""
    n, size = letters.shape
    total = np.full((size + 1, n), -np.inf)
    total[0] = 0
    for begin in range(size):
        for end, rows, found in edges(trie, letters, begin):
            total[end, rows] = np.logaddexp(total[end, rows], total[begin, rows] + scores[found])
        total[begin + 1] = np.logaddexp(total[begin + 1], total[begin] + byte_scores[letters[:, begin]])
    return total


def expected_counts(
    trie: Trie, scores: np.ndarray, byte_scores: np.ndarray, words: list[bytes], times: np.ndarray,
    n_pieces: int,
) -> np.ndarray:
    """How often each piece, then each byte, is expected in ``words`` over all segmentations."""
    counts = np.zeros(n_pieces + 256)
    for at, letters in by_length(words):
        ahead = forward(trie, scores, byte_scores, letters)
        n, size = letters.shape
        behind = np.full((size + 1, n), -np.inf)
        behind[size] = 0
        weight = times[at]
        add: Callable = lambda ids, values: np.add.at(counts, ids, values)
        for begin in range(size - 1, -1, -1):
            found_edges = list(edges(trie, letters, begin))
            by_byte = byte_scores[letters[:, begin]]
            behind[begin] = by_byte + behind[begin + 1]
            for end, rows, found in found_edges:
                behind[begin, rows] = np.logaddexp(behind[begin, rows], scores[found] + behind[end, rows])
            for end, rows, found in found_edges:
                share = ahead[begin, rows] + scores[found] + behind[end, rows] - ahead[size, rows]
                counts[:n_pieces] += np.bincount(found, weight[rows] * np.exp(share), n_pieces)
            share = ahead[begin] + by_byte + behind[begin + 1] - ahead[size]
            add(n_pieces + letters[:, begin].astype(np.int64), weight * np.exp(share))
    return counts


def marginals(
    trie: Trie, scores: np.ndarray, byte_scores: np.ndarray, words: list[bytes]
) -> np.ndarray:
    """Natural log of each word's probability summed over all its segmentations."""
    out = np.zeros(len(words))
    for at, letters in by_length(words):
        out[at] = forward(trie, scores, byte_scores, letters)[-1]
    return out
