"""Token counts that survive edits: a segment tree of pre-tokens for each document.

A document's pre-tokens lie in chunks of ``CHUNK``; a leaf of its tree holds a chunk's code points
and tokens, an inner node its children's sums. An edit descends to the chunk that holds the edit's
place less the pattern's look-ahead, splits the text anew from that chunk's start until a
boundary falls on an old chunk's boundary behind the edit, and re-encodes the pre-tokens in between
alone. The sums on the way to the root are updated. Splitting depends on the text from a boundary on only, so
everything behind the meeting point is as it was.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, functions as F

from .common import STEP_BYTES, column, pieces, text_bytes, whole_text

#: A public rank file (its path is a parameter) and the pattern that splits text before merging.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens of a chunk, and how many code points behind its end the pattern looks at a pre-token.
CHUNK, LOOK_AHEAD = 32, 2
MOST_CACHED = 200_000


class Counter:
    """Counts tokens of pre-tokens; remembers them."""

    def __init__(self, ranks: bytes, pattern: str = PATTERN):
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def split(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def counts(self, parts: list[str]) -> list[int]:
        new = [p for p in set(parts) if p not in self.known]
        if len(self.known) + len(new) > MOST_CACHED:
            self.known.clear()
            new = list(set(parts))
        encode = self.encoding.encode_ordinary
        self.known.update((p, len(encode(p))) for p in new)
        return [self.known[p] for p in parts]


@dataclass
class Tree:
    """Leaves ``size .. size + n - 1`` of two heaps of sums: code points and tokens."""

    n: int
    chars: list[int]
    tokens: list[int]
    #: Code points that edits have split anew, and pre-tokens they have encoded anew.
    read: int = 0
    encoded: int = 0
    size: int = field(init=False)

    def __post_init__(self) -> None:
        self.size = len(self.chars) // 2

    @staticmethod
    def of(chars: list[int], tokens: list[int]) -> Tree:
        size = 1
        while size < len(chars):
            size *= 2
        heaps = []
        for leaves in (chars, tokens):
            heap = [0] * size + leaves + [0] * (size - len(leaves))
            for node in range(size - 1, 0, -1):
                heap[node] = heap[2 * node] + heap[2 * node + 1]
            heaps.append(heap)
        return Tree(len(chars), *heaps)

    def total(self) -> int:
        return self.tokens[1]

    def find(self, place: int) -> tuple[int, int]:
        """The chunk that holds a code point (the last one beyond the end), and its start."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if place - start >= self.chars[node] and self.chars[node + 1]:
                start += self.chars[node]
                node += 1
        return node - self.size, start

    def put(self, chunk: int, chars: int, tokens: int) -> None:
        node = chunk + self.size
        more, added = chars - self.chars[node], tokens - self.tokens[node]
        while node:
            self.chars[node] += more
            self.tokens[node] += added
            node //= 2


def build(parts: list[str], counts: list[int]) -> Tree:
    """The tree of a text's pre-tokens and their token counts."""
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    starts = np.arange(0, max(1, len(parts)), CHUNK)
    if not len(parts):
        return Tree.of([0], [0])
    return Tree.of(
        np.add.reduceat(lengths, starts).tolist(),
        np.add.reduceat(np.array(counts, np.int64), starts).tolist(),
    )


def edit(counter: Counter, tree: Tree, text: str, start: int, delete: int, insert: str) -> str:
    """Applies an edit to text and tree; returns the new text.

    ``start`` and ``delete`` are code points, cut to the text's length; a null insert is empty.
    """
    start = min(max(start, 0), len(text))
    delete = min(max(delete, 0), len(text) - start)
    insert = insert or ""
    new = text[:start] + insert + text[start + delete :]
    shift = len(insert) - delete
    chunk, begin = tree.find(max(0, start - LOOK_AHEAD - 1))
    # old boundaries of chunks behind the edit, where the new splitting may meet the old one
    last, end = chunk, begin + tree.chars[chunk + tree.size]
    while end < start + delete and last + 1 < tree.n:
        last += 1
        end += tree.chars[last + tree.size]
    at, parts = begin, []
    while at < len(new):
        part = counter.pattern.match(new, at).group()
        parts.append(part)
        at += len(part)
        while end + shift < at and last + 1 < tree.n:
            last += 1
            end += tree.chars[last + tree.size]
        if at == end + shift and at >= start + len(insert):
            break
    tree.read += at - begin
    tree.encoded += len(parts)
    for emptied in range(chunk + 1, last + 1):
        tree.put(emptied, 0, 0)
    counts = counter.counts(parts)
    tree.put(chunk, at - begin, sum(counts))
    # a leaf that has grown long is cut into chunks; its pre-tokens and their counts are at hand
    if at - begin > 64 * CHUNK * 8 and len(parts) > CHUNK:
        grown, leaves = build(parts, counts), []
        for heap, new_heap in ((tree.chars, grown.chars), (tree.tokens, grown.tokens)):
            old = heap[tree.size : tree.size + tree.n]
            leaves.append(old[:chunk] + new_heap[grown.size : grown.size + grown.n] + old[chunk + 1 :])
        rebuilt = Tree.of(*leaves)
        rebuilt.read, rebuilt.encoded = tree.read, tree.encoded
        tree.__dict__.update(rebuilt.__dict__)
    return new


def sample_edits(text: Column) -> Column:
    """Three edits that depend on the text alone: a word put in at a third, twenty code points cut
    out at two thirds, and the last ten replaced. Places refer to the text after earlier edits."""
    n = F.char_length(text)
    one = [
        (F.floor(n / 3), F.lit(0), F.lit(" edited")),
        (F.floor(2 * n / 3), F.lit(20), F.lit("")),
        (F.greatest(n - 23, F.lit(0)), F.lit(10), F.lit("[end] of 2 lines\n")),
    ]
    return F.array(*[
        F.struct(s.cast("long").alias("start"), d.cast("long").alias("delete"), i.alias("insert"))
        for s, d, i in one
    ])


def edited_counts(
    docs: DataFrame, edits: Column | None = None, text: str = "text", path: str = RANKS, pattern: str = PATTERN
) -> DataFrame:
    """Every row with its token count before and after its edits.

    ``edits`` is an array of ``(start, delete, insert)``, applied in order; null, or one with null
    places, changes nothing (a null start or delete counts as 0). Adds n_pretokens, n_tokens,
    edited_chars, edited_tokens, n_reread (code points split anew), n_reencoded (pre-tokens encoded
    anew) and edited_text, replacing columns of these names. A null text counts as empty. Memory: a
    batch of texts, one tree at a time and a bounded cache of pre-tokens.
    """
    with open(path, "rb") as file:  # a megabyte, on the driver
        ranks = docs.sparkSession.sparkContext.broadcast(file.read())
    added = ("n_pretokens", "n_tokens", "edited_chars", "edited_tokens", "n_reread", "n_reencoded")
    others = [c for c in docs.columns if c.lower() not in (*added, "edited_text")]
    row = F.struct(F.lit(1).alias("x"), *[column(c).alias(f"c{i}") for i, c in enumerate(others)])
    edits = sample_edits(whole_text(text)) if edits is None else edits
    packed = docs.select(text_bytes(text).alias("text"), edits.alias("edits"), row.alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(ranks.value, pattern)
        for batch in batches:
            for piece in pieces(batch, 0, STEP_BYTES):
                out: list[list[int]] = [[] for _ in added]
                texts = []
                changes = piece.column(1).to_pylist()
                for data, changed in zip(piece.column(0).to_pylist(), changes, strict=True):
                    body = data.decode("utf-8", "replace")
                    parts = counter.split(body)
                    tree = build(parts, counter.counts(parts))
                    before = tree.total()
                    for change in changed or []:
                        if change is not None:
                            body = edit(
                                counter, tree, body, change["start"] or 0, change["delete"] or 0, change["insert"]
                            )
                    row_ = (len(parts), before, len(body), tree.total(), tree.read, tree.encoded)
                    for values, value in zip(out, row_, strict=True):
                        values.append(value)
                    texts.append(body)
                yield pa.record_batch(
                    [piece.column(2), *(pa.array(v, pa.int64()) for v in out), pa.array(texts, pa.string())],
                    names=["row", *added, "edited_text"],
                )

    kind = packed.schema["row"].dataType.simpleString()
    done = packed.mapInArrow(run, ", ".join([f"row {kind}", *(f"{a} long" for a in added), "edited_text string"]))
    return done.select(
        *[F.col("row").getField(f"c{i}").alias(c) for i, c in enumerate(others)], *added, "edited_text"
    )
