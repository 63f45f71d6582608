"""Token counts that follow edits, from a tree of pre-tokens for each text.

The leaves of a text's tree hold about ``LEAF`` pre-tokens each, with their
characters and tokens; inner nodes hold sums, so a character is found and a sum
is updated along one path.  An edit encodes anew only from the last leaf that
starts before it by the pattern's look-ahead, up to the first leaf boundary after
it where old and new pre-tokens meet again.

Leaves are stored as two arrays a row, from which the sums are made in one go.

Defined results: a null or empty text has one empty leaf and no tokens; edits must
not overlap and are applied from the last to the first, null edits are none;
repeated rows get equal rows; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import MARGIN, RANKS, Coder

LEAF = 64
#: A leaf of more pre-tokens than this, after edits, makes the tree be built anew.
FULL = 8 * LEAF


class CountTree:
    def __init__(self, coder: Coder, text: str, chars: list[int] | None = None, tokens: list[int] | None = None, leaf: int = LEAF):
        self.coder, self.text, self.leaf = coder, text, leaf
        self.encoded = 0  # pre-tokens encoded since the text was first counted
        if chars is None:
            chars, tokens = self._leaves(self._pieces(0, len(text)))
        self._fill(chars, tokens)

    def _pieces(self, start: int, end: int) -> list[tuple[int, int]]:
        return [(m.end() - m.start(), len(self.coder.piece(m.group()))) for m in self.coder.pattern.finditer(self.text, start, end)]

    def _leaves(self, pieces: list[tuple[int, int]], n: int | None = None) -> tuple[list[int], list[int]]:
        """``pieces`` dealt to ``n`` leaves, or to as many as ``leaf`` pre-tokens each need."""
        n = n or max(1, -(-len(pieces) // self.leaf))
        cuts = [len(pieces) * k // n for k in range(n + 1)]
        parts = [pieces[a:b] for a, b in zip(cuts, cuts[1:])]
        return [sum(c for c, _ in p) for p in parts], [sum(t for _, t in p) for p in parts]

    def _fill(self, chars: list[int], tokens: list[int]) -> None:
        self.n = len(chars)
        self.size = 1 << (self.n - 1).bit_length()
        self.chars, self.tokens = ([0] * self.size + x + [0] * (self.size - self.n) for x in (chars, tokens))
        for i in range(self.size - 1, 0, -1):
            for s in (self.chars, self.tokens):
                s[i] = s[2 * i] + s[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def leaves(self) -> tuple[list[int], list[int]]:
        return self.chars[self.size : self.size + self.n], self.tokens[self.size : self.size + self.n]

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (the last one past the end), and the leaf's first character."""
        i, start = 1, 0
        while i < self.size:
            i *= 2
            if start + self.chars[i] <= at and self.chars[i + 1]:
                start += self.chars[i]
                i += 1
        return i - self.size, start

    def _set(self, leaf: int, chars: int, tokens: int) -> None:
        i = leaf + self.size
        self.chars[i], self.tokens[i] = chars, tokens
        while i > 1:
            i //= 2
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def edit(self, start: int, end: int, text: str) -> None:
        """Replace characters ``start`` to ``end`` by ``text``."""
        shift = len(text) - (end - start)
        first, begin = self.find(max(0, start - MARGIN))
        self.text = self.text[:start] + text + self.text[end:]
        # Old leaf boundaries after the edit, where new pre-tokens may meet the old ones.
        last, at = self.find(end)
        stop = at + self.chars[last + self.size]
        while last + 1 < self.n and stop < end:
            last += 1
            stop += self.chars[last + self.size]
        pieces: list[tuple[int, int]] = []
        place = begin
        for m in self.coder.pattern.finditer(self.text, begin):
            pieces.append((m.end() - m.start(), len(self.coder.piece(m.group()))))
            place = m.end()
            while stop + shift < place and last + 1 < self.n:
                last += 1
                stop += self.chars[last + self.size]
            if place == stop + shift:
                break
        else:
            last = self.n - 1
        self.encoded += len(pieces)
        slots = last - first + 1
        if len(pieces) > slots * FULL:
            chars, tokens = self.leaves()
            more = self._leaves(pieces)
            self._fill(chars[:first] + more[0] + chars[last + 1 :], tokens[:first] + more[1] + tokens[last + 1 :])
            return
        for k, (c, t) in enumerate(zip(*self._leaves(pieces, slots))):
            self._set(first + k, c, t)


#: Strings that a clean-up replaces: long numbers, addresses, long hexadecimal strings.
REDACTED = re.compile(r"[0-9a-fA-F]{32,}|\d{9,}|\d{1,3}(?:\.\d{1,3}){3}|[\w.+-]+@[\w-]+(?:\.[\w-]+)+")
REPLACEMENT = "<redacted>"


def count_trees(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """doc_id, text, leaf_chars, leaf_tokens, n_tokens for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of(ranks)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                trees = [CountTree(coder, t.as_py() or "") for t in part.column(1)]
                chars, tokens = zip(*[t.leaves() for t in trees]) if trees else ((), ())
                columns = [pa.array(chars, pa.list_(pa.int32())), pa.array(tokens, pa.list_(pa.int32())), pa.array([t.n_tokens for t in trees], pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], ["doc_id", "text", "leaf_chars", "leaf_tokens", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, text string, leaf_chars array<int>, leaf_tokens array<int>, n_tokens long")


def apply_edits(trees: DataFrame, ranks: str = RANKS) -> DataFrame:
    """``trees`` with a column ``edits`` (array of struct start, end, text) -> the same columns after the edits, and n_encoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of(ranks)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                done = []
                for text, chars, tokens, edits in zip(*[c.to_pylist() for c in part.columns[1:]]):
                    tree = CountTree(coder, text or "", chars, tokens)
                    for e in sorted(edits or [], key=lambda e: (e["start"], e["end"]), reverse=True):
                        tree.edit(e["start"], e["end"], e["text"])
                    done.append(tree)
                chars, tokens = zip(*[t.leaves() for t in done]) if done else ((), ())
                columns = [pa.array([t.text for t in done], pa.string()), pa.array(chars, pa.list_(pa.int32())), pa.array(tokens, pa.list_(pa.int32())), pa.array([t.n_tokens for t in done], pa.int64()), pa.array([t.encoded for t in done], pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", "text", "leaf_chars", "leaf_tokens", "n_tokens", "n_encoded"])

    kind = trees.schema["doc_id"].dataType.simpleString()
    chosen = trees.select("doc_id", "text", "leaf_chars", "leaf_tokens", "edits")
    return chosen.mapInArrow(run, f"doc_id {kind}, text string, leaf_chars array<int>, leaf_tokens array<int>, n_tokens long, n_encoded long")


def redacted_counts(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """doc_id and n_tokens of each whole text; n_edits, n_tokens_after and n_encoded (pre-tokens encoded anew) of its redaction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of(ranks)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                rows = []
                for t in part.column(1):
                    tree = CountTree(coder, t.as_py() or "")
                    before = tree.n_tokens
                    spans = [m.span() for m in REDACTED.finditer(tree.text)]
                    for a, b in reversed(spans):
                        tree.edit(a, b, REPLACEMENT)
                    rows.append((before, len(spans), tree.n_tokens, tree.encoded))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]], ["doc_id", "n_tokens", "n_edits", "n_tokens_after", "n_encoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, n_edits long, n_tokens_after long, n_encoded long")
