"""Words and word shingles of many texts at once, as numpy arrays over Arrow buffers.

A word is a run of characters outside ``[\\x20\\x09-\\x0D]``.  Texts stay in the
byte buffer they arrive in; nothing here loops over words in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is one piece of its own.
PIECE_BYTES = 2 << 20

_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of splitmix64)."""
    x = x + U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_powers = {}


def _power_table(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        table = np.full(max(n, 1 << 16), base, U)
        table[0] = 1
        have = _powers[base] = np.multiply.accumulate(table)
        if len(have) > 4 * PIECE_BYTES:  # of one huge text; not worth keeping
            del _powers[base]
    return have[:n]


def text_pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, text starts and last end) for consecutive rows; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE_BYTES, "right")) - 1)
        end = min(end, len(column))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the index of the first word of each text (and past the last)."""
    inside = _IS_WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # words end where texts do
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from prefix sums of a polynomial over the bytes."""
    sums = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * _power_table(_BASE, len(data)), out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * _power_table(_INVERSE, len(data) + 1)[starts])


def shingles(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each run of ``width`` words; a shorter text with words has one shingle of all of them."""
    n_texts, counts = len(first) - 1, np.diff(first)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, U)
    text_of = np.repeat(np.arange(n_texts), counts)
    place = np.arange(len(words)) - first[text_of]
    starts = np.flatnonzero(place + width <= counts[text_of])
    h = np.full(len(starts), width, U)
    for k in range(width):
        h = mix64(h ^ words[starts + k])
    owner = text_of[starts]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        extra = counts[short].astype(U)
        for k in range(width - 1):
            here = counts[short] > k
            extra[here] = mix64(extra[here] ^ words[first[short[here]] + k])
        owner, h = np.concatenate([owner, short]), np.concatenate([h, extra])
        order = np.argsort(owner, kind="stable")
        owner, h = owner[order], h[order]
    return owner, h


def counted(owner: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, hash) in order, with how often each occurs."""
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], h[at], np.diff(np.append(at, len(h)))
