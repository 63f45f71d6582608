"""Statistics of texts as numpy arrays, for models that score documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .words import counted, shingles, text_pieces, word_hashes, word_spans

NAMES = [
    "log_words", "word_length", "upper", "digit", "symbol", "punctuation", "bang", "pipe", "line_words",
    "repeat_lines", "repeat_3", "repeat_5", "top_word", "distinct", "non_ascii", "sentence", "longest_word",
]

_CLASS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "symbol": b"#*$%&|<>{}[]=~^_@\\/+",
    "punctuation": b".,;:",
    "bang": b"!",
    "pipe": b"|",
    "sentence": b".?",
}
_TABLES = {k: np.isin(np.arange(256), np.frombuffer(v, np.uint8)) for k, v in _CLASS.items()}


def _per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _repeated(owner: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Per text, occurrences beyond the first of each element."""
    who, _, times = counted(owner, h)
    return np.bincount(who, times - 1, n)


def statistics(column: pa.Array) -> np.ndarray:
    """(texts, len(NAMES)) float32 for a string column; a null or empty text has zeros."""
    parts = []
    for _, _, data, offsets in text_pieces(column):
        n = len(offsets) - 1
        starts, ends, first = word_spans(data, offsets)
        words = word_hashes(data, starts, ends)
        count = np.diff(first).astype(float)
        some = np.maximum(count, 1)
        size = np.maximum(np.diff(offsets), 1).astype(float)
        of_class = {k: _per_text(t[data], offsets) for k, t in _TABLES.items()}
        breaks = data == 0x0A
        lines = _per_text(breaks, offsets) + 1.0
        text_of = np.repeat(np.arange(n), np.diff(first))
        who, h, times = counted(text_of, words)
        top = np.zeros(n)
        np.maximum.at(top, who, times)
        line_end = np.flatnonzero(breaks)
        line_of_word = np.searchsorted(line_end, starts) + text_of  # text ends part lines too
        line_key, line_first = np.unique(line_of_word, return_index=True)
        # A line's hash: the sum of its word hashes.
        line_hash = np.add.reduceat(words, line_first) if len(words) else words
        length = (ends - starts).astype(float)
        longest = np.zeros(n)
        np.maximum.at(longest, text_of, length)
        letters = np.maximum(np.bincount(text_of, length, n), 1)
        rows = {
            "log_words": np.log1p(count),
            "word_length": np.bincount(text_of, length, n) / some,
            **{k: of_class[k] / letters for k in ("upper", "digit", "symbol", "punctuation")},
            **{k: of_class[k] / some for k in ("bang", "pipe", "sentence")},
            "line_words": np.log1p(count / lines),
            "repeat_lines": _repeated(text_of[line_first], line_hash, n) / lines if len(words) else np.zeros(n),
            "repeat_3": _repeated(*shingles(words, first, 3), n) / some,
            "repeat_5": _repeated(*shingles(words, first, 5), n) / some,
            "top_word": top / some,
            "distinct": np.bincount(who, minlength=n) / some,
            "non_ascii": _per_text(data >= 0x80, offsets) / size,
            "longest_word": np.log1p(longest),
        }
        parts.append(np.stack([rows[k] for k in NAMES], axis=1).astype(np.float32))
    return np.concatenate(parts) if parts else np.zeros((0, len(NAMES)), np.float32)
