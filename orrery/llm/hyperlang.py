"""Language identification with hyperdimensional profiles.

Every letter has a random +1/-1 vector.  A three-letter window is its letters'
vectors, permuted (rotated) by place and bound by multiplication; a text is the
bundle (sum) of its windows.  A language's prototype is the bundle of its
training texts, each scaled to length one; the prediction is the prototype of
highest cosine.  Runs of other characters count as one blank.

Prototypes are fitted on a bounded sample: about ``PER_LANGUAGE`` labelled texts
of each language, chosen by a hash of doc_id; what leaves the executors is one
vector a language and task.  Every text is scored whole.

Defined results: ``und`` with score 0 for a null text, one without a letter, or
if there is no training text at all; equal cosines go to the smaller language
name; repeated rows get equal rows; an empty table gives no rows; a null doc_id
is never trained on and not held out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import U, mix64

DIMENSIONS = 2048
PER_LANGUAGE = 2000
HELD_OUT, FOLDS = 2, 4
UNKNOWN = "und"
#: Whole texts of learned languages reach 0.3 and more; of texts in left-out ones, 97 of 100 stay below 0.28.
LEAST_COSINE, SURE_AT = 0.28, 200
#: Bytes of text bundled at once, and windows that are multiplied at once.
PIECE_CHARS = 1 << 20
BLOCK = 4096

_letters = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def letter_vectors(codes: np.ndarray, dimensions: int) -> np.ndarray:
    """(len(codes), dimensions) of +1/-1, the same for a code point everywhere."""
    words = mix64(mix64(codes.astype(U))[:, None] + np.arange(dimensions // 64, dtype=U) * U(0x9E3779B97F4A7C15))
    bits = np.unpackbits(words.view(np.uint8), axis=1)
    return (2 * bits.astype(np.int8) - 1)[:, :dimensions]


def bundles(texts: list[str], dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """(len(texts), dimensions) float32 sums of window vectors, and whether a text has a letter."""
    low = [t.lower() for t in texts]
    joined = "\0" + "\0".join(low) + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    text_of = np.repeat(np.arange(len(low)), [len(t) + 1 for t in low])
    text_of = np.concatenate([text_of[:1] if len(text_of) else [0], text_of])
    letter = _is_letter()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of other characters stays, as a blank
    keep[0] = True
    codes, text_of, letter = np.where(letter, codes, 0)[keep], text_of[keep], letter[keep]
    out = np.zeros((len(texts), dimensions), np.float32)
    has = np.zeros(len(texts), bool)
    has[text_of[letter]] = True
    if len(codes) < 3:
        return out, has
    alphabet, symbol = np.unique(codes, return_inverse=True)
    key = (symbol[:-2] * len(alphabet) + symbol[1:-1]) * len(alphabet) + symbol[2:]
    # A window of two texts has the blank between them in its middle; those that end or begin with it belong to one text.
    owner, inside = text_of[1:-1], codes[1:-1] != 0
    key, owner = key[inside], owner[inside]
    windows, which = np.unique(key, return_inverse=True)
    letters = letter_vectors(alphabet, dimensions)
    once, twice = np.roll(letters, 1, axis=1), np.roll(letters, 2, axis=1)
    n = len(alphabet)
    for at in range(0, len(windows), BLOCK):
        here = windows[at : at + BLOCK]
        bound = twice[here // (n * n)] * once[here // n % n] * letters[here % n]
        mine = slice(None) if len(windows) <= BLOCK else np.flatnonzero((which >= at) & (which < at + BLOCK))
        counts = np.bincount(owner[mine] * len(here) + which[mine] - at, minlength=len(texts) * len(here)).reshape(len(texts), len(here))
        out += counts.astype(np.float32) @ bound.astype(np.float32)
    return out, has


def _pieces(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    first, piece, size = 0, [], 0
    for i, t in enumerate(column.to_pylist()):
        piece.append(t or "")
        size += len(piece[-1])
        if size >= PIECE_CHARS or len(piece) >= 2048:
            yield first, piece
            first, piece, size = i + 1, [], 0
    if piece:
        yield first, piece


def _slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(batch), rows):
        yield batch.slice(at, rows)


def _unit(vectors: np.ndarray) -> np.ndarray:
    norm = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    return vectors / np.maximum(norm, 1e-12)


def _sum_by_language(dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in _slices(batch):
                langs = part.column(0).to_pylist()
                for first, texts in _pieces(part.column(1)):
                    vectors, has = bundles(texts, dimensions)
                    for k, (v, ok) in enumerate(zip(_unit(vectors), has)):
                        if ok:
                            lang = langs[first + k]
                            sums[lang] = sums[lang] + v if lang in sums else v.astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["lang", "sums"])

    return run


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """crc32 of doc_id as text, modulo ``folds``, is ``fold``; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def fit_prototypes(docs: DataFrame, trainable: Column, per_language: int = PER_LANGUAGE, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Language names in order, and their unit prototypes, from the ``trainable`` rows with a lang and a text."""
    rows = docs.filter(trainable & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang", "text")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    dice = F.pmod(F.xxhash64("doc_id", F.lit("prototype")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # The choice is made on ids and languages alone; about ``per_language`` ids of each language are broadcast.
    chosen = rows.select("doc_id", "lang").join(counts, "lang").filter(dice * F.col("n") < per_language).select("doc_id").distinct()
    sample = rows.join(F.broadcast(chosen), "doc_id", "left_semi").select("lang", "text")
    parts = sample.repartition(16).mapInArrow(_sum_by_language(dimensions), "lang string, sums array<double>").collect()  # at most 16 rows a language
    names = sorted({p["lang"] for p in parts})
    total = np.zeros((len(names), dimensions))
    for p in sorted(parts, key=lambda p: (p["lang"], p["sums"][:4])):
        total[names.index(p["lang"])] += p["sums"]
    return names, _unit(total)


def _predict(names: list[str], prototypes: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                best, score = [], []
                for _, texts in _pieces(part.column(1)):
                    vectors, has = bundles(texts, prototypes.shape[1])
                    cosine = _unit(vectors) @ prototypes.T if names else np.zeros((len(texts), 1))
                    at = cosine.argmax(axis=1)
                    known = has & bool(names)
                    best += [names[i] if ok else UNKNOWN for i, ok in zip(at, known)]
                    score += np.where(known, np.clip(cosine[np.arange(len(at)), at], 0, 1), 0.0).tolist()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(best, pa.string()), pa.array(np.round(score, 6), pa.float64())], ["row", "lang_pred", "score"])

    return run


def _scored(docs: DataFrame, row: Column, kind: str, trainable: Column, per_language: int, dimensions: int) -> DataFrame:
    names, prototypes = fit_prototypes(docs, trainable, per_language, dimensions)
    return docs.select(row.alias("row"), "text").mapInArrow(_predict(names, prototypes), f"row {kind}, lang_pred string, score double")


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE, dimensions: int = DIMENSIONS) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of ``docs``."""
    held_out = in_fold(F.col("doc_id"), FOLDS, HELD_OUT)
    scored = _scored(docs, F.col("doc_id"), docs.schema["doc_id"].dataType.simpleString(), ~held_out, per_language, dimensions)
    return scored.select(F.col("row").alias("doc_id"), in_fold(F.col("row"), FOLDS, HELD_OUT).alias("held_out"), "lang_pred", "score")


def spoken_documents(docs: DataFrame, least_cosine: float = LEAST_COSINE, sure_at: int = SURE_AT, per_language: int = PER_LANGUAGE, dimensions: int = DIMENSIONS) -> DataFrame:
    """The rows of ``docs`` in a learned language, with their own columns.

    A text is rejected if it has no letter or if its cosine with the best prototype is
    below ``least_cosine``; a text of fewer than ``sure_at`` characters holds few windows,
    so it needs that part of it only.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    kind = docs.select(row.alias("row")).schema["row"].dataType.simpleString()
    trainable = ~in_fold(F.col("doc_id"), FOLDS, HELD_OUT)
    scored = _scored(docs, row, kind, trainable, per_language, dimensions)
    cut = least_cosine * F.least(F.lit(1.0), F.length("row.text") / F.lit(float(sure_at)))
    return scored.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= cut)).select("row.*")
