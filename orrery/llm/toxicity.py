"""Toxic passages by maximum-scoring segment search over token log-odds.

Tokens are lower-cased runs of letters and digits, each standing for itself and
for its stems of ``STEMS`` letters, so inflected forms support one another.  A
token's weight, the largest of these, is the log-odds of toxic against other labelled texts under a Dirichlet prior in
proportion to the pooled frequencies, less ``CAUTION`` standard errors; tokens
whose weight is not above 0 cost ``DRIFT`` each.  Occurrences count once for each
pair of neighbouring tokens, so copies of a text do not vouch for its rare words.

A scan in linear time finds all maximal scoring segments of a text.  By the theory of
local alignment scores, n random tokens hold about n exp(-lambda S) segments of
score S or more, where lambda makes exp(lambda score) average 1 over non-toxic
labelled tokens.  The evidence of a text is -log of the chance count of its
segments together; its score is an extreme-value distribution function of the
evidence, with location and scale fitted to the labels (a log-log regression).

The weights come from at most ``SAMPLE`` labelled documents; only tokens of
positive weight, and how often each such weight occurs, reach the driver.  All texts are scanned whole.  No label, lang,
source or id enters a score.

Defined results: null and empty texts score 0; without labels of both kinds every
score is 0; repeated rows get equal rows; an empty table gives no rows; a null
doc_id is kept, not held out.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, label_sample
from .scratch import Scratch
from .words import U, mix64

SAMPLE = 8_000
STEMS = (4, 5, 6, 7)
#: Part of all counted occurrences that the prior weighs.
PRIOR = 0.1
CAUTION = 3.0
DRIFT = 0.25
#: Segments of an expected chance count above this are not passages.
SIGNIFICANT = 1.0
CUT = 0.5
MEMO = 500_000

TOKEN = re.compile(r"[^\W_]+")


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def stems(token: str) -> list[str]:
    """The token, and its stems marked as such."""
    return [token] + [token[:k] + "-" for k in STEMS if len(token) > k]


class _Memo(dict):
    """Weights of the tokens seen, forgotten when there are too many."""

    def __init__(self, model: Model):
        self.model = model

    def __missing__(self, token: str) -> float:
        if len(self) >= MEMO:
            self.clear()
        found = self[token] = self.model.weight(token)
        return found


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    decay: float = 1.0  # lambda
    location: float = 0.0
    scale: float = 1.0

    def memo(self) -> dict[str, float]:
        """token -> weight, looked up once for each token."""
        return _Memo(self)

    def weight(self, token: str) -> float:
        """0 for a token without a positive weight."""
        get = self.weights.get
        return max(get(token, 0.0), get(token[:4] + "-", 0.0), get(token[:5] + "-", 0.0), get(token[:6] + "-", 0.0), get(token[:7] + "-", 0.0)) if len(token) > 4 else get(token, 0.0)

    def chance(self, score: float, n: int) -> float:
        return n * math.exp(-self.decay * score)

    def calibrated(self, evidence: float) -> float:
        return math.exp(-math.exp(min(-(evidence - self.location) / self.scale, 50.0)))


def maximal_segments(places: list[int], weights: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (first, end, score).

    ``places`` of tokens with positive ``weights``, ascending; every other token
    scores -drift.  Each candidate keeps the running sums at both its ends and the
    nearest earlier candidate that began lower.  A new one joins that candidate if it
    ends higher; where there is none, all earlier candidates are final.  Links passed
    once are not passed again, so the time is linear.
    """
    out: list[tuple[int, int, float]] = []
    first, end, low, high, lower = [], [], [], [], []  # of the candidates
    total, previous = 0.0, 0
    for at, w in zip(places, weights):
        total -= drift * (at - previous)
        begin, before = at, total
        total += w
        previous = at + 1
        j = len(low) - 1
        while True:
            while j >= 0 and low[j] >= before:
                j = lower[j]
            if j < 0:
                out += [(a, b, y - x) for a, b, x, y in zip(first, end, low, high)]
                first, end, low, high, lower = [begin], [previous], [before], [total], [-1]
                break
            if high[j] >= total:
                first.append(begin), end.append(previous), low.append(before), high.append(total), lower.append(j)
                break
            begin, before, below = first[j], low[j], lower[j]
            del first[j:], end[j:], low[j:], high[j:], lower[j:]
            j = below
    return out + [(a, b, y - x) for a, b, x, y in zip(first, end, low, high)]


def scan(model: Model, text: str, memo: dict[str, float] | None = None) -> tuple[list[tuple[int, int, float]], int]:
    """Significant segments (in tokens), and the number of tokens."""
    words = tokens(text)
    weight = (model.memo() if memo is None else memo).__getitem__
    marked = [(i, w) for i, w in enumerate(map(weight, words)) if w]
    if not marked:
        return [], len(words)
    segments = maximal_segments([i for i, _ in marked], [w for _, w in marked], DRIFT)
    return [s for s in segments if model.chance(s[2], len(words)) <= SIGNIFICANT], len(words)


def evidence(model: Model, text: str, memo: dict[str, float] | None = None) -> tuple[float, int, int]:
    """(evidence, passages, tokens in them); without a passage the evidence is 0."""
    segments, n = scan(model, text, memo)
    # Of r chance segments, the sum has about n^r / r! times the tail of one.
    r = len(segments)
    total = model.decay * sum(s for _, _, s in segments) + math.lgamma(r + 1) - (r * math.log(n) if r else 0)
    return total, r, sum(b - a for a, b, _ in segments)


def score(model: Model, text: str, memo: dict[str, float] | None = None) -> tuple[float, int, int]:
    """(score, passages, tokens in them); without a passage the score is 0."""
    found, r, k = evidence(model, text, memo)
    return (model.calibrated(found) if r else 0.0), r, k


def fit_extremes(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Location and scale for which exp(-exp(-(x - location) / scale)) is likeliest for labels y."""
    best = (-np.inf, 0.0, 1.0)
    lowest, highest = (float(x.min()), float(x.max())) if len(x) else (0.0, 1.0)
    spans = np.geomspace(0.05, 2.0, 24) * max(highest - lowest, 1.0)
    for location in np.linspace(lowest, highest, 200):
        for scale in spans / 10:
            p = np.clip(np.exp(-np.exp(np.minimum(-(x - location) / scale, 50))), 1e-6, 1 - 1e-6)
            best = max(best, (float((y * np.log(p) + (1 - y) * np.log(1 - p)).sum()), float(location), float(scale)))
    return round(best[1], 6), round(best[2], 6)


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """label, text -> distinct (token, neighbours, label)."""
    seen: dict[int, dict[str, set[int]]] = {0: defaultdict(set), 1: defaultdict(set)}
    for batch in batches:
        for label, text in zip(batch.column(0), batch.column(1)):
            words = tokens(text.as_py() or "")
            ids = np.fromiter((zlib.crc32(w.encode()) for w in words), U, len(words))
            near = np.zeros(len(ids) + 2, U)
            near[1:-1] = ids
            around = mix64(near[:-2] ^ (near[2:] << U(1))).view(np.int64).tolist()
            mine = seen[label.as_py()]
            for w, c in zip(words, around):
                mine[w].add(c)
    for label, of in seen.items():
        for at in range(0, len(of), 4096):
            part = list(of.items())[at : at + 4096]
            rows = [(w, c) for w, cs in part for c in cs]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([c for _, c in rows], pa.int64()), pa.array([label] * len(rows), pa.int32())], ["token", "near", "label"])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Model:
    chosen = label_sample(labels, label, sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("label", "text")  # at most ``sample`` ids
    found = texts.mapInArrow(_occurrences, "token string, near long, label int").distinct()
    by_token = found.groupBy("token").agg(F.sum("label").cast("double").alias("y1"), F.sum(1 - F.col("label")).cast("double").alias("y0"))
    scratch = Scratch(docs.sparkSession, "toxicity")
    by_token = scratch.keep(by_token, "tokens")
    sums = by_token.agg(F.sum("y1"), F.sum("y0")).first()
    n1, n0 = (sums[0] or 0.0), (sums[1] or 0.0)
    if not n1 or not n0:
        return Model()
    forms = F.array("token", *[F.when(F.length("token") > k, F.concat(F.substring("token", 1, k), F.lit("-"))) for k in STEMS])
    counts = by_token.select(F.explode(F.array_compact(forms)).alias("token"), "y1", "y0").groupBy("token").agg(F.sum("y1").alias("y1"), F.sum("y0").alias("y0"))
    mass = PRIOR * (n1 + n0)
    prior = PRIOR * (F.col("y1") + F.col("y0"))
    odds = lambda y, n: F.log((y + prior) / (n + mass - y - prior))
    error = F.sqrt(1 / (F.col("y1") + prior) + 1 / (F.col("y0") + prior))
    weight = odds(F.col("y1"), F.lit(n1)) - odds(F.col("y0"), F.lit(n0)) - CAUTION * error
    weights = {r["token"]: round(r["weight"], 6) for r in counts.withColumn("weight", weight).filter("weight > 0").select("token", "weight").collect()}
    # What each token scores, and how often non-toxic texts have it; unseen there counts as half an occurrence.
    model = Model(weights)
    rated = by_token.mapInArrow(_rates(model), "weight double, y0 double").filter("weight > 0")
    rates = [(r["weight"], r["y0"] / n0) for r in rated.groupBy("weight").agg(F.sum("y0").alias("y0")).orderBy("weight").collect()]  # as many as weights, at most
    low, high = 0.0, 50.0
    for _ in range(100):
        mid = (low + high) / 2
        rest = 1 - sum(p for _, p in rates)
        mean = rest * math.exp(-mid * DRIFT) + sum(p * math.exp(min(mid * s, 600)) for s, p in rates)
        low, high = (mid, high) if mean < 1 else (low, mid)
    model.decay = round(low, 6)
    pairs = sorted(map(tuple, texts.mapInArrow(_evidence_rows(model), "label int, evidence double").filter("evidence <> 0").collect()))
    model.location, model.scale = fit_extremes(np.array([e for _, e in pairs]), np.array([y for y, _ in pairs], float))
    scratch.drop("tokens")
    return model


def _rates(model: Model):
    """token, y1, y0 -> weight, y0 (half an occurrence if none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = [model.weight(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(weights, pa.float64()), pc.max_element_wise(batch.column(2), 0.5)], ["weight", "y0"])

    return run


def _evidence_rows(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = model.memo()
        for batch in batches:
            found = [round(evidence(model, t.as_py() or "", memo)[0], 6) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["label", "evidence"])

    return run


def classify(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages, n_passage_tokens for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = model.memo()
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                out = [score(model, t.as_py() or "", memo) for t in part.column(1)]
                s, n, k = ([o[i] for o in out] for i in range(3))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.round(s, 6), pa.float64()), pa.array(n, pa.int64()), pa.array(k, pa.int64())], ["doc_id", "score", "n_passages", "n_passage_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, n_passages long, n_passage_tokens long")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"), "n_passages", "n_passage_tokens")


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each significant passage: doc_id, first and end character, score, expected chance count, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "first", "end", "score", "chance", "passage"]
        memo = model.memo()
        for batch in batches:
            keep, rows = [], []
            for i, t in enumerate(batch.column(1)):
                text = t.as_py() or ""
                segments, n = scan(model, text, memo)
                spans = [m.span() for m in TOKEN.finditer(text.lower())] if segments else []
                for a, b, s in segments:
                    keep.append(i)
                    # Lower-casing can lengthen a text; then offsets are those of the lower-cased one.
                    rows.append((spans[a][0], spans[b - 1][1], s, model.chance(s, n), text[spans[a][0] : spans[b - 1][1]]))
            types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string()]
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), *columns], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, first long, end long, score double, chance double, passage string")
