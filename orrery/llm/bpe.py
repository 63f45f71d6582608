"""Byte-level BPE by overlapping chunks, and decoding by joining raw bytes.

A text longer than ``CHUNK`` characters becomes chunks that overlap by
``OVERLAP``, each a row of its own.  Chunks are pre-tokenised and encoded in
parallel, wherever they land.  Two neighbours are stitched at the first
pre-token boundary that both have: the pattern never looks back, so from a common
boundary on both see the same pre-tokens.  The last ``MARGIN`` characters before
a cut are not trusted, as the pattern looks ahead.  If neighbours share no
boundary (one pre-token longer than the overlap), the text is pre-tokenised
again from the last boundary that is certain.  Only then are the ids joined.

Defined results: a null or empty text has no ids; repeated rows each get a row;
an empty table gives no rows; a null doc_id is kept; extra columns do not enter.
Lone surrogates cannot occur in a Spark string.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANKS = "byte_bpe_50k.tiktoken"
CHUNK = 1 << 15
OVERLAP = 1 << 10
#: The longest look of the pattern past a pre-token's end.
MARGIN = 4
#: Encoded pre-tokens that a worker remembers.
CACHE = 200_000


class Coder:
    """Ranks and pattern of one tokenizer; one a worker."""

    _made: dict[str, Coder] = {}

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.merges = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.known: dict[str, list[int]] = {}

    @classmethod
    def of(cls, name: str) -> Coder:
        """``name``: a file of the public tokenizers, or a path."""
        if name not in cls._made:
            cls._made[name] = cls(name if "/" in name else public_tokenizers.path(name), public_tokenizers.PATTERN)
        return cls._made[name]

    def piece(self, piece: str) -> list[int]:
        ids = self.known.get(piece)
        if ids is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            ids = self.known[piece] = self.merges._encode_single_piece(piece)
        return ids

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        known, piece = self.known, self.piece
        for p in self.pattern.findall(text):
            ids += known.get(p) or piece(p)
        return ids

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def stitch(chunks: list[tuple[int, str, list[int], list[int], list[int]]], coder: Coder) -> list[int]:
    """Ids of a whole text from its chunks in order: (start, text, piece ends, ids up to each end, ids).

    Ends are characters of the whole text.  Every chunk but the last is cut.
    """
    ids: list[int] = []
    at = 0  # up to here the text is encoded
    for k, (start, text, ends, upto, own) in enumerate(chunks):
        last = k == len(chunks) - 1
        sure = ends if last else ends[: bisect_left(ends, start + len(text) - MARGIN + 1)]
        i = bisect_left(sure, at)
        if at == start:
            done = 0
        elif i < len(sure) and sure[i] == at:
            done = upto[i]
        else:  # the neighbours have not met: begin anew at the last certain boundary
            text, start = "".join([*_gap(chunks[: k + 1], at), text[max(0, at - start) :]]), at
            found = list(coder.pattern.finditer(text))
            ends = [start + m.end() for m in found]
            own, upto = [], []
            for m in found:
                own += coder.piece(m.group())
                upto.append(len(own))
            sure = ends if last else ends[: bisect_left(ends, start + len(text) - MARGIN + 1)]
            done = 0
        # Stop at the last certain boundary that the next chunk has too, if there is one.
        stop = len(sure) - 1
        if not last:
            nxt = set(chunks[k + 1][2]) | {chunks[k + 1][0]}
            while stop >= 0 and sure[stop] not in nxt:
                stop -= 1
            if stop < 0 or sure[stop] < at:
                stop = len(sure) - 1
        if stop < 0 or sure[stop] < at:
            continue
        ids += own[done : upto[stop]]
        at = sure[stop]
    return ids


def _gap(chunks, at: int) -> list[str]:
    """The text from ``at`` to the start of the last of ``chunks``, from those before it."""
    parts, end = [], chunks[-1][0]
    for (start, text, *_), (following, *_rest) in zip(chunks[:-1], chunks[1:]):
        upto = min(end, following)
        if upto > at:
            parts.append(text[max(0, at - start) : upto - start])
            at = max(at, upto)
    return parts


def _digest(coder: Coder, ids) -> tuple[int, str, str]:
    raw = np.asarray(ids, "<u4").tobytes()
    return len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest()


def _encode_rows(name: str, results: Callable, names: list[str], types: list[pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of(name)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                out = [results(coder, coder.encode(t.as_py() or "")) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([o[i] for o in out], t) for i, t in enumerate(types)]], ["row", *names])

    return run


def _encode_chunks(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of(name)
        for batch in batches:
            for at in range(len(batch)):
                part = batch.slice(at, 1)
                start, text = part.column(2)[0].as_py(), part.column(3)[0].as_py()
                ends, upto, ids = [], [], []
                for m in coder.pattern.finditer(text):
                    ids += coder.piece(m.group())
                    ends.append(start + m.end())
                    upto.append(len(ids))
                lists = [pa.array([x], pa.list_(pa.int64() if x is ends else pa.int32())) for x in (ends, upto, ids)]
                yield pa.RecordBatch.from_arrays([*part.columns, *lists], ["row", "key", "start", "chunk", "ends", "upto", "ids"])

    return run


def _stitch_group(name: str, results: Callable, names: list[str], types: list[pa.DataType]):
    def run(table: pa.Table) -> pa.Table:
        coder = Coder.of(name)
        table = table.sort_by("start")
        starts = table.column("start").to_pylist()
        copies = starts.count(0)  # equal rows have equal chunks; one set is enough
        first = table.take([i for i, s in enumerate(starts) if i == 0 or s != starts[i - 1]])
        chunks = list(zip(*[first.column(c).to_pylist() for c in ("start", "chunk", "ends", "upto", "ids")]))
        out = results(coder, stitch(chunks, coder))
        row = pa.concat_arrays([table.column("row").combine_chunks().slice(0, 1)] * copies) if copies > 1 else table.column("row").combine_chunks().slice(0, 1)
        return pa.table([row, *[pa.array([o] * copies, t) for o, t in zip(out, types)]], names=["row", *names])

    return run


def _apply(docs: DataFrame, row: Column, results: Callable, fields: str, names: list[str], types: list[pa.DataType], ranks: str, chunk: int, overlap: int) -> DataFrame:
    rows = docs.select(row.alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    short = rows.filter(F.length("text") <= chunk).mapInArrow(_encode_rows(ranks, results, names, types), f"row {kind}, {fields}")
    step = chunk - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - overlap - 1, F.lit(0)), F.lit(step))
    long = rows.filter(F.length("text") > chunk).select("row", "text", F.sha2(F.concat_ws("\0", F.to_json(F.struct("row")), "text"), 256).alias("key"), F.explode(starts).alias("start"))
    chunks = long.select("row", "key", F.col("start").cast("long").alias("start"), F.substring("text", F.col("start") + 1, F.lit(chunk)).alias("chunk"))
    encoded = chunks.repartition("key", "start").mapInArrow(_encode_chunks(ranks), f"row {kind}, key string, start long, chunk string, ends array<long>, upto array<int>, ids array<int>")
    stitched = encoded.groupBy("key").applyInArrow(_stitch_group(ranks, results, names, types), f"row {kind}, {fields}")
    return short.unionByName(stitched)


def digests(docs: DataFrame, ranks: str = RANKS, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (little-endian unsigned 32-bit ids), decoded_sha256, for each row."""
    types = [pa.int64(), pa.string(), pa.string()]
    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
    out = _apply(docs, F.col("doc_id"), _digest, "n_tokens long, ids_sha256 string, decoded_sha256 string", names, types, ranks, chunk, overlap)
    return out.withColumnRenamed("row", "doc_id")


def _digest_and_ids(coder: Coder, ids) -> tuple:
    return (*_digest(coder, ids), ids)


def encode_with_digests(docs: DataFrame, ranks: str = RANKS, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``digests`` and ``encode`` in one: doc_id, n_tokens, ids_sha256, decoded_sha256, ids."""
    types = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())]
    names = ["n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>"
    return _apply(docs, F.col("doc_id"), _digest_and_ids, fields, names, types, ranks, chunk, overlap).withColumnRenamed("row", "doc_id")


def encode(docs: DataFrame, ranks: str = RANKS, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id and ``ids``, the token ids of each whole text."""
    out = _apply(docs, F.col("doc_id"), _only_ids, "ids array<int>", ["ids"], [pa.list_(pa.int32())], ranks, chunk, overlap)
    return out.withColumnRenamed("row", "doc_id")


def _only_ids(coder: Coder, ids) -> tuple:
    return (ids,)


def decode(encoded: DataFrame, ranks: str = RANKS) -> DataFrame:
    """doc_id and ``raw``, the bytes that the ids stand for; null ids are no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of(ranks)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([coder.decode(x.as_py() or []) for x in part.column(1)], pa.binary())], ["doc_id", "raw"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, raw binary")
