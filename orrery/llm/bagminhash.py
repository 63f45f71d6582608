"""Near-duplicate texts by BagMinHash: weighted-Jaccard signatures, bands, exact overlap.

A text is the multiset of its five-word shingles.  Its signature has one smallest
point per component of Poisson processes that run, for every shingle, over the
levels of its weight: level blocks [0,1), [1,2), [2,4), [4,8), ... each have one
process whose points are thinned to the levels below the weight.  Two texts agree
in a component with a probability equal to their weighted Jaccard similarity.

Texts of one content are one node.  Nodes that share a band of components are
compared, but a bucket's texts never meet all at once:

1. In each bucket every node meets the bucket's most connected node, the pivot.
   The multiset overlap is exact.  Links found make nodes one class.
2. Of what remains, only pairs of a bucket in different classes can matter, and
   only if an exact bound on their overlap allows a link: overlap with the pivot
   and shingles that occur in no other candidate bound it from above.  Numbers
   alone decide that, without the texts; the pairs left are compared too.  So no
   pair of a bucket is left undecided.

Classes are the connected components of the links.  With ``ROWS`` x ``BANDS``
components a pair of similarity 0.8 shares no bucket with probability 5e-6.

Defined results: a text without words (null, empty) is a class of its own; a text
of fewer than five words has one shingle of all its words; repeated rows and
copies share a class; a doc_id that occurs with several texts has a row for each; an
empty table gives no rows; a null doc_id is kept and never names a class that has
another; extra columns do not enter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch
from .words import U, counted, mix64, shingles, text_pieces, word_hashes, word_spans

WIDTH = 5
THRESHOLD = 0.8
BANDS = 40
ROWS = 6
SEED = 20240101
#: Points that are drawn at once once few processes are left.
DRAWS = 4096


def signatures(owner: np.ndarray, h: np.ndarray, weight: np.ndarray, n_texts: int, m: int, seed: int = SEED) -> np.ndarray:
    """(n_texts, m) smallest points, infinite for texts without elements.

    ``owner``, ``h``, ``weight``: text, element hash and integer weight (levels) of each element.
    """
    blocks = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1
    which = np.repeat(np.arange(len(h)), blocks)
    k = np.arange(len(which)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    low = np.where(k > 0, 1 << np.maximum(k - 1, 0), 0)
    span = np.maximum(low, 1)  # of the block [low, low + span)
    text, limit = owner[which], weight[which]
    state = mix64(mix64(h[which] ^ U(seed)) + k.astype(U))
    rate = span.astype(np.float64) * m
    time = np.zeros(len(which))
    step = np.zeros(len(which), np.int64)
    sig = np.full((n_texts, m), np.inf)
    flat, worst = sig.reshape(-1), np.full(n_texts, np.inf)
    while len(state):
        draws = int(np.clip(DRAWS // len(state), 1, 64))
        turn = step[:, None] + np.arange(draws)
        r = mix64(state[:, None] + turn.astype(U) * U(0xD1342543DE82EF95))
        gaps = -np.log(((r >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate[:, None]
        times = np.cumsum(np.concatenate([time[:, None], gaps], axis=1), axis=1)[:, 1:]
        mark = mix64(r ^ U(0xA0761D6478BD642F))
        level = low[:, None] + ((mark >> U(32)).astype(np.int64) % span[:, None])
        use = (level < limit[:, None]) & (times < worst[text][:, None])
        place = text[:, None] * m + ((mark & U(0xFFFFFFFF)) % U(m)).astype(np.int64)
        np.minimum.at(flat, place[use], times[use])
        live = np.unique(text)
        worst[live] = sig[live].max(axis=1)
        going = times[:, -1] < worst[text]
        text, limit, state, rate, low, span = text[going], limit[going], state[going], rate[going], low[going], span[going]
        time, step = times[going, -1], step[going] + draws
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(n_texts, bands) signed 64-bit bucket keys; the band's number is part of the key."""
    bits = sig[:, : bands * rows].view(U).reshape(len(sig), bands, rows)
    key = np.broadcast_to(mix64(np.arange(bands, dtype=U)), bits.shape[:2]).copy()
    for k in range(rows):
        key = mix64(key ^ bits[:, :, k])
    return key.view(np.int64)


def _digests(owner: np.ndarray, h: np.ndarray, weight: np.ndarray, n_texts: int) -> np.ndarray:
    """(n_texts, 2) order-free 128-bit digests of the multisets."""
    out = np.zeros((n_texts, 2), U)
    for c, salt in enumerate((0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179)):
        np.add.at(out[:, c], owner, mix64(mix64(h ^ U(salt)) + weight.astype(U)))
    return out


def _sign(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in text_pieces(batch.column(1)):
                starts, ends, first = word_spans(data, offsets)
                owner, h, w = counted(*shingles(word_hashes(data, starts, ends), first, WIDTH))
                n = end - row
                sig = signatures(owner, h, w, n, bands * rows)
                total = np.bincount(owner, w, n).astype(np.int64)
                nodes = [d.tobytes() if t else None for d, t in zip(_digests(owner, h, w, n), total)]
                keys = band_keys(sig, bands, rows)
                lists = pa.ListArray.from_arrays(np.arange(0, n * bands + 1, bands, dtype=np.int32), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, n), batch.column(2).slice(row, n), pa.array(nodes, pa.binary()), pa.array(total), lists], ["doc_id", "h", "node", "n", "bands"]
                )

    return run


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, text -> node, bag: the sorted shingle hashes and, after them, their counts.

    A text that is not the node's (should two texts share a hash) gives no row.
    """
    for batch in batches:
        for row, end, data, offsets in text_pieces(batch.column(1)):
            starts, ends, first = word_spans(data, offsets)
            owner, h, w = counted(*shingles(word_hashes(data, starts, ends), first, WIDTH))
            cut = np.searchsorted(owner, np.arange(end - row + 1))
            bags = [np.concatenate([h[a:b], w[a:b].astype(U)]).tobytes() if (w[a:b] > 1).any() else h[a:b].tobytes() + b"1" for a, b in zip(cut[:-1], cut[1:])]
            nodes = batch.column(0).slice(row, end - row)
            own = pa.array([d.tobytes() == x.as_py() for d, x in zip(_digests(owner, h, w, end - row), nodes)], pa.bool_())
            yield pa.RecordBatch.from_arrays([nodes, pa.array(bags, pa.binary())], ["node", "bag"]).filter(own)


def _unbag(bag: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A bag whose counts are all one ends in one odd byte instead of the counts."""
    if len(bag) % 8:
        h = np.frombuffer(bag, U, len(bag) // 8)
        return h, np.ones(len(h), np.int64)
    both = np.frombuffer(bag, U)
    return both[: len(both) // 2], both[len(both) // 2 :].astype(np.int64)


def bag_overlap(a: bytes, b: bytes) -> int:
    """Size of the multiset intersection."""
    (ha, wa), (hb, wb) = _unbag(a), _unbag(b)
    at = np.searchsorted(hb, ha)
    at[at == len(hb)] = 0
    hit = hb[at] == ha
    return int(np.minimum(wa[hit], wb[at[hit]]).sum())


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shared = [bag_overlap(a.as_py(), b.as_py()) for a, b in zip(batch.column(2), batch.column(3))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared, pa.int64())], ["a", "b", "overlap"])


def _compare(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """(a, b) -> (a, b, overlap)."""
    left = bags.select(F.col("node").alias("a"), F.col("bag").alias("bag_a"))
    right = bags.select(F.col("node").alias("b"), F.col("bag").alias("bag_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "bag_a", "bag_b")
    return both.mapInArrow(_overlaps, "a binary, b binary, overlap long")


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for node, bag in zip(batch.column(0), batch.column(1)):
            h, w = _unbag(bag.as_py())
            yield pa.RecordBatch.from_arrays([pa.array([node.as_py()] * len(h), pa.binary()), pa.array(h.view(np.int64)), pa.array(w)], ["node", "h", "w"])


def _link(overlap, na, nb, threshold: float):
    return overlap >= threshold * (na + nb - overlap)


def _hashed(docs: DataFrame, *others: Column) -> DataFrame:
    """doc_id, text and h, which with doc_id tells rows of different texts apart."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("h"), *others)


def _same_row(left: str, right: str) -> Column:
    return (F.col(f"{left}.h") == F.col(f"{right}.h")) & F.col(f"{left}.doc_id").eqNullSafe(F.col(f"{right}.doc_id"))


def _classes(docs: DataFrame, threshold: float, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, node) for each row of ``docs``, and (node, class) for the linked nodes."""
    scratch = Scratch(docs.sparkSession, "bagminhash")
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = _hashed(docs).mapInArrow(_sign(bands, rows), f"doc_id {kind}, h long, node binary, n long, bands array<long>")
    signed = scratch.keep(signed, "signed")

    # Copies: one node per content.  Of each, one row stands for it, a named one if there is any.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "h")).alias("row")
    contents = signed.filter("node is not null").groupBy("node").agg(first, F.first("n").alias("n"), F.first("bands").alias("bands"))
    contents = scratch.keep(contents, "contents")
    keys = contents.select("node", "n", F.explode("bands").alias("key"))
    sizes = keys.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    member = scratch.keep(keys.join(sizes, "key"), "members")
    degrees = scratch.keep(member.groupBy("node").agg(F.sum("size").alias("degree")), "degrees")

    # Always by a shuffle: the candidates grow with the corpus, so a broadcast would only ever fit small ones.
    candidates = contents.join(degrees, "node", "left_semi").select("node", "row.doc_id", "row.h")
    source = _hashed(docs).alias("t").hint("merge").join(candidates.alias("c"), _same_row("t", "c")).select("node", "text")
    bags = source.mapInArrow(_bags, "node binary, bag binary").groupBy("node").agg(F.first("bag").alias("bag"))
    bags = scratch.keep(bags, "bags")

    # 1. Every node of a bucket against the most connected one.
    member = member.drop("size").join(degrees, "node")
    central = member.groupBy("key").agg(F.max(F.struct("degree", "node", "n")).alias("pivot"))
    member = member.join(central, "key").select("key", "node", "n", F.col("pivot.node").alias("pivot"), F.col("pivot.n").alias("pivot_n"))
    member = scratch.keep(member, "starred")
    stars = member.filter("node <> pivot").groupBy(F.col("node").alias("a"), F.col("pivot").alias("b")).agg(F.first("n").alias("na"), F.first("pivot_n").alias("nb"))
    # A length ratio below the threshold rules a link out without a look at the texts,
    # but the overlap is of use below; only those without it are spared.
    measured = _compare(stars.select("a", "b"), bags).join(stars, ["a", "b"])
    measured = scratch.keep(measured.withColumn("linked", _link(F.col("overlap"), F.col("na"), F.col("nb"), threshold)), "measured")
    links = measured.filter("linked").select("a", "b")
    classes = components(scratch, links)

    # 2. Pairs of a bucket that are still in different classes and can reach the threshold.
    classed = member.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    mixed = classed.groupBy("key").agg(F.min("class").alias("least"), F.max("class").alias("most")).filter("least <> most").select("key")
    left = classed.join(mixed, "key").join(measured.select(F.col("a").alias("node"), F.col("b").alias("pivot"), "overlap"), ["node", "pivot"], "left")
    left = scratch.keep(left.withColumn("with_pivot", F.coalesce("overlap", "n")).drop("overlap"), "undecided")
    open_bags = bags.join(left.select("node").distinct(), "node", "left_semi")
    rows_of = scratch.keep(open_bags.mapInArrow(_shingle_rows, "node binary, h long, w long"), "shingles")
    common = rows_of.groupBy("h").agg(F.count("*").alias("texts")).filter("texts > 1").select("h")
    shared = rows_of.join(common, "h").groupBy("node").agg(F.sum("w").alias("shared"))
    able = scratch.keep(left.join(shared, "node").filter(F.col("shared") >= threshold * F.col("n")), "able")
    x, y = able.alias("x"), able.alias("y")
    bound = F.least("x.with_pivot", "y.with_pivot") + F.least(F.col("x.shared") - F.col("x.with_pivot"), F.col("y.shared") - F.col("y.with_pivot"))
    can = _link(bound, F.col("x.n"), F.col("y.n"), threshold)
    unmet = (F.col("x.node") != F.col("x.pivot")) & (F.col("y.node") != F.col("y.pivot"))
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.class") != F.col("y.class")) & unmet & can)
    pairs = pairs.groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b")).agg(F.first("x.n").alias("na"), F.first("y.n").alias("nb"))
    pairs = scratch.keep(pairs, "pairs")
    more = _compare(pairs.select("a", "b"), bags).join(pairs, ["a", "b"])
    more = scratch.keep(more.filter(_link(F.col("overlap"), F.col("na"), F.col("nb"), threshold)).select("a", "b"), "more")
    if not more.isEmpty():
        classes = components(scratch, links.unionByName(more))

    # What follows reads only the rows with their nodes, and the classes.
    scratch.drop("contents", "members", "degrees", "bags", "starred", "measured", "undecided", "shingles", "able", "pairs", "more")
    found = scratch.keep(signed.select("doc_id", "h", "node"), "rows")
    scratch.drop("signed")
    return found, classes


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (smallest doc_id of the class), class_size, n_copies (rows of the same content)."""
    found, classes = _classes(docs, threshold, bands, rows)
    contents = found.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    named = contents.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    per_class = named.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.sum("copies").alias("class_size"))
    named = named.select("node", "class", "copies").join(per_class, "class").select("node", "class_id", "class_size", "copies")
    out = found.select("doc_id", "node").join(named, "node", "left")
    return out.select("doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"), F.coalesce("copies", F.lit(1)).alias("n_copies"))


def distinct_documents(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The rows of ``docs``, with their columns, that stand for their class.

    Of each class one row stays: that of the smallest doc_id, nulls last, then of the
    smallest hash of the text, so it need not be named and its doc_id may occur with
    other texts.  Rows equal in doc_id and text are one.  A text without words is
    like no other; one row stays of each such text and doc_id.
    """
    found, classes = _classes(docs, threshold, bands, rows)
    classed = found.join(classes, "node", "left").select("doc_id", "h", F.coalesce("class", "node").alias("class"))
    each = classed.groupBy("class", "doc_id", "h").agg(F.count("*").alias("times"))
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "h", "times")
    keepers = each.filter("class is not null").groupBy("class").agg(F.min(row).alias("row")).select("row.doc_id", "row.h", "row.times")
    keepers = keepers.unionByName(each.filter("class is null").select("doc_id", "h", "times"))
    boxed = _hashed(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = boxed.alias("d").join(keepers.alias("k"), _same_row("d", "k")).select("d.doc_id", "d.h", "d.row", "k.times")
    once = kept.filter("times = 1").select("row.*")
    return once.unionByName(kept.filter("times > 1").dropDuplicates(["doc_id", "h"]).select("row.*"))
