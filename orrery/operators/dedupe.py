"""Near-duplicate articles of a symbol within a few business days, first one kept.

Each article is packed once as its bag; articles are compared in blocks
(``bag_products``), so neither pairs nor tokens of pairs are ever shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bag_tokens
from ..functions.times import business_days
from .bag_products import Block, chunks, pack

#: Articles of a block that the others come to, and symbol-days up to which their list is sent to all.
BLOCK, FEW = 8192, 100_000
#: Pairs to a batch of results, and articles whose turn it is at once where order matters.
PAIRS, TURN = 1 << 16, 2048


def bags(articles: DataFrame) -> DataFrame:
    """One row per (symbol, doc, token): its count c, and the bag's norm.  Texts without tokens have none."""
    tokens = articles.select("symbol", "day", "doc", F.explode(bag_tokens("text")).alias("token"))
    counts = tokens.groupBy("symbol", "day", "doc", "token").agg(F.count("*").alias("c"))
    return counts.withColumn("norm", F.sqrt(F.sum(F.col("c") * F.col("c")).over(Window.partitionBy("symbol", "doc"))))


def norms(articles: DataFrame) -> DataFrame:
    """symbol, doc, n_terms, n_tokens, norm."""
    return bags(articles).groupBy("symbol", "doc").agg(F.count("*").alias("n_terms"), F.sum("c").alias("n_tokens"), F.first("norm").alias("norm"))


def _packed(articles: DataFrame) -> DataFrame:
    """symbol, day, doc, bag of the articles that can be compared."""
    hashes = F.transform(bag_tokens("text"), lambda t: F.xxhash64(t))
    return _dated(articles).select("symbol", "day", "doc", hashes.alias("tokens")).mapInArrow(pack, "symbol string, day date, doc long, bag binary")


def _dated(articles: DataFrame) -> DataFrame:
    return articles.filter("symbol is not null and day is not null and doc is not null")


def _homes(articles: DataFrame, window_days: int, block: int) -> DataFrame:
    """symbol, day, parts of the day, its first block, and the blocks of the symbol that its articles have to meet.

    A block has consecutive days of a symbol; a day of more than ``block`` articles has several.
    """
    per_day = _dated(articles).groupBy("symbol", "day").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("symbol").orderBy("day")) - F.col("n")
    days = per_day.select("symbol", "day", F.floor(before / block).alias("first"), F.ceil(F.col("n") / block).alias("parts"))
    part = days.select("symbol", "day", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    blocks = part.groupBy("symbol", "first", "part").agg(F.min("day").alias("from"), F.max("day").alias("to"))
    x, y = days.alias("x"), blocks.alias("y")
    meet = (F.col("x.symbol") == F.col("y.symbol")) & (F.col("x.day") <= F.col("y.to")) & (business_days("x.day", "y.from") <= window_days)
    met = x.join(y, meet).groupBy("x.symbol", "x.day", "x.first", "x.parts")
    return met.agg(F.collect_list(F.struct(F.col("y.first").alias("first"), F.col("y.part").alias("part"))).alias("homes"))


def similar_pairs(articles: DataFrame, threshold: float = 0.8, window_days: int = 5, block: int = BLOCK) -> DataFrame:
    """symbol, earlier, later, cosine for all pairs of at least ``threshold`` within ``window_days`` business days.

    articles: symbol, day, doc (unique, orders articles within a day), text.  A symbol's
    articles lie in blocks of consecutive days; those that have a later one within the
    window in a block come to it, and meet its articles there.
    """
    homes = _homes(articles, window_days, block)
    homes = F.broadcast(homes) if homes.limit(FEW + 1).count() <= FEW else homes
    own = F.struct(F.col("first"), F.pmod(F.xxhash64("doc"), F.col("parts")).alias("part"))
    sent = _packed(articles).join(homes, ["symbol", "day"]).withColumn("own", own).withColumn("home", F.explode("homes"))
    sent = sent.select("symbol", F.col("home.first").alias("first"), F.col("home.part").alias("part"), (F.col("home") == F.col("own")).alias("own"), "day", "doc", "bag")
    # The block's own articles are first; they come to it once more, to meet one another.
    sent = sent.withColumn("role", F.explode(F.when(F.col("own"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1))))).drop("own")
    ordered = sent.repartition("symbol", "first", "part").sortWithinPartitions("symbol", "first", "part", "role", "day", "doc")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, parts, ready = None, [], None
        for (*key, role), x in chunks(batches, ["symbol", "first", "part", "role"]):
            if key != home:
                home, parts, ready = key, [], None
            if role == 0:
                parts.append(x)
                continue
            if ready is None:
                ready, parts = Block.joined(parts).index().only_index(), []
            i, j, cosine = ready.similar(x, threshold, window_days)
            for at in range(0, len(i), PAIRS):
                k = slice(at, at + PAIRS)
                n = len(i[k])
                symbol = pa.DictionaryArray.from_arrays(pa.array(np.zeros(n, np.int32)), pa.array([key[0]], pa.string())).dictionary_decode()
                yield pa.RecordBatch.from_arrays([symbol, pa.array(x.doc[i[k]]), pa.array(ready.doc[j[k]]), pa.array(cosine[k])], ["symbol", "earlier", "later", "cosine"])

    return ordered.mapInArrow(meet, "symbol string, earlier long, later long, cosine double")


def greedy_keep(articles: DataFrame, threshold: float = 0.8, window_days: int = 5) -> DataFrame:
    """symbol, doc, kept: dropped if and only if an earlier *kept* article within the window is similar.

    The rule depends on order, so a symbol's articles pass in order through one task,
    which holds the kept ones of the window; each meets only those.
    """

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, kept = None, []
        for (name,), x in chunks(batches, ["symbol"], TURN):
            if name != symbol:
                symbol, kept = name, []
            kept = [b for b in kept if b.number[-1] >= x.number[0] - window_days]
            x.index()
            stay = np.ones(len(x), bool)
            for b in kept:
                stay[x.similar(b, threshold, window_days)[1]] = False
            left, rest = np.flatnonzero(stay), x.take(stay).index()
            i, j, _ = rest.similar(rest, threshold, window_days)
            later = np.split(j, np.searchsorted(i, np.arange(1, len(left))))
            for k in range(len(left)):
                if stay[left[k]]:
                    stay[left[later[k]]] = False
            new = x.take(stay)
            kept = [*kept[:-1], Block.joined([kept[-1], new])] if kept and len(kept[-1]) + len(new) <= 2 * TURN else [*kept, new]
            kept = [b for b in kept if len(b)]
            out = x.doc[~stay]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(out), pa.string()), pa.array(out)], ["symbol", "doc"])

    ordered = _packed(articles).repartition("symbol").sortWithinPartitions("symbol", "day", "doc")
    dropped = ordered.mapInArrow(resolve, "symbol string, doc long").distinct()
    return articles.select("symbol", "doc").join(dropped.withColumn("_out", F.lit(True)), ["symbol", "doc"], "left").select("symbol", "doc", F.col("_out").isNull().alias("kept"))
