"""Mixing sources to target weights by capped water-filling, native.

Targets: a budget is shared among sources by weight; a source whose share
exceeds ``max_epochs`` times its size is clamped there and the excess goes to
the others in proportion to their weights, until no share is above its cap.
Clamping only ever raises the common level, so the rounds end after at most as
many as there are clamped sources; each is one aggregation of the source table.

Taking: every document is repeated whole ``floor(target / size)`` times, and the
rest of the target is filled with one more repetition of documents in the order
of a seeded hash.  The document at the limit gives only the words that are still
missing, so a source's words equal its target but for rounding.  The order is
found without sorting a source: hash ranges (``BUCKETS`` a source) are summed
first, and only the range that holds the limit is ordered.

Defined results: a null text has size 0 and takes nothing; a null source is a
source of its own, ordered last; sources with no words have target 0; repeated
rows are taken one by one (rows equal in source, id and size stay
interchangeable); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"
#: Hash ranges of a source, by leading hex digits of the hash.
DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cyclic_weights(sizes: DataFrame, weights=WEIGHTS) -> DataFrame:
    """``weight`` for each source: the given weights in turn, by code point, null last."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    # ``sizes`` has one row a source, so this order is over the source table only.
    return sizes.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(rank, F.lit(len(weights)))))


def water_fill(sizes: DataFrame, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """``target`` for each row of ``sizes`` (source, source_size, weight)."""
    cap = F.col("source_size") * float(max_epochs)
    full = lambda level: cap <= F.col("weight") * level
    total = sizes.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        clamped = full(F.lit(level))
        used, weight = sizes.agg(F.sum(F.when(clamped, cap).otherwise(0.0)), F.sum(F.when(clamped, 0.0).otherwise(F.col("weight")))).first()
        if not weight:
            break
        higher = max(level, (share * total - used) / weight)
        if higher <= level:
            break
        level = higher
    return sizes.withColumn("target", F.least(cap, F.col("weight") * level) if level else F.lit(0.0))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, whole (full repetitions), part (words of one more), taken."""
    return take(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), weights, share, max_epochs, seed)


def take(slim: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: str = SEED, wide: bool = False) -> DataFrame:
    """``mix`` for rows with a ``size`` (doc_id, source, size, and any other columns).

    ``wide`` rows are not written: a second pass over their source takes them, and
    only the few in a hash range that holds a limit are shuffled.
    """
    scratch = Scratch(slim.sparkSession, "mixture")
    order = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    slim = slim.withColumn("h", order).withColumn("bucket", F.substring("h", 1, DIGITS))
    if not wide:  # the texts are read once; everything below works on this narrow table
        slim = scratch.keep(slim, "sizes")

    ranges = scratch.keep(slim.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "ranges")
    sizes = scratch.keep(cyclic_weights(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), weights), "sources")
    targets = water_fill(sizes, share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.withColumn("whole", whole).withColumn("rest", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))

    # At most 16**DIGITS ranges a source.
    upto = Window.partitionBy("source").orderBy("bucket")
    same_source = F.col("r.source").eqNullSafe(F.col("t.source"))
    limits = (
        ranges.withColumn("before", F.sum("words").over(upto) - F.col("words")).alias("r")
        .join(targets.alias("t"), same_source)
        .filter("r.before <= t.rest and t.rest < r.before + r.words")
        .select(F.col("t.source").alias("source"), F.col("r.bucket").alias("limit"), F.col("r.before").alias("before"))
    )
    plan = targets.alias("t").join(limits.alias("r"), same_source, "left").select("t.source", "source_size", "target", "whole", "rest", "limit", "before")
    plan = scratch.keep(plan, "plan")

    # The per-source plan is tiny next to the documents: broadcast by its size, else a skew-aware join.
    joined = slim.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source"))).select("d.*", "source_size", "target", "whole", "rest", "limit", "before")
    at_limit = F.coalesce(F.col("bucket") == F.col("limit"), F.lit(False))
    # Without a limit the rest covers all ranges (no words are left to choose from).
    below = joined.filter(~at_limit).withColumn("part", F.when(F.col("limit").isNull() | (F.col("bucket") < F.col("limit")), F.least("size", "rest")).otherwise(F.lit(0)))
    running = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = joined.filter(at_limit).withColumn("upto", F.col("before") + F.sum("size").over(running))
    within = within.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("upto") + F.col("size")))).drop("upto")
    both = below.unionByName(within).withColumn("part", F.col("part").cast("long"))
    return both.withColumn("taken", F.col("whole") * F.col("size") + F.col("part")).drop("h", "bucket", "limit", "before", "rest")


def mixed_documents(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """Whole documents of the mix, each as often as it is taken, with the columns of ``docs``.

    A repetition that ``mix`` cuts short is kept whole if at least half of it is taken.
    """
    boxed = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    times = F.col("whole") + F.when((F.col("part") > 0) & (2 * F.col("part") >= F.col("size")), 1).otherwise(0)
    taken = take(boxed, weights, share, max_epochs, seed, wide=True)
    return taken.filter(times > 0).select("row", F.explode(F.array_repeat(F.lit(1), times.cast("int"))).alias("k")).select("row.*")
