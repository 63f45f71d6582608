"""Connected components of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, class) for the nodes of undirected ``edges`` (a, b): smallest node of each component.

    Every round each node takes the smallest class of its neighbours, then the
    class of that class; long chains halve, so rounds are about log2 of the diameter.
    """
    both = scratch.keep(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "both")
    labels = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("class")), "labels")
    while True:
        seen = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("class").alias("near"))
        # A class that moves takes all that carry its name along.
        moved = labels.join(seen, "node").select("node", F.col("class").alias("old"), F.least("class", "near").alias("class"))
        hooks = moved.filter("old <> class").groupBy("old").agg(F.min("class").alias("to"))
        hooked = moved.join(hooks.withColumnRenamed("old", "from"), F.col("class") == F.col("from"), "left").select("node", "old", F.least("class", F.coalesce("to", "class")).alias("class"))
        new = scratch.keep(hooked, "labels")
        if new.filter("old <> class").isEmpty():
            scratch.drop("both")
            return new.select("node", "class")
        scratch.drop("labels", but_last=True)
        labels = new.select("node", "class")
