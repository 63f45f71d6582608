"""Shards of articles as a stream: discovery, drain, labels, counts and de-duplication."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import NEWS


def shard_stream(spark: SparkSession, folders: list[str], files_per_batch: int = 64) -> DataFrame:
    """Finished shards (news_*.jsonl) of several folders, each file once; which ones is in the query's checkpoint."""
    streams = [
        spark.readStream.schema(NEWS).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "news_*.json*").json(f)
        .withColumn("source_file", F.col("_metadata.file_path")).withColumn("source", F.lit(f"source_{i:02d}"))
        for i, f in enumerate(folders)
    ]
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s)
    return out.withColumn("ts", F.try_to_timestamp("date"))


def stub_model(texts: list[str]) -> list[str]:
    """A stand-in for a language model, for tests: it answers by the text's length, the same each time."""
    return [("LONG", "SHORT", "INSUFFICIENT_INFO")[len(t) % 3] for t in texts]


def label_batches(model: Callable[[list[str]], list[str]], batch_size: int = 16) -> Callable:
    """For ``mapInPandas``: column ``prompt`` to ``response_raw``; a batch too large for the model's memory is halved."""

    def call(texts: list[str]) -> list[str]:
        try:
            return model(texts)
        except MemoryError:
            if len(texts) == 1:
                raise
            half = len(texts) // 2
            return call(texts[:half]) + call(texts[half:])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["prompt"].fillna("").tolist()
            answers = [a for i in range(0, len(texts), batch_size) for a in call(texts[i : i + batch_size])]
            yield frame.assign(response_raw=answers)

    return run


def drain(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process all that is there, then stop; a second call takes up where the first ended."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def poll(stream: DataFrame, path: str, checkpoint: str, seconds: float = 60.0) -> StreamingQuery:
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def check_producer(status: dict, now: float | None = None, timeout: float = 1200.0) -> bool:
    """True if the producer has ended well; a failed one, or a running one that is silent for too long, is an error."""
    state = status.get("status", "")
    if state == "failed":
        raise RuntimeError(f"the producer failed: {status.get('error', '')}")
    if state in ("completed", "stopped"):
        return True
    if state == "running" and (now or time.time()) - float(status.get("updated_at", 0)) > timeout:
        raise RuntimeError("the producer is silent")
    return False


def label_counts(labelled: DataFrame, delay: str = "1 day") -> DataFrame:
    """Counts of labels per symbol and day of a stream (symbol, ts, label), closed ``delay`` after the day."""
    is_ = lambda v: F.count_if(F.col("label") == v)
    by = labelled.withWatermark("ts", delay).groupBy(F.window("ts", "1 day").alias("w"), "symbol")
    return by.agg(is_("YES").alias("yes_count"), is_("NO").alias("no_count"), is_("UNKNOWN").alias("unknown_count"), F.count("*").alias("news_count")).select(
        F.col("w.start").cast("date").alias("day"), "symbol", "yes_count", "no_count", "unknown_count", "news_count"
    )


def without_repeats(stream: DataFrame, delay: str = "7 days") -> DataFrame:
    """Each (symbol, link) once within the watermark."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["symbol", "link"])
