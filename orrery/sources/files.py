"""File sources: news, responses, embeddings, bars, market values, ticker lists, models."""

from __future__ import annotations

import json
from fnmatch import fnmatchcase

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NEWS = T.StructType([
    T.StructField("symbol", T.StringType()), T.StructField("source_ticker", T.StringType()), T.StructField("date", T.StringType()),
    T.StructField("title", T.StringType()), T.StructField("content", T.StringType()), T.StructField("link", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("sentiment", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("raw_symbols", T.ArrayType(T.StringType())),
])


def _numbered_lines(spark: SparkSession, path) -> DataFrame:
    """source_file, source_row, value of text files, large ones read in several blocks.

    Lines of a block have successive ids, so a first pass that counts lines by block
    tells where each block begins; no file has to pass through one task.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    blocks = lines.groupBy("source_file", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("source_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("source_file", "_block", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    return lines.join(blocks, ["source_file", "_block"]).select("source_file", (F.col("_before") + F.col("_id") - F.col("_first")).alias("source_row"), "value")


def news(spark: SparkSession, path, start: str | None = None, end: str | None = None) -> DataFrame:
    """Articles of JSON-lines shards with source_file, source_row (line of the file, from 0) and ts; lines that are no JSON are left out.

    ``start`` and ``end`` bound the time, both ends in; then articles without a time go.
    """
    row = F.from_json("value", T.StructType([*NEWS.fields, T.StructField("_bad", T.StringType())]), {"columnNameOfCorruptRecord": "_bad"})
    parsed = _numbered_lines(spark, path).withColumn("_row", row).filter("_row is not null and _row._bad is null")
    out = parsed.select(*[F.col(f"_row.{c}") for c in NEWS.names], "source_file", "source_row").withColumn("ts", F.try_to_timestamp("date"))
    if start:
        out = out.filter(F.col("ts") >= F.lit(start).cast("timestamp"))
    return out.filter(F.col("ts") <= F.lit(end).cast("timestamp")) if end else out


def sharded(spark: SparkSession, folder: str, pattern: str = "responses_*.parquet") -> DataFrame:
    """All files of a name pattern below a folder, sharded or not, with their path."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    return reader.parquet(folder).withColumn("source_path", F.col("_metadata.file_path"))


def bars(spark: SparkSession, folder: str, exchanges: list[str] | None = None) -> DataFrame:
    """Bars of <folder>/<EXCHANGE>/<TICKER>.parquet with ``stem`` and ``exchange`` from the path."""
    raw = spark.read.option("recursiveFileLookup", "true").parquet(folder)
    path = F.col("_metadata.file_path")
    out = raw.withColumn("stem", F.regexp_extract(path, r"([^/]+)\.parquet$", 1)).withColumn("exchange", F.regexp_extract(path, r"([^/]+)/[^/]+\.parquet$", 1))
    return out.filter(F.col("exchange").isin(exchanges)) if exchanges else out


market_values = bars


def paired(metadata: DataFrame, vectors: DataFrame, keys=("source_file", "source_row")) -> DataFrame:
    """Metadata joined to vectors by key; rows that only one side has make it fail."""
    keys = list(keys)
    both = metadata.withColumn("_m", F.lit(1)).join(vectors.withColumn("_v", F.lit(1)), keys, "full")
    alone = F.col("_m").isNull() | F.col("_v").isNull()
    message = F.lit("metadata and vectors differ in their rows")
    return both.filter(F.when(alone, F.raise_error(message).cast("boolean")).otherwise(True)).drop("_m", "_v")


#: Name patterns of metadata and vector files, the first layout that a folder has counts.
LAYOUTS = (("metadata_*.parquet", "embeddings_*.parquet"), ("responses_*.parquet", "pre_response_embeddings_*.parquet"))


def vector_files(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Metadata and vectors of a folder (and its subfolders), in the first of ``LAYOUTS`` that it has files of."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, True)
    present = [False] * len(LAYOUTS)
    while found.hasNext() and not present[0]:
        name = found.next().getPath().getName()
        present = [seen or fnmatchcase(name, metadata) for seen, (metadata, _) in zip(present, LAYOUTS)]
    for seen, patterns in zip(present, LAYOUTS):
        if seen:
            metadata, vectors = (sharded(spark, folder, p).drop("source_path") for p in patterns)
            return metadata, vectors
    raise FileNotFoundError(f"no metadata or responses below {folder}")


def tickers_from_text(spark: SparkSession, path: str) -> DataFrame:
    """ticker, seq: the first comma-separated field of each line; # starts a comment."""
    lines = spark.read.text(path).select(F.trim(F.get(F.split(F.regexp_replace("value", "#.*$", ""), ","), 0)).alias("ticker"), F.monotonically_increasing_id().alias("seq"))
    return lines.filter("ticker <> ''")


def tickers_from_csv(spark: SparkSession, path: str, separator: str = ",", names=("full_ticker", "ticker", "symbol", "code")) -> DataFrame:
    """ticker, seq: the first of ``names`` that the header has, whatever its case."""
    table = spark.read.option("header", "true").option("sep", separator).csv(path)
    have = {c.lower(): c for c in table.columns}
    chosen = next((have[n] for n in names if n in have), None)
    if chosen is None:
        raise ValueError(f"{path} has none of the columns {names}")
    return table.select(F.trim(F.col(f"`{chosen}`")).alias("ticker"), F.monotonically_increasing_id().alias("seq")).filter("ticker <> ''")


def tickers_from_json(spark: SparkSession, path: str, names=("full_ticker", "ticker", "symbol", "Code")) -> DataFrame:
    """ticker, seq of a JSON array of strings or of objects."""
    text = spark.read.option("wholetext", "true").text(path)
    items = text.select(F.posexplode(F.from_json("value", "array<string>")).alias("seq", "item"))
    fields = [F.get_json_object("item", f"$.{n}") for n in names]
    ticker = F.when(F.col("item").startswith("{"), F.coalesce(*fields)).otherwise(F.col("item"))
    return items.select(F.trim(ticker).alias("ticker"), "seq").filter("ticker <> ''")


def linear_model(spark: SparkSession, path: str) -> dict:
    """The one row of a stored model; without a mode it scores sums of embeddings."""
    row = spark.read.parquet(path).first().asDict()
    return row | {"mode": row.get("mode") or "sum_embedding"}


def drain_json(text: str) -> list:
    """Rows of a JSON answer: a list, or the list under data."""
    found = json.loads(text)
    return found if isinstance(found, list) else found.get("data", [])
