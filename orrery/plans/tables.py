"""The driver's tables as bars, articles, answers, signals and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import signals as S

MIN_PRICE, MIN_ADV = 1.0, 29_000.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supplier_symbol() -> Column:
    exchange = F.when(F.col("s_nationkey") % 2 == 0, ".NYSE").otherwise(".NASDAQ")
    return F.concat(F.lit("S"), F.col("s_suppkey").cast("string"), exchange)


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_suppkey, symbol, s_acctbal: the supplier table, broadcast by its size if that is small."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), supplier_symbol().alias("symbol"), "s_acctbal")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, trade_date, open, close, adjusted_close, volume from each supplier's lines of a day.

    Prices of parts have nothing to do with one another, so they move a level of 1000 by a few parts in a
    hundred, in whole cents; returns then compound like a market's, not to numbers of hundreds of digits.
    """
    price = F.lit(1000.0) + F.floor(F.col("l_extendedprice") / F.col("l_quantity")) / F.lit(100.0)
    lines = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", F.col("l_shipdate").cast("date").alias("trade_date"), "l_orderkey", "l_linenumber", price.alias("p"), "l_quantity"
    )
    order = F.struct("l_orderkey", "l_linenumber", "p")
    days = lines.groupBy("l_suppkey", "trade_date").agg(F.min_by("p", order).alias("open"), F.max_by("p", order).alias("close"), F.sum("l_quantity").alias("volume"))
    named = days.join(symbols(spark, sf_dir), "l_suppkey")
    return named.select("symbol", "trade_date", "open", "close", F.col("close").alias("adjusted_close"), "volume")


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.with_statistics(bars(spark, sf_dir), MIN_PRICE, MIN_ADV)


def order_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts, label, is_title_only: each line of an order as an article on its supplier."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").cast("timestamp").alias("ts"), "o_orderstatus", "o_orderpriority")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    label = F.when(F.col("o_orderstatus") == "F", "YES").when(F.col("o_orderstatus") == "O", "NO").otherwise("UNKNOWN")
    named = lines.join(orders, "l_orderkey").join(symbols(spark, sf_dir), "l_suppkey")
    return named.select("symbol", "ts", label.alias("label"), (F.substring("o_orderpriority", 1, 1) == "1").alias("is_title_only"))


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of each user's event values."""
    e = events(spark, sf_dir).withColumn("trade_date", F.col("ts").cast("date"))
    at = F.struct("ts", "event_id")
    return e.groupBy("symbol", "trade_date").agg(F.min_by("value", at).alias("open"), F.max_by("value", at).alias("close"), F.sum("value").alias("volume"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.concat(F.lit("U"), F.col("user_id").cast("string"), F.lit(".NYSE")).alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type", "value")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock-days of ``order_news`` with eligibility and returns."""
    stats = market(spark, sf_dir)
    assigned = S.assign_days(order_news(spark, sf_dir), B.calendar(bars(spark, sf_dir)))
    return S.with_market(S.label_counts(assigned), stats)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trade_date, symbol, pred (score per article), eligible, target."""
    return signals(spark, sf_dir).select("trade_date", "symbol", (F.col("paper_score") / F.col("news_count")).alias("pred"), "eligible", F.col("ret").alias("target"))


def caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market value = close x account balance."""
    balance = symbols(spark, sf_dir).select("symbol", "s_acctbal")
    return bars(spark, sf_dir).join(balance, "symbol").select("symbol", "trade_date", (F.col("close") * F.col("s_acctbal")).alias("market_cap"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, symbol, day, title (first line), content of each document."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").alias("doc"), F.col("source").alias("symbol"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 28).cast("int")).alias("day"),
        F.get(F.split(text, "\n"), 0).alias("title"), text.alias("text"),
    )
