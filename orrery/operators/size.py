"""Size buckets by the prior day's market value, and value-weighted bucket returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import base_symbol, exchange_of


def previous_caps(caps: DataFrame) -> DataFrame:
    """symbol, trade_date, prev_cap: the value on the symbol's own row before, if positive."""
    usable = F.when((F.col("market_cap") > 0) & ~F.isnan("market_cap"), F.col("market_cap"))
    before = F.lag(usable).over(Window.partitionBy("symbol").orderBy("trade_date"))
    return caps.select("symbol", "trade_date", before.alias("prev_cap")).filter("prev_cap is not null")


def breakpoints(prev_caps: DataFrame, q: float = 0.2, exchange: str = "NYSE") -> DataFrame:
    """trade_date, breakpoint (interpolated q-quantile over one exchange), n_symbols, quantile."""
    own = prev_caps.filter(exchange_of("symbol") == exchange)
    return own.groupBy("trade_date").agg(F.percentile("prev_cap", F.lit(q)).alias("breakpoint"), F.count("*").alias("n_symbols"), F.lit(q).alias("quantile"))


def membership(prev_caps: DataFrame, points: DataFrame, bars: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    """trade_date, symbol_base, size_bucket, prev_cap, breakpoint, ret: one row a base symbol and day, the larger name's.

    small: at most the breakpoint.  ``universe`` (symbol_base) restricts the names.
    """
    rows = prev_caps.join(bars.select("symbol", "trade_date", "ret"), ["symbol", "trade_date"]).join(points.select("trade_date", "breakpoint"), "trade_date")
    rows = rows.withColumn("symbol_base", base_symbol("symbol"))
    if universe is not None:
        rows = rows.join(universe.select("symbol_base").distinct(), "symbol_base", "left_semi")
    bucket = F.when(F.col("prev_cap") <= F.col("breakpoint"), "small").otherwise("non_small")
    rows = rows.withColumn("size_bucket", bucket)
    last = F.max_by(F.struct("size_bucket", "prev_cap", "breakpoint", "ret"), F.col("symbol")).alias("x")
    return rows.groupBy("trade_date", "symbol_base").agg(last).select("trade_date", "symbol_base", "x.*")


def with_bucket(stock_days: DataFrame, members: DataFrame) -> DataFrame:
    """Stock-days with the size_bucket of their base symbol; null if it has none that day."""
    keyed = stock_days.withColumn("symbol_base", base_symbol("symbol"))
    return keyed.join(members.select("trade_date", "symbol_base", "size_bucket", "prev_cap"), ["trade_date", "symbol_base"], "left")


def of_bucket(stock_days: DataFrame, bucket: str | None) -> DataFrame:
    """Stock-days of one size bucket, those without a bucket left out; all of them if none is named."""
    return stock_days.filter(F.col("size_bucket") == bucket) if bucket else stock_days


def bucket_returns(members: DataFrame) -> DataFrame:
    """Per day and bucket: value-weighted ret (0 without value), n, total value; equity by bucket."""
    by = members.groupBy("size_bucket", "trade_date").agg(
        F.coalesce(F.try_divide(F.sum(F.col("prev_cap") * F.coalesce("ret", F.lit(0.0))), F.sum("prev_cap")), F.lit(0.0)).alias("ret"),
        F.count("*").alias("n_names"), F.sum("prev_cap").alias("total_cap"),
    )
    return by.withColumn("equity", F.product(1 + F.col("ret")).over(Window.partitionBy("size_bucket").orderBy("trade_date")))


def caps_from_shares(closes: DataFrame, shares: DataFrame, min_coverage: float = 0.5) -> DataFrame:
    """symbol, trade_date, close, shares, market_cap.

    Share counts join on equal dates only (one on a day without trade is lost), then
    carry forward.  Symbols with counts on less than ``min_coverage`` of days go.
    """
    path = Window.partitionBy("symbol").orderBy("trade_date")
    one = shares.groupBy("symbol", "trade_date").agg(F.max("shares").alias("shares"))
    rows = closes.select("symbol", "trade_date", "close").join(one, ["symbol", "trade_date"], "left")
    rows = rows.withColumn("shares", F.last("shares", ignorenulls=True).over(path))
    every = Window.partitionBy("symbol")
    covered = F.count("shares").over(every) / F.count("*").over(every)
    return rows.withColumn("coverage", covered).filter((F.col("coverage") >= min_coverage) & F.col("shares").isNotNull()).withColumn("market_cap", F.col("close") * F.col("shares"))
