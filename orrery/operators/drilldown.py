"""What happened on days of extreme loss."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def loss_days(daily: DataFrame, below: float = -1.0, dates: list | None = None) -> DataFrame:
    """strategy, trade_date with net_ret under ``below``, or the given dates."""
    chosen = daily.filter(F.col("trade_date").isin(dates)) if dates else daily.filter(F.col("net_ret") < below)
    return chosen.select("strategy", "trade_date").distinct()


def contributions(targets: DataFrame, signals: DataFrame, bars: DataFrame, days: DataFrame) -> DataFrame:
    """Holdings of the days with their signal counts, return and weight x return."""
    held = targets.join(days, ["strategy", "trade_date"], "left_semi")
    facts = bars.select("symbol", "trade_date", "ret", "open", "fwd_ret")
    counts = signals.select("symbol", "trade_date", "yes_count", "no_count", "news_count")
    out = held.join(facts, ["symbol", "trade_date"], "left").join(counts, ["symbol", "trade_date"], "left")
    return out.withColumn("contribution", F.col("weight") * F.coalesce("ret", F.lit(0.0)))


def summary(contribs: DataFrame) -> DataFrame:
    """Per day: names long and short, total, and the name that lost most."""
    return contribs.groupBy("strategy", "trade_date").agg(
        F.count_if(F.col("weight") > 0).alias("n_long"), F.count_if(F.col("weight") < 0).alias("n_short"), F.sum("contribution").alias("total"),
        F.min_by("symbol", F.struct("contribution", "symbol")).alias("worst_symbol"), F.min("contribution").alias("worst_contribution"),
    )


def ranked(contribs: DataFrame) -> DataFrame:
    """Holdings with their place among the day's, the worst contribution first, then by symbol."""
    day = Window.partitionBy("strategy", "trade_date").orderBy("contribution", "symbol")
    return contribs.withColumn("place", F.row_number().over(day))


def names_of(contribs: DataFrame) -> DataFrame:
    """The union of names held long and short."""
    return contribs.filter("weight > 0").select("symbol").union(contribs.filter("weight < 0").select("symbol")).distinct()


def price_context(near: DataFrame) -> DataFrame:
    """Rows around a day (from ``bars.near_rows``) with the raw open-to-open return beside the used one."""
    day = Window.partitionBy("symbol", "target_date").orderBy("trade_date")
    raw = F.when(F.col("open") > 0, F.lead("open").over(day) / F.col("open") - 1)
    return near.withColumn("raw_ret", raw)


def news_of_days(assigned: DataFrame, names: DataFrame, days: DataFrame) -> DataFrame:
    return assigned.join(names, "symbol", "left_semi").join(days, "trade_date", "left_semi")
