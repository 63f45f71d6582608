"""Ticker universes: reading order, de-duplication, exclusion and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import base_symbol, exchange_of, is_non_equity, normalize_symbol


def first_of_each(tickers: DataFrame, order: str = "seq") -> DataFrame:
    """Normalised tickers, each where it first occurs by ``order``."""
    named = tickers.withColumn("ticker", normalize_symbol("ticker")).filter("ticker <> ''")
    return named.groupBy("ticker").agg(F.min(order).alias(order))


def prefer_active(active: DataFrame, delisted: DataFrame) -> DataFrame:
    """All rows of both lists, one a full_ticker: the active one, else the first delisted one."""
    both = active.withColumn("is_delisted", F.lit(False)).unionByName(delisted.withColumn("is_delisted", F.lit(True)))
    rank = F.row_number().over(Window.partitionBy("full_ticker").orderBy("is_delisted", "seq"))
    return both.withColumn("_r", rank).filter("_r = 1").drop("_r")


def only_delisted(active: DataFrame, delisted: DataFrame) -> DataFrame:
    return delisted.join(active.select("full_ticker"), "full_ticker", "left_anti")


def without(tickers: DataFrame, excluded: DataFrame) -> DataFrame:
    return tickers.join(excluded.select(normalize_symbol("ticker").alias("ticker")).distinct(), "ticker", "left_anti")


def split_by_metadata(tickers: DataFrame, metadata: DataFrame) -> DataFrame:
    """ticker, kept, reason: names that metadata marks as no shares are rejected; unknown ones stay."""
    last = metadata.groupBy("ticker").agg(F.max_by("name", "seq").alias("name"))
    joined = tickers.join(last, "ticker", "left")
    bad = F.coalesce(F.col("name").isNotNull() & is_non_equity("ticker", "name"), F.lit(False))
    return joined.select("ticker", (~bad).alias("kept"), F.when(bad, "non_equity").alias("reason"))


def split_by_presence(tickers: DataFrame, symbols: DataFrame, reason: str) -> DataFrame:
    """ticker, kept, reason: kept if ``symbols`` has a name of the same base."""
    bases = symbols.select(base_symbol("symbol").alias("_base")).distinct().withColumn("_here", F.lit(True))
    joined = tickers.withColumn("_base", base_symbol("ticker")).join(bases, "_base", "left")
    here = F.coalesce("_here", F.lit(False))
    return joined.select("ticker", here.alias("kept"), F.when(~here, reason).alias("reason"))


def counts_by_exchange(universe: DataFrame) -> DataFrame:
    return universe.groupBy(exchange_of("full_ticker").alias("exchange")).agg(
        F.count_if(~F.col("is_delisted")).alias("n_active"), F.count_if("is_delisted").alias("n_delisted"), F.count("*").alias("n_total")
    )


def single_symbol_articles(articles: DataFrame, requested: str = "requested") -> DataFrame:
    """Articles with the reason they are skipped for, null if kept: exactly one symbol, and the requested one."""
    n = F.size("symbols")
    reason = F.when(n == 0, "no_symbol").when(n > 1, "several_symbols").when(F.get("symbols", 0) != F.col(requested), "other_symbol")
    return articles.withColumn("reason", reason)


def reason_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def first_rows(rows: DataFrame, n: int | None, *order: str) -> DataFrame:
    """The first n rows by ``order``, which should tell rows apart; all rows, in that order, without n."""
    ordered = rows.orderBy(*order)
    return ordered if n is None else ordered.limit(n)


def sample(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows, each set equally likely, the same for a seed: the least seeded hashes."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), key).limit(n)
