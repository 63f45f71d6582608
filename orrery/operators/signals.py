"""From articles to stock-day signals and target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = ("strategy", "trade_date")


def assign_days(articles: DataFrame, calendar: DataFrame) -> DataFrame:
    """Articles (symbol, ts, ...) with the trade_date whose window (window_open, cutoff] holds them; others go.

    The join hashes on symbol and month: a window that spans months is listed in
    each, so that one symbol's long history does not meet all of its articles.
    """
    month = lambda c: F.trunc(c, "month").cast("date")
    months = F.sequence(month(F.col("window_open").cast("date")), month(F.col("cutoff").cast("date")), F.expr("interval 1 month"))
    windows = calendar.withColumn("_month", F.explode(months))
    keyed = articles.filter("ts is not null").withColumn("_month", month(F.col("ts").cast("date")))
    hit = (F.col("ts") > F.col("window_open")) & (F.col("ts") <= F.col("cutoff"))
    return keyed.join(windows, ["symbol", "_month"]).filter(hit).drop("_month", "window_open", "cutoff")


def only_parsed(answers: DataFrame, flag: str = "parsed_ok") -> DataFrame:
    """Answers whose flag is true; null counts as false."""
    return answers.filter(F.coalesce(F.col(flag), F.lit(False)))


def label_counts(assigned: DataFrame) -> DataFrame:
    """Per stock-day the labels (YES, NO, UNKNOWN), news and title-only articles, with score and strict flags."""
    is_ = lambda v: F.col("label") == v
    counts = assigned.groupBy("trade_date", "symbol").agg(
        F.count_if(is_("YES")).alias("yes_count"), F.count_if(is_("NO")).alias("no_count"), F.count_if(is_("UNKNOWN")).alias("unknown_count"),
        F.count("*").alias("news_count"), F.count_if(F.coalesce("is_title_only", F.lit(False))).alias("title_only_count"),
    )
    return counts.withColumns({
        "paper_score": F.col("yes_count") - F.col("no_count"),
        "strict_long": (F.col("yes_count") > 0) & (F.col("no_count") == 0),
        "strict_short": (F.col("no_count") > 0) & (F.col("yes_count") == 0),
    })


def label_totals(counts: DataFrame) -> DataFrame:
    names = ("yes_count", "no_count", "unknown_count", "news_count", "title_only_count")
    return counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])


def with_market(stock_days: DataFrame, bars: DataFrame) -> DataFrame:
    """Adds eligible (false without a bar) and ret (null without one)."""
    facts = bars.select("symbol", "trade_date", F.col("eligible").alias("_eligible"), "ret")
    return stock_days.join(facts, ["symbol", "trade_date"], "left").withColumn("eligible", F.coalesce("_eligible", F.lit(False))).drop("_eligible")


def gross_one(raw: Column, *by: str) -> Column:
    """raw / sum of |raw| within ``by``; null for zero and non-finite values."""
    usable = F.when(raw.isNotNull() & ~F.isnan(raw) & (F.abs(raw) != F.lit(float("inf"))) & (raw != 0), raw)
    return F.try_divide(usable, F.sum(F.abs(usable)).over(Window.partitionBy(*by)))


def _pool(signals: DataFrame) -> tuple[DataFrame, Window]:
    return signals.filter("eligible"), Window.partitionBy("trade_date")


def strict_targets(signals: DataFrame, min_pool: int = 10, min_short: int = 1) -> DataFrame:
    """trade_date, symbol, weight: yes counts against no counts of the strict names, gross 1.

    A day needs ``min_pool`` eligible names, a long one and ``min_short`` short ones.
    """
    pool, day = _pool(signals)
    raw = F.when(F.col("strict_long"), F.col("yes_count")).when(F.col("strict_short"), -F.col("no_count")).cast("double")
    gate = (F.count("*").over(day) >= min_pool) & (F.count_if("strict_long").over(day) >= 1) & (F.count_if("strict_short").over(day) >= min_short)
    out = pool.withColumn("_gate", gate).filter("_gate").withColumn("weight", gross_one(raw, "trade_date"))
    return out.filter("weight is not null").select("trade_date", "symbol", "weight")


def score_targets(signals: DataFrame, min_pool: int = 10, min_short: int = 1) -> DataFrame:
    """Weights in proportion to paper_score over the eligible names; the gate counts positive and negative scores."""
    pool, day = _pool(signals)
    score = F.col("paper_score").cast("double")
    gate = (F.count("*").over(day) >= min_pool) & (F.count_if(score > 0).over(day) >= 1) & (F.count_if(score < 0).over(day) >= min_short)
    out = pool.withColumn("_gate", gate).filter("_gate").withColumn("weight", gross_one(score, "trade_date"))
    return out.filter("weight is not null").select("trade_date", "symbol", "weight")


def long_targets(signals: DataFrame, min_pool: int = 10) -> DataFrame:
    """Equal weights over the strict long names of a day with ``min_pool`` eligible ones."""
    pool, day = _pool(signals)
    out = pool.withColumn("_n", F.count("*").over(day)).filter((F.col("_n") >= min_pool) & F.col("strict_long"))
    return out.withColumn("weight", 1.0 / F.count("*").over(day)).select("trade_date", "symbol", "weight")


def quantile_targets(predictions: DataFrame, q: float = 0.2, min_pool: int = 10) -> DataFrame:
    """-0.5/k for the k lowest and +0.5/k for the k highest of a day's n eligible predictions, k = floor(q n).

    Ties go by symbol; where the legs overlap (q above a half) the long one counts.
    """
    finite = F.col("pred").isNotNull() & ~F.isnan("pred")
    by_day = Window.partitionBy("trade_date")
    order = by_day.orderBy("pred", "symbol")
    ranked = predictions.filter(F.col("eligible") & finite).withColumns({"_r": F.row_number().over(order), "_n": F.count("*").over(by_day)})
    k = F.floor(F.col("_n") * F.lit(q))
    ranked = ranked.withColumn("_k", k).filter((F.col("_n") >= min_pool) & (F.col("_k") >= 1))
    weight = F.when(F.col("_r") > F.col("_n") - F.col("_k"), 0.5 / F.col("_k")).when(F.col("_r") <= F.col("_k"), -0.5 / F.col("_k"))
    return ranked.withColumn("weight", weight).filter("weight is not null").select("trade_date", "symbol", "weight")


def pool_counts(signals: DataFrame) -> DataFrame:
    """Per day the eligible names, and of these the strict long and short ones."""
    return signals.filter("eligible").groupBy("trade_date").agg(
        F.count("*").alias("n_pool"), F.count_if("strict_long").alias("n_long"), F.count_if("strict_short").alias("n_short")
    )


STRATEGIES = {
    "strict_unknown_filtered": strict_targets,
    "paper_like_positive_negative": score_targets,
    "long_only_yes_no_no": lambda signals, min_pool=10, min_short=1: long_targets(signals, min_pool),
}


def all_targets(signals: DataFrame, min_pool: int = 10, min_short: int = 1, buckets: bool = False) -> DataFrame:
    """strategy, trade_date, symbol, weight of the three strategies, in one pass over the signals.

    With ``buckets`` also of each size bucket alone, as <strategy>_small and <strategy>_non_small.
    """
    parts = F.array_compact(F.array(F.lit(""), F.concat(F.lit("_"), F.col("size_bucket")))) if buckets else F.array(F.lit(""))
    pool = signals.filter("eligible").withColumn("_part", F.explode(parts))
    day = Window.partitionBy("_part", "trade_date")
    score = F.col("paper_score").cast("double")
    pool = pool.withColumns({
        "_n": F.count("*").over(day), "_long": F.count_if("strict_long").over(day), "_short": F.count_if("strict_short").over(day),
        "_up": F.count_if(score > 0).over(day), "_down": F.count_if(score < 0).over(day),
    }).filter(F.col("_n") >= min_pool)
    strict = F.when(F.col("strict_long"), F.col("yes_count")).when(F.col("strict_short"), -F.col("no_count")).cast("double")
    raws = [
        F.when((F.col("_long") >= 1) & (F.col("_short") >= min_short), strict),
        F.when((F.col("_up") >= 1) & (F.col("_down") >= min_short), score),
        F.when(F.col("strict_long"), F.lit(1.0)),
    ]
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), raw.alias("raw")) for name, raw in zip(STRATEGIES, raws)]))
    rows = pool.select("_part", "trade_date", "symbol", each.alias("s")).filter("s.raw is not null and s.raw <> 0")
    rows = rows.select(F.concat(F.col("s.name"), F.col("_part")).alias("strategy"), "trade_date", "symbol", F.col("s.raw").alias("raw"))
    return rows.withColumn("weight", gross_one(F.col("raw"), "strategy", "trade_date")).drop("raw")
