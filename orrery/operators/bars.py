"""Daily bars: cutoffs, prior-day statistics, returns and eligibility per symbol.

Everything is one window over (symbol, trade_date), so bars shuffle once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import market_time


def by_day():
    return Window.partitionBy("symbol").orderBy("trade_date")


DECISION_HOUR, CLOSE_HOUR = 9, 16
ADV_DAYS, LEAST_ROWS = 20, 25


def clean_bars(bars: DataFrame) -> DataFrame:
    """Rows with a date, open, close and volume; NaN counts as missing; the last of equal days stays."""
    out = bars
    for c in ("open", "close", "adjusted_close", "volume"):
        out = out.withColumn(c, F.nanvl(F.col(c).try_cast("double"), F.lit(None).cast("double")))
    return out.dropna(subset=["symbol", "trade_date", "open", "close", "volume"])


def adjustment() -> Column:
    """adjusted_close / close, or 1 where that is undefined or not positive."""
    factor = F.try_divide("adjusted_close", "close")
    return F.when((F.col("close") > 0) & (factor > 0), factor).otherwise(1.0)


def average_dollar_volume(days: int = ADV_DAYS) -> Column:
    """Mean of close x volume over the ``days`` rows before; null with fewer."""
    prior = by_day().rowsBetween(-days, -1)
    traded = F.col("close") * F.col("volume")
    return F.when(F.count(traded).over(prior) == days, F.avg(traded).over(prior))


def training_return() -> Column:
    """Next open over open less one; null without a next day or with an open that is not positive."""
    following = F.lead("open").over(by_day())
    return F.when((F.col("open") > 0) & (following > 0), following / F.col("open") - 1)


def backtest_return() -> Column:
    """As ``training_return`` of adjusted opens with trades on both days; 0 where undefined."""
    price = F.col("open") * adjustment()
    following, traded = F.lead(price).over(by_day()), F.lead("volume").over(by_day())
    good = (price > 0) & (following > 0) & (F.col("volume") > 0) & (traded > 0)
    return F.coalesce(F.when(good, following / price - 1), F.lit(0.0))


def with_statistics(bars: DataFrame, min_price: float, min_adv: float, days: int = ADV_DAYS, least_rows: int = LEAST_ROWS) -> DataFrame:
    """Bars with prev_close, adv, eligible, ret (backtest) and fwd_ret (training)."""
    every = Window.partitionBy("symbol")
    out = bars.withColumns({
        "n_rows": F.count("*").over(every),
        "prev_close": F.lag("close").over(by_day()),
        "adv": average_dollar_volume(days),
        "ret": backtest_return(),
        "fwd_ret": training_return(),
    })
    able = (F.col("open") > 0) & (F.col("prev_close") >= min_price) & (F.col("adv") >= min_adv)
    return out.filter(F.col("n_rows") >= least_rows).withColumn("eligible", F.coalesce(able, F.lit(False))).drop("n_rows")


def calendar(bars: DataFrame, overnight: bool = False) -> DataFrame:
    """symbol, trade_date, window_open, cutoff: articles in (window_open, cutoff] belong to the day.

    The first day of a symbol has no window.  ``overnight`` opens it at the previous close.
    """
    cutoff = market_time("trade_date", DECISION_HOUR)
    opens = market_time("trade_date", CLOSE_HOUR) if overnight else cutoff
    days = bars.select("symbol", "trade_date").distinct()
    return days.select("symbol", "trade_date", F.lag(opens).over(by_day()).alias("window_open"), cutoff.alias("cutoff")).filter("window_open is not null")


def trade_days(bars: DataFrame, first=None, last=None) -> DataFrame:
    """The union of all symbols' days within a range."""
    days = bars.select("trade_date").distinct()
    if first is not None:
        days = days.filter(F.col("trade_date") >= F.lit(first))
    return days if last is None else days.filter(F.col("trade_date") <= F.lit(last))


def alias_table(stems: DataFrame, exchange_order=("NYSE", "NASDAQ")) -> DataFrame:
    """alias -> stem: each file answers to its stem, base and base.US; the first exchange, then name, wins."""
    from ..functions.names import aliases, exchange_of

    place = F.coalesce(F.array_position(F.array(*[F.lit(e) for e in exchange_order]), exchange_of("stem")), F.lit(0))
    rank = F.when(place > 0, place).otherwise(len(exchange_order) + 1)
    every = stems.select("stem", rank.alias("rank"), F.explode(aliases("stem")).alias("alias"))
    return every.groupBy("alias").agg(F.min_by("stem", F.struct("rank", "stem")).alias("stem"))


def resolve_stems(symbols: DataFrame, stems: DataFrame, exchange_order=("NYSE", "NASDAQ")) -> DataFrame:
    """symbol -> stem of the bar file that answers for it, null if none.

    A file of the base on one of the exchanges, in their order; else, in the same
    order, the first file whose name begins with the base.  Prefixes are as many as a
    ticker has letters, so the join is on equal keys.
    """
    from ..functions.names import base_symbol, exchange_of

    place = F.array_position(F.array(*[F.lit(e) for e in exchange_order]), exchange_of("stem"))
    named = stems.select("stem", place.alias("place"), base_symbol("stem").alias("base")).filter("place > 0 and base <> ''")
    prefixes = F.explode(F.transform(F.sequence(F.lit(1), F.length("base")), lambda k: F.substring("base", F.lit(1), k)))
    answers = named.select("stem", "place", "base", prefixes.alias("key"))
    order = F.struct((F.col("key") != F.col("base")).alias("longer"), "place", F.concat("stem", F.lit(".parquet")).alias("file"))
    first = answers.groupBy("key").agg(F.min_by("stem", order).alias("stem"))
    wanted = symbols.select("symbol", F.replace(F.upper("symbol"), F.lit(".US"), F.lit("")).alias("key")).distinct()
    return wanted.join(first, "key", "left").select("symbol", "stem")


def answering(stems: DataFrame, allowed: DataFrame) -> DataFrame:
    """Files one of whose names (stem, base, base.US) is an allowed symbol."""
    from ..functions.names import aliases, normalize_symbol

    wanted = allowed.select(normalize_symbol("symbol").alias("alias")).distinct()
    names = stems.select("stem", F.explode(aliases(F.upper("stem"))).alias("alias"))
    return stems.join(names.join(wanted, "alias", "left_semi").select("stem").distinct(), "stem", "left_semi")


def since(stats: DataFrame, start) -> DataFrame:
    """Rows from ``start`` on; to be taken after windows, so that the first row keeps what they say of days before."""
    return stats.filter(F.col("trade_date") >= F.lit(start))


def baseline(bars: DataFrame) -> DataFrame:
    """trade_date, ret, equity of one price series: adjusted close if positive, else close; first return 0."""
    price = F.when(F.col("adjusted_close") > 0, F.col("adjusted_close")).otherwise(F.col("close"))
    day = Window.orderBy("trade_date")  # one series, a row a day
    out = bars.select("trade_date", price.alias("price")).withColumn("ret", F.coalesce(F.try_divide("price", F.lag("price").over(day)) - 1, F.lit(0.0)))
    return out.select("trade_date", "ret", F.product(1 + F.col("ret")).over(day).alias("equity"))


def near_rows(bars: DataFrame, targets: DataFrame, distance: int = 3) -> DataFrame:
    """Bars within ``distance`` rows of each target (symbol, target_date), with their signed offset."""
    numbered = bars.withColumn("row", F.row_number().over(by_day()))
    at = numbered.join(targets, ["symbol"]).filter(F.col("trade_date") == F.col("target_date")).select("symbol", "target_date", F.col("row").alias("at"))
    wanted = at.withColumn("offset", F.explode(F.sequence(F.lit(-distance), F.lit(distance)))).withColumn("row", F.col("at") + F.col("offset"))
    return numbered.join(wanted, ["symbol", "row"]).drop("row", "at")
