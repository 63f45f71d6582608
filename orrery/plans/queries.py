"""Registered queries of the library's own operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import text as X
from ..functions import times as M
from ..operators import bars as B
from ..operators import dedupe as D
from ..operators import drilldown as G
from ..operators import heads as H
from ..operators import pages as P
from ..operators import portfolio as R
from ..operators import signals as S
from ..operators import size as Z
from ..operators import universe as U
from . import tables as T
from .sql import SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
MIN_POOL, MIN_SHORT = 3, 1


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


#: A day's net return below this is a loss to look at.
LOSS = -0.005


def r6(c, digits: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits)


@query
def daily_bars(spark, d):
    return T.bars(spark, d).select("symbol", "trade_date", "open", "close", "volume")


@query
def bar_statistics(spark, d):
    return T.market(spark, d).select("symbol", "trade_date", "prev_close", r6("adv").alias("adv"), "eligible")


@query
def open_returns(spark, d):
    return T.market(spark, d).select("symbol", "trade_date", r6("ret").alias("ret"), r6("fwd_ret").alias("fwd_ret"))


@query
def trading_windows(spark, d):
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    day, night = B.calendar(T.bars(spark, d)), B.calendar(T.bars(spark, d), overnight=True).withColumnRenamed("window_open", "night_open").drop("cutoff")
    both = day.join(night, ["symbol", "trade_date"])
    return both.select("symbol", "trade_date", text("window_open").alias("window_open"), text("cutoff").alias("cutoff"), text("night_open").alias("night_open"))


@query
def event_days(spark, d):
    return S.assign_days(T.events(spark, d), B.calendar(T.event_bars(spark, d))).select("event_id", "symbol", "trade_date")


@query
def event_days_overnight(spark, d):
    return S.assign_days(T.events(spark, d), B.calendar(T.event_bars(spark, d), overnight=True)).select("event_id", "symbol", "trade_date")


@query
def label_counts(spark, d):
    assigned = S.assign_days(T.order_news(spark, d), B.calendar(T.bars(spark, d)))
    return S.label_counts(assigned)


@query
def label_totals(spark, d):
    assigned = S.assign_days(T.order_news(spark, d), B.calendar(T.bars(spark, d)))
    return S.label_totals(S.label_counts(assigned))


@query
def stock_day_signals(spark, d):
    return T.signals(spark, d).select("trade_date", "symbol", "paper_score", "news_count", "eligible", r6("ret").alias("ret"))


@query
def strategy_targets(spark, d):
    return S.all_targets(T.signals(spark, d), MIN_POOL, MIN_SHORT).select("strategy", "trade_date", "symbol", r6("weight").alias("weight"))


@query
def quantile_targets(spark, d):
    return S.quantile_targets(T.predictions(spark, d), 0.3, MIN_POOL).select("trade_date", "symbol", r6("weight").alias("weight"))


@query
def pool_counts(spark, d):
    return S.pool_counts(T.signals(spark, d))


def _daily(spark, d) -> DataFrame:
    stats = T.market(spark, d)
    targets = S.all_targets(T.signals(spark, d), MIN_POOL, MIN_SHORT)
    return R.execute_daily(targets, stats.select("symbol", "trade_date", "ret", "eligible"), B.trade_days(stats))


@query
def backtest_daily(spark, d):
    out = _daily(spark, d)
    # A book of equal sides nets to a zero of either sign.
    rounded = [F.when(r6(c, 12) != 0, r6(c, 12)).otherwise(F.when(F.col(c).isNotNull(), F.lit(0.0))).alias(c) for c in ("gross_ret", "turnover", "cost", "net_ret", "leverage", "gross_leverage")]
    return out.select("strategy", "trade_date", *rounded, "n_long", "n_short")


@query
def backtest_performance(spark, d):
    out = R.performance(_daily(spark, d))
    return out.select("strategy", *[r6(c).alias(c) for c in ("total_return", "ann_return", "ann_vol", "sharpe", "max_drawdown")], "n_days")


@query
def equity_path(spark, d):
    return R.with_equity(_daily(spark, d)).select("strategy", "trade_date", r6("equity").alias("equity"), r6("drawdown").alias("drawdown"))


@query
def trailing_volatility(spark, d):
    return R.trailing_volatility(_daily(spark, d)).select("strategy", "trade_date", r6("vol_est_ann").alias("vol_est_ann"))


def _monthly(spark, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Targets, rebalances on the first day of each month that has any, returns, days."""
    stats = T.market(spark, d)
    targets = S.all_targets(T.signals(spark, d), MIN_POOL, MIN_SHORT)
    first = targets.groupBy(F.trunc("trade_date", "month")).agg(F.min("trade_date").alias("trade_date")).select("trade_date")
    return targets, first, stats.select("symbol", "trade_date", "ret", "eligible"), B.trade_days(stats)


@query
def monthly_backtest(spark, d):
    out = R.execute(*_monthly(spark, d))
    return out.select("strategy", "trade_date", "rebalance", *[(r6(c, 9) + 0.0).alias(c) for c in ("gross_ret", "turnover", "cost", "net_ret", "leverage")])


@query
def volatility_targeting(spark, d):
    return R.execute_to_volatility(*_monthly(spark, d), target=0.05)


@query
def drifted_weights(spark, d):
    stats = T.market(spark, d)
    first = stats.filter("eligible").withColumn("m", F.trunc("trade_date", "quarter").cast("date"))
    starts = first.groupBy("m").agg(F.min("trade_date").alias("rebalance_date"))
    held = stats.filter("eligible").join(starts.select(F.col("rebalance_date").alias("trade_date")), "trade_date")
    weight = 1.0 / F.count("*").over(Window.partitionBy("trade_date"))
    targets = held.select(F.lit("equal").alias("strategy"), F.col("trade_date").alias("rebalance_date"), "symbol", weight.alias("weight"))
    return R.drifted_weights(targets, stats.select("symbol", "trade_date", "ret")).select("strategy", "trade_date", "symbol", r6("w_exec").alias("w_exec"))


@query
def size_breakpoints(spark, d):
    return Z.breakpoints(Z.previous_caps(T.caps(spark, d))).select("trade_date", r6("breakpoint").alias("breakpoint"), "n_symbols")


def _members(spark, d) -> DataFrame:
    prev = Z.previous_caps(T.caps(spark, d))
    return Z.membership(prev, Z.breakpoints(prev), T.market(spark, d))


@query
def size_membership(spark, d):
    return _members(spark, d).select("trade_date", "symbol_base", "size_bucket", "prev_cap")


@query
def size_bucket_returns(spark, d):
    return Z.bucket_returns(_members(spark, d)).select("size_bucket", "trade_date", r6("ret").alias("ret"), "n_names", r6("total_cap", 4).alias("total_cap"))


@query
def stock_day_buckets(spark, d):
    return Z.with_bucket(T.signals(spark, d), _members(spark, d)).groupBy(F.coalesce("size_bucket", F.lit("none")).alias("size_bucket")).agg(F.count("*").alias("n"), F.sum("news_count").alias("news"))


@query
def caps_from_shares(spark, d):
    closes = T.bars(spark, d).select("symbol", "trade_date", "close")
    shares = closes.filter(F.dayofmonth("trade_date") <= 7).select("symbol", "trade_date", (F.month("trade_date") * 1000.0).alias("shares"))
    return Z.caps_from_shares(closes, shares).select("symbol", "trade_date", r6("market_cap", 4).alias("market_cap"), r6("coverage").alias("coverage"))


@query
def article_texts(spark, d):
    a = T.articles(spark, d)
    return a.select(
        "doc", F.md5(X.article_text("title", "text")).alias("text_md5"), F.md5(X.strip_urls("text")).alias("bare_md5"), X.is_title_only("title", "text").alias("is_title_only"),
        F.md5(X.truncated("text", 1500)).alias("cut_md5"), F.size(X.bag_tokens("text")).cast("long").alias("n_tokens"),
        X.length_reason("text", "symbol", "day", 300, 6000).alias("reason"),
    )


@query
def drop_reasons(spark, d):
    a = T.articles(spark, d).withColumn("reason", X.length_reason("text", "symbol", "day", 300, 6000))
    return U.reason_counts(a)


@query
def prompts(spark, d):
    a = T.articles(spark, d)
    after = "The above is the {subject}. Please choose a trading position."
    return a.select("doc", F.md5(X.chat(X.label_prompt("title", "text", 200))).alias("prompt_md5"), F.md5(X.label_prompt("title", "title", 200, after=after)).alias("closed_md5"))


@query
def position_prompts(spark, d):
    return T.articles(spark, d).select("doc", F.md5(X.position_prompt("symbol", "title", "text", 300)).alias("prompt_md5"))


def _answers(spark, d) -> DataFrame:
    kind = F.col("event_type")
    text = F.when(kind == "click", "long. Or Short").when(kind == "error", "\n  Short. Certainly\nLONG").when(kind == "view", "INSUFFICIENT_INFO, not long").when(kind == "signup", "longer shorts").otherwise("Yes")
    return T.events(spark, d).withColumn("answer", text)


@query
def answer_labels(spark, d):
    label = X.answer_label("answer")
    return _answers(spark, d).select("event_id", F.coalesce(label, F.lit("UNKNOWN")).alias("label"), label.isNotNull().alias("parsed_ok"), X.first_line("answer").alias("first_line"))


@query
def bag_norms(spark, d):
    return D.norms(T.articles(spark, d)).select("symbol", "doc", "n_terms", "n_tokens", r6("norm").alias("norm"))


@query
def similar_articles(spark, d):
    return D.similar_pairs(T.articles(spark, d)).select("symbol", "earlier", "later", r6("cosine").alias("cosine"))


@query
def kept_articles(spark, d):
    return D.greedy_keep(T.articles(spark, d))


@query
def business_day_gaps(spark, d):
    a = T.table(spark, d, "orders")
    start, end = F.col("o_orderdate").cast("date"), F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 23).cast("int") - 5)
    return a.select("o_orderkey", M.business_days(start, end).alias("gap"))


@query
def article_times(spark, d):
    e = T.events(spark, d)
    link = F.when(F.col("event_id") % 3 == 0, "https://www.fool.com/a").when(F.col("event_id") % 3 == 1, "https://x.investorplace.com/b").otherwise("https://notfool.com/c")
    at = F.when(F.col("event_id") % 2 == 0, F.date_trunc("day", "ts")).otherwise(F.col("ts"))
    return e.select("event_id", F.date_format(M.article_time(at, link), "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query
def parsed_times(spark, d):
    e = T.events(spark, d).filter("event_id is not null")
    seconds = F.unix_timestamp("ts")
    k = F.col("event_id") % 6
    text = (
        F.when(k == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, seconds.cast("string")).when(k == 2, (seconds * 1000).cast("string"))
        .when(k == 3, F.concat(F.date_format("ts", "EEE, d MMM yyyy HH:mm:ss"), F.lit(" GMT"))).when(k == 4, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise("no time")
    )
    return e.select("event_id", F.date_format(M.any_timestamp(text), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query
def symbol_names(spark, d):
    s = T.symbols(spark, d).select(F.concat(F.lit(" "), F.lower("symbol"), F.lit(" ")).alias("raw"), "symbol")
    return s.select(
        "symbol", N.normalize_symbol("raw").alias("normal"), N.exchange_of("symbol").alias("exchange"), N.base_symbol("symbol").alias("base"), N.vendor_symbol("raw").alias("vendor"),
        N.on_exchange("symbol", ["nyse"]).alias("on_nyse"), N.file_safe(F.concat("symbol", F.lit("/x y"))).alias("file_name"),
    )


@query
def splits_of_days(spark, d):
    i = M.date_int("trade_date")
    return T.bars(spark, d).select("trade_date").distinct().select(i.cast("long").alias("day"), M.split_of(i, (19960101, 19971231), (19980101, 19991231)).alias("split"), M.int_date(i).alias("back"))


@query
def trade_days(spark, d):
    return B.trade_days(T.bars(spark, d), "1996-01-01", "1998-12-31")


@query
def bar_aliases(spark, d):
    stems = T.symbols(spark, d).select(F.col("symbol").alias("stem"))
    more = stems.select(F.concat(N.base_symbol("stem"), F.lit(".NYSE")).alias("stem"))
    return B.alias_table(stems.union(more).distinct())


def _universe(spark, d) -> tuple[DataFrame, DataFrame]:
    s = T.table(spark, d, "part").select(F.col("p_partkey").alias("seq"), F.concat(F.lit("P"), (F.col("p_partkey") % 120).cast("string"), F.when(F.col("p_partkey") % 2 == 0, ".NYSE").otherwise(".NASDAQ")).alias("full_ticker"), F.col("p_name").alias("name"))
    return s.filter("seq % 3 <> 0"), s.filter("seq % 3 = 0")


@query
def universe_prefer_active(spark, d):
    return U.prefer_active(*_universe(spark, d)).select("full_ticker", "seq", "is_delisted")


@query
def universe_counts(spark, d):
    return U.counts_by_exchange(U.prefer_active(*_universe(spark, d)))


@query
def universe_only_delisted(spark, d):
    return U.only_delisted(*_universe(spark, d)).select("full_ticker", "seq")


@query
def tickers_first_seen(spark, d):
    active, delisted = _universe(spark, d)
    both = active.unionByName(delisted).select(F.concat(F.lit(" "), F.lower("full_ticker")).alias("ticker"), "seq")
    return U.without(U.first_of_each(both), both.filter("seq % 10 = 0").select("ticker"))


@query
def tickers_by_metadata(spark, d):
    active, _ = _universe(spark, d)
    tickers = active.select(F.col("full_ticker").alias("ticker")).distinct()
    words = F.when(F.col("seq") % 7 == 0, " Warrant").when(F.col("seq") % 11 == 0, " unit").otherwise("")
    metadata = active.filter("seq % 5 <> 0").select(F.col("full_ticker").alias("ticker"), F.concat("name", words).alias("name"), "seq")
    return U.split_by_metadata(tickers, metadata)


@query
def tickers_with_news(spark, d):
    active, delisted = _universe(spark, d)
    return U.split_by_presence(active.select(F.col("full_ticker").alias("ticker")).distinct(), delisted.select(F.col("full_ticker").alias("symbol")), "no_response")


@query
def single_symbol_reasons(spark, d):
    lines = T.table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    own = lines.groupBy("l_orderkey").agg(F.collect_set(F.col("l_suppkey").cast("string")).alias("symbols"), (F.min("l_suppkey") + F.col("l_orderkey") % 2).cast("string").alias("requested"))
    return U.reason_counts(U.single_symbol_articles(own))


@query
def sampled_pages(spark, d):
    return U.sample(T.table(spark, d, "pages"), "page_id", 20, 7).select("page_id", "url")


@query
def page_times(spark, d):
    return P.page_times(T.table(spark, d, "pages"))


@query
def baseline_path(spark, d):
    one = T.bars(spark, d).filter("symbol like 'S1.%'")
    return B.baseline(one).select("trade_date", r6("ret").alias("ret"), r6("equity").alias("equity"))


@query
def strategy_against_baseline(spark, d):
    base = B.baseline(T.bars(spark, d).filter("symbol like 'S1.%'"))
    return R.against_baseline(_daily(spark, d), base).select("strategy", "trade_date", r6("equity").alias("equity"), r6("baseline_equity").alias("baseline_equity"))


@query
def loss_day_summary(spark, d):
    stats, signals = T.market(spark, d), T.signals(spark, d)
    targets = S.all_targets(signals, MIN_POOL, MIN_SHORT)
    days = G.loss_days(_daily(spark, d), LOSS)
    out = G.summary(G.contributions(targets, signals, stats, days))
    return out.select("strategy", "trade_date", "n_long", "n_short", r6("total").alias("total"), "worst_symbol", r6("worst_contribution").alias("worst_contribution"))


@query
def bars_around_a_day(spark, d):
    b = T.bars(spark, d)
    targets = b.groupBy("symbol").agg(F.max_by("trade_date", F.struct("volume", "trade_date")).alias("target_date"))
    return B.near_rows(b.select("symbol", "trade_date", "volume"), targets).select("symbol", "target_date", "trade_date", F.col("offset").cast("long").alias("offset"))


@query
def vector_sums(spark, d):
    rows = T.table(spark, d, "embeddings").withColumn("g", F.col("vec_id") % 7)
    sums = H.vector_sums(rows, ["g", "label"], "embedding", 64)
    return sums.select("g", "label", "n", F.posexplode("vec_sum").alias("pos", "s")).select("g", "label", "n", F.col("pos").cast("long").alias("pos"), r6("s", 4).alias("s"))


@query
def group_scores(spark, d):
    rows = T.table(spark, d, "embeddings").withColumn("g", F.col("vec_id") % 7)
    sums = H.vector_sums(rows, ["g"], "embedding", 64)
    w = [(k % 5 - 2) / 10 for k in range(64)]
    return sums.select("g", *[r6(H.group_score(m, w, 0.25), 4).alias(m) for m in ("mean", "sum_head", "sum_embedding")])


@query
def daily_ic(spark, d):
    return H.daily_ic(T.predictions(spark, d)).select("trade_date", "n", r6("pearson").alias("pearson"), r6("spearman").alias("spearman"))


@query
def ic_summary(spark, d):
    out = H.ic_summary(T.predictions(spark, d), 5)
    return out.select(*[c if c.endswith("_days") else r6(c).alias(c) for c in out.columns])


@query
def ic_with_silent_names(spark, d):
    universe = T.market(spark, d).select("trade_date", "symbol", F.col("ret").alias("target"))
    full = H.no_news_zero(T.predictions(spark, d), universe)
    out = H.ic_summary(full, 5)
    return out.select(*[c if c.endswith("_days") else r6(c).alias(c) for c in out.columns])


@query
def ridge_grid(spark, d):
    rows = T.table(spark, d, "embeddings").withColumns({"y": F.col("label").cast("double"), "target": F.col("label").cast("double"), "trade_date": F.date_add(F.lit("2024-01-01").cast("date"), (F.col("vec_id") % 9).cast("int"))})
    stats = H.gram(rows.filter("vec_id % 3 <> 0"), "embedding", "y", 64)
    return H.grid(stats, rows.filter("vec_id % 3 = 0"), "embedding", [1e-6, 1e-4, 1e-2, 1e-1])


#: Ranges of days, both ends in, as numbers.
TRAIN, VALIDATION = (19960101, 19971231), (19980101, 19991231)


@query
def parsed_answers(spark, d):
    label = X.answer_label("answer")
    flag = F.when(F.col("event_type") != "view", label.isNotNull())  # null for views
    return S.only_parsed(_answers(spark, d).withColumn("parsed_ok", flag)).select("event_id", "event_type")


@query
def small_stock_days(spark, d):
    return Z.of_bucket(Z.with_bucket(T.signals(spark, d), _members(spark, d)), "small").select("trade_date", "symbol", "news_count")


@query
def returns_since(spark, d):
    return B.since(T.market(spark, d), "1998-01-01").select("symbol", "trade_date", "prev_close", r6("adv").alias("adv"), r6("ret").alias("ret"))


@query
def resolved_bar_files(spark, d):
    stems = T.symbols(spark, d).filter("l_suppkey >= 10").select(F.col("symbol").alias("stem"))
    wanted = T.table(spark, d, "nation").select(F.concat(F.lit("s"), F.col("n_nationkey").cast("string"), F.lit(".us")).alias("symbol"))
    return B.resolve_stems(wanted, stems)


@query
def allowed_bar_files(spark, d):
    stems = T.symbols(spark, d).select(F.col("symbol").alias("stem"))
    name = F.concat(F.lit("s"), F.col("n_nationkey").cast("string"), F.when(F.col("n_nationkey") % 2 == 0, ".US").otherwise(".NYSE"))
    return B.answering(stems, T.table(spark, d, "nation").select(name.alias("symbol")))


@query
def universe_by_split(spark, d):
    return H.universe_by_split(T.market(spark, d), TRAIN, VALIDATION).select("split", "trade_date", "symbol", r6("target").alias("target"))


@query
def ranked_holdings(spark, d):
    stats, signals = T.market(spark, d), T.signals(spark, d)
    targets = S.all_targets(signals, MIN_POOL, MIN_SHORT)
    out = G.contributions(targets, signals, stats, targets.select("strategy", "trade_date").distinct())
    # Contributions that differ in the last bits only are ties.
    return G.ranked(out.withColumn("contribution", r6("contribution", 12) + 0.0)).select("strategy", "trade_date", "symbol", "place", r6("contribution").alias("contribution"))


@query
def first_articles(spark, d):
    return U.first_rows(T.articles(spark, d), 50, "day", "doc").select("day", "doc", "symbol")


@query
def pooled_states(spark, d):
    states = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.slice("embedding", k * 8 + 1, F.lit(8)))
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: (k < F.col("vec_id") % 9).cast("double"))
    rows = T.table(spark, d, "embeddings").select("vec_id", states.alias("states"), mask.alias("mask"))
    pooled = rows.select("vec_id", F.posexplode(H.masked_mean("states", "mask", 8)).alias("pos", "v"))
    return pooled.select("vec_id", F.col("pos").cast("long").alias("pos"), r6("v", 5).alias("v"))


@query
def head_ic_by_split(spark, d):
    rows = T.table(spark, d, "embeddings").withColumns({"target": F.col("label").cast("double"), "trade_date": F.date_add(F.lit("2024-01-01").cast("date"), (F.col("vec_id") % 9).cast("int"))})
    rows = rows.withColumn("split", F.when(F.col("vec_id") % 3 == 0, "val").when(F.col("vec_id") % 3 == 1, "train"))
    scored, _ = H.train_and_score(rows, "embedding", "target", 64, 1e-2)
    return H.ic_by_split(scored, 5)


ORACLE_SQL = {k: v for k, v in SQL.items() if k in QUERIES}
