"""Hand-made cases: boundaries, ties, nulls, order dependence, recursion."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import names as N
from orrery.functions import text as X
from orrery.functions import times as M
from orrery.operators import bars as B
from orrery.operators import dedupe as D
from orrery.operators import heads as H
from orrery.operators import pages as P
from orrery.operators import portfolio as R
from orrery.operators import signals as S
from orrery.operators import size as Z

D0 = dt.date(2024, 3, 6)


def days(n):
    return [D0 + dt.timedelta(k) for k in range(n)]


def values(frame, expression):
    return [r[0] for r in frame.select(expression).collect()]


def test_windows_are_open_left_closed_right_over_summer_time(spark):
    bars = spark.createDataFrame([("A", d) for d in days(6)], "symbol string, trade_date date")
    calendar = B.calendar(bars)
    cutoffs = {r.trade_date: r.cutoff for r in calendar.collect()}
    assert cutoffs[dt.date(2024, 3, 8)].hour == 14 and cutoffs[dt.date(2024, 3, 11)].hour == 13
    assert D0 not in cutoffs  # the first day has no window
    at = cutoffs[dt.date(2024, 3, 8)]
    tick = dt.timedelta(microseconds=1)
    rows = [("A", at, 1), ("A", at + tick, 2), ("A", at - dt.timedelta(days=9), 3), ("A", at + dt.timedelta(days=90), 4), ("A", None, 5), ("B", at, 6)]
    got = {r.k: r.trade_date for r in S.assign_days(spark.createDataFrame(rows, "symbol string, ts timestamp, k int"), calendar).collect()}
    assert got == {1: dt.date(2024, 3, 8), 2: dt.date(2024, 3, 9)}


def test_eligibility_needs_twenty_prior_and_twenty_five_rows(spark):
    rows = [("A", d, 2.0, 2.0, 2.0, 100.0) for d in days(25)] + [("B", d, 2.0, 2.0, 2.0, 100.0) for d in days(24)]
    stats = B.with_statistics(spark.createDataFrame(rows, "symbol string, trade_date date, open double, close double, adjusted_close double, volume double"), 2.0, 200.0)
    got = stats.orderBy("trade_date").collect()
    assert {r.symbol for r in got} == {"A"}
    assert [r.eligible for r in got] == [False] * 20 + [True] * 5
    assert got[-1].ret == 0 and got[-1].fwd_ret is None


def test_returns_need_trades_and_positive_opens(spark):
    rows = [("A", d, o, 2.0, a, v) for d, o, a, v in zip(days(5), [1.0, 2.0, 0.0, 3.0, 6.0], [2.0, None, 2.0, 2.0, 4.0], [1.0, 1.0, 1.0, 0.0, 1.0])]
    f = spark.createDataFrame(rows, "symbol string, trade_date date, open double, close double, adjusted_close double, volume double")
    got = B.with_statistics(f, 0, 0, least_rows=1).orderBy("trade_date").collect()
    assert [r.ret for r in got] == [1.0, 0.0, 0.0, 0.0, 0.0]
    assert [r.fwd_ret for r in got] == [1.0, None, None, 1.0, None]


def reference_path(targets, rets, eligible, dates, bps):
    """Day by day, as the definition says."""
    prev, equity, out = {}, 1.0, []
    for d in dates:
        prev = {s: w if eligible.get((s, d), False) else 0.0 for s, w in prev.items()}
        want = targets.get(d, {})
        names = set(prev) | set(want)
        moved = sum(abs(want.get(s, 0) - prev.get(s, 0)) for s in names)
        turnover = 0.5 * (moved + abs(sum(prev.values()) - sum(want.values())))
        gross = sum(w * rets.get((s, d), 0.0) for s, w in want.items())
        net = gross - turnover * bps / 1e4
        equity *= 1 + net
        out.append((gross, turnover, net, equity))
        prev = {s: w * (1 + rets.get((s, d), 0.0)) / (1 + gross) if 1 + gross > 0 else 0.0 for s, w in want.items()}
    return out


def test_execution_equals_the_day_by_day_definition(spark):
    rng = np.random.default_rng(0)
    dates, names = days(30), list("ABCDE")
    rets = {(s, d): float(rng.normal(0, 0.3)) for s in names for d in dates if rng.random() < 0.9}
    rets[("A", dates[3])] = -5.0  # takes the portfolio below zero
    eligible = {k: bool(rng.random() < 0.8) for k in rets}
    targets = {d: {s: float(rng.normal()) for s in names if rng.random() < 0.6} for d in dates if rng.random() < 0.8}
    targets[dates[3]] = {"A": 1.0}
    t = spark.createDataFrame([("s", d, s, w) for d, ws in targets.items() for s, w in ws.items()], "strategy string, trade_date date, symbol string, weight double")
    r = spark.createDataFrame([(s, d, v, eligible[(s, d)]) for (s, d), v in rets.items()], "symbol string, trade_date date, ret double, eligible boolean")
    days_ = spark.createDataFrame([(d,) for d in dates], "trade_date date")
    got = R.with_equity(R.execute_daily(t, r, days_, 3.0)).orderBy("trade_date").collect()
    for g, e in zip(got, reference_path(targets, rets, eligible, dates, 3.0), strict=True):
        assert np.allclose((g.gross_ret, g.turnover, g.net_ret, g.equity), e, rtol=1e-9, atol=1e-12)


def test_drift_equals_the_recursion(spark):
    rng = np.random.default_rng(1)
    dates = days(12)
    rets = {(s, d): float(rng.normal(0, 0.05)) for s in "AB" for d in dates}
    start = {dates[0]: {"A": 0.5, "B": 0.3}, dates[7]: {"A": -0.2, "B": 0.6}}
    t = spark.createDataFrame([("s", d, s, w) for d, ws in start.items() for s, w in ws.items()], "strategy string, rebalance_date date, symbol string, weight double")
    r = spark.createDataFrame([(s, d, v) for (s, d), v in rets.items()], "symbol string, trade_date date, ret double")
    got = {(x.trade_date, x.symbol): x.w_exec for x in R.drifted_weights(t, r).collect()}
    w = {}
    for d in dates:
        w = dict(start.get(d, w))
        for s in w:
            assert np.isclose(got[(d, s)], w[s], atol=1e-12)
        gross = sum(w[s] * rets[(s, d)] for s in w)
        w = {s: w[s] * (1 + rets[(s, d)]) / (1 + gross) for s in w}


def sparse_path(targets, marks, rets, eligible, dates, bps, aim=0.0, lookback=252, cap=1.0):
    """The engine day by day, as the definition says."""
    prev, past, out = {}, [], []
    for d in dates:
        turnover, scale, want = 0.0, 1.0, prev
        if d in marks:
            prev = {s: w if eligible.get((s, d), False) else 0.0 for s, w in prev.items()}
            want = targets.get(d, {})
            if aim and sum(want.values()) > 0:
                vol = np.std(past[-lookback:], ddof=1) * 252**0.5 if len(past) >= 20 else 0.0
                scale = min(aim / vol if vol > 0 else 1.0, cap)
                want = {s: w * scale for s, w in want.items()}
            moved = sum(abs(want.get(s, 0) - prev.get(s, 0)) for s in set(prev) | set(want))
            turnover = 0.5 * (moved + abs(sum(prev.values()) - sum(want.values())))
        gross = sum(w * rets.get((s, d), 0.0) for s, w in want.items())
        past.append(gross - turnover * bps / 1e4)
        out.append((gross, turnover, past[-1], sum(want.values()), scale))
        prev = {s: w * (1 + rets.get((s, d), 0.0)) / (1 + gross) if 1 + gross > 0 else 0.0 for s, w in want.items()}
    return out


@pytest.mark.parametrize("every", [1, 7])
def test_sparse_and_targeted_execution_equal_the_day_by_day_definition(spark, every):
    rng = np.random.default_rng(every)
    dates, names = days(70), list("ABCDE")
    rets = {(s, d): float(rng.normal(0, 0.05)) for s in names for d in dates if rng.random() < 0.9}
    rets[("A", dates[31])] = -9.0  # closes the books that hold it
    eligible = {k: bool(rng.random() < 0.8) for k in rets}
    marks = [d for k, d in enumerate(dates) if k >= 3 and (k - 3) % every == 0]
    books = {name: {d: {s: float(rng.normal(shift, 0.3)) for s in names if rng.random() < 0.6} for d in dates if rng.random() < 0.9} for name, shift in (("long", 0.3), ("flat", 0.0))}
    for book in books.values():
        book[[d for d in marks if d <= dates[31]][-1]] = {"A": 0.9, "B": 0.1}
    rows = [(n, d, s, w) for n, book in books.items() for d, ws in book.items() for s, w in ws.items()]
    t = spark.createDataFrame(rows, "strategy string, trade_date date, symbol string, weight double")
    m = spark.createDataFrame([(d,) for d in marks], "trade_date date")
    r = spark.createDataFrame([(s, d, v, eligible[(s, d)]) for (s, d), v in rets.items()], "symbol string, trade_date date, ret double, eligible boolean")
    days_ = spark.createDataFrame([(d,) for d in dates], "trade_date date")
    plain, scaled = R.execute(t, m, r, days_, 5.0), R.execute_to_volatility(t, m, r, days_, 0.2, 5.0, months=1, max_leverage=1.5)
    for frame, options in ((plain, {}), (scaled, {"aim": 0.2, "lookback": 21, "cap": 1.5})):
        for name, book in books.items():
            got = sorted((x for x in frame.collect() if x.strategy == name), key=lambda x: x.trade_date)
            for g, e in zip(got, sparse_path(book, set(marks), rets, eligible, dates, 5.0, **options), strict=True):
                assert np.allclose((g.gross_ret, g.turnover, g.net_ret, g.leverage), e[:4], rtol=1e-8, atol=1e-11)
                assert not options or np.isclose(g.vol_scale, e[4])


def signal_rows(n, yes, no):
    return [(D0, f"S{k}", int(k < yes), int(yes <= k < yes + no), 1, True, None) for k in range(n)]


@pytest.mark.parametrize("n,short,expected", [(9, 1, 0), (10, 1, 4), (10, 0, 4), (10, 2, 0)])
def test_strict_gate(spark, n, short, expected):
    f = spark.createDataFrame(signal_rows(n, 3, 1), "trade_date date, symbol string, yes_count int, no_count int, news_count int, eligible boolean, size_bucket string")
    f = f.withColumns({"paper_score": F.expr("yes_count - no_count"), "strict_long": F.expr("yes_count > 0 and no_count = 0"), "strict_short": F.expr("no_count > 0 and yes_count = 0")})
    got = S.strict_targets(f, 10, short).collect()
    assert len(got) == expected and (not got or np.isclose(sum(abs(r.weight) for r in got), 1))
    one_pass = S.all_targets(f, 10, short, buckets=True)
    for name, build in S.STRATEGIES.items():
        assert sorted((r.symbol, round(r.weight, 12)) for r in one_pass.filter(F.col("strategy") == name).collect()) == sorted((r.symbol, round(r.weight, 12)) for r in build(f, 10, short).collect())


def test_quantile_ties_and_overlap(spark):
    f = spark.createDataFrame([(D0, s, 1.0, True) for s in "ABCDEFGHIJ"], "trade_date date, symbol string, pred double, eligible boolean")
    got = {r.symbol: r.weight for r in S.quantile_targets(f, 0.2).collect()}
    assert got == {"A": -0.25, "B": -0.25, "I": 0.25, "J": 0.25}
    assert sum(r.weight > 0 for r in S.quantile_targets(f, 0.6).collect()) == 6


def test_greedy_keeps_what_resembles_only_a_dropped_one(spark):
    a = "one two three four five six seven eight nine ten"
    b = "one two three four five six seven eight nine x"
    c = "one two three four five six seven eight y x"
    rows = [("S", D0, 1, a), ("S", D0, 2, b), ("S", D0, 3, c), ("S", D0 + dt.timedelta(9), 4, a), ("S", D0, 5, ""), ("S", D0, 6, None), ("T", D0, 7, a)]
    f = spark.createDataFrame(rows, "symbol string, day date, doc long, text string")
    got = {r.doc: r.kept for r in D.greedy_keep(f, 0.85).collect()}
    assert got == {1: True, 2: False, 3: True, 4: True, 5: True, 6: True, 7: True}


def test_business_days(spark):
    rng = np.random.default_rng(3)
    pairs = [(D0 + dt.timedelta(int(a)), D0 + dt.timedelta(int(a + b))) for a, b in zip(rng.integers(-900, 900, 200), rng.integers(0, 40, 200))]
    f = spark.createDataFrame(pairs, "a date, b date")
    assert values(f, M.business_days("a", "b")) == [int(np.busday_count(a, b)) for a, b in pairs]


def test_time_formats(spark):
    texts = ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05+01:00", "1704164645", "1704164645000", "Tue, 02 Jan 2024 03:04:05 GMT", "02 Jan 2024 03:04:05 +0000", "nothing", "", None]
    got = values(spark.createDataFrame([(t,) for t in texts], "t string"), M.any_timestamp("t"))
    at = dt.datetime(2024, 1, 2, 3, 4, 5)
    assert got == [at, at - dt.timedelta(hours=1), at, at, at, at, None, None, None]


def test_midnight_shift(spark):
    rows = [("2024-01-02 00:00:00", "https://www.fool.com/x", 1), ("2024-01-02 00:00:01", "https://www.fool.com/x", 0), ("2024-01-02 00:00:00", "https://a.investorplace.com/", 1), ("2024-01-02 00:00:00", "https://notfool.com", 0), ("2024-01-02 00:00:00", None, 0)]
    f = spark.createDataFrame(rows, "t string, link string, shift int").withColumn("ts", F.to_timestamp("t"))
    assert values(f, F.datediff(M.article_time("ts", "link"), "ts") == F.col("shift")) == [True] * 5


def test_answers(spark):
    cases = {"LONG": "YES", "short.": "NO", "INSUFFICIENT_INFO": "UNKNOWN", "Long or short": "YES", "SHORT, not LONG": "NO", "\n\n long": "YES", "YES": None, "": None, None: None, "belong": None}
    f = spark.createDataFrame([(k,) for k in cases], "t string")
    assert values(f, X.answer_label("t")) == list(cases.values())
    assert values(f, X.answer_label("t", accept_yes_no=True))[6] == "YES"


def test_texts(spark):
    f = spark.createDataFrame([("T", "see http://a.b/c now  \nend "), ("T", "T"), ("", "c"), ("T", None), (None, None)], "t string, c string")
    assert values(f, X.article_text("t", "c", without_urls=True)) == ["T\n\nsee  now\nend", "T", "c", "T", ""]
    assert values(f, X.is_title_only("t", "c")) == [False, True, False, True, False]


def test_prompts(spark):
    f = spark.createDataFrame([(" ab ", " T ", "see http://x.y now"), (None, "T", "http://x.y"), ("A", None, "c"), ("A", "\tT\n", "T http://x.y")], "s string, t string, c string")
    ask = X.LABEL_INSTRUCTION
    assert values(f, X.label_prompt("t", "c", 5)) == [f"{ask}\nT\n\nsee  n"[: len(ask) + 8].rstrip(), f"{ask}\nT", f"{ask}\nc", f"{ask}\nT"]
    assert values(f, X.label_prompt("t", "c", 5, "Q", "of {subject}"))[1] == "Q\nT\n\nof news title"
    got = values(f, X.position_prompt("s", "t", "c", 99))
    assert got[0] == X.POSITION_TEMPLATE.format(ticker="AB", subject="news", news="T\n\nsee  now") and got[1] == X.POSITION_TEMPLATE.format(ticker="the stock", subject="news title", news="T")
    assert values(f, X.chat(F.lit("u"), "s"))[0] == "<s>[INST] <<SYS>>\ns\n<</SYS>>\n\nu [/INST]"
    assert values(f, X.is_title_only("t", "c")) == [False, True, False, True]


def test_page_times_take_the_first_that_parses(spark):
    html = [
        '<meta name="pubdate" content="soon"><meta name="dc.date" content="2024-01-02"><meta name="datepublished" content="2020-01-01">',
        '<meta name="date" content="2020-01-01"><script type="application/ld+json">{"a": [{"datePublished": "x"}, {"b": {"datepublished": 1704067200}}], "datePublished": "2021-01-01"}</script>',
        "<p>Last modified on 2024-03-04T05:06Z and updated 2025-01-01",
    ]
    got = P.page_times(spark.createDataFrame(list(enumerate(html)), "page_id long, html string")).orderBy("page_id").collect()
    assert [(r.published, r.published_source) for r in got[:2]] == [(dt.datetime(2024, 1, 2), "meta:dc.date"), (dt.datetime(2024, 1, 1), "jsonld:$[0].a[1].b.datepublished")]
    assert (got[2].modified, got[2].modified_source) == (dt.datetime(2024, 3, 4, 5, 6), "html:updated_text_fallback")


def test_names(spark):
    f = spark.createDataFrame([(" brk.b.nyse ",), ("ABC",), ("X-WT.NYSE",)], "s string")
    assert values(f, N.exchange_of(N.normalize_symbol("s"))) == ["NYSE", "", "NYSE"]
    assert values(f, N.base_symbol(N.normalize_symbol("s"))) == ["BRK.B", "ABC", "X-WT"]
    assert values(f, N.is_non_equity("s", F.lit(None).cast("string"))) == [False, False, True]
    names = ["Community Bank", "Bright Horizons", "Wright Medical", "Some Rights", "New unit of", "Warrant", None]
    n = spark.createDataFrame([("ABC", x) for x in names], "s string, n string")
    assert values(n, N.is_non_equity("s", "n")) == [False, False, False, True, True, True, False]
    assert N.penalty_tag(1e-6) == "1em06" and N.penalty_tag(0.01) == "0p01"


def test_ic_without_variance_is_null(spark):
    rows = [(D0, float(k % 2), 1.0) for k in range(6)] + [(D0 + dt.timedelta(1), float(k), float(k)) for k in range(6)] + [(D0 + dt.timedelta(2), 1.0, 2.0), (D0 + dt.timedelta(3), float("nan"), 1.0)]
    f = spark.createDataFrame(rows, "trade_date date, pred double, target double")
    got = {r.trade_date: r for r in H.daily_ic(f).collect()}
    assert got[D0].pearson is None and got[D0 + dt.timedelta(2)].spearman is None and len(got) == 3
    assert np.isclose(got[D0 + dt.timedelta(1)].spearman, 1)
    assert H.ic_summary(f, 20).first().pearson_mean is None


def test_ridge_equals_the_normal_equations(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 5))
    y = x @ np.arange(5) + 3 + rng.normal(size=200)
    f = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y)] + [([float("nan")] * 5, 1.0), (None, 1.0)], "v array<double>, y double")
    w, b = H.ridge(H.gram(f, "v", "y", 5), 3.0)
    z = np.column_stack([x, np.ones(200)])
    expected = np.linalg.solve(z.T @ z + np.diag([3.0] * 5 + [0]), z.T @ y)
    assert np.allclose(np.append(w, b), expected)
    assert len(H.sum_head_adam(x, np.ones(200), y, epochs=2)[0]) == 5
    assert H.principal_axes(H.gram(f, "v", "y", 5), 2).shape == (5, 2)


def test_page_times(spark):
    html = [
        '<meta property="article:published_time" content="2024-01-02T03:04:05Z"><meta name=lastmod content="x">',
        '<script type="application/ld+json">{"@graph": [{"a": {"datePublished": "2024-01-02T03:04:05Z"}}]}</script> Updated on: 2024-01-05 10:00',
        "<p>nothing", None,
    ]
    f = spark.createDataFrame(list(enumerate(html)), "page_id long, html string")
    got = {r.page_id: r for r in P.page_times(f).collect()}
    at = dt.datetime(2024, 1, 2, 3, 4, 5)
    assert [got[k].published for k in range(4)] == [at, at, None, None]
    assert got[1].published_source == "jsonld:$[0].@graph[0].a.datePublished" and got[1].modified == dt.datetime(2024, 1, 5, 10)
    stored = spark.createDataFrame([(0, at - dt.timedelta(hours=1)), (1, at), (2, at)], "page_id long, db_time timestamp")
    assert {r.page_id: (r.status, r.delta_hours) for r in P.audit(stored, P.page_times(f)).collect()} == {0: ("suspicious", -1.0), 1: ("ok", 0.0), 2: ("unknown", None)}


def test_bar_files_resolve_by_exchange_then_prefix(spark):
    stems = spark.createDataFrame([("AB.NASDAQ",), ("ABC.NYSE",), ("AZ.NASDAQ",), ("AX.LSE",), ("BRK.B.NYSE",)], "stem string")
    wanted = spark.createDataFrame([("ab.us",), ("A",), ("AZ",), ("AX",), ("BRK",), ("BRK.B",), ("ABCD",), (None,), ("A",)], "symbol string")
    got = {r.symbol: r.stem for r in B.resolve_stems(wanted, stems).collect()}
    assert got == {"ab.us": "AB.NASDAQ", "A": "ABC.NYSE", "AZ": "AZ.NASDAQ", "AX": None, "BRK": "BRK.B.NYSE", "BRK.B": "BRK.B.NYSE", "ABCD": None, None: None}
    allowed = spark.createDataFrame([(" az.us ",), ("BRK.B",), (None,)], "symbol string")
    assert sorted(r.stem for r in B.answering(stems, allowed).collect()) == ["AZ.NASDAQ", "BRK.B.NYSE"]


def test_masked_mean_of_odd_numbers(spark):
    nan, inf = float("nan"), float("inf")
    rows = [([[1.0, 2.0], [3.0, nan], [inf, 6.0]], [1, 1, 0]), ([[1.0, 2.0]], [0]), ([], [])]
    got = values(spark.createDataFrame(rows, "states array<array<double>>, mask array<int>"), H.masked_mean("states", "mask", 2))
    assert got == [[0.0, 0.0], [0.0, 0.0], [0.0, 0.0]]
    rows = [([[1.0, 2.0], [3.0, 5.0], [9.0, 9.0]], [1, 1, 0])]
    assert values(spark.createDataFrame(rows, "states array<array<double>>, mask array<int>"), H.masked_mean("states", "mask", 2)) == [[2.0, 3.5]]


def test_a_head_is_fitted_on_its_own_split(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 3))
    y = x @ [1.0, -2.0, 0.5] + 0.3
    rows = [(k, D0 + dt.timedelta(k % 4), x[k].tolist(), float(y[k]) if k < 40 else float(-y[k]), ("train", "val", None)[k // 40 if k < 58 else 2]) for k in range(60)]
    rows += [(60, D0, [1.0], 1.0, "train"), (61, D0, [1.0, float("nan"), 2.0], 1.0, "train"), (62, D0, [1.0, 1.0, 1.0], None, "train")]
    f = spark.createDataFrame(rows, "k int, trade_date date, v array<double>, target double, split string")
    scored, (weights, bias) = H.train_and_score(f, "v", "target", 3, 1e-9)
    assert np.allclose(weights + [bias], [1.0, -2.0, 0.5, 0.3])
    assert sorted(r.k for r in scored.collect()) == [*range(58), 62]
    ic = {r.split: r for r in H.ic_by_split(scored, 3).collect()}
    assert np.isclose(ic["train"].pearson_mean, 1) and np.isclose(ic["val"].spearman_mean, -1)


def test_null_flags_and_buckets_do_not_pass(spark):
    f = spark.createDataFrame([(1, True, "small"), (2, False, "non_small"), (3, None, None)], "k int, parsed_ok boolean, size_bucket string")
    assert values(S.only_parsed(f), "k") == [1]
    assert values(Z.of_bucket(f, "small"), "k") == [1] and len(values(Z.of_bucket(f, None), "k")) == 3
