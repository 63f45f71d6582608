"""ANSI SQL (as DuckDB runs it) for the registered queries, composed from named sub-queries."""

from __future__ import annotations

from ..functions.text import LABEL_INSTRUCTION, POSITION_TEMPLATE

_SYMBOL = "'S' || s_suppkey || case when s_nationkey % 2 = 0 then '.NYSE' else '.NASDAQ' end"

#: name -> (sub-queries it reads, SQL)
_PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "sym": ((), f"select s_suppkey as l_suppkey, {_SYMBOL} as symbol, s_acctbal from supplier"),
    "bars": (("sym",), """
        select symbol, trade_date, first(p order by l_orderkey, l_linenumber, p) as open, last(p order by l_orderkey, l_linenumber, p) as close, sum(l_quantity) as volume
        from (select *, 1000::double + floor(l_extendedprice / l_quantity) / 100::double as p, cast(l_shipdate as date) as trade_date from lineitem) join sym using (l_suppkey) group by symbol, trade_date"""),
    "raw": (("bars",), """
        select *, count(*) over (partition by symbol) as n_rows, lag(close) over w as prev_close,
          case when count(close * volume) over p = 20 then avg(close * volume) over p end as adv,
          coalesce(case when open > 0 and lead(open) over w > 0 and volume > 0 and lead(volume) over w > 0 then lead(open) over w / open - 1 end, 0) as ret,
          case when open > 0 and lead(open) over w > 0 then lead(open) over w / open - 1 end as fwd_ret
        from bars window w as (partition by symbol order by trade_date), p as (partition by symbol order by trade_date rows between 20 preceding and 1 preceding)"""),
    "numbered": (("bars",), "select *, row_number() over (partition by symbol order by trade_date) as r from bars"),
    "mkt": (("raw",), "select *, coalesce(open > 0 and prev_close >= 1.0 and adv >= 29000, false) as eligible from raw where n_rows >= 25"),
    "cal": (("bars",), """
        select symbol, trade_date, cutoff, lag(cutoff) over w as window_open, lag(shut) over w as night_open from (
          select distinct symbol, trade_date, (trade_date + interval 9 hour) at time zone 'America/New_York' at time zone 'UTC' as cutoff,
            (trade_date + interval 16 hour) at time zone 'America/New_York' at time zone 'UTC' as shut from bars)
        window w as (partition by symbol order by trade_date)"""),
    "ev": ((), "select 'U' || user_id || '.NYSE' as symbol, ts, event_id, event_type, value from events"),
    "evcal": (("ev",), """
        select symbol, trade_date, cutoff, lag(cutoff) over w as window_open, lag(shut) over w as night_open from (
          select distinct symbol, cast(ts as date) as trade_date, (cast(ts as date) + interval 9 hour) at time zone 'America/New_York' at time zone 'UTC' as cutoff,
            (cast(ts as date) + interval 16 hour) at time zone 'America/New_York' at time zone 'UTC' as shut from ev)
        window w as (partition by symbol order by trade_date)"""),
    "news": (("sym",), """
        select symbol, cast(o_orderdate as timestamp) as ts, case o_orderstatus when 'F' then 'YES' when 'O' then 'NO' else 'UNKNOWN' end as label, substr(o_orderpriority, 1, 1) = '1' as is_title_only
        from lineitem join orders on l_orderkey = o_orderkey join sym using (l_suppkey)"""),
    "assigned": (("news", "cal"), "select news.*, trade_date from news join cal on news.symbol = cal.symbol and ts > window_open and ts <= cutoff"),
    "counts": (("assigned",), """
        select *, yes_count - no_count as paper_score, yes_count > 0 and no_count = 0 as strict_long, no_count > 0 and yes_count = 0 as strict_short from (
          select trade_date, symbol, count(*) filter (label = 'YES') as yes_count, count(*) filter (label = 'NO') as no_count, count(*) filter (label = 'UNKNOWN') as unknown_count,
            count(*) as news_count, count(*) filter (is_title_only) as title_only_count from assigned group by trade_date, symbol)"""),
    "sig": (("counts", "mkt"), "select counts.*, coalesce(mkt.eligible, false) as eligible, mkt.ret from counts left join mkt using (symbol, trade_date)"),
    "pool": (("sig",), """
        select *, count(*) over d as n_pool, count(*) filter (strict_long) over d as n_sl, count(*) filter (strict_short) over d as n_ss,
          count(*) filter (paper_score > 0) over d as n_pos, count(*) filter (paper_score < 0) over d as n_neg
        from sig where eligible window d as (partition by trade_date)"""),
    "tgt": (("pool",), """
        select 'strict_unknown_filtered' as strategy, trade_date, symbol, raw / sum(abs(raw)) over (partition by trade_date) as weight from (
          select trade_date, symbol, cast(case when strict_long then yes_count when strict_short then -no_count end as double) as raw from pool
          where n_pool >= 3 and n_sl >= 1 and n_ss >= 1) where raw is not null and raw <> 0
        union all select 'paper_like_positive_negative', trade_date, symbol, paper_score / sum(abs(paper_score)) over (partition by trade_date) from pool
          where n_pool >= 3 and n_pos >= 1 and n_neg >= 1 and paper_score <> 0
        union all select 'long_only_yes_no_no', trade_date, symbol, 1.0 / count(*) over (partition by trade_date) from pool where n_pool >= 3 and strict_long"""),
    "pred": (("sig",), "select trade_date, symbol, paper_score / news_count as pred, eligible, ret as target from sig"),
    "chain": (("mkt",), "select trade_date, lead(trade_date) over (order by trade_date) as next_date from (select distinct trade_date from mkt)"),
    "held": (("tgt", "mkt"), "select tgt.*, coalesce(mkt.ret, 0) as ret, sum(weight * coalesce(mkt.ret, 0)) over (partition by strategy, tgt.trade_date) as g from tgt left join mkt using (symbol, trade_date)"),
    "drift": (("held", "chain", "mkt"), """
        select strategy, next_date as trade_date, held.symbol, case when coalesce(m.eligible, false) and 1 + g > 0 then weight * (1 + held.ret) / (1 + g) else 0 end as before
        from held join chain using (trade_date) left join mkt m on m.symbol = held.symbol and m.trade_date = next_date where next_date is not null"""),
    "daily": (("held", "drift", "chain"), """
        select strategy, trade_date, coalesce(gross_ret, 0) as gross_ret, coalesce(turnover, 0) as turnover, coalesce(turnover, 0) * 3.0 / 1e4 as cost,
          coalesce(gross_ret, 0) - coalesce(turnover, 0) * 3.0 / 1e4 as net_ret, coalesce(leverage, 0) as leverage, coalesce(gross_leverage, 0) as gross_leverage,
          coalesce(n_long, 0) as n_long, coalesce(n_short, 0) as n_short
        from (select distinct strategy from held) cross join (select trade_date from chain) left join (
          select strategy, trade_date, sum(gain) as gross_ret, 0.5 * (sum(abs(w - b)) + abs(sum(b) - sum(w))) as turnover, sum(w) as leverage, sum(abs(w)) as gross_leverage,
            count(*) filter (w > 0) as n_long, count(*) filter (w < 0) as n_short
          from (select strategy, trade_date, symbol, sum(w) as w, sum(b) as b, sum(gain) as gain from (
              select strategy, trade_date, symbol, weight as w, 0 as b, weight * ret as gain from held
              union all select strategy, trade_date, symbol, 0, before, 0 from drift) group by all) group by all) using (strategy, trade_date)"""),
    "path": (("daily",), """
        select *, equity / max(equity) over (partition by strategy order by trade_date) - 1 as drawdown
        from (select *, product(1 + net_ret) over (partition by strategy order by trade_date) as equity from daily)"""),
    "firsts": (("tgt",), "select min(trade_date) as trade_date from tgt group by date_trunc('month', trade_date)"),
    "seg": (("chain", "firsts"), """
        select trade_date, next_date, mark is not null as rebalance, last_value(mark ignore nulls) over (order by trade_date) as segment
        from (select chain.trade_date, next_date, firsts.trade_date as mark from chain left join firsts using (trade_date))"""),
    "grown": (("tgt", "seg", "mkt"), """
        select *, coalesce(lag(e) over (partition by strategy, segment, symbol order by trade_date), weight) as s from (
          select t.strategy, seg.segment, seg.trade_date, seg.next_date, t.symbol, weight, weight * product(1 + coalesce(mkt.ret, 0)) over (partition by t.strategy, seg.segment, t.symbol order by seg.trade_date) as e
          from tgt t join seg on t.trade_date = seg.segment left join mkt on mkt.symbol = t.symbol and mkt.trade_date = seg.trade_date)"""),
    "worth": (("grown", "seg"), """
        select *, coalesce(min(after) over (partition by strategy, segment order by trade_date rows between unbounded preceding and 1 preceding), 1) > 0 as alive from (
          select strategy, trade_date, seg.segment, seg.next_date, rebalance, coalesce(s, 0) as s, coalesce(e, 0) as e, 1 - coalesce(w, 0) + coalesce(s, 0) as before, 1 - coalesce(w, 0) + coalesce(e, 0) as after
          from (select distinct strategy from tgt) cross join seg left join (select strategy, trade_date, sum(weight) as w, sum(s) as s, sum(e) as e from grown group by all) using (strategy, trade_date))"""),
    "moved": (("worth", "grown", "mkt", "tgt", "firsts"), """
        select strategy, trade_date, 0.5 * (sum(abs(want - had)) + abs(sum(want) - sum(had))) as turnover from (
          select strategy, trade_date, symbol, sum(want) as want, sum(had) as had from (
            select strategy, trade_date, symbol, weight as want, 0 as had from tgt where trade_date in (select trade_date from firsts)
            union all
            select g.strategy, g.next_date, g.symbol, 0, case when m.eligible and w.alive and w.after > 0 then g.e / w.after else 0 end
            from grown g join firsts on firsts.trade_date = g.next_date join worth w on w.strategy = g.strategy and w.trade_date = g.trade_date
            left join mkt m on m.symbol = g.symbol and m.trade_date = g.next_date) group by all) group by all"""),
    "quarters": (("mkt",), """
        select trade_date as rebalance_date, symbol, 1.0::double / count(*) over (partition by trade_date) as weight, dense_rank() over (order by trade_date) as q from mkt
        where eligible and trade_date in (select min(trade_date) from mkt where eligible group by date_trunc('quarter', trade_date))"""),
    "caps": (("bars", "sym"), "select bars.symbol, trade_date, close * s_acctbal as market_cap from bars join sym using (symbol)"),
    "prevcap": (("caps",), "select * from (select symbol, trade_date, lag(case when market_cap > 0 then market_cap end) over (partition by symbol order by trade_date) as prev_cap from caps) where prev_cap is not null"),
    "points": (("prevcap",), "select trade_date, quantile_cont(prev_cap, 0.2) as breakpoint, count(*) as n_symbols from prevcap where symbol like '%.NYSE' group by trade_date"),
    "mem": (("prevcap", "points", "mkt"), """
        select trade_date, regexp_replace(symbol, '[.][^.]*$', '') as symbol_base, case when prev_cap <= breakpoint then 'small' else 'non_small' end as size_bucket, prev_cap, ret
        from prevcap join mkt using (symbol, trade_date) join points using (trade_date)"""),
    "art": ((), "select doc_id as doc, source as symbol, date '2024-01-01' + cast(doc_id % 28 as int) as day, string_split(coalesce(text, ''), chr(10))[1] as title, coalesce(text, '') as text from documents"),
    "txt": (("art",), r"""
        select *, trim(title) as t, trim(text) as c,
          regexp_replace(regexp_replace(regexp_replace(text, 'https?://\S+|www\.\S+', '', 'g'), '[ \t]+\n', chr(10), 'g'), '^\s+|\s+$', '', 'g') as bare from art"""),
    "bag": (("art",), "select symbol, day, doc, token, count(*) as c from (select symbol, day, doc, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as token from art) group by all"),
    "bagn": (("bag",), "select *, sqrt(sum(c * c) over (partition by symbol, doc)) as norm from bag"),
    "norms": (("bag",), "select symbol, doc, day, count(*) as n_terms, sum(c) as n_tokens, sqrt(sum(c * c)) as norm from bag group by all"),
    "univ": ((), "select p_partkey as seq, 'P' || p_partkey % 120 || case when p_partkey % 2 = 0 then '.NYSE' else '.NASDAQ' end as full_ticker, p_name as name from part"),
    "active": (("univ",), "select * from univ where seq % 3 <> 0"),
    "gone": (("univ",), "select * from univ where seq % 3 = 0"),
    "best": (("active", "gone"), """
        select full_ticker, seq, is_delisted from (select *, row_number() over (partition by full_ticker order by is_delisted, seq) as r from (
          select *, false as is_delisted from active union all select *, true from gone)) where r = 1"""),
    "base1": (("bars",), """
        select trade_date, ret, product(1 + ret) over (order by trade_date) as equity from (
          select trade_date, coalesce(close / lag(close) over (order by trade_date) - 1, 0) as ret from bars where symbol like 'S1.%')"""),
    "emb": ((), "select vec_id, label, vec_id % 7 as g, generate_subscripts(embedding, 1) - 1 as pos, cast(unnest(embedding) as double) as v from embeddings"),
    "ranked": (("pred",), """
        select *, rank() over (partition by trade_date order by pred) + (count(*) over (partition by trade_date, pred) - 1) / 2 as rp,
          rank() over (partition by trade_date order by target) + (count(*) over (partition by trade_date, target) - 1) / 2 as rt from pred where pred is not null and target is not null"""),
    "full": (("pred", "mkt"), "select mkt.trade_date, mkt.symbol, mkt.ret as target, coalesce(pred.pred, 0) as pred from mkt left join pred using (trade_date, symbol)"),
    "franked": (("full",), """
        select *, rank() over (partition by trade_date order by pred) + (count(*) over (partition by trade_date, pred) - 1) / 2 as rp,
          rank() over (partition by trade_date order by target) + (count(*) over (partition by trade_date, target) - 1) / 2 as rt from full_"""),
}
_PARTS["full_"] = _PARTS.pop("full")
_PARTS["franked"] = (("full_",), _PARTS["franked"][1])
_IC = """
    select trade_date, count(*) as n, covar_samp(pred, target) / nullif(stddev_samp(pred) * stddev_samp(target), 0) as pearson,
      covar_samp(rp, rt) / nullif(stddev_samp(rp) * stddev_samp(rt), 0) as spearman from {} group by trade_date"""
_PARTS["ic"] = (("ranked",), _IC.format("ranked"))
_PARTS["fic"] = (("franked",), _IC.format("franked"))
_SUMMARY = ", ".join(
    f"count({c}) as {c}_days, round(avg({c}), 6) as {c}_mean, round(stddev_samp({c}), 6) as {c}_std, round(avg({c}) / nullif(stddev_samp({c}), 0), 6) as {c}_ir" for c in ("pearson", "spearman")
)


def _with(body: str, *parts: str) -> str:
    """``body`` with the sub-queries it needs, each once, before those that read it."""
    order: list[str] = []

    def visit(name: str) -> None:
        for p in _PARTS[name][0]:
            visit(p)
        if name not in order:
            order.append(name)

    for p in parts:
        visit(p)
    return "with " + ", ".join(f"{p} as ({_PARTS[p][1]})" for p in order) + " " + body if order else body


def _weights(n: int = 64) -> str:
    return "[" + ", ".join(str((k % 5 - 2) / 10) for k in range(n)) + "]"


_R6 = "round({0}, 6)"
_STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"

_quoted = lambda text: "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
_LABEL = _quoted(LABEL_INSTRUCTION)
_POSITION = _quoted(POSITION_TEMPLATE.format(ticker="<ticker>", subject="<subject>", news="<news>"))
_TITLE_ONLY = "(t <> '' and (bare = '' or bare = t or c = t))"
_NEWS = "trim(t || chr(10) || chr(10) || case when " + _TITLE_ONLY + " then '' else substr(bare, 1, {0}) end, ' ' || chr(9) || chr(10) || chr(13))"

SQL: dict[str, str] = {
    "daily_bars": _with("select symbol, trade_date, open, close, volume from bars", "bars"),
    "bar_statistics": _with("select symbol, trade_date, prev_close, round(adv, 6) as adv, eligible from mkt", "mkt"),
    "open_returns": _with("select symbol, trade_date, round(ret, 6) as ret, round(fwd_ret, 6) as fwd_ret from mkt", "mkt"),
    "trading_windows": _with(f"select symbol, trade_date, {_STAMP.format('window_open')} as window_open, {_STAMP.format('cutoff')} as cutoff, {_STAMP.format('night_open')} as night_open from cal where window_open is not null", "cal"),
    "event_days": _with("select event_id, ev.symbol, trade_date from ev join evcal on ev.symbol = evcal.symbol and ts > window_open and ts <= cutoff", "ev", "evcal"),
    "event_days_overnight": _with("select event_id, ev.symbol, trade_date from ev join evcal on ev.symbol = evcal.symbol and ts > night_open and ts <= cutoff", "ev", "evcal"),
    "label_counts": _with("select * from counts", "counts"),
    "label_totals": _with("select sum(yes_count)::bigint as yes_count, sum(no_count)::bigint as no_count, sum(unknown_count)::bigint as unknown_count, sum(news_count)::bigint as news_count, sum(title_only_count)::bigint as title_only_count from counts", "counts"),
    "stock_day_signals": _with("select trade_date, symbol, paper_score, news_count, eligible, round(ret, 6) as ret from sig", "sig"),
    "strategy_targets": _with("select strategy, trade_date, symbol, round(weight, 6) as weight from tgt", "tgt"),
    "quantile_targets": _with("""
        select trade_date, symbol, round(case when r > n - k then 0.5 / k else -0.5 / k end, 6) as weight from (
          select *, floor(n * 0.3::double) as k from (select *, row_number() over (partition by trade_date order by pred, symbol) as r, count(*) over (partition by trade_date) as n from pred where eligible))
        where n >= 3 and k >= 1 and (r > n - k or r <= k)""", "pred"),
    "pool_counts": _with("select trade_date, count(*) as n_pool, count(*) filter (strict_long) as n_long, count(*) filter (strict_short) as n_short from sig where eligible group by trade_date", "sig"),
    "backtest_daily": _with("select strategy, trade_date, " + ", ".join(f"case when round({c}, 12) = 0 then 0 else round({c}, 12) end as {c}" for c in ("gross_ret", "turnover", "cost", "net_ret", "leverage", "gross_leverage")) + ", n_long, n_short from daily", "daily"),
    "backtest_performance": _with(f"""
        select strategy, {_R6.format('total')} as total_return, {_R6.format('(case when total > -1 then (1 + total) ** (252.0 / n) - 1 else -1 end)')} as ann_return, {_R6.format('vol')} as ann_vol,
          {_R6.format('(m * 252 / nullif(vol, 0))')} as sharpe, {_R6.format('dd')} as max_drawdown, n as n_days
        from (select strategy, product(1 + net_ret) - 1 as total, avg(net_ret) as m, stddev_samp(net_ret) * sqrt(252) as vol, min(drawdown) as dd, count(*) as n from path group by strategy)""", "path"),
    "equity_path": _with(f"select strategy, trade_date, {_R6.format('equity')} as equity, {_R6.format('drawdown')} as drawdown from path", "path"),
    "monthly_backtest": _with("""
        select strategy, trade_date, rebalance, round(gross, 9) + 0 as gross_ret, round(turn, 9) + 0 as turnover, round(turn * 3.0 / 1e4, 9) + 0 as cost, round(gross - turn * 3.0 / 1e4, 9) + 0 as net_ret, round(lev, 9) + 0 as leverage
        from (select strategy, trade_date, rebalance, case when alive then (e - s) / before else 0 end as gross, case when alive then s / before else 0 end as lev, coalesce(turnover, 0) as turn
          from worth left join moved using (strategy, trade_date))""", "worth", "moved"),
    "drifted_weights": _with("""
        select 'equal' as strategy, trade_date, symbol, round(weight * g / (1 - sum(weight) over d + sum(weight * g) over d), 6) as w_exec from (
          select h.*, m.trade_date, coalesce(product(1 + coalesce(ret, 0)) over (partition by h.q, h.symbol order by m.trade_date rows between unbounded preceding and 1 preceding), 1) as g
          from quarters h left join (select distinct q - 1 as q, rebalance_date as until from quarters) n on n.q = h.q
          join mkt m on m.symbol = h.symbol and m.trade_date >= h.rebalance_date and (until is null or m.trade_date < until))
        window d as (partition by q, trade_date)""", "quarters"),
    "trailing_volatility": _with("""
        select strategy, trade_date, round(case when count(net_ret) over w >= 20 then stddev_samp(net_ret) over w * sqrt(252) end, 6) as vol_est_ann from daily
        window w as (partition by strategy order by trade_date rows between 63 preceding and 1 preceding)""", "daily"),
    "size_breakpoints": _with("select trade_date, round(breakpoint, 6) as breakpoint, n_symbols from points", "points"),
    "size_membership": _with("select trade_date, symbol_base, size_bucket, prev_cap from mem", "mem"),
    "size_bucket_returns": _with("select size_bucket, trade_date, round(sum(prev_cap * ret) / sum(prev_cap), 6) as ret, count(*) as n_names, round(sum(prev_cap), 4) as total_cap from mem group by size_bucket, trade_date", "mem"),
    "stock_day_buckets": _with("select coalesce(size_bucket, 'none') as size_bucket, count(*) as n, sum(news_count)::bigint as news from (select *, regexp_replace(symbol, '[.][^.]*$', '') as symbol_base from sig) left join mem using (trade_date, symbol_base) group by 1", "sig", "mem"),
    "caps_from_shares": _with("""
        select symbol, trade_date, round(close * shares, 4) as market_cap, round(coverage, 6) as coverage from (
          select *, count(shares) over (partition by symbol) / count(*) over (partition by symbol) as coverage from (
            select symbol, trade_date, close, last_value(case when day(trade_date) <= 7 then month(trade_date) * 1000.0 end ignore nulls) over (partition by symbol order by trade_date) as shares from bars))
        where coverage >= 0.5 and shares is not null""", "bars"),
    "article_texts": _with("""
        select doc, md5(case when t = '' then c when c = '' or t = c then t else t || chr(10) || chr(10) || c end) as text_md5, md5(bare) as bare_md5,
          t <> '' and (bare = '' or bare = t or c = t) as is_title_only, md5(substr(text, 1, 1500)) as cut_md5, len(regexp_extract_all(lower(text), '[a-z0-9]+')) as n_tokens,
          case when coalesce(trim(symbol), '') = '' then 'missing_symbol' when day is null then 'invalid_date' when length(text) < 300 then 'too_short' when length(text) > 6000 then 'too_long' end as reason from txt""", "txt"),
    "drop_reasons": _with("""
        select coalesce(case when coalesce(trim(symbol), '') = '' then 'missing_symbol' when day is null then 'invalid_date' when length(text) < 300 then 'too_short' when length(text) > 6000 then 'too_long' end, 'kept') as reason,
          count(*) as n from art group by 1""", "art"),
    "prompts": _with(f"""
        select doc, md5('<s>[INST] <<SYS>>' || chr(10) || 'You are a financial expert.' || chr(10) || '<</SYS>>' || chr(10) || chr(10) || {_LABEL} || chr(10) || news || ' [/INST]') as prompt_md5,
          md5({_LABEL} || chr(10) || t || chr(10) || chr(10) || 'The above is the news title. Please choose a trading position.') as closed_md5
        from (select *, {_NEWS.format(200)} as news from txt)""", "txt"),
    "position_prompts": _with(f"""
        select doc, md5(replace(replace(replace({_POSITION}, '<subject>', case when {_TITLE_ONLY} then 'news title' else 'news' end), '<ticker>', upper(symbol)), '<news>', {_NEWS.format(300)})) as prompt_md5
        from txt""", "txt"),
    "answer_labels": """
        select event_id, case event_type when 'click' then 'YES' when 'error' then 'NO' else 'UNKNOWN' end as label, event_type in ('click', 'error', 'view') as parsed_ok,
          case event_type when 'click' then 'LONG. OR SHORT' when 'error' then 'SHORT. CERTAINLY' when 'view' then 'INSUFFICIENT_INFO, NOT LONG' when 'signup' then 'LONGER SHORTS' else 'YES' end as first_line from events""",
    "bag_norms": _with("select symbol, doc, n_terms, n_tokens::bigint as n_tokens, round(norm, 6) as norm from norms", "norms"),
    "similar_articles": _with("""
        select x.symbol, x.doc as earlier, y.doc as later, round(sum(x.c * y.c) / (any_value(x.norm) * any_value(y.norm)), 6) as cosine
        from bagn x join bagn y on x.symbol = y.symbol and x.token = y.token and (x.day < y.day or x.day = y.day and x.doc < y.doc)
          and (select count(*) from range(x.day, y.day, interval 1 day) t(d) where dayofweek(d) between 1 and 5) <= 5
        group by x.symbol, x.doc, y.doc having sum(x.c * y.c) / (any_value(x.norm) * any_value(y.norm)) >= 0.8""", "bagn"),
    "business_day_gaps": """
        with f as (select o_orderkey, cast(o_orderdate as date) as a, cast(o_orderdate as date) + cast(o_orderkey % 23 as int) - 5 as b, date '1970-01-05' as m from orders)
        select o_orderkey, cast((5 * ((b - m) // 7) + least((b - m) % 7, 5)) - (5 * ((a - m) // 7) + least((a - m) % 7, 5)) as int) as gap from f""",
    "article_times": f"""
        select event_id, {_STAMP.format("t + case when event_id % 3 < 2 and t = date_trunc('day', t) then interval 1 day else interval 0 day end")} as ts
        from (select event_id, case when event_id % 2 = 0 then date_trunc('day', ts) else ts end as t from events)""",
    "parsed_times": f"select event_id, case when event_id % 6 < 5 then {_STAMP.format('ts')} end as parsed from events",
    "symbol_names": _with("""
        select symbol, symbol as normal, regexp_extract(symbol, '[^.]*$') as exchange, regexp_replace(symbol, '[.][^.]*$', '') as base, regexp_replace(symbol, '[.][^.]*$', '') || '.US' as vendor,
          symbol like '%.NYSE' as on_nyse, symbol || '_x_y' as file_name from sym""", "sym"),
    "splits_of_days": _with("""
        select cast(strftime(trade_date, '%Y%m%d') as bigint) as day, case when year(trade_date) in (1996, 1997) then 'train' when year(trade_date) in (1998, 1999) then 'val' end as split, trade_date as back
        from (select distinct trade_date from bars)""", "bars"),
    "trade_days": _with("select distinct trade_date from bars where trade_date between '1996-01-01' and '1998-12-31'", "bars"),
    "bar_aliases": _with("""
        select alias, stem from (select *, row_number() over (partition by alias order by case when stem like '%.NYSE' then 1 else 2 end, stem) as r from (
          select stem, unnest([stem, regexp_replace(stem, '[.][^.]*$', ''), regexp_replace(stem, '[.][^.]*$', '') || '.US']) as alias
          from (select symbol as stem from sym union select regexp_replace(symbol, '[.][^.]*$', '') || '.NYSE' from sym))) where r = 1""", "sym"),
    "universe_prefer_active": _with("select * from best", "best"),
    "universe_counts": _with("select regexp_extract(full_ticker, '[^.]*$') as exchange, count(*) filter (not is_delisted) as n_active, count(*) filter (is_delisted) as n_delisted, count(*) as n_total from best group by 1", "best"),
    "universe_only_delisted": _with("select full_ticker, seq from gone where full_ticker not in (select full_ticker from active)", "active", "gone"),
    "tickers_first_seen": _with("select full_ticker as ticker, min(seq) as seq from univ where full_ticker not in (select full_ticker from univ where seq % 10 = 0) group by 1", "univ"),
    "tickers_by_metadata": _with("""
        select ticker, coalesce(not bad, true) as kept, case when bad then 'non_equity' end as reason from (select distinct full_ticker as ticker from active) left join (
          select full_ticker as ticker, regexp_matches(lower(full_ticker || ' ' || arg_max(name || case when seq % 7 = 0 then ' Warrant' when seq % 11 = 0 then ' unit' else '' end, seq)), ' warrant| right| unit') or regexp_matches(upper(full_ticker), '-W|-R|-U') as bad
          from active where seq % 5 <> 0 group by 1) using (ticker)""", "active"),
    "tickers_with_news": _with("""
        select ticker, regexp_replace(ticker, '[.][^.]*$', '') in (select regexp_replace(full_ticker, '[.][^.]*$', '') from gone) as kept,
          case when regexp_replace(ticker, '[.][^.]*$', '') not in (select regexp_replace(full_ticker, '[.][^.]*$', '') from gone) then 'no_response' end as reason
        from (select distinct full_ticker as ticker from active)""", "active", "gone"),
    "single_symbol_reasons": """
        select case when n > 1 then 'several_symbols' when k % 2 = 1 then 'other_symbol' else 'kept' end as reason, count(*) as n
        from (select l_orderkey as k, count(distinct l_suppkey) as n from lineitem group by 1) group by 1""",
    "sampled_pages": "select page_id, url from pages order by md5('7|' || page_id), page_id limit 20",
    "baseline_path": _with(f"select trade_date, round(ret, 6) as ret, {_R6.format('equity')} as equity from base1", "base1"),
    "strategy_against_baseline": _with(f"""
        select strategy, trade_date, {_R6.format('equity')} as equity, {_R6.format('(b / first_value(b) over (partition by strategy order by trade_date))')} as baseline_equity from (
          select strategy, trade_date, path.equity, last_value(base1.equity ignore nulls) over (partition by strategy order by trade_date) as b from path left join base1 using (trade_date)) where b is not null""", "path", "base1"),
    "loss_day_summary": _with("""
        select strategy, trade_date, count(*) filter (weight > 0) as n_long, count(*) filter (weight < 0) as n_short, round(sum(weight * ret), 6) as total,
          first(symbol order by weight * ret, symbol) as worst_symbol, round(min(weight * ret), 6) as worst_contribution
        from held where (strategy, trade_date) in (select (strategy, trade_date) from daily where net_ret < -0.005) group by strategy, trade_date""", "held", "daily"),
    "bars_around_a_day": _with("""
        select b.symbol, t.trade_date as target_date, b.trade_date, b.r - t.r as "offset" from numbered b
        join (select * from numbered qualify row_number() over (partition by symbol order by volume desc, trade_date desc) = 1) t on b.symbol = t.symbol and abs(b.r - t.r) <= 3""", "numbered"),
    "parsed_answers": "select event_id, event_type from events where event_type in ('click', 'error')",
    "small_stock_days": _with("select trade_date, symbol, news_count from (select *, regexp_replace(symbol, '[.][^.]*$', '') as symbol_base from sig) join mem using (trade_date, symbol_base) where size_bucket = 'small'", "sig", "mem"),
    "returns_since": _with("select symbol, trade_date, prev_close, round(adv, 6) as adv, round(ret, 6) as ret from mkt where trade_date >= '1998-01-01'", "mkt"),
    "resolved_bar_files": _with("""
        select 's' || n_nationkey || '.us' as symbol, first(stem order by length(base) > length('S' || n_nationkey), stem like '%.NASDAQ', stem || '.parquet') as stem
        from nation left join (select symbol as stem, regexp_replace(symbol, '[.][^.]*$', '') as base from sym where l_suppkey >= 10) on starts_with(base, 'S' || n_nationkey) group by n_nationkey""", "sym"),
    "allowed_bar_files": _with("""
        select symbol as stem from sym where list_has_any([symbol, regexp_replace(symbol, '[.][^.]*$', ''), regexp_replace(symbol, '[.][^.]*$', '') || '.US'],
          (select list('S' || n_nationkey || case when n_nationkey % 2 = 0 then '.US' else '.NYSE' end) from nation))""", "sym"),
    "universe_by_split": _with("""
        select case when year(trade_date) < 1998 then 'train' else 'val' end as split, trade_date, regexp_replace(symbol, '[.][^.]*$', '') || '.US' as symbol, round(fwd_ret, 6) as target
        from mkt where fwd_ret is not null and year(trade_date) between 1996 and 1999""", "mkt"),
    "ranked_holdings": _with("""
        select strategy, trade_date, symbol, row_number() over (partition by strategy, trade_date order by c, symbol) as place, round(c, 6) as contribution
        from (select strategy, trade_date, symbol, round(weight * ret, 12) + 0 as c from held)""", "held"),
    "first_articles": "select date '2024-01-01' + (doc_id % 28)::int as day, doc_id as doc, source as symbol from documents order by day, doc limit 50",
    "pooled_states": """
        select vec_id, pos::bigint as pos, round(sum(case when k < vec_id % 9 then v else 0 end) / greatest(vec_id % 9, 1e-6::double), 5) as v
        from (select vec_id, (i - 1) % 8 as pos, (i - 1) // 8 as k, embedding[i]::double as v from (select vec_id, embedding, unnest(range(1, 65)) as i from embeddings)) group by vec_id, pos""",
    "vector_sums": _with("select g, label, count(*) as n, pos::bigint as pos, round(sum(v), 4) as s from emb group by g, label, pos", "emb"),
    "group_scores": _with(f"""
        select g, round(d / n + 0.25, 4) as mean, round(d + n * 0.25, 4) as sum_head, round(d + 0.25, 4) as sum_embedding
        from (select g, sum(v * {_weights()}[pos + 1]::double) as d, count(distinct vec_id) as n from emb group by g)""", "emb"),
    "daily_ic": _with("select trade_date, n, round(pearson, 6) as pearson, round(spearman, 6) as spearman from ic", "ic"),
    "ic_summary": _with(f"select {_SUMMARY} from ic where n >= 5", "ic"),
    "ic_with_silent_names": _with(f"select {_SUMMARY} from fic where n >= 5", "fic"),
}
