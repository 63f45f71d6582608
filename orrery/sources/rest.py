"""Market data over HTTP as Python data sources: one partition a ticker, or a page a batch.

``fetch`` is a function (url, params) -> text and is given as "module:function",
so tests and machines without a network plug in their own.
"""

from __future__ import annotations

import importlib
import json
import random
import time
import urllib.parse
import urllib.request
from collections.abc import Callable

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader


class RateLimiter:
    """At most ``per_minute`` calls; none or less of it is an error unless ``lenient``, which switches the limit off."""

    def __init__(self, per_minute: float, lenient: bool = False, clock=time.monotonic, sleep=time.sleep):
        if per_minute <= 0 and not lenient:
            raise ValueError("the rate must be positive")
        self.gap = 60.0 / per_minute if per_minute > 0 else 0.0
        self.next, self.clock, self.sleep = 0.0, clock, sleep

    def wait(self) -> None:
        now = self.clock()
        if now < self.next:
            self.sleep(self.next - now)
        self.next = max(now, self.next) + self.gap


def with_retries(call: Callable, attempts: int = 8, backoff: float = 2.0, retry_on=(OSError, TimeoutError), sleep=time.sleep):
    """The call's result; waits backoff, 2 backoff, ... (with some jitter) between attempts."""
    for k in range(attempts):
        try:
            return call()
        except retry_on:
            if k == attempts - 1:
                raise
            sleep(backoff * 2**k * (1 + 0.1 * random.random()))
    raise ValueError("attempts must be positive")


def http_fetch(url: str, params: dict, timeout: float = 60.0) -> str:
    with urllib.request.urlopen(f"{url}?{urllib.parse.urlencode(params)}", timeout=timeout) as answer:  # noqa: S310
        return answer.read().decode("utf-8", "replace")


def http_page(url: str, max_bytes: int = 2_000_000, timeout: float = 20.0) -> str:
    """A page's first bytes, by the charset it states."""
    with urllib.request.urlopen(url, timeout=timeout) as answer:  # noqa: S310
        return answer.read(max_bytes).decode(answer.headers.get_content_charset() or "utf-8", "replace")


def _function(name: str) -> Callable:
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


#: For each kind of data: columns, and the value of a column in a row (spellings in order of preference).
KINDS = {
    "bars": [("date", "string", ("date", "Date")), ("open", "double", ("open", "Open")), ("high", "double", ("high", "High")), ("low", "double", ("low", "Low")),
             ("close", "double", ("close", "Close")), ("adjusted_close", "double", ("adjusted_close", "Adj Close")), ("volume", "double", ("volume", "Volume"))],
    "market_cap": [("date", "string", ("date", "Date")), ("market_cap", "double", ("market_cap", "marketCap", "value"))],
    "shares": [("date", "string", ("date",)), ("shares", "double", ("shares", "sharesOutstanding"))],
    "symbols": [("code", "string", ("Code",)), ("name", "string", ("Name",)), ("country", "string", ("Country",)), ("exchange", "string", ("Exchange",)),
                ("currency", "string", ("Currency",)), ("type", "string", ("Type",)), ("isin", "string", ("Isin",))],
    "news": [("date", "string", ("date",)), ("title", "string", ("title",)), ("content", "string", ("content",)), ("link", "string", ("link",)), ("symbols", "string", ("symbols",))],
}


def parse_rows(kind: str, ticker: str, text: str) -> list[tuple]:
    """Rows of an answer; numbers that are none become null."""
    found = json.loads(text)
    rows = found if isinstance(found, list) else found.get("data", [])

    def value(row, how, spellings):
        v = next((row[s] for s in spellings if row.get(s) is not None), None)
        if how == "string":
            return v if v is None or isinstance(v, str) else json.dumps(v)
        try:
            return float(v)
        except (TypeError, ValueError):
            return None

    return [(ticker, *[value(r, how, s) for _, how, s in KINDS[kind]]) for r in rows]


class _Tickers(InputPartition):
    def __init__(self, tickers: list[str], per_minute: float):
        self.tickers, self.per_minute = tickers, per_minute


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        """The tickers, dealt to at most ``readers`` partitions, each of which has its share of the rate."""
        tickers = [t for t in self.options["tickers"].split(",") if t]
        readers = min(int(self.options.get("readers", "4")), len(tickers))
        return [_Tickers(tickers[k::readers], float(self.options.get("perMinute", "999")) / readers) for k in range(readers)]

    def read(self, partition):
        o = self.options
        fetch = _function(o.get("fetch", "orrery.sources.rest:http_fetch"))
        limiter = RateLimiter(partition.per_minute, lenient=True)
        params = {k[6:]: v for k, v in o.items() if k.startswith("param.")}
        for ticker in partition.tickers:

            def call():
                limiter.wait()  # a repeated call counts too
                return fetch(o["url"].format(ticker=ticker), params)

            text = with_retries(call, int(o.get("attempts", "8")), float(o.get("backoff", "2")))
            yield from parse_rows(o.get("kind", "bars"), ticker, text)


class _Pages(SimpleDataSourceStreamReader):
    """News pages in order: the offset is (ticker number, row offset); a short page ends a ticker."""

    def __init__(self, options: dict):
        self.options = options
        self.tickers = [t for t in options["tickers"].split(",") if t]

    def initialOffset(self):
        return {"ticker": 0, "row": 0}

    def _page(self, ticker: str, row: int) -> list[tuple]:
        o = self.options
        fetch, limit = _function(o.get("fetch", "orrery.sources.rest:http_fetch")), int(o.get("limit", "1000"))
        text = with_retries(lambda: fetch(o["url"].format(ticker=ticker), {"s": ticker, "offset": row, "limit": limit}), int(o.get("attempts", "5")), float(o.get("backoff", "2")))
        return parse_rows("news", ticker, text)

    def read(self, start):
        t, row = start["ticker"], start["row"]
        if t >= len(self.tickers):
            return iter([]), start
        rows = self._page(self.tickers[t], row)
        short = len(rows) < int(self.options.get("limit", "1000"))
        return iter(rows), {"ticker": t + 1, "row": 0} if short else {"ticker": t, "row": row + len(rows)}

    def readBetweenOffsets(self, start, end):
        while (start["ticker"], start["row"]) < (end["ticker"], end["row"]):
            rows, start = self.read(start)
            yield from rows

    def commit(self, end):
        pass


class MarketData(DataSource):
    """``spark.dataSource.register(MarketData)``, then ``format("market_data")`` with url, tickers, kind, fetch."""

    @classmethod
    def name(cls):
        return "market_data"

    def schema(self):
        kind = self.options.get("kind", "bars")
        return "ticker string, " + ", ".join(f"{c} {t}" for c, t, _ in KINDS[kind])

    def reader(self, schema):
        return _Reader(dict(self.options))

    def simpleStreamReader(self, schema):
        return _Pages(dict(self.options))
