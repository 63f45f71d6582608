"""Projections of vendor rows, articles and model answers into the library's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import names as N
from . import text as X
from . import times as M


def _first(frame: DataFrame, spellings: tuple[str, ...], kind: str) -> Column:
    """The first spelling that the frame has and that is not null, as ``kind`` or null."""
    have = [F.col(f"`{c}`").cast("string").try_cast(kind) for c in spellings if c in frame.columns]
    return F.coalesce(*have) if have else F.lit(None).cast(kind)


def universe_rows(raw: DataFrame, exchange: str) -> DataFrame:
    """ticker, full_ticker and descriptive columns of a symbol list; rows without a code go."""
    ticker = N.normalize_symbol(_first(raw, ("Code", "code"), "string"))
    out = raw.select(
        ticker.alias("ticker"), F.concat(ticker, F.lit("." + exchange.strip().upper())).alias("full_ticker"),
        *[_first(raw, (c, c.lower()), "string").alias(c.lower()) for c in ("Name", "Country", "Exchange", "Currency", "Type", "Isin")],
    )
    return out.filter("ticker <> ''")


def bar_rows(raw: DataFrame) -> DataFrame:
    """symbol, trade_date and numbers of daily bars, by any of the vendors' spellings; rows without a date go."""
    number = lambda *s: F.nanvl(_first(raw, s, "double"), F.lit(None).cast("double"))
    out = raw.select(
        N.normalize_symbol(_first(raw, ("ticker", "requested_symbol", "symbol"), "string")).alias("symbol"), _first(raw, ("date", "Date"), "date").alias("trade_date"),
        number("open", "Open").alias("open"), number("high", "High").alias("high"), number("low", "Low").alias("low"), number("close", "Close").alias("close"),
        number("adjusted_close", "Adj Close", "adjustedClose").alias("adjusted_close"), number("volume", "Volume").alias("volume"),
    )
    return out.filter("trade_date is not null")


def market_cap_rows(raw: DataFrame) -> DataFrame:
    """symbol, trade_date, market_cap; incomplete rows go."""
    out = raw.select(
        N.normalize_symbol(_first(raw, ("ticker", "requested_symbol", "symbol"), "string")).alias("symbol"), _first(raw, ("date", "Date"), "date").alias("trade_date"),
        F.nanvl(_first(raw, ("market_cap", "marketCap", "value"), "double"), F.lit(None).cast("double")).alias("market_cap"),
    )
    return out.dropna()


def article_rows(raw: DataFrame) -> DataFrame:
    """Articles with cleaned symbols; ``raw_symbols`` keeps what the vendor sent."""
    return raw.select(
        N.base_symbol("source_ticker").alias("symbol"), "source_ticker", "date", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("content", F.lit("")).alias("content"),
        "link", "tags", "sentiment", X.symbol_list("symbols").alias("raw_symbols"),
    )


def metadata_rows(articles: DataFrame, keep_text: bool = False) -> DataFrame:
    """What is stored beside an embedding: keys, title, length of the model's text, and the rest as JSON."""
    text = X.article_text("title", "content", without_urls=True)
    fields = ["date", "symbol", "source_ticker", "title", "link", "source_file", "source_row"]
    extra = F.to_json(F.struct("tags", "sentiment", "raw_symbols")).alias("extra_fields")
    return articles.select(*fields, F.length(text).alias("text_char_len"), extra, *([text.alias("text")] if keep_text else []))


def response_rows(answers: DataFrame, truncate: int = 1500, keep_prompt: bool = False, keep_news: bool = False) -> DataFrame:
    """What is stored of a model's answer: lengths, label, whether it parsed, the raw answer."""
    news = X.article_text("title", "content", without_urls=True)
    label = X.answer_label("response_raw")
    out = [
        "date", "symbol", "source_ticker", "title", X.is_title_only("title", "content").alias("is_title_only"), "link", "source_file", "source_row",
        F.length(news).alias("news_char_len"), F.length(X.truncated(news, truncate)).alias("truncated_news_char_len"), F.length("prompt").alias("prompt_char_len"),
        F.coalesce(label, F.lit("UNKNOWN")).alias("response_label"), F.lit("").alias("response_explanation"), "response_raw", label.isNotNull().alias("response_parsed_ok"),
    ]
    return answers.select(*out, *(["prompt"] if keep_prompt else []), *([X.truncated(news, truncate).alias("truncated_news")] if keep_news else []))


def audit_rows(news: DataFrame) -> DataFrame:
    """Articles that can be checked against their page: with a link and a time."""
    at = M.utc_timestamp("date")
    return news.withColumn("db_time", at).filter(at.isNotNull() & (F.trim(F.coalesce("link", F.lit(""))) != ""))
