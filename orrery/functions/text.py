"""Article texts, prompts and model answers as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._columns import SPACES, col

#: Fixed patterns.
URL = r"https?://\S+|www\.\S+"
TOKEN = "[A-Za-z0-9]+"
LABELS = ("YES", "NO", "UNKNOWN")
ANSWER_PATTERNS = ((r"\bINSUF[A-Z_]*", "UNKNOWN"), (r"\bSHORT\b", "NO"), (r"\bLONG\b", "YES"))


def _clean(c) -> Column:
    return F.btrim(F.coalesce(col(c), F.lit("")), F.lit(SPACES))


def strip_urls(c) -> Column:
    """Without links, without blanks before a line's end, trimmed."""
    bare = F.regexp_replace(F.coalesce(col(c), F.lit("")), URL, "")
    return F.regexp_replace(F.regexp_replace(bare, r"[ \t]+\n", "\n"), r"^\s+|\s+$", "")


def article_text(title, content, without_urls: bool = False) -> Column:
    """Title, blank line, content; one of them if the other is empty or equal."""
    t, c = _clean(title), strip_urls(content) if without_urls else _clean(content)
    return F.when(t == "", c).when((c == "") | (t == c), t).otherwise(F.concat(t, F.lit("\n\n"), c))


def bag_tokens(c) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(TOKEN), F.lit(0))


def truncated(c, n: int) -> Column:
    return F.lit("") if n <= 0 else F.substring(F.coalesce(col(c), F.lit("")), 1, n)


def is_title_only(title, content) -> Column:
    """There is a title, and no content beyond it."""
    return (_clean(title) != "") & ((strip_urls(content) == "") | (_clean(content) == _clean(title)) | (strip_urls(content) == _clean(title)))


def length_reason(text, symbol, published, least: int = 100, most: int = 100_000) -> Column:
    """The first reason against an article (missing_symbol, invalid_date, too_short, too_long), or null."""
    n = F.length(col(text))
    return (
        F.when(_clean(symbol) == "", "missing_symbol")
        .when(col(published).isNull(), "invalid_date")
        .when(n < least, "too_short")
        .when(n > most, "too_long")
    )


def normalize_label(c) -> Column:
    up = F.upper(F.btrim(F.coalesce(col(c), F.lit("")), F.lit(SPACES)))
    return F.when(up.isin(*LABELS), up).otherwise("UNKNOWN")


def first_line(c) -> Column:
    """The first line that is not blank, trimmed, in capitals; empty if there is none."""
    lines = F.filter(F.split(F.coalesce(col(c), F.lit("")), r"\r\n|\r|\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return F.upper(F.btrim(F.coalesce(F.get(lines, 0), F.lit("")), F.lit(SPACES)))


def answer_label(c, accept_yes_no: bool = False) -> Column:
    """YES, NO or UNKNOWN by the earliest known word of an answer's first line; null if there is none."""
    line = first_line(c)
    patterns = ANSWER_PATTERNS + (((r"\bNO\b", "NO"), (r"\bYES\b", "YES")) if accept_yes_no else ())
    places = []
    for p, label in patterns:
        before = F.length(F.get(F.split(line, p, 2), 0))
        places.append(F.when(line.rlike(p), F.struct(before.alias("at"), F.lit(label).alias("label"))))
    return F.array_min(F.array_compact(F.array(*places)))["label"]


#: What the models are asked.
SYSTEM_PROMPT = "You are a financial expert."
LABEL_INSTRUCTION = (
    'Answer "YES" if good news, "NO" if bad news, or "UNKNOWN" if uncertain in the first line. '
    "Then elaborate with one short and concise sentence on the next line."
)
POSITION_TEMPLATE = (
    "Choose a trading position for {ticker} for the next trading day after the {subject} below is released.\n\n"
    'Your first word must be exactly one of: "LONG", "SHORT", or "INSUFFICIENT_INFORMATION".\n'
    'Choose "LONG" if you would take a long position because the {subject} is likely to move {ticker}\'s stock price up over the next trading day.\n'
    'Choose "SHORT" if you would take a short position because the {subject} is likely to move {ticker}\'s stock price down over the next trading day.\n'
    'Choose "INSUFFICIENT_INFORMATION" if the {subject} does not provide enough stock-specific evidence for a directional trading position.\n\n'
    "Focus only on information materially relevant to {ticker}'s near-term stock return. "
    "Ignore generic market commentary, promotional language, and background information.\n\n"
    "{news}"
)
CHAT_TEMPLATE = "<s>[INST] <<SYS>>\n{system}\n<</SYS>>\n\n{user} [/INST]"


def _filled(template: str, **values: Column) -> Column:
    """``template`` with columns in place of its names in braces."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[x] if k % 2 else F.lit(x) for k, x in enumerate(parts) if x])


def _news(title, content, n: int) -> Column:
    """Title, blank line and at most ``n`` characters of the content without links; the title alone if there is no more."""
    return _clean(F.concat(_clean(title), F.lit("\n\n"), F.when(is_title_only(title, content), "").otherwise(truncated(strip_urls(content), n))))


def _subject(title, content) -> Column:
    return F.when(is_title_only(title, content), "news title").otherwise("news")


def label_prompt(title, content, n: int, instruction: str = LABEL_INSTRUCTION, after: str = "") -> Column:
    """Instruction and article; ``after`` (with {subject} in it) closes it, if given."""
    body = _news(title, content, n)
    if after:
        body = _clean(F.concat(body, F.lit("\n\n"), _filled(after, subject=_subject(title, content))))
    return _clean(F.concat(F.lit(f"{instruction}\n"), body))


def position_prompt(symbol, title, content, n: int) -> Column:
    """The question for a trading position in ``symbol``."""
    ticker = F.upper(_clean(symbol))
    ticker = F.when(ticker == "", "the stock").otherwise(ticker)
    return _filled(POSITION_TEMPLATE, ticker=ticker, subject=_subject(title, content), news=_news(title, content, n))


def chat(user, system: str = SYSTEM_PROMPT) -> Column:
    """The form of a chat for models without a template of their own."""
    return _filled(CHAT_TEMPLATE, system=F.lit(system), user=col(user))


def symbol_list(c) -> Column:
    """Trimmed capitals of an array of symbols, without blanks."""
    up = F.transform(F.coalesce(col(c), F.array().cast("array<string>")), lambda x: F.upper(F.btrim(x, F.lit(SPACES))))
    return F.filter(up, lambda x: x.isNotNull() & (x != ""))


def hash_bucket(c, buckets: int = 256) -> Column:
    return (F.crc32(F.encode(col(c), "UTF-8")) % buckets).cast("int")
