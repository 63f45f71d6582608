"""Ticker, exchange and file names as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._columns import SPACES, col

#: Words, after a blank, and marks in a ticker of securities other than shares.
NON_EQUITY_WORDS = (" warrant", " warrants", " right", " rights", " unit", " units")
NON_EQUITY_MARKS = ("-WT", "-WS", "-W", "-RT", "-RW", "-R", "-U", "-UN")


def normalize_symbol(c) -> Column:
    return F.upper(F.btrim(col(c), F.lit(SPACES)))


def exchange_of(c) -> Column:
    """What follows the last dot, in capitals; empty without a dot."""
    return F.when(F.contains(col(c), F.lit(".")), F.upper(F.substring_index(col(c), ".", -1))).otherwise(F.lit(""))


def base_symbol(c) -> Column:
    """What precedes the last dot."""
    return F.regexp_replace(col(c), r"\.[^.]*$", "")


def vendor_symbol(c, suffix: str = ".US") -> Column:
    return F.concat(base_symbol(normalize_symbol(c)), F.lit(suffix))


def on_exchange(c, allowed) -> Column:
    """The ticker's suffix is one of ``allowed``; all pass if that is empty."""
    return exchange_of(c).isin([a.strip().upper() for a in allowed]) if allowed else F.lit(True)


def is_non_equity(symbol, name, words=NON_EQUITY_WORDS, marks=NON_EQUITY_MARKS) -> Column:
    """A warrant, right or unit: by a word that begins so in ticker and name, or by marks in the ticker."""
    ticker = normalize_symbol(symbol)
    text = F.lower(F.concat_ws(" ", ticker, F.coalesce(col(name), F.lit(""))))
    tests = [F.contains(text, F.lit(w)) for w in words] + [F.contains(ticker, F.lit(m)) for m in marks]
    return reduce(Column.__or__, tests)


def aliases(stem) -> Column:
    """The names that a bar file answers to: its stem, its base and base.US."""
    return F.array_distinct(F.array(col(stem), base_symbol(stem), F.concat(base_symbol(stem), F.lit(".US"))))


def file_safe(c) -> Column:
    """Slashes and blanks as underscores."""
    return F.translate(col(c), "/\\ ", "___")


def penalty_tag(value: float) -> str:
    """A number as part of a file name: 1e-06 becomes 1em06, 0.01 becomes 0p01."""
    return f"{value:g}".replace("-", "m").replace(".", "p")
