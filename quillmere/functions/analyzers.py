"""Analyzers: Column builders that turn text into an array of tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is stripped from both ends of a token, and the query stop words of the search DSL.
STRIPPED = ".,!?;:'\"()"
STRIPPED_OPEN = ".,!?;:'\""
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with")
#: White space as Python's str.split has it; Java's \\s alone misses most of it.
SPACE = r"(?U)[\s\x1c-\x1f]+"
WORD = r"[\p{L}\p{N}]+(?:['\-][\p{L}\p{N}]+)*"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def plain(text: Column | str, strip_bom: bool = False, stripped: str = STRIPPED) -> Column:
    """Lower-case, cut at white space, strip punctuation from both ends, drop empty tokens. Null text: no tokens."""
    low = F.lower(F.coalesce(_col(text), F.lit("")))
    if strip_bom:
        low = F.regexp_replace(low, "^﻿", "")
    return F.filter(F.transform(F.split(low, SPACE), lambda t: F.btrim(t, F.lit(stripped))), lambda t: t != "")


def keep_parentheses(text: Column | str) -> Column:
    return plain(text, stripped=STRIPPED_OPEN)


def standard(text: Column | str) -> Column:
    """Runs of letters and digits, joined by single apostrophes or hyphens; lower-cased after matching."""
    return F.transform(F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(WORD), F.lit(0)), lambda t: F.lower(t))


def keyword(text: Column | str) -> Column:
    """The whole string, as it is."""
    return F.when(_col(text).isNull(), F.array().cast("array<string>")).otherwise(F.array(_col(text)))


ANALYZERS: dict[str, Callable[[Column | str], Column]] = {"plain": plain, "keep_parentheses": keep_parentheses, "standard": standard, "keyword": keyword, "whitespace": keyword}


def register(name: str, builder: Callable[[Column | str], Column]) -> None:
    """Add an analyzer; it may be built-in functions or a pandas UDF."""
    ANALYZERS[name] = builder


def without_stop_words(tokens: Column, words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Tokens without stop words, repeats kept."""
    return F.filter(tokens, lambda t: ~t.isin(*words))


def tokens_of(text: str, stripped: str = STRIPPED) -> list[str]:
    """plain() of a query string, on the driver."""
    return [t for t in (w.strip(stripped) for w in text.lower().split()) if t]
