"""Text cleaning and tokens as Column functions.

Order of the steps: NFKC, strip, URLs, e-mail addresses, symbols, lower case, tokens, number rule."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The patterns that the corpus format prescribes.
STRIP_RE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
URL_RE = r"(?iU)https?://\S+|www\.\S+"
EMAIL_RE = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
SYMBOL_RE = r"[\x{1F300}-\x{1FAFF}\x{2700}-\x{27BF}\x{2600}-\x{26FF}\x{2190}-\x{2BFF}]"
TOKEN_RE = r"[\x{4e00}-\x{9fff}]+|[A-Za-z]+|\p{Nd}+"
LONG_NUMBER_RE = r"^\p{Nd}{5,}$"
NUM = "<NUM>"


@F.pandas_udf(StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """NFKC, which Spark has no function for; ASCII texts pass through."""
    return values.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x), na_action="ignore")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, STRIP_RE, "")


def drop_urls(text: Column) -> Column:
    return F.regexp_replace(text, URL_RE, " ")


def drop_emails(text: Column) -> Column:
    return F.regexp_replace(text, EMAIL_RE, " ")


def drop_symbols(text: Column) -> Column:
    return F.regexp_replace(text, SYMBOL_RE, "")


def normalised(text: Column) -> Column:
    """NFKC; texts of ASCII alone don't travel to Python."""
    return F.coalesce(nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def clean(text: Column, normalise: bool = True) -> Column:
    return F.lower(drop_symbols(drop_emails(drop_urls(strip(normalised(text) if normalise else text)))))


def number_rule(tokens: Column) -> Column:
    """Numbers of five digits or more become one word."""
    return F.transform(tokens, lambda w: F.when(w.rlike(LONG_NUMBER_RE), NUM).otherwise(w))


def split_tokens(cleaned: Column) -> Column:
    """Maximal runs of CJK ideographs, ASCII letters or digits."""
    return F.regexp_extract_all(cleaned, F.lit(TOKEN_RE), F.lit(0))


def tokens(text: Column, normalise: bool = True, tokenizer: Callable[[Column], Column] | None = None) -> Column:
    """array<string>; empty for null or blank texts. tokenizer: Column function from a cleaned text to its words, such as
    a word segmenter in a Pandas UDF; of its words those of the kinds that count stay (`kept_kinds`)."""
    words = split_tokens if tokenizer is None else lambda c: kept_kinds(tokenizer(c))
    return F.coalesce(number_rule(words(clean(text, normalise))), F.array().cast("array<string>"))


def kept_kinds(words: Column) -> Column:
    """Of an external tokenizer's words those that hold an ideograph or are all letters or all digits."""
    return F.filter(words, lambda w: w.rlike(r"[\x{4e00}-\x{9fff}]") | w.rlike(r"^\p{L}+$") | w.rlike(r"^\p{Nd}+$"))
