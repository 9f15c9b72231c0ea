"""Query and document analysis as column expressions.

Everything stays inside generated code; the only Python hook is for custom tokenizers.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{Nd}]+"
_WIDE = "\u3000" + "".join(map(chr, range(0xFF01, 0xFF5F)))
_HALF = " " + "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
#: Punctuation that is always dropped from queries.
PUNCTUATION = "".join(c for c in map(chr, [*range(0x21, 0x7F), *range(0xA1, 0xC0), *range(0x2010, 0x2060), *range(0x3001, 0x3040), *range(0xFE30, 0xFE70)]) if unicodedata.category(c)[0] in "PS")
#: The strict list drops digits, spaces and the letter e as well.
STRICT = PUNCTUATION + "0123456789 e的了"


def unescape_newlines(q: Column) -> Column:
    """Drops newlines, and the two characters backslash and n."""
    return F.regexp_replace(q, r"\\n|\n", "")


def trim_spaces(q: Column) -> Column:
    return F.trim(q)


def half_width(q: Column) -> Column:
    """Full-width forms as their ordinary characters."""
    return F.translate(q, _WIDE, _HALF)


def lower(q: Column) -> Column:
    """Lower case character by character: no final sigma, no dot above."""
    return F.lower(F.translate(q, "Σİ", "σi"))


@lru_cache(1)
def _simplified() -> tuple[str, str]:
    """Traditional characters and their simplified forms, from the CLDR transform in Spark's ICU."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("simplification needs an active session")
    han = "".join(map(chr, [*range(0x3400, 0x4DC0), *range(0x4E00, 0xA000)]))
    to = spark._jvm.com.ibm.icu.text.Transliterator.getInstance("Traditional-Simplified").transliterate(han)
    pairs = [(a, b) for a, b in zip(han, to, strict=True) if a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def simplify(q: Column) -> Column:
    """Traditional Chinese characters as simplified ones, one for one."""
    return F.translate(q, *_simplified())


def drop_stopwords(q: Column, stopwords: str = PUNCTUATION) -> Column:
    """Without the characters of ``stopwords``."""
    return F.translate(q, stopwords, "") if stopwords else q


def keep_query_characters(q: Column) -> Column:
    """Only Han characters, decimal digits, lower-case letters and spaces."""
    return F.regexp_replace(q, r"[^\p{IsHan}\p{Nd}\p{Ll} ]", "")


def normalize(q: Column, stopwords: str = PUNCTUATION, chinese: bool = True) -> Column:
    """The whole chain, in order. Null stays null."""
    q = lower(half_width(trim_spaces(unescape_newlines(q))))
    q = simplify(q) if chinese else q
    return keep_query_characters(drop_stopwords(q, stopwords))


def tokenize(text: Column) -> Column:
    """Runs of letters and digits of the lower-cased text; null text has no tokens."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


@lru_cache(1)
def word_edges(spark: SparkSession) -> tuple[int, ...]:
    """The code points where characters of ``WORD``, as the JVM has them, begin and end by turns."""
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    other = spark._jvm.java.util.regex.Pattern.compile(WORD.replace("[", "[^", 1))
    found = list(map(ord, other.matcher(points).replaceAll("")))
    return tuple(sorted(set(found) ^ {c + 1 for c in found}))


def tokenize_han(text: Column, grams: int = 2) -> Column:
    """Like :func:`tokenize`, but a run of Han characters gives its ``grams``-character windows (itself if shorter)."""
    runs = F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"\p{IsHan}+|[\p{L}\p{Nd}&&[^\p{IsHan}]]+"), F.lit(0)), F.array().cast("array<string>"))

    def windows(run: Column) -> Column:
        last = F.greatest(F.length(run) - grams + 1, F.lit(1))
        return F.when(run.rlike(r"^\p{IsHan}"), F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(run, i, F.lit(grams)))).otherwise(F.array(run))

    return F.flatten(F.transform(runs, windows))


def tokenizer(cut: Callable[[str], list[str]]) -> Callable[[Column], Column]:
    """A Python tokenizer as a column function, in Arrow batches."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else cut(t))

    return run
