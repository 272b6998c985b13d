"""Token expressions. A tokenizer is any ``Column -> Column(array<int>)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import col

Tokenizer = Callable[[Column], Column]

# Words and single other visible characters.
TOKEN_PATTERN = r"[A-Za-z_0-9]+|[^A-Za-z_0-9 \t\n\x0b\f\r]"
# Words compared by near-duplicate detection.
DEDUP_PATTERN = r"[A-Za-z_0-9]+"


def token_texts(c: str | Column) -> Column:
    return F.regexp_extract_all(col(c), F.lit(TOKEN_PATTERN), F.lit(0))


def token_count(c: str | Column) -> Column:
    """``size(token_texts(c))`` without building the array: words shrink to a letter, spaces go."""
    return F.length(F.translate(F.regexp_replace(col(c), "[A-Za-z_0-9]++", "x"), " \t\n\x0b\f\r", ""))


def token_id(t: Column) -> Column:
    """28-bit id of a token text; needs no vocabulary table."""
    return F.conv(F.substring(F.md5(t), 1, 7), 16, 10).cast("int")


def default_tokenizer(c: str | Column) -> Column:
    return F.transform(token_texts(c), token_id)


def dedup_words(c: str | Column) -> Column:
    """All words in order, with repeats."""
    return F.regexp_extract_all(col(c), F.lit(DEDUP_PATTERN), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    """|A ∩ B| / |A ∪ B| of two arrays of distinct values; NULL when both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.try_divide(both, F.size(a) + F.size(b) - both)
