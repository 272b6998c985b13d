"""Per-document features: one scan, one projection, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import LINE_BREAK, col, contains_any, count_of, drop_whitespace, lines
from corpusloom.functions.tokens import token_count

# Marker texts looked for in the first lines of a file, and the
# keywords a Lua file is expected to contain.
GENERATED_MARKERS = ["auto-generated", "autogenerated", "automatically generated"]
TEST_MARKERS = ["unit tests", "test file", "configuration file"]
LUA_KEYWORDS = ["function ", "if ", "else ", "end"]
HEAD_LINES = 5
TEST_SHARE = 0.05
MIN_ASSIGNMENTS = 4


def content_hash(c: str | Column) -> Column:
    """md5 of the text without any white space."""
    return F.md5(drop_whitespace(c))


def line_mean(line_array: Column) -> Column:
    """Mean line length: all lines joined, over their number."""
    return F.try_divide(F.length(F.array_join(line_array, "")).cast("double"), F.size(line_array))


def line_max(line_array: Column) -> Column:
    return F.array_max(F.transform(line_array, F.length))


def alpha_frac(c: str | Column) -> Column:
    """Share of characters that are letters or digits."""
    c = col(c)
    kept = F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""))
    return F.try_divide(kept.cast("double"), F.length(c))


def char_token_ratio(c: str | Column, n_tokens: Column | None = None) -> Column:
    """Characters per token; ``n_tokens`` comes from any tokenizer, by default the built-in one."""
    n = token_count(c) if n_tokens is None else n_tokens
    return F.try_divide(F.length(col(c)).cast("double"), n)


def head_text(c: str | Column, n: int = HEAD_LINES) -> Column:
    """The first ``n`` lines in lower case, as one string."""
    return F.lower(F.array_join(F.slice(F.split(col(c), LINE_BREAK, n + 1), 1, n), "\n"))


def is_autogenerated(c: str | Column, scan_width: int = HEAD_LINES, markers: list[str] = GENERATED_MARKERS) -> Column:
    return contains_any(head_text(c, scan_width), markers)


def is_config_or_test(
    c: str | Column,
    scan_width: int = HEAD_LINES,
    coeff: float = TEST_SHARE,
    markers: list[str] = TEST_MARKERS,
    words: tuple[str, ...] = ("config", "test"),
) -> Column:
    """A marker in the head, or more hits of a word than ``coeff`` of the line breaks."""
    c = col(c)
    limit = F.floor(count_of(c, "\n") * F.lit(coeff))
    low = F.lower(c)
    flag = contains_any(head_text(c, scan_width), markers)
    for word in words:
        flag = flag | (count_of(low, word) > limit)
    return flag


def has_no_keywords(c: str | Column, keywords: list[str] = LUA_KEYWORDS) -> Column:
    return ~contains_any(F.lower(col(c)), keywords)


def has_few_assignments(c: str | Column, minimum: int = MIN_ASSIGNMENTS) -> Column:
    return count_of(c, "=") <= minimum


def with_features(df: DataFrame, content: str = "content", keywords: list[str] = LUA_KEYWORDS) -> DataFrame:
    """All features in one pass.

    Lines are split and the text lower-cased once; both helper columns are dropped again.
    """
    c = F.col(content)
    staged = df.withColumns({"_lines": lines(c), "_low": F.lower(c)})
    staged = staged.withColumns(
        {
            "_head": F.lower(F.array_join(F.slice("_lines", 1, HEAD_LINES), "\n")),
            "_limit": F.floor(count_of(c, "\n") * F.lit(TEST_SHARE)),
        }
    )
    config_or_test = contains_any(F.col("_head"), TEST_MARKERS)
    for word in ("config", "test"):
        config_or_test = config_or_test | (count_of("_low", word) > F.col("_limit"))
    return staged.withColumns(
        {
            "hash": content_hash(c),
            "line_mean": line_mean(F.col("_lines")),
            "line_max": line_max(F.col("_lines")),
            "alpha_frac": alpha_frac(c),
            "ratio": char_token_ratio(c),
            "autogenerated": contains_any(F.col("_head"), GENERATED_MARKERS),
            "config_or_test": config_or_test,
            "has_no_keywords": ~contains_any(F.col("_low"), keywords),
            "has_few_assignments": has_few_assignments(c),
        }
    ).drop("_lines", "_low", "_head", "_limit")


def add_completion(df: DataFrame, response: str = "response") -> DataFrame:
    return df.withColumn("completion", F.col(response))
