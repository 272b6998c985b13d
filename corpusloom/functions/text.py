"""Text expressions shared by the operators. All are Columns, none runs Python per row."""

from __future__ import annotations

import unicodedata
from functools import cache, reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python treats as white space (str.strip, \s) and the
# line boundaries of str.splitlines, written as Java regular expressions.
WS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
WS_CHARS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
LINE_BREAK = r"\r\n|[\n\x0b\f\r\x1c-\x1e\x85\u2028\u2029]"
WORD = r"[\p{L}\p{N}_]"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lines(c: str | Column) -> Column:
    """Lines as ``str.splitlines`` gives them: no empty element after a final break."""
    parts = F.split(col(c), LINE_BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def strip(c: str | Column) -> Column:
    return F.regexp_replace(col(c), rf"^{WS}+|{WS}+\z", "")


def drop_whitespace(c: str | Column) -> Column:
    return F.translate(col(c), WS_CHARS, "")


@cache
def _accent_table() -> tuple[str, str]:
    """Letters that are a base letter with marks, their base letters, and then the marks themselves."""
    letters, bases, marks = [], [], []
    for code in range(0x80, 0x10000):
        ch = chr(code)
        parts = unicodedata.normalize("NFD", ch) if not 0xAC00 <= code < 0xE000 else ch
        if len(parts) > 1 and all(unicodedata.combining(p) for p in parts[1:]):
            letters.append(ch)
            bases.append(parts[0])
        elif unicodedata.combining(ch):
            marks.append(ch)
    return "".join(letters + marks), "".join(bases)


def fold_key(c: str | Column) -> Column:
    """Form in which keys compare equal: case, accents and trailing blanks do not count.

    An ordinary string, so that grouping and joining on it stay hash-based.
    """
    plain = F.lower(F.regexp_replace(col(c), " +$", ""))
    return F.replace(F.translate(plain, *_accent_table()), F.lit("ß"), F.lit("ss"))


def count_of(c: str | Column, needle: str) -> Column:
    """Non-overlapping occurrences of ``needle``."""
    c = col(c)
    return ((F.length(c) - F.length(F.replace(c, F.lit(needle), F.lit("")))) / len(needle)).cast("bigint")


def contains_any(c: str | Column, needles: list[str]) -> Column:
    c = col(c)
    return reduce(or_, [c.contains(n) for n in needles], F.lit(False))


def quoted(text: str) -> str:
    """``text`` as a Java regular expression matching itself."""
    return "".join("\\" + ch if ch in r"\.[]{}()*+-?^$|#&~" else ch for ch in text)


def unit_hash(seed: int, key: str | Column, salt: str) -> Column:
    """Uniform draw in [0, 1) that depends on (seed, salt, key) only.

    The same row gets the same draw whatever the partitioning, retry or engine.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:{salt}:"), col(key).cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
