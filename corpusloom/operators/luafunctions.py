"""Functions in Lua sources: a partition-wise job over the files table."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Lua's comment forms, block words, function heads and event registration calls.
COMMENTS = (r"--.*$", r"--\[\[[\s\S]*?\]\]")
BLOCK_WORDS = r"\b(function|if|for|while|end)\b"
FUNCTION_WORD = r"\b(?:local\s+)?function\b"
FUNCTION_NAME = r"\b(?:local\s+)?function\s+([\w_:.]+)\s*?\("
#: Characters of found functions that a task holds before it hands them on.
HELD_CHARS = 4 << 20
REGISTER_CALL = (
    r"((GameEvent|g_mir.ssr)\.(add|register_ssr|remove|removeByNameAndTag|removeByTag|removeAll|push|register|"
    r"execute|addEvent)\(.+\))"
)


class _Spans:
    """Closed intervals, overlapping ones joined, for point lookups."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end in sorted(spans):
            if self.ends and start <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def __contains__(self, at: int) -> bool:
        i = bisect_right(self.starts, at) - 1
        return i >= 0 and at <= self.ends[i]

    def first_before(self, at: int) -> int | None:
        """Start of the interval that covers ``at``, if any."""
        return self.starts[bisect_right(self.starts, at) - 1] if at in self else None


def comment_spans(code: str) -> list[tuple[int, int]]:
    """(start, end) of line comments, then of block comments; the end position counts as inside."""
    line, block = COMMENTS
    return [m.span() for m in re.finditer(line, code, re.MULTILINE)] + [m.span() for m in re.finditer(block, code)]


def lua_functions(code: str, require_register: bool = True, register_call: str = REGISTER_CALL) -> Iterator[tuple[str, str, str, str | None]]:
    """(name, body, comment, register) of the functions of one file."""
    comments = _Spans(comment_spans(code))
    # One walk pairs every opening word with its end.
    closing: dict[int, int] = {}
    open_words: list[int] = []
    for word in re.finditer(BLOCK_WORDS, code):
        if word.start() in comments:
            continue
        if word.group() != "end":
            open_words.append(word.start())
        elif open_words:
            closing[open_words.pop()] = word.end()
    for head in re.finditer(FUNCTION_WORD, code):
        start = head.start()
        stop = closing.get(head.end() - len("function"))
        if start in comments or stop is None:
            continue
        above = start
        while above > 0:
            covering = comments.first_before(above - 1)
            if covering is not None:
                above = covering
            elif code[above - 1] == "\n":
                above -= 1
            else:
                break
        body = code[start:stop]
        name = re.search(FUNCTION_NAME, body)
        if name is None:
            continue
        register = None
        following = re.match(r"[^\n\r]*[\n\r]([^\n\r]*)", code[stop:])
        if following and re.match(register_call, following.group(1).strip()):
            register = following.group(1).strip()
        if register or not require_register:
            yield name.group(1), body, code[above:start], register


def _scanned(batches: Iterator[pa.RecordBatch], require_register: bool, register_call: str, held_chars: int) -> Iterator[pa.RecordBatch]:
    """Functions of texts (key, content): one text at a time is taken out of a batch, and what was found goes on in bounded batches."""
    for batch in batches:
        keys, texts = batch.columns
        places: list[int] = []
        found: list[tuple] = []

        def handed() -> pa.RecordBatch:
            columns = zip(*found) if found else [()] * 5
            arrays = [pa.array(c, t) for c, t in zip(columns, [pa.int32(), *[pa.string()] * 4])]
            return pa.RecordBatch.from_arrays([keys.take(pa.array(places, pa.int64())), *arrays], names=["key", "ord", "name", "body", "comment", "register"])

        held = 0
        for place, text in enumerate(texts):
            for i, function in enumerate(lua_functions(text.as_py(), require_register, register_call)):
                places.append(place)
                found.append((i, *function))
                held += sum(len(x) for x in function if x)
                if held >= held_chars:
                    yield handed()
                    places, found, held = [], [], 0
        yield handed()


def extract_functions(
    df: DataFrame, key: str = "path", content: str = "content", require_register: bool = True, register_call: str = REGISTER_CALL
) -> DataFrame:
    """(path, ord, name, body, comment, register): one row per function; ``register_call`` matches a registration line.

    Nesting of block words is not regular, so each text is scanned in Python, one Arrow batch at a
    time; files without the word are dropped before they leave the JVM.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _scanned(batches, require_register, register_call, HELD_CHARS)

    files = df.select(F.col(key).alias("key"), F.col(content).alias("content")).where(F.col("content").contains("function"))
    kind = dict(df.dtypes)[key]
    out = files.mapInArrow(scan, f"key {kind}, ord int, name string, body string, comment string, register string")
    return out.withColumnRenamed("key", key)


def find_comment_spans(df: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(path, start, end) of all comments, of either form.

    The places follow from the lengths of the matches and of the texts between them.
    """
    def spans(pattern: str) -> Column:
        matches, gaps = F.regexp_extract_all(content, F.lit(pattern), F.lit(0)), F.split(content, pattern, -1)
        sizes = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), F.transform(matches, F.length).alias("match"))
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

        def add(done: Column, size: Column) -> Column:
            start = done["at"] + size["gap"]
            end = start + size["match"]
            return F.struct(end.alias("at"), F.array_append(done["spans"], F.struct(start.alias("start"), end.alias("end"))).alias("spans"))

        # The gap after the last match has no partner.
        return F.aggregate(F.slice(sizes, 1, F.size(sizes) - 1), begin, add, lambda done: done["spans"])

    line, block = COMMENTS
    # As in the scan of functions, a line ends at a line feed only.
    found = F.concat(spans(f"(?md){line}"), spans(block))
    files = df.where(F.col(content).contains("--"))
    return files.select(key, F.explode(found).alias("span")).select(key, "span.start", "span.end")


def find_all_samples(df: DataFrame, key: str = "path", content: str = "content", register_call: str = REGISTER_CALL) -> DataFrame:
    """(path, functions): files with at least one registered function."""
    found = extract_functions(df, key, content, register_call=register_call)
    entry = F.struct("ord", "name", "body", "comment", "register")
    return found.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("functions"))
