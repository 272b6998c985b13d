"""Operators behind editor completions: prompt windows, clean-up and overlap spans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import col, quoted, strip
from corpusloom.operators.winnow import shared_grams
from corpusloom.session import materialize

# The window on either side of the cursor, template marks, and the
# characters a completion may stand in front of.
CHAR_LIMIT = 4000
ATTRIBUTION_WINDOW = 250
PREFIX, SUFFIX = "[prefix]", "[suffix]"
CLOSING = ['"', "'", "`", "]", ")", "}", ">"]


@dataclass(frozen=True)
class CompletionTemplate:
    """Prompt templates and stop texts of a model family; the presets are fixed values."""

    prefix_only: str = PREFIX
    fill: str = f"<fim_prefix>{PREFIX}<fim_suffix>{SUFFIX}<fim_middle>"
    stop_tokens: tuple[str, ...] = ("<|endoftext|>",)
    tokens_to_clear: tuple[str, ...] = ("<fim_middle>",)


ANGLE_TEMPLATE = CompletionTemplate()
SPACED_TEMPLATE = CompletionTemplate(
    fill=f"<PRE> {PREFIX} <SUF>{SUFFIX} <MID>", stop_tokens=("<|endoftext|>", "<EOT>"), tokens_to_clear=("<MID>",)
)


def cursor_window(text: str | Column, offset: str | Column, limit: int = CHAR_LIMIT) -> tuple[Column, Column]:
    """Up to ``limit`` characters before and after a 0-based offset."""
    text, offset = col(text), col(offset)
    start = F.greatest(offset - limit, F.lit(0))
    return F.substring(text, start + 1, offset - start), F.substring(text, offset + 1, F.lit(limit))


def attribution_window(text: str | Column, offset: str | Column, size: int = ATTRIBUTION_WINDOW) -> Column:
    """The text around the cursor that is looked up in a corpus."""
    before, after = cursor_window(text, offset, size)
    return F.concat(before, after)


def _fill(template: str, prefix: Column, suffix: Column) -> Column:
    parts: list[Column] = []
    head, mark, rest = template.partition(PREFIX)
    parts += [F.lit(head), prefix] if mark else [F.lit(head)]
    body, mark, tail = rest.partition(SUFFIX)
    parts += [F.lit(body), suffix, F.lit(tail)] if mark else [F.lit(body)]
    return F.concat(*parts)


def fim_prompt_window(
    text: str | Column, offset: str | Column, t: CompletionTemplate = ANGLE_TEMPLATE, fill_mode: bool = True, limit: int = CHAR_LIMIT
) -> Column:
    """Completion prompt at a cursor: the fill form when something visible follows it."""
    prefix, suffix = cursor_window(text, offset, limit)
    plain = _fill(t.prefix_only, prefix, suffix)
    if not fill_mode:
        return plain
    return F.when(strip(suffix) != "", _fill(t.fill, prefix, suffix)).otherwise(plain)


def clean_completion(
    generated: str | Column, inputs: str | Column, t: CompletionTemplate = ANGLE_TEMPLATE
) -> Column:
    """Generated text without the echoed prompt, stop texts and tokens to clear."""
    generated, inputs = col(generated), col(inputs)
    rest = F.substring(generated, F.length(inputs) + 1, F.length(generated))
    answer = F.when(generated.startswith(inputs), rest).otherwise(generated)
    marks = "|".join(quoted(m) for m in (*t.stop_tokens, *t.tokens_to_clear))
    return F.regexp_replace(answer, marks, "") if marks else answer


def clean_server_text(generated: str | Column) -> Column:
    """Trimmed, without carriage returns."""
    return F.replace(strip(generated), F.lit("\r"), F.lit(""))


def parse_generation_json(reply: str | Column) -> Column:
    """``generated_text`` of the object or of the first element, else an empty text."""
    reply = col(reply)
    return F.coalesce(
        F.get_json_object(reply, "$.generated_text"), F.get_json_object(reply, "$[0].generated_text"), F.lit("")
    )


def trim_known_context(
    df: DataFrame, text: str = "text", offset: str = "offset", suggestion: str = "suggestion", prefix: str = "prefix"
) -> DataFrame:
    """Adds ``hint``: the suggestion without what is already typed or already follows the cursor.

    Rows whose suggestion lacks the typed prefix, or whose cursor is inside a word, are left out.
    """
    after = F.substring(F.col(text), F.col(offset) + 1, F.lit(1))
    free = after.isin(CLOSING) | (strip(after) == "")
    kept = df.where(F.col(suggestion).contains(F.col(prefix)) & free)
    at = F.expr(f"locate(`{prefix}`, `{suggestion}`)")
    rest = F.concat(
        F.substring(F.col(suggestion), F.lit(1), at - 1),
        F.substring(F.col(suggestion), at + F.length(prefix), F.length(suggestion)),
    )
    staged = kept.withColumn("_rest", rest)
    # What follows the cursor on its line, as long as the suggestion.
    tail = F.substring(F.col(text), F.col(offset) + 1, F.length("_rest"))
    staged = staged.withColumn("_tail", F.regexp_replace(tail, r"(?s)[\r\n].*$", ""))
    cut = F.substring(F.col("_rest"), F.lit(1), F.length("_rest") - F.length("_tail"))
    return staged.withColumn("hint", F.when(F.col("_rest").endswith(F.col("_tail")), cut).otherwise(F.col("_rest"))).drop(
        "_rest", "_tail"
    )


def _merge(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    ordered = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)
    flagged = df.withColumn("_begins", begins)
    island = F.sum("_begins").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    return (
        flagged.withColumn("_island", island)
        .groupBy(*keys, "_island")
        .agg(F.min(start).alias(start), F.max(end).alias(end))
        .drop("_island")
    )


#: Spans of a task: the number of tasks follows the spans, so that a task's memory does not.
TASK_SPANS = 1 << 19
#: Tasks that the equal starts of one key are dealt to at first.
SALTS = 32


def merge_spans(
    df: DataFrame, keys: list[str], start: str = "start", end: str = "end", stride: int = 100_000, task_spans: int = TASK_SPANS
) -> DataFrame:
    """Spans of a key that touch or overlap become one.

    Spans with the same start are reduced to the longest, in ``SALTS`` places first, and merged inside
    stretches of ``stride`` positions: no task gets more than ``stride`` spans of a
    key at a time. Between stretches only their reaches meet, and a span that runs on is put
    together by an aggregate. ``df`` is counted first, for tasks of about ``task_spans``.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    tasks = max(slots, -(-df.count() // task_spans))
    # As a struct, null keys are equal to each other in joins too, and meet where the aggregates have put them.
    spans = df.select(F.struct(*keys).alias("_key"), start, end, F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("_salt"))
    longest = spans.repartition(tasks, "_key", start, "_salt").groupBy("_key", start, "_salt").agg(F.max(end).alias(end))
    parted = longest.withColumn("_part", F.floor(F.col(start) / stride)).repartition(tasks, "_key", "_part")
    place = ["_key", "_part"]
    rows = _merge(parted.groupBy(*place, start).agg(F.max(end).alias(end)), place, start, end)
    # Merged rows of a stretch lie apart, so all but those that begin within the reach of earlier stretches stand; a row per
    # stretch tells the later ones its reach, and the beginning of the row that the last one of it is part of.
    ahead = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(*place).agg(F.max(start).alias("_last"), F.max(end).alias("_top")).repartition(tasks, "_key")
    carried = ends.withColumn("_reach", F.max("_top").over(ahead))
    opened = F.when(F.col("_reach").isNull() | (F.col("_last") > F.col("_reach")), F.col("_last"))
    carried = carried.withColumn("_before", F.max(opened).over(ahead)).where("_reach IS NOT NULL").select(*place, "_reach", "_before")
    joined = rows.join(carried, place, "left").select(*place, start, end, "_reach", "_before")
    joined = joined.withColumn(start, F.when(F.col(start) <= F.col("_reach"), F.col("_before")).otherwise(F.col(start)))
    # A stretch's rows of one span become one before they meet those of other stretches.
    once = joined.groupBy(*place, start).agg(F.max(end).alias(end)).repartition(tasks, "_key", start)
    return once.groupBy("_key", start).agg(F.max(end).alias(end)).select("_key.*", start, end)


def merge_span_array(spans: str | Column) -> Column:
    """The same on an array of (start, end) structs of one row."""
    kind = "array<struct<start:int,end:int>>"

    def add(done: Column, span: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))
        grown = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))
        joins = (F.size(done) > 0) & (span["start"] <= F.get(done, F.size(done) - 1)["end"])
        return F.when(joins, grown).otherwise(F.concat(done, F.array(span))).cast(kind)

    return F.aggregate(F.array_sort(col(spans)).cast(kind), F.array().cast(kind), add)


def contamination_overlap(
    df: DataFrame,
    reference: DataFrame,
    n: int = 8,
    key: str = "id",
    content: str = "content",
    reference_content: str = "content",
) -> DataFrame:
    """(id, start, end): 0-based character spans of texts whose word n-grams occur in ``reference``.

    The places come from winnowed fingerprints; only matched ones are kept, as word numbers, and
    turned into character offsets after merging.
    """
    found = shared_grams(df, reference, n, key, content, reference_content)
    # Written once, since merging counts them first.
    hits = materialize(found.withColumn("end", F.col("start") + n), "overlap-hits")
    merged = merge_spans(hits, [key])
    words = F.split(F.col(content), " ")
    texts = df.select(key, words.alias("_words")).join(merged, key)
    before = F.slice("_words", F.lit(1), F.col("start").cast("int"))
    inside = F.slice("_words", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    begin = F.length(F.array_join(before, " ")) + F.when(F.col("start") > 0, 1).otherwise(0)
    return texts.select(key, begin.alias("start"), (begin + F.length(F.array_join(inside, " "))).alias("end"))
