"""The collected-files table: last content per (filename, user), and when it last changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.keyed import HOT_ROWS, first_per_key, folded, hot_keys, salted_join, top_per_group
from corpusloom.session import materialize

KEYS = ["filename", "user"]


def reduce_events(
    df: DataFrame,
    keys: list[str],
    content: str,
    ts: str,
    order: list[str],
    fold: bool = True,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """One row per key: content, date_modified (start of the last unbroken run of that content),
    and ``unchanged``, true when there was no other content.

    Contents are reduced to (key, digest, last position) before anything else, so a key that
    gets a third of all events weighs no more than its distinct contents; in the look-up of
    the winning run such keys are salted, and only times travel. Keys keep the spelling of
    their first event.
    """
    rows, names, spelled = folded(df, keys, fold)
    events = rows.select(
        *names,
        spelled.alias("_spelled"),
        F.md5(content).alias("_digest"),
        F.struct(*order).alias("_at"),
        F.col(ts).alias("_ts"),
        F.col(content).alias("content"),
    )
    runs = events.groupBy(*names, "_digest").agg(
        F.max("_at").alias("_last"),
        F.min(F.struct("_at", "_spelled")).alias("_born"),
        F.count(F.lit(1)).alias("n"),
        F.first("content").alias("content"),
    )
    # Used four times below; written once instead of reading the events four times.
    runs = materialize(runs, "runs")
    born = runs.groupBy(*names).agg(F.min("_born")["_spelled"].alias("_spelled"))
    two = top_per_group(runs, names, [F.col("_last").desc()], 2)
    newest = F.col("rank") == 1
    winners = two.groupBy(*names).agg(
        F.max(F.when(newest, F.col("_digest"))).alias("_digest"),
        F.max(F.when(newest, F.col("content"))).alias("content"),
        F.max(F.when(~newest, F.col("_last"))).alias("_other"),
    )
    found = [*names, "_digest"]
    times = events.select(*found, "_at", "_ts")
    joined = salted_join(times, winners.drop("content"), found, "inner", spread=["_at"], hot=hot_keys(runs, found, at_least=hot_rows))
    run = joined.where(F.col("_other").isNull() | (F.col("_at") > F.col("_other")))
    first = run.groupBy(*names).agg(
        F.min_by("_ts", "_at").alias("date_modified"), F.max(F.col("_other").isNull()).alias("unchanged")
    )
    texts = winners.select(*names, "content")
    return first.join(born, names).join(texts, names).select("_spelled.*", "content", "date_modified", "unchanged")


def upsert_batch(
    events: DataFrame,
    keys: list[str] = KEYS,
    content: str = "content",
    ts: str = "ts",
    order: list[str] | None = None,
    fold: bool = True,
) -> DataFrame:
    """(keys, content, date_modified): the table after all events, in order.

    ``date_modified`` moves only when the content changes.
    """
    return reduce_events(events, keys, content, ts, order or [ts], fold).drop("unchanged")


def collect_first_batch(
    events: DataFrame,
    keys: list[str] = KEYS,
    content: str = "content",
    ts: str = "ts",
    order: list[str] | None = None,
    fold: bool = True,
) -> DataFrame:
    """(keys, content, date_modified): the first content per key stays."""
    rows, names, _ = folded(events, keys, fold)
    first = first_per_key(rows, names, order or [ts])
    return first.select(*keys, F.col(content).alias("content"), F.col(ts).alias("date_modified"))


def merge_reduced(parts: DataFrame, keys: list[str], fold: bool = True) -> DataFrame:
    """Combine reduced rows of successive batches (``batch`` gives their order).

    A key has one row per batch here. Its modification time is that of the last row that is not a
    plain repetition of the content before it.
    """
    rows, names, spelled = folded(parts, keys, fold)
    before = F.lag("content").over(Window.partitionBy(*names).orderBy("batch"))
    repeats = F.col("unchanged") & before.isNotNull() & (before == F.col("content"))
    marked = rows.withColumn("_moved", ~F.coalesce(repeats, F.lit(False)))
    merged = marked.groupBy(*names).agg(
        F.min_by(spelled, "batch").alias("_spelled"),
        F.max_by("content", "batch").alias("content"),
        F.max_by("date_modified", F.when(F.col("_moved"), F.col("batch"))).alias("date_modified"),
        F.max("batch").alias("batch"),
        ((F.count_if("_moved") == 1) & F.min_by("unchanged", "batch")).alias("unchanged"),
    )
    return merged.select("_spelled.*", "content", "date_modified", "unchanged", "batch")


def merge_firsts(parts: DataFrame, keys: list[str], fold: bool = True) -> DataFrame:
    """The first of the first rows of successive batches (``batch`` gives their order)."""
    rows, names, _ = folded(parts, keys, fold)
    return first_per_key(rows, names, ["batch"]).drop(*names)


def read_table(df: DataFrame, sql: str, params: list | dict | None = None, name: str = "files") -> DataFrame:
    """Parametrised SQL over the table; ``?`` or ``:name`` markers are bound, never pasted in."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.sql(sql, args=params)
