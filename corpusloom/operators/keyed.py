"""First/last row per key and joins that stay balanced when one key is hot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import fold_key


def first_per_key(df: DataFrame, keys: list[str | Column], order: list[str | Column]) -> DataFrame:
    """First row of every key in the given order.

    Spark plans ``row_number() = 1`` with a group limit in front of the shuffle, so a map
    task sends at most one row per key and a hot key costs its reducer one row per task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def latest_per_key(df: DataFrame, keys: list[str | Column], order: list[str]) -> DataFrame:
    """Last write per key."""
    return first_per_key(df, keys, [F.col(c).desc() for c in order])


def top_per_group(df: DataFrame, keys: list[str], order: list[str | Column], k: int = 1) -> DataFrame:
    """The ``k`` first rows of every group, with their rank."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


HOT_ROWS = 100_000
HOT_KEYS = 1000


def hot_keys(counts: DataFrame, on: list[str], n: str = "n", at_least: int = HOT_ROWS, top: int = HOT_KEYS) -> DataFrame:
    """The keys with the most rows: at most ``top`` of them, so the list can be broadcast.

    ``counts`` has one row per key. Ties are cut in key order, so every evaluation agrees.
    """
    return counts.where(F.col(n) > at_least).orderBy(F.col(n).desc(), *on).limit(top).select(*on)


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str = "left",
    salts: int = 32,
    spread: list[str] | None = None,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Equi join of a possibly skewed ``left`` with a ``right`` that has few rows per key.

    Left rows get one of ``salts`` values from a hash of their ``spread`` columns and right rows are
    copied once per value, so the rows of one hot key spread over ``salts`` tasks. With
    ``hot`` (from ``hot_keys``) only those keys are salted and copied, which suits a
    right side of about the size of the left. The salt sits under the exchange, so adaptive
    execution can still split further, or broadcast a right side that turns out small.
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"salted_join keeps left rows only: {how}")
    draw = F.pmod(F.xxhash64(*(spread or left.columns)), F.lit(salts)).cast("int")
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    if hot is None:
        salted, copies = left.withColumn("_salt", draw), right.withColumn("_salt", F.explode(every))
    else:
        # At most HOT_KEYS rows.
        flags = F.broadcast(hot.withColumn("_hot", F.lit(True)))
        salted = left.join(flags, on, "left").withColumn("_salt", F.when(F.col("_hot"), draw).otherwise(0)).drop("_hot")
        copied = F.when(F.col("_hot"), every).otherwise(F.array(F.lit(0)))
        copies = right.join(flags, on, "left").withColumn("_salt", F.explode(copied)).drop("_hot")
    return salted.join(copies, on=[*on, "_salt"], how=how).drop("_salt")


def exact_dedup(df: DataFrame, key: str = "hash", order: str = "id") -> DataFrame:
    """Keep the first row per hash in ``order``, a unique column.

    The first copies are found by an aggregate over (hash, order); rows meet them by ``order``, so no text
    is sorted by its hash.
    """
    firsts = df.groupBy(key).agg(F.min(order).alias(order)).select(order)
    return df.join(firsts, order, "left_semi")


def drop_duplicate_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.dropDuplicates(columns) if columns else df.distinct()


def duplicate_fraction(df: DataFrame, key: str = "hash", approximate: bool = False) -> DataFrame:
    """1 - distinct/total. The exact count groups by key first, which combines on the map side."""
    if approximate:
        return df.agg((1 - F.approx_count_distinct(key) / F.count(F.lit(1))).alias("duplicate_fraction"))
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg((1 - F.try_divide(F.count(F.lit(1)).cast("double"), F.sum("n"))).alias("duplicate_fraction"))


def hash_universe(df: DataFrame, key: str = "hash") -> DataFrame:
    return df.select(key).distinct()


def without_ids(df: DataFrame, removed: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose id is not in ``removed``; ids are unique, so the join is even."""
    return df.join(removed.select(key), on=key, how="left_anti")


def folded(df: DataFrame, keys: list[str], fold: bool = True) -> tuple[DataFrame, list[str], Column]:
    """Adds comparison keys, in which case, accents and trailing blanks of texts do not count; gives their names and
    the keys as spelled."""
    names = [f"_key_{k}" for k in keys]
    kinds = dict(df.dtypes)
    columns = {n: fold_key(k) if fold and kinds[k] == "string" else F.col(k) for n, k in zip(names, keys)}
    return df.withColumns(columns), names, F.struct(*keys)


def insert_if_absent(table: DataFrame, incoming: DataFrame, keys: list[str], order: list[str], fold: bool = True) -> DataFrame:
    """``table`` plus the first incoming row of every key the table does not hold; keys compare folded.

    ``inserted`` tells the new rows from the old ones.
    """
    rows, names, _ = folded(incoming, keys, fold)
    held = folded(table, keys, fold)[0].select(*names).distinct()
    fresh = first_per_key(rows, names, order).join(held, on=names, how="left_anti").drop(*names)
    old = table.withColumn("inserted", F.lit(False))
    return old.unionByName(fresh.select(*table.columns).withColumn("inserted", F.lit(True)))
