"""Distinct counts as stored sketches that can be merged: a few kilobytes for any number of rows, built once per source."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 2^12 registers.
LOG_REGISTERS = 12


def standard_error(log_registers: int = LOG_REGISTERS) -> float:
    """Relative standard error of an estimate."""
    return 1.04 / math.sqrt(1 << log_registers)


def key_sketches(df: DataFrame, by: str, key: str = "hash", log_registers: int = LOG_REGISTERS) -> DataFrame:
    """(by, rows, sketch): the distinct keys of every group as a sketch, which a task fills before anything travels."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("rows"), F.hll_sketch_agg(key, F.lit(log_registers)).alias("sketch"))


def merged(sketches: DataFrame, *by: str) -> DataFrame:
    """The sketches put together, over everything or for each ``by``: the sketch of the union, however the rows were dealt out."""
    return sketches.groupBy(*by).agg(F.sum("rows").alias("rows"), F.hll_union_agg("sketch").alias("sketch"))


def estimated_duplicates(sketches: DataFrame) -> DataFrame:
    """Adds ``distinct`` and ``duplicate_fraction``, 1 - distinct / rows; never below zero."""
    distinct = F.least(F.hll_sketch_estimate("sketch"), F.col("rows"))
    fraction = 1 - F.try_divide(F.col("distinct").cast("double"), F.col("rows").cast("double"))
    return sketches.withColumn("distinct", distinct).withColumn("duplicate_fraction", fraction)


def estimated_overlap(sketches: DataFrame, by: str) -> DataFrame:
    """(a, b, shared): about how many keys two groups have in common, from their sketches and those of their unions.

    The error is that of the union's estimate, so small overlaps of large groups are not told from none. There is a row for every two
    groups: a few sources, not a key.
    """
    left, right = (sketches.select(F.col(by).alias(name), F.col("sketch").alias(f"sketch_{name}")) for name in ("a", "b"))
    pairs = left.join(right, F.col("a") < F.col("b"))
    union = F.hll_sketch_estimate(F.hll_union("sketch_a", "sketch_b"))
    shared = F.hll_sketch_estimate("sketch_a") + F.hll_sketch_estimate("sketch_b") - union
    return pairs.select("a", "b", F.greatest(shared, F.lit(0).cast("long")).alias("shared"))
