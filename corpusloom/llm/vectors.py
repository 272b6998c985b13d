"""Vector columns: the rows that can be used, whole-number entries, and batches of them as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """The rows whose vector can be used, and the length of these vectors (0: there are none).

    A vector that is null or empty, or holds a null or an entry that is not finite, is left out. Vectors of different
    lengths can't be compared: those of the most frequent length are used, of equally frequent ones the shortest.
    """
    entries = F.col(vector)
    finite = F.forall(entries, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    kept = df.where(entries.isNotNull() & finite & (F.size(entries) > 0))
    sizes = kept.groupBy(F.size(entries).alias("size")).agg(F.count("*").alias("rows"))
    most = sizes.orderBy(F.desc("rows"), "size").first()
    return (kept.where(F.size(entries) == most.size), most.size) if most else (kept, 0)


def floors(vector: str, scale: int, limit: int) -> Column:
    """floor(scale * entry) of every entry as array<long>, taken as double; held within ``limit`` on both sides."""
    return F.transform(F.col(vector), lambda v: F.floor(F.least(F.greatest(v.cast("double") * scale, F.lit(-float(limit))), F.lit(float(limit)))))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """An Arrow list column of equal lengths as rows x ``width``."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def summed(parts: DataFrame) -> dict[int, object]:
    """Column ``value`` added up for every ``slot``: what tasks give is added before it travels, one row a slot arrives."""
    return dict(parts.groupBy("slot").agg(F.sum("value").alias("value")).collect())
