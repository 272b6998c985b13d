"""Shuffles, splits, caps and row positions without a single-task global sort."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import unit_hash
from corpusloom.session import materialize

BINS = 1024


def shuffled(df: DataFrame, key: str = "id", seed: int = 0) -> DataFrame:
    """Random permutation as a range-partitioned sort on a per-row draw.

    A reservoir buffer only approximates this on one machine, so the buffered variants map here too.
    """
    return df.withColumn("_u", unit_hash(seed, key, "shuffle")).orderBy("_u", key).drop("_u")


def nth_smallest(df: DataFrame, order: Column, n: int):
    """Exact n-th smallest value of a numeric expression (1-based), or None when there are fewer.

    Histogram passes of ``BINS`` counters shrink the range around the n-th value until it holds one value. Only the
    counters reach the driver; ids that are unique or draws that hardly repeat need a few passes
    even for billions of rows. The passes run while the caller's plan is built. Infinite values are
    split off first, since no width parts them from the others.
    """
    values = df.select(order.alias("v")).where("v is not null")
    low, high, total = values.agg(F.min("v"), F.max("v"), F.count("v")).first()
    if n < 1 or total < n:
        return None
    inside, rank = values, n
    if isinstance(low, float) and (math.isinf(low) or math.isinf(high) or math.isnan(high)):
        ends = {float("-inf"): 0, float("inf"): 0}
        finite = F.abs("v") < float("inf")
        sizes = {v: c for v, c in values.where(~finite).groupBy("v").count().collect()}
        ends.update({v: sizes.get(v, 0) for v in ends})
        if rank <= ends[float("-inf")]:
            return float("-inf")
        rank -= ends[float("-inf")]
        inside = values = values.where(finite)
        low, high, total = values.agg(F.min("v"), F.max("v"), F.count("v")).first()
        if rank > total:
            return float("inf") if rank <= total + ends[float("inf")] else float("nan")
    while low < high:
        width = (high - low) / BINS
        # Neighbouring floating-point numbers leave no width: two bins part them.
        place = F.floor((F.col("v") - F.lit(low)) / F.lit(width)) if width > 0 else F.when(F.col("v") > F.lit(low), 1).otherwise(0)
        counts = sorted(
            inside.groupBy(F.least(place, F.lit(BINS - 1)).alias("bin")).agg(F.count("v"), F.min("v"), F.max("v")).collect()
        )
        for _, size, first, last in counts:
            if rank <= size:
                break
            rank -= size
        if (first, last) == (low, high):
            # Rounding put everything into one bin: part the least value from the rest.
            ties = inside.where(F.col("v") == F.lit(low)).count()
            if rank <= ties:
                return low
            rank -= ties
            inside = inside.where(F.col("v") > F.lit(low))
            low = inside.agg(F.min("v")).first()[0]
            continue
        low, high = first, last
        inside = values.where(F.col("v").between(low, high))
    return low


def first_n(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first ``n`` rows by a unique numeric column: a filter, not a sort into one task."""
    bound = nth_smallest(df, F.col(order), n)
    return df if bound is None and n > 0 else df.where(F.col(order) <= F.lit(bound)) if n > 0 else df.limit(0)


def take_skip_split(df: DataFrame, order: str = "id", n_valid: int = 4000) -> DataFrame:
    """The first ``n_valid`` rows become ``valid``, the rest ``train``."""
    bound = nth_smallest(df, F.col(order), n_valid)
    in_valid = F.lit(n_valid > 0) if bound is None else F.col(order) <= F.lit(bound)
    return df.withColumn("split", F.when(in_valid, "valid").otherwise("train"))


def train_test_split(df: DataFrame, test_size: float, key: str = "id", seed: int = 0, exact: bool = True) -> DataFrame:
    """Random ``split`` column. ``exact`` gives ceil(n * test_size) test rows, else a coin per row.

    The exact split finds the draw of the last test row first and then filters, so the
    data itself is neither sorted nor shuffled.
    """
    draw = unit_hash(seed, key, "split")
    if not exact:
        return df.withColumn("split", F.when(draw < test_size, "test").otherwise("train"))
    wanted = math.ceil(df.count() * test_size)
    bound = nth_smallest(df, draw, wanted)
    if bound is None:
        return df.withColumn("split", F.lit("train"))
    surplus = df.where(draw <= F.lit(bound)).count() - wanted
    in_test = draw < F.lit(bound) if surplus else draw <= F.lit(bound)
    if surplus:
        # Rows that share the last draw are taken in key order.
        tied = df.where(draw == F.lit(bound))
        last_key = nth_smallest(tied, F.col(key), tied.count() - surplus)
        in_test = in_test | ((draw == F.lit(bound)) & (F.col(key) <= F.lit(last_key)))
    return df.withColumn("split", F.when(in_test, "test").otherwise("train"))


def three_way_split(df: DataFrame, test_size: float = 0.2, key: str = "id", seed: int = 0) -> DataFrame:
    """``test_size`` of the rows held out and halved into test and valid."""
    draw = unit_hash(seed, key, "split")
    return df.withColumn(
        "split", F.when(draw < test_size / 2, "test").when(draw < test_size, "valid").otherwise("train")
    )


def overlapping_split(df: DataFrame, test_size: float = 0.05, key: str = "id", seed: int = 0, disjoint: bool = False) -> DataFrame:
    """All rows as ``train`` plus a test sample of the same rows, or a clean split when ``disjoint``."""
    cut = train_test_split(df, test_size, key, seed)
    if disjoint:
        return cut
    roles = F.when(F.col("split") == "test", F.array(F.lit("train"), F.lit("test"))).otherwise(F.array(F.lit("train")))
    return cut.withColumn("split", F.explode(roles))


def split_counts(df: DataFrame, split: str = "split") -> DataFrame:
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("n"))


def sample_rows(df: DataFrame, n: int = 3, key: str = "id", seed: int = 0) -> DataFrame:
    """``n`` random rows for inspection; a top-n sort keeps n rows per task."""
    return df.withColumn("_u", unit_hash(seed, key, "inspect")).orderBy("_u", key).limit(n).drop("_u")


def _binned(df: DataFrame, order: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``_bin``: bins of about equal size, in the order of a numeric column.

    Approximate quantiles cut the value range. A value that is itself more than a bin is cut further by its first
    tie, at quantiles of that. The cuts only affect balance, whatever they are.
    """
    n_bins = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), BINS)
    shares = [i / n_bins for i in range(1, n_bins)]
    found = df.approxQuantile(order, shares, 0.25 / n_bins) if shares else []
    cuts = sorted(set(found))
    if not cuts:
        return df.withColumn("_bin", F.lit(0).cast("bigint"))
    # The bucket is found by binary search in the JVM.
    splits = [float("-inf"), *cuts, float("inf")]
    binned = Bucketizer(splits=splits, inputCol="_order", outputCol="_bin", handleInvalid="keep").transform(
        df.withColumn("_order", F.coalesce(F.col(order).cast("double"), F.lit(float("-inf"))))
    )
    binned = binned.withColumn("_bin", F.col("_bin").cast("bigint") * BINS)
    heavy = [v for v in cuts if found.count(v) > 1]
    if heavy and ties:
        tie = F.col(ties[0]).cast("double")
        shared = binned.where(F.col("_order").isin(heavy)).groupBy("_order")
        # One row per heavy value, fewer than there are bins.
        inner = F.broadcast(shared.agg(F.percentile_approx(tie, shares, 1000).alias("_cuts")))
        part = F.size(F.filter("_cuts", lambda c: c < tie))
        binned = binned.join(inner, "_order", "left").withColumn("_bin", F.col("_bin") + F.coalesce(part, F.lit(0))).drop("_cuts")
        # Rows behind a heavy value share its quantile bin and come after all its parts.
        behind = F.col("_order").isin(heavy)
        binned = binned.withColumn("_bin", F.when(behind, F.col("_bin")).otherwise(F.col("_bin") + BINS - 1))
    return binned.drop("_order")


def range_cuts(df: DataFrame, order: str) -> list[float]:
    """Values that cut a unique numeric column into ranges of about equal numbers of rows; they only affect balance."""
    n_bins = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), BINS)
    shares = [i / n_bins for i in range(1, n_bins)]
    return sorted(set(df.approxQuantile(order, shares, 0.25 / n_bins))) if shares else []


def in_ranges(df: DataFrame, order: str, cuts: list[float], name: str = "_bin") -> DataFrame:
    """The range that each row lies in, found by binary search."""
    splits = [float("-inf"), *cuts, float("inf")]
    found = Bucketizer(splits=splits, inputCol=f"{name}_of", outputCol=name).transform(
        df.withColumn(f"{name}_of", F.coalesce(F.col(order).cast("double"), F.lit(float("-inf"))))
    )
    return found.withColumn(name, F.col(name).cast("int")).drop(f"{name}_of")


def _inside(order: str, ties: tuple[str, ...]):
    return Window.partitionBy("_bin").orderBy(order, *ties)


def row_positions(df: DataFrame, order: str, ties: tuple[str, ...] = (), name: str = "position") -> DataFrame:
    """0-based global position by a numeric column (and ``ties``), without an unpartitioned window.

    Rows are numbered inside bins of the value range; the bins' counts are summed up over a bounded number of rows.
    """
    binned = _binned(df, order, ties)
    counts = binned.groupBy("_bin").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_bin", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    numbered = binned.withColumn("_row", F.row_number().over(_inside(order, ties)))
    # ``starts`` has one row per bin: small by construction.
    joined = numbered.join(F.broadcast(starts), "_bin")
    return joined.withColumn(name, F.col("_start") + F.col("_row") - 1).drop("_bin", "_row", "_start")


def running_sums(df: DataFrame, order: str, values: list[str]) -> DataFrame:
    """Adds ``<value>_before`` for each value: its sum over all rows before, by a unique numeric column."""
    binned = _binned(df, order)
    totals = binned.groupBy("_bin").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    before = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_bin", *[F.coalesce(F.sum(f"_{v}").over(before), F.lit(0)).alias(f"_{v}") for v in values])
    ahead = _inside(order, ()).rowsBetween(Window.unboundedPreceding, -1)
    summed = binned.withColumns({f"{v}_before": F.coalesce(F.sum(v).over(ahead), F.lit(0)) for v in values})
    # ``starts`` has one row per bin: small by construction.
    joined = summed.join(F.broadcast(starts), "_bin")
    return joined.withColumns({f"{v}_before": F.col(f"{v}_before") + F.col(f"_{v}") for v in values}).drop("_bin", *[f"_{v}" for v in values])


def numbered_ranges(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """0-based global position by columns of any orderable type, without a sort into one task.

    Rows are dealt out by ranges, which are written once, since sampled ranges may differ when computed again, and
    numbered inside their range.
    """
    dealt = materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    row = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    # ``starts`` has one row per range: small by construction.
    joined = dealt.withColumn("_row", row).join(F.broadcast(starts), "_range")
    return joined.withColumn(name, (F.col("_start") + F.col("_row") - 1).cast("bigint")).drop("_range", "_row", "_start")


def batches(df: DataFrame, order: str, size: int = 1000, name: str = "batch") -> DataFrame:
    """Batch number of every row when rows are taken ``size`` at a time in order."""
    return row_positions(df, order, name="_position").withColumn(
        name, F.floor(F.col("_position") / size).cast("bigint")
    ).drop("_position")


def replicate_prompts(
    df: DataFrame, copies: int, order: str = "task_id", prompt: str = "prompt", eos: str = "<|endoftext|>", n_tasks: int | None = None
) -> DataFrame:
    """``copies`` rows per task; the prompt is the end token plus the stripped text."""
    from corpusloom.functions.text import strip

    tasks = df if n_tasks is None else first_n(df, order, n_tasks)
    return tasks.withColumn(prompt, F.concat(F.lit(eos), strip(prompt))).withColumn(
        "copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
    )
