"""Evaluation metrics over result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def perplexity(
    df: DataFrame, loss: str = "loss", step: str | None = None, batch_size: int = 1, dataset_size: int | None = None
) -> DataFrame:
    """(loss, perplexity) from one loss per batch.

    Every batch counts ``batch_size`` times; with ``dataset_size`` the batches behind that many
    samples, by ``step``, count for the rest only. An overflow gives infinity.
    """
    weight = F.lit(batch_size)
    if dataset_size is not None:
        left = F.lit(dataset_size) - F.col(step) * batch_size
        weight = F.greatest(F.least(weight, left), F.lit(0))
    mean = F.try_divide(F.sum(F.col(loss) * weight), F.sum(weight))
    return df.agg(mean.alias("loss")).withColumn("perplexity", F.exp("loss"))


def predicted_class(logits: str | Column) -> Column:
    """Index of the first largest value."""
    c = F.col(logits) if isinstance(logits, str) else logits
    return F.array_position(c, F.array_max(c)) - 1


def accuracy(df: DataFrame, logits: str = "logits", label: str = "label") -> DataFrame:
    right = F.when(predicted_class(logits) == F.col(label), 1.0).otherwise(0.0)
    return df.agg(F.avg(right).alias("accuracy"))


def pass_at_k(df: DataFrame, ks: tuple[int, ...] = (1, 10, 100), task: str = "task_id", passed: str = "passed") -> DataFrame:
    """One row with pass@k: the mean over tasks of 1 - C(n-c, k) / C(n, k).

    Tasks are reduced to (n, c) first; the ratio is a product of k factors, however many samples a
    task has. As usual a k is reported only if every task has that many samples.
    """
    counts = df.groupBy(task).agg(F.count(F.lit(1)).alias("n"), F.count_if(passed).alias("c"))

    def estimate(k: int) -> Column:
        factors = F.sequence(F.lit(0), F.lit(k - 1))
        fails = F.aggregate(
            factors, F.lit(1.0), lambda acc, j: acc * F.greatest(F.col("n") - F.col("c") - j, F.lit(0)) / (F.col("n") - j)
        )
        return F.when(F.col("n") >= k, 1.0 - fails)

    def column(k: int) -> Column:
        complete = F.min("n") >= k
        return F.when(complete, F.avg(estimate(k))).alias(f"pass_at_{k}")

    return counts.agg(*[column(k) for k in ks])


def token_rate(df: DataFrame, tokens: str = "tokens", seconds: str = "seconds", by: list[str] | None = None) -> DataFrame:
    """Generated tokens per second of a run, or per group."""
    rate = F.try_divide(F.sum(tokens).cast("double"), F.sum(seconds)).alias("token_rate")
    return df.groupBy(*by).agg(rate) if by else df.agg(rate)


def samples_by_task(
    df: DataFrame, task: str = "task_id", order: str = "sample", text: str = "generation", per_row: int = 1000
) -> DataFrame:
    """(task, part, samples): generations of each task in order, at most ``per_row`` to an array.

    A task with very many generations spans several rows instead of one unbounded array.
    """
    part = F.floor(F.col(order) / per_row).cast("bigint")
    listed = F.array_sort(F.collect_list(F.struct(order, text)))
    grouped = df.groupBy(task, part.alias("part")).agg(listed.alias("_samples"))
    return grouped.select(task, "part", F.transform("_samples", lambda s: s[text]).alias("samples"))
