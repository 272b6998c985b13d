"""Sinks. All of them write in parallel, one file or more per task."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLES_PER_FILE = 100_000
FILES_PER_FOLDER = 1000
#: The name Spark's writers give to a null key.
NULL_KEY = "__HIVE_DEFAULT_PARTITION__"


def sink_dataset(df: DataFrame, path: str, split: str | None = "split", mode: str = "overwrite") -> None:
    """Parquet, one folder per split."""
    writer = df.write.mode(mode)
    (writer.partitionBy(split) if split else writer).parquet(path)


def sink_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def sink_sharded_gzip_json(df: DataFrame, path: str, samples_per_file: int = SAMPLES_PER_FILE, mode: str = "overwrite") -> None:
    """Gzipped JSON lines with at most ``samples_per_file`` rows per file."""
    df.write.mode(mode).option("maxRecordsPerFile", samples_per_file).option("compression", "gzip").json(path)


def sink_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    writer = df.write.mode(mode).option("header", True).option("escape", '"').option("quoteAll", True)
    keep_blanks = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    writer.options(**keep_blanks).csv(path)


def sink_text_render(df: DataFrame, path: str, text: Column | str, order: list[str] | None = None, line_sep: str = "\n", mode: str = "overwrite") -> None:
    """The rendered texts in order, over as many part files as there are ranges of the order."""
    rendered = F.col(text) if isinstance(text, str) else text
    rows = df.orderBy(*order) if order else df
    rows.select(rendered.alias("value")).write.mode(mode).option("lineSep", line_sep).text(path)


def sample_text() -> Column:
    """An extracted function with its comment and register line."""
    return F.concat(F.col("comment"), F.col("body"), F.lit("\n"), F.col("register"))


def local_folder(spark: SparkSession, path: str) -> str | None:
    """The plain path of a folder in the local file system, which tasks can open by themselves; None in any other store."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def _put_files(root: str):
    def put(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get(), 0
        part = f"{task.partitionId():05d}"
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for key, lines in groupby(rows, itemgetter(0)):
            folder = f"{root}/part=t{part}.{made // FILES_PER_FOLDER}"
            if made % FILES_PER_FOLDER == 0:
                os.makedirs(folder, exist_ok=True)
            # Put in place when complete: another attempt of the task may be writing the same file. Scans skip names that begin with a dot.
            with open(begun := f"{folder}/.{key}.{task.taskAttemptId()}", "wb") as file:
                file.writelines((line or b"") + b"\n" for _, line in lines)
            os.replace(begun, f"{folder}/part-{part}-{key}.txt")
            made += 1
        yield pa.RecordBatch.from_pydict({"made": pa.array([made], pa.int64())})

    return put


def sink_file_per_key(df: DataFrame, path: str, key: str, text: str = "value") -> None:
    """The texts of each whole-number key, a line each, in a text file for each task that has some; ``file_key`` tells a file's key.

    Spark's writer makes a folder for each key, and in a local folder starts several processes for each file, to set its mode.
    There, tasks write the files, some to a folder.
    """
    if (root := local_folder(df.sparkSession, path)) is None:
        writer = df.select(text, key).write.option("compression", "none").option("mapreduce.fileoutputcommitter.algorithm.version", "2")
        return writer.partitionBy(key).text(path)
    os.makedirs(root, exist_ok=True)
    name = F.concat(F.lit(f"{key}="), F.coalesce(F.col(key).cast("string"), F.lit(NULL_KEY)))
    rows = df.sortWithinPartitions(key).select(name.alias("name"), F.col(text).cast("binary").alias("text"))
    rows.mapInArrow(_put_files(root), "made bigint").write.format("noop").mode("overwrite").save()


def file_key(path: str, key: str) -> Column:
    """The key of a file of ``sink_file_per_key`` as text; blank unless it is a whole number from 0 on."""
    return F.regexp_extract(path, rf"[/-]{key}=(\d+)(?:/[^/]*|\.txt)$", 1)
