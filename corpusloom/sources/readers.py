"""Scans of file trees, tables and result files."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import col, quoted, strip
from corpusloom.session import fresh_path

ARGS = "array<struct<name:string,type:string,comment:string>>"
API_ENTRY = f"struct<description:string,function_name:string,args:{ARGS},return:struct<type:string,comment:string>,example:string>"
SEPARATOR = "-----------"
MOST_FILES, MOST_FOLDERS = 250_000, 10_000


def scan_files_by_ext(spark: SparkSession, roots: str | list[str], ext: str) -> DataFrame:
    """(path, length, modificationTime) of all files under the roots that end in ``ext``.

    File contents are not read: the column is pruned from the scan.
    """
    paths = [roots] if isinstance(roots, str) else roots
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{ext}")
    return files.load(paths).select("path", "length", "modificationTime")


def scan_whole_files(spark: SparkSession, roots: str | list[str], ext: str) -> DataFrame:
    """(filepath, content): one row per file, over all roots.

    The text reader copies the job's settings for every file, which for small ones takes longer than reading them. It is
    left to those it may have to decompress.
    """
    paths = [roots] if isinstance(roots, str) else roots
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{ext}")
    if _compressed(spark, ext):
        texts, content = files.text(paths, wholetext=True), F.col("value")
    else:
        texts, content = files.format("binaryFile").load(paths), F.col("content").cast("string")
    return texts.select(F.col("_metadata.file_path").alias("filepath"), content.alias("content"))


def _compressed(spark: SparkSession, ext: str) -> bool:
    """Whether names that end in ``ext`` may belong to a codec: it has one, is a pattern, or less than a whole ending."""
    codecs = spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark._jsc.hadoopConfiguration())
    return not re.fullmatch(r"(\.\w+)+", ext) or codecs.getCodec(spark._jvm.org.apache.hadoop.fs.Path(f"x{ext}")) is not None


def scan_parquet_glob(spark: SparkSession, pattern: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet files by glob; only the wanted columns are read."""
    df = spark.read.parquet(pattern)
    return df.select(*columns) if columns else df


def scan_csv(spark: SparkSession, path: str | list[str], schema: str | None = None) -> DataFrame:
    """CSV with a header, quoted multi-line texts and doubled quotes."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def api_entries(files: DataFrame, path: str = "filepath", content: str = "content") -> DataFrame:
    """(package, file, ord, description, function_name, args, ret, example) of JSON API documents.

    Of every document the value of its first key counts; the key is the package name.
    """
    pairs = F.map_entries(F.from_json(content, "map<string,string>"))
    keyed = files.withColumn("_first", F.get(pairs, F.lit(0)))
    keyed, body = keyed.withColumn("package", F.col("_first.key")), F.col("_first.value")
    entries = F.from_json(body, f"array<{API_ENTRY}>")
    rows = keyed.select("package", F.col(path).alias("file"), F.posexplode(entries).alias("ord", "e"))
    return rows.select("package", "file", "ord", "e.description", "e.function_name", "e.args", F.col("e.return").alias("ret"), "e.example")


def scan_api_json(spark: SparkSession, roots: str | list[str], ext: str = ".json") -> DataFrame:
    """``api_entries`` of all files under the roots that end in ``ext``.

    The driver holds about a kilobyte for each file of a scan, so more than MOST_FILES are scanned in parts, whose entries are
    written to the shared folder.
    """
    parts = in_parts(spark, [roots] if isinstance(roots, str) else roots)
    scans = (api_entries(scan_whole_files(spark, part, ext)) for part in parts)
    if len(parts) == 1:
        return next(scans)
    path = fresh_path(spark, "api_entries")
    for entries in scans:
        entries.coalesce(max(64, spark.sparkContext.defaultParallelism)).write.mode("append").parquet(path)
    return spark.read.schema(entries.schema).parquet(path)


def in_parts(spark: SparkSession, roots: list[str]) -> list[list[str]]:
    """The roots as one part, or, when they hold more than MOST_FILES files, their folders in parts of about as many.

    A folder with more is taken apart if it has nothing but folders, at most MOST_FOLDERS.
    """
    conf, path_of = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path

    def weight(path: str) -> int:
        return path_of(path).getFileSystem(conf).getContentSummary(path_of(path)).getFileCount()

    def folders(path: str) -> list[str]:
        found, inside = path_of(path).getFileSystem(conf).listStatus(path_of(path)), []
        for x in found if len(found) <= MOST_FOLDERS else ():
            if re.match(r"[.]|_(?!metadata|common_metadata)[^=]*$", x.getPath().getName()):
                continue  # as scans do
            if not x.isDirectory():
                return []
            inside.append(x.getPath().toString())
        return inside

    paths = [x.getPath().toString() for r in roots for x in path_of(r).getFileSystem(conf).globStatus(path_of(r)) or ()]
    parts, held = [[]], 0
    with ThreadPoolExecutor(8) as pool:
        todo = [*zip(paths, pool.map(weight, paths), strict=True)]
        if sum(n for _, n in todo) <= MOST_FILES:
            return [roots]
        while todo:
            path, n = todo.pop()
            inside = folders(path) if n > MOST_FILES else []
            if inside:
                todo += zip(inside, [n] if len(inside) == 1 else pool.map(weight, inside), strict=True)
                continue
            if parts[-1] and held + n > MOST_FILES:
                parts.append([])
                held = 0
            parts[-1].append(re.sub(r"([\\{}\[\]*?])", r"\\\1", path))
            held += n
    return parts


def _segment(record: Column, i: int) -> Column:
    return strip(F.get(F.split(record, SEPARATOR, -1), F.lit(i)))


def delimited_records(df: DataFrame, record: str = "record", prompts_only: bool = False) -> DataFrame:
    """(prompt, response) of texts cut at dashes: segments 1 and 3 when both are non-blank, each pair once."""
    prompt, response = _segment(col(record), 1), _segment(col(record), 3)
    pairs = df.select(prompt.alias("prompt"), response.alias("response")).where("prompt <> ''")
    if prompts_only:
        return df.select(prompt.alias("prompt")).where("prompt <> ''").distinct()
    return pairs.where("response <> ''").distinct()


def scan_result_files(spark: SparkSession, root: str, pattern: str = "test_result-*", schema: str | None = None) -> DataFrame:
    """Rows of all result files (or folders of part files) under ``root`` that match ``pattern``.

    ``checkpoint`` is the integer their name has in place of the star.
    """
    before = pattern.partition("*")[0]
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    rows = (reader.schema(schema) if schema else reader).csv(f"{root.rstrip('/')}/{pattern}")
    number = F.regexp_extract(F.col("_metadata.file_path"), rf"/{quoted(before)}(\d+)(?:[./][^/]*)?(?:/[^/]*)?$", 1)
    return rows.withColumn("checkpoint", number.try_cast("bigint"))


def corpus_union(*tables: DataFrame, column: str = "content") -> DataFrame:
    """The texts of several tables one after another, repeats kept."""
    first, *rest = [t.select(column) for t in tables]
    for other in rest:
        first = first.unionByName(other)
    return first
