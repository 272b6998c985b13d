"""Session settings and the shared folder that intermediate tables are written to."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "corpusloom", cores: str = "*", **conf) -> SparkSession:
    """A local session for tests and benchmarks; a cluster supplies its own."""
    n = 8 if cores == "*" else int(cores)
    settings = {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    }
    settings.update(conf)
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``; a local session may do without, under its warehouse."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "local").partition("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_corpusloom"


FEW_SPLITS = 64


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition by ``keys`` when a scan has few splits and more task slots could work on it.

    A small table in one parquet row group is one task's work however many cores there are.
    Anything beyond ``FEW_SPLITS`` splits (some gigabytes) passes through unchanged.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots, *keys) if df.rdd.getNumPartitions() < min(slots, FEW_SPLITS) else df


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage for iterative jobs: a lost executor re-reads the table instead of
    replaying every earlier round, and the plan stays one round long.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written._written_to = path
    return written


def discard(*tables: DataFrame) -> None:
    """Removes what ``materialize`` wrote for these tables, once nothing that is still to run reads them."""
    for df in tables:
        spark, path = df.sparkSession, getattr(df, "_written_to", None)
        if path:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
