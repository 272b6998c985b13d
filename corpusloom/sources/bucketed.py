"""Tables laid out in buckets of a key: joins and groups on that key need no exchange."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Layout:
    """``schema`` as DDL. Rows go to ``buckets`` by a hash of ``keys``; ``batch`` names a column that parts the table into
    folders, each of which can be replaced by itself."""

    schema: str
    keys: tuple[str, ...]
    buckets: int
    batch: str | None = None


class BucketedTable:
    """A table under ``path``. The session's catalogue only holds its layout: any session may open the same folder."""

    def __init__(self, spark: SparkSession, path: str, layout: Layout):
        self.spark, self.path, self.layout = spark, path.rstrip("/"), layout
        self.name = "bucketed_" + hashlib.md5(self.path.encode()).hexdigest()[:20]
        if not spark.catalog.tableExists(self.name):
            keys = ", ".join(layout.keys)
            parted = f"PARTITIONED BY ({layout.batch}) " if layout.batch else ""
            place = self.path.replace("'", "\\'")
            spark.sql(
                f"CREATE TABLE {self.name} ({layout.schema}) USING parquet {parted}"
                f"CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {layout.buckets} BUCKETS LOCATION '{place}'"
            )
            if layout.batch:
                folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
                spark.catalog.recoverPartitions(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def write(self, df: DataFrame, batch: int | None = None) -> None:
        """Adds rows, or replaces those of one batch. Each task writes one bucket, so there is a file to a bucket."""
        columns = [f.name for f in self.read().schema if f.name != self.layout.batch]
        rows = df.select(*columns).repartition(self.layout.buckets, *self.layout.keys).sortWithinPartitions(*self.layout.keys)
        if self.layout.batch is None:
            rows.write.insertInto(self.name)
            return
        rows.withColumn(self.layout.batch, F.lit(batch)).createOrReplaceTempView(f"{self.name}_new")
        listed = ", ".join(f"`{c}`" for c in columns)
        self.spark.sql(f"INSERT OVERWRITE {self.name} PARTITION ({self.layout.batch} = {int(batch)}) SELECT {listed} FROM {self.name}_new")
        self.spark.catalog.dropTempView(f"{self.name}_new")


def sink_bucketed(df: DataFrame, path: str, keys: tuple[str, ...] = ("id",), buckets: int = 200) -> BucketedTable:
    """``df`` as a bucketed table in an empty folder."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    table = BucketedTable(df.sparkSession, path, Layout(schema, keys, buckets))
    table.write(df)
    return table
