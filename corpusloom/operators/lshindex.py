"""A stored index of MinHash bands: batches are looked up in it and added to it, clusters grow instead of being rebuilt.

Under the index's folder, all parted by batch:

- ``sets``     (set_key, node, words): every word set once, in buckets of its key; its node is the id it came with first
- ``bands``    (bucket, band, node): every band hash once, in buckets of the hash, with the first node that had it
- ``texts``    (id, set_key): every text
- ``labels``   (node, root): the root that a linked node had when it came
- ``moves``    (root, next): roots that later batches joined to another one

A batch reads the stored bands and sets in place (they are laid out for these joins) and shuffles only its own rows. Tables of a
batch are replaced as a whole when it is repeated; a batch counts once its folder in ``commits`` is complete.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import neardup as nd
from corpusloom.session import discard, materialize
from corpusloom.sources.bucketed import BucketedTable, Layout

#: The most buckets an index has unless it is told. As many as shuffles have partitions, or more: with fewer, Spark shuffles
#: the stored side as well, and fewer tasks write it.
BUCKETS = 200


class LshIndex:
    """The near-duplicate clusters of all batches so far, as ``duplicate_clusters`` finds them for their union."""

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        threshold: float = nd.THRESHOLD,
        num_perm: int = nd.NUM_PERM,
        seed: int = 1,
        buckets: int | None = None,
    ):
        """``buckets`` of a new index: by default as many as shuffles have partitions, ``BUCKETS`` at most."""
        if buckets is None:
            buckets = min(BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.spark, self.path = spark, path.rstrip("/")
        self.threshold, self.num_perm, self.seed = threshold, num_perm, seed
        self._known: tuple[list[int], DataFrame] | None = None
        layout = lambda schema, *keys: Layout(f"{schema}, batch int", keys, buckets, "batch")
        self.sets = BucketedTable(spark, f"{self.path}/sets", layout("set_key string, node long, words array<long>", "set_key"))
        self.bands = BucketedTable(spark, f"{self.path}/bands", layout("bucket long, band int, node long", "bucket", "band"))

    # --- what is stored ---------------------------------------------------------------------------------------------

    def batches(self) -> list[int]:
        """Numbers of the complete batches."""
        fs = self.spark._jvm.org.apache.hadoop.fs
        top = fs.Path(f"{self.path}/commits")
        system = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(top):
            return []
        found = [s.getPath() for s in system.listStatus(top)]
        return sorted(int(f.getName().split("=")[1]) for f in found if system.exists(fs.Path(f, "_SUCCESS")))

    def _stored(self, name: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{name}/batch={n}" for n in self.batches()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _held(self, table: BucketedTable) -> DataFrame:
        return table.read().where(F.col("batch").isin(self.batches())).drop("batch")

    def _roots(self) -> DataFrame:
        """(node, root) of all linked nodes, through all moves; found once for the batches there are."""
        batches = self.batches()
        if self._known is None or self._known[0] != batches:
            self._known = batches, self._moved_roots()
        return self._known[1]

    def _moved_roots(self) -> DataFrame:
        labels, moves = self._stored("labels", "node long, root long"), self._stored("moves", "root long, next long")
        if not moves.isEmpty():
            last = nd.connected_components(moves.select(F.col("root").alias("src"), F.col("next").alias("dst")))
            # A node that stood alone when it came has no label, but is its own root.
            named = labels.unionByName(moves.select(F.col("root").alias("node"), "root")).join(last.withColumnRenamed("id", "root"), "root", "left")
            labels = named.select("node", F.coalesce("component", "root").alias("root"))
        return labels.unionByName(labels.select(F.col("root").alias("node"), "root")).distinct()

    # --- query and insert -------------------------------------------------------------------------------------------

    def query(self, df: DataFrame, key: str = "id", content: str = "content") -> DataFrame:
        """(id, node): the stored sets that share a band, or all their words, with each text; nothing is stored."""
        table = nd.dedup_table(df, key, content)
        buckets = nd.lsh_buckets(table, self.threshold, self.num_perm, self.seed)
        near = buckets.join(self._held(self.bands), ["bucket", "band"]).select("id", "node")
        same = table.select("id", "set_key").join(self._held(self.sets).select("set_key", "node"), "set_key").select("id", "node")
        return near.unionByName(same).distinct()

    def insert(self, df: DataFrame, key: str = "id", content: str = "content") -> DataFrame:
        """Adds a batch; (id, cluster) of its texts: the smallest node each is linked with, itself included.

        ``key`` is unique over all batches. Texts too short to be compared are left out.
        """
        batch = max(self.batches(), default=-1) + 1
        table = materialize(nd.dedup_table(df, key, content), "index-words")
        texts = table.select("id", "set_key")
        firsts = texts.groupBy("set_key").agg(F.min("id").alias("id"))
        held = self._held(self.sets).select("set_key", "node")
        fresh = materialize(firsts.join(held.select("set_key"), "set_key", "left_anti"), "index-fresh")
        reps = materialize(table.join(fresh.select("id"), "id"), "index-reps")
        buckets = materialize(nd.lsh_buckets(reps.select("id", "words"), self.threshold, self.num_perm, self.seed), "index-buckets")

        # One row of the batch per bucket meets the stored bands; the batch's own members link among themselves.
        heads = materialize(buckets.groupBy("bucket", "band").agg(F.min("id").alias("id")), "index-heads")
        met = materialize(heads.join(self._held(self.bands), ["bucket", "band"], "left"), "index-met")
        old = met.where("node IS NOT NULL").select("id", "node").distinct()
        rooted = old.join(self._roots(), "node", "left").select(F.col("id").alias("src"), F.coalesce("root", "node").alias("dst"))
        links = nd.bucket_links(buckets.select("id", "band", "bucket")).unionByName(rooted.distinct())
        found = nd.connected_components(links)
        new = reps.select("id")
        labels = found.join(new, "id").select(F.col("id").alias("node"), F.col("component").alias("root"))
        moves = found.join(new, "id", "left_anti").where("id <> component").select(F.col("id").alias("root"), F.col("component").alias("next"))

        self.sets.write(reps.select("set_key", F.col("id").alias("node"), "words"), batch)
        self.bands.write(met.where("node IS NULL").select("bucket", "band", F.col("id").alias("node")), batch)
        for name, rows in (("texts", texts), ("labels", labels), ("moves", moves)):
            rows.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.path}/commits/batch={batch}")
        discard(reps, buckets, heads, met, fresh)
        nodes = texts.join(self._held(self.sets).select("set_key", "node"), "set_key")
        return nodes.join(self._roots(), "node", "left").select("id", F.coalesce("root", "node").alias("cluster"))

    def clusters(self, df: DataFrame, key: str = "id", carry: tuple[str, ...] = ("repo_name", "path")) -> DataFrame:
        """``duplicate_clusters`` of all texts inserted; ``df`` has their ids and the columns to carry.

        Sets and links come from the index. Only clusters' members are compared, to choose their extremes.
        """
        texts = self._stored("texts", "id long, set_key string")
        firsts = texts.groupBy("set_key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n_same"))
        firsts = materialize(firsts, "firsts")
        sets = self._held(self.sets).join(firsts.select("set_key", "rep"), "set_key")
        linked = sets.select("node", "rep").join(self._roots(), "node")
        smallest = linked.groupBy("root").agg(F.min("rep").alias("component"))
        components = materialize(linked.join(smallest, "root").select(F.col("rep").alias("id"), "component"), "components")
        reps = sets.select(F.col("rep").alias("id"), "words").join(components.select("id"), "id", "left_semi")
        return nd.listed_clusters(df, texts, firsts, reps, components, key, carry, self.threshold)
