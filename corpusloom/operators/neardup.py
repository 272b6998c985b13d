"""Near-duplicate removal: MinHash bands, connected components, exact Jaccard extremes.

Layout of the job (ids and hashes travel, texts stay where they are):

1. ``dedup_table``   words of every text -> 64-bit word hashes, a key of the word set, the list length.
2. collapse          texts with the same word set become one representative; however often a text
                     is copied, later steps see it once.
3. bands             one Arrow UDF turns a representative's words into band hashes.
4. links             every bucket becomes a two-level star (salted heads, then the bucket's first id):
                     as many links as members, never all pairs, and no task holds a whole hot bucket.
5. components        smallest id by propagation and pointer jumping, each round written to the shared folder.
6. extremes          greedy in id order, in blocks: a block of at most ``BLOCK`` first ids per cluster is
                     resolved, the rest of the cluster is compared with that block's extremes only.

The result equals the sequential greedy walk over each cluster in id order.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import col
from corpusloom.functions.tokens import DEDUP_PATTERN, dedup_words, jaccard
from corpusloom.operators.keyed import HOT_ROWS, hot_keys, salted_join, without_ids
from corpusloom.session import materialize, spread

# Fixed values of the reference job.
MIN_TOKENS = 10
NUM_PERM = 256
THRESHOLD = 0.85

BLOCK = 64
#: Spark puts a group limit in front of the shuffle for ranks up to 1000 (spark.sql.optimizer.windowGroupLimitThreshold).
LARGEST_BLOCK = 512
PART_WORDS = 1_000_000
#: Words of the texts of a block; the one that passes this bound is the block's last.
BLOCK_WORDS = 1_000_000
SALTS = 256


def choose_bands(threshold: float, num_perm: int = NUM_PERM) -> tuple[int, int]:
    """(bands, rows) with the least expected error of the collision curve 1 - (1 - s^r)^b.

    False positives (below the threshold) and false negatives (above it) weigh the same.
    """
    s = np.linspace(0.0, 1.0, 2001)
    below = s < threshold
    best = None
    for bands in range(1, num_perm + 1):
        for rows in range(1, num_perm // bands + 1):
            hit = 1.0 - (1.0 - s**rows) ** bands
            error = np.where(below, hit, 1.0 - hit).sum()
            if best is None or error < best[0]:
                best = (error, bands, rows)
    return best[1], best[2]


def _permutations(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    odd = rng.integers(0, 2**63, size=n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return odd, rng.integers(0, 2**63, size=n, dtype=np.uint64)


def _signatures(rows: list[np.ndarray], odd: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """MinHash of each row of word hashes: smallest high half of odd * h + shift, per permutation."""
    out = np.empty((len(rows), len(odd)), dtype=np.uint32)
    start = 0
    while start < len(rows):
        # Groups of texts whose words fit the CPU cache together.
        stop, words = start, 0
        while stop < len(rows) and (stop == start or words + len(rows[stop]) <= 32_768):
            words += len(rows[stop])
            stop += 1
        flat = np.concatenate(rows[start:stop]).view(np.uint64)
        cuts = np.cumsum([0] + [len(r) for r in rows[start : stop - 1]])
        for p in range(len(odd)):
            out[start:stop, p] = np.minimum.reduceat(flat * odd[p] + shift[p], cuts) >> np.uint64(32)
        start = stop
    return out


def _signature_udf(num_perm: int, seed: int):
    @F.pandas_udf("array<bigint>")
    def signature(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        odd, shift = _permutations(num_perm, seed)
        for hashes in batches:
            yield pd.Series(list(_signatures(list(hashes), odd, shift).astype(np.int64)))

    return signature


def _band_udf(bands: int, rows: int, seed: int):
    @F.pandas_udf("array<bigint>")
    def band_hashes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        odd, shift = _permutations(bands * rows, seed)
        mix = _permutations(rows, seed + 1)[0]
        for hashes in batches:
            sig = _signatures(list(hashes), odd, shift).astype(np.uint64).reshape(-1, bands, rows)
            folded = ((sig + np.uint64(1)) * mix).sum(axis=2, dtype=np.uint64)
            yield pd.Series(list(folded.view(np.int64)))

    return band_hashes


def dedup_tokens(c: str | Column) -> Column:
    """Distinct words of a text, in order of first use."""
    return F.array_distinct(dedup_words(c))


def word_hash(word: Column) -> Column:
    """60 bits of a word's md5: a hash that other engines have as well."""
    return F.conv(F.substring(F.md5(word), 1, 15), 16, 10).cast("bigint")


def long_enough(c: str | Column, min_tokens: int = MIN_TOKENS) -> Column:
    """At least ``min_tokens`` words, repeats counted; reads only as far as the last of them."""
    return col(c).rlike(rf"(?:{DEDUP_PATTERN}[^A-Za-z_0-9]+){{{min_tokens - 1}}}[A-Za-z_0-9]")


def dedup_table(df: DataFrame, key: str = "id", content: str = "content") -> DataFrame:
    """(id, words, set_key) of the texts long enough to be compared.

    The length test counts all words with repeats; the comparison uses the set.
    """
    distinct = df.where(long_enough(content)).select(F.col(key).alias("id"), dedup_tokens(content).alias("_set"))
    return distinct.select(
        "id",
        F.transform("_set", word_hash).alias("words"),
        F.md5(F.array_join(F.sort_array("_set"), " ")).alias("set_key"),
    )


def minhash_signature(
    df: DataFrame, key: str = "id", content: str = "content", num_perm: int = NUM_PERM, seed: int = 1
) -> DataFrame:
    """(id, signature); texts under ``MIN_TOKENS`` words have a NULL signature."""
    words = F.transform(dedup_tokens(content), word_hash)
    hashed = df.where(long_enough(content)).select(F.col(key).alias("id"), _signature_udf(num_perm, seed)(words).alias("signature"))
    short = df.where(~long_enough(content)).select(F.col(key).alias("id"), F.lit(None).cast("array<bigint>").alias("signature"))
    return hashed.unionByName(short)


def lsh_buckets(table: DataFrame, threshold: float = THRESHOLD, num_perm: int = NUM_PERM, seed: int = 1) -> DataFrame:
    """(id, band, bucket) rows of a ``dedup_table``."""
    bands, rows = choose_bands(threshold, num_perm)
    hashed = table.select("id", _band_udf(bands, rows, seed)("words").alias("hashes"))
    # Exploding an expression: for a plain column the optimizer would add a filter on its size,
    # push it down and run the UDF a second time there.
    return hashed.select("id", F.posexplode(F.slice("hashes", 1, bands)).alias("band", "bucket"))


def bucket_links(buckets: DataFrame, salts: int = SALTS) -> DataFrame:
    """(src, dst) links that connect all members of a bucket, one per member.

    Members link to the first id of their salted part, part heads to the first id of the
    bucket. Running windows read a sorted part once and hold one row; a part of a hot bucket
    is 1/``salts`` of it and the second level has at most ``salts`` rows per bucket.
    """
    salted = buckets.withColumn("salt", F.pmod("id", F.lit(salts)))
    part = Window.partitionBy("band", "bucket", "salt").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    headed = salted.withColumn("head", F.first("id").over(part))
    low = headed.where("id <> head").select(F.col("id").alias("src"), F.col("head").alias("dst"))
    bucket = Window.partitionBy("band", "bucket").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    heads = headed.where("id = head").withColumn("first", F.first("id").over(bucket))
    high = heads.where("id <> first").select(F.col("id").alias("src"), F.col("first").alias("dst"))
    return low.unionByName(high).distinct()


def connected_components(links: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(id, component): the smallest id reachable over the links.

    A round takes the smallest label among the neighbours and then the label of that label,
    so distances shrink by doubling. Frequent labels are salted in that look-up, since one
    component, and with it one label, may cover a large part of the nodes.
    """
    both = materialize(
        links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), "links"
    )
    labels = both.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("near"))
    labels = materialize(labels.select("id", F.least("id", "near").alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id"))
        near = near.agg(F.min("component").alias("near"))
        lowered = labels.join(near, "id").select("id", "component", F.least("component", "near").alias("lower"))
        target = labels.select(F.col("id").alias("lower"), F.col("component").alias("jump"))
        hot = hot_keys(labels.groupBy(F.col("component").alias("lower")).agg(F.count(F.lit(1)).alias("n")), ["lower"], at_least=hot_rows)
        moved = salted_join(lowered, target, ["lower"], "left", spread=["id"], hot=hot)
        moved = materialize(
            moved.select("id", F.least("lower", F.coalesce("jump", "lower")).alias("component"), F.col("component").alias("old")),
            "labels",
        )
        labels = moved.select("id", "component")
        if moved.where("component <> old").isEmpty():
            return labels


class _WordIndex:
    """Which of a bounded number of word sets hold a word; compares a set with all of them at once."""

    def __init__(self):
        self.holders: dict[int, list[int]] = {}
        self.ids: list[int] = []
        self.sizes: list[int] = []

    def add(self, key: int, words: np.ndarray) -> None:
        for word in words.tolist():
            self.holders.setdefault(word, []).append(len(self.ids))
        self.ids.append(key)
        self.sizes.append(len(words))

    def first_similar(self, words: np.ndarray, threshold: float) -> int | None:
        """Id of the first set with a Jaccard similarity of at least ``threshold``."""
        found = [self.holders[w] for w in words.tolist() if w in self.holders]
        if not found:
            return None
        shared = np.bincount(np.fromiter(chain.from_iterable(found), np.int64), minlength=len(self.ids))
        similar = shared / (np.array(self.sizes) + len(words) - shared) >= threshold
        first = int(similar.argmax())
        return self.ids[first] if similar[first] else None


def _greedy(threshold: float):
    """Greedy walk over one block (at most ``LARGEST_BLOCK`` rows) in id order."""

    def resolve(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("id")
        extremes, extreme_of = _WordIndex(), []
        for key, words in zip(block["id"], block["words"]):
            hit = extremes.first_similar(words, threshold)
            if hit is None:
                extremes.add(key, words)
            extreme_of.append(key if hit is None else hit)
        return pd.DataFrame({"cluster": block["cluster"], "id": block["id"], "extreme": extreme_of})

    return resolve


def _judge(threshold: float):
    """Compare a bounded part of a cluster with the extremes of one block, in their id order."""

    def judge(part: pd.DataFrame, leaders: pd.DataFrame) -> pd.DataFrame:
        extremes = _WordIndex()
        for key, words in leaders.sort_values("id")[["id", "words"]].itertuples(index=False):
            extremes.add(key, words)
        hits = [extremes.first_similar(words, threshold) for words in part["words"]]
        extreme = pd.array(hits, dtype="Int64")
        return pd.DataFrame({"cluster": part["cluster"], "id": part["id"], "words": part["words"], "extreme": extreme})

    return judge


def cluster_extremes(members: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, salts: int = 32) -> DataFrame:
    """(cluster, id, extreme): each member joins the first extreme it resembles, else becomes one.

    ``members`` has (cluster, id, words), words as 64-bit hashes. Each round resolves the first
    ``block`` open members of every cluster exactly; open members behind them are then compared with
    the extremes found, and the unmatched ones stay open. Clusters of at most ``block`` members
    finish in round one; blocks double for the few larger ones, up to ``LARGEST_BLOCK``. A block ends early
    with ``BLOCK_WORDS`` words, and a cluster is compared in parts of about ``PART_WORDS`` words, so a task holds neither
    many nor long texts of it.
    """
    open_rows = members.select("cluster", "id", "words")
    done: DataFrame | None = None
    while True:
        rank = F.row_number().over(Window.partitionBy("cluster").orderBy("id"))
        front = open_rows.withColumn("_rank", rank).where(F.col("_rank") <= block)
        ahead = Window.partitionBy("cluster").orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum(F.size("words")).over(ahead), F.lit(0))
        front = front.withColumn("_before", before).where(F.col("_before") < BLOCK_WORDS).drop("_rank", "_before")
        front = materialize(front, "block")
        solved = materialize(
            front.groupBy("cluster").applyInPandas(_greedy(threshold), "cluster bigint, id bigint, extreme bigint"),
            "extremes",
        )
        done = solved if done is None else done.unionByName(solved)
        # Only full blocks can have members behind them.
        held = front.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last"), F.sum(F.size("words")).alias("held"))
        full = held.where((F.col("n") == block) | (F.col("held") >= BLOCK_WORDS)).select("cluster", "last")
        if full.isEmpty():
            return done
        sizes = open_rows.groupBy("cluster").agg(F.sum(F.size("words")).alias("_words"))
        parts = F.ceil(F.col("_words") / PART_WORDS).cast("int").alias("parts")
        plan = materialize(full.join(sizes, "cluster").select("cluster", "last", parts), "parts")
        behind = salted_join(open_rows, plan, ["cluster"], "inner", salts, spread=["id"]).where("id > last")
        behind = behind.select("cluster", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "id", "words")
        leaders = solved.where("id = extreme").select("id").join(front, "id").join(plan, "cluster")
        leaders = leaders.select("cluster", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "id", "words")
        pairs = behind.groupBy("cluster", "part").cogroup(leaders.groupBy("cluster", "part"))
        judged = pairs.applyInPandas(_judge(threshold), "cluster bigint, id bigint, words array<bigint>, extreme bigint")
        judged = materialize(judged, "judged")
        done = done.unionByName(judged.where("extreme is not null").select("cluster", "id", "extreme"))
        open_rows = judged.where("extreme is null").select("cluster", "id", "words")
        if open_rows.isEmpty():
            return done
        block = min(2 * block, max(block, LARGEST_BLOCK))


def duplicate_clusters(
    df: DataFrame,
    key: str = "id",
    content: str = "content",
    carry: tuple[str, ...] = ("repo_name", "path"),
    threshold: float = THRESHOLD,
    num_perm: int = NUM_PERM,
    seed: int = 1,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """(cluster_id, base_index, <carry>, is_extreme, copies): every text of every duplicate cluster.

    ``cluster_id`` is the smallest id of the cluster; ``copies`` is set on extremes only and
    counts the cluster's texts they stand for, themselves included.
    """
    # Every text is split and hashed once.
    table = materialize(dedup_table(df, key, content), "words")
    texts = table.select("id", "set_key")
    firsts = texts.groupBy("set_key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n_same"))
    firsts = materialize(firsts, "firsts")
    reps = spread(materialize(table.join(firsts.select(F.col("rep").alias("id")), "id"), "reps"), "id")

    links = materialize(bucket_links(lsh_buckets(reps, threshold, num_perm, seed)), "links")
    components = connected_components(links, hot_rows)
    return listed_clusters(df, texts, firsts, reps, components, key, carry, threshold, hot_rows)


def listed_clusters(
    df: DataFrame,
    texts: DataFrame,
    firsts: DataFrame,
    reps: DataFrame,
    components: DataFrame,
    key: str = "id",
    carry: tuple[str, ...] = ("repo_name", "path"),
    threshold: float = THRESHOLD,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The rows of ``duplicate_clusters`` from texts (id, set_key), sets (set_key, rep, n_same), the words of ``reps`` (id, words)
    and their components (id, component)."""
    members = reps.select("id", "words").join(components, "id").withColumnRenamed("component", "cluster")
    solved = cluster_extremes(members, threshold)

    # Word sets outside any component are clusters of their own when copied at least twice.
    alone = firsts.where("n_same > 1").select(F.col("rep").alias("id")).join(components.select("id"), "id", "left_anti")
    alone = alone.select(F.col("id").alias("cluster"), "id", F.col("id").alias("extreme"))
    verdicts = solved.unionByName(alone).join(firsts.select(F.col("rep").alias("id"), "set_key", "n_same"), "id")
    verdicts = materialize(verdicts, "verdicts")
    copies = verdicts.groupBy(F.col("extreme").alias("base_index")).agg(F.sum("n_same").alias("copies"))

    # One word set may hold a large share of the texts: those sets are salted.
    found = verdicts.select("set_key", F.col("cluster").alias("cluster_id"), "extreme")
    hot = hot_keys(firsts, ["set_key"], "n_same", hot_rows)
    listed = salted_join(texts, found, ["set_key"], "inner", spread=["id"], hot=hot)
    listed = listed.select("cluster_id", F.col("id").alias("base_index"), (F.col("id") == F.col("extreme")).alias("is_extreme"))
    carried = df.select(F.col(key).alias("base_index"), *carry)
    named = listed.join(carried, "base_index").join(copies, "base_index", "left")
    return named.select("cluster_id", "base_index", *carry, "is_extreme", F.col("copies").cast("int").alias("copies"))


def removed_ids(clusters: DataFrame) -> DataFrame:
    """Cluster members that are not extremes."""
    return clusters.where(~F.col("is_extreme")).select(F.col("base_index").alias("id"))


def near_dedup(df: DataFrame, key: str = "id", clusters: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(kept rows, clusters)."""
    if clusters is None:
        clusters = materialize(duplicate_clusters(df, key, **options), "clusters")
    return without_ids(df, removed_ids(clusters).withColumnRenamed("id", key), key), clusters


def dedup_stats(df: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row of sizes: original, clusters, files in clusters, unique files in them, filtered."""
    per_cluster = clusters.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("files"), F.count_if("is_extreme").alias("unique_files")
    )
    sizes = per_cluster.agg(
        F.count(F.lit(1)).alias("clusters"),
        F.coalesce(F.sum("files"), F.lit(0)).alias("files_in_clusters"),
        F.coalesce(F.sum("unique_files"), F.lit(0)).alias("unique_files"),
    )
    total = df.agg(F.count(F.lit(1)).alias("original"))
    names = ["original", "clusters", "files_in_clusters", "unique_files"]
    both = total.unionByName(sizes, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in names])
    return both.withColumn("filtered", F.col("original") - F.col("files_in_clusters") + F.col("unique_files"))


def jaccard_of(a: str | Column, b: str | Column) -> Column:
    """Exact Jaccard similarity of two texts."""
    return jaccard(dedup_tokens(col(a)), dedup_tokens(col(b)))


def lookup_content(members: DataFrame, df: DataFrame, key: str = "id", content: str = "content") -> DataFrame:
    """Members with their text."""
    texts = df.select(F.col(key).alias("base_index"), content)
    return members.join(texts, "base_index")
