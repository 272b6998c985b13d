"""Column helpers, size-checked joins and connected components shared by the operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import materialize

#: Rows of a narrow table that may be broadcast: at 16 bytes a row this is 16 MB.
BROADCAST_ROWS = 1_000_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def small_batches(spark: SparkSession) -> None:
    """Texts are long: unless the session says otherwise, 2000 of them go to Python at once instead of 10,000."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "2000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str) -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def crc_of(column: str) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def ascii_lower(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores in front until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def small_or_shuffled(right: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``right`` marked for broadcast when it is counted to have at most ``limit`` rows; beyond, an ordinary shuffle join."""
    return F.broadcast(right) if right.limit(limit + 1).count() <= limit else right


#: The bits of a filter that a key sets are named by these parts of it.
_SHIFTS = (34, 4, 19)
#: A filter has 24 to 48 bits a key, which lets one key in a thousand pass wrongly, up to 128 MB.
_KEY_BITS, _MOST_BITS = 24, 30


def bit_filter(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of column ``key`` (well mixed longs): three bits for each key.

    It grows with the number of keys up to a fixed size; beyond, more keys pass that needn't, so whoever uses it must check
    what passes. Tasks put the bits together; the driver gets few large pieces.
    """
    bits = min(_MOST_BITS, max(16, (_KEY_BITS * keys.count()).bit_length()))
    mask, part = (1 << bits) - 1, 1 << 15
    places = F.array(*[F.expr(f"shiftrightunsigned(key, {s}) & {mask}L") for s in _SHIFTS])
    bit = F.expr("shiftleft(1L, cast(place & 63 AS int))")
    words = keys.select(F.explode(places).alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[int, np.ndarray] = {}
        for batch in batches:
            word, value = (c.to_numpy() for c in batch.columns)
            for p in np.unique(word // part).tolist():
                mine = word // part == p
                maps.setdefault(p, np.zeros(part, dtype=np.int64))[word[mine] % part] = value[mine]
        yield pa.RecordBatch.from_pydict({"part": list(maps), "bits": [m.tobytes() for m in maps.values()]}, schema=_MAP)

    packed = words.repartition(F.shiftright("word", 15)).mapInArrow(pack, "part long, bits binary")
    out = np.zeros(1 << (bits - 6), dtype=np.int64)
    for p, raw in packed.collect():
        piece = np.frombuffer(raw, dtype=np.int64)[: len(out)]
        out[p * part : p * part + len(piece)] = piece
    return out.view(np.uint64)


_MAP = pa.schema([("part", pa.int64()), ("bits", pa.binary())])


def passing(words: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Indices of the keys whose bits are all set."""
    mask = np.uint64(len(words) * 64 - 1)
    on = np.arange(len(key))
    for shift in _SHIFTS:
        place = key[on] >> np.uint64(shift) & mask
        on = on[(words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)]
    return on


def components(links: DataFrame, name: str) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of ``links`` (a, b); a row may link a node with itself.

    Distributed union-find by label passing and pointer jumping. Each round hands every node the least label of its
    neighbours and lets roots hook onto the least label seen among their members; then labels are replaced by their
    labels' labels. A round is written to the shared folder, so a lost executor repeats one round at most. Both
    steps are aggregates with map-side minima: a hot node costs one row per task.
    """
    links = materialize(links.where("a <> b").select("a", "b").distinct(), f"{name}-links")
    ends = links.union(links.select("b", "a")).toDF("a", "b")
    labels = materialize(ends.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root")), f"{name}-labels")
    while True:
        # The least label at either end of a link is offered to the roots of both ends.
        at_a = links.join(labels.toDF("a", "ra"), "a")
        both = at_a.join(labels.toDF("b", "rb"), "b").where("ra <> rb")
        hooks = both.select(F.greatest("ra", "rb").alias("node"), F.least("ra", "rb").alias("to"))
        hooks = hooks.groupBy("node").agg(F.min("to").alias("to"))
        hooks = materialize(hooks, f"{name}-hooks")
        if hooks.isEmpty():
            return labels
        labels = materialize(_jumped(labels, hooks), f"{name}-labels")
        while True:
            # Jump until every label is its own label.
            roots = labels.toDF("root", "next")
            moved = labels.join(roots, "root").select("node", "root", "next")
            if moved.where("root <> next").isEmpty():
                break
            labels = materialize(moved.select("node", F.col("next").alias("root")), f"{name}-labels")


def _jumped(labels: DataFrame, hooks: DataFrame) -> DataFrame:
    """Members of a hooked root take the root's new label."""
    by_root = hooks.toDF("root", "to")
    return labels.join(by_root, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
