"""Exact set-similarity join: prefixes of rarest-first word lists, length and position filters, exact verification.

If two sets have a Jaccard similarity of at least t, the rarest words of each, as many as its prefix holds, have one
in common. So only rows of prefixes meet, and only those that leave room for enough common words behind them. Meetings that sizes, positions
or parity sketches rule out are dropped where they happen, before they are shuffled or any set is looked at. The others are compared where
they met: a place holds each of its sets once, however many pairs the set is in, so whole sets are not shuffled for every pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.tokens import jaccard
from corpusloom.session import materialize

#: Prefix rows of one word and length class that a task compares with as many others.
CELL = 4096
#: Sets of a place that are compared with as many others at a time.
MEMBERS = 256
#: Counters that words are hashed to; how rare a word is follows its counter. A fixed size, 4 MB, whatever the corpus.
SLOTS = 1 << 20
#: Similar sets must meet once, and once more for so many words of the smaller one: sketches tell small sets apart, but not large ones.
MORE = 64
#: Keeps whole numbers whole when sizes are multiplied by a threshold.
EPSILON = 1e-9

#: Bits of a set's sketch: each is the parity of how many words are hashed to it, so that as many bits differ as words at most.
LANES = ("s0", "s1", "s2", "s3")

_FACTOR = 0x9E3779B97F4A7C15


def _at_least(x: Column) -> Column:
    return F.ceil(x - EPSILON).cast("int")


def _mixed(words: np.ndarray) -> np.ndarray:
    x = words.view(np.uint64) * np.uint64(_FACTOR)
    return x ^ (x >> np.uint64(32))


def word_counts(sets: DataFrame) -> np.ndarray:
    """How many words of all sets fall to each of ``SLOTS`` counters; at most 2^32 - 1."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(SLOTS, dtype=np.int64)
        for batch in batches:
            words = batch.column(0).flatten().drop_null().to_numpy(zero_copy_only=False)
            held += np.bincount((_mixed(words) & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        on = np.flatnonzero(held)
        yield pa.RecordBatch.from_pydict({"slot": on, "n": held[on]})

    counted = sets.select("words").mapInArrow(slots, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, dtype=np.uint32)
    out[counted["slot"].to_numpy()] = np.minimum(counted["n"].to_numpy(), 2**32 - 1)
    return out


def prefixes(sets: DataFrame, threshold: float, cell: int = CELL) -> DataFrame:
    """(id, n, at, word, many, s0 to s3): the rarest words of each set, as many as a similar set cannot lack all of.

    A set of n words that shares at least ceil(t * n) with another has one of its first n - ceil(t * n) + 1 words in common, in
    any order of words that is the same for all sets; rarest first keeps the groups of equal words small. Words are ordered by
    their counter, then by a hash. ``at`` is a word's place in that order, ``many`` marks words that more than ``cell`` sets may have, and the
    rest is the sketch of the whole set.
    """
    counts = word_counts(sets)

    def fronts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, sizes = batch.column(2), batch.column(1).to_numpy()
            words = lists.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            mixed = _mixed(words)
            seen = counts[(mixed & np.uint64(SLOTS - 1)).astype(np.int64)]
            order = np.lexsort((words, mixed, seen, row))
            words, row, seen, mixed = words[order], row[order], seen[order], mixed[order]
            starts = np.searchsorted(row, np.arange(len(lists)))
            at = np.arange(len(row)) - starts[row]
            bit = mixed >> np.uint64(40) & np.uint64(255)
            one = np.uint64(1) << (bit & np.uint64(63))
            sketch = [np.bitwise_xor.reduceat(np.where(bit >> np.uint64(6) == k, one, np.uint64(0)), starts) if len(row) else one for k in range(len(LANES))]
            size = sizes - np.ceil(sizes * threshold - EPSILON).astype(np.int64) + 1
            # A word that stands once in all sets can't be shared, but it fills the prefix.
            on = np.flatnonzero((at < size[row]) & (seen > 1))
            mine = row[on]
            columns = [
                batch.column(0).take(pa.array(mine)), sizes[mine].astype(np.int32), at[on].astype(np.int32), words[on], seen[on] > cell,
                *[lane[mine].view(np.int64) for lane in sketch],
            ]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)

    names = ["id", "n", "at", "word", "many", *LANES]
    kinds = [sets.schema["id"].dataType, T.IntegerType(), T.IntegerType(), T.LongType(), T.BooleanType(), *[T.LongType()] * len(LANES)]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)])
    rows = sets.where("id IS NOT NULL AND size(array_compact(words)) > 0").select("id", F.size("words").cast("long").alias("n"), F.array_compact("words").alias("words"))
    return rows.mapInArrow(fronts, schema)


def _celled(rows: DataFrame, cell: int) -> DataFrame:
    """Adds the cell of a row and the number of cells of its (word, class)."""
    sized = rows.where("many").groupBy("word", "class").agg(F.ceil(F.count(F.lit(1)) / cell).cast("int").alias("cells")).where("cells > 1")
    dealt = rows.join(materialize(sized, "set-cells"), ["word", "class"], "left").withColumn("cells", F.coalesce("cells", F.lit(1)))
    return dealt.withColumn("cell", F.pmod(F.xxhash64("id"), F.col("cells")).cast("int"))


def _folded(threshold: float) -> list[Column]:
    """The sketch of a row in the fewest words that still tell its class's unlike sets; the others are 0."""
    differ = F.pow(F.lit(1 / threshold), F.col("class") + 1) * (2 * (1 - threshold) / (1 + threshold))
    s0, s1, s2, s3 = map(F.col, LANES)
    both = [s0.bitwiseXOR(s2), s1.bitwiseXOR(s3)]
    narrow, middle = [both[0].bitwiseXOR(both[1]), 0, 0, 0], [*both, 0, 0]
    pick = lambda a, b, c: F.when(differ <= 20, a).when(differ <= 47, b).otherwise(c)
    return [pick(a, b, c).cast("long").alias(name) for a, b, c, name in zip(narrow, middle, (s0, s1, s2, s3), LANES)]


def meetings(front: DataFrame, threshold: float, cell: int = CELL) -> DataFrame:
    """(a, b, place, more): sets whose sizes and prefixes allow the similarity, at every word where they may still meet; a is the larger set.

    Sizes fall into classes whose borders are a factor of 1/t apart, so a set meets its own class and the next smaller one. The sets of a
    word and class are dealt to cells when they are many; every two cells meet in a task of their own. A meeting counts if the words from
    it on are as many in both sets as must be common, but for ``more``: so they are at the first ``more`` + 1 common words of similar sets.
    A row is only dealt where its place leaves room with the smallest partner there is. ``place`` is a hash of the word.
    """
    grown = F.col("n") if threshold == 1 else F.floor(F.log(F.col("n").cast("double")) / math.log(1 / threshold) + EPSILON)
    one = materialize(front, "set-prefixes").withColumn("class", grown.cast("int"))
    # The words that two sets must share, and whether a row leaves room for them with partners of a size and above.
    need = lambda m, n: _at_least((m + n) * (threshold / (1 + threshold)))
    roomy = lambda size: F.col("n") - F.col("at") >= need(F.col("n"), size) - F.floor(F.col("n") / MORE)
    # Each set offers itself to its own class and, as the larger one, to the class below, which has sizes down to the threshold.
    below = F.col("n") * threshold
    own = F.greatest(below, F.lit(0.0) if threshold == 1 else F.pow(F.lit(1 / threshold), F.col("class") - 1e-6))
    larger = one.where(roomy(own)).unionByName(one.where(roomy(below)).withColumn("class", F.col("class") - 1))
    both = _celled(one.where(roomy(F.col("n"))).withColumn("side", F.lit(0)).unionByName(larger.withColumn("side", F.lit(1))), 2 * cell)
    both = both.select("id", "n", "at", "word", "side", "class", "cells", "cell", *_folded(threshold))
    cells = F.sequence(F.lit(0), F.col("cells") - 1)
    facts = lambda side: (F.struct("n", "id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("at", *LANES)])
    small = both.where("side = 0").withColumn("other", F.explode(cells)).select("word", "class", F.col("cell").alias("i"), F.col("other").alias("j"), *facts("s"))
    large = both.where("side = 1").withColumn("other", F.explode(cells)).select("word", "class", F.col("other").alias("i"), F.col("cell").alias("j"), *facts("l"))
    least = need(F.col("s.n"), F.col("l.n"))
    left = F.least(F.col("s.n") - F.col("s_at"), F.col("l.n") - F.col("l_at"))
    # The prefix of the larger set reaches so far behind the first common word, however little of the rest is common.
    more = F.least(F.floor(F.col("s.n") / MORE).cast("int"), least - _at_least(F.col("l.n") * threshold))
    differ = sum((F.bit_count(F.col(f"s_{k}").bitwiseXOR(F.col(f"l_{k}"))) for k in LANES), F.lit(0))
    fits = (F.col("s") < F.col("l")) & (F.col("s.n") >= _at_least(F.col("l.n") * threshold)) & (left >= least - more) & (differ <= F.col("s.n") + F.col("l.n") - 2 * least)
    met = small.join(large, ["word", "class", "i", "j"]).where(fits)
    return met.select(F.col("l.id").alias("a"), F.col("s.id").alias("b"), F.hash("word").alias("place"), more.alias("more"))


def candidate_pairs(front: DataFrame, threshold: float, cell: int = CELL) -> DataFrame:
    """(a, b, place): sets that meet as often as similar ones must, and where; a is the larger set.

    The place is a hash of a word that they meet at, the least of them, so that sets alike meet in few places.
    """
    pairs = meetings(front, threshold, cell).groupBy("a", "b").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("times"), F.min("more").alias("more"))
    return pairs.where("times > more").select("a", "b", "place")


def _compared(pairs: DataFrame, sets: DataFrame, members: int, marks: DataFrame | None = None) -> DataFrame:
    """(a, b, similarity, marked) of pairs (a, b, place); marked: their ``marks`` (id, marks) have one in common.

    A place's sets are dealt to cells of about ``members``; every two cells with a pair are compared as one row, which holds each set once.
    """
    ends = F.explode(F.array("a", "b")).alias("id")
    sized = pairs.select("place", ends).distinct().groupBy("place").agg(F.ceil(F.count(F.lit(1)) / members).cast("int").alias("cells")).where("cells > 1")
    cells = F.coalesce("cells", F.lit(1))
    at = [F.pmod(F.xxhash64(c), cells).cast("int") for c in ("a", "b")]
    dealt = pairs.join(materialize(sized, "set-places"), "place", "left")
    dealt = materialize(dealt.select("place", F.least(*at).alias("i"), F.greatest(*at).alias("j"), "a", "b"), "set-meetings")
    cell = ["place", "i", "j"]
    present = dealt.select(*cell, ends).distinct()
    needed = materialize(dealt.select(ends).distinct(), "set-ends")
    held = sets.join(needed, "id", "left_semi").groupBy("id").agg(F.collect_list("words").alias("sets"))
    if marks is None:
        held = held.withColumn("marks", F.lit(None).cast("array<int>"))
    else:
        held = held.join(marks.join(needed, "id", "left_semi"), "id", "left")
    near = present.join(held, "id").groupBy(*cell).agg(F.map_from_entries(F.collect_list(F.struct("id", F.struct("sets", "marks")))).alias("held"))
    asked = dealt.groupBy(*cell).agg(F.collect_list(F.struct("a", "b")).alias("pairs"))

    def compare(pair: Column) -> Column:
        one, other = F.element_at("held", pair["a"]), F.element_at("held", pair["b"])
        alike = F.flatten(F.transform(one["sets"], lambda x: F.transform(other["sets"], lambda y: jaccard(x, y))))
        return F.struct(pair["a"].alias("a"), pair["b"].alias("b"), alike.alias("alike"), F.coalesce(F.arrays_overlap(one["marks"], other["marks"]), F.lit(False)).alias("marked"))

    rows = asked.join(near, cell).select(F.explode(F.transform("pairs", compare)).alias("r"))
    return rows.select("r.a", "r.b", F.explode(F.slice("r.alike", 1, 2**31 - 1)).alias("similarity"), "r.marked")


def _similar(sets: DataFrame, threshold: float, cell: int = CELL, members: int = MEMBERS, marks: DataFrame | None = None) -> DataFrame:
    if not 0 < threshold <= 1:
        raise ValueError(f"a threshold above 0 and up to 1 is needed: {threshold}")
    pairs = materialize(candidate_pairs(prefixes(sets, threshold, cell), threshold, cell), "set-pairs")
    scored = _compared(pairs, sets, members, marks).where(F.col("similarity") >= threshold)
    return scored.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity", "marked")


def similar_sets(sets: DataFrame, threshold: float, cell: int = CELL, members: int = MEMBERS) -> DataFrame:
    """(a, b, similarity): all pairs of sets (id, words: distinct values) with a Jaccard similarity of at least ``threshold``; a < b.

    Every pair once. Empty sets are like nothing. Equal sets should be one row: copies of a set make all their pairs.
    ``sets`` is read three times.
    """
    return _similar(sets, threshold, cell, members).select("a", "b", "similarity")


def band_recall(sets: DataFrame, buckets: DataFrame, threshold: float) -> DataFrame:
    """One row (pairs, found, recall): how many of the similar pairs share a bucket (id, band, bucket)."""
    marks = buckets.where("band IS NOT NULL AND bucket IS NOT NULL").groupBy("id").agg(F.collect_set(F.struct("band", "bucket")).alias("marks"))
    pairs = materialize(_similar(sets, threshold, marks=marks), "similar-sets")
    shared = pairs.where("marked").select("a", "b").distinct()
    counted = pairs.agg(F.count(F.lit(1)).alias("pairs")).crossJoin(shared.agg(F.count(F.lit(1)).alias("found")))
    return counted.withColumn("recall", F.try_divide(F.col("found").cast("double"), F.col("pairs").cast("double")))
