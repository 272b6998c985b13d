"""SimHash near-duplicates: fingerprints of word shingles, linked by a binary-trie self-join, grouped by union-find."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import components, fresh, small_or_shuffled, table, text_of
from corpusloom.llm.registry import query
from corpusloom.llm.textblocks import Block, blocks, lowered
from corpusloom.session import materialize


@dataclass(frozen=True)
class Rules:
    """``cell``: fingerprints that one subtree of a trie may hold before it is cut deeper."""

    shingle: int = 3
    distance: int = 2
    seed: int = 42
    cell: int = 4096
    #: Fingerprints walked at once inside a task; bounds the list of open node pairs.
    rows: int = 32_768


def _fingerprint(block: Block, starts: np.ndarray, ends: np.ndarray, rules: Rules) -> int:
    """Fingerprint of one document, whose words have the given spans."""
    n = len(starts)
    if not n:
        return 0
    # Words joined by single spaces: word i starts where the lengths before it, and a space each, end.
    lengths = ends - starts
    joined = b" ".join(block.data[s:e].tobytes() for s, e in zip(starts.tolist(), ends.tolist()))
    stop = np.cumsum(lengths + 1) - 1
    start = stop - lengths
    k = min(rules.shingle, n)
    digest, seed = xxhash.xxh64_intdigest, rules.seed
    count, total = np.zeros(64, dtype=np.int64), n - k + 1
    begins, finals = start[:total].tolist(), stop[k - 1 :].tolist()
    for first in range(0, total, 65_536):
        pairs = zip(begins[first : first + 65_536], finals[first : first + 65_536])
        h = np.fromiter((digest(joined[a:b], seed) for a, b in pairs), dtype="<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > total, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """(doc_id, copy, bits): the 64-bit fingerprint, as a signed long, of every row's whole text; null texts are empty.

    ``copy`` is a hash of the text, which tells rows with the same id apart.
    """
    kind = df.schema[doc_id].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.zeros(batch.num_rows, dtype=np.uint64)
            for first, end, raw in blocks(batch.column("text")):
                block = lowered(raw)
                starts, ends = block.words()
                cuts = np.searchsorted(starts, block.offsets).tolist()
                for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    bits[first + i] = _fingerprint(block, starts[a:b], ends[a:b], rules)
            columns = [batch.column("doc_id"), batch.column("copy"), pa.array(bits.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "copy", "bits"])

    rows = df.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text_of(text)).alias("copy"), text_of(text).alias("text"))
    return rows.mapInArrow(hashed, f"doc_id {kind}, copy long, bits long")


def _walk(groups: np.ndarray, flips: np.ndarray, sides: np.ndarray, prints: np.ndarray, depth: int, distance: int):
    """Links (a, b) between fingerprints of the same group at up to ``distance`` bits, by walking node pairs of tries.

    A group with flip 0 holds one subtree, joined with itself; any other group joins its two subtrees (sides 0 and 1)
    and gives nothing when one of them is empty. Fingerprints of a subtree agree in their first ``depth`` bits. A node is a range of the sorted
    fingerprints. A pair of nodes takes one more bit at a time: equal bits keep the pair's difference, different
    bits raise it, and a pair over the budget is dropped with everything below it.
    """
    order = np.lexsort((prints, sides, groups))
    groups, flips, sides, prints = groups[order], flips[order], sides[order], prints[order]
    tree = np.flatnonzero(np.r_[True, (groups[1:] != groups[:-1]) | (sides[1:] != sides[:-1])])
    ends = np.r_[tree[1:], len(groups)]
    two = np.r_[groups[tree[1:]] == groups[tree[:-1]], False]  # a tree followed by the other side of its group
    single = flips[tree] == 0
    # Subtrees that differ in their prefixes carry that difference from the start.
    a = np.concatenate([tree[single], tree[two]])
    a_end = np.concatenate([ends[single], ends[two]])
    other = np.flatnonzero(two) + 1
    b, b_end = np.concatenate([tree[single], tree[other]]), np.concatenate([ends[single], ends[other]])
    top = np.uint64(64 - depth)
    diff = np.bitwise_count((prints[a] ^ prints[b]) >> top).astype(np.int8) if depth else np.zeros(len(a), np.int8)
    found_a, found_b = [], []
    for level in range(depth, 64):
        one = (a_end - a == 1) & (b_end - b == 1)
        if one.any():
            # Two single fingerprints: the rest of their difference in one step.
            x, y = prints[a[one]], prints[b[one]]
            near = (np.bitwise_count(x ^ y) <= distance) & (x != y)
            found_a.append(x[near])
            found_b.append(y[near])
            a, a_end, b, b_end, diff = a[~one], a_end[~one], b[~one], b_end[~one], diff[~one]
        if not len(a):
            break
        zero = (prints >> np.uint64(63 - level)) & np.uint64(1) == 0
        zeros = np.concatenate([[0], np.cumsum(zero)])
        a_mid, b_mid = a + zeros[a_end] - zeros[a], b + zeros[b_end] - zeros[b]
        same = a == b
        parts = [
            (a, a_mid, b, b_mid, diff),
            (a_mid, a_end, b_mid, b_end, diff),
            (a, a_mid, b_mid, b_end, diff + 1),
            (a_mid[~same], a_end[~same], b[~same], b_mid[~same], diff[~same] + 1),
        ]
        a, a_end, b, b_end, diff = (np.concatenate(column) for column in zip(*parts))
        open_ = (a < a_end) & (b < b_end) & (diff <= distance)
        a, a_end, b, b_end, diff = a[open_], a_end[open_], b[open_], b_end[open_], diff[open_]
    keep = a != b  # all 64 bits taken: fingerprints are distinct, so these differ within the budget
    found_a.append(prints[a[keep]])
    found_b.append(prints[b[keep]])
    return np.concatenate(found_a), np.concatenate(found_b)


def _blocks(distance: int) -> list[tuple[int, int]]:
    """(first bit, width) of the ``distance + 1`` blocks of a fingerprint, counted from its highest bit."""
    cuts = [round(64 * i / (distance + 1)) for i in range(distance + 2)]
    return [(i, j - i) for i, j in zip(cuts, cuts[1:])]


#: Bits by which the tries of a crowded block are cut deeper, at most.
_DEEPEST = 12


def near_links(prints: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(a, b): distinct fingerprints (column ``bits``) at most ``rules.distance`` bits apart; each pair once.

    As many differing bits leave one of ``rules.distance + 1`` blocks equal. Each block is turned to the top of the fingerprint, as
    the first levels of a trie, so a fingerprint is copied once a block, however many there are; fingerprints with an equal
    block are one subtree, which a task joins with itself. A block that more than ``rules.cell`` share is cut deeper: every
    pair of its nodes within the budget becomes a group of its own.
    """
    blocks = _blocks(rules.distance)

    def turned(first: int) -> Column:
        return F.expr(f"shiftleft(bits, {first}) | shiftrightunsigned(bits, {64 - first})" if first else "bits")

    tops = [F.struct(F.lit(i).alias("block"), turned(first).alias("turned"), F.shiftrightunsigned(turned(first), 64 - w).alias("top")) for i, (first, w) in enumerate(blocks)]
    spread = prints.select(F.explode(F.array(*tops)).alias("t")).select("t.*")
    extra = F.least(F.ceil(F.log2(F.col("n") / rules.cell)).cast("int"), F.lit(_DEEPEST)).alias("extra")
    crowded = spread.groupBy("block", "top").agg(F.count("*").alias("n")).where(F.col("n") > rules.cell).select("block", "top", extra)
    crowded = materialize(crowded, "simhash-crowded")
    if crowded.isEmpty():
        deepened = spread.withColumn("extra", F.lit(0))
    else:
        deepened = spread.join(crowded, ["block", "top"], "left").withColumn("extra", F.coalesce("extra", F.lit(0)))
    flips = F.array(F.lit(0).cast("long"))
    for e in range(1, _DEEPEST + 1):
        changes = [sum(1 << bit for bit in bits) for k in range(min(rules.distance, e) + 1) for bits in combinations(range(e), k)]
        flips = F.when(F.col("extra") == e, F.array(*[F.lit(f).cast("long") for f in changes])).otherwise(flips)
    widths = F.array(*[F.lit(w) for _, w in blocks])
    own = F.expr("shiftrightunsigned(turned, 64 - depth)")
    copies = deepened.withColumn("depth", F.get(widths, F.col("block")) + F.col("extra")).withColumn("flip", F.explode(flips)).withColumn("own", own)
    other = F.col("own").bitwiseXOR(F.col("flip"))
    group = ["block", "depth", "low", "flip"]
    copies = copies.select("block", "depth", F.least("own", other).alias("low"), "flip", (F.col("own") > other).cast("byte").alias("side"), "turned")
    dealt = copies.repartition(*group).sortWithinPartitions(*group)

    def walked(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Links of whole groups, which lie in runs of the same block and depth."""
        block, depth, low, flip, side, bits = columns
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in (block, depth, low, flip)], axis=0)) + 1
        group = np.zeros(len(low), np.int64)
        group[new] = 1
        group = np.cumsum(group)
        kinds = np.concatenate([[0], np.flatnonzero((block[1:] != block[:-1]) | (depth[1:] != depth[:-1])) + 1, [len(low)]])
        borders = np.concatenate([[0], new, [len(low)]])
        for start, end in zip(kinds.tolist(), kinds[1:].tolist()):
            mine = borders[(borders >= start) & (borders <= end)]
            first = 0
            while first < len(mine) - 1:
                # Groups go in runs of about ``rules.rows`` fingerprints.
                last = max(first + 1, int(np.searchsorted(mine, mine[first] + rules.rows, side="right")) - 1)
                x = slice(mine[first], mine[last])
                first = last
                a, b = _walk(group[x], flip[x], side[x], bits[x].view(np.uint64), int(depth[start]), rules.distance)
                turn = blocks[int(block[start])][0]
                if turn:
                    a, b = (v >> np.uint64(turn) | v << np.uint64(64 - turn) for v in (a, b))
                # A pair with an earlier equal block was found there.
                fresh = np.ones(len(a), dtype=bool)
                for f, w in blocks[: int(block[start])]:
                    fresh &= ((a ^ b) >> np.uint64(64 - f - w)) & np.uint64((1 << w) - 1) != 0
                if fresh.any():
                    yield pa.RecordBatch.from_arrays([pa.array(v[fresh].view(np.int64)) for v in (a, b)], names=["a", "b"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            size += batch.num_rows
            if size >= 4 * rules.rows:
                columns = [np.concatenate(x) for x in zip(*held)]
                # The last group may go on in the next batch.
                change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns[:4]], axis=0)) + 1
                cut = int(change[-1]) if len(change) else 0
                if cut:
                    yield from walked([c[:cut] for c in columns])
                held, size = [[c[cut:] for c in columns]], size - cut
        if size:
            yield from walked([np.concatenate(x) for x in zip(*held)])

    return dealt.select(*group, "side", "turned").mapInArrow(walk, "a long, b long")


def simhash_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """(doc_id, copy, fingerprint, component_id): one row per input row; ``copy`` is a hash of the text.

    Rows with equal fingerprints are one node of the trie however often they occur, so a group of copies costs its
    members' ids only. ``component_id`` is the smallest id of all rows reachable over links, null ids left out of the
    minimum (null when a component has only null ids). Rows without words have fingerprint zero, linked like any
    other. Repeated ids and rows keep their own rows; other columns are not read.
    """
    rows = materialize(fingerprints(df, doc_id, text, rules), "fingerprints")
    nodes = rows.groupBy("bits").agg(F.min("doc_id").alias("first"))
    links = near_links(nodes.select("bits"), rules)
    roots = components(links, "simhash").toDF("bits", "root")
    nodes = nodes.join(roots, "bits", "left").withColumn("root", F.coalesce("root", "bits"))
    # A root's smallest id comes from one aggregate; a hot fingerprint is a single row here.
    least = nodes.groupBy("root").agg(F.min("first").alias("component_id"))
    groups = nodes.join(least, "root").select("bits", "component_id")
    named = F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint")
    return rows.join(groups, "bits").select("doc_id", "copy", named, "component_id")


def near_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The rows of ``df`` whose id is the smallest of their component, with all their columns.

    Of rows that repeat both id and text one stays. Rows with a null id stay only when their component has no other id.
    """
    groups = materialize(simhash_groups(df, doc_id, text, rules), "simhash-groups")
    name, copy = fresh(df, "id", "copy")
    same = F.col(doc_id).eqNullSafe(F.col(name)) & (F.xxhash64(text_of(text)) == F.col(copy))
    pairs = groups.select(F.col("doc_id").alias(name), F.col("copy").alias(copy), (~F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("later"))
    later = materialize(pairs.where("later").drop("later").distinct(), "later-ids")
    kept = df.join(small_or_shuffled(later), same, "left_anti")
    # Only rows that repeat need to meet; all others are told by their id and a hash alone.
    often = materialize(pairs.groupBy(name, copy).count().where("count > 1").drop("count"), "repeated-rows")
    if often.isEmpty():
        return kept
    often = small_or_shuffled(often)
    once = kept.join(often, same, "left_semi").dropDuplicates([doc_id, text])
    return kept.join(often, same, "left_anti").unionByName(once)


@query("op7_simhash")
def op7_simhash(spark, sf_dir):
    return simhash_groups(table(spark, sf_dir, "documents")).drop("copy")
