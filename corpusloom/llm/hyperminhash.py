"""Near-duplicates by HyperMinHash: compressed MinHash registers, banded, estimated with a correction, then verified."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import bit_filter, components, fresh, passing, small_or_shuffled, table, text_of
from corpusloom.llm.registry import query
from corpusloom.llm.textblocks import Block, blocks, lowered, mix
from corpusloom.session import materialize

_U = np.uint64


@dataclass(frozen=True)
class Rules:
    """Sets of ``shingle`` words are linked when 100 * intersection >= ``percent`` * union.

    A set has ``bands`` * ``rows`` registers of 6 bits for leading zeros and ``mantissa`` bits. Two sets at a
    similarity of 0.8 meet in one of 32 bands of 4 with probability 1 - (1 - 0.8^4)^32 = 1 - 5e-8.
    """

    shingle: int = 2
    percent: int = 80
    bands: int = 32
    rows: int = 4
    mantissa: int = 10
    #: A pair goes on to the exact check unless its estimate is so many standard errors below the similarity asked for.
    errors: float = 6.0
    #: Smaller sets fill few registers, so that their estimates are not relied on.
    least: int = 64
    #: Sets, and words in them, that a cell of a large group holds.
    cell: int = 2048
    cell_words: int = 1 << 21
    #: Pairs with the same head that one task gets.
    part: int = 4096

    @property
    def registers(self) -> int:
        return self.bands * self.rows


# --- sets, registers and bands of a block of documents --------------------------------------------------------------


def shingle_sets(block: Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the distinct shingles of every document as rising 64-bit hashes.

    Words are runs without blanks in lower case. A document of fewer than ``k`` words has the whole sequence as its shingle.
    """
    block = lowered(block)
    starts, ends = block.words()
    doc, word = block.doc_of(starts), block.hashes(starts, ends)
    count = np.bincount(doc, minlength=len(block))
    first = np.cumsum(count) - count
    rolled = np.zeros(max(0, len(word) - k + 1), dtype=_U)
    for i in range(k):
        rolled = mix(rolled * _U(0x9FB21C651E98DF25) + word[i : i + len(rolled)] + _U(1))
    inside = doc[: len(rolled)] == doc[k - 1 :]
    few = np.flatnonzero((count > 0) & (count < k))
    whole = np.zeros(len(few), dtype=_U)
    for i in range(k - 1):
        more = count[few] > i
        whole[more] = mix(whole[more] * _U(0x9FB21C651E98DF25) + word[first[few[more]] + i] + _U(1))
    doc, key = np.concatenate([doc[: len(rolled)][inside], few]), np.concatenate([rolled[inside], mix(whole + _U(k))])
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
    return key[new], np.searchsorted(doc[new], np.arange(len(block) + 1))


def registers(hashes: np.ndarray, offsets: np.ndarray, rules: Rules) -> np.ndarray:
    """sets x registers, as uint16: of the least hash in each bucket, its leading zeros and the bits that follow them.

    The upper bits of a hash choose its bucket. Hashes rise inside a set, so the first one in a bucket is the least. An empty
    bucket takes the register that a walk, the same for all sets, finds first. Empty sets have zeros.
    """
    n, size = len(offsets) - 1, rules.registers
    owner = np.repeat(np.arange(n), np.diff(offsets))
    bucket = ((hashes >> _U(32)) * _U(size) >> _U(32)).astype(np.int64)
    place = owner * size + bucket
    first = np.ones(len(place), dtype=bool)
    first[1:] = place[1:] != place[:-1]
    # Another 53 bits, spread evenly inside the bucket: the position of the hash among those of the bucket.
    inside = (hashes[first] * _U(size)) >> _U(11)
    fraction, exponent = np.frexp(inside.astype(np.float64))
    bits = 1 << rules.mantissa
    zeros = np.minimum(53 - exponent, 62)
    value = (zeros + 1) * bits + ((2 * fraction - 1) * bits).astype(np.int64)
    value[inside == 0] = 63 * bits
    known = np.zeros(n * size, dtype=np.uint16)
    known[place[first]] = value
    out = known.copy()
    filled = np.repeat(np.diff(offsets) > 0, size)
    gaps = np.flatnonzero((known == 0) & filled)
    attempt = 1
    while len(gaps):
        probe = (mix((gaps % size).astype(_U) * _U(1000003) + _U(attempt)) % _U(size)).astype(np.int64)
        out[gaps] = known[gaps // size * size + probe]
        gaps = gaps[out[gaps] == 0]
        attempt += 1
    return out.reshape(n, size)


def band_hashes(regs: np.ndarray, rules: Rules) -> np.ndarray:
    """sets x bands: a hash of the registers of each band."""
    parts = regs.reshape(len(regs), rules.bands, rules.rows).astype(_U)
    out = np.broadcast_to(np.arange(1, rules.bands + 1, dtype=_U) * _U(0xD6E8FEB86659FD93), (len(regs), rules.bands)).copy()
    for r in range(rules.rows):
        out = mix(out * _U(0x9E3779B97F4A7C15) + parts[:, :, r])
    return out.view(np.int64)


def chance(n: np.ndarray, m: np.ndarray, rules: Rules) -> np.ndarray:
    """Probability that a register agrees by chance for disjoint sets of sizes n and m.

    Minima in a bucket have densities a exp(-a x) and b exp(-b x), with a and b elements to a bucket. Values agree when both fall
    into the same of 2^mantissa cells of the same power of two; summed over all cells that is
    2^-mantissa * ab / (a+b)^2 * sum of y (exp(-y) - exp(-2y)) over y = (a+b) / 2, (a+b) / 4, and so on.
    """
    a, b = np.maximum(n / rules.registers, 1.0), np.maximum(m / rules.registers, 1.0)
    total = np.zeros(np.broadcast(a, b).shape)
    y = (a + b) / 2
    for _ in range(64):
        total += y * (np.exp(-y) - np.exp(-2 * y))
        y = y / 2
    return a * b / (a + b) ** 2 * total / (1 << rules.mantissa)


def likely(equal: np.ndarray, n: np.ndarray, m: np.ndarray, rules: Rules) -> np.ndarray:
    """Which pairs may be linked: sizes allow it, and so does the Jaccard estimate, corrected for agreement by chance.

    ``equal`` registers of all agree. Agreement by chance adds (1 - J) * chance to the share that J predicts, so
    only pairs that pass without the correction need it.
    """
    small, large = np.minimum(n, m), np.maximum(n, m)
    j = rules.percent / 100
    enough = j - rules.errors * np.sqrt(j * (1 - j) / rules.registers)
    share = equal / rules.registers
    out = (100 * small >= rules.percent * large) & ((share >= enough) | (small < rules.least))
    at = np.nonzero(out & (small >= rules.least))
    c = chance(small[at], large[at], rules)
    out[at] = (share[at] - c) / (1 - c) >= enough
    return out


def linked(a: np.ndarray, b: np.ndarray, rules: Rules) -> bool:
    """The exact check of two sets of rising hashes."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= rules.percent * (len(both) - shared)


# --- distributed steps ----------------------------------------------------------------------------------------------


def signatures(rows: DataFrame, rules: Rules) -> DataFrame:
    """(doc_id, copy, n, key, proof, regs) for rows (doc_id, copy, text): equal sets have equal keys and proofs.

    Two hashes of 64 bits, sums over the set, stand for it; ``regs`` is null for empty sets.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, block in blocks(batch.column("text")):
                hashes, offsets = shingle_sets(block, rules.shingle)
                n = np.diff(offsets)
                sums = [np.concatenate([[_U(0)], np.cumsum(h, dtype=_U)]) for h in (mix(hashes), mix(hashes + _U(0x9E3779B97F4A7C15)))]
                key, proof = (mix(s[offsets[1:]] - s[offsets[:-1]] + n.astype(_U)).view(np.int64) for s in sums)
                regs = registers(hashes, offsets, rules)
                packed = pa.array([r.tobytes() if k else None for r, k in zip(regs, n.tolist())], pa.binary())
                columns = [batch.column(c).slice(first, end - first) for c in ("doc_id", "copy")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n), pa.array(key), pa.array(proof), packed], names=["doc_id", "copy", "n", "key", "proof", "regs"])

    return rows.mapInArrow(scan, f"doc_id {kind}, copy long, n long, key long, proof long, regs binary")


def full_sets(keys: DataFrame, nodes: DataFrame, rows: DataFrame, rules: Rules) -> DataFrame:
    """(key, words): the full sets, as rising hashes of 8 bytes, of the keys (column ``key``).

    A set is read again from the texts with the copy hash that its node names; other texts are passed by.
    """
    asked = materialize(keys.distinct().join(nodes.select("key", "copy"), "key"), "hyper-asked")
    wanted = asked.select("copy").distinct()
    shared = rows.sparkSession.sparkContext.broadcast(bit_filter(wanted.withColumnRenamed("copy", "key")))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            copies = batch.column("copy").to_numpy()
            there = passing(shared.value, copies.view(_U))
            # A text that this task sees again is not read again, as long as few are remembered.
            there = [i for i, c in zip(there.tolist(), copies[there].tolist()) if c not in seen and (seen.add(c) or True)]
            if len(seen) > 100_000:
                seen.clear()
            batch = batch.take(pa.array(there, pa.int64()))
            for first, end, block in blocks(batch.column("text")):
                hashes, offsets = shingle_sets(block, rules.shingle)
                sets = [hashes[a:b].tobytes() for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column("copy").slice(first, end - first), pa.array(sets, pa.binary())], names=["copy", "words"])

    found = rows.select("copy", "text").mapInArrow(scan, "copy long, words binary").join(wanted, "copy", "left_semi")
    once = found.groupBy("copy").agg(F.min("words").alias("words"))
    return materialize(asked.join(once, "copy").select("key", "words"), "hyper-sets")


def _banded(nodes: DataFrame, rules: Rules) -> DataFrame:
    """(key, bucket) for every band of every set."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = band_hashes(_registers(batch.column("regs"), rules), rules)
            keys = np.repeat(batch.column("key").to_numpy(), rules.bands)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(hashes.ravel())], names=["key", "bucket"])

    return nodes.select("key", "regs").mapInArrow(cut, "key long, bucket long")


def _registers(column: pa.Array, rules: Rules) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, rules.registers)


def bucket_pairs(nodes: DataFrame, rules: Rules) -> DataFrame:
    """(head, key): every set of a bucket with another one, next to the bucket's least key; each pair once.

    A bucket's least and greatest key and its size come from one aggregate with map-side minima. Most buckets hold one
    set, and of the others most hold two, which are a pair already; only sets of larger ones meet their head in a join.
    """
    banded = _banded(nodes, rules)
    heads = banded.groupBy("bucket").agg(F.min("key").alias("head"), F.max("key").alias("last"), F.count("*").alias("size"))
    heads = materialize(heads.where("size > 1"), "hyper-heads")
    larger = heads.where("size > 2")
    shared = nodes.sparkSession.sparkContext.broadcast(bit_filter(larger.select(F.col("bucket").alias("key"))))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.take(pa.array(passing(shared.value, batch.column("bucket").to_numpy().view(_U))))

    members = banded.mapInArrow(pick, "key long, bucket long").join(larger.select("bucket", "head"), "bucket").where("key <> head")
    return heads.select("head", F.col("last").alias("key")).union(members.select("head", "key")).distinct()


def _likely_pairs(pairs: DataFrame, nodes: DataFrame, rules: Rules) -> DataFrame:
    """The pairs (head, key) whose registers and sizes allow a link."""
    sides = _spread(pairs, nodes.select("key", "n", "regs"), rules)
    other = nodes.select("key", F.col("n").alias("m"), F.col("regs").alias("other"))
    both = sides.join(other, "key").select("head", "key", "n", "m", "regs", "other")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            equal = (_registers(batch.column("regs"), rules) == _registers(batch.column("other"), rules)).sum(axis=1)
            yes = likely(equal, batch.column("n").to_numpy(), batch.column("m").to_numpy(), rules)
            yield batch.select(["head", "key"]).filter(pa.array(yes))

    return both.mapInArrow(judge, "head long, key long")


def _spread(pairs: DataFrame, values: DataFrame, rules: Rules) -> DataFrame:
    """``pairs`` with the head's row of ``values``; a head with many pairs is copied, so that no task gets them all."""
    hot = pairs.groupBy("head").agg(F.ceil(F.count("*") / rules.part).cast("int").alias("parts")).where("parts > 1")
    hot = materialize(hot, "hyper-hot")
    renamed = values.withColumnRenamed("key", "head")
    if hot.isEmpty():
        return pairs.join(renamed, "head")
    hot = small_or_shuffled(hot)
    dealt = pairs.join(hot, "head", "left").withColumn("part", F.pmod(F.xxhash64("key"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    copies = renamed.join(hot, "head", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return dealt.join(copies, ["head", "part"]).drop("part")


def _verified(pairs: DataFrame, sets: DataFrame, rules: Rules) -> DataFrame:
    """The links (a, b): pairs (head, key) that pass the exact check on their full sets."""
    other = sets.withColumnRenamed("words", "other")
    both = _spread(pairs, sets, rules).join(other, "key").select("head", "key", "words", "other")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("words"), batch.column("other")
            yes = [linked(_hashes(x), _hashes(y), rules) for x, y in zip(a, b)]
            yield pa.RecordBatch.from_arrays(batch.select(["head", "key"]).columns, names=["a", "b"]).filter(pa.array(yes, pa.bool_()))

    return both.mapInArrow(check, "a long, b long")


def _hashes(value: pa.BinaryScalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), dtype=_U)


def _cells(groups: DataFrame, sized: DataFrame) -> DataFrame:
    """The rows (head, key, ...) of ``groups``, dealt to cells, once for every pair (i, j) of cells theirs is part of."""
    dealt = groups.join(sized, "head").withColumn("cell", F.pmod(F.xxhash64("key"), F.col("cells")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("cells") - 1), lambda o: F.struct(F.least("cell", o).alias("i"), F.greatest("cell", o).alias("j")))
    return dealt.withColumn("pair", F.explode(pairs)).select("head", "pair.i", "pair.j", *[c for c in dealt.columns if c not in ("head", "cells")])


def _by_cells(rows: DataFrame, judge: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """``judge`` of the rows of every pair of cells (head, i, j)."""
    group = ("head", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            place = [batch.column(c).to_numpy() for c in group]
            borders = np.flatnonzero(np.any([p[1:] != p[:-1] for p in place], axis=0)) + 1
            cuts = [0, *borders.tolist(), batch.num_rows]
            for first, end in zip(cuts, cuts[1:]):
                if held and any(held[0].column(c)[0] != batch.column(c)[first] for c in group):
                    yield judge(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(first, end - first))
        if held:
            yield judge(pa.Table.from_batches(held))

    dealt = rows.repartition(*group).sortWithinPartitions(*group)
    return dealt.mapInArrow(run, schema)


def _candidates(group: pa.Table, rules: Rules) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (x, y), most alike first, of the likely pairs between cells i and j whose sets have different roots."""
    cell, root, n = (group.column(c).to_numpy() for c in ("cell", "root", "n"))
    i, j = (group.column(c)[0].as_py() for c in ("i", "j"))
    left, right = np.flatnonzero(cell == i), np.flatnonzero(cell == j)
    regs = _registers(group.column("regs"), rules)
    found = []
    for k, x in enumerate(left.tolist()):
        other = right[k + 1 :] if i == j else right
        other = other[root[other] != root[x]]
        equal = (regs[other] == regs[x]).sum(axis=1)
        yes = likely(equal, n[other], np.full(len(other), n[x]), rules)
        found.append((np.full(yes.sum(), x), other[yes], equal[yes]))
    x, y, equal = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    best = np.argsort(-equal, kind="stable")
    return x[best], y[best]


def grid_links(groups: DataFrame, nodes: DataFrame, rows: DataFrame, rules: Rules) -> DataFrame:
    """Links (a, b) inside the groups (head, key, root) that hold several roots.

    The sets of a group are dealt to cells of bounded size, and every two cells meet in a task. First registers alone meet, which
    leaves the sets that have a likely partner; these come with their full sets then. A task gives as
    many links at most as join its sets, never the pairs it compares.
    """
    sized = groups.join(nodes.select("key", "n"), "key").groupBy("head").agg(
        F.greatest(F.ceil(F.count("*") / rules.cell), F.ceil(F.sum("n") / rules.cell_words)).cast("int").alias("cells"),
        F.min("root").alias("low"), F.max("root").alias("high"),
    )
    sized = materialize(sized.where("low <> high").select("head", "cells"), "hyper-cells")
    met = materialize(_cells(groups, sized).join(nodes.select("key", "n", "regs"), "key"), "hyper-grid")
    columns = ["head", "i", "j", "cell", "key", "root", "n", "regs"]

    def hopeful(group: pa.Table) -> pa.RecordBatch:
        x, y = _candidates(group, rules)
        chosen = group.take(pa.array(np.unique(np.concatenate([x, y])))).select(["head", "i", "j", "key"])
        return chosen.combine_chunks().to_batches()[0] if chosen.num_rows else pa.RecordBatch.from_pylist([], schema=_HOPEFUL)

    some = materialize(_by_cells(met.select(*columns), hopeful, "head long, i int, j int, key long"), "hyper-hopeful")
    sets = full_sets(some.select("key"), nodes, rows, rules)
    wide = met.join(some, ["head", "i", "j", "key"], "left_semi").join(sets, "key")

    def join(group: pa.Table) -> pa.RecordBatch:
        parent = {r: r for r in group.column("root").to_pylist()}

        def find(r):
            while parent[r] != r:
                parent[r] = parent[parent[r]]
                r = parent[r]
            return r

        key, root, words = (group.column(c) for c in ("key", "root", "words"))
        root = root.to_pylist()
        found = []
        for x, y in zip(*(c.tolist() for c in _candidates(group, rules))):
            a, b = find(root[x]), find(root[y])
            if a != b and linked(_hashes(words[x]), _hashes(words[y]), rules):
                parent[max(a, b)] = min(a, b)
                found.append((key[x].as_py(), key[y].as_py()))
        a, b = zip(*found) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return _by_cells(wide.select(*columns, "words"), join, "a long, b long")


_HOPEFUL = pa.schema([("head", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("key", pa.int64())])


def near_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """(doc_id, copy, n_shingles, component_id, kept): one row per row of ``df``; ``copy`` is a hash of the text.

    Null and empty texts, and texts without words, have an empty set and are linked with nothing, so each such row is
    its own component. Rows with equal sets are one node however often they occur. ``component_id`` is the smallest id of
    all rows reachable over links, null ids left out (null when there are only null ids); ``kept`` says whether the
    row's id is that one. Repeated ids and rows keep their own rows; other columns are not read.
    """
    rows = df.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text_of(text)).alias("copy"), text_of(text).alias("text"))
    signed = materialize(signatures(rows, rules), "hyper-signatures")
    filled = signed.where("n > 0")
    # Equal sets collapse. Of a key shared by different sets, if ever, the least proof's rows stand for it.
    least = F.min(F.struct("proof", "doc_id", "copy", "n", "regs")).alias("first")
    nodes = materialize(filled.groupBy("key").agg(least).select("key", "first.*"), "hyper-nodes")
    pairs = materialize(bucket_pairs(nodes, rules), "hyper-pairs")
    near = materialize(_likely_pairs(pairs, nodes, rules), "hyper-likely")

    sets = full_sets(near.select(F.explode(F.array("head", "key")).alias("key")), nodes, rows, rules)
    links = materialize(_verified(near, sets, rules), "hyper-links")
    labels = components(links, "hyper")

    # Where the sets next to one head have several roots after that, they are compared among themselves.
    groups = pairs.join(labels.toDF("key", "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    open_ = groups.groupBy("head").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("head")
    groups = materialize(groups.join(open_, "head", "left_semi"), "hyper-groups")
    if not groups.isEmpty():
        more = materialize(grid_links(groups, nodes, rows, rules), "hyper-more")
        labels = components(links.union(more), "hyper")

    named = nodes.join(labels.toDF("key", "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_key = named.join(smallest, "root").select("key", F.col("proof").alias("known"), "component_id")
    met = filled.drop("regs").join(by_key, "key").withColumn("component_id", F.when(F.col("proof") == F.col("known"), F.col("component_id")).otherwise(F.col("doc_id")))
    alone = signed.where("n = 0").withColumn("component_id", F.col("doc_id"))
    both = met.select("doc_id", "copy", "n", "component_id").union(alone.select("doc_id", "copy", "n", "component_id"))
    return both.select("doc_id", "copy", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def near_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The rows of ``df`` that ``near_groups`` keeps, with all their columns; of rows that repeat id and text all stay."""
    name, copy = fresh(df, "id", "copy")
    gone = near_groups(df, doc_id, text, rules).where("NOT kept").select(F.col("doc_id").alias(name), F.col("copy").alias(copy)).distinct()
    gone = small_or_shuffled(materialize(gone, "hyper-gone"))
    return df.join(gone, F.col(doc_id).eqNullSafe(F.col(name)) & (F.xxhash64(text_of(text)) == F.col(copy)), "left_anti")


SQL = """WITH RECURSIVE
split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g
  FROM split WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id < b.doc_id JOIN sizes na ON na.doc_id = a.doc_id JOIN sizes nb ON nb.doc_id = b.doc_id
  WHERE 100 * least(na.n, nb.n) >= 80 * greatest(na.n, nb.n)
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
ends AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT x, y FROM ends UNION SELECT reach.x, ends.y FROM reach JOIN ends ON reach.y = ends.x),
least_id AS (SELECT x AS doc_id, least(x, min(y)) AS component_id FROM reach GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept
FROM split LEFT JOIN sizes USING (doc_id) LEFT JOIN least_id USING (doc_id)"""


@query("op12_hyperminhash", SQL)
def op12_hyperminhash(spark, sf_dir):
    return near_groups(table(spark, sf_dir, "documents")).drop("copy")
