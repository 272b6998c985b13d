"""Fuzzy line dedup: MinHash of character shingles, banding, exact Jaccard verification, distributed union-find.

A line is its text without the blanks around it; a line shorter than a shingle is its own only shingle. Lines travel
as 64-bit keys; texts are fetched for candidates only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import bit_filter, components, fresh, passing, table, text_of
from corpusloom.llm.registry import query
from corpusloom.llm.textblocks import Block, blocks, mix
from corpusloom.session import materialize

_U = np.uint64

#: Bytes of text that the scans handle at once: the arrays made of them, of 8 bytes for each, fit the CPU's cache.
SCAN_BYTES = 1 << 17


@dataclass(frozen=True)
class Rules:
    """``bands`` times ``rows`` MinHash values. At a similarity of 0.8 a pair meets in one of 12 bands of 4 with
    probability 1 - (1 - 0.8^4)^12 = 0.998. With shingles of 8, one changed character is found from 79 characters on.
    """

    shingle: int = 8
    similarity: float = 0.8
    bands: int = 12
    rows: int = 4
    #: Members of a bucket that one task compares with as many others.
    cell: int = 512
    #: Characters of lines held as sets of shingles at a time.
    cell_chars: int = 1 << 19


def line_spans(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, line number, start, end) of the lines with a word, without the blanks around them, in bytes."""
    starts, ends = block.words()
    breaks = np.flatnonzero(block.data == 0x0A)
    doc = block.doc_of(starts)
    number = np.searchsorted(breaks, starts) - np.searchsorted(breaks, block.offsets[:-1])[doc]
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (number[1:] != number[:-1])
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(starts)] - 1 if len(first) else first
    return doc[first], number[first], starts[first], ends[last]


def _shingles(block: Block, starts: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of every shingle, line of every shingle, shingles per line); spans are byte positions."""
    begin, end = _places(block, starts), _places(block, ends)
    rolled, n = _rolled(_mixed_chars(block), k), end - begin - k + 1
    # Lines don't overlap, so a step up where one begins and a step down behind its last shingle mark them all.
    inside = np.zeros(len(rolled) + 1, dtype=np.int8)
    inside[begin] += 1
    inside[begin + n] -= 1
    held = rolled[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
    return mix(held), np.repeat(np.arange(len(n)), n), n


def _places(block: Block, positions: np.ndarray) -> np.ndarray:
    """Byte positions, where characters begin, as numbers of characters."""
    later = np.flatnonzero((block.data & 0xC0) == 0x80)
    return positions - np.searchsorted(later, positions)


def _mixed_chars(block: Block) -> np.ndarray:
    """A 64-bit value of every character."""
    known = _CHARS[block.data] if len(block.data) == 0 or block.data.max() < 0x80 else None
    if known is None:
        chars = np.frombuffer(block.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype="<u4")
        known = _CHARS[chars] if chars.max() < len(_CHARS) else mix(chars.astype(_U) + _U(1))
    return known


_CHARS = mix(np.arange(1, (1 << 14) + 1, dtype=_U))


def _rolled(chars: np.ndarray, k: int) -> np.ndarray:
    """A hash of every ``k`` neighbours, from hashes of halves."""
    if k == 1:
        return chars
    half = _rolled(chars, k // 2)
    size = max(0, len(chars) - 2 * (k // 2) + 1)
    base = pow(0x9E3779B97F4A7C15, k // 2, 1 << 64)
    both = half[:size] * _U(base)
    both += half[k // 2 : k // 2 + size]
    if k % 2 == 0:
        return both
    size = max(0, len(chars) - k + 1)
    return both[:size] * _U(0x9E3779B97F4A7C15) + chars[k - 1 : k - 1 + size]


def signatures(hashes: np.ndarray, line: np.ndarray, n_lines: int, size: int) -> np.ndarray:
    """One-permutation MinHash, lines x ``size``: the shingles fall into bins, a bin keeps its least value.

    An empty bin borrows from the bins a fixed walk leads to, the same walk in every line, until one is filled.
    """
    empty = np.uint32(0xFFFFFFFF)
    sig = np.full(n_lines * size, empty, dtype=np.uint32)
    bin_ = ((hashes >> _U(32)) * _U(size) >> _U(32)).astype(np.int64)
    np.minimum.at(sig, line * size + bin_, (hashes & _U(0xFFFFFFFE)).astype(np.uint32))
    out = sig.copy()
    gaps = np.flatnonzero(sig == empty)
    attempt = 1
    while len(gaps):
        probe = (mix((gaps % size).astype(_U) * _U(1000003) + _U(attempt)) % _U(size)).astype(np.int64)
        out[gaps] = sig[gaps // size * size + probe]
        gaps = gaps[out[gaps] == empty]
        attempt += 1
    return out.reshape(n_lines, size)


def _bands(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = sig.reshape(len(sig), bands, rows).astype(_U)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=_U) * _U(0xD6E8FEB86659FD93), (len(sig), bands)).copy()
    for r in range(rows):
        out = mix(out * _U(0x9E3779B97F4A7C15) + parts[:, :, r])
    return out.view(np.int64)


def _long(block: Block, starts: np.ndarray, ends: np.ndarray, rules: Rules) -> np.ndarray:
    """Which of the spans hold a shingle; the others are alike to their equals only."""
    return _places(block, ends) - _places(block, starts) >= rules.shingle


def line_table(docs: DataFrame, rules: Rules) -> DataFrame:
    """(doc_id, copy, line, key, proof, bands) of all lines with a word; equal lines have equal keys and proofs.

    ``bands`` is null where the task has given the line's bands already, and for lines without a shingle.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for first, _, block in blocks(batch.column("text"), SCAN_BYTES):
                doc, number, starts, ends = line_spans(block)
                if not len(doc):
                    continue
                key = block.hashes(starts, ends).view(np.int64)
                proof = block.hashes(starts, ends, other=True)
                new = _long(block, starts, ends, rules)
                new[new] = [k not in seen and (seen.add(k) or True) for k in key[new].tolist()]
                if len(seen) > 100_000:
                    seen.clear()
                bands = np.zeros((len(doc), rules.bands), dtype=np.int64)
                if new.any():
                    hashes, line, n = _shingles(block, starts[new], ends[new], rules.shingle)
                    bands[new] = _bands(signatures(hashes, line, len(n), rules.bands * rules.rows), rules.bands, rules.rows)
                offsets = pa.array(np.arange(0, bands.size + 1, rules.bands, dtype=np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(bands.ravel()), mask=pa.array(~new))
                rows = pa.array(first + doc)
                columns = [batch.column(c).take(rows) for c in ("doc_id", "copy")]
                more = [pa.array(number), pa.array(key), pa.array(proof.view(np.int64)), lists]
                yield pa.RecordBatch.from_arrays([*columns, *more], names=["doc_id", "copy", "line", "key", "proof", "bands"])

    return docs.mapInArrow(scan, f"doc_id {kind}, copy long, line long, key long, proof long, bands array<long>")


def line_texts(docs: DataFrame, keys: DataFrame, rules: Rules) -> DataFrame:
    """(key, chars): the texts of the lines with the given keys (column ``key``)."""
    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(keys))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, seen = shared.value, set()
        for batch in batches:
            for _, _, block in blocks(batch.column("text"), SCAN_BYTES):
                _, _, starts, ends = line_spans(block)
                key = block.hashes(starts, ends)
                hit = passing(wanted, key)
                # A line that this task sees again is not sent again, as long as few are remembered.
                hit = [i for i, k in zip(hit.tolist(), key[hit].tolist()) if k not in seen and (seen.add(k) or True)]
                if len(seen) > 100_000:
                    seen.clear()
                texts = [block.data[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(starts[hit].tolist(), ends[hit].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(key[hit].view(np.int64)), pa.array(texts, pa.string())], names=["key", "chars"])

    found = docs.select("text").mapInArrow(scan, "key long, chars string")
    return found.join(keys, "key", "left_semi").groupBy("key").agg(F.min("chars").alias("chars"))


def shingle_set(text: str, k: int) -> frozenset[str]:
    return frozenset(text[i : i + k] for i in range(max(1, len(text) - k + 1)))


def packed_shingles(text: str, k: int) -> np.ndarray | None:
    """The distinct shingles as sorted numbers of a byte per character; None where a shingle has no room in one, or is short."""
    try:
        raw = text.encode("latin-1") + bytes(max(0, 8 - k)) if k <= len(text) and k <= 8 else None
    except UnicodeEncodeError:
        raw = None
    if raw is None:
        return None
    held = np.sort(np.ndarray(len(text) - k + 1, dtype="<u8", buffer=raw, strides=(1,)) & _U((1 << 8 * k) - 1))
    new = np.ones(len(held), dtype=bool)
    np.not_equal(held[1:], held[:-1], out=new[1:])
    return held[new]


def packed_alike(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """``alike`` of packed shingles."""
    small, large = (len(a), len(b)) if len(a) < len(b) else (len(b), len(a))
    if small < least * large:
        return False
    held = np.concatenate([a, b])
    held.sort()
    both = int(np.count_nonzero(held[1:] == held[:-1]))
    return both >= least * (small + large - both)


def alike(a: frozenset[str], b: frozenset[str], least: float) -> bool:
    """Whether the Jaccard similarity reaches ``least``; sets of very different sizes are told apart by size alone."""
    small, large = (len(a), len(b)) if len(a) < len(b) else (len(b), len(a))
    if small < least * large:
        return False
    both = len(a & b)
    return both >= least * (small + large - both)


def text_alike(text: str, other: frozenset[str], k: int, least: float) -> bool:
    """``alike`` of a text's shingles and a set.

    Of a set of at most ``n`` shingles, ``missing`` of which the other lacks, no more than ``n - missing`` are shared: a
    third of the text often has enough missing ones to tell that it is not alike.
    """
    n = max(1, len(text) - k + 1)
    if n < least * len(other):
        return False
    missing = len(shingle_set(text[: n // 3 + k], k) - other) if n >= 60 else 0
    if n - missing < least * (len(other) + missing):
        return False
    return alike(shingle_set(text, k), other, least)


def _shared_ends(a: str, b: str) -> tuple[int, int]:
    """Lengths of the common beginning and of the common end behind it."""
    out = []
    for back in (False, True):
        low, high = 0, min(len(a), len(b)) - sum(out)
        while low < high:
            middle = (low + high + 1) // 2
            same = a[len(a) - middle :] == b[len(b) - middle :] if back else a[:middle] == b[:middle]
            low, high = (middle, high) if same else (low, middle - 1)
        out.append(low)
    return out[0], out[1]


def surely_alike(a: str, b: str, n_b: int, k: int, least: float) -> bool:
    """Whether two texts are alike by their ends alone; ``n_b`` is the size of b's set.

    Shingles that lie in the common ends are shared. So each set has at most as many others as touch the part between, and
    the union has ``n_b`` at least.
    """
    begin, end = _shared_ends(a, b)
    return len(a) + len(b) - 2 * (begin + end) + 2 * (k - 1) <= (1 - least) * n_b


def _items(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle) rows of the shingles that several texts have, numbered from 0, and the number of all shingles of each text."""
    sets = [packed_shingles(t, k) for t in texts]
    if any(s is None for s in sets):
        place: dict[str, int] = {}
        sets = [np.fromiter((place.setdefault(x, len(place)) for x in shingle_set(t, k)), dtype=_U) for t in texts]
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    values, item, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    on = times[item] > 1
    return owner[on], (np.cumsum(times > 1) - 1)[item[on]], size


def _alike_pairs(texts: list[str], k: int, left: np.ndarray, right: np.ndarray, least: float, width: int = 8192) -> list[tuple[int, int]]:
    """Index pairs (one of ``left``, one of ``right``) of texts that are alike; all intersections come from matrix products."""
    owner, item, size = _items(texts, k)
    n_items = int(item.max()) + 1 if len(item) else 0
    order = np.argsort(item, kind="stable")
    owner, item = owner[order], item[order]
    rows, columns = np.flatnonzero(left), np.flatnonzero(right)
    both = np.zeros((len(rows), len(columns)), dtype=np.float32)
    for first in range(0, n_items, width):
        part = slice(*np.searchsorted(item, [first, first + width]))
        held = np.zeros((len(texts), min(width, n_items - first)), dtype=np.float32)
        held[owner[part], item[part] - first] = 1
        both += held[rows] @ held[columns].T
    union = size[rows][:, None] + size[columns][None, :] - both
    x, y = np.nonzero(both >= least * union)
    return [(int(a), int(b)) for a, b in zip(rows[x], columns[y]) if a != b]


def _verified(pairs: DataFrame, texts: DataFrame, rules: Rules) -> DataFrame:
    """The pairs (a, b) whose shingle sets are alike."""
    with_a = pairs.join(texts.toDF("a", "text_a"), "a")
    both = with_a.join(texts.toDF("b", "text_b"), "b").select("a", "b", "text_a", "text_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray | frozenset[str]] = {}
        held = 0

        def near(text_a: str, text_b: str, b: int) -> bool:
            theirs = known[b]
            # Texts that differ in one place are told cheaply; the longer they are, the more that spares.
            if len(text_a) > 2000 and surely_alike(text_a, text_b, len(theirs), rules.shingle, rules.similarity):
                return True
            if isinstance(theirs, np.ndarray):
                if len(text_a) - rules.shingle + 1 < rules.similarity * len(theirs):
                    return False
                mine = packed_shingles(text_a, rules.shingle)
                if mine is not None:
                    return packed_alike(mine, theirs, rules.similarity)
                theirs = shingle_set(text_b, rules.shingle)
            return text_alike(text_a, theirs, rules.shingle, rules.similarity)

        for batch in batches:
            keep = []
            for b, text_a, text_b in zip(*(batch.column(c).to_pylist() for c in ("b", "text_a", "text_b"))):
                if b not in known:
                    held += len(text_b)
                    if held > rules.cell_chars:
                        known.clear()
                        held = len(text_b)
                    packed = packed_shingles(text_b, rules.shingle)
                    known[b] = shingle_set(text_b, rules.shingle) if packed is None else packed
                keep.append(near(text_a, text_b, b))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(check, "a long, b long")


def _merged(entries: np.ndarray) -> np.ndarray:
    """Rows (bucket, least key, greatest key, count), one for each bucket, in the order of the buckets as unsigned numbers."""
    if not len(entries):
        return entries
    entries = entries[np.argsort(entries[:, 0].view(_U), kind="stable")]
    first = np.flatnonzero(np.concatenate([[True], entries[1:, 0] != entries[:-1, 0]]))
    low, high = np.minimum.reduceat(entries[:, 1], first), np.maximum.reduceat(entries[:, 2], first)
    return np.stack([entries[first, 0], low, high, np.add.reduceat(entries[:, 3], first)], axis=1)


def _heads(lines: DataFrame, rules: Rules) -> DataFrame:
    """(bucket, a, b, n): the least and the greatest key of every bucket with different lines, and its rows.

    A task adds up its buckets before they travel, so a hot bucket costs a row per task. The buckets are dealt to as many
    parts as shuffles have partitions, and a task's buckets of a part travel as two packed arrays: those with one line as
    (bucket, key), the others whole. Most buckets have one line and are gone after that.
    """
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def packed(entries: np.ndarray) -> pa.RecordBatch:
        entries = _merged(entries)
        part = ((entries[:, 0].view(_U) >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)
        cuts = np.searchsorted(part, np.arange(parts + 1)).tolist()
        rows = []
        for p, (i, j) in enumerate(zip(cuts, cuts[1:])):
            if i < j:
                mine = entries[i:j]
                one = mine[:, 3] == 1
                rows.append((p, mine[one, :2].tobytes(), mine[~one].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _PACKED.types)], schema=_PACKED)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            bucket = batch.column("bands").flatten().to_numpy()
            key = np.repeat(batch.column("key").to_numpy(), rules.bands)
            held.append(np.stack([bucket, key, key, np.ones_like(key)], axis=1))
            size += len(bucket)
            if size > 1_000_000:
                yield packed(np.concatenate(held))
                held, size = [], 0
        if size:
            yield packed(np.concatenate(held))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []

        def found() -> pa.RecordBatch:
            entries = _merged(np.concatenate(held))
            entries = entries[entries[:, 1] != entries[:, 2]]
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in entries.T], names=["bucket", "a", "b", "n"])

        for batch in batches:
            for p, ones, more in zip(*(c.to_pylist() for c in batch.columns)):
                if p != part and held:
                    yield found()
                    held = []
                part = p
                single = np.frombuffer(ones, dtype=np.int64).reshape(-1, 2)
                held.append(np.stack([single[:, 0], single[:, 1], single[:, 1], np.ones(len(single), dtype=np.int64)], axis=1))
                held.append(np.frombuffer(more, dtype=np.int64).reshape(-1, 4))
        if held:
            yield found()

    sent = lines.where("bands IS NOT NULL").select("key", "bands").mapInArrow(gather, "part int, ones binary, more binary")
    return sent.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(meet, "bucket long, a long, b long, n long")


_PACKED = pa.schema([("part", pa.int32()), ("ones", pa.binary()), ("more", pa.binary())])


def _members(lines: DataFrame, heads: DataFrame, rules: Rules) -> DataFrame:
    """(bucket, key): the lines of the buckets that may have more than two, without a and b.

    Buckets with the same lines, as the bands of a group of near copies give, are taken once.
    """
    larger = heads.where("n > 2")
    shared = lines.sparkSession.sparkContext.broadcast(bit_filter(larger.select(F.col("bucket").alias("key"))))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("bands").flatten().to_numpy()
            keys = np.repeat(batch.column("key").to_numpy(), rules.bands)
            on = passing(shared.value, flat.view(_U))
            yield pa.RecordBatch.from_arrays([pa.array(flat[on]), pa.array(keys[on])], names=["bucket", "key"])

    rows = lines.where("bands IS NOT NULL").select("key", "bands").mapInArrow(pick, "bucket long, key long")
    met = rows.join(larger.select("bucket", "a", "b"), "bucket").where("key <> a AND key <> b").distinct()
    summary = met.groupBy("bucket", "a", "b").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("key")).alias("one"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("two"))
    once = summary.groupBy("a", "b", "n", "one", "two").agg(F.min("bucket").alias("bucket"))
    return met.join(once.select("bucket"), "bucket", "left_semi")


def _rooted(rows: DataFrame, labels: DataFrame, key: str, root: str) -> DataFrame:
    """``rows`` with the component of the line in column ``key``; lines without links are their own."""
    return rows.join(labels.toDF(key, root), key, "left").withColumn(root, F.coalesce(root, key))


def _open_groups(heads: DataFrame, members: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, key, root): the lines, but for each bucket's least, of the buckets that may hold several components.

    The bands of a group of near copies give many buckets with mostly the same lines. Buckets with the same least line
    are taken as one, so that their lines come once; such a group has at most one bucket per band of that line.
    """
    last = heads.select("bucket", "a", F.col("b").alias("key")).join(members.select("bucket").distinct(), "bucket", "left_semi")
    lines = members.select("a", "key").union(last.select("a", "key")).distinct()
    return _rooted(lines, labels, "key", "root").withColumnRenamed("a", "bucket")


def _grid(open_: DataFrame, texts: DataFrame, rules: Rules) -> DataFrame:
    """Links (a, b) between all members (bucket, key, root) of different components in a bucket.

    Buckets whose members are one component are done. Members are dealt to cells of ``rules.cell``; a task compares the members of two cells and emits links, one per
    member at most beyond the first, never the pairs compared. A bucket of any size is finished this way.
    """
    sized = open_.join(texts.select("key", F.length("chars").alias("size")), "key").groupBy("bucket").agg(
        F.greatest(F.ceil(F.count("*") / rules.cell), F.ceil(F.sum("size") / rules.cell_chars)).cast("int").alias("cells"),
        F.min("root").alias("low"), F.max("root").alias("high"),
    )
    sized = sized.where("low <> high").select("bucket", "cells")
    dealt = open_.join(sized, "bucket").withColumn("cell", F.pmod(F.xxhash64("key"), F.col("cells")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("cells") - 1), lambda o: F.struct(F.least("cell", o).alias("i"), F.greatest("cell", o).alias("j")))
    copies = dealt.withColumn("pair", F.explode(pairs)).select("bucket", "pair.i", "pair.j", "cell", "key", "root").join(texts, "key")

    def links(members: list[tuple]) -> list[tuple[int, int]]:
        """Of one bucket's cells i and j: pairs that join components, at most one for each member beyond the first."""
        _, i, j = members[0][:3]
        cells = np.array([m[3] for m in members])
        parent = {m[5]: m[5] for m in members}

        def find(r):
            while parent[r] != r:
                parent[r] = parent[parent[r]]
                r = parent[r]
            return r

        out = []
        if len(parent) > 1:
            for x, y in _alike_pairs([m[6] for m in members], rules.shingle, cells == i, cells == j, rules.similarity):
                a, b = find(members[x][5]), find(members[y][5])
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    out.append((members[x][4], members[y][4]))
        return out

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in batches:
            found = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if group and row[:3] != group[0][:3]:
                    found += links(group)
                    group = []
                group.append(row)
            yield _pairs(found)
        if group:
            yield _pairs(links(group))

    cut = copies.select("bucket", "i", "j", "cell", "key", "root", "chars")
    dealt = cut.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return dealt.mapInArrow(compare, "a long, b long")


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after more links: only the roots at their ends are linked anew."""
    ends = _rooted(_rooted(links, labels, "a", "root_a"), labels, "b", "root_b")
    moved = components(ends.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")), "line-roots")
    single = moved.select("node", F.col("node").alias("root")).join(labels.select("node"), "node", "left_anti")
    moved = moved.toDF("root", "next")
    return labels.union(single).join(moved, "root", "left").select("node", F.coalesce("next", "root").alias("root"))


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*found) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def line_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """(doc_id, copy, line, keeper_id, keeper_copy, keeper_line, kept): every line with a word.

    Lines of one component (exact copies, and lines joined by chains of similarities of at least ``rules.similarity``)
    name the same keeper, the component's first line by (doc_id, copy, line). ``copy`` is a hash of the document's
    text: rows that share an id are told apart by it, and exact repeats of a row count as one document. Null ids come
    first. Null and empty texts have no lines. ``line`` counts from 0 over all lines of the text.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text_of(text)).alias("copy"), text_of(text).alias("text"))
    lines = materialize(line_table(rows, rules), "lines")
    heads = materialize(_heads(lines, rules), "line-heads")
    members = materialize(_members(lines, heads, rules), "line-members")
    ends = heads.select(F.explode(F.array("a", "b")).alias("key"))
    texts = materialize(line_texts(rows, ends.union(members.select("key")).distinct(), rules), "line-texts")

    # Each line of a bucket against its least; where that leaves several components, all others among themselves.
    star = heads.select("a", "b").union(members.select(F.col("key").alias("a"), F.col("a").alias("b"))).distinct()
    links = materialize(_verified(star, texts, rules), "line-links")
    labels = components(links, "line")
    open_ = materialize(_open_groups(heads, members, labels), "line-members")
    labels = _joined(labels, materialize(_grid(open_, texts, rules), "line-links"))

    # Lines with a copy or a link meet their component's first line; a filter lets the others pass by.
    copied = lines.groupBy("key").count().where("count > 1").select("key")
    wanted = docs.sparkSession.sparkContext.broadcast(bit_filter(copied.union(labels.select(F.col("node").alias("key")))))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = np.zeros(batch.num_rows, dtype=bool)
            told[passing(wanted.value, batch.column("key").to_numpy().view(_U))] = True
            yield batch.append_column("shared", pa.array(told))

    place = F.struct("doc_id", "copy", "line")
    kind = lines.schema["doc_id"].dataType.simpleString()
    marked = lines.drop("bands").mapInArrow(mark, f"doc_id {kind}, copy long, line long, key long, proof long, shared boolean")
    single = marked.where("NOT shared").select(place.alias("place"), place.alias("keeper"))
    # Copies of a line collapse; of a key shared by different lines, if ever, the least proof's lines do.
    shared = marked.where("shared")
    nodes = shared.groupBy("key").agg(F.min(F.struct("proof", "doc_id", "copy", "line")).alias("first"))
    rooted = _rooted(nodes, labels, "key", "root")
    keepers = rooted.groupBy("root").agg(F.min(F.struct("first.doc_id", "first.copy", "first.line")).alias("keeper"))
    named = rooted.join(keepers, "root").select("key", F.col("first.proof").alias("known"), "keeper")
    met = shared.join(named, "key").select(place.alias("place"), F.when(F.col("proof") == F.col("known"), F.col("keeper")).otherwise(place).alias("keeper"))
    return met.union(single).select(
        "place.*", F.col("keeper.doc_id").alias("keeper_id"), F.col("keeper.copy").alias("keeper_copy"), F.col("keeper.line").alias("keeper_line"),
        F.col("place").eqNullSafe(F.col("keeper")).alias("kept"),
    )


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """``docs`` with the lines that repeat an earlier one taken out of their texts, other columns as they are.

    A row whose every line with a word went is a duplicate as a whole and goes too. Rows that lost no line, null texts among
    them, are unchanged.
    """
    gone = line_groups(docs, doc_id, text, rules).where("NOT kept").groupBy("doc_id", "copy").agg(F.collect_set("line").alias("_gone"))
    name, copy, lost = fresh(docs, "id", "copy", "lost")
    gone = materialize(gone, "lines-gone").toDF(name, copy, lost)
    # Lists may be long: both the rows and what their lists hold together are counted before they are broadcast.
    held = gone.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size(lost)), F.lit(0)).alias("lines")).first()
    if held.rows <= 200_000 and held.lines <= 2_000_000:
        gone = F.broadcast(gone)
    same = F.col(doc_id).eqNullSafe(F.col(name)) & (F.xxhash64(text_of(text)) == F.col(copy))
    joined = docs.join(gone, same, "left")
    left = F.filter(F.split(F.col(text), "\n"), lambda _, i: ~F.array_contains(lost, i.cast("long")))
    new = joined.withColumn(text, F.when(F.col(lost).isNull(), F.col(text)).otherwise(F.array_join(left, "\n")))
    whole = F.col(lost).isNotNull() & ~F.col(text).rlike(r"[^\x20\x09-\x0D]")
    return new.where(~F.coalesce(whole, F.lit(False))).select(*docs.columns)


@query("op3_line_dedup")
def op3_line_dedup(spark, sf_dir):
    return line_groups(table(spark, sf_dir, "documents")).drop("copy", "keeper_copy")
