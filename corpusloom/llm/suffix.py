"""Exact substring dedup by induced suffix sorting with common-prefix values, in shards sorted on disk by Spark.

Two equal strings of ``length`` bytes choose the same sample position: the place of their least ``gram``-byte hash. So
texts are cut into pieces, one per sample position with all windows that choose it, and windows can only be equal in
pieces with the same sample. Pieces with the same bytes collapse. For the rest the suffixes at the sample positions
are sorted, and the order is induced to the left: suffixes one byte longer are a stable pass over that byte, and
neighbours' common prefixes are one more than the least value between them. A window that reaches ``length`` with its
neighbour is a repeated one.

No text moves but those pieces, and at the end the texts that hold an oldest piece: a scan knows by a Bloom filter which
samples may be repeated, and by its text's list of oldest pieces which of them to keep.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import bit_filter, passing, small_or_shuffled, table, text_of
from corpusloom.llm.registry import query
from corpusloom.llm.textblocks import Block, blocks, column_bytes, grams, mix
from corpusloom.session import materialize

_U = np.uint64


@dataclass(frozen=True)
class Rules:
    length: int = 100
    gram: int = 32
    #: Distinct pieces from which a sample is split by more context, and the left reaches that share a split.
    hot: int = 4096
    reach: int = 9
    #: Pieces of a shard beyond which its windows are grouped one by one.
    crowd: int = 32_768
    #: Bytes of pieces sorted at once in a task.
    chunk: int = 4_000_000


class Samples:
    """The pieces of a block: (document, sample position, first window, last window), and the sample's hash."""

    def __init__(self, block: Block, rules: Rules):
        n, k, length = len(block.data), rules.gram, rules.length
        w = length - k + 1
        empty = np.zeros(0, np.int64)
        self.block, self.doc, self.pos, self.first, self.last, self.key = block, empty, empty, empty, empty, np.zeros(0, _U)
        if n < length:
            return
        hashes = grams(block, k)
        # The leftmost least hash of every window: 33 bits of hash, then the position.
        packed = (hashes >> _U(31) << _U(31)) | np.arange(n - k + 1, dtype=_U)
        rows = -(-len(packed) // w)
        grid = np.full(rows * w, ~_U(0))
        grid[: len(packed)] = packed
        grid = grid.reshape(rows, w)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = n - length + 1
        least = (np.minimum(behind[:windows], ahead[w - 1 : w - 1 + windows]) & _U((1 << 31) - 1)).astype(np.int64)
        start = np.arange(windows)
        doc = block.doc_of(start)
        inside = start + length <= block.offsets[doc + 1]
        start, doc, least = start[inside], doc[inside], least[inside]
        if not len(start):
            return
        new = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])])
        self.doc, self.pos, self.first = doc[new], least[new], start[new]
        self.last = start[np.r_[new[1:], len(start)] - 1]
        self.key = hashes[self.pos]

    def local(self, positions: np.ndarray, rows=slice(None)) -> np.ndarray:
        return positions[rows] - self.block.offsets[self.doc[rows]]

    def identity(self, rows: np.ndarray, rules: Rules) -> np.ndarray:
        """A hash that, with the sample's, tells pieces apart: of their bytes and of where the sample stands in them."""
        first, end = self.first[rows], self.last[rows] + rules.length
        return mix(self.block.hashes(first, end, other=True) + (self.pos[rows] - first).astype(_U))


def _identified(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, copy, name, text): ``copy`` tells rows with the same id apart, and is 0 where no id repeats."""
    repeats = docs.groupBy(doc_id).count().where("count > 1").limit(1).count() > 0
    copy = F.xxhash64(text_of(text)) if repeats else F.lit(0).cast("long")
    rows = docs.select(F.col(doc_id).alias("doc_id"), copy.alias("copy"), text_of(text).alias("text"))
    return rows.withColumn("name", _name())


def _name():
    return F.xxhash64("doc_id", "copy")


def sample_counts(rows: DataFrame, rules: Rules) -> DataFrame:
    """(key, n): how often each sample occurs in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, block in blocks(batch.column("text")):
                keys, n = np.unique(Samples(block, rules).key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["key", "n"])

    return rows.select("text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def oldest_pieces(rows: DataFrame, repeated: np.ndarray, rules: Rules) -> DataFrame:
    """(key, two, doc_id, copy, pos): the oldest occurrence of every distinct piece whose sample passes the filter ``repeated``."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast(repeated)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def first_ones() -> pa.Table:
            """Of equal pieces that this task has seen, the oldest."""
            rows = pa.Table.from_batches(held)
            age = _order([_flat(rows, c) for c in ("doc_id", "copy", "pos")])
            key, two = rows["key"].to_numpy(), rows["two"].to_numpy()
            order = np.lexsort((age, two, key))
            new = np.r_[True, (key[order][1:] != key[order][:-1]) | (two[order][1:] != two[order][:-1])]
            return rows.take(pa.array(order[new]))

        for batch in batches:
            for row, _, block in blocks(batch.column("text")):
                found = Samples(block, rules)
                hit = passing(shared.value, found.key)
                at = pa.array(row + found.doc[hit])
                columns = [
                    pa.array(found.key[hit].view(np.int64)), pa.array(found.identity(hit, rules).view(np.int64)),
                    batch.column("doc_id").take(at), batch.column("copy").take(at), pa.array(found.local(found.pos, hit)),
                ]
                held.append(pa.RecordBatch.from_arrays(columns, names=["key", "two", "doc_id", "copy", "pos"]))
                size += len(hit)
            if size > 250_000:
                yield from first_ones().to_batches(max_chunksize=100_000)
                held, size = [], 0
        if size:
            yield from first_ones().to_batches(max_chunksize=100_000)

    found = rows.select("doc_id", "copy", "text").mapInArrow(scan, f"key long, two long, doc_id {kind}, copy long, pos long")
    oldest = found.groupBy("key", "two").agg(F.min(F.struct("doc_id", "copy", "pos")).alias("oldest"))
    return oldest.select("key", "two", "oldest.*")


def open_pieces(rows: DataFrame, oldest: DataFrame, several: DataFrame, rules: Rules) -> DataFrame:
    """(key, hot, bytes, left, doc_id, copy, pos) of the oldest pieces whose samples have several distinct pieces.

    The filter may let later copies of such a piece pass; they change nothing, since the oldest one is there too.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()
    named = oldest.join(several.select("key"), "key", "left_semi").select(F.col("two").bitwiseXOR(_name()).alias("key"))
    context = rows.sparkSession.sparkContext
    wanted = context.broadcast(bit_filter(named))
    frequent = context.broadcast(bit_filter(several.where(F.col("m") > rules.hot).select("key")))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("name").to_numpy().view(_U)
            for row, _, block in blocks(batch.column("text")):
                found = Samples(block, rules)
                every = np.arange(len(found.pos))
                hit = passing(wanted.value, found.identity(every, rules) ^ names[row + found.doc])
                hot = np.zeros(len(hit), dtype=bool)
                hot[passing(frequent.value, found.key[hit])] = True
                first, end = found.first[hit], found.last[hit] + rules.length
                values = [block.data[a:b].tobytes() for a, b in zip(first.tolist(), end.tolist())]
                at = pa.array(row + found.doc[hit])
                columns = [
                    pa.array(found.key[hit].view(np.int64)), pa.array(hot), pa.array(values, pa.binary()), pa.array(found.pos[hit] - first),
                    batch.column("doc_id").take(at), batch.column("copy").take(at), pa.array(found.local(found.pos, hit)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "hot", "bytes", "left", "doc_id", "copy", "pos"])

    return rows.mapInArrow(scan, f"key long, hot boolean, bytes binary, left long, doc_id {kind}, copy long, pos long")


def _flat(rows: pa.Table, column: str) -> pa.Array:
    """A column as one array."""
    return pa.concat_arrays(rows[column].chunks) if rows[column].num_chunks else pa.array([], rows[column].type)


def _order(columns: list[pa.Array]) -> np.ndarray:
    """Rank of each row by the columns in order, nulls first; equal rows share a rank."""
    codes = []
    for c in columns:
        known = c.dictionary_encode() if not pa.types.is_dictionary(c.type) else c
        by_value = np.argsort(np.argsort(known.dictionary.to_numpy(zero_copy_only=False), kind="stable"), kind="stable") + 1
        index = known.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        codes.append(np.where(index >= 0, by_value[index] if len(by_value) else 0, 0))
    order = np.lexsort(codes[::-1])
    step = np.zeros(len(order), dtype=np.int64)
    for c in codes:
        step[1:] |= c[order][1:] != c[order][:-1]
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.cumsum(step)
    return rank


def induced(group: np.ndarray, data: np.ndarray, begin: np.ndarray, end: np.ndarray, left: np.ndarray, age: np.ndarray, low: np.ndarray, high: np.ndarray, length: int):
    """(least, greatest) left reach at which an equal, older window exists for each piece; -1 where there is none.

    Piece i is ``data[begin[i]:end[i]]`` with its sample at ``left[i]``; a window with reach r starts r bytes left of the
    sample. Only reaches from ``low`` to ``high`` are judged. ``age`` orders the pieces' first occurrences.
    """
    n = len(group)
    sample = begin + left
    size = np.minimum(end - sample, length)
    # Suffixes at the samples: right contexts, padded, then by size, so that equal ones stand together.
    right = np.zeros((n, length), dtype=np.uint8)
    column = np.arange(length)
    real = column < size[:, None]
    right[real] = data[(sample[:, None] + column)[real]]
    words = np.zeros((n, -(-length // 8) * 8), dtype=np.uint8)
    words[:, :length] = right
    keys = words.view(">u8").astype(_U)
    order = np.lexsort((size, *keys.T[::-1], group))
    same = group[order][1:] == group[order][:-1]
    differ = (right[order][1:] != right[order][:-1]) | ~(real[order][1:] & real[order][:-1])
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
    prefix = np.zeros(n, dtype=np.int64)
    prefix[1:] = np.where(same, common, -1)
    prefix[:1] = -1
    least, greatest = np.full(n, -1), np.full(n, -1)
    reach = 0
    while len(order):
        equal = prefix >= length
        if equal.any():
            starts = np.flatnonzero(~equal)
            oldest = np.repeat(np.minimum.reduceat(age[order], starts), np.diff(np.r_[starts, len(order)]))
            member = equal.copy()
            member[:-1] |= equal[1:]
            hit = order[member & (age[order] != oldest) & (low[order] <= reach) & (reach <= high[order])]
            least[hit] = np.where(least[hit] < 0, reach, least[hit])
            greatest[hit] = reach
        reach += 1
        # One byte to the left: a stable pass by that byte, inside each group.
        on = np.flatnonzero((left[order] >= reach) & (high[order] >= reach))
        if not len(on):
            break
        byte = data[sample[order[on]] - reach].astype(np.int64)
        bucket = group[order[on]] * 256 + byte
        again = np.argsort(bucket, kind="stable")
        moved, bucket = on[again], bucket[again]
        alike = bucket[1:] == bucket[:-1]
        grown = np.full(len(moved), -1)
        if alike.any():
            # Least common prefix over the old places after one neighbour up to the other.
            bounds = np.stack([moved[:-1][alike] + 1, moved[1:][alike] + 1], axis=1).ravel()
            grown[1:][alike] = np.minimum.reduceat(np.r_[prefix, -1], bounds)[::2] + 1
        fresh_group = np.r_[True, group[order[moved]][1:] != group[order[moved]][:-1]]
        prefix = np.where(fresh_group, -1, np.maximum(grown, 0))
        order = order[moved]
    return least, greatest


def repeated_reaches(pieces: DataFrame, rules: Rules) -> DataFrame:
    """(doc_id, copy, pos, least, greatest) of the pieces with a window that an older piece has as well.

    ``pieces``: (shard, bytes, left, low, high, doc_id, copy, pos). Spark deals the shards out and sorts them with its
    external sorter; a task takes as many whole shards at once as fit a chunk.
    """
    kind = pieces.schema["doc_id"].dataType.simpleString()

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0

        def flush(whole: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            rows = pa.concat_tables(held)
            shard = rows["shard"].to_numpy()
            change = np.flatnonzero(shard[1:] != shard[:-1]) + 1
            cut = len(shard) if whole else (int(change[-1]) if len(change) else 0)
            held = [] if cut == len(shard) else [rows.slice(cut)]
            size = sum(t.nbytes for t in held)
            if not cut:
                return
            rows, shard = rows.slice(0, cut), shard[:cut]
            data, offsets = column_bytes(_flat(rows, "bytes"))
            group = np.cumsum(np.r_[0, shard[1:] != shard[:-1]])
            age = _order([_flat(rows, c) for c in ("doc_id", "copy", "pos")])
            left, low, high = (rows[c].to_numpy() for c in ("left", "low", "high"))
            least, greatest = induced(group, data, offsets[:-1], offsets[1:], left, age, low, high, rules.length)
            hit = np.flatnonzero(least >= 0)
            found = rows.select(["doc_id", "copy", "pos"]).take(pa.array(hit))
            found = found.append_column("least", pa.array(least[hit])).append_column("greatest", pa.array(greatest[hit]))
            yield from found.to_batches(max_chunksize=100_000)

        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            size += batch.nbytes
            if size >= rules.chunk:
                yield from flush(False)
        if held:
            yield from flush(True)

    dealt = pieces.repartition("shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(sort, f"doc_id {kind}, copy long, pos long, least long, greatest long")


def _shards(pieces: DataFrame, rules: Rules) -> DataFrame:
    """Pieces dealt to shards by sample; those of a frequent sample by sample and context.

    Equal windows whose reaches lie in a range [low, high] agree in the ``low`` bytes left of the sample and in the
    ``length - high`` bytes from it, so these bytes may part a frequent sample's pieces into smaller shards, a copy per range.
    """
    top = rules.length - rules.gram
    ranges = F.array(*[F.struct(F.lit(a).cast("long").alias("low"), F.lit(min(a + rules.reach - 1, top)).cast("long").alias("high")) for a in range(0, top + 1, rules.reach)])
    whole = F.array(F.struct(F.lit(0).cast("long").alias("low"), F.lit(top).cast("long").alias("high")))
    spread = pieces.withColumn("range", F.explode(F.when(F.col("hot"), ranges).otherwise(whole)))
    # A piece has windows of reach ``left - (size - length)`` to ``left`` only.
    fits = (F.col("range.low") <= F.col("left")) & (F.col("range.high") >= F.col("left") + rules.length - F.octet_length("bytes"))
    context = F.expr(f"substring(bytes, cast(left - range.low + 1 AS int), cast(range.low + {rules.length} - range.high AS int))")
    shard = F.when(F.col("hot"), F.xxhash64("key", "range.low", context)).otherwise(F.col("key"))
    return spread.where(fits).select(shard.alias("shard"), "hot", "bytes", "left", "range.low", "range.high", "doc_id", "copy", "pos")


def _all_reaches(pieces: DataFrame, several: DataFrame, rules: Rules) -> DataFrame:
    """``repeated_reaches`` of all pieces. Shards that stay crowded, since many different pieces agree in all the context of
    their range, are not sorted: their windows are grouped instead."""
    if several.where(F.col("m") > rules.hot).isEmpty():
        return repeated_reaches(_shards(pieces, rules), rules)
    shards = _shards(materialize(pieces, "open-pieces"), rules)
    crowded = shards.where("hot").groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > rules.crowd).select("shard")
    crowded = materialize(crowded, "crowded-shards")
    if crowded.isEmpty():
        return repeated_reaches(shards, rules)
    crowded = small_or_shuffled(crowded)
    sorted_ = repeated_reaches(shards.join(crowded, "shard", "left_anti"), rules)
    return sorted_.unionByName(window_reaches(shards.join(crowded, "shard", "left_semi"), rules))


def window_reaches(pieces: DataFrame, rules: Rules) -> DataFrame:
    """(doc_id, copy, pos, least, greatest): as ``repeated_reaches``, by the windows themselves.

    Two hashes of 64 bits stand for a window. Its oldest piece comes from an aggregate with map-side minima, so a window that a
    third of all texts share is a row per task; the pieces meet it in parts.
    """
    size = F.octet_length("bytes")
    reaches = F.sequence(F.greatest("low", F.col("left") + rules.length - size), F.least("high", "left"))
    each = pieces.select("doc_id", "copy", "pos", "left", "bytes", F.explode(reaches).alias("reach"))
    window = F.expr(f"substring(bytes, cast(left - reach + 1 AS int), {rules.length})")
    piece = F.struct("doc_id", "copy", "pos")
    each = each.select("reach", piece.alias("piece"), F.xxhash64(window).alias("one"), F.xxhash64(F.lit(1), window).alias("two"))
    each = materialize(each, "crowded-windows")
    oldest = each.groupBy("one", "two").agg(F.min("piece").alias("oldest"), F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / max(1, rules.crowd)).cast("int")
    oldest = materialize(oldest.select("one", "two", "oldest", parts.alias("parts")), "oldest-windows")
    many = small_or_shuffled(oldest.where("parts > 1").select("one", "two", "parts"))
    dealt = each.join(many, ["one", "two"], "left").withColumn("part", F.pmod(F.xxhash64("piece"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    copies = oldest.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    later = dealt.join(copies, ["one", "two", "part"]).where("piece <> oldest")
    # Windows of a piece overlap, so what lies between two repeated ones is covered by them.
    found = later.groupBy("piece").agg(F.min("reach").alias("least"), F.max("reach").alias("greatest"))
    return found.select("piece.*", "least", "greatest")


def dedup_substrings(df: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """(doc_id, n_bytes, spans array<struct<first, end>>, kept binary): one row per input row.

    ``spans`` are the maximal runs of removed bytes of the text in UTF-8: those covered by a string of ``rules.length`` bytes that
    also starts earlier, in a smaller id (nulls first; of equal ids the smaller hash of the text) or further left in
    the same text. Exact repeats of a row, id included, count as one document and get the same result. Null texts
    are empty. Matches never cross documents and are judged on the input. Other columns are not read.
    """
    rows = _identified(df, doc_id, text)
    repeated = bit_filter(materialize(sample_counts(rows, rules).where("n > 1").select("key"), "repeated-samples"))
    oldest = materialize(oldest_pieces(rows, repeated, rules), "oldest-pieces")
    several = materialize(oldest.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "several-pieces")
    reaches = _all_reaches(open_pieces(rows, oldest, several, rules), several, rules)
    # Per document: where its pieces are the oldest of their kind, and how far their windows are repeated even so.
    span = F.struct("pos", "least", "greatest")
    listed = oldest.select("doc_id", "copy", "pos", F.lit(None).cast("long").alias("least"), F.lit(None).cast("long").alias("greatest")).unionByName(reaches)
    listed = listed.groupBy("doc_id", "copy").agg(F.collect_list(span).alias("marks"))
    listed = materialize(listed, "marks")
    # Texts without marks need not move: a filter tells most of them.
    bits = rows.sparkSession.sparkContext.broadcast(bit_filter(listed.select(_name().alias("key"))))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def sort_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = np.zeros(batch.num_rows, dtype=bool)
            told[passing(bits.value, batch.column("name").to_numpy().view(_U))] = True
            yield batch.append_column("marked", pa.array(told))

    shape = f"doc_id {kind}, copy long, text string, name long, marked boolean"
    parted = rows.mapInArrow(sort_out, shape)
    other = listed.withColumnsRenamed({"doc_id": "_id", "copy": "_copy"})
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("copy") == F.col("_copy"))
    moved = parted.where("marked").join(other, same, "left").select("doc_id", "text", "marks")
    stays = parted.where("NOT marked").select("doc_id", "text", F.lit(None).cast(listed.schema["marks"].dataType).alias("marks"))
    cut = _cut(rows.sparkSession.sparkContext.broadcast(repeated), rules)
    out = f"doc_id {kind}, n_bytes long, spans array<struct<first:long,end:long>>, kept binary"
    return moved.mapInArrow(cut, out).union(stays.mapInArrow(cut, out))


def _cut(repeated, rules: Rules):
    """Per text: its pieces that pass the filter ``repeated`` go, unless marked as the oldest; of those, the marked reaches go."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run_type = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            marks = batch.column("marks")
            owner = np.repeat(np.arange(len(marks)), marks.value_lengths().fill_null(0).to_numpy())
            fields = dict(zip(("pos", "least", "greatest"), marks.flatten().flatten()))
            pos, least, greatest = (fields[c].fill_null(-1).to_numpy() for c in ("pos", "least", "greatest"))
            for row, end, block in blocks(batch.column("text")):
                found = Samples(block, rules)
                hit = passing(repeated.value, found.key)
                mine = slice(*np.searchsorted(owner, [row, end]))
                doc, at, low, high = owner[mine] - row, pos[mine], least[mine], greatest[mine]
                known = low < 0
                old = np.isin(found.doc[hit] << 31 | found.local(found.pos, hit), doc[known] << 31 | at[known])
                gone = hit[~old]
                part = ~known
                starts = np.r_[found.first[gone], block.offsets[doc[part]] + at[part] - high[part]]
                ends = np.r_[found.last[gone], block.offsets[doc[part]] + at[part] - low[part]] + rules.length
                docs = np.r_[found.doc[gone], doc[part]]
                yield _texts_without(batch.column("doc_id").slice(row, end - row), block, docs, starts, ends, run_type)

    return cut


def _texts_without(ids: pa.Array, block: Block, docs: np.ndarray, starts: np.ndarray, ends: np.ndarray, run_type) -> pa.RecordBatch:
    """Merges the spans where they overlap or touch, inside each document, and cuts them out."""
    order = np.lexsort((ends, starts))
    docs, starts, ends = docs[order], starts[order], np.maximum.accumulate(ends[order]) if len(ends) else ends
    new = np.r_[True, (starts[1:] > ends[:-1]) | (docs[1:] != docs[:-1])] if len(starts) else np.zeros(0, dtype=bool)
    first = starts[new]
    last = ends[np.r_[np.flatnonzero(new)[1:], len(ends)] - 1] if len(ends) else ends
    doc = docs[new]
    change = np.zeros(len(block.data) + 1, dtype=np.int32)
    np.add.at(change, first, 1)
    np.add.at(change, last, -1)
    keep = np.cumsum(change)[:-1] == 0
    cuts = block.offsets
    kept = [block.data[a:b][keep[a:b]].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
    base = cuts[doc]
    runs = pa.StructArray.from_arrays([pa.array(first - base), pa.array(last - base)], names=["first", "end"])
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(block) + 1)).astype(np.int32)), runs)
    return pa.RecordBatch.from_arrays([ids, pa.array(np.diff(cuts)), lists.cast(run_type), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])


@query("op10_suffix_dedup")
def op10_suffix_dedup(spark, sf_dir):
    found = dedup_substrings(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["first"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
