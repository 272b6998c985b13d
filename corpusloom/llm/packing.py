"""Order-preserving packing: window cuts at document or sentence boundaries by dynamic programming."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import table, text_of
from corpusloom.llm.registry import query


@dataclass(frozen=True)
class Rules:
    """Costs are in tokens. A sequence costs its padding and ``sequence``; a cut inside a document costs ``sentence`` after
    a sentence and ``word`` elsewhere. A sequence is padded to ``window`` unless its length is a power of two.

    Cuts elsewhere are offered every ``gap`` tokens of a sentence, and after every token near the end of a shard.
    """

    window: int = 1024
    sentence: int = 4
    word: int = 12
    sequence: int = 16
    gap: int = 24
    shortest: int = 64
    #: Tokens laid out at once; what may still join later text is carried on.
    chunk: int = 1 << 18


class Tokens:
    """Ids of the byte-level vocabulary. Texts of plain Latin letters take the faster of two equal encoders."""

    def __init__(self, name: str, ranks: str | None):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(_path(name))
        # Added tokens stand for themselves wherever their text occurs; the faster encoder knows none.
        self.added = [t.content for t in self.full.get_added_tokens_decoder().values()]
        self.quick = _quick(ranks) if ranks else None
        size = self.full.get_vocab_size()
        last = [self.full.id_to_token(i) or "" for i in range(size)]
        # Fixed value: the vocabulary writes a line end as U+010A.
        self.ends = np.array([t[-1:] in (".", "!", "?") or "Ċ" in t for t in last], dtype=bool)

    def encode(self, text: str) -> np.ndarray:
        if self.quick is not None and _latin(text) and not any(t in text for t in self.added):
            return np.array(self.quick.encode_ordinary(text), dtype=np.uint32)
        return np.array(self.full.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


_FURTHER = re.compile("[^\x00-\u024f]")


def _latin(text: str) -> bool:
    """Whether all letters are among the plain Latin ones, on which both encoders are the same."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _FURTHER.search(text) is None
    return True


def _path(name: str) -> str:
    """A file's path as given, or by its name among the installed public vocabularies."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _quick(ranks: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(_path(ranks), "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(ranks, pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})


def boundaries(sizes: np.ndarray, ends: np.ndarray, last: bool, rules: Rules) -> tuple[np.ndarray, np.ndarray]:
    """(positions, penalties) where a window may end, from document sizes and positions after sentences."""
    borders = np.cumsum(sizes)
    total = int(borders[-1])
    kinds = [borders, ends, np.zeros(1, np.int64)]
    known = np.unique(np.concatenate(kinds))
    wide = np.flatnonzero(np.diff(known) > rules.gap)
    more = [np.arange(known[i] + rules.gap, known[i + 1], rules.gap) for i in wide]
    if last:
        more.append(np.arange(max(0, total - rules.window), total))
    positions = np.unique(np.concatenate([known, *more]))
    penalties = np.full(len(positions), float(rules.word))
    penalties[np.searchsorted(positions, ends)] = rules.sentence
    penalties[np.searchsorted(positions, borders)] = 0
    return positions, penalties


def best_cuts(positions: np.ndarray, penalties: np.ndarray, rules: Rules, shortest: int) -> list[int]:
    """Indices of the boundaries that close the windows of a cheapest layout.

    cost[i] = penalty[i] + sequence + min over j of cost[j] + padding(positions[i] - positions[j]). Padding to the window
    is linear in the length, so its minimum over the last ``window`` tokens comes from a monotone queue of
    cost[j] + positions[j]; the few j at a power of two, which need no padding, are looked up besides.
    """
    window = rules.window
    exact: dict[int, list[int]] = {}
    size = shortest
    while size < window:
        j = np.searchsorted(positions, positions - size)
        hit = np.flatnonzero(positions[j] == positions - size)
        for i, k in zip(hit.tolist(), j[hit].tolist()):
            exact.setdefault(i, []).append(k)
        size *= 2
    p, extra = positions.tolist(), (penalties + rules.sequence).tolist()
    n = len(p)
    cost, back = [0.0] * n, [0] * n
    queue, key = [0] * n, [0.0] * n
    head, tail = 0, 1
    for i in range(1, n):
        at = p[i]
        low = at - window
        while p[queue[head]] < low:
            head += 1
        j = queue[head]
        least = key[head] + window - at
        if i in exact:
            for k in exact[i]:
                if cost[k] < least:
                    least, j = cost[k], k
        least += extra[i]
        cost[i], back[i] = least, j
        value = least + at
        while tail > head and key[tail - 1] >= value:
            tail -= 1
        queue[tail], key[tail] = i, value
        tail += 1
    cuts, i = [], n - 1
    while i:
        cuts.append(i)
        i = back[i]
    return cuts[::-1]


PIECES = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    tokens: Callable[[], Tokens] | None = None,
    end: int = 0,
    rules: Rules = Rules(),
) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset) of all documents, in the order of the input.

    A document is its ids and then ``end``; a null text is empty. ``ids`` holds a piece's ids as little-endian unsigned
    32-bit numbers. Every partition is a shard: its documents are laid out in order, in chunks whose last windows stay
    open, so memory is bounded by a chunk and the longest document. Sequences never mix shards; the number of
    the shard leads ``sequence_id``. Repeated ids and rows are packed like any others.
    """
    kind = df.schema[doc_id].dataType.simpleString()
    arrow_id = pa.string()
    make = tokens or (lambda: Tokens("byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))

    def layout(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make()
        shard = TaskContext.get().partitionId() << 40
        stop = np.array([end], dtype=np.uint32)
        names: list = []  # of the open documents: id, tokens already placed, all tokens
        held: list[np.ndarray] = []
        waiting, made = 0, 0

        def flush(last: bool) -> list[list]:
            nonlocal names, held, waiting, made
            sizes = np.array([len(x) for x in held])
            stream = np.concatenate(held)
            positions, penalties = boundaries(sizes, np.flatnonzero(encoder.ends[stream]) + 1, last, rules)
            cuts = [int(positions[i]) for i in best_cuts(positions, penalties, rules, 1 if last else rules.shortest)]
            if not last:
                cuts = [c for c in cuts if c <= len(stream) - 2 * rules.window]
            columns: list[list] = [[] for _ in range(7)]
            raw = stream.astype("<u4").tobytes()
            borders = np.cumsum(sizes)
            d, begin = 0, 0
            for cut in cuts:
                offset = 0
                while begin < cut:
                    until = min(cut, int(borders[d]))
                    name, placed, total = names[d]
                    row = (name, placed, until - begin, raw[4 * begin : 4 * until], total, shard + made, offset)
                    for column, value in zip(columns, row):
                        column.append(value)
                    names[d] = (name, placed + until - begin, total)
                    offset += until - begin
                    begin = until
                    d += begin == borders[d]
                made += 1
            kept = stream[begin:]
            names = names[d:]
            sizes = sizes[d:].copy()
            if len(sizes):
                sizes[0] = int(borders[d]) - begin
            held = np.split(kept, np.cumsum(sizes)[:-1]) if len(sizes) else []
            waiting = len(kept)
            return columns

        def batch_of(columns: list[list]) -> pa.RecordBatch:
            types = [arrow_id, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for name, value in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                value = value.as_py()
                ids = np.concatenate([encoder.encode(value), stop]) if value else stop
                names.append((name, 0, len(ids)))
                held.append(ids)
                waiting += len(ids)
                if waiting >= rules.chunk:
                    yield batch_of(flush(False))
        if held:
            yield batch_of(flush(True))

    rows = df.select(F.col(doc_id).cast("string").alias("doc_id"), text_of(text).alias("text"))
    pieces = rows.mapInArrow(layout, f"doc_id string, {PIECES}")
    return pieces.withColumn("doc_id", F.col("doc_id").cast(kind))


def digests(pieces: DataFrame) -> DataFrame:
    """Pieces with the crc32 of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op5_packing")
def op5_packing(spark, sf_dir):
    return digests(pack(table(spark, sf_dir, "documents")))
