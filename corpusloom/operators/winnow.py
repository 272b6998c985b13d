"""Winnowed fingerprints: which of a text's short word n-grams are looked up, so that no shared long one is missed.

Of every window of consecutive k-grams the one with the least hash is chosen. Two texts that share n words choose the same k-gram
inside them, with windows of n - k + 1. Only chosen ones travel; around those that match, the n-grams themselves are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_U = np.uint64
#: Two odd bases and offsets: spans are told apart by hashes that have nothing to do with each other.
BASES = ((0x9E3779B97F4A7C15, 1), (0xD1342543DE82EF95, 1001))
#: Bytes of text whose hashes are held at once; a longer text is taken by itself.
CHUNK = 1 << 20


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xFF51AFD7ED558CCD)):
        x = (x ^ (x >> _U(shift))) * _U(factor)
    return x ^ (x >> _U(32))


class Words:
    """The words of texts, which single blanks separate, so that empty words are words too.

    ``text`` has the row of each word; a run of words is the bytes from its first to its last one, blanks included.
    """

    def __init__(self, texts: list[bytes]):
        # A blank after each text ends its last word.
        joined = b" ".join([*texts, b""])
        self.data = np.frombuffer(joined, dtype=np.uint8)
        self.ends = np.flatnonzero(self.data == 0x20)
        self.starts = np.concatenate([[0], self.ends[:-1] + 1]) if len(self.ends) else self.ends
        borders = np.cumsum([len(t) + 1 for t in texts])
        self.text = np.searchsorted(borders, self.starts, side="right")
        self.first = np.searchsorted(self.starts, np.concatenate([[0], borders[:-1]])) if len(texts) else borders
        self._sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def grams(self, n: int, which: int = 0) -> np.ndarray:
        """A hash of the ``n`` words from each word on; those that run into another text are hashed all the same."""
        if which not in self._sums:
            base, offset = BASES[which]
            powers = np.full(len(self.data) + 1, base, dtype=_U)
            powers[0] = 1
            np.cumprod(powers, out=powers)
            back = np.full(len(self.data) + 1, pow(base, -1, 1 << 64), dtype=_U)
            back[0] = 1
            np.cumprod(back, out=back)
            values = _mixed(np.arange(256, dtype=_U) + _U(offset))
            sums = np.concatenate([np.zeros(1, _U), np.cumsum(values[self.data] * powers[:-1])])
            self._sums[which] = sums, back
        sums, back = self._sums[which]
        size = max(0, len(self.starts) - n + 1)
        starts, ends = self.starts[:size], self.ends[n - 1 :]
        return _mixed((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(_U))

    def inside(self, n: int) -> np.ndarray:
        """Whether the ``n`` words from each word on are of one text."""
        size = max(0, len(self.starts) - n + 1)
        return self.text[:size] == self.text[n - 1 :] if size else np.zeros(0, bool)

    def chosen(self, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(word numbers, hashes) of the winnowed k-grams: the least of each window inside ``n`` words, once each."""
        whole = np.flatnonzero(self.inside(n))
        if not len(whole):
            return whole, np.zeros(0, _U)
        hashes = self.grams(k)
        windows = np.lib.stride_tricks.sliding_window_view(hashes, n - k + 1)
        at = np.unique(whole + windows[whole].argmin(axis=1))
        return at, hashes[at]


def chunks(column: pa.Array) -> Iterator[tuple[int, Words]]:
    """(first row, words) over a text column, about ``CHUNK`` bytes at a time; null texts are empty."""
    texts = [b"" if t is None else t.encode() for t in column.to_pylist()]
    first = 0
    while first < len(texts):
        end, size = first, 0
        while end < len(texts) and (end == first or size + len(texts[end]) <= CHUNK):
            size += len(texts[end])
            end += 1
        yield first, Words(texts[first:end])
        first = end


def fingerprints(texts: DataFrame, n: int, k: int) -> DataFrame:
    """(row, at, print): the winnowed k-grams of texts (row, text); ``at`` is a word number."""
    kind = texts.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, words in chunks(batch.column("text")):
                at, hashes = words.chosen(n, k)
                text = words.text[at]
                columns = [batch.column("row").take(pa.array(first + text)), pa.array(at - words.first[text]), pa.array(hashes.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "at", "print"])

    return texts.select("row", "text").mapInArrow(run, f"row {kind}, at long, print long")


def grams_around(texts: DataFrame, n: int, k: int) -> DataFrame:
    """(row, start, gram_a, gram_b): the n-grams of texts (row, text, places) that hold the k-gram at one of the places.

    Two hashes of 64 bits stand for an n-gram, whatever its words.
    """
    kind = texts.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column("places")
            for first, words in chunks(batch.column("text")):
                near = np.zeros(len(words.starts) + 1, dtype=np.int64)
                for i in range(len(words.first)):
                    at = words.first[i] + np.array(places[first + i].as_py(), dtype=np.int64)
                    np.add.at(near, np.maximum(at - (n - k), words.first[i]), 1)
                    np.add.at(near, at + 1, -1)
                start = np.flatnonzero(words.inside(n) & (np.cumsum(near)[: max(0, len(words.starts) - n + 1)] > 0))
                text = words.text[start]
                grams = [pa.array(words.grams(n, which)[start].view(np.int64)) for which in (0, 1)]
                columns = [batch.column("row").take(pa.array(first + text)), pa.array(start - words.first[text]), *grams]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "start", "gram_a", "gram_b"])

    return texts.select("row", "text", "places").mapInArrow(run, f"row {kind}, start long, gram_a long, gram_b long")


def shared_grams(df: DataFrame, reference: DataFrame, n: int, key: str, content: str, reference_content: str, k: int | None = None) -> DataFrame:
    """(key, start): word numbers of ``df``'s texts at which an n-gram of ``reference`` begins. ``key`` is unique.

    Chosen k-grams of the texts meet the reference's distinct ones; texts of which one is found are read again, and their
    n-grams around these places meet the reference's n-grams around the same k-grams. Sizes of all joins are left to the optimizer.
    """
    k = max(1, n // 2) if k is None else k
    mine = df.where(F.col(content).isNotNull()).select(F.col(key).alias("row"), F.col(content).alias("text"))
    theirs = reference.select(F.monotonically_increasing_id().alias("row"), F.col(reference_content).alias("text"))
    known = fingerprints(theirs, n, k).select("print").distinct()
    met = fingerprints(mine, n, k).join(known, "print", "left_semi").select("row", "at")
    # A text's places are one list: as long as the text at most.
    places = met.groupBy("row").agg(F.collect_list("at").alias("places"))
    found = grams_around(mine.join(places, "row"), n, k)
    everywhere = F.sequence(F.lit(0), F.size(F.split("text", " ")) - 1).cast("array<long>")
    grams = grams_around(theirs.withColumn("places", F.coalesce(everywhere, F.array().cast("array<long>"))), n, k)
    return found.join(grams.select("gram_a", "gram_b").distinct(), ["gram_a", "gram_b"], "left_semi").select(F.col("row").alias(key), "start")
