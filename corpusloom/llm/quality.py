"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import small_or_shuffled, table, text_of
from corpusloom.llm.registry import query
from corpusloom.llm.textblocks import Block, blocks, mix, repeated, sums_by_doc
from corpusloom.session import materialize


@dataclass(frozen=True)
class Rules:
    """``buckets`` hashed unigrams and bigrams; ``smoothing`` is added to every bucket of both multinomials."""

    buckets: int = 1 << 17
    smoothing: float = 1.0
    min_words: int = 50
    repeat_percent: int = 50
    bins: int = 2048


def gram_buckets(block: Block, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every word and every pair of neighbouring words."""
    starts, ends = block.words()
    doc, word = block.doc_of(starts), block.hashes(starts, ends)
    pair = mix(word[:-1] * np.uint64(0x9FB21C651E98DF25) + word[1:])
    inside = doc[:-1] == doc[1:]
    keys = np.concatenate([word, pair[inside]]) % np.uint64(n_buckets)
    return np.concatenate([doc, doc[:-1][inside]]), keys.astype(np.int64)


def gram_counts(df: DataFrame, text: str, trusted: str, n_buckets: int) -> DataFrame:
    """(bucket, raw, target): n-gram counts of all documents, and of those where ``trusted`` is true."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, n_buckets), dtype=np.int64)
        for batch in batches:
            marked = batch.column("trusted").to_numpy(zero_copy_only=False).astype(bool)
            for first, end, block in blocks(batch.column("text")):
                doc, key = gram_buckets(block, n_buckets)
                counts[0] += np.bincount(key, minlength=n_buckets)
                counts[1] += np.bincount(key[marked[first:end][doc]], minlength=n_buckets)
        seen = np.flatnonzero(counts[0])
        for part in np.array_split(seen, max(1, len(seen) // 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array(c[part]) for c in counts)], names=["bucket", "raw", "target"])

    rows = df.select(text_of(text).alias("text"), F.coalesce(F.col(trusted), F.lit(False)).alias("trusted"))
    counted = rows.mapInArrow(count, "bucket long, raw long, target long")
    return counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame, rules: Rules = Rules()) -> np.ndarray:
    """log(target / raw) of every bucket; at most ``rules.buckets`` rows reach the driver."""
    both = np.zeros((2, rules.buckets))
    for bucket, raw, target in counts.collect():
        both[:, bucket] = raw, target
    both += rules.smoothing
    raw, target = np.log(both / both.sum(axis=1, keepdims=True))
    return target - raw


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double"


def measures(df: DataFrame, ratios: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The base counts of each row and ``ratio``, its mean log ratio per n-gram (0 without words).

    A null text has no words. Every row is measured by itself, so repeated ids and rows stay.
    """
    kind = df.schema[doc_id].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(ratios)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = shared.value
        for batch in batches:
            for first, end, block in blocks(batch.column("text")):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, end - first), *map(pa.array, _measured(block, table_))],
                    names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "ratio"],
                )

    rows = df.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    return rows.mapInArrow(measure, f"doc_id {kind}, {MEASURES}")


def _measured(block: Block, ratios: np.ndarray) -> tuple[np.ndarray, ...]:
    data = block.data
    starts, ends = block.words()
    n_words = block.per_doc(starts)

    # Code points in words: bytes that do not continue a UTF-8 sequence.
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    word_chars = sums_by_doc(block, starts, lead[ends] - lead[starts])

    symbol = np.zeros(256, dtype=bool)
    symbol[list(b"#*$%&|<>")] = True
    n_symbols = block.per_doc(np.flatnonzero(symbol[data]))

    line_starts, line_ends = block.spans(data == 0x0A)
    filled = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[filled], line_ends[filled]
    _, later = repeated(block.doc_of(line_starts), block.hashes(line_starts, line_ends))
    n_dup_lines = sums_by_doc(block, line_starts, later.astype(np.int64))

    doc, word = block.doc_of(starts), block.hashes(starts, ends)
    inside = doc[:-2] == doc[2:]
    three = mix(mix(word[:-2] * np.uint64(0x9FB21C651E98DF25) + word[1:-1]) * np.uint64(0xD6E8FEB86659FD93) + word[2:])
    often = np.zeros(len(three), dtype=bool)
    often[inside], _ = repeated(doc[:-2][inside], three[inside])
    covered = np.zeros(len(word), dtype=bool)
    for shift in range(3):
        covered[shift : shift + len(often)] |= often
    n_repeat = sums_by_doc(block, starts, covered.astype(np.int64))

    gram_doc, key = gram_buckets(block, len(ratios))
    total = np.bincount(gram_doc, weights=ratios[key], minlength=len(block))
    ratio = total / np.maximum(np.bincount(gram_doc, minlength=len(block)), 1)
    return n_words, word_chars, n_symbols, n_dup_lines, n_repeat, ratio


def best_threshold(scored: DataFrame, score: str, good: str, bins: int) -> float:
    """The cut with the highest share of good rows kept plus bad rows dropped, from a histogram of ``bins`` bins.

    Ties take the lowest cut. Without both good and bad rows the cut is 0: as likely under the target as under the corpus.
    """
    low, high = scored.agg(F.min(score), F.max(score)).first()
    if low is None or low == high:
        return 0.0
    step = (high - low) / bins
    at = F.least(F.floor((F.col(score) - F.lit(low)) / F.lit(step)), F.lit(bins - 1))
    rows = scored.groupBy(at.alias("bin"), F.col(good).alias("good")).count().collect()
    seen = np.zeros((2, bins))
    for bin_, is_good, n in rows:
        seen[int(is_good), bin_] += n
    if not seen.sum(axis=1).all():
        return 0.0
    share = np.concatenate([[[0.0], [0.0]], np.cumsum(seen, axis=1)], axis=1) / seen.sum(axis=1, keepdims=True)
    return float(low + step * int(np.argmax(share[0] - share[1])))


def quality_rules(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: Rules = Rules()
) -> DataFrame:
    """One row per document: base counts, ``ratio``, ``base_failed`` and ``kept``.

    The target multinomial is counted over all documents that ``labels`` trusts (quality 1, toxic not 1), the raw one over
    all documents. The threshold is read off the labelled documents' ratios and then holds for every document.
    Null texts have no words, so they fail the base rule; null ids are never trusted; a document labelled twice is
    trusted when any of its labels says so. Other columns of either table are not read.
    """
    said = labels.where(F.col(doc_id).isNotNull() & F.col("quality").isNotNull())
    good = F.max((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) != 1))
    said = said.groupBy(F.col(doc_id).alias("doc_id")).agg(good.alias("trusted"), F.max("quality").alias("quality"))
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    marked = narrow.join(small_or_shuffled(said.where("trusted").select("doc_id", "trusted")), "doc_id", "left")
    ratios = log_ratios(gram_counts(marked, "text", "trusted", rules.buckets), rules)
    rows = materialize(measures(narrow, ratios), "quality")
    judged = rows.join(said.select("doc_id", (F.col("quality") == 1).alias("good")), "doc_id").where("n_words > 0")
    cut = best_threshold(judged, "ratio", "good", rules.bins)
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.repeat_percent * F.col("n_words"))
    return rows.withColumns({"base_failed": failed, "kept": ~failed & (F.col("ratio") >= cut), "threshold": F.lit(cut)})


@query("op8_quality_rules")
def op8_quality_rules(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
