"""Byte-pair vocabularies: learning merges in batches of proposed and then proven steps, and encoding with them.

The corpus shrinks to its distinct pre-tokens with their counts, and these to a table of pair counts that is never counted
again: merges change it by what they add and take away. Inside a task an index from pairs to their places in the words keeps a
merge to these places, and one job proves a whole batch of merges.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.keyed import hot_keys  # noqa: F401 (tests put another one here)
from corpusloom.operators.ordering import first_n
from corpusloom.session import discard, materialize, spread

# Fixed value: the published byte-level pre-tokenizer pattern.
PRE_TOKENS = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCAB_SIZE = 200_000

BYTES = 256
# A word is a string with one character per symbol: U+0000..U+00FF for bytes, then one
# supplementary character per merge. A merge is a plain string replacement.
FIRST_MERGED = 0x10000

#: Pairs whose exact counts, and words whose texts, the driver sees when it proposes merges. They bound its memory; what is
#: proposed is proven over all words, so they change the number of rounds and never the result.
TOP_PAIRS = 4096
PROPOSAL_WORDS = 200_000
FIRST_BATCH, LARGEST_BATCH = 64, 1024
#: Merges that tasks repeat before a batch; beyond, the word table is written again.
REPEATED = 2048
#: Symbols of the words that a task indexes at a time.
INDEXED_SYMBOLS = 1 << 20
#: Bytes of encoded words that a task remembers, and ids that it hands on at a time.
BROADCAST_BYTES, HANDED_IDS = 64 << 20, 1 << 20


@dataclass(frozen=True)
class Merge:
    rank: int
    left: str
    right: str
    count: int


def pre_tokens(content: str | Column, pattern: str = PRE_TOKENS) -> Column:
    return F.regexp_extract_all(content, F.lit(pattern), F.lit(0))


def as_bytes(text: str | Column) -> Column:
    """A text as a string with one character per byte."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def word_counts(df: DataFrame, content: str = "content", pattern: str = PRE_TOKENS) -> DataFrame:
    """(word, n): the corpus shrinks to its distinct pre-tokens, as strings of byte characters."""
    words = df.select(F.explode(pre_tokens(content, pattern)).alias("text"))
    counted = words.groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(as_bytes("text").alias("word"), "n")


def pair_counts(words: DataFrame) -> DataFrame:
    """(pair, n) over neighbouring symbols, weighted by word counts."""
    places = F.sequence(F.lit(1), F.length("word") - 1)
    pairs = words.where(F.length("word") > 1).select("n", F.explode(places).alias("at"), "word")
    return pairs.groupBy(F.substring("word", F.col("at"), F.lit(2)).alias("pair")).agg(F.sum("n").alias("n"))


class PairIndex:
    """The symbols of words in one array, and for every pair of neighbours the places where it stands.

    A merge looks at the places of its pair alone. Symbols of a word are linked: a merged one takes the place of its first part.
    """

    def __init__(self, words: list[str], counts: np.ndarray):
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.symbols = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").astype(np.int64)
        self.word = np.repeat(np.arange(len(words)), lengths)
        self.weight = np.asarray(counts, dtype=np.int64)[self.word]
        place = np.arange(len(self.symbols))
        self.after, self.before = place + 1, place - 1
        ends = np.cumsum(lengths)[lengths > 0]
        self.after[ends - 1] = -1
        self.before[np.concatenate([[0], ends[:-1]])[: len(ends)]] = -1
        first = np.flatnonzero(self.after >= 0)
        codes = self._codes(first)
        order = np.argsort(codes, kind="stable")
        known, start = np.unique(codes[order], return_index=True)
        self.places = dict(zip(known.tolist(), np.split(first[order], start[1:]))) if len(known) else {}

    def copy(self) -> PairIndex:
        other = object.__new__(PairIndex)
        other.word, other.weight, other.places = self.word, self.weight, dict(self.places)
        other.symbols, other.after, other.before = self.symbols.copy(), self.after.copy(), self.before.copy()
        return other

    def _codes(self, at: np.ndarray) -> np.ndarray:
        return self.symbols[at] << 21 | self.symbols[self.after[at]]

    def _counted(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        codes, inverse = np.unique(self._codes(at), return_inverse=True)
        return codes, np.bincount(inverse, weights=self.weight[at], minlength=len(codes)).astype(np.int64)

    def merge(self, pair: str, symbol: str) -> dict[str, int]:
        """Replaces a pair wherever it stands, from the left; the changes of all pair counts."""
        a, b, new = ord(pair[0]), ord(pair[1]), ord(symbol)
        at = self.places.pop(a << 21 | b, np.zeros(0, np.int64))
        at = at[(self.symbols[at] == a) & (self.after[at] >= 0)]
        at = np.sort(at[self.symbols[self.after[at]] == b])
        if a == b and len(at):
            # Of neighbouring places every other one is taken, counted from the first.
            joined = np.concatenate([[False], self.after[at[:-1]] == at[1:]])
            run = np.maximum.accumulate(np.where(joined, 0, np.arange(len(at))))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
        if not len(at):
            return {}
        second = self.after[at]
        left, right = self.before[at], self.after[second]
        gone = np.unique(np.concatenate([left[left >= 0], at, second[right >= 0]]))
        change: dict[int, int] = {}
        for code, n in zip(*(x.tolist() for x in self._counted(gone))):
            change[code] = -n
        self.symbols[at], self.symbols[second] = new, -1
        self.after[at] = right
        self.before[right[right >= 0]] = at[right >= 0]
        left = self.before[at]
        made = np.unique(np.concatenate([left[left >= 0], at[self.after[at] >= 0]]))
        codes = self._codes(made)
        order = np.argsort(codes, kind="stable")
        known, start = np.unique(codes[order], return_index=True)
        for code, places in zip(known.tolist(), np.split(made[order], start[1:]) if len(known) else ()):
            self.places[code] = places
            change[code] = change.get(code, 0) + int(self.weight[places].sum())
        return {chr(code >> 21) + chr(code & (1 << 21) - 1): n for code, n in change.items() if n}

    def words(self) -> list[str]:
        there = self.symbols >= 0
        text = self.symbols[there].astype("<u4").tobytes().decode("utf-32-le")
        ends = np.cumsum(np.bincount(self.word[there], minlength=int(self.word[-1]) + 1 if len(self.word) else 0)).tolist()
        return [text[i:j] for i, j in zip([0, *ends], ends)]


def _proposed(sample: PairIndex, top: list[tuple[str, int]], complete: bool, first: int, size: int) -> list[str]:
    """Pairs in the order in which they are likely to be merged: exact counts, changed as the sample's words change.

    A merge that the sample shows a part of changes counts by so much more. The order ends where a pair that is not
    among ``top`` could come next.
    """
    index, counts = sample.copy(), dict(top)
    unseen = 0 if complete else top[-1][1]
    queue = [(-n, pair) for pair, n in top]
    heapq.heapify(queue)
    out: list[str] = []
    while queue and len(out) < size:
        n, pair = heapq.heappop(queue)
        n = -n
        if counts.get(pair) != n:
            if 0 < counts.get(pair, 0) < n:
                heapq.heappush(queue, (-counts[pair], pair))
            continue
        if out and n <= unseen:
            break
        symbol = chr(first + len(out))
        out.append(pair)
        counts[pair] = 0
        changes = index.merge(pair, symbol)
        seen = -changes.pop(pair, 0)
        for p, change in changes.items():
            if p in counts or change > 0:
                counts[p] = counts.get(p, 0) + (change if seen == n else round(change * n / max(seen, 1)))
                if change > 0 and counts[p] > 0:
                    heapq.heappush(queue, (-counts[p], p))
    return out


def _indexed(batches: Iterator[pa.RecordBatch], symbols: int) -> Iterator[PairIndex]:
    """The words of a task in indexes of about as many symbols, so its memory does not grow with its words; a longer word is one by itself."""
    words, counts, held = [], [], 0
    for batch in batches:
        for word, n in zip(batch.column("word"), batch.column("n").to_numpy()):
            words.append(word.as_py())
            counts.append(n)
            held += len(words[-1])
            if held >= symbols:
                yield PairIndex(words, np.array(counts, np.int64))
                words, counts, held = [], [], 0
    if words:
        yield PairIndex(words, np.array(counts, np.int64))


def _merged(index: PairIndex, pairs: list[str], first: int) -> None:
    for i, pair in enumerate(pairs):
        index.merge(pair, chr(first + i))


def _changes(words: DataFrame, done: list[str], since: int, proposed: list[str]) -> DataFrame:
    """(step, pair, change): what the proposed merges do to pair counts, summed over all words.

    ``done`` are merges, the first of them the symbol ``since``, that the stored words lack.
    """
    start = since + len(done)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for index in _indexed(batches, INDEXED_SYMBOLS):
            _merged(index, done, since)
            for step, pair in enumerate(proposed):
                change = index.merge(pair, chr(start + step))
                if change:
                    columns = [pa.array([step] * len(change), pa.int32()), pa.array(change, pa.string()), pa.array(change.values(), pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["step", "pair", "change"])

    found = words.mapInArrow(run, "step int, pair string, change long")
    return found.groupBy("step", "pair").agg(F.sum("change").alias("change")).where("change <> 0")


def _rewritten(words: DataFrame, done: list[str], since: int) -> DataFrame:
    """The words with the given merges applied."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            for index in _indexed(iter([batch]), INDEXED_SYMBOLS):
                _merged(index, done, since)
                words = pa.array(index.words(), pa.string())
                yield pa.RecordBatch.from_arrays([words, batch.column("n").slice(start, len(words))], names=["word", "n"])
                start += len(words)

    return words.mapInArrow(run, "word string, n long")


def _counts_in_turn(pairs: DataFrame, changes: DataFrame, proposed: list[str], min_count: int) -> list[int]:
    """The exact count of every proposed pair when its turn comes, up to the first that is too rare or larger than the one before."""
    turns = F.broadcast(pairs.sparkSession.createDataFrame(list(enumerate(proposed)), "turn int, pair string"))
    before = changes.join(turns, "pair").where("step < turn").select("turn", F.col("change").alias("n"))
    counted = pairs.join(turns, "pair").select("turn", "n").unionByName(before).groupBy("turn").agg(F.sum("n").alias("n"))
    found = dict(counted.collect())
    counts: list[int] = []
    for turn in range(len(proposed)):
        n = found.get(turn, 0)
        if n < max(1, min_count) or (counts and n > counts[-1]):
            break
        counts.append(n)
    return counts


def _first_beaten(pairs: DataFrame, changes: DataFrame, proposed: list[str], counts: list[int]) -> int:
    """The first step at which some pair comes before the proposed one, with a larger count or the same and a lower name.

    ``counts`` are those of the proposed pairs when their turn comes, and never rise. A pair keeps its count between the
    steps that change it, so each such stretch is looked up among the counts once.
    """
    least, steps = counts[-1], len(counts)
    touched = changes.where(F.col("step") < steps).groupBy("pair").agg(
        F.array_sort(F.collect_list(F.struct("step", "change"))).alias("changes"), F.sum(F.greatest("change", F.lit(0))).alias("most")
    )
    joined = pairs.join(touched, "pair", "full").select("pair", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("most", F.lit(0)).alias("most"), "changes")
    # Among pairs that can at best reach the least count, only those named before a proposed one of that count matter.
    highest, last = F.col("n") + F.col("most"), max(p for p, c in zip(proposed, counts) if c == least)
    near = joined.where((highest > least) | ((highest == least) & (F.col("pair") < last)))
    falling = [-c for c in counts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = steps
        for batch in batches:
            for pair, n, changed in zip(*(c.to_pylist() for c in batch.columns)):
                at = 0
                for change in [*(changed or []), {"step": steps - 1, "change": 0}]:
                    # The pair has n from step ``at`` to the one that changes it; it is beaten wherever a count is lower.
                    until = min(change["step"] + 1, first)
                    step = max(at, bisect_left(falling, -n))
                    while step < until and counts[step] == n and pair >= proposed[step]:
                        step += 1
                    if step < until:
                        first = step
                    at, n = change["step"] + 1, n + change["change"]
        yield pa.RecordBatch.from_arrays([pa.array([first], pa.int32())], names=["step"])

    found = near.select("pair", "n", "changes").mapInArrow(run, "step int").agg(F.min("step")).first()[0]
    return steps if found is None else found


def bpe_train(
    df: DataFrame,
    content: str = "content",
    vocab_size: int = VOCAB_SIZE,
    n_examples: int | None = None,
    key: str = "id",
    min_count: int = 1,
    proposal_words: int = PROPOSAL_WORDS,
) -> list[Merge]:
    """Merges in the order they are learnt, most frequent pair first, ties by symbol order.

    Learns from all texts, or from the first ``n_examples`` by ``key``.

    A round proposes merges from the largest pair counts and the most frequent words, has the tasks carry them out,
    and takes them as far as no other pair comes before them at its step: the list equals one-at-a-time training. The
    first one always holds, since the largest count is exact. Pair counts are then changed, not counted again.
    """
    texts = df if n_examples is None else first_n(df, key, n_examples)
    words = materialize(spread(word_counts(texts, content).where(F.length("word") > 1), "word"), "bpe-words")
    pairs = materialize(pair_counts(words), "bpe-pairs")
    seen = words.orderBy(F.desc("n"), "word").limit(proposal_words).toArrow()
    sample = PairIndex(seen.column("word").to_pylist(), seen.column("n").to_numpy())
    merges: list[Merge] = []
    spelled = {chr(i): chr(i) for i in range(BYTES)}
    size, wanted = FIRST_BATCH, vocab_size - BYTES
    pending: list[str] = []
    while len(merges) < wanted:
        top = [(r.pair, r.n) for r in pairs.orderBy(F.desc("n"), "pair").limit(TOP_PAIRS).collect()]
        if not top or top[0][1] < min_count:
            break
        first = FIRST_MERGED + len(merges)
        proposed = _proposed(sample, top, len(top) < TOP_PAIRS, first, min(size, wanted - len(merges)))
        changes = materialize(_changes(words, pending, first - len(pending), proposed), "bpe-changes")
        counts = _counts_in_turn(pairs, changes, proposed, min_count)
        taken = _first_beaten(pairs, changes, proposed, counts)
        for pair, n in zip(proposed[:taken], counts):
            symbol = chr(FIRST_MERGED + len(merges))
            spelled[symbol] = spelled[pair[0]] + spelled[pair[1]]
            merges.append(Merge(len(merges), spelled[pair[0]], spelled[pair[1]], n))
        changed = pairs.unionByName(changes.where(F.col("step") < taken).select("pair", F.col("change").alias("n")))
        older, pairs = pairs, materialize(changed.groupBy("pair").agg(F.sum("n").alias("n")).where("n > 0"), "bpe-pairs")
        discard(older, changes)
        _merged(sample, proposed[:taken], first)
        pending += proposed[:taken]
        if len(pending) > REPEATED:
            rewritten = _rewritten(words, pending, FIRST_MERGED + len(merges) - len(pending))
            words, pending = materialize(rewritten, "bpe-words"), []
        size = min(2 * size, LARGEST_BATCH) if taken == len(proposed) else max(FIRST_BATCH // 4, 2 * taken)
    return merges


def bpe_merges(df: DataFrame, **options) -> DataFrame:
    """``bpe_train`` as a table; symbols as the hexadecimal of their bytes."""
    merges = bpe_train(df, **options)
    rows = [(m.rank, m.left.encode("latin-1").hex(), m.right.encode("latin-1").hex(), m.count) for m in merges]
    return df.sparkSession.createDataFrame(rows, "rank int, left string, right string, n bigint")


class Vocabulary:
    """Learnt merges as a lookup of pairs. Ids: a byte is its value, a merge is 256 plus its rank; bytes that several
    merges lead to have the id of the first."""

    def __init__(self, merges: list[Merge]):
        symbols = {chr(i): chr(i) for i in range(BYTES)}
        self.merges: dict[str, tuple[int, str]] = {}
        for m in sorted(merges, key=lambda m: m.rank):
            symbol = symbols.setdefault(m.left + m.right, chr(FIRST_MERGED + m.rank))
            self.merges.setdefault(symbols[m.left] + symbols[m.right], (m.rank, symbol))

    @classmethod
    def of(cls, merges: DataFrame) -> Vocabulary:
        """From a table (rank, left, right), as ``bpe_merges`` gives; it has at most as many rows as the vocabulary."""
        rows = merges.select("rank", "left", "right").collect()
        return cls([Merge(r.rank, *(bytes.fromhex(x).decode("latin-1") for x in (r.left, r.right)), 0) for r in rows])

    def encode(self, word: str) -> list[int]:
        """Ids of a pre-token, a string with a character per byte: merges are applied in the order of their ranks."""
        while len(word) > 1:
            held = [(*self.merges[p], p) for p in set(map(str.__add__, word, word[1:])) if p in self.merges]
            if not held:
                break
            _, symbol, pair = min(held)
            word = word.replace(pair, symbol)
        return [ord(c) if ord(c) < BYTES else ord(c) - FIRST_MERGED + BYTES for c in word]


def encoded_words(words: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(word, n, ids) of distinct pre-tokens (word, n): each is encoded once, however often it occurs.

    The vocabulary goes to every executor; its size is that of the merges asked for in training.
    """
    shared = words.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = shared.value.encode
        for batch in batches:
            ids = [encode(word) for word in batch.column("word").to_pylist()]
            yield batch.append_column("ids", pa.array(ids, pa.list_(pa.int32())))

    return words.select("word", "n").mapInArrow(run, "word string, n long, ids array<int>")


def bpe_encode(
    df: DataFrame,
    vocabulary: Vocabulary,
    key: str = "id",
    content: str = "content",
    pattern: str = PRE_TOKENS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """(key, n_chars, input_ids): the ids of every text. ``key`` is unique; texts that are null or empty have no ids.

    A task encodes each different pre-token once, as far as ``broadcast_bytes`` hold what it remembers. Neither texts nor their ids
    are shuffled, only keys, to find repeated ones: the texts of such a key are one, their pre-tokens taken place by place.
    """
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = remembered(shared.value, broadcast_bytes)
        for batch in batches:
            begin, held, out = 0, 0, []
            for i, tokens in enumerate(batch.column("_tokens")):
                out.append([encode(token) for token in tokens.as_py() or ()])
                held += sum(map(len, out[-1]))
                if held >= HANDED_IDS or i + 1 == batch.num_rows:
                    kept = batch.select(["_key", "n_chars"]).slice(begin, len(out))
                    yield kept.append_column("_pieces", pa.array(out, pa.list_(pa.list_(pa.int32()))))
                    begin, held, out = i + 1, 0, []

    repeated = materialize(df.groupBy(F.col(key).alias("_again")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_again"), "bpe-keys")
    again = None if repeated.isEmpty() else F.col("_key").eqNullSafe(F.col("_again"))
    rows = df.select(F.col(key).alias("_key"), F.length(content).alias("n_chars"), pre_tokens(content, pattern).alias("_tokens"))

    def encoded(rows: DataFrame) -> DataFrame:
        return rows.mapInArrow(run, f"_key {dict(rows.dtypes)['_key']}, n_chars int, _pieces array<array<int>>")

    found = encoded(rows if again is None else rows.join(repeated, again, "left_anti"))
    if again is not None:
        placed = encoded(rows.join(repeated, again, "left_semi")).select("_key", "n_chars", F.posexplode_outer("_pieces").alias("_at", "ids"))
        pieces = F.array_sort(F.collect_list(F.when(F.col("_at").isNotNull(), F.struct("_at", "ids"))))
        grouped = placed.groupBy("_key").agg(F.max("n_chars").alias("n_chars"), pieces.alias("_pieces"))
        found = found.unionByName(grouped.withColumn("_pieces", F.transform("_pieces", lambda p: p["ids"])))
    return found.select(F.col("_key").alias(key), "n_chars", F.flatten("_pieces").alias("input_ids"))


def remembered(vocabulary: Vocabulary, most: int) -> Callable[[str], list[int]]:
    """The encoding of pre-tokens as texts, with those of before looked up, as far as ``most`` bytes hold them."""
    known: dict[str, list[int]] = {}
    size = 0

    def encode(token: str) -> list[int]:
        nonlocal size
        ids = known.get(token)
        if ids is None:
            ids = vocabulary.encode(token.encode().decode("latin-1"))
            size += len(token) + 4 * len(ids) + 32
            if size > most:
                known.clear()
                size = 0
            else:
                known[token] = ids
        return ids

    return encode


def bpe_tokenizer(vocabulary: Vocabulary, pattern: str = PRE_TOKENS) -> Callable[[Column], Column]:
    """A tokenizer for any place that takes one, such as ``pretokenize``: a task encodes each different pre-token once.

    Nothing is shuffled; a task remembers up to a million pre-tokens.
    """

    @F.pandas_udf("array<array<int>>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, list[int]] = {}
        for words in batches:
            out = []
            for text in words:
                ids = []
                for word in () if text is None else text:
                    if word not in known:
                        if len(known) > 1_000_000:
                            known.clear()
                        known[word] = vocabulary.encode(word.encode().decode("latin-1"))
                    ids.append(known[word])
                out.append(None if text is None else ids)
            yield pd.Series(out)

    return lambda c: F.flatten(encode(pre_tokens(c, pattern)))
