"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax.

P(word | history) = P(class | history) * P(word | class). Classes come from counts over all training text: the most
frequent words are classes of their own, other words are classed by frequency band and by a group of word endings that
keep the same company. P(class | history) is a softmax over summed weights of hashed features of the preceding words.
Words beyond the ``top`` most frequent meet their counts in a shuffle join, so no table that grows with the corpus is
broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import crc_of, table, text_of
from corpusloom.llm.registry import query
from corpusloom.llm.textblocks import Block, blocks, lowered, mix
from corpusloom.session import materialize

_U = np.uint64
END, BEGIN = _U(0x5851F42D4C957F2D), _U(0x14057B7EF767814F)


@dataclass(frozen=True)
class Rules:
    """``smoothing`` belongs to the base score. ``top`` words are broadcast with their counts: 1 MB, whatever the corpus."""

    smoothing: float = 0.1
    top: int = 1 << 16
    #: Words that are classes of their own, and the rank that parts the two bands of the other top words.
    single: int = 24
    band: int = 3000
    groups: int = 6
    shapes: int = 1 << 12
    anchors: int = 64
    features: int = 1 << 13
    #: Each round takes its own share of the training documents; together they are one pass over all of them.
    rounds: int = 3
    rate: float = 0.25
    #: Tokens between two steps along the gradient, and tokens whose softmax is taken at once.
    batch: int = 32_768
    part: int = 8192
    seed: int = 11


@dataclass(frozen=True)
class Vocabulary:
    """Counts of all training tokens, and what of them is small enough for every task."""

    total: int
    distinct: int
    keys: np.ndarray  # sorted keys of the top words
    counts: np.ndarray


@dataclass(frozen=True)
class Classes:
    of_top: np.ndarray  # class of each top word
    log_inside: np.ndarray  # log10 P(word | class) of each top word
    group_of_shape: np.ndarray
    first_tail: int  # classes from here on hold the words beyond the top ones, one per group
    log_prior: np.ndarray
    tail_mass: np.ndarray
    unseen: np.ndarray  # P(unseen word | tail class)


class Tokens:
    """The tokens of a block: lower-cased words and an end per document."""

    def __init__(self, raw: Block, rules: Rules):
        block = lowered(raw)
        starts, ends = block.words()
        self.lengths = block.per_doc(starts) + 1
        stops = np.cumsum(self.lengths)
        self.doc = np.repeat(np.arange(len(block)), self.lengths)
        self.rank = np.arange(len(self.doc)) - np.repeat(stops - self.lengths, self.lengths)
        word = np.ones(len(self.doc), dtype=bool)
        word[stops - 1] = False
        self.key = np.full(len(self.doc), END, dtype=_U)
        self.key[word] = block.hashes(starts, ends)
        self.shape = np.zeros(len(self.doc), dtype=np.int64)
        self.shape[word] = _shapes(block, starts, ends, rules.shapes)

    def before(self, distance: int) -> np.ndarray:
        """The key so many tokens back in the same document."""
        out = np.full(len(self.key), BEGIN, dtype=_U)
        out[distance:] = self.key[:-distance]
        out[self.rank < distance] = BEGIN
        return out

    def features(self, size: int) -> np.ndarray:
        """Hashed features, 4 x tokens: the word before, the two before, and skips to the second and third word back."""
        one, two, three = self.before(1), self.before(2), self.before(3)
        raw = [one * _U(3) + _U(1), mix(two) + one * _U(5) + _U(2), two * _U(7) + _U(3), three * _U(9) + _U(4)]
        return np.stack([(mix(r) % _U(size)).astype(np.int64) for r in raw])


def _shapes(block: Block, starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """A bucket for the last three bytes of each word."""
    code = np.zeros(len(starts), dtype=_U)
    for back in range(1, 4):
        byte = block.data[np.maximum(ends - back, starts)].astype(_U)
        code = code * _U(257) + np.where(ends - back >= starts, byte + _U(1), _U(0))
    return (mix(code + _U(1)) % _U(size)).astype(np.int64)


def in_training(doc_id: str = "doc_id"):
    """The fold that is learned from: crc32 of the id as text, modulo 10, is not 0."""
    return crc_of(doc_id) % 10 != 0


def _counted(key: np.ndarray, shape: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, their shapes, and how often they stand there. Equal keys have one shape."""
    order = np.argsort(key)
    ranked = key[order]
    cuts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]][: len(ranked)])
    times = np.diff(np.r_[cuts, len(ranked)]) if n is None else np.add.reduceat(n[order], cuts) if len(cuts) else n
    return ranked[cuts], shape[order[cuts]], times


def token_counts(df: DataFrame, text: str, rules: Rules) -> DataFrame:
    """(key, shape, n): how often each token stands in ``df``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def merged():
            return _counted(*(np.concatenate(x) for x in zip(*held)))

        def rows(key, shape, n):
            for at in range(0, len(key), 200_000):
                part = slice(at, at + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(key[part].view(np.int64)), pa.array(shape[part]), pa.array(n[part])], names=["key", "shape", "n"])

        for batch in batches:
            for _, _, block in blocks(batch.column("text")):
                tokens = Tokens(block, rules)
                held.append(_counted(tokens.key, tokens.shape))
                size += len(held[-1][0])
                if size > 500_000:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > 350_000:
                        yield from rows(*held[0])
                        held, size = [], 0
        if held:
            yield from rows(*merged())

    counted = df.select(text_of(text).alias("text")).mapInArrow(count, "key long, shape long, n long")
    return counted.groupBy("key").agg(F.min("shape").alias("shape"), F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, rules: Rules) -> tuple[Vocabulary, np.ndarray]:
    """The vocabulary, and the shapes of its top words; at most ``rules.top`` rows reach the driver."""
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # Where to cut comes from counts of counts in bins, a fixed number of them, so no sort sends rows to the driver.
    bin_ = F.floor(F.log2("n") * 128).cast("int")
    sizes = sorted(counts.groupBy(bin_.alias("bin")).count().collect(), reverse=True)
    taken = np.cumsum([size for _, size in sizes])
    fit = [b for (b, _), up_to in zip(sizes, taken) if up_to <= rules.top]
    rows = counts.where(bin_ >= min(fit)) if fit else counts.where("false")
    rows = rows.select("key", "shape", "n").toPandas().sort_values(["n", "key"], ascending=[False, True])
    key = rows["key"].to_numpy(dtype=np.int64).view(_U)
    order = np.argsort(key)
    return Vocabulary(total, distinct, key[order], rows["n"].to_numpy(dtype=np.int64)[order]), rows["shape"].to_numpy(dtype=np.int64)[order]


def _place(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index of each wanted key in the sorted keys, -1 where it is missing."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


class Places:
    """The places of wanted keys among the top words, by a hash table: a key stands in its slot or in one of the next."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max((4 * len(keys)).bit_length(), 3)
        self.slots = np.full(1 << self.bits, -1, dtype=np.int32)
        self.longest = 0
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            # Of the keys that want a free slot the last one gets it; the others go on.
            free = self.slots[slot] < 0
            self.slots[slot[free]] = left[free]
            out = self.slots[slot] != left
            left, slot = left[out], slot[out] + 1 & (1 << self.bits) - 1
            self.longest += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> _U(64 - self.bits)).astype(np.int64)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Index of each wanted key in the keys, -1 where it is missing."""
        if not len(self.keys):
            return np.full(len(wanted), -1)
        slot = self._slot(wanted)
        found = self.slots[slot].astype(np.int64)
        left = np.flatnonzero(found >= 0)
        left = left[self.keys[found[left]] != wanted[left]]
        for _ in range(1, self.longest):
            slot[left] = slot[left] + 1 & (1 << self.bits) - 1
            found[left] = self.slots[slot[left]]
            left = left[found[left] >= 0]
            left = left[self.keys[found[left]] != wanted[left]]
        found[left] = -1
        return found


def _summed(rows: DataFrame, width: int) -> np.ndarray:
    """Sum of the float vectors (part, values) that tasks emit, part by part; the sums have a fixed size."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, values in zip(batch.column("part").to_pylist(), batch.column("values")):
                vector = np.frombuffer(values.as_buffer(), dtype="<f4").astype(np.float64)
                sums[part] = sums[part] + vector if part in sums else vector
        for part, vector in sums.items():
            yield pa.RecordBatch.from_pydict({"part": [part], "values": [vector.astype("<f8").tobytes()]}, schema=_PARTS)

    found = {r["part"]: np.frombuffer(r["values"], dtype="<f8") for r in rows.repartition("part").mapInArrow(add, "part long, values binary").collect()}
    return np.concatenate([found[p] for p in sorted(found)]) if found else np.zeros(width)


_PARTS = pa.schema([("part", pa.int64()), ("values", pa.binary())])


def _parts(vector: np.ndarray, size: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    for part, at in enumerate(range(0, len(vector), size)):
        yield pa.RecordBatch.from_pydict({"part": [part], "values": [vector[at : at + size].astype("<f4").tobytes()]}, schema=_PARTS)


def company(df: DataFrame, text: str, words: Vocabulary, rules: Rules) -> np.ndarray:
    """Shapes x anchors: how often words of a shape stand within four words after each of the most frequent words."""
    frequent = np.argsort(-words.counts, kind="stable")[: rules.anchors]
    anchors = np.sort(words.keys[frequent])
    shared = df.sparkSession.sparkContext.broadcast(anchors)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(rules.shapes * rules.anchors)
        for batch in batches:
            for _, _, block in blocks(batch.column("text")):
                tokens = Tokens(block, rules)
                anchor = _place(shared.value, tokens.key)
                for distance in range(1, 5):
                    met = np.flatnonzero((anchor[:-distance] >= 0) & (tokens.rank[distance:] >= distance))
                    cell = tokens.shape[met + distance] * rules.anchors + anchor[met]
                    seen += np.bincount(cell, minlength=len(seen))
        yield from _parts(seen)

    rows = df.select(text_of(text).alias("text")).mapInArrow(count, "part long, values binary")
    return _summed(rows, rules.shapes * rules.anchors).reshape(rules.shapes, rules.anchors)


def group_shapes(seen: np.ndarray, groups: int) -> np.ndarray:
    """k-means over the shapes' company, weighted by how often they occur; starts from the furthest heavy shapes."""
    weight = seen.sum(axis=1)
    point = np.sqrt((seen + seen.sum(axis=0) / max(seen.sum(), 1)) / (weight[:, None] + 1))
    point /= np.maximum(np.linalg.norm(point, axis=1, keepdims=True), 1e-12)
    heavy = weight >= np.quantile(weight, 0.9)
    centres = [point[int(weight.argmax())]]
    while len(centres) < groups:
        far = np.min([1 - point @ c for c in centres], axis=0) * heavy
        centres.append(point[int(far.argmax())])
    centre = np.stack(centres)
    group = np.zeros(len(point), dtype=np.int64)
    for _ in range(25):
        group = (point @ centre.T).argmax(axis=1)
        for g in range(groups):
            mine = group == g
            if weight[mine].sum() > 0:
                mean = (point[mine] * weight[mine, None]).sum(axis=0)
                centre[g] = mean / np.linalg.norm(mean)
    return group


def make_classes(counts: DataFrame, words: Vocabulary, shapes: np.ndarray, group: np.ndarray, rules: Rules) -> Classes:
    """Classes: an end, single words, then each group's upper and lower band, then each group's words beyond the top."""
    g = rules.groups
    rank = np.empty(len(words.keys), dtype=np.int64)
    rank[np.argsort(-words.counts, kind="stable")] = np.arange(len(rank))
    first_band, first_tail = 1 + rules.single, 1 + rules.single + 2 * g
    of_top = np.where(rank < rules.single, 1 + rank, first_band + group[shapes] + g * (rank >= rules.band))
    of_top[words.keys == END] = 0
    mass = np.zeros(first_tail + g)
    mass[:first_tail] = np.bincount(of_top, weights=words.counts, minlength=first_tail)
    # Mass and singletons of the tail by shape: a row per shape reaches the driver.
    once = np.zeros(rules.shapes)
    every = np.zeros(rules.shapes)
    for shape, n, n_once in counts.groupBy("shape").agg(F.sum("n"), F.sum((F.col("n") == 1).cast("long"))).collect():
        every[shape], once[shape] = n, n_once
    every -= np.bincount(shapes, weights=words.counts, minlength=rules.shapes)
    once -= np.bincount(shapes, weights=words.counts == 1, minlength=rules.shapes)
    tail_mass = np.bincount(group, weights=every, minlength=g)
    tail_once = np.bincount(group, weights=once, minlength=g)
    mass[first_tail:] = tail_mass
    # An unseen word is as likely as a word seen once (Good-Turing); a tail nothing was seen of holds only unseen ones.
    unseen = np.where(tail_mass > 0, np.clip(tail_once / np.maximum(tail_mass, 1), 1e-4, 0.5), 1.0)
    log_inside = np.log10(words.counts / mass[of_top]) if len(of_top) else np.zeros(0)
    log_prior = np.log((mass + 0.5) / (mass + 0.5).sum())
    return Classes(of_top, log_inside, group, first_tail, log_prior, tail_mass, unseen)


def _classes_of(tokens: Tokens, top: Places, classes: Classes) -> tuple[np.ndarray, np.ndarray]:
    """(index among the top words or -1, class) of every token."""
    at = top.find(tokens.key)
    tail = classes.first_tail + classes.group_of_shape[tokens.shape]
    own = np.where(at >= 0, classes.of_top[at], tail) if len(top.keys) else tail
    return at, np.where(tokens.key == END, 0, own)


def _room(rules: Rules, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Arrays that one softmax after the other is taken in."""
    return np.empty((rules.part, classes), dtype=np.float32), np.empty((rules.part, classes), dtype=np.float32)


def _log_softmax(weights: np.ndarray, prior: np.ndarray, features: np.ndarray, room: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """log P(class), tokens x classes; it stands in ``room``, until the next call with the same."""
    shape = (features.shape[1], len(prior))
    z, more = (np.empty(shape, dtype=np.float32) if room is None else room[k][: shape[0]] for k in range(2))
    # "clip" spares the copy behind a check of the indexes; hashed features are never out of range.
    np.take(weights, features[0], axis=0, out=z, mode="clip")
    for f in features[1:]:
        z += np.take(weights, f, axis=0, out=more, mode="clip")
    z += prior
    z -= z.max(axis=1, keepdims=True)
    z -= np.log(np.exp(z, out=more).sum(axis=1, keepdims=True))
    return z


def _updated(df: DataFrame, weights: np.ndarray, words: Vocabulary, classes: Classes, rules: Rules) -> np.ndarray:
    """One distributed round: every task steps along the gradients of its batches; rows of weights are averaged over
    tasks in proportion to how often a task has seen their feature."""
    shared = df.sparkSession.sparkContext.broadcast((weights, words, classes))
    n_classes = weights.shape[1]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, words, classes = shared.value
        w = start.copy()
        square = np.full_like(w, 0.5)
        prior = classes.log_prior.astype(np.float32)
        seen = np.zeros(len(w), dtype=np.float32)
        top = Places(words.keys)
        room = _room(rules, n_classes)
        errors, sums = np.empty((n_classes, rules.batch)), np.empty((n_classes, len(w)))
        for batch in batches:
            for _, _, block in blocks(batch.column("text")):
                tokens = Tokens(block, rules)
                features = tokens.features(len(w))
                _, gold = _classes_of(tokens, top, classes)
                seen += np.bincount(features.ravel(), minlength=len(w)).astype(np.float32)
                for at in range(0, len(gold), rules.batch):
                    f = features[:, at : at + rules.batch]
                    error = errors[:, : f.shape[1]]
                    for a in range(0, f.shape[1], rules.part):
                        part = slice(a, a + rules.part)
                        p = np.exp(z := _log_softmax(w, prior, f[:, part], room), out=z)
                        p[np.arange(len(p)), gold[at : at + rules.batch][part]] -= 1
                        error[:, part] = p.T
                    flat, each = f.ravel(), np.empty(f.shape)
                    for c in range(n_classes):
                        each[:] = error[c]
                        sums[c] = np.bincount(flat, weights=each.ravel(), minlength=len(w))
                    gradient = sums.T.astype(np.float32, order="C")
                    square += gradient**2
                    w -= rules.rate * gradient / np.sqrt(square)
        if seen.any():
            yield from _parts(np.concatenate([(w * seen[:, None]).ravel(), seen]))

    rows = df.select(text_of("text").alias("text")).mapInArrow(step, "part long, values binary")
    total = _summed(rows, 0)
    if not len(total):
        return weights
    seen = total[-len(weights) :]
    mean = total[: -len(weights)].reshape(-1, n_classes) / np.maximum(seen, 1)[:, None]
    return np.where(seen[:, None] > 0, mean, weights).astype(np.float32)


def score(df: DataFrame, train: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score): log10 probabilities of every text of ``df``.

    ``train`` has the documents to learn from, in the same columns. A token is a lower-cased word or the end of a text;
    null texts are empty and have an end only. All words that training has not seen count as one word in the base, and
    as one per group of endings in the model. Each row is scored by itself, so repeated ids and rows keep theirs; without
    training documents every word is unseen. Words are told apart by 64-bit hashes. Other columns are not read.
    """
    learn = train.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    counts = materialize(token_counts(learn, "text", rules), "token-counts")
    words, shapes = vocabulary(counts, rules)
    group = group_shapes(company(learn, "text", words, rules), rules.groups)
    classes = make_classes(counts, words, shapes, group, rules)
    weights = np.zeros((rules.features, len(classes.log_prior)), dtype=np.float32)
    share = (crc_of("doc_id") / 10).cast("long") % rules.rounds
    for r in range(rules.rounds):
        weights = _updated(learn.where(share == r), weights, words, classes, rules)
    scored = materialize(_scored(df, weights, words, classes, doc_id, text, rules), "scored")

    # Words beyond the top ones: their counts come by join. The frequent keys are not among them, so no key is hot.
    tail = scored.select("row", F.explode(F.arrays_zip("tail_key", "tail_n", "tail_group"))).select("row", "col.*")
    met = tail.join(counts.select(F.col("key").alias("tail_key"), F.col("n").alias("c")), "tail_key", "left")
    c = F.coalesce("c", F.lit(0))
    floor = words.total + rules.smoothing * (words.distinct + 1)
    of_group = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.greatest(F.col("tail_group"), F.lit(0)) + 1)
    inside = F.when(c > 0, F.log10((1 - of_group(classes.unseen)) * c / of_group(np.maximum(classes.tail_mass, 1))))
    extra = met.groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("tail_n")).otherwise(0)).alias("known"),
        F.sum(F.col("tail_n") * F.log10((c + rules.smoothing) / floor)).alias("base"),
        F.sum(F.when(F.col("tail_group") >= 0, F.col("tail_n") * inside.otherwise(F.log10(of_group(classes.unseen))))).alias("more"),
    )
    add = lambda c, d: F.col(c) + F.coalesce(F.col(d), F.lit(0))
    return scored.join(extra, "row", "left").select(
        "doc_id", "n_tokens", add("n_known", "known").alias("n_known"), F.lit(words.total).cast("long").alias("train_tokens"),
        add("base_score", "base").alias("base_score"), add("score", "more").alias("score"),
    )


def _scored(df: DataFrame, weights: np.ndarray, words: Vocabulary, classes: Classes, doc_id: str, text: str, rules: Rules) -> DataFrame:
    """Per row what the top words and the classes give, and the other words with how often they stand in it."""
    kind = df.schema[doc_id].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast((weights, words, classes))
    floor = words.total + rules.smoothing * (words.distinct + 1)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, words, classes = shared.value
        prior = classes.log_prior.astype(np.float32)
        base_of_top = np.log10((words.counts + rules.smoothing) / floor)
        top_words = Places(words.keys)
        room = _room(rules, len(prior))
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for first, end, block in blocks(batch.column("text")):
                tokens = Tokens(block, rules)
                n_docs = len(block)
                at, gold = _classes_of(tokens, top_words, classes)
                features = tokens.features(len(weights))
                log_p = np.empty(len(gold))
                for a in range(0, len(gold), rules.part):
                    part = slice(a, a + rules.part)
                    z = _log_softmax(weights, prior, features[:, part], room)
                    log_p[part] = z[np.arange(len(z)), gold[part]]
                log_p /= np.log(10)
                top, rest = at >= 0, at < 0
                log_p[top] += classes.log_inside[at[top]]
                known = np.bincount(tokens.doc[top], minlength=n_docs)
                base = np.bincount(tokens.doc[top], weights=base_of_top[at[top]], minlength=n_docs).astype(np.float64)
                doc, key = tokens.doc[rest], tokens.key[rest]
                order = np.lexsort((key, doc))
                new = np.ones(len(order), dtype=bool)
                new[1:] = (doc[order][1:] != doc[order][:-1]) | (key[order][1:] != key[order][:-1])
                cut = np.flatnonzero(new)
                n = np.diff(np.r_[cut, len(order)])
                pick = order[cut]
                lists = np.searchsorted(doc[pick], np.arange(n_docs + 1)).astype(np.int32)
                # The end is a class of one token even if it is rarer than the top words: group -1 adds nothing.
                group = np.where(key == END, -1, classes.group_of_shape[tokens.shape[rest]])[pick]
                columns = [
                    pa.array(row + np.arange(n_docs)), batch.column("doc_id").slice(first, end - first), pa.array(tokens.lengths.astype(np.int64)),
                    pa.array(known.astype(np.int64)), pa.array(base), pa.array(np.bincount(tokens.doc, weights=log_p, minlength=n_docs)),
                    *(pa.ListArray.from_arrays(lists, pa.array(x)) for x in (key[pick].view(np.int64), n.astype(np.int32), group.astype(np.int32))),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "n_tokens", "n_known", "base_score", "score", "tail_key", "tail_n", "tail_group"])
                row += n_docs

    rows = df.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    return rows.mapInArrow(
        apply,
        f"row long, doc_id {kind}, n_tokens long, n_known long, base_score double, score double, tail_key array<long>, tail_n array<int>, tail_group array<int>",
    )


@query("op1_lm_scoring")
def op1_lm_scoring(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, docs.where(in_training()))
    return scored.select("doc_id", (~in_training()).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
