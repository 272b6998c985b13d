"""Language identification by a linear-chain conditional random field over the words of a text.

Every word gets a label. Its emission score sums learned weights of hashed features: byte n-grams, the same n-grams
where they touch a word border (affixes), and the whole word (lexicon). A learned matrix scores transitions between
neighbouring labels. Forward-backward gives each word's label distribution; a document's is the mean over its words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import crc_of, table, text_of
from corpusloom.llm.registry import query
from corpusloom.llm.textblocks import mix

WORD = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"


@dataclass(frozen=True)
class Rules:
    """The training sample is bounded: ``docs_per_label`` documents for each language, and about ``chars`` characters
    of each: of a longer one, ``pieces`` stretches spread over the whole text.

    Sampled documents are cut into stretches of ``stretch`` words that are mixed across languages, so that the
    transitions see code-switched text.
    """

    docs_per_label: int = 150
    chars: int = 8000
    pieces: int = 8
    features: int = 1 << 16
    stretch: int = 24
    sequence: int = 96
    epochs: int = 30
    rate: float = 0.3
    decay: float = 1e-6
    step: int = 64
    seed: int = 7
    #: Distinct words whose scores a task remembers.
    remembered: int = 100_000
    #: Characters labelled at once; a longer document is taken alone.
    block: int = 500_000


@dataclass(frozen=True)
class Model:
    labels: list[str]
    weights: np.ndarray  # features x labels
    transitions: np.ndarray  # labels x labels, log scores


def word_features(words: list[str], n_features: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature ids, first feature of each word): byte n-grams of 2 to 4 with the borders, and the whole word."""
    data = np.frombuffer(("\n" + "\n".join(words) + "\n").encode(), dtype=np.uint8)
    border = np.flatnonzero(data == 0x0A)
    starts, ends = border[:-1], border[1:]  # both borders belong to the word's n-grams
    value = mix(np.arange(1, 257, dtype=np.uint64))[data]
    ids, owners = [], []
    rolled = np.zeros(len(data), dtype=np.uint64)
    for n in range(1, 5):
        rolled = rolled[: len(data) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + value[n - 1 :]
        if n == 1:
            continue
        at = np.arange(len(rolled))
        owner = np.searchsorted(starts, at, side="right") - 1
        whole = (owner < len(words)) & (at + n - 1 <= ends[np.minimum(owner, len(words) - 1)])
        ids.append(mix(rolled[whole] + np.uint64(n)))
        owners.append(owner[whole])
    power = np.cumprod(np.full(len(data), 0x9E3779B97F4A7C15 | 1, dtype=np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * power)])
    back = pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64)
    inverse = np.cumprod(np.full(len(data), back, dtype=np.uint64))
    ids.append(mix((sums[ends] - sums[starts + 1]) * inverse[starts + 1] + np.uint64(99)))
    owners.append(np.arange(len(words)))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    ids = (np.concatenate(ids)[order] % np.uint64(n_features)).astype(np.int64)
    return ids, np.searchsorted(owner[order], np.arange(len(words)))


def emissions(words: list[str], weights: np.ndarray) -> np.ndarray:
    """Scores words x labels."""
    if not words:
        return np.zeros((0, weights.shape[1]), weights.dtype)
    ids, first = word_features(words, len(weights))
    return np.add.reduceat(weights[ids], first, axis=0)


def marginals(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, step: int, pairs: np.ndarray | None = None) -> np.ndarray:
    """Label distribution of every word by forward-backward; ``scores`` has the words of all texts in a row.

    Texts are cut into pieces of ``step`` words. The product of a piece's step matrices carries the chain across it,
    so pieces of all texts advance together: first their products, then the states at their borders, then the
    words inside. The chain starts from a uniform state; the result is exact for texts of any length. The expected number
    of every two neighbouring labels is added to ``pairs`` (labels x labels).
    """
    n, k = scores.shape
    pieces = -(-lengths // step)
    total = int(pieces.sum())
    text_of_piece = np.repeat(np.arange(len(lengths)), pieces)
    first_piece = np.cumsum(pieces) - pieces
    rank = np.arange(total) - first_piece[text_of_piece]
    start = (np.cumsum(lengths) - lengths)[text_of_piece] + rank * step
    size = np.minimum(step, lengths[text_of_piece] - rank * step)
    at = start[:, None] + np.arange(step)
    real = np.arange(step) < size[:, None]
    psi = np.ones((total, step, k))
    psi[real] = np.exp(scores - scores.max(axis=1, keepdims=True))
    move = np.exp(transitions - transitions.max())

    product = np.broadcast_to(np.eye(k), (total, k, k)).copy()
    for t in range(step):
        on = size > t
        if not on.any():
            break
        nxt = (product[on] @ move) * psi[on, t][:, None, :]
        product[on] = nxt / nxt.max(axis=(1, 2), keepdims=True)

    into, out = np.full((total, k), 1.0 / k), np.full((total, k), 1.0)
    for r in range(1, int(pieces.max(initial=0))):
        p = first_piece[pieces > r] + r
        v = np.einsum("pi,pij->pj", into[p - 1], product[p - 1])
        into[p] = v / v.sum(axis=1, keepdims=True)
        p = (first_piece + pieces - 1)[pieces > r] - r
        v = np.einsum("pij,pj->pi", product[p + 1], out[p + 1])
        out[p] = v / v.sum(axis=1, keepdims=True)

    ahead = np.empty((total, step, k))
    state = into
    for t in range(step):
        state = np.where((size > t)[:, None], (state @ move) * psi[:, t], state)
        state = state / state.sum(axis=1, keepdims=True)
        ahead[:, t] = state
    state = out
    for t in range(step - 1, -1, -1):
        if pairs is not None:
            # A text's first word has no word before it; a piece's first has the last of the piece before.
            on = (size > t) & ((rank > 0) | (t > 0))
            before = ahead[on, t - 1] if t else into[on]
            both = before[:, :, None] * move * (psi[on, t] * state[on])[:, None, :]
            pairs += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        ahead[:, t] *= state
        state = np.where((size > t)[:, None], (state * psi[:, t]) @ move.T, state)
        state = state / state.sum(axis=1, keepdims=True)
    both = ahead[real]
    result = np.empty((n, k))
    result[at[real]] = both / both.sum(axis=1, keepdims=True)
    return result


def fit(sample: list[tuple[str, str]], rules: Rules = Rules()) -> Model:
    """Gradient ascent on the conditional likelihood of the word labels of a bounded sample of (text, language)."""
    labels = sorted({lang for _, lang in sample})
    k = len(labels)
    stretches = []
    for text, lang in sorted(sample):
        words = WORD.findall(text.lower())
        stretches += [(words[i : i + rules.stretch], labels.index(lang)) for i in range(0, len(words), rules.stretch)]
    weights, transitions = np.zeros((rules.features, max(k, 1))), np.zeros((max(k, 1), max(k, 1)))
    if k < 2 or not stretches:
        return Model(labels, weights.astype(np.float32), transitions)
    rng = np.random.default_rng(rules.seed)
    order = rng.permutation(len(stretches))
    per = max(1, rules.sequence // rules.stretch)
    words, gold, lengths = [], [], []
    for i in range(0, len(order), per):
        part = [stretches[j] for j in order[i : i + per]]
        words += [w for ws, _ in part for w in ws]
        gold += [label for ws, label in part for _ in ws]
        lengths.append(sum(len(ws) for ws, _ in part))
    gold, lengths = np.array(gold), np.array(lengths)
    vocabulary = sorted(set(words))
    place = {w: i for i, w in enumerate(vocabulary)}
    word = np.fromiter(map(place.__getitem__, words), dtype=np.int64, count=len(words))
    ids, first = word_features(vocabulary, rules.features)
    owner = np.repeat(np.arange(len(vocabulary)), np.diff(np.r_[first, len(ids)]))
    inner = np.ones(len(words), dtype=bool)
    inner[np.cumsum(lengths) - lengths] = False
    square_w, square_t = np.full_like(weights, 1e-8), np.full_like(transitions, 1e-8)
    observed = np.zeros((k, k))
    np.add.at(observed, (gold[:-1][inner[1:]], gold[1:][inner[1:]]), 1)
    hot = np.eye(k)[gold]
    for _ in range(rules.epochs):
        scores = np.add.reduceat(weights[ids], first, axis=0)[word]
        expected = np.zeros_like(transitions)
        p = marginals(scores, lengths, transitions, rules.step, expected)
        error = np.stack([np.bincount(word, weights=(hot - p)[:, c], minlength=len(vocabulary)) for c in range(k)], axis=1)
        gradient = np.stack([np.bincount(ids, weights=error[owner, c], minlength=rules.features) for c in range(k)], axis=1)
        gradient -= rules.decay * len(words) * weights
        step_t = observed - expected
        square_w += gradient**2
        square_t += step_t**2
        weights += rules.rate * gradient / np.sqrt(square_w)
        transitions += rules.rate * step_t / np.sqrt(square_t)
    return Model(labels, weights.astype(np.float32), transitions)


def _spread(text: Column, rules: Rules) -> Column:
    """A text of at most ``rules.chars`` characters, or pieces from its start to its end, without the words cut at their borders."""
    size = rules.chars // rules.pieces
    gap = (F.length(text) - size) / max(1, rules.pieces - 1)
    piece = lambda i: F.substr(text, (F.floor(gap * i) + 1).cast("int"), F.lit(size))
    whole = lambda i: F.regexp_replace(piece(i), r"^\S+\s|\s\S+$", "")
    return F.when(F.length(text) <= rules.chars, text).otherwise(F.concat_ws("\n", *[whole(i) for i in range(rules.pieces)]))


def training_sample(docs: DataFrame, doc_id: str, text: str, lang: str, rules: Rules) -> list[tuple[str, str]]:
    """A bounded, repeatable sample: the documents of each language with the smallest hashes."""
    fit_for = docs.where(F.col(lang).isNotNull() & (F.length(text) > 0))
    order = Window.partitionBy("lang").orderBy("_hash", "text")
    rows = fit_for.select(_spread(F.col(text), rules).alias("text"), F.col(lang).alias("lang"), F.xxhash64(doc_id, text).alias("_hash"))
    ranked = rows.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= rules.docs_per_label)
    return [(r["text"], r["lang"]) for r in ranked.select("text", "lang").collect()]


class Labeller:
    """Word labels of many texts; remembers the scores of words it has met."""

    def __init__(self, model: Model, rules: Rules):
        self.model, self.rules = model, rules
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.scores = np.zeros((4096, max(1, len(self.model.labels))), dtype=np.float32)

    def _scores(self, words: list[str]) -> np.ndarray:
        new = list(set(words) - self.place.keys())
        if len(new) + len(self.place) > self.rules.remembered and self.place:
            self._forget()
            new = list(set(words))
        n = len(self.place)
        if n + len(new) > len(self.scores):
            grown = np.zeros((2 * (n + len(new)), self.scores.shape[1]), dtype=np.float32)
            grown[:n] = self.scores[:n]
            self.scores = grown
        self.scores[n : n + len(new)] = emissions(new, self.model.weights)
        self.place.update(zip(new, range(n, n + len(new))))
        return self.scores[np.fromiter(map(self.place.__getitem__, words), dtype=np.int64, count=len(words))]

    def label(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(words per text, label distribution of all words in a row)."""
        found = [WORD.findall(t.lower()) if any(c.isalpha() for c in t) else [] for t in texts]
        lengths = np.array([len(ws) for ws in found], dtype=np.int64)
        words = [w for ws in found for w in ws]
        if not words or not self.model.labels:
            return lengths, np.zeros((len(words), max(1, len(self.model.labels))))
        scores = self._scores(words).astype(np.float64)
        full = lengths[lengths > 0]
        return lengths, marginals(scores, full, self.model.transitions, self.rules.step)

    def judge(self, texts: list[str]) -> Iterator[tuple[str, float, int, list[dict]]]:
        """(language, score, words, label runs) of each text."""
        names, first = self.model.labels, 0
        while first < len(texts):
            end, size = first + 1, len(texts[first])
            while end < len(texts) and size + len(texts[end]) <= self.rules.block:
                size += len(texts[end])
                end += 1
            lengths, p = self.label(texts[first:end])
            best, stops = p.argmax(axis=1), np.cumsum(lengths)
            for a, b in zip((stops - lengths).tolist(), stops.tolist()):
                if a == b or not names:
                    yield UNDETERMINED, 0.0, b - a, []
                    continue
                mean = p[a:b].mean(axis=0)
                top = int(mean.argmax())
                cuts = np.r_[0, np.flatnonzero(np.diff(best[a:b])) + 1, b - a].tolist()
                runs = [{"lang": names[best[a + i]], "first": i, "words": j - i} for i, j in zip(cuts, cuts[1:])]
                yield names[top], min(1.0, float(mean[top])), b - a, runs
            first = end


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """(doc_id, lang_pred, score, n_words, runs) per row: language, its mean probability, words, and label runs.

    ``runs`` lists the stretches of equal most likely labels as (lang, first word, words): the code switches. Null
    texts and texts without a letter are ``und`` with score 0 and no runs; so is every text when the model has no
    label. Ties take the first language in order. Only the text is read; repeated ids and rows keep their own rows.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    shape = "array<struct<lang:string,first:long,words:long>>"

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value, rules)
        run_type = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int64()), ("words", pa.int64())]))
        types = [pa.string(), pa.float64(), pa.int64(), run_type]
        for batch in batches:
            told = list(zip(*labeller.judge(batch.column("text").to_pylist()))) or [()] * 4
            columns = [pa.array(values, kind) for values, kind in zip(told, types)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "lang_pred", "score", "n_words", "runs"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    return rows.mapInArrow(label, f"doc_id {kind}, lang_pred string, score double, n_words long, runs {shape}")


def decided(docs: DataFrame, model: Model, text: str = "text", min_score: float = 0.3, rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language is told: not ``und``, and a score of ``min_score`` or more.

    Rows are judged one by one as they pass, so repeated or null ids are no special case.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value, rules)
        for batch in batches:
            told = labeller.judge(batch.column(text).fill_null("").to_pylist())
            yield batch.filter(pa.array([lang != UNDETERMINED and score >= min_score for lang, score, _, _ in told], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rules: Rules = Rules()) -> Model:
    return fit(training_sample(docs, doc_id, text, lang, rules), rules)


def held_out(doc_id: str = "doc_id"):
    """The fold that is never learned from: crc32 of the id as text, modulo 4, is 2."""
    return crc_of(doc_id) % 4 == 2


@query("op9_language_id")
def op9_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    predicted = predict(docs, model)
    return predicted.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "n_words", F.size("runs").alias("n_runs"))
