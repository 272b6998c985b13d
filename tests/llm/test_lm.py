import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import lm
from corpusloom.llm.queries import queries


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + [None]


@pytest.fixture(scope="module")
def scored(spark, small):
    return {r.doc_id: r for r in queries()["op1_lm_scoring"](spark, small).collect()}


def test_base_equals_brute_force(documents, scored):
    held_out = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _, _ in documents}
    counts = Counter()
    for i, text, _ in documents:
        if not held_out[i]:
            counts.update(tokens(text))
    total, distinct = sum(counts.values()), len(counts)
    assert len(scored) == len(documents)
    for i, text, _ in documents:
        row, words = scored[i], tokens(text)
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in words)
        assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (held_out[i], len(words), sum(counts[w] > 0 for w in words), total)
        assert row.base_score == pytest.approx(base, rel=1e-9)


def test_model_predicts_unseen_texts_better_than_the_base(scored):
    unseen = [r for r in scored.values() if r.held_out]
    n = sum(r.n_tokens for r in unseen)
    assert sum(r.score for r in unseen) / n > sum(r.base_score for r in unseen) / n + 0.3


def test_words_beyond_the_broadcast_ones_score_the_same_base(spark, documents):
    """With 20 broadcast words nearly all counts come by the join."""
    docs = spark.createDataFrame(documents, "doc_id long, text string, lang string")
    few = {r.doc_id: r for r in lm.score(docs, docs, rules=lm.Rules(top=20, single=5, band=10, rounds=1)).collect()}
    many = {r.doc_id: r for r in lm.score(docs, docs, rules=lm.Rules(rounds=1)).collect()}
    for i in few:
        assert few[i].n_known == many[i].n_known == few[i].n_tokens
        assert few[i].base_score == pytest.approx(many[i].base_score, rel=1e-9)


def test_probabilities_sum_to_one():
    """Over classes, and over the seen and unseen words of a class."""
    rng = np.random.default_rng(1)
    weights = rng.normal(size=(64, 9)).astype(np.float32)
    z = lm._log_softmax(weights, np.zeros(9, np.float32), rng.integers(0, 64, (4, 50)))
    assert np.allclose(np.exp(z).sum(axis=1), 1, atol=1e-5)


def test_softmax_is_taken_in_the_room_it_is_given():
    """With and without room the same, for fewer tokens than there is room for; nothing of an earlier call is left."""
    rng = np.random.default_rng(2)
    weights, prior = rng.normal(size=(64, 9)).astype(np.float32), rng.normal(size=9).astype(np.float32)
    room = lm._room(lm.Rules(part=50), 9)
    for n in (50, 7, 0):
        features = rng.integers(0, 64, (4, n))
        z = lm._log_softmax(weights, prior, features, room)
        assert z.base is room[0] and np.array_equal(z, lm._log_softmax(weights, prior, features))


@pytest.mark.parametrize("n", [0, 1, 3, 5000])
def test_places_of_keys_are_found_without_a_search(n):
    """Also where keys want one slot, in the last slots and for keys that are missing."""
    rng = np.random.default_rng(n)
    keys = np.unique(np.concatenate([rng.integers(0, 2**64, n, dtype=np.uint64), np.arange(n, dtype=np.uint64), ~np.arange(n, dtype=np.uint64)]))
    wanted = np.concatenate([keys, rng.integers(0, 2**64, 1000, dtype=np.uint64), np.arange(2 * n, dtype=np.uint64), ~np.arange(2 * n, dtype=np.uint64)])
    assert np.array_equal(lm.Places(keys).find(wanted), lm._place(keys, wanted))


def test_counted_keys_equal_brute_force():
    rng = np.random.default_rng(3)
    key, n = rng.integers(0, 50, 1000).astype(np.uint64), rng.integers(1, 9, 1000)
    want, seen = Counter(), Counter(key.tolist())
    for k, times in zip(key.tolist(), n.tolist()):
        want[k] += times
    shape = (key * 7 % 11).astype(np.int64)
    for got, expected in ((lm._counted(key, shape, n), want), (lm._counted(key, shape), seen)):
        assert list(zip(*(x.tolist() for x in got))) == [(k, k * 7 % 11, expected[k]) for k in sorted(expected)]
    assert [len(x) for x in lm._counted(key[:0], shape[:0], n[:0])] == [0, 0, 0]


def test_inside_a_class_probabilities_sum_to_one(spark, documents):
    docs = spark.createDataFrame(documents, "doc_id long, text string, lang string")
    rules = lm.Rules(top=500, single=10, band=100)
    counts = lm.token_counts(docs, "text", rules).cache()
    words, shapes = lm.vocabulary(counts, rules)
    group = lm.group_shapes(lm.company(docs, "text", words, rules), rules.groups)
    classes = lm.make_classes(counts, words, shapes, group, rules)
    inside = np.bincount(classes.of_top, weights=10**classes.log_inside)
    assert np.allclose(inside[inside > 0], 1)
    every = counts.toPandas()
    tail = every[~every["key"].isin(words.keys.view(np.int64))]
    mass = np.bincount(group[tail["shape"]], weights=tail["n"], minlength=rules.groups)
    assert np.array_equal(mass, classes.tail_mass)


def test_odd_rows(odd, nothing):
    rows = lm.score(odd, odd.where("doc_id < 9"), rules=lm.Rules(rounds=1)).collect()
    assert len(rows) == odd.count()
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) and r.score < 0 for r in rows)
    by_id = {r.doc_id: r for r in rows}
    assert [by_id[i].n_tokens for i in (2, 3, 4, 8, 11)] == [1, 1, 1, 2, 2]
    unlearned = lm.score(odd, nothing, rules=lm.Rules(rounds=1)).collect()
    assert len(unlearned) == odd.count() and all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in unlearned)
    assert lm.score(nothing, odd, rules=lm.Rules(rounds=1)).collect() == []
