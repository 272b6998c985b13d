import zlib

import numpy as np
import pytest

from corpusloom.llm import langid
from corpusloom.llm.queries import queries


@pytest.fixture(scope="module")
def model(documents):
    return langid.fit([(t, lang) for i, t, lang in documents if t and lang and zlib.crc32(str(i).encode()) % 4 != 2])


def test_forward_backward_equals_enumeration():
    """Marginals against the sum over all label sequences, for texts longer and shorter than a piece."""
    rng = np.random.default_rng(2)
    k, lengths = 3, np.array([1, 5, 2, 7])
    scores, moves = rng.normal(size=(lengths.sum(), k)), rng.normal(size=(k, k))
    got = langid.marginals(scores, lengths, moves, step=2)
    at = 0
    for n in lengths:
        total = np.zeros((n, k))
        for path in np.ndindex(*[k] * n):
            start = np.log(np.mean(np.exp(moves[:, path[0]])))
            weight = np.exp(start + sum(scores[at + i, y] for i, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
            for i, y in enumerate(path):
                total[i, y] += weight
        assert np.allclose(got[at : at + n], total / total.sum(axis=1, keepdims=True))
        at += n


def test_held_out_accuracy(spark, small, documents):
    got = {r.doc_id: r for r in queries()["op9_language_id"](spark, small).collect()}
    assert len(got) == len(documents)
    unseen = [(i, lang) for i, t, lang in documents if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out for i, _ in unseen)
    assert sum(got[i].lang_pred == lang for i, lang in unseen) >= 0.98 * len(unseen)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_code_switches_are_found(spark, documents, model):
    words = {lang: " ".join(t for _, t, x in documents if x == lang).replace("\n", " ").split()[:40] for lang in ("en", "de")}
    text = " ".join(words["en"] + words["de"] + words["en"])
    runs = langid.predict(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first().runs
    assert [r.lang for r in runs if r.words >= 8] == ["en", "de", "en"]
    assert sum(r.words for r in runs) == runs[-1]["first"] + runs[-1].words


def test_a_text_is_judged_alike_alone_and_among_others(documents, model):
    texts = [t or "" for _, t, _ in documents][:40]
    together = list(langid.Labeller(model, langid.Rules()).judge(texts))
    alone = [next(langid.Labeller(model, langid.Rules(remembered=50)).judge([t])) for t in texts]
    assert [x[0] for x in together] == [x[0] for x in alone]
    assert np.allclose([x[1] for x in together], [x[1] for x in alone])


def test_odd_rows(spark, odd, nothing, model):
    rows = langid.predict(odd, model).collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: r for r in rows}
    assert all((by_id[i].lang_pred, by_id[i].score, by_id[i].runs) == ("und", 0.0, []) for i in (2, 3, 4, 10))
    assert all(by_id[i].lang_pred != "und" for i in (1, 6, 8, 9, 11))
    kept = langid.decided(odd, model)
    assert kept.columns == odd.columns
    assert not {2, 3, 4, 10} & {r.doc_id for r in kept.collect()}
    assert langid.predict(nothing, model).collect() == [] and langid.decided(nothing, model).collect() == []
    untrained = langid.train(nothing)
    assert {r.lang_pred for r in langid.predict(odd, untrained).collect()} == {"und"}
    assert langid.train(odd).labels == ["lang"]


def test_long_documents_are_read_in_part(spark):
    long = " ".join(f"anfang{i}" for i in range(2000)) + " " + " ".join(f"ende{i}" for i in range(2000))
    docs = spark.createDataFrame([(1, "short text", "en"), (2, long, "de"), (3, None, "fr"), (4, "x", None)], "doc_id long, text string, lang string")
    sample = dict(reversed(r) for r in langid.training_sample(docs, "doc_id", "text", "lang", langid.Rules()))
    assert set(sample) == {"en", "de"} and sample["en"] == "short text"
    words = sample["de"].split()
    assert len(sample["de"]) <= 8100 and len(sample["de"]) > 7500 and set(words) <= set(long.split())
    assert "anfang1" in words and "ende1998" in words and any(w.startswith("ende1") and len(w) == 7 for w in words)


def test_expected_pairs_equal_enumeration():
    rng = np.random.default_rng(4)
    k, lengths = 3, np.array([1, 5, 2, 7])
    scores, moves = rng.normal(size=(lengths.sum(), k)), rng.normal(size=(k, k))
    got, expected, at = np.zeros((k, k)), np.zeros((k, k)), 0
    langid.marginals(scores, lengths, moves, step=2, pairs=got)
    for n in lengths:
        total, pairs = 0.0, np.zeros((k, k))
        for path in np.ndindex(*[k] * n):
            start = np.log(np.mean(np.exp(moves[:, path[0]])))
            weight = np.exp(start + sum(scores[at + i, y] for i, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
            total += weight
            for a, b in zip(path, path[1:]):
                pairs[a, b] += weight
        expected += pairs / total
        at += n
    assert np.allclose(got, expected)
