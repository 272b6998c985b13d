import re
from collections import Counter

import pytest

from corpusloom.llm import quality
from corpusloom.llm.queries import queries


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [s for s in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@pytest.fixture(scope="module")
def judged(spark, small):
    return {r.doc_id: r for r in queries()["op8_quality_rules"](spark, small).collect()}


def test_base_counts_equal_brute_force(documents, judged):
    assert len(judged) == len(documents)
    for i, text, _ in documents:
        n, *rest = brute(text)
        row = judged[i]
        assert [row[c] for c in COUNTS] == [n, *rest]
        assert row.base_failed == (n < 50 or 100 * rest[-1] > 50 * n)
        assert row.kept == (not row.base_failed and row.ratio >= row.threshold)


def test_ratio_parts_good_from_bad(spark, small, judged):
    labels = spark.read.parquet(f"{small}/labels.parquet").where("quality IS NOT NULL").collect()
    verdicts = [(r.quality, judged[r.doc_id].kept) for r in labels if not judged[r.doc_id].base_failed]
    assert sum(kept for q, kept in verdicts if q == 1) >= 0.97 * sum(q == 1 for q, _ in verdicts)
    assert sum(kept for q, kept in verdicts if q == 0) <= 0.1 * sum(q == 0 for q, _ in verdicts)


def test_counted_grams_cover_all_documents(spark, documents):
    docs = spark.createDataFrame([(i, t, i % 3 == 0) for i, t, _ in documents], "doc_id long, text string, trusted boolean")
    raw, target = 0, 0
    for r in quality.gram_counts(docs, "text", "trusted", 512).collect():
        raw, target = raw + r.raw, target + r.target
    grams = {i: max(0, 2 * brute(t)[0] - 1) for i, t, _ in documents}
    assert raw == sum(grams.values()) and target == sum(n for i, n in grams.items() if i % 3 == 0)


def test_threshold_is_the_best_cut(spark):
    rows = [(0.1, False), (0.2, False), (0.3, True), (0.4, False), (0.5, True), (0.6, True)]
    cut = quality.best_threshold(spark.createDataFrame(rows, "s double, good boolean"), "s", "good", 1000)
    assert 0.4 < cut <= 0.5 or 0.2 < cut <= 0.3  # both cuts judge five of six rightly
    assert quality.best_threshold(spark.createDataFrame(rows[:2], "s double, good boolean"), "s", "good", 1000) == 0.0


def test_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1, 0, "x"), (6, 0, 0, "x"), (6, 1, None, "x"), (None, 1, 0, "x"), (99, 1, 0, "x"), (8, None, 1, "x")], "doc_id long, quality int, toxic int, text string")
    rows = quality.quality_rules(odd, labels).collect()
    assert sorted([tuple(r[c] for c in COUNTS) for r in rows]) == sorted(brute(r.text) for r in odd.collect())
    assert all(not r.kept for r in rows if r.n_words < 50)
    assert quality.quality_rules(odd, labels.where("false")).count() == odd.count()
    assert quality.quality_rules(nothing, labels).count() == 0
