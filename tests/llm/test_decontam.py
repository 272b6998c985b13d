import pytest
from compare import compare, connect
from pyspark.sql import functions as F

from corpusloom.llm import decontam
from corpusloom.llm.queries import oracle_sql, queries

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"


def told(spark, docs, items, rules=decontam.Rules()):
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame(items, "item_id long, text string")
    return {r.doc_id: r for r in decontam.contamination(docs, items, rules=rules).collect()}


def test_query_equals_sql(spark, small):
    name = "op4_decontamination"
    assert compare(queries()[name](spark, small), connect(small), oracle_sql()[name]) is None


def test_no_python_runs(spark, small):
    plan = queries()["op4_decontamination"](spark, small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_windows_hits_and_the_rule(spark):
    words = ITEM.split()
    filler = " ".join(f"w{i}" for i in range(400))
    rows = [
        (1, "X " + ITEM.upper().replace(" ", ", ") + " y"),  # whole item, other case and blanks
        (2, " ".join(words[2:15]) + " " + filler),  # one window, 13 of 413 words: below a twentieth
        (3, " ".join(words[:12]) + " other"),  # one word short
        (4, " ".join(words[:13]) + " " + " ".join(words[3:16])),  # overlapping item windows at two places
        (5, "one two three"),  # a short item is one window
        (6, "one two"),
        (7, None),
        (8, ""),
    ]
    items = [(100, ITEM), (9, "One, two! THREE?"), (7, None), (8, "!!!"), (5, ITEM)]
    got = told(spark, rows, items)
    assert {i: (r.n_words, r.n_hit, r.n_items, r["items"], r.contaminated) for i, r in got.items()} == {
        1: (18, 16, 2, ["100", "5"], True),
        2: (413, 13, 2, ["100", "5"], False),
        3: (13, 0, 0, [], False),
        4: (26, 26, 2, ["100", "5"], True),
        5: (3, 3, 1, ["9"], True),
        6: (2, 0, 0, [], False),
        7: (0, 0, 0, [], False),
        8: (0, 0, 0, [], False),
    }


def test_repeated_words_in_a_window(spark):
    """An item of one word over and over has windows at every place of a longer run."""
    got = told(spark, [(1, "la " * 20 + "end"), (2, "la " * 12), (3, "la la")], [(1, "la " * 14), (2, "la la")])
    assert [(got[i].n_hit, got[i].n_items) for i in (1, 2, 3)] == [(20, 2), (12, 1), (2, 1)]


def test_proximity_matches(spark):
    words = ITEM.split()
    moved = words[:5] + ["inserted"] + words[5:]
    got = told(spark, [(1, " ".join(moved)), (2, " ".join(words[::-1])), (3, ITEM)], [(100, ITEM)])
    assert [(got[i].n_items, got[i].n_near) for i in (1, 2, 3)] == [(0, 1), (0, 0), (1, 0)]


def test_proximity_survives_edits_of_the_rarest_words(spark, tmp_path):
    words = ITEM.split()
    often = " ".join(w for w in words if w not in ("epsilon", "theta", "xi") for _ in range(5))
    absent = " ".join("other" if w in ("epsilon", "xi") else w for w in words)  # terms that the corpus lacks
    rarest = " ".join("other" if w in ("theta", "xi") else w for w in words)  # rare terms that stand elsewhere
    few = " ".join(w if i % 2 else "other" for i, w in enumerate(words))
    for more, expected in (([], 1), ([(3, "theta xi")], 1)):
        rows = [(1, absent if not more else rarest), (2, often), (4, few), *more]
        got = told(spark, rows, [(100, ITEM)])
        assert [(got[i].n_items, got[i].n_near) for i, _ in rows] == [(0, expected)] + [(0, 0)] * (len(rows) - 1)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(100, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = queries()["op4_decontamination_near"](spark, str(tmp_path))
    assert {r.doc_id: r.n_near for r in found.collect()} == {1: 1, 2: 0, 3: 0, 4: 0}


@pytest.mark.parametrize("window", [2, 3])
def test_random_texts_equal_brute_force(spark, window):
    import random

    rng = random.Random(window)
    text = lambda n: " ".join(rng.choice("abcd") for _ in range(rng.randrange(n)))
    docs, items = [(i, text(30)) for i in range(60)], [(i, text(8)) for i in range(12)]
    got = told(spark, docs, items, decontam.Rules(window=window))
    for i, t in docs:
        w, hit, found = t.split(), set(), set()
        for j, item in items:
            v = item.split()
            k = min(window, len(v))
            for a in range(len(v) - k + 1) if v else ():
                for b in range(len(w) - k + 1):
                    if w[b : b + k] == v[a : a + k]:
                        hit |= set(range(b, b + k))
                        found.add(str(j))
        assert (got[i].n_hit, got[i]["items"]) == (len(hit), sorted(found)), t


def test_odd_rows(spark, odd, nothing):
    items = odd.select(F.col("doc_id").alias("item_id"), "text", "copy", "term", "n")
    got = decontam.contamination(odd, items)
    assert got.count() == odd.count()
    kept = decontam.decontaminate(odd, items.where("item_id = 1"))
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([2, 3, 4, 5, None, None, 6, 7, 8, 9, 10, 11], key=str)
    none = nothing.select(F.col("doc_id").alias("item_id"), "text")
    assert decontam.contamination(nothing, items).count() == 0
    assert decontam.contamination(odd, none).where("n_hit > 0").count() == 0
    assert decontam.decontaminate(odd, none).count() == odd.count()
