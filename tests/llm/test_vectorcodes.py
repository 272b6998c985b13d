import hashlib
import math
import random

import numpy as np
import pytest

from corpusloom.llm import vectorcodes as vc
from corpusloom.llm.queries import queries


def reference(rows, entries=64, parts=16, rounds=2):
    """Codes by definition: every entry against every part."""
    rows = sorted((i, label, [math.floor(256 * v) for v in vector]) for i, label, vector in rows)
    width = len(rows[0][2]) // parts
    cut = lambda x, p: x[p * width : (p + 1) * width]
    books = [[cut(x, p) for _, _, x in rows[:entries]] for p in range(parts)]

    def near(x, p):
        return min((sum((a - b) ** 2 for a, b in zip(cut(x, p), c)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        held = {}
        for _, _, x in rows:
            for p in range(parts):
                held.setdefault((p, near(x, p)[1]), []).append(cut(x, p))
        for (p, e), members in held.items():
            books[p][e] = [sum(c) // len(members) for c in zip(*members)]
    found = {i: [near(x, p) for p in range(parts)] for i, _, x in rows}
    errors = {}
    for i, label, _ in rows:
        errors[label] = errors.get(label, 0) + sum(d for d, _ in found[i])
    sha = hashlib.sha256(",".join(str(v) for book in books for c in book for v in c).encode()).hexdigest()
    return {i: ("".join(f"{e:02x}" for _, e in found[i]), sum(d for d, _ in found[i]), errors[label], sha) for i, label, _ in rows}


def codes(rows):
    return {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in rows}


def test_query_equals_brute_force(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").collect()
    got = queries()["op13_vector_codes"](spark, small).collect()
    assert codes(got) == reference([(r.vec_id, r.label, r.embedding) for r in rows])


@pytest.mark.parametrize("spread", [1, 3, 1000])
def test_search_equals_looking_at_all_entries(spread):
    rng = np.random.default_rng(spread)
    book = rng.integers(-spread, spread + 1, (64, 4))
    points = np.concatenate([rng.integers(-2 * spread, 2 * spread + 1, (500, 4)), book])
    distance = ((points[:, None] - book[None]) ** 2).sum(axis=2)
    index, best = vc.nearest(points, book)
    assert (index == distance.argmin(axis=1)).all() and (best == distance.min(axis=1)).all()


def test_odd_rows(spark):
    rng = random.Random(5)
    good = [(i, i % 3 if i % 4 else None, [rng.uniform(-1, 1) for _ in range(32)]) for i in range(90)]
    good += [(i, 1, good[0][2]) for i in range(90, 130)] + [(200, None, [1e30, -1e30] + [0.0] * 30)]
    bad = [(300, 1, None), (301, 1, []), (302, 2, [None] + [0.5] * 31), (303, 2, [float("nan")] * 32), (304, 2, [float("inf")] * 32), (305, 2, [0.1] * 31)]
    schema = "vec_id long, label int, embedding array<double>, x string, id string, code string, slot int"
    rows = [(*r, "a", "b", "c", 1) for r in good + bad]
    df = spark.createDataFrame(rows, schema).repartition(5)
    got = vc.encode(df).collect()
    most = vc._limit(2, 16) / 256
    held = [(i, label, [max(min(v, most), -most) for v in x]) for i, label, x in good]
    want = reference([(i, -1 if label is None else label, x) for i, label, x in held])
    assert codes(got) == want
    # Repeated rows and ids keep their own rows; null ids are no first entries.
    twice = spark.createDataFrame([(1, 1, [0.0] * 16), (1, 1, [0.0] * 16), (None, 2, [1.0] * 16)], "vec_id long, label int, embedding array<float>")
    got = sorted((r.vec_id or -1, r.code, r.error) for r in vc.encode(twice, rules=vc.Rules(entries=2)).collect())
    assert got[1] == got[2] and [i for i, _, _ in got] == [-1, 1, 1]
    # A length that sixteen does not divide is filled up with zeros.
    few = spark.createDataFrame([(i, 1, [float(i), 2.0, 3.0]) for i in range(3)], "vec_id long, label int, embedding array<float>")
    assert [r.error for r in vc.encode(few).collect()] == [0, 0, 0]
    for empty in (df.where("false"), df.where("vec_id >= 300 AND vec_id < 305")):
        assert vc.encode(empty).collect() == []
        assert vc.encode(empty).columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
