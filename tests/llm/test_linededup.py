import random
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import linededup as ld
from corpusloom.llm.queries import queries

BLANKS = " \t\n\v\f\r"


def brute(rows, k=8, least=0.8):
    """{(doc, line): first (doc, line) of its component} by comparing all lines that share a shingle."""
    lines = [(i, n, s.strip(BLANKS)) for i, t in rows for n, s in enumerate((t or "").split("\n")) if s.strip(BLANKS)]
    texts = sorted({s for _, _, s in lines})
    sets = {t: {t[i : i + k] for i in range(max(1, len(t) - k + 1))} for t in texts}
    having = {}
    for t in texts:
        for s in sets[t]:
            having.setdefault(s, []).append(t)
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            root[t] = root[root[t]]
            t = root[t]
        return t

    for t in texts:
        for u, both in Counter(u for s in sets[t] for u in having[s] if u > t).items():
            if both >= least * (len(sets[t]) + len(sets[u]) - both):
                a, b = find(t), find(u)
                root[max(a, b)] = min(a, b)
    first = {}
    for i, n, s in sorted(lines):
        first.setdefault(find(s), (i, n))
    return {(i, n): first[find(s)] for i, n, s in lines}


def test_query_equals_brute_force(spark, small, documents):
    got = {(r.doc_id, r.line): (r.keeper_id, r.keeper_line) for r in queries()["op3_line_dedup"](spark, small).collect()}
    assert got == brute([(i, t) for i, t, _ in documents])


def test_large_groups_of_near_copies(spark):
    """A group in which many members are not alike to the bucket's head: the grid must finish it."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(300)]
    base = [rng.choice(words) for _ in range(30)]
    rows = []
    for i in range(150):
        changed = list(base)
        for _ in range(rng.randrange(4)):
            changed[rng.randrange(30)] = rng.choice(words)
        rows.append((i, " ".join(changed)))
    rows += [(1000 + i, " ".join(rng.choice(words) for _ in range(30))) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute(rows)
    for cell in (128, 7):
        got = {(r.doc_id, r.line): (r.keeper_id, r.keeper_line) for r in ld.line_groups(docs, rules=ld.Rules(cell=cell)).collect()}
        # Banding may miss a pair in five hundred at the threshold itself; none of a missed pair's lines are joined wrongly.
        assert sum(got[k] != expected[k] for k in expected) <= 2
        assert all(got[k] >= expected[k] for k in expected)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    for share in (0.3, 0.8):
        n = 300
        both = int(2 * n * share / (1 + share))
        agree = []
        for _ in range(60):
            h = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
            a, b = h[:n], h[n - both : 2 * n - both]
            sig = ld.signatures(np.r_[a, b], np.repeat([0, 1], n), 2, 48)
            agree.append((sig[0] == sig[1]).mean())
        assert np.mean(agree) == pytest.approx(share, abs=0.04)


def test_texts_lose_repeated_lines_only(spark):
    long = "This is a line long enough to be compared with others."
    near = "This is a line long enough to be compared with others!"
    rows = [(2, f"first\n  {near}\nlast"), (1, f"{long}\nshort\nshort"), (3, f"{long}\n \n{long} "), (4, "short"), (5, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in ld.dedup_lines(docs).collect()}
    assert got == {1: f"{long}\nshort", 2: "first\nlast", 5: None, 6: ""}


def test_odd_rows(odd, nothing):
    groups = ld.line_groups(odd).collect()
    assert {(r.keeper_id, r.kept) for r in groups if r.doc_id == 1} == {(1, True)}
    assert sorted(r.keeper_id for r in groups if r.doc_id == 5) == [1, 1, 1, 1, 5]
    assert all(r.kept for r in groups if r.doc_id is None)  # exact repeats of a row count as one document
    assert [(r.keeper_id, r.kept) for r in groups if r.doc_id in (6, 7)] in ([(6, True), (6, False)], [(6, False), (6, True)])
    kept = ld.dedup_lines(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 3, 4, 5, None, None, 6, 8, 9, 10, 11], key=str)
    assert ld.line_groups(nothing).collect() == [] and ld.dedup_lines(nothing).collect() == []


def test_short_lines_lose_their_copies(spark):
    long = "This is a line long enough to be compared with others."
    rows = [(1, f"{long}\nshort\n short\nend"), (2, f"end\n{long}\nshort"), (3, "short"), (4, "other\nend"), (5, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in ld.dedup_lines(docs).collect()}
    assert got == {1: f"{long}\nshort\nend", 4: "other", 5: None, 6: ""}


def test_one_changed_character(spark, tmp_path):
    rng = random.Random(5)
    rows = []
    for n in range(80, 161, 5):
        line = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n - 2))
        rows += [(2 * n, f"<{line}>"), (2 * n + 1, f"<{line[: n // 2]}7{line[n // 2 + 1 :]}>")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.keeper_id for r in queries()["op3_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == {i: i // 2 * 2 for i, _ in rows}


def test_heads_of_buckets(spark):
    """Buckets of one line go; the others keep their ends and their rows, whatever task they were in."""
    rng = random.Random(4)
    rows = [(rng.randrange(-40, 40), [rng.choice([rng.getrandbits(63), -5, 7, (1 << 63) - 1 - rng.randrange(3)]) for _ in range(3)]) for _ in range(300)]
    lines = spark.createDataFrame(rows, "key long, bands array<long>").repartition(4)
    held = {}
    for key, bands in rows:
        for bucket in bands:
            held.setdefault(bucket, []).append(key)
    want = {(b, min(k), max(k), len(k)) for b, k in held.items() if min(k) != max(k)}
    assert {tuple(r) for r in ld._heads(lines, ld.Rules(bands=3)).collect()} == want
    assert ld._heads(lines.where("false"), ld.Rules(bands=3)).collect() == []


def test_long_lines_are_held_a_few_at_a_time(spark):
    rng = random.Random(8)
    base = "".join(rng.choice("abcdefghij ") for _ in range(4000))
    rows = [(i, base[: 100 * (i % 7)] + str(i) + base[100 * (i % 7) :]) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = ld.line_groups(docs, rules=ld.Rules(cell_chars=9000, cell=8)).collect()
    assert {(r.keeper_id, r.keeper_line) for r in got} == {(0, 0)} and len(got) == 40


def test_texts_alike_by_their_ends():
    """Never said of texts that are not alike, and said of those with one short change."""
    rng = random.Random(6)
    told = 0
    for _ in range(3000):
        a = "".join(rng.choice("abc") for _ in range(rng.choice([5, 30, 90, 200])))
        at, size = rng.randrange(len(a) + 1), rng.randrange(4)
        b = a[:at] + "".join(rng.choice("abcd") for _ in range(rng.randrange(4))) + a[at + size :] if rng.random() < 0.9 else a[::-1]
        if len(b) < 8:
            continue
        sets = [ld.shingle_set(t, 8) for t in (a, b)]
        if ld.surely_alike(a, b, len(sets[1]), 8, 0.8):
            told += 1
            assert ld.alike(*sets, 0.8)
    assert told > 800
    line = " ".join(f"word{i}" for i in range(60))
    assert ld.surely_alike(line, line.replace("word30", "other"), len(line) - 7, 8, 0.8)


def test_packed_shingles_are_the_shingles():
    """Packed and plain sets say the same of every pair; texts with characters beyond a byte are never packed."""
    rng = random.Random(7)
    texts = ["".join(rng.choice("ab\x00é") for _ in range(rng.choice([3, 8, 9, 40, 120]))) for _ in range(60)]
    texts += [t[:30] + "x" + t[30:] for t in texts] + ["a line with a sign €", "a line with a sigh €", "short", ""]
    for k in (1, 5, 8, 9):
        packed = [ld.packed_shingles(t, k) for t in texts]
        assert all((p is not None) == (k <= 8 and k <= len(t) and "€" not in t) for p, t in zip(packed, texts))
        sets = [ld.shingle_set(t, k) for t in texts]
        assert all(p is None or len(p) == len(s) for p, s in zip(packed, sets))
        alike = [(i, j) for i in range(len(texts)) for j in range(len(texts)) if i != j and ld.alike(sets[i], sets[j], 0.8)]
        assert all(((i, j) in set(alike)) == ld.packed_alike(packed[i], packed[j], 0.8) for i in range(0, 60, 7) for j in range(len(texts)) if i != j and packed[i] is not None and packed[j] is not None)
        every = np.ones(len(texts), dtype=bool)
        assert sorted(ld._alike_pairs(texts, k, every, every, 0.8)) == alike
        # Shingles that one text has alone take no part in the products.
        owner, item, size = ld._items(texts, k)
        assert size.tolist() == [len(s) for s in sets] and (np.bincount(item) > 1).all()
        assert len(np.unique(item)) == sum(n > 1 for n in Counter(x for s in sets for x in s).values())
