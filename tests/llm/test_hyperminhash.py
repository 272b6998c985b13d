import random

import numpy as np
import pyarrow as pa
import pytest
import regex

from corpusloom.llm import hyperminhash as hm
from corpusloom.llm.queries import queries
from corpusloom.llm.textblocks import blocks

RULES = hm.Rules()


def words(text):
    return regex.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def shingles(text):
    w = words(text)
    return {" ".join(w)} - {""} if len(w) < 2 else {" ".join(w[i : i + 2]) for i in range(len(w) - 1)}


def reference(texts):
    """{row: (set size, smallest row reachable)} by comparing all pairs."""
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) * 10 >= 8 * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= 80 * (len(a) + len(b) - both):
                    x, y = find(i), find(j)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def groups(rows):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows}


def test_query_equals_brute_force(spark, small, documents):
    rows = queries()["op12_hyperminhash"](spark, small).collect()
    assert groups(rows) == reference({i: t for i, t, _ in documents}) and len(rows) == len(documents)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def chained(rng, n):
    """Texts of which many are like others, some only over a chain of likenesses, some just below and at the border."""
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    while len(texts) < n:
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 5, 6, 9, 11, 21, 60, 200]))]
        for _ in range(rng.randrange(1, 8)):
            texts.append(" ".join(base))
            if rng.random() < 0.8:
                base = list(base)
                for _ in range(max(1, len(base) // rng.choice([9, 18, 30]))):
                    base[rng.randrange(len(base))] = rng.choice(vocabulary)
    rng.shuffle(texts)
    return dict(enumerate(texts))


@pytest.mark.parametrize("seed,rules", [(1, RULES), (2, hm.Rules(cell=3, cell_words=100, part=2)), (3, hm.Rules(rows=2, bands=64, cell=5, part=3))])
def test_chains_and_cells(spark, seed, rules):
    """Loose bands put unlike sets into the same buckets, and small cells and parts cut the groups up."""
    texts = chained(random.Random(seed), 300)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    assert groups(hm.near_groups(df, rules=rules).collect()) == reference(texts)


def block_of(texts):
    return [b for _, _, b in blocks(pa.array(texts, pa.string()))][0]


def test_registers_keep_the_least_hash_of_each_bucket():
    hashes, offsets = hm.shingle_sets(block_of(["a b c d e f g " * 3, "", "one", " ".join(map(str, range(5000)))]), 2)
    assert np.diff(offsets).tolist() == [7, 0, 1, 4999]
    regs = hm.registers(hashes, offsets, RULES)
    assert (regs[1] == 0).all() and (regs[[0, 2, 3]] > 0).all() and len(set(regs[2].tolist())) == 1
    for b in range(RULES.registers):
        own = [int(h) for h in hashes[offsets[3] : offsets[4]] if int(h) >> 57 == b]
        if own:
            rest = (min(own) & ((1 << 57) - 1)) >> 4  # 53 bits after the bucket's
            zeros = 53 - rest.bit_length()
            mantissa = (rest << (zeros + 1) & ((1 << 53) - 1)) >> 43
            assert regs[3][b] == (zeros + 1 << 10) + mantissa


@pytest.mark.parametrize("mantissa", [1, 3, 10])
def test_estimates_are_corrected_for_agreement_by_chance(mantissa):
    rules = hm.Rules(bands=512, mantissa=mantissa)
    rng = np.random.default_rng(mantissa)
    for n, m in ((20_000, 20_000), (60_000, 15_000)):
        sets = [np.sort(rng.integers(0, 1 << 64, k, dtype=np.uint64)) for k in (n, m)]
        regs = hm.registers(np.concatenate(sets), np.array([0, n, n + m]), rules)
        c = float(hm.chance(np.array([n]), np.array([m]), rules)[0])
        assert abs((regs[0] == regs[1]).mean() - c) < 5 * np.sqrt(c / rules.registers)


def test_odd_rows(odd, nothing):
    rows = hm.near_groups(odd).collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows if r.doc_id not in (5, None)}
    assert by_id[2] == (0, 2, True) and by_id[3] == (0, 3, True) and by_id[4] == (0, 4, True)
    assert by_id[7][1] == 6 and by_id[8][:2] == (1, 8) and by_id[11][:2] == (1, 11)
    assert sorted(r.component_id for r in rows if r.doc_id == 5) == [1, 1, 5]
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)] * 2
    kept = hm.near_dedup(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(5) == 1 and ids.count(1) == 1 and 7 not in ids and {2, 3, 4} <= set(ids) and ids.count(None) == 2
    assert hm.near_groups(nothing).collect() == [] and hm.near_dedup(nothing).collect() == []
