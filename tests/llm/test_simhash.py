import random

import numpy as np
import pytest
import regex
import xxhash

from corpusloom.llm import simhash
from corpusloom.llm.queries import queries


def fingerprint(text):
    words = regex.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, distance=2):
    """Smallest id of each id's component."""
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_query_equals_brute_force(spark, small, documents):
    prints = {i: fingerprint(t) for i, t, _ in documents}
    expected = groups(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries()["op7_simhash"](spark, small).collect()}
    assert got == {i: (f"{prints[i]:016x}", expected[i]) for i in prints}


@pytest.mark.parametrize("cell,rows", [(4096, 32768), (8, 64), (1, 16)])
def test_trie_join_finds_all_pairs_and_no_other(spark, cell, rows):
    rng = random.Random(cell)
    prints = {0, (1 << 64) - 1}
    while len(prints) < 400:
        base = rng.getrandbits(64) if rng.random() < 0.4 else rng.choice(sorted(prints))
        prints.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))))
    prints = sorted(prints)
    df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "bits long")
    for distance in (1, 2, 3):
        got = simhash.near_links(df, simhash.Rules(distance=distance, cell=cell, rows=rows)).collect()
        pairs = [frozenset(int(np.int64(x).view(np.uint64)) for x in r) for r in got]
        want = {frozenset((a, b)) for k, a in enumerate(prints) for b in prints[k + 1 :] if (a ^ b).bit_count() <= distance}
        assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_blocks_cover_all_bits():
    for distance in range(1, 6):
        blocks = simhash._blocks(distance)
        assert len(blocks) == distance + 1 and sum(w for _, w in blocks) == 64
        assert all(a + w == b for (a, w), (b, _) in zip(blocks, [*blocks[1:], (64, 0)]))


def test_a_crowded_block_is_cut_deeper(spark):
    """Fingerprints that all share their first block, in groups of near ones."""
    rng = random.Random(2)
    top, prints = rng.getrandbits(21) << 43, set()
    while len(prints) < 300:
        base = top | rng.getrandbits(43)
        prints |= {base, base ^ (1 << rng.randrange(43)), base ^ (1 << rng.randrange(43)) ^ (1 << rng.randrange(43))}
    prints = sorted(prints)
    df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "bits long")
    got = simhash.near_links(df, simhash.Rules(cell=16, rows=64)).collect()
    want = {frozenset((a, b)) for k, a in enumerate(prints) for b in prints[k + 1 :] if (a ^ b).bit_count() <= 2}
    assert sorted(map(sorted, want)) == sorted(sorted(int(np.int64(x).view(np.uint64)) for x in r) for r in got)


def test_odd_rows(odd, nothing):
    rows = simhash.simhash_groups(odd).collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: r for r in rows if r.doc_id not in (5, None)}
    assert by_id[2].fingerprint == by_id[3].fingerprint == by_id[4].fingerprint == "0" * 16
    assert by_id[2].component_id == by_id[3].component_id == by_id[4].component_id == 2
    assert sorted(r.component_id for r in rows if r.doc_id == 5) == [1, 1, 5]
    assert [r.component_id for r in rows if r.doc_id is None] == [None, None]
    kept = simhash.near_dedup(odd)
    assert kept.columns == odd.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids.count(None) == 1 and ids.count(5) == 1 and {1, 2}.issubset(ids) and not {3, 4} & set(ids)
    assert simhash.simhash_groups(nothing).collect() == [] and simhash.near_dedup(nothing).collect() == []
