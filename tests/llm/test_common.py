import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import common, textblocks


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_a_search(spark, seed):
    """Chains, stars and random links."""
    rng = random.Random(seed)
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(500, 500)]
    links += [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)]
    rng.shuffle(links)
    near = {}
    for a, b in links:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    expected = {}
    for start in sorted(near):
        reached, todo = set(), [start]
        while todo:
            x = todo.pop()
            if x not in reached:
                reached.add(x)
                todo += near[x]
        expected[start] = min(reached)
    got = common.components(spark.createDataFrame(links, "a long, b long"), "test")
    assert {r.node: r.root for r in got.collect()} == expected
    assert common.components(spark.createDataFrame([], "a long, b long"), "test").collect() == []


def test_filter_passes_all_its_keys_and_few_others(spark):
    keys = spark.range(20_000).select(F.xxhash64("id").alias("key"))
    words = common.bit_filter(keys)
    held = keys.toPandas()["key"].to_numpy().view(np.uint64)
    assert len(common.passing(words, held)) == 20_000
    other = np.random.default_rng(1).integers(0, 2**63, 100_000, dtype=np.uint64) * np.uint64(2)
    assert len(common.passing(words, other)) < 1000
    assert len(common.passing(common.bit_filter(keys.where("false")), held)) == 0


def test_block_hashes_do_not_depend_on_the_block():
    texts = ["some words here", "", "here some words", "ünï wörds", "words"]
    seen = {}
    for parts in ([texts], [[t] for t in texts], [texts[::-1]]):
        for part in parts:
            for _, _, block in textblocks.blocks(pa.array(part), 12 if len(part) > 1 else 1 << 19):
                starts, ends = block.words()
                for s, e, h in zip(starts.tolist(), ends.tolist(), block.hashes(starts, ends).tolist()):
                    assert seen.setdefault(block.data[s:e].tobytes(), h) == h
    assert len(set(seen.values())) == len(seen) == 5


def test_sliced_columns():
    column = pa.array(["a b", "c", "", "d e f"])[1:]
    found = [(first, end, len(block.words()[0])) for first, end, block in textblocks.blocks(column)]
    assert found == [(0, 3, 4)]
