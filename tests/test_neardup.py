import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import neardup as nd
from corpusloom.session import materialize


def words_of(text):
    return [w for w in re.split(r"[^A-Za-z_0-9]", text) if w.strip()]


def similarity(a, b):
    a, b = set(words_of(a)), set(words_of(b))
    return len(a & b) / len(a | b)


def components(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


def greedy(texts, members, threshold):
    """(extreme of every member) of one cluster, one after another in id order."""
    extremes, out = [], {}
    for i in sorted(members):
        hit = next((e for e in extremes if similarity(texts[i], texts[e]) >= threshold), None)
        if hit is None:
            extremes.append(i)
        out[i] = i if hit is None else hit
    return out


def corpus(seed=5, n_base=25, copies=6):
    """Random texts with exact copies, near copies, reorderings and short ones."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(n_base):
        base = rng.sample(vocabulary, 60)
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, copies)):
            near = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 8])):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                rng.shuffle(near)
            texts.append("  ".join(near))
    texts += ["short text", "short text", "", "a " * 20, "a " * 30, "b " * 7]
    rng.shuffle(texts)
    return texts


def frame(spark, texts):
    rows = [(i, t, f"repo{i % 3}", f"p{i}.lua") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "id bigint, content string, repo_name string, path string")


def expected(spark, df, texts, threshold=0.85):
    buckets = defaultdict(list)
    for r in nd.lsh_buckets(nd.dedup_table(df), threshold).collect():
        buckets[r.band, r.bucket].append(r.id)
    label = components([(b[0], x) for b in buckets.values() if len(b) > 1 for x in b])
    clusters = defaultdict(list)
    for i, c in label.items():
        clusters[c].append(i)
    want = {}
    for c, members in clusters.items():
        found = greedy(texts, members, threshold)
        for i in members:
            is_extreme = found[i] == i
            want[i] = (c, is_extreme, list(found.values()).count(i) if is_extreme else None)
    return want


def as_dict(clusters):
    return {r.base_index: (r.cluster_id, r.is_extreme, r.copies) for r in clusters.collect()}


def test_band_choice():
    assert nd.choose_bands(0.85) == (13, 19) and nd.choose_bands(0.7) == (25, 10)


def test_known_case(spark):
    rows = [("test_repo1", "test_1.py", "a " * 20), ("test_repo2", "test_2.py", "a " * 30), ("test_repo3", "unit_test.py", "b " * 7)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id bigint, repo_name string, path string, content string")
    kept, clusters = nd.near_dedup(df)
    got = clusters.orderBy("base_index").collect()
    assert [(r.cluster_id, r.base_index, r.repo_name, r.is_extreme, r.copies) for r in got] == [
        (0, 0, "test_repo1", True, 2), (0, 1, "test_repo2", False, None)
    ]
    assert sorted(r.id for r in kept.collect()) == [0, 2]
    assert nd.dedup_stats(df, clusters).first().asDict() == {
        "original": 3, "clusters": 1, "files_in_clusters": 2, "unique_files": 1, "filtered": 2
    }


@pytest.mark.parametrize("threshold", [0.85, 0.7])
def test_equals_sequential_walk(spark, threshold):
    texts = corpus()
    df = frame(spark, texts)
    got = as_dict(nd.duplicate_clusters(df, threshold=threshold))
    assert got == expected(spark, df, texts, threshold) and len(got) > 20


def test_invariants_and_recall(spark):
    texts = corpus(11)
    df = frame(spark, texts)
    kept, clusters = nd.near_dedup(df)
    kept_ids = {r.id for r in kept.collect()}
    members = as_dict(clusters)
    for i in set(range(len(texts))) - kept_ids:
        mates = [j for j, (c, extreme, _) in members.items() if c == members[i][0] and extreme]
        assert any(similarity(texts[i], texts[j]) >= 0.85 for j in mates)
    assert sum(n or 0 for _, _, n in members.values()) == len(members)
    sure = [
        (i, j) for i in range(len(texts)) for j in range(i)
        if len(words_of(texts[i])) >= 10 and len(words_of(texts[j])) >= 10 and similarity(texts[i], texts[j]) >= 0.95
    ]
    found = sum(members.get(i, (None,))[0] == members.get(j, (-1,))[0] for i, j in sure)
    assert sure and found >= 0.99 * len(sure)


def test_partitions_do_not_matter(spark):
    df = frame(spark, corpus(7, 10))
    assert as_dict(nd.duplicate_clusters(df.coalesce(1))) == as_dict(nd.duplicate_clusters(df.repartition(8)))


def test_large_cluster_takes_blocks(spark, monkeypatch):
    """One cluster far larger than a block, with several extremes; and salted hot keys."""
    rng = random.Random(2)
    texts = []
    for i in range(150):
        words = [f"c{k}" for k in range(40)] + [f"x{i % 5}_{k}" for k in range(10)]
        words[rng.randrange(40)] = f"y{i}"
        texts.append(" ".join(words))
    texts += [texts[0]] * 60
    number = {w: k for k, w in enumerate(sorted({w for t in texts for w in words_of(t)}))}
    rows = [(0, i, [number[w] for w in set(words_of(t))]) for i, t in enumerate(texts)]
    members = spark.createDataFrame(rows, "cluster bigint, id bigint, words array<bigint>")
    monkeypatch.setattr(nd, "PART_WORDS", 500)
    got = {r.id: r.extreme for r in nd.cluster_extremes(members, 0.85, block=4).collect()}
    want = greedy(texts, range(len(texts)), 0.85)
    assert got == want and len(set(want.values())) > 4
    monkeypatch.setattr(nd, "BLOCK_WORDS", 300)  # six texts
    assert {r.id: r.extreme for r in nd.cluster_extremes(members, 0.85, block=64).collect()} == want
    df = frame(spark, texts)
    assert as_dict(nd.duplicate_clusters(df, hot_rows=5)) == as_dict(nd.duplicate_clusters(df))


def test_components_of_chains_and_stars(spark):
    links = [(i + 1, i) for i in range(300, 340)] + [(i, 5) for i in range(6, 90)] + [(1000, 999)]
    got = nd.connected_components(spark.createDataFrame(links, "src bigint, dst bigint"), hot_rows=10)
    assert {r.id: r.component for r in got.collect()} == components(links)


def test_links_connect_a_bucket_without_pairs(spark):
    buckets = spark.range(1000).select("id", F.lit(0).alias("band"), F.lit(1).cast("bigint").alias("bucket"))
    links = materialize(nd.bucket_links(buckets, salts=16), "links")
    pairs = [(r.src, r.dst) for r in links.collect()]
    assert len(pairs) == 999 and set(components(pairs).values()) == {0}
    assert links.groupBy("dst").count().agg(F.max("count")).first()[0] < 120


def test_signature(spark):
    rows = {r.id: r.signature for r in nd.minhash_signature(frame(spark, ["a b c d e f g h i j", "j i h g f e d c b a", "few"])).collect()}
    assert rows[0] == rows[1] and len(rows[0]) == 256 and rows[2] is None


def test_signature_estimates_similarity(spark):
    texts = [" ".join(f"w{i}" for i in range(100)), " ".join(f"w{i}" for i in range(20, 120))]
    a, b = (r.signature for r in nd.minhash_signature(frame(spark, texts)).orderBy("id").collect())
    assert abs(sum(x == y for x, y in zip(a, b)) / 256 - similarity(*texts)) < 0.12


def test_band_udf_runs_once(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").selectExpr("doc_id AS id", "text AS content")
    plan = nd.lsh_buckets(nd.dedup_table(docs))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
