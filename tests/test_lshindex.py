import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import neardup as nd
from corpusloom.operators import setjoin
from corpusloom.operators.lshindex import LshIndex
from corpusloom.sources.bucketed import BucketedTable, sink_bucketed

CARRY = ("repo_name", "path")


def texts(n_base=20, seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    out = []
    for _ in range(n_base):
        base = rng.sample(vocabulary, 40)
        for _ in range(rng.randint(1, 6)):
            near = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                near[rng.randrange(40)] = rng.choice(vocabulary)
            out.append(" ".join(near))
    rng.shuffle(out)
    return [*out, "short", "", None, "x " * 30, "x " * 40]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, f"r{i % 3}", f"p{i}") for i, t in rows], "id bigint, content string, repo_name string, path string")


def listed(clusters):
    return {r.base_index: (r.cluster_id, r.is_extreme, r.copies, r.path) for r in clusters.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_give_the_clusters_of_their_union(spark, tmp_path, seed):
    """Batches that bring smaller ids, copies of stored sets, and links that join older clusters."""
    rows = list(enumerate(texts(seed=seed)))
    random.Random(seed).shuffle(rows)
    df = frame(spark, rows)
    index = LshIndex(spark, str(tmp_path), buckets=4)
    cut = len(rows) // 4
    for batch in (rows[:cut], rows[cut : 2 * cut], [], rows[2 * cut :]):
        verdicts = index.insert(frame(spark, batch) if batch else df.where("false"))
        assert verdicts.count() == sum(len((t or "").split()) >= 10 for _, t in batch)
    want = listed(nd.duplicate_clusters(df))
    assert listed(index.clusters(df)) == want and len({c for c, *_ in want.values()}) > 5
    # The same folder, opened anew.
    spark.sql(f"DROP TABLE {index.sets.name}")
    spark.sql(f"DROP TABLE {index.bands.name}")
    assert listed(LshIndex(spark, str(tmp_path), buckets=4).clusters(df)) == want


def test_query_stores_nothing_and_a_broken_batch_is_replaced(spark, tmp_path):
    rows = list(enumerate(texts(8)))
    first, second = frame(spark, rows[::2]), frame(spark, rows[1::2])
    index = LshIndex(spark, str(tmp_path), buckets=4)
    index.insert(first)
    near = {(r.id, r.node) for r in index.query(second).collect()}
    assert index.batches() == [0] and near
    # A batch that broke off before its commit leaves rows that nobody reads and that the next try replaces.
    index.insert(second)
    done = index._stored("texts", "id long, set_key string").count()
    import shutil

    shutil.rmtree(tmp_path / "commits" / "batch=1")
    assert index.batches() == [0] and {(r.id, r.node) for r in index.query(second).collect()} == near
    index.insert(second)
    assert index._stored("texts", "id long, set_key string").count() == done
    assert listed(index.clusters(frame(spark, rows))) == listed(nd.duplicate_clusters(frame(spark, rows)))


def test_stored_bands_are_not_shuffled(spark, tmp_path):
    index = LshIndex(spark, str(tmp_path), buckets=8)
    index.insert(frame(spark, list(enumerate(texts(5)))))
    heads = spark.range(1000).selectExpr("id AS bucket", "CAST(id % 13 AS INT) AS band", "id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = heads.join(index._held(index.bands), ["bucket", "band"])._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    physical = plan[plan.index("== Physical Plan ==") :]
    assert physical.count("Exchange") == 1 and "SortMergeJoin" in physical


def test_bucketed_joins_need_no_exchange(spark, tmp_path):
    docs = frame(spark, list(enumerate(texts(5))))
    table = sink_bucketed(docs, str(tmp_path / "docs"), ("id",), 4).read()
    members = sink_bucketed(docs.where("id % 3 = 0").selectExpr("id AS base_index"), str(tmp_path / "members"), ("base_index",), 4).read()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = nd.lookup_content(members, table)
        physical = found._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
        assert "Exchange" not in physical and "SortMergeJoin" in physical
        assert {r.base_index: r.content for r in found.collect()} == {r.id: r.content for r in docs.where("id % 3 = 0").collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("threshold,cell,hot", [(0.85, 4096, 100_000), (0.6, 3, 5), (0.3, 2, 2), (1.0, 4, 10)])
def test_set_join_finds_all_pairs(spark, threshold, cell, hot):
    rng = random.Random(cell)
    sets = {0: set(), 1: {1}, 2: {2, 3}}
    while len(sets) < 120:
        base = rng.sample(range(60), rng.choice([1, 2, 5, 12, 30]))
        for _ in range(3):
            near = set(base) | {1000}  # a word that all have
            for _ in range(rng.randrange(4)):
                near ^= {rng.randrange(60)}
            if near not in sets.values():
                sets[len(sets)] = near
    df = spark.createDataFrame([(i, list(s)) for i, s in sets.items()], "id long, words array<long>")
    got = {(r.a, r.b): r.similarity for r in setjoin.similar_sets(df, threshold, cell, hot).collect()}
    want = {}
    for a in sets:
        for b in sets:
            if a < b and sets[a] | sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold:
                want[a, b] = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert got == pytest.approx(want) and set(got) == set(want)
    with pytest.raises(ValueError):
        setjoin.similar_sets(df, 0)


def test_sets_alike_are_shuffled_once_and_not_for_every_pair(spark, tmp_path):
    """Every set is like every other: 780 pairs, but the cells that compare them hold few copies of a set."""
    base = list(range(1000, 1100))
    sets = spark.createDataFrame([(i, [*base, i, i + 500]) for i in range(40)], "id long, words array<long>")
    pairs = setjoin.candidate_pairs(setjoin.prefixes(sets, 0.85), 0.85)
    assert pairs.count() == 780
    ends = pairs.select("place", F.explode(F.array("a", "b")).alias("id")).distinct()
    assert ends.count() <= 40 * 3
    assert setjoin.similar_sets(sets, 0.85).count() == 780


def test_sets_alike_meet_at_their_first_words_only(spark):
    """Of the 14 common words in the prefixes of sets of 102 words the last 6 leave no room for 94 common ones: 780 pairs, 8 meetings each."""
    base = list(range(1000, 1100))
    sets = spark.createDataFrame([(i, [*base, i, i + 500]) for i in range(40)], "id long, words array<long>")
    front = setjoin.prefixes(sets, 0.85)
    assert front.where("word >= 1000").count() == 40 * 14
    assert setjoin.meetings(front, 0.85).where("place IS NOT NULL").count() <= 780 * 8
    assert setjoin.candidate_pairs(front, 0.85).count() == 780


@pytest.mark.parametrize("threshold,cell", [(0.85, 4096), (0.85, 4), (0.5, 4096)])
def test_large_sets_that_must_meet_often_are_all_found(spark, threshold, cell):
    """Sets of up to 1,000 words at and about the threshold: words left out, added, put in place of others, first or last in order."""
    rng = random.Random(cell)
    sets = {}
    for n in (63, 64, 128, 200, 500, 1000):
        base = rng.sample(range(10**6), n)
        sets[len(sets)] = set(base)
        lost, changed = int((1 - threshold) * n), int((1 - threshold) / (1 + threshold) * n)
        for k in (-1, 0, 1):
            for order in (base, sorted(base), rng.sample(base, n)):
                sets[len(sets)] = set(order[lost + k :])
                sets[len(sets)] = set(order[changed + k :]) | {rng.randrange(10**6, 10**7) for _ in range(changed + k)}
                sets[len(sets)] = set(base) | {rng.randrange(10**6, 10**7) for _ in range(int(n / threshold) - n + k)}
    df = spark.createDataFrame([(i, list(s)) for i, s in sets.items()], "id long, words array<long>")
    got = {(r.a, r.b): r.similarity for r in setjoin.similar_sets(df, threshold, cell).collect()}
    like = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    want = {pair: x for pair, x in like.items() if x >= threshold}
    assert len(want) > 50 and got == pytest.approx(want)


def test_prefixes_that_share_too_little_are_no_candidates(spark):
    """One rare word in common does not make two sets a pair that is looked at."""
    rows = [(i, [7, *range(1000 * (i + 1), 1000 * (i + 1) + 150)]) for i in range(30)]
    sets = spark.createDataFrame(rows + [(i + 100, w[1:]) for i, w in rows], "id long, words array<long>")
    pairs = setjoin.candidate_pairs(setjoin.prefixes(sets, 0.85), 0.85)
    assert {(r.a, r.b) for r in pairs.collect()} == {(i, i + 100) for i in range(30)}


@pytest.mark.parametrize("cells", [(4096, 512), (2, 2)])
def test_set_join_keeps_repeated_ids_and_drops_null_ones(spark, cells):
    words = list(range(20))
    rows = [(1, words), (1, words), (2, [*words, 99]), (None, words), (3, [5, 1000])]
    sets = spark.createDataFrame(rows, "id long, words array<long>")
    assert sorted((r.a, r.b, round(r.similarity, 3)) for r in setjoin.similar_sets(sets, 0.85, *cells).collect()) == [(1, 2, 0.952)] * 2


def test_recall_of_the_bands(spark):
    rows = frame(spark, list(enumerate(texts(30))))
    table = nd.dedup_table(rows)
    sets = table.join(table.groupBy("set_key").agg(F.min("id").alias("id")).select("id"), "id")
    measured = setjoin.band_recall(sets, nd.lsh_buckets(sets), 0.85).first()
    assert measured.pairs > 20 and measured.recall == measured.found / measured.pairs > 0.5
    none = setjoin.band_recall(sets.where("false"), nd.lsh_buckets(sets.where("false")), 0.85).first()
    assert (none.pairs, none.found, none.recall) == (0, 0, None)


def test_buckets_meet_where_their_sets_do(spark):
    """(similarity, marked) of pairs whose place is dealt to cells; ids without buckets share none."""
    sets = spark.createDataFrame([(i, [1, 2, 3, 10 + i % 2]) for i in range(12)], "id long, words array<long>")
    pairs = spark.createDataFrame([(a, b, (a + b) % 2) for a in range(12) for b in range(a)], "a long, b long, place int")
    marks = spark.createDataFrame([(i, [i % 3, 100 + i]) for i in range(10)], "id long, marks array<int>")
    got = {(r.a, r.b): (r.similarity, r.marked) for r in setjoin._compared(pairs, sets, 3, marks).collect()}
    assert got == {(a, b): (1.0 if (a - b) % 2 == 0 else 0.6, a < 10 and (a - b) % 3 == 0) for a in range(12) for b in range(a)}


def test_word_sets_are_one_row_for_each_set(spark, tmp_path):
    """As a join with the first id of each set: repeated ids stay, null ids go, an id that is first of two sets counts for both."""
    from corpusloom.plans.duplicates import _word_sets

    text = lambda n: " ".join(f"w{i}" for i in range(n))
    rows = [(1, text(12)), (2, text(12)), (3, text(13)), (3, text(13)), (4, text(14)), (4, text(15)), (None, text(16)), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'s' AS source", "'l' AS lang")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.id, len(r.words)) for r in _word_sets(spark, str(tmp_path)).collect())
    assert got == [(1, 12), (3, 13), (3, 13), (4, 14), (4, 14), (4, 15), (4, 15)]


def test_a_batch_of_a_bucketed_table_replaces_itself(spark, tmp_path):
    from corpusloom.sources.bucketed import Layout

    layout = Layout("k long, v long, batch int", ("k",), 4, "batch")
    table = BucketedTable(spark, str(tmp_path), layout)
    table.write(spark.range(10).selectExpr("id AS k", "id AS v"), 0)
    table.write(spark.range(10, 15).selectExpr("id AS k", "id AS v"), 1)
    table.write(spark.range(3).selectExpr("id AS k", "-id AS v"), 0)
    assert sorted((r.k, r.v, r.batch) for r in table.read().collect()) == [(0, 0, 0), (1, -1, 0), (2, -2, 0), *((i, i, 1) for i in range(10, 15))]


def test_roots_are_found_once_for_the_batches_there_are(spark, tmp_path, monkeypatch):
    """The answer of an insert and the clusters share them; another batch, or a broken one, gives new ones."""
    found = []
    monkeypatch.setattr(LshIndex, "_moved_roots", lambda self, plain=LshIndex._moved_roots: found.append(self.batches()) or plain(self))
    rows = list(enumerate(texts(6)))
    index = LshIndex(spark, str(tmp_path), buckets=4)
    index.insert(frame(spark, rows[::2]))
    index.insert(frame(spark, rows[1::2]))
    assert listed(index.clusters(frame(spark, rows))) == listed(nd.duplicate_clusters(frame(spark, rows)))
    assert found == [[], [0], [0, 1]]


def test_a_new_index_has_a_bucket_for_each_partition_of_a_shuffle(spark, tmp_path):
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert LshIndex(spark, str(tmp_path)).bands.layout.buckets == partitions
