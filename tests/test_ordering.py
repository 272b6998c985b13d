import math
import random

from pyspark.sql import functions as F

from corpusloom.operators import keyed, ordering


def test_positions_and_batches(spark):
    values = random.Random(1).sample(range(10**6), 3000)
    df = spark.createDataFrame([(v,) for v in values], "k bigint").repartition(6)
    got = {r.k: r.position for r in ordering.row_positions(df, "k").collect()}
    assert got == {v: i for i, v in enumerate(sorted(values))}
    batch = {r.k: r.batch for r in ordering.batches(df, "k", 700).collect()}
    assert batch == {v: i // 700 for i, v in enumerate(sorted(values))}


def test_positions_with_ties(spark):
    rows = [(i % 3, i) for i in range(50)]
    df = spark.createDataFrame(rows, "k int, id int")
    got = {(r.k, r.id): r.position for r in ordering.row_positions(df, "k", ("id",)).collect()}
    assert got == {r: i for i, r in enumerate(sorted(rows))}


def test_positions_of_a_heavy_value(spark):
    rows = [(5 if i % 10 else i, i * 7919 % 20_011) for i in range(20_000)]
    df = spark.createDataFrame(rows, "k int, id int").repartition(4)
    got = {(r.k, r.id): r.position for r in ordering.row_positions(df, "k", ("id",)).collect()}
    assert got == {r: i for i, r in enumerate(sorted(rows))}
    bins = ordering._binned(df, "k", ("id",)).where("k = 5").groupBy("_bin").count().collect()
    assert len(bins) > 1


def test_running_sums(spark):
    rows = [(i * 37 - 500, i % 7, i) for i in range(300)]
    df = spark.createDataFrame(rows, "id bigint, a int, b int").repartition(4)
    a = b = 0
    got = {r.id: (r.a_before, r.b_before) for r in ordering.running_sums(df, "id", ["a", "b"]).collect()}
    for i, x, y in sorted(rows):
        assert got[i] == (a, b)
        a, b = a + x, b + y


def test_numbered_ranges_of_texts(spark):
    names = [f"name {i * 7919 % 997}" for i in range(997)]
    got = {r.n: r.position for r in ordering.numbered_ranges(spark.createDataFrame([(n,) for n in names], "n string"), ["n"]).collect()}
    assert got == {n: i for i, n in enumerate(sorted(names))}


def test_nth_smallest_with_infinite_values(spark):
    values = [float("inf")] * 3 + [float("-inf")] * 2 + [0.0, 1e-300, 2.5, 1e308, -1e308, 7.0, 7.0, 5e-324]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [ordering.nth_smallest(df, F.col("v"), n) for n in range(1, len(values) + 1)] == sorted(values)


def test_nth_smallest(spark):
    for values in ([random.Random(4).randrange(10**9) for _ in range(5000)], [7] * 300 + [1, 2, 9], [i // 100 for i in range(2000)]):
        df = spark.createDataFrame([(v,) for v in values], "v bigint").repartition(4)
        for n in (1, 2, len(values) // 3, len(values)):
            assert ordering.nth_smallest(df, F.col("v"), n) == sorted(values)[n - 1]
        assert ordering.nth_smallest(df, F.col("v"), len(values) + 1) is None


def test_splits(spark):
    df = spark.range(1003).repartition(5)
    for size in (0.05, 0.1, 0.5):
        cut = ordering.train_test_split(df, size)
        assert cut.where("split = 'test'").count() == math.ceil(1003 * size) and cut.count() == 1003
    both = ordering.overlapping_split(df, 0.05)
    assert both.where("split = 'train'").count() == 1003 and both.where("split = 'test'").count() == 51
    assert ordering.overlapping_split(df, 0.05, disjoint=True).count() == 1003
    assert ordering.take_skip_split(df, n_valid=40).where("split = 'valid'").agg(F.max("id")).first()[0] == 39
    assert ordering.take_skip_split(df, n_valid=4000).where("split = 'valid'").count() == 1003
    assert ordering.first_n(df, "id", 10).count() == 10 and ordering.first_n(df, "id", 0).count() == 0
    assert ordering.first_n(df, "id", 5000).count() == 1003
    shares = {r.split: r.n for r in ordering.split_counts(ordering.three_way_split(df)).collect()}
    assert 700 < shares["train"] < 880 and abs(shares["test"] - shares["valid"]) < 60


def test_split_with_tied_draws(spark, monkeypatch):
    monkeypatch.setattr(ordering, "unit_hash", lambda seed, key, salt: (F.col("id") % 4) / 4.0)
    cut = ordering.train_test_split(spark.range(100), 0.3)
    assert sorted(r.id for r in cut.where("split = 'test'").collect()) == sorted(sorted(range(100), key=lambda i: (i % 4, i))[:30])


def test_shuffle_is_a_repeatable_permutation(spark):
    a = [r.id for r in ordering.shuffled(spark.range(300)).collect()]
    b = [r.id for r in ordering.shuffled(spark.range(300).repartition(7)).collect()]
    assert a == b and sorted(a) == list(range(300)) and a != sorted(a)
    assert len(ordering.sample_rows(spark.range(300)).collect()) == 3


def test_replicated_prompts(spark):
    df = spark.createDataFrame([(0, " a\n"), (1, "b"), (2, "c")], "task_id bigint, prompt string")
    rows = ordering.replicate_prompts(df, 2, n_tasks=2).orderBy("task_id", "copy").collect()
    assert [(r.task_id, r.prompt, r.copy) for r in rows] == [
        (0, "<|endoftext|>a", 0), (0, "<|endoftext|>a", 1), (1, "<|endoftext|>b", 0), (1, "<|endoftext|>b", 1)
    ]


def hot_frame(spark):
    """A third of the rows share one key."""
    return spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 97).alias("k"))


def test_salted_joins_equal_plain_joins(spark):
    left = hot_frame(spark)
    right = spark.range(60).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    hot = keyed.hot_keys(left.groupBy("k").agg(F.count(F.lit(1)).alias("n")), ["k"], at_least=500)
    assert [r.k for r in hot.collect()] == [0]
    for how in ("left", "inner", "left_semi", "left_anti"):
        want = sorted(map(tuple, left.join(right, "k", how).collect()), key=repr)
        for extra in ({}, {"hot": hot}):
            got = keyed.salted_join(left, right, ["k"], how, spread=["id"], **extra)
            assert sorted(map(tuple, got.collect()), key=repr) == want


def test_hot_key_spreads_over_tasks(spark):
    left = hot_frame(spark)
    right = spark.range(60).select(F.col("id").alias("k"), F.lit(1).alias("v")).hint("merge")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = keyed.salted_join(left, right, ["k"], "inner", spread=["id"])
        per_task = joined.where("k = 0").groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(per_task) >= 6 and max(r["count"] for r in per_task) < 500


def test_first_per_key_limits_before_the_shuffle(spark):
    df = keyed.first_per_key(hot_frame(spark), ["k"], ["id"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Partial") > plan.index("Exchange")
    assert {r.k: r.id for r in df.collect()}[0] == 0 and df.count() == 97


def test_insert_if_absent(spark):
    held = spark.createDataFrame([("a", 1, "old")], "f string, u int, c string")
    new = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y"), ("b", 1, "z")], "f string, u int, c string")
    rows = keyed.insert_if_absent(held, new, ["f", "u"], ["c"]).collect()
    assert sorted((r.f, r.c, r.inserted) for r in rows) == [("a", "old", False), ("b", "y", True)]


def test_duplicate_fraction(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "hash string")
    assert keyed.duplicate_fraction(df).first()[0] == 0.25
    assert abs(keyed.duplicate_fraction(df, approximate=True).first()[0] - 0.25) < 0.1
