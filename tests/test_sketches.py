import pytest
from pyspark.sql import functions as F

from corpusloom.functions import tables
from corpusloom.operators import luafunctions
from corpusloom.operators import sketches as sk


def test_merged_sketches_are_the_sketch_of_the_union(spark):
    rows = spark.range(30_000).select((F.col("id") % 3).cast("string").alias("source"), F.md5((F.col("id") % 9000).cast("string")).alias("hash"))
    stored = sk.key_sketches(rows.repartition(7), "source")
    whole = sk.key_sketches(rows.withColumn("source", F.lit("all")), "source")
    one, two = (sk.estimated_duplicates(s).first() for s in (sk.merged(stored), whole))
    assert (one.rows, one.distinct) == (two.rows, two.distinct) == (30_000, one.distinct)
    assert abs(one.distinct - 9000) < 4 * sk.standard_error() * 9000
    assert abs(one.duplicate_fraction - 0.7) < 4 * sk.standard_error()
    each = {r.source: r.distinct for r in sk.estimated_duplicates(stored).collect()}
    assert set(each) == {"0", "1", "2"} and all(abs(n - 3000) < 4 * sk.standard_error() * 3000 for n in each.values())


def test_overlap_of_sources(spark):
    rows = spark.sql("SELECT 'a' AS source, id AS hash FROM range(4000) UNION ALL SELECT 'b', id FROM range(3000, 7000) UNION ALL SELECT 'c', id FROM range(9000, 9500)")
    found = {(r.a, r.b): r.shared for r in sk.estimated_overlap(sk.key_sketches(rows, "source"), "source").collect()}
    error = 4 * sk.standard_error() * 8000
    assert abs(found["a", "b"] - 1000) < error and found["a", "c"] < error and found["b", "c"] < error


def test_no_rows(spark):
    none = spark.createDataFrame([], "source string, hash string")
    assert sk.estimated_duplicates(sk.key_sketches(none, "source")).collect() == []
    empty = sk.estimated_duplicates(sk.merged(sk.key_sketches(none, "source"))).first()
    assert empty.rows is None or empty.rows == 0


CODE = """-- adds one
local function add(x)
  if x then return x + 1 end
end
GameEvent.add(add)

function plain() end
"""


def test_table_function_gives_the_rows_of_the_extraction(spark):
    tables.register(spark)
    files = spark.createDataFrame([("a", CODE), ("b", "no code"), ("c", None), ("d", CODE * 3)], "path string, content string")
    want = {tuple(r) for r in luafunctions.extract_functions(files).select("path", "ord", "name", "body", "comment", "register").collect()}
    query = "SELECT path, f.* FROM {files}, LATERAL lua_functions(content) f"
    assert {tuple(r) for r in spark.sql(query, files=files).collect()} == want and len(want) == 4
    loose = spark.sql("SELECT path, f.* FROM {files}, LATERAL lua_functions(content, require_register => false) f", files=files)
    want = luafunctions.extract_functions(files, require_register=False).select("path", "ord", "name", "body", "comment", "register")
    assert {tuple(r) for r in loose.collect()} == {tuple(r) for r in want.collect()} and loose.count() == 8
    assert loose.schema["ord"].dataType.simpleString() == "int"
    for wrong in ("lua_functions(1)", "lua_functions(content, register_call => path)"):
        with pytest.raises(Exception, match="lua_functions needs"):
            spark.sql(f"SELECT f.* FROM {{files}}, LATERAL {wrong} f", files=files).collect()
