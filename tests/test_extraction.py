import gzip
import json
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import luafunctions as lf
from corpusloom.operators.codetext import render_api_stub
from corpusloom.plans import evaluation
from corpusloom.plans.registry import QUERIES
from corpusloom.sources import readers, writers

LUA = """-- greets
-- politely
local function hello(name)
  -- end of nothing
  for i = 1, 2 do
    if name then print(name) end
  end
  while false do end
end
GameEvent.add(evt, hello, "e")

--[[ block
function ghost() end
]]
function M.open:it(x) return x end
other()

local function anonymous() end
GameEvent.push(a)
local broken = function() if x then
"""


def test_registered_functions(spark):
    df = spark.createDataFrame([("a.lua", LUA), ("b.lua", "nothing here"), ("c.lua", "x = 1")], "path string, content string")
    rows = lf.extract_functions(df).orderBy("path", "ord").collect()
    assert [(r.path, r.name, r.register) for r in rows] == [
        ("a.lua", "hello", 'GameEvent.add(evt, hello, "e")'), ("a.lua", "anonymous", "GameEvent.push(a)")
    ]
    assert rows[0].comment == "-- greets\n-- politely\n"
    assert rows[0].body == LUA[LUA.index("local function hello") : LUA.index("\nGameEvent.add")]
    names = [r.name for r in lf.extract_functions(df, require_register=False).orderBy("ord").collect()]
    assert names == ["hello", "M.open:it", "anonymous"]
    samples = lf.find_all_samples(df).collect()
    assert len(samples) == 1 and [f.name for f in samples[0].functions] == ["hello", "anonymous"]


def nested_end(code, start):
    """Walk from one function to its end."""
    comments = lf.comment_spans(code)
    depth = 0
    for word in re.finditer(r"\b(function|if|for|while|end)\b", code[start:]):
        at = start + word.start()
        if any(a <= at <= b for a, b in comments):
            continue
        depth += -1 if word.group() == "end" else 1
        if depth == 0:
            return start + word.end()
    return -1


def test_ends_match_a_walk_per_function():
    codes = [LUA, "end end function f() end", "function a() function b() end end", "if function c() end", "-- function d() end\nfunction e() --end\nend"]
    for code in codes:
        spans = lf.comment_spans(code)
        want = []
        for m in re.finditer(r"\b(?:local\s+)?function\b", code):
            if any(a <= m.start() <= b for a, b in spans):
                continue
            stop = nested_end(code, m.start())
            if stop != -1 and re.search(r"function\s+[\w_:.]+\s*\(", code[m.start() : stop]):
                want.append(code[m.start() : stop])
        assert [f[1] for f in lf.lua_functions(code, False)] == want


def test_comment_spans(spark):
    df = spark.createDataFrame([("a", "x -- one\n--[[ two\n]] y")], "path string, content string")
    assert [(r.start, r.end) for r in lf.find_comment_spans(df).collect()] == [(2, 8), (9, 17), (9, 20)]


def test_api_json_files(spark, tmp_path):
    entry = {"description": "d", "function_name": "f", "args": [{"name": "a", "type": "t", "comment": "c"}], "example": None}
    (tmp_path / "sub").mkdir()
    (tmp_path / "x.json").write_text(json.dumps({"zoo's [1]": [entry], "abc": "ignored"}))
    (tmp_path / "sub" / "y.json").write_text(json.dumps({"events": [entry, {**entry, "function_name": "g", "return": {"type": "r", "comment": "rc"}}]}, indent=2))
    (tmp_path / "z.txt").write_text("no")
    rows = readers.scan_api_json(spark, str(tmp_path)).orderBy("package", "ord").collect()
    assert [(r.package, r.ord, r.function_name) for r in rows if r.package == "events"] == [("events", 0, "f"), ("events", 1, "g")]
    assert [(r.package, r.function_name) for r in rows if r.package != "events"] == [("zoo's [1]", "f")]
    assert rows[1].ret.type == "r" and rows[0].ret is None and rows[0].args[0].name == "a"
    files = readers.scan_files_by_ext(spark, [str(tmp_path)], ".json").collect()
    assert sorted(f.path.rsplit("/", 1)[1] for f in files) == ["x.json", "y.json"]


def test_stub_forms(spark):
    schema = ("package string, description string, function_name string, args array<struct<name:string,type:string,comment:string>>, "
              "ret struct<type:string,comment:string>, example string")  # fmt: skip
    two = [("a", "int", "x"), ("b", "str", "y")]
    rows = [("events", "E", "on", two, None, None), ("structures", "S", "Tab", two[:1], None, None),
            ("actor", "A", "go", two, ("bool", "ok"), "go(1)"), ("actor", "N", "no", None, None, "")]
    events, structure, actor, bare = (r.s for r in spark.createDataFrame(rows, schema).select(render_api_stub().alias("s")).collect())
    assert events == "-- E\n---@param a int x\n---@param b str y\non(a,b)\n\n"
    assert structure == '-- S\n-- 获取S的x\n---@field a int x\nlocal a = Tab["a"]\n\n'
    assert actor.startswith("-- A的例子\ngo(1)\n\n-- A\n---@param a int x\n") and "---@return bool #ok\n" in actor
    assert actor.endswith('function isc_test_actor:go(a,b)\n\tlocal result = edi.actor:go(a,b)\n\tLOGI("isc_test_actor go: " .. tostring(result))\nend\n\n')
    assert bare == "-- N\nfunction isc_test_actor:no()\n\tedi.actor:no()\nend\n\n"


def test_files_and_csv(spark, tmp_path):
    texts = {"a.lua": "x = 1\n", "deep/b.lua": "y\r\n\"q\", é\n", "c.py": "no"}
    for name, text in texts.items():
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode())
    files = readers.scan_whole_files(spark, [str(tmp_path / "in")], ".lua")
    got = {r.filepath.rsplit("/", 1)[1]: r.content for r in files.collect()}
    assert got == {"a.lua": texts["a.lua"], "b.lua": texts["deep/b.lua"]}
    table = files.select("content", F.lit("  pad ").alias("pad"))
    writers.sink_csv(table, str(tmp_path / "csv"))
    back = readers.scan_csv(spark, str(tmp_path / "csv"), "content string, pad string")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, table.collect()))


def test_result_files(spark, tmp_path):
    for step in (5, 40):
        (tmp_path / f"test_result-{step}.csv").write_text('prompt,match_count\n"a\nb",1\nc,2\n')
    (tmp_path / "test_report-5.md").write_text("no")
    rows = readers.scan_result_files(spark, str(tmp_path), schema="prompt string, match_count bigint").collect()
    assert sorted((r.checkpoint, r.prompt, r.match_count) for r in rows) == [(5, "a\nb", 1), (5, "c", 2), (40, "a\nb", 1), (40, "c", 2)]


def test_shards(spark, tmp_path):
    writers.sink_sharded_gzip_json(spark.range(95).coalesce(1), str(tmp_path / "s"), 20)
    files = list((tmp_path / "s").glob("*.json.gz"))
    assert len(files) == 5 and spark.read.json(str(tmp_path / "s")).count() == 95


def test_rendered_text_keeps_order(spark, tmp_path):
    df = spark.range(50).select("id", F.concat(F.lit("line "), "id").alias("t")).repartition(7)
    writers.sink_text_render(df, str(tmp_path / "t"), "t", ["id"])
    parts = sorted((tmp_path / "t").glob("part-*"))
    assert "".join(p.read_text() for p in parts).split("\n")[:-1] == [f"line {i}" for i in range(50)]


def test_delimited_records(spark):
    bar = "-----------"
    good = f"1{bar} ask \n{bar}2{bar}\tanswer"
    rows = [good, f"1{bar}ask", f"1{bar}ask{bar}2{bar}  \n", good, f"1{bar} {bar}2{bar}x"]
    df = spark.createDataFrame([(r,) for r in rows], "record string")
    assert [tuple(r) for r in readers.delimited_records(df).collect()] == [("ask", "answer")]
    assert [tuple(r) for r in readers.delimited_records(df, prompts_only=True).collect()] == [("ask",)]


def test_found_functions_go_on_in_bounded_batches():
    code = "".join(f"local function f{i}(x)\nend\nGameEvent.add(f{i})\n" for i in range(200))
    batch = pa.RecordBatch.from_pydict({"key": [1, 2, 3], "content": [code, "function", code]})
    got = list(lf._scanned(iter([batch]), True, lf.REGISTER_CALL, 500))
    assert len(got) > 20 and max(b.num_rows for b in got) < 20
    rows = pa.Table.from_batches(got).to_pylist()
    assert [(r["key"], r["ord"], r["name"]) for r in rows] == [(k, i, f"f{i}") for k in (1, 3) for i in range(200)]


def test_api_files_are_made_by_several_tasks(spark, small, tmp_path, monkeypatch):
    monkeypatch.setattr(evaluation, "fresh_path", lambda spark, name: f"{tmp_path}/{name}")
    n = QUERIES["scan_api_json"](spark, small).select("file").distinct().count()
    made = list(tmp_path.glob("api/text/part=*/part-*.txt"))
    assert len(made) == n and len({f.name[:10] for f in made}) > 1


def test_api_files_in_a_local_folder_are_written_by_the_tasks(spark, small, tmp_path, monkeypatch):
    monkeypatch.setattr(evaluation, "fresh_path", lambda spark, name: f"file://{tmp_path}/{name}")
    assert QUERIES["scan_api_json"](spark, small).count() == len(list(tmp_path.glob("api/text/part=*/part-*.txt"))) > 0
    # Hadoop's local file system puts a checksum beside each file it makes, and starts processes to set the mode of both.
    assert not list(tmp_path.glob("api/text/part=*/.*"))


def test_api_files_of_an_empty_table(spark, small, tmp_path):
    spark.read.parquet(f"{small}/part.parquet").limit(0).write.parquet(f"{tmp_path}/part.parquet")
    assert QUERIES["scan_api_json"](spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("local", [True, False])
def test_a_file_per_key(spark, tmp_path, monkeypatch, local):
    if not local:
        monkeypatch.setattr(writers, "local_folder", lambda spark, path: None)
    rows = [(5, "a\u00e9"), (None, "n"), (-3, "m"), (5, "b"), (7, None)]
    df = spark.createDataFrame(rows, "key bigint, value string").coalesce(1)
    monkeypatch.setattr(writers, "FILES_PER_FOLDER", 3)
    writers.sink_file_per_key(df, f"file://{tmp_path}/a b", "key")
    files = readers.scan_whole_files(spark, f"file://{tmp_path}/a b", ".txt").withColumn("key", writers.file_key("filepath", "key"))
    assert sorted((r.key, r.content) for r in files.collect()) == [("", "m\n"), ("", "n\n"), ("5", "a\u00e9\nb\n"), ("7", "\n")]
    assert len(list(tmp_path.glob("a b/*=*"))) == (2 if local else 4)


def test_whole_files_by_either_reader(spark, tmp_path):
    texts = {"a b%.x.json": b"\xef\xbb\xbf{\r\n}", "deep/c.json": b"\xff\xfe \xe9", "empty.json": b"", "d.json.gz": gzip.compress(b"zipped"), "_e.json": b"hidden"}
    for name, text in texts.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(text)
    root = f"{tmp_path}/in"
    plain, wide, zipped = (readers.scan_whole_files(spark, root, ext) for ext in (".json", "json", ".gz"))
    assert ["content:binary" in df._jdf.queryExecution().toString() for df in (plain, wide, zipped)] == [True, False, False]
    got, want = ([tuple(r) for r in df.select("filepath", F.hex("content")).orderBy("filepath").collect()] for df in (plain, wide))
    assert got == want and [c for _, c in got] == [texts[n].hex().upper() for n in ("a b%.x.json", "deep/c.json")]
    assert [r.content for r in zipped.collect()] == ["zipped"]


def test_api_files_of_a_large_tree_are_scanned_in_parts(spark, tmp_path, monkeypatch):
    for k in range(30):
        at = tmp_path / "in" / ("only" if k < 20 else "other [1]{a}") / f"f {k % 5}*" / f"{k}.json"
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(json.dumps({"p": [{"function_name": f"f{k}"}, {"function_name": f"g{k}"}]}))
    (tmp_path / "in" / "_skipped").mkdir()
    (tmp_path / "in" / "_skipped" / "x.json").write_text(json.dumps({"p": [{"function_name": "x"}]}))
    (tmp_path / "in" / "other [1]{a}" / "_metadata.json").write_text(json.dumps({"p": [{"function_name": "m"}]}))
    whole = readers.scan_api_json(spark, f"{tmp_path}/in")
    monkeypatch.setattr(readers, "MOST_FILES", 8)
    assert sorted(len(p) for p in readers.in_parts(spark, [f"{tmp_path}/in"])) == [1, 1, 2, 2]
    assert readers.in_parts(spark, [f"{tmp_path}/none"]) == [[f"{tmp_path}/none"]]
    for root in (f"{tmp_path}/in", [f"{tmp_path}/in/on*", f"{tmp_path}/in/ot*"]):
        parts = readers.scan_api_json(spark, root)
        assert parts.dtypes == whole.dtypes and sorted(map(str, parts.collect())) == sorted(map(str, whole.collect()))
    assert whole.count() == 60
