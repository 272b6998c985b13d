import random
import re

from pyspark.sql import functions as F

from corpusloom.functions.text import count_of, drop_whitespace, lines, quoted, strip, unit_hash
from corpusloom.functions.tokens import jaccard, token_count, token_texts
from corpusloom.operators import codetext as ct
from corpusloom.operators import features as ft
from corpusloom.operators import filters as fl


def test_text_functions_follow_python(spark):
    random.seed(3)
    letters = "ab \n\r\x0b\x0c\x1c\x1e\x1f\x85 \xa0　é😀"
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 9))) for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, c string")
    got = df.select("id", lines("c").alias("l"), strip("c").alias("s"), drop_whitespace("c").alias("d"), count_of("c", "a").alias("n"))
    for row in got.collect():
        text = texts[row.id]
        assert row.l == text.splitlines()
        assert row.s == text.strip()
        assert row.d == re.sub(r"\s+", "", text)
        assert row.n == text.count("a")


def test_unit_hash_does_not_depend_on_partitions(spark):
    ids = spark.range(500)
    one = {r.id: r.u for r in ids.coalesce(1).select("id", unit_hash(7, "id", "x").alias("u")).collect()}
    many = {r.id: r.u for r in ids.repartition(8).select("id", unit_hash(7, "id", "x").alias("u")).collect()}
    assert one == many and all(0 <= u < 1 for u in one.values()) and 0.4 < sum(one.values()) / 500 < 0.6


def test_quoted_matches_itself(spark):
    for text in ["<|end|>", "a.b*c", "[x](y){z}", "\\d+$^", "#&~-"]:
        assert spark.range(1).select(F.lit(text).rlike(f"^{quoted(text)}$").alias("m")).first().m


def test_tokens(spark):
    row = spark.createDataFrame([("foo_1(bar) é\n x",)], "c string")
    got = row.select(token_texts("c").alias("t"), token_count("c").alias("n")).first()
    assert got.t == ["foo_1", "(", "bar", ")", "é", "x"] and got.n == 6


def test_jaccard(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], [])], "a array<string>, b array<string>")
    assert [r.j for r in df.select(jaccard(F.col("a"), F.col("b")).alias("j")).collect()] == [1 / 3, None]


LUA = """-- auto-generated by a tool
local function area(w, h)
  local size = w * h
  if size == 0 then size = 1 end
  return size
end
x = 1
y = 2
z = 3
"""


def _features(text: str) -> dict:
    """The same rules written as loops over one text."""
    rows = text.splitlines()
    head = "\n".join(r.lower() for r in rows[:5])
    low, limit = text.lower(), int(0.05 * text.count("\n"))
    sizes = [len(r) for r in rows]
    return {
        "line_mean": sum(sizes) / len(sizes) if sizes else None,
        "line_max": max(sizes) if sizes else None,
        "autogenerated": any(m in head for m in ft.GENERATED_MARKERS),
        "config_or_test": any(m in head for m in ft.TEST_MARKERS) or low.count("config") > limit or low.count("test") > limit,
        "has_no_keywords": not any(k in low for k in ft.LUA_KEYWORDS),
        "has_few_assignments": text.count("=") <= 4,
    }


def test_features_of_code_and_odd_texts(spark):
    texts = [LUA, "", " \t\n", "a\r\nb\x1cc", "config = 1\n" * 3, "x\n" * 100 + "test\n" * 6, "x\n" * 100 + "test\n" * 5, "UNIT TESTS\nx = 1"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, content string")
    for row in ft.with_features(df).collect():
        want = _features(texts[row.id])
        assert {k: row[k] for k in want} == want, texts[row.id]
    single = df.select(
        "id", ft.is_autogenerated("content").alias("a"), ft.is_config_or_test("content").alias("c"),
        ft.has_no_keywords("content").alias("k"), ft.has_few_assignments("content").alias("f"),
    )
    for row in single.collect():
        want = _features(texts[row.id])
        assert (row.a, row.c, row.k, row.f) == tuple(
            want[k] for k in ("autogenerated", "config_or_test", "has_no_keywords", "has_few_assignments")
        )


def test_alpha_frac_and_ratio(spark):
    df = spark.createDataFrame([("ab1 é!",), ("",)], "c string")
    got = df.select(ft.alpha_frac("c").alias("a"), ft.char_token_ratio("c").alias("r")).collect()
    assert got[0].a == 4 / 6 and got[0].r == 6 / 3 and got[1].a is None and got[1].r is None


def test_first_copy_uses_the_hash_up(spark):
    good = "function f() end a = 1 b = 2 c = 3 d = 4 e = 5 some words here to fill the line\n" * 3
    rows = [(1, good + "x" * 2000), (2, (good + "x" * 2000).replace("\n", " \n")), (3, good), (4, good.replace(" ", "  ")), (5, "")]
    df = ft.with_features(spark.createDataFrame(rows, "id int, content string"))
    rules = fl.QualityRules(line_mean=5000)
    assert [r.id for r in fl.quality_filter(df, rules).orderBy("id").collect()] == [3]
    reasons = {r.reason: r.n for r in fl.quality_reject_reason(df, rules).collect()}
    assert reasons == {"line_max": 2, "duplicate": 2, "kept": 1}
    assert fl.quality_filter(df, rules).where("content is null").isEmpty()


def test_positions(spark):
    rows = [("ab)\ncd", 2, True), ("ab)\ncd", 1, False), ("ab;", 2, True), ("ab", 2, True), ("a # off", 7, True), ("x,y", 1, False)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, text string, offset int, ok boolean")
    df = df.withColumn("filename", F.lit("a.lua"))
    assert [r.id for r in fl.completion_positions(df).orderBy("id").collect()] == [i for i, r in enumerate(rows) if r[2]]
    left = fl.completion_positions(df, disable_line=["#"]).collect()
    assert 4 not in [r.id for r in left] and len(left) == 3
    assert fl.completion_positions(df, disable_file=[r"\.lua$"]).isEmpty()


def test_code_text(spark):
    text = "say ```lua\nedi.a:one(1)\n``` or\n`lua\nedi.b:two() edi.c:one()\n` edi.d:three()"
    row = spark.createDataFrame([(text,)], "t string").select(
        ct.find_code_blocks("t").alias("b"), ct.find_function_calls("t").alias("c"), ct.calls_in_code_blocks("t").alias("k")
    ).first()
    assert row.b == re.findall(r"`lua\n(.*?)\n`", text, re.S)
    assert row.c == ["one", "two", "one", "three"] and row.k == ["one", "two", "one"]


def test_last_block_is_cut(spark):
    texts = ["a\ndef b\nclass c", "no marker", "x\n# y", "\nif"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(ct.remove_last_block("t").alias("r"), ct.hits_stop_string("t").alias("h")).collect()
    assert [r.r for r in got] == ["a\ndef b", "", "x", ""] and [r.h for r in got] == [True, False, True, True]


def test_comment_code_pairs(spark):
    code = "local a\n\n    -- first\n\tif a then\n-- one\n-- two\nb()\n-- last"
    rows = ct.comment_code_pairs(spark.createDataFrame([(1, code)], "id int, content string")).collect()
    want = []
    for note, line in re.findall(r"(--[^\n]*)\n\s*([^\n]+)", code):
        if not line.strip().startswith("--"):
            want.append((note.strip(), line.strip(), code.index(line), code.index(line) + len(line) - 1))
    assert [(r.notation, r.code, r.start, r.end) for r in rows] == want and want


def test_grep_lines(spark):
    df = spark.createDataFrame([(1, "a b\nc\r\nxb\rb"), (2, "nothing"), (3, "a\nb")], "id int, content string")
    assert {r.id: r.line_numbers for r in ct.grep_lines(df, "b").collect()} == {1: [1, 3, 4], 3: [2]}
    assert ct.grep_lines(df, "a\nb").isEmpty()


def test_test_program_and_content(spark):
    df = spark.createDataFrame([("def t(): pass", "f", "ask", "x `lua\ncode\n` y"), ("t", "g", "ask", "none")], "t string, e string, p string, r string")
    got = df.select(ct.build_test_program("t", "e").alias("b"), ct.create_content("p", "r").alias("c")).collect()
    assert got[0].b == "\ndef t(): pass\ncheck(f)"
    assert got[0].c == "-- ask\ncode" and got[1].c == "-- ask\n" + ct.NO_CODE
