import math
import random
import re
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import apieval as ev
from corpusloom.operators import bpe
from corpusloom.operators import editor as ed
from corpusloom.operators import metrics as mt

ENTRIES = [(0, "one", None), (1, "two", "edi.a:three() edi.a:one()"), (2, "one", ""), (3, "four", "edi.a:three()")]
GENERATED = ["nothing", "edi.x:one() edi.x:three()", "edi.x:nope()", "edi.x:one() edi.x:nope() edi.y:nope() edi.x:four()"]


@pytest.fixture(scope="module")
def catalogue(spark):
    return ev.api_catalogue(spark.createDataFrame(ENTRIES, "ord int, function_name string, example string"))


@pytest.fixture(scope="module")
def results(spark, catalogue):
    rows = [(i, i % 2, f"p{i}", g) for i, g in enumerate(GENERATED)]
    df = spark.createDataFrame(rows, "id int, checkpoint int, prompt string, generated string")
    return ev.eval_output(df, catalogue).cache()


def test_catalogue(catalogue):
    rows = catalogue.orderBy("origin", "ord", "call_no").collect()
    assert [r.function_name for r in rows] == ["one", "two", "one", "four", "three", "one", "three"]
    first = {r.function_name: (r.origin, r.ord) for r in ev.first_by_name(catalogue).collect()}
    assert first == {"one": (0, 0), "two": (0, 1), "four": (0, 3), "three": (1, 1)}


def test_verdicts(results):
    rows = results.orderBy("id").collect()
    assert [r.note for r in rows] == [
        "No function found",
        "All functions matched: one three",
        "No function matched: nope",
        "Some functions matched: one four  \nSome functions not matched: nope nope",
    ]
    assert [(r.match_count, r.unmatch_count) for r in rows] == [(0, 0), (2, 0), (0, 1), (2, 2)]
    assert [c.target for c in rows[3].all_result] == ["nope", "nope", "one", "four"]
    assert rows[3].all_result[0].match is None and rows[1].match[1].match.in_example == ENTRIES[1][2]


def test_markdown_counts_blocks_only(spark, catalogue):
    df = spark.createDataFrame([(0, "edi.x:one() `lua\nedi.x:two()\n`")], "id int, generated string")
    assert ev.eval_output(df, catalogue, is_md=True).first().note == "All functions matched: two"


def test_reports(spark, results, catalogue):
    row = ev.eval_report(results).first()
    assert (row.total_tests, row.matched, row.unmatched, row.total) == (4, 4, 3, 7)
    assert (row.zero_api_count, row.full_api_count, row.partical_api_count) == (1, 1, 2)
    assert row.match_rate_avg == 4 / 7 and row.api_count_avg == 7 / 4
    by = {r.checkpoint: r.matched for r in ev.checkpoint_summary(results).collect()}
    assert by == {0: 0, 1: 4}
    calls = ev.api_calls(results.select("id", "generated"))
    assert {r.target: r.n for r in ev.unmatched_names(calls, catalogue).collect()} == {"nope": 3}
    counted = ev.call_counts(results.select("id", "checkpoint"), calls, catalogue)
    assert ev.eval_report(counted).first() == row
    section = results.where("id = 2").select(ev.report_section().alias("s"), ev.report_section(False).alias("t")).first()
    assert section.s == "\n ---  \n  **Prompt: p2** \n\n **Output:**  \n edi.x:nope()\n\n  **Note:**  No function matched: nope\n\n"
    assert " ``` edi.x:nope()\n```\n\n" in section.t


def test_published_rates(spark):
    """171 generations: 224 of 293 calls matched, 53 without calls, 70 fully matched."""
    rows = [(0, 0)] * 53 + [(2, 0)] * 69 + [(44, 0)] + [(1, 1)] * 27 + [(0, 2)] * 21 + [(15, 0)] * 0
    rows[122] = (224 - 138 - 27, 0)
    df = spark.createDataFrame(rows, "match_count bigint, unmatch_count bigint")
    r = ev.eval_report(df).first()
    assert (r.total_tests, r.total) == (171, 293)
    assert f"{r.match_rate_avg:.2%} {r.api_count_avg:.2f} {r.zero_api_count_rate:.2%}" == "76.45% 1.71 30.99%"
    assert f"{r.full_api_count_rate:.2%} {r.partical_api_count_rate:.2%}" == "40.94% 28.07%"


def test_empty_report(results):
    row = ev.eval_report(results.where("id < 0")).first()
    assert row.total_tests == 0 and row.match_rate_avg is None


def test_pass_at_k(spark):
    rng = random.Random(1)
    runs = {t: [rng.random() < 0.4 for _ in range(rng.randint(6, 9))] for t in range(5)}
    df = spark.createDataFrame([(t, p) for t, ps in runs.items() for p in ps], "task_id int, passed boolean")
    row = mt.pass_at_k(df, (1, 3, 9)).first()
    for k in (1, 3):
        want = sum(sum(any(c) for c in combinations(ps, k)) / math.comb(len(ps), k) for ps in runs.values()) / 5
        assert abs(row[f"pass_at_{k}"] - want) < 1e-12
    assert min(map(len, runs.values())) < 9 and row.pass_at_9 is None


def test_losses_and_accuracy(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 4.0)], "step int, loss double")
    assert mt.perplexity(df, batch_size=4).first().loss == 7 / 3
    cut = mt.perplexity(df, step="step", batch_size=4, dataset_size=6).first()
    assert cut.loss == (4 * 1.0 + 2 * 2.0) / 6 and abs(cut.perplexity - math.exp(cut.loss)) < 1e-12
    assert mt.perplexity(df.withColumn("loss", F.lit(1000.0))).first().perplexity == math.inf
    scored = spark.createDataFrame([([0.1, 0.9], 1), ([0.5, 0.5], 0), ([0.9, 0.1], 1)], "logits array<double>, label int")
    assert mt.accuracy(scored).first().accuracy == 2 / 3
    assert mt.token_rate(spark.createDataFrame([(10, 2.0), (5, 1.0)], "tokens int, seconds double")).first().token_rate == 5.0


def test_samples_in_bounded_rows(spark):
    df = spark.range(25).select(F.lit("t").alias("task_id"), F.col("id").alias("sample"), F.col("id").cast("string").alias("generation"))
    rows = mt.samples_by_task(df, per_row=10).orderBy("part").collect()
    assert [len(r.samples) for r in rows] == [10, 10, 5] and sum([r.samples for r in rows], []) == [str(i) for i in range(25)]


# ---------------------------------------------------------------- editor


def merged(spans):
    out = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def test_spans(spark):
    rng = random.Random(8)
    spans = {k: [(s, s + rng.randint(0, 30)) for s in (rng.randrange(900) for _ in range(rng.choice([0, 1, 40])))] for k in range(12)}
    rows = [(k, s, e) for k, v in spans.items() for s, e in v]
    df = spark.createDataFrame(rows, "k int, start int, end int")
    for stride in (7, 100_000):
        got = {}
        for r in ed.merge_spans(df, ["k"], stride=stride).collect():
            got.setdefault(r.k, []).append((r.start, r.end))
        assert {k: sorted(v) for k, v in got.items()} == {k: merged(v) for k, v in spans.items() if v}
    arrays = spark.createDataFrame(list(spans.items()), "k int, s array<struct<start:int,end:int>>")
    for r in arrays.select("k", ed.merge_span_array("s").alias("m")).collect():
        assert [tuple(x) for x in r.m] == merged(spans[r.k])


def test_tasks_that_merge_spans_follow_their_number(spark):
    """A hot start, null keys and spans over many stretches; a task gets about as many spans as it is told."""
    rng = random.Random(3)
    rows = [("a", 5, 5 + i % 40) for i in range(300)] + [("b", i, i + 500 * (i % 50 == 0) + 1) for i in rng.sample(range(2000), 400)]
    rows += [(None, s, s + rng.randrange(9)) for s in rng.sample(range(2000), 300)]
    df = spark.createDataFrame(rows, "k string, start int, end int")
    got = ed.merge_spans(df, ["k"], stride=50, task_spans=20)
    assert got.columns == ["k", "start", "end"] and got.rdd.getNumPartitions() == 50
    want = [(k, *span) for k in ("a", "b", None) for span in merged([(s, e) for c, s, e in rows if c == k])]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert ed.merge_spans(df.where("false"), ["k"]).collect() == []


def test_overlap_spans_are_text(spark):
    rng = random.Random(9)
    pool = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(12)]
    known = [" ".join(texts[i].split(" ")[5:20]) for i in range(4)] + ["w1 w2"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, content string")
    refs = spark.createDataFrame([(k,) for k in known], "content string")
    n, want = 4, set()
    grams = {tuple(k.split(" ")[i : i + n]) for k in known for i in range(len(k.split(" ")) - n + 1)}
    for d, text in enumerate(texts):
        words = text.split(" ")
        hits = [(i, i + n) for i in range(len(words) - n + 1) if tuple(words[i : i + n]) in grams]
        for s, e in merged(hits):
            begin = len(" ".join(words[:s])) + (1 if s else 0)
            want.add((d, begin, begin + len(" ".join(words[s:e]))))
    got = {tuple(r) for r in ed.contamination_overlap(docs, refs, n).collect()}
    assert got == want and want


def test_prompt_window(spark):
    rows = [("abc def", 3), ("abc  \n", 3), ("x" * 9000, 4500), ("abc", 0), ("abc", 3)]
    df = spark.createDataFrame(rows, "text string, offset int")
    for t in (ed.ANGLE_TEMPLATE, ed.SPACED_TEMPLATE):
        for row, got in zip(rows, df.select(ed.fim_prompt_window("text", "offset", t).alias("p")).collect()):
            text, at = row
            before, after = text[max(0, at - 4000) : at], text[at : at + 4000]
            want = t.fill.replace("[prefix]", before).replace("[suffix]", after) if after.strip() else before
            assert got.p == want
    assert df.select(ed.fim_prompt_window("text", "offset", fill_mode=False).alias("p")).first().p == "abc"
    assert df.select(ed.attribution_window("text", "offset", 2).alias("p")).first().p == "bc d"


def test_clean_up(spark):
    rows = [("ask", "ask me<|endoftext|><fim_middle>!"), ("ask", "answer\r\n"), ("", "x")]
    df = spark.createDataFrame(rows, "inputs string, generated string")
    got = df.select(ed.clean_completion("generated", "inputs").alias("c"), ed.clean_server_text("generated").alias("s")).collect()
    assert [r.c for r in got] == [" me!", "answer\r\n", "x"] and got[1].s == "answer"
    replies = ['{"generated_text": "a"}', '[{"generated_text": "b"}, {"generated_text": "c"}]', "{}", "[]", "broken"]
    df = spark.createDataFrame([(r,) for r in replies], "r string")
    assert [r.t for r in df.select(ed.parse_generation_json("r").alias("t")).collect()] == ["a", "b", "", "", ""]


def test_hints(spark):
    rows = [
        ("foo()\nbar", 4, "foo(", "foo(x)", "x"),  # the closing bracket is there already
        ("foo\nnext", 3, "foo", "foo.bar", ".bar"),
        ("food", 3, "foo", "foo.bar", None),  # inside a word
        ("foo", 3, "fob", "foo.bar", None),  # other prefix
        ("a b", 1, "a", "a b", ""),
        ("say ", 4, "", "hello", "hello"),
    ]
    df = spark.createDataFrame([(i, *r[:4]) for i, r in enumerate(rows)], "id int, text string, offset int, prefix string, suggestion string")
    got = {r.id: r.hint for r in ed.trim_known_context(df).collect()}
    assert got == {i: r[4] for i, r in enumerate(rows) if r[4] is not None}


# ---------------------------------------------------------------- byte pairs


def learn(texts, n_merges, min_count=2):
    """One merge at a time."""
    split = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?[^\s\w]+|\s+(?!\S)|\s+")
    words = Counter(w for t in texts for w in split.findall(t))
    table = {w: [chr(b) for b in w.encode()] for w in words}
    spelled, merges = {chr(i): bytes([i]) for i in range(256)}, []
    for k in range(n_merges):
        pairs = Counter()
        for w, n in words.items():
            for a, b in zip(table[w], table[w][1:]):
                pairs[a + b] += n
        if not pairs:
            break
        pair, n = min(pairs.items(), key=lambda p: (-p[1], p[0]))
        if n < min_count:
            break
        symbol = chr(bpe.FIRST_MERGED + k)
        spelled[symbol] = spelled[pair[0]] + spelled[pair[1]]
        merges.append((spelled[pair[0]].hex(), spelled[pair[1]].hex(), n))
        for w, symbols in table.items():
            out, i = [], 0
            while i < len(symbols):
                if "".join(symbols[i : i + 2]) == pair and i + 1 < len(symbols):
                    out.append(symbol)
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            table[w] = out
    return merges


def test_byte_pairs_equal_stepwise_learning(spark):
    rng = random.Random(4)
    syllables = ["ba", "na", "nan", "é", "to", "aaaa", "x1", "12", " ", "  ", "don't", "!", "日本"]
    texts = ["".join(rng.choice(syllables) for _ in range(40)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, content string")
    got = [(r.left, r.right, r.n) for r in bpe.bpe_merges(df, vocab_size=256 + 60).orderBy("rank").collect()]
    assert got == learn(texts, 60) and len(got) == 60
    few = bpe.bpe_train(df, vocab_size=256 + 5, n_examples=10)
    assert [(m.left.encode("latin-1").hex(), m.right.encode("latin-1").hex(), m.count) for m in few] == learn(texts[:10], 5)


def test_byte_pairs_stop_when_nothing_repeats(spark):
    df = spark.createDataFrame([(0, "ab"), (1, "cd")], "id int, content string")
    assert [(m.left, m.right) for m in bpe.bpe_train(df, vocab_size=300)] == [("a", "b"), ("c", "d")]
    assert bpe.bpe_train(df, vocab_size=300, min_count=2) == []
