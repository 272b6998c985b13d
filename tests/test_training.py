import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.tokens import default_tokenizer
from corpusloom.operators import dialogue as dl
from corpusloom.operators import packing as pk
from corpusloom.plans import training

SEP = -1


def documents(n=60, seed=3):
    rng = random.Random(seed)
    return [(i, [rng.randrange(1000) for _ in range(rng.choice([0, 1, 5, 17, 40]))], rng.randrange(1, 90)) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id bigint, input_ids array<int>, n_chars int").repartition(5)


def packed(rows, length, limit, size):
    """Buffer by buffer, by the sizes before each row in id order."""
    buffers, before = {}, 0
    for r in sorted(rows):
        buffers.setdefault(int(before // limit), []).append(r)
        before += size(r)
    out = {}
    for b, buffer in buffers.items():
        flat = [t for r in buffer for t in r[1] + [SEP]]
        for k in range(len(flat) // length):
            out[b, k] = flat[k * length : (k + 1) * length]
    return out


@pytest.mark.parametrize("tokenized", [False, True])
@pytest.mark.parametrize("renumber", [lambda i: i, lambda i: i * 1000, lambda i: i - 40, lambda i: hash((i, 7)) % (1 << 62) - (1 << 61)])
def test_constant_length(spark, tokenized, renumber):
    """Dense, sparse, negative and hashed ids: nothing but the remainder of a buffer is lost."""
    rows = [(renumber(i), ids, n) for i, ids, n in documents()]
    got = pk.pack_constant_length(frame(spark, rows), SEP, seq_length=16, num_of_sequences=8, chars_per_token=2.5, tokenized=tokenized)
    limit = 16 * 8 * (1 if tokenized else 2.5)
    want = packed(rows, 16, limit, (lambda r: len(r[1])) if tokenized else (lambda r: r[2]))
    assert {(r.buffer, r.block): r.input_ids for r in got.collect()} == want
    n_buffers = len({k[0] for k in want})
    assert n_buffers > 1 and sum(len(r[1]) + 1 for r in rows) - 16 * len(want) < 16 * n_buffers


def test_the_packing_query_packs_dense_and_sparse_ids(spark, tmp_path):
    rows = [(i * 3, "word " * (20 + 90 * i)) for i in range(40)]
    spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'en' AS lang", "'web' AS source").write.parquet(f"{tmp_path}/documents.parquet")
    got = training.pack_constant_length(spark, str(tmp_path)).collect()
    of = {gap: sorted(tuple(r[1:]) for r in got if r.gap == gap) for gap in (1, 1000)}
    assert len(of[1]) > 100 and of[1] == of[1000] and len(got) == 2 * len(of[1])


def test_masks_of_blocks_that_begin_inside_a_user_turn(spark):
    ids = [5, 6, -2, 7, -1, 8, 9, -2, 4]
    df = spark.createDataFrame([(ids, True), (ids, False), ([], True), ([3], True)], "ids array<int>, inside boolean")
    got = [r.m for r in df.select(pk.mask_user_labels("ids", -1, -2, F.col("inside")).alias("m")).collect()]
    assert got == [[-100, -100, -2, 7, -100, -100, -100, -2, 4], [5, 6, -2, 7, -100, -100, -100, -2, 4], [], [-100]]


def test_a_long_dialogue_comes_in_numbered_parts(spark):
    turns = spark.range(2500).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.col("id").cast("string").alias("text"))
    parts = dl.collect_messages(turns, mark_last=True).orderBy("part")
    texts = parts.select("part", dl.inference_prompt("messages", first=F.col("part") == 0, last=F.col("last")).alias("t")).collect()
    assert [r.part for r in texts] == [0, 1, 2]
    whole = "".join(r.t for r in texts)
    one = dl.collect_messages(turns, per_row=10_000).select(dl.inference_prompt("messages").alias("t")).first().t
    assert whole == one


def test_group_texts(spark):
    rows = documents(47)
    got = pk.pack_group_texts(frame(spark, rows), 32, batch_rows=10)
    want = {}
    for b in range(5):
        flat = [t for r in rows[b * 10 : b * 10 + 10] for t in r[1]]
        total = len(flat) // 32 * 32 if len(flat) >= 32 else len(flat)
        for k in range(0, total, 32):
            want[b, k // 32] = flat[k : min(k + 32, total)]
    assert {(r.batch, r.block): r.input_ids for r in got.collect()} == want
    short = pk.pack_group_texts(frame(spark, [(0, [1, 2], 2)]), 32).collect()
    assert [r.input_ids for r in short] == [[1, 2]]


def test_chunks_and_padding(spark):
    rows = documents()
    got = {(r.id, r.chunk): r.input_ids for r in pk.chunk_overflow(frame(spark, rows), 8).collect()}
    assert got == {(r[0], k): r[1][k * 8 : k * 8 + 8] for r in rows for k in range(len(r[1]) // 8)}
    batch = frame(spark, rows).withColumn("batch", F.floor(F.col("id") / 7))
    for r in pk.pad_batch(batch, pad_id=9).collect():
        ids = rows[r.id][1]
        longest = max(len(x[1]) for x in rows if x[0] // 7 == r.batch)
        assert r.input_ids == ids + [9] * (longest - len(ids))
        assert r.attention_mask == [1] * len(ids) + [0] * (longest - len(ids)) and r.input_len == len(ids)


@pytest.mark.parametrize("ids", [[7, 1, 2, 8, 3, 7, 4], [1, 2], [], [8, 8, 7, 7, 5, 8], [77, 7, 78, 8], [7], [1, 7, 1, 8, 8]])
def test_user_labels(spark, ids):
    want, hidden = [], False
    for t in ids:
        hidden = (hidden or t == 7) and t != 8
        want.append(-100 if hidden else t)
    df = spark.createDataFrame([(ids,)], "input_ids array<int>")
    assert df.select(pk.mask_user_labels("input_ids", 7, 8).alias("l")).first().l == want


@pytest.mark.parametrize("fit", [False, True])
def test_fim_keeps_the_tokens(spark, fit):
    rows = [(i, list(range(100, 100 + i % 40)), 1) for i in range(400)]
    got = pk.fim_permute(frame(spark, rows), 1, 2, 3, 4, truncate_or_pad=fit).collect()
    changed = spm = 0
    for r in got:
        before, after = rows[r.id][1], r.input_ids
        if after == before:
            continue
        changed += 1
        pre, suf, mid = after.index(1), after.index(3), after.index(2)
        if suf == pre + 1:
            spm += 1
            suffix, rest = after[suf + 1 : mid], after[mid + 1 :]
            again = rest + suffix
        else:
            again = after[pre + 1 : suf] + after[mid + 1 :] + after[suf + 1 : mid]
        assert again == before[: len(again)] and pre == 0
        assert len(after) == len(before) if fit else len(again) == len(before)
    assert 100 < changed < 300 and 0.3 < spm / changed < 0.7
    assert pk.fim_permute(frame(spark, rows), None, None, None).count() == 400


def test_pretokenize_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, "a", "p", "x = 1 + y", "mit")], "id int, repo_name string, path string, content string, license string")
    out = pk.pretokenize(df)
    assert out.columns == ["id", "input_ids", "ratio_char_token"]
    row = out.first()
    assert len(row.input_ids) == 5 and row.ratio_char_token == 9 / 5


def test_label_encode(spark):
    df = spark.createDataFrame([("n",), ("a",), ("n",), ("z",)], "label string")
    assert sorted((r.label, r.label_id) for r in pk.label_encode(df).collect()) == [("a", 0), ("n", 1), ("n", 1), ("z", 2)]


def rendered(messages, t, is_train=True):
    text = f"{t.system_token}\n{t.system}{t.end_token}\n"
    for content, role in messages:
        text += (t.user_token if role == "user" else t.assistant_token) + "\n" + content + t.end_token + "\n"
    return text if is_train else text + t.assistant_token


def test_templates(spark):
    messages = [("hi", "user"), ("yes", "assistant"), ("odd", "system"), ("none", None)]
    df = spark.createDataFrame([(messages,)], dl.MESSAGES.join(["messages ", ""]))
    for name in dl.TEMPLATES:
        t = dl.template(name)
        for train in (True, False):
            assert dl.prepare_dialogue(df, t, train).first().text == rendered(messages, t, train)
    assert df.select(dl.readable("messages").alias("r")).first().r == "\n\nHuman: hi\n\nAssistant: yes\n\nAssistant: odd\n\nAssistant: none"
    with pytest.raises(ValueError):
        dl.template("other")
    head = df.select(dl.system_as_header("messages").alias("r")).first().r
    assert head.startswith("<|system|>\nodd<|end|>\n<|user|>\nhi") and head.count("odd") == 1


def test_prompt_columns(spark):
    t = dl.template("no_system")
    df = spark.createDataFrame([("q", "a"), ("q", None)], "prompt string, completion string")
    assert [r.text for r in dl.prepare_dialogue(df, t).collect()] == [rendered([("q", "user"), ("a", "assistant")], t), rendered([("q", "user")], t)]
    assert dl.prepare_dialogue(df.select("prompt"), t, False).first().text == rendered([("q", "user")], t, False)
    with pytest.raises(ValueError):
        dl.prepare_dialogue(df.select(F.col("prompt").alias("x")))
    with pytest.raises(Exception, match="neither messages"):
        dl.prepare_dialogue(spark.createDataFrame([(None,)], "prompt string")).collect()
    assert df.select(dl.chat_query_prompt("prompt").alias("c")).first().c == rendered([("q", "user")], t, False)


def test_mixed_rows(spark):
    t = dl.template("default")
    schema = f"type string, content string, messages {dl.MESSAGES}, prompt string, completion string"
    df = spark.createDataFrame([("code", "x = 1", None, None, None), ("dialogue", None, [("m", "user")], None, None), ("dialogue", None, None, "p", "c")], schema)
    assert [r.text for r in dl.prepare_mixed(df, t).collect()] == [
        "x = 1<|endoftext|>\n", rendered([("m", "user")], t), rendered([("p", "user"), ("c", "assistant")], t)
    ]
    with pytest.raises(Exception, match="unknown row type"):
        dl.prepare_mixed(spark.createDataFrame([("poem", "x", None, None, None)], schema), t).collect()


def test_transcripts_round_trip(spark):
    text = " ### Human: how?\n### Assistant:  so.\n\n###  Note: skipped ### Human:again###"
    row = spark.createDataFrame([(text,)], "t string").select(dl.dialogue_to_messages("t").alias("m")).first()
    assert [(m.content, m.role) for m in row.m] == [("how?", "user"), ("so.", "assistant"), ("again", "user")]


def test_long_dialogue_in_parts_reads_as_one(spark):
    turns = [(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(23)] + [(2, 0, "user", "only")]
    df = spark.createDataFrame(turns, "conv_id int, turn int, role string, text string")
    parts = dl.collect_messages(df, per_row=5, mark_last=True)
    assert parts.where("conv_id = 1").count() == 5 and parts.agg(F.max(F.size("messages"))).first()[0] == 5
    t = dl.template("default")
    text = parts.withColumn("x", dl.inference_prompt("messages", t, F.col("part") == 0, F.col("last")))
    rows = text.where("conv_id = 1").orderBy("part").collect()
    assert "".join(r.x for r in rows) == rendered([(f"t{i}", r) for _, i, r, _ in turns[:23]], t, False)
    train = dl.prepare_dialogue(parts, t).where("conv_id = 1").orderBy("part").collect()
    assert "".join(r.text for r in train) == rendered([(f"t{i}", r) for _, i, r, _ in turns[:23]], t)


def test_default_tokenizer_is_stable(spark):
    df = spark.createDataFrame([("a b a",)], "c string")
    ids = df.select(default_tokenizer("c").alias("i")).first().i
    assert ids[0] == ids[2] != ids[1] and all(0 <= i < 1 << 28 for i in ids)
