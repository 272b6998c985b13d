"""Dialogues, tokens, packing and fill-in-the-middle."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.text import unit_hash
from corpusloom.functions.tokens import default_tokenizer, token_count
from corpusloom.operators import dialogue as dl
from corpusloom.operators import packing as pk
from corpusloom.operators.codetext import create_content
from corpusloom.operators.ordering import batches
from corpusloom.plans import sql as q
from corpusloom.plans.registry import documents, query, table

SEPARATOR = 0
BLOCK = 256


def _ids(c: str = "input_ids") -> F.Column:
    return F.array_join(c, " ").alias("input_ids")


# ---------------------------------------------------------------- dialogues


def _dialogues(spark, d):
    return dl.collect_messages(table(spark, d, "conversations"))


def _turns(user: str, assistant: str, end: str, source: str = "conversations") -> str:
    return f"""string_agg(CASE WHEN role = 'user' THEN {user} ELSE {assistant} END || text || {end}, '' ORDER BY turn)"""


def _header(t: dl.Template) -> str:
    return f"'{t.system_token}' || chr(10) || '{t.system}{t.end_token}' || chr(10)"


def _body(t: dl.Template) -> str:
    return _turns(f"'{t.user_token}' || chr(10)", f"'{t.assistant_token}' || chr(10)", f"'{t.end_token}' || chr(10)")


_DEFAULT, _ALPACA, _NO_SYSTEM = (dl.TEMPLATES[n] for n in ("default", "alpaca", "no_system"))


# Dialogues come in parts of at most 1000 turns; the first one has the header, the last one is left open.
_PARTS = f"(SELECT *, turn // {dl.TURNS_PER_ROW} AS part, max(turn // {dl.TURNS_PER_ROW}) OVER (PARTITION BY conv_id) AS final FROM conversations)"


def _rendered(t: dl.Template) -> str:
    return f"CASE WHEN part = 0 THEN {_header(t)} ELSE '' END || {_body(t)}"


@query("render_training_prompt", f"SELECT conv_id, part, {_rendered(_DEFAULT)} AS text FROM {_PARTS} GROUP BY conv_id, part")
def _(spark, d):
    first = F.col("part") == 0
    return _dialogues(spark, d).select("conv_id", "part", dl.training_prompt("messages", _DEFAULT, first).alias("text"))


@query(
    "render_inference_prompt",
    f"""SELECT conv_id, part, {_rendered(_ALPACA)} || CASE WHEN part = final THEN '{_ALPACA.assistant_token}' ELSE '' END AS text
        FROM {_PARTS} GROUP BY conv_id, part, final""",
)
def _(spark, d):
    parts = dl.collect_messages(table(spark, d, "conversations"), mark_last=True)
    text = dl.inference_prompt("messages", _ALPACA, F.col("part") == 0, F.col("last"))
    return parts.select("conv_id", "part", text.alias("text"))


_READABLE = _turns("chr(10) || chr(10) || 'Human: '", "chr(10) || chr(10) || 'Assistant: '", "''")


@query("render_readable", f"SELECT conv_id, part, {_READABLE} AS text FROM {_PARTS} GROUP BY conv_id, part")
def _(spark, d):
    return _dialogues(spark, d).select("conv_id", "part", dl.readable("messages").alias("text"))


def _pairs(spark, d):
    """Each user turn with the turn after it."""
    turns = table(spark, d, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"))
    answers = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("completion"))
    return asked.join(answers, ["conv_id", "turn"], "left")


_PAIRS = """
  SELECT a.conv_id, a.turn, a.text AS prompt, b.text AS completion
  FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND b.role = 'assistant'
  WHERE a.role = 'user'"""


@query(
    "prepare_dialogue",
    f"""SELECT conv_id, turn, {_header(_DEFAULT)} || '<|user|>' || chr(10) || prompt || '<|end|>' || chr(10)
          || coalesce('<|assistant|>' || chr(10) || completion || '<|end|>' || chr(10), '') AS text FROM ({_PAIRS})""",
)
def _(spark, d):
    return dl.prepare_dialogue(_pairs(spark, d)).select("conv_id", "turn", "text")


@query(
    "prepare_mixed",
    f"""SELECT 'code' AS type, doc_id AS id, NULL AS part, text || '<|endoftext|>' || chr(10) AS text FROM documents
        UNION ALL
        SELECT 'dialogue', conv_id, part, {_rendered(_NO_SYSTEM)} FROM {_PARTS} GROUP BY conv_id, part""",
)
def _(spark, d):
    code = documents(spark, d).select(F.lit("code").alias("type"), "id", "content")
    spoken = _dialogues(spark, d).select(F.lit("dialogue").alias("type"), F.col("conv_id").alias("id"), "part", "messages")
    mixed = code.unionByName(spoken, allowMissingColumns=True)
    return dl.prepare_mixed(mixed, _NO_SYSTEM).select("type", "id", "part", "text")


@query(
    "chat_query_prompt",
    """SELECT item_id, '<|system|>' || chr(10) || '<|end|>' || chr(10) || '<|user|>' || chr(10) || text
         || '<|end|>' || chr(10) || '<|assistant|>' AS prompt FROM benchmark""",
)
def _(spark, d):
    return table(spark, d, "benchmark").select("item_id", dl.chat_query_prompt("text").alias("prompt"))


# A transcript is cut at every ``###``, also at those that its texts hold.
_TRANSCRIPT = "string_agg(CASE WHEN role = 'user' THEN '### Human: ' ELSE '### Assistant: ' END || text, ' ' ORDER BY turn)"
_SEGMENTS = f"list_filter(string_split_regex({q.strip('whole')}, '###{q.WS}*'), lambda s: starts_with(s, 'Human:') OR starts_with(s, 'Assistant:'))"
_PARSED = f"""CASE WHEN starts_with(s, 'Human:') THEN 'user=' || {q.strip('substr(s, 7)')} ELSE 'assistant=' || {q.strip('substr(s, 11)')} END"""


@query(
    "dialogue_to_messages",
    f"""SELECT conv_id, part, array_to_string(list_transform({_SEGMENTS}, lambda s: {_PARSED}), '|') AS messages
        FROM (SELECT conv_id, part, {_TRANSCRIPT} AS whole FROM {_PARTS} GROUP BY conv_id, part)""",
)
def _(spark, d):
    mark = F.when(F.col("role") == "user", "### Human: ").otherwise("### Assistant: ")
    turns = table(spark, d, "conversations").withColumn("text", F.concat(mark, "text"))
    transcripts = dl.collect_messages(turns).select(
        "conv_id", "part", F.array_join(F.transform("messages", lambda m: m["content"]), " ").alias("text")
    )
    parsed = transcripts.select("conv_id", "part", dl.dialogue_to_messages("text").alias("messages"))
    shown = F.transform("messages", lambda m: F.concat(m["role"], F.lit("="), m["content"]))
    return parsed.select("conv_id", "part", F.array_join(shown, "|").alias("messages"))


@query(
    "create_content",
    f"""SELECT conv_id, turn, '-- ' || prompt || chr(10) || coalesce(completion, '-- 还没学会怎么写这个代码呢TAT') AS content
        FROM ({_PAIRS})""",
)
def _(spark, d):
    fenced = F.coalesce(F.concat(F.lit("Answer:\n```lua\n"), "completion", F.lit("\n```\n")), F.lit("No code."))
    pairs = _pairs(spark, d).withColumn("response", fenced)
    return pairs.select("conv_id", "turn", create_content("prompt", "response").alias("content"))


# ---------------------------------------------------------------- tokens

_TOKENS = f"SELECT doc_id AS id, length(text) AS n_chars, {q.tokens('text')} AS ids FROM documents"


def _tokens(spark, d):
    return documents(spark, d).select(
        "id", F.length("content").alias("n_chars"), token_count("content").alias("n_tokens"), default_tokenizer("content").alias("input_ids")
    )


@query("pretokenize", f"SELECT id, {q.joined('ids')} AS input_ids, round(n_chars::DOUBLE / len(ids), 6) AS ratio_char_token FROM ({_TOKENS})")
def pretokenize(spark, d):
    rows = pk.pretokenize(documents(spark, d).drop("source", "lang"))
    return rows.select("id", _ids(), F.round("ratio_char_token", 6).alias("ratio_char_token"))


@query("chars_per_token", f"""
    SELECT round(sum(length(text))::DOUBLE / sum(len({q.token_texts('text')})), 6) AS chars_per_token
    FROM documents""")
def _(spark, d):
    return pk.chars_per_token(documents(spark, d)).select(F.round("chars_per_token", 6).alias("chars_per_token"))


@query(
    "running_token_offset",
    f"""SELECT id, shard, CAST(coalesce(sum(n) OVER (PARTITION BY shard ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
        FROM (SELECT doc_id AS id, doc_id // 1000 AS shard, len({q.token_texts('text')}) AS n FROM documents)""",
)
def _(spark, d):
    counted = documents(spark, d).select("id", pk.shard_of().alias("shard"), token_count("content").alias("n"))
    return pk.running_token_offset(counted, "shard", "id", "n").select("id", "shard", "start")


# Documents in id order fill buffers of a fixed number of characters. Keys only give the order: the same
# documents under ids a thousand apart make the same blocks.
_BUFFERED = f"""
  WITH docs AS (
    SELECT id, ids, CAST(floor(coalesce(sum(n_chars) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                               / {BLOCK * 64 * 3.6}) AS BIGINT) AS buffer FROM ({_TOKENS})
  ), joined AS (
    SELECT buffer, flatten(list(list_append(ids, {SEPARATOR}) ORDER BY id)) AS ids FROM docs GROUP BY buffer
  )
  SELECT gap, buffer, block, {q.joined(f'ids[block * {BLOCK} + 1 : (block + 1) * {BLOCK}]')} AS input_ids
  FROM joined, LATERAL (SELECT unnest(generate_series(0, len(ids) // {BLOCK} - 1)) AS block), (VALUES (1), (1000)) AS gaps(gap)"""


@query("pack_constant_length", _BUFFERED)
def pack_constant_length(spark, d):
    def packed(gap: int):
        rows = _tokens(spark, d).withColumn("id", F.col("id") * gap)
        blocks = pk.pack_constant_length(rows, SEPARATOR, BLOCK, num_of_sequences=64, n_tokens="n_tokens")
        return blocks.select(F.lit(gap).alias("gap"), "buffer", "block", _ids())

    return packed(1).union(packed(1000))


@query(
    "pack_group_texts",
    f"""WITH flat AS (
          SELECT batch, unnest(ids) AS token, generate_subscripts(ids, 1) AS k, id
          FROM (SELECT *, CAST(floor((row_number() OVER (ORDER BY id) - 1) / 1000) AS BIGINT) AS batch FROM ({_TOKENS}))
        ), placed AS (
          SELECT *, row_number() OVER (PARTITION BY batch ORDER BY id, k) - 1 AS p, count(*) OVER (PARTITION BY batch) AS total FROM flat
        )
        SELECT batch, p // {BLOCK} AS block, string_agg(token, ' ' ORDER BY p) AS input_ids
        FROM placed WHERE p // {BLOCK} < greatest(total // {BLOCK}, 1) GROUP BY batch, p // {BLOCK}""",
)
def _(spark, d):
    return pk.pack_group_texts(_tokens(spark, d), BLOCK, n_tokens="n_tokens").select("batch", "block", _ids())


@query(
    "chunk_overflow",
    f"""SELECT id, chunk, {q.joined(f'ids[chunk * {BLOCK} + 1 : (chunk + 1) * {BLOCK}]')} AS input_ids
        FROM ({_TOKENS}), LATERAL (SELECT unnest(generate_series(0, len(ids) // {BLOCK} - 1)) AS chunk)""",
)
def _(spark, d):
    return pk.chunk_overflow(_tokens(spark, d), BLOCK).select("id", F.col("chunk").cast("bigint").alias("chunk"), _ids())


@query("truncate_tokens", f"SELECT id, {q.joined('ids[1:1024]')} AS input_ids FROM ({_TOKENS})")
def _(spark, d):
    return _tokens(spark, d).select("id", pk.truncate_tokens("input_ids", 1024).alias("t")).select("id", _ids("t"))


_ITEM_TOKENS = f"SELECT item_id AS id, CAST(floor((row_number() OVER (ORDER BY item_id) - 1) / 8) AS BIGINT) AS batch, {q.tokens('text')} AS ids FROM benchmark"


@query(
    "pad_batch",
    f"""SELECT id, batch, CAST(len(ids) AS INTEGER) AS input_len,
               {q.joined('list_concat(ids, list_transform(range(longest - len(ids)), lambda x: 0))')} AS input_ids,
               {q.joined('list_concat(list_transform(ids, lambda x: 1), list_transform(range(longest - len(ids)), lambda x: 0))')} AS attention_mask
        FROM (SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS longest FROM ({_ITEM_TOKENS}))""",
)
def _(spark, d):
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), default_tokenizer("text").alias("input_ids"))
    padded = pk.pad_batch(batches(items, "id", 8))
    return padded.select("id", "batch", "input_len", _ids(), F.array_join("attention_mask", " ").alias("attention_mask"))


# Role tokens of the masked dialogues: ids outside the tokenizer's range.
USER, ASSISTANT = 1 << 29, (1 << 29) + 1


@query(
    "mask_user_labels",
    f"""SELECT conv_id, part, string_agg(CASE WHEN role = 'user' THEN {q.joined('list_transform(ids, lambda x: -100)')}
                                        ELSE {q.joined('ids')} END, ' ' ORDER BY turn) AS labels
        FROM (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS role,
                     part, list_prepend(CASE WHEN role = 'user' THEN {USER} ELSE {ASSISTANT} END, {q.tokens('text')}) AS ids FROM {_PARTS})
        GROUP BY conv_id, part""",
)
def _(spark, d):
    role = F.when(F.col("role") == "user", USER).otherwise(ASSISTANT)
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.array(role), default_tokenizer("text")).alias("ids"))
    # Every part of a dialogue starts at a role token, so parts are masked by themselves.
    part = F.floor(F.col("turn") / dl.TURNS_PER_ROW).alias("part")
    listed = turns.groupBy("conv_id", part).agg(F.array_sort(F.collect_list(F.struct("turn", "ids"))).alias("t"))
    flat = listed.select("conv_id", "part", F.flatten(F.transform("t", lambda x: x["ids"])).alias("ids"))
    return flat.select("conv_id", "part", F.array_join(pk.mask_user_labels("ids", USER, ASSISTANT), " ").alias("labels"))


PRE, MID, SUF = 268435457, 268435458, 268435459


def _fim_sql() -> str:
    n = "len(ids)"
    a, b = (f"CAST(floor({q.unit(0, 'id', s)} * ({n} + 1)) AS BIGINT)" for s in ("fim-a", "fim-b"))
    return f"""
      WITH cut AS (SELECT id, ids, least({a}, {b}) AS lo, greatest({a}, {b}) AS hi FROM ({_TOKENS})),
      part AS (SELECT id, ids, ids[1:lo] AS p, ids[lo + 1:hi] AS m, ids[hi + 1:] AS s FROM cut)
      SELECT id, {q.joined(f'''CASE
          WHEN {q.unit(0, 'id', 'fim')} >= 0.5 THEN ids
          WHEN {q.unit(0, 'id', 'fim-spm')} < 0.5 THEN [{PRE}, {SUF}] || s || [{MID}] || p || m
          ELSE [{PRE}] || p || [{SUF}] || s || [{MID}] || m END''')} AS input_ids
      FROM part"""


@query("fim_permute", _fim_sql())
def fim_permute(spark, d):
    return pk.fim_permute(_tokens(spark, d), PRE, MID, SUF).select("id", _ids())


_FIM_PACKED = f"""
  WITH rows AS (SELECT id, string_split(input_ids, ' ') AS ids FROM ({_fim_sql()})),
  docs AS (
    SELECT id, ids, CAST(floor(coalesce(sum(len(ids)) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / {BLOCK * 64}.0) AS BIGINT) AS buffer
    FROM rows
  ), joined AS (SELECT buffer, flatten(list(list_append(ids, '{SEPARATOR}') ORDER BY id)) AS ids FROM docs GROUP BY buffer)
  SELECT buffer, block, {q.joined(f'ids[block * {BLOCK} + 1 : (block + 1) * {BLOCK}]')} AS input_ids
  FROM joined, LATERAL (SELECT unnest(generate_series(0, len(ids) // {BLOCK} - 1)) AS block)"""


@query("fim_packed_blocks", _FIM_PACKED)
def fim_packed_blocks(spark, d):
    """Code training blocks: tokens, fill-in-the-middle, separator, blocks."""
    rows = pk.fim_permute(_tokens(spark, d), PRE, MID, SUF)
    blocks = pk.pack_constant_length(rows, SEPARATOR, BLOCK, num_of_sequences=64, tokenized=True)
    return blocks.select("buffer", "block", _ids())


_CHAT_ROWS = f"""
  SELECT conv_id, part, flatten(list(ids ORDER BY turn)) AS ids, flatten(list(labels ORDER BY turn)) AS labels FROM (
    SELECT conv_id, part, turn, ids, CASE WHEN role = 'user' THEN list_transform(ids, lambda x: -100) ELSE ids END AS labels FROM (
      SELECT conv_id, part, turn, role, list_prepend(CASE WHEN role = 'user' THEN {USER} ELSE {ASSISTANT} END, {q.tokens('text')}) AS ids FROM {_PARTS}))
  GROUP BY conv_id, part"""
_CHAT_BLOCKS = f"""
  WITH placed AS (
    SELECT *, CAST(floor(coalesce(sum(len(ids)) OVER (ORDER BY conv_id, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / {BLOCK * 64}.0) AS BIGINT) AS buffer
    FROM ({_CHAT_ROWS})
  ), joined AS (
    SELECT buffer, flatten(list(ids ORDER BY conv_id, part)) AS ids, flatten(list(labels ORDER BY conv_id, part)) AS labels FROM placed GROUP BY buffer
  )
  SELECT buffer, block, {q.joined(f'ids[block * {BLOCK} + 1 : (block + 1) * {BLOCK}]')} AS input_ids,
         {q.joined(f'labels[block * {BLOCK} + 1 : (block + 1) * {BLOCK}]')} AS labels
  FROM joined, LATERAL (SELECT unnest(generate_series(0, len(ids) // {BLOCK} - 1)) AS block)"""


@query("chat_training_blocks", _CHAT_BLOCKS)
def chat_training_blocks(spark, d):
    """Chat training blocks: dialogues, tokens, label masks, blocks. Masks come before blocks, so a block that begins
    inside a user turn is masked as far as that turn goes."""
    role = F.when(F.col("role") == "user", USER).otherwise(ASSISTANT)
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.array(role), default_tokenizer("text")).alias("ids"))
    part = F.floor(F.col("turn") / dl.TURNS_PER_ROW).alias("part")
    listed = turns.groupBy("conv_id", part).agg(F.array_sort(F.collect_list(F.struct("turn", "ids"))).alias("t"))
    flat = listed.select("conv_id", "part", F.flatten(F.transform("t", lambda x: x["ids"])).alias("ids"))
    masked = flat.withColumn("labels", pk.mask_user_labels("ids", USER, ASSISTANT))
    # Parts of a dialogue follow each other; a dialogue has far fewer than a million.
    rows = masked.select((F.col("conv_id") * 1_000_000 + F.col("part")).alias("id"), F.arrays_zip("ids", "labels").alias("input_ids"))
    blocks = pk.pack_constant_length(rows, None, BLOCK, num_of_sequences=64, tokenized=True)
    return blocks.select("buffer", "block", _ids("input_ids.ids"), F.array_join("input_ids.labels", " ").alias("labels"))


@query(
    "label_encode",
    "SELECT doc_id AS id, lang, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS BIGINT) AS label_id FROM documents",
)
def _(spark, d):
    return pk.label_encode(documents(spark, d), "lang").select("id", "lang", "label_id")


# ---------------------------------------------------------------- stream of the same columns


@query("stream_dialogue_prompts", f"SELECT conv_id, part, {_rendered(_DEFAULT)} AS text FROM {_PARTS} GROUP BY conv_id, part")
def _(spark, d):
    from corpusloom.session import fresh_path
    from corpusloom.streaming.feed import stream_dialogue_prompts

    landing, out, state = (fresh_path(spark, n) for n in ("dialogues", "prompts", "prompts-state"))
    stored = _dialogues(spark, d)
    stored.write.json(landing)
    stream = stream_dialogue_prompts(spark.readStream.schema(stored.schema).json(landing), _DEFAULT)
    run = stream.select("conv_id", "part", "text").writeStream.format("parquet").option("path", out)
    run.option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("conv_id bigint, part int, text string").parquet(out)
