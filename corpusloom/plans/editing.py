"""Editor-side operators: cursor windows, clean-up, overlap spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import editor as ed
from corpusloom.operators import filters as fl
from corpusloom.plans import sql as q
from corpusloom.plans.registry import documents, query, table

# Every document with the cursor at its start, middle, first line end and end.
_CURSORS = """
  SELECT id, text, unnest([0, length(text) // 2, strpos(text || chr(10), chr(10)) - 1, length(text)]) AS "offset"
  FROM (SELECT doc_id AS id, text FROM documents)"""


def _cursors(spark, d):
    n = F.length("content")
    line_end = F.expr("locate('\\n', concat(content, '\\n')) - 1")
    places = F.array(F.lit(0), F.floor(n / 2).cast("int"), line_end, n)
    return documents(spark, d).select("id", F.col("content").alias("text"), F.explode(places).alias("offset"), "source")


_REST = "regexp_replace(substr(text, \"offset\" + 1), '(?s)[\\r\\n].*$', '')"


@query(
    "completion_position_filter",
    f"""SELECT id, CAST("offset" AS INTEGER) AS "offset" FROM ({_CURSORS})
        WHERE regexp_matches({_REST}, '^{q.WS}*[)}}\\]"''`]*{q.WS}*[:{{;,]?{q.WS}*$')""",
)
def _(spark, d):
    return fl.completion_positions(_cursors(spark, d)).select("id", "offset")


_BEFORE = 'substr(text, greatest("offset" - 4000, 0) + 1, least("offset", 4000))'
_AFTER = 'substr(text, "offset" + 1, 4000)'


@query(
    "fim_prompt_window",
    f"""SELECT id, CAST("offset" AS INTEGER) AS "offset", CASE WHEN {q.strip(_AFTER)} <> ''
          THEN '<fim_prefix>' || {_BEFORE} || '<fim_suffix>' || {_AFTER} || '<fim_middle>' ELSE {_BEFORE} END AS inputs
        FROM ({_CURSORS})""",
)
def _(spark, d):
    return _cursors(spark, d).select("id", "offset", ed.fim_prompt_window("text", "offset").alias("inputs"))


# A reply that repeats its prompt and carries stop texts.
_REPLY = "text || '<fim_middle>' || source || '<|endoftext|>'"


@query(
    "clean_completion",
    f"""SELECT doc_id AS id, replace(replace(({_REPLY})[length(text) + 1:], '<fim_middle>', ''), '<|endoftext|>', '') AS answer,
               replace({q.strip("text")}, chr(13), '') AS server_text FROM documents""",
)
def _(spark, d):
    reply = F.concat("content", F.lit("<fim_middle>"), "source", F.lit("<|endoftext|>"))
    docs = documents(spark, d)
    return docs.select("id", ed.clean_completion(reply, "content").alias("answer"), ed.clean_server_text("content").alias("server_text"))


@query(
    "parse_generation_json",
    """SELECT conv_id, turn, CASE WHEN role = 'system' THEN '' ELSE text END AS generated FROM conversations""",
)
def _(spark, d):
    reply = F.struct(F.col("text").alias("generated_text"))
    single, listed = F.to_json(reply), F.to_json(F.array(reply))
    json = F.when(F.col("role") == "user", single).when(F.col("role") == "assistant", listed).otherwise(F.lit('{"error": "busy"}'))
    turns = table(spark, d, "conversations").select("conv_id", "turn", json.alias("reply"))
    return turns.select("conv_id", "turn", ed.parse_generation_json("reply").alias("generated"))


# The first 12 characters at the cursor are suggested again after the 5 typed before it.
_SUGGEST = f"""SELECT *, substr(text, greatest("offset" - 5, 0) + 1, least("offset", 5)) AS prefix,
  substr(text, greatest("offset" - 5, 0) + 1, least("offset", 5) + 12) AS suggestion, substr(text, "offset" + 1, 1) AS nxt FROM ({_CURSORS})"""
_HINT = f"""SELECT id, "offset", substr(suggestion, 1, strpos(suggestion, prefix) - 1) || substr(suggestion, strpos(suggestion, prefix) + length(prefix)) AS rest,
  {_REST} AS line, nxt FROM ({_SUGGEST})"""


@query(
    "trim_known_context",
    f"""SELECT id, CAST("offset" AS INTEGER) AS "offset",
               CASE WHEN ends_with(rest, substr(line, 1, length(rest))) THEN substr(rest, 1, length(rest) - length(substr(line, 1, length(rest))))
                    ELSE rest END AS hint
        FROM ({_HINT}) WHERE nxt IN ('"', '''', '`', ']', ')', '}}', '>') OR {q.strip('nxt')} = ''""",
)
def _(spark, d):
    cursors = _cursors(spark, d)
    begin = F.greatest(F.col("offset") - 5, F.lit(0))
    typed = F.least("offset", F.lit(5))
    rows = cursors.withColumns(
        {"prefix": F.substring("text", begin + 1, typed), "suggestion": F.substring("text", begin + 1, typed + 12)}
    )
    return ed.trim_known_context(rows).select("id", "offset", "hint")


_SPANS = "SELECT l_suppkey, l_partkey AS s, l_partkey + CAST(l_quantity AS BIGINT) AS e FROM lineitem"


def _merged(rows: str, keys: str) -> str:
    return f"""
      SELECT {keys}, min(s) AS start, max(e) AS "end" FROM (
        SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island
        FROM (SELECT *, max(e) OVER (PARTITION BY {keys} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ({rows})))
      GROUP BY {keys}, island"""


@query("merge_spans", _merged(_SPANS, "l_suppkey"))
def _(spark, d):
    spans = table(spark, d, "lineitem").select(
        "l_suppkey", F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_quantity").cast("bigint")).alias("end")
    )
    return ed.merge_spans(spans, ["l_suppkey"])


N = 8
_GRAMS = "SELECT {0} AS id, unnest(range(len(w) - {1} + 1)) AS k, w FROM (SELECT {0}, string_split(text, ' ') AS w FROM {2})"
_HITS = f"""SELECT id, k AS s, k + {N} AS e FROM ({_GRAMS.format('doc_id', N, 'documents')})
  WHERE array_to_string(w[k + 1 : k + {N}], ' ') IN
    (SELECT array_to_string(w[k + 1 : k + {N}], ' ') FROM ({_GRAMS.format('item_id', N, 'benchmark')}))"""


@query(
    "contamination_overlap",
    f"""SELECT id, CAST(begin AS INTEGER) AS start, CAST(begin + length(array_to_string(w[s + 1 : e], ' ')) AS INTEGER) AS "end" FROM (
          SELECT m.id, m.start AS s, m."end" AS e, w, length(array_to_string(w[1:m.start], ' ')) + CASE WHEN m.start > 0 THEN 1 ELSE 0 END AS begin
          FROM ({_merged(_HITS, 'id')}) m JOIN (SELECT doc_id AS id, string_split(text, ' ') AS w FROM documents) t ON m.id = t.id)""",
)
def contamination_overlap(spark, d):
    reference = table(spark, d, "benchmark").selectExpr("text AS content")
    return ed.contamination_overlap(documents(spark, d), reference, N)
