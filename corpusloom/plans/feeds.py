"""Sources, sinks, extraction jobs and the collected-files table."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import tables
from corpusloom.operators import bpe, collect, keyed, luafunctions
from corpusloom.operators.ordering import numbered_ranges
from corpusloom.plans import sql as q
from corpusloom.plans.corpus import FILE_EVENTS, file_events
from corpusloom.plans.registry import documents, query, table
from corpusloom.session import fresh_path
from corpusloom.sources import readers, writers
from corpusloom.streaming import feed

# ---------------------------------------------------------------- sources and sinks


def _text_tree(spark, d) -> str:
    """The corpus as text files in one folder per language."""
    root = fresh_path(spark, "tree")
    docs = documents(spark, d).select("lang", F.col("content").alias("value"))
    docs.write.option("maxRecordsPerFile", 5000).partitionBy("lang").text(root)
    # Files of other kinds, which a scan by suffix must leave out.
    docs.write.mode("append").partitionBy("lang").json(root)
    docs.select("value", "lang").write.mode("append").option("compression", "gzip").partitionBy("lang").text(root)
    return root


def _lang(path: str) -> F.Column:
    return F.regexp_extract(path, "lang=([^/]+)/", 1).alias("lang")


@query("scan_files_by_ext", "SELECT lang, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes FROM documents GROUP BY lang")
def _(spark, d):
    files = readers.scan_files_by_ext(spark, _text_tree(spark, d), ".txt")
    return files.groupBy(_lang("path")).agg(F.sum("length").alias("bytes"))


@query("scan_whole_files", "SELECT lang, CAST(sum(length(text) + 1) AS BIGINT) AS chars FROM documents GROUP BY lang")
def _(spark, d):
    files = readers.scan_whole_files(spark, [_text_tree(spark, d)], ".txt")
    return files.groupBy(_lang("filepath")).agg(F.sum(F.length("content")).alias("chars"))


@query("scan_parquet_glob", "SELECT text FROM documents")
def _(spark, d):
    return readers.scan_parquet_glob(spark, f"{d}/document*.parquet", ["text"])


def _csv(spark, d):
    path = fresh_path(spark, "csv")
    writers.sink_csv(documents(spark, d), path)
    return readers.scan_csv(spark, path, "id bigint, content string, source string, lang string")


@query("scan_csv", "SELECT doc_id AS id, text AS content, source, lang FROM documents")
def _(spark, d):
    return _csv(spark, d)


@query("sink_csv", "SELECT lang, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY lang")
def _(spark, d):
    return _csv(spark, d).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("chars"))


@query(
    "sink_dataset",
    f"""SELECT doc_id AS id, text AS content, CASE WHEN {q.unit(0, 'doc_id', 'split')} < 0.05 THEN 'test' ELSE 'train' END AS split
        FROM documents""",
)
def _(spark, d):
    from corpusloom.operators.ordering import train_test_split

    path = fresh_path(spark, "dataset")
    writers.sink_dataset(train_test_split(documents(spark, d).select("id", "content"), 0.05, exact=False), path)
    return spark.read.parquet(path)


@query("sink_sharded_gzip_json", "SELECT doc_id AS id, text AS content, true AS within FROM documents")
def _(spark, d):
    path = fresh_path(spark, "shards")
    writers.sink_sharded_gzip_json(documents(spark, d).select("id", "content"), path, 300)
    rows = spark.read.schema("id bigint, content string").json(path).withColumn("file", F.col("_metadata.file_path"))
    sizes = rows.groupBy("file").agg((F.count(F.lit(1)) <= 300).alias("within"))
    return rows.join(sizes, "file").drop("file")


@query(
    "sink_text_render",
    f"""SELECT 'doc ' || doc_id || ' ' || {q.content_hash('text')} AS value, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS place FROM documents""",
)
def _(spark, d):
    from corpusloom.operators.features import content_hash

    path = fresh_path(spark, "rendered")
    line = F.concat(F.lit("doc "), F.col("id").cast("string"), F.lit(" "), content_hash("content"))
    writers.sink_text_render(documents(spark, d), path, line, ["id"])
    # The place of each line: by file, and inside a file as it is read.
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("at"))
    return numbered_ranges(lines, ["file", "at"], "place").drop("file", "at")


# ---------------------------------------------------------------- collected files

_SAVED = f"SELECT event_id, ts, filename, host AS \"user\", inputs AS content FROM ({FILE_EVENTS}) WHERE type = 'save' AND ends_with(filename, '.lua')"
_LATEST = f"""
  SELECT filename, "user", content, ts AS date_modified FROM (
    SELECT *, row_number() OVER (PARTITION BY filename, "user" ORDER BY ts DESC, event_id DESC) AS r FROM (
      SELECT *, lag(content) OVER (PARTITION BY filename, "user" ORDER BY ts, event_id) AS before FROM ({_SAVED}))
    WHERE before IS NULL OR before <> content)
  WHERE r = 1"""
_FIRST = f"""
  SELECT filename, "user", content, ts AS date_modified FROM (
    SELECT *, row_number() OVER (PARTITION BY filename, "user" ORDER BY ts, event_id) AS r FROM ({_SAVED})) WHERE r = 1"""


def _saved(spark, d):
    from corpusloom.operators.filters import file_events as only_saved

    return only_saved(file_events(spark, d)).select("event_id", "ts", "filename", F.col("host").alias("user"), F.col("inputs").alias("content"))


@query("collect_upsert_batch", _LATEST)
def _(spark, d):
    return collect.upsert_batch(_saved(spark, d), order=["ts", "event_id"])


@query("collect_first_batch", _FIRST)
def _(spark, d):
    return collect.collect_first_batch(_saved(spark, d), order=["ts", "event_id"])


_EVENT = feed.EVENT.replace("ts timestamp", "ts timestamp_ntz")
TRIGGERS = 3


def _collected(spark, d, collector, target):
    """The save events arrive as JSON files in ``TRIGGERS`` instalments by time; the stream runs after each."""
    landing, state = fresh_path(spark, "landing"), fresh_path(spark, "files-state")
    events = file_events(spark, d).withColumn("parameters", F.create_map(F.lit("event_id"), F.col("event_id").cast("string"))).drop("event_id")
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    step = (last - first) / TRIGGERS
    for k in range(TRIGGERS):
        after = F.col("ts") >= F.lit(first + k * step)
        before = F.col("ts") < F.lit(first + (k + 1) * step) if k + 1 < TRIGGERS else F.lit(True)
        part = events.where(after & before).withColumn("instalment", F.lit(k))
        part.write.mode("append").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").partitionBy("instalment").json(landing)
        stream = feed.event_stream(spark, f"{landing}/*", _EVENT)
        collector(stream, target, state).trigger(availableNow=True).start().awaitTermination()
        if k == 1:
            target.compact()
    return target.read()


@query("collect_upsert_stream", _LATEST)
def _(spark, d):
    return _collected(spark, d, feed.collect_upsert_stream, feed.FilesTable(spark, fresh_path(spark, "files")))


@query("collect_first_stream", _FIRST)
def _(spark, d):
    return _collected(spark, d, feed.collect_first_stream, feed.FilesTable(spark, fresh_path(spark, "files"), first=True))


@query("collect_arrivals_stream", f"SELECT DISTINCT filename, \"user\" FROM ({_SAVED})")
def _(spark, d):
    """The files seen, each once: repeats are dropped by the stream's state, whose watermark lies a month behind."""
    target = feed.FilesTable(spark, fresh_path(spark, "files"), first=True)
    arrived = _collected(spark, d, lambda *a: feed.collect_arrivals_stream(*a, "30 days"), target)
    return arrived.select("filename", "user")


@query("read_table", f"SELECT filename, \"user\", content FROM ({_LATEST}) WHERE content = 'click'")
def _(spark, d):
    latest = collect.upsert_batch(_saved(spark, d), order=["ts", "event_id"])
    return collect.read_table(latest, "SELECT filename, user, content FROM files WHERE content = ?", ["click"])


@query(
    "insert_if_no_match",
    """SELECT event_type, user_id, min(event_id) AS event_id, bool_and(event_type <> 'view') AS inserted
       FROM events GROUP BY event_type, user_id""",
)
def _(spark, d):
    """The table holds the first view of every user; all events come in."""
    rows = table(spark, d, "events").select("event_type", "user_id", "event_id")
    held = keyed.first_per_key(rows.where("event_type = 'view'"), ["user_id"], ["event_id"])
    return keyed.insert_if_absent(held, rows, ["event_type", "user_id"], ["event_id"])


# ---------------------------------------------------------------- extraction jobs


def _lua_files(spark, d):
    """Documents as Lua files: every line is a function, registered when it has a comma."""
    lines = F.filter(F.split("content", "\n"), lambda l: F.trim(l) != "")

    def function(line: F.Column, i: F.Column) -> F.Column:
        name = F.concat(F.lit("f"), i.cast("string"))
        register = F.when(line.contains(","), F.concat(F.lit("GameEvent.add("), name, F.lit(")"))).otherwise("return")
        body = F.regexp_replace(line, r"[^A-Za-z ]", " ")
        return F.concat(F.lit("-- "), body, F.lit("\nlocal function "), name, F.lit("(x)\n  if x then y() end\nend\n"), register, F.lit("\n"))

    code = F.array_join(F.transform(lines, function), "")
    return documents(spark, d).select(F.col("id").alias("path"), code.alias("content"))


_LUA_LINES = """
  SELECT path, i - 1 AS i, l[i] AS line FROM (
    SELECT path, l, unnest(range(1, len(l) + 1)) AS i FROM (
      SELECT doc_id AS path, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents))"""


@query(
    "extract_functions",
    f"""SELECT path, 'f' || i AS name, 'local function f' || i || '(x)' || chr(10) || '  if x then y() end' || chr(10) || 'end' AS body,
               'GameEvent.add(f' || i || ')' AS register FROM ({_LUA_LINES}) WHERE contains(line, ',')""",
)
def _(spark, d):
    return luafunctions.extract_functions(_lua_files(spark, d)).select("path", "name", "body", "register")


@query(
    "lua_functions",
    f"""SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY i) - 1 AS INTEGER) AS ord, 'f' || i AS name, 'GameEvent.add(f' || i || ')' AS register
        FROM ({_LUA_LINES}) WHERE contains(line, ',')""",
)
def _(spark, d):
    """The same extraction as a table function in SQL."""
    tables.register(spark)
    files = _lua_files(spark, d)
    return spark.sql("SELECT path, f.ord, f.name, f.register FROM {files}, LATERAL lua_functions(content) f", files=files)


@query("find_comment_spans", f"SELECT path, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(line) + 3) AS BIGINT) AS chars FROM ({_LUA_LINES}) GROUP BY path")
def _(spark, d):
    spans = luafunctions.find_comment_spans(_lua_files(spark, d))
    return spans.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).alias("chars"))


@query(
    "find_all_samples",
    f"""SELECT path, CAST(count(*) AS INTEGER) AS n, string_agg('f' || i, ' ' ORDER BY i) AS names
        FROM ({_LUA_LINES}) WHERE contains(line, ',') GROUP BY path""",
)
def _(spark, d):
    found = luafunctions.find_all_samples(_lua_files(spark, d))
    return found.select("path", F.size("functions").alias("n"), F.array_join(F.transform("functions", lambda f: f["name"]), " ").alias("names"))


# ---------------------------------------------------------------- byte pairs

MERGES = 48
# The white space of the pre-tokenizer. The engine that runs the SQL has no look-ahead: a mark in front of the last blank before
# other characters parts what that would leave over.
_BLANK = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_MARKED = rf"regexp_replace(text, '([{_BLANK}])([^{_BLANK}])', chr(57344) || '\1\2', 'g')"
_SPLIT = rf"regexp_extract_all({_MARKED}, '''s|''t|''re|''ve|''m|''ll|''d| ?\pL+| ?\pN+| ?[^{_BLANK}\pL\pN\x{{e000}}]+|[{_BLANK}]+')"
_AS_BYTES = "array_to_string(list_transform(range(1, 2 * strlen(token), 2), lambda i: chr(('0x' || substr(hex(encode(token)), i, 2))::INTEGER)), '')"

#: One merge after another, over all distinct pre-tokens: a symbol per merge, counted from U+10000.
_LEARNT = f"""
  WITH RECURSIVE tokens AS MATERIALIZED (SELECT doc_id AS id, {_SPLIT} AS tokens FROM documents),
  words AS MATERIALIZED (
    SELECT token, {_AS_BYTES} AS word, n FROM (SELECT token, count(*) AS n FROM (SELECT unnest(tokens) AS token FROM tokens) GROUP BY token)),
  steps AS (
    SELECT 0 AS k, token, word, n, NULL::VARCHAR AS pair, NULL::BIGINT AS held FROM words
    UNION ALL
    SELECT s.k + 1, s.token, replace(s.word, t.pair, chr(65536 + s.k)), s.n, t.pair, t.held
    FROM steps s, (
      SELECT pair, CAST(sum(n) AS BIGINT) AS held FROM (SELECT substr(word, i, 2) AS pair, n FROM (SELECT word, n, unnest(range(1, length(word))) AS i FROM steps))
      GROUP BY pair ORDER BY held DESC, pair LIMIT 1) t
    WHERE s.k < {MERGES}),
  merges AS MATERIALIZED (SELECT DISTINCT k, pair, held FROM steps WHERE k > 0)
"""


def _spelled(c: str) -> str:
    return f"CASE WHEN unicode({c}) >= 65536 THEN known[unicode({c}) - 65535] ELSE lpad(lower(hex(unicode({c}))), 2, '0') END"


@query("bpe_train", f"""{_LEARNT},
  spelling AS (
    SELECT 0 AS k, []::VARCHAR[] AS known, '' AS l, '' AS r, 0::BIGINT AS n
    UNION ALL
    SELECT m.k, list_append(known, {_spelled('pair[1]')} || {_spelled('pair[2]')}), {_spelled('pair[1]')}, {_spelled('pair[2]')}, m.held
    FROM spelling s JOIN merges m ON m.k = s.k + 1)
  SELECT k - 1 AS rank, l AS "left", r AS "right", n FROM spelling WHERE k > 0""")
def bpe_train(spark, d):
    return bpe.bpe_merges(documents(spark, d), vocab_size=256 + MERGES)


@query("bpe_encode", f"""{_LEARNT},
  encoded AS MATERIALIZED (
    SELECT token, list_transform(string_split(word, ''), lambda c: CASE WHEN unicode(c) < 256 THEN unicode(c) ELSE unicode(c) - 65536 + 256 END) AS ids
    FROM steps WHERE k = {MERGES}),
  placed AS (SELECT id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS place FROM tokens),
  joined AS (SELECT id, flatten(list(ids ORDER BY place)) AS ids FROM placed JOIN encoded USING (token) GROUP BY id)
  SELECT doc_id AS id, coalesce({q.joined('ids')}, '') AS input_ids, round(length(text)::DOUBLE / nullif(len(ids), 0), 6) AS ratio_char_token
  FROM documents LEFT JOIN joined ON id = doc_id""")
def _(spark, d):
    """Learns on the corpus, then encodes it with what was learnt."""
    docs = documents(spark, d)
    vocabulary = bpe.Vocabulary(bpe.bpe_train(docs, vocab_size=256 + MERGES))
    rows = bpe.bpe_encode(docs, vocabulary)
    ratio = F.try_divide(F.col("n_chars").cast("double"), F.size("input_ids").cast("double"))
    return rows.select("id", F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("input_ids"), F.round(ratio, 6).alias("ratio_char_token"))
