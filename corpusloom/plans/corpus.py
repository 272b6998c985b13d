"""Features, filters, exact duplicates, splits, samples and set operations on the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.text import unit_hash
from corpusloom.operators import features as ft
from corpusloom.operators import filters as fl
from corpusloom.operators import keyed, ordering
from corpusloom.operators import sketches as sk
from corpusloom.plans import sql as q
from corpusloom.plans.registry import documents, query, table
from corpusloom.session import materialize, spread

# Prose lines are longer than code lines.
PROSE = fl.QualityRules(line_mean=500.0)
PROSE_KEYWORDS = ["the ", "und ", "que ", "der "]


def _round(c: str) -> F.Column:
    return F.round(c, 6).alias(c)


# ---------------------------------------------------------------- features

_LENGTHS = f"list_transform({q.lines('text')}, lambda l: length(l))"
_FEATURES = f"""
  SELECT doc_id AS id, source, lang, text AS content,
         {q.content_hash('text')} AS hash,
         list_sum({_LENGTHS})::DOUBLE / len({_LENGTHS}) AS line_mean,
         CAST(list_max({_LENGTHS}) AS BIGINT) AS line_max,
         length(regexp_replace(text, '[^\\pL\\pN]', '', 'g'))::DOUBLE / length(text) AS alpha_frac,
         length(text)::DOUBLE / len({q.token_texts('text')}) AS ratio,
         {q.any_of(q.head('text'), ft.GENERATED_MARKERS)} AS autogenerated,
         {q.any_of(q.head('text'), ft.TEST_MARKERS)}
           OR {q.count_of('lower(text)', 'config')} > floor({q.count_of('text', chr(10))} * 0.05)
           OR {q.count_of('lower(text)', 'test')} > floor({q.count_of('text', chr(10))} * 0.05) AS config_or_test,
         NOT {q.any_of('lower(text)', ft.LUA_KEYWORDS)} AS has_no_keywords,
         {q.count_of('text', '=')} <= 4 AS has_few_assignments
  FROM documents"""


@query("content_hash", f"SELECT doc_id AS id, {q.content_hash('text')} AS hash FROM documents")
def _(spark, d):
    return documents(spark, d).select("id", ft.content_hash("content").alias("hash"))


@query("line_stats", f"SELECT id, round(line_mean, 6) AS line_mean, line_max FROM ({_FEATURES})")
def _(spark, d):
    lengths = documents(spark, d).select("id", ft.lines("content").alias("n"))
    return lengths.select(
        "id", F.round(ft.line_mean(F.col("n")), 6).alias("line_mean"), ft.line_max(F.col("n")).cast("bigint").alias("line_max")
    )


@query("alpha_frac", f"SELECT id, round(alpha_frac, 6) AS alpha_frac FROM ({_FEATURES})")
def _(spark, d):
    return documents(spark, d).select("id", F.round(ft.alpha_frac("content"), 6).alias("alpha_frac"))


@query("char_token_ratio", f"SELECT id, round(ratio, 6) AS ratio FROM ({_FEATURES})")
def _(spark, d):
    return documents(spark, d).select("id", F.round(ft.char_token_ratio("content"), 6).alias("ratio"))


@query("is_autogenerated", f"SELECT id, autogenerated FROM ({_FEATURES})")
def _(spark, d):
    return documents(spark, d).select("id", ft.is_autogenerated("content").alias("autogenerated"))


@query("is_config_or_test", f"SELECT id, config_or_test FROM ({_FEATURES})")
def _(spark, d):
    return documents(spark, d).select("id", ft.is_config_or_test("content").alias("config_or_test"))


@query("has_no_keywords", f"SELECT doc_id AS id, NOT {q.any_of('lower(text)', PROSE_KEYWORDS)} AS has_no_keywords FROM documents")
def _(spark, d):
    return documents(spark, d).select("id", ft.has_no_keywords("content", PROSE_KEYWORDS).alias("has_no_keywords"))


@query("has_few_assignments", f"SELECT id, has_few_assignments FROM ({_FEATURES})")
def _(spark, d):
    return documents(spark, d).select("id", ft.has_few_assignments("content").alias("has_few_assignments"))


@query(
    "doc_features",
    f"""SELECT id, hash, round(line_mean, 6) AS line_mean, line_max, round(alpha_frac, 6) AS alpha_frac,
               round(ratio, 6) AS ratio, autogenerated, config_or_test, has_no_keywords, has_few_assignments
        FROM ({_FEATURES})""",
)
def _(spark, d):
    rows = ft.with_features(documents(spark, d))
    return rows.select(
        "id", "hash", _round("line_mean"), F.col("line_max").cast("bigint").alias("line_max"), _round("alpha_frac"),
        _round("ratio"), "autogenerated", "config_or_test", "has_no_keywords", "has_few_assignments",
    )


@query("add_completion", "SELECT conv_id, turn, text AS response, text AS completion FROM conversations")
def _(spark, d):
    return ft.add_completion(table(spark, d, "conversations").selectExpr("conv_id", "turn", "text AS response"))


# ---------------------------------------------------------------- filters


def _rejects(salted: bool = True) -> list[tuple[str, str]]:
    return [
        ("autogenerated", "autogenerated"),
        ("line_max", f"line_max > {PROSE.line_max}"),
        ("line_mean", f"line_mean > {PROSE.line_mean}"),
        ("alpha_frac", f"alpha_frac < {PROSE.alpha_frac}"),
        ("ratio", f"ratio < {PROSE.min_token_ratio}"),
        ("config_or_test", f"config_or_test AND {q.unit(0, 'id', 'config_or_test')} <= {PROSE.filter_proba}"),
        ("has_no_keywords", f"has_no_keywords AND {q.unit(0, 'id', 'has_no_keywords')} <= {PROSE.filter_proba}"),
    ]


# Prose has no assignments, so the last rule is kept apart from the prose chain.
_REASON = "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in _rejects()) + " WHEN has_few_assignments THEN 'has_few_assignments' END"


def _prose_features(spark, d):
    """Features of the corpus with the assignment rule counting full stops."""
    return ft.with_features(documents(spark, d)).withColumn("has_few_assignments", ft.count_of("content", ".") <= ft.MIN_ASSIGNMENTS)


_PROSE_FEATURES = f"SELECT * REPLACE ({q.count_of('content', '.')} <= 4 AS has_few_assignments) FROM ({_FEATURES})"
_FIRSTS = f"""SELECT *, {_REASON} AS reason, row_number() OVER (PARTITION BY hash ORDER BY id) AS copy
              FROM ({_PROSE_FEATURES})"""
KEPT = f"SELECT * FROM ({_FIRSTS}) WHERE copy = 1 AND reason IS NULL"


@query("quality_filter", f"SELECT id, source, lang, content, hash FROM ({KEPT})")
def quality_filter(spark, d):
    return fl.quality_filter(_prose_features(spark, d), PROSE).select("id", "source", "lang", "content", "hash")


@query(
    "quality_reject_reason",
    f"""SELECT reason, CAST(count(*) AS BIGINT) AS n
        FROM (SELECT CASE WHEN copy > 1 THEN 'duplicate' ELSE coalesce(reason, 'kept') END AS reason FROM ({_FIRSTS}))
        GROUP BY reason""",
)
def _(spark, d):
    return fl.quality_reject_reason(_prose_features(spark, d), PROSE)


@query(
    "corpus_build",
    f"""SELECT lang, CAST(count(*) AS BIGINT) AS docs, CAST(sum(length(content)) AS BIGINT) AS chars
        FROM ({KEPT}) GROUP BY lang""",
)
def corpus_build(spark, d):
    """Features, first copy per hash, quality rules, then what is kept per language."""
    rows = _prose_features(spark, d).withColumn("chars", F.length("content")).drop("content", "source")
    kept = fl.first_good_rows(rows, PROSE)
    return kept.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("chars").alias("chars"))


@query("probabilistic_drop", f"SELECT doc_id AS id, {q.unit(0, 'doc_id', 'config_or_test')} <= 0.7 AS dropped FROM documents")
def _(spark, d):
    return documents(spark, d).select("id", fl.randomly_drops(0.7, 0, "id", "config_or_test").alias("dropped"))


def file_events(spark, d):
    """The event table as editor events: half of the values stand for Lua files."""
    kind = F.when(F.col("event_type").isin("click", "view", "purchase"), "save").otherwise("autocomplete")
    name = F.concat(F.lit("src/f"), F.get_json_object("props", "$.k"), F.when(F.col("value") > 5, ".lua").otherwise(".py"))
    return spread(table(spark, d, "events"), "event_id").select(
        "event_id", "ts", kind.alias("type"), name.alias("filename"), F.col("user_id").cast("string").alias("host"),
        F.col("event_type").alias("inputs"),
    )


FILE_EVENTS = """
  SELECT event_id, ts, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'save' ELSE 'autocomplete' END AS type,
         'src/f' || (props->>'$.k') || CASE WHEN value > 5 THEN '.lua' ELSE '.py' END AS filename,
         CAST(user_id AS VARCHAR) AS host, event_type AS inputs
  FROM events"""


@query("file_type_filter", f"SELECT * FROM ({FILE_EVENTS}) WHERE type = 'save' AND ends_with(filename, '.lua')")
def _(spark, d):
    return fl.file_events(file_events(spark, d))


# ---------------------------------------------------------------- exact duplicates

_HASHED = f"SELECT doc_id AS id, source, text AS content, {q.content_hash('text')} AS hash FROM documents"


def _hashed(spark, d):
    return documents(spark, d).withColumn("hash", ft.content_hash("content"))


@query("duplicate_fraction", f"SELECT round(1 - count(DISTINCT hash)::DOUBLE / count(*), 6) AS duplicate_fraction FROM ({_HASHED})")
def _(spark, d):
    return keyed.duplicate_fraction(_hashed(spark, d)).select(_round("duplicate_fraction"))


@query(
    "exact_dedup",
    f"""SELECT id, hash, content FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY id) AS r FROM ({_HASHED}))
        WHERE r = 1""",
)
def _(spark, d):
    return keyed.exact_dedup(_hashed(spark, d)).select("id", "hash", "content")


@query("hash_universe", f"SELECT DISTINCT hash FROM ({_HASHED})")
def _(spark, d):
    return keyed.hash_universe(_hashed(spark, d))


@query("duplicate_sketches", f"""
    SELECT source, count(*) AS rows, count(DISTINCT hash) AS distinct_hashes, true AS within_error FROM ({_HASHED}) GROUP BY source
    UNION ALL SELECT NULL, count(*), count(DISTINCT hash), true FROM ({_HASHED})""")
def _(spark, d):
    """A stored sketch per source, merged over all; estimates stand next to exact counts, four standard errors from them at most."""
    hashed = materialize(_hashed(spark, d).select("source", "hash"), "hashes")
    stored = materialize(sk.key_sketches(hashed, "source"), "sketches")
    every = stored.unionByName(sk.merged(stored).withColumn("source", F.lit(None).cast("string")))
    counted = hashed.rollup("source").agg(F.count_distinct("hash").alias("distinct_hashes"), F.grouping("source").alias("total"))
    met = sk.estimated_duplicates(every).join(
        counted.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")) & (F.col("source").isNull() == (F.col("total") == 1))
    )
    near = F.abs(F.col("distinct") - F.col("distinct_hashes")) <= 4 * sk.standard_error() * F.col("distinct_hashes") + 1
    return met.select("source", "rows", "distinct_hashes", near.alias("within_error"))


@query("drop_duplicate_rows", "SELECT DISTINCT lang, text FROM documents")
def _(spark, d):
    return keyed.drop_duplicate_rows(table(spark, d, "documents").select("lang", "text"))


_COPIES = f"SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY hash ORDER BY id) AS r FROM ({_HASHED})) WHERE r > 1"


def _exact_copies(spark, d):
    """Ids of all but the first text of every hash."""
    hashed = _hashed(spark, d).select("id", "hash")
    return hashed.select("id").exceptAll(keyed.exact_dedup(hashed).select("id"))


@query("remove_duplicates_by_index", f"SELECT doc_id AS id, text AS content FROM documents WHERE doc_id NOT IN ({_COPIES})")
def _(spark, d):
    return keyed.without_ids(documents(spark, d), _exact_copies(spark, d)).select("id", "content")


@query("removed_ids", _COPIES)
def _(spark, d):
    return _exact_copies(spark, d)


@query("lookup_content", f"SELECT doc_id AS base_index, text AS content FROM documents WHERE doc_id IN ({_COPIES})")
def _(spark, d):
    from corpusloom.operators.neardup import lookup_content

    return lookup_content(_exact_copies(spark, d).withColumnRenamed("id", "base_index"), documents(spark, d))


@query(
    "first_per_key",
    """SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events)
       WHERE r = 1""",
)
def _(spark, d):
    return keyed.first_per_key(table(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "ts")


@query(
    "latest_per_key",
    """SELECT event_type, user_id, event_id, value FROM
         (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
       WHERE r = 1""",
)
def _(spark, d):
    latest = keyed.latest_per_key(table(spark, d, "events"), ["event_type", "user_id"], ["ts", "event_id"])
    return latest.select("event_type", "user_id", "event_id", "value")


@query(
    "top_result",
    """SELECT l_orderkey, l_linenumber, l_extendedprice FROM
         (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS r FROM lineitem)
       WHERE r <= 1""",
)
def _(spark, d):
    top = keyed.top_per_group(
        table(spark, d, "lineitem"), ["l_orderkey"], [F.col("l_extendedprice").desc(), "l_linenumber"], 1
    )
    return top.select("l_orderkey", "l_linenumber", "l_extendedprice")


# ---------------------------------------------------------------- order, splits, samples


@query(
    "shuffle",
    f"""SELECT doc_id AS id, CAST(row_number() OVER (ORDER BY {q.unit(0, 'doc_id', 'shuffle')}, doc_id) - 1 AS BIGINT) AS position
        FROM documents""",
)
def _(spark, d):
    drawn = documents(spark, d).select("id", unit_hash(0, "id", "shuffle").alias("u"))
    return ordering.row_positions(drawn, "u", ("id",)).select("id", F.col("position").cast("bigint").alias("position"))


@query(
    "buffer_shuffle",
    f"""SELECT o_orderkey AS id, o_totalprice, CAST(row_number() OVER (ORDER BY {q.unit(1, 'o_orderkey', 'shuffle')}, o_orderkey) - 1 AS BIGINT) AS place
        FROM orders""",
)
def _(spark, d):
    """The shuffled rows with the place at which each one comes."""
    rows = ordering.shuffled(table(spark, d, "orders").selectExpr("o_orderkey AS id", "o_totalprice"), seed=1)
    return ordering.numbered_ranges(rows.withColumn("at", F.monotonically_increasing_id()), ["at"], "place").drop("at")


def _exact_split(frac: float, table_name: str, key: str) -> str:
    rank = f"row_number() OVER (ORDER BY {q.unit(0, key, 'split')}, {key})"
    return f"""SELECT {key} AS id, CASE WHEN {rank} <= ceil((SELECT count(*) FROM {table_name}) * {frac}) THEN 'test' ELSE 'train' END AS split
               FROM {table_name}"""


@query("train_test_split", _exact_split(0.05, "documents", "doc_id"))
def _(spark, d):
    return ordering.train_test_split(documents(spark, d).select("id"), 0.05)


@query(
    "split_80_10_10",
    f"""SELECT doc_id AS id, CASE WHEN {q.unit(0, 'doc_id', 'split')} < 0.1 THEN 'test'
               WHEN {q.unit(0, 'doc_id', 'split')} < 0.2 THEN 'valid' ELSE 'train' END AS split FROM documents""",
)
def _(spark, d):
    return ordering.three_way_split(documents(spark, d).select("id"))


@query(
    "eval_sample_overlap",
    f"""SELECT id, 'train' AS split FROM ({_exact_split(0.05, 'documents', 'doc_id')})
        UNION ALL SELECT id, split FROM ({_exact_split(0.05, 'documents', 'doc_id')}) WHERE split = 'test'""",
)
def _(spark, d):
    return ordering.overlapping_split(documents(spark, d).select("id"), 0.05)


@query(
    "take_skip_split",
    """SELECT o_orderkey AS id, CASE WHEN row_number() OVER (ORDER BY o_orderkey) <= 4000 THEN 'valid' ELSE 'train' END AS split
       FROM orders""",
)
def _(spark, d):
    return ordering.take_skip_split(table(spark, d, "orders").selectExpr("o_orderkey AS id"))


@query("max_samples", "SELECT o_orderkey AS id, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 1000")
def _(spark, d):
    return ordering.first_n(table(spark, d, "orders").selectExpr("o_orderkey AS id", "o_totalprice"), "id", 1000)


@query(
    "replicate_prompts",
    f"""SELECT item_id AS task_id, '<|endoftext|>' || {q.strip('text')} AS prompt, CAST(c AS INTEGER) AS copy
        FROM benchmark, generate_series(0, 9) AS g(c)""",
)
def _(spark, d):
    return ordering.replicate_prompts(table(spark, d, "benchmark").selectExpr("item_id AS task_id", "text AS prompt"), 10)


@query("sample_rows", f"SELECT doc_id AS id, text AS content FROM documents ORDER BY {q.unit(0, 'doc_id', 'inspect')}, doc_id LIMIT 3")
def _(spark, d):
    return ordering.sample_rows(documents(spark, d).select("id", "content"))


@query(
    "split_counts",
    f"SELECT split, CAST(count(*) AS BIGINT) AS n FROM ({_exact_split(0.1, 'documents', 'doc_id')}) GROUP BY split",
)
def _(spark, d):
    return ordering.split_counts(ordering.train_test_split(documents(spark, d).select("id"), 0.1))


@query(
    "batch_of_1000",
    """SELECT batch, CAST(count(*) AS BIGINT) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM
         (SELECT o_orderkey, CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 1000) AS BIGINT) AS batch FROM orders)
       GROUP BY batch""",
)
def _(spark, d):
    numbered = ordering.batches(table(spark, d, "orders").select("o_orderkey"), "o_orderkey")
    return numbered.groupBy("batch").agg(
        F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key")
    )


# ---------------------------------------------------------------- sets


@query("corpus_union", "SELECT text AS content FROM documents UNION ALL SELECT text FROM conversations")
def _(spark, d):
    from corpusloom.sources.readers import corpus_union

    return corpus_union(documents(spark, d), table(spark, d, "conversations").selectExpr("text AS content"))


_TURNS = f"""
  SELECT a.conv_id, a.turn, list_distinct({q.dedup_words('a.text')}) AS mine, list_distinct({q.dedup_words('b.text')}) AS theirs
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"""


def _neighbour_turns(spark, d):
    from corpusloom.operators.neardup import dedup_tokens

    turns = table(spark, d, "conversations").select("conv_id", "turn", dedup_tokens("text").alias("mine"))
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("mine").alias("theirs"))
    return turns.join(following, ["conv_id", "turn"])


@query("token_intersection", f"SELECT conv_id, turn, array_to_string(list_sort(list_intersect(mine, theirs)), ' ') AS shared FROM ({_TURNS})")
def _(spark, d):
    shared = F.array_join(F.array_sort(F.array_intersect("mine", "theirs")), " ")
    return _neighbour_turns(spark, d).select("conv_id", "turn", shared.alias("shared"))


@query(
    "token_union",
    f"SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_concat(mine, theirs))), ' ') AS either FROM ({_TURNS})",
)
def _(spark, d):
    either = F.array_join(F.array_sort(F.array_union("mine", "theirs")), " ")
    return _neighbour_turns(spark, d).select("conv_id", "turn", either.alias("either"))
