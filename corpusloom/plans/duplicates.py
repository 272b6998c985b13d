"""Near-duplicate queries. Their SQL repeats the chain: signatures by wide products, recursive components, a recursive walk."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import neardup as nd
from corpusloom.operators import setjoin
from corpusloom.operators.lshindex import LshIndex
from corpusloom.operators.ordering import train_test_split
from corpusloom.plans import sql as q
from corpusloom.plans.corpus import KEPT, quality_filter
from corpusloom.plans.registry import documents, query
from corpusloom.session import fresh_path, materialize
from corpusloom.sources.writers import sink_dataset


def corpus(spark, d):
    return documents(spark, d).select("id", "content", F.col("source").alias("repo_name"), F.col("lang").alias("path"))


_WORDS = f"SELECT doc_id AS id, {q.dedup_words('text')} AS words FROM documents"


@query(
    "dedup_tokens",
    f"""SELECT id, CAST(len(words) AS INTEGER) AS n_words, array_to_string(list_sort(list_distinct(words)), ' ') AS tokens FROM ({_WORDS})""",
)
def _(spark, d):
    rows = corpus(spark, d).select("id", nd.dedup_words("content").alias("words"))
    tokens = F.array_join(F.array_sort(F.array_distinct("words")), " ")
    return rows.select("id", F.size("words").alias("n_words"), tokens.alias("tokens"))


@query(
    "jaccard",
    f"""SELECT a.id, round(len(list_intersect(list_distinct(a.words), list_distinct(b.words)))::DOUBLE
                 / nullif(len(list_distinct(list_concat(a.words, b.words))), 0), 6) AS similarity
        FROM ({_WORDS}) a JOIN ({_WORDS}) b ON b.id = a.id + 1""",
)
def _(spark, d):
    """Each document with the next one."""
    sets = corpus(spark, d).select("id", nd.dedup_tokens("content").alias("mine"))
    following = sets.select((F.col("id") - 1).alias("id"), F.col("mine").alias("theirs"))
    return sets.join(following, "id").select("id", F.round(nd.jaccard(F.col("mine"), F.col("theirs")), 6).alias("similarity"))


BANDS, ROWS = nd.choose_bands(nd.THRESHOLD)
_MOD = 1 << 64


_HALF = 1 << 32


def _halves(x: int) -> tuple[int, int]:
    return x >> 32, x % _HALF


def _permuted(n: int) -> str:
    """The permutations of the signature, as the operator draws them: high and low halves of factor and shift."""
    odd, shift = (v.tolist() for v in nd._permutations(n, 1))
    halves = [(p, *_halves(a), *_halves(b)) for p, (a, b) in enumerate(zip(odd, shift))]
    return f"(SELECT p, a1::UBIGINT AS a1, a0::UBIGINT AS a0, b1::UBIGINT AS b1, b0::UBIGINT AS b0 FROM (VALUES {', '.join(map(str, halves))}) AS v(p, a1, a0, b1, b0))"


def _long(docs: str = "documents") -> str:
    return f"SELECT id, list_distinct(words) AS words FROM (SELECT doc_id AS id, {q.dedup_words('text')} AS words FROM {docs}) WHERE len(words) >= {nd.MIN_TOKENS}"


_HASHED = f"SELECT id, unnest(list_transform(words, lambda w: ('0x' || substr(md5(w), 1, 15))::UBIGINT)) AS h FROM ({{0}})"


def _signed(n: int, texts: str = _long()) -> str:
    """(id, p, s): the smallest high half of a * h + b modulo 2^64, per permutation; products of halves fit 64 bits."""
    low = f"((a0 * h0) % {_HALF} + b0) // {_HALF}"
    high = f"(((a0 * h0) // {_HALF}) + ((a0 * h1) % {_HALF}) + ((a1 * h0) % {_HALF}) + b1 + {low}) % {_HALF}"
    words = f"SELECT id, h // {_HALF} AS h1, h % {_HALF} AS h0 FROM ({_HASHED.format(texts)})"
    return f"SELECT id, p, min({high})::BIGINT AS s FROM ({words}), {_permuted(n)} GROUP BY id, p"


def _bucketed(texts: str = _long()) -> str:
    """(id, band, bucket): the signature's rows of a band, folded with odd factors modulo 2^64, as a signed number."""
    mix = [(r, *_halves(m)) for r, m in enumerate(nd._permutations(ROWS, 2)[0].tolist())]
    one = "(s + 1)::UBIGINT"
    total = f"(sum(({one} * m0)::HUGEINT) + sum((({one} * m1) % {_HALF})::HUGEINT) * {_HALF}) % {_MOD}::HUGEINT"
    factors = f"(SELECT r, m1::UBIGINT AS m1, m0::UBIGINT AS m0 FROM (VALUES {', '.join(map(str, mix))}) AS v(r, m1, m0))"
    return f"""SELECT id, band, (CASE WHEN f >= {1 << 63}::HUGEINT THEN f - {_MOD}::HUGEINT ELSE f END)::BIGINT AS bucket FROM (
                 SELECT id, CAST(p // {ROWS} AS INTEGER) AS band, {total} AS f
                 FROM ({_signed(BANDS * ROWS, texts)}) JOIN {factors} ON r = p % {ROWS}
                 GROUP BY id, p // {ROWS})"""


def _linked(buckets: str) -> str:
    """Members to the head of their part of a bucket, heads to the first of the bucket."""
    return f"""SELECT DISTINCT src, dst FROM (
                 SELECT id AS src, head AS dst FROM (SELECT *, min(id) OVER (PARTITION BY band, bucket, id % {nd.SALTS}) AS head FROM ({buckets})) WHERE id <> head
                 UNION ALL
                 SELECT id, first FROM (SELECT id, min(id) OVER (PARTITION BY band, bucket) AS first FROM (
                   SELECT *, min(id) OVER (PARTITION BY band, bucket, id % {nd.SALTS}) AS head FROM ({buckets})) WHERE id = head) WHERE id <> first)"""


def _clustered(docs: str = "documents") -> str:
    """Texts with the same words are one representative; similar ones are walked in id order, each joining the first
    extreme it resembles."""
    return f"""
  WITH RECURSIVE texts AS MATERIALIZED (SELECT id, words, md5(array_to_string(list_sort(words), ' ')) AS set_key FROM ({_long(docs)})),
  firsts AS MATERIALIZED (SELECT set_key, min(id) AS rep, count(*) AS n_same FROM texts GROUP BY set_key),
  reps AS MATERIALIZED (SELECT id, words FROM texts JOIN firsts ON rep = id),
  buckets AS MATERIALIZED ({_bucketed('SELECT * FROM reps')}),
  links AS MATERIALIZED ({_linked('SELECT * FROM buckets')}),
  ends AS (SELECT src, dst FROM links UNION SELECT dst, src FROM links),
  reach AS (SELECT src AS id, dst AS other FROM ends UNION SELECT reach.id, ends.dst FROM reach JOIN ends ON ends.src = reach.other),
  members AS MATERIALIZED (
    SELECT id, least(id, min(other)) AS cluster, row_number() OVER (PARTITION BY least(id, min(other)) ORDER BY id) AS r FROM reach GROUP BY id),
  alike AS MATERIALIZED (
    SELECT b.id, list(a.id) AS olds FROM members a JOIN members b ON a.cluster = b.cluster AND a.id < b.id
      JOIN reps x ON x.id = a.id JOIN reps y ON y.id = b.id
    WHERE len(list_intersect(x.words, y.words))::DOUBLE / (len(x.words) + len(y.words) - len(list_intersect(x.words, y.words))) >= {nd.THRESHOLD}
    GROUP BY b.id),
  walk AS (
    SELECT cluster, r, id, id AS extreme, [id] AS extremes FROM members WHERE r = 1
    UNION ALL
    SELECT cluster, r, id, coalesce(hit, id), CASE WHEN hit IS NULL THEN list_append(extremes, id) ELSE extremes END FROM (
      SELECT m.cluster, m.r, m.id, w.extremes, list_filter(w.extremes, lambda e: list_contains(coalesce(l.olds, []), e))[1] AS hit
      FROM walk w JOIN members m ON m.cluster = w.cluster AND m.r = w.r + 1 LEFT JOIN alike l ON l.id = m.id)),
  verdicts AS MATERIALIZED (
    SELECT cluster, id, extreme FROM walk
    UNION ALL SELECT rep, rep, rep FROM firsts WHERE n_same > 1 AND rep NOT IN (SELECT id FROM members)),
  named AS MATERIALIZED (SELECT v.*, f.set_key, f.n_same FROM verdicts v JOIN firsts f ON f.rep = v.id),
  copies AS (SELECT extreme AS base_index, CAST(sum(n_same) AS INTEGER) AS copies FROM named GROUP BY extreme),
  clusters AS MATERIALIZED (
    SELECT n.cluster AS cluster_id, t.id AS base_index, d.source AS repo_name, d.lang AS path, t.id = n.extreme AS is_extreme, c.copies
    FROM texts t JOIN named n ON n.set_key = t.set_key JOIN {docs} d ON d.doc_id = t.id LEFT JOIN copies c ON c.base_index = t.id)
"""


_CLUSTERS = _clustered()


@query("minhash_signature", f"""
    SELECT doc_id AS id, CAST(len(sig) AS INTEGER) AS n, md5(array_to_string(sig, ' ')) AS digest
    FROM documents LEFT JOIN (SELECT id, list(s ORDER BY p) AS sig FROM ({_signed(nd.NUM_PERM)}) GROUP BY id) ON id = doc_id""")
def _(spark, d):
    rows = nd.minhash_signature(corpus(spark, d))
    return rows.select("id", F.size("signature").alias("n"), F.md5(F.array_join("signature", " ")).alias("digest"))


@query("lsh_buckets", _bucketed())
def _(spark, d):
    return nd.lsh_buckets(nd.dedup_table(corpus(spark, d)))


@query("minhash_candidates", f"WITH buckets AS MATERIALIZED ({_bucketed()}) {_linked('SELECT * FROM buckets')}")
def _(spark, d):
    return nd.bucket_links(nd.lsh_buckets(nd.dedup_table(corpus(spark, d))))


@query("duplicate_clusters", f"{_CLUSTERS} SELECT * FROM clusters")
def duplicate_clusters(spark, d):
    return nd.duplicate_clusters(corpus(spark, d))


@query("cluster_extremes", f"{_CLUSTERS} SELECT cluster_id, base_index, copies FROM clusters WHERE is_extreme")
def _(spark, d):
    clusters = nd.duplicate_clusters(corpus(spark, d))
    return clusters.where("is_extreme").select("cluster_id", "base_index", "copies")


@query("near_dedup", f"""{_CLUSTERS} SELECT doc_id AS id, text AS content, source AS repo_name, lang AS path FROM documents
    WHERE doc_id NOT IN (SELECT base_index FROM clusters WHERE NOT is_extreme)""")
def near_dedup(spark, d):
    kept, _ = nd.near_dedup(corpus(spark, d))
    return kept


@query("dedup_stats", f"""{_CLUSTERS}
    SELECT original, clusters, files_in_clusters, unique_files, original - files_in_clusters + unique_files AS filtered FROM (
      SELECT (SELECT count(*) FROM documents) AS original, count(DISTINCT cluster_id) AS clusters, count(*) AS files_in_clusters,
             count(*) FILTER (WHERE is_extreme) AS unique_files FROM clusters)""")
def _(spark, d):
    docs = corpus(spark, d)
    return nd.dedup_stats(docs, materialize(nd.duplicate_clusters(docs), "clusters"))


_KEPT_DOCS = f"(SELECT id AS doc_id, content AS text, source, lang FROM ({KEPT}))"


@query("corpus_path", f"""{_clustered(_KEPT_DOCS)}
    SELECT CASE WHEN {q.unit(0, 'doc_id', 'split')} < 0.05 THEN 'test' ELSE 'train' END AS split, lang,
           CAST(count(*) AS BIGINT) AS docs, CAST(sum(length(text)) AS BIGINT) AS chars
    FROM {_KEPT_DOCS} WHERE doc_id NOT IN (SELECT base_index FROM clusters WHERE NOT is_extreme) GROUP BY 1, 2""")
def corpus_path(spark, d):
    """The whole way: quality rules, near-duplicates, train/test split, saved by split; rows per split and language."""
    kept = materialize(quality_filter(spark, d).select("id", "source", "lang", "content"), "kept")
    distinct, _ = nd.near_dedup(kept.withColumnsRenamed({"source": "repo_name", "lang": "path"}))
    rows = distinct.select("id", "content", F.col("path").alias("lang"))
    path = fresh_path(spark, "corpus")
    sink_dataset(train_test_split(rows, 0.05, exact=False), path)
    return spark.read.parquet(path).groupBy("split", "lang").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.length("content")).alias("chars"))


# ---------------------------------------------------------------- a stored index and the exact join


def _indexed(spark, d, path: str) -> LshIndex:
    """The corpus in two batches, as if the second had come later."""
    index, docs = LshIndex(spark, path), corpus(spark, d)
    index.insert(docs.where("id % 2 = 0"))
    index.insert(docs.where("id % 2 = 1"))
    return index


@query("lsh_index_clusters", f"{_CLUSTERS} SELECT * FROM clusters")
def _(spark, d):
    """Two batches, one after the other, give the clusters of their union."""
    return _indexed(spark, d, fresh_path(spark, "lsh-index")).clusters(corpus(spark, d))


@query("lsh_index_query", f"""
    WITH texts AS MATERIALIZED (SELECT id, words, md5(array_to_string(list_sort(words), ' ')) AS set_key FROM ({_long()})),
    buckets AS MATERIALIZED ({_bucketed('SELECT id, words FROM texts')}),
    stored AS (SELECT set_key, min(id) AS node FROM texts WHERE id % 2 = 0 GROUP BY set_key),
    heads AS (SELECT band, bucket, min(id) AS node FROM buckets WHERE id IN (SELECT node FROM stored) GROUP BY band, bucket)
    SELECT b.id, h.node FROM buckets b JOIN heads h USING (band, bucket) WHERE b.id % 2 = 1
    UNION SELECT t.id, s.node FROM texts t JOIN stored s USING (set_key) WHERE t.id % 2 = 1""")
def _(spark, d):
    """What the texts of a second batch would be linked with in an index of the first."""
    index, docs = LshIndex(spark, fresh_path(spark, "lsh-index")), corpus(spark, d)
    index.insert(docs.where("id % 2 = 0"))
    return index.query(docs.where("id % 2 = 1"))


_SIMILAR = f"""
  WITH texts AS MATERIALIZED (SELECT id, words, array_to_string(list_sort(words), ' ') AS set_key FROM ({_long()})),
  reps AS MATERIALIZED (SELECT id, words FROM texts JOIN (SELECT min(id) AS id FROM texts GROUP BY set_key) USING (id)),
  entries AS (SELECT id, len(words) AS n, unnest(words) AS w FROM reps),
  shared AS (
    SELECT x.id AS a, y.id AS b, x.n AS na, y.n AS nb, count(*) AS n
    FROM entries x JOIN entries y ON x.w = y.w AND x.id < y.id AND least(x.n, y.n) >= {nd.THRESHOLD} * greatest(x.n, y.n) - 1e-9
    GROUP BY ALL),
  pairs AS MATERIALIZED (SELECT a, b, n::DOUBLE / (na + nb - n) AS similarity FROM shared WHERE n::DOUBLE / (na + nb - n) >= {nd.THRESHOLD})
"""


def _word_sets(spark, d):
    """One row per word set of the texts long enough: its first id."""
    sets = materialize(nd.dedup_table(corpus(spark, d)), "words")
    firsts = sets.groupBy("set_key").agg(F.min("id").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("times"))
    # Most ids stand for themselves; only the others are listed, so the words stay where they are.
    other = sets.select("id").distinct().join(firsts, "id", "left").select("id", F.coalesce("times", F.lit(0)).cast("int").alias("times")).where("times <> 1")
    listed = sets.where("id IS NOT NULL").join(materialize(other, "word-copies"), "id", "left")
    return listed.select("id", "words", "set_key", F.explode(F.array_repeat(F.lit(1), F.coalesce("times", F.lit(1)))).alias("_")).drop("_")


@query("set_similarity_join", f"{_SIMILAR} SELECT a, b, round(similarity, 6) AS similarity FROM pairs")
def _(spark, d):
    pairs = setjoin.similar_sets(_word_sets(spark, d), nd.THRESHOLD)
    return pairs.select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("band_recall", f"""{_SIMILAR}, buckets AS MATERIALIZED ({_bucketed('SELECT * FROM reps')}),
  met AS (SELECT DISTINCT a, b FROM pairs JOIN buckets x ON x.id = a JOIN buckets y ON y.id = b AND x.band = y.band AND x.bucket = y.bucket)
  SELECT count(*) AS pairs, (SELECT count(*) FROM met) AS found, round((SELECT count(*) FROM met)::DOUBLE / nullif(count(*), 0), 6) AS recall FROM pairs""")
def _(spark, d):
    """How many of the truly similar sets the bands find."""
    sets = _word_sets(spark, d)
    measured = setjoin.band_recall(sets, nd.lsh_buckets(sets), nd.THRESHOLD)
    return measured.select("pairs", "found", F.round("recall", 6).alias("recall"))
