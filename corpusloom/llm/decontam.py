"""Benchmark decontamination by a distributed positional inverted index, in DataFrame operations only.

The index is partitioned by document: a posting is (document, term, position). Postings are stored first for the two
rarest terms of every test window only, and intersected by position less offset in the item. Where the two agree, the
item is aligned with the document, and postings of the neighbouring terms are fetched for those documents alone.
Proximity matches may lack some words, so they are aligned by any two of a window's rarest places that leave room for that.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import ascii_lower, fresh, small_or_shuffled, table, text_of
from corpusloom.llm.registry import query
from corpusloom.session import materialize

#: What stands between words: ASCII other than digits and letters; after A-Z are lower-cased, and before.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN_ANY = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Rules:
    """A window is ``window`` consecutive item words. A proximity match has at least ``near`` of them within ``slop`` words
    of where one of the window's rarest words puts them: one of the ``window - near + 2`` rarest, two of which must be there. A document is contaminated when ``share`` times its hit words reach its words.
    """

    window: int = 13
    slop: int = 2
    near: int = 10
    share: int = 20


def words(text: Column) -> Column:
    """The words of a text, in order."""
    return F.filter(F.split(ascii_lower(text), BETWEEN), lambda w: w != "")


def n_words(text: Column) -> Column:
    parts = F.split(text, BETWEEN_ANY)
    first, last = F.element_at(parts, 1), F.element_at(parts, -1)
    return (F.size(parts) - (first == "").cast("int") - ((F.size(parts) > 1) & (last == "")).cast("int")).cast("long")


def keyed(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, copy, text): rows that share an id are told apart by a hash of their text."""
    return df.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text_of(text)).alias("copy"), text_of(text).alias("text"))


def tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, copy, term, position) of every word.

    Texts are split before they are lower-cased: most words are ASCII, for which the plain function is exact and fast.
    """
    parts = docs.select(
        "doc_id", "copy", F.col("text").rlike(f"^{BETWEEN_ANY}").cast("int").alias("lead"), F.posexplode(F.split("text", BETWEEN_ANY)).alias("at", "raw")
    )
    raw = F.col("raw")
    term = F.when(F.octet_length(raw) == F.char_length(raw), F.lower(raw)).otherwise(ascii_lower(raw))
    return parts.where("raw <> ''").select("doc_id", "copy", term.alias("term"), (F.col("at") - F.col("lead")).alias("position"))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, doc_id, copy, position) of the given terms (column ``term``, without repeats)."""
    return tokens(docs).join(terms, "term")


def items_of(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, item_copy, place, term, length): the words of every item that has any."""
    rows = benchmark.select(F.col(item_id).alias("item_id"), F.xxhash64(text_of(text)).alias("item_copy"), words(text_of(text)).alias("words")).distinct()
    return rows.select("item_id", "item_copy", F.size("words").alias("length"), F.posexplode("words").alias("place", "term"))


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): how often each given term stands in the corpus, 0 included."""
    counts = tokens(docs).select("term").join(terms, "term").groupBy("term").count()
    return terms.join(counts, "term", "left").select("term", F.coalesce("count", F.lit(0)).alias("n"))


def anchors(items: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """(item_id, item_copy, length, place, term, place_2, term_2): of every window the rarest terms, by corpus count, then place.

    The windows of an item that share both give them once; a window of one word has no second. A window with a term
    that the corpus lacks can't match and gives none.
    """
    counted = items.join(counts, "term")
    begins = F.sequence(F.greatest(F.col("place") - window + 1, F.lit(0)), F.greatest(F.least("place", F.col("length") - window), F.lit(0)))
    members = counted.withColumn("begin", F.explode(begins))
    order = Window.partitionBy("item_id", "item_copy", "begin").orderBy("n", "term", "place")
    after = lambda c: F.lead(c).over(order).alias(f"{c}_2")
    ranked = members.select("item_id", "item_copy", "length", "n", "place", "term", after("place"), after("term"), F.row_number().over(order).alias("rank"))
    return ranked.where("rank = 1 AND n > 0").drop("rank", "n").distinct()


_DOC = ["doc_id", "copy"]
_ITEM = ["item_id", "item_copy"]


def _same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, null ids included; the right side's keys are dropped."""
    renamed = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    joined = left.join(renamed, on, how)
    return joined if how == "left_semi" else joined.drop(*(f"_{k}" for k in keys))


def _close(left: DataFrame, right: DataFrame, keys: list[str], here: str, there: str, slop: int) -> DataFrame:
    """Join on equal keys and numbers at most ``slop`` apart, by buckets of the numbers: a frequent key pairs near rows only."""
    bucket = lambda c: F.floor(F.col(c) / (slop + 1))
    spread = right.withColumn("bucket", F.explode(F.array(*[bucket(there) + d for d in (-1, 0, 1)])))
    met = _same(left.withColumn("bucket", bucket(here)), spread, [*keys, "bucket"])
    return met.where(F.abs(F.col(here) - F.col(there)) <= slop).drop("bucket")


def matched_places(docs: DataFrame, items: DataFrame, rules: Rules) -> DataFrame:
    """(doc_id, copy, item_id, item_copy, length, start, place, anchor, exact): item words found around an anchor.

    ``start`` is the document position that the item's first word would have. The word stands within ``rules.slop`` words
    of where the alignment puts it, and if ``exact`` there.
    """
    terms = items.select("term").distinct()
    anchored = materialize(anchors(items, term_counts(docs, terms), rules.window), "anchors")
    # The stored index of rare terms: few postings however large the corpus.
    rare = anchored.select("term").union(anchored.where("term_2 IS NOT NULL").select("term_2")).distinct()
    index = materialize(postings(docs, rare), "rare-postings")
    start = F.col("position") - F.col("place")
    first = index.join(anchored, "term").select(*_DOC, *_ITEM, "length", start.alias("start"), F.col("place").alias("anchor"), "place_2")
    second = index.withColumnsRenamed({"term": "term_2"}).join(anchored.select(*_ITEM, "place_2", "term_2").distinct(), "term_2")
    second = second.select(*_DOC, *_ITEM, "place_2", (F.col("position") - F.col("place_2")).alias("start_2"))
    agreed = _close(first.where("place_2 IS NOT NULL"), second, [*_DOC, *_ITEM, "place_2"], "start", "start_2", rules.slop).drop("start_2")
    aligned = agreed.union(first.where("place_2 IS NULL")).drop("place_2").distinct()
    return found_around(docs, items, materialize(aligned, "alignments"), rules)


def found_around(docs: DataFrame, items: DataFrame, aligned: DataFrame, rules: Rules) -> DataFrame:
    """The words of ``items`` found around the anchors of ``aligned`` (doc_id, copy, item_id, item_copy, length, start, anchor)."""
    terms = items.select("term").distinct()
    hit_docs = materialize(aligned.select(*_DOC).distinct(), "aligned-documents")
    candidates = _same(docs, small_or_shuffled(hit_docs), _DOC, "left_semi")
    more = materialize(postings(candidates, terms), "candidate-postings")
    reach = F.sequence(F.greatest(F.col("anchor") - rules.window + 1, F.lit(0)), F.least(F.col("anchor") + rules.window - 1, F.col("length") - 1))
    wanted = aligned.withColumn("place", F.explode(reach))
    wanted = _same(wanted, items.select(*_ITEM, "place", "term"), [*_ITEM, "place"])
    wanted = wanted.withColumn("due", F.col("start") + F.col("place"))
    met = _close(wanted, more, [*_DOC, "term"], "due", "position", rules.slop)
    return met.groupBy(*_DOC, *_ITEM, "length", "start", "place", "anchor").agg(F.max(F.col("due") == F.col("position")).alias("exact"))


def near_anchors(items: DataFrame, counts: DataFrame, rules: Rules) -> DataFrame:
    """(item_id, item_copy, length, place, term): of every window the rarest places, as far as the corpus has their terms.

    A match may lack ``size - need`` words of a window, so two of any ``size - need + 2`` places are there.
    """
    counted = items.join(counts, "term")
    begins = F.sequence(F.greatest(F.col("place") - rules.window + 1, F.lit(0)), F.greatest(F.least("place", F.col("length") - rules.window), F.lit(0)))
    members = counted.withColumn("begin", F.explode(begins))
    rank = F.row_number().over(Window.partitionBy(*_ITEM, "begin").orderBy("n", "term", "place"))
    size = F.least(F.lit(rules.window), F.col("length"))
    ranked = members.withColumn("rank", rank).where((F.col("rank") <= size - F.least(F.lit(rules.near), size) + 2) & (F.col("n") > 0))
    return ranked.select(*_ITEM, "length", "place", "term").distinct()


def near_places(docs: DataFrame, items: DataFrame, rules: Rules) -> DataFrame:
    """As ``matched_places``, around all anchors that a proximity match may have."""
    anchored = materialize(near_anchors(items, term_counts(docs, items.select("term").distinct()), rules), "near-anchors")
    index = postings(docs, anchored.select("term").distinct())
    hits = index.join(anchored, "term").select(*_DOC, *_ITEM, "length", (F.col("position") - F.col("place")).cast("int").alias("start"), "place")
    around = Window.partitionBy(*_DOC, *_ITEM).orderBy("start").rangeBetween(-rules.slop, rules.slop)
    paired = hits.distinct().select("*", F.min("place").over(around).alias("low"), F.max("place").over(around).alias("high"))
    alone = F.least(F.lit(rules.near), F.col("length")) < 2
    aligned = paired.where((F.col("low") < F.col("high")) | alone).select(*_DOC, *_ITEM, "length", "start", F.col("place").alias("anchor"))
    return found_around(docs, items, materialize(aligned, "near-alignments"), rules)


def phrase_matches(places: DataFrame, window: int) -> DataFrame:
    """(doc_id, copy, item_id, item_copy, first, last): document spans of runs that hold whole windows of an item."""
    line = [*_DOC, *_ITEM, "start"]
    found = places.where("exact").select(*line, "length", "place").distinct()
    run = F.col("place") - F.row_number().over(Window.partitionBy(*line).orderBy("place"))
    runs = found.withColumn("run", run).groupBy(*line, "length", "run").agg(F.min("place").alias("low"), F.max("place").alias("high"))
    whole = runs.where(F.col("high") - F.col("low") + 1 >= F.least(F.lit(window), F.col("length")))
    return whole.select(*_DOC, *_ITEM, (F.col("start") + F.col("low")).alias("first"), (F.col("start") + F.col("high")).alias("last"))


def proximity_matches(places: DataFrame, rules: Rules) -> DataFrame:
    """(doc_id, copy, item_id, item_copy, start, anchor, words): windows around an anchor most of whose words are near."""
    around = places.groupBy(*_DOC, *_ITEM, "length", "start", "anchor").agg(F.collect_set("place").alias("found"))
    begins = F.sequence(F.greatest(F.col("anchor") - rules.window + 1, F.lit(0)), F.greatest(F.least("anchor", F.col("length") - rules.window), F.lit(0)))
    inside = lambda b: F.size(F.filter("found", lambda p: (p >= b) & (p < b + rules.window)))
    best = F.array_max(F.transform(begins, inside))
    need = F.least(F.lit(rules.near), F.col("length"))
    return around.withColumn("words", best).where(F.col("words") >= need).select(*_DOC, *_ITEM, "start", "anchor", "words")


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    rules: Rules = Rules(),
    proximity: bool = True,
) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items (sorted ids as text), n_near, contaminated.

    Null and empty texts have no words and no hits; items without words match nothing; an item with fewer words than a
    window is one window. ``n_near`` counts further items that only match by proximity; it is
    null without ``proximity``, which nothing else depends on. Rows that share an id are judged by their own texts, exact
    repeats alike. An item with a null id counts as a hit but is not listed. An empty table on either side gives
    documents without hits. Other columns are not read.
    """
    rows = keyed(docs, doc_id, text)
    items = items_of(benchmark, item_id, item_text)
    places = materialize(matched_places(rows, items, rules), "places")
    spans = materialize(phrase_matches(places, rules.window), "phrases")
    # Words hit: spans of a document are merged where they touch, so no word is listed.
    ahead = Window.partitionBy(*_DOC).orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("last").over(ahead), F.lit(-1))
    fresh = F.greatest(F.lit(0), F.col("last") - F.greatest(reach, F.col("first") - 1))
    hits = spans.select(*_DOC, "first", "last").distinct().withColumn("fresh", fresh).groupBy(*_DOC).agg(F.sum("fresh").alias("n_hit"))
    listed = spans.groupBy(*_DOC).agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"), F.count_distinct(*_ITEM).alias("n_items"))
    sized = rows.select(*_DOC, n_words(F.col("text")).alias("n_words"))
    joined = _same(_same(sized, hits, _DOC, "left"), listed, _DOC, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    n_near = F.lit(None).cast("long").alias("n_near")
    if proximity:
        near = proximity_matches(near_places(rows, items, rules), rules).select(*_DOC, *_ITEM).distinct()
        near = near.exceptAll(spans.select(*_DOC, *_ITEM).distinct()).groupBy(*_DOC).agg(F.count("*").alias("n_near"))
        joined, n_near = _same(joined, near, _DOC, "left"), zero("n_near")
    told = joined.select("doc_id", "n_words", zero("n_hit"), zero("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), n_near, "copy")
    return told.withColumn("contaminated", (F.col("n_hit") > 0) & (rules.share * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not contaminated."""
    name, copy = fresh(docs, "id", "copy")
    bad = contamination(docs, benchmark, doc_id, text, rules=rules, proximity=False).where("contaminated").select("doc_id", "copy").distinct()
    bad = small_or_shuffled(materialize(bad, "contaminated").toDF(name, copy))
    same = F.col(doc_id).eqNullSafe(F.col(name)) & (F.xxhash64(text_of(text)) == F.col(copy))
    return docs.join(bad, same, "left_anti")


_SPLIT = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

_ORACLE = f"""
WITH d AS (SELECT doc_id, {_SPLIT} AS w FROM documents),
     b AS (SELECT item_id, {_SPLIT} AS w FROM benchmark),
     bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS k, unnest([list_slice(w, i, i + least(13, len(w)) - 1) FOR i IN range(1, greatest(len(w) - 12, 1) + 1)]) AS win
            FROM b WHERE len(w) > 0),
     sizes AS (SELECT DISTINCT k FROM bw),
     dw AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, w FROM d, sizes WHERE len(w) >= k),
     m AS (SELECT DISTINCT doc_id, i, dw.k, item_id FROM dw JOIN bw ON bw.k = dw.k AND bw.win = list_slice(w, i, i + dw.k - 1)),
     hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
     it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
            FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id
"""


@query("op4_decontamination", _ORACLE)
def op4_decontamination(spark, sf_dir):
    return _told(spark, sf_dir, proximity=False).drop("n_near")


@query("op4_decontamination_near")
def op4_decontamination_near(spark, sf_dir):
    """As ``op4_decontamination``, with the number of items that only match by proximity."""
    return _told(spark, sf_dir, proximity=True)


def _told(spark, sf_dir, proximity: bool) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), proximity=proximity)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", "n_near")
