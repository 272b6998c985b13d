"""Vector codes: product quantisation in whole numbers, with equal-average search for the nearest entry."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import small_or_shuffled, table
from corpusloom.llm.registry import query
from corpusloom.llm.vectors import floors, matrix, summed, usable
from corpusloom.session import materialize


@dataclass(frozen=True)
class Rules:
    """``parts`` equal parts of a vector, each with a codebook of ``entries`` that is moved ``rounds`` times."""

    parts: int = 16
    entries: int = 64
    rounds: int = 2
    scale: int = 256


def nearest(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the entry of ``book`` nearest to each point; of equally near ones the first.

    Equal-average search: entries are sorted by the sum of their components. The squared gap of two sums over the
    dimension is at most the squared distance, so a point's search goes outward from its own sum, to both sides, and a
    side closes once that quotient strictly exceeds the best distance: an entry at just that distance may come first.
    """
    n, width = points.shape
    order = np.argsort(book.sum(axis=1), kind="stable")
    entries, sums = book[order], book.sum(axis=1)[order]
    total = points.sum(axis=1)
    start = np.searchsorted(sums, total)
    best, found = np.full(n, (1 << 62) // width), np.full(n, len(book))
    sides = [(np.arange(n), start, 1), (np.arange(n), start - 1, -1)]
    while sides:
        still = []
        for rows, at, step in sides:
            inside = (at >= 0) & (at < len(sums))
            rows, at = rows[inside], at[inside]
            gap = sums[at] - total[rows]
            near = gap * gap <= best[rows] * width
            rows, at = rows[near], at[near]
            if not len(rows):
                continue
            away = points[rows] - entries[at]
            distance = (away * away).sum(axis=1)
            better = (distance < best[rows]) | ((distance == best[rows]) & (order[at] < found[rows]))
            best[rows[better]], found[rows[better]] = distance[better], order[at[better]]
            still.append((rows, at + step, step))
        sides = still
    return found, best


def _limit(width: int, parts: int) -> int:
    """Components are held within this, so that squares of sums and sums of squares fit a long."""
    return min((1 << 30) // width, 1 << (30 - (width * parts - 1).bit_length() // 2 - 1))


def _first_books(rows: DataFrame, rules: Rules, width: int) -> np.ndarray:
    """parts x entries x width: the parts of the vectors with the smallest ids; of equal ids the smaller vector first."""
    first = rows.select("id", "x").orderBy(F.col("id").asc_nulls_last(), "x").limit(rules.entries).collect()
    vectors = np.array([r.x for r in first], dtype=np.int64)
    return np.ascontiguousarray(_cut(vectors, rules, width).transpose(1, 0, 2))


def _cut(vectors: np.ndarray, rules: Rules, width: int) -> np.ndarray:
    """rows x parts x width; zeros fill up what is missing in the last parts."""
    fill = np.zeros((len(vectors), rules.parts * width - vectors.shape[1]), dtype=np.int64)
    return np.hstack([vectors, fill]).reshape(len(vectors), rules.parts, width)


def _moved(rows: DataFrame, length: int, books: np.ndarray, rules: Rules) -> np.ndarray:
    """Every entry replaced by the floor of the mean of the parts nearest to it; entries without parts stay."""
    n_parts, n_entries, width = books.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((n_parts, n_entries, width + 1), dtype=np.int64)
        for batch in batches:
            cut = _cut(matrix(batch.column("x"), length), rules, width)
            for p in range(n_parts):
                index, _ = nearest(cut[:, p], books[p])
                np.add.at(sums[p], index, np.hstack([cut[:, p], np.ones((len(cut), 1), dtype=np.int64)]))
        slots = np.flatnonzero(sums.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(sums.ravel()[slots])], names=["slot", "value"])

    found = summed(rows.select("x").mapInArrow(add, "slot long, value long"))
    sums = np.zeros(n_parts * n_entries * (width + 1), dtype=np.int64)
    sums[list(found)] = list(found.values())
    sums = sums.reshape(n_parts, n_entries, width + 1)
    count = sums[:, :, width:]
    return np.where(count > 0, sums[:, :, :width] // np.maximum(count, 1), books)


def codebooks(rows: DataFrame, length: int, rules: Rules = Rules()) -> np.ndarray:
    """parts x entries x components. ``rows`` has an id and ``x``; only sums per entry reach the driver."""
    books = _first_books(rows, rules, -(-length // rules.parts))
    for _ in range(rules.rounds):
        books = _moved(rows, length, books, rules)
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in order, as decimal numbers with commas between them."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", rules: Rules = Rules()) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256): the code of every usable vector.

    Which vectors are usable is said in ``vectors.usable``; the others have no row. A length that the parts don't divide is
    filled up with zeros. Null ids come after all others when the first codebooks are chosen, and repeated rows count
    as often as they occur. Components are held within +-2^26 for 64 entries (values of about 262,000), less for longer
    vectors, so that all numbers are exact. With fewer vectors than entries the codebooks are shorter. ``label_error``
    is null where it exceeds a long; rows without a label are summed together. Other columns are not read.
    """
    kind = {"vec_id": df.schema[vec_id].dataType.simpleString(), "label": df.schema[label].dataType.simpleString()}
    schema = f"vec_id {kind['vec_id']}, label {kind['label']}, code string, error long"
    kept, length = usable(df.select(F.col(vec_id).alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector")), "vector")
    width = max(1, -(-length // rules.parts))
    rows = kept.select("id", "label", floors("vector", rules.scale, _limit(width, rules.parts)).alias("x"))
    if not length:
        return df.sparkSession.createDataFrame([], f"{schema}, label_error long, codebooks_sha256 string")
    books = codebooks(rows, length, rules)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = _cut(matrix(batch.column("x"), length), rules, width)
            found = [nearest(cut[:, p], books[p]) for p in range(rules.parts)]
            index = np.stack([i for i, _ in found], axis=1).astype(np.uint8 if rules.entries <= 256 else ">u2")
            text = [raw.tobytes().hex() for raw in index]
            error = np.sum([d for _, d in found], axis=0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(text, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    coded = materialize(rows.mapInArrow(code, schema), "codes")
    totals = coded.groupBy(F.col("label").alias("_label")).agg(F.try_sum("error").alias("label_error"))
    joined = coded.join(small_or_shuffled(totals), F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
    return joined.withColumn("codebooks_sha256", F.lit(digest(books)))


#: Fixed by the table: 64 components, so parts of four.
_ROUND = """
near{i} AS (
  SELECT vec_id, p, arg_min(e, d * 64 + e) AS e, min(d) AS d
  FROM (SELECT vec_id, p, e, (v[1]-c[1])**2::BIGINT + (v[2]-c[2])**2 + (v[3]-c[3])**2 + (v[4]-c[4])**2 AS d FROM parts JOIN book{i} USING (p))
  GROUP BY vec_id, p),"""
_MOVE = """
book{j} AS (
  SELECT p, e, coalesce(m, c) AS c FROM book{i} LEFT JOIN (
    SELECT p, e, [CAST(floor(sum(v[1]) / count(*)) AS BIGINT), CAST(floor(sum(v[2]) / count(*)) AS BIGINT),
      CAST(floor(sum(v[3]) / count(*)) AS BIGINT), CAST(floor(sum(v[4]) / count(*)) AS BIGINT)] AS m
    FROM parts JOIN near{i} USING (vec_id, p) GROUP BY p, e) USING (p, e)),"""
SQL = (
    """WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda v: CAST(floor(256 * CAST(v AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = 64),
parts AS (SELECT vec_id, p, x[4 * p + 1:4 * p + 4] AS v FROM kept, range(16) t(p)),
book0 AS (
  SELECT p, e, x[4 * p + 1:4 * p + 4] AS c
  FROM (SELECT x, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept), range(16) t(p) WHERE e < 64),"""
    + "".join(_ROUND.format(i=i) + _MOVE.format(i=i, j=i + 1) for i in range(2))
    + _ROUND.format(i=2)
    + """
coded AS (
  SELECT vec_id, string_agg(lpad(lower(hex(e)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM near2 GROUP BY vec_id)
SELECT vec_id, label, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book2) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)"""
)


@query("op13_vector_codes", SQL)
def op13_vector_codes(spark, sf_dir):
    return encode(table(spark, sf_dir, "embeddings"))
