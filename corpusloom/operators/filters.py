"""Row filters: corpus quality rules and event/file predicates."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import WS, col, unit_hash
from corpusloom.operators.keyed import first_per_key


@dataclass(frozen=True)
class QualityRules:
    """Thresholds; the defaults are fixed values of the corpus cleaner."""

    line_max: int = 1000
    line_mean: float = 100.0
    alpha_frac: float = 0.25
    min_token_ratio: float = 1.5
    filter_proba: float = 0.7
    seed: int = 0


def randomly_drops(p: float, seed: int, key: str | Column, salt: str) -> Column:
    """True with probability ``p``; a repeatable draw per row and rule."""
    return unit_hash(seed, key, salt) <= F.lit(p)


def rule_chain(rules: QualityRules, key: str = "id") -> list[tuple[str, Column]]:
    """(name, Column that is true when the rule rejects the row), in rule order.

    Expects the feature columns. NULL features (an empty text) reject the row.
    """
    def beyond(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(True))

    return [
        ("autogenerated", F.col("autogenerated")),
        ("line_max", beyond(F.col("line_max") > rules.line_max)),
        ("line_mean", beyond(F.col("line_mean") > rules.line_mean)),
        ("alpha_frac", beyond(F.col("alpha_frac") < rules.alpha_frac)),
        ("ratio", beyond(F.col("ratio") < rules.min_token_ratio)),
        ("config_or_test", F.col("config_or_test") & randomly_drops(rules.filter_proba, rules.seed, key, "config_or_test")),
        ("has_no_keywords", F.col("has_no_keywords") & randomly_drops(rules.filter_proba, rules.seed, key, "has_no_keywords")),
        ("has_few_assignments", F.col("has_few_assignments")),
    ]


def first_failing_rule(rules: QualityRules, key: str = "id") -> Column:
    return F.coalesce(*[F.when(rejects, F.lit(name)) for name, rejects in rule_chain(rules, key)])


def first_good_rows(df: DataFrame, rules: QualityRules = QualityRules(), key: str = "id") -> DataFrame:
    """The first row of every ``hash``, with the columns given, if it passes all rules.

    The first copy uses its hash up even when a rule rejects it, so later copies never survive. All columns travel
    to their hash: give narrow rows.
    """
    first = first_per_key(df.withColumn("_reason", first_failing_rule(rules, key)), ["hash"], [key])
    return first.where(F.col("_reason").isNull()).drop("_reason")


def quality_filter(df: DataFrame, rules: QualityRules = QualityRules(), key: str = "id") -> DataFrame:
    """Keep the first row of every ``hash`` if it passes all rules.

    Which rows stay is found from keys, hashes and verdicts; whole rows meet the keys of the winners only.
    """
    verdict = df.select(key, "hash", first_failing_rule(rules, key).alias("_reason"))
    winners = first_per_key(verdict, ["hash"], [key]).where(F.col("_reason").isNull()).select(key)
    return df.join(winners, key, "left_semi")


def quality_reject_reason(df: DataFrame, rules: QualityRules = QualityRules(), key: str = "id") -> DataFrame:
    """Rows per first rule that fires (``duplicate`` and ``kept`` included).

    Each hash is reduced to (rows, verdict of its first row) before anything is
    counted, so the funnel needs one shuffle of hash-sized rows.
    """
    verdict = df.select("hash", F.col(key).alias("_key"), F.coalesce(first_failing_rule(rules, key), F.lit("kept")).alias("reason"))
    per_hash = verdict.groupBy("hash").agg(
        F.min_by("reason", "_key").alias("reason"), F.count(F.lit(1)).alias("n")
    )
    counted = per_hash.select(
        F.explode(
            F.array(
                F.struct(F.col("reason"), F.lit(1).cast("bigint").alias("n")),
                F.struct(F.lit("duplicate").alias("reason"), (F.col("n") - 1).alias("n")),
            )
        ).alias("r")
    ).select("r.*")
    return counted.where("n > 0").groupBy("reason").agg(F.sum("n").alias("n"))


def file_events(df: DataFrame, suffix: str = ".lua", kind: str = "save") -> DataFrame:
    """Save events of files with the given suffix."""
    return df.where((F.col("type") == kind) & F.col("filename").endswith(suffix))


# Fixed value: what may follow the cursor on its line.
LINE_REST = rf"""^{WS}*[)}}\]"'`]*{WS}*[:{{;,]?{WS}*$"""
LINE_WINDOW = 500


def line_rest(text: Column, offset: Column) -> Column:
    """From the 0-based offset to the end of the line."""
    tail = text.substr(offset + 1, F.length(text))
    return F.substring_index(F.replace(tail, F.lit("\r"), F.lit("\n")), "\n", 1)


def line_at(text: Column, offset: Column) -> Column:
    """The whole line that holds the offset."""
    before = F.substring_index(F.replace(F.substring(text, F.lit(1), offset), F.lit("\r"), F.lit("\n")), "\n", -1)
    return F.concat(before, line_rest(text, offset))


def completion_positions(
    df: DataFrame,
    text: str = "text",
    offset: str = "offset",
    filename: str = "filename",
    disable_line: list[str] | None = None,
    disable_file: list[str] | None = None,
) -> DataFrame:
    """Rows whose cursor position accepts a completion."""
    rest = line_rest(F.col(text), F.col(offset))
    allowed = [rest.rlike(LINE_REST)]
    if disable_line:
        head = F.substring(line_at(F.col(text), F.col(offset)), 1, LINE_WINDOW)
        allowed.append(~reduce(or_, [head.rlike(p) for p in disable_line]))
    if disable_file:
        allowed.append(~reduce(or_, [col(filename).rlike(p) for p in disable_file]))
    return df.where(reduce(and_, allowed))
