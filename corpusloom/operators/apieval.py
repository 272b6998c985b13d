"""Matching generated API calls with a catalogue, and the reports on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.codetext import CALL_PATTERN, calls_in_code_blocks, find_function_calls
from corpusloom.operators.keyed import first_per_key


def api_catalogue(entries: DataFrame, pattern: str = CALL_PATTERN) -> DataFrame:
    """Documented entries plus one entry per call found in an example.

    ``entries`` has ``ord``, ``function_name`` and ``example``. ``origin`` (0 documented, 1 from an
    example), ``ord`` and ``call_no`` give the order in which entries are tried.
    """
    documented = entries.withColumns(
        {"origin": F.lit(0), "call_no": F.lit(0), "in_example": F.lit(None).cast("string")}
    )
    shown = entries.where(F.coalesce(F.col("example"), F.lit("")) != "")
    calls = shown.select(
        F.posexplode(find_function_calls("example", pattern)).alias("call_no", "function_name"),
        "ord",
        F.lit(1).alias("origin"),
        F.col("example").alias("in_example"),
    )
    return documented.unionByName(calls, allowMissingColumns=True)


def first_by_name(catalogue: DataFrame) -> DataFrame:
    """The entry a name resolves to: the first one in catalogue order."""
    order = [c for c in ("origin", "package", "file", "ord", "call_no") if c in catalogue.columns]
    return first_per_key(catalogue, ["function_name"], order)


def api_calls(df: DataFrame, key: str = "id", generated: str = "generated", is_md: bool = False, pattern: str = CALL_PATTERN) -> DataFrame:
    """(id, pos, target) per call, of the code blocks only when ``is_md``."""
    names = calls_in_code_blocks(generated, pattern) if is_md else find_function_calls(generated, pattern)
    return df.select(F.col(key), F.posexplode(names).alias("pos", "target"))


def api_match(calls: DataFrame, catalogue: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Calls with the catalogue entry of their name as ``match``, NULL without one.

    The catalogue is not assumed to fit a broadcast: adaptive execution broadcasts it when its measured size is
    small, and otherwise splits the calls of a popular name over tasks.
    """
    first = first_by_name(catalogue)
    fields = fields or first.columns
    entry = first.select(F.col("function_name").alias("target"), F.struct(*fields).alias("match"))
    return calls.join(entry, "target", "left")


def api_matched(calls: DataFrame, catalogue: DataFrame) -> DataFrame:
    names = catalogue.select(F.col("function_name").alias("target")).distinct()
    return calls.join(names, "target", "left_semi")


def api_unmatched(calls: DataFrame, catalogue: DataFrame) -> DataFrame:
    names = catalogue.select(F.col("function_name").alias("target")).distinct()
    return calls.join(names, "target", "left_anti")


def match_note(match: Column, unmatch: Column) -> Column:
    """The four fixed forms of the note."""
    def names(a: Column) -> Column:
        return F.array_join(F.transform(a, lambda m: m["target"]), " ")

    none, all_ = F.size(match) == 0, F.size(unmatch) == 0
    return (
        F.when(none & all_, F.lit("No function found"))
        .when(none, F.concat(F.lit("No function matched: "), names(unmatch)))
        .when(all_, F.concat(F.lit("All functions matched: "), names(match)))
        .otherwise(
            F.concat(
                F.lit("Some functions matched: "), names(match),
                F.lit("  \nSome functions not matched: "), names(unmatch),
            )
        )
    )


def eval_output(
    df: DataFrame,
    catalogue: DataFrame,
    key: str = "id",
    generated: str = "generated",
    is_md: bool = False,
    pattern: str = CALL_PATTERN,
    fields: list[str] | None = None,
) -> DataFrame:
    """Adds all_result, match, unmatch, match_count, unmatch_count and note to every generation.

    ``fields`` limits what of the catalogue entry each match carries; reports need only its name.

    Only (id, position, name) rows are joined and regrouped; the generated texts stay put until
    the verdicts come back to them by id. A group is one generation's calls.
    """
    found = api_match(api_calls(df, key, generated, is_md, pattern), catalogue, fields)
    calls = F.array_sort(F.collect_list(F.struct("pos", "target", "match")))
    per_row = found.groupBy(key).agg(calls.alias("_calls"))
    joined = df.join(per_row, key, "left")
    result = F.transform("_calls", lambda c: F.struct(c["target"].alias("target"), c["match"].alias("match")))
    kind = dict(found.select(F.array(F.struct("target", "match")).alias("a")).dtypes)["a"]
    results = F.coalesce(result, F.array().cast(kind))
    staged = joined.withColumn("_all", results)
    staged = staged.withColumns(
        {
            "match": F.filter("_all", lambda c: c["match"].isNotNull()),
            "unmatch": F.filter("_all", lambda c: c["match"].isNull()),
        }
    )
    return staged.withColumns(
        {
            "all_result": F.concat("unmatch", "match"),
            "match_count": F.size("match").cast("bigint"),
            "unmatch_count": F.size("unmatch").cast("bigint"),
            "note": match_note(F.col("match"), F.col("unmatch")),
        }
    ).drop("_calls", "_all")


def _report_columns() -> list[Column]:
    calls = F.col("match_count") + F.col("unmatch_count")
    tests = F.count(F.lit(1))
    zero = F.count_if(calls == 0)
    full = F.count_if((F.col("match_count") == calls) & (calls > 0))
    partial = tests - zero - full

    def rate(n: Column, of: Column = tests) -> Column:
        return F.try_divide(n.cast("double"), of)

    matched, unmatched = F.sum("match_count"), F.sum("unmatch_count")
    # The names of the report's columns, as existing reports spell them.
    return [
        tests.alias("total_tests"),
        matched.alias("matched"),
        unmatched.alias("unmatched"),
        (matched + unmatched).alias("total"),
        rate(matched, matched + unmatched).alias("match_rate_avg"),
        rate(matched + unmatched).alias("api_count_avg"),
        zero.alias("zero_api_count"),
        rate(zero).alias("zero_api_count_rate"),
        full.alias("full_api_count"),
        rate(full).alias("full_api_count_rate"),
        partial.alias("partical_api_count"),
        rate(partial).alias("partical_api_count_rate"),
    ]


def eval_report(results: DataFrame) -> DataFrame:
    """Totals and rates over all generations: one row."""
    return results.agg(*_report_columns())


def checkpoint_summary(results: DataFrame, checkpoint: str = "checkpoint") -> DataFrame:
    """The report of every checkpoint side by side."""
    return results.groupBy(checkpoint).agg(*_report_columns())


def unmatched_names(calls: DataFrame, catalogue: DataFrame) -> DataFrame:
    """How often each unknown name was called: names are counted before they meet the catalogue."""
    counted = calls.groupBy("target").agg(F.count(F.lit(1)).alias("n"))
    return api_unmatched(counted, catalogue).select("target", "n")


def call_counts(df: DataFrame, calls: DataFrame, catalogue: DataFrame, key: str = "id") -> DataFrame:
    """Adds match_count and unmatch_count, which is all that reports need of a generation's calls."""
    names = catalogue.select(F.col("function_name").alias("target")).distinct().withColumn("_hit", F.lit(True))
    hits = calls.join(names, "target", "left").groupBy(key).agg(F.count("_hit").alias("match_count"), F.count_if(F.col("_hit").isNull()).alias("unmatch_count"))
    joined = df.join(hits, key, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("match_count", "unmatch_count")})


def report_section(is_md: bool = True) -> Column:
    """Markdown section of one generation (prompt, generated, note)."""
    # The texts of a section.
    body = F.col("generated") if is_md else F.concat(F.lit("``` "), F.col("generated"), F.lit("\n```"))
    return F.concat(
        F.lit("\n ---  \n  **Prompt: "), F.col("prompt"), F.lit("** \n\n **Output:**  \n "), body,
        F.lit("\n\n  **Note:**  "), F.col("note"), F.lit("\n\n"),
    )
