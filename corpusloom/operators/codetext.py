"""Code inside texts: blocks, calls, comments, stubs and generated programs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import WORD, WS, col, contains_any, quoted, strip

# The call pattern of the API, the answer when no code is found, and the
# texts that end a generated function.
CALL_PATTERN = rf"edi\.{WORD}+:({WORD}+)"
NO_CODE = "-- 还没学会怎么写这个代码呢TAT"
END_OF_FUNCTION = ["\nclass", "\ndef", "\n#", "\n@", "\nprint", "\nif"]


def find_code_blocks(text: str | Column, language: str = "lua") -> Column:
    """All texts between `` `lua`` and a closing back-tick line."""
    return F.regexp_extract_all(col(text), F.lit(rf"(?s)`{quoted(language)}\n(.*?)\n`"), F.lit(1))


def find_function_calls(code: str | Column, pattern: str = CALL_PATTERN) -> Column:
    """Names of called functions in order, repeats kept."""
    return F.regexp_extract_all(col(code), F.lit(pattern), F.lit(1))


def calls_in_code_blocks(text: str | Column, pattern: str = CALL_PATTERN, language: str = "lua") -> Column:
    return F.flatten(F.transform(find_code_blocks(text, language), lambda b: find_function_calls(b, pattern)))


def create_content(prompt: str | Column, response: str | Column, fallback: str = NO_CODE, language: str = "lua") -> Column:
    """The prompt as a comment, then the first code block of the response."""
    first = F.get(find_code_blocks(response, language), F.lit(0))
    return F.concat(F.lit("-- "), col(prompt), F.lit("\n"), F.coalesce(first, F.lit(fallback)))


def comment_code_pairs(df: DataFrame, content: str = "content", keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """(notation, code, start, end) for every comment line that a code line follows.

    ``start``/``end`` are the 0-based first and last character of the code line's first occurrence.
    """
    # One extraction; the two lines of a match are parted afterwards. Of a match that ends in blanks only, as at the
    # end of a text, the last blank counts as the code.
    found = F.regexp_extract_all(content, F.lit(rf"--[^\n]*\n{WS}*[^\n]+"), F.lit(0))

    def parted(match: Column) -> Column:
        notation = F.substring_index(match, "\n", 1)
        code = F.regexp_replace(F.substring(match, F.length(notation) + 2, F.length(match)), rf"^{WS}+", "")
        return F.struct(notation.alias("notation"), F.when(code == "", F.right(match, F.lit(1))).otherwise(code).alias("code"))

    pairs = F.transform(found, parted)
    # Places are looked up inside the row, so an exploded row does not carry the text. Exploding the
    # expression itself, not a column of it, keeps the optimizer from computing it again in a filter.
    placed = F.expr(f"transform(pairs, p -> struct(p.notation, p.code, locate(p.code, `{content}`) - 1 AS start))")
    rows = df.select(*keep, content, pairs.alias("pairs")).select(*keep, F.posexplode(placed).alias("ord", "pair"))
    return rows.where(~strip("pair.code").startswith("--")).select(
        *keep,
        "ord",
        strip("pair.notation").alias("notation"),
        strip("pair.code").alias("code"),
        "pair.start",
        (F.col("pair.start") + F.length("pair.code") - 1).alias("end"),
    )


def grep_lines(df: DataFrame, substring: str, content: str = "content", keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """1-based numbers of the lines that contain ``substring``; files without a hit are left out."""
    rows = F.split(F.regexp_replace(F.col(content), r"\r\n?", "\n"), "\n", -1)
    hits = F.filter(F.transform(rows, lambda l, i: F.when(l.contains(substring), i + 1)), lambda n: n.isNotNull())
    found = F.col(content).contains(substring) & F.lit("\n" not in substring)
    return df.where(found).select(*keep, hits.alias("line_numbers"))


def remove_last_block(text: str | Column, markers: list[str] = END_OF_FUNCTION) -> Column:
    """The text before the last end-of-function marker; empty when there is none."""
    choices = "|".join(quoted(m).replace("\n", r"\n") for m in markers)
    return F.regexp_extract(col(text), rf"(?s)^(.*)(?:{choices})", 1)


def hits_stop_string(text: str | Column, markers: list[str] = END_OF_FUNCTION) -> Column:
    return contains_any(text, markers)


def build_test_program(test: str | Column, entry_point: str | Column) -> Column:
    return F.concat(F.lit("\n"), col(test), F.lit("\ncheck("), col(entry_point), F.lit(")"))


def _arg_names(args: Column) -> Column:
    return F.array_join(F.transform(args, lambda a: a["name"]), ",")


def _arg_lines(args: Column, tag: str) -> Column:
    def line(a: Column) -> Column:
        return F.concat(F.lit(f"---@{tag} "), a["name"], F.lit(" "), a["type"], F.lit(" "), a["comment"], F.lit("\n"))

    return F.array_join(F.transform(args, line), "")


def render_api_stub(package: str | Column = "package", namespace: str = "edi", prefix: str = "isc_test_") -> Column:
    """Annotated stub of a catalogue entry (description, function_name, args, ret, example).

    Functions of ``namespace`` are called from functions whose names begin with ``prefix``. Packages ``events`` and ``structures`` have their own forms.
    """
    # The texts of the stubs below, and the names that ``namespace`` and ``prefix`` have by default.
    package = col(package)
    name, about = F.col("function_name"), F.col("description")
    args = F.coalesce("args", F.array().cast("array<struct<name:string,type:string,comment:string>>"))
    names = _arg_names(args)
    title = F.concat(F.lit("-- "), about, F.lit("\n"))
    params = _arg_lines(args, "param")

    event = F.concat(title, params, name, F.lit("("), names, F.lit(")\n\n"))

    def field(a: Column) -> Column:
        return F.concat(
            F.lit("-- 获取"), about, F.lit("的"), a["comment"], F.lit("\n---@field "),
            a["name"], F.lit(" "), a["type"], F.lit(" "), a["comment"],
            F.lit("\nlocal "), a["name"], F.lit(" = "), name, F.lit('["'), a["name"], F.lit('"]\n\n'),
        )

    structure = F.concat(title, F.array_join(F.transform(args, field), ""))

    example = F.when(
        F.coalesce(F.col("example"), F.lit("")) != "",
        F.concat(F.lit("-- "), about, F.lit("的例子\n"), F.col("example"), F.lit("\n\n")),
    ).otherwise("")
    call = F.concat(F.lit(f"{namespace}."), package, F.lit(":"), name, F.lit("("), names, F.lit(")"))
    head = F.concat(F.lit(f"function {prefix}"), package, F.lit(":"), name, F.lit("("), names, F.lit(")\n\t"))
    logged = F.concat(
        F.lit("---@return "), F.col("ret.type"), F.lit(" #"), F.col("ret.comment"), F.lit("\n"), head,
        F.lit("local result = "), call,
        F.lit(f'\n\tLOGI("{prefix}'), package, F.lit(" "), name, F.lit(': " .. tostring(result))\nend\n\n'),
    )
    plain = F.concat(head, call, F.lit("\nend\n\n"))
    common = F.concat(example, title, params, F.when(F.col("ret").isNotNull(), logged).otherwise(plain))
    return F.when(package == "events", event).when(package == "structures", structure).otherwise(common)
