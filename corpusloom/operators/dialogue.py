"""Dialogues: parsing, templates and training/inference texts as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import WS, col, strip

MESSAGES = "array<struct<content:string,role:string>>"


@dataclass(frozen=True)
class Template:
    """Role tokens and system text; the defaults and the presets below are fixed values."""

    system: str = ""
    system_token: str = "<|system|>"
    user_token: str = "<|user|>"
    assistant_token: str = "<|assistant|>"
    end_token: str = "<|end|>"
    eos_token: str = "<|endoftext|>"


TEMPLATES = {
    "default": Template(
        system="Below is a dialogue between a human user and an AI assistant. The assistant is happy to help with"
        " almost anything, and will do its best to understand exactly what is needed."
    ),
    "no_system": Template(),
    "alpaca": Template(
        system="Below is an instruction that describes a task. Write a response that appropriately completes the request.",
        user_token="### Instruction:",
        assistant_token="### Response:",
    ),
}


def template(name: str, **changes) -> Template:
    if name not in TEMPLATES:
        raise ValueError(f"unknown template: {name}")
    return replace(TEMPLATES[name], **changes)


def _turns(messages: str | Column, user: str, assistant: str, end: str) -> Column:
    """Messages rendered one after another; any role but ``user`` takes the assistant form."""
    def turn(m: Column) -> Column:
        return F.concat(F.when(m["role"] == "user", user).otherwise(assistant), m["content"], F.lit(end))

    return F.array_join(F.transform(col(messages), turn), "")


def _with_system(t: Template, messages: str | Column, first: Column | None) -> Column:
    head = F.lit(f"{t.system_token}\n{t.system}{t.end_token}\n")
    head = head if first is None else F.when(first, head).otherwise("")
    return F.concat(head, _turns(messages, f"{t.user_token}\n", f"{t.assistant_token}\n", f"{t.end_token}\n"))


def training_prompt(messages: str | Column, t: Template = TEMPLATES["default"], first: Column | None = None) -> Column:
    """System header and all turns; only the ``first`` part of a long dialogue has the header."""
    return _with_system(t, messages, first)


def inference_prompt(
    messages: str | Column, t: Template = TEMPLATES["default"], first: Column | None = None, last: Column | None = None
) -> Column:
    """The training text, open for the assistant's next turn after the ``last`` part."""
    opening = F.lit(t.assistant_token)
    return F.concat(_with_system(t, messages, first), opening if last is None else F.when(last, opening).otherwise(""))


def readable(messages: str | Column) -> Column:
    return _turns(messages, "\n\nHuman: ", "\n\nAssistant: ", "")


def _message(content: Column, role: str) -> Column:
    return F.struct(content.alias("content"), F.lit(role).alias("role"))


def as_messages(df: DataFrame) -> Column:
    """Messages from whatever the table has: ``messages``, else ``prompt`` + ``completion``, else ``prompt``.

    Columns are looked up when the plan is built, NULLs row by row.
    """
    options = []
    if "messages" in df.columns:
        options.append(F.col("messages"))
    if "prompt" in df.columns:
        asked = _message(F.col("prompt"), "user")
        if "completion" in df.columns:
            answered = F.array(asked, _message(F.col("completion"), "assistant"))
            options.append(F.when(F.col("prompt").isNotNull() & F.col("completion").isNotNull(), answered))
        options.append(F.when(F.col("prompt").isNotNull(), F.array(asked)))
    if not options:
        raise ValueError(f"need messages, prompt and completion, or prompt; got {df.columns}")
    missing = F.raise_error(F.lit("row has neither messages nor a prompt")).cast(MESSAGES)
    return F.coalesce(*[o.cast(MESSAGES) for o in options], missing)


def prepare_dialogue(df: DataFrame, t: Template = TEMPLATES["default"], is_train: bool = True) -> DataFrame:
    """Adds ``text``."""
    render = training_prompt if is_train else inference_prompt
    return df.withColumn("text", render(as_messages(df), t, first_part(df)))


def first_part(df: DataFrame) -> Column | None:
    """Which rows open a dialogue, when the table holds dialogues in parts."""
    return F.coalesce(F.col("part"), F.lit(0)) == 0 if "part" in df.columns else None


def prepare_mixed(df: DataFrame, t: Template = TEMPLATES["default"]) -> DataFrame:
    """Adds ``text`` to rows of ``type`` code or dialogue; other types are an error."""
    code = F.concat("content", F.lit(f"{t.eos_token}\n"))
    unknown = F.raise_error(F.concat(F.lit("unknown row type: "), F.coalesce("type", F.lit("NULL")))).cast("string")
    spoken = training_prompt(as_messages(df), t, first_part(df))
    return df.withColumn("text", F.when(F.col("type") == "code", code).when(F.col("type") == "dialogue", spoken).otherwise(unknown))


def chat_query_prompt(query: str | Column, t: Template = TEMPLATES["no_system"]) -> Column:
    """A single query in the chat template, ready for the answer."""
    return F.concat(
        F.lit(f"{t.system_token}\n{t.system}{t.end_token}\n{t.user_token}\n"),
        col(query),
        F.lit(f"{t.end_token}\n{t.assistant_token}"),
    )


def dialogue_to_messages(text: str | Column) -> Column:
    """Messages of a ``### Human: … ### Assistant: …`` transcript; other segments are skipped."""
    segments = F.filter(F.split(strip(text), rf"###{WS}*", -1), lambda s: s != "")

    def body(segment: Column, mark: str) -> Column:
        return strip(F.substring(segment, F.lit(len(mark) + 1), F.length(segment)))

    def parse(s: Column) -> Column:
        return (
            F.when(s.startswith("Human:"), _message(body(s, "Human:"), "user"))
            .when(s.startswith("Assistant:"), _message(body(s, "Assistant:"), "assistant"))
        )

    return F.filter(F.transform(segments, parse), lambda m: m.isNotNull()).cast(MESSAGES)


TURNS_PER_ROW = 1000


def collect_messages(
    df: DataFrame,
    dialogue: str = "conv_id",
    order: str = "turn",
    role: str = "role",
    text: str = "text",
    per_row: int = TURNS_PER_ROW,
    mark_last: bool = False,
) -> DataFrame:
    """(dialogue, part, messages) from one row per turn, turns numbered from 0.

    A dialogue of at most ``per_row`` turns is one row, ``part`` 0. A longer one continues in
    further parts, so no row or task gathers an unbounded dialogue; its texts, in part order,
    join to the text of the whole. ``last`` marks the final part when asked for.
    """
    part = F.floor(F.col(order) / per_row).cast("int")
    turns = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(text).alias("content"), F.col(role).alias("role"))))
    grouped = df.groupBy(dialogue, part.alias("part")).agg(turns.alias("_turns"))
    plain = F.transform("_turns", lambda m: F.struct(m["content"].alias("content"), m["role"].alias("role")))
    parts = grouped.select(dialogue, "part", plain.alias("messages"))
    if not mark_last:
        return parts
    final = df.groupBy(dialogue).agg(F.max(part).alias("part")).withColumn("last", F.lit(True))
    return parts.join(final, [dialogue, "part"], "left").withColumn("last", F.coalesce("last", F.lit(False)))


def system_as_header(messages: str | Column, t: Template = TEMPLATES["default"]) -> Column:
    """Training text in which system messages become the header instead of assistant turns."""
    m = col(messages)
    header = F.array_join(F.transform(F.filter(m, lambda x: x["role"] == "system"), lambda x: x["content"]), "\n")
    header = F.when(header == "", F.lit(t.system)).otherwise(header)
    rest = F.filter(m, lambda x: F.coalesce(x["role"], F.lit("")) != "system")
    turns = _turns(rest, f"{t.user_token}\n", f"{t.assistant_token}\n", f"{t.end_token}\n")
    return F.concat(F.lit(f"{t.system_token}\n"), header, F.lit(f"{t.end_token}\n"), turns)
