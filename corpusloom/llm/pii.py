"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Base kinds (email, ip, card, phone) are kept whenever pattern and checksum agree, whatever the context says. Further
kinds are reported when their score, pattern plus checksum plus context, reaches ``Rules.threshold``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import table, text_of
from corpusloom.llm.registry import query

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("iban", "ssn", "secret")
KINDS = BASE_KINDS + MORE_KINDS

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# No digit in front: a match that began inside a run of digits would have begun at the run's start.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")
# Whole runs of any length; they must hold a digit and a letter.
SECRET, DIGIT, LETTER = re.compile(r"[A-Za-z0-9_]{16,}"), re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")

#: Words that make a kind more likely, in either direction within ``Rules.window`` characters.
CONTEXT = {
    "iban": re.compile(r"(?i)\b(?:iban|account|bank|konto|compte|cuenta|transfer)\b"),
    "ssn": re.compile(r"(?i)\b(?:ssn|social security|taxpayer|insurance number)\b"),
    "secret": re.compile(r"(?i)(?:password|passwd|secret|token|api[_-]?key|access[_-]?key)"),
}
AGAINST = re.compile(r"(?i)\b(?:example|sample|test|order|invoice|isbn|version|part number)\b")


@dataclass(frozen=True)
class Rules:
    """Scores of the further kinds: what a pattern and a passed checksum are worth, and what a nearby word adds or takes."""

    pattern: float = 0.3
    checksum: float = 0.5
    context: float = 0.4
    against: float = 0.3
    threshold: float = 0.6
    window: int = 40


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 7064 check of an IBAN without blanks: letters count 10 to 35, country and check digits go last."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Every match holds one @ after a local part, so the @ signs are walked rather than every position."""
    after, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        after = domain.end() if domain else max(after, at + 1)
        if domain:
            yield start, after
        at = text.find("@", after)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, order of the kind, end) of the base kinds; code points, end exclusive."""
    found = [(s, 0, e) for s, e in _emails(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def _score(kind: str, text: str, start: int, end: int, checked: bool, rules: Rules) -> float:
    near = text[max(0, start - rules.window) : start] + " " + text[end : end + rules.window]
    score = rules.pattern + rules.checksum * checked
    score += rules.context if CONTEXT[kind].search(near) else 0
    return score - (rules.against if AGAINST.search(near) else 0)


def more_spans(text: str, rules: Rules) -> list[tuple[int, int, str]]:
    """Spans of the further kinds whose score reaches the threshold."""
    found = []
    for m in IBAN.finditer(text):
        # Capital letters after the number may have been taken in: the longest prefix that passes counts.
        whole = m[0]
        for end in range(len(whole), 14, -1):
            bare = whole[:end].replace(" ", "")
            if whole[end - 1] != " " and 15 <= len(bare) <= 34 and mod97(bare):
                if _score("iban", text, m.start(), m.start() + end, True, rules) >= rules.threshold:
                    found.append((m.start(), 4, m.start() + end))
                break
    for m in SSN.finditer(text):
        area, group, serial = m[0].split("-")
        valid = area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"
        if valid and _score("ssn", text, m.start(), m.end(), False, rules) >= rules.threshold:
            found.append((m.start(), 5, m.end()))
    for m in SECRET.finditer(text):
        mixed = DIGIT.search(m[0]) and LETTER.search(m[0])
        if mixed and _score("secret", text, m.start(), m.end(), False, rules) >= rules.threshold:
            found.append((m.start(), 6, m.end()))
    return found


def spans_of(text: str, rules: Rules = Rules()) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans), both by start and then by kind in the order of ``KINDS``."""
    base = base_spans(text)
    return base, sorted(base + more_spans(text, rules))


def find_pii(df: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end, base>>), one row per input row.

    Null and empty texts have no spans. Rows are independent: repeated ids and rows each get their own result; other
    columns are not read. Offsets are code points into the whole text.
    """
    kind = df.schema[doc_id].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
        for batch in batches:
            found = []
            for value in batch.column("text"):
                base, every = spans_of(value.as_py(), rules)
                known = set(base)
                found.append([{"kind": KINDS[k], "start": s, "end": e, "base": (s, k, e) in known} for s, k, e in every])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, shape)], names=["doc_id", "spans"])

    rows = df.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    return rows.mapInArrow(scan, f"doc_id {kind}, spans array<struct<kind:string,start:long,end:long,base:boolean>>")


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query("op2_pii")
def op2_pii(spark, sf_dir):
    found = find_pii(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    counts = [_count(base, kind) for kind in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))
