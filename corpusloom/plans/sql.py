"""DuckDB spellings of the shared expressions, for the oracle queries."""

from __future__ import annotations

WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
BREAK = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
TOKEN = r"[A-Za-z_0-9]+|[^A-Za-z_0-9 \t\n\x0b\x0c\r]"
DEDUP = "[A-Za-z_0-9]+"
WORD = r"[\pL\pN_]"


def lines(c: str) -> str:
    parts = f"string_split_regex({c}, '{BREAK}')"
    return f"(CASE WHEN {c} = '' THEN [] WHEN {parts}[-1] = '' THEN {parts}[:-2] ELSE {parts} END)"


def strip(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^{WS}+', ''), '{WS}+$', '')"


def drop_ws(c: str) -> str:
    return f"regexp_replace({c}, '{WS}+', '', 'g')"


def content_hash(c: str) -> str:
    return f"md5({drop_ws(c)})"


def count_of(c: str, needle: str) -> str:
    lit = "chr(10)" if needle == "\n" else f"'{needle}'"
    return f"CAST((length({c}) - length(replace({c}, {lit}, ''))) / {len(needle)} AS BIGINT)"


def any_of(c: str, needles: list[str]) -> str:
    def lit(n: str) -> str:
        return " || ".join("chr(10)" if p == "\n" else f"'{p}'" for p in _pieces(n))

    return "(" + " OR ".join(f"contains({c}, {lit(n)})" for n in needles) + ")"


def _pieces(text: str) -> list[str]:
    out: list[str] = []
    for ch in text:
        if ch == "\n" or not out or out[-1] == "\n":
            out.append(ch)
        else:
            out[-1] += ch
    return out


def unit(seed: int, key: str, salt: str) -> str:
    return f"(('0x' || substr(md5('{seed}:{salt}:' || CAST({key} AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0)"


def head(c: str) -> str:
    return f"lower(array_to_string({lines(c)}[1:5], chr(10)))"


def token_texts(c: str) -> str:
    return f"regexp_extract_all({c}, '{TOKEN}')"


def tokens(c: str) -> str:
    return f"list_transform({token_texts(c)}, lambda t: ('0x' || substr(md5(t), 1, 7))::INTEGER)"


def dedup_words(c: str) -> str:
    return f"regexp_extract_all({c}, '{DEDUP}')"


def joined(c: str) -> str:
    """A list of numbers as one string."""
    return f"array_to_string({c}, ' ')"
