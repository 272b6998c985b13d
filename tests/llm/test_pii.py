import hashlib
import random
import re

import pytest

from corpusloom.llm import pii
from corpusloom.llm.queries import queries


def brute(text):
    """The base kinds straight from their patterns."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        doubled = [x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d[::-1])]
        if 12 <= len(d) <= 19 and sum(doubled) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.findall("[0-9]", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_base_spans_equal_the_patterns(seed):
    rng = random.Random(seed)
    for _ in range(3000):
        text = "".join(rng.choice("a0@.1+- (4)b2%_5\n😀") for _ in range(rng.randrange(60)))
        assert pii.base_spans(text) == brute(text), repr(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 100_000, "+1(" * 80_000, "@" * 200_000, "a@" * 100_000, "-" * 200_000):
        pii.spans_of(text)


def test_checksums():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765433")


def test_context_and_checksum_decide_the_further_kinds():
    kinds = lambda t: [pii.KINDS[k] for _, k, _ in pii.more_spans(t, pii.Rules())]
    assert kinds("pay to DE89 3704 0044 0532 0130 00 today") == ["iban"]
    assert kinds("pay to DE89 3704 0044 0532 0130 01 today") == []
    assert kinds("my SSN is 078-05-1120") == ["ssn"]
    assert kinds("part 078-05-1120") == []
    assert kinds("password=fefbb8734ee6aa113d") == ["secret"]
    assert kinds("fefbb8734ee6aa113d") == []


def test_query_equals_brute_force(spark, small, documents):
    got = {r.doc_id: r for r in queries()["op2_pii"](spark, small).collect()}
    assert len(got) == len(documents)
    for i, text, _ in documents:
        base = brute(text or "")
        row = got[i]
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(k == x for _, x, _ in base) for k in range(4)]
        spans = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert row.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
        assert set(filter(None, spans.split(","))) <= set(row.spans.split(","))


def test_odd_rows(odd, nothing):
    rows = pii.find_pii(odd).collect()
    assert len(rows) == odd.count()
    assert all(r.spans == [] for r in rows if r.doc_id in (2, 3, 4, 8))
    assert [s.kind for r in rows if r.doc_id == 9 for s in r.spans] == ["email", "phone", "card"]
    assert pii.find_pii(nothing).collect() == []


@pytest.mark.parametrize("size", [15, 16, 256, 257, 5000])
def test_secrets_of_any_length(size):
    key = ("a1B_" * size)[:size]
    found = [(9, 6, 9 + size)] if size >= 16 else []
    assert pii.more_spans(f"password={key}, and more", pii.Rules()) == found
    assert pii.more_spans(f"password={'x' * size}", pii.Rules()) == pii.more_spans(f"password={'7' * size}", pii.Rules()) == []
