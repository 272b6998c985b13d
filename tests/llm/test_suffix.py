import hashlib
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import suffix
from corpusloom.llm.queries import queries


def brute(rows, length=100):
    """{id: (bytes, removed, runs, digest)} by a set of all strings seen so far."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            if raw[s : s + length] in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(raw[s : s + length])
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        runs = sum(g and not before for g, before in zip(gone, [0, *gone]))
        out[i] = (len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def result(docs, rules):
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["first"])
    rows = suffix.dedup_substrings(docs, rules=rules).select("doc_id", "n_bytes", removed, F.size("spans").cast("long"), F.sha2("kept", 256))
    return {r[0]: tuple(r[1:]) for r in rows.collect()}


def test_query_equals_brute_force(spark, small, documents):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries()["op10_suffix_dedup"](spark, small).collect()}
    assert got == brute([(i, t) for i, t, _ in documents])


def made(seed):
    """Texts of passages, edits, repeats within a text, periodic stretches and zero bytes."""
    rng = random.Random(seed)
    letters = "ab" if seed % 2 else "abcdefgh \x00é"
    some = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [some(rng.randrange(20, 160)) for _ in range(8)] + ["ab" * 60, "x" * 130, "\x00" * 40]
    rows = []
    for i in range(40):
        parts = [rng.choice([some(rng.randrange(40)), rng.choice(passages), rng.choice(passages)]) for _ in range(rng.randrange(6))]
        text = "".join(parts)
        if text and rng.random() < 0.4:
            at = rng.randrange(len(text))
            text = text[:at] + some(1) + text[at + 1 :]
        rows.append((rng.randrange(-500, 500) * 50 + i, text))
    return rows


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("rules", [dict(length=30, gram=8), dict(length=30, gram=8, hot=1, reach=4, chunk=500), dict(length=30, gram=8, hot=1, reach=4, crowd=2)])
def test_made_texts_equal_brute_force(spark, seed, rules):
    rows = made(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(docs, suffix.Rules(**rules)) == brute(rows, rules["length"])


def test_odd_rows(spark, odd, nothing):
    rows = suffix.dedup_substrings(odd).collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: r for r in rows}
    assert [(by_id[i].n_bytes, by_id[i].spans, bytes(by_id[i].kept)) for i in (2, 3)] == [(0, [], b"")] * 2
    assert all(r.spans == [] for r in rows if r.doc_id is None)  # exact repeats of a row count as one document
    assert by_id[8].n_bytes == 150_000 and len(by_id[8].kept) == 1  # every other byte lies in a run that also starts one earlier
    assert sorted(len(r.kept) for r in rows if r.doc_id == 5)[0] < 30
    assert suffix.dedup_substrings(nothing).collect() == []


def test_text_ids(spark):
    rows = [("b", "z" * 50 + "The same passage of more than a hundred bytes stands in two texts, whose ids are words. " * 2), ("a", "The same passage of more than a hundred bytes stands in two texts, whose ids are words. " * 2), ("10", "short")]
    assert result(spark.createDataFrame(rows, "doc_id string, text string"), suffix.Rules()) == brute(rows)


def test_a_passage_with_different_text_around_it(spark, monkeypatch):
    """A third of the texts share 150 bytes: all pieces differ and agree in the context, yet no task sorts them together."""
    rng = random.Random(1)
    some = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    passage = some(150)
    rows = [(i, some(rng.randrange(80, 200)) + (passage if i % 3 == 0 else "") + some(rng.randrange(80, 200))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    rules, sorted_ = suffix.Rules(hot=20, crowd=50), []
    induced = suffix.repeated_reaches
    monkeypatch.setattr(suffix, "repeated_reaches", lambda pieces, rules: sorted_.append(pieces) or induced(pieces, rules))
    assert result(docs, rules) == brute(rows)
    assert max(r["count"] for r in sorted_[0].groupBy("shard").count().collect()) <= 50
    assert suffix.Rules().crowd <= 1 << 16


def test_null_ids_and_windows_by_hash(spark, odd):
    rules = dict(hot=0, crowd=0)
    got = {(r.doc_id, r.n_bytes, str(r.spans), bytes(r.kept)) for r in suffix.dedup_substrings(odd, rules=suffix.Rules(**rules)).collect()}
    assert got == {(r.doc_id, r.n_bytes, str(r.spans), bytes(r.kept)) for r in suffix.dedup_substrings(odd).collect()}
