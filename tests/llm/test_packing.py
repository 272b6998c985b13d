import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpusloom.llm import packing as pk
from corpusloom.llm.queries import queries


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [0]


def test_both_encoders_give_the_same_ids(reference):
    tokens = pk.Tokens("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")
    rng = random.Random(5)
    letters = "aZ éßñ \u0085\n\r\t'sdtlvrem019²½.,!?_-ĀſǅɎ\x00\x1c\x1f<|endoftext|>"
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(30)))
        assert tokens.encode(text).tolist() == reference(text)[:-1], repr(text)
    for text in ("日本語 🙂", "<|endoftext|>", "  x", "ɐɑ ʼn"):
        assert tokens.encode(text).tolist() == reference(text)[:-1], repr(text)


def checked(rows, texts, reference):
    """All ids lie in exactly one piece, sequences have no gaps; returns (padding, tokens)."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(texts)
    for i, text in texts.items():
        ids, at = np.array(reference(text), dtype="<u4"), 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for parts in sequences.values():
        size = 0
        for offset, length in sorted(parts):
            assert offset == size
            size += length
        assert size <= 1024
        padding += 0 if size & (size - 1) == 0 else 1024 - size
    return padding, sum(n for parts in sequences.values() for _, n in parts)


def test_query_packs_every_token_with_little_padding(spark, small, documents, reference):
    rows = queries()["op5_packing"](spark, small).collect()
    padding, total = checked(rows, {i: t for i, t, _ in documents}, reference)
    assert padding < 0.015 * total


def test_small_chunks_carry_open_windows_on(spark, documents, reference):
    docs = spark.createDataFrame(documents, "doc_id long, text string, lang string").coalesce(1)
    rows = pk.digests(pk.pack(docs, rules=pk.Rules(chunk=5000))).collect()
    padding, total = checked(rows, {i: t for i, t, _ in documents}, reference)
    assert padding < 0.03 * total
    # Order is kept: documents follow each other as they came.
    placed = sorted((r.sequence_id, r.offset, r.doc_id, r.start) for r in rows)
    assert [d for _, _, d, s in placed if s == 0] == [i for i, _, _ in documents]


@pytest.mark.parametrize("seed", range(20))
def test_layout_is_the_cheapest(seed):
    """The monotone queue against the plain recurrence."""
    rng = random.Random(seed)
    rules = pk.Rules(window=32, gap=10, sentence=3, word=7, sequence=2)
    sizes = np.array([rng.randrange(1, 60) for _ in range(rng.randrange(1, 12))])
    total = int(sizes.sum())
    ends = np.array(sorted(rng.sample(range(1, total + 1), rng.randrange(total // 4 + 1))), dtype=np.int64)
    positions, penalties = pk.boundaries(sizes, ends, seed % 2 == 0, rules)
    price = lambda n: 0 if n & (n - 1) == 0 else rules.window - n
    best = [0.0] + [float("inf")] * (len(positions) - 1)
    for i in range(1, len(positions)):
        for j in range(i):
            n = int(positions[i] - positions[j])
            if n <= rules.window:
                best[i] = min(best[i], best[j] + price(n) + penalties[i] + rules.sequence)
    cuts = [0, *pk.best_cuts(positions, penalties, rules, 1)]
    cost = sum(price(int(positions[b] - positions[a])) + penalties[b] + rules.sequence for a, b in zip(cuts, cuts[1:]))
    assert cuts[-1] == len(positions) - 1 and cost == pytest.approx(best[-1])


def test_odd_rows(odd, nothing, reference):
    rows = pk.pack(odd).collect()
    assert sum(r.length for r in rows) == sum(len(reference(t)) for t in (r.text for r in odd.collect()))
    assert [(r.length, bytes(r.ids)) for r in rows if r.doc_id in (2, 3)] == [(1, b"\0\0\0\0")] * 2
    assert sum(r.start == 0 for r in rows if r.doc_id is None) == 2
    assert pk.pack(nothing).collect() == []
