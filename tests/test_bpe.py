import random
from collections import Counter

import pyarrow as pa
import pytest
import regex

from corpusloom.operators import bpe
from corpusloom.operators.packing import pretokenize

SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def learn(words, n_merges, min_count=1):
    """One merge after another, all pairs counted anew each time: [(left, right, count)]."""
    table = {w: [chr(b) for b in w.encode()] for w in words}
    spelled, merges = {chr(i): chr(i) for i in range(256)}, []
    for k in range(n_merges):
        pairs = Counter()
        for w, n in words.items():
            for a, b in zip(table[w], table[w][1:]):
                pairs[a + b] += n
        pair, n = min(pairs.items(), key=lambda p: (-p[1], p[0]), default=("", 0))
        if n < min_count:
            break
        symbol = chr(bpe.FIRST_MERGED + k)
        spelled[symbol] = spelled[pair[0]] + spelled[pair[1]]
        merges.append((spelled[pair[0]], spelled[pair[1]], n))
        for w, symbols in table.items():
            if pair[0] in symbols:
                table[w] = list("".join(symbols).replace(pair, symbol))
    return merges


def corpus(seed, n=80):
    rng = random.Random(seed)
    syllables = ["ba", "na", "nan", "é", "to", "aaaa", "aa", "x1", "12", " ", "  ", "don't", "!", "日本", "\n\n ", "🙂"]
    return ["".join(rng.choice(syllables) for _ in range(rng.randrange(60))) for _ in range(n)]


def counted(texts):
    return Counter(w for t in texts if t for w in SPLIT.findall(t))


def listed(merges):
    return [(m.left, m.right, m.count) for m in merges]


@pytest.mark.parametrize("seen,top", [(20_000, 4096), (5, 4096), (0, 4096), (20, 6)])
def test_batches_equal_one_merge_after_another(spark, monkeypatch, seen, top):
    """However little of the corpus the proposals come from, and so however often they are wrong."""
    monkeypatch.setattr(bpe, "TOP_PAIRS", top)
    monkeypatch.setattr(bpe, "REPEATED", 20)
    texts = corpus(seen + top)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, content string").repartition(5)
    merges = 120 if seen > 1000 else 40
    got = bpe.bpe_train(df, vocab_size=256 + merges, proposal_words=seen)
    assert listed(got) == learn(counted(texts), merges)


def test_thousands_of_merges_take_few_rounds(spark, monkeypatch):
    """All merges of a corpus, down to pairs that occur once: batches double, and counts are never taken anew."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 14))) for _ in range(900)]
    texts = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(200)]
    rounds, full = [], []
    changes, count = bpe._changes, bpe.pair_counts
    monkeypatch.setattr(bpe, "_changes", lambda *a: rounds.append(a[-1]) or changes(*a))
    monkeypatch.setattr(bpe, "pair_counts", lambda words: full.append(1) or count(words))
    df = spark.createDataFrame(list(enumerate(texts)), "id int, content string")
    got = bpe.bpe_train(df, vocab_size=256 + 2500)
    assert listed(got) == learn(counted(texts), 2500) and len(got) > 1500
    assert len(full) == 1 and len(rounds) < 12


def test_too_rare_pairs_and_empty_corpora(spark):
    texts = corpus(5, 20)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, content string")
    for least in (2, 7, 10**6):
        assert listed(bpe.bpe_train(df, vocab_size=800, min_count=least)) == learn(counted(texts), 544, least)
    assert bpe.bpe_train(df.where("false"), vocab_size=300) == []
    nothing = spark.createDataFrame([(0, ""), (1, None), (2, "a")], "id int, content string")
    assert bpe.bpe_train(nothing, vocab_size=300) == []


def one_at_a_time(merges, word):
    symbols = [chr(b) for b in word.encode()]
    for m in merges:
        out = []
        for s in symbols:
            if out and (out[-1], s) == (m.left, m.right):
                out[-1] = m.left + m.right
            else:
                out.append(s)
        symbols = out
    ids = {chr(i): i for i in range(256)}
    for m in reversed(merges):
        if len(m.left + m.right) > 1:
            ids[m.left + m.right] = 256 + m.rank
    return [ids[s] for s in symbols]


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_encoding_equals_one_merge_after_another(spark, limit, monkeypatch):
    texts = [*corpus(11, 40), "", None, "ba" * 3000, "  ", "unseen ÿ words"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, content string").repartition(4)
    merges = bpe.bpe_train(df, vocab_size=256 + 90)
    vocabulary = bpe.Vocabulary.of(bpe.bpe_merges(df, vocab_size=256 + 90))
    if not limit:
        monkeypatch.setattr(bpe, "hot_keys", lambda counts, on: counts.orderBy(counts.n.desc(), *on).limit(3).select(*on))
    got = {r.id: (r.n_chars, r.input_ids) for r in bpe.bpe_encode(df, vocabulary, broadcast_bytes=limit).collect()}
    want = {i: [x for w in SPLIT.findall(t or "") for x in one_at_a_time(merges, w)] for i, t in enumerate(texts)}
    assert got == {i: (None if t is None else len(t), want[i]) for i, t in enumerate(texts)}
    # Decoding gives the bytes back.
    spelled = {i: bytes([i]) for i in range(256)} | {256 + m.rank: (m.left + m.right).encode("latin-1") for m in merges}
    assert all(b"".join(spelled[x] for x in ids) == (texts[i] or "").encode() for i, (_, ids) in got.items())
    # As a tokenizer of the packing path, with ratios of characters to ids.
    rows = pretokenize(df.withColumn("size", df.id), tokenizer=bpe.bpe_tokenizer(vocabulary), drop=()).collect()
    for r in rows:
        if texts[r.id]:
            assert r.input_ids == want[r.id] and r.ratio_char_token == len(texts[r.id]) / len(want[r.id])


def test_a_task_indexes_its_words_in_bounded_parts():
    words = [f"word{i:04}" for i in range(1000)]
    batches = [pa.RecordBatch.from_pydict({"word": words[i : i + 400], "n": list(range(i, min(i + 400, 1000)))}) for i in (0, 400, 800)]
    parts = list(bpe._indexed(iter(batches), 800))
    assert [len(p.symbols) for p in parts] == [800] * 10
    assert [w for p in parts for w in p.words()] == words and [n for p in parts for n in p.weight[::8].tolist()] == list(range(1000))
    assert list(bpe._indexed(iter(batches[:0]), 800)) == []


def test_encoding_does_not_shuffle_texts(spark):
    df = spark.createDataFrame([(1, "a b a b"), (2, None), (3, "b")], "id int, content string").repartition(3)
    found = bpe.bpe_encode(df, bpe.Vocabulary([]))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan
    assert {r.id: (r.n_chars, r.input_ids) for r in found.collect()} == {1: (7, [*b"a b a b"]), 2: (None, []), 3: (1, [*b"b"])}
    # A repeated or null key: its texts are one, place by place.
    twice = spark.createDataFrame([(1, "a b"), (1, "c de"), (None, "x"), (None, "y"), (4, "z")], "id int, content string")
    got = {r.id: (r.n_chars, r.input_ids) for r in bpe.bpe_encode(twice, bpe.Vocabulary([])).collect()}
    assert got == {1: (4, [*b"ac b de"]), None: (1, [*b"xy"]), 4: (1, [*b"z"])}
