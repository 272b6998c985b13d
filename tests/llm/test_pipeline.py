
import public_tokenizers
import pytest
from test_decontam import ITEM
from test_linededup import BLANKS, brute
from test_simhash import fingerprint, groups
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline as cp
from corpusloom.session import materialize


@pytest.fixture(scope="module")
def stages(spark, small):
    """The rows that each stage was given, and those of the last."""
    docs, out = spark.read.parquet(f"{small}/documents.parquet"), []
    for name, stage in cp.STAGES:
        out.append(docs)
        docs = materialize(stage(spark, docs, small), name)
    return out + [docs]


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_keep_the_columns_of_documents(stages):
    assert [s.columns for s in stages[:-1]] == [cp.COLUMNS] * 5


def test_language_stage_drops_texts_without_letters_only(stages):
    before, after = texts(stages[0]), texts(stages[1])
    assert after == {i: t for i, t in before.items() if any(c.isalpha() for c in t or "")}


def test_line_stage_equals_brute_force(stages):
    before, after = texts(stages[1]), texts(stages[2])
    keeper = brute(sorted(before.items()))
    expected = {}
    for i, t in before.items():
        kept = [s for n, s in enumerate(t.split("\n")) if keeper.get((i, n), (i, n)) == (i, n)]
        if len(kept) == t.count("\n") + 1 or any(s.strip(BLANKS) for s in kept):
            expected[i] = "\n".join(kept)
    assert after == expected
    assert all(r.n_chars == len(r.text) for r in stages[2].collect())


def test_simhash_stage_keeps_one_of_each_group(stages):
    before = texts(stages[2])
    first = groups({i: fingerprint(t) for i, t in before.items()})
    assert texts(stages[3]) == {i: t for i, t in before.items() if first[i] == i}


def test_packing_stage_holds_all_tokens_left(stages):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sizes = {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in texts(stages[4]).items()}
    got = {}
    for r in stages[5].collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == sizes


def test_decontamination_stage(spark, stages, small, tmp_path):
    before, after = texts(stages[3]), texts(stages[4])
    assert set(after) < set(before) and all(before[i] == t for i, t in after.items())
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    dirty = stages[3].limit(1).selectExpr("doc_id", f"'{ITEM}' AS text", "lang", "source", "n_chars")
    assert cp.benchmark_decontamination(spark, dirty, str(tmp_path)).count() == 0


def test_run_gives_the_same_documents(spark, small, stages):
    ids = {r.doc_id for r in entry.queries()["pipeline"](spark, small).select("doc_id").distinct().collect()}
    assert ids == set(texts(stages[4]))


def test_stages_take_empty_and_odd_documents(spark, small):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "word", None, None, None), (1, "word", None, None, None), (2, "12 34", "en", None, 5)]
    for given in (rows, []):
        docs = spark.createDataFrame(given, "doc_id long, text string, lang string, source string, n_chars long")
        for name, stage in cp.STAGES:
            docs = materialize(stage(spark, docs, small), name)
        assert {r.doc_id for r in docs.collect()} == ({1} if given else set())


def test_every_number_has_a_query():
    names = set(entry.queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
