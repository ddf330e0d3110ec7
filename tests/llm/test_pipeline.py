"""The stages one after another, each held against a plain version on its own input."""

import os
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from test_minhash_dedup import brute
from test_pii import brute as base_spans

import corpus_pipeline
from annalist.llm import mixing, tokens
from annalist.llm.queries import QUERIES
from annalist.session import materialize, scratch, shared_folder


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = [(10**6, "the " * 30, "en", "s", 120), (10**6 + 1, None, "en", None, None), (10**6 + 2, "123 456", None, "s", 7), (10**6 + 3, "mail me at someone@example.org now or later please", "en", "s", 50)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], sf_dir), "test"))
    return out


def test_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "pii", "mixing", "packing"]
    for df in steps[1:-1]:
        assert df.dtypes == steps[0].dtypes


def test_language_and_copies(steps):
    ids = [{r.doc_id: r.text for r in df.select("doc_id", "text").collect()} for df in steps[:3]]
    assert set(ids[0]) - set(ids[1]) >= {10**6 + 1, 10**6 + 2} and len(ids[1]) >= 0.98 * (len(ids[0]) - 2)
    want = brute(ids[1], 80, 5)
    assert set(ids[2]) == {i for i, (_, c) in want.items() if c == i}


def test_personal_data_goes(steps):
    before = {r.doc_id: r.text for r in steps[2].collect()}
    after = {r.doc_id: r for r in steps[3].collect()}
    assert set(before) == set(after)
    changed = 0
    for i, text in before.items():
        assert after[i].n_chars == len(after[i].text)
        if base_spans(text):
            assert after[i].text != text
            changed += 1
        elif "token" not in text:
            assert after[i].text == text
    assert changed > 0 and after[10**6 + 3].text == "mail me at <EMAIL> now or later please"


def test_mix_and_pack(spark, steps):
    before, after = (Counter(r.doc_id for r in df.select("doc_id").collect()) for df in (steps[3], steps[4]))
    assert set(after) <= set(before) and all(after[i] <= 2 * before[i] for i in after)
    plain = tokens.load(tokens.vocabulary_path("word_bpe_49k.json"))
    want = Counter()
    for r in steps[4].collect():
        want[r.doc_id] += len(plain.encode(r.text, add_special_tokens=False).ids) + 1
    got, filled = Counter(), defaultdict(int)
    for r in steps[5].collect():
        got[r.doc_id] += r.length
        filled[r.sequence_id] += r.length
    assert got == want
    assert sum(n != 4096 for n in filled.values()) < 13 and all(n & (n - 1) == 0 for n in filled.values())


def written(spark):
    folder = shared_folder(spark).removeprefix("file:").replace("//", "/") + "/annalist"
    return {f for f in os.listdir(folder) if os.path.isdir(f"{folder}/{f}")} if os.path.isdir(folder) else set()


def test_run(spark, sf_dir):
    before = written(spark)
    with scratch():
        assert corpus_pipeline.run(spark, sf_dir).count() > 0
        assert len(written(spark) - before) == 1
    assert written(spark) == before
    assert mixing.SHARE == 1.5


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_leave_nothing_behind(spark, sf_dir, name):
    before = written(spark)
    with scratch():
        assert QUERIES[name](spark, sf_dir).count() > 0
    assert written(spark) == before


#: Names that operators use for working and result columns.
CLASHES = (
    "id row size key band hash h1 h2 place rate sum copies source_size target range rank mix_size _mix_size n n_large cls bands component component_id kept _near_id by node _spread_key "
    "base spans clean pii_base pii_spans _pii_base lang_pred score bits_per_byte has_letter _lid_pred part queue at ids start length sequence_id offset stands bucket"
).split()


def test_clashing_columns_nulls_repeats_and_empty_tables(spark, sf_dir):
    """Every stage keeps extra columns of any name, and survives nulls everywhere, ties, repeated rows and no rows at all."""
    text = "the cat and the dog are with all of our old friends from school today"
    rows = [(i, f"{text} {i % 7} " * 5, "en", f"s{i % 3}", 10) for i in range(40)] + [(None, None, None, None, None)] * 3 + [(7, "", None, None, 0), (7, f"{text} 0 " * 5, "en", "s1", 3), (8, "x " * 60000, "en", None, 1)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    df = spark.createDataFrame(rows, schema)
    wide = df.select("*", *[F.lit(f"extra {c}").alias(c) for c in CLASHES])
    for docs in (wide, wide.limit(0), spark.createDataFrame([(None,) * 5] * 2, schema).select("*", *[F.lit(c).alias(c) for c in CLASHES])):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, docs, sf_dir)
            if name == "packing":
                assert got.count() >= docs.count()
            else:
                assert got.columns == docs.columns, name
                found = got.collect()
                assert all(r[c] == docs.select(c).first()[0] for r in found for c in CLASHES[:3] + CLASHES[-3:])
                assert len(found) <= 2 * docs.count()
