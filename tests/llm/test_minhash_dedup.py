import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from annalist.llm import minhash_dedup as m
from annalist.llm.queries import QUERIES


def shingles(text, k=3):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda x: x[0].lower(), (text or "").encode()))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(texts, percent=85, k=3):
    """ids to texts: n and least id reachable, by comparing all pairs that share a shingle."""
    sets = {i: shingles(t, k) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by = {}
    for i in sorted(sets):
        near = {}
        for s in sets[i]:
            for j in by.get(s, ()):
                near[j] = near.get(j, 0) + 1
            by.setdefault(s, []).append(i)
        for j, n in near.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


def made_texts(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = {}
    for g in range(12):
        base = [word() for _ in range(rng.randrange(5, 150))]
        for _ in range(rng.choice([1, 2, 9, 40])):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                t[rng.randrange(len(t))] = word()
            texts[len(texts) * 3 + g] = " ".join(t)
    return texts


@pytest.mark.parametrize("block, large", [(1024, 64), (7, 2)])
def test_equal_to_all_pairs(spark, monkeypatch, block, large):
    monkeypatch.setattr(m, "BLOCK_ROWS", block)
    monkeypatch.setattr(m, "LARGE", large)
    texts = made_texts()
    texts |= {90001: None, 90002: "", 90003: " \t", 90004: "One", 90005: "one", 90006: "one two", 90007: "ONE two\n", 90008: "É é", 90009: "é é", 90010: "x " * 30000}
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in texts.items()] + [(90010, texts[90010], "c", 2), (None, "null id", "c", 1)], "doc_id bigint, text string, cls string, n int")
    got = m.near_duplicates(df).collect()
    assert len(got) == len(texts) + 2
    want = brute(texts)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == want[r.doc_id], r
            assert r.kept == (r.doc_id == r.component_id)
    left = m.drop_duplicates(df, percent=85, shingle=3)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} == {i for i, (_, c) in want.items() if c == i} | {None}
    ids = [r.doc_id for r in left.collect()]
    assert len(ids) == len(set(ids))


def test_null_and_repeated_ids(spark):
    base = [f"w{i}" for i in range(60)]
    near = " ".join([*base[:-1], "x"])
    base = " ".join(base)
    rows = [(None, base, "a"), (None, near, "b"), (None, base, "a"), (3, "other text of no relation to any", "a"), (3, "the same id but another text here", "b"),
            (7, near + " y", "a"), (8, "of one id and text twice", "a"), (8, "of one id and text twice", "a"), (8, "of one id and text twice", "b"), (None, None, "a")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in m.near_duplicates(df).collect()), key=str)
    assert got == sorted([(3, 3, True)] * 2 + [(7, 7, True)] + [(8, 8, True)] * 3 + [(None, 7, False)] * 3 + [(None, None, True)], key=str)
    left = sorted(map(tuple, m.drop_duplicates(df).collect()), key=str)
    one = [r for r in left if r[0] == 8]
    assert len(one) == 1 and [r for r in left if r[0] != 8] == sorted([rows[3], rows[4], rows[5], rows[9]], key=str)
    # a group without any id is compared as well, and one of its rows stays
    alone = df.where("doc_id is null and text is not null")
    assert [r.kept for r in m.near_duplicates(alone).collect()] == [True] * 3 and m.drop_duplicates(alone).count() == 1


def test_boilerplate_does_not_chain_documents_together(spark, monkeypatch):
    """Documents that share half their shingles chain in coarse bands; the second sketch takes them apart before sets are shuffled."""
    rng = random.Random(8)
    boiler = [f"b{i}" for i in range(120)]
    texts = {i: " ".join(boiler + [f"w{rng.randrange(10**6)}" for _ in range(90)]) for i in range(150)}
    texts |= {1000 + i: texts[i] + " end" for i in range(10)}
    compared = []
    confirmed = m._confirmed

    def counted(groups, numerator):
        compared.append(sum(r["count"] * (r["count"] - 1) // 2 for r in groups.groupBy("task").count().collect()))
        return confirmed(groups, numerator)

    monkeypatch.setattr(m, "_confirmed", counted)
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in m.near_duplicates(df).collect()}
    assert got == brute(texts)
    assert 10 <= compared[0] < 150 * 149 // 20


def test_clashing_columns(spark):
    names = ["doc_id", "text", "id", "key", "cls", "n", "bands", "row", "_near_id", "component", "kept", "KEPT_2"]
    df = spark.createDataFrame([(i, "a b c d e f g" if i < 3 else "x", *range(10)) for i in range(5)], ", ".join(f"{c} {'string' if c == 'text' else 'int'}" for c in names))
    left = m.drop_duplicates(df)
    assert left.columns == names and sorted(r[0] for r in left.collect()) == [0, 3]
    assert sorted(r.doc_id for r in m.near_duplicates(df).where("kept").collect()) == [0, 3]


def test_query_equals_all_pairs(spark, sf_dir):
    texts = dict(zip(*pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pydict().values()))
    want = brute(texts)
    rows = QUERIES["op7_minhash_dedup"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 1500).astype(np.uint64)
    sets = [np.unique(pool[:1000]), np.unique(pool[100:1000]), np.unique(pool[500:1500]), pool[:1], pool[:3]]
    s = m.sketches(sets)
    assert (s != np.iinfo(np.uint64).max).all()
    assert abs((s[0] == s[1]).mean() - 0.9) < 0.12 and abs((s[0] == s[2]).mean() - 1 / 3) < 0.15
    assert (m.sketches([sets[3]]) == s[3]).all()


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert m.near_duplicates(df).collect() == []


def test_bands_catch_pairs_at_the_threshold():
    assert m.band_width(85) == 5 and m.band_width(80) == 4
    for percent in (70, 80, 85, 90, 95):
        w = m.band_width(percent)
        assert (1 - (percent / 100) ** w) ** (m.BINS // w) <= m.MISS
