import numpy as np
import pyarrow.parquet as pq
import pytest

from annalist.llm import embedding_dedup as e
from annalist.llm.queries import QUERIES


def brute(ids, x, cosine=0.9):
    x = np.array(x, np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    label = list(ids)
    changed = True
    while changed:
        changed = False
        for i in range(len(ids)):
            low = min([label[i]] + [label[j] for j in np.flatnonzero(near[i])])
            if low < label[i]:
                label[i], changed = low, True
    return {i: (int(near[k].sum()), label[k]) for k, i in enumerate(ids)}


def test_query_equals_all_pairs(spark, sf_dir):
    t = pq.read_table(f"{sf_dir}/embeddings.parquet")
    want = brute(t["vec_id"].to_pylist(), t["embedding"].to_pylist())
    rows = QUERIES["op9_embedding_dedup"](spark, sf_dir).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in rows} == want and len(rows) == len(want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows)


@pytest.mark.parametrize("block", [4096, 50])
def test_edges_and_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(e, "BLOCK", block)
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((20, 32))
    x = [centres[i % 20] + rng.standard_normal(32) * rng.choice([0.05, 0.3, 0.5]) for i in range(260)]
    x += [x[0], x[0], x[1] * 100, -x[2]]
    x = [[float(np.float32(c)) for c in v] for v in x]
    ids = [i * 7 for i in range(len(x))]
    want = brute(ids, x)
    odd = [(5001, None), (5002, []), (5003, [0.0] * 32), (5004, [None] + [1.0] * 31), (5005, [float("nan")] + [1.0] * 31), (5006, [float("inf")] * 32), (5007, [1.0, 2.0]), (5008, [1.0, 2.1]), (5009, [1.0])]
    df = spark.createDataFrame([(i, v, 1, "c") for i, v in zip(ids, x)] + [(i, v, 1, "c") for i, v in odd], "vec_id bigint, embedding array<float>, label int, cls string")
    got = {r.vec_id: r for r in e.near_duplicates(df).collect()}
    assert len(got) == len(x) + len(odd)
    for i in ids:
        assert (got[i].n_links, got[i].component_id) == want[i]
    assert all(got[i].n_links == 0 and got[i].kept for i in (5001, 5002, 5003, 5004, 5005, 5006, 5009))
    assert got[5008].component_id == 5007 and got[5007].n_links == 1
    assert e.near_duplicates(df.limit(0)).collect() == []


@pytest.mark.parametrize("cosine", [0.5, 0.7, 0.9, 0.99])
@pytest.mark.parametrize("dimension", [2, 3, 8, 64, 300])
def test_recall_at_the_threshold(cosine, dimension):
    """Every pair just above the threshold is found, in any dimension: none of the windows is clipped."""
    rng = np.random.default_rng(9)
    n = 1000
    x = rng.standard_normal((n, dimension))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((n, dimension))
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    c = cosine + 1e-6
    both = np.concatenate([x, c * x + np.sqrt(1 - c * c) * y])
    both /= np.linalg.norm(both, axis=1, keepdims=True)
    near = both @ both.T >= cosine
    np.fill_diagonal(near, False)
    linked, at = e.links(both, np.ones(2 * n, np.int64), np.zeros(2 * n, np.int64), cosine)
    assert (linked == near.sum(axis=1)).all()
    halves = np.repeat([1, 2], n)
    linked, _ = e.links(both, np.ones(2 * n, np.int64), halves, cosine)
    assert (linked == (near & (halves[:, None] != halves[None, :])).sum(axis=1)).all()


def test_counters_add_up():
    rng = np.random.default_rng(3)
    sets = rng.integers(0, 2, (e.PROJECTIONS, 640), np.uint8)
    packed = [np.packbits(s, bitorder="little").view(np.uint64) for s in sets]
    counters = e._added(packed, e.PROJECTIONS.bit_length())
    for least in (0, 1, 20, 24, 31, e.PROJECTIONS):
        got = np.unpackbits(e._at_least(counters, least).view(np.uint8), bitorder="little")
        assert (got == (sets.sum(axis=0) >= least)).all()


def test_windows_hold_the_sorted_neighbours():
    rng = np.random.default_rng(4)
    cells = rng.integers(0, e.CELLS, (3, 200))
    prefixes = e._prefixes(cells)
    for p in range(3):
        for lo, hi in ((0, e.CELLS), (5, 9), (100, 101)):
            bits = np.unpackbits((prefixes[p, hi] ^ prefixes[p, lo]).view(np.uint8), bitorder="little")[:200]
            assert (bits == ((cells[p] >= lo) & (cells[p] < hi))).all()


def test_cosine_at_the_threshold_does_not_depend_on_the_tile(spark):
    """(9, sqrt(19)) against (1, 0) has the cosine 0.9 but for rounding; vectors of whole numbers have it exactly."""
    x = [[3.0, 4.0, 0.0], [6.0, 8.0, 0.0], [9.0, 2.0, 3.873], [1e30, 0.0, 0.0], [1e-30, 0.0, 0.0], [4.0, 3.0, 0.0]]
    df = spark.createDataFrame(list(enumerate(x)), "vec_id int, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in e.near_duplicates(df, cosine=0.96).collect()}
    assert got[0] == (2, 0) and got[1] == (2, 0) and got[5] == (2, 0) and got[3] == (1, 3) and got[4] == (1, 3)
