import pytest
from pyspark.sql import functions as F

from annalist.llm import mixing

SCHEMA = "doc_id bigint, text string, source string, size bigint"


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    """Share out, cap, reshare the excess by weight, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, left = {}, share * sum(sizes.values())
    open_ = set(names)
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total > cap * sizes[s]]
        if not over:
            return capped | {s: left * w[s] / total for s in open_}
        for s in over:
            capped[s] = cap * sizes[s]
        left -= sum(cap * sizes[s] for s in over)
        open_ -= set(over)
    return capped


def test_targets_and_copies(spark):
    rows = [(i, "w " * (i % 37), f"s{i % 7}" if i % 11 else None, 1) for i in range(900)]
    rows += [(5000, None, "s1", 2), (5001, "", "s2", 2), (5001, "", "s2", 2), (5002, "x " * 20000, "s3", 1), (None, "a b", "zero", 3), (7, "\t\n", "blank", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.with_copies(df, mixing.word_count(F.col("text"))).collect()
    assert len(got) == len(rows)
    sizes, taken = {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.mix_size
        taken[r.source] = taken.get(r.source, 0) + r.mix_size * r.mix_copies
        assert 0 <= r.mix_copies <= 2
    want = brute_targets(sizes)
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))
    for r in got:
        assert r.mix_target == pytest.approx(want[r.source]) and r.mix_source_size == sizes[r.source]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(r.mix_size for r in got if r.source == s)
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    assert mixed.count() == sum(r.mix_copies for r in got)
    again = mixing.with_copies(df.repartition(3), mixing.word_count(F.col("text"))).collect()
    key = lambda r: (str(r.doc_id), str(r.text), r.mix_copies)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert mixing.with_copies(df, mixing.word_count(F.col("text"))).collect() == []
    blank = spark.createDataFrame([(1, None, None, 1), (2, " ", "a", 1)], SCHEMA)
    assert [r.mix_copies for r in mixing.with_copies(blank, mixing.word_count(F.col("text"))).collect()] == [0, 0]


@pytest.mark.parametrize("seed", range(6))
def test_words_taken_are_near_targets_whatever_the_offset(spark, seed):
    """A few long documents hold most of a source; the short ones make up for what whole copies of them miss."""
    rows = [(i, s, n) for s in ("a", "b", "c", "d") for i, n in enumerate([9000, 4100, 2500, 1700] + [40 + i % 90 for i in range(300)])]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, size bigint")
    got = mixing.with_copies(df, F.col("size"), seed=seed).collect()
    for s in "abcd":
        own = [r for r in got if r.source == s]
        target = own[0].mix_target
        assert abs(sum(r.size * r.mix_copies for r in own) - target) <= max(0.005 * target, 40)


def test_targets_of_many_sources(spark):
    sizes = {f"s{i:04d}": (i * 7919) % 1000 + (500000 if i == 77 else 0) for i in range(1500)}
    got = mixing.source_targets(spark.createDataFrame([("0" + k, n) for k, n in sizes.items()], "key string, source_size bigint")).collect()
    want = brute_targets(sizes)
    assert {r.key[1:]: r.target for r in got} == pytest.approx(want)


def test_clashing_columns(spark):
    names = ["doc_id", "text", "source", "mix_size", "MIX_copies", "size", "key", "row", "band", "place", "copies", "id", "n"]
    df = spark.createDataFrame([(1, "a b", "s", *range(10)), (2, "c", None, *range(10, 20))], ", ".join(f"{c} {'string' if c in ('text', 'source') else 'int'}" for c in names))
    got = mixing.with_copies(df, mixing.word_count(F.col("text")))
    assert got.columns == [*names, "mix_size_2", "mix_source_size", "mix_target", "mix_copies_2"]
    assert sorted(tuple(r)[: len(names)] for r in got.collect()) == sorted(map(tuple, df.collect()))
    mixed = mixing.mix(df)
    assert mixed.columns == names and set(map(tuple, mixed.collect())) <= set(map(tuple, df.collect()))
