import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from annalist.llm import packing, tokens

SCHEMA = "doc_id bigint, text string, source string, part int, ids string"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 900), min_size=1, max_size=6), st.integers(1, 70), st.booleans())
def test_every_token_has_one_place(sizes, window, weighted):
    rates = [1.0 + i for i in range(len(sizes))] if weighted else None
    robin = packing.RoundRobin(sizes, rates, window)
    places = []
    for q, n in enumerate(sizes):
        at = 0
        while at < n:
            step = min(7, n - at)
            for begin, length, place in robin.stretches(q, at, step):
                places += range(place, place + length)
            at += step
    assert sorted(places) == list(range(sum(sizes)))


def test_windows_hold_their_targets():
    sizes = [100_000, 50_000, 7, 1_234]
    robin = packing.RoundRobin(sizes, None, 1000)
    for k in range(robin.windows - 1):
        took = robin.given(k + 1) - robin.given(k)
        assert np.all(np.abs(took - 1000 * np.array(sizes) / sum(sizes)) <= 1)
    robin = packing.RoundRobin([5000, 5000], [3.0, 1.0], 400)
    assert (robin.given(5) == [1500, 500]).all() and robin.given(15)[0] == 4500 and robin.given(20).tolist() == [5000, 3000]


def check(df, rows, vocabulary, sequence):
    plain = tokens.load(vocabulary)
    want = defaultdict(list)
    for doc, text, *_ in rows:
        want[doc].append(plain.encode(text or "", add_special_tokens=False).ids + [2])
    pieces = defaultdict(list)
    filled = defaultdict(list)
    for r in df.collect():
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length > 0
        pieces[r.doc_id].append(r)
        filled[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(want)
    for doc, found in pieces.items():
        total = sum(len(x) for x in want[doc])
        assert sum(r.length for r in found) == total
        if len(want[doc]) == 1:
            found.sort(key=lambda r: r.start)
            assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in found]).tolist() == want[doc][0]
            assert [r.start for r in found] == [sum(x.length for x in found[:i]) for i in range(len(found))]
    short = 0
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= sequence and (at & (at - 1)) == 0
        short += at < sequence
    assert short < sequence.bit_length()


@pytest.mark.parametrize("targets", [None, {"a": 5.0, None: 1.0}])
def test_pack(spark, targets):
    rows = [(i, "word stream " * (i % 40), "ab"[i % 2] if i % 5 else None, 1, "x") for i in range(120)]
    rows += [(500, None, "a", 1, ""), (501, "", "c", 1, ""), (502, "long text, " * 4000, "a", 1, ""), (7, "again", "a", 1, ""), (None, "no id", "b", 1, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    vocabulary = tokens.vocabulary_path("word_bpe_49k.json")
    check(packing.pack(df, vocabulary, targets, sequence=256, window=2048), rows, vocabulary, 256)


def test_more_sources_than_queues(spark, monkeypatch):
    monkeypatch.setattr(packing, "MOST_QUEUES", 3)
    rows = [(i, "w " * (i + 1), f"s{i}", 1, "") for i in range(20)]
    vocabulary = tokens.vocabulary_path("word_bpe_49k.json")
    check(packing.pack(spark.createDataFrame(rows, SCHEMA), vocabulary, sequence=64, window=128), rows, vocabulary, 64)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 300), min_size=1, max_size=9), st.integers(1, 70))
def test_mirror(sizes, window):
    total = sum(sizes)
    mirror, places, owner = packing.Mirror(total, window), [], {}
    for q, n in enumerate(sizes):
        own = []
        for at in range(0, n, 7):
            done = 0
            for begin, length, place in mirror.stretches(sum(sizes[:q]), n, at, min(7, n - at)):
                assert begin == done and length > 0
                done += length
                own += range(place, place + length)
        assert own == sorted(own)
        owner |= dict.fromkeys(own, q)
        places += own
    assert sorted(places) == list(range(total))
    for at in range(0, total, window):
        held = [owner[x] for x in range(at, min(at + window, total))]
        assert all(abs(held.count(q) - len(held) * n / total) < 2 for q, n in enumerate(sizes))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 90), st.integers(1, 9), st.sampled_from([0.0, 0.5, 1.0, 7.0])), min_size=1, max_size=5), st.integers(1, 70))
def test_members_of_classes(classes, window):
    robin = packing.RoundRobin([n * m for n, m, _ in classes], [r * m for _, m, r in classes], window)
    places = []
    for c, (n, m, _) in enumerate(classes):
        for i in range(m):
            own = [place + x for at in range(0, n, 7) for _, length, place in robin.stretches(c, at, min(7, n - at), i, m) for x in range(length)]
            assert own == sorted(own)
            places += own
    assert sorted(places) == list(range(sum(n * m for n, m, _ in classes)))


@pytest.mark.parametrize("targets", [None, {"s3": 400.0, None: 100.0}])
def test_many_sources_keep_their_targets(spark, targets):
    sources, window = 1100, 9 * 512
    names = [f"s{i}" if i else None for i in range(sources)]
    rows = [(i, "word " * (3000 if i in (0, 3) else 9), names[i], 1, "") for i in range(sources)]
    vocabulary = tokens.vocabulary_path("word_bpe_49k.json")
    df = packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(5), vocabulary, targets, sequence=512, window=window).cache()
    check(df, rows, vocabulary, 512)
    sizes, first = defaultdict(int), defaultdict(int)
    for r in df.collect():
        sizes[r.doc_id] += r.length
        at = r.sequence_id * 512 + r.offset
        first[r.doc_id] += max(0, min(at + r.length, window) - at)
    weights = {i: targets.get(names[i], 100.0) for i in range(sources)} if targets else sizes
    assert sum(first.values()) == window
    # weighted windows end where clocks round, so they can miss one token a source
    slack = 2 if targets else 1
    for i, n in sizes.items():
        assert abs(first[i] - window * weights[i] / sum(weights.values())) <= slack


def test_every_full_sequence_mirrors_the_corpus(spark):
    rows = [(i, "word " * (50 + i % 700), f"s{i % 7}", 1, "") for i in range(400)]
    source = {r[0]: r[2] for r in rows}
    sizes, held = defaultdict(int), defaultdict(lambda: defaultdict(int))
    for r in packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(3), tokens.vocabulary_path("word_bpe_49k.json"), keep_ids=False).collect():
        sizes[source[r.doc_id]] += r.length
        held[r.sequence_id][source[r.doc_id]] += r.length
    full = sum(sizes.values()) // packing.SEQUENCE
    assert full > 20
    for k in range(full):
        assert all(abs(held[k][s] - packing.SEQUENCE * n / sum(sizes.values())) < 2 for s, n in sizes.items())


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), tokens.vocabulary_path("word_bpe_49k.json")).collect() == []


def test_query_against_the_library(spark, sf_dir):
    """Every id of every document lies in exactly one piece, sequences are gapless, and full but for powers of two at the end; sources are mixed in each."""
    import zlib
    from collections import Counter, defaultdict

    import pyarrow.parquet as pq

    from annalist.llm import tokens
    from annalist.llm.queries import QUERIES

    plain = tokens.load(tokens.vocabulary_path("word_bpe_49k.json"))
    t = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text", "source"]).to_pydict()
    ids = {i: [*plain.encode(x or "", add_special_tokens=False).ids, 2] for i, x in zip(t["doc_id"], t["text"])}
    source = dict(zip(t["doc_id"], t["source"]))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in QUERIES["op4_packing"](spark, sf_dir).collect():
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert r.length == len(own) > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in own))
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length, source[r.doc_id]))
    assert set(pieces) == set(ids)
    for i, own in pieces.items():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, [*own[1:], (len(ids[i]), 0)]))
    total = Counter()
    for i, x in ids.items():
        total[source[i]] += len(x)
    share = {k: n / sum(total.values()) for k, n in total.items()}
    sizes = []
    for own in sequences.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n, _), (b, _, _) in zip(own, own[1:]))
        sizes.append(sum(n for _, n, _ in own))
        if sizes[-1] == 4096:
            held = Counter()
            for _, n, k in own:
                held[k] += n
            # within a token or two of the corpus' proportions in every full sequence
            assert all(abs(held[k] - 4096 * share[k]) <= 2 for k in share)
    rest = sorted(n for n in sizes if n != 4096)
    assert rest == [1 << k for k in range(12) if sum(sizes) >> k & 1]
