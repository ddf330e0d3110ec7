"""Word hashes: different words differ, also those that polynomials modulo 2**64 cannot tell apart."""

import random

import numpy as np
import pytest
from test_minhash_dedup import brute as brute_near
from test_substring_dedup import brute as brute_repeats

from annalist.llm import minhash_dedup, substring_dedup, words


def thue_morse(n):
    """A word of n letters and its complement: the odd and even positions of bits, letter by letter."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_of_all_lengths_differ():
    rng = random.Random(1)
    made = {bytes(rng.choice(b"ab\x00") for _ in range(rng.randrange(1, 40))) for _ in range(4000)}
    made |= {b"a" * n for n in range(1, 70)} | {b"a" + bytes(n) for n in range(20)} | {w.encode() for n in (16, 1024, 4096) for w in thue_morse(n)}
    made = sorted(made)
    hashes, at = words.word_hashes([b" ".join(made), b"", b"\t ", made[0], made[-1]])
    assert at.tolist() == [0, len(made), len(made), len(made), len(made) + 1, len(made) + 2]
    for k in (0, 1):
        assert len(np.unique(hashes[k, : len(made)])) == len(made)
    assert (hashes[:, len(made)] == hashes[:, 0]).all() and (hashes[:, -1] == hashes[:, len(made) - 1]).all()
    assert words.word_hashes([])[0].shape == (2, 0)


@pytest.mark.parametrize("n", [1024, 2048, 5000])
def test_thue_morse_words_neither_repeat_nor_link(spark, n):
    one, other = thue_morse(n)
    lead = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{lead} {one}"), (2, f"{lead} {other}"), (3, f"{one} x y"), (4, f"{other} x y"), (5, f"{lead} {one} z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(df).collect())
    assert got == brute_repeats(rows) and [r[2] for r in got] == [0, 0, 0, 0, 13]
    near = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(df).collect()}
    assert near == brute_near(dict(rows), 85, 3)
