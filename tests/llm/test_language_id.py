import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq

from annalist.llm import language_id as lid
from annalist.llm.queries import QUERIES


def brute_lengths(train, text, order):
    """Code length of a text under each language's tree, by recursion over suffixes."""
    out = []
    for lang in sorted(train):
        tree = defaultdict(Counter)
        for t in train[lang]:
            for i, b in enumerate(t):
                for d in range(min(order, i) + 1):
                    tree[t[i - d : i]][b] += 1

        def p(context, b):
            lower = p(context[1:], b) if context else 1 / 256
            if context and sum(tree[context].values()) < 2:
                return lower
            n, q = sum(tree[context].values()), len(tree[context])
            return (tree[context][b] + q * lower) / (n + q) if n else lower

        out.append(sum(-math.log(p(text[max(0, i - order) : i], b)) for i, b in enumerate(text)))
    return out


def test_tables_equal_recursion(monkeypatch):
    train = {"aa": [b"the cat sat on the mat", b"that hat"], "bb": [b"der hut ist gut", b"das haus", b"x"], "cc": [b"el gato"]}
    counts = {l: lid.ngram_counts(b"\x00" * 3 + (b"\x00" * 3).join(t)) for l, t in train.items()}
    trees = lid.Trees(sorted(train), counts)
    texts = [b"the haus", b"", b"zzz!", b"g", b"das ist ein gato that sat" * 20]
    want = np.array([brute_lengths(train, t, 3) for t in texts])
    assert np.allclose(trees.code_lengths(texts), want, rtol=1e-5)
    monkeypatch.setattr(lid, "BLOCK", 7)
    assert np.allclose(trees.code_lengths(texts), want, rtol=1e-5)


def test_edges(spark):
    schema = "doc_id bigint, text string, lang string, score string, label string"
    rows = [(i, "the cat and the dog are here" if i % 2 else "der hund und die katze sind hier", "en" if i % 2 else "de", "s", "l") for i in range(60)]
    rows += [(100, None, "en", "", ""), (101, "123 ... 漢"[:7], "en", "", ""), (102, "", None, "", ""), (None, "the dog", "en", "", ""), (103, "die katze " * 90000, "de", "", ""), (104, "漢字", None, "", ""), (105, "\x00", "en", "", "")]
    df = spark.createDataFrame(rows, schema)
    trees = lid.train(df)
    got = {r.doc_id: r for r in lid.predict(df, trees, score="sure").collect()}
    assert got[1].lang_pred == "en" and got[2].lang_pred == "de" and got[103].lang_pred == "de" and got[None].lang_pred == "en"
    assert all(got[i].lang_pred == "und" and got[i].sure == 0 for i in (100, 101, 102, 105)) and 0 <= got[104].sure <= 1
    assert lid.predict(df.limit(0), trees).collect() == [] and lid.train(df.limit(0)).languages == []
    assert {r.lang_pred for r in lid.predict(df, lid.train(df.limit(0)), score="sure").collect()} == {"und"}
    assert lid.keep_identified(df, trees).columns == df.columns


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    langs = dict(zip(*pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "lang"]).to_pydict().values()))
    rows = QUERIES["op10_language_id"](spark, sf_dir).collect()
    assert len(rows) == len(langs)
    held = [r for r in rows if r.held_out]
    assert len(held) > 150 and sum(r.lang_pred == langs[r.doc_id] for r in held) / len(held) > 0.98
    assert sum(r.score >= 0.5 for r in rows) > 0.98 * len(rows)


def test_trees_do_not_depend_on_other_languages():
    one = {"aa": [b"the cat sat on the mat"], "bb": [b"der hut ist gut"]}
    many = one | {f"c{i}": [bytes(range(97, 97 + i + 2)) * 3] for i in range(20)}
    made = []
    for train in (one, many):
        trees = lid.Trees(sorted(train), {l: lid.ngram_counts(b"\x00" * 3 + (b"\x00" * 3).join(t)) for l, t in train.items()})
        made.append(trees.code_lengths([b"the hut is gut", b"zz"])[:, :2])
    assert np.array_equal(*made)


def test_foreign_and_clashing(spark):
    """Long text of no learned language goes; short text with a letter and long text of the language stay; names never clash."""
    rng = random.Random(2)
    en = lambda n: " ".join(rng.choice("the cat and dog are here with all of our old friends from school".split()) for _ in range(n))
    odd = "".join(rng.choice("qxzjkvwy") for _ in range(600))
    rows = [(i, en(40), "en", "a", "b", 1, 2.0) for i in range(80)] + [(900, odd, None, "a", "b", 1, 2.0), (901, "Qxz", None, "a", "b", 1, 2.0), (902, en(2000), None, "a", "b", 1, 2.0), (903, "42", "en", "a", "b", 1, 2.0)]
    names = ["doc_id", "text", "lang", "lang_pred", "has_letter", "Score", "bits_per_byte"]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string, lang_pred string, has_letter string, Score int, bits_per_byte double")
    kept = lid.keep_identified(df)
    assert kept.columns == names
    assert {r.doc_id for r in kept.collect()} == set(range(80)) | {901, 902}
    judged = lid.predict(df, lid.train(df))
    assert judged.columns == [*names, "lang_pred_2", "score_2", "bits_per_byte_2"]
    assert {(r.lang_pred, r.lang_pred_2) for r in judged.where("doc_id < 80").collect()} == {("a", "en")}
