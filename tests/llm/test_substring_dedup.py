import hashlib
import random
import re

import pyarrow.parquet as pq

from annalist.llm import substring_dedup as s
from annalist.llm.queries import QUERIES


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(rows, k=13):
    first = {}
    for doc, text in rows:
        w = split(text)
        for i in range(len(w) - k + 1) if doc is not None else ():
            key = tuple(w[i : i + k])
            first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text in rows:
        w = split(text)
        gone = [False] * len(w)
        for i in range(len(w) - k + 1) if doc is not None else ():
            if first[tuple(w[i : i + k])] < doc:
                gone[i : i + k] = [True] * k
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((doc, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def made():
    rng = random.Random(2)
    word = lambda: rng.choice("abcdefghij") * rng.randrange(1, 4)
    passages = [[word() for _ in range(rng.choice([12, 13, 14, 60]))] for _ in range(6)]
    rows = []
    for i in range(120):
        t = []
        for _ in range(rng.randrange(0, 6)):
            t += [word() for _ in range(rng.randrange(0, 30))] + (rng.choice(passages) if rng.random() < 0.6 else [])
        rows.append((rng.randrange(0, 1000), rng.choice([" ", "\n", " \t "]).join(t)))
    return rows


def test_equal_to_brute_force(spark):
    rows = made()
    long = " ".join(f"w{i}" for i in range(30000))
    rows += [(2000, long), (2001, "x " + long + " y"), (2001, "same id"), (2002, None), (2003, ""), (2004, "é " * 40), (2005, "é " * 14), (None, long), (-5, long[:400])]
    df = spark.createDataFrame([(i, t, 1, "h") for i, t in rows], "doc_id bigint, text string, hi int, gone string")
    got = s.remove_repeats(df).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got], key=str) == brute(rows)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)
    assert s.remove_repeats(df.limit(0)).collect() == []


def test_query_equals_brute_force(spark, sf_dir):
    t = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    rows = QUERIES["op6_substring_dedup"](spark, sf_dir).collect()
    want = brute(list(zip(t["doc_id"], t["text"])))
    assert sorted([tuple(r) for r in rows], key=str) == want and sum(x[2] for x in want) > 0


def longest(text, texts):
    out = []
    for e in range(1, len(text) + 1):
        n = 0
        while n < e and any(text[e - n - 1 : e] == t[i : i + n + 1] for t in texts for i in range(len(t) - n)):
            n += 1
        out.append(n)
    return out


def test_automaton_gives_matching_statistics():
    rng = random.Random(4)
    texts = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(0, 40))] for _ in range(5)]
    machine = s.automaton(texts)
    for _ in range(20):
        text = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(30)]
        assert machine.matching(text) == longest(text, texts)


def test_references(spark, monkeypatch):
    monkeypatch.setattr(s, "SHARD_WORDS", 20)
    passage = " ".join(f"q{i}" for i in range(15))
    refs = spark.createDataFrame([(1, passage), (2, "short one"), (3, None), (4, " ".join(f"r{i}" for i in range(30)))], "item_id int, text string")
    docs = spark.createDataFrame([(1, f"a b {passage} c"), (2, passage[:-4]), (3, None), (4, passage + " " + passage), (5, "q0 r1 " * 20)], "doc_id int, text string")
    got = {r.doc_id: r for r in s.remove_references(docs, refs).collect()}
    assert got[1].kept_text == "a b c" and got[1].spans == ["2:17"] and got[2].kept_text == "" and got[3].n_words == 0
    assert got[4].n_removed == 30 and got[5].n_removed == 0
    # more references than one pass holds, and texts longer than a shard: the same, in several passes
    monkeypatch.setattr(s, "SHARD_WORDS", 5)
    monkeypatch.setattr(s, "PASS_WORDS", 20)
    again = {r.doc_id: r for r in s.remove_references(docs, refs).collect()}
    assert again == got
    assert {tuple(r) for r in s.remove_references(docs, refs.limit(0)).select("doc_id", "n_removed").collect()} == {(i, 0) for i in got}
    assert s.remove_references(docs.limit(0), refs).collect() == []
