import array

import pyarrow.parquet as pq

from annalist.llm import token_counts, tokens
from annalist.llm.queries import QUERIES

EDGES = [
    None, "", " ", "  ", "\n", "\n\n", "\n\n\n a", "a\nb", "a\n\nb", "a \n b", "a  b", "a   b ", " a", "\na", "a\n", "x 's 'S don't DON'T", "İstanbul ΣΑΣ ΟΔΟΣ. é", "é a ́b",
    "<|endoftext|>", "a <|endoftext|> b", "a\n <|endoftext|>  b", "<|ENDOFTEXT|> x", "a.b, c., d.), e). f g h\x85i\x1cj", "1,234. 5 ,6 x_, y×, z÷.", "\x00a\x00 b", "漢字 かな 🙂🙂 ok",
    "tab\tx\t\ty", "z" * 3000, "long" * 40 + " " + "w" * 100, "a\r\nb", "... ,,, ?!. x", "\x00", "word\x00 \x00word", "élève Über straße ÀÉ ŉa ǰ ªº ß ẞ ʼn ǅ İİ ıI µ ſ", " ".join(chr(c) + "x" for c in range(0x80, 0x250)), " ".join("a" + chr(c) for c in range(0x80, 0x250)),
]


def test_counts_equal_the_library(spark, sf_dir):
    path = tokens.vocabulary_path("byte_bpe_50k.json")
    plain = tokens.load(path)
    texts = EDGES + pq.read_table(f"{sf_dir}/documents.parquet")["text"].to_pylist() + EDGES
    rows = [(i, t, 1, 2) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int, id int")
    got = {r.doc_id: r for r in token_counts.count_tokens(df, path, batch_bytes=5000).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        n = len(plain.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 1024), (i, t)
    assert token_counts.count_tokens(df.limit(0), path).collect() == []


def test_ids_equal_the_library(sf_dir):
    path = tokens.vocabulary_path("word_bpe_49k.json")
    plain = tokens.load(path)
    texts = [t or "" for t in EDGES] + pq.read_table(f"{sf_dir}/documents.parquet")["text"].to_pylist()
    for cache in (100, tokens.CACHE):
        encoder = tokens.WordEncoder(path, cache)
        for a in range(0, len(texts), 37):
            for t, ids in zip(texts[a : a + 37], encoder.encode(texts[a : a + 37]), strict=True):
                assert array.array("H", ids).tolist() == plain.encode(t, add_special_tokens=False).ids, t


def test_batches():
    sizes = [5, 1, 1, 100, 1, 1, 1, 9]
    parts = list(tokens.batches_by_bytes(sizes, 10))
    assert parts[0][0] == 0 and parts[-1][1] == 8 and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
    assert all(sum(sizes[a:b]) <= 10 or b - a == 1 for a, b in parts) and list(tokens.batches_by_bytes([], 5)) == []


def test_query_equals_the_library(spark, sf_dir):
    plain = tokens.load(tokens.vocabulary_path("byte_bpe_50k.json"))
    texts = dict(zip(*pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pydict().values()))
    want = {i: (len((t or "").encode()), len(plain.encode(t or "", add_special_tokens=False).ids)) for i, t in texts.items()}
    rows = QUERIES["op5_token_counts"](spark, sf_dir).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in rows} == want and len(rows) == len(want)
    assert all(r.over_limit == (r.n_tokens > 1024) for r in rows)
