"""Small frames whose answers are worked out by hand."""

import pytest

from annalist.operators import organise, proofread, search
from annalist.sources.files import file_manifest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs(spark):
    rows = [
        (1, "The cat sat. The cat ran.", "en", "a", 25),
        (2, "of the of the of", "en", "a", 16),
        (3, None, None, None, None),
        (4, "", "en", "b", 0),
        (5, "地方志编纂", "zh", "b", 5),
        (6, "It it (was so!! fine\nline\nline\n\n\nab1c. lower", "en", "b", 45),
    ]
    return spark.createDataFrame(rows, DOCS)


def found(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_tokens_and_counts(docs):
    assert found(search.tokenize(docs).where("doc_id = 1"), "pos", "tok") == [(0, "the"), (1, "cat"), (2, "sat"), (3, "the"), (4, "cat"), (5, "ran")]
    assert ("the", 1, 2) in found(search.postings(docs), "tok", "doc_id", "tf")
    assert ("the", 2, 4) in found(search.vocabulary(docs), "tok", "df", "cf")
    assert found(search.bigram_index(docs).where("gram rlike '\\\\p{IsHan}'"), "gram", "df") == [("地方", 1), ("志编", 1), ("方志", 1), ("编纂", 1)]


@pytest.fixture
def index(docs, tmp_path):
    return search.write_index(docs, f"file://{tmp_path}/index")


def test_search(docs, index):
    assert found(search.boolean_search(index, ["the"], ["cat"]), "doc_id") == [(2,)]
    assert found(search.boolean_search(index, ["THE"]), "doc_id") == [(1,), (2,)]
    assert found(search.boolean_search(index, [], ["the"]), "doc_id") == [(3,), (4,), (5,), (6,)]
    assert found(search.boolean_search(index, ["the", "absent"]), "doc_id") == []
    assert found(search.phrase_search(index, ["of", "the"]), "doc_id", "n_hits") == [(2, 2)]
    assert found(search.phrase_search(index, ["of", "the", "of"]), "doc_id", "n_hits") == [(2, 2)]
    assert found(search.phrase_search(index, ["The", "cat", "sat"]), "doc_id", "n_hits") == [(1, 1)]
    assert found(search.phrase_search(index, []), "doc_id", "n_hits") == []
    assert found(search.prefix_search(index, "Ca"), "doc_id", "tok") == [(1, "cat")]
    assert [r.doc_id for r in search.ranked_search(index, ["cat"]).collect()] == [1]
    assert search.ranked_search(index, ["?!"]).collect() == []
    assert found(search.facets(index, "the"), "lang", "source", "n_hits") == [("en", "a", 2)]
    assert ("cat",) in found(search.fuzzy_term(index, "Cats"), "tok")


def test_keyword_in_context(spark, docs):
    assert found(search.keyword_in_context(docs, "sat", 4), "doc_id", "context") == [(1, "cat sat. Th")]
    assert found(search.keyword_in_context(docs, "CAT", 3), "doc_id", "context") == [(1, "he cat sa")]
    assert found(search.keyword_in_context(docs, "方志", 1), "doc_id", "context") == [(5, "地方志编")]
    odd = spark.createDataFrame([(1, "see a+(b) there", "", "", 1), (2, "aab", "", "", 1)], DOCS)
    assert found(search.keyword_in_context(odd, "a+(", 2), "doc_id", "context") == [(1, "e a+(b)")]
    assert found(search.keyword_in_context(odd, "", 2), "doc_id") == []


def test_chinese(spark, tmp_path):
    rows = [(1, "本县地方志编纂委员会，1985年成立。", "zh", "a", 1), (2, "志地方", "zh", "a", 1), (3, "the 地方志 of地方志County 地方", "zh", "b", 1), (4, None, "zh", "b", None)]
    docs = spark.createDataFrame(rows, DOCS)
    index = search.write_index(docs, f"file://{tmp_path}/index")
    assert [r.tok for r in search.tokenize(docs).where("doc_id = 3").orderBy("pos").collect()] == ["the", *"地方志", "of", *"地方志", "county", *"地方"]
    assert found(search.boolean_search(index, ["地方志"]), "doc_id") == [(1,), (3,)]
    assert found(search.boolean_search(index, ["地方"], ["委员会"]), "doc_id") == [(2,), (3,)]
    assert found(search.phrase_search(index, ["地方志"]), "doc_id", "n_hits") == [(1, 1), (3, 2)]
    assert found(search.phrase_search(index, ["地方志", "County"]), "doc_id", "n_hits") == [(3, 1)]
    assert [r.doc_id for r in search.ranked_search(index, ["地方志"]).collect()] == [3, 1]
    assert found(search.facets(index, "地方志"), "source", "n_hits") == [("a", 1), ("b", 1)]
    assert found(search.boolean_search(index, ["1985"]), "doc_id") == [(1,)]


def test_a_search_reads_the_partitions_of_its_terms(index):
    plan = search.boolean_search(index, ["the"])._jdf.queryExecution().explainString(index.postings.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "PushedFilters" in plan and "In(tok" in plan or "EqualTo(tok,the)" in plan


def test_proofreading(docs):
    assert found(proofread.repeated_words(docs), "doc_id", "pos", "tok") == [(6, 1, "it"), (6, 6, "line")]
    assert found(proofread.repeated_lines(docs), "doc_id", "line", "n") == [(6, "line", 2)]
    assert found(proofread.recurring_lines(docs, 1).where("line = 'line'"), "n_docs") == [(1,)]
    assert found(proofread.repeated_punctuation(docs), "doc_id", "n") == [(6, 1)]
    assert (6, 1, 0) in found(proofread.bracket_balance(docs.where("text is not null")), "doc_id", "n_open", "n_close")
    assert found(proofread.digit_in_word(docs), "doc_id", "n") == [(6, 1)]
    checks = found(proofread.sentence_checks(docs), "doc_id", "no_final_stop", "n_lower_after_stop")
    assert (6, 1, 2) in checks and 3 not in [c[0] for c in checks]
    report = found(proofread.proof_report(docs).where("doc_id = 6"), "rule", "n")
    assert report == [("digit_in_word", 1), ("lower_after_stop", 2), ("no_final_stop", 1), ("repeated_lines", 1), ("repeated_punctuation", 1), ("repeated_words", 2), ("unbalanced_brackets", 1)]


def test_corrections(spark):
    rows = [(1, " ".join(["chapter"] * 20), "en", "s", 1), (2, "Chaptr one", "en", "s", 1), (3, "chaptexr two", "en", "s", 1), (4, "xhapter", "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    assert found(proofread.correction_candidates(docs), "suspect", "candidate") == [("chaptexr", "chapter"), ("chaptr", "chapter")]
    fixed = {r.doc_id: (r.corrected_text, r.n_fixed) for r in proofread.apply_corrections(docs).collect()}
    assert fixed[2] == ("chapter one", 1) and fixed[3] == ("chapter two", 1) and fixed[4] == ("xhapter", 0)


def test_pages(spark):
    html = '<html lang="zh"><title> T </title><script>var a="</p>";</script><!-- x --><p>a<b>b</b></p></html>'
    pages = spark.createDataFrame([(1, "https://h.example/x", html), (2, None, None)], "page_id bigint, url string, html string")
    assert [r.text for r in organise.page_text(pages).orderBy("page_id").collect()] == ["T a b", None]
    assert tuple(organise.page_metadata(pages).where("page_id = 1").first()) == (1, " T ", "zh", "h.example")


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "b.png").write_bytes(b"\x89PNG\r\n\x1a\n")
    (tmp_path / "c").write_bytes(b"")
    rows = {r.path.rsplit("/", 1)[1]: (r.n_bytes, r.kind) for r in file_manifest(spark, str(tmp_path)).collect()}
    assert rows == {"a.pdf": (10, "pdf"), "b.png": (8, "png")}  # Spark's file scan skips empty files


def test_stream_of_documents(spark, docs, tmp_path):
    from annalist.streaming.proofing import document_stream, proof_stream

    docs.write.parquet(str(tmp_path / "in"))
    query = proof_stream(document_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("findings").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("findings").where("doc_id = 6").count() == 6


def test_empty(spark):
    docs = spark.createDataFrame([], DOCS)
    for f in (search.tokenize, search.vocabulary, proofread.proof_report, proofread.apply_corrections, organise.exact_duplicates, organise.archive_inventory):
        assert f(docs).collect() == []
