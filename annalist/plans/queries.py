"""The registered queries: each applies one operator to a whole table."""

from __future__ import annotations

from annalist.operators import organise, pdf, proofread, search
from annalist.session import own_folder
from annalist.sources.files import file_manifest
from annalist.sources.tables import table


def _docs(operator, *args, **options):
    return lambda spark, sf_dir: operator(table(spark, sf_dir, "documents"), *args, **options)


_indexes: dict[tuple[str, str], search.Index] = {}


def index_of(spark, sf_dir: str) -> search.Index:
    """The index of a folder's documents, written once a session and deleted when the application ends."""
    key = (spark._jsparkSession.sessionUUID(), sf_dir)
    if key not in _indexes:
        _indexes[key] = search.write_index(table(spark, sf_dir, "documents"), own_folder(spark, "index"))
    return _indexes[key]


def _indexed(operator, *args):
    return lambda spark, sf_dir: operator(index_of(spark, sf_dir), *args)


def _pages(operator):
    return lambda spark, sf_dir: operator(table(spark, sf_dir, "pages"))


QUERIES = {
    "p1_file_manifest": lambda spark, sf_dir: file_manifest(spark, sf_dir, "*.parquet"),
    "p2_page_text": _pages(organise.page_text),
    "p3_page_metadata": _pages(organise.page_metadata),
    "p4_exact_duplicates": _docs(organise.exact_duplicates),
    "p5_archive_inventory": _docs(organise.archive_inventory),
    "p6_pdf_pages": lambda spark, sf_dir: pdf.pdf_pages(pdf.texts_to_pdf(table(spark, sf_dir, "documents")), id_column="doc_id"),
    "s1_tokenize": _docs(search.tokenize),
    "s2_postings": _docs(search.postings),
    "s3_vocabulary": _docs(search.vocabulary),
    "s4_boolean_search": _indexed(search.boolean_search, ["that"], ["ering"]),
    "s5_phrase_search": _indexed(search.phrase_search, ["of", "the"]),
    "s6_prefix_search": _indexed(search.prefix_search, "therh"),
    "s7_ranked_search": _indexed(search.ranked_search, ["the", "ering", "that"]),
    "s8_keyword_in_context": _docs(search.keyword_in_context, "that"),
    "s9_facets": _indexed(search.facets, "that"),
    "s10_char_bigrams": _docs(search.bigram_index),
    "s11_fuzzy_term": _indexed(search.fuzzy_term, "ering"),
    "c1_suspect_terms": _docs(proofread.suspect_terms),
    "c2_correction_candidates": _docs(proofread.correction_candidates),
    "c3_repeated_words": _docs(proofread.repeated_words),
    "c4_repeated_lines": _docs(proofread.repeated_lines),
    "c5_recurring_lines": _docs(proofread.recurring_lines),
    "c6_repeated_punctuation": _docs(proofread.repeated_punctuation),
    "c7_bracket_balance": _docs(proofread.bracket_balance),
    "c8_sentence_checks": _docs(proofread.sentence_checks),
    "c9_digit_in_word": _docs(proofread.digit_in_word),
    "c10_proof_report": _docs(proofread.proof_report),
    "c11_apply_corrections": _docs(proofread.apply_corrections),
}
