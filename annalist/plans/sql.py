"""DuckDB spellings of the registered queries, for comparison only."""

from __future__ import annotations

_TOKENS = """
t AS (SELECT doc_id, regexp_extract_all(regexp_replace(lower(text), '(\\p{Han})', ' \\1 ', 'g'), '[\\p{L}\\p{N}]+') AS t FROM documents),
tok AS (SELECT doc_id, unnest(t) AS tok, CAST(unnest(range(len(t))) AS INT) AS pos FROM t)"""

_LINES = "lines AS (SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> '')"

_PAIRS = f"""{_TOKENS},
lex AS (SELECT tok, count(*) AS cf, min(doc_id) AS doc_id FROM tok WHERE length(tok) >= 5 GROUP BY tok),
pos AS (SELECT CAST(unnest(range(1, 200)) AS INT) AS i),
cut AS (SELECT tok, cf, doc_id, i, substring(tok, 1, i - 1) || substring(tok, i + 1) AS rest FROM lex JOIN pos ON i <= length(tok) WHERE cf = 1 OR cf >= 20),
pairs AS (
  SELECT a.tok AS suspect, b.tok AS candidate, b.cf AS frequency, a.doc_id FROM cut a JOIN lex b ON a.rest = b.tok WHERE a.cf = 1 AND b.cf >= 20
  UNION SELECT a.tok, b.tok, b.cf, a.doc_id FROM lex a JOIN cut b ON a.tok = b.rest WHERE a.cf = 1 AND b.cf >= 20
  UNION SELECT a.tok, b.tok, b.cf, a.doc_id FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i WHERE a.cf = 1 AND b.cf >= 20),
cand AS (SELECT DISTINCT suspect, candidate, frequency, doc_id FROM pairs WHERE suspect <> candidate AND substring(suspect, 1, 1) = substring(candidate, 1, 1))"""

_REPEATS = "SELECT doc_id, pos, tok FROM (SELECT doc_id, pos, tok, lag(tok) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM tok) WHERE tok = prev"


def _count(pattern: str) -> str:
    return f"CAST(len(regexp_extract_all(text, '{pattern}')) AS INT)"


_OPEN = "CAST(length(text) - length(replace(text, '(', '')) AS INT)"
_CLOSE = "CAST(length(text) - length(replace(text, ')', '')) AS INT)"
_PUNCT, _DIGIT, _LOWER = r"[!?.,;:]{2,}", r"\p{L}+\p{N}+\p{L}+", r"[.!?] \p{Ll}"
_NO_STOP = r"CASE WHEN regexp_matches(text, '[.!?]\s*$') THEN 0 ELSE 1 END"

SQL = {
    "p2_page_text": r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
        '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS text FROM pages""",
    "p3_page_metadata": r"""SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title,
        regexp_extract(html, '(?i)<html[^>]*\blang="([^"]*)"', 1) AS html_lang, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages""",
    "p4_exact_duplicates": "SELECT sha256(text) AS text_sha256, min(doc_id) AS kept_doc_id, count(*) AS n_copies FROM documents WHERE text IS NOT NULL GROUP BY sha256(text) HAVING count(*) > 1",
    "p5_archive_inventory": "SELECT source, lang, count(*) AS n_docs, CAST(sum(length(text)) AS BIGINT) AS n_characters FROM documents GROUP BY source, lang",
    "p6_pdf_pages": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL),
        n AS (SELECT doc_id, i, CAST(i // 60 + 1 AS INT) AS page, trim(regexp_replace(line, '[ \t]+', ' ', 'g')) AS line FROM l)
        SELECT doc_id, page, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE line <> ''), '') AS text, CAST(NULL AS VARCHAR) AS error FROM n GROUP BY doc_id, page""",
    "s1_tokenize": f"WITH {_TOKENS} SELECT doc_id, pos, tok FROM tok",
    "s2_postings": f"WITH {_TOKENS} SELECT tok, doc_id, count(*) AS tf FROM tok GROUP BY tok, doc_id",
    "s3_vocabulary": f"WITH {_TOKENS} SELECT tok, count(DISTINCT doc_id) AS df, count(*) AS cf FROM tok GROUP BY tok",
    "s4_boolean_search": f"WITH {_TOKENS} SELECT doc_id FROM t WHERE list_contains(t, 'that') AND NOT list_contains(t, 'ering')",
    "s5_phrase_search": f"""WITH {_TOKENS} SELECT a.doc_id, CAST(count(*) AS INT) AS n_hits FROM tok a JOIN tok b
        ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.tok = 'of' AND b.tok = 'the' GROUP BY a.doc_id""",
    "s6_prefix_search": f"WITH {_TOKENS} SELECT DISTINCT doc_id, tok FROM tok WHERE tok LIKE 'therh%'",
    "s7_ranked_search": f"""WITH {_TOKENS}, dl AS (SELECT doc_id, len(t) AS dl FROM t), stats AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS avgdl FROM dl),
        tf AS (SELECT doc_id, tok, CAST(count(*) AS DOUBLE) AS tf FROM tok WHERE tok IN ('the', 'ering', 'that') GROUP BY doc_id, tok),
        df AS (SELECT tok, CAST(count(*) AS DOUBLE) AS df FROM tf GROUP BY tok)
        SELECT doc_id, round(sum(ln(1.0 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
        FROM tf JOIN df USING (tok) JOIN dl USING (doc_id) CROSS JOIN stats GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 20""",
    "s8_keyword_in_context": r"SELECT doc_id, regexp_extract(text, '(?is)(.{0,20}\bthat\b.{0,20})', 1) AS context FROM documents WHERE regexp_matches(text, '(?i)\bthat\b')",
    "s9_facets": f"WITH {_TOKENS} SELECT lang, source, count(*) AS n_hits FROM documents JOIN t USING (doc_id) WHERE list_contains(t, 'that') GROUP BY lang, source",
    "s10_char_bigrams": r"""WITH r AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS r FROM documents),
        g AS (SELECT DISTINCT doc_id, substring(r, CAST(i AS INT), 2) AS gram FROM (SELECT doc_id, r, unnest(range(1, length(r))) AS i FROM r))
        SELECT gram, count(*) AS df FROM g GROUP BY gram""",
    "s11_fuzzy_term": f"""WITH {_TOKENS}, v AS (SELECT tok, count(DISTINCT doc_id) AS df, count(*) AS cf FROM tok GROUP BY tok HAVING length(tok) BETWEEN 4 AND 6),
        pos AS (SELECT CAST(unnest(range(1, 8)) AS INT) AS i),
        q AS (SELECT i, substring('ering', 1, i - 1) || substring('ering', i + 1) AS rest FROM pos WHERE i <= 5),
        c AS (SELECT tok, i, substring(tok, 1, i - 1) || substring(tok, i + 1) AS rest FROM v JOIN pos ON i <= length(tok)),
        hit AS (SELECT tok FROM v WHERE tok = 'ering' OR tok IN (SELECT rest FROM q) UNION SELECT tok FROM c WHERE rest = 'ering' UNION SELECT tok FROM c JOIN q USING (i, rest))
        SELECT tok, df, cf FROM v WHERE tok IN (SELECT tok FROM hit)""",
    "c1_suspect_terms": f"WITH {_TOKENS} SELECT tok, min(doc_id) AS doc_id FROM tok WHERE length(tok) >= 5 GROUP BY tok HAVING count(*) = 1",
    "c2_correction_candidates": f"WITH {_PAIRS} SELECT suspect, candidate, frequency, doc_id FROM cand",
    "c3_repeated_words": f"WITH {_TOKENS} {_REPEATS}",
    "c4_repeated_lines": f"WITH {_LINES} SELECT doc_id, line, count(*) AS n FROM lines GROUP BY doc_id, line HAVING count(*) > 1",
    "c5_recurring_lines": f"WITH {_LINES} SELECT line, count(DISTINCT doc_id) AS n_docs FROM lines GROUP BY line HAVING count(DISTINCT doc_id) >= 5",
    "c6_repeated_punctuation": f"SELECT doc_id, {_count(_PUNCT)} AS n FROM documents WHERE {_count(_PUNCT)} > 0",
    "c7_bracket_balance": f"SELECT doc_id, {_OPEN} AS n_open, {_CLOSE} AS n_close FROM documents",
    "c8_sentence_checks": f"SELECT * FROM (SELECT doc_id, CAST({_NO_STOP} AS INT) AS no_final_stop, {_count(_LOWER)} AS n_lower_after_stop FROM documents WHERE text IS NOT NULL) WHERE no_final_stop > 0 OR n_lower_after_stop > 0",
    "c9_digit_in_word": f"SELECT doc_id, {_count(_DIGIT)} AS n FROM documents WHERE {_count(_DIGIT)} > 0",
    "c10_proof_report": f"""WITH {_TOKENS}, {_LINES}, rep AS ({_REPEATS}),
        f AS (SELECT doc_id, 'repeated_words' AS rule, CAST(count(*) AS INT) AS n FROM rep GROUP BY doc_id
        UNION ALL SELECT doc_id, 'repeated_lines', CAST(count(*) AS INT) FROM (SELECT doc_id, line FROM lines GROUP BY doc_id, line HAVING count(*) > 1) GROUP BY doc_id
        UNION ALL SELECT doc_id, 'repeated_punctuation', {_count(_PUNCT)} FROM documents
        UNION ALL SELECT doc_id, 'unbalanced_brackets', CAST(abs({_OPEN} - {_CLOSE}) AS INT) FROM documents
        UNION ALL SELECT doc_id, 'no_final_stop', CAST({_NO_STOP} AS INT) FROM documents
        UNION ALL SELECT doc_id, 'lower_after_stop', {_count(_LOWER)} FROM documents
        UNION ALL SELECT doc_id, 'digit_in_word', {_count(_DIGIT)} FROM documents)
        SELECT doc_id, rule, n FROM f WHERE n > 0""",
    "c11_apply_corrections": f"""WITH {_PAIRS}, one AS (SELECT doc_id, suspect, min(candidate) AS candidate FROM cand GROUP BY doc_id, suspect HAVING count(*) = 1),
        built AS (SELECT tok.doc_id, string_agg(coalesce(candidate, tok), ' ' ORDER BY pos) AS corrected_text FROM tok LEFT JOIN one ON one.doc_id = tok.doc_id AND suspect = tok GROUP BY tok.doc_id),
        n AS (SELECT doc_id, count(*) AS n FROM one GROUP BY doc_id)
        SELECT documents.doc_id, coalesce(corrected_text, '') AS corrected_text, CAST(coalesce(n, 0) AS INT) AS n_fixed
        FROM documents LEFT JOIN built USING (doc_id) LEFT JOIN n USING (doc_id)""",
}
