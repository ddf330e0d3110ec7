"""C: proofreading. Findings and proposals; nothing here overwrites a text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.functions.text import matches, removals, tokens

REPEATED_PUNCTUATION = r"[!?.,;:]{2,}"
# letters from the start of their run, so that a word is tried once and not from each of its letters
DIGIT_IN_WORD = r"(?<!\p{L})\p{L}++\p{N}++\p{L}++"
LOWER_AFTER_STOP = r"[.!?] \p{Ll}"


def _lexicon(documents: DataFrame, min_length: int) -> DataFrame:
    """Terms of some length with their frequency and first document; one combine-friendly shuffle."""
    words = documents.select("doc_id", F.explode(tokens(F.col("text"))).alias("tok")).where(F.length("tok") >= min_length)
    return words.groupBy("tok").agg(F.count("*").alias("cf"), F.min("doc_id").alias("doc_id"))


def suspect_terms(documents: DataFrame, min_length: int = 5) -> DataFrame:
    """Terms that occur once in the whole corpus, and where."""
    return _lexicon(documents, min_length).where("cf = 1").select("tok", "doc_id")


def correction_candidates(documents: DataFrame, min_length: int = 5, min_frequency: int = 20) -> DataFrame:
    """Frequent terms one edit away from a suspect, with the same first character.

    Two different words are one edit apart when leaving one character out of
    one gives the other, or leaving out the same position of both gives the
    same rest. Both are equal keys, so this is a hash join on keys whose number
    is linear in the vocabulary and no pair is compared in vain.
    """
    lexicon = _lexicon(documents, min_length)
    first = lambda w: F.substring(w, 1, 1)

    def keyed(words: DataFrame, whole: str, cut: str) -> DataFrame:
        keys = F.flatten(
            F.array(
                F.array(F.concat(F.lit(whole), F.col("tok"))),
                F.transform(removals(F.col("tok")), lambda x: F.concat(F.lit(cut), x["rest"])),
                F.transform(removals(F.col("tok")), lambda x: F.concat(x["at"].cast("string"), F.lit(":"), x["rest"])),
            )
        )
        return words.select("tok", "cf", "doc_id", F.explode(F.array_distinct(keys)).alias("key"))

    rare = keyed(lexicon.where("cf = 1"), "l:", "r:").select("key", F.col("tok").alias("suspect"), "doc_id")
    common = keyed(lexicon.where(F.col("cf") >= min_frequency), "r:", "l:").select("key", F.col("tok").alias("candidate"), "cf")
    return (
        rare.join(common, "key")
        .where((F.col("suspect") != F.col("candidate")) & (first(F.col("suspect")) == first(F.col("candidate"))))
        .select("suspect", "candidate", F.col("cf").alias("frequency"), "doc_id")
        .distinct()
    )


def _repeated_positions(t: Column) -> Column:
    return F.filter(F.sequence(F.lit(2), F.greatest(F.size(t), F.lit(2))), lambda i: F.try_element_at(t, i) == F.try_element_at(t, i - 1))


def repeated_words(documents: DataFrame) -> DataFrame:
    """Tokens equal to the one before, by position from 0. Found inside each token list, without a window."""
    t = tokens(F.col("text"))
    return (
        documents.where("text is not null").select("doc_id", t.alias("t"))
        .select("doc_id", "t", F.explode(_repeated_positions(F.col("t"))).alias("i"))
        .select("doc_id", (F.col("i") - 1).alias("pos"), F.element_at("t", F.col("i")).alias("tok"))
    )


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")


def repeated_lines(documents: DataFrame) -> DataFrame:
    """C4: non-blank lines that occur more than once in a document."""
    lines = documents.select("doc_id", F.explode(_lines(F.col("text"))).alias("line"))
    return lines.groupBy("doc_id", "line").agg(F.count("*").alias("n")).where("n > 1")


def recurring_lines(documents: DataFrame, min_documents: int = 5) -> DataFrame:
    """Lines found in several documents, such as running headers."""
    lines = documents.select(F.explode(F.array_distinct(_lines(F.col("text")))).alias("line"))
    return lines.groupBy("line").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= min_documents)


def repeated_punctuation(documents: DataFrame) -> DataFrame:
    """Runs of two or more punctuation marks per document."""
    return _counted(documents, "repeated_punctuation")


def bracket_balance(documents: DataFrame) -> DataFrame:
    """Opening and closing brackets of each document."""
    return documents.select("doc_id", _occurrences("(").alias("n_open"), _occurrences(")").alias("n_close"))


def sentence_checks(documents: DataFrame) -> DataFrame:
    """No final full stop, and lower case after a full stop, per document with either; null texts have no findings."""
    return documents.where("text is not null").select(
        "doc_id", _rule_count("no_final_stop").alias("no_final_stop"), _rule_count("lower_after_stop").alias("n_lower_after_stop")
    ).where("no_final_stop > 0 or n_lower_after_stop > 0")


def digit_in_word(documents: DataFrame) -> DataFrame:
    """Digits between letters, a typical recognition error, per document."""
    return _counted(documents, "digit_in_word")


def _occurrences(char: str) -> Column:
    return F.length("text") - F.length(F.replace(F.col("text"), F.lit(char), F.lit("")))


def _rule_count(rule: str) -> Column:
    text = F.col("text")
    if rule == "repeated_words":
        # the one-element array binds the token list, so that it is made once and not once per position
        return F.element_at(F.transform(F.array(tokens(text)), lambda t: F.size(_repeated_positions(t))), 1)
    if rule == "repeated_punctuation":
        return matches(text, REPEATED_PUNCTUATION)
    if rule == "unbalanced_brackets":
        return F.abs(_occurrences("(") - _occurrences(")"))
    if rule == "no_final_stop":
        return F.when(text.rlike(r"[.!?]\s*$"), 0).otherwise(1)
    if rule == "lower_after_stop":
        return matches(text, LOWER_AFTER_STOP)
    return matches(text, DIGIT_IN_WORD)


def _counted(documents: DataFrame, rule: str) -> DataFrame:
    return documents.select("doc_id", _rule_count(rule).alias("n")).where("n > 0")


def proof_findings(documents: DataFrame, rules: tuple[str, ...]) -> DataFrame:
    """Findings of rules that need one document at a time; narrow, so it also runs on streams."""
    found = F.array(*[F.struct(F.lit(r).alias("rule"), _rule_count(r).cast("int").alias("n")) for r in rules])
    return documents.where("text is not null").select("doc_id", F.inline(F.filter(found, lambda x: x["n"] > 0)))


NARROW_RULES = ("repeated_words", "repeated_punctuation", "unbalanced_brackets", "no_final_stop", "lower_after_stop", "digit_in_word")


def proof_report(documents: DataFrame) -> DataFrame:
    """(doc_id, rule, n) over all rules. One narrow pass, and one shuffle for repeated lines."""
    lines = repeated_lines(documents).groupBy("doc_id").agg(F.count("*").cast("int").alias("n"))
    parts = [
        proof_findings(documents, NARROW_RULES),
        lines.select("doc_id", F.lit("repeated_lines").alias("rule"), "n"),
    ]
    return reduce(DataFrame.unionByName, parts)


def apply_corrections(documents: DataFrame, min_length: int = 5, min_frequency: int = 20) -> DataFrame:
    """C11: the token text with every suspect that has exactly one candidate replaced, as a new column.

    A suspect occurs once, so its document is known; the replacements of a
    document become a map and its token list is rewritten in place.
    """
    single = (
        correction_candidates(documents, min_length, min_frequency)
        .groupBy("doc_id", "suspect")
        .agg(F.count("*").alias("n"), F.min("candidate").alias("candidate"))
        .where("n = 1")
    )
    fixes = single.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("suspect", "candidate"))).alias("fix"))
    return documents.join(fixes, "doc_id", "left").select(
        "doc_id",
        F.array_join(F.transform(tokens(F.col("text")), lambda w: F.coalesce(F.try_element_at("fix", w), w)), " ").alias("corrected_text"),
        F.when(F.col("fix").isNull(), 0).otherwise(F.size("fix")).alias("n_fixed"),
    )
