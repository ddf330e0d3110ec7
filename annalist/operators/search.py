"""S: full-text search over documents."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.functions.text import tokens


def tokenize(documents: DataFrame) -> DataFrame:
    """One row per token, with its position from 0."""
    return documents.select("doc_id", F.posexplode(tokens(F.col("text"))).alias("pos", "tok"))


def postings(documents: DataFrame) -> DataFrame:
    """Term frequency per term and document."""
    return tokenize(documents).groupBy("tok", "doc_id").agg(F.count("*").alias("tf"))


def vocabulary(documents: DataFrame) -> DataFrame:
    """S3: documents and occurrences of each term, from one count per term and document."""
    return postings(documents).groupBy("tok").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


# --- the index ---------------------------------------------------------------

BUCKETS = 64


class Index(NamedTuple):
    """Tables that searches read instead of the texts.

    ``postings`` has a row for each token: its document and position, and the
    document's length. It is partitioned by a hash of the term and sorted by
    term, document and position, so that it packs well and a search reads the
    partitions of its terms only, and of these the row groups that may hold them. ``documents`` has what searches report
    of a document, ``vocabulary`` the counts of each term by length, ``corpus``
    one row with the number of documents and their mean length.
    """

    postings: DataFrame
    documents: DataFrame
    vocabulary: DataFrame
    corpus: DataFrame


def _bucket(tok: Column) -> Column:
    return F.pmod(F.xxhash64(tok), F.lit(BUCKETS)).cast("int")


def write_index(documents: DataFrame, folder: str) -> Index:
    """Write the index of documents to a folder that all executors share, and open it.

    Rows are dealt by the term's partition and, within it, by document, so
    that a term which most documents have is spread over tasks and files.
    """
    spark = documents.sparkSession
    shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // BUCKETS)
    t = documents.select("doc_id", "lang", "source", tokens(F.col("text")).alias("t"))
    words = t.select("doc_id", F.size("t").alias("dl"), F.posexplode("t").alias("pos", "tok"))
    words = words.withColumn("bucket", _bucket(F.col("tok"))).withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
    rows = words.repartition(BUCKETS * shards, "bucket", "shard").select("tok", "doc_id", "pos", "dl", "bucket")
    rows.sortWithinPartitions("bucket", "tok", "doc_id", "pos").write.partitionBy("bucket").parquet(f"{folder}/postings")
    t.select("doc_id", "lang", "source", F.coalesce(F.size("t"), F.lit(0)).alias("dl")).write.parquet(f"{folder}/documents")
    opened = spark.read.parquet(f"{folder}/postings")
    counts = opened.groupBy("tok", "doc_id").agg(F.count("*").alias("tf")).groupBy("tok").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    counts.withColumn("n", F.length("tok")).repartitionByRange("n", "tok").sortWithinPartitions("n", "tok").write.parquet(f"{folder}/vocabulary")
    spark.read.parquet(f"{folder}/documents").agg(F.count("*").cast("double").alias("n"), F.avg("dl").alias("avgdl")).write.parquet(f"{folder}/corpus")
    return open_index(spark, folder)


def open_index(spark: SparkSession, folder: str) -> Index:
    return Index(*[spark.read.parquet(f"{folder}/{name}") for name in Index._fields])


def parsed(spark: SparkSession, terms: Sequence[str]) -> list[list[str]]:
    """The tokens of each term, as documents have them; several, in succession, where a term is a phrase or of Han characters."""
    if not terms:
        return []
    row = spark.sql("select 1").select(F.array(*[tokens(F.lit(t)) for t in terms])).first()
    return [list(t) for t in row[0]]


def _of_terms(index: Index, toks: Sequence[str]) -> DataFrame:
    """Postings of some terms, from their partitions alone."""
    spark = index.postings.sparkSession
    # the numbers of the partitions are worked out first, for the scan to list no others
    held = spark.sql("select 1").select(F.array(*[_bucket(F.lit(t)) for t in toks])).first()[0] if toks else []
    return index.postings.where(F.col("bucket").isin(sorted(set(held))) & F.col("tok").isin(sorted(set(toks))))


def _hits(index: Index, terms: Sequence[str]) -> tuple[DataFrame, list[list[str]]]:
    """doc_id, dl and how often each term occurs (``tf0``, ``tf1``, ...) in the documents that hold a token of any.

    One shuffle of the postings of the terms' tokens; those of a document are one row each.
    """
    parts = parsed(index.postings.sparkSession, terms)
    toks = sorted({t for p in parts for t in p})
    in_phrase = sorted({t for p in parts if len(p) > 1 for t in p})
    counts = [F.count(F.when(F.col("tok") == t, 1)).cast("int").alias(f"n{i}") for i, t in enumerate(toks)]
    places = [F.collect_list(F.when(F.col("tok") == t, F.col("pos"))).alias(f"p{i}") for i, t in enumerate(in_phrase)]
    rows = _of_terms(index, toks).groupBy("doc_id").agg(F.first("dl").alias("dl"), *counts, *places)

    def times(phrase: list[str]) -> Column:
        if len(phrase) < 2:
            return F.col(f"n{toks.index(phrase[0])}") if phrase else F.lit(0)
        found = F.col(f"p{in_phrase.index(phrase[0])}")
        for k, tok in enumerate(phrase[1:], 1):
            found = F.array_intersect(found, F.transform(f"p{in_phrase.index(tok)}", _back(k)))
        return F.size(found)

    return rows.select("doc_id", "dl", *[times(p).alias(f"tf{i}") for i, p in enumerate(parts)]), parts


def _back(k: int) -> Callable[[Column], Column]:
    return lambda x: x - k


def boolean_search(index: Index, required: Sequence[str], excluded: Sequence[str] = ()) -> DataFrame:
    """Documents with all required terms and no excluded one; without required terms, all documents without the excluded."""
    hits, _ = _hits(index, [*required, *excluded])
    no = reduce(Column.__or__, [F.col(f"tf{i}") > 0 for i in range(len(required), len(required) + len(excluded))], F.lit(False))
    if not required:
        return index.documents.select("doc_id").join(hits.where(no).select("doc_id"), "doc_id", "left_anti")
    yes = reduce(Column.__and__, [F.col(f"tf{i}") > 0 for i in range(len(required))])
    return hits.where(yes & ~no).select("doc_id")


def phrase_search(index: Index, phrase: Sequence[str]) -> DataFrame:
    """Documents holding the terms in succession, and how often they do; a phrase without a token is in none."""
    hits, _ = _hits(index, [" ".join(phrase)])
    return hits.select("doc_id", F.col("tf0").alias("n_hits")).where("n_hits > 0")


def prefix_search(index: Index, prefix: str) -> DataFrame:
    """Terms that begin with a prefix, in any case, and the documents they occur in. Reads the row groups in that range of terms."""
    return index.postings.where(F.col("tok").startswith(prefix.lower())).select("doc_id", "tok").distinct()


def ranked_search(index: Index, terms: Sequence[str], k1: float = 1.2, b: float = 0.75, limit: int = 20) -> DataFrame:
    """BM25, best ``limit`` documents by score, then doc_id.

    The index has the corpus' statistics in one row, and each term's documents
    are counted over the hits; both are joined as single rows.
    """
    hits, _ = _hits(index, terms)
    names = [f"tf{i}" for i in range(len(terms))]
    found = hits.agg(*[F.count(F.when(F.col(n) > 0, 1)).cast("double").alias(f"d{n}") for n in names])
    score = sum(
        (
            F.log(F.lit(1.0) + (F.col("n") - F.col(f"d{n}") + 0.5) / (F.col(f"d{n}") + 0.5))
            * (F.col(n) * (k1 + 1.0))
            / (F.col(n) + k1 * (F.lit(1.0 - b) + b * F.col("dl") / F.col("avgdl")))
            for n in names
        ),
        F.lit(0.0),
    )
    return (
        hits.where(reduce(Column.__or__, [F.col(n) > 0 for n in names], F.lit(False)))
        .crossJoin(F.broadcast(found))
        .crossJoin(F.broadcast(index.corpus.limit(1)))
        .select("doc_id", F.round(score, 6).alias("score"))
        .orderBy(F.desc("score"), "doc_id")
        .limit(limit)
    )


def keyword_in_context(documents: DataFrame, term: str, width: int = 20) -> DataFrame:
    """The first hit of a term, in any case, as written, with up to ``width`` characters on each side."""
    edge = lambda c: r"\b" if c.isascii() and (c.isalnum() or c == "_") else ""
    # what is not a letter, number or underscore may mean something in a pattern
    literal = "".join(c if c.isalnum() or c == "_" else f"\\x{{{ord(c):x}}}" for c in term)
    hit = f"{edge(term[:1])}{literal}{edge(term[-1:])}" if term else r"[^\s\S]"
    return documents.where(F.col("text").rlike(f"(?i){hit}")).select(
        "doc_id", F.regexp_extract("text", f"(?is)(.{{0,{width}}}{hit}.{{0,{width}}})", 1).alias("context")
    )


def facets(index: Index, term: str) -> DataFrame:
    """How many documents with a term there are per language and source."""
    hits, _ = _hits(index, [term])
    return index.documents.join(hits.where("tf0 > 0").select("doc_id"), "doc_id", "left_semi").groupBy("lang", "source").agg(F.count("*").alias("n_hits"))


def bigram_index(documents: DataFrame) -> DataFrame:
    """Document frequency of overlapping character pairs, letters only, for text without word spaces."""
    # a look-ahead takes no characters, so the pairs overlap
    grams = F.array_distinct(F.regexp_extract_all(F.lower(F.col("text")), F.lit(r"(?=(\p{L}{2}))"), F.lit(1)))
    return documents.select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count("*").alias("df"))


def fuzzy_term(index: Index, term: str, distance: int = 1) -> DataFrame:
    """Vocabulary terms within an edit distance of a query term, in any case, from the row groups of its lengths."""
    term = term.lower()
    return (
        index.vocabulary.where(F.col("n").between(len(term) - distance, len(term) + distance))
        .where(F.levenshtein(F.col("tok"), F.lit(term), distance).between(0, distance))
        .select("tok", "df", "cf")
    )
