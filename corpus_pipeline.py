"""A training corpus from documents: each stage calls one operator of the llm subpackage.

Every stage takes (spark, docs, sf_dir) and returns a frame; what it returns is
written as Parquet and read again as the next stage's docs. All stages but the
last return the columns of documents, whatever further ones these have and
however those are named.

Defined results, for every stage: an empty table gives an empty table; rows are
decided one by one, so repeated rows and repeated or null ids lose nothing by
being so, but for the near-dedup stage, which leaves one row of each group;
texts of any length are read whole; reruns agree. What null and empty texts
come to is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from annalist.llm import language_id, minhash_dedup, mixing, packing, pii, tokens
from annalist.session import discard, materialize, scratch
from annalist.sources.tables import table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no learned language go: null or empty text, text without a letter, long text unlike all of them. Ties go to the first by name."""
    return language_id.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity of 0.8 or more) the row of the least id stays, null last.

    Null and empty texts, and such without words, are like nothing and stay.
    """
    return minhash_dedup.drop_duplicates(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Addresses, numbers, names and secrets are replaced by their kind, the first where some overlap. Null and empty texts stay as they are."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target draws it, at most twice.

    Null and empty texts have no words, so they are drawn like the small
    documents of their source, and not at all from a source without words. A
    null source is a source.
    """
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their token ids, placed in sequences. Null and empty texts are one piece, the end token; a null source is a queue."""
    return packing.pack(docs, tokens.vocabulary_path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Tokenizers, context trees and sketches are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage wrote for itself, and the table it read, go once its result stands."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch() as own:
            done = own.keep(materialize(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        discard(docs)
        docs = done
    return docs
