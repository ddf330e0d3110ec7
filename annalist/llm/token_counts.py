"""Token counts: texts are encoded in Arrow functions that return lengths only.

Rows of an Arrow batch are regrouped to batches of about equal bytes, long
texts among them are cut at safe boundaries (see ``tokens``), and no ids leave
the worker. Narrow: no shuffle, any size of input.

Defined results: null counts as empty and has 0 bytes and 0 tokens; special
strings inside texts are handled as the library does by default; repeated rows
are counted each; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm import tokens
from annalist.llm.memory import trimmed

BATCH_BYTES = 1 << 20
LIMIT = 1024
_COUNTERS: dict[str, tokens.ByteLevelCounter] = {}


def count_tokens(
    documents: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text", limit: int = LIMIT, batch_bytes: int = BATCH_BYTES
) -> DataFrame:
    """id, n_bytes, n_tokens and over_limit of each document, for a byte-level vocabulary file."""
    slim = documents.select(F.col(f"`{id_column}`").alias("id"), F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        counter = _COUNTERS.get(vocabulary)
        if counter is None:
            counter = _COUNTERS[vocabulary] = tokens.ByteLevelCounter(vocabulary)
        for batch in batches:
            sizes = pc.binary_length(batch.column("text")).cast(pa.int64())
            counted: list[int] = []
            for a, b in tokens.batches_by_bytes(sizes.to_pylist(), batch_bytes):
                counted += counter.counts(batch.column("text").slice(a, b - a).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), sizes, pa.array(counted, pa.int64()), pa.array([n > limit for n in counted], pa.bool_())],
                names=["id", "n_bytes", "n_tokens", "over_limit"],
            )

    return slim.mapInArrow(trimmed(run), f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean").withColumnRenamed("id", id_column)


def op5(spark, sf_dir: str) -> DataFrame:
    from annalist.sources.tables import table

    return count_tokens(table(spark, sf_dir, "documents"), tokens.vocabulary_path("byte_bpe_50k.json"))
