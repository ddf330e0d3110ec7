"""R: text recognition in images with a local engine; nothing leaves the cluster."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Engine = Callable[[bytes], Iterable[tuple[int, str, float]]]
PAGES = "array<struct<page:int,text:string,confidence:float>>"


def recognize(files: DataFrame, engine: Callable[[], Engine], id_column: str = "path", content_column: str = "content") -> DataFrame:
    """Id, pages (page, text, confidence) and error of each file.

    ``engine`` makes the caller's recogniser, once per task; the recogniser
    turns a file's bytes to its pages. A file it fails on has no pages and the
    error; a null content has neither. Narrow, so files spread over the cluster.
    """
    slim = files.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{content_column}`").cast("binary").alias("content"))
    kind = slim.schema["id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        read = engine()
        shape = pa.list_(pa.struct([("page", pa.int32()), ("text", pa.string()), ("confidence", pa.float32())]))
        for batch in batches:
            pages, errors = [], []
            for content in batch.column("content"):
                found, error = [], None
                if content.is_valid:
                    try:
                        found = [{"page": p, "text": t, "confidence": c} for p, t, c in read(content.as_py())]
                    except Exception as e:  # one unreadable file must not end the batch
                        error = f"{type(e).__name__}: {e}"[:300]
                pages.append(found)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(pages, shape), pa.array(errors, pa.string())], names=["id", "pages", "error"])

    return slim.mapInArrow(run, f"id {kind}, pages {PAGES}, error string").withColumnRenamed("id", id_column)
