"""Batches of PDF files: page text, splitting, merging."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from annalist.functions.pdf import Pdf, text_pdf, write_pages


def _per_file(files: DataFrame, rows_of: Callable[[bytes], list[dict]], schema: str, id_column: str, content_column: str) -> DataFrame:
    slim = files.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{content_column}`").cast("binary").alias("content"))
    kind = slim.schema["id"].dataType.simpleString()
    shape = StructType.fromDDL(f"id {kind}, {schema}, error string")
    target = to_arrow_schema(shape)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for key, content in zip(batch.column("id").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    rows = rows_of(content) if content is not None else []
                except Exception as e:  # one unreadable file must not end the batch
                    rows = [{"error": f"{type(e).__name__}: {e}"[:300]}]
                yield pa.RecordBatch.from_pylist([{"id": key, **r} for r in rows], schema=target)

    return slim.mapInArrow(run, shape).withColumnRenamed("id", id_column)


def pdf_pages(files: DataFrame, id_column: str = "path", content_column: str = "content") -> DataFrame:
    """One row per page, from 1, with its text; a file that cannot be read gives one row with the error."""

    def rows(content: bytes) -> list[dict]:
        pdf = Pdf(content)
        return [{"page": i, "text": pdf.page_text(p)} for i, p in enumerate(pdf.pages, 1)]

    return _per_file(files, rows, "page int, text string", id_column, content_column)


def texts_to_pdf(documents: DataFrame, lines: int = 60, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id`` and content of a PDF file for each text, some lines to a page; null texts have no file."""
    slim = documents.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text")).where("text is not null")
    kind = slim.schema["id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                content = text_pdf(batch.column("text")[i].as_py(), lines)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, 1), pa.array([content], pa.binary())], names=["id", "content"])

    return slim.mapInArrow(run, f"id {kind}, content binary").withColumnRenamed("id", id_column)


def split_pdf(files: DataFrame, pages_per_part: int = 1, id_column: str = "path", content_column: str = "content") -> DataFrame:
    """One row per part, from 1, with its first page, number of pages and new content."""

    def rows(content: bytes) -> list[dict]:
        pdf = Pdf(content)
        cuts = range(0, len(pdf.pages), pages_per_part)
        return [
            {"part": n, "first_page": a + 1, "n_pages": len(own), "content": write_pages([(pdf, own)])}
            for n, (a, own) in enumerate(((a, pdf.pages[a : a + pages_per_part]) for a in cuts), 1)
        ]

    return _per_file(files, rows, "part int, first_page int, n_pages int, content binary", id_column, content_column)


def merge_pdf(files: DataFrame, by: str, order: str = "path", content_column: str = "content") -> DataFrame:
    """One file per value of ``by``, its files' pages in order. A merged file is one value, so its group is one row here."""
    groups = files.groupBy(F.col(f"`{by}`").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct(F.col(f"`{order}`").alias("o"), F.col(f"`{content_column}`").cast("binary").alias("c")))).alias("parts")
    ).select("id", F.transform("parts", lambda p: p["c"]).alias("contents"))
    kind = groups.schema["id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                content, n, error = None, None, None
                try:
                    pdfs = [Pdf(c) for c in batch.column("contents")[i].as_py() if c is not None]
                    content, n = write_pages([(p, p.pages) for p in pdfs]), sum(len(p.pages) for p in pdfs)
                except Exception as e:  # one unreadable group must not end the batch
                    error = f"{type(e).__name__}: {e}"[:300]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(i, 1), pa.array([n], pa.int32()), pa.array([content], pa.binary()), pa.array([error], pa.string())],
                    names=["id", "n_pages", "content", "error"],
                )

    return groups.mapInArrow(run, f"id {kind}, n_pages int, content binary, error string").withColumnRenamed("id", by)
