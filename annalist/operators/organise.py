"""P: organising archive files. HTML pages stand in for PDF pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.functions.text import html_text


def page_text(pages: DataFrame) -> DataFrame:
    """The text of each page. Narrow, one stage; null markup gives null."""
    return pages.select("page_id", html_text(F.col("html")).alias("text"))


def page_metadata(pages: DataFrame) -> DataFrame:
    """Title, language attribute and host of each page; empty where absent."""
    return pages.select(
        "page_id",
        F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1).alias("title"),
        F.regexp_extract("html", r'(?i)<html[^>]*\blang="([^"]*)"', 1).alias("html_lang"),
        F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1).alias("host"),
    )


def exact_duplicates(documents: DataFrame) -> DataFrame:
    """Groups of byte-identical texts, by hash, with the smallest doc_id kept.

    Only the hash and the id are shuffled, after a map-side combine, so a text
    repeated in a third of all rows costs one row per task.
    """
    return (
        documents.where("text is not null")
        .groupBy(F.sha2("text", 256).alias("text_sha256"))
        .agg(F.min("doc_id").alias("kept_doc_id"), F.count("*").alias("n_copies"))
        .where("n_copies > 1")
    )


def archive_inventory(documents: DataFrame) -> DataFrame:
    """P5: documents and characters per source and language."""
    return documents.groupBy("source", "lang").agg(
        F.count("*").alias("n_docs"), F.sum(F.length("text").cast("bigint")).alias("n_characters")
    )
