"""Archive files as rows: what lies in a folder, and of which kind it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Leading bytes (hex) of the file kinds told apart.
MAGIC = (
    ("pdf", "255044462D"),
    ("png", "89504E470D0A1A0A"),
    ("jpeg", "FFD8FF"),
    ("tiff", "49492A00"),
    ("tiff", "4D4D002A"),
    ("zip", "504B0304"),
    ("parquet", "50415231"),
)


def sniffed_kind(content: Column) -> Column:
    """The kind a file's first bytes tell; ``other`` where none fits."""
    head = F.hex(F.substring(content, 1, 8))
    kind = F.lit("other")
    for name, magic in MAGIC:
        kind = F.when(head.startswith(magic), name).otherwise(kind)
    return kind


def read_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)


def file_manifest(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Path, length, modification time, sha256 and sniffed kind of each file; empty files are skipped by Spark's scan."""
    return read_files(spark, folder, glob).select(
        "path",
        F.col("length").alias("n_bytes"),
        "modificationTime",
        F.sha2("content", 256).alias("sha256"),
        sniffed_kind(F.col("content")).alias("kind"),
    )
