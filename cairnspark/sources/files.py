"""Files as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(file_id, content, file_size) of all files under a path, read by the
    executors; a file is one cell, as Spark's binary reader has it."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select(F.col("path").alias("file_id"), "content", F.col("length").alias("file_size"))


def read_gear_table(spark: SparkSession, path: str) -> str:
    """A byte table from a text file of 256 hexadecimal words, for
    ``table=`` of the chunkers."""
    return " ".join(r["value"] for r in spark.read.text(path).limit(1024).collect())
