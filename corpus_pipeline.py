"""The corpus pipeline: five of the training-data operators in a row.

All stages take and (but for the last) return the columns of ``documents``; any
other columns pass through unchanged, whatever their names. Each row counts,
repeated ones too; a null id is an id that comes first; an empty table gives no
rows, with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairnspark.llm import best_fit, cross_parsing, line_dedup, simhash, winnowing
from cairnspark.llm.common import materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the others go.

    Null and empty texts, and those without a letter, have none. Where several
    languages fit equally well the first by name is taken, so ties stay. If no
    row has a language to learn from, no row's can be told.
    """
    return cross_parsing.keep_identified(docs, cross_parsing.sample(docs))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier document (or line) has.

    Earlier is by id, then line number. Null texts stay null; a text that loses
    all its lines is empty and stays; rows equal in id and text are one document.
    ``n_chars`` follows the text.
    """
    return line_dedup.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group the document of the smallest id.

    Null, empty and blank texts are one group. Rows that share an id stay or go
    together; rows without an id go if their group has a document with one.
    """
    return simhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark window.

    Null and empty texts hold none. Items that are null or have no word are
    ignored; rows equal in id and text share their verdict.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return winnowing.clean(docs, benchmark)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document that is left, in its training sequence.

    Lengths are words and an end token; null and empty texts are one end token.
    Equal lengths go by id, and equal rows in any order among themselves.
    """
    return best_fit.best_fit(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Language ID, fingerprints and packing are not expressible in SQL; the tests
#: hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
