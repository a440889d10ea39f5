"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()

_local_dirs: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only where that setting is absent and the session has one machine (tests) a
    temporary folder is made; it is removed when the driver's Python ends. A
    cluster without the setting is an error: no folder of its own is shared.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), f"cairnspark-{os.getpid()}-{spark.sparkContext.applicationId}")
    if own not in _local_dirs:
        os.makedirs(own, exist_ok=True)
        _local_dirs.add(own)
        atexit.register(shutil.rmtree, own, True)
    return f"file://{own}"


#: Bytes that a task reads at least where its result is written in between.
TASK_BYTES = 1 << 19


def _tasks(df: DataFrame) -> int:
    """Tasks that the files (by Spark's estimate) behind ``df`` are worth."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    read = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return max(1, -(-read // TASK_BYTES))


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to a fresh Parquet folder in the shared dir and read it back.

    Cuts lineage: a lost executor costs a re-read, never a recomputation. A
    plan that reads little is not run in more tasks than TASK_BYTES allow, so
    small tables do not become as many files as there are shuffle partitions.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    few = _tasks(df)
    writer = (df.coalesce(few) if few < shuffle_partitions(spark) else df).write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def size_of(df: DataFrame) -> int:
    """Bytes of the files behind a freshly materialised table (0 if unknown)."""
    files = df.inputFiles()
    if not files:
        return 0
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    path = jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
    return path.getFileSystem(conf).getContentSummary(path).getLength()


#: Tables of up to so many bytes in memory are broadcast; larger ones shuffle.
BROADCAST_BYTES = 48 << 20
#: Of a hash table: bytes a row and a column; strings come in as a multiple of
#: the bytes they have on disk.
_ROW, _COLUMN, _UNPACKED = 32, 8, 4


def fit(df: DataFrame) -> DataFrame:
    """Broadcast a materialised table if its hash table is within the bound: its
    rows, which Parquet tells, by their width, and what it has of strings."""
    stored = size_of(df)
    if stored > BROADCAST_BYTES:
        return df
    loose = any(not isinstance(f.dataType, (T.NumericType, T.BooleanType)) for f in df.schema)
    held = df.count() * (_ROW + _COLUMN * len(df.columns)) + loose * _UNPACKED * stored
    return F.broadcast(df) if held <= BROADCAST_BYTES else df


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added until no column of ``df`` has them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_bounds(df: DataFrame, col: str, n: int) -> list[int]:
    """At most ``n - 1`` ascending distinct values of ``col`` that cut its rows
    into parts of near-equal row counts. Empty for an empty or all-null column.

    Only the id column is read; the driver receives ``n`` numbers.
    """
    if n < 2:
        return []
    fractions = [i / n for i in range(1, n)]
    got = df.agg(
        F.percentile_approx(col, fractions, max(10_000, 20 * n)).alias("q"), F.min(col).alias("lo")
    ).first()
    return sorted({int(x) for x in got["q"] or [] if x != got["lo"]})


def long_array(values: list[int]) -> Column:
    """A constant array<bigint>, however long, as one folded literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def bucket_of(col: Column, bounds: list[int]) -> Column:
    """How many of the ascending ``bounds`` are <= ``col``: its bucket.

    A native binary search (one folded literal, log2 steps). Null goes to 0.
    """
    if not bounds:
        return F.lit(0)
    steps, step = [], 1
    while step <= len(bounds):
        steps.insert(0, step)
        step *= 2
    cuts = long_array(bounds)
    found = F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, s: F.when(F.get(cuts, at + s - 1) <= col, at + s).otherwise(at),
    )
    return F.when(col.isNull(), F.lit(0)).otherwise(found)


def fold_case(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, ASCII_UPPER, ASCII_LOWER))


#: Rows of an Arrow batch at most, where rows hold whole texts. Spark buffers a
#: batch twice outside its heap, so batches bound what a task needs there.
BATCH_ROWS = 512
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def whole_texts(df: DataFrame, rows: int = BATCH_ROWS) -> DataFrame:
    """``df``, whose rows hold whole texts, about to go to Python: the session's
    Arrow batches are held to ``rows`` rows from now on (Spark reads the setting
    when a plan runs, so it cannot be put back here)."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_BATCH)) <= rows:
        conf.set(_BATCH, str(rows))
    return df


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches in runs of a few rows: Python objects are made of those
    alone, whatever size Spark's batches have."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
