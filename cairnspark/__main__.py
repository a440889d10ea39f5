"""Command line: convert files to xorbs, put them into a store, get them out.

    python -m cairnspark convert PATH OUT [--codec lz4] [--algorithm gearhash] [--gear-table FILE]
    python -m cairnspark put PATH STORE NAMESPACE [--codec ...]
    python -m cairnspark list STORE NAMESPACE
    python -m cairnspark get STORE NAMESPACE OUT [--file NAME] [--range START END]

``get`` without ``--file`` brings all files and goes on past those that fail; it
ends with status 1 if any did. Files of over LARGE bytes are written piece by
piece, and one that fails ends the command. Paths are whatever Spark reads; what ``convert``
and ``get`` write goes through pyarrow's file systems.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .constants import CODECS
from .kernels.gear import ALGORITHMS
from .operators import find_file
from .plans import Store, convert_stats, ingest
from .sources import read_files, read_gear_table, write_blobs
from .sources.formats import write_all


#: Files of more bytes than this are not made one cell.
LARGE = 1 << 28


def save_files(files: DataFrame, path: str) -> DataFrame:
    """Write (name, content) rows as files, by the tasks that hold them; rows of
    a name that follow each other are one file. The result (name, size) is
    computed as it is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((n.as_py(), d.as_py()) for b in batches for n, d in zip(b.column(0), b.column(1), strict=True))
        sizes = write_all(path, "", rows)
        yield pa.RecordBatch.from_arrays([pa.array(list(sizes), pa.string()), pa.array(list(sizes.values()), pa.int64())], ["name", "size"])

    return files.select("name", "content").mapInArrow(run, "name string, size bigint")


def _options(spark: SparkSession, args: argparse.Namespace) -> dict:
    table = read_gear_table(spark, args.gear_table) if args.gear_table else None
    return {"codec": args.codec, "algorithm": args.algorithm, "table": table}


def convert(spark: SparkSession, args: argparse.Namespace) -> int:
    files = read_files(spark, args.path)
    done = ingest(files, **_options(spark, args))
    write_blobs(done.xorbs.select("xorb_hash", "payload"), args.out)
    convert_stats(files, done).orderBy("file_id").show(1000, truncate=False)
    return 0


def put(spark: SparkSession, args: argparse.Namespace) -> int:
    root = args.path.rstrip("/") + "/"
    files = read_files(spark, args.path)
    own = F.element_at(F.split("file_id", root.split("://")[-1].lstrip("/"), 2), -1)  # below the folder
    store = Store(spark, args.store)
    store.put(files.withColumn("file_id", own), args.namespace, version=args.version, **_options(spark, args)).select("file_id", "file_size", "chunk_count", "was_inserted").orderBy("file_id").show(1000, truncate=False)
    return 0


def show(spark: SparkSession, args: argparse.Namespace) -> int:
    names = Store(spark, args.store).names().filter(F.col("namespace") == args.namespace)
    names.select("path", "size", F.lower(F.hex("file_hash")).alias("file_hash")).orderBy("path").show(1000, truncate=False)
    return 0


def get(spark: SparkSession, args: argparse.Namespace) -> int:
    store = Store(spark, args.store)
    names = store.names().filter((F.col("namespace") == args.namespace) & (F.col("size") > 0))
    if args.file:
        listed = names.select(F.col("path").alias("ord"), "path", "size", F.hex("file_hash").alias("file_hash_hex"))
        names = find_file(listed, spark.createDataFrame([(args.file,)], "name string")).filter("path is not null").select("path", "size", F.unhex("file_hash_hex").alias("file_hash"))
        if names.isEmpty():
            print(f"no file named {args.file}", file=sys.stderr)
            return 1
    large = names.filter(F.col("size") > (LARGE if not args.range else (1 << 63) - 1))
    wanted = names.join(large.select("file_hash"), "file_hash", "left_anti").select("file_hash").distinct()
    if args.range:
        ranged = wanted.withColumns({"range_start": F.lit(args.range[0]), "range_end": F.lit(args.range[1])})
        got = store.get_range(ranged, strict=False)
    else:
        got = store.get(wanted, strict=False)
    rows = names.select("path", "file_hash").join(got, "file_hash")
    saved = save_files(rows.filter("error is null").select(F.col("path").alias("name"), "content"), args.out)
    n, total = saved.count(), names.count()
    for r in large.select("path", "file_hash").toLocalIterator():  # each is a job of its own
        pieces = store.stream(spark.createDataFrame([(bytes(r["file_hash"]),)], "file_hash binary"))
        n += save_files(pieces.select(F.lit(r["path"]).alias("name"), F.col("data").alias("content")), args.out).count()
    print(f"{n} of {total} files written")
    return int(n < total)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    top = argparse.ArgumentParser(prog="cairnspark", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = top.add_subparsers(required=True)

    def command(name: str, run, *positional: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        p.set_defaults(run=run)
        for x in positional:
            p.add_argument(x)
        if name in ("convert", "put"):
            p.add_argument("--codec", choices=CODECS, default="lz4")
            p.add_argument("--algorithm", choices=sorted(ALGORITHMS), default="gearhash")
            p.add_argument("--gear-table")
        return p

    command("convert", convert, "path", "out")
    command("put", put, "path", "store", "namespace").add_argument("--version", type=int, default=0)
    command("list", show, "store", "namespace")
    p = command("get", get, "store", "namespace", "out")
    p.add_argument("--file")
    p.add_argument("--range", type=int, nargs=2)
    args = top.parse_args(argv)
    return args.run(spark or SparkSession.builder.appName("cairnspark").getOrCreate(), args)


if __name__ == "__main__":
    sys.exit(main())
