"""The catalog of named files, and inserts that tell what was new."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def file_list(entries: DataFrame) -> DataFrame:
    """Listing entries (ord, type, path, size, file_hash_hex) reduced to files;
    a missing size is 0, a missing hash stays null."""
    files = entries.filter(F.col("type") == "file")
    return files.select("ord", "path", F.coalesce("size", F.lit(0)).cast("bigint").alias("size"), "file_hash_hex")


def find_file(files: DataFrame, names: DataFrame) -> DataFrame:
    """For each row of ``names`` (name): the first file in list order whose
    path is the name or ends with it. (name, path, size, file_hash_hex), null
    where there is none.

    A name is cut before its first ``/`` into the end of one path segment and a
    rest of whole segments (none for a bare name). Paths are cut likewise, at
    each of their segments, and reduced to the first of each (segment, rest), so
    a file name that every folder has is one row; then to the ends of segments
    as long as those asked for (a rest asks for a few lengths, and a segment has
    at most 255), which meet the names by equality.
    """
    wanted = names.select("name").distinct().withColumn("rest", F.regexp_extract("name", "/(.*)$", 1)).withColumn("bare", ~F.contains("name", F.lit("/")))
    wanted = wanted.withColumn("end", F.substring_index("name", "/", 1)).withColumn("n", F.length("end"))
    at = F.struct("ord", "path", "size", "file_hash_hex")
    parts = F.split("path", "/")
    cuts = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.struct(F.get(parts, i - 1).alias("segment"), F.array_join(F.slice(parts, i + 1, F.size(parts)), "/").alias("rest"), (i == F.size(parts)).alias("bare")),
    )
    listed = files.filter("path is not null").select(at.alias("f"), F.explode(cuts).alias("c")).groupBy("c.segment", "c.rest", "c.bare").agg(F.min("f").alias("f"))

    def ends(rows: DataFrame, lengths: DataFrame, on: list[str]) -> DataFrame:
        rows = rows.join(lengths, on).withColumn("n", F.explode("ns")).filter(F.length("segment") >= F.col("n"))
        return rows.groupBy("rest", "bare", F.expr("right(segment, n)").alias("end")).agg(F.min("f").alias("f"))

    # of bare names there is one set of lengths, in one row
    bare = ends(listed.filter("bare"), F.broadcast(wanted.filter("bare").groupBy("bare").agg(F.collect_set("n").alias("ns"))), ["bare"])
    deep = ends(listed.filter("not bare"), wanted.filter("not bare").groupBy("rest").agg(F.collect_set("n").alias("ns")), ["rest"])
    first = wanted.join(bare.union(deep), ["rest", "bare", "end"]).select("name", "f")
    return names.select("name").join(first, "name", "left").select("name", "f.path", "f.size", "f.file_hash_hex")


def catalog_lookup(catalog: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (namespace, path) with size, file_hash_hex and error:
    NotFound (no entry, or none with a hash) or InvalidResponse (no size)."""
    got = requests.join(catalog.select("namespace", "path", "size", "file_hash_hex", F.lit(True).alias("__hit")), ["namespace", "path"], "left")
    error = F.when(F.col("__hit").isNull(), "NotFound").when(F.col("size").isNull(), "InvalidResponse").when(F.col("file_hash_hex").isNull(), "NotFound")
    return got.select("namespace", "path", "size", "file_hash_hex", error.alias("error"))


def latest_entries(entries: DataFrame) -> DataFrame:
    """Registrations (namespace, path, size, file_hash_hex, mtime, version) as
    a catalog: per path the one of the highest version (ties: highest mtime)."""
    at = F.struct("size", "file_hash_hex", "mtime", "version")
    got = entries.groupBy("namespace", "path").agg(F.max_by(at, F.struct("version", "mtime")).alias("e"))
    return got.select("namespace", "path", "e.size", "e.file_hash_hex", "e.mtime")


def ensure_namespace(known: DataFrame, asked: DataFrame) -> DataFrame:
    """Namespaces after an idempotent create: (namespace, created). A name
    without ``/`` raises InvalidNamespace."""
    name = F.when(F.col("namespace").contains("/"), F.col("namespace")).otherwise(F.raise_error(F.lit("InvalidNamespace")).cast("string"))
    new = asked.select(name.alias("namespace")).distinct().join(known.select("namespace"), "namespace", "left_anti")
    return known.select("namespace").distinct().withColumn("created", F.lit(False)).union(new.withColumn("created", F.lit(True)))


def put_if_absent(store: DataFrame, rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The rows with ``was_inserted``: true for the first row (by ``order``) of
    a key that the store lacks; of rows equal in all of these for one. What to
    append is the rows that have it. A null key is a key like any other."""
    first = rows.groupBy(key).agg(F.min(F.struct(*order)).alias("__first")).withColumnRenamed(key, "__of")
    held = store.select(F.col(key).alias("__key"), F.lit(True).alias("__held")).distinct()
    own = Window.partitionBy(key, *order).orderBy(F.lit(0))  # rows that repeat, no hot key's
    got = rows.withColumn("__copy", F.row_number().over(own))
    got = got.join(first, F.col(key).eqNullSafe(F.col("__of"))).join(held, F.col(key).eqNullSafe(F.col("__key")), "left")
    new = F.col("__held").isNull() & F.struct(*order).eqNullSafe(F.col("__first")) & (F.col("__copy") == 1)
    return got.withColumn("was_inserted", new).drop("__of", "__first", "__key", "__held", "__copy")


def registration_lines(entries: DataFrame) -> DataFrame:
    """(line): one JSON record an entry, as a registration request has them."""
    row = F.struct(F.lit("addFile").alias("type"), "path", F.col("file_hash_hex").alias("xetHash"), F.lit(0).alias("mtime"))
    return entries.select(F.to_json(row).alias("line"))


def numbered(entries: DataFrame, order: list[str]) -> DataFrame:
    """Entries with ``ord``, their place in list order, per namespace."""
    return entries.withColumn("ord", F.row_number().over(Window.partitionBy("namespace").orderBy(*order)).cast("bigint"))
