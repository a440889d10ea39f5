"""Tree hashes of files and xorbs, streamed over sorted chunk rows.

Only (hash, size) rows are shuffled. A file's rows arrive in order and are
folded as they come; what stays in memory is one batch and, of a file that a
batch cuts, at most nine nodes a tree level.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as c
from ..kernels.blake3 import keyed
from ..kernels.merkle import OpenTree, ends_group, roots
from .packing import in_file_order


def tree_roots(chunks: DataFrame, by: str = "file_id", order: str = "chunk_index") -> DataFrame:
    """(by, root, size, chunk_count): the tree root over each group's chunks.
    Groups without chunks have no row."""
    kind = chunks.schema[by].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_id, tree = None, None
        for batch in batches:
            ids = batch.column(0).to_pylist()
            nodes = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            starts = [i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1]]
            done: list[tuple] = []
            whole: list[tuple] = []
            for s, e in zip(starts, [*starts[1:], len(ids)], strict=True):
                if tree is not None and ids[s] != open_id:
                    done.append((open_id, tree.close(), tree.size, tree.count))
                    tree = None
                if tree is not None or e == len(ids):  # a batch's last group may go on
                    tree = tree or OpenTree()
                    tree.push(nodes[s:e])
                    open_id = ids[s]
                else:
                    whole.append((ids[s], nodes[s:e]))
            for (own, group), root in zip(whole, roots([g for _, g in whole]), strict=True):
                done.append((own, root, sum(n for _, n in group), len(group)))
            if done:
                yield _rows(done, batch.schema.field(0).type)
        if tree is not None:
            yield _rows([(open_id, tree.close(), tree.size, tree.count)], batch.schema.field(0).type)

    rows = in_file_order(chunks.select(by, order, "chunk_hash", "size"), by, order).select(by, "chunk_hash", "size")
    return rows.mapInArrow(run, f"`{by}` {kind}, root binary, size bigint, chunk_count bigint")


def _rows(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    own, root, size, count = zip(*done, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(own, kind), pa.array(root, pa.binary()), pa.array(size, pa.int64()), pa.array(count, pa.int64())], ["0", "root", "size", "chunk_count"])


def file_hashes(chunks: DataFrame, files: DataFrame | None = None, salt: bytes = c.ZERO) -> DataFrame:
    """(file_id, file_hash, file_size, chunk_count) of chunked files. With
    ``files`` (file_id), files without chunks get the zero hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = keyed(salt, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, pa.binary()), batch.column(2), batch.column(3)], ["file_id", "file_hash", "file_size", "chunk_count"])

    kind = chunks.schema["file_id"].dataType.simpleString()
    got = tree_roots(chunks).mapInArrow(run, f"file_id {kind}, file_hash binary, file_size bigint, chunk_count bigint")
    if files is None:
        return got
    zero = F.lit(0).cast("bigint")
    own = files.select("file_id").distinct()
    return own.join(got, "file_id", "left").select("file_id", F.coalesce("file_hash", F.lit(c.ZERO)).alias("file_hash"), F.coalesce("file_size", zero).alias("file_size"), F.coalesce("chunk_count", zero).alias("chunk_count"))


def range_hashes(chunks: DataFrame, by: str = "file_id", order: str = "chunk_index") -> DataFrame:
    """(by, range_hash): the hash over a group's chunk hashes in order. A group
    is a segment of one xorb, so its hashes are some ten thousand at most."""
    from ..functions import ordered_concat, range_hash

    parts = F.collect_list(F.struct(F.col(order).alias("o"), F.col("chunk_hash").alias("data")))
    return chunks.groupBy(by).agg(parts.alias("p")).select(by, range_hash(ordered_concat(F.col("p"))).alias("range_hash"))


def merkle_groups(nodes: DataFrame, by: str = "file_id", order: str = "chunk_index") -> DataFrame:
    """(by, order, chunk_hash, group): which group of the tree's first level
    each node falls into, by the cut rule alone.

    Groups restart where one ends, so the rows are folded as they stream by, in
    order; what is kept between batches is two numbers.
    """
    kinds = [nodes.schema[x].dataType.simpleString() for x in (by, order)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, group = object(), 0, 0
        for batch in batches:
            groups = []
            for file, h in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if file != own:
                    own, held, group = file, 0, 0
                groups.append(group)
                held += 1
                if ends_group(h, held):
                    held, group = 0, group + 1
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(3)], pa.array(groups, pa.int64())], [by, order, "chunk_hash", "group"])

    rows = in_file_order(nodes.select(by, order, "chunk_hash"), by, order)
    return rows.mapInArrow(run, f"`{by}` {kinds[0]}, `{order}` {kinds[1]}, chunk_hash binary, group bigint")
