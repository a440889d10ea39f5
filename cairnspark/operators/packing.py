"""Chunks into xorbs: the greedy fold, serialisation, and what refers to them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as c
from ..kernels.codec import serialize_xorb
from ..kernels.merkle import roots

#: Bytes and number of built xorbs hashed and handed on together.
_BATCH_BYTES = 8 << 20
_BATCH_XORBS = 4096


def in_file_order(rows: DataFrame, by: str, order: str) -> DataFrame:
    """Rows of a file together and in order; files side by side."""
    return rows.repartition(F.col(by)).sortWithinPartitions(by, order)


def assign_xorbs(chunks: DataFrame, cap: int = c.XORB_CAP, overhead: int = c.CHUNK_HEADER, by: str = "file_id", order: str = "chunk_index") -> DataFrame:
    """(by, chunk_index, chunk_hash, size, xorb_index, xorb_chunk): where each
    chunk goes when a file's chunks are packed greedily, in order.

    A xorb is closed when the next chunk and its ``overhead`` (8 for stored
    sizes, 0 for raw ones) would take it over ``cap``. Only hashes and sizes
    move; they are sorted by Spark (which spills) and folded as they stream by,
    a search a xorb, so a file of any length needs no more than a batch. The
    order is the file's own, so xorbs do not depend on the cluster.
    """
    kind = chunks.schema[by].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, xorb, held, filled = object(), 0, 0, 0
        for batch in batches:
            ids, sizes = batch.column(0).to_pylist(), batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64) + overhead
            upto = np.cumsum(sizes)
            xorbs, places = np.zeros(len(ids), np.int32), np.zeros(len(ids), np.int32)
            starts = [i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1]]
            for s, e in zip(starts, [*starts[1:], len(ids)], strict=True):
                if ids[s] != own:
                    own, xorb, held, filled = ids[s], 0, 0, 0
                at = s
                while at < e:
                    before = int(upto[at - 1]) if at else 0
                    stop = max(at, int(np.searchsorted(upto[:e], before + cap - filled, side="right")))
                    if stop == at:
                        if held:
                            xorb, held, filled = xorb + 1, 0, 0
                            continue
                        stop = at + 1  # larger than the cap: a xorb of its own
                    xorbs[at:stop] = xorb
                    places[at:stop] = np.arange(held, held + stop - at)
                    held, filled, at = held + stop - at, filled + int(upto[stop - 1]) - before, stop
            cols = [*[batch.column(i) for i in range(4)], pa.array(xorbs), pa.array(places)]
            yield pa.RecordBatch.from_arrays(cols, ["file_id", "chunk_index", "chunk_hash", "size", "xorb_index", "xorb_chunk"])

    rows = in_file_order(chunks.select(by, F.col(order).cast("int").alias("chunk_index"), "chunk_hash", F.col("size").cast("bigint").alias("size")), by, "chunk_index")
    return rows.mapInArrow(run, f"`{by}` {kind}, chunk_index int, chunk_hash binary, size bigint, xorb_index int, xorb_chunk int")


def raw_offsets(placed: DataFrame, by: str = "file_id") -> DataFrame:
    """Placed chunks with ``byte_range_start``: the raw bytes before each one in
    its xorb. A window is one xorb, so it is bounded by the cap."""
    w = Window.partitionBy(by, "xorb_index").orderBy("xorb_chunk").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("byte_range_start", F.coalesce(F.sum("size").over(w), F.lit(0)).cast("bigint"))


def build_xorbs(placed: DataFrame, data: DataFrame, codec: str = "lz4", by: str = "file_id") -> DataFrame:
    """Serialised xorbs: (by, xorb_index, xorb_hash, chunk_count,
    total_raw_bytes, serialized_size, payload, chunks).

    ``placed`` comes from :func:`assign_xorbs`, ``data`` has the same (by,
    chunk_index) and the bytes; this is the one shuffle that bytes go through.
    ``chunks`` is an array of (chunk_index, chunk_hash, byte_range_start, size,
    ser_start, ser_end) within the xorb.

    Rows are sorted by Spark and stream by; small xorbs are hashed and handed on
    many at a time. What is held is a batch of rows, a batch of xorbs and one
    xorb.
    """
    kind = placed.schema[by].dataType.simpleString()
    detail = "array<struct<chunk_index: int, chunk_hash: binary, byte_range_start: bigint, size: bigint, ser_start: bigint, ser_end: bigint>>"
    detail_kind = pa.list_(pa.struct([("chunk_index", pa.int32()), ("chunk_hash", pa.binary()), *[(n, pa.int64()) for n in ("byte_range_start", "size", "ser_start", "ser_end")]]))

    def built(done: list[tuple], own_kind: pa.DataType) -> pa.RecordBatch:
        """Whole xorbs as rows; the trees of all are hashed together."""
        own, at, payloads, hashes, spans = zip(*done, strict=True)
        sizes = [[e - s for s, e in zip(r, r[1:], strict=False)] for r in (x[1] for x in spans)]
        chunks = [
            [{"chunk_index": i, "chunk_hash": x, "byte_range_start": raw[i], "size": n[i], "ser_start": s, "ser_end": e} for i, (x, (s, e)) in enumerate(zip(h, ser, strict=True))]
            for h, n, (ser, raw) in zip(hashes, sizes, spans, strict=True)
        ]
        cols = [
            pa.array(own, own_kind),
            pa.array(at, pa.int32()),
            pa.array(roots([list(zip(h, n, strict=True)) for h, n in zip(hashes, sizes, strict=True)]), pa.binary()),
            pa.array([len(h) for h in hashes], pa.int64()),
            pa.array([raw[-1] for _, raw in spans], pa.int64()),
            pa.array([len(p) for p in payloads], pa.int64()),
            pa.array(payloads, pa.binary()),
            pa.array(chunks, detail_kind),
        ]
        return pa.RecordBatch.from_arrays(cols, [by, "xorb_index", "xorb_hash", "chunk_count", "total_raw_bytes", "serialized_size", "payload", "chunks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, own_kind, hashes, datas = None, None, [], []  # the xorb that is open
        done: list[tuple] = []
        held = 0

        def close() -> None:
            nonlocal held, hashes, datas
            payload, ser = serialize_xorb(datas, codec)
            done.append((*own, payload, hashes, (ser, np.cumsum([0, *map(len, datas)]).tolist())))
            held, hashes, datas = held + len(payload), [], []

        for batch in batches:
            own_kind = batch.schema.field(0).type
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            for i, (key, h) in enumerate(zip(keys, batch.column(3).to_pylist(), strict=True)):
                if hashes and key != own:
                    close()
                    if held >= _BATCH_BYTES or len(done) >= _BATCH_XORBS:
                        yield built(done, own_kind)
                        done, held = [], 0
                own = key
                hashes.append(h)
                datas.append(batch.column(4)[i].as_py())
        if hashes:
            close()
        if done:
            yield built(done, own_kind)

    joined = placed.join(data.select(by, "chunk_index", "data"), [by, "chunk_index"])
    rows = joined.select(by, "xorb_index", "xorb_chunk", "chunk_hash", "data").repartition(by, "xorb_index").sortWithinPartitions(by, "xorb_index", "xorb_chunk")
    return rows.mapInArrow(run, f"`{by}` {kind}, xorb_index int, xorb_hash binary, chunk_count bigint, total_raw_bytes bigint, serialized_size bigint, payload binary, chunks {detail}")


def xorb_chunks(xorbs: DataFrame) -> DataFrame:
    """(xorb_hash, chunk_index, chunk_hash, byte_range_start, size, ser_start,
    ser_end): the index of built xorbs, one row a chunk."""
    return xorbs.select("xorb_hash", F.explode("chunks").alias("c")).select("xorb_hash", "c.*")


def file_segments(occurrences: DataFrame, index: DataFrame) -> DataFrame:
    """(file_id, segment_index, xorb_hash, chunk_index_start, chunk_index_end,
    unpacked_segment_size): files as runs of neighbouring chunks of one xorb.

    ``occurrences`` has every chunk of every file (file_id, chunk_index,
    chunk_hash), ``index`` one place a hash (chunk_hash, xorb_hash, xorb_chunk,
    size). The windows are per file, over 50-byte rows, sorted and spilled by
    Spark.
    """
    at = occurrences.select("file_id", "chunk_index", "chunk_hash").join(index.select("chunk_hash", "xorb_hash", "xorb_chunk", "size"), "chunk_hash")
    w = Window.partitionBy("file_id").orderBy("chunk_index")
    follows = (F.lag("xorb_hash").over(w) == F.col("xorb_hash")) & (F.lag("xorb_chunk").over(w) + 1 == F.col("xorb_chunk"))
    runs = at.withColumn("new", F.when(follows, 0).otherwise(1)).withColumn("segment_index", (F.sum("new").over(w) - 1).cast("int"))
    return runs.groupBy("file_id", "segment_index").agg(
        F.min("xorb_hash").alias("xorb_hash"),
        F.min("xorb_chunk").alias("chunk_index_start"),
        (F.max("xorb_chunk") + 1).alias("chunk_index_end"),
        F.sum("size").cast("bigint").alias("unpacked_segment_size"),
    )
