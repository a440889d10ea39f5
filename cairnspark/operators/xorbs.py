"""Reading serialised xorbs: all chunks, one, or a range."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..constants import DATA_KEY
from ..kernels.blake3 import keyed
from ..kernels.codec import FormatError, chunk_at, chunk_range, frames

FRAMES = "chunk_index int, ser_start bigint, ser_end bigint, codec tinyint, packed_size bigint, size bigint"
_KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.int8(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
_NAMES = ["chunk_index", "ser_start", "ser_end", "codec", "packed_size", "size", "data", "error"]
_BATCH_BYTES = 8 << 20


def read_xorb(xorbs: DataFrame, id_col: str = "xorb_hash", payload_col: str = "payload", strict: bool = True, decode: bool = True, wanted: str | None = None) -> DataFrame:
    """One row a stored chunk: id, chunk_index, ser_start, ser_end, codec,
    packed_size, size and, if ``decode``, data.

    ``wanted`` names a column of (chunk_index, chunk_hash) structs: only those
    chunks are decoded and returned, and each that has a hash is held against
    it (HashMismatch).

    Strict: wrong bytes fail the job by the error's name. Else chunks up to the
    fault are kept and a last row carries the name in ``error``; a chunk without
    its hash is a row without data. A null payload has no chunks.
    """
    kind = xorbs.schema[id_col].dataType.simpleString()
    use = [*range(6), *([6] if decode else []), *([] if strict else [7])]

    def checked(rows: list[tuple], hashes: list[bytes | None]) -> list[tuple]:
        """Rows of any number of xorbs, held against their hashes together."""
        known = [k for k, h in enumerate(hashes) if h is not None and rows[k][7] is not None]
        got = keyed(DATA_KEY, [rows[k][7] for k in known])
        bad = {k for k, h in zip(known, got, strict=True) if h != hashes[k]}
        if bad and strict:
            raise FormatError("HashMismatch")
        return [(*r[:7], None, "HashMismatch") if k in bad else r for k, r in enumerate(rows)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []  # place in the batch, then FRAMES, data and error
            hashes: list[bytes | None] = []
            held = 0

            def close(rows: list[tuple], hashes: list[bytes | None], batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                rows = checked(rows, hashes) if wanted else rows
                own = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                return pa.RecordBatch.from_arrays([own, *[pa.array([r[k + 1] for r in rows], _KINDS[k]) for k in use]], [id_col, *[_NAMES[k] for k in use]])

            for i in range(batch.num_rows):
                payload = batch.column(1)[i].as_py()
                if payload is None:
                    continue
                asked = {x["chunk_index"]: x["chunk_hash"] for x in batch.column(2)[i].as_py() or ()} if wanted else {}
                last = max(asked, default=-1)
                try:
                    for f in frames(payload):
                        if wanted and f.index > last:
                            break
                        if wanted and f.index not in asked:
                            continue
                        data = f.data() if decode else None
                        rows.append((i, f.index, f.start, f.end, f.codec, len(f.raw), f.size, data, None))
                        hashes.append(asked.get(f.index))
                        held += f.size if decode else 0
                        if held >= _BATCH_BYTES:
                            yield close(rows, hashes)
                            rows, hashes, held = [], [], 0
                except ValueError as e:
                    if strict:
                        raise
                    rows.append((i, *(None,) * 7, str(e).split(":")[0]))
                    hashes.append(None)
            if rows:
                yield close(rows, hashes)

    fields = f"`{id_col}` {kind}, {FRAMES}" + ", data binary" * decode + ", error string" * (not strict)
    return xorbs.select(id_col, F.col(payload_col).cast("binary").alias("payload"), *[F.col(x) for x in [wanted] if x]).mapInArrow(run, fields)


def read_chunk(xorbs: DataFrame, index: int, id_col: str = "xorb_hash", payload_col: str = "payload", strict: bool = True) -> DataFrame:
    """(id, data) of chunk ``index`` of each xorb, the only one that is decoded.
    A xorb too short raises ChunkNotFound; not strict, there is a third column,
    ``error``. A null payload has null data."""

    @arrow_udf("struct<data: binary, error: string>")
    def run(payloads: pa.Array) -> pa.Array:
        return _tried([(lambda p=p: None if p is None else chunk_at(p, index)) for p in payloads.to_pylist()], strict)

    got = xorbs.select(id_col, run(F.col(payload_col).cast("binary")).alias("r"))
    return got.select(id_col, "r.data") if strict else got.select(id_col, "r.data", "r.error")


def _tried(todo: list[Callable[[], bytes | None]], strict: bool) -> pa.Array:
    out = []
    for f in todo:
        try:
            out.append({"data": f(), "error": None})
        except ValueError as e:
            if strict:
                raise
            out.append({"data": None, "error": str(e).split(":")[0]})
    return pa.array(out, pa.struct([("data", pa.binary()), ("error", pa.string())]))


def extract_range(payload: Column, start: Column, stop: Column, strict: bool = True) -> Column:
    """struct<data, error>: the joined bytes of chunks [start, stop). Errors
    (InvalidRange, RangeOutOfBounds, ...) raise, or come in ``error``."""

    @arrow_udf("struct<data: binary, error: string>")
    def run(payloads: pa.Array, starts: pa.Array, stops: pa.Array) -> pa.Array:
        rows = zip(payloads.to_pylist(), starts.to_pylist(), stops.to_pylist(), strict=True)
        return _tried([(lambda p=p, a=a, b=b: None if p is None or a is None or b is None else chunk_range(p, a, b)) for p, a, b in rows], strict)

    return run(payload.cast("binary"), start.cast("int"), stop.cast("int"))


__all__ = ["FormatError", "extract_range", "read_chunk", "read_xorb"]
