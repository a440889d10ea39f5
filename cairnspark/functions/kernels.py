"""Functions that need a byte kernel: Arrow UDFs, a batch at a time."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BinaryType

from .. import constants as c
from ..kernels import bits
from ..kernels.blake3 import keyed
from ..kernels.gear import cut, table_of
from .columns import is_zero_key


def _hashing(key: bytes) -> Callable:
    @arrow_udf("binary")
    def run(data: pa.Array) -> pa.Array:
        rows = data.to_pylist()
        at = [i for i, x in enumerate(rows) if x is not None]
        for i, h in zip(at, keyed(key, [bytes(rows[i]) for i in at]), strict=True):
            rows[i] = h
        return pa.array(rows, pa.binary())

    return run


def _binary(data: Column) -> Column:
    return data.cast("binary")


def keyed_hash(key: bytes, data: Column) -> Column:
    """Keyed BLAKE3-256 of binary data; null stays null."""
    return _hashing(key)(_binary(data))


def data_hash(data: Column) -> Column:
    """The hash of a chunk's bytes."""
    return keyed_hash(c.DATA_KEY, data)


def node_hash(text: Column) -> Column:
    """The hash of an inner tree node's text."""
    return keyed_hash(c.NODE_KEY, text)


def range_hash(hashes: Column) -> Column:
    """The hash over concatenated chunk hashes."""
    return keyed_hash(c.RANGE_KEY, hashes)


def file_hash_of_root(root: Column, salt: bytes = c.ZERO) -> Column:
    return keyed_hash(salt, root)


@arrow_udf(BinaryType())
def _by_own_key(data: pa.Array, key: pa.Array) -> pa.Array:
    rows, keys = data.to_pylist(), key.to_pylist()
    groups: dict[bytes, list[int]] = {}
    for i, (x, k) in enumerate(zip(rows, keys, strict=True)):
        if x is not None and k is not None:
            groups.setdefault(bytes(k), []).append(i)
    out: list[bytes | None] = [None] * len(rows)
    for k, at in groups.items():
        for i, h in zip(at, keyed(k, [bytes(rows[i]) for i in at]), strict=True):
            out[i] = h
    return pa.array(out, pa.binary())


def keyed_chunk_hash(h: Column, key: Column) -> Column:
    """A chunk hash as a keyed shard stores it; unchanged under the zero key."""
    return F.when(is_zero_key(key), h).otherwise(_by_own_key(h, key))


def chunk_bounds(data: Column, algorithm: str = "gearhash", least: int = c.MIN_CHUNK, most: int = c.MAX_CHUNK, bits: int = c.CUT_BITS, table: str | None = None) -> Column:
    """array<struct<start, end>> tiling the bytes; empty for empty or null."""
    words = table_of(table)

    @arrow_udf("array<struct<start: bigint, end: bigint>>")
    def run(rows: pa.Array) -> pa.Array:
        out = []
        for x in rows.to_pylist():
            ends = cut(bytes(x), algorithm, least, most, bits, words) if x else []
            out.append([{"start": a, "end": b} for a, b in zip([0, *ends], ends, strict=False)])
        return pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))

    return run(_binary(data))


def compress_chunk(data: Column, codec: str = "lz4") -> Column:
    """struct<data, codec>: the codec kept is 0 where packing does not help."""
    bits.codec_number(codec)

    @arrow_udf("struct<data: binary, codec: tinyint>")
    def run(rows: pa.Array) -> pa.Array:
        out = []
        for x in rows.to_pylist():
            packed, number = bits.compress(bytes(x), codec) if x is not None else (None, None)
            out.append({"data": packed, "codec": number})
        return pa.array(out, pa.struct([("data", pa.binary()), ("codec", pa.int8())]))

    return run(_binary(data))


def decompress_chunk(data: Column, codec: Column, size: Column, strict: bool = True) -> Column:
    """The bytes of a stored chunk; wrong ones raise, or give null."""

    @arrow_udf("binary")
    def run(rows: pa.Array, codecs: pa.Array, sizes: pa.Array) -> pa.Array:
        out = []
        for x, k, n in zip(rows.to_pylist(), codecs.to_pylist(), sizes.to_pylist(), strict=True):
            try:
                out.append(None if x is None or k is None or n is None else bits.decompress(bytes(x), k, n))
            except bits.CodecError:
                if strict:
                    raise
                out.append(None)
        return pa.array(out, pa.binary())

    return run(_binary(data), codec, size)


@arrow_udf(BinaryType())
def _floats(rows: pa.Array) -> pa.Array:
    return pa.array([None if x is None else np.array(x, "<f4").tobytes() for x in rows.to_pylist()], pa.binary())


def float_bytes(values: Column) -> Column:
    """An array of numbers as little-endian 32-bit floats (nulls as NaN)."""
    return _floats(values)


_TRANSFORMS = {"bg4": bits.group4, "bg4_inverse": bits.ungroup4, "fbs": bits.slice_bits, "fbs_inverse": bits.unslice_bits}


def transform_bytes(data: Column, name: str) -> Column:
    """A byte transform: bg4, fbs, or the inverse of either."""
    step = _TRANSFORMS[name]

    @arrow_udf("binary")
    def run(rows: pa.Array) -> pa.Array:
        return pa.array([None if x is None else step(bytes(x)) for x in rows.to_pylist()], pa.binary())

    return run(_binary(data))


def register(spark: SparkSession) -> None:
    """Make the kernels callable from SQL: cas_data_hash, cas_node_hash,
    cas_range_hash, cas_bg4, cas_bg4_inverse, cas_fbs, cas_fbs_inverse,
    cas_chunk_bounds."""
    for name, key in (("data", c.DATA_KEY), ("node", c.NODE_KEY), ("range", c.RANGE_KEY)):
        spark.udf.register(f"cas_{name}_hash", _hashing(key))

    def transform(step: Callable[[bytes], bytes]) -> Callable:
        @arrow_udf("binary")
        def run(rows: pa.Array) -> pa.Array:
            return pa.array([None if x is None else step(bytes(x)) for x in rows.to_pylist()], pa.binary())

        return run

    for name, step in _TRANSFORMS.items():
        spark.udf.register(f"cas_{name}", transform(step))

    @arrow_udf("array<bigint>")
    def bounds(rows: pa.Array) -> pa.Array:
        return pa.array([cut(bytes(x)) if x else [] for x in rows.to_pylist()], pa.list_(pa.int64()))

    spark.udf.register("cas_chunk_bounds", bounds)
