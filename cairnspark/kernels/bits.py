"""Byte transforms and compression."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ..constants import CODECS


def group4(data: bytes) -> bytes:
    """Bytes by position modulo four: all of plane 0, then 1, 2 and 3."""
    return b"".join(data[i::4] for i in range(4))


def ungroup4(data: bytes) -> bytes:
    out, at = np.empty(len(data), np.uint8), 0
    src = np.frombuffer(data, np.uint8)
    for i in range(4):
        n = len(out[i::4])
        out[i::4] = src[at : at + n]
        at += n
    return out.tobytes()


def slice_bits(data: bytes) -> bytes:
    """Bit planes, lowest first: output bit k is bit k // n of byte k % n."""
    bits = np.unpackbits(np.frombuffer(data, np.uint8)[:, None], axis=1, bitorder="little")
    return np.packbits(bits.T.ravel(), bitorder="little").tobytes()


def unslice_bits(data: bytes) -> bytes:
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little").reshape(8, -1)
    return np.packbits(bits.T, axis=1, bitorder="little").tobytes()


_lz4 = pa.Codec("lz4")
_BEFORE = {"lz4": bytes, "bg4": group4, "fbs": slice_bits}
_AFTER = {"lz4": bytes, "bg4": ungroup4, "fbs": unslice_bits}


class CodecError(ValueError):
    """Bytes that a codec cannot have made."""


def codec_number(name: str) -> int:
    if name not in CODECS:
        raise CodecError(f"InvalidCompressionType: {name}")
    return CODECS.index(name)


def compress(data: bytes, codec: str = "lz4") -> tuple[bytes, int]:
    """(bytes, codec number): stored as they are (0) unless it is smaller."""
    number = codec_number(codec)
    if number and data:
        packed = _lz4.compress(_BEFORE[codec](data), asbytes=True)
        if len(packed) < len(data):
            return packed, number
    return data, 0


def decompress(data: bytes, number: int, size: int) -> bytes:
    """The ``size`` bytes that were compressed."""
    if not 0 <= number < len(CODECS):
        raise CodecError(f"InvalidCompressionType: {number}")
    if number == 0:
        if len(data) != size:
            raise CodecError("InvalidUncompressedSize")
        return data
    try:
        plain = _lz4.decompress(data, decompressed_size=size, asbytes=True)
        # the frame has to end with the payload, at exactly this size
        if len(plain) != size or pa.input_stream(pa.py_buffer(data), compression="lz4").read(size + 1) != plain:
            raise CodecError("InvalidUncompressedSize")
    except (OSError, pa.ArrowInvalid) as e:
        raise CodecError(f"DecompressionFailed: {e}") from e
    return _AFTER[CODECS[number]](plain)
