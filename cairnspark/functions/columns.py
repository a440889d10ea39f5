"""Functions that are plain Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import CODECS, XORB_VERSION

_GROUPS = (1, 9, 17, 25)


def _backwards(data: Column, start: int, n: int) -> Column:
    """``n`` bytes from ``start`` (1-based) in reverse. (``reverse`` would keep
    what looks like a UTF-8 character together.)"""
    return F.concat(*[F.substring(data, start + n - 1 - i, 1) for i in range(n)])


def api_hex(h: Column) -> Column:
    """A 32-byte hash as text: each 8-byte word reversed, in lower-case hex."""
    return F.lower(F.hex(F.concat(*[_backwards(h, i, 8) for i in _GROUPS])))


def from_api_hex(text: Column, strict: bool = True) -> Column:
    """The hash of its text. Other lengths or digits raise, or give null where
    not ``strict``; null stays null."""
    raw = F.unhex(text)
    words = F.concat(*[_backwards(raw, i, 8) for i in _GROUPS])
    good = text.rlike("^[0-9a-fA-F]{64}$")
    if not strict:
        return F.when(good, words)
    wrong = F.when(F.length(text) != 64, F.raise_error(F.lit("InvalidHexLength"))).otherwise(F.raise_error(F.lit("InvalidCharacter")))
    return F.when(text.isNull() | good, words).otherwise(wrong.cast("binary"))


def is_zero_key(key: Column) -> Column:
    return key == F.lit(bytes(32))


def codec_code(name: Column) -> Column:
    """none, lz4, bg4, fbs as 0 to 3; null for any other name."""
    out = F.lit(None).cast("tinyint")
    for i, n in enumerate(CODECS):
        out = F.when(name == n, F.lit(i).cast("tinyint")).otherwise(out)
    return out


def _u24(n: Column) -> Column:
    """Three bytes, low first."""
    return _backwards(F.unhex(F.lpad(F.hex(n.cast("bigint")), 6, "0")), 1, 3)


def chunk_header(packed: Column, codec: Column, size: Column) -> Column:
    """The eight bytes before a stored chunk. Sizes of 2**24 or more raise."""
    limit = F.lit(1 << 24)
    ok = (packed >= 0) & (packed < limit) & (size >= 0) & (size < limit)
    made = F.concat(F.lit(bytes([XORB_VERSION])), _u24(packed), F.unhex(F.lpad(F.hex(codec.cast("bigint")), 2, "0")), _u24(size))
    return F.when(ok, made).otherwise(F.raise_error(F.lit("InvalidChunkSize")).cast("binary"))


def byte_group(data: Column) -> Column:
    """Bytes by position modulo four (null stays null)."""
    digits = F.hex(data)
    n = F.length(data)
    planes = [
        F.when(n > p, F.array_join(F.transform(F.sequence(F.lit(p), n - 1, F.lit(4)), lambda i: F.substring(digits, 2 * i + 1, F.lit(2))), "")).otherwise("")
        for p in range(4)
    ]
    return F.unhex(F.concat(*planes))


def ordered_concat(parts: Column) -> Column:
    """One binary of an array of structs (order, data), joined by order."""
    return F.aggregate(F.array_sort(parts), F.lit(b""), lambda out, p: F.concat(out, p["data"]))


def next_link(header: Column) -> Column:
    """The target of the first rel="next" of a Link header, else null."""
    got = F.regexp_extract(header, '<([^>]*)>[^,<]*rel="next"', 1)
    return F.when(got != "", got)


_RETRY = {"TooManyRequests", "InternalServerError", "ServiceUnavailable", "GatewayTimeout", "NetworkError"}
_STATUS = {400: "BadRequest", 401: "Unauthorized", 403: "Forbidden", 404: "NotFound", 416: "RangeNotSatisfiable", 429: "TooManyRequests", 500: "InternalServerError", 503: "ServiceUnavailable", 504: "GatewayTimeout"}


def error_class(status: Column) -> Column:
    """struct(error, retryable) of an HTTP status; null status: a network error."""
    name = F.lit("UnexpectedStatus")
    for code, n in _STATUS.items():
        name = F.when(status == code, F.lit(n)).otherwise(name)
    name = F.when(status.isNull(), F.lit("NetworkError")).when(status.between(200, 299), F.lit(None).cast("string")).otherwise(name)
    return F.struct(name.alias("error"), F.coalesce(name.isin(*sorted(_RETRY)), F.lit(False)).alias("retryable"))
