"""Column functions, native where Spark has what it takes."""

from .columns import (  # noqa: F401
    api_hex,
    byte_group,
    chunk_header,
    codec_code,
    error_class,
    from_api_hex,
    is_zero_key,
    next_link,
    ordered_concat,
)
from .kernels import (  # noqa: F401
    chunk_bounds,
    compress_chunk,
    data_hash,
    decompress_chunk,
    file_hash_of_root,
    float_bytes,
    keyed_chunk_hash,
    keyed_hash,
    node_hash,
    range_hash,
    register,
    transform_bytes,
)
