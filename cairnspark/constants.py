"""Protocol constants: what the hashes and formats depend on."""

from __future__ import annotations

# Chunk sizes in bytes, and how many top bits of the rolling hash
# have to be zero at a cut.
MIN_CHUNK = 8192
NORMAL_CHUNK = 65536
MAX_CHUNK = 131072
CUT_BITS = 16

# Keys of the data, inner node and range hashes.
DATA_KEY = bytes.fromhex("6697f5775b9550de3135cbaca597181c9de421109beb2b58b4d0b04b93adf229")
NODE_KEY = bytes.fromhex("017ec5c7a5472996fd946666b48a02e65ddd536f37c76dd2f86352e64a53713f")
RANGE_KEY = bytes.fromhex("7f1857d6ce56ed66127ff913e7a5c3f3a4cd26d5b5db49e64124987f28fb94c3")
ZERO = bytes(32)

# The container format.
XORB_CAP = 67108864
CHUNK_HEADER = 8
XORB_VERSION = 0
#: Codec names by the number stored in chunk headers.
CODECS = ("none", "lz4", "bg4", "fbs")

# The shard format.
SHARD_TAG = b"HFRepoMetaData\x00UigEj{\x81W\x83\xa5\xbd\xd9\\\xcd\xd1J\xa9"
SHARD_HEADER, SHARD_FOOTER, SHARD_ENTRY = 48, 200, 48
SHARD_VERSION, FOOTER_VERSION = 2, 1
BOOKEND = b"\xff" * 32 + bytes(16)
HAS_VERIFICATION = 0x80000000
