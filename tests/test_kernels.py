"""Byte kernels against published vectors, the JVM, and plain versions."""

import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairnspark import constants as c
from cairnspark.kernels import bits, codec, gear, merkle
from cairnspark.kernels.blake3 import keyed

MASK = (1 << 64) - 1


def splitmix(n, seed):
    """Random bytes: splitmix64, eight bytes a step, low byte first."""
    out = bytearray()
    while len(out) < n:
        seed = (seed + 0x9E3779B97F4A7C15) & MASK
        z = seed
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & MASK
        out += (z ^ (z >> 31)).to_bytes(8, "little")
    return bytes(out[:n])


# -- chunking


def plain_cuts(data, least, most, bits_, table):
    """Byte at a time, the hash reset at each cut."""
    ends, start, h = [], 0, 0
    for i, b in enumerate(data):
        h = ((h << 1) + int(table[b])) & MASK
        size = i + 1 - start
        if size >= most or (size >= least and h >> (64 - bits_) == 0):
            ends.append(i + 1)
            start, h = i + 1, 0
    return ends + ([len(data)] if start < len(data) else [])


@pytest.mark.parametrize("n", [0, 1, 63, 64, 8192, 8193, 131072, 300_000])
def test_cuts_equal_the_plain_fold(n):
    data = splitmix(n, 7)
    assert gear.gear_cuts(data) == plain_cuts(data, c.MIN_CHUNK, c.MAX_CHUNK, c.CUT_BITS, gear.RULE_TABLE)


@given(st.integers(0, 5000), st.integers(0, 99), st.integers(64, 300), st.integers(4, 9))
@settings(max_examples=60, deadline=None)
def test_small_profiles_equal_the_plain_fold(n, seed, least, bits_):
    data = splitmix(n, seed)
    got = gear.gear_cuts(data, least, 4 * least, bits_)
    assert got == plain_cuts(data, least, 4 * least, bits_, gear.RULE_TABLE)


def test_pieces_do_not_move_cuts(monkeypatch):
    data = splitmix(200_000, 3)
    want = gear.gear_cuts(data, 512, 4096, 10)
    monkeypatch.setattr(gear, "_PIECE", 1000)
    assert gear.gear_cuts(data, 512, 4096, 10) == want


@pytest.mark.skipif("CAIRNSPARK_GEAR_TABLE" not in os.environ, reason="needs the protocol's byte table as a file of 256 hexadecimal words")
def test_published_boundaries():
    with open(os.environ["CAIRNSPARK_GEAR_TABLE"]) as f:
        table = gear.table_of(f.read())
    data = splitmix(1_000_000, 0)
    assert (data[0], data[127], data[111111]) == (175, 132, 118)
    # fixed values: published chunk ends
    assert gear.gear_cuts(data, table=table) == [84493, 134421, 144853, 243318, 271793, 336457, 467529, 494581, 582000, 596735, 616815, 653164, 678202, 724510, 815591, 827760, 958832, 991092, 1000000]
    assert gear.gear_cuts(bytes([59]) * 1_000_000, table=table) == [131072, 262144, 393216, 524288, 655360, 786432, 917504, 1000000]


def test_table_parameter():
    words = " ".join(f"{i * 0x9E3779B97F4A7C15 & MASK:x}" for i in range(256))
    data = splitmix(50_000, 1)
    assert gear.gear_cuts(data, 512, 4096, 10, gear.table_of(words)) == plain_cuts(data, 512, 4096, 10, gear.table_of(words))
    with pytest.raises(ValueError):
        gear.table_of("1 2 3")


@pytest.mark.parametrize("algorithm", ["gearhash", "ultracdc"])
@pytest.mark.parametrize("data", [b"", b"Hello, World!", bytes(262_144), bytes(i % 256 for i in range(204_800)), splitmix(700_000, 5)])
def test_chunks_tile_within_bounds(algorithm, data):
    ends = gear.cut(data, algorithm)
    assert ends == gear.cut(data, algorithm)
    starts = [0, *ends[:-1]]
    sizes = [e - s for s, e in zip(starts, ends, strict=False)]
    assert sum(sizes) == len(data)
    assert all(c.MIN_CHUNK <= n <= c.MAX_CHUNK for n in sizes[:-1])
    assert all(0 < n <= c.MAX_CHUNK for n in sizes)


def test_constant_bytes_reach_the_largest_size():
    assert gear.gear_cuts(bytes(262_144))[0] == c.MAX_CHUNK


def test_algorithms_differ():
    data = splitmix(700_000, 5)
    assert gear.cut(data, "gearhash") != gear.cut(data, "ultracdc")
    with pytest.raises(ValueError):
        gear.cut(data, "other")


# -- hashes


def test_keyed_hash_equals_the_jvm(spark):
    blake3 = spark.sparkContext._jvm.org.apache.commons.codec.digest.Blake3
    sizes = [0, 1, 63, 64, 65, 1023, 1024, 1025, 2048, 3072, 8192, 131072]
    messages = [splitmix(n, n) for n in sizes]
    for key in (c.DATA_KEY, c.NODE_KEY, c.ZERO):
        want = [bytes(blake3.initKeyedHash(bytearray(key)).update(bytearray(m)).doFinalize(32)) for m in messages]
        assert keyed(key, messages) == want
    assert keyed(c.DATA_KEY, []) == []
    with pytest.raises(ValueError):
        keyed(b"short", [b""])


# Leaves (hash, size) and published roots.
LEAVES = {
    "Z": ("0" * 64, 0),
    "A": ("cfc5d07f6f03c29bbf424132963fe08d19a37d5757aaf520bf08119f05cd56d6", 100),
    "B": ("c3e67584b5c4fc2a89837ec39e40f2c8a6bb0b2987ac94cd4b31e5fbdd210a72", 200),
    "C": ("0d2beb91b9196929a5ddec9f6e306924ddf4a24268e3e59fd8464738d525af37", 300),
    "D": ("adf8773496a9b7319b2e50dc98093f344053b17d8ad37100b9c07d9805988784", 400),
    "E": ("4ac202caf347fc1e9c874b1ef6a1c5e619141eb775a6f43f0f0124ccd0060d9e", 500),
    "F": ("b3b28636f65c149ea52eb1f94669466f70f033b54cea792824c696ba6ef3c389", 600),
    "G": ("0e2c1a002aae913d2c0fc8ddfa4e9e14b7b311b3b0d458726d5d9f6a6318013c", 700),
}
ROOTS = {
    "": "0" * 64,
    "Z": "0" * 64,
    "A": "cfc5d07f6f03c29bbf424132963fe08d19a37d5757aaf520bf08119f05cd56d6",
    "ABC": "71ec1275fca074724e2dd666921b3277c7cee603e4d025bcab2d4050015be2bc",
    "AAAA": "89f2ada89ff8c96763c6b25010e6dd76a4c05b1466207633ea559acf2093211b",
    "ABABCD": "52c826f99507aa05d0b45e9837fa1709e0485425cfbcb1e80db3905cf98b3ee9",
    "ZABCDEFG": "f62abe77e3fb9c954fe52b0028027ddc90c064c45951a4fd2211d87e5c0011db",
    "A" * 32: "0a0123c1617921883b7e13902095fcb86676e77c49120c33b233003b0af0e0a6",
}


def leaves(names):
    return [(merkle.from_api_hex(LEAVES[x][0]), LEAVES[x][1]) for x in names]


def test_published_roots():
    got = merkle.roots([leaves(k) for k in ROOTS])
    assert [merkle.api_hex(h) for h in got] == list(ROOTS.values())


@pytest.mark.parametrize("names", ROOTS)
def test_streamed_roots(names):
    tree = merkle.OpenTree()
    for node in leaves(names):
        tree.push([node])
    assert merkle.api_hex(tree.close()) == ROOTS[names]


@given(st.integers(0, 400), st.integers(1, 50), st.integers(0, 1000))
@settings(max_examples=30, deadline=None)
def test_streaming_equals_folding(n, step, seed):
    nodes = [(splitmix(32, seed * 1000 + i), i) for i in range(n)]
    tree = merkle.OpenTree()
    for s in range(0, n, step):
        tree.push(nodes[s : s + step])
    assert tree.close() == merkle.roots([nodes])[0]
    assert (tree.count, tree.size) == (n, sum(range(n)))


def test_file_hashes():
    assert merkle.file_hashes([[]]) == [c.ZERO]
    one = leaves("A")
    assert merkle.file_hashes([one]) == keyed(c.ZERO, [one[0][0]])
    assert merkle.file_hashes([one], salt=bytes([1] * 32)) != merkle.file_hashes([one])


def test_api_hex_round_trip():
    h = splitmix(32, 4)
    assert merkle.from_api_hex(merkle.api_hex(h)) == h
    with pytest.raises(ValueError, match="InvalidHexLength"):
        merkle.from_api_hex("123abc")


# -- transforms and codecs

# Published byte groupings.
GROUPED = [
    (range(1, 9), [1, 5, 2, 6, 3, 7, 4, 8]),
    (range(8), [0, 4, 1, 5, 2, 6, 3, 7]),
    (range(1, 11), [1, 5, 9, 2, 6, 10, 3, 7, 4, 8]),
    (range(10), [0, 4, 8, 1, 5, 9, 2, 6, 3, 7]),
    (range(13), [0, 4, 8, 12, 1, 5, 9, 2, 6, 10, 3, 7, 11]),
    (range(15), [0, 4, 8, 12, 1, 5, 9, 13, 2, 6, 10, 14, 3, 7, 11]),
    ([42], [42]),
]


@pytest.mark.parametrize("plain,want", GROUPED)
def test_published_groupings(plain, want):
    assert list(bits.group4(bytes(plain))) == want


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 15, 16, 17, 1000, 65483, 65536, 65671])
def test_transforms_invert(n):
    data = splitmix(n, n + 1)
    assert bits.ungroup4(bits.group4(data)) == data
    assert bits.unslice_bits(bits.slice_bits(data)) == data
    assert bits.slice_bits(bytes([0b10110100])) == bytes([0b10110100])


def test_bit_slices_by_definition():
    data = splitmix(9, 2)
    flat = np.unpackbits(np.frombuffer(bits.slice_bits(data), np.uint8), bitorder="little")
    assert all(flat[k] == data[k % 9] >> (k // 9) & 1 for k in range(72))


@pytest.mark.parametrize("name", c.CODECS)
@pytest.mark.parametrize("data", [b"", b"abc", b"abcd", bytes([1, 0, 0, 0, 2, 0, 0, 0, 3, 0, 0, 0] * 20), splitmix(5000, 1), b"text " * 5000])
def test_codecs_round_trip(name, data):
    packed, number = bits.compress(data, name)
    assert len(packed) <= len(data)
    assert (number == 0) == (packed == data)
    assert bits.decompress(packed, number, len(data)) == data


def test_codec_choices():
    rows = bytes([1, 0, 0, 0, 2, 0, 0, 0, 3, 0, 0, 0] * 20)
    assert [bits.compress(rows, n)[1] for n in c.CODECS] == [0, 1, 2, 3]
    assert bits.compress(b"abcd", "bg4") == (b"abcd", 0) and bits.compress(b"abc", "fbs") == (b"abc", 0)
    floats = bytes(x for i in range(256) for x in (i, 0, 0, 0x3F))
    assert len(bits.compress(floats, "bg4")[0]) < len(bits.compress(floats, "lz4")[0])


def test_wrong_codecs():
    packed, number = bits.compress(b"text " * 100, "lz4")
    for args in ((packed, number, 499), (packed, number, 501), (packed[:-9], number, 500), (b"raw", 0, 4), (b"raw", 9, 3)):
        with pytest.raises(bits.CodecError):
            bits.decompress(*args)
    with pytest.raises(bits.CodecError):
        bits.compress(b"x", "zip")


# -- xorbs and shards


@pytest.mark.parametrize("n", [0, 1, 255, 256, 65535, 65536, 16777215])
def test_header_sizes(n):
    assert codec.parse_header(codec.chunk_header(n, 1, n)) == (0, n, 1, n)


def test_header_limit():
    with pytest.raises(codec.FormatError):
        codec.chunk_header(1 << 24, 0, 1)


@pytest.mark.parametrize("name", c.CODECS)
def test_xorb_round_trip(name):
    chunks = [b"First chunk", b"Second chunk" * 50, b"", b"Third chunk"]
    raw, spans = codec.serialize_xorb(chunks, name)
    got = list(codec.frames(raw))
    assert [f.data() for f in got] == chunks and [(f.start, f.end) for f in got] == spans


def test_chunk_ranges():
    raw, _ = codec.serialize_xorb([f"Chunk {i}".encode() for i in range(4)], "none")
    assert codec.chunk_range(raw, 1, 3) == b"Chunk 1Chunk 2" and codec.chunk_range(raw, 1, 2) == b"Chunk 1"
    for a, b, name in ((5, 5, "InvalidRange"), (0, 10, "RangeOutOfBounds")):
        with pytest.raises(codec.FormatError, match=name):
            codec.chunk_range(raw, a, b)


def test_broken_xorbs():
    raw, _ = codec.serialize_xorb([b"some bytes"], "none")
    cases = [(raw[:5], "TruncatedXorb"), (raw[:-1], "TruncatedXorb"), (b"\x01" + raw[1:], "UnsupportedVersion"), (raw[:4] + b"\x09" + raw[5:], "InvalidCompressionType"), (raw[:5] + bytes(3) + raw[8:], "InvalidChunkSize")]
    for bad, name in cases:
        with pytest.raises(ValueError, match=name):
            list(codec.frames(bad))


def shard(key=c.ZERO):
    x = codec.XorbInfo(b"x" * 32, [(bytes([i]) * 32, s, n) for i, (s, n) in enumerate([(0, 8192), (8192, 16384), (24576, 4096)])], 28672, 15000)
    f = codec.FileInfo(b"f" * 32, [(b"x" * 32, 1000, 0, 5)], b"r" * 32)
    return codec.Shard([f, codec.FileInfo(b"g" * 32, [])], [x], key, 1700000000, 1700086400)


def test_shard_round_trip():
    raw = shard().to_bytes()
    assert len(raw) == 48 + 4 * 48 + 48 + 4 * 48 + 48 + 200
    got = codec.parse_shard(raw)
    assert (got.files, got.xorbs, got.created, got.expires) == (shard().files, shard().xorbs, 1700000000, 1700086400)
    assert not got.is_keyed and codec.parse_shard(shard(bytes(7 * i % 256 for i in range(32))).to_bytes()).is_keyed
    assert codec.parse_shard(codec.Shard().to_bytes()).files == []


def test_broken_shards():
    raw = shard().to_bytes()
    for bad, name in ((raw[:100], "TruncatedShard"), (b"?" + raw[1:], "InvalidShardTag"), (raw[:32] + b"\x09" + raw[33:], "UnsupportedShardVersion"), (raw[:-200] + b"\x09" + raw[-199:], "UnsupportedFooterVersion")):
        with pytest.raises(codec.FormatError, match=name):
            codec.parse_shard(bad)
    assert len(codec.parse_shard(b"?" + raw[1:], strict=False).xorbs) == 1


@given(st.binary(max_size=600))
@settings(max_examples=100, deadline=None)
def test_noise_never_crashes(noise):
    for read in (lambda: list(codec.frames(noise)), lambda: codec.parse_shard(noise), lambda: codec.parse_shard(noise, False)):
        try:
            read()
        except ValueError:
            pass


