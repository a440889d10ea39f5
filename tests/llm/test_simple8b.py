"""Op 4: exact round trips, and the tokenizer itself as the oracle."""

import uuid
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from cairnspark.llm import simple8b as s8
from cairnspark.llm.common import shared_dir
from cairnspark.llm.queries import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")


def test_words_of_a_full_table(monkeypatch):
    monkeypatch.setattr(s8.Words, "MOST", 4)
    monkeypatch.setattr(s8.Words, "RENEW", 2)
    words, sizes = s8.Words(PATH), []
    for at in range(0, 60, 3):
        texts = [f"Word{'abcdefghij'[i % 10]}, word{'abcdefghij'[i % 7]} ÉTÉ. été 12{i} WORDA!" for i in range(at, at + 3)]
        flat, counts = words.encode(pa.array(texts))
        ends = np.cumsum(counts)
        assert [flat[e - c : e].tolist() for e, c in zip(ends, counts, strict=True)] == library(texts)
        assert np.array_equal(words.counts(pa.array(texts)), counts)
        sizes.append(len(words))
    assert max(sizes) <= 4 and min(sizes) < 4  # filled, and emptied


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 300), st.integers(0, 50_000), st.integers(0, 2**64 - 1)), max_size=400), st.integers(0, 400), st.integers(0, 400))
def test_round_trip(ids, a, b):
    arr = np.array(ids, np.uint64)
    seg = s8.Segment(s8.segment([1, None], [arr[: len(arr) // 2], arr[len(arr) // 2 :]]))
    assert seg.doc_ids == [1, None] and (seg.ids() == arr).all()
    a, b = min(a, b), max(a, b)
    assert (seg.read(a, b) == arr[a:b]).all()


def test_blocks_decode_alone():
    arr = np.random.default_rng(0).integers(0, 50_000, 3 * s8.BLOCK + 7).astype(np.uint64)
    arr[5000] = 2**63
    seg = s8.Segment(s8.segment([0], [arr]))
    for a, b in ((0, 1), (4095, 4097), (8192, 12000), (12290, 99999)):
        assert (seg.read(a, b) == arr[a:b]).all()


def library(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    return [tok.encode(t or "", add_special_tokens=False).ids for t in texts]


ODD = ["'s don't I'M we'll", "á éx", "İstanbul ŉ ſ ß ẞ", "<|endoftext|> x<|startoftext|>y", "x\x1cy\x1dz", "123abc .,!", "ÀÉ,!? Ÿ", "日本語 text", "", "  ", "a" * 3000, "ﬁ ǅ Σς ΑΣ", "a\x85b", "﻿abc", "K", None, "é ́x", "̈́ a b"]


def check_words(texts):
    flat, counts = s8.Words(PATH).encode(pa.array(texts, pa.string()))
    ends = np.cumsum(counts)
    assert [flat[e - c : e].tolist() for e, c in zip(ends, counts, strict=True)] == library(texts)


def test_words_equal_the_library():
    check_words(ODD)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=5))
def test_words_equal_the_library_on_any_text(texts):
    check_words(texts)


def written(spark, df):
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    s8.write_tokens(df, path, PATH)
    return path


def check(spark, df):
    rows = sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, at = [], 0
    for (doc, _), ids in zip(rows, library([t for _, t in rows]), strict=True):
        ids = [*ids, 2]
        want.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    path = written(spark, df)
    got = sorted((tuple(r) for r in s8.read_tokens(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])
    assert got == want
    whole = s8.read_tokens(spark, path, digest=False)
    assert sum(len(r.ids) for r in whole.collect()) == at


def test_files(spark, docs, odd_docs, no_docs):
    check(spark, docs)
    check(spark, odd_docs)
    check(spark, no_docs)
    check(spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_small_segments(spark, docs, monkeypatch):
    monkeypatch.setattr(s8, "SEGMENT_IDS", 50)
    check(spark, docs)
