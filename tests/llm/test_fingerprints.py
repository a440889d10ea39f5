"""Op 1 against multisets of pieces."""

import hashlib
import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cairnspark.llm import iblt

from .conftest import SMALL


def jaccard(a, b):
    x, y = Counter(iblt.pieces(a)), Counter(iblt.pieces(b))
    union = sum((x | y).values())
    return sum((x & y).values()) / union if union else 1.0


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    out = []
    for i, (doc, t) in enumerate(rows):
        t, nxt = t or "", rows[(i + 1) % len(rows)][1] or ""
        new = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        out.append((doc, len(t), hashlib.sha256(new.encode()).hexdigest(), round(jaccard(t, new), 9), round(jaccard(t, nxt), 9)))
    return out


def check(df, rows):
    got = df.collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got), key=key) == sorted(expected(rows), key=key)
    return got


def test_awkward_texts(docs, texts):
    got = check(iblt.version_fingerprints(docs), texts)
    by_id = {r.doc_id: r for r in got}
    text = dict(texts)
    for a in by_id:
        for b in by_id:
            if (text[a] or "") == (text[b] or ""):
                assert by_id[a].fingerprint == by_id[b].fingerprint


def test_odd_rows(odd_docs, no_docs):
    check(iblt.version_fingerprints(odd_docs), [(r.doc_id, r.text) for r in odd_docs.collect()])
    assert iblt.version_fingerprints(no_docs).count() == 0
    one = odd_docs.filter("doc_id = -2")
    check(iblt.version_fingerprints(one), [(-2, "")])


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    check(iblt.version_fingerprints(docs), [(r.doc_id, r.text) for r in docs.collect()])


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), unique=True, max_size=300), st.integers(0, 300), st.integers(0, 300))
def test_peeling_recovers_both_sides(keys, i, j):
    a, b = set(keys[:i]), set(keys[j:])
    arr = lambda s: (np.zeros(len(s), np.int64), np.array(sorted(s), np.uint64))
    row, key, sign, used = iblt.differences(arr(a), arr(b), 1)
    assert set(key[sign > 0].tolist()) == a - b
    assert set(key[sign < 0].tolist()) == b - a
    assert used[0] >= iblt.CELLS


def test_long_pieces_are_cut_by_content():
    rng = random.Random(6)
    for words in (["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(900)], [chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(3000)]):
        gap = " " if len(words[0]) > 1 else ""
        text = gap.join(words)
        got = iblt.pieces(text)
        assert b"".join(got) == text.encode() and len(got) > 20 and all(p.decode() for p in got)
        other = gap.join(words[: len(words) // 2] + ["changed"] + words[len(words) // 2 + 1 :])
        assert jaccard(text, other) > 0.85
    assert iblt.pieces("\u4e00\u3002\u4e8c\u3002") == ["\u4e00\u3002".encode(), "\u4e8c\u3002".encode()]
    assert iblt.pieces("a" * 5000) == [b"a" * 5000]


def test_fingerprint_round_trip():
    g = iblt.Group(["one. two. three.\nfour", "", None])
    n, count, xor, check_ = iblt.decode(g.strings()[0])
    assert n == 4 and (count == g.base[0][: iblt.CELLS]).all() and (xor == g.base[1][: iblt.CELLS]).all() and (check_ == g.base[2][: iblt.CELLS]).all()
    assert g.strings()[1] == g.strings()[2]


def test_recovered_digests(spark):
    df = spark.createDataFrame([(1, "a. b. c.", "a. x. c."), (2, None, ""), (3, "same", "same")], "doc_id bigint, old string, new string")
    got = {r.doc_id: r for r in iblt.recover_differences(df).collect()}
    assert len(got[1].removed) == len(got[1].added) == 1
    assert got[2].removed == got[2].added == got[3].removed == got[3].added == []
