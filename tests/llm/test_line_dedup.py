"""Op 9 against all pairs of lines."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairnspark.llm import line_dedup as ld

from .conftest import SMALL


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row = row, [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y))
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("abé\U0001f600", max_size=14), st.text("abé\U0001f600", max_size=14)), max_size=12), st.integers(1, 4))
def test_verification(pairs, k):
    assert ld.within(pairs, k).tolist() == [distance(a, b) <= k for a, b in pairs]


def brute(rows, k, least):
    """(id, text) in order -> kept texts."""
    lines = [(i, j, x) for i, (_, t) in enumerate(rows) for j, x in enumerate((t or "").split("\n")) if x.strip(" \t\r\x0b\f") and t is not None]
    parent = {x: x for _, _, x in lines}
    distinct = sorted(x for x in parent if len(x) >= least)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    near = [(x, y) for a, x in enumerate(distinct) for y in distinct[:a] if abs(len(x) - len(y)) <= k]
    for (x, y), ok in zip(near, ld.within(near, k), strict=True):
        if ok:
            parent[find(x)] = find(y)
    seen, gone = set(), set()
    for i, j, x in lines:
        c = find(x)
        if c in seen:
            gone.add((i, j))
        seen.add(c)
    return [None if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if (i, j) not in gone) for i, (_, t) in enumerate(rows)]


def check(df, k=1, least=ld.MIN_CHARS, crowd=ld.CROWD):
    rows = sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda r: r[0])
    got = ld.dedup_lines(df, threshold=k, min_chars=least, crowd=crowd, counts=("lines", "gone")).collect()
    assert {r.doc_id: r.text for r in got} == {d: t for (d, _), t in zip(rows, brute(rows, k, least), strict=True)}
    assert all(r.n_chars == len(r.text or "") for r in got if r.gone)
    for r in got:
        kept = 0 if r.text is None else r.text.count("\n") + 1
        assert r.lines - r.gone == (kept if not (r.text == "" and r.lines == r.gone) else 0)


def test_tables(spark, docs, no_docs):
    check(docs)
    check(spark.read.parquet(f"{SMALL}/documents.parquet"))
    assert ld.dedup_lines(no_docs).count() == 0


@pytest.mark.parametrize("k,crowd", [(1, 32), (1, 2), (2, 32), (3, 32)])
def test_near_lines(spark, k, crowd):
    rng = random.Random(k)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(8, 30))) for _ in range(25)]
    lines = list(base)
    for x in base * 4:
        y = list(x)
        for _ in range(rng.randint(1, k + 1)):
            op, at = rng.randrange(3), rng.randrange(len(y))
            if op == 0:
                y.insert(at, rng.choice("abc"))
            elif op == 1:
                y[at] = rng.choice("abc")
            else:
                y.pop(at)
        lines.append("".join(y))
    rng.shuffle(lines)
    df = spark.createDataFrame([(i, "\n".join(lines[4 * i : 4 * i + 4]), 0) for i in range(-(-len(lines) // 4))], "doc_id bigint, text string, n_chars bigint")
    check(df, k, 6, crowd)


def test_odd_rows(odd_docs):
    got = ld.dedup_lines(odd_docs, min_chars=5)
    assert got.columns == odd_docs.columns
    out = sorted((r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "") for r in got.collect())
    # rows equal in id and text are one document: both copies of id 5 lose the line
    assert out == sorted([(False, 0, True, "alpha beta gamma delta"), (False, 0, False, ""), (True, 5, True, ""), (True, 5, True, ""), (True, 5, True, "other words are here"), (True, -2, True, ""), (True, 7, False, "")])


def test_clashing_names_and_short_lines(spark):
    names = ["key_of_drops", "Key_of_row", "id_of_drops", "drops", "__key", "__key2", "__id", "__drop", "h", "line_no"]
    rows = [(i, t, *([i] * len(names))) for i, t in enumerate(["ab\n\n  \ncd\nab", "cd\n\nabc\n" + "x" * 30, "  \n" + "x" * 29 + "\nab"])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"{n} bigint" for n in names))
    got = ld.dedup_lines(df)
    assert got.columns == df.columns
    assert {r.doc_id: r.text for r in got.collect()} == {0: "ab\n\n  \ncd", 1: "\nabc\n" + "x" * 30, 2: "  "}
    assert all(tuple(r)[2:] == (r.doc_id,) * len(names) for r in got.collect())
