"""The pipeline's rows against brute-force versions of its stages."""

import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from cairnspark.llm import best_fit
from cairnspark.llm import line_dedup as ld

from .conftest import SMALL
from .test_line_dedup import brute
from .test_simhash import kept_by_brute_force
from .test_winnowing import expected


def wanted(rows, items):
    rows = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    rows = list(zip([i for i, _ in rows], brute(rows, ld.THRESHOLD, ld.MIN_CHARS), strict=True))
    kept = set(kept_by_brute_force(rows))
    rows = [r for r in rows if r[0] in kept]
    bad = {r[0] for r in expected(rows, items) if r[-1]}
    return {i: len(re.findall("[^ \t-\r]+", t)) + 1 for i, t in rows if i not in bad}


def packed(rows):
    """Lengths by document, after checking that pieces tile documents and bins
    hold them apart."""
    pieces, bins = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
        bins.setdefault((r.bin, r.capacity), []).append((r.offset, r.length))
    assert len({b for b, _ in bins}) == len(bins)
    for (_, capacity), held in bins.items():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= capacity and capacity == min(c for c in best_fit.CAPACITIES if c >= at)
    for got in pieces.values():
        at = 0
        for k, (piece, start, n) in enumerate(sorted(got)):
            assert (piece, start) == (k, at)
            at += n
    return {d: sum(n for _, _, n in got) for d, got in pieces.items()}


def test_run(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    got = packed(corpus_pipeline.run(spark, SMALL).collect())
    assert got == wanted([(r.doc_id, r.text) for r in docs], items)


def test_stages_keep_columns(spark, docs):
    small = docs.limit(8)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, small, SMALL)
        assert out.columns == small.columns, name


@pytest.mark.parametrize("at", range(len(corpus_pipeline.STAGES)))
def test_stages_on_nothing(spark, no_docs, at):
    assert corpus_pipeline.STAGES[at][1](spark, no_docs, SMALL).count() == 0


def test_stages_on_odd_rows(spark, odd_docs):
    docs = odd_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    left = docs.groupBy("doc_id").agg(F.count("*").alias("n")).collect()
    # one of the two languages' texts is a copy, and rows of one id stay or go together
    assert {r.doc_id for r in left} == {5} or {r.doc_id for r in left} == {None, 5}
