"""Every registered query of the engine, against DuckDB where SQL has it."""

import datetime
import os

import duckdb
import pytest

from cairnspark import oracle, queries

SF = "/root/testdata/sf0.001"
SQL = oracle.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return bytes(v) if isinstance(v, bytearray) else str(v) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", queries.queries())
def test_query(spark, db, name):
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    assert got
    if name in SQL:
        res = db.execute(SQL[name])
        names = [d[0] for d in res.description]
        want = sorted(repr([plain(r[names.index(c)]) for c in cols]) for r in res.fetchall())
        assert sorted(names) == cols and got == want


def test_entry_without_the_llm_folder():
    import __spark_entry__ as entry

    assert set(queries.queries()) <= set(entry.queries())
    assert set(SQL) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_prune_and_push_down(spark):
    """Queries read the columns that they need alone."""
    plan = queries.find_file(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    plan = queries.fetch_match(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "l_extendedprice" not in plan and "CartesianProduct" not in plan
    plan = queries.turn_dedup(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan


def test_bundles_match_the_plain_fold(spark):
    """Too slow in SQL: chunk ends and dedup of files of many chunks."""
    from cairnspark import constants as c
    from cairnspark.kernels import gear

    from .test_kernels import plain_cuts

    files = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect():
        files[r.doc_id // 64] = files.get(r.doc_id // 64, b"") + (r.text or "").encode()
    ends = {k: plain_cuts(v, c.MIN_CHUNK, c.MAX_CHUNK, c.CUT_BITS, [int(x) for x in gear.RULE_TABLE]) for k, v in files.items()}
    want = sorted((k, i, a, b, b - a) for k, e in ends.items() for i, (a, b) in enumerate(zip([0, *e], e, strict=False)))
    assert len(want) > 2 * len(files)
    assert sorted(tuple(r) for r in queries.bundle_chunks(spark, SF).collect()) == want
    seen, stats = set(), {}
    for k, _, a, b, n in want:
        own, new = stats.setdefault(k, [0] * 5), files[k][a:b] not in seen
        seen.add(files[k][a:b])
        for i, x in enumerate((1, new, n, n * new, n * (not new))):
            own[i] += x
    got = {r.file_id: [r.chunks, r.unique_chunks, r.raw_bytes, r.unique_bytes, r.dedup_savings] for r in queries.bundle_dedup(spark, SF).collect()}
    assert got == stats
