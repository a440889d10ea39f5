"""Op 10 against all windows."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from cairnspark.llm import winnowing as wn

from .conftest import SMALL, prose


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def expected(rows, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc, text in rows:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[k]
        ids = sorted(map(str, found))
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


def check(df, bench):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    items = [(r.item_id, r.text) for r in bench.collect()]
    key = lambda r: tuple((x is not None, x) for x in r)
    got = [tuple(r) for r in wn.decontaminate(df, bench).collect()]
    assert sorted(got, key=key) == sorted(expected(rows, items), key=key)


def test_real(spark):
    check(spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet"))


def test_planted(spark, docs, odd_docs, no_docs):
    rng = random.Random(9)
    items = [(i, prose(rng, n)) for i, n in enumerate([30, 12, 11, 10, 9, 5, 2, 1, 40])] + [(90, None), (91, "..."), (92, "zebra " * 14), (93, "É à ß"), (None, "alpha beta")]
    items.append((2, items[0][1]))
    rows = [(1000 + i, prose(rng, 5) + " " + (t or "") + " " + prose(rng, 8)) for i, (_, t) in enumerate(items)]
    rows += [(2000, " ".join(items[0][1].split()[3:14]).upper() + "!"), (2001, "zebra " * 9), (2002, "zebra " * 33), (2003, items[1][1] + " " + items[1][1])]
    bench = spark.createDataFrame(items, "item_id bigint, text string").filter("item_id is not null")
    planted = spark.createDataFrame(rows, "doc_id bigint, text string")
    check(planted, bench)
    check(docs, bench)
    check(odd_docs, bench)
    check(no_docs, bench)
    check(docs, bench.limit(0))
    long_only = bench.filter("item_id < 4")
    check(planted, long_only)
    kept = wn.clean(docs, long_only)
    assert kept.columns == docs.columns
    bad = {r.doc_id for r in wn.decontaminate(docs, long_only).filter("contaminated").collect()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in docs.collect() if r.doc_id not in bad)


def test_no_broadcast(spark, monkeypatch):
    from cairnspark.llm import common

    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    test_real(spark)


def test_crowded_map(spark, monkeypatch):
    """A map too small for its fingerprints filters little; results stay exact."""
    monkeypatch.setattr(wn, "MIN_SLOTS", 16)
    monkeypatch.setattr(wn, "MAX_SLOTS", 16)
    test_real(spark)


def test_winnowed_by_surroundings(spark, docs):
    """Where the map knows every hash, what is kept is the winnowing of whole texts."""
    found = wn._found(docs, "text", ["doc_id"], [], b"\x01" * 16, 16, wn.PROBES)
    ids = found.filter("p < 0").select("row", "doc_id")
    got = found.filter("p >= 0").select("row", "p", "n", "h", "ctx").join(ids, "row").select("doc_id", "p", "n", "h", "ctx")
    whole = docs.select("doc_id", wn.words_of(F.col("text")).alias("w")).withColumn("g", wn._grams(F.col("w"), wn.K))
    want = whole.select("doc_id", "w", "g", F.explode(wn._selected(F.col("g"))).alias("p"))
    want = want.select("doc_id", "p", F.lit(0).alias("n"), F.get("g", F.col("p")).alias("h"), wn._context(F.col("w"), F.col("p")).alias("ctx"))
    assert got.count() > 1000
    assert sorted(map(tuple, got.collect()), key=lambda r: r[:2]) == sorted(map(tuple, want.collect()), key=lambda r: r[:2])


def test_no_lambda_over_whole_texts(spark, docs, monkeypatch):
    """Lambdas are interpreted: below the map's test there are none, and the
    loop over words is one that the JVM compiles (methods of under 8000 bytes),
    for items of every length too."""
    plans, write = [], wn.materialize

    def seen(df, name):
        if name == "winnow-docs":
            plans.append(df)
        return write(df, name)

    monkeypatch.setattr(wn, "materialize", seen)
    rng = random.Random(4)
    bench = spark.createDataFrame([(i, prose(rng, i)) for i in range(1, 14)], "item_id bigint, text string")
    wn.decontaminate(spark.read.parquet(f"{SMALL}/documents.parquet"), bench)
    run = plans[0]._jdf.queryExecution()
    lines = str(run.executedPlan().toString()).splitlines()
    loops = [i for i, line in enumerate(lines) if re.search(r"\*\(\d+\) Generate posexplode", line)]
    assert loops and not any("lambdafunction" in line for line in lines[loops[0] :])
    code = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(run, "codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert sizes and max(sizes) < 8000
