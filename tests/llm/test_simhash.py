"""Op 7 against all pairs of fingerprints."""

import random

import pytest

from xxhash import xxh64_intdigest

from cairnspark.llm import simhash
from cairnspark.llm.components import components

from .conftest import SMALL


def fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    import re

    w = re.findall("[^\x20\x09-\x0d]+", w)
    if not w:
        return 0
    n = min(3, len(w))
    h = [xxh64_intdigest(" ".join(w[i : i + n]).encode(), 42) for i in range(len(w) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps, radius=2):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(fps))]


def check(df):
    rows = sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda r: r[0])
    fps = [fingerprint(t) for _, t in rows]
    want = sorted((d, f"{f:016x}", rows[c][0]) for (d, _), f, c in zip(rows, fps, classes(fps), strict=True))
    assert sorted(tuple(r) for r in simhash.near_duplicates(df).collect()) == want


def test_tables(spark, docs, no_docs):
    check(docs)
    check(spark.read.parquet(f"{SMALL}/documents.parquet"))
    assert simhash.near_duplicates(no_docs).count() == 0


def test_odd_rows(odd_docs):
    got = simhash.near_duplicates(odd_docs).collect()
    assert len(got) == 7
    assert {r.component_id for r in got if r.fingerprint == "0" * 16} == {-2}


def edges_check(spark, fps):
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp bigint")
    edges = [(r.a, r.b) for r in simhash.links(df).collect()]
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 2 for a, b in edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()} if edges else {}
    signed = [r.fp for r in df.collect()]
    part = classes(fps)
    groups = {}
    for f, c in zip(signed, part, strict=True):
        groups.setdefault(c, set()).add(f)
    want = {f: min(g) for g in groups.values() for f in g if len(g) > 1}
    assert got == want


def test_links_random_and_crowded(spark, monkeypatch):
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for f in fps[:30]:
        g = f
        for _ in range(rng.randint(1, 3)):
            g ^= 1 << rng.randrange(64)
        fps.append(g)
    fps = sorted(set(fps))
    edges_check(spark, fps)
    crowd = {rng.getrandbits(64)}
    while len(crowd) < 120:
        crowd.add(rng.choice(sorted(crowd)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    monkeypatch.setattr(simhash, "CROWD", 4)
    edges_check(spark, sorted(crowd | set(fps)))


def test_components_long_chain(spark):
    n = 200
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(n - 1)] + [(500, 501), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(n)}, 500: 500, 501: 500}


def kept_by_brute_force(rows):
    """Ids left: groups by fingerprints within two bits or similar texts."""
    fps = [simhash.fingerprint(t) for _, t in rows]
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (fps[i] ^ fps[j]).bit_count() <= 2 or both and both >= 0.8 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted(least.values())


def test_drop_keeps_one_of_each_group(docs):
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == kept_by_brute_force([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("crowd", [32, 4])
def test_drop_finds_similar_texts(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    texts = []
    for size in (1, 2, 3, 30):
        base = [rng.choice(vocabulary) for _ in range(200)]
        texts.append(" ".join(base))
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
        far = base[:100] + [rng.choice(vocabulary) for _ in range(100)]  # half in common: stays
        texts.append(" ".join(far))
    rng.shuffle(texts)
    rows = list(enumerate(texts)) + [(900, None), (901, ""), (902, texts[0]), (903, "two words"), (904, "two  Words")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(df).collect()) == kept_by_brute_force(rows)


def test_drop_compares_all_of_a_crowd(spark):
    """Copies of a text that is not there, many similar to a few others only."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    texts = []
    for size in (300, 40):
        base = [rng.choice(vocabulary) for _ in range(200)]
        for _ in range(size):
            w = list(base)
            for at in rng.sample(range(len(w)), rng.randint(2, 5)):
                w[at] = rng.choice(vocabulary)
            texts.append(" ".join(w))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(df).collect()) == kept_by_brute_force(rows)


def test_drop_odd_rows(odd_docs, no_docs):
    assert simhash.drop_near_duplicates(no_docs).count() == 0
    kept = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in simhash.drop_near_duplicates(odd_docs).collect())
    assert kept == [(False, -2, ""), (False, 5, "alpha beta gamma delta"), (False, 5, "alpha beta gamma delta"), (False, 5, "other words are here")]


def test_band_keys_catch_similar_texts():
    rng = random.Random(8)
    missed = 0
    for _ in range(300):
        w = [str(rng.getrandbits(40)) for _ in range(160)]
        v = list(w)
        for at in rng.sample(range(10, 150), 3):
            v[at] = "changed"
        x, y = " ".join(w), " ".join(v)
        assert simhash.similarity(simhash.shingles(x), simhash.shingles(y)) >= 0.8
        missed += not set(simhash.band_keys(x)) & set(simhash.band_keys(y))
    assert missed <= 2
