"""Op 3: held-out accuracy, and parsing against brute force."""

import random
import zlib

from cairnspark.llm import cross_parsing as cp

from .conftest import SMALL


def phrases(text, sample):
    n = at = 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in sample:
            end += 1
        n, at = n + 1, max(end - 1, at + 1)
    return n


def test_phrases_match_brute_force():
    samples = {"a": "the cat sat on the mat and the hat", "b": "der hund und die katze auf der matte"}
    m = cp.Model(samples)
    for text in ("the mat", "katze und hat", "zzz", "t", "the cat sat on the mat and the hat", "q the q"):
        got = m.phrases([m.fold(text)])[0]
        fold = lambda t: tuple(m.fold(t).tolist())
        as_text = lambda t: "".join(chr(200 + c) for c in fold(t))
        for k, lang in enumerate(m.langs):
            assert got[k] == phrases(as_text(text), as_text(samples[lang]))


def test_long_texts_are_parsed_whole(monkeypatch):
    rng = random.Random(4)
    samples = {k: " ".join("".join(rng.choice(k) for _ in range(rng.randint(1, 6))) for _ in range(150)) for k in ("abc", "abd", "xyz")}
    samples["tide"] = "ab" * 400
    m = cp.Model(samples)
    as_text = lambda t: "".join(chr(200 + c) for c in m.fold(t).tolist())
    texts = ["".join(rng.choice("abcdxy ") for _ in range(n)) for n in (2048, 2049, 2240, 2300, 5000)]
    # slices of the samples: phrases that go on over a stretch's start
    texts += [" ".join(samples[k][100:400] for k in ("abc", "xyz", "abd") * 8), "ab" * 3000, "b" + "ab" * 2500 + "c" + texts[0], "short", ""]
    want = [[phrases(as_text(t), as_text(samples[k])) for k in m.langs] for t in texts]
    assert m.phrases([m.fold(t) for t in texts]).tolist() == want
    alone = m._in_one_go
    apart = []
    monkeypatch.setattr(m, "_in_one_go", lambda codes, k: apart.append(k) or alone(codes, k))
    assert m.phrases([m.fold(t) for t in texts[::-1]]).tolist() == want[::-1]
    assert 0 < len(apart) < 8


def test_rare_letters_are_spelled(monkeypatch):
    rng = random.Random(7)
    wide = [chr(c) for c in range(0x4E00, 0x4E00 + 3000)]
    samples = {f"l{i}": "".join(rng.choice([*wide[i * 700 : i * 700 + 900], *"abc "]) for _ in range(3000)) for i in range(4)}
    texts = [samples[f"l{i}"][300 * k : 300 * k + 40] + "zz" + wide[-1] for i in range(4) for k in range(3)]
    monkeypatch.setattr(cp, "TABLE_CELLS", 1 << 27)
    plain = cp.Model(samples)
    assert plain.fold.size > 2800
    monkeypatch.setattr(cp, "TABLE_CELLS", 1 << 20)
    m = cp.Model(samples)
    assert m.fold.size == cp.MIN_CLASSES and m.table.dtype == plain.table.dtype == "int32"
    # distinct letters are spelled apart, a letter with a class takes one
    assert len({tuple(m.fold(c).tolist()) for c in [*wide[:3000], *"abc"]} - {(cp._OTHER,)}) == plain.fold.size - 2
    assert len(m.fold("a B")) == 3 and len(m.fold(wide[5])) == m.fold.digits == 3
    as_text = lambda c: "".join(map(chr, (c + 200).tolist()))
    got = m.phrases([m.fold(t) for t in texts])
    for j, t in enumerate(texts):
        assert got[j].tolist() == [phrases(as_text(m.fold(t)), as_text(m.fold(samples[k]))) for k in m.langs]
    assert m.predict(texts)[0] == plain.predict(texts)[0] == [f"l{i}" for i in range(4) for _ in range(3)]


def test_automaton_accepts_exactly_the_substrings():
    text = [0, 1, 0, 0, 1, 2, 1, 0]
    table = cp.suffix_automaton(__import__("numpy").array(text), 3)
    subs = {tuple(text[i:j]) for i in range(len(text)) for j in range(i, len(text) + 1)}
    from itertools import product

    for n in range(1, 5):
        for word in product(range(3), repeat=n):
            s = 0
            for c in word:
                s = table[s, c] if s >= 0 else -1
            assert (s >= 0) == (word in subs)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in cp.predict(docs, cp.sample(docs)).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert len(got) == len(truth)
    held = [d for d in got if got[d].held_out]
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d in got)
    assert sum(got[d].lang_pred == truth[d] for d in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_odd_rows(docs, odd_docs, no_docs):
    got = {r.doc_id: r for r in cp.predict(docs, cp.sample(docs)).collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    for d, t in text.items():
        assert (got[d].lang_pred == "und") == (not any(c.isalpha() for c in t or "")), (d, t)
    assert cp.predict(odd_docs, cp.sample(odd_docs)).count() == 7
    assert cp.sample(no_docs) == {} and cp.predict(no_docs, {}).count() == 0
    assert {r.lang_pred for r in cp.predict(odd_docs, {}).collect()} == {"und"}
    kept = cp.keep_identified(docs, cp.sample(docs))
    assert kept.columns == docs.columns and kept.count() == sum(any(c.isalpha() for c in t or "") for t in text.values())
