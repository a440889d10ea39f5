"""Language ID by cross-parsing entropy.

Training: of each language a bounded sample of labelled text (SAMPLE_CHARS
letters and blanks) becomes a suffix automaton, which accepts exactly the
substrings of that sample.

Prediction: a text is parsed from left to right into longest phrases that occur
in a language's sample. The number of phrases times the cost of pointing at one
(log2 of the sample's length), over the text's length, estimates the
cross-entropy of text and language; the language needing least wins.

The automata are dense transition tables in which a missing transition restarts
at the root and counts phrases, so parsing is one table look-up a character,
done for many texts and all languages at a time. Whole texts are parsed, as one
piece each: a long one is first parsed in stretches side by side, each as if a
phrase began there; then each stretch's start is parsed again from the state
that the stretch before ended in, until both parses are in the same state, from
where they agree. The rare text whose parses do not meet is parsed in one go.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, whole_texts

#: Letters and blanks of labelled text per language, at most.
SAMPLE_CHARS = 24_000
#: Labelled documents per language that the sample is taken from, on average,
#: and the longest of them, in characters, unless a language has none so short.
SAMPLE_DOCS, SAMPLE_DOC_CHARS = 48, 4_000
#: Characters of all languages' samples together; more languages share it, and
#: the MAX_LANGS that have most documents are learned.
TOTAL_CHARS, MAX_LANGS = 400_000, 256
#: Characters parsed side by side, and of them how many may pass until a parse
#: meets that of the stretch before. Neither changes the number of phrases.
STRETCH, CATCH = 2048, 384
LANES = 1024
#: Cells (four bytes) of the automata's table: classes of letters are as many as
#: they allow, of at most two states a character, but MIN_CLASSES at least. Rarer
#: letters are spelled in digits of this base.
TABLE_CELLS, MIN_CLASSES, BASE = 48 << 20, 64, 16
UNDETERMINED = "und"

_BLANK, _OTHER = 0, 1


class Folding:
    """Code points to classes: blank (anything but letters), the letters of the
    samples, and one class for all other letters.

    There are ``width`` classes at most. Where the samples have more letters the
    most frequent have classes of their own and the rest are spelled: a first
    digit and further ones, of two sets of BASE classes.
    """

    def __init__(self, texts: list[str], width: int = 1 << 20):
        counts = Counter(c.lower() for t in texts for c in t if c.isalpha())
        letters = sorted((c for c in counts if len(c) == 1), key=lambda c: (-counts[c], c))
        own = len(letters) if len(letters) + 2 <= width else width - 2 - 2 * BASE
        spelled = len(letters) - own
        self.first = own + 2
        self.size = self.first + 2 * BASE * (spelled > 0)
        self.digits = next(d for d in range(1, 9) if BASE**d >= spelled)
        table = np.zeros(0x110000, np.int32)
        for cp in range(0x110000):
            if chr(cp).isalpha():
                table[cp] = _OTHER
        for i, c in enumerate(letters):
            for form in {c, c.upper(), c.title()}:
                if len(form) == 1:
                    table[ord(form)] = i + 2
        self.table = table

    def __call__(self, text: str) -> np.ndarray:
        """Classes, runs of blanks as one."""
        cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        got = self.table[cps]
        keep = np.ones(len(got), bool)
        keep[1:] = (got[1:] != _BLANK) | (got[:-1] != _BLANK)
        got = got[keep]
        rare = got >= self.first
        if self.size == self.first or not rare.any():
            return got
        n = np.where(rare, self.digits, 1)
        out, starts = np.repeat(got, n), np.cumsum(n) - n
        rank, at = got[rare] - self.first, starts[rare]
        for d in range(self.digits):
            out[at + d] = self.first + BASE * (d > 0) + rank // BASE ** (self.digits - 1 - d) % BASE
        return out


def suffix_automaton(codes: np.ndarray, alphabet: int) -> np.ndarray:
    """Transitions [states, alphabet] of the suffix automaton, -1 where none."""
    n = len(codes)
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes.tolist():
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    out = np.full((len(nxt), alphabet), -1, np.int32)
    for s, edges in enumerate(nxt):
        for c, t in edges.items():
            out[s, c] = t
    assert n == 0 or len(nxt) <= 2 * n
    return out


class Model:
    """Automata of all languages as one table of (next row * 4 + phrases ended).

    A missing transition ends the phrase and starts one at that character; a
    character that the sample lacks is a phrase of its own.
    """

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        room = max(500, TOTAL_CHARS // max(1, len(samples)))
        texts = [samples[k] for k in self.langs]
        self.fold = Folding(texts)
        # fewer classes make the spelling longer, so until both fit
        while self.fold.size > (width := max(MIN_CLASSES, TABLE_CELLS // max(1, 2 * sum(min(room, len(self.fold(t))) for t in texts)))):
            self.fold = Folding(texts, width)
        a, tables, roots, at, cost = self.fold.size, [], [], 0, []
        for lang in self.langs:
            codes = self.fold(samples[lang])[:room]  # spelled letters take more room
            step = suffix_automaton(codes, a)
            root = step[0]
            ended = np.where(root >= 0, (root + at) * a * 4 + 1, at * a * 4 + 2)
            table = np.where(step >= 0, (step + at) * a * 4, ended[None, :])
            table[0] = np.where(root >= 0, table[0], at * a * 4 + 1)
            tables.append(table)
            roots.append(at * a)
            cost.append(np.log2(max(2, len(codes))))
            at += len(step)
        assert at * a * 4 < 1 << 31, "rows do not fit 32 bits"
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)
        self.roots, self.cost = np.array(roots, np.int64), np.array(cost)

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """[texts, languages]: phrases that each text is parsed into."""
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        width = max(64, LANES * 4 // max(4, len(self.langs)))
        parts = [(i, at) for i, codes in enumerate(texts) for at in range(0, len(codes), STRETCH)]
        before, apart = self.roots, set()
        for s in range(0, len(parts), width):
            lanes = parts[s : s + width]
            order = sorted(range(len(lanes)), key=lambda k: -min(STRETCH, len(texts[lanes[k][0]]) - lanes[k][1]))
            count, state, seen = self._parse([texts[lanes[k][0]][lanes[k][1] : lanes[k][1] + STRETCH] for k in order], CATCH)
            back = np.argsort(order)
            before, apart_now = self._joined(texts, lanes, count[:, back], state[:, back], seen[0][:, :, back], seen[1][:, :, back], before, out)
            apart |= apart_now
        for i, k in apart:
            out[i, k] = self._in_one_go(texts[i], k)
        return out

    def _parse(self, parts: list[np.ndarray], keep: int = 0) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """Phrases ended [languages, parts] and last states of parts in descending
        length, each parsed from the root; states and counts after each of the
        first ``keep`` characters."""
        n = np.array([len(x) for x in parts])
        text = np.zeros((int(n[0]), len(parts)), self.table.dtype)
        for j, x in enumerate(parts):
            text[: n[j], j] = x
        live = np.searchsorted(-n, -np.arange(int(n[0])) - 0.5)  # parts longer than t
        count = np.zeros((len(self.langs), len(parts)), np.int32)
        state = np.repeat(self.roots[:, None], len(parts), axis=1).astype(self.table.dtype)
        states = np.zeros((keep, *state.shape), self.table.dtype)
        counts = np.zeros((keep, *state.shape), np.int16)
        for t, m in enumerate(live.tolist()):
            got = self.table.take(state[:, :m] + text[t, :m])
            count[:, :m] += got & 3
            state[:, :m] = got >> 2
            if t < keep:
                states[t], counts[t] = state, count
        return count, state, (states, counts)

    def _joined(self, texts, parts, count, state, states, counts, before, out) -> tuple[np.ndarray, set[tuple[int, int]]]:
        """Adds the phrases of consecutive ``parts`` (text, start) to ``out``;
        ``before``: the last states of the part before them. Returns the last
        part's, and the (text, language) whose parses have not met."""
        start = np.array([at for _, at in parts])
        entry = np.concatenate([np.asarray(before).reshape(-1, 1), state[:, :-1]], axis=1)
        lang, lane = np.nonzero((entry != self.roots[:, None]) & (start > 0))
        left = np.array([min(CATCH, len(texts[i]) - at) for i, at in parts])
        head = np.zeros((CATCH, len(parts)), self.table.dtype)
        for j, (i, at) in enumerate(parts):
            head[: left[j], j] = texts[i][at : at + left[j]]
        now, ended = entry[lang, lane], np.zeros(len(lang), np.int32)
        for t in range(CATCH):
            if not len(lang):
                break
            got = self.table.take(now + head[t, lane])
            ended, now = ended + (got & 3), got >> 2
            met = now == states[t, lang, lane]
            over = ~met & (t + 1 == left[lane]) & (left[lane] < CATCH)
            done = met | over
            if done.any():
                np.add.at(count, (lang[done], lane[done]), ended[done] - counts[t, lang[done], lane[done]])
                state[lang[over], lane[over]] = now[over]
                lang, lane, now, ended = lang[~done], lane[~done], now[~done], ended[~done]
        apart = {(parts[j][0], k) for j, k in zip(lane.tolist(), lang.tolist(), strict=True)}
        for j, (i, at) in enumerate(parts):
            out[i] += count[:, j]
            if at + STRETCH >= len(texts[i]):  # a phrase that the end cuts off
                out[i] += state[:, j] != self.roots
        return state[:, -1], apart

    def _in_one_go(self, codes: np.ndarray, lang: int) -> int:
        table, root, count = memoryview(self.table), int(self.roots[lang]), 0
        state = root
        for c in codes.tolist():
            got = table[state + c]
            count += got & 3
            state = got >> 2
        return count + (state != root)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        codes = [self.fold(t) if t else np.zeros(0, np.int32) for t in texts]
        has = np.array([bool((c != _BLANK).any()) for c in codes])
        lang, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        if not self.langs or not has.any():
            return lang, score
        at = np.flatnonzero(has)
        bits = self.phrases([codes[i] for i in at]) * self.cost
        best = bits.argmin(axis=1)  # ties: the first language by name
        least = bits[np.arange(len(at)), best]
        # posterior of the code lengths, one bit a phrase so as not to saturate
        share = np.exp2(np.clip(-(bits - least[:, None]) / self.cost.mean(), -60, 0))
        score[at] = 1 / share.sum(axis=1)
        for i, b in zip(at, best, strict=True):
            lang[i] = self.langs[b]
        return lang, score


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_chars: int = SAMPLE_CHARS) -> dict[str, str]:
    """Training text per language, at most ``sample_chars`` characters of each
    (fewer where there are so many languages that TOTAL_CHARS is shared).

    Documents come in the order of a hash of the id; a first pass counts what
    there is, a second brings about SAMPLE_DOCS documents per language.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(is_held_out(F.col("doc_id")), F.lit(False)))
    fits = F.char_length("text") <= SAMPLE_DOC_CHARS
    counts = {r["lang"]: r for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(fits.cast("int")).alias("short")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect()}
    if not counts:
        return {}
    chars = min(sample_chars, max(500, TOTAL_CHARS // len(counts)))
    share = F.lit(0.0)
    for lang, r in counts.items():
        n = r["short"] or r["n"]
        rate = min(1.0, SAMPLE_DOCS / n)
        share = F.when(F.col("lang") == lang, F.lit(rate) if not r["short"] else F.when(fits, F.lit(rate)).otherwise(F.lit(0.0))).otherwise(share)
    order = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("sample")), 11).cast("double") / float(1 << 53)
    # of a longer text the start is enough for a sample
    got = rows.filter(order < share).select("lang", order.alias("o"), F.substring("text", 1, chars).alias("text")).collect()
    out: dict[str, list[str]] = {}
    for r in sorted(got, key=lambda r: (r["lang"], r["o"], r["text"])):
        texts = out.setdefault(r["lang"], [])
        room = chars - sum(map(len, texts))
        if room > 0 and r["text"][:room] not in texts:
            texts.append(r["text"][:room])
    return {k: "\n".join(v)[:chars] for k, v in out.items()}


_models: dict[int, Model] = {}


def _model(samples: dict[str, str]) -> Model:
    """The model of some samples, built once a Python worker."""
    key = hash(tuple(sorted(samples.items())))
    if key not in _models:
        _models.clear()
        _models[key] = Model(samples)
    return _models[key]


def _groups(texts: list[str | None], chars: int = 1 << 20):
    start, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t or "")
        if n >= chars or i - start >= LANES:
            yield start, i + 1
            start, n = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def predict(docs: DataFrame, samples: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row.

    ``lang_pred`` is 'und' with score 0 for a null text, one without a letter,
    or where no language was learned. Score is the winner's share when each
    further phrase halves a language's weight (1: beyond doubt). Ties go to the
    first language by name. A null id counts as not held out; repeated rows
    each count; an empty table gives no rows; other columns are ignored.
    """
    def run(batches):
        model = _model(samples)
        for batch in slices(batches, LANES):
            texts = batch.column(2).to_pylist()
            for a, b in _groups(texts):
                lang, score = model.predict(texts[a:b])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(lang, pa.string()), pa.array(score)],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(is_held_out(F.col(id_col)), F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return whole_texts(rows, LANES).mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, samples: dict[str, str], text_col: str = "text", langs: set[str] | None = None, min_score: float = 0.0) -> DataFrame:
    """The rows, unchanged, whose language is determined (and in ``langs``, if
    given) with at least ``min_score``."""
    at = docs.columns.index(text_col)

    def run(batches):
        model = _model(samples)
        for batch in slices(batches, LANES):
            texts = batch.column(at).to_pylist()
            for a, b in _groups(texts):
                lang, score = model.predict(texts[a:b])
                ok = [x != UNDETERMINED and (langs is None or x in langs) and s >= min_score for x, s in zip(lang, score, strict=True)]
                yield batch.slice(a, b - a).filter(pa.array(ok, pa.bool_()))

    return whole_texts(docs, LANES).mapInArrow(run, docs.schema)
