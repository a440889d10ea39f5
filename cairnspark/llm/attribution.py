"""Token counts by section: encode whole documents once, then attribute.

A byte-level tokenizer's tokens tile the text's UTF-8 bytes, so the running sum
of token lengths maps every token to its span. Spans are interval-joined to the
sections of the document (both are sorted: a binary search per token edge), and
a token that crosses a boundary is allocated by RULE:

* ``majority`` - to the section that holds most of its bytes, the earlier on ties;
* ``start``    - to the section of its first byte;
* ``split``    - to each section by its share of the bytes (fractional counts).

Encoding whole documents keeps merges that cross section boundaries; counting
the sections alone would not add up to the document's count.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_texts

RULES = ("majority", "start", "split")
_encoders: dict[str, tuple] = {}


def encoder(path: str, pattern: str):
    """(encoding, bytes of each token) of a ranks file, one a Python worker."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            size[rank] = len(token)
        _encoders[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), size
    return _encoders[path]


def attribute(ends: np.ndarray, cuts: np.ndarray, rule: str) -> np.ndarray:
    """Tokens per section. ``ends``: end byte of each token; ``cuts``: end byte
    of each section, ascending, the last one being the text's end."""
    begins = np.concatenate([np.zeros(1, np.int64), ends[:-1]])
    first = np.searchsorted(cuts, begins, side="right")  # section of the first byte
    last = np.searchsorted(cuts, ends - 1, side="right")  # and of the last
    out = np.zeros(len(cuts))
    whole = first == last
    np.add.at(out, first[whole], 1)
    if rule == "start":
        np.add.at(out, first[~whole], 1)
        return out
    for t in np.flatnonzero(~whole).tolist():
        a, b, s, e = begins[t], ends[t], first[t], last[t]
        edges = np.concatenate([[a], cuts[s:e], [b]])
        share = np.diff(edges)
        if rule == "split":
            out[s : e + 1] += share / (b - a)
        else:
            out[s + int(share.argmax())] += 1
    return out


SCHEMA = "doc_id bigint, section int, n_bytes bigint, n_tokens double"


def section_tokens(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", rule: str = "majority", separator: str = "\n") -> DataFrame:
    """Per (row, section): doc_id, section (0..), n_bytes, n_tokens.

    Sections are the stretches between separators; a separator belongs to the
    section that it ends, so sections tile the text. A text's n_tokens sum to
    the tokens of the whole text. Edge cases: a null or empty text has one
    section of no bytes and no tokens; an empty section in between has its
    separator only; null ids stay null; repeated rows repeat their rows; an
    empty table gives no rows. Other columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    sep = separator.encode()

    def run(batches):
        enc, size = encoder(ranks, pattern)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for s in range(0, len(ids), 256):
                cols: list[list] = [[], [], [], []]
                for doc, text in zip(ids[s : s + 256], texts[s : s + 256], strict=True):
                    lengths = [len(x) + len(sep) for x in (text or "").encode().split(sep)]
                    lengths[-1] -= len(sep)
                    if len(lengths) > 1 and not lengths[-1]:
                        lengths.pop()  # the text ends with a separator
                    cuts = np.cumsum(lengths)
                    tokens = np.array(enc.encode_ordinary(text), np.int64) if text else np.zeros(0, np.int64)
                    got = attribute(np.cumsum(size[tokens]), cuts, rule) if len(tokens) else np.zeros(len(cuts))
                    cols[0] += [doc] * len(cuts)
                    cols[1] += range(len(cuts))
                    cols[2] += lengths
                    cols[3] += got.tolist()
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "section", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return whole_texts(rows).mapInArrow(run, SCHEMA)
