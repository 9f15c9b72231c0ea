"""Quality by weak supervision.

Twelve rules look at each whole text; each votes good (+1), bad (-1) or abstains
(0). No rule rejects by itself. Expectation-maximisation over the votes of all
documents estimates, without labels, how often each rule is right about good and
about bad documents, and from these the posterior probability that a document is
good. An abstention says nothing.

EM needs only how many documents have each vote pattern: one aggregation whose
result has at most 3**12 rows however large the corpus, so the iterations run on
the driver over a table of fixed size, and each is exact over all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexisearch.llm._spark import load
from lexisearch.llm._text import _hash, flat, pieces, words

RULES = ("symbols", "letters", "capitals", "exclamations", "bars", "echoes", "variety", "repeated_lines", "function_words", "word_length", "length", "sentence_ends")
KEEP = 0.5
ITERATIONS = 200
_FUNCTION = (
    "the of and to a in is that it for on with as was by are this be from at which or an have not but "
    "der die und das ist nicht ein eine zu mit den von für auf im sich des dem als auch sie "
    "el la de que y en los se del las un por con una para es lo su más "
    "le les et du est dans qui au pour pas sur il elle ne ce des une"
).split()
_STOP = np.unique(words(pa.array([" ".join(_FUNCTION)]))[0])
_LOW, _UP, _DIGIT, _SPACE, _USUAL, _MARK, _BAR, _WIDE = range(8)
_KIND = np.full(256, 9, np.uint8)
for _chars, _k in (("abcdefghijklmnopqrstuvwxyz", _LOW), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", _UP), ("0123456789", _DIGIT), (" \t\r\n", _SPACE), (".,;:?'\"()-", _USUAL), ("!", _MARK), ("|", _BAR)):
    for _c in _chars:
        _KIND[ord(_c)] = _k
_KIND[0xC0:] = _WIDE  # the first byte of a wider character; its other bytes count for nothing
_KIND[0x80:0xC0] = 10
_OTHER = 9


def _per(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def _distinct(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    owner = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))
    key = np.unique((owner << np.uint64(44)) | (hashes >> np.uint64(20)))
    return np.bincount((key >> np.uint64(44)).astype(np.int64), minlength=len(first) - 1)


def features(arr: pa.Array) -> dict[str, np.ndarray]:
    """Counts and shares of each text; shares of nothing are 0."""
    data, off = flat(arr)
    kind = _KIND[data]
    n = {k: _per(kind == k, off) for k in (_LOW, _UP, _DIGIT, _SPACE, _MARK, _BAR, _WIDE, _OTHER, _USUAL)}
    h, first = words(arr)
    count = np.diff(first)
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    same[first[:-1][count > 0]] = False
    at = np.searchsorted(_STOP, h)
    stop = _STOP[np.minimum(at, len(_STOP) - 1)] == h

    cut = np.flatnonzero(data == 10)
    start = np.unique(np.concatenate([off[:-1][np.diff(off) > 0], cut + 1]))
    start = start[start < len(data)]
    end = np.append(start[1:], len(data))
    end = np.where(np.isin(end - 1, cut, assume_unique=False), end - 1, end)
    full = end > start
    start, end = start[full], end[full]
    lines_at = np.searchsorted(start, off)
    lines = np.diff(lines_at)
    unlike = _distinct(_hash(data, start, end - start), lines_at)
    closed = _per(np.isin(data[end - 1], np.frombuffer(b".!?:;\"')", np.uint8)), lines_at)

    def share(x: np.ndarray, of: np.ndarray) -> np.ndarray:
        return x / np.maximum(of, 1)

    ascii_letters = n[_LOW] + n[_UP]
    chars = sum(n.values())
    solid = chars - n[_SPACE]
    return {
        "words": count,
        "lines": lines,
        "symbols": share(n[_OTHER] + n[_BAR], chars),
        "letters": share(ascii_letters + n[_WIDE] + n[_DIGIT], solid),
        "capitals": share(n[_UP], ascii_letters),
        "exclamations": share(n[_MARK], count),
        "bars": share(n[_BAR], count),
        "echoes": share(_per(same, first), count),
        "latin": share(ascii_letters, ascii_letters + n[_WIDE]),
        "variety": share(_distinct(h, first), count),
        "repeated_lines": share(lines - unlike, lines),
        "function_words": share(_per(stop, first), count),
        "word_length": share(ascii_letters + n[_WIDE] + n[_DIGIT], count),
        "sentence_ends": share(closed, lines),
    }


def votes(arr: pa.Array) -> np.ndarray:
    """One row a text, one column a rule: 1, 0 or -1. A text without a word gets -1 throughout."""
    f = features(arr)
    nw, many = f["words"], f["words"] >= 50

    def between(x: np.ndarray, good: np.ndarray, bad: np.ndarray) -> np.ndarray:
        return np.where(good, 1, np.where(bad, -1, 0))

    def under(name: str, good: float, bad: float) -> np.ndarray:
        return between(f[name], f[name] <= good, f[name] >= bad)

    def over(name: str, good: float, bad: float, where: np.ndarray | bool = True) -> np.ndarray:
        return between(f[name], (f[name] >= good) & where, (f[name] <= bad) & where)

    size = f["word_length"]
    v = np.stack(
        [
            under("symbols", 0.02, 0.06),
            over("letters", 0.85, 0.75, nw >= 10),
            between(f["capitals"], (f["capitals"] <= 0.2) & (nw >= 5), (f["capitals"] >= 0.6) & (nw >= 5)),
            under("exclamations", 0.05, 0.3),
            under("bars", 0.01, 0.1),
            under("echoes", 0.05, 0.2),
            over("variety", 0.3, 0.12, many),
            between(f["lines"], (f["repeated_lines"] <= 0.1) & (f["lines"] >= 3), (f["repeated_lines"] >= 0.4) & (f["lines"] >= 3)),
            over("function_words", 0.12, 0.02, many & (f["latin"] >= 0.5)),
            between(size, (size >= 3) & (size <= 9), (size < 2) | (size > 15)),
            np.where(many, 1, 0),
            over("sentence_ends", 0.5, 0.1, f["lines"] >= 4),
        ],
        axis=1,
    ).astype(np.int8)
    v[nw == 0] = -1
    return v


_POWERS = 3 ** np.arange(len(RULES), dtype=np.int64)


def pattern(v: np.ndarray) -> np.ndarray:
    """Each row of votes as one number."""
    return (v.astype(np.int64) + 1) @ _POWERS


def unpack(patterns: np.ndarray) -> np.ndarray:
    return (patterns[:, None] // _POWERS % 3 - 1).astype(np.int8)


def fit(v: np.ndarray, count: np.ndarray, iterations: int = ITERATIONS) -> tuple[float, np.ndarray]:
    """(share of good documents, [P(vote good | good), P(vote good | bad)] of each rule).

    ``v`` has the distinct vote rows and ``count`` how many documents have each.
    A rule's chances are taken over the documents on which it votes, with one
    vote of each kind added, so none is 0 or 1; nothing else holds them. EM begins where
    every rule is nearly always right about good text and often wrong about bad.
    """
    good, bad = (v == 1).astype(float), (v == -1).astype(float)
    prior, chance = 0.8, np.tile([[0.99], [0.75]], (1, v.shape[1]))
    weight = count.astype(float)
    for _ in range(iterations):
        p = posterior(v, prior, chance)
        new = np.stack([((w := weight * q) @ good + 1) / (w @ (good + bad) + 2) for q in (p, 1 - p)])
        shift = np.abs(new - chance).max()
        prior, chance = float((weight @ p + 1) / (weight.sum() + 2)), new
        if shift < 1e-10:
            break
    return prior, chance


def posterior(v: np.ndarray, prior: float, chance: np.ndarray) -> np.ndarray:
    """P(good | votes) of each row."""
    good, bad = (v == 1).astype(float), (v == -1).astype(float)
    odds = np.log(prior) - np.log1p(-prior) + good @ np.log(chance[0] / chance[1]) + bad @ np.log((1 - chance[0]) / (1 - chance[1]))
    return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def patterns(docs: DataFrame, text_col: str = "text") -> pd.DataFrame:
    """(pattern, count) over all rows: at most 3**12 rows, whatever the size of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for part in pieces(batch, "text"):
                all_of = np.concatenate([seen[0], pattern(votes(part.column(0)))])
                key, back = np.unique(all_of, return_inverse=True)
                seen = key, np.bincount(back, np.concatenate([seen[1], np.ones(part.num_rows, np.int64)])).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in seen], ["pattern", "n"])

    counts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "pattern bigint, n bigint")
    return counts.groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").toPandas()


def _scores(docs: DataFrame, text_col: str) -> dict[int, float]:
    found = patterns(docs, text_col)
    v = unpack(found["pattern"].to_numpy(np.int64))
    return dict(zip(found["pattern"].tolist(), posterior(v, *fit(v, found["n"].to_numpy(np.int64))).tolist(), strict=True))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """(doc_id, votes, quality, kept) of every row: the rules' votes in the order of
    ``RULES``, the posterior probability that the text is good, and whether it is at
    least ``keep``.

    Two narrow passes over whole texts and an aggregation of vote patterns. A null
    text is as an empty one: every rule votes bad. Repeated rows each count and each
    get a row; null ids stay null; other columns are ignored; an empty table gives
    an empty result.
    """
    score = _scores(docs, text_col)
    schema = pa.schema([("doc_id", pa.int64()), ("votes", pa.list_(pa.int32())), ("quality", pa.float64()), ("kept", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                v = votes(part.column(1))
                p = np.array([score[k] for k in pattern(v).tolist()], float)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * len(RULES), pa.int32()), pa.array(v.reshape(-1).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(p), pa.array(p >= keep)], schema=schema)

    columns = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return columns.mapInArrow(run, "doc_id bigint, votes array<int>, quality double, kept boolean")


def keep_good(docs: DataFrame, text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """The rows whose text is good with probability ``keep`` or more, with all their columns."""
    score = _scores(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text_col):
                p = np.array([score[k] for k in pattern(votes(part.column(text_col))).tolist()], float)
                yield part.filter(pa.array(p >= keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(load(spark, sf_dir, "documents"))
