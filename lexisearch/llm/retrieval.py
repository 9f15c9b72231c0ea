"""Packing by lexical retrieval.

Every document is in one shard of a BM25 inverted index. Shards hold texts that are
alike, so that a document's nearest neighbours are mostly in its own: documents are laid
out in one order, by the leaves of a tree of halving planes (principal directions of
hashed TF-IDF vectors, fitted on a sample of ``SAMPLE`` documents), and the order is cut
into shards of about ``SHARD_WORDS`` words. Documents with the same least shingle hash,
as copies have with the chance of their similarity, go to the leaf of the least of them,
and lie together there. A group of copies of any size is thus cut as all else is.

Inside a shard, in order of id, each unused document opens a window and asks the index
for its unused neighbours, with all its distinct terms as the query; the best that still
fits joins, until none that fits has a positive score. Document counts, lengths and
document frequencies are exact and those of the whole corpus, so a shard scores as the
whole would.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexisearch.llm._spark import id_text, load, materialize, ranked
from lexisearch.llm._text import flat, mix, pieces, word_spans, words

WINDOW = 2048
K1, B = 1.2, 0.75
#: A shard has about so many words or documents, whichever makes more shards.
SHARD_WORDS = 1 << 20
SHARD_DOCS = 4096
#: The tree that lays documents out is fitted on about so many of them, and is so deep.
SAMPLE = 4096
DEPTH = 12
#: Length of the vectors it halves, principal directions it has to choose from, and buckets of terms for the vectors' weights.
WIDTH, DIRECTIONS, BUCKETS = 512, 24, 1 << 16
SEPARATOR = "\n\n"


def _terms(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, term, count) of each distinct term of each text, by owner."""
    owner = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))
    key = np.sort((owner << np.uint64(44)) | (h >> np.uint64(20)))
    if not len(key):
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return (key[at] >> np.uint64(44)).astype(np.int64), key[at] & np.uint64((1 << 44) - 1), np.diff(np.append(at, len(key)))


@dataclass(frozen=True)
class Layout:
    """Weights of terms by bucket, the mean vector, directions, and for each node of the
    tree (its children at 2i+1 and 2i+2) the direction that halves it and where."""

    idf: np.ndarray
    mean: np.ndarray
    directions: np.ndarray
    axis: np.ndarray
    at: np.ndarray


def vectors(owner: np.ndarray, term: np.ndarray, tf: np.ndarray, n: int, idf: np.ndarray) -> np.ndarray:
    """Hashed TF-IDF vectors of length 1; zeros for texts without a term."""
    h = mix(term)
    weight = idf[(h % np.uint64(BUCKETS)).astype(np.int64)] * (tf / (tf + K1)) * np.where(h >> np.uint64(63), 1.0, -1.0)
    place = (h >> np.uint64(20)) % np.uint64(WIDTH)
    v = np.bincount(owner * WIDTH + place.astype(np.int64), weight, n * WIDTH).reshape(n, WIDTH)
    return v / np.maximum(np.linalg.norm(v, axis=1), 1e-12)[:, None]


def _spots(v: np.ndarray, layout_mean: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Places along the directions, rounded so that they do not follow the batches."""
    return np.round((v - layout_mean) @ directions.T, 6)


def fitted(terms: list[tuple[np.ndarray, np.ndarray]], depth: int = DEPTH) -> Layout:
    """The layout for a sample, given as (terms, counts) of each text."""
    n = len(terms)
    owner = np.repeat(np.arange(n), [len(t) for t, _ in terms])
    term = np.concatenate([t for t, _ in terms]) if n else np.empty(0, np.uint64)
    tf = np.concatenate([c for _, c in terms]) if n else np.empty(0, np.int64)
    df = np.bincount((mix(term) % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
    idf = np.log1p(n / (df + 1.0))
    v = vectors(owner, term, tf, n, idf)
    mean = v.mean(axis=0) if n else np.zeros(WIDTH)
    directions = np.linalg.svd(v - mean, full_matrices=False)[2][:DIRECTIONS] if n else np.zeros((1, WIDTH))
    x = _spots(v, mean, directions)
    nodes = (1 << depth) - 1
    axis, at = np.zeros(nodes, np.int32), np.zeros(nodes)
    inside = {0: np.arange(n)}
    for i in range(nodes):
        mine = inside.pop(i, np.empty(0, np.int64))
        if len(mine) > 1:
            axis[i] = x[mine].var(axis=0).argmax()
            y = np.sort(x[mine, axis[i]])
            at[i] = (y[(len(y) - 1) // 2] + y[(len(y) - 1) // 2 + 1]) / 2 + 1e-7
            over = x[mine, axis[i]] > at[i]
            inside[2 * i + 1], inside[2 * i + 2] = mine[~over], mine[over]
    return Layout(idf, mean, directions, axis, at)


def leaves(v: np.ndarray, m: Layout) -> np.ndarray:
    x, node = _spots(v, m.mean, m.directions), np.zeros(len(v), np.int64)
    while len(node) and node[0] < len(m.axis):
        node = 2 * node + 1 + (x[np.arange(len(x)), m.axis[node]] > m.at[node])
    return node - len(m.axis)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Layout:
    """The layout, fitted in one task on about ``sample`` documents, which a hash picks."""
    n = docs.count()
    span = 1 << 40
    few = docs.select(F.xxhash64("text", "doc_id").alias("h"), "text").where(F.pmod("h", F.lit(span)) < min(span, span * sample // max(n, 1) + 1))

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                h, first = words(part.column(1))
                owner, term, tf = _terms(h, first)
                at = np.searchsorted(owner, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([term[a:b].tobytes() for a, b in pairwise(at)], pa.binary()), pa.array([tf[a:b].tobytes() for a, b in pairwise(at)], pa.binary())], ["h", "terms", "tf"])

    def run(table: pa.Table) -> pa.Table:
        # Of rows alike, of which there may be many, one is enough.
        rows = sorted(set(zip(*(c.to_pylist() for c in table.columns[:3]), strict=True)))[: 2 * sample]
        m = fitted([(np.frombuffer(t, np.uint64), np.frombuffer(c, np.int64)) for _, t, c in rows])
        return pa.table({"model": pa.array([pickle.dumps(m)], pa.binary())})

    one = few.mapInArrow(terms, "h bigint, terms binary, tf binary").dropDuplicates(["h"]).withColumn("all", F.lit(0))
    found = one.groupBy("all").applyInArrow(run, "model binary").collect()
    return pickle.loads(found[0][0]) if found else fitted([])


def routed(docs: DataFrame, layout: Layout) -> DataFrame:
    """(doc_id, h, leaf, least, n_words) of texts that have a word; ``h`` is the text's hash, ``least`` its least shingle hash."""
    shared = docs.sparkSession.sparkContext.broadcast(layout)
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("leaf", pa.int32()), ("least", pa.int64()), ("n_words", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                w, first = words(part.column(2))
                n = np.diff(first)
                v = vectors(*_terms(w, first), len(n), shared.value.idf)
                ids, at = neighbours(w, first)
                full = n > 0
                least = np.full(len(n), np.iinfo(np.int64).max)
                if len(ids):
                    least[full] = np.minimum.reduceat(ids, at[:-1][full])
                columns = [part.column(0), part.column(1), pa.array(leaves(v, shared.value).astype(np.int32)), pa.array(least), pa.array(n)]
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(full)) for c in columns], schema=schema)

    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    return rows.mapInArrow(run, "doc_id bigint, h bigint, leaf int, least bigint, n_words bigint")


def neighbours(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mixed hashes of each text's runs of three words, index of each text's first); a shorter text has one."""
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    padded = np.concatenate([h, np.zeros(2, np.uint64)])
    i = np.arange(len(h))
    take = (i + 3 <= first[1:][doc]) | (i == first[:-1][doc])
    i, doc = i[take], doc[take]
    end = first[1:][doc]
    x = padded[i] * np.uint64(0x9E3779B97F4A7C15)
    x += np.where(i + 1 < end, padded[i + 1], np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    x += np.where(i + 2 < end, padded[i + 2], np.uint64(2)) * np.uint64(0x165667B19E3779F9)
    return mix(x).view(np.int64), np.searchsorted(doc, np.arange(len(n) + 1))


def shards(routes: DataFrame, shard_words: int, shard_docs: int) -> DataFrame:
    """(doc_id, h, shard) of each different row: the order cut by words, or by documents where these are more.

    ``routes`` has repeated rows once, with their number in ``copies``; they share a shard
    unless they are more than it holds, and then are dealt to as many as they fill.
    """
    leaf = routes.groupBy("least").agg(F.min_by("leaf", F.struct("doc_id", "h")).alias("home"))
    weight = F.greatest("n_words", F.lit(max(1, shard_words // shard_docs))) * F.col("copies")
    laid = routes.select("doc_id", "h", "least", weight.alias("weight"), "copies").join(leaf, "least")
    placed = ranked(laid.select("home", "least", "doc_id", "h", "weight", "copies"), ["home", "least", "doc_id", "h"], "place", "weight")
    begin = F.col("weight_before")
    out = placed.select("doc_id", "h", F.floor(begin / shard_words).cast("bigint").alias("shard"), F.greatest(F.lit(1), F.ceil(F.col("weight") / shard_words)).cast("int").alias("spread"))
    return out


class Index:
    """BM25 impacts of a shard's pieces, by term."""

    def __init__(self, owner: np.ndarray, term: np.ndarray, tf: np.ndarray, size: np.ndarray, idf: np.ndarray, average: float):
        """``idf`` of each posting."""
        self.n = len(size)
        weight = idf * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[owner] / average)))
        order = np.argsort(term, kind="stable")
        term = term[order]
        head = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.empty(0, np.int64)
        span = np.diff(np.append(head, len(term)))
        number = np.empty(len(term), np.int64)
        number[order] = np.repeat(np.arange(len(head)), span)
        self.start, self.span = head, span
        self.doc, self.weight = owner[order], weight[order]
        self.query = number  # term numbers of each piece, by piece
        self.at = np.searchsorted(owner, np.arange(self.n + 1))

    def scores(self, piece: int) -> np.ndarray:
        """BM25 score of every piece for all distinct terms of this one."""
        t = self.query[self.at[piece] : self.at[piece + 1]]
        t = t[self.span[t] > 1]
        span = self.span[t]
        if not len(t):
            return np.zeros(self.n)
        to = np.cumsum(span)
        take = np.arange(to[-1]) + np.repeat(self.start[t] - to + span, span)
        return np.bincount(self.doc[take], self.weight[take], self.n)


def fill(index: Index, size: np.ndarray, window: int) -> list[list[tuple[int, float]]]:
    """Windows as lists of (piece, score); a window's first piece is its seed, with score 0.

    Of equal scores the earlier piece is taken.
    """
    free = np.ones(len(size), bool)
    out = []
    for seed in range(len(size)):
        if not free[seed]:
            continue
        free[seed] = False
        mine, room = [(seed, 0.0)], window - int(size[seed])
        if room and free.any():
            score = index.scores(seed)
            score[~free] = 0
            while room:
                fits = np.where(size <= room, score, 0)
                best = int(fits.argmax())
                if fits[best] <= 0:
                    break
                mine.append((best, float(fits[best])))
                free[best], score[best] = False, 0
                room -= int(size[best])
        out.append(mine)
    return out


PACKED = "shard bigint, window_no int, doc_ids array<bigint>, parts array<int>, scores array<double>, n_words int, text string"
_PACKED = pa.schema(
    [("shard", pa.int64()), ("window_no", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("parts", pa.list_(pa.int32())), ("scores", pa.list_(pa.float64())), ("n_words", pa.int32()), ("text", pa.string())]
)


def _cut(text: bytes, start: np.ndarray, window: int) -> list[bytes]:
    edges = [0, *start[window::window].tolist(), len(text)]
    return [text[a:b] for a, b in pairwise(edges)]


def pack_shard(ids: list, texts: pa.Array, known: tuple[np.ndarray, np.ndarray], n_docs: int, average: float, window: int) -> list[tuple[list, list[int], list[float], int, bytes]]:
    """The windows of one shard: (ids, part numbers, scores, words, text).

    ``known`` has the terms, ascending, that several texts of the shard have, and the
    corpus's document frequencies of these; no other term joins two texts.
    """
    h, first = words(texts)
    n = np.diff(first)
    data, off = flat(texts)
    raw = data.tobytes()
    out, doc, part, begin, text = [], [], [], [], []
    for k in np.flatnonzero(n):
        whole = raw[off[k] : off[k + 1]]
        cuts = [whole] if n[k] <= window else _cut(whole, word_spans(texts.slice(k, 1))[2], window)
        for i, x in enumerate(cuts):
            if n[k] - i * window >= window:
                out.append(([ids[k]], [i], [0.0], window, x))
            else:
                doc.append(ids[k]), part.append(i), begin.append(int(first[k]) + i * window), text.append(x)
    if doc:
        size = np.array([min(window, int(first[np.searchsorted(first, b, "right")]) - b) for b in begin])
        edge = np.concatenate([[0], np.cumsum(size)])
        take = np.arange(edge[-1]) + np.repeat(np.array(begin) - edge[:-1], size)
        owner, term, tf = _terms(h[take], edge)
        at = np.minimum(np.searchsorted(known[0], term), max(len(known[0]) - 1, 0))
        # The parts of one long text may share a term that no other text of the shard has.
        df = np.where(known[0][at] == term, known[1][at], 1) if len(known[0]) else np.ones(len(term))
        index = Index(owner, term, tf, size, np.log1p((n_docs - df + 0.5) / (df + 0.5)), average)
        for mine in fill(index, size, window):
            at = [p for p, _ in mine]
            out.append(([doc[p] for p in at], [part[p] for p in at], [s for _, s in mine], int(size[at].sum()), SEPARATOR.encode().join(text[p] for p in at)))
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """One row a window: its shard and number, the documents in it and which part of
    each, their scores against the window's first, its words and its text.

    A text over ``window`` words is cut into windows without loss; what is left of it
    is packed like a short text, under its part number. Texts without a word, and
    nulls, are in no window. Every other row is in windows exactly once, repeated rows
    each; a null id stays null. Rows of equal ids are ordered by text. Other columns
    are ignored; an empty table gives no windows.
    """
    docs = id_text(docs, id_col, text_col).where("text is not null")
    found = routed(docs, fit(docs)).groupBy("doc_id", "h").agg(F.first("leaf").alias("leaf"), F.first("least").alias("least"), F.first("n_words").alias("n_words"), F.count("*").alias("copies"))
    routes = materialize(found)
    n, total = routes.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.coalesce(F.sum(F.col("n_words") * F.col("copies")), F.lit(0))).first()
    average = total / max(n, 1)
    where = shards(routes, shard_words, shard_docs)
    # Null ids take part in the join by a column of their own.
    key = ["doc", "known", "h"]
    of = lambda df: df.withColumn("doc", F.coalesce("doc_id", F.lit(0))).withColumn("known", F.col("doc_id").isNotNull())
    keyed = of(docs.withColumn("h", F.xxhash64("text")))
    placed = of(where).drop("doc_id")
    columns = ["doc_id", "text", F.col("shard").cast("bigint").alias("shard"), "copies"]
    dealt = keyed.join(placed.where("spread = 1").drop("spread"), key).withColumn("copies", F.lit(1).cast("bigint")).select(*columns)
    hot = placed.where("spread > 1")
    if not hot.isEmpty():
        # Copies of one row that fill several shards travel once to each. There are no more such rows than shards.
        one = keyed.join(F.broadcast(hot), key).groupBy(*key, "shard", "spread").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count("*").alias("all"))
        turns = one.withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("spread") - 1)))
        mine = F.expr("all div spread + if(turn < all % spread, 1, 0)")
        dealt = dealt.union(turns.withColumn("shard", F.col("shard") + F.col("turn")).withColumn("copies", mine).where("copies > 0").select(*columns))

    def count(table: pa.Table) -> pa.Table:
        h, first = words(table.column("text").combine_chunks())
        owner, term, _ = _terms(h, first)
        term, back = np.unique(term, return_inverse=True)
        n = np.bincount(back, table.column("copies").to_numpy()[owner], len(term)).astype(np.int64)
        return pa.table([pa.array(np.full(len(term), table.column("shard")[0].as_py())), pa.array(term.astype(np.int64)), pa.array(n)], names=["shard", "term", "n"])

    def run(table: pa.Table, counts: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _PACKED.empty_table()
        table = table.take(pa.array(np.repeat(np.arange(table.num_rows), table.column("copies").to_numpy())))
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()
        counts = counts.sort_by("term")
        known = counts.column("term").to_numpy().astype(np.uint64), counts.column("df").to_numpy()
        made = pack_shard(table.column("doc_id").to_pylist(), table.column("text").combine_chunks(), known, n, average, window)
        k = len(made)
        columns = list(zip(*made, strict=True)) or [[]] * 5
        return pa.Table.from_arrays([pa.array([table.column("shard")[0].as_py()] * k, pa.int64()), pa.array(range(k), pa.int32()), *(pa.array(c if f.name != "text" else [x.decode() for x in c], f.type) for c, f in zip(columns, list(_PACKED)[2:], strict=True))], schema=_PACKED)

    # One plan: the texts are shuffled to their shards once, for counting and for packing.
    local = dealt.groupBy("shard").applyInArrow(count, "shard bigint, term bigint, n bigint")
    df = local.groupBy("term").agg(F.sum("n").alias("df"), F.max("n").alias("most")).where("most > 1").select("term", "df")
    needed = local.where("n > 1").join(df, "term").select("shard", "term", "df")
    return dealt.groupBy("shard").cogroup(needed.groupBy("shard")).applyInArrow(run, PACKED)


def op5_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents"))
