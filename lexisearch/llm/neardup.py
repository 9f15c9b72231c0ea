"""Near-duplicate groups with SetSketch registers.

A document is the set of its three-word shingles. Its sketch is a row of
registers, each the exponentially spaced, truncated minimum of one exponential
variable a shingle: the registers of a union are the larger ones of its parts
(mergeable), and two sets agree on a register with about their Jaccard
similarity (locality-sensitive). The steps:

* ``sketch``: one pass over the texts; registers, distinct shingles and a
  fingerprint of the whole set. Equal sets collapse to one document here, so
  thousands of exact copies cost a row each and no pairs.
* ``candidates``: four registers are a band; documents that share a band value
  meet. In a bucket everyone is paired with its least member first; later rounds
  pair the least members of the groups that share a bucket. What is then left apart
  in a bucket of up to ``SMALL_BUCKET`` members is paired member by member; in a
  larger one only members whose rarest shingles agree somewhere are, as any two of
  the threshold's similarity must (prefixes of the sets in one order of all
  shingles). No pair that reaches the threshold is left out by this, and documents that
  have much in common, but less than the threshold, make no pairs.
* ``estimate``: the Jaccard similarity that makes a pair's register comparisons
  likeliest, given the set sizes; far pairs end here.
* ``verify``: exact similarity of the shingle sets of what is left.
* Groups are the connected components of the verified pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexisearch.llm._spark import id_text, load, materialize, release
from lexisearch.llm._text import mix, pieces, words

SHINGLE = 3
REGISTERS = 128
BAND = 4
BASE = 1.001
RATE = 20.0
TOP = (1 << 16) - 2
THRESHOLD = 0.55
#: Standard errors by which an estimate may lie under the threshold and still be verified.
SLACK = 3.0
#: In buckets of more members pairs are made by their rarest shingles only.
SMALL_BUCKET = 48
#: Shingles are counted in so many hash buckets, for the order of prefixes only.
ORDER_BUCKETS = 1 << 20
#: Up to so many ids (16 MB) are broadcast to pick documents; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
_C = tuple(np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_ID_BITS = np.uint64(16)


def shingles(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(48-bit ids of the distinct shingles, first index of each text), sorted within a text.

    A text with fewer words than a shingle has one shingle of all of them.
    """
    h, first = words(arr)
    n = np.diff(first)
    if not len(h):
        return np.empty(0, np.uint64), np.zeros(len(arr) + 1, np.int64)
    doc = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(h)) - first[doc]
    padded = np.concatenate([h, np.zeros(SHINGLE, np.uint64)])
    whole = n[doc] - place >= SHINGLE
    take = np.flatnonzero(whole | (place == 0))
    x = padded[take] * _C[0]
    for j in range(1, SHINGLE):
        there = place[take] + j < n[doc[take]]
        x += np.where(there, padded[take + j], np.uint64(j)) * _C[j]
    key = np.sort((doc[take].astype(np.uint64) << np.uint64(48)) | (mix(x) >> _ID_BITS))
    key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    owner = (key >> np.uint64(48)).astype(np.int64)
    return key & np.uint64((1 << 48) - 1), np.searchsorted(owner, np.arange(len(n) + 1))


def fingerprints(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit number of each whole set."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(ids * _C[1]), dtype=np.uint64)])
    return mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64)).view(np.int64)


def registers(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Registers of each set, one row a set; an empty set has zeros.

    A shingle's exponential values come in ascending order, each for the next
    register of its own permutation. It stops as soon as its value can change no
    register of its set, which for most shingles is after one or two.
    """
    sets, m = len(first) - 1, REGISTERS
    least = np.full((sets, m), np.inf)
    owner = np.repeat(np.arange(sets), np.diff(first))
    at, step = mix(ids * _C[0]), mix(ids * _C[1] + _C[2])
    reg, stride = (at & np.uint64(m - 1)).astype(np.int64), (step & np.uint64(m - 1)).astype(np.int64) | 1
    x, rnd = np.zeros(len(ids)), step
    for j in range(m):
        rnd = mix(rnd + _C[1])
        x = x - np.log(((rnd >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (RATE * (m - j))
        np.minimum.at(least.reshape(-1), owner * m + reg, x)
        live = np.flatnonzero(x < least.max(axis=1)[owner])
        if not len(live):
            break
        owner, reg, stride, x, rnd = owner[live], (reg[live] + stride[live]) & (m - 1), stride[live], x[live], rnd[live]
    with np.errstate(divide="ignore"):
        k = np.floor(1 - np.log(least) / np.log(BASE))
    return np.clip(k, 0, TOP + 1).astype(np.uint16)


SKETCH = "doc_id bigint, n bigint, fp bigint, sketch binary"
_SKETCH = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("fp", pa.int64()), ("sketch", pa.binary())])


def sketch(docs: DataFrame) -> DataFrame:
    """Sketches of the texts that have a word; a narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                ids, first = shingles(part.column(1))
                n = np.diff(first)
                full = n > 0
                fp, rows = fingerprints(ids, first), registers(ids, first)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).filter(pa.array(full)), pa.array(n[full]), pa.array(fp[full]), pa.array([r.tobytes() for r in rows[full]], pa.binary())], schema=_SKETCH
                )

    return docs.where("doc_id is not null and text is not null").mapInArrow(run, SKETCH)


def _bands(sketches: DataFrame) -> DataFrame:
    """(band, doc_id): a band's value with its number mixed in."""
    count = REGISTERS // BAND
    width = 2 * BAND
    schema = pa.schema([("band", pa.int64()), ("doc_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = mix(np.arange(1, count + 1, dtype=np.uint64))
        for batch in batches:
            if not batch.num_rows:
                continue
            value = np.frombuffer(b"".join(batch.column(1).to_pylist()), f"<u{width}").reshape(-1, count)
            yield pa.RecordBatch.from_arrays([pa.array((mix(value ^ number)).reshape(-1).view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), count))], schema=schema)

    return sketches.select("doc_id", "sketch").mapInArrow(run, "band bigint, doc_id bigint")


def joint(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The likeliest Jaccard similarity of each pair of register rows, given the set sizes."""
    plus, minus = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = a.shape[1] - plus - minus
    u, v = na / (na + nb), nb / (na + nb)
    grow = (BASE - 1) / BASE

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-x * grow) / np.log(BASE)

    def score(j: np.ndarray) -> np.ndarray:
        more, fewer = p(np.maximum(u - v * j, 0)), p(np.maximum(v - u * j, 0))
        tiny = 1e-300
        return plus * np.log(more + tiny) + minus * np.log(fewer + tiny) + equal * np.log(np.maximum(1 - more - fewer, 0) + tiny)

    low, high = np.zeros(len(a)), np.minimum(u / v, v / u)
    for _ in range(40):  # the likelihood is concave in j
        x, y = low + (high - low) / 3, high - (high - low) / 3
        up = score(x) < score(y)
        low, high = np.where(up, x, low), np.where(up, high, y)
    return (low + high) / 2


def _rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, REGISTERS)


def estimated(pairs: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose likeliest similarity is not clearly under the threshold."""
    enough = threshold - SLACK * (threshold * (1 - threshold) / REGISTERS) ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                j = joint(_rows(batch.column("sa")), _rows(batch.column("sb")), batch.column("na").to_numpy(), batch.column("nb").to_numpy())
                yield batch.select(["a", "b"]).filter(pa.array(j >= enough))

    side = lambda x: sketches.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def verified(pairs: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose exact Jaccard similarity reaches the threshold. Only documents in a pair are read on."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            for part in pieces(batch, "text"):
                ids, first = shingles(part.column(1))
                fp = fingerprints(ids, first)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp), pa.array([ids[s:e].astype("<u8").tobytes() for s, e in zip(first[:-1], first[1:], strict=True)], pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("ia"), batch.column("ib"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= threshold * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    wanted = materialize(pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct())
    few = wanted.count() <= BROADCAST_IDS
    some = materialize(docs.join(F.broadcast(wanted) if few else wanted, "doc_id", "left_semi").mapInArrow(sets, "doc_id bigint, fp bigint, ids binary").repartition("doc_id").dropDuplicates(["doc_id", "fp"]))
    side = lambda x: some.select(F.col("doc_id").alias(x), F.col("ids").alias(f"i{x}"))
    out = materialize(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ia", "ib").mapInArrow(run, "a bigint, b bigint").distinct())
    release(some, wanted)
    return out


def shingle_counts(docs: DataFrame) -> np.ndarray:
    """Documents by bucket of their shingles: a table of fixed size, for the order of prefixes."""
    step = 1 << 14

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ORDER_BUCKETS, np.int64)
        for batch in batches:
            for part in pieces(batch, "text"):
                total += np.bincount((shingles(part.column(0))[0] % np.uint64(ORDER_BUCKETS)).astype(np.int64), minlength=ORDER_BUCKETS)
        if total.any():
            parts = range(0, ORDER_BUCKETS, step)
            yield pa.RecordBatch.from_arrays([pa.array([s // step for s in parts], pa.int32()), pa.array([total[s : s + step].tobytes() for s in parts], pa.binary())], ["slice", "counts"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"slice": group["slice"][:1], "counts": [sum(np.frombuffer(x, np.int64) for x in group["counts"]).tobytes()]})

    kind = "slice int, counts binary"
    rows = dict(docs.select("text").mapInArrow(count, kind).groupBy("slice").applyInPandas(add, kind).collect())
    return np.concatenate([np.frombuffer(rows[i], np.int64) for i in range(ORDER_BUCKETS // step)]) if rows else np.zeros(ORDER_BUCKETS, np.int64)


def prefixes(docs: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, n, token, own): the rarest shingles of each text, as many as two sets of the
    threshold's similarity cannot both do without.

    Of a set of n its rarest n - ceil(t n) + 1 shingles meet the rarest of any similar set;
    where the other is no smaller, n - ceil(2 t n / (1 + t)) + 1 are enough (``own``).
    """
    shared = docs.sparkSession.sparkContext.broadcast(np.minimum(shingle_counts(docs), (1 << 31) - 1).astype(np.int32))
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("token", pa.int64()), ("own", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in batches:
            for part in pieces(batch, "text"):
                ids, first = shingles(part.column(1))
                n = np.diff(first)
                owner = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((ids, often[(ids % np.uint64(ORDER_BUCKETS)).astype(np.int64)], owner))
                place = np.arange(len(ids)) - first[owner]
                far = (n - np.ceil(threshold * n - 1e-9) + 1)[owner]
                near = (n - np.ceil(2 * threshold / (1 + threshold) * n - 1e-9) + 1)[owner]
                take = place < far
                at = owner[take]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), pa.array(n[at]), pa.array(ids[order][take].view(np.int64)), pa.array((place < near)[take])], schema=schema)

    return docs.mapInArrow(run, "doc_id bigint, n bigint, token bigint, own boolean")


def by_prefix(members: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a over b, of members (doc_id, g) of different groups whose prefixes meet.

    Of a shingle's documents those of its largest group are paired with the others only,
    so that a group of thousands of copies does not meet itself.
    """
    few = members.count() <= BROADCAST_IDS
    mine = docs.join(F.broadcast(members.select("doc_id")) if few else members.select("doc_id"), "doc_id", "left_semi")
    # Rows that share an id are linked already; each has its own prefix.
    tokens = materialize(prefixes(mine, threshold).join(members, "doc_id"))
    sizes = tokens.groupBy("token", "g").agg(F.count("*").alias("k"), F.max("own").alias("own")).groupBy("token").agg(F.max_by("g", F.struct("k", "g")).alias("most"), F.count("*").alias("groups"), F.max("own").alias("any"))
    met = materialize(tokens.join(sizes.where("groups > 1 and any").select("token", "most"), "token"))

    def across(own: str, other: str) -> DataFrame:
        x, y = met.where("g <> most"), met
        x, y = (x.where("own").alias("x"), y.alias("y")) if own == "x" else (x.alias("x"), y.where("own").alias("y"))
        fits = f"x.token = y.token and x.g <> y.g and {own}.n <= {other}.n and {own}.n >= {threshold - 1e-9!r} * {other}.n"
        return x.join(y, F.expr(fits)).select(F.greatest("x.doc_id", "y.doc_id").alias("a"), F.least("x.doc_id", "y.doc_id").alias("b")).where("a <> b")

    out = materialize(across("x", "y").union(across("y", "x")).distinct())
    release(tokens, met)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, group_id): the least id of each connected component; (a, b) with b < a.

    Large and small stars in turn: every step shrinks the paths, and no node's
    neighbours are ever gathered in one row or one window.
    """
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        # Minima are aggregated and joined back: partial sums, and a hub's edges can be split.
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        small = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a").select("a", "b", "m")
        new = materialize(small.select("a", F.col("m").alias("b")).union(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct())
        state = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        release(edges)
        edges = new
        if state == seen:
            out = edges.toDF("doc_id", "group_id")
            out._lexi_path = edges._lexi_path
            return out
        seen = state


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, group_id, n_docs) of every document that has a near copy.

    Documents linked by a chain of pairs with shingle Jaccard similarity of
    ``threshold`` or more share a group; ``group_id`` is the least ``doc_id`` in
    it and ``n_docs`` its number of ids. Null ids, and null texts or texts
    without a word, are in no group. An id that occurs in several rows is one
    document: its rows are linked, whatever their texts; alone it makes no group.
    Texts are read whole, of whatever length, and compared by all their shingles. Other
    columns are ignored; an empty table gives an empty result.
    """
    docs = id_text(docs, id_col, text_col)
    rows = materialize(sketch(docs))
    firsts = rows.groupBy("n", "fp").agg(F.min("doc_id").alias("rep"))
    leads = materialize(rows.select("doc_id", "n", "fp").join(firsts, ["n", "fp"]).select("doc_id", "rep"))
    same = leads.where("doc_id <> rep").distinct()
    reps = materialize(rows.join(leads.where("doc_id = rep").select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id", "n", "fp"]))
    bands = materialize(_bands(reps))
    shared = bands.groupBy("band").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low <> high").select("band", "low")
    met = materialize(bands.join(shared, "band"))
    release(bands)
    linked, tried = same.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")), None
    pairs = met.where("doc_id <> low").select(F.col("doc_id").alias("a"), F.col("low").alias("b")).distinct()
    made = []

    def apart(members: DataFrame) -> DataFrame:
        """Untried pairs of members (band, g, doc_id) of different groups."""
        x, y = members.toDF("band", "gx", "a"), members.toDF("band", "gy", "b")
        return x.join(y, "band").where("gx <> gy and b < a").select("a", "b").distinct().join(tried, ["a", "b"], "left_anti")

    def open_buckets(part: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(members of small buckets with several groups, members of large ones)."""
        mine = met.join(part.withColumnRenamed("group_id", "g"), "doc_id", "left").select("band", F.coalesce("g", "doc_id").alias("g"), "doc_id")
        size = mine.groupBy("band").agg(F.count("*").alias("k"), F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo <> hi").select("band", "k")
        mine = materialize(mine.join(size, "band"))
        made.append(mine)
        return mine.where(F.col("k") <= SMALL_BUCKET).drop("k"), mine.where(F.col("k") > SMALL_BUCKET).drop("k")

    def tested(pairs: DataFrame) -> None:
        nonlocal linked, tried
        close = materialize(estimated(pairs, reps, threshold).distinct())
        found = verified(close, docs, threshold)
        made.extend([close, found, pairs])
        linked = linked.union(found)
        tried = pairs if tried is None else tried.union(pairs)

    pairs = materialize(pairs)
    rest = pairs.isEmpty()
    if rest:
        made.append(pairs)
    while not rest:
        tested(pairs)
        part = components(linked)
        made.append(part)
        small, large = open_buckets(part)
        # Least members of groups stand for them as long as that is a bounded number a bucket.
        least = small.union(large).groupBy("band", "g").agg(F.min("doc_id").alias("doc_id"))
        size = least.groupBy("band").count().where(F.col("count") <= SMALL_BUCKET).select("band")
        pairs = materialize(apart(least.join(size, "band", "left_semi").select("band", "g", "doc_id")))
        if rest := pairs.isEmpty():
            made.append(pairs)
            hot = materialize(large.select("doc_id", "g").distinct())
            made.append(hot)
            last = apart(small)
            if not hot.isEmpty():
                more = by_prefix(hot, docs, threshold)
                made.append(more)
                last = last.union(more.join(tried, ["a", "b"], "left_anti")).distinct()
            last = materialize(last)
            if last.isEmpty():
                made.append(last)
            else:
                tested(last)
    part = components(linked)
    whole = part.union(part.select(F.col("group_id").alias("doc_id"), "group_id")).distinct()
    out = materialize(whole.join(whole.groupBy("group_id").agg(F.count("*").alias("n_docs")), "group_id").select("doc_id", "group_id", "n_docs"))
    release(rows, leads, reps, met, part, *made)
    return out


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(load(spark, sf_dir, "documents"))
