"""Postings with precomputed BM25 impacts, segment by segment.

A segment's statistics (documents, document frequencies, average length) are its own,
so segments are built, searched and merged without looking at each other.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexisearch.functions.analysis import tokenize, word_edges

K1, B = 1.2, 0.75
SEGMENT = ("namespace", "group_id", "segment_id")
_PLACE = "namespace string, group_id int, segment_id bigint, term string"
#: Tokens or postings, and bytes of text, that a Python worker has in hand at once, and documents of a block.
SLICE, TEXT, BLOCK = 2_000_000, 6_000_000, 1024
_BLOCK = [*SEGMENT, "term", "n", "ids", "tf", "dl", "length"]
#: Input of less than this for each packet makes fewer packets than a shuffle has partitions.
PACKET_BYTES = 4 << 20
#: Repeated ids up to so many are broadcast to the documents; more are joined by a shuffle.
BROADCAST_IDS = 200_000


@dataclass(frozen=True)
class IndexOptions:
    persist_interval: float = 10.0
    merge_interval: float = 60.0
    merge_num: int = 100_000
    shards: int = 1

    def __post_init__(self) -> None:
        if self.merge_num < 1 or self.shards < 1 or self.persist_interval < 0 or self.merge_interval < 0:
            raise ValueError("intervals cannot be negative, merge_num and shards must be positive")


def analyzed(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", placed: tuple[str, ...] = SEGMENT) -> DataFrame:
    """(namespace, group_id, segment_id, doc_id, tokens), and where tokens come of a text, the
    ``lowered`` text, of which Python workers make the same tokens in less time.

    Text is tokenized; a table without ``text_col`` has its tokens in ``tokens``. The
    columns named in ``placed`` say where a document goes, if they are there; others of these
    names are ignored. What is absent is 'default' or 0; a place of another type is an error.
    """
    have = {c for c in docs.columns if c in placed} | {c for c in ("tokens",) if text_col not in docs.columns}
    kind_of = dict(docs.dtypes)
    for c in have - {"namespace", "tokens"}:
        if kind_of[c] not in ("tinyint", "smallint", "int", "bigint"):
            raise ValueError(f"{c} is {kind_of[c]}, not a whole number; leave it out of 'placed' if it is not the engine's")
    tokens, lowered = (F.col("tokens"), []) if "tokens" in have else (tokenize(F.col(text_col)), [F.lower(F.col(text_col)).alias("lowered")])
    default = {"namespace": F.lit("default"), "group_id": F.lit(0), "segment_id": F.lit(0)}
    kinds = {"namespace": "string", "group_id": "int", "segment_id": "bigint"}
    return docs.select(*((F.col(c) if c in have else default[c]).cast(kinds[c]).alias(c) for c in SEGMENT), F.col(id_col).alias("doc_id"), F.coalesce(tokens, F.array().cast("array<string>")).alias("tokens"), *lowered)


def _slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The batches in parts of at most ``SLICE`` list elements or ``TEXT`` bytes (or one row), with the rows' numbers of these."""
    for batch in batches:
        length, most = (pc.binary_length, TEXT) if column == "lowered" else (pc.list_value_length, SLICE)
        sizes = pc.fill_null(length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < len(sizes):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, to - at), sizes[at:to]
            at = to


def _codes(values: pa.Array) -> np.ndarray:
    """Equal values as equal numbers, null as 0."""
    return pc.fill_null(values.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1


def _bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of strings, one after the other, and where each begins (and the last ends). Nulls are empty."""
    values = pc.fill_null(values, "")
    _, ends, data = values.buffers()
    if not len(values) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(values) + 1, np.int64)
    wide = np.int64 if pa.types.is_large_string(values.type) else np.int32
    ends = np.frombuffer(ends, wide, len(values) + 1, values.offset * wide().itemsize).astype(np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def _word_table(edges: np.ndarray) -> np.ndarray:
    """Whether each code point is of words; ``edges`` are where that changes."""
    table = np.zeros(0x110000 + 1, np.int8)
    table[edges] = 1
    return np.cumsum(table, dtype=np.int32) % 2 == 1


def _words(texts: pa.Array, table: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All runs of word characters of lower-cased texts, and how many each text has."""
    data, ends = _bytes(texts)
    keep = np.concatenate([table[:128], np.zeros(128, bool)])[data]
    high = np.flatnonzero(data >= 0xC0)
    if len(high):
        lead = data[high].astype(np.int32)
        width = 2 + (lead >= 0xE0) + (lead >= 0xF0)
        point = lead & (0x7F >> width)
        for i in range(1, 4):
            more = data[np.minimum(high + i, len(data) - 1)] & 0x3F
            point = np.where(i < width, point << 6 | more, point)
        word = table[np.minimum(point, 0x10FFFF)]
        high, width = high[word], width[word]
        for i in range(4):
            keep[high[width > i] + i] = True
    begin = keep.copy()
    begin[1:] &= ~keep[:-1]
    rows = ends[:-1][ends[:-1] < len(data)]
    begin[rows] = keep[rows]
    sizes = np.diff(np.searchsorted(np.flatnonzero(begin), ends))
    kept = data[keep]
    starts = np.append(np.flatnonzero(begin[keep]), len(kept)).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(kept)), sizes


def _tokenized(batches: Iterator[pa.RecordBatch], edges: np.ndarray | None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, pa.Array]]:
    """Parts of the batches, the rows' numbers of tokens, and all tokens."""
    if edges is None:
        for part, sizes in _slices(batches, "tokens"):
            yield part, sizes, part.column("tokens").flatten()
        return
    table = _word_table(edges)
    for part, _ in _slices(batches, "lowered"):
        tokens, sizes = _words(part.column("lowered"), table)
        yield part, sizes, tokens


def _places(part: pa.RecordBatch) -> np.ndarray:
    """The rows' segments as numbers from 0 on."""
    place = np.zeros(len(part), np.int64)
    for c in SEGMENT:
        place = np.unique(place * (len(part) + 1) + _codes(part.column(c)), return_inverse=True)[1]
    return place


def _counts(part: pa.RecordBatch, sizes: np.ndarray, tokens: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The rows' segments as numbers; the terms; and in order of segment and term, of each document and term: the segment's
    number, the term's, the row, and how often it is there. Null and empty tokens are left out."""
    place = _places(part)
    coded = tokens.dictionary_encode()
    terms, term = coded.dictionary, pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    empty = pc.index(terms, "").as_py()
    if empty >= 0 or coded.null_count:
        row, term = (x[(term >= 0) & (term != empty)] for x in (row, term))
    bits, more = len(sizes).bit_length(), len(terms).bit_length()
    key = np.sort((place[row] << more | term) << bits | row)
    first = np.flatnonzero(np.diff(key, prepend=-1))
    key, tf = key[first], np.diff(first, append=len(key))
    row, key = key & ((1 << bits) - 1), key >> bits
    return place, terms, key >> more, key & ((1 << more) - 1), row, tf


def _rows(batches: Iterator[pa.RecordBatch], edges: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    for part, sizes, tokens in _tokenized(batches, edges):
        _, terms, _, term, row, tf = _counts(part, sizes, tokens)
        columns = [part.column(c).take(pa.array(row)) for c in SEGMENT] + [terms.take(pa.array(term)), part.column("doc_id").take(pa.array(row)), pa.array(tf), pa.array(sizes[row].astype(np.int32))]
        yield pa.RecordBatch.from_arrays(columns, [*SEGMENT, "term", "doc_id", "tf", "dl"])


def _summed(tables: list[pa.Table], by: list[str], sums: list[str]) -> pa.Table:
    return pa.concat_tables(tables).group_by(by).aggregate([(c, "sum") for c in sums]).rename_columns([*by, *sums])


def _term_counts(batches: Iterator[pa.RecordBatch], edges: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Documents of each term, added up over the parts until there are ``SLICE`` rows of them."""
    held, by = [], [*SEGMENT, "term"]
    for part, sizes, tokens in _tokenized(batches, edges):
        _, terms, place, term, row, _ = _counts(part, sizes, tokens)
        start = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(term, prepend=-1) != 0))
        columns = [part.column(c).take(pa.array(row[start])) for c in SEGMENT] + [terms.take(pa.array(term[start])), pa.array(np.diff(start, append=len(row)))]
        held.append(pa.Table.from_arrays(columns, _BLOCK[:5]))
        if sum(map(len, held)) > SLICE:
            held = [_summed(held, by, ["n"])]
            if len(held[0]) > SLICE // 2:
                yield from held.pop().to_batches(SLICE)
    if held:
        yield from (held[0] if len(held) == 1 else _summed(held, by, ["n"])).to_batches(SLICE)


def _blocks(batches: Iterator[pa.RecordBatch], edges: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    for part, sizes, tokens in _tokenized(batches, edges):
        places, terms, place, term, row, tf = _counts(part, sizes, tokens)
        new = (np.diff(place, prepend=-1) != 0) | (np.diff(term, prepend=-1) != 0)
        start = np.flatnonzero(new)  # a frequent word's documents are in several blocks
        at = np.arange(len(row)) - np.repeat(start, np.diff(start, append=len(row)))
        start = np.flatnonzero(new | (at % BLOCK == 0))
        n = np.diff(start, append=len(row))
        columns = [part.column(c).take(pa.array(row[start])) for c in SEGMENT] + [terms.take(pa.array(term[start])), pa.array(n)]
        ends = pa.array(np.append(start, len(row)).astype(np.int32))
        values = (part.column("doc_id").take(pa.array(row)), pa.array(tf.astype(np.int32)), pa.array(sizes[row].astype(np.int32)))
        columns += [*(pa.ListArray.from_arrays(ends, v) for v in values), pa.array(np.zeros(len(n), np.int64))]
        yield pa.RecordBatch.from_arrays(columns, _BLOCK)
        _, one, n = np.unique(places, return_index=True, return_counts=True)
        none = pa.array(np.zeros(len(n) + 1, np.int32))
        columns = [part.column(c).take(pa.array(one)) for c in SEGMENT] + [pa.array([""] * len(n), pa.string()), pa.array(n)]
        columns += [*(pa.ListArray.from_arrays(none, v[:0]) for v in values), pa.array(np.bincount(places, sizes).astype(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, _BLOCK)


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with idf and average length as postings."""
    for part, sizes in _slices(batches, "ids"):
        row = np.repeat(np.arange(len(sizes)), sizes)
        ids, tf, dl = (part.column(c).flatten() for c in ("ids", "tf", "dl"))
        idf, avg = (part.column(c).to_numpy(zero_copy_only=False).astype(np.float64)[row] for c in ("idf", "avg_length"))
        n = tf.to_numpy().astype(np.float64)
        bm25 = idf * n * (K1 + 1) / (n + K1 * (1 - B + B * dl.to_numpy().astype(np.float64) / np.where(avg == 0, 1, avg)))
        columns = [part.column(c).take(pa.array(row)) for c in (*SEGMENT, "term")] + [ids, tf.cast(pa.int64()), dl, pa.array(np.where(avg == 0, 0.0, bm25))]
        yield pa.RecordBatch.from_arrays(columns, [*SEGMENT, "term", "doc_id", "tf", "dl", "bm25"])


def _hashes(terms: pa.Array) -> np.ndarray:
    """Numbers below 2**32 by the bytes of strings."""
    data, ends = _bytes(terms)
    length = np.diff(ends)
    power = np.cumprod(np.full(int(length.max(initial=0)) + 1, 0x100000001B3, np.uint64))
    upto = np.append(np.uint64(0), np.cumsum((data + np.uint64(1)) * power[np.arange(len(data)) - np.repeat(ends[:-1], length)]))
    mixed = upto[ends[1:]] - upto[ends[:-1]]
    return ((mixed ^ mixed >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)


def _names(part: pa.RecordBatch, place: np.ndarray) -> list[str]:
    """The segments of :func:`_places` as text, which no other is the beginning of."""
    one = pa.array(np.unique(place, return_index=True)[1])
    return [json.dumps(x) for x in zip(*(part.column(c).take(one).to_pylist() for c in SEGMENT), strict=True)]


def _packed(columns: list[pa.Array], names: list[str]) -> bytes:
    out, rows = pa.BufferOutputStream(), pa.RecordBatch.from_arrays(columns, names)
    with pa.ipc.new_stream(out, rows.schema) as to:
        to.write_batch(rows)
    return out.getvalue().to_pybytes()


def _opened(body: pa.Buffer) -> pa.Table:
    rows = pa.ipc.open_stream(body).read_all()
    return rows.set_column(0, "place", rows.column("place").cast(pa.string()))


def _packets(names: list[str], terms: pa.Array, place: np.ndarray, term: np.ndarray, values: list[pa.Array], docs: np.ndarray, length: np.ndarray, packets: int) -> pa.RecordBatch:
    """Postings in order of segment and term, dealt out by these to ``packets``; each packet's counts, with
    those of all segments (as the empty term's), are a row, and so are its postings."""
    places, new = pa.array(names, pa.string()), (np.diff(place, prepend=-1) != 0) | (np.diff(term, prepend=-1) != 0)
    start = np.flatnonzero(new)
    n, place, term = np.diff(start, append=len(place)), place[start], term[start]
    mine = ((_hashes(terms)[term] + _hashes(places)[place]) % np.uint64(packets)).astype(np.int64)
    order = np.argsort(mine, kind="stable")
    start, n, place, term = start[order], n[order], place[order], term[order]
    ends = np.append(0, np.cumsum(n))
    row = pa.array(np.repeat(start - ends[:-1], n) + np.arange(ends[-1]))
    terms = terms.take(pa.array(term))
    found = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays([v.take(row) for v in values], ["ids", "tf", "dl"]))
    every = [pa.array(np.arange(len(names))), pa.array([""] * len(names), pa.string()), pa.array(docs.astype(np.int64)), pa.array(length.astype(np.int64))]
    place, n, zero = (pa.array(x.astype(np.int64)) for x in (place, n, np.zeros(len(n))))
    at = np.searchsorted(mine[order], np.arange(packets + 1))
    rows = []
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        code, *counts = (pa.concat_arrays([x, y.slice(a, b - a)]) for x, y in zip(every, [place, terms, n, zero], strict=True))
        rows.append((i, 0, _packed([pa.DictionaryArray.from_arrays(code, places), *counts], ["place", "term", "n", "length"])))
        if b > a:
            code, *lists = (x.slice(a, b - a) for x in (place, terms, found))
            rows.append((i, 1, _packed([pa.DictionaryArray.from_arrays(code, places), *lists], ["place", "term", "found"])))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["packet", "kind", "body"])


def _dealt(batches: Iterator[pa.RecordBatch], edges: np.ndarray | None, packets: int) -> Iterator[pa.RecordBatch]:
    """The packets of documents."""
    for part, sizes, tokens in _tokenized(batches, edges):
        places, terms, place, term, row, tf = _counts(part, sizes, tokens)
        values = [part.column("doc_id").take(pa.array(row)), pa.array(tf.astype(np.int32)), pa.array(sizes[row].astype(np.int32))]
        yield _packets(_names(part, places), terms, place, term, values, np.bincount(places), np.bincount(places, sizes), packets)


def _dealt_rows(batches: Iterator[pa.RecordBatch], packets: int) -> Iterator[pa.RecordBatch]:
    """The packets of term frequencies; rows of the null term have a segment's documents as ``tf`` and length as ``total``."""
    for part in batches:
        if not len(part):
            continue
        places, coded = _places(part), part.column("term").dictionary_encode()
        tf, dl, total = (part.column(c).to_numpy(zero_copy_only=False) for c in ("tf", "dl", "total"))
        term = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.lexsort((term, places))
        row = order[term[order] >= 0]
        values = [part.column("doc_id").take(pa.array(row)), pa.array(tf[row].astype(np.int32)), pa.array(dl[row].astype(np.int32))]
        sums = [np.bincount(places, np.where(term < 0, x, 0)) for x in (tf, total)]
        yield _packets(_names(part, places), coded.dictionary, places[row], term[row], values, *sums, packets)


def _log(x: np.ndarray) -> np.ndarray:
    """The natural logarithm of numbers from 2 on with the JVM's last digit (StrictMath's algorithm)."""
    bits = x.astype(np.float64).view(np.int64)
    high = bits >> 32 & 0xFFFFF
    up = high + 0x95F64 & 0x100000
    k = ((bits >> 52) - 1023 + (up >> 20)).astype(np.float64)
    f = (bits & 0xFFFFFFFF | (high | up ^ 0x3FF00000) << 32).view(np.float64) - 1
    s = f / (2 + f)
    z = s * s
    w = z * z
    r = z * (6.666666666666735130e-01 + w * (2.857142874366239149e-01 + w * (1.818357216161805012e-01 + w * 1.479819860511658591e-01)))
    r = r + w * (3.999999999940941908e-01 + w * (2.222219843214978396e-01 + w * 1.531383769920937332e-01))
    a, b, half = k * 6.93147180369123816490e-01, k * 1.90821492927058770002e-10, 0.5 * f * f
    out = np.where((high - 0x6147A | 0x6B851 - high) > 0, a - ((half - (s * (half + r) + b)) - f), a - ((s * (f - r) - b) - f))
    small = f * f * (0.5 - 0.33333333333333333 * f)
    return np.where((2 + high & 0xFFFFF) < 3, np.where(f == 0, a + b, a - ((small - b) - f)), out)


def _weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of packets whose rows come one after the other, counts first. Of a packet, its counts and
    up to about an eighth of ``SLICE`` postings are in memory."""
    at, counts, held, size, known = None, [], [], 0, None
    by, sums = ["place", "term"], ["n", "length"]

    def weigh() -> Iterator[pa.RecordBatch]:
        nonlocal counts, held, size, known
        if held:
            if known is None:
                table = _summed(counts, by, sums).combine_chunks()
                place, term, n, length = (table.column(c).combine_chunks() for c in (*by, *sums))
                stats = pc.equal(term, "")
                names, docs, length = (x.filter(stats) for x in (place, n, length))
                docs, length = docs.to_numpy().astype(np.int64), length.to_numpy().astype(np.int64)
                known = pc.binary_join_element_wise(place, term, ""), n.to_numpy(), names, docs, length // np.maximum(docs, 1)
                counts = []
            keys, df, names, docs, avg = known
            rows = pa.concat_tables(held).combine_chunks()
            place, term, found = (rows.column(c).combine_chunks() for c in (*by, "found"))
            ids, tf, dl = (pa.ListArray.from_arrays(found.offsets, v) for v in found.flatten().flatten())
            df = df[pc.index_in(pc.binary_join_element_wise(place, term, ""), keys).to_numpy()].astype(np.float64)
            code = pc.index_in(place, names)
            segments = [pa.array(x, t) for x, t in zip(zip(*map(json.loads, names.to_pylist()), strict=True), (pa.string(), pa.int32(), pa.int64()), strict=True)]
            columns = [*(x.take(code) for x in segments), term, ids, tf, dl, pa.array(_log(docs[code.to_numpy()] / df + 1) / _log(np.array([2.0]))), pa.array(avg[code.to_numpy()])]
            yield from _postings([pa.RecordBatch.from_arrays(columns, [*SEGMENT, "term", "ids", "tf", "dl", "idf", "avg_length"])])
        held, size = [], 0

    for batch in batches:
        for packet, kind, body in zip(batch.column("packet").to_pylist(), batch.column("kind").to_pylist(), batch.column("body"), strict=True):
            if packet != at:
                yield from weigh()
                at, counts, known = packet, [], None
            rows = _opened(body.as_buffer())
            if kind == 0:
                counts.append(rows)
                if sum(map(len, counts)) > SLICE // 4 + 2 * len(counts[0]):
                    counts = [_summed(counts, by, sums)]
            else:
                held.append(rows)
                size += len(rows.column("found").combine_chunks().flatten())
                if size > SLICE // 8:
                    yield from weigh()
    yield from weigh()


def _by_repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Documents whose ids are there once in their segment, and those whose ids are repeated (None
    if no id is). Only ids are read to tell."""
    keys = [*SEGMENT, "doc_id"]
    repeated = docs.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").select(*(F.col(k).alias(f"_{k}") for k in keys))
    n = repeated.limit(BROADCAST_IDS + 1).count()
    if n == 0:
        return docs, None
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    repeated = F.broadcast(repeated) if n <= BROADCAST_IDS else repeated
    return docs.join(repeated, same, "left_anti"), docs.join(repeated, same, "left_semi")


def _id_type(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def _over_tokens(docs: DataFrame, make: Callable[..., Iterator[pa.RecordBatch]], kind: str, *more) -> DataFrame:
    """What ``make`` makes of analyzed documents, from the lowered text if they have it."""
    column, edges = ("lowered", np.array(word_edges(docs.sparkSession))) if "lowered" in docs.columns else ("tokens", None)
    return docs.select(*SEGMENT, "doc_id", column).mapInArrow(lambda batches: make(batches, edges, *more), kind)


def _counted_rows(docs: DataFrame) -> DataFrame:
    return _over_tokens(docs, _rows, f"{_PLACE}, doc_id {_id_type(docs)}, tf bigint, dl int")


def _added(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*SEGMENT, "term", "doc_id").agg(F.sum("tf").alias("tf"), F.max("dl").alias("dl"))


def term_frequencies(docs: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """(segment, term, doc_id, tf, dl): a document's count of each non-empty term, and its
    length in tokens, empty ones included. ``terms`` keeps only these.

    A document's tokens sit in one row and are counted there, in Arrow batches; only rows of
    ids that a segment has more than once are shuffled and added up.
    """
    if terms is not None:
        rows = docs.select(*SEGMENT, "doc_id", F.size("tokens").alias("dl"), F.explode(F.filter("tokens", lambda t: t.isin(terms))).alias("term"))
        return rows.groupBy(*SEGMENT, "term", "doc_id").agg(F.count("*").alias("tf"), F.max("dl").alias("dl"))
    alone, repeated = _by_repeats(docs)
    rows = _counted_rows(alone)
    return rows if repeated is None else rows.unionByName(_added(_counted_rows(repeated)))


def blocks(docs: DataFrame, lists: bool = True) -> DataFrame:
    """(segment, term, n, ids, tf, dl, length): the term frequencies with up to ``BLOCK`` documents
    of a term in a row, as lists; a term has many rows. Rows of the empty term, which no document
    has, tell how many documents (``n``) there are and their ``length``. Without ``lists`` only the terms' ``n``."""
    alone, repeated = _by_repeats(docs)
    of = _id_type(docs)
    kind = f"{_PLACE}, n bigint" + (f", ids array<{of}>, tf array<int>, dl array<int>, length bigint" if lists else "")
    out = _over_tokens(alone, _blocks if lists else _term_counts, kind)
    if repeated is None:
        return out
    rows = _added(_counted_rows(repeated))
    one = [F.array("doc_id").alias("ids"), F.array(F.col("tf").cast("int")).alias("tf"), F.array("dl").alias("dl")]
    out = out.unionByName(rows.select(*SEGMENT, "term", F.lit(1).cast("bigint").alias("n"), *(one if lists else ()), *((F.lit(0).cast("bigint").alias("length"),) if lists else ())))
    if not lists:
        return out
    none = [F.array().cast(t).alias(c) for c, t in (("ids", f"array<{of}>"), ("tf", "array<int>"), ("dl", "array<int>"))]
    sums = segment_stats(repeated)
    return out.unionByName(sums.select(*SEGMENT, F.lit("").alias("term"), F.col("num_docs").alias("n"), *none, F.col("total_length").alias("length")))


def segment_stats(docs: DataFrame) -> DataFrame:
    """(segment, num_docs, total_length, avg_length): rows, not distinct ids; integer average."""
    size = F.size("tokens").cast("bigint")
    out = docs.groupBy(*SEGMENT).agg(F.count("*").alias("num_docs"), F.sum(size).alias("total_length"))
    return out.withColumn("avg_length", F.expr("total_length div num_docs"))


def doc_lengths(docs: DataFrame) -> DataFrame:
    return docs.select(*SEGMENT, "doc_id", F.size("tokens").alias("dl"))


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(segment, term, df): documents are counted in each task, and the counts summed."""
    return blocks(docs, False).groupBy(*SEGMENT, "term").agg(F.sum("n").alias("df"))


def impact(tf: Column, dl: Column, df: Column, n: Column, avg: Column) -> Column:
    """BM25 with a base-2 idf that is never negative; 0 where the average length is 0."""
    idf = F.log2(n / df + 1)
    return F.when(avg == 0, F.lit(0.0)).otherwise(idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.nullif(avg, F.lit(0)))))


def with_impacts(tf: DataFrame, stats: DataFrame) -> DataFrame:
    """Postings of a query's few words: the frequencies with document frequency and impact.

    Statistics have a row for each segment, as manifests do.
    """
    df = tf.groupBy(*SEGMENT, "term").agg(F.count("*").alias("df"))
    rows = tf.join(F.broadcast(df), [*SEGMENT, "term"]).join(F.broadcast(stats), list(SEGMENT))
    return rows.select(*SEGMENT, "term", "doc_id", "tf", "dl", impact(F.col("tf"), F.col("dl"), F.col("df"), F.col("num_docs"), F.col("avg_length")).alias("bm25"))


def weighted(held: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Blocks with idf and average length, where the segments' statistics are not given those of the blocks.

    Blocks are shuffled once, by term: sums, statistics and the join all read that shuffle. A
    word's blocks stream through one task, which has none of them in memory for longer.
    """
    # The joins below want this of their inputs anyway; said here, it is said of all that read the shuffle.
    held = held.where(" and ".join(f"{c} is not null" for c in (*SEGMENT, "term"))).repartition(*SEGMENT, "term")
    # Everything is over all columns: with some of them pruned the shuffle would not be the same one and be done again.
    all_read = (F.size("ids") >= 0) & (F.size("tf") >= 0) & (F.size("dl") >= 0) & (F.col("length") >= 0)
    df = held.groupBy(*SEGMENT, "term").agg(F.sum(F.when(all_read, F.col("n"))).alias("df"))
    if stats is None:
        sums = [F.sum(F.when(all_read & (F.col("term") == ""), F.col(c))).alias(name) for c, name in (("n", "num_docs"), ("length", "total_length"))]
        stats = held.groupBy(*SEGMENT).agg(*sums).withColumn("avg_length", F.expr("total_length div num_docs"))
    rows = held.join(df, [*SEGMENT, "term"]).join(F.broadcast(stats), list(SEGMENT))
    return rows.select(*SEGMENT, "term", "n", "ids", "tf", "dl", "length", F.log2(F.col("num_docs") / F.col("df") + 1).alias("idf"), "avg_length")


def unpacked(held: DataFrame) -> DataFrame:
    """Postings of weighted blocks, in the order of the blocks."""
    of = held.schema["ids"].dataType.elementType.simpleString()
    return held.mapInArrow(_postings, f"{_PLACE}, doc_id {of}, tf bigint, dl int, bm25 double")


def _packet_postings(docs: DataFrame) -> DataFrame:
    """Postings of all documents, which are shuffled once, in packets of many terms: rows of a packet are
    few and large, so that nothing is sorted, joined or copied by the posting. Counts come before postings,
    which stream through the packet's task."""
    docs = docs.where(" and ".join(f"{c} is not null" for c in SEGMENT))
    spark, kind = docs.sparkSession, "packet int, kind int, body binary"
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    packets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(spark.sparkContext.defaultParallelism, size // PACKET_BYTES))
    alone, repeated = _by_repeats(docs)
    held = _over_tokens(alone, _dealt, kind, packets)
    if repeated is not None:
        none = {"term": "string", "doc_id": _id_type(docs), "dl": "int"}
        sums = segment_stats(repeated).select(*SEGMENT, *(F.lit(None).cast(t).alias(c) for c, t in none.items()), F.col("num_docs").alias("tf"), F.col("total_length").alias("total"))
        rows = _added(_counted_rows(repeated)).withColumn("total", F.lit(0).cast("bigint")).unionByName(sums)
        held = held.unionByName(rows.mapInArrow(lambda batches: _dealt_rows(batches, packets), kind))
    held = held.repartitionById(packets, F.col("packet")).sortWithinPartitions("packet", "kind")  # by hash some tasks would have many
    return held.mapInArrow(_weighed, f"{_PLACE}, doc_id {_id_type(docs)}, tf bigint, dl int, bm25 double")


def build_postings(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", terms: list[str] | DataFrame | None = None, placed: tuple[str, ...] = SEGMENT) -> DataFrame:
    """Postings of all documents, or of ``terms`` only (with the same impacts): a list, that is
    looked for before anything is exploded, or a table (column ``term``)."""
    docs = analyzed(docs, text_col, id_col, placed)
    if isinstance(terms, list):
        return with_impacts(term_frequencies(docs, terms), segment_stats(docs))
    if terms is None:
        return _packet_postings(docs)
    kept = terms.select("term").unionByName(docs.sparkSession.sql("SELECT '' AS term")).distinct()
    return unpacked(weighted(blocks(docs).join(kept, "term", "left_semi").select(_BLOCK)))
