"""Token ids packed into rows of one length, as binary matrices.

Encoded documents, each closed by an end token, are packed by best-fit decreasing:
longest first, each into the fullest row that still has room. A segment tree over
the capacities 0..row length finds that row. A document longer than a row is cut
losslessly into whole rows and a rest, and the rest is packed like a short one.

The packing is one for the whole corpus. Only lengths matter to it, and there are no
more of these than the row is long, so it is planned on the driver from the number
of pieces of each length: open rows that are filled alike are one entry of the tree.
Pieces of a length, in order of document, take the places that the plan has for their
length, are shuffled to their rows, and each row is put together where it arrives. The
result is the same however the input is partitioned.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexisearch.llm._spark import id_text, load, materialize, ranked
from lexisearch.llm._text import pieces
from lexisearch.llm.bpe import PATTERN, VOCABULARY, contents, ranks

ROW = 2048
END = 50256
PAD = 0


@lru_cache(2)
def _encoding(vocabulary: bytes) -> tiktoken.Encoding:
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks(vocabulary), special_tokens={})


class Capacities:
    """Entries by the room they have left; a segment tree finds the least room that is enough."""

    def __init__(self, row: int):
        self.leaves = 1 << row.bit_length()
        self.tree = [0] * (2 * self.leaves)  # entries below each node
        self.entries: list[deque] = [deque() for _ in range(row + 1)]

    def add(self, room: int, entry: object, first: bool = False) -> None:
        (self.entries[room].appendleft if first else self.entries[room].append)(entry)
        self._count(room, 1)

    def _count(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.tree[node] += by
            node >>= 1

    def take(self, size: int) -> tuple[int, object] | None:
        """(room, entry) of the fullest entry with room for ``size``, which is removed; of equals the one that came to that room first."""
        tree, node = self.tree, size + self.leaves
        if not tree[node]:
            while True:  # up until there is something to the right
                while node & 1:
                    node >>= 1
                if not node:
                    return None
                node += 1
                if tree[node]:
                    break
            while node < self.leaves:
                node = 2 * node if tree[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._count(room, -1)
        return room, self.entries[room].popleft()


@dataclass(frozen=True)
class Places:
    """Pieces of a length, from the ``first``-th on, ``each`` to a row, from row ``row`` and place ``at`` in it on."""

    first: int
    each: int
    row: int
    at: int


def best_fit(counts: dict[int, int], row: int) -> tuple[dict[int, list[Places]], int]:
    """(the places of each length's pieces, number of rows) of best-fit decreasing.

    As if piece by piece, longest first: a row that a piece was put in is the fullest that
    has room for the next of that length, as long as it has, so rows alike take as many
    as fit, one row after the other.
    """
    open_rows, plan, rows = Capacities(row), {}, 0
    for size in sorted(counts, reverse=True):
        left, done, mine = counts[size], 0, []
        while left:
            found = open_rows.take(size)
            room, (at, n) = found if found else (row, (rows, -(-left // (row // size))))
            rows = rows if found else rows + n
            each = room // size
            full = min(n, left // each)
            mine.append(Places(done, each, at, row - room))
            if full:
                done, left = done + full * each, left - full * each
                if rest := room - each * size:
                    open_rows.add(rest, (at, full))
            if full < n:
                used = 0
                if left:  # the last row of this length takes fewer
                    used = 1
                    open_rows.add(room - left * size, (at + full, 1))
                    done, left = done + left, 0
                if full + used < n:
                    open_rows.add(room, (at + full + used, n - full - used), first=True)
        plan[size] = mine
    return plan, rows


PACKED = "row_no bigint, doc_ids array<bigint>, parts array<int>, cu_seqlens array<int>, input_ids binary, position_ids binary"
_PACKED = pa.schema(
    [("row_no", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("parts", pa.list_(pa.int32())), ("cu_seqlens", pa.list_(pa.int32())), ("input_ids", pa.binary()), ("position_ids", pa.binary())]
)
_PIECES = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("part", pa.int32()), ("n", pa.int32()), ("ids", pa.binary())])
_ROUND = 256


def cut(ids: np.ndarray, row: int) -> list[np.ndarray]:
    return [ids[i : i + row] for i in range(0, len(ids), row)]


def encoded(docs: DataFrame, row: int, vocabulary: str, end: int, kind: str) -> DataFrame:
    """(doc_id, digest, part, n, ids): the pieces of each text; ``digest`` tells texts of one id apart."""

    shared = docs.sparkSession.sparkContext.broadcast(contents(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(shared.value)
        if enc.max_token_value >= 1 << 16 and kind == "<u2":
            raise ValueError("the vocabulary needs 32-bit ids")
        for batch in batches:
            for part in pieces(batch, "text"):
                out: list[list] = [[], [], [], [], []]
                for doc, digest, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    for i, x in enumerate(cut(np.append(enc.encode_to_numpy(text, disallowed_special=()), end).astype(kind), row)):
                        for column, value in zip(out, (doc, digest, i, len(x), x.tobytes()), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, _PIECES, strict=True)], schema=_PIECES)

    rows = docs.select("doc_id", F.xxhash64("text").alias("digest"), "text")
    return rows.mapInArrow(run, "doc_id bigint, digest bigint, part int, n int, ids binary")


def placed(items: DataFrame, counts: dict[int, int], row: int) -> tuple[DataFrame, int]:
    """(uid, row_no, at) of items (uid, n, place) in order of length, by the plan; and the number of rows."""
    plan, rows = best_fit(counts, row)
    sizes = sorted(counts)
    begin = np.concatenate([[0], np.cumsum([counts[s] for s in sizes])])
    # Places of all lengths in the order of the items: ranges of items that go to rows alike.
    table = np.array([(begin[k] + p.first, p.each, p.row, p.at) for k, s in enumerate(sizes) for p in plan[s]], np.int64).reshape(-1, 4)
    shared = items.sparkSession.sparkContext.broadcast(table)
    schema = pa.schema([("uid", pa.int64()), ("row_no", pa.int64()), ("at", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, each, at_row, at = shared.value.T
        for batch in batches:
            place, n = batch.column(2).to_numpy(), batch.column(1).to_numpy()
            k = np.searchsorted(first, place, "right") - 1
            j = place - first[k]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at_row[k] + j // each[k]), pa.array((at[k] + j % each[k] * n).astype(np.int32))], schema=schema)

    return items.select("uid", "n", "place").mapInArrow(run, "uid bigint, row_no bigint, at int"), rows


def assembled(rows: DataFrame, row: int, kind: str) -> DataFrame:
    """The packed rows of pieces (row_no, at, doc_id, part, n, ids) that are sorted by row and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def made(table: pa.Table) -> Iterator[pa.RecordBatch]:
            number = table.column("row_no").to_numpy()
            heads = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
            for s in range(0, len(heads), _ROUND):
                mine = heads[s : s + _ROUND]
                lo, hi = int(mine[0]), int(heads[s + _ROUND]) if s + _ROUND < len(heads) else len(number)
                part = table.slice(lo, hi - lo).combine_chunks()
                n, at = part.column("n").to_numpy().astype(np.int64), part.column("at").to_numpy().astype(np.int64)
                line = np.repeat(np.arange(len(mine)), np.diff(np.append(mine, hi)))
                flat = np.frombuffer(b"".join(part.column("ids").to_pylist()), kind)
                step = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
                to = np.repeat(line * row + at, n) + step
                ids, places = np.full(len(mine) * row, PAD, kind), np.zeros(len(mine) * row, kind)
                ids[to], places[to] = flat, step
                offsets = pa.array(np.append(mine, hi) - lo, pa.int32())
                edges = np.insert(at + n, mine - lo, 0)
                lists = [pa.ListArray.from_arrays(offsets, part.column(c).combine_chunks()) for c in ("doc_id", "part")]
                more = pa.array(np.append(mine, hi) - lo + np.arange(len(mine) + 1), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(number[mine]), *lists, pa.ListArray.from_arrays(more, pa.array(edges, pa.int32())), *(pa.array([x.tobytes() for x in m.reshape(-1, row)], pa.binary()) for m in (ids, places))], schema=_PACKED
                )

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            number = batch.column(batch.schema.get_field_index("row_no")).to_numpy()
            cut_at = table.num_rows - int(np.count_nonzero(number == number[-1]))  # the last row may go on
            if number[0] == number[-1]:
                continue
            yield from made(table.slice(0, cut_at))
            held = table.slice(cut_at).combine_chunks().to_batches()
        if held:
            yield from made(pa.Table.from_batches(held))

    return rows.select("row_no", "at", "doc_id", "part", "n", "ids").mapInArrow(run, PACKED)


def pack_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: int = ROW, vocabulary: str = VOCABULARY, end: int = END) -> DataFrame:
    """One row of ``row`` token ids each: its number; the documents in it
    and which part of each; ``cu_seqlens``, the cumulative lengths of its segments from 0
    to the tokens used; ids and positions as little-endian integers, 16-bit if all ids
    and positions fit and 32-bit otherwise. Positions restart at 0 in each segment; behind
    the last segment both are 0.

    The parts of a document, in order, are its ids and ``end``. Empty text is ``end`` alone;
    null text is in no row; a text of any length is cut into as many rows as it needs. Repeated rows are packed each; a null id stays null; other
    columns are ignored; an empty table gives no rows. Pieces of one length are taken in
    order of id (nulls first), text and part, so the rows do not depend on the input's partitions.
    """
    if row < 1:
        raise ValueError("row must be positive")
    kind = "<u2" if max(end, row) < 1 << 16 else "<u4"
    docs = id_text(docs, id_col, text_col).where("text is not null")
    made = materialize(encoded(docs, row, vocabulary, end, kind).withColumn("uid", F.monotonically_increasing_id()))
    items = ranked(made.select("n", "doc_id", "digest", "part", "uid"), ["n", "doc_id", "digest", "part", "uid"], "place")
    counts = {r.n: r["count"] for r in made.groupBy("n").count().collect()}
    where, _ = placed(items, counts, row)
    # A piece as long as a row is one; only the others are shuffled to their rows.
    short = made.where(F.col("n") < row).join(where, "uid").repartition("row_no").sortWithinPartitions("row_no", "at")
    full = made.where(F.col("n") == row).join(where, "uid")
    return assembled(short, row, kind).union(assembled(full, row, kind))


def write_packed(packed: DataFrame, path: str) -> None:
    """The rows as Parquet with uncompressed, plain binary columns, for readers that map them into memory."""
    packed.write.option("compression", "uncompressed").option("parquet.enable.dictionary", "false").mode("errorifexists").parquet(path)


def op9_token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_tokens(load(spark, sf_dir, "documents"))
