"""Document fingerprints that tell what changed between versions.

A document is the set of its paragraphs' digests, kept in an invertible Bloom
lookup sketch: each digest is added to three cells, each a count, an exclusive-or of
digests and one of check values. Two versions' sketches of equal size subtract cell
by cell, which cancels what both have; peeling cells that hold a single digest then
gives the differing digests of either side. Sketches start small, sized for few
differences; pairs that do not peel are sketched again, twice as large, until they do.

Versions are documents with the same first paragraph, in order of id; each is
compared with the one before it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexisearch.llm._spark import load, materialize, ranked, release
from lexisearch.llm._text import mix

CELLS = 24
HASHES = 3
#: Stands for the first paragraph of a text that has none.
NO_HEAD = -1
_CELL = np.dtype([("count", "<i4"), ("key", "<u8"), ("check", "<u4")])
_SALT = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


def digest(paragraph: str) -> int:
    """The first 60 bits of the paragraph's MD5."""
    return int(hashlib.md5(paragraph.encode()).hexdigest()[:15], 16)


def paragraphs(text: str) -> list[str]:
    return [p for p in text.split("\n") if p]


def _places(keys: np.ndarray, cells: int) -> np.ndarray:
    """Each key's cells, one in each third of the sketch."""
    part = cells // HASHES
    return np.stack([(mix(keys ^ _SALT[i]) % np.uint64(part)).astype(np.int64) + i * part for i in range(HASHES)])


def _check(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ _SALT[3]) >> np.uint64(32)).astype(np.uint32)


def sketch(keys: np.ndarray, cells: int) -> np.ndarray:
    """The sketch of a set of digests; ``cells`` a multiple of ``HASHES``."""
    out = np.zeros(cells, _CELL)
    checks = _check(keys)
    for at in _places(keys, cells):
        np.add.at(out["count"], at, 1)
        np.bitwise_xor.at(out["key"], at, keys)
        np.bitwise_xor.at(out["check"], at, checks)
    return out


def subtract(new: np.ndarray, old: np.ndarray) -> np.ndarray:
    out = np.empty_like(new)
    out["count"] = new["count"] - old["count"]
    out["key"] = new["key"] ^ old["key"]
    out["check"] = new["check"] ^ old["check"]
    return out


def peel(cells: np.ndarray) -> tuple[list[int], list[int]] | None:
    """(digests only in the new, only in the old) version, ascending; None if it stalls."""
    cells, found = cells.copy(), ([], [])
    while True:
        single = np.flatnonzero((np.abs(cells["count"]) == 1) & (_check(cells["key"]) == cells["check"]))
        if not len(single):
            break
        keys, one = np.unique(cells["key"][single], return_index=True)
        signs = cells["count"][single][one]
        checks = _check(keys)
        for at in _places(keys, len(cells)):
            np.subtract.at(cells["count"], at, signs)
            np.bitwise_xor.at(cells["key"], at, keys)
            np.bitwise_xor.at(cells["check"], at, checks)
        for k, s in zip(keys.tolist(), signs.tolist(), strict=True):
            found[s < 0].append(k)
    if cells["count"].any() or cells["key"].any() or cells["check"].any():
        return None
    return sorted(found[0]), sorted(found[1])


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, head, body, digests): the first paragraph's digest, the whole text's, and the set, ascending."""

    def number(c: Column) -> Column:
        return F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("bigint")

    found = F.transform(F.filter(F.split("text", "\n"), lambda p: p != ""), number)
    rows = docs.select("doc_id", number(F.col("text")).alias("body"), found.alias("found"))
    return rows.select("doc_id", F.coalesce(F.try_element_at("found", F.lit(1)), F.lit(NO_HEAD)).alias("head"), "body", F.array_sort(F.array_distinct("found")).alias("digests"))


_AT = ("place", pa.int64())


def _sketches(rows: DataFrame, cells: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [sketch(np.array(x or [], np.uint64), cells).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], schema=pa.schema([_AT, ("sketch", pa.binary())]))

    return rows.select("place", "digests").mapInArrow(run, "place bigint, sketch binary")


def _peeled(pairs: DataFrame) -> DataFrame:
    """The differing digests of each version's sketch and the one before; null where peeling stalls."""
    schema = pa.schema([_AT, ("added", pa.list_(pa.int64())), ("removed", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [peel(subtract(np.frombuffer(new, _CELL), np.frombuffer(old, _CELL))) or (None, None) for new, old in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([g[i] for g in got], pa.list_(pa.int64())) for i in (0, 1))], schema=schema)

    return pairs.select("place", "new", "old").mapInArrow(run, "place bigint, added array<bigint>, removed array<bigint>")


def changes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cells: int = CELLS) -> DataFrame:
    """(doc_id, previous_id, n_paragraphs, added, removed) of every row with text.

    ``previous_id`` is the version before it, null for a first one, which adds all it
    has. ``added`` and ``removed`` are ascending digests. Paragraphs are non-empty
    lines; repeats in a document count once; texts may be of any length. Documents without
    a paragraph (empty text) are versions of each other, with nothing to add. Null text has
    no row. Versions are in order of id, then of the whole text's digest, null ids first;
    repeated rows are versions without a change. Other columns are ignored; an empty table
    gives an empty result.
    """
    if cells < HASHES:
        raise ValueError("a sketch has three cells at least")
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    taken = materialize(digests(docs).withColumn("uid", F.monotonically_increasing_id()))
    # A row is known by its place in the order of all rows, so ids may repeat or be null, and
    # a first paragraph that a third of all texts share is in many tasks.
    order = ["head", "doc_id", "body", "uid"]
    numbered = ranked(taken.select(*order), order, "place")
    before = numbered.select((F.col("place") + 1).alias("place"), F.col("head").alias("old_head"), F.col("doc_id").alias("previous_id"))
    chained = materialize(numbered.join(before, "place", "left").select("uid", "place", "previous_id", F.coalesce(F.col("head") == F.col("old_head"), F.lit(False)).alias("later")))
    all_of = materialize(taken.select("uid", "doc_id", "digests").join(chained, "uid"))
    todo = chained.where("later").select("place")
    done, size, made = None, max(HASHES, cells // HASHES * HASHES), [taken, numbered, chained]
    while True:
        need = todo.union(todo.select(F.col("place") - 1)).distinct()
        held = materialize(_sketches(all_of.join(need, "place", "left_semi"), size))
        old = held.select((F.col("place") + 1).alias("place"), F.col("sketch").alias("old"))
        level = materialize(_peeled(todo.join(held.withColumnRenamed("sketch", "new"), "place").join(old, "place")))
        release(held)
        made.append(level)
        peeled = level.where("added is not null")
        done = peeled if done is None else done.union(peeled)
        todo = level.where("added is null").select("place")
        if todo.isEmpty():
            break
        size *= 2
    out = all_of.join(done, "place", "left").select(
        "doc_id",
        F.when(F.col("later"), F.col("previous_id")).alias("previous_id"),
        F.size("digests").cast("bigint").alias("n_paragraphs"),
        F.when(F.col("later"), F.col("added")).otherwise(F.col("digests")).alias("added"),
        F.when(F.col("later"), F.col("removed")).otherwise(F.array().cast("array<bigint>")).alias("removed"),
    )
    out = materialize(out)
    release(all_of, *made)
    return out


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes(load(spark, sf_dir, "documents"))


SQL = """
WITH taken AS (
  SELECT doc_id, ('0x' || substr(md5(text), 1, 15))::BIGINT AS body,
         list_transform(list_filter(string_split(text, chr(10)), lambda p: p <> ''),
                        lambda p: ('0x' || substr(md5(p), 1, 15))::BIGINT) AS found
  FROM documents WHERE text IS NOT NULL),
chains AS (
  SELECT doc_id, list_sort(list_distinct(found)) AS digests,
         lag(doc_id) OVER w AS previous_id, row_number() OVER w AS place,
         lag(list_sort(list_distinct(found))) OVER w AS old
  FROM taken WINDOW w AS (PARTITION BY found[1] ORDER BY doc_id NULLS FIRST, body))
SELECT doc_id, previous_id, len(digests)::BIGINT AS n_paragraphs,
       CASE WHEN place = 1 THEN digests
            ELSE list_sort(list_filter(digests, lambda x: NOT list_contains(old, x))) END AS added,
       CASE WHEN place = 1 THEN []::BIGINT[]
            ELSE list_sort(list_filter(old, lambda x: NOT list_contains(digests, x))) END AS removed
FROM chains
"""
