"""Merging, removing, and merging sorted inputs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Removed ids up to so many rows are broadcast to what they are removed from; more are joined by a shuffle.
BROADCAST_IDS = 200_000


def pick_segments(segments: list[tuple[int, int]], merge_num: int = 100_000) -> list[list[int]]:
    """Groups of small segments to merge, from (id, documents) of a manifest.

    In order of id, segments of more than 0 and fewer than ``merge_num`` documents are
    gathered until they hold ``merge_num``; then a new group begins. A group of one is left alone.
    """
    groups, current, total = [], [], 0
    for segment, n in sorted(segments):
        if not 0 < n < merge_num:
            continue
        current.append(segment)
        total += n
        if total >= merge_num:
            groups.append(current)
            current, total = [], 0
    groups.append(current)
    return [g for g in groups if len(g) > 1]


def merge_postings(postings: DataFrame, ids: list[int], into: int) -> DataFrame:
    """The rows of these segments as rows of one; impacts as they were, repeated documents kept."""
    return postings.where(F.col("segment_id").isin(ids)).withColumn("segment_id", F.lit(into).cast("bigint"))


def relabel(postings: DataFrame, ids: list[int], into: int) -> DataFrame:
    """All rows, those of these segments as rows of one."""
    return postings.withColumn("segment_id", F.when(F.col("segment_id").isin(ids), F.lit(into).cast("bigint")).otherwise(F.col("segment_id")))


def merged_frequencies(counts: DataFrame) -> DataFrame:
    """(term, df): documents of each term over all segments, from their numbers ``n`` in parts."""
    return counts.groupBy("term").agg(F.sum("n").alias("df"))


def distinct_terms(postings: DataFrame) -> DataFrame:
    return postings.select("term").distinct()


def few(ids: DataFrame) -> bool:
    """Whether rows are counted to be at most ``BROADCAST_IDS``."""
    return ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS


def without(rows: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Rows of documents that are not removed; a tombstone holds for segments up to ``upto``.
    Tombstones are broadcast to the rows if they are counted to be few."""
    last = tombstones.groupBy("namespace", "doc_id").agg(F.max("upto").alias("upto"))
    last = F.broadcast(last) if few(tombstones) else last
    x, t = rows.alias("x"), last.alias("t")
    on = (F.col("x.namespace") == F.col("t.namespace")) & (F.col("x.doc_id") == F.col("t.doc_id")) & (F.col("x.segment_id") <= F.col("t.upto"))
    return x.join(t, on, "left_anti")


def kmerge(inputs: list[DataFrame], *by: str) -> DataFrame:
    """All rows of the inputs in one order, repeats kept. Lists that come from one table are
    better given as one input: it is read once."""
    inputs = [i for i in inputs if i is not None]
    if not inputs:
        raise ValueError("nothing to merge")
    return reduce(DataFrame.unionByName, inputs).orderBy(*by)
