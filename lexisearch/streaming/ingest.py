"""Streaming ingestion: each micro-batch becomes a segment.

A batch's documents, its removals and its number are committed by one manifest, so a
batch that is run again changes nothing, whatever was merged since.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexisearch.functions.scalar import canonical_id, route
from lexisearch.operators.index import SEGMENT
from lexisearch.operators.maintain import few
from lexisearch.sources.files import malformed, parse_commands
from lexisearch.sources.storage import SegmentStore


def apply_batch(store: SegmentStore, namespace: str, commands: DataFrame, batch: int, groups: int = 1, stream: str = "commands") -> None:
    """Indexes the batch's INDEX commands, and removes what its REMOVE commands name unless a
    later command of the batch indexes it again. Other types are ignored.

    Later is what was appended later, and within one append what has the higher ``seq``.
    """
    # Both branches read the batch; its files or offsets are replayed rather than kept.
    appended = F.col("appended") if "appended" in commands.columns else F.lit(None)
    at = F.struct(F.coalesce(appended, F.lit(0)).cast("bigint").alias("appended"), F.coalesce("seq", F.lit(0)).cast("bigint").alias("seq"))
    keyed = commands.select("type", "doc", canonical_id(F.coalesce("doc.doc_id", "doc_id")).alias("_id"), at.alias("_at")).where("_id is not null")
    removed = keyed.where("type = 'REMOVE'").groupBy("_id").agg(F.max("_at").alias("_upto"))
    # Documents are large and removals small: unless these are many, documents stay where they are.
    docs = keyed.where("type = 'INDEX'").join(F.broadcast(removed) if few(removed) else removed, "_id", "left").where("_upto is null or _at > _upto")
    placed = {"namespace": F.lit(namespace), "group_id": route(F.col("_id"), groups), "segment_id": F.lit(0)}
    docs = docs.select(*(placed[c].alias(c) for c in SEGMENT), F.col("_id").alias("doc_id"), F.col("doc.tokens").alias("tokens"))
    store.add(docs, removed=(namespace, removed.select(F.col("_id").alias("doc_id"))), stream=stream, batch=batch)


def ingest(commands: DataFrame, store: SegmentStore, namespace: str, checkpoint: str, groups: int = 1, trigger: dict | None = None, quarantine: str | None = None) -> StreamingQuery:
    """Starts ingestion of a stream of commands; by default every ``persist_interval`` seconds.

    A stream with a column ``value`` has messages in JSON; those that are no commands are
    left out, and kept in the folder ``quarantine`` if one is given, a folder for each batch.
    """
    stream = store.token(checkpoint)
    messages = "value" in commands.columns

    def write(batch: DataFrame, number: int) -> None:
        if messages and quarantine and store.applied(stream) < number:
            malformed(batch).write.mode("overwrite").parquet(f"{quarantine}/batch={number}")
        apply_batch(store, namespace, parse_commands(batch) if messages else batch, number, groups, stream)

    trigger = trigger or {"processingTime": f"{store.options.persist_interval} seconds"}
    query = commands.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    store.streams.append(query)
    return query


def maintain(store: SegmentStore, stop: Callable[[float], bool]) -> None:
    """Compacts every ``merge_interval`` seconds until ``stop(seconds)`` says so or the store is
    closed; an interval of 0 does nothing."""
    while store.options.merge_interval and not stop(store.options.merge_interval) and not store.closed:
        store.compact()
