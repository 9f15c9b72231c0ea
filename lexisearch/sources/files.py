"""Text, word-list and embedding sources; command and result sinks."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexisearch.functions.scalar import route
from lexisearch.schemas import COMMANDS


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, content): one document a line, of any length; ids are new UUIDs."""
    return spark.read.text(path).select(F.uuid().alias("doc_id"), F.col("value").alias("content"))


def read_stopwords(spark: SparkSession, path: str) -> str:
    """The first character of each line, each once, in code-point order."""
    rows = spark.read.text(path).select(F.substring("value", 1, 1).alias("c")).where("c <> ''").distinct().orderBy("c").collect()
    return "".join(r.c for r in rows)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """(token, vector) of a text file of ``word v1 ... vn`` under a heading line; the token is
    the word's first character."""
    rows = spark.read.text(path)
    parts = F.split(F.trim("value"), " ")
    # The heading has two numbers and no vector.
    return rows.where(F.size(parts) > 2).select(F.substring(parts[0], 1, 1).alias("token"), F.slice(parts, 2, F.size(parts) - 1).cast("array<float>").alias("vector"))


def read_tags(spark: SparkSession, path: str) -> list[str]:
    return [r.value for r in spark.read.text(path, wholetext=False).collect()]


def index_commands(docs: DataFrame, groups: int) -> DataFrame:
    """Documents (doc_id, tokens) as INDEX commands with their group; content is left behind."""
    return docs.select(F.lit("INDEX").alias("type"), F.struct("doc_id", "tokens").alias("doc"), F.lit(None).cast("string").alias("doc_id"), F.monotonically_increasing_id().alias("seq"), route(F.col("doc_id"), groups).alias("group_id"))


def remove_commands(ids: DataFrame, groups: int) -> DataFrame:
    """(doc_id) as REMOVE commands with their group."""
    return ids.select(F.lit("REMOVE").alias("type"), F.lit(None).cast("struct<doc_id: string, tokens: array<string>>").alias("doc"), F.col("doc_id").cast("string").alias("doc_id"), F.monotonically_increasing_id().alias("seq"), route(F.col("doc_id"), groups).alias("group_id"))


def append_commands(commands: DataFrame, path: str, namespace: str) -> None:
    """Adds commands to the log, a folder for each namespace and group.

    ``appended`` (microseconds) comes first in the order of the log, ``seq`` second: what is
    appended later is later, whatever its rows were numbered.
    """
    commands.withColumn("appended", F.lit(time.time_ns() // 1000)).withColumn("namespace", F.lit(namespace)).write.mode("append").partitionBy("namespace", "group_id").parquet(path)


_GOOD = "coalesce((type = 'INDEX' and doc.doc_id is not null) or (type = 'REMOVE' and doc_id is not null), false)"


def _parsed(messages: DataFrame, column: str) -> DataFrame:
    """Commands with the message as ``_raw``; offset and timestamp of a log, where there are any, order them."""
    rows = messages.select("*", F.from_json(F.col(column).cast("string"), COMMANDS, {"mode": "PERMISSIVE"}).alias("_c"))
    seq = F.coalesce("offset", "_c.seq") if "offset" in messages.columns else F.col("_c.seq")
    appended = F.coalesce(F.unix_micros("timestamp"), "_c.appended") if "timestamp" in messages.columns else F.col("_c.appended")
    return rows.select("_c.type", "_c.doc", "_c.doc_id", seq.alias("seq"), appended.alias("appended"), F.col(column).cast("string").alias("_raw"))


def parse_commands(messages: DataFrame, column: str = "value") -> DataFrame:
    """JSON messages as commands; what does not parse, or is neither an INDEX with a document
    nor a REMOVE with an id, is left out (see :func:`malformed`)."""
    return _parsed(messages, column).where(_GOOD).drop("_raw")


def malformed(messages: DataFrame, column: str = "value") -> DataFrame:
    """(raw) of the messages that :func:`parse_commands` leaves out."""
    return _parsed(messages, column).where(f"not {_GOOD}").select(F.col("_raw").alias("raw"))


def command_stream(spark: SparkSession, path: str, kind: str = "log") -> DataFrame:
    """A stream of commands: ``log`` as :func:`append_commands` writes it, or ``json``, text
    files of a message a line."""
    if kind == "json":
        return spark.readStream.text(path)
    if kind != "log":
        raise ValueError("a stream is a 'log' or 'json'")
    return spark.readStream.schema(f"{COMMANDS}, namespace string, group_id int").parquet(path)


def kafka_messages(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """A topic's messages (value, offset, timestamp) for ``ingest``; needs Spark's Kafka connector."""
    source = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    return source.options(**options).load().select("value", "offset", "timestamp")


def to_json_rows(df: DataFrame) -> DataFrame:
    """One column ``json``, a row each."""
    return df.select(F.to_json(F.struct("*")).alias("json"))
