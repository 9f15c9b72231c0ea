"""Command line: namespaces and placement, indexing, removing, searching, listings."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lexisearch.functions.scalar import route, trace_id
from lexisearch.operators.catalog import Catalog, shard_info
from lexisearch.operators.index import IndexOptions
from lexisearch.operators.search import search, search_shard
from lexisearch.plans.plugins import standard
from lexisearch.schemas import QUERIES
from lexisearch.sources.files import command_stream, read_lines, to_json_rows
from lexisearch.sources.storage import SegmentStore
from lexisearch.streaming.ingest import ingest


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lexisearch")
    p.add_argument("--data", required=True, help="folder of the catalog and the indexes")
    p.add_argument("--master")
    sub = p.add_subparsers(dest="do", required=True)

    def command(name: str, *args: str, **options: object) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a)
        for k, v in options.items():
            c.add_argument(f"--{k.replace('_', '-')}", default=v, type=type(v) if isinstance(v, int | str) else str)
        return c

    command("node", "addr", status="online")
    command("create", "namespace", shards=3, replicas=2)
    command("drop", "namespace").add_argument("--data", dest="with_data", action="store_true", help="delete its index as well")
    command("add", "namespace", "addr")
    command("remove-node", "namespace", "addr")
    command("balance", "namespace")
    c = command("migrate", "namespace", group=0, replica=0)
    c.add_argument("--source", required=True)
    c.add_argument("--target", required=True)
    command("commit", "namespace")
    command("info")
    for listing in ("nodes", "namespaces", "members"):
        command(listing)
    command("ingest", "namespace", "log", kind="log", quarantine=None)
    command("search-shard", "namespace", "query", group=0, start=0, count=10, plugins="preprocessor,segmenter")
    command("validate", "namespace")
    command("index", "namespace", file=None, content=None)
    command("remove", "namespace", "doc_id")
    c = command("search", "namespace", "query", start=0, count=10, plugins="preprocessor,segmenter", trace="", dedup="none")
    c.add_argument("--group", type=int, action="append")
    command("compact", "namespace")
    command("segments", "namespace")
    return p


def main(argv: list[str] | None = None) -> list[str]:
    """Runs one command; prints its rows as JSON, and returns them."""
    a = parser().parse_args(argv)
    builder = SparkSession.builder.appName("lexisearch").config("spark.ui.enabled", "false")
    spark = (builder.master(a.master) if a.master else builder).getOrCreate()
    catalog = Catalog(spark, os.path.join(a.data, "catalog"))
    out, drafts = None, []

    def tokens() -> list[str]:
        raw = spark.createDataFrame([(0, a.query, [], [])], QUERIES)
        return standard(tuple(x for x in a.plugins.split(",") if x)).analyze(raw).first().tokens

    def store() -> SegmentStore:
        catalog.get(a.namespace)
        return SegmentStore(spark, os.path.join(a.data, "index", a.namespace), IndexOptions())

    match a.do:
        case "node":
            catalog.register_node(a.addr, a.status)
        case "create":
            catalog.create(a.namespace, a.shards, a.replicas)
        case "drop":
            if a.with_data:
                store().drop(a.namespace)
            catalog.drop(a.namespace)
        case "add":
            catalog.add_node(a.namespace, a.addr)
        case "remove-node":
            catalog.remove_node(a.namespace, a.addr)
        case "balance":
            catalog.balance(a.namespace)
        case "migrate":
            catalog.migrate(a.namespace, a.group, a.replica, a.source, a.target)
        case "commit":
            catalog.commit(a.namespace)
        case "info":
            out = catalog.shards()
        case "nodes" | "namespaces" | "members":
            out = getattr(catalog, a.do)()
        case "ingest":
            base = os.path.join(a.data, "streams", a.namespace)
            groups = catalog.get(a.namespace).shard_num
            ingest(command_stream(spark, a.log, a.kind), store(), a.namespace, base, groups, {"availableNow": True}, a.quarantine).awaitTermination()
        case "search-shard":
            found = search_shard(store().postings(a.namespace), a.group, tokens(), a.count, a.start, catalog.get(a.namespace).shard_num)
            out = found
        case "validate":
            store().validate()
        case "index":
            if (a.file is None) == (a.content is None):
                raise SystemExit("give either --file or --content")
            docs = read_lines(spark, a.file) if a.file else spark.range(1).select(F.uuid().alias("doc_id"), F.lit(a.content).alias("content"))
            docs = _written(docs, a, catalog)
            drafts.append(docs.inputFiles()[0].rpartition("/")[0] if docs.inputFiles() else None)
            store().add(docs, text_col="content")
            out = docs.select("doc_id")
        case "remove":
            store().remove(a.namespace, spark.createDataFrame([(a.doc_id,)], "doc_id string"))
        case "search":
            out = search(store().postings(a.namespace), tokens(), a.count, a.start, a.group, dedup=a.dedup)
            # One id for all hits of a search: the caller's, or a new one.
            out = out.withColumn("trace_id", F.lit(spark.range(1).select(trace_id(F.lit(a.trace))).first()[0]))
        case "compact":
            store().compact()
        case "segments":
            out = shard_info(store().manifest())
    if a.do in ("node", "create", "drop", "add", "remove-node", "balance", "migrate"):
        catalog.save()
    rows = [] if out is None else [r.json for r in to_json_rows(out).collect()]
    for path in filter(None, drafts):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    print(*rows, sep="\n")
    return rows


def _written(docs, a: argparse.Namespace, catalog: Catalog):
    """The rows in the data folder: they are read for each of the segment's tables, and new ids are drawn but once."""
    spark = docs.sparkSession
    path = os.path.join(a.data, "incoming", a.namespace, spark.range(1).select(F.uuid()).first()[0])
    docs.withColumn("namespace", F.lit(a.namespace)).withColumn("group_id", route(F.col("doc_id"), catalog.get(a.namespace).shard_num)).write.parquet(path)
    return spark.read.parquet(path)


if __name__ == "__main__":
    main()
