"""Segments on disk: Parquet postings under a versioned manifest.

The manifest is one small JSON file a version: the live segments, the tombstones, and the
last batch of each stream. A search sees what the newest one names, so writing, merging
and removing are: write new files under a number no one else has, then one new manifest,
and only later delete what none names any more. Whatever fails before its manifest has
changed nothing. Of two writers of a version one goes first (file systems that create
exclusively, as HDFS does, see to it between processes; a lock does within one); the other
looks at the new manifest and tries again, or begins anew where that would be wrong.

Numbers of segments never recur and say what is newer: a tombstone holds for segments up
to the newest one there was when it was committed. Merged segments are written without
removed documents under a new number, and a tombstone that no older segment is left for goes.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexisearch.errors import Conflict, CorruptIndex, IndexClosed
from lexisearch.operators.index import SEGMENT, IndexOptions, analyzed, blocks, doc_lengths, unpacked, weighted
from lexisearch.operators.maintain import pick_segments, without
from lexisearch.schemas import LENGTHS, POSTINGS, SEGMENTS, TOMBSTONES
from lexisearch.sources.tables import spread

FORMAT = 2
RETRIES = 20
#: Manifests before the newest that stay readable.
KEEP = 8
_EMPTY = {"segments": [], "tombstones": [], "batches": {}, "trash": []}
_locks: dict[str, threading.RLock] = defaultdict(threading.RLock)
_FIELDS = ("namespace", "group_id", "segment_id", "num_docs", "total_length", "avg_length", "create_time", "version", "num_postings", "checksum")


def _key(row: dict) -> tuple:
    return row["namespace"], row["group_id"], row["segment_id"]


class SegmentStore:
    def __init__(self, spark: SparkSession, path: str, options: IndexOptions | None = None):
        self.spark, self.path, self.options, self.closed = spark, path.rstrip("/"), options or IndexOptions(), False
        self.streams: list = []
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._lock = _locks[self.path]
        self.check_format()

    def _open(self) -> None:
        if self.closed:
            raise IndexClosed("the index is closed")

    # Files

    def _exists(self, path: str) -> bool:
        return self._fs.exists(self._hadoop(path))

    def _names(self, path: str) -> list[str]:
        return [f.getPath().getName() for f in self._fs.listStatus(self._hadoop(path))] if self._exists(path) else []

    def _delete(self, path: str) -> None:
        self._fs.delete(self._hadoop(path), True)

    def _put(self, path: str, text: str) -> bool:
        """Writes a file that is not there yet, whole; False if it is."""
        with self._lock:
            if self._exists(path):
                return False
            draft = self._hadoop(f"{self.path}/drafts/{uuid.uuid4().hex}")
            out = self._fs.create(draft)
            out.write(bytearray(text.encode()))
            out.close()
            to = self._hadoop(path)
            self._fs.mkdirs(to.getParent())
            if self._fs.rename(draft, to):
                return True
            self._fs.delete(draft, False)
            return False

    def _get(self, path: str) -> str:
        stream = self._fs.open(self._hadoop(path))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def token(self, folder: str) -> str:
        """A name for what is kept in a folder, made up the first time and the same from then on."""
        path = f"{folder.rstrip('/')}/lexisearch-token"
        fs = self._hadoop(path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(self._hadoop(path)):
            out = fs.create(self._hadoop(path), False)
            out.write(bytearray(uuid.uuid4().hex.encode()))
            out.close()
        return self._get(path)

    # Manifests

    def version(self) -> int:
        """The newest manifest; 0 if there is none."""
        return max((int(n[1:-5]) for n in self._names(f"{self.path}/manifest") if n[:1] == "v" and n[-5:] == ".json"), default=0)

    def state(self) -> dict:
        for _ in range(RETRIES):
            if not (v := self.version()):
                return json.loads(json.dumps(_EMPTY))
            try:
                return json.loads(self._get(f"{self.path}/manifest/v{v}.json"))
            except Exception:  # an older one, deleted since it was listed
                if v == self.version():
                    raise
        raise Conflict("the manifest changes too fast to be read")

    def _commit(self, change: Callable[[dict], dict]) -> dict:
        for _ in range(RETRIES):
            v = self.version()
            new = change(self.state())
            if v == self.version() and self._put(f"{self.path}/manifest/v{v + 1}.json", json.dumps(new)):
                return new
        raise Conflict("the manifest changes too fast to be written")

    def _rows(self, rows: list[dict]) -> DataFrame:
        times = SEGMENTS.replace("create_time timestamp", "create_time bigint")
        df = self.spark.createDataFrame([tuple(r[f] for f in _FIELDS) for r in rows], times)
        return df.withColumn("create_time", F.timestamp_micros("create_time"))

    def manifest(self) -> DataFrame:
        return self._rows(self.state()["segments"])

    def discover(self) -> list[tuple[str, int]]:
        """(namespace, group) of every shard that has live segments."""
        return sorted({(r["namespace"], r["group_id"]) for r in self.state()["segments"]})

    def applied(self, stream: str) -> int:
        """The last batch of a stream that is in the index; -1 if none is."""
        return self.state()["batches"].get(stream, -1)

    def _reserve(self) -> int:
        """A segment number that no one else gets."""
        while True:
            used = [int(n) for n in self._names(f"{self.path}/numbers")] + [r["segment_id"] for r in self.state()["segments"]]
            if self._put(f"{self.path}/numbers/{(n := max(used, default=-1) + 1)}", ""):
                return n

    def check_format(self) -> None:
        if wrong := sum(r["version"] != FORMAT for r in self.state()["segments"]):
            raise CorruptIndex(f"{wrong} segments are of another format")

    # Reading

    def _folder(self, name: str, row: dict) -> str:
        space = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(row["namespace"])
        return f"{self.path}/{name}/namespace={space}/group_id={row['group_id']}/segment_id={row['segment_id']}"

    def _read(self, name: str, rows: list[dict]) -> DataFrame:
        """The rows of these segments: their folders are named, so nothing else is listed or read."""
        schema = POSTINGS if name == "postings" else LENGTHS
        folders = [self._folder(name, r) for r in rows if name == "lengths" or r["num_postings"]]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(*folders)

    def postings(self, namespace: str | None = None, apply_deletes: bool = True) -> DataFrame:
        """Postings of the live segments; without removed documents unless told otherwise."""
        self._open()
        state = self.state()
        return self._postings(state, [r for r in state["segments"] if namespace in (None, r["namespace"])], apply_deletes)

    def _postings(self, state: dict, rows: list[dict], apply_deletes: bool, name: str = "postings") -> DataFrame:
        found = self._read(name, rows)
        holds = [t for t in state["tombstones"] if any(r["namespace"] == t["namespace"] and r["segment_id"] <= t["upto"] for r in rows)]
        return without(found, self._tombstones(holds)) if apply_deletes and holds else found

    def lengths(self) -> DataFrame:
        return self._read("lengths", self.state()["segments"])

    def _tombstones(self, known: list[dict]) -> DataFrame:
        if not known:
            return self.spark.createDataFrame([], TOMBSTONES)
        ids = self.spark.read.schema("doc_id string, t string").option("basePath", f"{self.path}/tombstones").parquet(*(f"{self.path}/tombstones/t={t['t']}" for t in known))
        of = self.spark.createDataFrame([(t["t"], t["namespace"], t["upto"]) for t in known], "t string, namespace string, upto bigint")
        return ids.join(F.broadcast(of), "t").select("namespace", "doc_id", "upto")

    def tombstones(self) -> DataFrame:
        return self._tombstones(self.state()["tombstones"])

    @staticmethod
    def _sums(postings: DataFrame) -> dict[tuple, tuple[int, int]]:
        """(postings, checksum) of each segment; the order of rows does not matter."""
        digest = F.bit_xor(F.xxhash64("term", "doc_id", "tf", "dl", "bm25"))
        return {(r.namespace, r.group_id, r.segment_id): (r.n, r.x) for r in postings.groupBy(*SEGMENT).agg(F.count("*").alias("n"), digest.alias("x")).collect()}

    def validate(self) -> None:
        """Reads every live segment, postings and lengths, and compares it with its manifest row."""
        self.check_format()
        rows = self.state()["segments"]
        held = {(r.namespace, r.group_id, r.segment_id): (r.n, r.total) for r in self._read("lengths", rows).groupBy(*SEGMENT).agg(F.count("*").alias("n"), F.sum(F.col("dl").cast("bigint")).alias("total")).collect()}
        sums = self._sums(self._read("postings", rows))
        wrong = [_key(r) for r in rows if held.get(_key(r), (0, 0)) != (r["num_docs"], r["total_length"]) or sums.get(_key(r), (0, 0)) != (r["num_postings"], r["checksum"])]
        if wrong:
            raise CorruptIndex(f"segments {wrong[:5]} do not hold what the manifest says")

    # Writing

    def _write(self, rows: DataFrame, name: str) -> None:
        """Each task's rows in order of term, or document, with a Bloom filter, so that lookups
        read few row groups and pages. Rows stay in the tasks they are in: those of an index are there
        by term, and ranges would have to be sampled, which computes everything twice."""
        key = "term" if name == "postings" else "doc_id"
        out = rows.sortWithinPartitions(*SEGMENT, key).write.mode("overwrite")
        out.option("partitionOverwriteMode", "dynamic").option(f"parquet.bloom.filter.enabled#{key}", "true").partitionBy(*SEGMENT).parquet(f"{self.path}/{name}")

    def _write_blocks(self, held: DataFrame, rows: list[dict]) -> None:
        """Writes weighted blocks as postings. A single segment's are in order as they are unpacked,
        and go to its folder directly; else they are sorted for the writer of many folders."""
        postings = unpacked(held.sortWithinPartitions(*SEGMENT, "term"))
        if len(rows) > 1:
            return self._write(postings, "postings")
        postings.drop(*SEGMENT).write.mode("overwrite").option("parquet.bloom.filter.enabled#term", "true").parquet(self._folder("postings", rows[0]))

    def _clear(self, segment: int) -> None:
        """Deletes what an attempt that came to nothing has left in any group."""
        for name in ("postings", "lengths"):
            for f in self._fs.globStatus(self._hadoop(f"{self.path}/{name}/*/*/segment_id={segment}")) or []:
                self._fs.delete(f.getPath(), True)

    def _stats(self, segments: list[int]) -> list[dict]:
        """Manifest rows of segments whose lengths are written."""
        folders = [str(f.getPath().toString()) for n in segments for f in self._fs.globStatus(self._hadoop(f"{self.path}/lengths/*/*/segment_id={n}")) or []]
        if not folders:
            return []
        held = self.spark.read.schema(LENGTHS).option("basePath", f"{self.path}/lengths").parquet(*folders)
        found = held.groupBy(*SEGMENT).agg(F.count("*").alias("n"), F.sum(F.col("dl").cast("bigint")).alias("total"), F.count("doc_id").alias("ids")).collect()
        if any(r.ids < r.n for r in found):
            raise ValueError("documents need an id")
        now = time.time_ns() // 1000
        return [dict(zip(_FIELDS, (r.namespace, r.group_id, r.segment_id, r.n, r.total, r.total // r.n, now, FORMAT, 0, 0), strict=True)) for r in found]

    def _summed(self, rows: list[dict]) -> list[dict]:
        """The rows with the sums of the postings that are written."""
        known = [r | {"num_postings": 1} for r in rows if self._exists(self._folder("postings", r))]
        sums = self._sums(self._read("postings", known)) if known else {}
        return [r | dict(zip(("num_postings", "checksum"), sums.get(_key(r), (0, 0)), strict=True)) for r in rows]

    def add(self, docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", removed: tuple[str, DataFrame] | None = None, stream: str | None = None, batch: int = -1) -> int | None:
        """Writes documents as one segment in each group they have; the segment's number, or
        None if there are none.

        ``removed`` (a namespace and a table with ``doc_id``) is removed from all older
        segments by the same manifest. A ``batch`` that the ``stream`` has applied already is left out.
        """
        self._open()
        for _ in range(RETRIES):
            if stream is not None and self.applied(stream) >= batch:
                return None
            number, grave = self._reserve(), None
            try:
                rows = self._built(docs, number, text_col, id_col)
                grave = self._buried(*removed) if removed else None

                def change(state: dict, rows: list[dict] = rows, grave: dict | None = grave, number: int = number) -> dict:
                    newest = max((r["segment_id"] for r in state["segments"]), default=-1)
                    if grave and newest >= number or any(t["upto"] >= number for t in state["tombstones"]):
                        raise Conflict("a newer segment came first")
                    if stream is not None and state["batches"].get(stream, -1) >= batch:
                        raise Conflict("the batch is applied already")
                    state["segments"] += rows
                    state["tombstones"] += [grave | {"upto": newest}] if grave else []
                    state["batches"] |= {stream: batch} if stream is not None else {}
                    return state

                if rows or grave or stream is not None:
                    self._commit(change)
                return number if rows else None
            except BaseException as e:
                self._clear(number)
                if grave:
                    self._delete(f"{self.path}/tombstones/t={grave['t']}")
                if not isinstance(e, Conflict):
                    raise
        raise Conflict("other writers were always first")

    def _built(self, docs: DataFrame, number: int, text_col: str, id_col: str) -> list[dict]:
        docs = analyzed(spread(docs), text_col, id_col).withColumn("segment_id", F.lit(number).cast("bigint")).withColumn("doc_id", F.col("doc_id").cast("string"))
        # Statistics come from the lengths just written, so that texts are analyzed for these and for the postings only.
        self._write(doc_lengths(docs), "lengths")
        rows = self._stats([number])
        if not rows:
            return []
        stats = self._rows(rows).select(*SEGMENT, "num_docs", "total_length", "avg_length")
        self._write_blocks(weighted(blocks(docs), stats), rows)
        return self._summed(rows)

    def _buried(self, namespace: str, ids: DataFrame) -> dict | None:
        t = uuid.uuid4().hex
        path = f"{self.path}/tombstones/t={t}"
        ids.select(F.col("doc_id").cast("string").alias("doc_id")).where("doc_id is not null").distinct().write.parquet(path)
        if self.spark.read.schema("doc_id string").parquet(path).isEmpty():
            self._delete(path)
            return None
        return {"t": t, "namespace": namespace}

    def remove(self, namespace: str, ids: DataFrame) -> None:
        """Documents of all segments so far are no longer found; indexed again later, they are."""
        self._open()
        if grave := self._buried(namespace, ids):

            def change(state: dict) -> dict:
                state["tombstones"].append(grave | {"upto": max((r["segment_id"] for r in state["segments"]), default=-1)})
                return state

            self._commit(change)

    def compact(self) -> list[list[int]]:
        """Merges small segments of each namespace and group; the merged numbers, a list for each merge.

        Impacts are copied as they are, removed documents are left out. Files of merged
        segments are deleted by the compaction after, so that a running search still has them.
        """
        self._open()
        for _ in range(RETRIES):
            before = self.state()
            by_group: dict[tuple, list] = defaultdict(list)
            for r in before["segments"]:
                by_group[r["namespace"], r["group_id"]].append((r["segment_id"], r["num_docs"]))
            merges = [(*key, ids) for key, rows in sorted(by_group.items()) for ids in pick_segments(rows, self.options.merge_num)]
            if not merges:
                return []
            into = [(namespace, group, old, number) for (namespace, group, ids), number in zip(merges, [self._reserve() for _ in merges], strict=True) for old in ids]
            try:
                self._merge(before, into)
            except BaseException as e:
                for number in {n for *_, n in into}:
                    self._clear(number)
                if not isinstance(e, Conflict):
                    raise
                continue
            return [ids for *_, ids in merges]
        raise Conflict("other writers were always first")

    def _merge(self, before: dict, into: list[tuple[str, int, int, int]]) -> None:
        dead = {(n, g, old) for n, g, old, _ in into}
        rows = [r for r in before["segments"] if _key(r) in dead]
        # As many rows as segments are merged, which the driver holds anyway.
        to = F.broadcast(self.spark.createDataFrame(into, "namespace string, group_id int, segment_id bigint, _into bigint"))
        for name in ("lengths", "postings"):
            kept = self._postings(before, rows, True, name).join(to, list(SEGMENT))
            self._write(kept.withColumn("segment_id", F.col("_into")).drop("_into"), name)
        fresh = self._summed(self._stats(sorted({n for *_, n in into})))

        def change(state: dict) -> dict:
            if state["tombstones"] != before["tombstones"] or not dead <= {_key(r) for r in state["segments"]}:
                raise Conflict("what was to be merged has changed")
            for path in state["trash"]:
                self._delete(path)
            state["segments"] = [r for r in state["segments"] if _key(r) not in dead] + fresh
            spent = [t for t in state["tombstones"] if not any(r["namespace"] == t["namespace"] and r["segment_id"] <= t["upto"] for r in state["segments"])]
            state["tombstones"] = [t for t in state["tombstones"] if t not in spent]
            state["trash"] = [self._folder(name, r) for r in rows for name in ("postings", "lengths")] + [f"{self.path}/tombstones/t={t['t']}" for t in spent]
            return state

        self._commit(change)
        newest = self.version()
        for n in self._names(f"{self.path}/manifest"):
            if n[:1] == "v" and int(n[1:-5]) <= newest - KEEP:
                self._delete(f"{self.path}/manifest/{n}")
        oldest = min((r["segment_id"] for r in self.state()["segments"]), default=0)
        for n in self._names(f"{self.path}/numbers"):
            if int(n) < oldest:
                self._delete(f"{self.path}/numbers/{n}")

    def drop(self, namespace: str) -> None:
        """All of a namespace's documents and tombstones, with their files."""

        def change(state: dict) -> dict:
            gone = [self._folder(name, r) for r in state["segments"] if r["namespace"] == namespace for name in ("postings", "lengths")]
            state["trash"] += gone + [f"{self.path}/tombstones/t={t['t']}" for t in state["tombstones"] if t["namespace"] == namespace]
            state["segments"] = [r for r in state["segments"] if r["namespace"] != namespace]
            state["tombstones"] = [t for t in state["tombstones"] if t["namespace"] != namespace]
            return state

        self._open()
        self._commit(change)
        self.vacuum()

    def vacuum(self) -> None:
        """Deletes what no manifest names, at once; searches that began before may fail."""

        def change(state: dict) -> dict:
            for path in state["trash"]:
                self._delete(path)
            return state | {"trash": []}

        self._commit(change)

    def close(self) -> None:
        """What streams have at hand is indexed, then they and the maintenance loop stop; later calls raise."""
        for stream in self.streams:
            if stream.isActive:
                stream.processAllAvailable()
                stream.stop()
        self.closed = True
