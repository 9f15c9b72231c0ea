"""Folders that all executors see."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only where the session leaves it unset, and runs on one machine (``local`` masters), is a
    temporary folder made and set; elsewhere it must be set.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lexisearch-"))
        named = sc.getCheckpointDir()
    return named


@contextmanager
def folder(spark: SparkSession) -> Iterator[str]:
    """A new shared folder, deleted in the end."""
    path = f"{shared_dir(spark)}/lexisearch-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
