"""Reading tables and cutting lineage through the cluster's shared folder."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexisearch.sources.shared import shared_dir
from lexisearch.sources.tables import read_table as load  # noqa: F401


#: Tables that are still in the shared folder.
_made: dict[str, SparkSession] = {}


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The files outlive any executor, so what follows never recomputes ``df``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexisearch-{uuid.uuid4().hex}"
    _made[path] = spark
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._lexi_path = path
    return back


def release(*tables: DataFrame) -> None:
    """Delete tables made by :func:`materialize` that no later plan reads."""
    for df in tables:
        _delete(df._lexi_path)


def _delete(path: str) -> None:
    spark = _made.pop(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _tidy() -> None:
    """What results were read from goes when the driver ends, if its session still runs."""
    for path in list(_made):
        if _made[path].sparkContext._jsc is not None:
            _delete(path)


def ranked(df: DataFrame, keys: list, name: str, weight: str | None = None) -> DataFrame:
    """``df`` with each row's place, from 0, in the order of ``keys`` (nulls first), written and
    read back; with ``weight``, a column of integers, ``<weight>_before`` is its sum over the rows before.

    Rows are range-partitioned and sorted, so no key, however frequent, is in one task;
    only each partition's number of rows, and its weight, come to the driver.
    """
    pid, at, sums = f"_{name}_pid", f"_{name}_at", f"_{name}_sum"
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(at, F.monotonically_increasing_id())
    rows = rows.withColumn(pid, F.shiftright(at, 33)).withColumn(at, F.col(at).bitwiseAND(F.lit((1 << 33) - 1)))
    if weight:
        in_order = Window.partitionBy(pid).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn(sums, F.coalesce(F.sum(weight).over(in_order), F.lit(0)).cast("bigint"))
    rows = materialize(rows)
    per = rows.groupBy(pid).agg(F.count("*"), *([F.sum(weight)] if weight else [])).collect()
    before, total = [], [0, 0]
    for p, n, *w in sorted(map(tuple, per)):
        before.append((p, *total))
        total = [total[0] + n, total[1] + (w[0] if w else 0)]
    known = df.sparkSession.createDataFrame(before, f"{pid} bigint, _{name}_n bigint, _{name}_w bigint")
    out = rows.join(F.broadcast(known), pid).withColumn(name, F.col(at) + F.col(f"_{name}_n"))
    more = [(F.col(sums) + F.col(f"_{name}_w")).alias(f"{weight}_before")] if weight else []
    out = out.select(*df.columns, name, *more)
    out._lexi_path = rows._lexi_path
    return out


def id_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Two columns ``doc_id`` (bigint) and ``text`` whatever else ``df`` has."""
    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
