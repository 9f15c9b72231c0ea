"""Reading tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: A table with less than this for each core is dealt out to all cores before the work begins.
SPREAD_BYTES = 8 << 20


def _row_groups(df: DataFrame, cores: int) -> tuple[int, int]:
    """Bytes of the Parquet files that the table is read from, and of the largest row group if that
    may be more than a core's share of them (else 0): only footers of such files are read."""
    spark = df.sparkSession
    hadoop, parquet, conf = spark._jvm.org.apache.hadoop.fs, spark._jvm.org.apache.parquet.hadoop, spark._jsc.hadoopConfiguration()
    paths = [hadoop.Path(spark._jvm.java.net.URI(f)) for f in df.inputFiles() if f.endswith(".parquet")]
    sizes = [p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths]
    most = 0
    for path, size in zip(paths, sizes, strict=True):
        if size * cores > sum(sizes):
            reader = parquet.ParquetFileReader.open(parquet.util.HadoopInputFile.fromPath(path, conf))
            most = max([most, *(group.getCompressedSize() for group in reader.getRowGroups())])
            reader.close()
    return sum(sizes), most


def spread(df: DataFrame) -> DataFrame:
    """A table that few tasks would read in as many partitions as there are cores, or more.

    A scan cannot split a row group, so a small file, or a large one with few row groups, would
    keep one core busy and the others idle. Tables with enough row groups for every core are
    left as they are: no shuffle is added.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size < cores * SPREAD_BYTES:
        return df.repartition(cores)
    held, most = _row_groups(df, cores)
    return df.repartition(max(cores, held // (4 * SPREAD_BYTES))) if 2 * most * cores > 3 * held else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
