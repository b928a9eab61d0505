"""Global ranks without a task that sees everything, and tables that cut lineage in the folder that a cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names. Where it's unset, a temporary folder in local mode; on a cluster, where executors wouldn't see that, a ValueError."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    named = tempfile.mkdtemp(prefix="rectpart-")
    spark.conf.set("spark.checkpoint.dir", named)
    return named


@contextmanager
def arrow_rows(spark: SparkSession, rows: int, read: bool = False) -> Iterator[None]:
    """Rows that Spark sends to a Python worker at a time, for the jobs within: few where each holds whole texts. read: Parquet's reader, too, decodes no more at a time."""
    keys = ["spark.sql.execution.arrow.maxRecordsPerBatch", *["spark.sql.parquet.columnarReaderBatchSize"] * read]
    before = {key: spark.conf.get(key) for key in keys}
    for key, x in before.items():
        spark.conf.set(key, str(min(rows, int(x)) if int(x) > 0 else rows))
    try:
        yield
    finally:
        for key, x in before.items():
            spark.conf.set(key, x)


#: How rows of MBs are written.
LARGE_ROWS = {"parquet.block.row.count.limit": "1", "parquet.column.statistics.enabled": "false", "parquet.enable.dictionary": "false"}


class Scratch:
    """Tables of one operation. A saved table cuts the lineage, so that a lost executor costs a read and not the steps before; drop() deletes what isn't read any more.

    What is left is deleted when the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}"
        self.count = 0
        self._hadoop(self.path, lambda fs, path: (fs.mkdirs(path), fs.deleteOnExit(path)))

    def _hadoop(self, where: str, act) -> None:
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(where)
        act(path.getFileSystem(context._jsc.hadoopConfiguration()), path)

    def save(self, frame: DataFrame, name: str | None = None, large_rows: bool = False) -> DataFrame:
        """large_rows: each of them is MBs, and a row group of its own, without statistics and dictionaries, which hold copies. Otherwise a writer looks at its size after 100 rows
        first, and a reader takes all rows of a group at once."""
        if name is None:
            self.count += 1
        path = f"{self.path}/{name or self.count}"
        frame.write.mode("overwrite").options(**(LARGE_ROWS if large_rows else {})).parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._hadoop(f"{self.path}/{name}", lambda fs, path: fs.delete(path, True))

    def close(self) -> None:
        self._hadoop(self.path, lambda fs, path: fs.delete(path, True))


def saved(df: DataFrame) -> DataFrame:
    """One table that stays until the driver's JVM ends."""
    return Scratch(df.sparkSession).save(df)


def global_rank(df: DataFrame, order: list) -> DataFrame:
    """Adds `rank`, 0-based, in an order without ties: range partitions, their sizes summed up, then places within each. Broadcast: a size for each partition."""
    cut = saved(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = cut.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    inner = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return cut.withColumn("_in", inner).join(F.broadcast(starts), "_part").withColumn("rank", F.col("_start") + F.col("_in") - 1).drop("_part", "_in", "_start")
