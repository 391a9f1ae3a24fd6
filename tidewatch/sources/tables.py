"""Intermediate tables in the folder that all executors share, and places in a total order."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the cluster's ``spark.checkpoint.dir``.

    Where the session names none, it is set: to a folder of the warehouse on a
    cluster, to a temporary one only where driver and executors are one process.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        alone = spark.sparkContext.master.split("[")[0] == "local"
        named = "file://" + tempfile.mkdtemp(prefix="tidewatch-") if alone else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/tidewatch-stored"
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def _place(spark: SparkSession, path: str):
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(context._jsc.hadoopConfiguration())


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder; what is written there goes when the driver ends."""
    path = f"{shared_dir(spark)}/tidewatch-{uuid.uuid4().hex}"
    place, files = _place(spark, path)
    files.deleteOnExit(place)
    return path


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    This cuts the lineage: a lost executor costs only the tasks that it ran,
    and what is used twice is computed once.  The table goes when the driver
    ends, or before that by ``release``.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    again = spark.read.schema(df.schema).parquet(path)
    again._stored_at = path
    return again


def release(table: DataFrame) -> None:
    """Delete a table that ``stored`` returned and that nothing reads any more."""
    place, files = _place(table.sparkSession, table._stored_at)
    files.delete(place, True)


def with_position(rows: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """rows with their place, from 1, in the order of all of ``order``, whose values together are unique.

    Rows are dealt into slices of that whole order, as many as a shuffle has
    partitions, and stored; a row's place is that in its slice after all rows of
    the slices before.  No task sorts more than a slice.
    """
    dealt = stored(rows.repartitionByRange(*order).withColumn("_slice", F.spark_partition_id()))
    counts = dealt.groupBy("_slice").agg(F.count("*").alias("_n"))  # a row for each slice
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("_slice").orderBy(*order))
    found = dealt.withColumn("_place", place).join(F.broadcast(counts.select("_slice", before.alias("_before"))), "_slice")
    return found.select(*rows.columns, (F.col("_before") + F.col("_place")).alias(name))
