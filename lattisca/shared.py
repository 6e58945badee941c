"""Durable results in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a local master gets a temporary folder and a cluster an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if root is None and held.isDefined():
        root = held.get()
    if root is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lattisca-shared-")
    if not held.isDefined():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once, its lineage cut: an iteration's plan does not grow, and a lost executor costs one read."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def join_split(rows: DataFrame, keyed: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``keyed``, which has a row for each of its ``keys``, when some keys may have very many ``rows``.

    Spark deals a hot key's rows over several tasks only where both sides were shuffled for the join. An aggregate by the
    same keys would pass on its own partitioning instead; another key beside them prevents it.
    """
    mark = F.xxhash64(*keys, F.lit(len(keys)))
    return rows.withColumn("_split", mark).join(keyed.withColumn("_split", mark), ["_split", *keys], how).drop("_split")


def _ranged(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` dealt by ranges of ``order``, with the number of the range as ``_range``."""
    return durable(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))


def ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds ``name``, numbers from 0 without gaps in ``order`` over all rows, which no single task sees: ranges are counted, and
    rows numbered inside of theirs."""
    return running_sum(rows.withColumn("_one", F.lit(1).cast("long")), order, F.col("_one"), name).drop("_one")


def running_sum(rows: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """Adds ``name``, the sum of ``value`` over all rows before in ``order``."""
    dealt = _ranged(rows, order)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    firsts = dealt.groupBy("_range").agg(F.sum(value).alias("_sum")).select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    here = F.coalesce(F.sum(value).over(inside), F.lit(0))
    return dealt.withColumn("_here", here).join(F.broadcast(firsts), "_range").withColumn(name, F.col("_first") + F.col("_here")).drop("_range", "_here", "_first")
