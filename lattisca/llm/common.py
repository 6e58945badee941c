"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

ASCII_SPACE = r"[\x20\x09-\x0D]+"
#: Seconds that pass at least before the driver's memory is given back again.
GIVE_BACK_S = 5
#: And before the executors' is: a collection on each of them.
EXECUTORS_S = 15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session has none, a local master gets a temporary folder (tests); a cluster gets an error, as a
    machine's own folder would not be seen by the others.
    """
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


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in the shared folder, so that a lost executor costs no recomputation."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def with_text(docs: DataFrame, text: str, keep: list[str]) -> tuple[DataFrame, StructType]:
    """The columns ``keep`` and, as the last one, ``text`` (once, where it is the last to keep), for functions on batches;
    and the schema of those kept."""
    if text in keep:
        keep.remove(text)
        keep.append(text)
        rows = docs.select(*[F.col(f"`{c}`") for c in keep])
        return rows, StructType(list(rows.schema.fields))
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_text"))
    return rows, StructType(rows.schema.fields[:-1])


_HELD: dict[str, Callable[[], None]] = {}


def hold(owner: str, drop: Callable[[], None]) -> None:
    """A worker process outlives its tasks, and so does what operators keep in it. One operator's things stay at a time:
    when another comes, ``drop`` of those before is called. What is free then goes back to the machine."""
    others = [n for n in _HELD if n != owner]
    for name in others:
        _HELD.pop(name)()
    if others:
        gc.collect()
    _HELD.setdefault(owner, drop)
    trim()


def trim() -> None:
    """Gives this process's free native memory back to the machine."""
    pa.default_memory_pool().release_unused()
    if give := getattr(ctypes.CDLL(None), "malloc_trim", None):
        give(0)


def hash_unit(key: Column) -> Column:
    """From 0 to 1, by the key alone."""
    return F.shiftrightunsigned(F.xxhash64(key), 11).cast("double") / F.lit(float(1 << 53))


def smallest_hashes(rows: DataFrame, key: str, kind: str, most: int) -> Column:
    """A condition that keeps about half as many again as ``most`` rows of each ``kind``, those with the smallest hashes of ``key``; few rows
    are all kept. Kinds are labels, so their counts are few; no kind is gathered in a task of its own."""
    out = F.lit(False)
    for value, n in rows.groupBy(kind).count().collect():
        out = out | ((F.col(kind) == F.lit(value)) & (hash_unit(F.col(key)) < F.lit(min(2.0, 1.5 * most / n + 1e-9))))
    return out


def join_split(rows: DataFrame, keyed: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``keyed``, which has a row for each of its ``keys``, when some keys may have very many ``rows``.

    Spark deals a hot key's rows over several tasks only where both sides were shuffled for the join. An aggregate by the
    same keys would pass on its own partitioning instead, and so one task would get all; another key beside them prevents it.
    """
    mark = F.xxhash64(*keys, F.lit(len(keys)))
    return rows.withColumn("_split", mark).join(keyed.withColumn("_split", mark), ["_split", *keys], how).drop("_split")


_given_back = [0.0]
_collected = [float("-inf")]


def collect_on_executors(spark: SparkSession) -> None:
    """A full collection on each executor, which takes less heap afterwards and no classes of plans that are gone. Executors fill
    all of their heap before they collect by themselves, and their Python workers need memory beside it."""
    executors = spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1  # without the driver
    if executors > 0:
        with contextlib.suppress(PySparkException):  # some clusters allow no Java methods
            # Between jobs, tasks are dealt out one to an executor.
            spark.range(0, executors, 1, executors).select(F.call_function("java_method", F.lit("java.lang.System"), F.lit("gc"))).collect()


def give_back(spark: SparkSession, wait: float = GIVE_BACK_S) -> bool:
    """Gives the driver's free memory back to the machine, unless that was done in the last ``wait`` seconds; tells if it did.
    So is the executors', every EXECUTORS_S seconds at most.

    A driver that plans many jobs in a row takes new heap for their remains, and what its compilers and threads have freed
    stays in the native heap. The collection also lets Spark remove shuffle files of results that are gone.
    """
    if time.monotonic() - _given_back[0] < wait:
        return False
    gc.collect()  # first, as the JVM keeps what Python's objects stand for
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    jvm.System.gc()
    with contextlib.suppress(Py4JError):  # other JVMs have no such command
        beans = jvm.java.lang.Class.forName("javax.management.MBeanServer")
        call = next(m for m in beans.getMethods() if m.getName() == "invoke")
        args = gateway.new_array(jvm.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    trim()
    if time.monotonic() - _collected[0] >= EXECUTORS_S:
        collect_on_executors(spark)
        _collected[0] = time.monotonic()
    _given_back[0] = time.monotonic()
    return True


class Scratch:
    """Durable intermediate results of one operator, removed together when its result no longer reads them. The driver's and the
    executors' free memory is given back meanwhile."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame) -> DataFrame:
        out = durable(df)
        file = out._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if file.isDefined():
            self.paths.append(file.get())
        give_back(self.spark)
        return out

    def drop(self, but: int = 0) -> None:
        """Removes all but the last ``but`` results."""
        gone = self.paths[: len(self.paths) - but]
        self.paths = self.paths[len(gone) :]
        remove(self.spark, gone)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Removes folders, wherever they are."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def gapless_rank(df: DataFrame, keys: list[str], order: list[str], name: str, salt: Column, groups: list[DataFrame] | None = None) -> DataFrame:
    """Adds ``name``: numbers from 0 without gaps in each group of ``keys``, in no task more than a share of a group.

    A group is dealt over as many buckets as there are shuffle partitions by the hash of ``salt``; the buckets' counts,
    summed up in order, give each bucket its first number. Rows are ordered by ``order`` inside a bucket. ``df`` is read
    twice, so it should be cheap or durable.
    """
    n = max(1, shuffle_partitions(df.sparkSession))
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(salt), F.lit(n)).cast("int"))
    counts = dealt.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    joined = dealt.join(starts, [*keys, "_bucket"])
    return joined.withColumn(name, F.col("_first") + F.row_number().over(inside) - 1).drop("_bucket", "_first")
