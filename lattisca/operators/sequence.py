"""Sequences from residues: runs between gaps, their strings, brackets of pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def runs(nodes: DataFrame, keys: list[str], tolerance: int = 2) -> DataFrame:
    """Adds ``run``, from 0 in each group: a run ends where at least ``tolerance`` positions are missing."""
    order = Window.partitionBy(*keys).orderBy("pos")
    broken = (F.col("pos") - F.lag("pos").over(order) - 1 >= tolerance).cast("int")
    marked = nodes.withColumn("_broken", F.coalesce(broken, F.lit(0)))
    return marked.withColumn("run", F.sum("_broken").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_broken")


def sequences(nodes: DataFrame, keys: list[str], letter: Column, tolerance: int = 2, longer_than: int = 5) -> DataFrame:
    """(keys, run, first, last, n, seq) of all runs longer than ``longer_than``."""
    cut = runs(nodes, keys, tolerance).withColumn("_letter", letter)
    whole = cut.groupBy(*keys, "run").agg(
        F.min("pos").alias("first"), F.max("pos").alias("last"), F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_letter"))), lambda x: x["_letter"]), "").alias("seq")
    )
    return whole.where(F.col("n") > longer_than)


def longest_run(nodes: DataFrame, keys: list[str], letter: Column, tolerance: int = 2) -> DataFrame:
    """The longest run of each group, the last of equals."""
    best = Window.partitionBy(*keys).orderBy(F.col("n").desc(), F.col("run").desc())
    return sequences(nodes, keys, letter, tolerance, 0).withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def standard_letter(code: Column) -> Column:
    return F.when(F.upper(code).isin("A", "C", "G", "U"), F.upper(code)).otherwise("N")


def brackets(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(graph, n, brackets): ``(`` where a residue's partner comes later, ``)`` where it came before, else a dot. ``pairs``
    (graph, src, dst) has both directions; the nearest partner counts."""
    by = pairs.groupBy("graph", F.col("src").alias("node")).agg(F.min_by("dst", F.struct(F.abs(F.col("dst") - F.col("src")), F.col("dst"))).alias("partner"))
    mark = F.when(F.col("partner") > F.col("node"), "(").when(F.col("partner") < F.col("node"), ")").otherwise(".")
    each = nodes.join(by, ["graph", "node"], "left").select("graph", F.struct("pos", mark.alias("m")).alias("s"))
    return each.groupBy("graph").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["m"]), "").alias("brackets"))
