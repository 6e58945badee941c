"""Counts and statistics of a collection: partial aggregates, merged by one shuffle of counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def value_counts(rows: DataFrame, columns: list[str], by: list[str] | None = None, field: str = "field", value: str = "value") -> DataFrame:
    """(by, field, value, n): how often each attribute has each value, for all rows or in each group of ``by``."""
    by = by or []
    kind = "string" if len({rows.schema[c].dataType.simpleString() for c in columns}) > 1 else rows.schema[columns[0]].dataType.simpleString()
    long = rows.select(*by, *[F.col(c).cast(kind).alias(c) for c in columns]).unpivot(by, columns, field, value)
    return long.groupBy(*by, field, value).agg(F.count(F.lit(1)).alias("n"))


def graph_index(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(graph, key, value, n): what each graph holds, for looking graphs up."""
    return value_counts(rows, columns, ["graph"], "key", "value")


def label_counts(rows: DataFrame, outer: str, inner: str) -> DataFrame:
    """Counts of each pair, of each ``outer`` and of all, where nulls stand for all."""
    return rows.rollup(outer, inner).agg(F.count(F.lit(1)).alias("n"))


def length_stats(nodes: DataFrame) -> DataFrame:
    """Least, most, mean and median number of nodes of a graph, as one row."""
    sizes = nodes.groupBy("graph").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean"), F.median("n").alias("median"))


def label_idf(edges: DataFrame) -> DataFrame:
    """(label, idf): the logarithm of one more than the graphs for each graph that has the label."""
    each = edges.select("label", "graph").distinct()
    total = each.agg(F.countDistinct("graph").alias("total"))
    df = each.groupBy("label").agg(F.count(F.lit(1)).alias("df"))
    return df.join(F.broadcast(total)).select("label", F.log(F.col("total") / F.col("df") + 1).alias("idf"))  # one row


def correlation(rows: DataFrame, one: str, two: str) -> Column:
    return F.corr(F.col(one).cast("double"), F.col(two).cast("double"))


def positive_weight(label: Column) -> Column:
    """The root of negatives for each positive, as an aggregate."""
    return F.sqrt(F.count_if(label == 0) / F.count_if(label == 1))


def shares(rows: DataFrame, group: str, label: str) -> DataFrame:
    """(group, label, n, share): how often each label comes in a group, and its part of the group."""
    counts = rows.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(group)))  # a row for each label


def label_summary(nodes: DataFrame, edges: DataFrame, label: str) -> DataFrame:
    """One row: the share of ones among a label's values, the distinct edge labels, and the most and mean nodes of a graph."""
    ones = nodes.agg(F.avg(F.col(label).cast("double")).alias("fraction"))
    kinds = edges.agg(F.countDistinct("label").alias("edge_labels"))
    sizes = length_stats(nodes).select("most", "mean")
    return ones.join(kinds).join(sizes)  # of one row each


def ordered_digest(rows: DataFrame, group: Column, item: str, parts: list[tuple[str, Column]], name: str) -> DataFrame:
    """(name, hash): SHA-256 over the items of each group, in order of ``item``; an item's own is over its ``parts``, pairs of a
    column to order by and a text. Equal for collections with the same items and parts."""
    order, text = parts[0]
    one = rows.groupBy(item, group.alias(name)).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t")))), lambda x: x["t"]), ","), 256).alias("h"))
    whole = one.groupBy(name).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(item, "h"))), lambda x: x["h"]), "").alias("all"))
    return whole.select(name, F.sha2("all", 256).alias("hash"))


def pivoted(rows: DataFrame, key: str, attribute: str, value: str, names: list[str]) -> DataFrame:
    """(key, names...): each named attribute's largest value as a column; null where there is none."""
    return rows.groupBy(key).agg(*[F.max(F.when(F.col(attribute) == n, F.col(value))).alias(n) for n in names])
