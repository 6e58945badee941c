"""One graph to many: by chain, by lists of nodes, by position, by connection, by shape."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from lattisca.operators.local import by_graph
from lattisca.shared import durable, join_split


def by_chain(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes get ``part``, their chain; edges stay if both ends are in one part."""
    parts = nodes.withColumn("part", F.col("chain"))
    return parts, split_edges(parts, edges)


def split_edges(parts: DataFrame, edges: DataFrame) -> DataFrame:
    of = parts.select("graph", "node", "part")
    one = edges.join(of.select("graph", F.col("node").alias("src"), "part"), ["graph", "src"])
    return one.join(of.select("graph", F.col("node").alias("dst"), "part"), ["graph", "dst", "part"])


def from_lists(nodes: DataFrame, lists: DataFrame) -> DataFrame:
    """``lists`` (graph, list, node): each list with a node is a part, numbered without gaps; lists may share nodes."""
    met = nodes.join(lists, ["graph", "node"])
    return met.withColumn("part", (F.dense_rank().over(Window.partitionBy("graph").orderBy("list")) - 1).cast("long"))


def ordinal_slice(nodes: DataFrame, slices: DataFrame) -> DataFrame:
    """``slices`` (graph, chain, first, last): the residues of a chain from the first to the last by rank, from 1."""
    rank = F.row_number().over(Window.partitionBy("graph", "chain").orderBy("pos"))
    return nodes.withColumn("rank", rank.cast("long")).join(slices, ["graph", "chain"]).where("rank between first and last").drop("first", "last")


def chunks(nodes: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Blocks of ``size`` residues in order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("pos"))
    return nodes.withColumn("chunk", F.floor((rank - 1) / size).cast("long"))


def _united(rows: list[tuple]) -> list[tuple]:
    parent: dict = {}

    def find(x):  # noqa: ANN001, ANN202
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in rows:
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return [(n, find(n)) for n in list(parent)]


def connected_components(edges: DataFrame) -> DataFrame:
    """(graph, node, component): the smallest node that each end of an edge reaches, whatever the directions. A graph is
    bounded, so its edges meet in one task; links without a graph are for ``linked_components``."""
    kind = edges.schema["src"].dataType.simpleString()
    ends = edges.where("src <> dst").select("graph", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return by_graph(ends, _united, f"node {kind}, component {kind}")


def linked_components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, component) for the ends of links (i, j) of any number: large and small stars in turn, until nothing changes.

    Edges hang below ever smaller nodes until each is below its component's smallest. The number of rounds grows with the
    logarithm of a component's size; each round's edges are written out. If ``rounds`` are given and do not suffice, it is
    an error.
    """
    now = durable(links.select(F.greatest("i", "j").alias("u"), F.least("i", "j").alias("v")).where("u <> v").distinct())
    seen = None
    for _ in itertools.count() if rounds is None else range(rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = join_split(both, least, ["u"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = join_split(large, below, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = durable(small.union(below.select("u", F.col("m").alias("v"))).distinct())
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == seen:
            named = now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
            return named.union(named.select(F.col("component").alias("node"), "component").distinct())
        seen = mark
    raise RuntimeError(f"components still change after {rounds} rounds")


def chop(points: np.ndarray, most: int) -> np.ndarray:
    """Halves by the sign of the first principal coordinate until no part has more than ``most`` points; equal points are
    cut in half by order. Returns the number of each point's part."""
    out = np.zeros(len(points), np.int64)
    todo, made = [np.arange(len(points))], 0
    while todo:
        at = todo.pop()
        if len(at) <= most:
            out[at] = made
            made += 1
            continue
        centred = points[at] - points[at].mean(0)
        _, vectors = np.linalg.eigh(centred.T @ centred)
        axis = vectors[:, -1] * np.sign(vectors[np.abs(vectors[:, -1]).argmax(), -1])
        right = centred @ axis >= 0
        if right.all() or not right.any():
            right = np.arange(len(at)) >= len(at) // 2
        todo += [at[right], at[~right]]
    return out


def pca_chop(nodes: DataFrame, most: int = 50, keys: str = "graph") -> DataFrame:
    """Adds ``part`` by recursive principal-axis bisection of (x, y, z). A graph is a molecule, bounded in size."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        return rows.assign(part=chop(rows[["x", "y", "z"]].to_numpy(float), most))

    return nodes.groupBy(keys).applyInPandas(run, StructType([*nodes.schema.fields, StructField("part", LongType())]))


def batches(df: DataFrame, size: int) -> Iterator[pd.DataFrame]:
    """Rows as batches on the driver, a partition at a time."""
    kept: list = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        kept.append(row)
        if len(kept) == size:
            yield pd.DataFrame(kept, columns=df.columns)
            kept = []
    if kept:
        yield pd.DataFrame(kept, columns=df.columns)


def by_groups(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """(graph, node, part) of the residues whose chain is in a group ``A-B-C`` of ``groups`` (graph, chains); the part is the
    group's name, and a chain may be in several."""
    wanted = groups.select("graph", F.col("chains").alias("part"), F.explode(F.array_distinct(F.split("chains", "-"))).alias("chain"))
    return nodes.join(wanted, ["graph", "chain"]).select("graph", "node", "part")


def chains_of_size(nodes: DataFrame, least: int = 0, most: int = -1) -> DataFrame:
    """(graph, chain, n) of the chains with at least ``least`` and at most ``most`` residues; -1 sets no bound."""
    sizes = nodes.groupBy("graph", "chain").agg(F.countDistinct("node").alias("n"))
    return sizes.where((F.col("n") >= least) & ((F.lit(most) == -1) | (F.col("n") <= most)))
