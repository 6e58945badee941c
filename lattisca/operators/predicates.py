"""Predicates of nodes and edges that look at what is around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattisca.operators import edges as E
from lattisca.operators import traverse as T
from lattisca.sources.structures import AMINO


def odd_within(edges: DataFrame, roots: DataFrame, depth: int = 2) -> DataFrame:
    """(graph, root, has_nc): whether an edge that isn't canonical lies in the root's ball."""
    inside = T.ego_edges(edges, T.ball(edges, roots, depth)).groupBy("graph", "root").agg(F.bool_or(~E.is_canonical(F.col("label"))).alias("has_nc"))
    return roots.select("graph", "root").join(inside, ["graph", "root"], "left").na.fill({"has_nc": False})


def odd_or_loop_nodes(edges: DataFrame, nodes: DataFrame, depth: int = 4) -> DataFrame:
    """(graph, node) with two neighbours, as in a loop, or near an edge that isn't canonical."""
    pairs = edges.select("graph", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src <> dst").distinct()
    loops = E.degrees(pairs).where("degree = 2").select("graph", "node")
    others = nodes.select("graph", "node").join(loops, ["graph", "node"], "left_anti").withColumnRenamed("node", "root")
    odd = odd_within(edges, others, depth).where("has_nc").select("graph", F.col("root").alias("node"))
    return loops.union(odd)


def stem_edges(edges: DataFrame, labels: tuple[str, ...] = ("CWW", "cWW")) -> DataFrame:
    """Adds ``stem``: the edge is no canonical pair, and each end has one or two neighbours by edges that aren't canonical."""
    odd = edges.where(~E.is_canonical(F.col("label"))).groupBy("graph", F.col("src").alias("node")).agg(F.countDistinct("dst").alias("n")).where("n between 1 and 2").select("graph", "node")
    mark = lambda end, c: odd.select("graph", F.col("node").alias(end), F.lit(True).alias(c))
    met = edges.join(mark("src", "_a"), ["graph", "src"], "left").join(mark("dst", "_b"), ["graph", "dst"], "left")
    stem = ~F.col("label").isin(*labels) & F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return met.select(*edges.columns, stem.alias("stem"))


def is_dna(comp: Column, group: Column) -> Column:
    """No hetero residue, no amino acid, and a D in its name."""
    return (group != "HETATM") & ~comp.isin(*AMINO) & comp.contains("D")
