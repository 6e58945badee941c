"""Binding pockets: growth from ligands, flags, pairs for screening, and edges that are not there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattisca.operators import edges as E
from lattisca.operators.split import hash_unit


def _grown(ways: DataFrame, members: DataFrame, hops: int) -> DataFrame:
    """``members`` (graph, pocket, node) and all that lies within so many hops of one."""
    found = members
    border = members
    for _ in range(hops):
        after = border.join(ways, (border.graph == ways.graph) & (border.node == ways.src)).select(border.graph, "pocket", F.col("dst").alias("node")).distinct()
        border = after.join(found, ["graph", "pocket", "node"], "left_anti")
        found = found.union(border)
    return found


def grow_pockets(edges: DataFrame, seeds: DataFrame, fewer_than: int = 40, most: int = 2, hops: int = 2) -> DataFrame:
    """(graph, pocket, node): the residues within ``hops`` of the bound ones, ``seeds``; pockets of fewer than ``fewer_than``
    residues grow by as many hops again, up to ``most`` times."""
    ways = edges.select("graph", "src", "dst").distinct()
    found = _grown(ways, seeds.select("graph", "pocket", "node").distinct(), hops)
    for _ in range(most):
        small = found.groupBy("graph", "pocket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < fewer_than).select("graph", "pocket")
        more = _grown(ways, found.join(small, ["graph", "pocket"], "left_semi"), hops)
        found = found.join(small, ["graph", "pocket"], "left_anti").union(more)
    return found


def by_content(pockets: DataFrame, nodes: DataFrame, content: str, below: float) -> DataFrame:
    """The pockets whose residues have little of ``content`` on average."""
    mean = pockets.join(nodes.select("graph", "node", F.col(content).alias("_c")), ["graph", "node"]).groupBy("graph", "pocket").agg(F.avg("_c").alias("_m"))
    return pockets.join(mean.where(F.col("_m") < below), ["graph", "pocket"], "left_semi")


def in_pocket(nodes: DataFrame, pockets: DataFrame) -> DataFrame:
    """Adds ``in_pocket``: whether a pocket of ``pockets`` (graph, node) holds the residue."""
    held = pockets.select("graph", "node").distinct().withColumn("in_pocket", F.lit(True))
    return nodes.join(held, ["graph", "node"], "left").na.fill({"in_pocket": False})


def pocket_flags(nodes: DataFrame) -> DataFrame:
    """(graph, in_pocket): the flags of each graph as an array, in the order of its tensors."""
    at = F.struct(F.col("node").cast("string").alias("node"), "in_pocket")
    packed = nodes.groupBy("graph").agg(F.array_sort(F.collect_list(at)).alias("s"))
    return packed.select("graph", F.transform("s", lambda x: x["in_pocket"].cast("int")).alias("in_pocket"))


def pocket_graphs(nodes: DataFrame, edges: DataFrame, pockets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with their flags and the edges of the graphs that have a pocket, to be written as files."""
    held = pockets.select("graph").distinct()
    return in_pocket(nodes.join(held, "graph", "left_semi"), pockets), edges.join(held, "graph", "left_semi")


def sampled_pairs(groups: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """(key, ligand, active): a coin by hash takes actives or decoys of each group (key, actives, decoys), and a second hash one
    of them; a group without the ones it falls on gives the others, one without any nothing."""
    u = hash_unit(F.col(key), seed)
    heads = ((u > 0.5) & (F.size("actives") > 0)) | (F.size("decoys") == 0)
    some = F.when(heads, F.col("actives")).otherwise(F.col("decoys"))
    place = F.floor(hash_unit(F.col(key), seed + 1) * F.size(some)).cast("int")
    return groups.where((F.size("actives") > 0) | (F.size("decoys") > 0)).select(key, F.get(some, place).alias("ligand"), heads.alias("active"))


def base_pairs(edges: DataFrame) -> DataFrame:
    """Edges that are no backbone: what a link predictor learns."""
    return edges.where(~F.col("label").isin(*E.BACKBONE))


def negative_edges(nodes: DataFrame, positives: DataFrame, edges: DataFrame, each: int = 1, seed: int = 0) -> DataFrame:
    """(graph, src, dst): for each positive (graph, src, dst) ``each`` draws of another end among its graph's nodes, by hash,
    without those that are an edge or the node itself. The draws are places in the order of the graph's nodes, so no pair of
    nodes is looked at but the drawn ones."""
    order = nodes.groupBy("graph").agg(F.array_sort(F.collect_set("node")).alias("_all"))
    name = F.concat_ws("|", F.col("graph").cast("string"), F.col("src").cast("string"), F.col("dst").cast("string"), F.col("_k").cast("string"))
    drawn = positives.select("graph", "src", "dst").distinct().withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(each)))).join(order, "graph")
    other: Column = F.get("_all", F.floor(hash_unit(name, seed) * F.size("_all")).cast("int"))
    pairs = drawn.select("graph", "src", other.alias("dst")).where("src <> dst").distinct()
    return pairs.join(edges.select("graph", "src", "dst").distinct(), ["graph", "src", "dst"], "left_anti")
