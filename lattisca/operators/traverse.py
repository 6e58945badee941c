"""Walks over all graphs and roots at once: each hop is one join, and what was visited is anti-joined away.

A graph is bounded, so hops are too; the number of roots is not, and no root is looked at alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattisca.operators.edges import is_canonical


def ball(edges: DataFrame, roots: DataFrame, depth: int, directed: bool = True) -> DataFrame:
    """(graph, root, node, hop): the nodes within ``depth`` hops of each root of ``roots`` (graph, root), with the fewest hops."""
    ways = edges.select("graph", "src", "dst")
    if not directed:
        ways = ways.union(edges.select("graph", F.col("dst").alias("src"), F.col("src").alias("dst")))
    ways = ways.distinct()
    found = roots.select("graph", "root", F.col("root").alias("node"), F.lit(0).alias("hop"))
    border = found
    for hop in range(1, depth + 1):
        after = border.join(ways, (border.graph == ways.graph) & (border.node == ways.src)).select(border.graph, "root", F.col("dst").alias("node")).distinct()
        border = after.join(found.select("graph", "root", "node"), ["graph", "root", "node"], "left_anti").withColumn("hop", F.lit(hop))
        found = found.union(border)
    return found


def ball_until_canonical(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """Like ``ball``, but a root's walk ends at a hop whose edges are all canonical."""
    ways = edges.select("graph", "src", "dst", (~is_canonical(F.col("label"))).alias("odd"))
    found = roots.select("graph", "root", F.col("root").alias("node"), F.lit(0).alias("hop"))
    border = found
    for hop in range(1, depth + 1):
        steps = border.join(ways, (border.graph == ways.graph) & (border.node == ways.src)).select(border.graph, "root", "dst", "odd")
        going = steps.groupBy("graph", "root").agg(F.bool_or("odd").alias("on")).where("on").select("graph", "root")
        after = steps.select("graph", "root", F.col("dst").alias("node")).distinct().join(found.select("graph", "root", "node"), ["graph", "root", "node"], "left_anti")
        found = found.union(after.withColumn("hop", F.lit(hop)))
        border = after.join(going, ["graph", "root"], "left_semi").withColumn("hop", F.lit(hop))
    return found


def ego_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(graph, root, src, dst, label): edges with both ends in a root's ball ``members``."""
    of = members.select("graph", "root", "node")
    one = edges.join(of.withColumnRenamed("node", "src"), ["graph", "src"])
    return one.join(of.withColumnRenamed("node", "dst"), ["graph", "root", "dst"], "left_semi").select("graph", "root", "src", "dst", "label")


def near_roots(edges: DataFrame, roots: DataFrame, depth: int = 1) -> DataFrame:
    """Edges that lie in the ball of at least one root, each once."""
    return ego_edges(edges, ball(edges, roots, max(1, depth))).drop("root").distinct()


def rings(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(graph, root, hop, label, a, b): each undirected edge at the first hop that touches it: one more than the smaller
    number of hops of its ends. ``edges`` has each pair once, as src < dst."""
    members = ball(edges, roots, depth, directed=False)
    ends = F.array(F.struct(F.col("src").alias("node")), F.struct(F.col("dst").alias("node")))
    touching = edges.select("graph", "src", "dst", "label", F.explode(ends).alias("e")).select("graph", "src", "dst", "label", "e.node")
    first = members.where(F.col("hop") < depth).join(touching, ["graph", "node"]).groupBy("graph", "root", "src", "dst", "label").agg((F.min("hop") + 1).alias("hop"))
    return first.select("graph", "root", "hop", "label", F.col("src").alias("a"), F.col("dst").alias("b"))


def ball_hashes(edges: DataFrame, roots: DataFrame, depth: int = 1, iterations: int = 2, symmetric: bool = False, width: int = 32, label: str | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """(graph, root, hash): the refinement hash of each root's ball, cut to ``width`` hexadecimal digits. ``symmetric`` takes
    both directions of a label for one; ``label`` names a column of ``nodes`` (graph, node) to begin with, else all are alike."""
    from lattisca.operators.edges import symmetric_label

    members = ball(edges, roots, depth, directed=False)
    name = F.concat_ws("|", "graph", "root")
    inside = ego_edges(edges.withColumn("label", symmetric_label(F.col("label"))) if symmetric else edges, members)
    each = members.withColumn("_label", F.lit("")) if label is None else members.join(nodes.select("graph", "node", F.col(label).alias("_label")), ["graph", "node"])
    found = wl_hash(inside.select(name.alias("graph"), "src", "dst", "label"), each.select(name.alias("graph"), "node", "_label"), "_label", iterations)
    return roots.select("graph", "root", name.alias("_name")).join(found.withColumnRenamed("graph", "_name"), "_name").select("graph", "root", F.substring("hash", 1, width).alias("hash"))


def hash_table(hashes: DataFrame, examples: int = 0) -> DataFrame:
    """(hash, n, first): how many balls have each hash and the smallest of them as (graph, root); with ``examples`` also so
    many of them."""
    at = F.struct("graph", "root")
    more = [F.slice(F.array_sort(F.collect_list(at)), 1, examples).alias("examples")] if examples else []
    return hashes.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first"), *more)


def missing_hashes(hashes: DataFrame, table: DataFrame) -> DataFrame:
    """The hashes that a table lacks; none if it is complete."""
    return hashes.select("hash").distinct().join(table, "hash", "left_anti")


def node_rings(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(graph, root, hop, nodes): the nodes first met at each hop, in order."""
    found = ball(edges, roots, depth, directed=False)
    return found.groupBy("graph", "root", "hop").agg(F.array_sort(F.collect_list("node")).alias("nodes"))


def graphlet_rings(edges: DataFrame, roots: DataFrame, hashes: DataFrame, depth: int) -> DataFrame:
    """(graph, root, hop, hashes): the hashes of the balls around the nodes of each ring, in order. ``hashes`` is (graph, root,
    hash), of every node."""
    met = ball(edges, roots, depth, directed=False).join(hashes.select("graph", F.col("root").alias("node"), "hash"), ["graph", "node"])
    return met.groupBy("graph", "root", "hop").agg(F.array_sort(F.collect_list("hash")).alias("hashes"))


def wl_labels(edges: DataFrame, nodes: DataFrame, label: str, iterations: int = 2) -> DataFrame:
    """(graph, node, wl): labels refined by the sorted edge labels and labels of neighbours, hashed at each step."""
    now = nodes.select("graph", "node", F.md5(F.col(label).cast("string")).alias("wl"))
    for _ in range(iterations):
        near = edges.join(now.select("graph", F.col("node").alias("dst"), F.col("wl").alias("other")), ["graph", "dst"])
        seen = near.groupBy("graph", F.col("src").alias("node")).agg(F.array_join(F.array_sort(F.collect_list(F.concat("label", "other"))), ",").alias("around"))
        now = now.join(seen, ["graph", "node"], "left").select("graph", "node", F.md5(F.concat("wl", F.lit("|"), F.coalesce("around", F.lit("")))).alias("wl"))
    return now


def wl_hash(edges: DataFrame, nodes: DataFrame, label: str, iterations: int = 2) -> DataFrame:
    """(graph, hash): equal for graphs that refinement does not tell apart."""
    last = wl_labels(edges, nodes, label, iterations)
    return last.groupBy("graph").agg(F.md5(F.array_join(F.array_sort(F.collect_list("wl")), ",")).alias("hash"))


def walk_weights(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(graph, node, weight): walks of up to two steps that end in an edge that isn't canonical, clipped to one, scaled by
    how rare they are in the graph."""
    odd = edges.where(~is_canonical(F.col("label"))).groupBy("graph", F.col("src").alias("node")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    total = odd
    step = odd
    for _ in range(2):
        step = edges.join(step.select("graph", F.col("node").alias("dst"), "w"), ["graph", "dst"]).groupBy("graph", F.col("src").alias("node")).agg(F.sum("w").alias("w"))
        total = total.union(step.select("graph", "node", "w"))
    value = total.groupBy("graph", "node").agg(F.least(F.sum("w"), F.lit(1.0)).alias("v"))
    each = nodes.select("graph", "node").join(value, ["graph", "node"], "left").na.fill({"v": 0.0})
    share = each.groupBy("graph").agg(F.avg("v").alias("share"))
    return each.join(share, "graph").select("graph", "node", (F.col("v") / (F.col("share") + 0.005) + 1).alias("weight"))
