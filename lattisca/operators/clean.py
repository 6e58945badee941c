"""Cleaning of graphs that were cut or are to be reduced to what is not a plain stem. All work on (graph, src, dst, label) with
either or both directions of an edge, and count neighbours whatever the direction."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattisca.operators import edges as E
from lattisca.operators.local import by_graph
from lattisca.operators.partition import connected_components


def _pairs(edges: DataFrame) -> DataFrame:
    """Each pair of different neighbours once."""
    return edges.select("graph", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src <> dst").distinct()


def _without_loose_ends(rows: list[tuple]) -> list[tuple]:
    near: dict = {}
    for a, b in rows:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    todo = deque(n for n, some in near.items() if len(some) < 2)
    while todo:
        n = todo.popleft()
        for other in near.pop(n, ()):
            near[other].discard(n)
            if len(near[other]) == 1:
                todo.append(other)
    return [(a, b) for a, b in rows if a in near and b in near]


def dangle_trim(edges: DataFrame) -> DataFrame:
    """Edges (graph, src, dst), once each, left when nodes with fewer than two neighbours are removed until there are none."""
    pairs = _pairs(edges)
    kind = pairs.schema["src"].dataType.simpleString()
    return by_graph(pairs, _without_loose_ends, f"src {kind}, dst {kind}")


def _without_stacks(rows: list[tuple]) -> list[tuple]:
    backbone: dict = {}
    paired: dict = {}
    near: dict = {}
    for a, b, label in rows:
        for x, y in ((a, b), (b, a)):
            near.setdefault(x, set()).add(y)
            if label in E.BACKBONE:
                backbone.setdefault(x, set()).add(y)
            elif label.upper() == "CWW":
                paired.setdefault(x, set()).add(y)
    todo = deque(sorted(near))
    while todo:
        n = todo.popleft()
        if n not in near or len(near[n]) != 2:
            continue
        after = [s for s in backbone.get(n, ()) if s in near[n]]
        with_ = [p for p in paired.get(n, ()) if p in near[n]]
        if len(after) != 1 or len(with_) != 1 or after == with_ or len(near[with_[0]]) > 3:
            continue
        p, s = with_[0], after[0]
        if any(q in near[p] and q in near and q in paired.get(s, ()) for q in backbone.get(p, ())):
            for gone in (n, p):
                for other in near.pop(gone, ()):
                    near.get(other, set()).discard(gone)
                    todo.append(other)
    return [(a, b, label) for a, b, label in rows if a in near and b in near]


def stack_trim(edges: DataFrame) -> DataFrame:
    """Edges left when the open ends of stems are taken off until there are none: a node with one neighbour along the
    backbone and one canonical partner goes, with that partner, if the next pair stacks on theirs."""
    kind = edges.schema["src"].dataType.simpleString()
    return by_graph(edges.select("graph", "src", "dst", "label"), _without_stacks, f"src {kind}, dst {kind}, label string")


def gap_fill(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(graph, node): the nodes of ``members``, and all neighbours of those that have one neighbour among them."""
    inside = _pairs(E.induced(edges, members))
    loose = E.degrees(inside).where("degree = 1").select("graph", "node")
    near = E.both_ways(edges).join(loose, ["graph", "node"], "left_semi").select("graph", F.col("other").alias("node"))
    return members.select("graph", "node").union(near).distinct()


def without_islands(edges: DataFrame, least: int = 8) -> DataFrame:
    """Edges of connected parts with at least ``least`` nodes."""
    parts = connected_components(edges)
    large = parts.groupBy("graph", "component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    kept = parts.join(large, ["graph", "component"], "left_semi").select("graph", "node")
    return E.induced(edges, kept)


def clean_parts(edges: DataFrame, members: DataFrame, least: int = 8) -> DataFrame:
    """(graph, node) left of the cut ``members``: gaps are filled, loose ends trimmed, small islands dropped."""
    filled = gap_fill(edges, members)
    whole = without_islands(dangle_trim(E.induced(edges, filled)), least)
    return E.both_ways(whole).select("graph", "node").distinct()


def odd_part(edges: DataFrame, nodes: DataFrame, depth: int = 4, more_than: int = 4) -> DataFrame:
    """Pairs (graph, src, dst) of each graph that remain when nodes that are neither in loops nor near an edge that
    isn't canonical go and loose ends are trimmed; of graphs that keep more than so many nodes."""
    from lattisca.operators.predicates import odd_or_loop_nodes

    trimmed = dangle_trim(E.induced(edges, odd_or_loop_nodes(edges, nodes, depth)))
    sizes = E.both_ways(trimmed).select("graph", "node").distinct().groupBy("graph").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > more_than)
    return trimmed.join(sizes.select("graph"), "graph", "left_semi")
