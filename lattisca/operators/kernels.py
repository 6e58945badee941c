"""Ring kernels: how alike two residues are by the edges around them, ring by ring.

Rings are arrays: ``rings[k]`` holds the labels of the edges first met at hop k + 1. Pairs are scored in Arrow batches; a pair
is bounded by its rings, and no pair meets another.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattisca.operators.similarity import edit_distance, edit_distance_bound, hungarian

BACKBONE = ("B53", "B35")

# Distances between pair geometries (isostericity discrepancy index), rows and columns in the same order.
GEOMETRIES = "CHH TWH CWW THS CWS CSS CWH CHS TWS TSS TWW THH B53".split()
DISTANCES = """
8.9 12 14.7 14 13.7 12.7 15.1 14.7 16.2 16.6 16.2 14 19
12 2.6 10.6 9.7 14.3 15.6 11.2 15.2 13.8 15.4 11.9 11.4 19
14.7 10.6 4.1 8.2 9.2 13.1 14.5 16 12.4 11.3 11.1 15.5 19
14 9.7 8.2 2.1 7 12.7 12 12.1 10 11.9 13.1 15.8 19
13.7 14.3 9.2 7 3.5 7.4 14.9 12.3 10.9 10.8 14.6 17.7 19
12.7 15.6 13.1 12.7 7.4 1.3 15.8 12.9 13.8 12 17.1 19 19
15.1 11.2 14.5 12 14.9 15.8 3.2 8.8 8.4 11.5 10.6 10.8 19
14.7 15.2 16 12.1 12.3 12.9 8.8 2.4 7.9 11.2 14.7 14.9 19
16.2 13.8 12.4 10 10.9 13.8 8.4 7.9 3.4 6.4 9.6 13.4 19
16.6 15.4 11.3 11.9 10.8 12 11.5 11.2 6.4 2.2 9 14.4 19
16.2 11.9 11.1 13.1 14.6 17.1 10.6 14.7 9.6 9 3.8 9 19
14 11.4 15.5 15.8 17.7 19 10.8 14.9 13.4 14.4 9 4 19
19 19 19 19 19 19 19 19 19 19 19 19 0
"""
_TABLE = np.array([[float(v) for v in row.split()] for row in DISTANCES.strip().splitlines()])
_PLACE = {g: i for i, g in enumerate(GEOMETRIES)}


def _place(label: str) -> int:
    """A label's row: upper case, and with its last two letters swapped where only that geometry is listed."""
    up = label.upper()
    return _PLACE[up] if up in _PLACE else _PLACE[up[0] + up[2] + up[1]]


@lru_cache(maxsize=1024)
def isostericity(one: str, two: str) -> float:
    if one == two:
        return 1.0
    if one in BACKBONE or two in BACKBONE:
        return 0.2 if one in BACKBONE and two in BACKBONE else 0.0
    return math.exp(-_TABLE[_place(one), _place(two)] / 8)


def indel(label: str) -> float:
    """The cost of an edge that the other graph lacks."""
    return 1.0 if label in BACKBONE else 2.0 if label.upper() == "CWW" else 3.0


def normalised(score: float, length: float, kind: str | None) -> float:
    share = score / length
    if kind == "sqrt":
        return share ** (5 / math.sqrt(length))
    if kind == "log":
        return share ** (1 / (math.log(length) + 1))
    return share


class RingKernel:
    """``method``: R_1 (multiset Jaccard), R_iso (backbone counts, and the best matching of pairs by isostericity), hungarian
    (one matching over all rings, with the depths' difference) or R_graphlets (matching of graphlets by edit distance).
    ``idf`` weighs labels; what it doesn't name weighs nothing."""

    def __init__(self, method: str = "R_1", depth: int = 2, decay: float = 0.5, idf: dict[str, float] | None = None, normalization: str | None = None):
        if method not in ("R_1", "R_iso", "hungarian", "R_graphlets"):
            raise ValueError(f"no method is called {method}")
        if not 0 < decay < 1:
            raise ValueError("decay must lie between 0 and 1")
        self.method, self.depth, self.decay, self.idf, self.normalization = method, depth, decay, idf, normalization

    def weight(self, label: str) -> float:
        return 1.0 if self.idf is None else self.idf.get(label, 0.0)

    def length(self, one: list[str], two: list[str]) -> float:
        longer = max(len(one), len(two))
        if self.idf is None:
            return float(longer)
        return max(sum(map(self.weight, one)), sum(map(self.weight, two))) or 1.0

    def r_1(self, one: list[str], two: list[str]) -> float:
        a, b = Counter(one), Counter(two)
        most = sum(self.weight(k) * max(a[k], b[k]) for k in a.keys() | b.keys())
        return 1.0 if not most else sum(self.weight(k) * min(a[k], b[k]) for k in a.keys() & b.keys()) / most

    def _cost(self, one: str, two: str) -> float:
        return isostericity(one, two) * math.sqrt(self.weight(one) * self.weight(two))

    def _matched(self, one: list[str], two: list[str], depths: tuple[list[int], list[int]] | None = None) -> float:
        if not one or not two:
            return float(not one and not two)
        gain = np.array([[self._cost(a, b) for b in two] for a in one])
        if depths is not None:
            gain = (gain + np.exp(-np.abs(np.subtract.outer(depths[0], depths[1])))) / 2
        return normalised(-hungarian(-gain)[1], self.length(one, two), self.normalization)

    def r_iso(self, one: list[str], two: list[str]) -> float:
        def share(label: str) -> float:
            a, b = one.count(label), two.count(label)
            return 1.0 if a == b == 0 else (min(a, b) / max(a, b)) ** 1.5

        pairs = [[x for x in ring if x not in BACKBONE] for ring in (one, two)]
        return (self._matched(*pairs) + (share("B53") + share("B35")) / 2) / 2

    def r_graphlets(self, one: list, two: list) -> float:
        """Rings of graphlets, each a list of (source, target, label)."""
        if not one or not two:
            return float(not one and not two)
        sub = lambda a, b: 1 - isostericity(a, b)

        def alike(a: list, b: list) -> float:
            d = edit_distance({tuple(e) for e in a}, {tuple(e) for e in b}, sub, indel)
            if d is None:  # too large for the distance itself; no more alike than by its bound
                d = edit_distance_bound({tuple(e) for e in a}, {tuple(e) for e in b}, sub, indel)
            return math.exp(-0.5 * d)

        gain = np.array([[alike(a, b) for b in two] for a in one])
        return normalised(-hungarian(-gain)[1], float(max(len(one), len(two))), self.normalization)

    def compare(self, one: list[list], two: list[list]) -> float:
        """Of two residues' rings, the sum of decay^k times ring k's score, as a share of the most that it can be."""
        k = min(self.depth, max(len(one), len(two)))
        pad = lambda rings: [list(rings[i]) if i < len(rings) and rings[i] is not None else [] for i in range(k)]
        one, two = pad(one), pad(two)
        if self.method == "hungarian":
            flat = []
            for rings in (one, two):
                labels = [(x, i) for i, ring in enumerate(rings) for x in ring]
                flat.append(([x for x in labels if x[0] in BACKBONE], [x for x in labels if x[0] not in BACKBONE]))
            (bb1, nc1), (bb2, nc2) = flat
            names, depths = (lambda s: [x for x, _ in s]), (lambda s: [i for _, i in s])
            return (self._matched(names(bb1), names(bb2)) + self._matched(names(nc1), names(nc2), (depths(nc1), depths(nc2)))) / 2
        score = {"R_1": self.r_1, "R_iso": self.r_iso, "R_graphlets": self.r_graphlets}[self.method]
        norm = (1 - self.decay ** (k + 1)) / (1 - self.decay) - 1
        return sum(self.decay ** (i + 1) * score(a, b) for i, (a, b) in enumerate(zip(one, two, strict=True))) / norm if k else 1.0


def ring_similarity(pairs: DataFrame, one: str, two: str, kernel: RingKernel) -> DataFrame:
    """Adds ``similarity`` of the ring arrays in columns ``one`` and ``two``."""

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([kernel.compare(list(x), list(y)) for x, y in zip(a, b, strict=True)])

    return pairs.withColumn("similarity", score(one, two))


def ring_arrays(rings: DataFrame, depth: int) -> DataFrame:
    """(graph, root, rings): the labels of each hop in order, as an array of arrays."""
    packed = rings.groupBy("graph", "root").agg(*[F.array_sort(F.collect_list(F.when(F.col("hop") == k + 1, F.col("label")))).alias(f"r{k}") for k in range(depth)])
    return packed.select("graph", "root", F.array(*[f"r{k}" for k in range(depth)]).alias("rings"))


def memoised_edit_distance(pairs: DataFrame, one: str, two: str, graphlets: DataFrame, beta: float = 0.5) -> DataFrame:
    """Adds ``ged`` and ``similarity`` to pairs of graphlet hashes. Each unordered pair of distinct hashes is computed once;
    ``graphlets`` is (hash, edges), edges an array of (src, dst, label)."""
    low, high = F.least(one, two), F.greatest(one, two)
    each = pairs.select(low.alias("_low"), high.alias("_high")).distinct()
    met = each.join(graphlets.select(F.col("hash").alias("_low"), F.col("edges").alias("_a")), "_low").join(graphlets.select(F.col("hash").alias("_high"), F.col("edges").alias("_b")), "_high")

    @F.pandas_udf("double")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        sub = lambda x, y: 1 - isostericity(x, y)
        as_set = lambda edges: {(e["src"], e["dst"], e["label"]) for e in edges}
        return pd.Series([edit_distance(as_set(x), as_set(y), sub, indel) for x, y in zip(a, b, strict=True)], dtype=float)

    table = met.select("_low", "_high", distance("_a", "_b").alias("ged"))
    out = pairs.withColumn("_low", low).withColumn("_high", high).join(table, ["_low", "_high"], "left").drop("_low", "_high")
    return out.withColumn("similarity", F.exp(-beta * F.col("ged")))


def distance(one: str, two: str) -> float:
    """The published distance of two pair geometries."""
    return float(_TABLE[_place(one), _place(two)])


def label_table(labels: list[str]) -> list[tuple[str, str, float]]:
    """(one, two, similarity) of all pairs of the labels, by the published distances."""
    return [(a, b, isostericity(a, b)) for a in labels for b in labels]


def square_matrices(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """(graph, names, matrix): each graph's similarities as a square, rows and columns by name, ones on the diagonal and zeros
    where a pair is missing. ``pairs`` is (graph, a, b, similarity), ``roots`` (graph, root)."""
    both = pairs.select("graph", F.explode(F.array(F.struct("a", "b", "similarity"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))).alias("e")).select("graph", "e.*")
    rows = both.groupBy("graph", F.col("a").alias("root")).agg(F.map_from_entries(F.collect_list(F.struct("b", "similarity"))).alias("m"))
    packed = roots.select("graph", "root").distinct().join(rows, ["graph", "root"], "left").groupBy("graph").agg(F.array_sort(F.collect_list("root")).alias("names"), F.map_from_entries(F.collect_list(F.struct("root", F.coalesce("m", F.map_from_arrays(F.array("root"), F.array(F.lit(1.0))))))).alias("m"))
    cell = lambda x, y: F.when(x == y, F.lit(1.0)).otherwise(F.coalesce(F.try_element_at(F.try_element_at("m", x), y), F.lit(0.0)))
    return packed.select("graph", "names", F.transform("names", lambda x: F.transform("names", lambda y: cell(x, y))).alias("matrix"))


def kernel_matrix(rings: DataFrame, kernel: RingKernel, most: int | None = None, seed: int = 0) -> DataFrame:
    """(graph, a, b, similarity), a < b, of each graph's residues; ``most`` keeps so many of a graph, by hash, where asked for."""
    from pyspark.sql.window import Window

    chosen = rings
    if most is not None:
        order = Window.partitionBy("graph").orderBy(F.xxhash64("graph", "root", F.lit(seed)))
        chosen = rings.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")
    a = chosen.select("graph", F.col("root").alias("a"), F.col("rings").alias("ra"))
    b = chosen.select("graph", F.col("root").alias("b"), F.col("rings").alias("rb"))
    return ring_similarity(a.join(b, "graph").where("a < b"), "ra", "rb", kernel).select("graph", "a", "b", "similarity")


def block_similarity(one: Column, two: Column) -> Column:
    """R_1 of two sorted label arrays as a column expression, for plans without Python."""
    kinds = F.array_union(one, two)
    count = lambda a, x: F.size(F.filter(a, lambda y: y == x))
    least = F.aggregate(kinds, F.lit(0), lambda s, x: s + F.least(count(one, x), count(two, x)))
    most = F.aggregate(kinds, F.lit(0), lambda s, x: s + F.greatest(count(one, x), count(two, x)))
    return F.when(most == 0, 1.0).otherwise(least / most)
