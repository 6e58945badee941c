"""Graphs as model-ready rows: one row a graph, with ordered arrays; and tables of single entries of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattisca.operators.edges import LABELS
from lattisca.operators.sequence import runs
from lattisca.shared import ranked


def node_index(nodes: DataFrame) -> DataFrame:
    """Adds ``index``: the rank of the node's id among its graph's, in lexicographic order, from 0."""
    order = Window.partitionBy("graph").orderBy(F.col("node").cast("string"))
    return nodes.withColumn("index", (F.row_number().over(order) - 1).cast("long"))


def edge_index(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph, i, j, code): edges by node indices and label codes; edges with unknown labels or ends are gone."""
    at = node_index(nodes).select("graph", "node", "index")
    codes = F.create_map(*[x for i, label in enumerate(LABELS) for x in (F.lit(label), F.lit(i))])
    met = edges.join(at.select("graph", F.col("node").alias("src"), F.col("index").alias("i")), ["graph", "src"])
    met = met.join(at.select("graph", F.col("node").alias("dst"), F.col("index").alias("j")), ["graph", "dst"])
    return met.withColumn("code", F.try_element_at(codes, F.col("label"))).where("code is not null").select("graph", "i", "j", "code")


def graph_tensors(nodes: DataFrame, edges: DataFrame, x: str = "features") -> DataFrame:
    """One row a graph: node ids and features by index, edges sorted, and their codes."""
    n = node_index(nodes).groupBy("graph").agg(F.array_sort(F.collect_list(F.struct("index", F.col("node").cast("string").alias("node"), F.col(x).alias("x")))).alias("n"))
    e = edge_index(nodes, edges).groupBy("graph").agg(F.array_sort(F.collect_list(F.struct("i", "j", "code"))).alias("e"))
    return n.join(e, "graph", "left").select("graph", F.col("n.node").alias("node_names"), F.col("n.x").alias("x"), F.transform("e", lambda v: F.array(v["i"], v["j"])).alias("edge_index"), F.col("e.code").alias("edge_attr"))


def point_cloud(nodes: DataFrame) -> DataFrame:
    """One row a graph: coordinates in the order of node ids, and the names."""
    packed = nodes.groupBy("graph").agg(F.array_sort(F.collect_list(F.struct(F.col("node").cast("string").alias("node"), "x", "y", "z"))).alias("p"))
    return packed.select("graph", F.transform("p", lambda v: F.array(v["x"], v["y"], v["z"])).alias("xyz"), F.col("p.node").alias("names"))


def neighbour_mean(nodes: DataFrame, edges: DataFrame, value: str) -> DataFrame:
    """(graph, node, label, mean): a relation's mean of the neighbours' values, as a graph layer takes it."""
    near = edges.join(nodes.select("graph", F.col("node").alias("dst"), F.col(value).alias("v")), ["graph", "dst"])
    return near.groupBy("graph", F.col("src").alias("node"), "label").agg(F.avg("v").alias("mean"))


def circular_layout(nodes: DataFrame) -> DataFrame:
    """Adds ``px`` and ``py``: nodes on a circle in order of their positions."""
    order = Window.partitionBy("graph").orderBy("pos")
    turn = 2 * 3.141592653589793 * (F.row_number().over(order) - 1) / F.count(F.lit(1)).over(Window.partitionBy("graph"))
    return nodes.withColumn("px", F.cos(turn)).withColumn("py", F.sin(turn))


def vector_features(points: DataFrame, keys: list[str], k: int, between: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Scalar and vector features of nodes and of edges, the nearest neighbours or ``between`` (graph, a, b), as vector networks
    take them.

    Nodes: dihedral and angle to the points around, as sine and cosine, logarithm of the step's length, and unit vectors
    forward and backward, zeros at a chain's ends. Edges: radial functions of the distance, positional encoding of the
    steps between, and the unit vector.
    """
    from lattisca.functions import geometry as G
    from lattisca.operators.spatial import knn, neighbours_at

    order = Window.partitionBy(*keys).orderBy("node")
    at = neighbours_at(points, keys).select("*", *[F.lead(c, 2).over(order).alias(f"m{c}") for c in "xyz"], F.row_number().over(order).alias("rank"))
    turn = G.dihedral(G.vector("p"), G.vector(), G.vector("n"), G.vector("m"))
    bend = G.angle(G.vector("p"), G.vector(), G.vector("n"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    unit = lambda p: F.array(*[zero(x) for x in G.unit(G.minus(G.vector(p), G.vector()))])
    nodes = at.select(
        "graph",
        "node",
        F.array(zero(F.sin(turn)), zero(F.cos(turn)), zero(F.sin(bend)), zero(F.cos(bend)), zero(F.log(G.length(G.vector(), G.vector("n")) + G.EPS))).alias("scalars"),
        F.array(unit("n"), unit("p")).alias("vectors"),
    )
    ends = at.select("graph", "node", "x", "y", "z", "rank")
    a = ends.select("graph", F.col("node").alias("a"), *[F.col(c).alias(f"a{c}") for c in "xyz"], F.col("rank").alias("ra"))
    b = ends.select("graph", F.col("node").alias("b"), *[F.col(c).alias(f"b{c}") for c in "xyz"], F.col("rank").alias("rb"))
    pairs = (knn(points, k) if between is None else between).join(a, ["graph", "a"]).join(b, ["graph", "b"])
    apart = G.length(G.vector("a"), G.vector("b"))
    edges = pairs.select("graph", "a", "b", F.array(*G.rbf(apart), *G.positional((F.col("rb") - F.col("ra")).cast("double"))).alias("scalars"), F.array(*G.unit(G.minus(G.vector("b"), G.vector("a")))).alias("vector"))
    return nodes, edges


def sequence_rows(nodes: DataFrame, letter: Column, tolerance: int = 2, x: str | None = None) -> DataFrame:
    """One row a graph: the longest run of each chain, chains in order, as ``seq``, ``node_names``, ``chain_index`` and, with
    ``x``, that column's values."""
    cut = runs(nodes, ["graph", "chain"], tolerance)
    sizes = cut.groupBy("graph", "chain", "run").agg(F.count(F.lit(1)).alias("_n"))
    best = sizes.groupBy("graph", "chain").agg(F.max_by("run", F.struct("_n", "run")).alias("run"))
    value = [F.col(x).alias("x")] if x else []
    held = cut.join(best, ["graph", "chain", "run"]).select("graph", F.struct("chain", "pos", F.col("node").alias("node"), letter.alias("letter"), *value).alias("s"))
    packed = held.groupBy("graph").agg(F.array_sort(F.collect_list("s")).alias("s"))
    names = F.array_distinct(F.transform("s", lambda v: v["chain"]))
    return packed.select(
        "graph",
        F.array_join(F.transform("s", lambda v: v["letter"]), "").alias("seq"),
        F.transform("s", lambda v: v["node"]).alias("node_names"),
        F.transform("s", lambda v: (F.array_position(names, v["chain"]) - 1).cast("long")).alias("chain_index"),
        *([F.transform("s", lambda v: v["x"]).alias("x")] if x else []),
    )


def sequence_edges(sequences: DataFrame, backbone: str = "both") -> DataFrame:
    """(graph, i, j): neighbours in a chain of ``sequence_rows``, in the direction 5p3p, 3p5p or both."""
    if backbone not in ("both", "5p3p", "3p5p"):
        raise ValueError("backbone is both, 5p3p or 3p5p")
    at = sequences.select("graph", F.posexplode("chain_index").alias("i", "chain"), F.col("chain_index").alias("_c"))
    follow = at.where(F.get("_c", F.col("i") + 1) == F.col("chain"))
    ends = {"5p3p": F.struct(F.col("i").alias("i"), (F.col("i") + 1).alias("j")), "3p5p": F.struct((F.col("i") + 1).alias("i"), F.col("i").alias("j"))}
    return follow.select("graph", F.explode(F.array(*[e for k, e in ends.items() if backbone in ("both", k)])).alias("e")).select("graph", "e.*")


def collated(tensors: DataFrame, size: int, order: str = "graph") -> DataFrame:
    """Rows of ``graph_tensors`` in batches of ``size`` graphs: (batch, graphs, x, edge_index, edge_attr, graph_of, starts), with
    nodes numbered through each batch. Batches follow ``order``; none is larger than its graphs."""
    numbered = ranked(tensors, [order], "_at").withColumn("batch", F.expr(f"_at div {int(size)}"))
    fields = [F.col(c) for c in ("_at", "graph", "x")] + [F.coalesce("edge_index", F.array().cast("array<array<bigint>>")).alias("e"), F.coalesce("edge_attr", F.array().cast("array<int>")).alias("a")]
    packed = numbered.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("s"))
    counts = F.transform("s", lambda v: F.size(v["x"]).cast("long"))
    # Where each graph's nodes begin: sums of the sizes before, folded once.
    starts = F.aggregate(counts, F.array(F.lit(0).cast("long")), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    at = packed.withColumn("starts", starts)
    shifted = F.flatten(F.transform("s", lambda v, i: F.transform(v["e"], lambda e: F.transform(e, lambda k: k + F.get("starts", i)))))
    return at.select(
        "batch",
        F.transform("s", lambda v: v["graph"]).alias("graphs"),
        F.flatten(F.transform("s", lambda v: v["x"])).alias("x"),
        shifted.alias("edge_index"),
        F.flatten(F.transform("s", lambda v: v["a"])).alias("edge_attr"),
        F.flatten(F.transform("s", lambda v, i: F.array_repeat(i.cast("long"), F.size(v["x"])))).alias("graph_of"),
        F.slice("starts", 1, F.size("s")).alias("starts"),
    )
