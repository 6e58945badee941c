"""Edge and node rewrites. All work on frames with ``graph``, ``src``, ``dst``, ``label`` and keep other columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The edge labels by code, and those of canonical edges.
LABELS = ("B53", "cHH", "cHS", "cHW", "cSH", "cSS", "cSW", "cWH", "cWS", "cWW", "tHH", "tHS", "tHW", "tSH", "tSS", "tSW", "tWH", "tWS", "tWW", "B35")
BACKBONE = ("B53", "B35")
CANONICAL = ("B53", "B35", "cWW")


def is_canonical(label: Column) -> Column:
    return F.upper(label).isin(*[c.upper() for c in CANONICAL])


def simple_graph(edges: DataFrame, order: list[str]) -> DataFrame:
    """One edge for each (graph, src, dst): a backbone edge if there is one, else the last in ``order``."""
    last = Window.partitionBy("graph", "src", "dst").orderBy(F.col("label").isin(*BACKBONE).desc(), *[F.col(c).desc() for c in order], F.col("label").desc())
    return edges.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def canonical_edges(edges: DataFrame) -> DataFrame:
    return edges.where(is_canonical(F.col("label")))


def known_edges(edges: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    return edges.where(F.col("label").isin(*labels))


def no_self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst")


def symmetric_label(label: Column) -> Column:
    """Backbone labels are one; a pair's label does not tell its ends apart."""
    ends = F.array_join(F.array_sort(F.split(F.substring(label, 2, 8), "")), "")
    return F.when(label.isin(*BACKBONE), F.lit("B53")).otherwise(F.concat(F.substring(label, 1, 1), ends))


def flipped(label: Column) -> Column:
    """The label of the edge the other way round."""
    return F.when(label == "B53", "B35").when(label == "B35", "B53").otherwise(F.concat(F.substring(label, 1, 1), F.substring(label, 3, 1), F.substring(label, 2, 1)))


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("graph", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), symmetric_label(F.col("label")).alias("label")).distinct()


def legacy_graph(nodes: DataFrame, edges: DataFrame, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """Graphs as older tools want them: edges with known labels once and undirected, nodes with some attributes alone."""
    known = known_edges(edges).select("graph", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.when(F.col("label") == "B35", "B53").otherwise(F.col("label")).alias("label"))
    first = known.groupBy("graph", "src", "dst").agg(F.min("label").alias("label"))
    return nodes.select("graph", "node", *keep), first


def both_ways(edges: DataFrame) -> DataFrame:
    """(graph, node, other) for either end of each edge, in one pass."""
    ends = F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other")))
    return edges.select("graph", F.explode(ends).alias("e")).select("graph", "e.*")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes`` (graph, node)."""
    keep = nodes.select("graph", "node").distinct()
    one = edges.join(keep.withColumnRenamed("node", "src"), ["graph", "src"], "left_semi")
    return one.join(keep.withColumnRenamed("node", "dst"), ["graph", "dst"], "left_semi").select(*edges.columns)


def incident_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Neighbours of the set, in either direction, that are outside of it."""
    keep = nodes.select("graph", "node").distinct()
    near = both_ways(edges).join(keep, ["graph", "node"], "left_semi").select("graph", F.col("other").alias("node")).distinct()
    return near.join(keep, ["graph", "node"], "left_anti")


def degrees(edges: DataFrame) -> DataFrame:
    """Edges at each node, out and in together."""
    return both_ways(edges).groupBy("graph", "node").agg(F.count(F.lit(1)).alias("degree"))


def without_floaters(edges: DataFrame) -> DataFrame:
    """Edges of which not both ends have degree one (undirected, so each pair counts once)."""
    pairs = edges.select("graph", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    alone = degrees(pairs).where("degree = 1").select("graph", "node")
    floating = pairs.join(alone.withColumnRenamed("node", "src"), ["graph", "src"], "left_semi").join(alone.withColumnRenamed("node", "dst"), ["graph", "dst"], "left_semi")
    return pairs.join(floating, ["graph", "src", "dst"], "left_anti").select("graph", "src", "dst")


def backbone_edges(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Edges both ways between residues whose positions follow each other: B53 from the higher to the lower."""
    before = F.lag("pos").over(Window.partitionBy(*keys).orderBy("pos"))
    pairs = nodes.select(*keys, "pos", before.alias("before")).where("pos - before = 1")
    both = F.array(
        F.struct(F.col("pos").alias("src"), F.col("before").alias("dst"), F.lit("B53").alias("label")), F.struct(F.col("before").alias("src"), F.col("pos").alias("dst"), F.lit("B35").alias("label"))
    )
    return pairs.select(*keys, F.explode(both).alias("e")).select(*keys, "e.*")


def has_noncanonical(edges: DataFrame) -> DataFrame:
    return edges.groupBy("graph").agg(F.bool_or(~is_canonical(F.col("label"))).alias("has_nc"))


def isostericity(one: Column, two: Column, distance: Column) -> Column:
    """1 for equal labels, 0.2 for the two directions of the backbone, 0 for backbone against a pair, else by distance."""
    bb1, bb2 = one.isin(*BACKBONE), two.isin(*BACKBONE)
    return F.when(one == two, 1.0).when(bb1 & bb2, 0.2).when(bb1 | bb2, 0.0).otherwise(F.exp(-distance / 8))


def encode_labels(edges: DataFrame) -> DataFrame:
    """Adds the label's code; unknown labels have none."""
    codes = F.create_map(*[x for i, label in enumerate(LABELS) for x in (F.lit(label), F.lit(i))])
    return edges.withColumn("code", F.try_element_at(codes, F.col("label")))
