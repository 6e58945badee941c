"""Joins in space. Points meet only in neighbouring cells of a grid, within one molecule; nothing is compared across."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _cell(c: str, size: float) -> Column:
    return F.floor(F.col(c) / size).cast("long")


def _shifted(column: str, steps: Column) -> Column:
    return F.transform(steps, lambda s: (F.col(column) + s).cast("long"))


def radius_join(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """(graph, a, b, distance) of points of ``left`` and ``right`` (graph, node, x, y, z) no further apart than ``radius``.

    Cells are as wide as the radius; the right side is copied to the 27 cells around its own, so that the join is an equal
    join on the molecule and the cell, and the distance only filters.
    """
    cells = [_cell(c, radius).alias(f"c{c}") for c in "xyz"]
    one = left.select("graph", F.col("node").alias("a"), *[F.col(c).alias(f"a{c}") for c in "xyz"], *cells)
    around = F.sequence(F.lit(-1), F.lit(1))
    two = right.select("graph", F.col("node").alias("b"), *[F.col(c).alias(f"b{c}") for c in "xyz"], *cells)
    for c in "xyz":
        two = two.withColumn(f"c{c}", F.explode(_shifted(f"c{c}", around)))
    square = sum((F.col(f"a{c}") - F.col(f"b{c}")) * (F.col(f"a{c}") - F.col(f"b{c}")) for c in "xyz")
    met = one.join(two, ["graph", "cx", "cy", "cz"]).withColumn("d2", square).where(F.col("d2") <= radius * radius)
    return met.select("graph", "a", "b", F.sqrt("d2").alias("distance"))


def knn(points: DataFrame, k: int) -> DataFrame:
    """(graph, a, b): the ``k`` nearest points of each point of its molecule, ties by node. A molecule's points meet each
    other once, packed in one row, so the join is within a row of bounded size."""
    packed = points.groupBy("graph").agg(F.collect_list(F.struct("node", "x", "y", "z")).alias("ps"))

    def near(p: Column) -> Column:
        away = F.filter("ps", lambda q: q["node"] != p["node"])
        ranked = F.array_sort(F.transform(away, lambda q: F.struct(((q["x"] - p["x"]) * (q["x"] - p["x"]) + (q["y"] - p["y"]) * (q["y"] - p["y"]) + (q["z"] - p["z"]) * (q["z"] - p["z"])).alias("d"), q["node"].alias("b"))))
        return F.transform(F.slice(ranked, 1, k), lambda r: F.struct(p["node"].alias("a"), r["b"].alias("b")))

    return packed.select("graph", F.explode(F.flatten(F.transform("ps", near))).alias("e")).select("graph", "e.a", "e.b")


def undirected_knn(points: DataFrame, k: int) -> DataFrame:
    pairs = knn(points, k)
    return pairs.select("graph", F.explode(F.array(F.struct(F.col("a"), F.col("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("graph", "e.a", "e.b").distinct()


def voxels(points: DataFrame, spacing: float, padding: float, sigma: float) -> DataFrame:
    """(graph, ix, iy, iz, weight): a sparse grid over each molecule; a point adds exp(-d^2 / 2 sigma^2) to the cells up to
    int(4 sigma) steps from its own."""
    box = points.groupBy("graph").agg(*[F.min(c).alias(f"min{c}") for c in "xyz"], *[F.max(c).alias(f"max{c}") for c in "xyz"])
    at = points.join(box, "graph")
    reach = int(4 * sigma)
    steps = F.sequence(F.lit(-reach), F.lit(reach - 1))
    for c in "xyz":
        low = F.col(f"min{c}") - padding
        at = at.withColumn(f"n{c}", F.ceil((F.col(f"max{c}") + padding - low) / spacing).cast("long")).withColumn(f"low{c}", low)
        at = at.withColumn(f"i{c}", (F.floor((F.col(c) - low) / spacing) + 1).cast("long"))
    for c in "xyz":
        at = at.withColumn(f"i{c}", F.explode(_shifted(f"i{c}", steps))).where((F.col(f"i{c}") >= 0) & (F.col(f"i{c}") < F.col(f"n{c}")))
    square = sum(F.pow(F.col(c) - (F.col(f"low{c}") + F.col(f"i{c}") * spacing), 2) for c in "xyz")
    return at.groupBy("graph", "ix", "iy", "iz").agg(F.sum(F.exp(-square / (2 * sigma * sigma))).alias("weight"))


def neighbours_at(points: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the coordinates of the point before and after in order, as ``px`` and ``nx`` and so on."""
    order = Window.partitionBy(*keys).orderBy("node")
    for c in "xyz":
        points = points.withColumn(f"p{c}", F.lag(c).over(order)).withColumn(f"n{c}", F.lead(c).over(order))
    return points
