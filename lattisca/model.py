"""A collection of graphs as frames that share the column ``graph``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattisca.operators import edges as E
from lattisca.shared import ranked


@dataclass(frozen=True)
class GraphHandle:
    """One graph of a collection, by name, path or value: give one of them."""

    collection: GraphCollection

    @classmethod
    def get(cls, spark: SparkSession, *, name: str | None = None, among: GraphCollection | None = None, path: str | None = None, value: dict | None = None) -> GraphHandle:
        if sum(x is not None for x in (name, path, value)) != 1:
            raise ValueError("give one of name, path and value")
        if name is not None:
            if among is None:
                raise ValueError("a name is looked up among a collection")
            return cls(among.item(name))
        if path is not None:
            from lattisca.sources.graph_json import read_graphs

            return cls(read_graphs(spark, path))
        nodes = spark.createDataFrame([(value["name"], n) for n in value["nodes"]], "graph string, node string")
        edges = spark.createDataFrame([(value["name"], *e) for e in value["edges"]], "graph string, src string, dst string, label string")
        return cls(GraphCollection.of(nodes, edges))

    def save(self, path: str) -> None:
        from lattisca.sources.graph_json import write_graphs

        write_graphs(self.collection, path)

    def to_dict(self) -> dict:
        """Name, nodes and edges, in order; a graph is bounded."""
        c = self.collection
        return {
            "name": c.graphs.first()["graph"],
            "nodes": sorted(r.node for r in c.nodes.select("node").collect()),
            "edges": sorted((r.src, r.dst, r.label) for r in c.edges.select("src", "dst", "label").collect()),
        }


@dataclass(frozen=True)
class GraphCollection:
    """``graphs`` (graph, attributes), ``nodes`` (graph, node, ...), ``edges`` (graph, src, dst, label, ...) and, if there are
    any, ``distances`` (metric, i, j, distance), i < j by graph. Operations give new collections and run nothing, but for ``indexed``."""

    graphs: DataFrame
    nodes: DataFrame
    edges: DataFrame
    distances: DataFrame | None = None

    @classmethod
    def of(cls, nodes: DataFrame, edges: DataFrame) -> GraphCollection:
        return cls(nodes.select("graph").distinct(), nodes, edges)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> GraphCollection:
        read = {name: spark.read.parquet(f"{path}/{name}") for name in ("graphs", "nodes", "edges")}
        meta = spark.read.text(f"{path}/parts").first()
        return cls(**read, distances=spark.read.parquet(f"{path}/distances") if meta and "distances" in meta[0] else None)

    def save(self, path: str, mode: str = "errorifexists") -> None:
        self.graphs.write.mode(mode).parquet(f"{path}/graphs")
        self.nodes.write.mode(mode).parquet(f"{path}/nodes")
        self.edges.write.mode(mode).parquet(f"{path}/edges")
        if self.distances is not None:
            self.distances.write.mode(mode).partitionBy("metric").parquet(f"{path}/distances")
        parts = "distances" if self.distances is not None else "none"
        self.graphs.sparkSession.createDataFrame([(parts,)], "value string").write.mode(mode).text(f"{path}/parts")

    def keep(self, passing: DataFrame) -> GraphCollection:
        """The graphs among ``passing`` (graph), with their nodes, edges and distances."""
        ids = passing.select("graph").distinct()
        semi = lambda df: df.join(ids, "graph", "left_semi")
        d = self.distances
        if d is not None:
            for end in ("i", "j"):
                d = d.join(ids.withColumnRenamed("graph", end), end, "left_semi")
        return GraphCollection(semi(self.graphs), semi(self.nodes), semi(self.edges), d)

    def keep_nodes(self, nodes: DataFrame) -> GraphCollection:
        """The subgraphs that ``nodes`` (graph, node) induce; graphs left without a node are gone."""
        kept = self.nodes.join(nodes.select("graph", "node").distinct(), ["graph", "node"], "left_semi")
        out = replace(self, nodes=kept, edges=E.induced(self.edges, kept))
        return out.keep(kept)

    def where(self, condition: str) -> GraphCollection:
        return self.keep(self.graphs.where(condition))

    def annotate(self, values: DataFrame, level: str = "nodes") -> GraphCollection:
        """Adds the columns of ``values`` to nodes (by graph, node) or graphs (by graph); what isn't named there gets null."""
        if level == "graphs":
            return replace(self, graphs=self.graphs.join(values, "graph", "left"))
        return replace(self, nodes=self.nodes.join(values, ["graph", "node"], "left"))

    def partition(self, parts: DataFrame) -> GraphCollection:
        """Graphs become their parts: ``parts`` has (graph, node, part); the new name is ``graph_part``."""
        name = F.concat_ws("_", F.col("graph").cast("string"), F.col("part").cast("string"))
        of = parts.select("graph", "node", "part").distinct()
        nodes = self.nodes.join(of, ["graph", "node"])
        edges = self.edges.join(of.select("graph", F.col("node").alias("src"), "part"), ["graph", "src"])
        edges = edges.join(of.select("graph", F.col("node").alias("dst"), "part"), ["graph", "dst", "part"])
        graphs = self.graphs.join(of.select("graph", "part").distinct(), "graph").withColumn("parent", F.col("graph"))
        rename = lambda df: df.withColumn("graph", name).drop("part")
        return GraphCollection(rename(graphs), rename(nodes), rename(edges))

    def subset(self, names: list[str]) -> GraphCollection:
        """The named graphs, those that exist, with ``idx`` in the order of the list."""
        spark = self.graphs.sparkSession
        wanted = spark.createDataFrame([(i, n) for i, n in enumerate(dict.fromkeys(names))], "wish long, graph string")
        chosen = self.graphs.withColumn("graph", F.col("graph").cast(self.graphs.schema["graph"].dataType)).join(wanted.withColumn("graph", F.col("graph").cast(self.graphs.schema["graph"].dataType)), "graph")
        idx = F.row_number().over(Window.orderBy("wish")) - 1  # as many rows as the list has names
        return replace(self.keep(chosen), graphs=chosen.withColumn("idx", idx.cast("long")).drop("wish"))

    def item(self, name) -> GraphCollection:  # noqa: ANN001
        """The graph of a name."""
        return self.keep(self.graphs.where(F.col("graph") == F.lit(name)))

    def indexed(self) -> GraphCollection:
        """With ``idx``: the graphs' places by name, from 0."""
        return replace(self, graphs=ranked(self.graphs, ["graph"], "idx"))

    def head(self, n: int = 50) -> GraphCollection:
        """The first graphs by name, for trying things out."""
        first = self.graphs.select("graph").orderBy("graph").limit(n)
        return self.keep(first)

    def to_memory(self) -> GraphCollection:
        """Kept by the executors once it is computed; what doesn't fit goes to their disks."""
        d = self.distances
        return GraphCollection(self.graphs.persist(), self.nodes.persist(), self.edges.persist(), d if d is None else d.persist())

    def inconsistent(self) -> DataFrame:
        """(graph, what): graphs without nodes, and edges whose ends are none of their graph's nodes; none if all fits."""
        empty = self.graphs.select("graph").join(self.nodes.select("graph").distinct(), "graph", "left_anti").withColumn("what", F.lit("no nodes"))
        ends = E.both_ways(self.edges).select("graph", "node").distinct()
        lost = ends.join(self.nodes.select("graph", "node"), ["graph", "node"], "left_anti").select("graph").distinct().withColumn("what", F.lit("unknown ends"))
        return empty.union(lost)

    def transform(self, *steps: Callable[[GraphCollection], GraphCollection]) -> GraphCollection:
        out = self
        for step in steps:
            out = step(out)
        return out

    def with_distances(self, metric: str, pairs: DataFrame) -> GraphCollection:
        """Adds or replaces a metric's distances (i, j, distance)."""
        new = pairs.select(F.lit(metric).alias("metric"), "i", "j", "distance")
        old = None if self.distances is None else self.distances.where(F.col("metric") != metric)
        return replace(self, distances=new if old is None else old.unionByName(new))

    def without_distances(self, metric: str) -> GraphCollection:
        return replace(self, distances=None if self.distances is None else self.distances.where(F.col("metric") != metric))
