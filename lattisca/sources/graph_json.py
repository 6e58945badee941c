"""Graphs as node-link JSON, one document a graph: reading and writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from lattisca.model import GraphCollection
from lattisca.operators import edges as E
from lattisca.shared import ranked

#: The links' key has two names, by the age of the file.
LINK_KEYS = ("links", "edges")


def schema(node_fields: list[StructField] | None = None, edge_fields: list[StructField] | None = None) -> StructType:
    """A fixed schema spares the pass that infers one: of a node its id and ``node_fields``, of a link its ends, label and
    ``edge_fields``."""
    node = StructType([StructField("id", StringType()), *(node_fields or [])])
    link = StructType([StructField("source", StringType()), StructField("target", StringType()), StructField("LW", StringType()), *(edge_fields or [])])
    graph = StructType([StructField("name", StringType()), StructField("pdbid", StringType())])
    return StructType([StructField("graph", graph), StructField("nodes", ArrayType(node)), *[StructField(k, ArrayType(link)) for k in LINK_KEYS]])


def read_graphs(spark: SparkSession, path: str, node_fields: list[StructField] | None = None, multi_line: bool = True, multigraph: bool = False) -> GraphCollection:
    """A file, or with ``multi_line`` false a line, for each graph. Of several edges between two residues the backbone or the
    last in the file stays, unless ``multigraph`` keeps all. Chain and position come from ids ``name.chain.position``;
    a graph without a name is named after its file."""
    raw = spark.read.schema(schema(node_fields)).option("multiLine", multi_line).json(path)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.json)?$", 1)
    named = raw.select(F.coalesce("graph.name", stem).alias("name"), F.element_at(F.split(F.col("graph.pdbid"), ","), 1).alias("pdbid"), "nodes", F.coalesce(*LINK_KEYS).alias("links"))
    graphs = named.select(F.col("name").alias("graph"), "pdbid")
    nodes = named.select(F.col("name").alias("graph"), F.inline("nodes")).withColumnRenamed("id", "node")
    nodes = nodes.withColumn("chain", F.split_part("node", F.lit("."), F.lit(2))).withColumn("pos", F.split_part("node", F.lit("."), F.lit(3)).try_cast(LongType()))
    placed = named.select(F.col("name").alias("graph"), F.posexplode("links").alias("ord", "e")).select("graph", "ord", "e.*")
    edges = placed.withColumnsRenamed({"source": "src", "target": "dst", "LW": "label"})
    return GraphCollection(graphs, nodes, (edges if multigraph else E.simple_graph(edges, ["ord"])).drop("ord"))


def to_json(collection: GraphCollection) -> DataFrame:
    """(graph, value): each graph as one line of JSON, nodes and links in order."""
    c = collection
    attributes = [x for x in c.nodes.columns if x not in ("graph", "node", "chain", "pos")]
    nodes = c.nodes.groupBy("graph").agg(F.array_sort(F.collect_list(F.struct(F.col("node").cast("string").alias("id"), *attributes))).alias("nodes"))
    links = c.edges.groupBy("graph").agg(F.array_sort(F.collect_list(F.struct(F.col("src").cast("string").alias("source"), F.col("dst").cast("string").alias("target"), F.col("label").alias("LW")))).alias("links"))
    whole = c.graphs.select("graph").join(nodes, "graph", "left").join(links, "graph", "left")
    doc = F.struct(F.struct(F.col("graph").cast("string").alias("name")).alias("graph"), F.coalesce("nodes", F.array()).alias("nodes"), F.coalesce("links", F.array()).alias("links"))
    return whole.select("graph", F.to_json(doc).alias("value"))


def write_graphs(collection: GraphCollection, path: str, mode: str = "errorifexists") -> None:
    to_json(collection).select("value").write.mode(mode).text(path)


#: Files of a folder of graphs that are none.
SPECIAL = ("distances", "metadata", "index")


def list_graphs(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """(idx, graph) of the graph files of a folder: all in order, or those of ``names`` that are there, in the order asked for."""
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path).select(stem.alias("graph")).where(~F.col("graph").isin(*SPECIAL)).distinct()
    if names is None:
        return ranked(found, ["graph"], "idx").select("idx", "graph")
    wanted = spark.createDataFrame([(i, n) for i, n in enumerate(dict.fromkeys(names))], "wish long, graph string")
    return ranked(found.join(F.broadcast(wanted), "graph"), ["wish"], "idx").select("idx", "graph")  # as many as were asked for
