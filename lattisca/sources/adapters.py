"""The relational tables seen as collections of graphs, each with the SQL that gives the same rows.

Node frames have ``graph``, ``node``, ``pos`` and attributes, edge frames ``graph``, ``src``, ``dst``, ``label``. A graph is the
bounded unit (a user's history, a conversation, an order, a molecule of consecutive vectors); the collection grows, a graph
does not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Consecutive vectors that make up one molecule.
MOLECULE = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


EVENT_NODES = """SELECT user_id AS graph, event_id AS node, event_type AS chain,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS pos,
  value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"""


def event_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events in order of time; the type is the chain."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("graph"),
        F.col("event_id").alias("node"),
        F.col("event_type").alias("chain"),
        F.row_number().over(order).cast("long").alias("pos"),
        "value",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


CONV_NODES = "SELECT conv_id AS graph, turn AS node, turn AS pos, role AS code, length(text) AS size FROM conversations"


def conv_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("graph"), F.col("turn").alias("node"), F.col("turn").alias("pos"), F.col("role").alias("code"), F.length("text").cast("long").alias("size")
    )


CONV_EDGES = """SELECT a.conv_id AS graph, b.turn AS src, a.turn AS dst, 'B53' AS label FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
UNION ALL SELECT a.conv_id, a.turn, b.turn, 'B35' FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
UNION ALL SELECT a.conv_id, a.turn, b.turn, CASE a.role WHEN 'user' THEN 'cWW' WHEN 'assistant' THEN 'tHS' ELSE 'cSW' END
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 2 AND a.role = b.role
UNION ALL SELECT a.conv_id, b.turn, a.turn, CASE a.role WHEN 'user' THEN 'cWW' WHEN 'assistant' THEN 'tSH' ELSE 'cWS' END
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 2 AND a.role = b.role"""


def conv_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backbone between following turns (B53 from the later to the earlier one), pairs between a speaker's turns two apart."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    after = t.select("conv_id", (F.col("turn") - 1).alias("turn"))
    follow = t.join(after, ["conv_id", "turn"]).select(F.col("conv_id").alias("graph"), F.col("turn").alias("a"), (F.col("turn") + 1).alias("b"))
    again = t.join(t.select("conv_id", (F.col("turn") - 2).alias("turn"), "role"), ["conv_id", "turn", "role"])
    again = again.select(F.col("conv_id").alias("graph"), F.col("turn").alias("a"), (F.col("turn") + 2).alias("b"), "role")
    there = F.when(F.col("role") == "user", "cWW").when(F.col("role") == "assistant", "tHS").otherwise("cSW")
    back = F.when(F.col("role") == "user", "cWW").when(F.col("role") == "assistant", "tSH").otherwise("cWS")

    def ends(df: DataFrame, pairs: list[tuple[str, str, object]]) -> DataFrame:
        """Every direction in one pass over the joined pairs."""
        return df.select("graph", F.explode(F.array(*[F.struct(F.col(s).alias("src"), F.col(d).alias("dst"), label.alias("label")) for s, d, label in pairs])).alias("e")).select("graph", "e.*")

    return ends(follow, [("b", "a", F.lit("B53")), ("a", "b", F.lit("B35"))]).union(ends(again, [("a", "b", there), ("b", "a", back)]))


ORDER_NODES = "SELECT l_orderkey AS graph, l_partkey AS node, min(l_linenumber) AS pos, max(l_quantity) AS quantity, bool_or(l_returnflag = 'R') AS returned FROM lineitem GROUP BY l_orderkey, l_partkey"


def order_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("graph"), F.col("l_partkey").alias("node"))
        .agg(F.min("l_linenumber").alias("pos"), F.max("l_quantity").alias("quantity"), F.bool_or(F.col("l_returnflag") == "R").alias("returned"))
    )


ORDER_EDGES = """SELECT l_orderkey AS graph, l_partkey AS src, l_suppkey AS dst,
  CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'cWW' WHEN 'NO' THEN 'B53' WHEN 'RF' THEN 'tHS' WHEN 'NF' THEN 'B35' ELSE 'cSW' END AS label,
  l_shipdate AS shipped, l_linenumber AS ord FROM lineitem"""


def order_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A multigraph: each line of an order joins its part and its supplier; the line's state is the label."""
    state = F.concat("l_returnflag", "l_linestatus")
    label = F.when(state == "AF", "cWW").when(state == "NO", "B53").when(state == "RF", "tHS").when(state == "NF", "B35").otherwise("cSW")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("graph"), F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), label.alias("label"), F.col("l_shipdate").alias("shipped"), F.col("l_linenumber").alias("ord")
    )


POINTS = f"""SELECT vec_id // {MOLECULE} AS graph, vec_id AS node, label AS kind, CAST(embedding[1] AS DOUBLE) AS x,
  CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as points in their first three dimensions, in molecules of ``MOLECULE`` that follow each other."""
    at = [F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")]
    return table(spark, sf_dir, "embeddings").select(F.expr(f"vec_id div {MOLECULE}").alias("graph"), F.col("vec_id").alias("node"), F.col("label").alias("kind"), *at)


HAIRPIN_NODES = """SELECT user_id AS graph, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS pos,
  count(*) OVER (PARTITION BY user_id) AS n, event_type AS chain, value FROM events"""
#: Whether the residue ``pos`` of a hairpin of ``n`` has a canonical partner, and whether it has any.
WATSON = "((pos + graph) % 4 <> 0 AND n + 1 - 2 * pos > 2)"
PAIRED = "(((pos + graph) % 4 <> 0 OR graph % 3 = 0) AND n + 1 - 2 * pos > 2)"
HAIRPIN_EDGES = f"""SELECT graph, pos AS src, pos - 1 AS dst, 'B53' AS label FROM ({HAIRPIN_NODES}) WHERE pos > 1
UNION ALL SELECT graph, pos - 1, pos, 'B35' FROM ({HAIRPIN_NODES}) WHERE pos > 1
UNION ALL SELECT graph, pos, n + 1 - pos, CASE WHEN {WATSON} THEN 'cWW' ELSE 'tHS' END FROM ({HAIRPIN_NODES}) WHERE {PAIRED}
UNION ALL SELECT graph, n + 1 - pos, pos, CASE WHEN {WATSON} THEN 'cWW' ELSE 'tSH' END FROM ({HAIRPIN_NODES}) WHERE {PAIRED}"""


def hairpin_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events folded into a hairpin: the first lies across the last, the second across the last but one. A residue is
    named by its place."""
    n = F.count(F.lit(1)).over(Window.partitionBy("graph"))
    nodes = event_nodes(spark, sf_dir).withColumn("n", n)
    return nodes.select("graph", F.col("pos").alias("node"), "pos", "n", "chain", "value")


def hairpin_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backbone between neighbours; of four pairs across three are canonical, and the fourth, in every third graph, is not."""
    nodes = hairpin_nodes(spark, sf_dir)
    across = F.col("n") + 1 - F.col("pos")
    canonical = (F.col("pos") + F.col("graph")) % 4 != 0
    pair = (across - F.col("pos") > 2) & (canonical | (F.col("graph") % 3 == 0))
    end = lambda s, d, label: F.struct(s.alias("src"), d.alias("dst"), label.alias("label"))
    before, at = F.col("pos") - 1, F.col("pos")
    follow = F.when(at > 1, F.array(end(at, before, F.lit("B53")), end(before, at, F.lit("B35"))))
    pairs = F.when(pair, F.array(end(at, across, F.when(canonical, "cWW").otherwise("tHS")), end(across, at, F.when(canonical, "cWW").otherwise("tSH"))))
    none = F.array().cast("array<struct<src:bigint,dst:bigint,label:string>>")
    return nodes.select("graph", F.explode(F.concat(F.coalesce(follow, none), F.coalesce(pairs, none))).alias("e")).select("graph", "e.*")
