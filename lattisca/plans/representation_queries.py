"""Representations, batches, coordinates, tasks and evaluations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattisca.catalog import query
from lattisca.functions import geometry as G
from lattisca.functions.encoders import BoolEncoder, FeaturesComputer, FloatEncoder, OneHotEncoder
from lattisca.model import GraphCollection
from lattisca.operators import metrics as K
from lattisca.operators import represent as R
from lattisca.operators import sequence as Q
from lattisca.plans.analysis_queries import RUNS
from lattisca.plans.feature_queries import INDEX, PREDS, _preds
from lattisca.plans.structure_queries import _u
from lattisca.representations import GraphRepresentation, Represented, SequenceRepresentation
from lattisca.sources import adapters as A
from lattisca.sources.adapters import table

# --- sequences

LONGEST = f"""{RUNS}, b AS (SELECT graph, chain, run, row_number() OVER (PARTITION BY graph, chain ORDER BY n DESC, run DESC) AS best, dense_rank() OVER (PARTITION BY graph ORDER BY chain) - 1 AS ci FROM s),
q AS (SELECT r.graph, r.chain, r.pos, r.letter, b.ci FROM r JOIN b ON b.graph = r.graph AND b.chain = r.chain AND b.run = r.run WHERE best = 1)"""


def _letter():  # noqa: ANN202
    return F.upper(F.substring("chain", 1, 1))


@query(f"{LONGEST} SELECT graph, string_agg(letter, '' ORDER BY chain, pos) AS seq, string_agg(CAST(ci AS VARCHAR), ',' ORDER BY chain, pos) AS chains, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY chain, pos) AS places FROM q GROUP BY graph")
def sequence_rows(spark: SparkSession, d: str) -> DataFrame:
    nodes = A.event_nodes(spark, d).withColumn("node", F.col("pos"))
    rows = R.sequence_rows(nodes, _letter())
    join = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return rows.select("graph", "seq", join("chain_index").alias("chains"), join("node_names").alias("places"))


@query(f"""{LONGEST}, k AS (SELECT graph, ci, CAST(row_number() OVER (PARTITION BY graph ORDER BY chain, pos) - 1 AS INTEGER) AS i FROM q)
SELECT a.graph, a.i, b.i AS j FROM k a JOIN k b ON b.graph = a.graph AND b.i = a.i + 1 AND b.ci = a.ci UNION ALL SELECT a.graph, b.i, a.i FROM k a JOIN k b ON b.graph = a.graph AND b.i = a.i + 1 AND b.ci = a.ci""")
def sequence_edges(spark: SparkSession, d: str) -> DataFrame:
    nodes = A.event_nodes(spark, d).withColumn("node", F.col("pos"))
    return R.sequence_edges(R.sequence_rows(nodes, _letter()), "both")


# --- representations of a collection, and batches of them


def _collection(spark: SparkSession, d: str) -> GraphCollection:
    return GraphCollection.of(A.conv_nodes(spark, d).withColumn("chain", F.lit("A")), A.conv_edges(spark, d))


@query(f"""{INDEX}, a AS (SELECT graph, count(*) AS nodes, sum(size) AS total FROM i GROUP BY graph), b AS (SELECT graph, count(*) AS edges FROM x WHERE code IN (0, 9, 19) GROUP BY graph),
c AS (SELECT graph, string_agg(CASE code WHEN 'user' THEN 'U' WHEN 'assistant' THEN 'A' ELSE 'N' END, '' ORDER BY node) AS seq FROM n GROUP BY graph)
SELECT a.graph, a.nodes, CAST(total AS DOUBLE) AS total, coalesce(edges, 0) AS edges, seq FROM a LEFT JOIN b ON b.graph = a.graph JOIN c ON c.graph = a.graph""")
def represented(spark: SparkSession, d: str) -> DataFrame:
    """Canonical graphs and sequences of conversations side by side; the sequence replaces one that was added before."""
    c = _collection(spark, d)
    c = GraphCollection(c.graphs, c.nodes.withColumn("nt_code", F.upper(F.substring("code", 1, 1))), c.edges)
    some = Represented(c, FeaturesComputer(features=["size"], custom={"size": FloatEncoder()}))
    some.add_representation(GraphRepresentation(canonical=True), SequenceRepresentation("5p3p"), SequenceRepresentation("both"))
    some.remove_representation("voxel")
    rows = some.rows().toDF("name", "g", "s")  # one column for each representation, in order
    size = lambda x: F.greatest(F.coalesce(F.size(x), F.lit(0)), F.lit(0)).cast("long")
    total = F.aggregate("g.x", F.lit(0.0), lambda t, v: t + v[0].cast("double"))
    return rows.select(F.col("name").alias("graph"), size("g.x").alias("nodes"), total.alias("total"), size("g.edge_index").alias("edges"), F.col("s.seq").alias("seq"))


@query(f"""{INDEX}, g AS (SELECT graph, count(*) AS n FROM i GROUP BY graph), r AS (SELECT graph, n, row_number() OVER (ORDER BY graph) - 1 AS place FROM g),
o AS (SELECT *, place // 16 AS batch, coalesce(sum(n) OVER (PARTITION BY place // 16 ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, place % 16 AS slot FROM r),
k AS (SELECT batch, count(*) AS edges, sum((x.i + start) * 1000 + x.j + start) AS places, sum(code) AS codes FROM x JOIN o ON o.graph = x.graph GROUP BY batch),
b AS (SELECT batch, count(*) AS graphs, sum(n) AS nodes, sum(n * slot) AS slots, string_agg(CAST(CAST(start AS BIGINT) AS VARCHAR), ',' ORDER BY place) AS starts FROM o GROUP BY batch)
SELECT b.batch, b.graphs, CAST(nodes AS BIGINT) AS nodes, CAST(slots AS BIGINT) AS slots, starts, CAST(coalesce(edges, 0) AS BIGINT) AS edges, CAST(coalesce(places, 0) AS BIGINT) AS places, CAST(coalesce(codes, 0) AS BIGINT) AS codes FROM b LEFT JOIN k ON k.batch = b.batch""")
def collated(spark: SparkSession, d: str) -> DataFrame:
    """Batches of sixteen conversations as one graph each, with nodes numbered through."""
    t = R.collated(R.graph_tensors(A.conv_nodes(spark, d), A.conv_edges(spark, d), "size"), 16)
    size = lambda c: F.size(c).cast("long")
    total = lambda c, f: F.aggregate(c, F.lit(0).cast("long"), lambda s, v: s + f(v))
    return t.select("batch", size("graphs").alias("graphs"), size("x").alias("nodes"), total("graph_of", lambda v: v).alias("slots"), F.array_join(F.col("starts").cast("array<string>"), ",").alias("starts"),
                    size("edge_index").alias("edges"), total("edge_index", lambda v: v[0] * 1000 + v[1]).alias("places"), total("edge_attr", lambda v: v.cast("long")).alias("codes"))


# --- features of graphs and of the collection


@query("""SELECT conv_id AS graph, CAST(s.slot AS INTEGER) AS slot, CASE s.slot WHEN 0 THEN CASE WHEN n > 4 THEN 1.0 ELSE 0.0 END WHEN 1 THEN CASE WHEN first = 'user' THEN 1.0 ELSE 0.0 END WHEN 2 THEN CASE WHEN first = 'system' THEN 1.0 ELSE 0.0 END ELSE CAST(n AS DOUBLE) END::DOUBLE AS v
FROM (SELECT conv_id, count(*) AS n, arg_min(role, turn) AS first FROM conversations GROUP BY conv_id), (SELECT unnest([0, 1, 2, 3]) AS slot) s""")
def encode_graphs(spark: SparkSession, d: str) -> DataFrame:
    """Features of whole graphs: a flag, the first speaker and a number, one behind the other."""
    g = A.conv_nodes(spark, d).groupBy("graph").agg(F.count(F.lit(1)).alias("n"), F.min_by("code", "node").alias("first")).withColumn("long", F.col("n") > 4)
    f = FeaturesComputer(custom={"long": BoolEncoder(), "first": OneHotEncoder({"user": 0, "system": 1}), "n": FloatEncoder()})
    for name in ("long", "first", "n", "nothing"):
        f.add_feature(name, FloatEncoder() if name == "nothing" else None)
    f.remove_feature("nothing")
    return f.compute(g).select("graph", F.posexplode("features").alias("slot", "v")).withColumn("v", F.col("v").cast("double"))


# --- coordinates

ATOMS = f"SELECT vec_id // {A.MOLECULE} AS graph, vec_id AS node, " + ", ".join(f"CAST(embedding[{3 * k + i + 1}] AS DOUBLE) AS {a}{c}" for k, a in enumerate("pcn") for i, c in enumerate("xyz")) + " FROM embeddings"


def _atoms(spark: SparkSession, d: str) -> DataFrame:
    """Three atoms to a vector, from its first nine places."""
    at = [F.col("embedding")[3 * k + i].cast("double").alias(f"{a}{c}") for k, a in enumerate("pcn") for i, c in enumerate("xyz")]
    return table(spark, d, "embeddings").select(F.expr(f"vec_id div {A.MOLECULE}").alias("graph"), F.col("vec_id").alias("node"), *at)


def _vec(a: str, b: str) -> list[str]:
    return [f"({a}{c} - {b}{c})" for c in "xyz"]


def _dot(a: list[str], b: list[str]) -> str:
    return "(" + " + ".join(f"{x} * {y}" for x, y in zip(a, b, strict=True)) + ")"


def _unit(v: list[str]) -> list[str]:
    return [f"({x} / sqrt({_dot(v, v)} + 0.001))" for x in v]


def _length(a: str, b: str) -> str:
    return f"sqrt({_dot(_vec(a, b), _vec(a, b))} + 0.001)"


def _bend(a: str, b: str, c: str) -> str:
    return f"pi() - acos(greatest(-1.0, least(1.0, {_dot(_unit(_vec(a, b)), _unit(_vec(c, b)))})))"


def _cross(a: list[str], b: list[str]) -> list[str]:
    return [f"({a[1]} * {b[2]} - {a[2]} * {b[1]})", f"({a[2]} * {b[0]} - {a[0]} * {b[2]})", f"({a[0]} * {b[1]} - {a[1]} * {b[0]})"]


def _turn(a: str, b: str, c: str, e: str) -> str:
    ij, jk, kl = _unit(_vec(a, b)), _unit(_vec(b, c)), _unit(_vec(c, e))
    one, two = _unit(_cross(ij, jk)), _unit(_cross(jk, kl))
    return f"sign({_dot(ij, two)}) * acos(greatest(-1.0, least(1.0, {_dot(one, two)})))"


AROUND = f"""WITH a AS ({ATOMS}), w AS (SELECT *, {', '.join(f'lag(c{c}) OVER o AS l{c}, lead(p{c}) OVER o AS q{c}, lead(c{c}) OVER o AS m{c}' for c in 'xyz')} FROM a WINDOW o AS (PARTITION BY graph ORDER BY node))"""
INTERNAL = {
    "length": [_length("p", "c"), _length("c", "q"), _length("c", "n")],
    "angle": [_bend("l", "p", "c"), _bend("p", "c", "q"), _bend("p", "c", "n")],
    "dihedral": [_turn("l", "p", "c", "q"), _turn("p", "c", "q", "m"), _turn("q", "n", "c", "p")],
}


@query(f"{AROUND} SELECT node, " + ", ".join(f"round(coalesce({e}, 0.0), 4) + 0.0 AS {name}{i}" for name, some in INTERNAL.items() for i, e in enumerate(some)) + ", CAST(px IS NOT NULL AND lx IS NOT NULL AND qx IS NOT NULL AS BOOLEAN) AS whole FROM w")
def internal_coordinates(spark: SparkSession, d: str) -> DataFrame:
    c = G.internal_coordinates(_atoms(spark, d), ["graph"], "node")
    values = [(F.round(F.col(f"{name}s")[i], 4) + 0.0).alias(f"{name}{i}") for name in INTERNAL for i in range(3)]
    return c.select("node", *values, F.col("dihedrals_mask")[0].alias("whole"))


def _internal(name: str, v: list[str]) -> str:
    return ", ".join(f"round({x}, 5) + 0.0 AS {name}{c}" for x, c in zip(_unit(v), "xyz", strict=True))


@query(f"WITH a AS ({ATOMS}) SELECT node, {_internal('u', _vec('p', 'c'))}, {_internal('v', _vec('n', 'c'))} FROM a")
def internal_vectors(spark: SparkSession, d: str) -> DataFrame:
    u, v = G.internal_vectors(G.vector("p"), G.vector("c"), G.vector("n"))
    return _atoms(spark, d).select("node", *[(F.round(x, 5) + 0.0).alias(f"{k}{c}") for k, s in (("u", u), ("v", v)) for x, c in zip(s, "xyz", strict=True)])


BEAD = {"A": ("c", "n"), "B": ("p", "p")}


@query(f"""WITH a AS ({ATOMS}), r AS (SELECT *, CASE node % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'c' WHEN 2 THEN 'g' ELSE 'U' END AS code FROM a)
SELECT node, round(CASE WHEN code IN ('A', 'g') THEN nx WHEN node % 7 = 0 THEN 0.00001 ELSE cx END, 6) AS second, round(px, 6) AS first, code IN ('A', 'g') OR node % 7 <> 0 AS whole FROM r""")
def backbone_beads(spark: SparkSession, d: str) -> DataFrame:
    """A bead at P and one at N of purines or C of the others; every seventh residue lacks its C."""
    at = lambda a: F.array(*[F.col(f"{a}{c}") for c in "xyz"])
    code = F.element_at(F.array(*[F.lit(x) for x in "AcgU"]), (F.col("node") % 4 + 1).cast("int"))
    r = _atoms(spark, d).select("node", code.alias("code"), at("p").alias("xyz_P"), F.when(F.col("node") % 7 != 0, at("c")).alias("xyz_C"), at("n").alias("xyz_N"))
    beads, whole = G.backbone_beads(F.col("code"), ["P", "N"], ["P", "C"])
    return r.select("node", F.round(beads[1][0], 6).alias("second"), F.round(beads[0][0], 6).alias("first"), whole.alias("whole"))


# --- evaluation


@query(f"""WITH p AS {PREDS}, g AS (SELECT doc_id, label, {_u('doc_id', 11)} AS p FROM p) SELECT doc_id, label, round(p, 9) AS prob, CAST(p >= 0.5 AS INTEGER) AS pred FROM g""")
def dummy_binary(spark: SparkSession, d: str) -> DataFrame:
    rows = K.dummy_predictions(_preds(spark, d).select("doc_id", "label"), F.col("doc_id"), 1, 11)
    return rows.select("doc_id", "label", F.round(F.col("probs")[0], 9).alias("prob"), "pred")


THREE = ", ".join(f"{_u('doc_id', 20 + k)} AS u{k}" for k in range(3))


@query(f"""WITH p AS {PREDS}, g AS (SELECT doc_id, label, {THREE} FROM p) SELECT doc_id, round(exp(greatest(u0, u1, u2)) / (exp(u0) + exp(u1) + exp(u2)), 9) AS top,
CAST(CASE WHEN u0 >= u1 AND u0 >= u2 THEN 0 WHEN u1 >= u2 THEN 1 ELSE 2 END AS INTEGER) AS pred FROM g""")
def dummy_classes(spark: SparkSession, d: str) -> DataFrame:
    rows = K.dummy_predictions(_preds(spark, d).select("doc_id"), F.col("doc_id"), 3, 20)
    return rows.select("doc_id", F.round(F.array_max("probs"), 9).alias("top"), "pred")


@query(f"""WITH p AS {PREDS}, g AS (SELECT source, label, CAST({_u('doc_id', 11)} >= 0.5 AS INTEGER) AS pred FROM p),
a AS (SELECT 'pooled' AS kind, avg(CAST(label = pred AS INTEGER)) AS accuracy FROM g), m AS (SELECT source FROM g GROUP BY source HAVING count(DISTINCT label) > 1),
b AS (SELECT 'mean' AS kind, avg(x) AS accuracy FROM (SELECT avg(CAST(label = pred AS INTEGER)) AS x FROM g WHERE source IN (SELECT source FROM m) GROUP BY source))
SELECT kind, round(accuracy, 6) AS accuracy FROM a UNION ALL SELECT kind, round(accuracy, 6) FROM b""")
def dummy_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy of guesses, pooled and as the mean over sources with both labels."""
    from lattisca.tasks import evaluate

    guessed = K.dummy_predictions(_preds(spark, d).select("doc_id", "source", "label"), F.col("doc_id"), 1, 11).withColumnRenamed("source", "graph")
    pooled, each = evaluate(guessed)
    of = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.round("accuracy", 6).alias("accuracy"))
    return of(pooled, "pooled").union(of(each, "mean"))


# --- tasks: conversations as structures, turns as residues

TURNS = f"SELECT *, CASE code WHEN 'user' THEN 'A' WHEN 'assistant' THEN 'C' ELSE 'G' END AS nt_code, size > 60 AS long FROM ({A.CONV_NODES})"


def _structures(spark: SparkSession, d: str) -> GraphCollection:
    code = F.when(F.col("code") == "user", "A").when(F.col("code") == "assistant", "C").otherwise("G")
    nodes = A.conv_nodes(spark, d).withColumn("chain", F.lit("A")).withColumn("nt_code", code).withColumn("is_modified", F.col("size") > 60)
    return GraphCollection.of(nodes, A.conv_edges(spark, d))


@query(f"""WITH n AS ({TURNS}), k AS (SELECT graph FROM n GROUP BY graph HAVING count(*) > 2 AND count(*) < 8 AND bool_or(long)), m AS (SELECT graph, min(node) AS part FROM n GROUP BY graph),
u AS (SELECT graph, graph || '_' || part AS name FROM m WHERE graph IN (SELECT graph FROM k)), s AS (SELECT name, graph, {_u('name', 0)} AS u FROM u)
SELECT s.name AS graph, n.node, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.85 THEN 'val' ELSE 'test' END AS split, CASE nt_code WHEN 'A' THEN 0 WHEN 'C' THEN 2 ELSE 3 END AS code, CAST(long AS INTEGER) AS target FROM s JOIN n ON n.graph = s.graph""")
def task_rows(spark: SparkSession, d: str) -> DataFrame:
    """The recipe of a residue task: connected parts within size limits that hold a long turn, features, targets, split."""
    from lattisca.tasks import Task, by_components, sized, with_residues

    f = FeaturesComputer(features=["nt_code"], targets=["is_modified"])
    t = Task("turns", _structures(spark, d), [by_components, with_residues(F.col("is_modified")), sized(2, 8)], f)
    return t.rows().select("graph", "node", "split", (F.array_position("features", F.lit(1.0).cast("float")) - 1).cast("int").alias("code"), F.col("targets")[0].cast("int").alias("target"))


GROUPS = [(g, "A", s) for g, s in ((1, "train"), (2, "train"), (4, "val"), (8, "test"), (-5, "test"))]
LISTED = "(VALUES " + ", ".join(f"({g}, '{c}', '{s}')" for g, c, s in GROUPS) + ") AS l(graph, chain, split)"


@query(f"""WITH n AS ({TURNS}), k AS (SELECT graph FROM n GROUP BY graph HAVING count(*) > 2 AND count(*) < 8)
SELECT n.graph || '_A' AS graph, n.node, l.split, CASE nt_code WHEN 'A' THEN 0 WHEN 'C' THEN 2 ELSE 3 END AS target FROM n JOIN {LISTED} ON l.graph = n.graph WHERE n.graph IN (SELECT graph FROM k)""")
def folding_benchmark(spark: SparkSession, d: str) -> DataFrame:
    """Published chain groups with their split; the letter is the target."""
    from lattisca.tasks import benchmark_folding

    groups = spark.createDataFrame(GROUPS, "graph long, chains string, split string")
    _, rows = benchmark_folding(_structures(spark, d), groups, (2, 8))
    return rows.select("graph", "node", "split", (F.array_position("targets", F.lit(1.0).cast("float")) - 1).cast("int").alias("target"))


@query(f"""WITH n AS ({TURNS}) SELECT n.graph, n.node, l.split, CAST(size % 3 = 0 OR size % 5 = 0 AS INTEGER) AS target FROM n JOIN {LISTED} ON l.graph = n.graph""")
def binding_benchmark(spark: SparkSession, d: str) -> DataFrame:
    """Published chains; a turn is a site if a ligand or an ion is near."""
    from lattisca.tasks import benchmark_binding

    c = _structures(spark, d)
    near = lambda k, name: F.when(F.col("size") % k == 0, name)
    c = GraphCollection(c.graphs, c.nodes.withColumn("ligand_6", near(3, "LIG")).withColumn("ion_6", near(5, "MG")), c.edges)
    _, rows = benchmark_binding(c, spark.createDataFrame(GROUPS, "graph long, chain string, split string"))
    return rows.select("graph", "node", "split", F.col("targets")[0].cast("int").alias("target"))


@query(f"""WITH n AS ({TURNS}), t AS (SELECT CAST(long AS INTEGER) AS value FROM n) SELECT CAST(0 AS INTEGER) AS slot, CAST(value AS DOUBLE) AS value, count(*) AS n FROM t GROUP BY value""")
def class_counts(spark: SparkSession, d: str) -> DataFrame:
    from lattisca.tasks import Task

    t = Task("turns", _structures(spark, d), [], FeaturesComputer(features=["nt_code"], targets=["is_modified"]))
    return t.class_counts(t.rows()).withColumn("value", F.col("value").cast("double"))


@query(f"WITH n AS ({A.CONV_NODES}) SELECT graph, node, 1 AS dummy FROM n")
def dummy_annotation(spark: SparkSession, d: str) -> DataFrame:
    from lattisca.transforms import DummyAnnotator

    return DummyAnnotator()(_collection(spark, d)).nodes.select("graph", "node", "dummy")


@query("SELECT p_partkey AS graph, lower(p_brand) AS name FROM part")
def structure_names(spark: SparkSession, d: str) -> DataFrame:
    from lattisca.transforms import PDBIDNameTransform

    graphs = table(spark, d, "part").select(F.col("p_partkey").alias("graph"), F.col("p_brand").alias("pdbid"))
    empty = spark.createDataFrame([], "graph long, node long, src long, dst long, label string")
    return PDBIDNameTransform()(GraphCollection(graphs, empty.select("graph", "node"), empty.select("graph", "src", "dst", "label"))).graphs.select("graph", "name")


@query(f"WITH n AS ({A.EVENT_NODES}), f AS (SELECT graph, arg_min(chain, node) AS chain FROM n GROUP BY graph) SELECT graph, graph || '_' || chain AS name FROM f")
def chain_names(spark: SparkSession, d: str) -> DataFrame:
    from lattisca.transforms import ChainNameTransform

    nodes = A.event_nodes(spark, d).select("graph", "node", "chain")
    c = GraphCollection.of(nodes, spark.createDataFrame([], "graph long, src long, dst long, label string"))
    return ChainNameTransform()(c).graphs.select("graph", "name")


@query("SELECT p_partkey, CASE WHEN upper(p_brand)[1] IN ('A', 'C', 'G', 'U') THEN upper(p_brand)[1] ELSE 'N' END AS letter FROM part")
def standard_letters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", Q.standard_letter(F.substring("p_brand", 1, 1)).alias("letter"))
