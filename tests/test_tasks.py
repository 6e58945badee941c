"""Task recipes on small collections."""

from pyspark.sql import functions as F

from lattisca import tasks
from lattisca.model import GraphCollection


def chain(spark, graphs, n=20):
    rows = [(g, f"{g}.A.{i:03d}", "A", i, "ACGU"[(i * i + len(g)) % 4], i % 7 == 0, float(i % 3), i == 3) for g in graphs for i in range(n)]
    nodes = spark.createDataFrame(rows, "graph string, node string, chain string, pos int, nt_code string, is_modified boolean, protein_content double, binding_site boolean")
    edges = spark.createDataFrame([(g, f"{g}.A.{i:03d}", f"{g}.A.{i + 1:03d}", "B35") for g in graphs for i in range(n - 1)], "graph string, src string, dst string, label string")
    return GraphCollection.of(nodes, edges)


def test_residue_recipes_drop_copies(spark):
    c = chain(spark, ["a", "b"]).annotate(spark.createDataFrame([("a", 2.0), ("b", 1.0)], "graph string, resolution double"), "graphs")
    for name in ("rna_cm", "rna_site", "rna_if"):
        rows = tasks.get_task(name, c).rows()
        assert {r.graph.split("_")[0] for r in rows.select("graph").collect()} == {"b"}, name
    fixed = tasks.fixed_split(tasks.Task("t", c), ["a"], [], ["b"])
    assert {(r.graph, r.split) for r in fixed.collect()} == {("a", "train"), ("b", "test")}


def test_terms_ligands_and_screens(spark):
    c = chain(spark, [f"g{i}" for i in range(6)])
    slices = spark.createDataFrame([(f"g{i}", "A", 2, 12, f"F{i % 3}") for i in range(6)], "graph string, chain string, first int, last int, family string")
    terms = spark.createDataFrame([("F0", "t1"), ("F1", "t2"), ("F2", "t1"), ("F2", "t3"), ("F0", "t9"), ("F2", "t9")], "family string, term string")
    rows = tasks.family_terms(c, slices, terms, 1, 5).rows().collect()
    assert {r.graph: r.targets for r in rows}["g0"] == [1.0, 0.0, 0.0] and len(rows) == 6  # t9 goes with t1
    pockets = c.nodes.where("pos between 2 and 6 and graph < 'g3'").select("graph", F.lit(0).alias("part"), "node", F.when(F.col("graph") == "g2", "ZZZ").otherwise("PAR").alias("ligand"))
    task = tasks.ligand_identity(c, pockets, ["PAR", "LLL"], (3, 10))
    assert {(r.graph, tuple(r.targets)) for r in task.rows().collect()} == {("g0_0", (1.0, 0.0)), ("g1_0", (1.0, 0.0))}
    scores = spark.createDataFrame([("p", float(i), int(i > 5)) for i in range(12)] + [("q", 1.0, 1)], "pocket string, score double, label int")
    assert tuple(tasks.virtual_screen(scores).first()) == (1.0, 1)
