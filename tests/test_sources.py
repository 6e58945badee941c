"""Sources, sinks, tasks and streams on small inputs."""

import json

from pyspark.sql import functions as F

from lattisca import tasks
from lattisca.model import GraphCollection
from lattisca.sources import graph_json, structures
from lattisca.streaming import incremental

CIF = """data_1ABC
_entry.id 1ABC
_refine.ls_d_res_high   2.00
#
loop_
_chem_comp.id
_chem_comp.type
_chem_comp.name
_chem_comp.formula
_chem_comp.formula_weight
A 'RNA linking' "ADENOSINE-5'-MONOPHOSPHATE" 'C10 H14 N5 O7 P' 347.221
HOH non-polymer WATER 'H2 O' 18.015
#
loop_
_atom_site.group_PDB
_atom_site.auth_asym_id
_atom_site.auth_seq_id
_atom_site.pdbx_PDB_ins_code
_atom_site.auth_comp_id
_atom_site.auth_atom_id
_atom_site.type_symbol
_atom_site.pdbx_PDB_model_num
_atom_site.Cartn_x
_atom_site.Cartn_y
_atom_site.Cartn_z
ATOM A 1 ? A P P 1 1.0 2.0 3.0
ATOM A 1 ? A "C4'" C 1 2.0 3.0 4.0
ATOM A 2 ? U "C4'" C 1 4.0 4.0 4.0
ATOM A 2 ? U "C5'" C 1 6.0 6.0 6.0
ATOM A 5 ? G P P 1 9.0 9.0 9.0
ATOM B 1 ? ALA CA C 1 0.0 0.0 0.0
HETATM A 100 ? HOH O O 1 7.0 7.0 7.0
#
"""


def test_atoms_components_and_graph(spark, tmp_path):
    (tmp_path / "1abc.cif").write_text(CIF)
    atoms = structures.read_atoms(spark, str(tmp_path))
    assert atoms.count() == 7
    assert [tuple(r) for r in structures.rna_chains(atoms).collect()] == [("1abc", "A")]
    g = structures.structure_graphs(atoms, spark.createDataFrame([("1abc", "1abc.A.1", "1abc.A.5", "tSH"), ("1abc", "1abc.A.1", "1abc.A.99", "cWW")], "graph string, src string, dst string, label string"))
    nodes = {r.node: (r.nt_code, r.x) for r in g.nodes.collect()}
    assert nodes == {"1abc.A.1": ("A", 1.0), "1abc.A.2": ("U", 5.0), "1abc.A.5": ("G", 9.0)}
    assert {(r.src[-1], r.dst[-1], r.label) for r in g.edges.collect()} == {("2", "1", "B53"), ("1", "2", "B35"), ("1", "5", "tSH"), ("5", "1", "tHS")}
    parts = structures.read_components(spark, str(tmp_path)).collect()
    assert {(r.id, r.weight) for r in parts} == {("A", 347.221), ("HOH", 18.015)} and parts[0].name == "ADENOSINE-5'-MONOPHOSPHATE"


def small(spark):
    nodes = spark.createDataFrame([(g, f"{g}.A.{i}", "A", i, c) for g, s in (("g1", "ACGUA"), ("g2", "GG")) for i, c in enumerate(s)], "graph string, node string, chain string, pos int, nt_code string")
    edges = spark.createDataFrame([("g1", "g1.A.0", "g1.A.1", "B35"), ("g1", "g1.A.3", "g1.A.4", "cWW"), ("g2", "g2.A.0", "g2.A.1", "B35")], "graph string, src string, dst string, label string")
    return GraphCollection.of(nodes, edges)


def test_json_round_trip(spark, tmp_path):
    from pyspark.sql.types import StringType, StructField

    c = small(spark)
    graph_json.write_graphs(c, f"{tmp_path}/out")
    back = graph_json.read_graphs(spark, f"{tmp_path}/out", [StructField("nt_code", StringType())], multi_line=False)
    assert {tuple(r) for r in back.nodes.select("graph", "node", "nt_code", "chain", "pos").collect()} == {tuple(r) for r in c.nodes.select("graph", "node", "nt_code", "chain", "pos").collect()}
    assert {tuple(r) for r in back.edges.select("graph", "src", "dst", "label").collect()} == {tuple(r) for r in c.edges.collect()}
    doc = {"graph": {"pdbid": "1xyz"}, "nodes": [{"id": "1xyz.A.3"}], "edges": [{"source": "1xyz.A.3", "target": "1xyz.A.3", "LW": "cWW"}]}
    (tmp_path / "1xyz.json").write_text(json.dumps(doc, indent=1))
    one = graph_json.read_graphs(spark, f"{tmp_path}/1xyz.json")
    assert one.graphs.first().graph == "1xyz" and one.edges.first().label == "cWW"


def test_collection_operations(spark, tmp_path):
    c = small(spark)
    c.with_distances("seq", spark.createDataFrame([("g1", "g2", 0.5)], "i string, j string, distance double")).save(f"{tmp_path}/c")
    back = GraphCollection.load(spark, f"{tmp_path}/c")
    assert back.nodes.count() == 7 and back.distances.count() == 1
    assert back.where("graph = 'g1'").distances.count() == 0
    assert back.keep_nodes(c.nodes.where("pos < 2")).edges.count() == 2
    assert [r.graph for r in back.subset(["g2", "none", "g1"]).graphs.orderBy("idx").collect()] == ["g2", "g1"]
    split = tasks.by_components(c)
    assert sorted(r["count"] for r in split.nodes.groupBy("graph").count().collect()) == [1, 2, 2, 2]


def test_task_is_written_and_identified(spark, tmp_path):
    c = small(spark)
    t = tasks.Task("t", c, [tasks.sized(0, 10)], tasks.FeaturesComputer(features=["nt_code"], targets=["nt_code"]))
    meta = t.write(f"{tmp_path}/t")
    rows, again = tasks.Task.load(spark, f"{tmp_path}/t")
    assert meta == again and rows.count() == 7 and meta["num_node_features"] == 4 and meta["dataset_size"] == 2
    assert t.fingerprint(t.rows()) == meta["fingerprint"]
    pooled, mean = tasks.evaluate(rows.select("graph", (F.col("pos") % 2).alias("label"), F.lit(0).alias("pred")))
    assert 0 < pooled.first().accuracy < 1 and mean.first().accuracy is not None


def test_text_sources(spark, tmp_path):
    (tmp_path / "nr.csv").write_text('"NR_1","1ABC|1|A+1ABC|1|B","x"\n"NR_2","2DEF|1|C","2DEF|1|C"\n')
    assert {r.pdbid: r.chains for r in structures.read_representatives(spark, f"{tmp_path}/nr.csv").collect()} == {"1abc": ["A", "B"], "2def": ["C"]}
    (tmp_path / "ids.txt").write_text("3B58_1_B-C-A\n\n")
    assert {(r.pdbid, r.chains, r.chain) for r in structures.read_split_ids(spark, f"{tmp_path}/ids.txt").collect()} == {("3b58", "B-C-A", x) for x in "ABC"}
    (tmp_path / "go.txt").write_text("!x\nRfam:RF00001 5S_rRNA > GO:structural constituent of ribosome ; GO:0003735\n")
    assert [tuple(r) for r in structures.read_family_terms(spark, f"{tmp_path}/go.txt").collect()] == [("RF00001", "0003735")]


def test_stream_gives_what_a_batch_gives(spark, tmp_path):
    src = f"{tmp_path}/in"
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).repartition(3).write.parquet(src)
    stream = incremental.counts_by_window(incremental.read_events(spark, src), "6 hours", "3650 days")
    q = stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.start, r.event_type): r.n for r in spark.table("counts").collect()}
    want = {(r.start, r.event_type): r.n for r in incremental.counts_by_window(spark.read.parquet(src), "6 hours").collect()}
    assert got == want and got
