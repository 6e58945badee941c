"""Sinks and sources in a round trip, kernels and vector features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField

from lattisca.catalog import query
from lattisca.functions.encoders import FeaturesComputer
from lattisca.model import GraphCollection
from lattisca.operators import aggregate as G
from lattisca.operators import edges as E
from lattisca.operators import kernels as N
from lattisca.operators import pockets as O
from lattisca.operators import represent as R
from lattisca.operators import traverse as T
from lattisca.plans.structure_queries import _u
from lattisca.shared import shared_path
from lattisca.sources import adapters as A
from lattisca.sources import graph_json
from lattisca.sources import structures as Z
from lattisca.streaming.incremental import append_batches, counts_by_window, read_events, sessions
from lattisca.tasks import Task


@query(f"""WITH n AS ({A.CONV_NODES}), e AS ({A.CONV_EDGES}), c AS (SELECT graph, count(*) AS edges FROM e GROUP BY graph)
SELECT n.graph AS graph, count(*) AS nodes, CAST(coalesce(max(c.edges), 0) AS BIGINT) AS edges FROM n LEFT JOIN c ON c.graph = n.graph GROUP BY n.graph""")
def scan_json(spark: SparkSession, d: str) -> DataFrame:
    """Graphs written as JSON, a line each, and read again."""
    path = shared_path(spark, "graphs")
    graph_json.write_graphs(GraphCollection.of(A.conv_nodes(spark, d).select("graph", "node"), A.conv_edges(spark, d)), path)
    back = graph_json.read_graphs(spark, path, multi_line=False)
    nodes = back.nodes.groupBy("graph").agg(F.count(F.lit(1)).alias("nodes"))
    edges = back.edges.groupBy("graph").agg(F.count(F.lit(1)).alias("edges"))
    return nodes.join(edges, "graph", "left").select(F.col("graph").cast("long").alias("graph"), "nodes", F.coalesce("edges", F.lit(0)).cast("long").alias("edges"))


@query(f"""WITH p AS ({A.POINTS}), b AS (SELECT graph, CAST(floor(x / 0.1) AS BIGINT) AS cx, count(*) AS n, round(avg(y), 6) AS y FROM p GROUP BY 1, 2) SELECT graph, cx, n, y FROM b""")
def cell_counts(spark: SparkSession, d: str) -> DataFrame:
    p = A.points(spark, d)
    return p.groupBy("graph", F.floor(F.col("x") / 0.1).cast("long").alias("cx")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("y"), 6).alias("y"))


@query()
def ring_kernel(spark: SparkSession, d: str) -> DataFrame:
    """Isostericity kernel between the turns of each conversation."""
    nodes = A.conv_nodes(spark, d).select("graph", F.col("node").alias("root"))
    rings = T.rings(E.undirected(A.conv_edges(spark, d)), nodes, 2)
    return N.kernel_matrix(N.ring_arrays(rings, 2), N.RingKernel("R_iso", 2))


@query()
def vector_features(spark: SparkSession, d: str) -> DataFrame:
    return R.vector_features(A.points(spark, d), ["graph"], 8)[1]


# --- file formats: tables written in each and read again


def _written(rows: DataFrame, name: str) -> str:
    path = shared_path(rows.sparkSession, name)
    rows.write.text(path)
    return path


def _object(rows: DataFrame, key: str, value: str) -> DataFrame:
    """One JSON object of a table of keys and values, as these files have it."""
    return rows.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).cast("string"), F.col(value)))))).alias("value"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS ligand, replace(p_type, ' ', '') AS smiles FROM part")
def smiles_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = A.table(spark, d, "part").select(F.concat(F.col("p_partkey").cast("string"), F.lit("   "), F.regexp_replace("p_type", " ", ""), F.lit(" ")).alias("value"))
    return Z.read_smiles(spark, _written(lines, "smiles"))


@query("SELECT r_name AS kind, n_name AS comp, n_name[1] AS letter FROM nation JOIN region ON n_regionkey = r_regionkey")
def modifications_json(spark: SparkSession, d: str) -> DataFrame:
    n = A.table(spark, d, "nation").join(A.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    inner = n.groupBy("r_name").agg(F.map_from_entries(F.collect_list(F.struct("n_name", F.substring("n_name", 1, 1)))).alias("m"))
    whole = inner.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("r_name", "m")))).alias("value"))
    return Z.read_modifications(spark, _written(whole, "modifications"))


@query("SELECT CAST(conv_id AS VARCHAR) AS graph, turn % 2 AS part, CAST(turn AS VARCHAR) AS node FROM conversations")
def pockets_json(spark: SparkSession, d: str) -> DataFrame:
    """Odd and even turns as pockets, a file for some hundred graphs."""
    t = A.table(spark, d, "conversations")
    some = lambda k: F.collect_list(F.when(F.col("turn") % 2 == k, F.col("turn").cast("string")))
    lists = t.groupBy("conv_id").agg(F.array(some(0), some(1)).alias("l"))
    whole = lists.groupBy(F.expr("conv_id div 256").alias("_file")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("conv_id").cast("string"), "l")))).alias("value"))
    path = shared_path(spark, "pockets")
    whole.repartition("_file").write.partitionBy("_file").text(path)
    return Z.read_pockets(spark, f"{path}/*")


@query("SELECT n_name AS node, CAST(n_regionkey AS VARCHAR) AS ligand FROM nation")
def ligands_json(spark: SparkSession, d: str) -> DataFrame:
    n = A.table(spark, d, "nation").select("n_name", F.col("n_regionkey").cast("string").alias("r"))
    return Z.read_node_ligands(spark, _written(_object(n, "n_name", "r"), "ligands"))


@query("SELECT CAST(user_id AS VARCHAR) AS graph, 'event_type' AS key, event_type AS value, count(*) AS n FROM events GROUP BY user_id, event_type")
def index_json(spark: SparkSession, d: str) -> DataFrame:
    """The index of what each graph holds, a file for some hundred graphs, written and read."""
    e = A.table(spark, d, "events").select(F.col("user_id").alias("graph"), "event_type")
    found = G.graph_index(e, ["event_type"])
    inner = found.groupBy("graph").agg(F.map_from_entries(F.collect_list(F.struct("value", "n"))).alias("m")).withColumn("m", F.create_map(F.lit("event_type"), "m"))
    whole = inner.groupBy(F.expr("graph div 256").alias("_file")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("graph").cast("string"), "m")))).alias("value"))
    path = shared_path(spark, "index")
    whole.repartition("_file").write.partitionBy("_file").text(path)
    return Z.read_index(spark, f"{path}/*")


@query("""SELECT lower('S' || l_suppkey) AS pdbid, l_returnflag AS chain, CAST(l_linenumber AS BIGINT) AS first, CAST(l_linenumber + l_quantity AS BIGINT) AS last, 'RF' || lpad(CAST(l_partkey AS VARCHAR), 5, '0') AS family,
lower('S' || l_suppkey) || '_' || l_returnflag || '_' || CAST(l_linenumber AS BIGINT) || '_' || CAST(l_linenumber + l_quantity AS BIGINT) AS selection FROM lineitem""")
def family_slices(spark: SparkSession, d: str) -> DataFrame:
    t = A.table(spark, d, "lineitem")
    last = (F.col("l_linenumber") + F.col("l_quantity")).cast("long")
    rows = t.select(F.concat(F.lit("RF"), F.lpad(F.col("l_partkey").cast("string"), 5, "0")).alias("rfam_acc"), F.concat(F.lit("S"), "l_suppkey").alias("pdb_id"), F.col("l_returnflag").alias("chain"), F.col("l_linenumber").alias("pdb_start"), last.alias("pdb_end"))
    path = shared_path(spark, "families")
    rows.write.option("header", True).csv(path, sep="\t")
    return Z.read_family_slices(spark, path)


@query("SELECT 'RF' || lpad(CAST(p_partkey % 100000 AS VARCHAR), 5, '0') AS family, lpad(CAST(p_size AS VARCHAR), 7, '0') AS term FROM part")
def family_terms(spark: SparkSession, d: str) -> DataFrame:
    p = A.table(spark, d, "part")
    number = F.lpad((F.col("p_partkey") % 100_000).cast("string"), 5, "0")  # a family's number has five digits
    line = F.concat(F.lit("Rfam:RF"), number, F.lit(" name > GO:a word ; GO:"), F.lpad(F.col("p_size").cast("string"), 7, "0"))
    return Z.read_family_terms(spark, _written(p.select(line.alias("value")), "terms"))


@query("""WITH e AS (SELECT 's' || s_suppkey AS pdbid, CASE WHEN s_nationkey % 2 = 0 THEN 'A' ELSE 'B' END AS one FROM supplier) SELECT pdbid, one || ',C' AS chains FROM e""")
def representatives_csv(spark: SparkSession, d: str) -> DataFrame:
    s = A.table(spark, d, "supplier")
    entry = lambda chain: F.concat(F.lit("S"), F.col("s_suppkey").cast("string"), F.lit("|1|"), chain)
    rows = s.select(F.concat(F.lit("NR_"), "s_suppkey").alias("a"), F.concat_ws("+", entry(F.when(F.col("s_nationkey") % 2 == 0, "A").otherwise("B")), entry(F.lit("C"))).alias("b"))
    path = shared_path(spark, "representatives")
    rows.write.option("quoteAll", True).csv(path)
    return Z.read_representatives(spark, path).withColumn("chains", F.array_join("chains", ","))


@query("SELECT 'c' || c_custkey AS pdbid, 'B-C-' || c_mktsegment[1] AS chains, unnest(['B', 'C', c_mktsegment[1]]) AS chain FROM customer")
def split_ids(spark: SparkSession, d: str) -> DataFrame:
    c = A.table(spark, d, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string"), F.lit("_1_B-C-"), F.substring("c_mktsegment", 1, 1)).alias("value"))
    return Z.read_split_ids(spark, _written(c, "splits"))


COMPONENTS = """WITH RECURSIVE k AS (SELECT 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS id, CASE n_nationkey % 3 WHEN 0 THEN 'RNA LINKING' WHEN 1 THEN 'L-PEPTIDE LINKING' ELSE 'NON-POLYMER' END AS type, n_name[1] AS letter,
CASE WHEN n_nationkey % 4 <> 0 THEN 'N' || lpad(CAST(n_nationkey // 2 AS VARCHAR), 2, '0') END AS parent FROM nation),
r(id, last, hop) AS (SELECT id, id, 0 FROM k UNION ALL SELECT r.id, k.parent, hop + 1 FROM r JOIN k ON k.id = r.last WHERE k.parent IS NOT NULL AND k.parent <> k.id),
l AS (SELECT id, arg_max(last, hop) AS last FROM r GROUP BY id)"""


@query(f"{COMPONENTS} SELECT l.id, k.letter, CASE WHEN k.type LIKE '%PEPTIDE%' THEN 'protein' WHEN k.type LIKE '%RNA%' THEN 'rna' ELSE lower(k.type) END AS kind FROM l JOIN k ON k.id = l.last")
def component_letters(spark: SparkSession, d: str) -> DataFrame:
    """A dictionary of components, whose letters are those of their last parents."""
    n = A.table(spark, d, "nation")
    name = lambda c: F.concat(F.lit("N"), F.lpad(c.cast("string"), 2, "0"))
    kind = F.when(F.col("n_nationkey") % 3 == 0, "'RNA LINKING'").when(F.col("n_nationkey") % 3 == 1, "'L-PEPTIDE LINKING'").otherwise("NON-POLYMER")
    parent = F.when(F.col("n_nationkey") % 4 != 0, name(F.expr("n_nationkey div 2"))).otherwise("?")
    item = lambda k, v: F.concat(F.lit(f"_chem_comp.{k}   "), v, F.lit("\n"))
    block = F.concat(F.lit("data_"), name(F.col("n_nationkey")), F.lit("\n#\n"), item("id", name(F.col("n_nationkey"))), item("type", kind), item("mon_nstd_parent_comp_id", parent), item("one_letter_code", F.substring("n_name", 1, 1)))
    return Z.canonical_letters(Z.read_component_dictionary(spark, _written(n.select(block.alias("value")), "components")))


# --- structures


def _atoms(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as atoms: a molecule is a structure, a label a chain, and two atoms make a residue."""
    e = A.table(spark, d, "embeddings")
    pick = lambda names, c: F.element_at(F.array(*[F.lit(x) for x in names]), (c + 1).cast("int"))
    at = [F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")]
    pos = F.expr("vec_id div 2")
    return e.select(
        F.concat(F.lit("m"), F.expr(f"vec_id div {A.MOLECULE}").cast("string")).alias("pdbid"),
        F.when(F.col("label") == 9, "HETATM").otherwise("ATOM").alias("group"),
        pick("ABCDEFGHIJ", F.col("label")).alias("chain"),
        pos.alias("pos"),
        F.lit(None).cast("string").alias("ins"),
        F.when(F.col("label") == 8, "DA").otherwise(pick("ACGU", pos % 4)).alias("comp"),
        F.when(F.col("vec_id") % 2 == 0, "P").otherwise("C4'").alias("atom"),
        F.when(F.col("vec_id") % 2 == 0, "P").otherwise("C").alias("element"),
        F.when(F.col("vec_id") % 11 == 10, 2).otherwise(1).cast("long").alias("model"),
        *at,
    )


ATOMS = f"""SELECT 'm' || (vec_id // {A.MOLECULE}) AS pdbid, CASE WHEN label = 9 THEN 'HETATM' ELSE 'ATOM' END AS "group", 'ABCDEFGHIJ'[label + 1] AS chain, vec_id // 2 AS pos,
CASE WHEN label = 8 THEN 'DA' ELSE 'ACGU'[(vec_id // 2) % 4 + 1] END AS comp, CASE WHEN vec_id % 2 = 0 THEN 'P' ELSE 'C4' || chr(39) END AS atom, CASE WHEN vec_id % 11 = 10 THEN 2 ELSE 1 END AS model,
CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings"""


@query(f"""WITH a AS ({ATOMS}) SELECT pdbid, "group", chain, CAST(pos AS BIGINT) AS pos, comp, atom, CAST(model AS BIGINT) AS model, round(x, 9) AS x, round(z, 9) AS z FROM a""")
def structure_files(spark: SparkSession, d: str) -> DataFrame:
    """Structures written as files, one each, and read again."""
    path = shared_path(spark, "structures")
    Z.write_structures(_atoms(spark, d), path)
    back = Z.read_atoms(spark, f"{path}/*")
    return back.select("pdbid", "group", "chain", "pos", "comp", "atom", "model", F.round("x", 9).alias("x"), F.round("z", 9).alias("z"))


@query(f"""WITH a AS ({ATOMS}), f AS (SELECT a.* FROM a JOIN (SELECT pdbid, min(model) AS m FROM a GROUP BY pdbid) USING (pdbid) WHERE model = m),
k AS (SELECT pdbid, chain FROM f GROUP BY pdbid, chain HAVING bool_or(comp IN ('A', 'C', 'G', 'U')) AND count(DISTINCT pos) BETWEEN 3 AND 8)
SELECT pdbid || '_' || chain AS pdbid, count(*) AS atoms, count(DISTINCT pos) AS residues FROM f JOIN k USING (pdbid, chain) GROUP BY pdbid, chain""")
def structures_by_chain(spark: SparkSession, d: str) -> DataFrame:
    """Cleaned structures, one for each chain of three to eight residues."""
    cut = Z.split_structures(Z.clean_structures(_atoms(spark, d)), 3, 8)
    return cut.groupBy("pdbid").agg(F.count(F.lit(1)).alias("atoms"), F.countDistinct("pos").alias("residues"))


@query(f"""WITH a AS ({ATOMS}) SELECT pdbid, count(*) FILTER (pos % 3 = 0) AS kept, count(*) FILTER (pos % 3 <> 0) AS dropped FROM a GROUP BY pdbid""")
def residues_kept(spark: SparkSession, d: str) -> DataFrame:
    atoms = _atoms(spark, d)
    some = atoms.where("pos % 3 = 0").select("pdbid", "chain", "pos")
    kept = Z.keep_residues(atoms, some).select("pdbid", F.lit(1).alias("k"), F.lit(0).alias("l"))
    gone = Z.drop_residues(atoms, some).select("pdbid", F.lit(0).alias("k"), F.lit(1).alias("l"))
    return kept.union(gone).groupBy("pdbid").agg(F.sum("k").cast("long").alias("kept"), F.sum("l").cast("long").alias("dropped"))


@query(f"""WITH a AS ({ATOMS}) SELECT DISTINCT pdbid, chain, CAST(pos AS BIGINT) AS pos, comp FROM a WHERE "group" = 'ATOM' OR comp = 'C'""")
def residue_list(spark: SparkSession, d: str) -> DataFrame:
    return Z.residue_list(_atoms(spark, d), ["C"])


@query(f"""WITH a AS ({ATOMS}) SELECT pdbid, chain FROM a WHERE "group" = 'ATOM' GROUP BY pdbid, chain HAVING bool_and(comp IN ('A', 'C', 'G', 'U'))""")
def rna_chains(spark: SparkSession, d: str) -> DataFrame:
    return Z.rna_chains(_atoms(spark, d))


@query(f"""WITH a AS ({ATOMS}), k AS (SELECT pdbid, chain FROM a WHERE "group" = 'ATOM' GROUP BY pdbid, chain HAVING bool_and(comp IN ('A', 'C', 'G', 'U'))),
n AS (SELECT pdbid, chain, pos, min(comp) AS nt_code, coalesce(min(x) FILTER (atom = 'P'), avg(x)) AS x FROM a JOIN k USING (pdbid, chain) WHERE "group" = 'ATOM' AND model = 1 GROUP BY pdbid, chain, pos),
b AS (SELECT pdbid, chain, pos, pos - lag(pos) OVER (PARTITION BY pdbid, chain ORDER BY pos) = 1 AS linked FROM n)
SELECT n.pdbid AS graph, n.pdbid || '.' || n.chain || '.' || n.pos AS node, nt_code, round(x, 6) AS x, coalesce(b.linked, false) AS linked FROM n JOIN b ON b.pdbid = n.pdbid AND b.chain = n.chain AND b.pos = n.pos""")
def structure_graphs(spark: SparkSession, d: str) -> DataFrame:
    """Residues of the RNA chains, and whether a backbone edge leads to the one before."""
    c = Z.structure_graphs(_atoms(spark, d))
    back = c.edges.where("label = 'B53'").select("graph", F.col("src").alias("node"), F.lit(True).alias("linked"))
    return c.nodes.join(back, ["graph", "node"], "left").select("graph", "node", "nt_code", F.round("x", 6).alias("x"), F.coalesce("linked", F.lit(False)).alias("linked"))


@query("SELECT 'x' || n_nationkey AS pdbid, CAST(n_regionkey + 20 AS VARCHAR) AS resolution_low, CASE WHEN n_nationkey % 3 <> 0 THEN CAST(n_regionkey AS VARCHAR) || '.50' END AS resolution_high FROM nation")
def structure_metadata(spark: SparkSession, d: str) -> DataFrame:
    n = A.table(spark, d, "nation")
    high = F.when(F.col("n_nationkey") % 3 != 0, F.concat(F.col("n_regionkey").cast("string"), F.lit(".50"))).otherwise("?")
    text = F.concat(F.lit("data_X\n#\n_reflns.entry_id  X\n_reflns.d_resolution_high  "), high, F.lit("\n_reflns.d_resolution_low "), (F.col("n_regionkey") + 20).cast("string"), F.lit("\n#\n"))
    path = shared_path(spark, "metadata")
    n.select(F.concat(F.lit("x"), F.col("n_nationkey").cast("string")).alias("pdbid"), text.alias("value")).repartition("pdbid").write.partitionBy("pdbid").text(path)
    return Z.read_metadata(spark, f"{path}/*")


# --- collections and tasks, written and read


@query(f"""WITH n AS ({A.CONV_NODES}), s AS (SELECT graph, count(*) AS nodes FROM n GROUP BY graph), e AS (SELECT graph, count(*) AS edges FROM ({A.CONV_EDGES}) GROUP BY graph)
SELECT s.graph, nodes, coalesce(edges, 0) AS edges, CASE WHEN s.graph % 2 = 0 AND EXISTS (SELECT 1 FROM s o WHERE o.graph = s.graph + 1) THEN round(1.0 / (s.graph + 1), 6) END AS distance FROM s LEFT JOIN e ON e.graph = s.graph""")
def collection_files(spark: SparkSession, d: str) -> DataFrame:
    """A collection with one metric kept and one taken away, saved and loaded."""
    c = GraphCollection.of(A.conv_nodes(spark, d), A.conv_edges(spark, d))
    pairs = c.graphs.where("graph % 2 = 0").select(F.col("graph").alias("i"), (F.col("graph") + 1).alias("j"), (1.0 / (F.col("graph") + 1)).alias("distance"))
    pairs = pairs.join(c.graphs.select(F.col("graph").alias("j")), "j", "left_semi").select("i", "j", "distance")
    path = shared_path(spark, "collection")
    c.with_distances("own", pairs).with_distances("other", pairs).without_distances("other").save(path)
    back = GraphCollection.load(spark, path)
    sizes = back.nodes.groupBy("graph").agg(F.count(F.lit(1)).alias("nodes"))
    edges = back.edges.groupBy("graph").agg(F.count(F.lit(1)).alias("edges"))
    far = back.distances.groupBy(F.col("i").alias("graph")).agg(F.round(F.max("distance"), 6).alias("distance"))
    return sizes.join(edges, "graph", "left").join(far, "graph", "left").select("graph", "nodes", F.coalesce("edges", F.lit(0)).cast("long").alias("edges"), "distance")


@query(f"""WITH n AS ({A.CONV_NODES}), s AS (SELECT graph, node, CASE WHEN {_u('graph', 0)} < 0.7 THEN 'train' WHEN {_u('graph', 0)} < 0.85 THEN 'val' ELSE 'test' END AS split, CAST(size > 60 AS INTEGER) AS target FROM n)
SELECT split, count(*) AS n, CAST(sum(target) AS BIGINT) AS ones FROM s GROUP BY split""")
def task_files(spark: SparkSession, d: str) -> DataFrame:
    """A task written and loaded: rows and ones of each part."""
    nodes = A.conv_nodes(spark, d).withColumn("is_modified", F.col("size") > 60)
    t = Task("turns", GraphCollection.of(nodes, A.conv_edges(spark, d)), [], FeaturesComputer(targets=["is_modified"]))
    path = shared_path(spark, "task")
    t.write(path)
    rows, _ = Task.load(spark, path)
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("targets")[0]).cast("long").alias("ones"))


@query(f"""WITH s AS (SELECT DISTINCT conv_id AS graph, turn AS node FROM conversations WHERE turn % 4 = 1 AND conv_id % 2 = 0), n AS ({A.CONV_NODES})
SELECT CAST(n.graph AS VARCHAR) AS graph, CAST(n.node AS VARCHAR) AS node, s.node IS NOT NULL AS in_pocket FROM n LEFT JOIN s ON s.graph = n.graph AND s.node = n.node WHERE n.graph IN (SELECT graph FROM s)""")
def pocket_files(spark: SparkSession, d: str) -> DataFrame:
    """Graphs with a pocket as JSON, with flags on their residues, written and read."""
    seeds = A.conv_nodes(spark, d).where("node % 4 = 1 and graph % 2 = 0").select("graph", "node")
    nodes, edges = O.pocket_graphs(A.conv_nodes(spark, d).select("graph", "node"), A.conv_edges(spark, d), seeds)
    path = shared_path(spark, "pocket-graphs")
    graph_json.write_graphs(GraphCollection.of(nodes, edges), path)
    back = graph_json.read_graphs(spark, path, [StructField("in_pocket", BooleanType())], multi_line=False)
    return back.nodes.select("graph", "node", "in_pocket")


# --- streams


@query("""WITH w AS (SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2), m AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM events)
SELECT start, event_type, n, total FROM w, m WHERE start + INTERVAL 1 HOUR <= mark""")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events as a stream: the windows that are finished, as the watermark lets them go. The pattern lets one file be a source."""
    path, state = shared_path(spark, "windows"), shared_path(spark, "state")
    append_batches(counts_by_window(read_events(spark, f"{d}/events.parque[t]")), path, state).awaitTermination()
    return spark.read.parquet(path).withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("total", F.round("total", 4))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM g), m AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM events)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s, m GROUP BY user_id, run, mark HAVING max(ts) + INTERVAL 30 MINUTE <= mark""")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Events as a stream: each user's runs without a gap of half an hour, those that are over."""
    path, state = shared_path(spark, "sessions"), shared_path(spark, "state")
    append_batches(sessions(read_events(spark, f"{d}/events.parque[t]")), path, state).awaitTermination()
    return spark.read.parquet(path).withColumn("start", F.col("start").cast("timestamp_ntz"))
