"""Edge rewrites, filters, partitions and joins over the adapters' graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattisca.catalog import query
from lattisca.model import GraphCollection
from lattisca.operators import aggregate as G
from lattisca.operators import annotate as U
from lattisca.operators import edges as E
from lattisca.operators import filters as L
from lattisca.operators import kernels as N
from lattisca.operators import labels as B
from lattisca.operators import partition as P
from lattisca.operators import pockets as O
from lattisca.operators import spatial as S
from lattisca.sources import adapters as A
from lattisca.sources.structures import residue_name_of

BB = "('B53', 'B35')"
CANON = "upper(label) IN ('B53', 'B35', 'CWW')"


@query(f"""WITH e AS ({A.ORDER_EDGES})
SELECT graph, src, dst, label FROM (SELECT *, row_number() OVER (PARTITION BY graph, src, dst
  ORDER BY CASE WHEN label IN {BB} THEN 1 ELSE 0 END DESC, shipped DESC, ord DESC, label DESC) AS n FROM e) WHERE n = 1""")
def simple_graph(spark: SparkSession, d: str) -> DataFrame:
    return E.simple_graph(A.order_edges(spark, d), ["shipped", "ord"]).select("graph", "src", "dst", "label")


@query(f"WITH e AS ({A.ORDER_EDGES}) SELECT graph, src, dst, label, CAST(ord AS BIGINT) AS ord FROM e WHERE {CANON}")
def canonical_edges(spark: SparkSession, d: str) -> DataFrame:
    return E.canonical_edges(A.order_edges(spark, d)).select("graph", "src", "dst", "label", F.col("ord").cast("long").alias("ord"))


@query(f"""WITH e AS ({A.CONV_EDGES})
SELECT DISTINCT graph, least(src, dst) AS src, greatest(src, dst) AS dst,
  CASE WHEN label IN {BB} THEN 'B53' WHEN label[2] <= label[3] THEN label ELSE label[1] || label[3] || label[2] END AS label FROM e""")
def symmetric_labels(spark: SparkSession, d: str) -> DataFrame:
    return E.undirected(A.conv_edges(spark, d))


@query(f"""WITH e AS ({A.CONV_EDGES}) SELECT graph, src, dst, label FROM e WHERE label NOT IN {BB}""")
def base_pair_edges(spark: SparkSession, d: str) -> DataFrame:
    return O.base_pairs(A.conv_edges(spark, d))


@query("""WITH l AS (SELECT DISTINCT l_returnflag || l_linestatus AS state, CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'cWW' WHEN 'NO' THEN 'B53' WHEN 'RF' THEN 'tHS' WHEN 'NF' THEN 'B35' ELSE 'cSW' END AS label FROM lineitem)
SELECT a.label AS one, b.label AS two, round(CASE WHEN a.label = b.label THEN 1.0 WHEN a.label IN ('B53','B35') AND b.label IN ('B53','B35') THEN 0.2
  WHEN a.label IN ('B53','B35') OR b.label IN ('B53','B35') THEN 0.0 ELSE exp(-4.0 / 8) END, 6) AS iso FROM (SELECT DISTINCT label FROM l) a JOIN (SELECT DISTINCT label FROM l) b ON true""")
def iso_lookup(spark: SparkSession, d: str) -> DataFrame:
    found = A.order_edges(spark, d).select("label").distinct()  # at most as many as there are labels
    both = found.withColumn("all", F.lit(1)).withColumnRenamed("label", "one").join(found.withColumn("all", F.lit(1)).withColumnRenamed("label", "two"), "all")
    return both.select("one", "two", F.round(E.isostericity(F.col("one"), F.col("two"), F.lit(4.0)), 6).alias("iso"))


PUBLISHED = ", ".join(f"('{a}', '{b}', {N.distance(a, b)})" for a in ("cWW", "tHS", "cSW") for b in ("cWW", "tHS", "cSW"))


@query(f"""WITH l AS (SELECT DISTINCT CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'cWW' WHEN 'NO' THEN 'B53' WHEN 'RF' THEN 'tHS' WHEN 'NF' THEN 'B35' ELSE 'cSW' END AS label FROM lineitem),
t AS (SELECT * FROM (VALUES {PUBLISHED}) AS v(one, two, d)) SELECT a.label AS one, b.label AS two, round(CASE WHEN a.label = b.label THEN 1.0 WHEN a.label IN {BB} AND b.label IN {BB} THEN 0.2
WHEN a.label IN {BB} OR b.label IN {BB} THEN 0.0 ELSE exp(-t.d / 8) END, 6) AS iso FROM l a JOIN l b ON true LEFT JOIN t ON t.one = a.label AND t.two = b.label""")
def iso_matrix(spark: SparkSession, d: str) -> DataFrame:
    """How alike labels are by the published distances, as a table of all labels that there are."""
    found = A.order_edges(spark, d).select("label").distinct()
    table_ = spark.createDataFrame(N.label_table(list(E.LABELS)), "one string, two string, iso double")
    held = table_.join(F.broadcast(found.withColumnRenamed("label", "one")), "one", "left_semi").join(F.broadcast(found.withColumnRenamed("label", "two")), "two", "left_semi")
    return held.withColumn("iso", F.round("iso", 6)).select("one", "two", "iso")


@query("SELECT p_partkey, lower(split_part(p_brand, '#', 1)) || '.' || split_part(p_type, ' ', 1) || '.' || CAST(p_size AS VARCHAR) AS node FROM part")
def id_rewrite(spark: SparkSession, d: str) -> DataFrame:
    p = A.table(spark, d, "part")
    raw = F.concat_ws("|", F.split_part("p_brand", F.lit("#"), F.lit(1)), F.lit("1"), F.split_part("p_type", F.lit(" "), F.lit(1)), F.lit("A"), F.col("p_size").cast("string"))
    return p.select("p_partkey", residue_name_of(raw).alias("node"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_attr(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT page_id, url FROM pages WHERE NOT regexp_matches(lower(url), 'blog|utm_source')")
def keyword_filter(spark: SparkSession, d: str) -> DataFrame:
    return L.by_keywords(A.table(spark, d, "pages").select("page_id", "url"), "url", ["Blog", "UTM_source"])


@query("SELECT n_nationkey, n_name FROM nation WHERE lower(n_name) IN ('france', 'nation_3', 'nation_7', 'germany')")
def name_filter(spark: SparkSession, d: str) -> DataFrame:
    n = A.table(spark, d, "nation").withColumn("name", F.lower("n_name"))
    return L.by_name(n, ["FRANCE", "nation_3", "NATION_7", "Germany"]).select("n_nationkey", "n_name")


@query(f"WITH n AS ({A.EVENT_NODES}) SELECT graph, count(*) FILTER (CAST(node AS VARCHAR) LIKE '%7') AS n_valid FROM n GROUP BY graph HAVING count(*) FILTER (CAST(node AS VARCHAR) LIKE '%7') >= 2")
def residue_name(spark: SparkSession, d: str) -> DataFrame:
    return L.by_residues(A.event_nodes(spark, d), F.col("node").cast("string").endswith("7"), 2)


@query("SELECT user_id AS graph, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 15 AND count(*) < 500")
def size_filter(spark: SparkSession, d: str) -> DataFrame:
    nodes = A.table(spark, d, "events").select(F.col("user_id").alias("graph"))
    return L.by_size(nodes, 15, 500)


@query("SELECT user_id AS graph, count(*) FILTER (event_type = 'error' AND value > 1) AS n_valid FROM events GROUP BY user_id HAVING count(*) FILTER (event_type = 'error' AND value > 1) >= 1")
def residue_attr_min(spark: SparkSession, d: str) -> DataFrame:
    nodes = A.table(spark, d, "events").select(F.col("user_id").alias("graph"), "event_type", "value")
    return L.by_residues(nodes, (F.col("event_type") == "error") & (F.col("value") > 1), 1)


@query("SELECT user_id AS graph, round(avg(value), 6) AS agg FROM events GROUP BY user_id HAVING avg(value) < 45")
def residue_attr_agg(spark: SparkSession, d: str) -> DataFrame:
    nodes = A.table(spark, d, "events").select(F.col("user_id").alias("graph"), "value")
    return L.by_aggregate(nodes, F.avg("value"), F.col("agg") < 45).select("graph", F.round("agg", 6).alias("agg"))


@query("SELECT o_orderkey AS graph FROM orders WHERE o_totalprice < 50000")
def resolution_filter(spark: SparkSession, d: str) -> DataFrame:
    g = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("graph"), F.col("o_totalprice").cast("string").alias("resolution"))
    return L.by_resolution(g, 50000).select("graph")


@query("SELECT user_id AS graph, event_id AS node, event_type AS chain FROM events WHERE event_type IN ('purchase', 'error')")
def chain_filter(spark: SparkSession, d: str) -> DataFrame:
    nodes = A.table(spark, d, "events").select(F.col("user_id").alias("graph"), F.col("event_id").alias("node"), F.col("event_type").alias("chain"))
    valid = nodes.select("graph").distinct().select("graph", F.explode(F.array(F.lit("purchase"), F.lit("error"))).alias("chain"))
    return L.by_chains(nodes, valid).select("graph", "node", "chain")


@query(f"""WITH n AS ({A.CONV_NODES}), e AS ({A.CONV_EDGES})
SELECT graph, count(*) AS n FROM n WHERE graph IN (SELECT graph FROM e WHERE NOT ({CANON})) GROUP BY graph HAVING count(*) >= 4""")
def graph_filter(spark: SparkSession, d: str) -> DataFrame:
    return L.by_structure(A.conv_nodes(spark, d), A.conv_edges(spark, d), 4)


@query("""SELECT p_partkey, CASE WHEN split_part(p_type, ' ', 1) IN ('PROMO', 'ECONOMY') THEN 'ion' WHEN p_retailprice BETWEEN 950 AND 1400 THEN 'ligand' END AS class FROM part""")
def ligand_class(spark: SparkSession, d: str) -> DataFrame:
    p = A.table(spark, d, "part")
    elements = F.array(F.lit("C"), F.lit("N"), F.lit("O"))
    kind = F.split_part("p_type", F.lit(" "), F.lit(1))
    return p.select("p_partkey", L.ligand_class(kind, F.col("p_retailprice"), elements, ["C", "N", "O", "P"], 950, 1400, ["PROMO", "ECONOMY"]).alias("class"))


@query("SELECT event_id, coalesce(CASE WHEN event_type = 'purchase' THEN value END, CASE WHEN event_type = 'error' THEN value END) IS NOT NULL AS bound FROM events")
def binding_flag(spark: SparkSession, d: str) -> DataFrame:
    e = A.table(spark, d, "events")
    sites = [F.when(F.col("event_type") == kind, F.col("value")) for kind in ("purchase", "error")]
    return e.select("event_id", U.binding_flag(sites).alias("bound"))


@query(f"""WITH n AS ({A.EVENT_NODES}), e AS (SELECT a.graph, a.node AS src, b.node AS dst, a.chain AS ca, b.chain AS cb FROM n a JOIN n b ON a.graph = b.graph AND b.pos = a.pos + 1)
SELECT graph, src, dst, ca AS part FROM e WHERE ca = cb""")
def chain_split(spark: SparkSession, d: str) -> DataFrame:
    nodes = A.event_nodes(spark, d)
    after = nodes.select("graph", F.col("node").alias("dst"), (F.col("pos") - 1).alias("pos"))
    follow = nodes.select("graph", F.col("node").alias("src"), "pos").join(after, ["graph", "pos"]).select("graph", "src", "dst")
    return P.by_chain(nodes, follow)[1].select("graph", "src", "dst", "part")


@query(f"""WITH n AS ({A.CONV_NODES}), l AS (SELECT graph, node, code AS list FROM n WHERE code <> 'system')
SELECT graph, node, CAST(dense_rank() OVER (PARTITION BY graph ORDER BY list) - 1 AS BIGINT) AS part FROM l""")
def partition_from_dict(spark: SparkSession, d: str) -> DataFrame:
    nodes = A.conv_nodes(spark, d)
    lists = nodes.select("graph", "node", F.col("code").alias("list")).where("list <> 'system'")
    return P.from_lists(nodes.select("graph", "node"), lists).select("graph", "node", "part")


@query(f"""WITH n AS ({A.EVENT_NODES}), r AS (SELECT *, row_number() OVER (PARTITION BY graph, chain ORDER BY pos) AS rank FROM n)
SELECT graph, chain, node, CAST(rank AS BIGINT) AS rank FROM r WHERE rank BETWEEN 2 AND 4 AND chain <> 'view'""")
def ordinal_slice(spark: SparkSession, d: str) -> DataFrame:
    nodes = A.event_nodes(spark, d).where("chain <> 'view'")
    slices = nodes.select("graph", "chain").distinct().select("graph", "chain", F.lit(2).alias("first"), F.lit(4).alias("last"))
    return P.ordinal_slice(nodes, slices).select("graph", "chain", "node", "rank")


@query(f"WITH n AS ({A.EVENT_NODES}) SELECT graph, (pos - 1) // 8 AS chunk, count(*) AS n, min(pos) AS first FROM n GROUP BY graph, (pos - 1) // 8")
def chunk_sequence(spark: SparkSession, d: str) -> DataFrame:
    cut = P.chunks(A.event_nodes(spark, d), ["graph"], 8)
    return cut.groupBy("graph", "chunk").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey AS graph, least(l_partkey, l_suppkey + 10000000) AS u, greatest(l_partkey, l_suppkey + 10000000) AS v FROM lineitem),
b AS (SELECT graph, u, v FROM e UNION SELECT graph, v, u FROM e),
r(graph, node, root) AS (SELECT graph, u, u FROM b UNION SELECT r.graph, b.v, r.root FROM r JOIN b ON r.graph = b.graph AND r.node = b.u)
SELECT graph, node, min(root) AS component FROM r GROUP BY graph, node""")
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    e = A.order_edges(spark, d).select("graph", "src", (F.col("dst") + 10_000_000).alias("dst"))
    return P.connected_components(e)


@query()
def pca_chop(spark: SparkSession, d: str) -> DataFrame:
    return P.pca_chop(A.points(spark, d).select("graph", "node", "x", "y", "z"), 12).select("graph", "node", "part")


@query(f"""WITH n AS ({A.CONV_NODES}), f AS (SELECT graph, node, size, row_number() OVER (PARTITION BY graph ORDER BY node) AS r FROM n)
SELECT n.graph, n.node, f.size AS first_size FROM n JOIN f ON n.graph = f.graph AND f.r = 1""")
def annotate_from_dict(spark: SparkSession, d: str) -> DataFrame:
    nodes = A.conv_nodes(spark, d)
    first = nodes.groupBy("graph").agg(F.min_by("size", "node").alias("first_size"))
    return U.lookup(nodes.select("graph", "node"), first, "graph", "first_size")


@query(f"""WITH n AS ({A.EVENT_NODES}), c AS (SELECT graph, chain, pos, lag(pos) OVER (PARTITION BY graph, chain ORDER BY pos) AS before FROM n), p AS (SELECT * FROM c WHERE pos - before = 1)
SELECT graph, chain, pos AS src, before AS dst, 'B53' AS label FROM p UNION ALL SELECT graph, chain, before, pos, 'B35' FROM p""")
def backbone_edges(spark: SparkSession, d: str) -> DataFrame:
    return E.backbone_edges(A.event_nodes(spark, d), ["graph", "chain"])


@query(f"""WITH e AS ({A.CONV_EDGES}), b AS (SELECT graph, src AS node, dst AS other FROM e UNION ALL SELECT graph, dst, src FROM e)
SELECT DISTINCT b.graph, other AS node FROM b JOIN conversations x ON x.conv_id = b.graph AND x.turn = b.node JOIN conversations y ON y.conv_id = b.graph AND y.turn = b.other WHERE x.role = 'user' AND y.role <> 'user'""")
def incident_nodes(spark: SparkSession, d: str) -> DataFrame:
    chosen = A.conv_nodes(spark, d).where("code = 'user'")
    return E.incident_nodes(A.conv_edges(spark, d), chosen)


PAIRS = f"""WITH p AS ({A.POINTS}), m AS (SELECT a.graph, a.node AS a, b.node AS b, b.kind, (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) AS d2
  FROM p a JOIN p b ON a.graph = b.graph AND a.node <> b.node)"""


@query(f"{PAIRS} SELECT graph, a, count(*) AS n FROM m WHERE d2 <= 0.08 * 0.08 GROUP BY graph, a")
def radius_count(spark: SparkSession, d: str) -> DataFrame:
    p = A.points(spark, d)
    return S.radius_join(p, p, 0.08).where("a <> b").groupBy("graph", "a").agg(F.count(F.lit(1)).alias("n"))


@query(f"{PAIRS} SELECT graph, a, b, round(sqrt(d2), 6) AS distance FROM m WHERE d2 <= 0.1 * 0.1 AND a < b")
def radius_neighbors(spark: SparkSession, d: str) -> DataFrame:
    p = A.points(spark, d)
    return S.radius_join(p, p, 0.1).where("a < b").select("graph", "a", "b", F.round("distance", 6).alias("distance"))


@query(f"""{PAIRS}, k AS (SELECT graph, a, b, row_number() OVER (PARTITION BY graph, a ORDER BY d2, b) AS r FROM m)
SELECT DISTINCT graph, a, b FROM (SELECT graph, a, b FROM k WHERE r <= 4 UNION ALL SELECT graph, b, a FROM k WHERE r <= 4)""")
def knn_graph(spark: SparkSession, d: str) -> DataFrame:
    return S.undirected_knn(A.points(spark, d), 4)


@query("""WITH w AS (SELECT * FROM (VALUES (0, 7), (1, 3), (2, 12), (3, -1), (4, 5)) AS v(wish, conv_id)), k AS (SELECT w.wish, w.conv_id FROM w WHERE conv_id IN (SELECT conv_id FROM conversations))
SELECT k.conv_id AS graph, CAST(row_number() OVER (ORDER BY wish) - 1 AS BIGINT) AS idx, (SELECT count(*) FROM conversations c WHERE c.conv_id = k.conv_id) AS nodes FROM k""")
def subset(spark: SparkSession, d: str) -> DataFrame:
    """Named graphs in the order that they were asked for; names that don't exist are left out."""
    c = GraphCollection.of(A.conv_nodes(spark, d), A.conv_edges(spark, d)).subset(["7", "3", "12", "-1", "5"])
    return c.graphs.join(c.nodes.groupBy("graph").agg(F.count(F.lit(1)).alias("nodes")), "graph").select("graph", "idx", "nodes")


@query("""SELECT conv_id AS graph, CAST(row_number() OVER (ORDER BY conv_id) - 1 AS BIGINT) AS idx FROM (SELECT DISTINCT conv_id FROM conversations)""")
def collection_index(spark: SparkSession, d: str) -> DataFrame:
    return GraphCollection.of(A.conv_nodes(spark, d), A.conv_edges(spark, d)).indexed().graphs.select("graph", "idx")


@query("""SELECT conv_id AS graph, count(*) AS nodes FROM conversations WHERE conv_id IN (SELECT DISTINCT conv_id FROM conversations ORDER BY conv_id LIMIT 50) GROUP BY conv_id""")
def collection_head(spark: SparkSession, d: str) -> DataFrame:
    """The first fifty graphs by name."""
    c = GraphCollection.of(A.conv_nodes(spark, d), A.conv_edges(spark, d)).head(50)
    return c.nodes.groupBy("graph").agg(F.count(F.lit(1)).alias("nodes"))


@query(f"SELECT graph, node, pos, size FROM ({A.CONV_NODES}) WHERE graph = 7")
def collection_item(spark: SparkSession, d: str) -> DataFrame:
    return GraphCollection.of(A.conv_nodes(spark, d), A.conv_edges(spark, d)).item(7).nodes.select("graph", "node", "pos", "size")


@query("""WITH e AS (SELECT DISTINCT l_orderkey AS graph FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)) SELECT graph, 'unknown ends' AS what FROM e""")
def collection_check(spark: SparkSession, d: str) -> DataFrame:
    """Orders with a part that is no longer listed among their nodes."""
    lines = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("graph"), F.col("l_partkey").alias("node"))
    kept = lines.join(A.table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("node")), "node", "left_semi").select("graph", "node").distinct()
    loops = lines.select("graph", F.col("node").alias("src"), F.col("node").alias("dst"), F.lit("B53").alias("label"))
    return GraphCollection(lines.select("graph").distinct(), kept, loops).inconsistent().where("what = 'unknown ends'")


@query("""SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def id_set_algebra(spark: SparkSession, d: str) -> DataFrame:
    orders = A.table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    has = orders.where("o_orderstatus = 'O'").select("c_custkey")
    no = orders.where("o_orderpriority = '1-URGENT'").select("c_custkey")
    return A.table(spark, d, "customer").select("c_custkey").join(has, "c_custkey", "left_semi").join(no, "c_custkey", "left_anti")


@query("""WITH w AS (SELECT conv_id, turn, role FROM conversations), f AS (SELECT conv_id, role, min(turn) AS first FROM w GROUP BY conv_id, role),
c AS (SELECT conv_id, role, CAST(dense_rank() OVER (PARTITION BY conv_id ORDER BY first) - 1 AS BIGINT) AS code FROM f)
SELECT w.conv_id, w.turn, c.code FROM w JOIN c ON w.conv_id = c.conv_id AND w.role = c.role""")
def dict_encode(spark: SparkSession, d: str) -> DataFrame:
    w = A.table(spark, d, "conversations").select("conv_id", "turn", "role")
    codes = B.dictionary(w, "role", "turn", ["conv_id"])
    return B.encoded(w, "role", codes, ["conv_id"]).select("conv_id", "turn", "code")


@query("""WITH f AS (SELECT p_type AS value, min(p_partkey) AS first FROM part GROUP BY p_type) SELECT value, CAST(row_number() OVER (ORDER BY first, value) - 1 AS BIGINT) AS code FROM f""")
def dictionary(spark: SparkSession, d: str) -> DataFrame:
    return B.dictionary(A.table(spark, d, "part"), "p_type", "p_partkey")


@query("SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS BIGINT) AS code FROM (SELECT DISTINCT p_type AS term FROM part)")
def label_codes(spark: SparkSession, d: str) -> DataFrame:
    return B.label_codes(A.table(spark, d, "part").select(F.col("p_type").alias("term")))


@query("SELECT p_partkey AS id, p_type AS term FROM part WHERE p_type IN (SELECT p_type FROM part GROUP BY p_type HAVING count(*) > 3)")
def label_threshold(spark: SparkSession, d: str) -> DataFrame:
    return B.over(A.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("term")), 3)


@query("""SELECT user_id AS graph, round(max(value) FILTER (event_type = 'click'), 6) AS click, round(max(value) FILTER (event_type = 'view'), 6) AS view, round(max(value) FILTER (event_type = 'error'), 6) AS error FROM events GROUP BY user_id""")
def pivot_attr(spark: SparkSession, d: str) -> DataFrame:
    e = A.table(spark, d, "events").withColumnRenamed("user_id", "graph")
    kinds = ["click", "view", "error"]
    return G.pivoted(e, "graph", "event_type", "value", kinds).select("graph", *[F.round(k, 6).alias(k) for k in kinds])
