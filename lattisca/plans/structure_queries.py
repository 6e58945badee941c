"""Cleaning, predicates, pockets, hashes of balls, and what is made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattisca.catalog import query
from lattisca.operators import clean as D
from lattisca.operators import edges as E
from lattisca.operators import filters as L
from lattisca.operators import partition as P
from lattisca.operators import pockets as O
from lattisca.operators import predicates as H
from lattisca.operators import split as X
from lattisca.operators import traverse as T
from lattisca.plans.analysis_queries import BALL, _roots
from lattisca.sources import adapters as A
from lattisca.sources.adapters import HAIRPIN_EDGES, HAIRPIN_NODES, PAIRED, WATSON, table

AFTER = WATSON.replace("pos", "(pos + 1)")


# --- cleaning. Hairpins have a known answer: what is left lies between a place and the one across.


@query(f"""WITH h AS ({HAIRPIN_NODES}), e AS ({HAIRPIN_EDGES}), s AS (SELECT graph, n, min(pos) AS t FROM h WHERE NOT ({WATSON} AND {AFTER}) GROUP BY graph, n)
SELECT e.graph, src, dst, label FROM e JOIN s ON s.graph = e.graph WHERE src BETWEEN t AND n + 1 - t AND dst BETWEEN t AND n + 1 - t""")
def stack_trim(spark: SparkSession, d: str) -> DataFrame:
    return D.stack_trim(A.hairpin_edges(spark, d))


TRIMMED = f"""WITH h AS ({HAIRPIN_NODES}), e AS ({HAIRPIN_EDGES}), s AS (SELECT graph, n, min(pos) AS t FROM h WHERE {PAIRED} GROUP BY graph, n)"""


@query(f"{TRIMMED} SELECT DISTINCT e.graph, least(src, dst) AS src, greatest(src, dst) AS dst FROM e JOIN s ON s.graph = e.graph WHERE src BETWEEN t AND n + 1 - t AND dst BETWEEN t AND n + 1 - t")
def hairpin_trim(spark: SparkSession, d: str) -> DataFrame:
    """Loose ends of hairpins are trimmed back to the outermost pair."""
    return D.dangle_trim(A.hairpin_edges(spark, d))


@query(f"""WITH h AS ({HAIRPIN_NODES}), e AS ({HAIRPIN_EDGES}), m AS (SELECT graph, pos AS node FROM h WHERE pos % 5 <> 0),
p AS (SELECT DISTINCT e.graph, src, dst FROM e JOIN m a ON a.graph = e.graph AND a.node = src JOIN m b ON b.graph = e.graph AND b.node = dst),
l AS (SELECT graph, src AS node FROM p GROUP BY graph, src HAVING count(*) = 1)
SELECT graph, node FROM m UNION SELECT e.graph, e.dst FROM e JOIN l ON l.graph = e.graph AND l.node = e.src""")
def gap_fill(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth residue is missing; those with one neighbour left get theirs back."""
    return D.gap_fill(A.hairpin_edges(spark, d), A.hairpin_nodes(spark, d).where("pos % 5 <> 0"))


@query(f"""WITH h AS ({HAIRPIN_NODES}), p AS (SELECT graph, pos, n FROM h WHERE {PAIRED}),
b AS (SELECT graph, n, min(pos) FILTER (pos >= 4) AS own, max(CASE WHEN pos = 4 THEN 1 ELSE 0 END) AS four, max(CASE WHEN pos = 3 THEN 1 ELSE 0 END) AS three FROM p GROUP BY graph, n),
c AS (SELECT graph, n, CASE WHEN four = 0 AND three = 1 THEN 3 ELSE own END AS t FROM b WHERE n >= 12)
SELECT h.graph, h.pos AS node FROM h JOIN c ON c.graph = h.graph WHERE t IS NOT NULL AND c.n + 2 - 2 * t >= 8 AND h.pos BETWEEN t AND c.n + 1 - t""")
def clean_parts(spark: SparkSession, d: str) -> DataFrame:
    """Hairpins cut at both ends: gaps filled, loose ends trimmed, islands below eight residues dropped."""
    inner = A.hairpin_nodes(spark, d).where("pos > 3 and pos <= n - 3 and n >= 12")
    return D.clean_parts(A.hairpin_edges(spark, d), inner, 8)


@query(f"""WITH h AS ({HAIRPIN_NODES}), m AS (SELECT graph, pos FROM h WHERE pos % 9 <> 0), i AS (SELECT graph, pos, pos // 9 AS island, count(*) OVER (PARTITION BY graph, pos // 9) AS n FROM m)
SELECT graph, pos AS src, pos + 1 AS dst FROM i x WHERE n >= 8 AND EXISTS (SELECT 1 FROM i y WHERE y.graph = x.graph AND y.pos = x.pos + 1 AND y.island = x.island)""")
def without_islands(spark: SparkSession, d: str) -> DataFrame:
    """Chains without every ninth residue fall into islands; those below eight residues go."""
    kept = A.hairpin_nodes(spark, d).where("pos % 9 <> 0")
    chain = A.hairpin_edges(spark, d).where("label = 'B35'").select("graph", "src", "dst")
    return D.without_islands(E.induced(chain, kept), 8).select("graph", "src", "dst")


@query()
def odd_part(spark: SparkSession, d: str) -> DataFrame:
    return D.odd_part(A.hairpin_edges(spark, d), A.hairpin_nodes(spark, d), 1, 4)


# --- predicates

INSIDE = f"""{BALL}, i AS (SELECT a.graph, a.root, bool_or(upper(l.label) NOT IN ('B53', 'B35', 'CWW')) AS has_nc FROM ({A.CONV_EDGES}) l JOIN ball a ON a.graph = l.graph AND a.node = l.src
JOIN ball b ON b.graph = l.graph AND b.root = a.root AND b.node = l.dst GROUP BY a.graph, a.root)"""


@query(f"{INSIDE} SELECT r.graph, r.root, coalesce(has_nc, false) AS has_nc FROM roots r LEFT JOIN i ON i.graph = r.graph AND i.root = r.root")
def odd_within(spark: SparkSession, d: str) -> DataFrame:
    return H.odd_within(A.conv_edges(spark, d), _roots(spark, d), 2)


@query(f"""{INSIDE}, u AS (SELECT DISTINCT graph, src, dst FROM ({A.CONV_EDGES})), g AS (SELECT graph, src AS node FROM u GROUP BY graph, src HAVING count(*) = 2)
SELECT graph, node FROM g UNION SELECT graph, root FROM i WHERE has_nc""")
def odd_or_loop_nodes(spark: SparkSession, d: str) -> DataFrame:
    return H.odd_or_loop_nodes(A.conv_edges(spark, d), A.conv_nodes(spark, d), 2)


@query(f"""WITH e AS ({A.CONV_EDGES}), o AS (SELECT graph, src AS node FROM e WHERE upper(label) NOT IN ('B53', 'B35', 'CWW') GROUP BY graph, src HAVING count(DISTINCT dst) BETWEEN 1 AND 2)
SELECT e.graph, e.src, e.dst, e.label, label <> 'cWW' AND a.node IS NOT NULL AND b.node IS NOT NULL AS stem FROM e
LEFT JOIN o a ON a.graph = e.graph AND a.node = e.src LEFT JOIN o b ON b.graph = e.graph AND b.node = e.dst""")
def stem_edges(spark: SparkSession, d: str) -> DataFrame:
    return H.stem_edges(A.conv_edges(spark, d))


@query(f"SELECT graph, bool_or(upper(label) NOT IN ('B53', 'B35', 'CWW')) AS has_nc FROM ({A.CONV_EDGES}) GROUP BY graph")
def has_noncanonical(spark: SparkSession, d: str) -> DataFrame:
    return E.has_noncanonical(A.conv_edges(spark, d))


@query("SELECT p_partkey, split_part(p_type, ' ', 1) <> 'PROMO' AND p_brand LIKE '%D%' AS dna FROM (SELECT p_partkey, p_type, upper(p_type) AS p_brand FROM part)")
def dna_residues(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    group = F.when(F.split_part("p_type", F.lit(" "), F.lit(1)) == "PROMO", "HETATM").otherwise("ATOM")
    return p.select("p_partkey", H.is_dna(F.upper("p_type"), group).alias("dna"))


@query(f"""WITH e AS (SELECT DISTINCT graph, src, dst, upper(label) NOT IN ('B53', 'B35', 'CWW') AS odd FROM ({A.CONV_EDGES})), roots AS (SELECT conv_id AS graph, turn AS root FROM conversations WHERE role = 'user'),
a1 AS (SELECT DISTINCT r.graph, r.root, e.dst AS node FROM roots r JOIN e ON e.graph = r.graph AND e.src = r.root WHERE e.dst <> r.root),
g1 AS (SELECT DISTINCT r.graph, r.root FROM roots r JOIN e ON e.graph = r.graph AND e.src = r.root WHERE odd),
a2 AS (SELECT DISTINCT x.graph, x.root, e.dst AS node FROM a1 x JOIN g1 ON g1.graph = x.graph AND g1.root = x.root JOIN e ON e.graph = x.graph AND e.src = x.node)
SELECT graph, root, root AS node, 0 AS hop FROM roots UNION ALL SELECT graph, root, node, 1 FROM a1
UNION ALL SELECT graph, root, node, 2 FROM a2 WHERE node <> root AND NOT EXISTS (SELECT 1 FROM a1 x WHERE x.graph = a2.graph AND x.root = a2.root AND x.node = a2.node)""")
def ball_until_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Walks of user turns that end at a hop whose edges are all canonical."""
    roots = A.conv_nodes(spark, d).where("code = 'user'").select("graph", F.col("node").alias("root"))
    return T.ball_until_canonical(A.conv_edges(spark, d), roots, 2)


# --- rewrites


@query(f"SELECT graph, src, dst, label FROM ({A.CONV_EDGES}) WHERE label IN ('B53', 'cWW', 'tHS')")
def known_edges(spark: SparkSession, d: str) -> DataFrame:
    return E.known_edges(A.conv_edges(spark, d), ("B53", "cWW", "tHS"))


@query("SELECT l_orderkey AS graph, l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_partkey <> l_suppkey")
def no_self_loops(spark: SparkSession, d: str) -> DataFrame:
    return E.no_self_loops(A.order_edges(spark, d)).select("graph", "src", "dst")


@query(f"""SELECT graph, src, dst, label, CAST(CASE label WHEN 'B53' THEN 0 WHEN 'cSW' THEN 6 WHEN 'cWS' THEN 8 WHEN 'cWW' THEN 9 WHEN 'tHS' THEN 11 WHEN 'tSH' THEN 13 WHEN 'B35' THEN 19 END AS INTEGER) AS code FROM ({A.CONV_EDGES})""")
def encode_labels(spark: SparkSession, d: str) -> DataFrame:
    return E.encode_labels(A.conv_edges(spark, d))


@query(f"WITH e AS ({A.CONV_EDGES}) SELECT DISTINCT graph, dst AS src, src AS dst, CASE label WHEN 'B53' THEN 'B35' WHEN 'B35' THEN 'B53' ELSE label[1] || label[3] || label[2] END AS label FROM e")
def flipped_edges(spark: SparkSession, d: str) -> DataFrame:
    e = A.conv_edges(spark, d)
    return e.select("graph", F.col("dst").alias("src"), F.col("src").alias("dst"), E.flipped(F.col("label")).alias("label")).distinct()


@query(f"WITH e AS ({A.CONV_EDGES}) SELECT graph, node, count(*) AS degree FROM (SELECT graph, src AS node FROM e UNION ALL SELECT graph, dst FROM e) GROUP BY graph, node")
def degrees(spark: SparkSession, d: str) -> DataFrame:
    return E.degrees(A.conv_edges(spark, d))


@query(f"""WITH e AS ({A.CONV_EDGES}), m AS (SELECT conv_id AS graph, turn AS node FROM conversations WHERE turn % 3 <> 0)
SELECT e.graph, e.src, e.dst, e.label FROM e JOIN m a ON a.graph = e.graph AND a.node = e.src JOIN m b ON b.graph = e.graph AND b.node = e.dst""")
def induced_subgraph(spark: SparkSession, d: str) -> DataFrame:
    return E.induced(A.conv_edges(spark, d), A.conv_nodes(spark, d).where("node % 3 <> 0"))


@query(f"WITH n AS ({A.CONV_NODES}) SELECT graph, node, CAST(row_number() OVER (PARTITION BY graph ORDER BY CAST(node AS VARCHAR)) - 1 AS BIGINT) AS index FROM n")
def node_order(spark: SparkSession, d: str) -> DataFrame:
    from lattisca.operators.represent import node_index

    return node_index(A.conv_nodes(spark, d)).select("graph", "node", "index")


@query("SELECT l_orderkey AS graph, min(l_partkey) AS node FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 2 GROUP BY l_orderkey")
def find_node(spark: SparkSession, d: str) -> DataFrame:
    from lattisca.sources.structures import find_node as find

    nodes = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("graph"), F.col("l_partkey").alias("node"), F.col("l_returnflag").alias("chain"), F.col("l_linenumber").alias("pos"))
    return find(nodes, "R", 2)


# --- partitions


@query(f"""WITH n AS ({A.EVENT_NODES}), g AS (SELECT * FROM (VALUES ('click-view'), ('error'), ('purchase-error')) AS t(part))
SELECT graph, node, part FROM n JOIN g ON list_contains(string_split(part, '-'), chain)""")
def chain_groups(spark: SparkSession, d: str) -> DataFrame:
    nodes = A.event_nodes(spark, d)
    names = F.explode(F.array(*[F.lit(x) for x in ("click-view", "error", "purchase-error")])).alias("chains")
    return P.by_groups(nodes, nodes.select("graph").distinct().select("graph", names))


@query("SELECT user_id AS graph, event_type AS chain, count(*) AS n FROM events GROUP BY user_id, event_type HAVING count(*) BETWEEN 10 AND 15")
def chains_of_size(spark: SparkSession, d: str) -> DataFrame:
    return P.chains_of_size(A.event_nodes(spark, d), 10, 15)


# --- pockets

SEEDS = "SELECT conv_id AS graph, role AS pocket, turn AS node FROM conversations WHERE turn % 4 = 1"


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    return A.conv_nodes(spark, d).where("node % 4 = 1").select("graph", F.col("code").alias("pocket"), "node")


@query(f"""WITH RECURSIVE e AS (SELECT DISTINCT graph, src, dst FROM ({A.CONV_EDGES})), s AS ({SEEDS}),
w(graph, pocket, node, hop) AS (SELECT graph, pocket, node, 0 FROM s UNION SELECT w.graph, w.pocket, e.dst, w.hop + 1 FROM w JOIN e ON e.graph = w.graph AND e.src = w.node WHERE w.hop < 2),
b AS (SELECT graph, pocket, node, min(hop) AS hop FROM w GROUP BY graph, pocket, node), n AS (SELECT graph, pocket, count(*) FILTER (hop <= 1) AS n FROM b GROUP BY graph, pocket)
SELECT b.graph, b.pocket, b.node FROM b JOIN n ON n.graph = b.graph AND n.pocket = b.pocket WHERE hop <= 1 OR n.n < 4""")
def grow_pockets(spark: SparkSession, d: str) -> DataFrame:
    """Pockets of the first turn and every fourth one after it; those below four residues grow once more."""
    return O.grow_pockets(A.conv_edges(spark, d), _seeds(spark, d), 4, 1, 1)


@query(f"""WITH s AS ({SEEDS}), m AS (SELECT s.graph, s.pocket FROM s JOIN ({A.CONV_NODES}) n ON n.graph = s.graph AND n.node = s.node GROUP BY s.graph, s.pocket HAVING avg(n.size) < 300)
SELECT s.graph, s.pocket, s.node FROM s JOIN m ON m.graph = s.graph AND m.pocket = s.pocket""")
def pockets_by_content(spark: SparkSession, d: str) -> DataFrame:
    return O.by_content(_seeds(spark, d), A.conv_nodes(spark, d), "size", 300)


@query(f"""WITH s AS (SELECT DISTINCT graph, node FROM ({SEEDS})), n AS ({A.CONV_NODES}), f AS (SELECT n.graph, n.node, s.node IS NOT NULL AS f FROM n LEFT JOIN s ON s.graph = n.graph AND s.node = n.node)
SELECT graph, string_agg(CAST(CAST(f AS INTEGER) AS VARCHAR), ',' ORDER BY CAST(node AS VARCHAR)) AS flags FROM f GROUP BY graph""")
def pocket_flags(spark: SparkSession, d: str) -> DataFrame:
    flags = O.pocket_flags(O.in_pocket(A.conv_nodes(spark, d), _seeds(spark, d)))
    return flags.select("graph", F.array_join(F.col("in_pocket").cast("array<string>"), ",").alias("flags"))


def _u(key: str, seed: int) -> str:
    return f"CAST(('0x' || substr(md5(CAST({key} AS VARCHAR) || '|{seed}'), 1, 8)) AS BIGINT) / 4294967296.0"


@query(f"""WITH g AS (SELECT o_custkey AS pocket, list(o_orderkey ORDER BY o_orderkey) FILTER (o_orderstatus = 'F') AS a, list(o_orderkey ORDER BY o_orderkey) FILTER (o_orderstatus <> 'F') AS b FROM orders GROUP BY o_custkey),
h AS (SELECT *, (({_u('pocket', 5)}) > 0.5 AND coalesce(len(a), 0) > 0) OR coalesce(len(b), 0) = 0 AS active FROM g), l AS (SELECT *, CASE WHEN active THEN a ELSE b END AS held FROM h)
SELECT pocket, held[CAST(floor({_u('pocket', 6)} * len(held)) AS INTEGER) + 1] AS ligand, active FROM l""")
def sampled_pairs(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    f = F.col("o_orderstatus") == "F"
    some = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("o_orderkey"))))
    groups = orders.groupBy(F.col("o_custkey").alias("pocket")).agg(some(f).alias("actives"), some(~f).alias("decoys"))
    return O.sampled_pairs(groups, "pocket", 5)


NEG = "graph || '|' || src || '|' || dst || '|' || k"


@query(f"""WITH n AS ({A.CONV_NODES}), e AS (SELECT DISTINCT graph, src, dst FROM ({A.CONV_EDGES})), p AS (SELECT DISTINCT graph, src, dst FROM ({A.CONV_EDGES}) WHERE label NOT IN ('B53', 'B35')),
a AS (SELECT graph, list(node ORDER BY node) AS nodes FROM n GROUP BY graph), d AS (SELECT p.graph, src, a.nodes[CAST(floor({_u(NEG.replace('graph', 'p.graph'), 3)} * len(a.nodes)) AS INTEGER) + 1] AS dst FROM p, (SELECT unnest([1, 2]) AS k) k, a WHERE a.graph = p.graph)
SELECT DISTINCT graph, src, dst FROM d WHERE src <> dst AND NOT EXISTS (SELECT 1 FROM e WHERE e.graph = d.graph AND e.src = d.src AND e.dst = d.dst)""")
def negative_edges(spark: SparkSession, d: str) -> DataFrame:
    edges = A.conv_edges(spark, d)
    return O.negative_edges(A.conv_nodes(spark, d), O.base_pairs(edges), edges, 2, 3)


@query(f"SELECT DISTINCT o_custkey AS pocket, CASE WHEN {_u('o_custkey', 9)} < 0.9 THEN 'train' ELSE 'val' END AS split FROM orders")
def screening_split(spark: SparkSession, d: str) -> DataFrame:
    from lattisca.tasks import screening_split as cut

    return cut(table(spark, d, "orders").select(F.col("o_custkey").alias("pocket")).distinct(), "pocket", 9)


# --- hashes of balls


def _step(before: str) -> str:
    return f"""(SELECT n.g, n.node, md5(n.wl || '|' || coalesce((SELECT string_agg(i.label || o.wl, ',' ORDER BY i.label || o.wl) FROM i JOIN {before} o ON o.g = i.g AND o.node = i.dst WHERE i.g = n.g AND i.src = n.node), '')) AS wl FROM {before} n)"""


HASHES = f"""WITH e AS ({A.CONV_EDGES}), roots AS (SELECT conv_id AS graph, turn AS root FROM conversations), u AS (SELECT DISTINCT graph, src, dst FROM e),
m AS (SELECT graph, root, root AS node FROM roots UNION SELECT r.graph, r.root, u.dst FROM roots r JOIN u ON u.graph = r.graph AND u.src = r.root),
i AS MATERIALIZED (SELECT a.graph || '|' || a.root AS g, e.src, e.dst, e.label FROM e JOIN m a ON a.graph = e.graph AND a.node = e.src JOIN m b ON b.graph = e.graph AND b.root = a.root AND b.node = e.dst),
w0 AS MATERIALIZED (SELECT graph || '|' || root AS g, graph, root, node, md5('') AS wl FROM m), w1 AS MATERIALIZED {_step('w0')}, w2 AS MATERIALIZED {_step('w1')},
b AS (SELECT g, substr(md5(string_agg(wl, ',' ORDER BY wl)), 1, 16) AS hash FROM w2 GROUP BY g), h AS (SELECT graph, root, hash FROM b JOIN (SELECT DISTINCT g, graph, root FROM w0) USING (g))"""


def _hashes(spark: SparkSession, d: str) -> DataFrame:
    return T.ball_hashes(A.conv_edges(spark, d), _roots(spark, d), 1, 2, width=16)


@query(f"{HASHES} SELECT graph, root, hash FROM h")
def ball_hashes(spark: SparkSession, d: str) -> DataFrame:
    """The hash of each turn's ball, of sixteen digits."""
    return _hashes(spark, d)


@query(f"{HASHES}, f AS (SELECT hash, graph, root, count(*) OVER (PARTITION BY hash) AS n, row_number() OVER (PARTITION BY hash ORDER BY graph, root) AS r FROM h) SELECT hash, n, graph AS first_graph, root AS first_root FROM f WHERE r = 1")
def ball_table(spark: SparkSession, d: str) -> DataFrame:
    t = T.hash_table(_hashes(spark, d))
    return t.select("hash", "n", F.col("first.graph").alias("first_graph"), F.col("first.root").alias("first_root"))


@query(f"{HASHES} SELECT DISTINCT hash FROM h WHERE hash NOT IN (SELECT hash FROM h WHERE graph IN (SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) <= 4))")
def missing_hashes(spark: SparkSession, d: str) -> DataFrame:
    """The hashes that a table built from conversations of up to four turns lacks."""
    found = _hashes(spark, d)
    short = L.by_size(A.conv_nodes(spark, d), 0, 5).select("graph")
    return T.missing_hashes(found, T.hash_table(found.join(short, "graph", "left_semi")))


# --- filters in combination, splits


@query(f"""WITH n AS ({A.CONV_NODES}) SELECT graph FROM n GROUP BY graph HAVING count(*) > 2 AND count(*) < 7 AND avg(size) < 550 AND count(*) FILTER (code = 'user') >= 2""")
def combined_filters(spark: SparkSession, d: str) -> DataFrame:
    nodes = A.conv_nodes(spark, d)
    passing = [L.by_size(nodes, 2, 7), L.by_aggregate(nodes, F.avg("size"), F.col("agg") < 550), L.by_residues(nodes, F.col("code") == "user", 2)]
    return L.all_of(nodes.select("graph").distinct(), passing)


@query("SELECT o_orderkey AS graph, o_totalprice FROM orders WHERE o_orderpriority IS NOT NULL AND o_orderstatus = 'F' AND o_totalprice > 100000")
def attribute_filter(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "orders").select(F.col("o_orderkey").alias("graph"), "o_totalprice", "o_orderstatus", "o_orderpriority")
    return L.by_attribute(g, F.col("o_orderpriority").isNotNull() & (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 100_000)).select("graph", "o_totalprice")


@query(f"""WITH n AS ({A.CONV_NODES}), e AS ({A.CONV_EDGES}), m AS (SELECT graph, node, CASE WHEN node % 2 = 1 THEN 'odd' ELSE 'even' END AS part FROM n)
SELECT graph || '_' || part AS graph, count(*) AS nodes, coalesce(max(k), 0) AS edges FROM m LEFT JOIN (SELECT e.graph AS g, a.part AS p, count(*) AS k FROM e JOIN m a ON a.graph = e.graph AND a.node = e.src JOIN m b ON b.graph = e.graph AND b.node = e.dst AND b.part = a.part GROUP BY e.graph, a.part)
ON g = graph AND p = part GROUP BY graph, part""")
def partitioned(spark: SparkSession, d: str) -> DataFrame:
    """Conversations become their odd and their even turns."""
    from lattisca.model import GraphCollection

    nodes = A.conv_nodes(spark, d)
    part = F.when(F.col("node") % 2 == 1, "odd").otherwise("even")
    c = GraphCollection.of(nodes, A.conv_edges(spark, d)).partition(nodes.select("graph", "node", part.alias("part")))
    sizes = c.nodes.groupBy("graph").agg(F.count(F.lit(1)).alias("nodes"))
    return sizes.join(c.edges.groupBy("graph").agg(F.count(F.lit(1)).alias("edges")), "graph", "left").na.fill({"edges": 0})


@query("SELECT doc_id, split FROM (VALUES (3, 'train'), (10, 'train'), (20, 'val'), (7, 'test')) AS l(doc_id, split) WHERE doc_id IN (SELECT doc_id FROM documents)")
def published_split(spark: SparkSession, d: str) -> DataFrame:
    """Fixed lists of names, those that exist."""
    lists = spark.createDataFrame([("3", "train"), ("10", "train"), ("20", "val"), ("7", "test"), ("-1", "test")], "name string, split string")
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("name"))
    return X.name_split(rows, "name", lists).select(F.col("name").cast("int").alias("doc_id"), "split")


# --- rings of nodes and graphlets, edge features, legacy graphs


UBALL = f"""WITH e AS (SELECT DISTINCT graph, src, dst FROM ({A.CONV_EDGES})), roots AS (SELECT conv_id AS graph, turn AS root FROM conversations),
h1 AS (SELECT r.graph, r.root, e.dst AS node, 1 AS hop FROM roots r JOIN e ON e.graph = r.graph AND e.src = r.root),
h2 AS (SELECT DISTINCT h1.graph, h1.root, e.dst AS node, 2 AS hop FROM h1 JOIN e ON e.graph = h1.graph AND e.src = h1.node),
ball AS (SELECT graph, root, node, min(hop) AS hop FROM (SELECT graph, root, root AS node, 0 AS hop FROM roots UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY graph, root, node)"""


@query(f"{UBALL} SELECT graph, root, hop, string_agg(CAST(node AS VARCHAR), ',' ORDER BY node) AS nodes FROM ball GROUP BY graph, root, hop")
def node_rings(spark: SparkSession, d: str) -> DataFrame:
    rings = T.node_rings(A.conv_edges(spark, d), _roots(spark, d), 2)
    return rings.withColumn("nodes", F.array_join(F.col("nodes").cast("array<string>"), ","))


@query(f"""{HASHES}, x1 AS (SELECT r.graph, r.root, u.dst AS node, 1 AS hop FROM roots r JOIN u ON u.graph = r.graph AND u.src = r.root),
ball AS (SELECT graph, root, root AS node, 0 AS hop FROM roots UNION ALL SELECT * FROM x1 WHERE node <> root)
SELECT b.graph, b.root, b.hop, string_agg(h.hash, ',' ORDER BY h.hash) AS hashes FROM ball b JOIN h ON h.graph = b.graph AND h.root = b.node GROUP BY b.graph, b.root, b.hop""")
def graphlet_rings(spark: SparkSession, d: str) -> DataFrame:
    rings = T.graphlet_rings(A.conv_edges(spark, d), _roots(spark, d), _hashes(spark, d), 1)
    return rings.withColumn("hashes", F.array_join("hashes", ","))


@query(f"""WITH e AS ({A.CONV_EDGES}), k AS (SELECT graph, least(src, dst) AS src, greatest(src, dst) AS dst, CASE label WHEN 'B35' THEN 'B53' ELSE label END AS label FROM e)
SELECT graph, src, dst, min(label) AS label FROM k GROUP BY graph, src, dst""")
def legacy_graph(spark: SparkSession, d: str) -> DataFrame:
    return E.legacy_graph(A.conv_nodes(spark, d), A.conv_edges(spark, d), ["code"])[1]


@query(f"SELECT graph, src, dst, CAST(CASE label WHEN 'B53' THEN 0 WHEN 'cSW' THEN 6 WHEN 'cWS' THEN 8 WHEN 'cWW' THEN 9 WHEN 'tHS' THEN 11 WHEN 'tSH' THEN 13 ELSE 19 END AS INTEGER) AS slot FROM ({A.CONV_EDGES})")
def encode_edges(spark: SparkSession, d: str) -> DataFrame:
    from lattisca.functions.encoders import FeaturesComputer

    edges = FeaturesComputer().compute_edges(A.conv_edges(spark, d))
    return edges.select("graph", "src", "dst", (F.array_position("features", F.lit(1.0).cast("float")) - 1).cast("int").alias("slot"))


@query("""WITH n AS (SELECT o_custkey AS graph, CASE WHEN o_orderstatus <> 'P' THEN 'L' || (o_orderkey % 7) END AS ligand FROM orders), s AS (SELECT 'L' || k AS ligand, 'C' || k AS smiles FROM (SELECT unnest([0, 1, 2, 4, 5]) AS k)),
b AS (SELECT DISTINCT n.graph, n.ligand, s.smiles FROM n JOIN s ON s.ligand = n.ligand) SELECT graph, string_agg(ligand || '=' || smiles, ',' ORDER BY ligand) AS smiles FROM b GROUP BY graph""")
def ligand_smiles(spark: SparkSession, d: str) -> DataFrame:
    from lattisca.operators import annotate as U

    ligand = F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("L"), (F.col("o_orderkey") % 7).cast("string")))
    nodes = table(spark, d, "orders").select(F.col("o_custkey").alias("graph"), ligand.alias("ligand"))
    smiles = spark.createDataFrame([(f"L{k}", f"C{k}") for k in (0, 1, 2, 4, 5)], "ligand string, smiles string")
    found = U.ligand_smiles(nodes, "ligand", smiles)
    return found.select("graph", F.array_join(F.transform(F.map_entries("ligand_to_smiles"), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",").alias("smiles"))


@query("""WITH m AS (SELECT DISTINCT l_orderkey AS id, CAST(l_partkey % 90 AS VARCHAR) AS item FROM lineitem), s AS (SELECT id, count(*) AS n FROM m GROUP BY id),
c AS (SELECT a.id AS i, b.id AS j, count(*) AS common FROM m a JOIN m b ON a.item = b.item AND a.id < b.id GROUP BY a.id, b.id)
SELECT i, j, round(common / (x.n + y.n - common), 6) AS similarity FROM c JOIN s x ON x.id = i JOIN s y ON y.id = j WHERE common / (x.n + y.n - common) >= 0.75""")
def similar_sets(spark: SparkSession, d: str) -> DataFrame:
    """Orders with much the same shelves, through an index of combinations of their rarest items."""
    from lattisca.operators import similarity as M

    m = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_partkey") % 90).cast("string").alias("item"))
    return M.similar_sets(m, 0.75, digits=6)


@query("""WITH p AS (SELECT conv_id AS graph, a.turn AS a, b.turn AS b, 1.0 / (1 + b.turn - a.turn) AS s FROM conversations a JOIN conversations b USING (conv_id) WHERE a.turn < b.turn AND (a.turn + b.turn) % 3 <> 0),
n AS (SELECT conv_id AS graph, turn AS x FROM conversations), c AS (SELECT n.graph, n.x, m.x AS y, CASE WHEN n.x = m.x THEN 1.0 ELSE coalesce(p.s, 0) END AS v FROM n JOIN n m ON m.graph = n.graph LEFT JOIN p ON p.graph = n.graph AND p.a = least(n.x, m.x) AND p.b = greatest(n.x, m.x))
SELECT graph, CAST(x AS INTEGER) AS name, round(sum(v * (y + 1)), 6) AS total FROM c GROUP BY graph, x""")
def square_matrices(spark: SparkSession, d: str) -> DataFrame:
    """Similarities of turns as squares; a row's sum tells its entries and their places."""
    from lattisca.operators import kernels as N

    t = _roots(spark, d)
    both = t.select("graph", F.col("root").alias("a")).join(t.select("graph", F.col("root").alias("b")), "graph").where("a < b and (a + b) % 3 <> 0")
    squares = N.square_matrices(both.withColumn("similarity", 1.0 / (1 + F.col("b") - F.col("a"))), t)
    rows = squares.select("graph", "names", F.posexplode("matrix").alias("at", "row"))
    total = F.aggregate(F.zip_with("row", "names", lambda v, n: v * (n + 1)), F.lit(0.0), lambda s, v: s + v)
    return rows.select("graph", F.get("names", F.col("at")).cast("int").alias("name"), F.round(total, 6).alias("total"))
