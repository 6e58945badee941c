"""Aggregates, traversal, sequences, similarity and splits over the adapters' graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattisca.catalog import query
from lattisca.operators import aggregate as G
from lattisca.operators import clean as D
from lattisca.operators import edges as E
from lattisca.operators import filters as L
from lattisca.operators import labels as B
from lattisca.operators import pockets as O
from lattisca.operators import sequence as Q
from lattisca.operators import similarity as M
from lattisca.operators import split as X
from lattisca.operators import traverse as T
from lattisca.sources import adapters as A
from lattisca.sources.adapters import table

BB = "('B53', 'B35')"


# --- aggregates


@query("""SELECT 'type' AS field, event_type AS value, count(*) AS n FROM events GROUP BY event_type
UNION ALL SELECT 'k', json_extract_string(props, '$.k'), count(*) FROM events GROUP BY 2""")
def value_counts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_type").alias("type"), F.get_json_object("props", "$.k").alias("k"))
    return G.value_counts(e, ["type", "k"])


@query("SELECT user_id AS graph, event_type AS value, count(*) AS n FROM events GROUP BY user_id, event_type")
def graph_index(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("graph"), "event_type")
    return G.graph_index(e, ["event_type"]).select("graph", "value", "n")


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY ROLLUP (source, lang)")
def label_counter(spark: SparkSession, d: str) -> DataFrame:
    return G.label_counts(table(spark, d, "documents"), "source", "lang")


@query("""SELECT 'quality' AS label, CAST(quality AS BIGINT) AS class, count(*) AS n FROM labels GROUP BY quality UNION ALL SELECT 'toxic', CAST(toxic AS BIGINT), count(*) FROM labels GROUP BY toxic""")
def describe(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").select(F.col("quality").cast("long").alias("quality"), F.col("toxic").cast("long").alias("toxic"))
    return G.value_counts(labels, ["quality", "toxic"], field="label", value="class")


@query("""WITH s AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) SELECT min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean, CAST(median(n) AS DOUBLE) AS median FROM s""")
def length_stats(spark: SparkSession, d: str) -> DataFrame:
    s = G.length_stats(table(spark, d, "events").select(F.col("user_id").alias("graph")))
    return s.select("least", "most", F.round("mean", 6).alias("mean"), "median")


@query("""WITH n AS (SELECT count(DISTINCT user_id) AS total FROM events) SELECT event_type AS label, round(ln(max(total) / count(DISTINCT user_id) + 1), 6) AS idf FROM events JOIN n ON true GROUP BY event_type""")
def edge_idf(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("graph"), F.col("event_type").alias("label"))
    return G.label_idf(e).select("label", F.round("idf", 6).alias("idf"))


@query("SELECT p_type AS term, count(*) AS n FROM part GROUP BY p_type HAVING count(*) > 5 AND count(*) < 100000")
def freq_cut(spark: SparkSession, d: str) -> DataFrame:
    return B.frequent(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("term")), 5, 100_000)


@query("SELECT round(corr(CAST(quality AS DOUBLE), CAST(toxic AS DOUBLE)), 6) AS quality_toxic FROM labels")
def label_corr(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels")
    return labels.agg(F.round(G.correlation(labels, "quality", "toxic"), 6).alias("quality_toxic"))


@query("SELECT md5(text) AS hash, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY md5(text)")
def hash_table(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.md5("text").alias("hash"), F.lit(0).alias("graph"), F.col("doc_id").alias("root"))
    return T.hash_table(docs).select("hash", "n", F.col("first.root").alias("first"))


@query("SELECT round(sqrt(count(*) FILTER (toxic = 0) / count(*) FILTER (toxic = 1)), 6) AS weight FROM labels")
def pos_weight(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").agg(F.round(G.positive_weight(F.col("toxic")), 6).alias("weight"))


@query("SELECT quality, count(*) AS n, round(1.0 / count(*), 9) AS weight FROM labels GROUP BY quality")
def class_weights(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels")
    counts = labels.groupBy("quality").agg(F.count(F.lit(1)).alias("n"))
    return B.class_weights(labels, "quality").join(counts, "quality").select("quality", "n", F.round("weight", 9).alias("weight"))


@query(f"""WITH e AS ({A.CONV_EDGES}), p AS (SELECT graph % 2 = 0 AS pocket, label, count(*) AS n FROM e WHERE label NOT IN {BB} GROUP BY 1, 2)
SELECT pocket, label, n, round(n / sum(n) OVER (PARTITION BY pocket), 6) AS share FROM p""")
def enrichment(spark: SparkSession, d: str) -> DataFrame:
    e = O.base_pairs(A.conv_edges(spark, d)).select((F.col("graph") % 2 == 0).alias("pocket"), "label")
    return G.shares(e, "pocket", "label").withColumn("share", F.round("share", 6))


@query(f"""WITH n AS ({A.CONV_NODES}), s AS (SELECT graph, count(*) AS n FROM n GROUP BY graph) SELECT (SELECT round(avg(CASE WHEN code = 'user' THEN 1.0 ELSE 0.0 END), 6) FROM n) AS fraction,
(SELECT count(DISTINCT label) FROM ({A.CONV_EDGES})) AS edge_labels, max(n) AS most, round(avg(n), 6) AS mean FROM s""")
def label_summary(spark: SparkSession, d: str) -> DataFrame:
    nodes = A.conv_nodes(spark, d).withColumn("bound", (F.col("code") == "user").cast("int"))
    s = G.label_summary(nodes, A.conv_edges(spark, d), "bound")
    return s.select(F.round("fraction", 6).alias("fraction"), "edge_labels", "most", F.round("mean", 6).alias("mean"))


@query(f"""WITH n AS ({A.CONV_NODES}), e AS ({A.CONV_EDGES}), s0 AS (SELECT graph, src AS node, CAST(count(*) AS DOUBLE) AS w FROM e WHERE NOT (upper(label) IN ('B53','B35','CWW')) GROUP BY graph, src),
s1 AS (SELECT e.graph, e.src AS node, sum(w) AS w FROM e JOIN s0 ON e.graph = s0.graph AND e.dst = s0.node GROUP BY e.graph, e.src),
s2 AS (SELECT e.graph, e.src AS node, sum(w) AS w FROM e JOIN s1 ON e.graph = s1.graph AND e.dst = s1.node GROUP BY e.graph, e.src),
v AS (SELECT graph, node, least(sum(w), 1.0) AS v FROM (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2) GROUP BY graph, node),
a AS (SELECT n.graph, n.node, coalesce(v, 0.0) AS v FROM n LEFT JOIN v ON n.graph = v.graph AND n.node = v.node)
SELECT graph, node, round(v / (avg(v) OVER (PARTITION BY graph) + 0.005) + 1, 6) AS weight FROM a""")
def nc_weight(spark: SparkSession, d: str) -> DataFrame:
    w = T.walk_weights(A.conv_edges(spark, d), A.conv_nodes(spark, d))
    return w.select("graph", "node", F.round("weight", 6).alias("weight"))


# --- traversal


BALL = f"""WITH RECURSIVE e AS (SELECT DISTINCT graph, src, dst FROM ({A.CONV_EDGES})), roots AS (SELECT conv_id AS graph, turn AS root FROM conversations),
w(graph, root, node, hop) AS (SELECT graph, root, root, 0 FROM roots UNION SELECT w.graph, w.root, e.dst, w.hop + 1 FROM w JOIN e ON w.graph = e.graph AND w.node = e.src WHERE w.hop < 2),
ball AS (SELECT graph, root, node, min(hop) AS hop FROM w GROUP BY graph, root, node)"""


def _roots(spark: SparkSession, d: str) -> DataFrame:
    return A.conv_nodes(spark, d).select("graph", F.col("node").alias("root"))


@query(f"{BALL} SELECT graph, root, node, hop FROM ball")
def bfs_ball(spark: SparkSession, d: str) -> DataFrame:
    return T.ball(A.conv_edges(spark, d), _roots(spark, d), 2)


@query(f"""{BALL} SELECT a.graph, a.root, l.src, l.dst, l.label FROM ({A.CONV_EDGES}) l JOIN ball a ON a.graph = l.graph AND a.node = l.src
JOIN ball b ON b.graph = l.graph AND b.root = a.root AND b.node = l.dst""")
def ego_graphlet(spark: SparkSession, d: str) -> DataFrame:
    e = A.conv_edges(spark, d)
    return T.ego_edges(e, T.ball(e, _roots(spark, d), 2))


@query(f"""{BALL.replace('w.hop < 2', 'w.hop < 1').replace('FROM conversations)', "FROM conversations WHERE role = 'assistant')", 1)} SELECT DISTINCT l.graph, l.src, l.dst, l.label FROM ({A.CONV_EDGES}) l JOIN ball a ON a.graph = l.graph AND a.node = l.src
JOIN ball b ON b.graph = l.graph AND b.root = a.root AND b.node = l.dst""")
def induced_edge_filter(spark: SparkSession, d: str) -> DataFrame:
    roots = A.conv_nodes(spark, d).where("code = 'assistant'").select("graph", F.col("node").alias("root"))
    return T.near_roots(A.conv_edges(spark, d), roots, 1)


UNDIRECTED = f"""SELECT DISTINCT graph, least(src, dst) AS src, greatest(src, dst) AS dst,
  CASE WHEN label IN {BB} THEN 'B53' WHEN label[2] <= label[3] THEN label ELSE label[1] || label[3] || label[2] END AS label FROM ({A.CONV_EDGES})"""


@query(f"""{BALL}, u AS ({UNDIRECTED}) SELECT a.graph, a.root, min(a.hop) + 1 AS hop, u.label, u.src AS a, u.dst AS b FROM u JOIN ball a ON a.graph = u.graph AND (a.node = u.src OR a.node = u.dst)
WHERE a.hop < 2 GROUP BY a.graph, a.root, u.label, u.src, u.dst""")
def rings(spark: SparkSession, d: str) -> DataFrame:
    return T.rings(E.undirected(A.conv_edges(spark, d)), _roots(spark, d), 2)


@query("""WITH e AS (SELECT DISTINCT l_orderkey AS graph, l_partkey AS src, l_suppkey + 10000000 AS dst FROM lineitem),
g AS (SELECT graph, node, count(*) AS degree FROM (SELECT graph, src AS node FROM e UNION ALL SELECT graph, dst FROM e) GROUP BY graph, node)
SELECT e.graph, e.src, e.dst FROM e JOIN g a ON a.graph = e.graph AND a.node = e.src JOIN g b ON b.graph = e.graph AND b.node = e.dst WHERE NOT (a.degree = 1 AND b.degree = 1)""")
def floaters(spark: SparkSession, d: str) -> DataFrame:
    e = A.order_edges(spark, d).select("graph", "src", (F.col("dst") + 10_000_000).alias("dst"))
    return E.without_floaters(e)


@query()
def dangle_trim(spark: SparkSession, d: str) -> DataFrame:
    return D.dangle_trim(A.conv_edges(spark, d))


def _wl(step: str) -> str:
    return f"""(SELECT n.graph, n.node, md5(n.wl || '|' || coalesce((SELECT string_agg(e.label || o.wl, ',' ORDER BY e.label || o.wl) FROM e JOIN {step} o ON o.graph = e.graph AND o.node = e.dst WHERE e.graph = n.graph AND e.src = n.node), '')) AS wl FROM {step} n)"""


@query(f"""WITH e AS MATERIALIZED ({A.CONV_EDGES}), w0 AS (SELECT conv_id AS graph, turn AS node, md5(role) AS wl FROM conversations),
w1 AS {_wl('w0')}, w2 AS {_wl('w1')} SELECT graph, md5(string_agg(wl, ',' ORDER BY wl)) AS hash FROM w2 GROUP BY graph""")
def wl_hash(spark: SparkSession, d: str) -> DataFrame:
    return T.wl_hash(A.conv_edges(spark, d), A.conv_nodes(spark, d), "code")


# --- sequences


RUNS = f"""WITH n AS ({A.EVENT_NODES}), c AS (SELECT graph, chain, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY graph, chain ORDER BY pos) - 1 >= 2 THEN 1 ELSE 0 END AS broken, upper(chain)[1] AS letter FROM n),
r AS (SELECT *, sum(broken) OVER (PARTITION BY graph, chain ORDER BY pos) AS run FROM c),
s AS (SELECT graph, chain, CAST(run AS BIGINT) AS run, min(pos) AS first, max(pos) AS last, count(*) AS n, string_agg(letter, '' ORDER BY pos) AS seq FROM r GROUP BY graph, chain, run)"""


@query(f"{RUNS} SELECT graph, chain, run, first, last, n, seq FROM s WHERE n > 2")
def sequences(spark: SparkSession, d: str) -> DataFrame:
    letter = F.upper(F.substring("chain", 1, 1))
    return Q.sequences(A.event_nodes(spark, d), ["graph", "chain"], letter, 2, 2)


@query(f"""{RUNS} SELECT graph, chain, run, first, last, n, seq FROM s WHERE n > 1 AND graph IN
(SELECT user_id FROM events GROUP BY user_id HAVING count(*) > 15 AND count(*) FILTER (event_type = 'error') >= 1)""")
def filtered_sequences(spark: SparkSession, d: str) -> DataFrame:
    """The runs of the graphs that are large enough and hold an error: filters are counted on two columns, then semi-joined."""
    kinds = table(spark, d, "events").select(F.col("user_id").alias("graph"), "event_type")
    passing = [L.by_size(kinds, 15), L.by_residues(kinds, F.col("event_type") == "error")]
    letter = F.upper(F.substring("chain", 1, 1))
    return Q.sequences(L.all_of(A.event_nodes(spark, d), passing), ["graph", "chain"], letter, 2, 1)


@query(f"{RUNS} SELECT graph, chain, run, first, last, n, seq FROM (SELECT *, row_number() OVER (PARTITION BY graph, chain ORDER BY n DESC, run DESC) AS best FROM s) WHERE best = 1")
def longest_run(spark: SparkSession, d: str) -> DataFrame:
    return Q.longest_run(A.event_nodes(spark, d), ["graph", "chain"], F.upper(F.substring("chain", 1, 1)))


@query(f"""WITH n AS ({A.CONV_NODES}), e AS (SELECT graph, src, dst FROM ({A.CONV_EDGES}) WHERE label NOT IN {BB}),
p AS (SELECT graph, src, dst, row_number() OVER (PARTITION BY graph, src ORDER BY abs(dst - src), dst) AS r FROM e)
SELECT n.graph, count(*) AS n, string_agg(CASE WHEN p.dst > n.node THEN '(' WHEN p.dst < n.node THEN ')' ELSE '.' END, '' ORDER BY n.pos) AS brackets
FROM n LEFT JOIN p ON p.graph = n.graph AND p.src = n.node AND p.r = 1 GROUP BY n.graph""")
def dot_bracket(spark: SparkSession, d: str) -> DataFrame:
    pairs = A.conv_edges(spark, d).where(~F.col("label").isin(*E.BACKBONE))
    return Q.brackets(A.conv_nodes(spark, d), pairs)


# --- similarity


@query("""WITH m AS (SELECT DISTINCT l_orderkey AS id, l_partkey || '.' || l_suppkey AS item FROM lineitem), s AS (SELECT id, count(*) AS n FROM m GROUP BY id),
c AS (SELECT a.id AS i, b.id AS j, count(*) AS common FROM m a JOIN m b ON a.item = b.item AND a.id < b.id GROUP BY a.id, b.id)
SELECT i, j, round(common / (x.n + y.n - common), 6) AS similarity FROM c JOIN s x ON x.id = i JOIN s y ON y.id = j""")
def tanimoto(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.concat_ws(".", "l_partkey", "l_suppkey").alias("item"))
    return M.tanimoto(m).withColumn("similarity", F.round("similarity", 6))


VEC = "(SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


def _query_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every vector of an id that 100 divides against all others, in blocks: a stated query set, not all pairs."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    asked = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qe"))
    return M.against(v, asked, "vec_id").where("vec_id <> q")


@query(f"""SELECT q.vec_id AS q, v.vec_id, round(list_dot_product(q.e, v.e) / (greatest(sqrt(list_dot_product(q.e, q.e)), 1e-8) * greatest(sqrt(list_dot_product(v.e, v.e)), 1e-8)), 5) AS cosine
FROM {VEC} q JOIN {VEC} v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0""")
def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _query_pairs(spark, d).select("q", "vec_id", F.round(M.cosine(F.col("qe"), F.col("embedding")), 5).alias("cosine"))


@query(f"SELECT q.vec_id AS q, v.vec_id, round(list_distance(q.e, v.e), 5) AS l2 FROM {VEC} q JOIN {VEC} v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0")
def l2_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _query_pairs(spark, d).select("q", "vec_id", F.round(M.l2(F.col("qe"), F.col("embedding")), 5).alias("l2"))


@query(f"SELECT q.vec_id AS q, round(avg(power(list_dot_product(q.e, v.e) - 1.0, 2)), 5) AS loss FROM {VEC} q JOIN {VEC} v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0 GROUP BY q.vec_id")
def kernel_loss(spark: SparkSession, d: str) -> DataFrame:
    """The products with all others against ones, as the mean of squares."""
    pairs = _query_pairs(spark, d).select("q", M.dot(F.col("qe"), F.col("embedding")).alias("product"), F.lit(1.0).alias("wanted"))
    return M.kernel_loss(pairs, "product", "wanted", ["q"]).withColumn("loss", F.round("loss", 5))


@query(f"""{BALL}, u AS ({UNDIRECTED}), h AS (SELECT a.graph, a.root, min(a.hop) + 1 AS hop, u.label, u.src, u.dst FROM u JOIN ball a ON a.graph = u.graph AND (a.node = u.src OR a.node = u.dst)
WHERE a.hop < 2 GROUP BY a.graph, a.root, u.label, u.src, u.dst), k AS (SELECT graph, root, hop, label, count(*) AS n FROM h GROUP BY graph, root, hop, label),
p AS (SELECT a.graph, a.root AS a, b.root AS b FROM roots a JOIN roots b ON a.graph = b.graph AND b.root = a.root + 1),
c AS (SELECT p.graph, p.a, p.b, hop, label, sum(CASE WHEN k.root = p.a THEN n ELSE 0 END) AS n, sum(CASE WHEN k.root = p.b THEN n ELSE 0 END) AS m FROM p JOIN k ON k.graph = p.graph AND (k.root = p.a OR k.root = p.b) GROUP BY p.graph, p.a, p.b, hop, label),
r AS (SELECT graph, a, b, hop, sum(least(n, m)) / sum(greatest(n, m)) AS s FROM c GROUP BY graph, a, b, hop)
SELECT p.graph, p.a, p.b, round((0.5 * coalesce(r1.s, 1) + 0.25 * coalesce(r2.s, 1)) / 0.75, 6) AS similarity FROM p
LEFT JOIN r r1 ON r1.graph = p.graph AND r1.a = p.a AND r1.b = p.b AND r1.hop = 1 LEFT JOIN r r2 ON r2.graph = p.graph AND r2.a = p.a AND r2.b = p.b AND r2.hop = 2""")
def ring_jaccard(spark: SparkSession, d: str) -> DataFrame:
    roots = _roots(spark, d)
    ident = lambda c: F.struct("graph", c)
    counts = T.rings(E.undirected(A.conv_edges(spark, d)), roots, 2).groupBy(ident(F.col("root")).alias("id"), "hop", "label").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("id", F.concat_ws(".", F.col("id.graph"), F.col("id.root")))
    next_ = roots.select("graph", (F.col("root") - 1).alias("root"))
    pairs = roots.join(next_, ["graph", "root"]).select(F.concat_ws(".", "graph", "root").alias("a"), F.concat_ws(".", "graph", F.col("root") + 1).alias("b"))
    s = M.ring_jaccard(counts, pairs, 0.5, 2)
    end = lambda c, i: F.split(c, r"\.")[i].cast("long")
    return s.select(end("a", 0).alias("graph"), end("a", 1).alias("a"), end("b", 1).alias("b"), F.round("similarity", 6).alias("similarity"))


@query("""WITH RECURSIVE m AS (SELECT DISTINCT l_orderkey AS id, l_partkey || '.' || l_suppkey AS item FROM lineitem), e AS (SELECT DISTINCT a.id AS u, b.id AS v FROM m a JOIN m b ON a.item = b.item AND a.id <> b.id),
r(id, root) AS (SELECT o_orderkey, o_orderkey FROM orders UNION SELECT e.v, r.root FROM r JOIN e ON r.id = e.u), c AS (SELECT id, min(root) AS component FROM r GROUP BY id),
b AS (SELECT component, id, row_number() OVER (PARTITION BY component ORDER BY o_totalprice, id) AS n, count(*) OVER (PARTITION BY component) AS members FROM c JOIN orders ON o_orderkey = id)
SELECT id, component, members FROM b WHERE n = 1""")
def redundancy_removal(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.concat_ws(".", "l_partkey", "l_suppkey").alias("item")).distinct()
    # A chain through the sets of an item links them all: each with the item's first set.
    first = m.groupBy("item").agg(F.min("id").alias("i"), F.count(F.lit(1)).alias("n")).where("n > 1")
    close = m.join(first, "item").where("id <> i").select("i", F.col("id").alias("j")).distinct()
    items = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("resolution"))
    return M.redundancy_removal(items, close)


@query("""WITH p AS (SELECT o_custkey AS cluster FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) = 1), r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS n FROM orders WHERE o_custkey IN (SELECT cluster FROM p))
SELECT o_custkey, o_orderkey FROM r WHERE n = 1""")
def pure_cluster_dedup(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")
    return M.first_of_pure_clusters(orders, "o_custkey", "o_orderstatus", [F.col("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query()
def greedy_cluster(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.concat_ws(".", "l_partkey", "l_suppkey").alias("item"))
    close = M.similar_sets(m, 0.15).select("i", "j")
    items = m.groupBy("id").agg(F.count(F.lit(1)).alias("length"))
    return M.greedy_clusters(items, close)


@query()
def ged(spark: SparkSession, d: str) -> DataFrame:
    """Edit distance of each conversation to the next one; null for those of more than nine turns."""
    e = E.undirected(A.conv_edges(spark, d))
    whole = e.groupBy("graph").agg(F.array_sort(F.collect_list(F.struct("src", "dst", "label"))).alias("edges"))
    after = whole.select((F.col("graph") - 1).alias("graph"), F.col("edges").alias("others"))

    @F.pandas_udf("double")
    def distance(one, two):  # noqa: ANN001, ANN202
        import pandas as pd

        sub = lambda a, b: 0.0 if a == b else 1.0
        return pd.Series([M.edit_distance({(x["src"], x["dst"], x["label"]) for x in a}, {(x["src"], x["dst"], x["label"]) for x in b}, sub, lambda _: 1.0) for a, b in zip(one, two, strict=True)], dtype=float)

    return whole.join(after, "graph").select("graph", distance("edges", "others").alias("ged"))


# --- splits


U = "CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR) || '|7'), 1, 8)) AS BIGINT) / 4294967296.0"


@query(f"SELECT doc_id, CASE WHEN {U} < 0.7 THEN 'train' WHEN {U} < 0.85 THEN 'val' ELSE 'test' END AS split FROM documents")
def hash_split(spark: SparkSession, d: str) -> DataFrame:
    return X.hash_split(table(spark, d, "documents").select("doc_id"), "doc_id", (0.7, 0.15, 0.15), 7)


@query("SELECT doc_id, CASE WHEN source IN ('src0', 'src1') THEN 'train' ELSE 'test' END AS split FROM documents WHERE source IN ('src0', 'src1', 'src2')")
def name_split(spark: SparkSession, d: str) -> DataFrame:
    lists = spark.createDataFrame([("src0", "train"), ("src1", "train"), ("src2", "test")], "name string, split string")
    return X.name_split(table(spark, d, "documents").select("doc_id", "source"), "source", lists).select("doc_id", "split")


UC = U.replace("doc_id", "o_custkey").replace("|7", "|3")


@query(f"SELECT o_orderkey, CASE WHEN {UC} < 0.7 THEN 'train' WHEN {UC} < 0.85 THEN 'val' ELSE 'test' END AS split FROM orders")
def cluster_split(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return X.cluster_split(orders, "o_custkey", "o_orderkey", seed=3).select("o_orderkey", "split")


@query(f"""WITH s AS (SELECT CASE WHEN {U} < 0.7 THEN 'train' WHEN {U} < 0.85 THEN 'val' ELSE 'test' END AS split, count(*) AS n FROM documents GROUP BY 1),
t AS (SELECT split, n, CASE split WHEN 'train' THEN 0.7 ELSE 0.15 END * sum(n) OVER () AS target FROM s) SELECT split, n, round(CAST(target AS DOUBLE), 6) AS target, round(CAST(abs(n - target) / target AS DOUBLE), 6) AS deviation FROM t""")
def split_balance(spark: SparkSession, d: str) -> DataFrame:
    rows = X.hash_split(table(spark, d, "documents").select("doc_id"), "doc_id", (0.7, 0.15, 0.15), 7)
    b = X.split_balance(rows, "split", {"train": 0.7, "val": 0.15, "test": 0.15})
    return b.select("split", "n", F.round("target", 6).alias("target"), F.round("deviation", 6).alias("deviation"))


@query("SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 16 AS batch FROM events")
def batch_assign(spark: SparkSession, d: str) -> DataFrame:
    return X.batches(table(spark, d, "events").select("user_id", "event_id"), ["user_id"], ["event_id"], 16)


@query(f"SELECT doc_id, CASE WHEN {U} < 0.7 THEN 'train' WHEN {U} < 0.85 THEN 'val' ELSE 'test' END AS split, quality AS target FROM documents JOIN labels USING (doc_id)")
def task_csv(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a task as they are written: item, split, target."""
    from lattisca.functions.encoders import FeaturesComputer, IntEncoder
    from lattisca.model import GraphCollection
    from lattisca.tasks import Task

    graphs = table(spark, d, "documents").select(F.col("doc_id").alias("graph")).join(table(spark, d, "labels").select(F.col("doc_id").alias("graph"), "quality"), "graph")
    none = spark.createDataFrame([], "graph long, node long, src long, dst long, label string")
    c = GraphCollection(graphs, none.select("graph", "node"), none.select("graph", "src", "dst", "label"))
    t = Task("quality", c, features=FeaturesComputer(targets=["quality"], custom={"quality": IntEncoder()}), level="graphs", seed=7)
    return t.table().select(F.col("graph").alias("doc_id"), "split", F.col("target").cast("double").cast("int").alias("target"))


@query("""WITH g AS (SELECT conv_id, sha256(string_agg(turn || ':' || role, ',' ORDER BY turn)) AS h FROM conversations GROUP BY conv_id), b AS (SELECT conv_id // 64 AS shelf, sha256(string_agg(h, '' ORDER BY conv_id)) AS hash FROM g GROUP BY 1) SELECT shelf, hash FROM b""")
def task_hash(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", "turn", "role")
    return G.ordered_digest(c, F.expr("conv_id div 64"), "conv_id", [("turn", F.concat_ws(":", "turn", "role"))], "shelf")
