"""Encoders, geometry, representations and metrics over the adapters' graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattisca.catalog import query
from lattisca.functions import encoders as C
from lattisca.functions import geometry as G
from lattisca.operators import metrics as K
from lattisca.operators import represent as R
from lattisca.operators import spatial as S
from lattisca.sources import adapters as A
from lattisca.sources.adapters import table

TYPES = {"click": 0, "view": 1, "purchase": 2, "error": 3}


def _flat(key: str, array: str, value: str = "v") -> list:
    """An array as rows, so that any engine can compare it."""
    return [key, F.posexplode(array).alias("slot", value)]


# --- encoders


@query("""SELECT event_id, CAST(s.slot AS INTEGER) AS slot, CASE WHEN CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 WHEN 'error' THEN 3 END = s.slot THEN 1.0 ELSE 0.0 END::DOUBLE AS v
FROM events, (SELECT unnest([0, 1, 2, 3]) AS slot) s""")
def one_hot(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", C.OneHotEncoder(TYPES).encode(F.col("event_type")).alias("a"))
    return e.select(*_flat("event_id", "a")).withColumn("v", F.col("v").cast("double"))


@query("""WITH g AS (SELECT user_id, list(DISTINCT event_type) AS kinds FROM events GROUP BY user_id)
SELECT user_id, CAST(s.slot AS INTEGER) AS slot, CASE WHEN list_contains(kinds, ['click', 'view', 'purchase', 'error'][s.slot + 1]) THEN 1.0 ELSE 0.0 END::DOUBLE AS v FROM g, (SELECT unnest([0, 1, 2, 3]) AS slot) s""")
def multi_hot(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"))
    return g.select("user_id", C.MultiHotEncoder(TYPES).encode(F.col("kinds")).alias("a")).select(*_flat("user_id", "a")).withColumn("v", F.col("v").cast("double"))


@query("SELECT event_id, CAST(CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 WHEN 'error' THEN 3 ELSE 9 END AS DOUBLE) AS v FROM events")
def int_mapping(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", C.IntMappingEncoder(TYPES, 9).encode(F.col("event_type"))[0].cast("double").alias("v"))


@query("SELECT event_id, CAST(CASE WHEN event_type = 'view' THEN 0 ELSE CAST(value AS FLOAT) END AS DOUBLE) AS v FROM events")
def float_encode(spark: SparkSession, d: str) -> DataFrame:
    value = F.when(F.col("event_type") == "view", F.lit("none")).otherwise(F.col("value").cast("string"))
    return table(spark, d, "events").select("event_id", C.FloatEncoder().encode(value)[0].cast("double").alias("v"))


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN 0.0 WHEN event_type = 'error' THEN 1.0 WHEN value <> 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS v FROM events")
def bool_encode(spark: SparkSession, d: str) -> DataFrame:
    value = F.when(F.col("event_type") == "error", F.lit("yes")).when(F.col("event_type") != "view", F.col("value").cast("string"))
    return table(spark, d, "events").select("event_id", C.BoolEncoder().encode(value)[0].cast("double").alias("v"))


@query("SELECT vec_id, CAST(s.slot AS INTEGER) AS slot, CASE WHEN vec_id % 7 = 0 THEN 0.0 ELSE round(CAST(embedding[s.slot + 1] AS DOUBLE), 6) END AS v FROM embeddings, (SELECT unnest([0, 1, 2]) AS slot) s")
def list_encode(spark: SparkSession, d: str) -> DataFrame:
    value = F.when(F.col("vec_id") % 7 == 0, F.array(F.lit(None).cast("float"), F.lit(1.0).cast("float"))).otherwise(F.slice("embedding", 1, 3))
    e = table(spark, d, "embeddings").select("vec_id", C.ListEncoder(3).encode(value).alias("a"))
    return e.select(*_flat("vec_id", "a")).withColumn("v", F.round(F.col("v").cast("double"), 6))


@query("SELECT o_orderkey, CAST(CASE upper(o_orderstatus) WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS BIGINT) AS code FROM orders")
def symbol_code(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(C.SymbolEncoder("FO").code(F.lower("o_orderstatus")), F.lit(0)).cast("long").alias("code"))


@query("""SELECT event_id, CAST(s.slot AS INTEGER) AS slot, CASE WHEN s.slot < 4 THEN CASE WHEN CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 WHEN 'error' THEN 3 END = s.slot THEN 1.0 ELSE 0.0 END ELSE CAST(CAST(value AS FLOAT) AS DOUBLE) END AS v
FROM events, (SELECT unnest([0, 1, 2, 3, 4]) AS slot) s""")
def encode_nodes(spark: SparkSession, d: str) -> DataFrame:
    f = C.FeaturesComputer()
    f.add_feature("event_type", C.OneHotEncoder(TYPES))
    f.add_feature("value", C.FloatEncoder())
    return f.compute(table(spark, d, "events")).select(*_flat("event_id", "features")).withColumn("v", F.col("v").cast("double"))


@query(f"""WITH p AS (SELECT vec_id // {A.MOLECULE} AS graph, vec_id, CASE WHEN vec_id % 5 = 0 THEN NULL ELSE CAST(embedding[1] AS DOUBLE) END AS a, CASE WHEN vec_id % 5 = 0 THEN NULL ELSE CAST(embedding[2] AS DOUBLE) END AS b FROM embeddings)
SELECT vec_id, round(coalesce(a, avg(a) OVER (PARTITION BY graph)), 6) AS a, round(coalesce(b, avg(b) OVER (PARTITION BY graph)), 6) AS b FROM p""")
def mean_fill(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.expr(f"vec_id div {A.MOLECULE}").alias("graph"), "vec_id", F.when(F.col("vec_id") % 5 != 0, F.slice("embedding", 1, 2)).alias("e"))
    return C.mean_fill(e, "e", 2).select("vec_id", F.round(F.col("e")[0], 6).alias("a"), F.round(F.col("e")[1], 6).alias("b"))


# --- geometry

NEXT = f"""WITH p AS ({A.POINTS}), q AS (SELECT *, {', '.join(f'lag({c}) OVER w AS p{c}, lead({c}) OVER w AS n{c}, lead({c}, 2) OVER w AS m{c}' for c in 'xyz')} FROM p WINDOW w AS (PARTITION BY graph ORDER BY node))"""


def _chain(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    order = Window.partitionBy("graph").orderBy("node")
    p = S.neighbours_at(A.points(spark, d), ["graph"])
    return p.select("*", *[F.lead(c, 2).over(order).alias(f"m{c}") for c in "xyz"])


@query(f"{NEXT} SELECT node, round(sqrt((x-nx)*(x-nx) + (y-ny)*(y-ny) + (z-nz)*(z-nz) + 0.001), 6) AS length FROM q WHERE nx IS NOT NULL")
def lengths(spark: SparkSession, d: str) -> DataFrame:
    return _chain(spark, d).where("nx is not null").select("node", F.round(G.length(G.vector(), G.vector("n")), 6).alias("length"))


@query(f"""{NEXT}, u AS (SELECT node, px-x AS ax, py-y AS ay, pz-z AS az, nx-x AS wx, ny-y AS wy, nz-z AS wz FROM q WHERE px IS NOT NULL AND nx IS NOT NULL)
SELECT node, round(acos(greatest(-1.0, least(1.0, (ax*wx + ay*wy + az*wz) / (sqrt(ax*ax+ay*ay+az*az+0.001) * sqrt(wx*wx+wy*wy+wz*wz+0.001))))), 5) AS angle FROM u""")
def angles(spark: SparkSession, d: str) -> DataFrame:
    c = _chain(spark, d).where("px is not null and nx is not null")
    return c.select("node", F.round(G.angle(G.vector("p"), G.vector(), G.vector("n")), 5).alias("angle"))


def _sql_unit(a: str, out: str) -> str:
    size = f"sqrt({a}x*{a}x + {a}y*{a}y + {a}z*{a}z + 0.001)"
    return ", ".join(f"{a}{c} / {size} AS {out}{c}" for c in "xyz")


def _sql_cross(a: str, b: str, out: str) -> str:
    return f"{a}y*{b}z - {a}z*{b}y AS {out}x, {a}z*{b}x - {a}x*{b}z AS {out}y, {a}x*{b}y - {a}y*{b}x AS {out}z"


@query(f"""{NEXT}, s0 AS (SELECT node, {', '.join(f'p{c}-{c} AS a{c}, {c}-n{c} AS v{c}, n{c}-m{c} AS w{c}' for c in 'xyz')} FROM q WHERE px IS NOT NULL AND mx IS NOT NULL),
s1 AS (SELECT node, {_sql_unit('a', 'ij')}, {_sql_unit('v', 'jk')}, {_sql_unit('w', 'kl')} FROM s0),
s2 AS (SELECT node, ijx, ijy, ijz, {_sql_cross('ij', 'jk', 'e')}, {_sql_cross('jk', 'kl', 'f')} FROM s1),
s3 AS (SELECT node, ijx, ijy, ijz, {_sql_unit('e', 'g')}, {_sql_unit('f', 'h')} FROM s2)
SELECT node, round(sign(ijx*hx + ijy*hy + ijz*hz) * acos(greatest(-1.0, least(1.0, gx*hx + gy*hy + gz*hz))), 5) AS dihedral FROM s3""")
def dihedrals(spark: SparkSession, d: str) -> DataFrame:
    c = _chain(spark, d).where("px is not null and mx is not null")
    return c.select("node", F.round(G.dihedral(G.vector("p"), G.vector(), G.vector("n"), G.vector("m")), 5).alias("dihedral"))


@query(f"WITH p AS ({A.POINTS}) SELECT node, {', '.join(f'round({c} / sqrt(x*x + y*y + z*z + 0.001), 6) AS u{c}' for c in 'xyz')} FROM p")
def normed_vec(spark: SparkSession, d: str) -> DataFrame:
    u = G.unit(G.vector())
    return A.points(spark, d).select("node", *[F.round(u[i], 6).alias(f"u{c}") for i, c in enumerate("xyz")])


@query(f"""{NEXT}, v AS (SELECT node, {', '.join(f'coalesce(n{c}-{c}, 0) AS f{c}, coalesce(p{c}-{c}, 0) AS w{c}' for c in 'xyz')} FROM q)
SELECT node, {', '.join(f'round(f{c} / sqrt(fx*fx + fy*fy + fz*fz + 0.001), 6) + 0.0 AS f{c}, round(w{c} / sqrt(wx*wx + wy*wy + wz*wz + 0.001), 6) + 0.0 AS \"b{c}\"' for c in 'xyz')} FROM v""")
def fwd_bwd_vectors(spark: SparkSession, d: str) -> DataFrame:
    c = _chain(spark, d)
    ends = {k: [F.coalesce(F.col(f"{p}{a}") - F.col(a), F.lit(0.0)) for a in "xyz"] for k, p in (("f", "n"), ("b", "p"))}
    return c.select("node", *[(F.round(G.unit(v)[i], 6) + 0.0).alias(f"{k}{a}") for k, v in ends.items() for i, a in enumerate("xyz")])


@query("SELECT event_id, CAST(i.i AS INTEGER) AS slot, round(exp(-power((value - i.i * 30.0 / 31) / (30.0 / 31), 2)), 6) AS v FROM events, (SELECT unnest(generate_series(0, 31)) AS i) i")
def rbf(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.array(*G.rbf(F.col("value"))).alias("a"))
    return e.select(*_flat("event_id", "a")).withColumn("v", F.round("v", 6))


@query("""WITH p AS (SELECT i, power(10, 3.0 * i / 3) AS period FROM (SELECT unnest(generate_series(0, 3)) AS i))
SELECT conv_id, turn, CAST(i AS INTEGER) AS slot, round(cos(2 * pi() * turn / period), 6) + 0.0 AS v FROM conversations, p UNION ALL SELECT conv_id, turn, CAST(i + 4 AS INTEGER), round(sin(2 * pi() * turn / period), 6) + 0.0 FROM conversations, p""")
def posenc(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", "turn", F.array(*G.positional(F.col("turn"), 8)).alias("a"))
    return c.select("conv_id", "turn", F.posexplode("a").alias("slot", "v")).withColumn("v", F.round("v", 6) + 0.0)


@query("""SELECT conv_id AS graph, turn AS node, round(cos(2 * pi() * (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) / count(*) OVER (PARTITION BY conv_id)), 6) + 0.0 AS px,
round(sin(2 * pi() * (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) / count(*) OVER (PARTITION BY conv_id)), 6) + 0.0 AS py FROM conversations""")
def circular_layout(spark: SparkSession, d: str) -> DataFrame:
    return R.circular_layout(A.conv_nodes(spark, d)).select("graph", "node", (F.round("px", 6) + 0.0).alias("px"), (F.round("py", 6) + 0.0).alias("py"))


def _grid(spacing: float, padding: float, reach: int, sigma: float) -> str:
    low = {c: f"(min{c} - {padding})" for c in "xyz"}
    bins = ", ".join(f"CAST(floor(({c} - {low[c]}) / {spacing}) + 1 AS BIGINT) AS bin{c}, {low[c]} AS low{c}, CAST(ceil((max{c} + {padding} - {low[c]}) / {spacing}) AS BIGINT) AS n{c}" for c in "xyz")
    steps = "(SELECT unnest(generate_series(%d, %d)) AS s)" % (-reach, reach - 1)
    cells = ", ".join(f"bin{c} + s{c}.s AS i{c}" for c in "xyz")
    square = " + ".join(f"power({c} - (low{c} + i{c} * {spacing}), 2)" for c in "xyz")
    return f"""WITH p AS ({A.POINTS}), b AS (SELECT graph, {', '.join(f'min({c}) AS min{c}, max({c}) AS max{c}' for c in 'xyz')} FROM p GROUP BY graph),
a AS (SELECT p.graph, x, y, z, {bins} FROM p JOIN b ON p.graph = b.graph), c AS (SELECT a.*, {cells} FROM a, {steps} sx, {steps} sy, {steps} sz)
SELECT graph, ix, iy, iz, round(sum(exp(-({square}) / (2 * {sigma} * {sigma}))), 5) AS weight FROM c WHERE {' AND '.join(f'i{c} >= 0 AND i{c} < n{c}' for c in 'xyz')} GROUP BY graph, ix, iy, iz"""


@query(_grid(0.25, 0.5, 2, 0.5))
def voxel_grid(spark: SparkSession, d: str) -> DataFrame:
    v = S.voxels(A.points(spark, d), 0.25, 0.5, 0.5)
    return v.select("graph", "ix", "iy", "iz", F.round("weight", 5).alias("weight"))


# --- representations

INDEX = f"""WITH n AS ({A.CONV_NODES}), i AS (SELECT graph, node, size, CAST(row_number() OVER (PARTITION BY graph ORDER BY CAST(node AS VARCHAR)) - 1 AS BIGINT) AS idx FROM n), e AS ({A.CONV_EDGES}),
x AS (SELECT e.graph, a.idx AS i, b.idx AS j, CAST(CASE label WHEN 'B53' THEN 0 WHEN 'cSW' THEN 6 WHEN 'cWS' THEN 8 WHEN 'cWW' THEN 9 WHEN 'tHS' THEN 11 WHEN 'tSH' THEN 13 WHEN 'B35' THEN 19 END AS INTEGER) AS code
  FROM e JOIN i a ON a.graph = e.graph AND a.node = e.src JOIN i b ON b.graph = e.graph AND b.node = e.dst)"""


@query(f"{INDEX} SELECT graph, i, j, code FROM x")
def edge_index(spark: SparkSession, d: str) -> DataFrame:
    return R.edge_index(A.conv_nodes(spark, d), A.conv_edges(spark, d))


@query(f"""{INDEX}, a AS (SELECT graph, string_agg(CAST(node AS VARCHAR), ',' ORDER BY idx) AS names, string_agg(CAST(size AS VARCHAR), ',' ORDER BY idx) AS x FROM i GROUP BY graph),
b AS (SELECT graph, string_agg(i || '-' || j || ':' || code, ',' ORDER BY i, j, code) AS edges FROM x GROUP BY graph) SELECT a.graph, names, x, edges FROM a LEFT JOIN b ON a.graph = b.graph""")
def graph_tensors(spark: SparkSession, d: str) -> DataFrame:
    t = R.graph_tensors(A.conv_nodes(spark, d), A.conv_edges(spark, d), "size")
    text = F.transform(F.arrays_zip("edge_index", "edge_attr"), lambda v: F.concat(v["edge_index"][0], F.lit("-"), v["edge_index"][1], F.lit(":"), v["edge_attr"]))
    return t.select("graph", F.array_join("node_names", ",").alias("names"), F.array_join(F.col("x").cast("array<string>"), ",").alias("x"), F.array_join(text, ",").alias("edges"))


@query(f"""WITH p AS ({A.POINTS}) SELECT graph, count(*) AS n, string_agg(CAST(node AS VARCHAR), ',' ORDER BY CAST(node AS VARCHAR)) AS names, round(sum(x + 2 * y + 3 * z), 5) AS sum FROM p GROUP BY graph""")
def point_cloud(spark: SparkSession, d: str) -> DataFrame:
    c = R.point_cloud(A.points(spark, d))
    total = F.aggregate("xyz", F.lit(0.0), lambda s, v: s + v[0] + 2 * v[1] + 3 * v[2])
    return c.select("graph", F.size("names").cast("long").alias("n"), F.array_join("names", ",").alias("names"), F.round(total, 5).alias("sum"))


@query(f"WITH n AS ({A.CONV_NODES}), e AS ({A.CONV_EDGES}) SELECT e.graph, e.src AS node, e.label, round(avg(n.size), 6) AS mean FROM e JOIN n ON n.graph = e.graph AND n.node = e.dst GROUP BY e.graph, e.src, e.label")
def rgcn_mean(spark: SparkSession, d: str) -> DataFrame:
    return R.neighbour_mean(A.conv_nodes(spark, d), A.conv_edges(spark, d), "size").withColumn("mean", F.round("mean", 6))


@query("""SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def edge_dot_score(spark: SparkSession, d: str) -> DataFrame:
    from lattisca.operators.similarity import dot

    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(after, "vec_id").select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"), F.round(dot(F.col("embedding"), F.col("other")), 5).alias("score"))


# --- metrics: documents as items, their quality the label, a rule on their length the prediction

PREDS = "(SELECT l.doc_id, source, lang, l.quality AS label, CAST(n_chars > 300 AS INTEGER) AS pred, n_chars AS score FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"


def _preds(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", (F.col("n_chars") > 300).cast("int").alias("pred"), F.col("n_chars").alias("score"))
    return docs.join(table(spark, d, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")


CLASSES = f"""WITH p AS {PREDS}, c AS (SELECT label AS class FROM p UNION SELECT pred FROM p),
k AS (SELECT class, (SELECT count(*) FROM p WHERE label = class AND pred = class) AS tp, (SELECT count(*) FROM p WHERE label = class) AS s, (SELECT count(*) FROM p WHERE pred = class) AS q FROM c)"""


@query(f"SELECT label, pred, count(*) AS n FROM {PREDS} GROUP BY label, pred")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return K.confusion(_preds(spark, d), "label", "pred")


@query(f"{CLASSES} SELECT class, tp, s AS support, round(CASE WHEN q = 0 THEN 0 ELSE tp / q END, 6) AS precision, round(CASE WHEN s = 0 THEN 0 ELSE tp / s END, 6) AS recall, round(CASE WHEN s + q = 0 THEN 0 ELSE 2 * tp / (s + q) END, 6) AS f1 FROM k")
def per_class_f1(spark: SparkSession, d: str) -> DataFrame:
    c = K.per_class(K.confusion(_preds(spark, d), "label", "pred"))
    return c.select("class", "tp", "support", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")])


def _summary(spark: SparkSession, d: str) -> DataFrame:
    return K.summary(K.per_class(K.confusion(_preds(spark, d), "label", "pred")))


@query(f"""{CLASSES} SELECT CAST(sum(s) AS BIGINT) AS n, round(sum(tp) / sum(s), 6) AS accuracy, round(avg(CASE WHEN s + q = 0 THEN 0 ELSE 2 * tp / (s + q) END), 6) AS macro_f1,
round((sum(tp) * sum(s) - sum(q * s)) / sqrt((sum(s) * sum(s) - sum(q * q)) * (sum(s) * sum(s) - sum(s * s))), 6) AS mcc FROM k""")
def accuracy_f1_mcc(spark: SparkSession, d: str) -> DataFrame:
    return _summary(spark, d).select("n", F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"), F.round("mcc", 6).alias("mcc"))


@query(f"{CLASSES} SELECT round(avg(tp / s), 6) AS balanced_accuracy FROM k WHERE s > 0")
def balanced_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return _summary(spark, d).select(F.round("balanced_accuracy", 6).alias("balanced_accuracy"))


@query(f"{CLASSES} SELECT round(avg(tp / (s + q - tp)), 6) AS jaccard FROM k")
def jaccard_macro(spark: SparkSession, d: str) -> DataFrame:
    return _summary(spark, d).select(F.round("jaccard", 6).alias("jaccard"))


@query(f"{CLASSES} SELECT round(sum(s * 2 * tp / (s + q)) / sum(s), 6) AS weighted_f1 FROM k")
def weighted_f1(spark: SparkSession, d: str) -> DataFrame:
    return _summary(spark, d).select(F.round("weighted_f1", 6).alias("weighted_f1"))


@query(f"""WITH p AS {PREDS}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM p)
SELECT round((sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)), 6) AS auc FROM r""")
def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return K.roc_auc(_preds(spark, d), "label", "score").select(F.round("auc", 6).alias("auc"))


@query(f"SELECT source, count(*) AS n, round(avg(CAST(label = pred AS INTEGER)), 6) AS accuracy FROM {PREDS} GROUP BY GROUPING SETS ((source), ())")
def metrics_per_group(spark: SparkSession, d: str) -> DataFrame:
    right = F.avg((F.col("label") == F.col("pred")).cast("int"))
    return _preds(spark, d).rollup("source").agg(F.count(F.lit(1)).alias("n"), F.round(right, 6).alias("accuracy"))


@query(f"""WITH p AS {PREDS}, r AS (SELECT source, label, rank() OVER (PARTITION BY source ORDER BY score) + (count(*) OVER (PARTITION BY source, score) - 1) / 2.0 AS r FROM p),
a AS (SELECT source, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS q, sum(r) FILTER (label = 1) AS s FROM r GROUP BY source)
SELECT source, round((s - p * (p + 1) / 2.0) / (p * q), 6) AS auc FROM a WHERE p + q >= 10 AND p > 0 AND q > 0""")
def vs_auroc(spark: SparkSession, d: str) -> DataFrame:
    """A source is a pocket; those with fewer than ten documents, or of one class, are left out."""
    p = _preds(spark, d)
    big = p.groupBy("source").agg(F.count(F.lit(1)).alias("n")).where("n >= 10").select("source")
    return K.roc_auc(p, "label", "score", ["source"]).join(big, "source", "left_semi").where("auc is not null").select("source", F.round("auc", 6).alias("auc"))


@query(f"""WITH n AS ({A.EVENT_NODES}), b AS (SELECT graph, pos, value, min(value) OVER (PARTITION BY graph ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM n),
c AS (SELECT *, CASE WHEN best IS NULL OR value < best THEN pos END AS better FROM b)
SELECT graph, pos, pos - max(better) OVER (PARTITION BY graph ORDER BY pos) >= 5 AS stopped FROM c""")
def early_stop(spark: SparkSession, d: str) -> DataFrame:
    return K.early_stop(A.event_nodes(spark, d), ["graph"], "pos", "value", 5).select("graph", "pos", "stopped")
