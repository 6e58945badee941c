"""Labels: correlations, pruning, pockets, and samples by weight."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattisca.catalog import query
from lattisca.operators import labels as B
from lattisca.sources.adapters import table

TERMS = "SELECT DISTINCT l_orderkey AS id, CAST(l_suppkey % 12 AS VARCHAR) AS term FROM lineitem"
CORR = f"""WITH m AS ({TERMS}), t AS (SELECT count(DISTINCT id) AS items FROM m), s AS (SELECT term, count(*) AS n FROM m GROUP BY term),
b AS (SELECT x.term AS a, y.term AS b, count(*) AS n FROM m x JOIN m y ON x.id = y.id AND x.term < y.term GROUP BY 1, 2),
c AS (SELECT a, b, (items * b.n - sa.n * sb.n) / sqrt(CAST(sa.n AS DOUBLE) * (items - sa.n) * sb.n * (items - sb.n)) AS corr FROM b, t, s sa, s sb WHERE sa.term = a AND sb.term = b)"""


def _terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_suppkey") % 12).cast("string").alias("term"))


@query(f"{CORR} SELECT a, b, round(corr, 6) AS corr FROM c")
def term_correlations(spark: SparkSession, d: str) -> DataFrame:
    return B.correlations(_terms(spark, d)).withColumn("corr", F.round("corr", 6))


@query(f"{CORR} SELECT term, count(*) AS n FROM m WHERE term NOT IN (SELECT b FROM c WHERE abs(corr) >= 0.05) GROUP BY term")
def term_pruning(spark: SparkSession, d: str) -> DataFrame:
    return B.uncorrelated(_terms(spark, d).distinct(), 0.05).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH g AS (SELECT o_custkey AS pocket, o_orderkey AS ligand, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label FROM orders) SELECT pocket, ligand, label FROM g""")
def pocket_pairs(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    f = F.col("o_orderstatus") == "F"
    groups = orders.groupBy(F.col("o_custkey").alias("pocket")).agg(F.collect_list(F.when(f, F.col("o_orderkey"))).alias("actives"), F.collect_list(F.when(~f, F.col("o_orderkey"))).alias("decoys"))
    return B.pocket_pairs(groups)


W = "-ln(greatest(CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR) || '|1'), 1, 8)) AS BIGINT) / 4294967296.0, 1e-12))"


@query(f"WITH w AS (SELECT toxic, 1.0 / count(*) AS weight FROM labels GROUP BY toxic) SELECT doc_id, CAST(row_number() OVER (PARTITION BY labels.toxic ORDER BY {W} / weight, doc_id) AS BIGINT) AS rank FROM labels JOIN w ON labels.toxic = w.toxic QUALIFY rank <= 20")
def balanced_sample(spark: SparkSession, d: str) -> DataFrame:
    """Twenty of each class, by weighted draws."""
    from pyspark.sql.window import Window

    rows = table(spark, d, "labels").select("doc_id", "toxic")
    drawn = B.weighted_order(rows.join(F.broadcast(B.class_weights(rows, "toxic")), "toxic"), "doc_id", "weight", 1)  # a row for each class
    rank = F.row_number().over(Window.partitionBy("toxic").orderBy("draw", "doc_id"))
    return drawn.withColumn("rank", rank.cast("long")).where("rank <= 20").select("doc_id", "rank")
