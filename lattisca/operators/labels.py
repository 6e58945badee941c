"""Labels of graphs: frequency cuts, correlated labels, weights, pockets with ligands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattisca.shared import ranked


def frequent(members: DataFrame, more_than: int, less_than: int) -> DataFrame:
    """(term, n) of terms on more than and less than so many distinct items. ``members`` is (id, term)."""
    n = F.col("n")
    return members.distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n")).where((n > more_than) & (n < less_than))


def correlations(members: DataFrame) -> DataFrame:
    """(a, b, corr), a < b, of terms that share an item: the correlation of their 0/1 columns, from counts alone. Terms that
    share none are never positively correlated and have no row."""
    rows = members.select("id", "term").distinct()
    total = rows.select("id").distinct().agg(F.count(F.lit(1)).alias("items"))
    sizes = rows.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    one, two = rows.withColumnRenamed("term", "a"), rows.withColumnRenamed("term", "b")
    both = one.join(two, "id").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("both"))
    met = both.join(sizes.select(F.col("term").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("term").alias("b"), F.col("n").alias("nb")), "b")
    met = met.join(F.broadcast(total))  # one row
    # Products of two counts are exact as decimals; the product of four is beyond any whole number's range, so it is a double.
    exact = {c: F.col(c).cast("decimal(19,0)") for c in ("items", "both", "na", "nb")}
    top = (exact["items"] * exact["both"] - exact["na"] * exact["nb"]).cast("double")
    below = F.sqrt(F.col("na").cast("double") * (F.col("items") - F.col("na")) * F.col("nb") * (F.col("items") - F.col("nb")))
    return met.select("a", "b", F.when(below > 0, top / below).otherwise(0.0).alias("corr"))


def uncorrelated(members: DataFrame, limit: float = 0.9) -> DataFrame:
    """Members without the terms that are as correlated as ``limit`` with one that comes before them in order."""
    gone = correlations(members).where(F.abs("corr") >= limit).select(F.col("b").alias("term")).distinct()
    return members.join(gone, "term", "left_anti")


def label_codes(members: DataFrame) -> DataFrame:
    """(term, code): terms in order, from 0."""
    return ranked(members.select("term").distinct(), ["term"], "code").select("term", "code")


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    return rows.groupBy(label).agg((F.lit(1.0) / F.count(F.lit(1))).alias("weight"))


def weighted_order(rows: DataFrame, key: str, weight: str, seed: int = 0) -> DataFrame:
    """Adds ``draw``: taking the smallest draws is sampling by weight without replacement, the same at every run."""
    from lattisca.operators.split import hash_unit

    u = F.greatest(hash_unit(F.col(key), seed), F.lit(1e-12))
    return rows.withColumn("draw", -F.log(u) / F.col(weight))


def pocket_pairs(groups: DataFrame) -> DataFrame:
    """(pocket, ligand, label): actives 1, decoys 0. ``groups`` is (pocket, actives, decoys), both arrays."""
    both = F.concat(F.transform("actives", lambda x: F.struct(x.alias("ligand"), F.lit(1).alias("label"))), F.transform("decoys", lambda x: F.struct(x.alias("ligand"), F.lit(0).alias("label"))))
    return groups.select("pocket", F.explode(both).alias("p")).select("pocket", "p.*")


def dictionary(values: DataFrame, column: str, order: str, by: list[str] | None = None) -> DataFrame:
    """(by, value, code): distinct values by where they come first, in each group of ``by`` or over all rows."""
    first = values.groupBy(*(by or []), F.col(column).alias("value")).agg(F.min(order).alias("first"))
    if not by:
        return ranked(first, ["first", "value"], "code").select("value", "code")
    code = F.row_number().over(Window.partitionBy(*by).orderBy("first", "value")) - 1
    return first.withColumn("code", code.cast("long")).select(*by, "value", "code")


def encoded(values: DataFrame, column: str, codes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``values`` with the code in place of the value; ``decoded`` turns it round."""
    return values.withColumnRenamed(column, "value").join(codes, [*(by or []), "value"]).drop("value")


def decoded(coded: DataFrame, column: str, codes: DataFrame, by: list[str] | None = None) -> DataFrame:
    return coded.join(codes, [*(by or []), "code"]).drop("code").withColumnRenamed("value", column)


def over(members: DataFrame, more_than: int) -> DataFrame:
    """Members whose term more than so many items have."""
    kept = members.distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > more_than).select("term")
    return members.join(kept, "term", "left_semi")
