"""Classification metrics from one aggregation: confusion counts, then formulas over at most classes-squared rows a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattisca.operators.split import hash_unit
from lattisca.shared import running_sum


def confusion(rows: DataFrame, label: str, pred: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, label, pred, n)."""
    return rows.groupBy(*(keys or []), F.col(label).alias("label"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def per_class(counts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, class, tp, support, predicted, precision, recall, f1, jaccard) of every class that is a label or a prediction."""
    keys = keys or []
    ends = F.array(
        F.struct(F.col("label").alias("class"), F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted")),
        F.struct(F.col("pred").alias("class"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted")),
    )
    each = counts.select(*keys, F.explode(ends).alias("e")).select(*keys, "e.*").groupBy(*keys, "class").agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted")])

    def over(a: Column, b: Column) -> Column:
        return F.when(b == 0, 0.0).otherwise(a / b)

    tp, s, p = F.col("tp"), F.col("support"), F.col("predicted")
    return each.select(*keys, "class", "tp", "support", "predicted", over(tp, p).alias("precision"), over(tp, s).alias("recall"), over(2 * tp, s + p).alias("f1"), over(tp, s + p - tp).alias("jaccard"))


def summary(classes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, n, accuracy, macro_f1, weighted_f1, balanced_accuracy, mcc, jaccard): from ``per_class``; mcc is 0 where undefined."""
    tp, s, p = F.col("tp").cast("double"), F.col("support").cast("double"), F.col("predicted").cast("double")
    total = F.sum(s)
    top = F.sum(tp) * total - F.sum(p * s)
    below = (total * total - F.sum(p * p)) * (total * total - F.sum(s * s))
    return classes.groupBy(*(keys or [])).agg(
        F.sum("support").alias("n"),
        (F.sum(tp) / total).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("f1") * s) / total).alias("weighted_f1"),
        F.avg(F.when(s > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.when(below <= 0, 0.0).otherwise(top / F.sqrt(below)).alias("mcc"),
        F.avg("jaccard").alias("jaccard"),
    )


def roc_auc(rows: DataFrame, label: str, score: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, auc): the share of positive-negative pairs in the right order, ties half. Rows are counted by score first, so
    that only distinct scores are put in order."""
    keys = keys or []
    at = rows.groupBy(*keys, F.col(score).alias("_s")).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("neg"))
    if keys:
        below = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
        met = at.withColumn("_before", F.coalesce(F.sum("neg").over(below), F.lit(0)))
    else:
        met = running_sum(at, ["_s"], F.col("neg"), "_before")
    found = met.groupBy(*keys).agg(F.sum(F.col("pos") * (F.col("_before") + F.col("neg") / 2)).alias("wins"), F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    return found.select(*keys, F.when(F.col("p") * F.col("q") > 0, F.col("wins") / (F.col("p") * F.col("q"))).alias("auc"))


def early_stop(rows: DataFrame, keys: list[str], order: str, loss: str, patience: int) -> DataFrame:
    """Adds ``best`` (the least loss before) and ``since`` (steps since the last strict improvement); ``stopped`` from patience on."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    through = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    step = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    marked = rows.withColumn("best", F.min(loss).over(before)).withColumn("step", step.cast("long"))
    better = marked.withColumn("_at", F.when(F.col("best").isNull() | (F.col(loss) < F.col("best")), F.col("step")))
    return better.withColumn("since", F.col("step") - F.max("_at").over(through)).drop("_at").withColumn("stopped", F.col("since") >= patience)


def dummy_predictions(rows: DataFrame, key: Column, classes: int, seed: int = 0) -> DataFrame:
    """Adds ``probs``, as good as random but the same at every run, and ``pred``, the likeliest class: what a metric gives for no
    model at all. One class gives a probability and a prediction by half."""
    name = key.cast("string")
    if classes == 1:
        p = hash_unit(name, seed)
        return rows.withColumn("probs", F.array(p)).withColumn("pred", (p >= 0.5).cast("int"))
    raw = F.array(*[hash_unit(name, seed + k) for k in range(classes)])
    soft = rows.withColumn("_raw", raw).withColumn("probs", F.transform("_raw", lambda x: F.exp(x) / F.aggregate("_raw", F.lit(0.0), lambda s, y: s + F.exp(y))))
    return soft.withColumn("pred", (F.array_position("_raw", F.array_max("_raw")) - 1).cast("int")).drop("_raw")
