"""Filters of whole graphs. Each gives the frame of graphs that pass, to be semi-joined with the collection; they compose by
intersection, and an aggregate is one partial aggregation and one shuffle of counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattisca.operators.edges import is_canonical


def by_size(nodes: DataFrame, least: int = 0, most: int = -1) -> DataFrame:
    """Strict bounds on both ends; ``most`` = -1 sets none."""
    n = F.col("n")
    return nodes.groupBy("graph").agg(F.count(F.lit(1)).alias("n")).where((n > least) & ((F.lit(most) == -1) | (n < most)))


def by_attribute(graphs: DataFrame, condition: Column) -> DataFrame:
    """A graph without the attribute doesn't pass."""
    return graphs.where(F.coalesce(condition, F.lit(False)))


def by_residues(nodes: DataFrame, condition: Column, least: int = 1) -> DataFrame:
    """At least so many residues meet the condition."""
    return nodes.groupBy("graph").agg(F.count_if(condition).alias("n_valid")).where(F.col("n_valid") >= least)


def by_aggregate(nodes: DataFrame, value: Column, condition: Column) -> DataFrame:
    """The aggregate ``value`` meets ``condition``, which reads it as ``agg``."""
    return nodes.groupBy("graph").agg(value.alias("agg")).where(condition)


def by_name(graphs: DataFrame, names: list[str], column: str = "name") -> DataFrame:
    return graphs.where(F.col(column).isin([n.lower() for n in names]))


def by_chains(nodes: DataFrame, valid: DataFrame) -> DataFrame:
    """The residues of the valid (graph, chain) pairs; graphs without any are gone."""
    return nodes.join(valid, ["graph", "chain"], "left_semi")


def by_resolution(graphs: DataFrame, below: float, column: str = "resolution") -> DataFrame:
    """The attribute is a string; what is no number doesn't pass."""
    return graphs.where(F.col(column).try_cast("double") < below)


def by_keywords(rows: DataFrame, column: str, words: list[str]) -> DataFrame:
    """Rows whose text holds none of the words, whatever the case."""
    return rows.where(~F.coalesce(F.lower(column).rlike("|".join(w.lower() for w in words)), F.lit(False)))


def by_structure(nodes: DataFrame, edges: DataFrame, least: int = 10) -> DataFrame:
    """Graphs of enough nodes with at least one edge that is not canonical."""
    big = nodes.groupBy("graph").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    odd = edges.where(~is_canonical(F.col("label"))).select("graph").distinct()
    return big.join(odd, "graph", "left_semi")


def all_of(collection: DataFrame, passing: list[DataFrame]) -> DataFrame:
    """The rows whose graph is in every one of ``passing``."""
    return reduce(lambda df, keep: df.join(keep.select("graph"), "graph", "left_semi"), passing, collection)


def ligand_class(kind: Column, mass: Column, elements: Column, allowed: list[str], least: float, most: float, ions: list[str]) -> Column:
    """ion, ligand or null: ligands have a mass within the limits, carbon, and allowed elements alone."""
    fits = mass.between(least, most) & F.array_contains(elements, "C") & (F.size(F.array_except(elements, F.array(*[F.lit(a) for a in allowed]))) == 0)
    return F.when(kind.isin(*ions), "ion").when(fits, "ligand")
