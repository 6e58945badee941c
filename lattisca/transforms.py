"""Transforms as objects: filters, partitions, annotations, and their composition. Calling one gives a new lazy collection.

Checkers are functions from a column to a column; a plain Python function of a value goes through ``python_checker``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattisca.constants import RIBOSOMAL
from lattisca.model import GraphCollection
from lattisca.operators import clean as D
from lattisca.operators import edges as E
from lattisca.operators import filters as L
from lattisca.operators import partition as P
from lattisca.operators import similarity as M
from lattisca.operators import split as X

Checker = Callable[[Column], Column]


def python_checker(f: Callable[[object], bool]) -> Checker:
    """A plain function of one value, run in Arrow batches."""

    @F.pandas_udf("boolean")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: bool(f(v)))

    return run


class Transform:
    def __call__(self, c: GraphCollection) -> GraphCollection:
        raise NotImplementedError


@dataclass
class Compose(Transform):
    transforms: list[Callable[[GraphCollection], GraphCollection]]

    def __call__(self, c: GraphCollection) -> GraphCollection:
        return c.transform(*self.transforms)


class IdentityTransform(Transform):
    def __call__(self, c: GraphCollection) -> GraphCollection:
        return c


# --- filters


class FilterTransform(Transform):
    def passing(self, c: GraphCollection) -> DataFrame:
        """(graph, ...) of the graphs that pass."""
        raise NotImplementedError

    def __call__(self, c: GraphCollection) -> GraphCollection:
        return c.keep(self.passing(c))


class DummyFilter(FilterTransform):
    def passing(self, c: GraphCollection) -> DataFrame:
        return c.graphs


@dataclass
class SizeFilter(FilterTransform):
    """Strict bounds; ``max_size`` -1 sets none."""

    min_size: int = 0
    max_size: int = -1

    def passing(self, c: GraphCollection) -> DataFrame:
        return L.by_size(c.nodes, self.min_size, self.max_size)


@dataclass
class RNAAttributeFilter(FilterTransform):
    attribute: str
    value_checker: Checker

    def passing(self, c: GraphCollection) -> DataFrame:
        if self.attribute not in c.graphs.columns:
            return c.graphs.limit(0)
        return L.by_attribute(c.graphs, self.value_checker(F.col(self.attribute)))


@dataclass
class ResidueAttributeFilter(FilterTransform):
    """``min_valid``: at least so many residues pass the checker; ``aggfunc``: the aggregate of the attribute passes it.
    ``compat`` keeps what the checker-less original does in the second mode: any aggregate but zero and null passes."""

    attribute: str
    aggregation_mode: str = "min_valid"
    value_checker: Checker = lambda v: v.isNotNull()
    min_valid: int = 1
    aggfunc: Checker = F.avg
    compat: bool = False

    def passing(self, c: GraphCollection) -> DataFrame:
        if self.attribute not in c.nodes.columns:
            return c.graphs.limit(0)
        if self.aggregation_mode == "min_valid":
            return L.by_residues(c.nodes, self.value_checker(F.col(self.attribute)), self.min_valid)
        if self.aggregation_mode != "aggfunc":
            raise ValueError("aggregation_mode is min_valid or aggfunc")
        condition = F.col("agg") != 0 if self.compat else self.value_checker(F.col("agg"))
        return L.by_aggregate(c.nodes, self.aggfunc(self.attribute), condition)


@dataclass
class ResidueNameFilter(FilterTransform):
    value_checker: Checker
    min_valid: int = 1

    def passing(self, c: GraphCollection) -> DataFrame:
        return L.by_residues(c.nodes, self.value_checker(F.col("node")), self.min_valid)


@dataclass
class NameFilter(FilterTransform):
    names: list[str]

    def passing(self, c: GraphCollection) -> DataFrame:
        return L.by_name(c.graphs, self.names, "graph")


@dataclass
class RibosomalFilter(FilterTransform):
    """Leaves out graphs whose ``columns`` (titles, keywords) hold a ribosomal word, whatever the case."""

    columns: list[str] = field(default_factory=lambda: ["title"])

    def passing(self, c: GraphCollection) -> DataFrame:
        text = F.concat_ws(" ", *self.columns)
        return L.by_keywords(c.graphs.withColumn("_text", text), "_text", list(RIBOSOMAL))


@dataclass
class ChainFilter(FilterTransform):
    """``valid_chains``: graph to chains; residues of other chains go too."""

    valid_chains: dict[str, list[str]]

    def __call__(self, c: GraphCollection) -> GraphCollection:
        rows = [(g, x) for g, some in self.valid_chains.items() for x in some]
        valid = c.nodes.sparkSession.createDataFrame(rows, "graph string, chain string")
        return c.keep_nodes(L.by_chains(c.nodes, valid))


@dataclass
class ResolutionFilter(FilterTransform):
    """``compat`` compares the first digit, as the original does with strings."""

    resolution_threshold: float
    column: str = "resolution_high"
    compat: bool = False

    def passing(self, c: GraphCollection) -> DataFrame:
        graphs = c.graphs.withColumn("_r", F.substring(F.col(self.column).cast("string"), 1, 1 if self.compat else 99))
        return L.by_resolution(graphs, self.resolution_threshold, "_r")


@dataclass
class ComposeFilters(FilterTransform):
    """All of the filters; each looks at the collection as it came."""

    filters: list[FilterTransform]

    def passing(self, c: GraphCollection) -> DataFrame:
        return L.all_of(c.graphs, [f.passing(c) for f in self.filters])


# --- partitions


class ChainSplitTransform(Transform):
    """A graph for each chain; ``parent`` keeps the name."""

    def __call__(self, c: GraphCollection) -> GraphCollection:
        return c.partition(c.nodes.select("graph", "node", F.col("chain").alias("part")))


class ConnectedComponentPartition(Transform):
    """Weak components, numbered in the order of their smallest nodes."""

    def __call__(self, c: GraphCollection) -> GraphCollection:
        from pyspark.sql.window import Window

        named = P.connected_components(c.edges)
        whole = c.nodes.select("graph", "node").join(named, ["graph", "node"], "left").withColumn("component", F.coalesce("component", "node"))
        number = F.dense_rank().over(Window.partitionBy("graph").orderBy("component")) - 1
        return c.partition(whole.select("graph", "node", number.alias("part")))


@dataclass
class PartitionFromDict(Transform):
    """``lists``: graph to lists of nodes; graphs that are not named are gone."""

    lists: dict[str, list[list[str]]]

    def __call__(self, c: GraphCollection) -> GraphCollection:
        rows = [(g, i, n) for g, some in self.lists.items() for i, nodes in enumerate(some) for n in nodes]
        lists = c.nodes.sparkSession.createDataFrame(rows, "graph string, list int, node string")
        return c.partition(P.from_lists(c.nodes.select("graph", "node"), lists))


@dataclass
class Chop(Transform):
    """Pieces of at most ``max_size`` residues by principal axes. Then gaps are filled, dangling ends trimmed and islands below
    ``least`` residues dropped; pieces with fewer than ``filter_size`` residues or without a pair that isn't canonical go."""

    max_size: int = 50
    least: int = 8
    filter_size: int = 10

    def __call__(self, c: GraphCollection) -> GraphCollection:
        cut = P.pca_chop(c.nodes.select("graph", "node", "x", "y", "z").where("x is not null"), self.max_size).select("graph", "node", "part")
        # A gap is filled from the whole graph, so a piece looks at all of its graph's edges.
        name = F.concat_ws("|", F.col("graph").cast("string"), F.col("part").cast("string"))
        members = cut.select(name.alias("graph"), "node")
        edges = c.edges.join(cut.select("graph", "part").distinct(), "graph").select(name.alias("graph"), "src", "dst", "label")
        kept = D.clean_parts(edges, members, self.least)
        whole = F.substring_index("graph", "|", 1).cast(c.nodes.schema["graph"].dataType)
        out = c.partition(kept.select(whole.alias("graph"), "node", F.substring_index("graph", "|", -1).alias("part")))
        return out.keep(L.by_structure(out.nodes, out.edges, self.filter_size))


# --- annotations and names


@dataclass
class AnnotatorFromDict(Transform):
    """``values``: node (or graph) to a value of a new column; others get null."""

    name: str
    values: dict[str, str]
    level: str = "nodes"

    def __call__(self, c: GraphCollection) -> GraphCollection:
        key = "node" if self.level == "nodes" else "graph"
        table = c.nodes.sparkSession.createDataFrame(list(self.values.items()), f"{key} string, `{self.name}` string")
        if key == "graph":
            return c.annotate(table, "graphs")
        return GraphCollection(c.graphs, c.nodes.join(table, "node", "left"), c.edges, c.distances)


@dataclass
class BindingSiteAnnotator(Transform):
    """``binding_site``: whether a ligand (or an ion) is bound within the cutoff."""

    include_ions: bool = False
    cutoff: float = 6.0

    def __call__(self, c: GraphCollection) -> GraphCollection:
        from lattisca.operators.annotate import binding_flag

        columns = [f"ligand_{self.cutoff:g}"] + [f"ion_{self.cutoff:g}"] * self.include_ions
        return GraphCollection(c.graphs, c.nodes.withColumn("binding_site", binding_flag([F.col(x) for x in columns])), c.edges, c.distances)


class PDBIDNameTransform(Transform):
    """``name``: the structure's id in lower case."""

    def __call__(self, c: GraphCollection) -> GraphCollection:
        column = "pdbid" if "pdbid" in c.graphs.columns else "graph"
        return replace(c, graphs=c.graphs.withColumn("name", F.lower(F.col(column).cast("string"))))


class DummyAnnotator(Transform):
    """``dummy``: 1 on every residue."""

    def __call__(self, c: GraphCollection) -> GraphCollection:
        return replace(c, nodes=c.nodes.withColumn("dummy", F.lit(1)))


class ChainNameTransform(Transform):
    """``name``: graph and the chain of its first node."""

    def __call__(self, c: GraphCollection) -> GraphCollection:
        first = c.nodes.groupBy("graph").agg(F.min_by("chain", "node").alias("chain"))
        named = c.graphs.join(first, "graph", "left").withColumn("name", F.concat_ws("_", F.col("graph").cast("string"), "chain")).drop("chain")
        return GraphCollection(named, c.nodes, c.edges, c.distances)


# --- whole collections


@dataclass
class RedundancyRemover(Transform):
    """One graph of each component of those no further apart than 1 - ``threshold`` in ``distance_name``."""

    distance_name: str
    threshold: float = 0.95
    resolution: str | None = None

    def __call__(self, c: GraphCollection) -> GraphCollection:
        if c.distances is None:
            raise ValueError("the collection has no distances")
        close = c.distances.where((F.col("metric") == self.distance_name) & (F.col("distance") <= 1 - self.threshold + 1e-12)).select("i", "j")
        best = F.col(self.resolution).try_cast("double") if self.resolution else F.lit(None).cast("double")
        kept = M.redundancy_removal(c.graphs.select(F.col("graph").alias("id"), best.alias("resolution")), close)
        return c.keep(kept.select(F.col("id").alias("graph")))


@dataclass
class RandomSplitter:
    split_train: float = 0.7
    split_valid: float = 0.15
    split_test: float = 0.15
    seed: int = 0

    def __call__(self, c: GraphCollection) -> DataFrame:
        return X.hash_split(c.graphs.select("graph"), "graph", (self.split_train, self.split_valid, self.split_test), self.seed)


@dataclass
class NameSplitter:
    train_names: list[str]
    val_names: list[str]
    test_names: list[str]

    def __call__(self, c: GraphCollection) -> DataFrame:
        rows = [(n, s) for s, names in zip(X.SPLITS, (self.train_names, self.val_names, self.test_names), strict=True) for n in names]
        lists = c.graphs.sparkSession.createDataFrame(rows, "name string, split string")
        return X.name_split(c.graphs.select("graph"), "graph", lists)


@dataclass
class ClusterSplitter:
    """Graphs at least ``similarity_threshold`` alike are one cluster. Clusters fall by hash; with ``balanced`` the driver
    assigns them (their sizes are collected, at most ``most_clusters``) so that sizes keep their tolerance."""

    similarity_threshold: float = 0.5
    distance_name: str = "seq"
    split_train: float = 0.7
    split_valid: float = 0.15
    split_test: float = 0.15
    seed: int = 0
    balanced: bool = False
    most_clusters: int = 100_000

    def clusters(self, c: GraphCollection) -> DataFrame:
        close = c.distances.where((F.col("metric") == self.distance_name) & (F.col("distance") <= 1 - self.similarity_threshold + 1e-12))
        named = P.linked_components(close)
        of = named.select(F.col("node").alias("graph"), F.col("component").alias("cluster"))
        return c.graphs.select("graph").join(of, "graph", "left").withColumn("cluster", F.coalesce("cluster", "graph"))

    def __call__(self, c: GraphCollection) -> DataFrame:
        ratios = (self.split_train, self.split_valid, self.split_test)
        rows = self.clusters(c)
        if not self.balanced:
            return X.cluster_split(rows, "cluster", "graph", ratios, self.seed)
        sizes = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).orderBy("cluster").limit(self.most_clusters + 1).collect()
        if len(sizes) > self.most_clusters:
            raise ValueError("too many clusters to balance on the driver; use balanced=False")
        where = X.assign_clusters([r.n for r in sizes], [{} for _ in sizes], ratios)
        table = c.graphs.sparkSession.createDataFrame([(r.cluster, X.SPLITS[w]) for r, w in zip(sizes, where, strict=True)], "cluster string, split string")
        return rows.join(table, "cluster")
