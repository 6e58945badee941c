"""Representations as objects: each turns a collection into a row for each graph. A ``Represented`` collection holds several and
gives them side by side, one graph at a time, or in batches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from lattisca.functions.encoders import FeaturesComputer
from lattisca.model import GraphCollection
from lattisca.operators import edges as E
from lattisca.operators import kernels as N
from lattisca.operators import represent as R
from lattisca.operators import sequence as Q
from lattisca.operators import spatial as S
from lattisca.operators import traverse as T
from lattisca.shared import ranked


class Representation:
    """``rows`` gives (graph, ...), a row for each graph that can be represented."""

    name = ""

    def rows(self, c: GraphCollection) -> DataFrame:
        raise NotImplementedError


@dataclass
class GraphRepresentation(Representation):
    """Node ids and features by index, sorted edges and their label codes; ``clean_edges`` drops labels without a code,
    ``canonical`` keeps canonical edges alone."""

    clean_edges: bool = True
    canonical: bool = False
    x: str = "features"
    name = "graph"

    def rows(self, c: GraphCollection) -> DataFrame:
        edges = E.known_edges(c.edges) if self.clean_edges else c.edges
        return R.graph_tensors(c.nodes, E.canonical_edges(edges) if self.canonical else edges, self.x)


@dataclass
class SequenceRepresentation(Representation):
    """The longest run of each chain as letters, with features and, as ``edge_index``, the backbone in one or both directions."""

    backbone: str = "both"
    x: str | None = None
    letter: str = "nt_code"
    name = "sequence"

    def rows(self, c: GraphCollection) -> DataFrame:
        whole = R.sequence_rows(c.nodes, Q.standard_letter(F.col(self.letter)), x=self.x)
        edges = R.sequence_edges(whole, self.backbone).groupBy("graph").agg(F.array_sort(F.collect_list(F.array("i", "j"))).alias("edge_index"))
        return whole.join(edges, "graph", "left")


@dataclass
class PointCloudRepresentation(Representation):
    name = "point_cloud"

    def rows(self, c: GraphCollection) -> DataFrame:
        return R.point_cloud(c.nodes.where("x is not null"))


@dataclass
class VoxelRepresentation(Representation):
    """Cells with a weight as a sparse array, (ix, iy, iz, weight) in order."""

    spacing: float = 2.0
    padding: float = 3.0
    sigma: float = 1.0
    name = "voxel"

    def rows(self, c: GraphCollection) -> DataFrame:
        cells = S.voxels(c.nodes.where("x is not null"), self.spacing, self.padding, self.sigma)
        return cells.groupBy("graph").agg(F.array_sort(F.collect_list(F.struct("ix", "iy", "iz", "weight"))).alias("cells"))


@dataclass
class RingRepresentation(Representation):
    """Each residue's rings, and, with a kernel, the similarities of a graph's residues (of at most ``most`` of them)."""

    depth: int = 2
    kernel: N.RingKernel | None = None
    most: int | None = None
    name = "ring"

    def rows(self, c: GraphCollection) -> DataFrame:
        roots = c.nodes.select("graph", F.col("node").alias("root"))
        rings = N.ring_arrays(T.rings(E.undirected(c.edges), roots, self.depth), self.depth)
        packed = rings.groupBy("graph").agg(F.array_sort(F.collect_list(F.struct("root", "rings"))).alias("rings"))
        if self.kernel is None:
            return packed
        matrix = N.kernel_matrix(rings, self.kernel, self.most).groupBy("graph").agg(F.array_sort(F.collect_list(F.struct("a", "b", "similarity"))).alias("similarities"))
        return packed.join(matrix, "graph", "left")


@dataclass
class GVPGraphRepresentation(Representation):
    """Scalar and vector features of nodes and edges; edges join the nearest residues (``knn``) or those that pair (``base_pair``)."""

    graph_construction: str = "knn"
    top_k: int = 16
    name = "gvp_graph"

    def rows(self, c: GraphCollection) -> DataFrame:
        points = c.nodes.where("x is not null").select("graph", "node", "x", "y", "z")
        pairs = None if self.graph_construction == "knn" else c.edges.select("graph", F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
        nodes, edges = R.vector_features(points, ["graph"], self.top_k, pairs)
        n = nodes.groupBy("graph").agg(F.array_sort(F.collect_list(F.struct("node", "scalars", "vectors"))).alias("nodes"))
        e = edges.groupBy("graph").agg(F.array_sort(F.collect_list(F.struct("a", "b", "scalars", "vector"))).alias("edges"))
        return n.join(e, "graph", "left")


@dataclass
class Represented:
    """A collection, its features and representations. One of a name replaces another."""

    collection: GraphCollection
    features: FeaturesComputer = field(default_factory=FeaturesComputer)
    representations: list[Representation] = field(default_factory=list)

    def add_representation(self, *some: Representation) -> None:
        for one in some:
            self.remove_representation(one.name)
            self.representations.append(one)

    def remove_representation(self, *names: str) -> None:
        self.representations = [r for r in self.representations if r.name not in names]

    def add_feature(self, name: str, encoder=None, is_input: bool = True) -> None:  # noqa: ANN001
        self.features.add_feature(name, encoder, is_input)

    def _featured(self) -> GraphCollection:
        c = self.collection
        return GraphCollection(c.graphs, self.features.compute(c.nodes), c.edges, c.distances)

    def rows(self) -> DataFrame:
        """(name, a struct for each representation); null where a graph has none."""
        c = self._featured()
        out = c.graphs.select(F.col("graph").alias("name"))
        for r in self.representations:
            rows = r.rows(c)
            held = rows.select(F.col("graph").alias("_graph"), F.struct(*[x for x in rows.columns if x != "graph"]).alias(r.name))
            out = out.join(held, F.col("name") == F.col("_graph"), "left").drop("_graph")
        return out

    def indexed(self) -> DataFrame:
        """(idx, name, ...): the rows by name, numbered from 0."""
        return ranked(self.rows(), ["name"], "idx")

    def __len__(self) -> int:
        return self.collection.graphs.count()

    def item(self, name) -> Row | None:  # noqa: ANN001
        """One graph's representations; the filter on its name reaches every scan."""
        return Represented(self.collection.keep(self.collection.graphs.where(F.col("graph") == name)), self.features, self.representations).rows().first()

    def batches(self, size: int) -> Iterator[list[Row]]:
        """Rows in batches on the driver, a partition at a time."""
        kept: list[Row] = []
        for row in self.indexed().orderBy("idx").toLocalIterator():
            kept.append(row)
            if len(kept) == size:
                yield kept
                kept = []
        if kept:
            yield kept
