"""Transforms as objects, on small collections."""

import pytest
from pyspark.sql import functions as F

from lattisca import transforms as T
from lattisca.model import GraphCollection


@pytest.fixture(scope="module")
def c(spark):
    nodes = [(g, f"{g}.{ch}.{i}", ch, i, x, m, float(i), float(i + 1), 0.0) for g, s in (("g1", "ACGUAC"), ("g2", "GGC")) for i, (x, ch, m) in enumerate(zip(s, "AAABBB", [False, True, False, None, True, False], strict=False))]
    n = spark.createDataFrame(nodes, "graph string, node string, chain string, pos int, nt_code string, is_modified boolean, x double, y double, z double")
    e = [("g1", "g1.A.0", "g1.A.1", "B35"), ("g1", "g1.A.1", "g1.A.2", "tSH"), ("g1", "g1.B.3", "g1.B.4", "cWW"), ("g2", "g2.A.0", "g2.A.1", "B35")]
    g = spark.createDataFrame([("g1", "3.5", "Ribosomal RNA"), ("g2", "12.0", "riboswitch")], "graph string, resolution_high string, title string")
    return GraphCollection(g, n, spark.createDataFrame(e, "graph string, src string, dst string, label string"))


def names(c):
    return sorted(r.graph for r in c.graphs.select("graph").distinct().collect())


def test_filters(c):
    assert names(T.SizeFilter(3)(c)) == ["g1"] and names(T.SizeFilter(0, 6)(c)) == ["g2"]
    assert names(T.ResidueAttributeFilter("is_modified", value_checker=lambda v: v, min_valid=2)(c)) == ["g1"]
    mean = T.ResidueAttributeFilter("pos", "aggfunc", lambda v: v > 2)
    assert names(mean(c)) == ["g1"] and names(T.ResidueAttributeFilter("pos", "aggfunc", lambda v: v > 99, compat=True)(c)) == ["g1", "g2"]
    assert names(T.RNAAttributeFilter("title", T.python_checker(lambda v: "switch" in v))(c)) == ["g2"]
    assert names(T.RNAAttributeFilter("nothing", lambda v: v)(c)) == []
    assert names(T.ResidueNameFilter(lambda v: v.endswith("5"))(c)) == ["g1"]
    assert names(T.NameFilter(["G2"])(c)) == ["g2"] and names(T.RibosomalFilter()(c)) == ["g2"]
    assert names(T.ResolutionFilter(4)(c)) == ["g1"] and names(T.ResolutionFilter(2, compat=True)(c)) == ["g2"]
    kept = T.ChainFilter({"g1": ["B"]})(c)
    assert names(kept) == ["g1"] and kept.nodes.count() == 3 and kept.edges.count() == 1
    assert names(T.ComposeFilters([T.SizeFilter(0), T.NameFilter(["g1"])])(c)) == ["g1"]
    assert names(T.Compose([T.IdentityTransform(), T.DummyFilter()])(c)) == ["g1", "g2"]


def test_partitions(c):
    assert names(T.ChainSplitTransform()(c)) == ["g1_A", "g1_B", "g2_A"]
    assert names(T.ConnectedComponentPartition()(c)) == ["g1_0", "g1_1", "g1_2", "g2_0", "g2_1"]
    parts = T.PartitionFromDict({"g1": [["g1.A.0", "g1.A.1"], ["nowhere"], ["g1.A.1"]]})(c)
    assert names(parts) == ["g1_0", "g1_1"] and parts.edges.count() == 1
    assert names(T.Chop(2, 1)(c)) == []  # chains of pairs are all dangling ends


def test_annotations_and_splits(c, spark):
    a = T.AnnotatorFromDict("mark", {"g1.A.0": "x"})(c)
    assert a.nodes.where("mark = 'x'").count() == 1 and a.nodes.count() == 9
    assert {r.name for r in T.ChainNameTransform()(c).graphs.collect()} == {"g1_A", "g2_A"}
    d = c.with_distances("seq", spark.createDataFrame([("g1", "g2", 0.05)], "i string, j string, distance double"))
    assert names(T.RedundancyRemover("seq", 0.9, "resolution_high")(d)) == ["g1"] and names(T.RedundancyRemover("seq", 0.99)(d)) == ["g1", "g2"]
    for balanced in (False, True):
        assert len({r.split for r in T.ClusterSplitter(0.9, balanced=balanced)(d).collect()}) == 1
    assert T.RandomSplitter()(c).count() == 2
    assert {(r.graph, r.split) for r in T.NameSplitter(["g2"], [], ["g1", "none"])(c).collect()} == {("g2", "train"), ("g1", "test")}
    with pytest.raises(ValueError, match="no distances"):
        T.RedundancyRemover("seq")(c)
    assert c.nodes.where(F.col("x").isNull()).count() == 0
