"""Operators on small graphs with known results."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattisca.functions import encoders as C
from lattisca.operators import clean as D
from lattisca.operators import edges as E
from lattisca.operators import filters as L
from lattisca.operators import metrics as K
from lattisca.operators import partition as P
from lattisca.operators import sequence as Q
from lattisca.operators import similarity as M
from lattisca.operators import split as X
from lattisca.operators import traverse as T

EDGE = "graph string, src int, dst int, label string"


def edges(spark, *rows):
    return spark.createDataFrame([("g", *r) for r in rows], EDGE)


def test_edge_rings(spark):
    e = edges(spark, (1, 2, "A"), (1, 3, "B"), (2, 3, "C"), (3, 4, "A"))
    got = T.rings(e, spark.createDataFrame([("g", 1)], "graph string, root int"), 2).collect()
    assert sorted(r.label for r in got if r.hop == 1) == ["A", "B"]
    assert sorted(r.label for r in got if r.hop == 2) == ["A", "C"]
    ball = {r.node: r.hop for r in T.ball(e, spark.createDataFrame([("g", 1)], "graph string, root int"), 2, directed=False).collect()}
    assert ball == {1: 0, 2: 1, 3: 1, 4: 2}


def test_chop_halves():
    line = np.array([[i, i + 1, i + 2] for i in range(100)], float)
    parts = P.chop(line, 50)
    assert sorted(np.bincount(parts)) == [50, 50]
    same = P.chop(np.zeros((9, 3)), 4)
    assert max(np.bincount(same)) <= 4


def test_graph_filter(spark):
    nodes = spark.createDataFrame([("g", i) for i in range(15)], "graph string, node int")
    assert L.by_structure(nodes, edges(spark, (1, 2, "CWW"), (2, 3, "B35"), (3, 4, "TWW"))).count() == 1
    assert L.by_structure(nodes.where("node < 2"), edges(spark, (1, 2, "TWW"))).count() == 0
    assert L.by_structure(nodes, edges(spark, (1, 2, "cWW"), (2, 3, "B35"))).count() == 0


def test_wl_hash_tells_labels_apart(spark):
    one = [("a", 1, 2, "A"), ("a", 2, 3, "A"), ("a", 3, 1, "A"), ("a", 1, 4, "B")]
    two = [("b", 5, 6, "B"), ("b", 6, 7, "A"), ("b", 7, 5, "A"), ("b", 7, 8, "A")]
    e = spark.createDataFrame(one + two, EDGE)
    both = e.union(e.select("graph", "dst", "src", "label"))
    nodes = both.select("graph", F.col("src").alias("node"), F.lit("n").alias("code")).distinct()
    assert len({r.hash for r in T.wl_hash(both, nodes, "code", 3).collect()}) == 2
    assert len({r.hash for r in T.wl_hash(both.withColumn("label", F.lit("A")), nodes, "code", 3).collect()}) == 1


def test_simple_graph_prefers_backbone_then_last(spark):
    e = spark.createDataFrame([("g", 1, 2, "cWW", 1), ("g", 1, 2, "B53", 0), ("g", 3, 4, "cWW", 1), ("g", 3, 4, "tSH", 2)], EDGE + ", ord int")
    assert {(r.src, r.label) for r in E.simple_graph(e, ["ord"]).collect()} == {(1, "B53"), (3, "tSH")}


def test_components_and_trim_against_search(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def reach(x):
        seen, todo = {x}, [x]
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        return seen

    e = edges(spark, *[(a, b, "A") for a, b in pairs])
    got = {r.node: r.component for r in P.connected_components(e).collect()}
    assert got == {x: min(reach(x)) for x in near if near[x] - {x}}
    left = {frozenset(p) for p in pairs if p[0] != p[1]}
    while True:
        degree = {x: sum(x in p for p in left) for x in near}
        after = {p for p in left if all(degree[x] >= 2 for x in p)}
        if after == left:
            break
        left = after
    assert {frozenset((r.src, r.dst)) for r in D.dangle_trim(e).collect()} == left


def test_runs_break_at_gaps(spark):
    pos = [1, 2, 4, 7, 8, 9, 20]
    nodes = spark.createDataFrame([("g", p, "A") for p in pos], "graph string, pos int, code string")
    got = Q.sequences(nodes, ["graph"], Q.standard_letter(F.col("code")), 2, 0).orderBy("first").collect()
    assert [(r.first, r.last, r.n) for r in got] == [(1, 4, 3), (7, 9, 3), (20, 20, 1)]
    assert Q.longest_run(nodes, ["graph"], F.col("code")).first().first == 7  # the last of equals


def test_hungarian_against_all_assignments():
    rng = np.random.default_rng(2)
    for n, m in ((1, 1), (3, 3), (3, 5), (5, 4)):
        cost = rng.integers(0, 9, (n, m)).astype(float)
        small = cost if n <= m else cost.T
        best = min(sum(small[i, p[i]] for i in range(len(small))) for p in itertools.permutations(range(small.shape[1]), len(small)))
        assert M.hungarian(cost)[1] == pytest.approx(best)


def test_edit_distance():
    sub = lambda a, b: 0.0 if a == b else 1.0
    one = {(1, 2, "A"), (2, 3, "B")}
    assert M.edit_distance(one, {(7, 8, "A"), (8, 9, "B")}, sub, lambda _: 1.0) == 0
    assert M.edit_distance(one, {(7, 8, "A")}, sub, lambda _: 1.0) == 1
    assert M.edit_distance(one, {(7, 8, "A"), (8, 9, "C")}, sub, lambda _: 1.0) == 1
    assert M.edit_distance({(i, i + 1, "A") for i in range(9)}, one, sub, lambda _: 1.0) is None


def test_edit_distance_of_larger_graphs():
    sub = lambda a, b: 0.0 if a == b else 1.0
    ring = {(i, (i + 1) % 9, "AB"[i % 2]) for i in range(9)}
    turned = {(20 - s, 20 - d, k) for s, d, k in ring}
    assert M.edit_distance(ring, turned, sub, lambda _: 1.0) == 0
    assert M.edit_distance(ring, turned - {(20, 19, "A")} | {(20, 18, "B")}, sub, lambda _: 1.0) == 2


def test_ged_of_eight_turns(spark, tmp_path):
    from lattisca.plans.analysis_queries import ged

    turns = [(c, t, ("user", "assistant")[t % 2], "x") for c, n in ((1, 8), (2, 8), (3, 7)) for t in range(n)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.graph: r.ged for r in ged(spark, str(tmp_path)).collect()}
    assert got == {1: 0.0, 2: 2.0}


def test_assignment_of_clusters():
    sizes = [1, 2, 1, 1]
    labels = [{0: 32, 1: 2}, {0: 28 + 30, 1: 3 + 1}, {}, {0: 25, 1: 4}]
    where = X.assign_clusters(sizes, labels, (0.7, 0.15, 0.15))
    assert sorted(where.count(j) > 0 for j in range(3)) == [True] * 3
    with pytest.raises(ValueError, match="sum to one"):
        X.check_ratios((0.5, 0.1, 0.1))


def test_redundancy_keeps_the_best_resolution(spark):
    items = spark.createDataFrame([(1, 3.0), (2, 1.5), (3, None), (4, 9.9)], "id long, resolution double")
    close = spark.createDataFrame([(1, 2), (2, 3)], "i long, j long")
    assert {(r.id, r.members) for r in M.redundancy_removal(items, close).collect()} == {(2, 3), (4, 1)}


def test_encoders(spark):
    df = spark.createDataFrame([("G", "x", [1.0, None, 2.0]), (None, None, None), ("c", "0", [1.0, 2.0, 3.0])], "nt string, flag string, xyz array<double>")
    f = C.FeaturesComputer(custom={"nt": C.NODE_FEATURES["nt_code"], "flag": C.BoolEncoder(), "xyz": C.ListEncoder(3)})
    for name in ("nt", "flag", "xyz"):
        f.add_feature(name)
    assert f.input_dim == 8
    assert [r.features for r in f.compute(df).collect()] == [[0, 0, 0, 1, 1, 0, 0, 0], [0] * 8, [0, 0, 1, 0, 0, 1, 2, 3]]
    with pytest.raises(ValueError, match="no encoder"):
        f.parser(["nothing"])
    assert [r[0] for r in df.select(C.SymbolEncoder().decode(C.SymbolEncoder().code(F.col("nt")))).collect()] == ["G", "X", "C"]


def test_metrics_by_hand(spark):
    rows = spark.createDataFrame([(1, 1, 0.9), (1, 0, 0.4), (0, 0, 0.4), (0, 1, 0.8), (1, 1, 0.7)], "y int, p int, s double")
    s = K.summary(K.per_class(K.confusion(rows, "y", "p"))).first()
    assert s.accuracy == pytest.approx(0.6) and s.balanced_accuracy == pytest.approx((2 / 3 + 1 / 2) / 2) and s.mcc == pytest.approx(1 / 6)
    assert K.roc_auc(rows, "y", "s").first().auc == pytest.approx(3.5 / 6)
