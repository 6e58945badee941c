"""What SQL doesn't express, against plain Python on the same rows."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattisca.operators import clean as D
from lattisca.operators import kernels as N
from lattisca.operators import labels as B
from lattisca.operators import partition as P
from lattisca.operators import predicates as H
from lattisca.operators import represent as R
from lattisca.operators import similarity as M
from lattisca.plans import analysis_queries, graph_queries, source_queries, structure_queries
from lattisca.shared import ranked, running_sum
from lattisca.sources import adapters as A

SF = "/root/testdata/sf0.001"


def by_graph(rows):
    out = {}
    for graph, *rest in rows:
        out.setdefault(graph, []).append(tuple(rest))
    return out


def trimmed(pairs):
    left = {frozenset(p) for p in pairs if p[0] != p[1]}
    while True:
        degree = {}
        for p in left:
            for x in p:
                degree[x] = degree.get(x, 0) + 1
        after = {p for p in left if all(degree[x] >= 2 for x in p)}
        if after == left:
            return left
        left = after


def neighbours(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return near


def test_dangle_trim_of_conversations(spark):
    edges = by_graph(A.conv_edges(spark, SF).collect())
    got = by_graph(analysis_queries.dangle_trim(spark, SF).collect())
    want = {g: trimmed([e[:2] for e in rows]) for g, rows in edges.items()}
    assert {g: {frozenset(e) for e in rows} for g, rows in got.items()} == {g: w for g, w in want.items() if w}


def test_long_paths_trim_to_nothing(spark):
    path = spark.range(1000).select(F.lit("g").alias("graph"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit("A").alias("label"))
    ring = spark.createDataFrame([("r", i, (i + 1) % 3, "A") for i in range(3)] + [("r", 2, 7, "A"), ("r", 5, 5, "A")], path.schema)
    assert {(r.graph, r.src, r.dst) for r in D.dangle_trim(path.union(ring)).collect()} == {("r", 0, 1), ("r", 1, 2), ("r", 0, 2)}
    assert D.dangle_trim(path.limit(0)).count() == 0


def stacks_off(rows):
    """Round by round, as it is defined."""
    left = set(rows)
    while True:
        near = neighbours([e[:2] for e in left])
        kind = lambda x, y: {e[2] for e in left if set(e[:2]) == {x, y}}  # noqa: B023, E731
        gone = set()
        for n in near:
            if len(near[n]) != 2:
                continue
            for s, p in itertools.permutations(near[n]):
                if kind(n, s) & {"B53", "B35"} and "cWW" in kind(n, p) and not kind(n, p) & {"B53", "B35"} and "cWW" not in kind(n, s) and len(near[p]) <= 3:
                    if any(kind(p, q) & {"B53", "B35"} and "cWW" in kind(s, q) for q in near[p]):
                        gone |= {n, p}
        if not gone:
            return left
        left = {e for e in left if not gone & set(e[:2])}


def test_stack_trim_round_by_round(spark):
    edges = A.hairpin_edges(spark, SF)
    want = {(g, *e) for g, rows in by_graph(edges.collect()).items() for e in stacks_off(rows)}
    assert {tuple(r) for r in D.stack_trim(edges).collect()} == want


def test_odd_part(spark):
    edges, nodes = A.hairpin_edges(spark, SF), A.hairpin_nodes(spark, SF)
    want = {}
    for g, rows in by_graph(edges.collect()).items():
        near = neighbours([e[:2] for e in rows])
        odd = {frozenset(e[:2]) for e in rows if e[2].upper() not in ("B53", "B35", "CWW")}
        kept = {n for n in near if len(near[n]) == 2 or any(p <= near[n] | {n} for p in odd)}
        left = trimmed([e[:2] for e in rows if set(e[:2]) <= kept])
        if len(set().union(*left)) > 4 if left else False:
            want[g] = left
    got = by_graph(structure_queries.odd_part(spark, SF).collect())
    assert {g: {frozenset(e) for e in rows} for g, rows in got.items()} == want
    assert H.odd_within(edges, nodes.select("graph", F.col("node").alias("root")), 1).count() == nodes.count()


def test_greedy_clusters(spark):
    m = spark.read.parquet(f"{SF}/lineitem.parquet").select(F.col("l_orderkey").alias("id"), F.concat_ws(".", "l_partkey", "l_suppkey").alias("item"))
    sets = {}
    for r in m.collect():
        sets.setdefault(r.id, []).append(r.item)
    close = M.tanimoto(m).where("similarity >= 0.15").select("i", "j").collect()
    near = neighbours([tuple(r) for r in close])
    heads, want = [], {}
    for i in sorted(sets, key=lambda i: (-len(sets[i]), i)):
        want[i] = next((h for h in heads if h in near.get(i, ())), i)
        heads += [i] * (want[i] == i)
    got = {r.id: r.cluster for r in analysis_queries.greedy_cluster(spark, SF).collect()}
    assert got == want and any(i != c for i, c in got.items())


def test_greedy_clusters_of_a_chain(spark):
    items = spark.createDataFrame([(i, 5) for i in range(30)] + [(40, 9)], "id long, length long")
    close = spark.createDataFrame([(i, i + 1) for i in range(29)] + [(29, 40)], "i long, j long")
    got = {r.id: r.cluster for r in M.greedy_clusters(items, close).collect()}
    assert got == {40: 40, 29: 40, **{i: i - i % 2 for i in range(29)}}


def brute_distance(one, two):
    nodes = [sorted({n for e in s for n in e[:2]}) for s in (one, two)]
    size = max(map(len, nodes))
    pads = [list(n) + [f"{k}-{i}" for i in range(size - len(n))] for k, n in enumerate(nodes)]
    second = {(a, b): k for a, b, k in two}
    best = math.inf
    for image in itertools.permutations(pads[1]):
        to = dict(zip(pads[0], image, strict=True))
        mapped = {(to[a], to[b]): k for a, b, k in one}
        best = min(best, sum(second.get(e) != k for e, k in mapped.items()) + sum(e not in mapped for e in second))
    return best


def test_edit_distances_of_conversations(spark):
    from lattisca.operators import edges as E

    graphs = {g: {tuple(e) for e in rows} for g, rows in by_graph(E.undirected(A.conv_edges(spark, SF)).select("graph", "src", "dst", "label").collect()).items()}
    got = {r.graph: r.ged for r in analysis_queries.ged(spark, SF).collect()}
    small = [g for g in got if all(len({n for e in graphs[x] for n in e[:2]}) <= 6 for x in (g, g + 1))]
    assert small and set(got) == {g for g in graphs if g + 1 in graphs}
    for g in small:
        assert got[g] == brute_distance(graphs[g], graphs[g + 1])


def test_pca_chop(spark):
    points = A.points(spark, SF).select("graph", "node", "x", "y", "z")
    at = {r.node: np.array(r[2:]) for r in points.collect()}
    parts = {}
    for r in graph_queries.pca_chop(spark, SF).collect():
        parts.setdefault((r.graph, r.part), []).append(r.node)
    assert sorted(n for p in parts.values() for n in p) == sorted(at) and max(map(len, parts.values())) <= 12

    def halves(nodes):
        """By the first axis of a singular value decomposition."""
        if len(nodes) <= 12:
            return [frozenset(nodes)]
        x = np.array([at[n] for n in nodes])
        axis = np.linalg.svd(x - x.mean(0))[2][0]
        right = (x - x.mean(0)) @ axis >= 0
        return halves([n for n, r in zip(nodes, right, strict=True) if r]) + halves([n for n, r in zip(nodes, right, strict=True) if not r])

    molecules = {}
    for r in points.collect():
        molecules.setdefault(r.graph, []).append(r.node)
    assert {frozenset(p) for p in parts.values()} == {h for nodes in molecules.values() for h in halves(sorted(nodes))}


def test_ring_kernel(spark):
    """Rings by a walk of their own, matched over all assignments."""
    from lattisca.operators import edges as E

    pairs = by_graph(E.undirected(A.conv_edges(spark, SF)).select("graph", "src", "dst", "label").collect())
    rings = {}
    for g, rows in pairs.items():
        near = neighbours([e[:2] for e in rows])
        for root in near:
            hop, border = {root: 0}, {root}
            for h in (1, 2):
                border = {y for x in border for y in near[x]} - hop.keys()
                hop |= dict.fromkeys(border, h)
            rings[g, root] = [sorted(e[2] for e in rows if min(hop.get(e[0], 9), hop.get(e[1], 9)) == h) for h in (0, 1)]

    def matched(a, b):
        a, b = sorted((a, b), key=len)
        if not a:
            return float(not b)
        return max(sum(N.isostericity(x, y) for x, y in zip(a, p, strict=True)) for p in itertools.permutations(b, len(a))) / len(b)

    def alike(a, b):
        share = lambda k: 1.0 if a.count(k) == b.count(k) == 0 else (min(a.count(k), b.count(k)) / max(a.count(k), b.count(k))) ** 1.5
        return (matched([x for x in a if x[0] != "B"], [x for x in b if x[0] != "B"]) + (share("B53") + share("B35")) / 2) / 2

    got = source_queries.ring_kernel(spark, SF).collect()
    assert len(got) == sum(n * (n - 1) // 2 for n in (sum(k[0] == g for k in rings) for g in pairs))
    for r in got:
        a, b = rings[r.graph, r.a], rings[r.graph, r.b]
        assert r.similarity == pytest.approx(sum(0.5 ** (k + 1) * alike(a[k], b[k]) for k in (0, 1)) / 0.75)


def test_vector_features(spark):
    points = by_graph(A.points(spark, SF).select("graph", "node", "x", "y", "z").collect())
    rows = source_queries.vector_features(spark, SF).collect()
    want = 0
    for g, some in points.items():
        some.sort()
        at = {n: np.array(p) for n, *p in some}
        rank = {n: i for i, n in enumerate(at)}
        near = {n: sorted((m for m in at if m != n), key=lambda m: (((at[m] - at[n]) ** 2).sum(), m))[:8] for n in at}
        mine = {(r.a, r.b): r for r in rows if r.graph == g}
        assert set(mine) == {(n, m) for n in at for m in near[n]}
        want += len(mine)
        for (a, b), r in mine.items():
            step = at[b] - at[a]
            size = math.sqrt(step @ step + 1e-3)
            centres = np.linspace(0, 30, 32)
            periods = 10 ** np.linspace(0, 3, 16)
            turns = 2 * np.pi / periods * (rank[b] - rank[a])
            assert np.allclose(r.vector, step / size) and np.allclose(r.scalars, [*np.exp(-(((size - centres) / (30 / 31)) ** 2)), *np.cos(turns), *np.sin(turns)])
    assert want == len(rows)


def test_linked_components_and_rounds(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(300)]
    links = spark.createDataFrame(pairs, "i long, j long")
    near = neighbours(pairs)
    found = {}
    for x in sorted(near):
        todo = [x]
        while todo:
            y = todo.pop()
            if y not in found:
                found[y] = x
                todo += near[y]
    assert {r.node: r.component for r in P.linked_components(links).collect()} == {x: c for x, c in found.items() if near[x] - {x}}
    with pytest.raises(RuntimeError, match="rounds"):
        P.linked_components(links, rounds=1)


def test_numbering_over_all_rows(spark):
    rng = random.Random(4)
    values = [rng.randrange(500) for _ in range(2000)]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v long, i long").repartition(7)
    got = {r.i: r.n for r in ranked(df, ["v", "i"], "n").collect()}
    assert got == {i: n for n, (_, i) in enumerate(sorted((v, i) for i, v in enumerate(values)))}
    sums = {r.i: r.s for r in running_sum(df, ["v", "i"], F.col("v"), "s").collect()}
    order = sorted((v, i) for i, v in enumerate(values))
    assert all(sums[i] == sum(v for v, _ in order[:n]) for n, (_, i) in list(enumerate(order))[::97])
    assert ranked(df.limit(0), ["v"], "n").count() == 0


def test_clean_parts_of_a_path(spark):
    """A path with a tail is trimmed to nothing, a ring stays, a small ring goes."""
    ring = [("g", i, (i + 1) % 9, "cWW") for i in range(9)]
    small = [("g", 100 + i, 100 + (i + 1) % 3, "cWW") for i in range(3)]
    path = [("g", 200 + i, 201 + i, "cWW") for i in range(12)]
    edges = spark.createDataFrame(ring + small + path, "graph string, src long, dst long, label string")
    members = spark.createDataFrame([("g", n) for n in [*range(8), *range(100, 103), *range(200, 210)]], "graph string, node long")
    assert {r.node for r in D.clean_parts(edges, members, 8).collect()} == set(range(9))


def test_sequence_batches(spark):
    tensors = R.graph_tensors(A.conv_nodes(spark, SF), A.conv_edges(spark, SF), "size")
    rows = {r.graph: r for r in tensors.collect()}
    got = sorted(R.collated(tensors, 7).collect(), key=lambda r: r.batch)
    assert [g for r in got for g in r.graphs] == sorted(rows) and all(len(r.graphs) <= 7 for r in got)
    for r in got:
        x, edges, of = [], [], []
        for k, g in enumerate(r.graphs):
            edges += [[i + len(x), j + len(x)] for i, j in rows[g].edge_index or []]
            of += [k] * len(rows[g].x)
            x += rows[g].x
        assert (r.x, r.edge_index, r.graph_of) == (x, edges, of)


def test_similar_sets_are_those_of_the_full_join(spark):
    rng = random.Random(6)
    rows = [(i, f"x{rng.choice([rng.randrange(8), rng.randrange(60)])}") for i in range(150) for _ in range(rng.randrange(1, 12))]
    m = spark.createDataFrame(rows, "id long, item string")
    for least in (0.15, 0.5, 0.8, 1.0):
        want = {(r.i, r.j): r.similarity for r in M.tanimoto(m).collect() if r.similarity >= least}
        got = {(r.i, r.j): r.similarity for r in M.similar_sets(m, least).collect()}
        assert got == pytest.approx(want) and want


def most_joined(spark, run):
    """The most rows that a join made while ``run`` ran."""
    store = spark._jsparkSession.sharedState().statusStore()
    before, out = store.executionsCount(), 0
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    done = store.executionsList()
    for k in range(before, done.size()):
        e = done.apply(k).executionId()
        values, nodes = store.executionMetrics(e), store.planGraph(e).allNodes()
        for n in (nodes.apply(x) for x in range(nodes.size())):
            if "Join" in n.name():
                for m in (n.metrics().apply(x) for x in range(n.metrics().size())):
                    if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                        out = max(out, int(str(values.apply(m.accumulatorId())).replace(",", "")))
    return out


def test_similar_sets_meet_by_more_than_one_common_item(spark):
    """Sets of few items in all: each item is in thousands of sets, most of which are not alike."""
    rng = random.Random(8)
    rows = [(i, f"x{x}") for i in range(4000) for x in rng.sample(range(24), rng.choice([5, 6, 7]))] + [(i, "y") for i in range(5000, 5600)]
    m = spark.createDataFrame(rows, "id long, item string").repartition(4)
    got, sets = [], {}
    for i, x in rows:
        sets.setdefault(i, set()).add(x)
    joined = most_joined(spark, lambda: got.extend(tuple(r) for r in M.similar_sets(m, 0.75).collect()))
    want = {(i, j) for i, j in itertools.combinations(range(4000), 2) if 4 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j])}
    assert len(got) == len({g[:2] for g in got}) and {g[:2] for g in got if g[0] < 5000} == want
    assert sum(g[0] >= 5000 for g in got) == 600 * 599 // 2
    assert 0 < joined < 20 * len(rows)


def test_similar_sets_count_null_items_and_no_null_ids(spark):
    rows = [(1, "a"), (1, "b"), (1, None), (2, "a"), (2, "b"), (2, None), (3, "a"), (3, "b"), (None, "a"), (None, "b"), (4, None), (5, None)]
    m = spark.createDataFrame(rows, "id long, item string")
    assert sorted((r.i, r.j, r.similarity) for r in M.similar_sets(m, 0.4).collect()) == [(1, 2, 0.5), (1, 3, 2 / 3), (2, 3, 2 / 3)]


def many_members(spark, n=120_000):
    """Terms of so many items that the product of four counts is beyond 64 bits: two that halve the items across each other,
    one that is nearly the first, and one of the items without these."""
    a, b, c = F.col("id") < n // 2, F.col("id") % 2 == 0, F.col("id") < n // 2 - n // 100
    terms = F.array(F.when(a, "a"), F.when(b, "b"), F.when(c, "c"), F.when(~a & ~b, "d"))
    return spark.range(n).select("id", F.explode(terms).alias("term")).where("term is not null")


def test_correlations_of_many_items(spark):
    n = 120_000
    x = {"a": np.arange(n) < n // 2, "b": np.arange(n) % 2 == 0, "c": np.arange(n) < n // 2 - n // 100}
    want = {(p, q): np.corrcoef(x[p], x[q])[0, 1] for p, q in ("ab", "ac", "bc")}  # "d" shares no item
    got = {(r.a, r.b): r["corr"] for r in B.correlations(many_members(spark, n)).collect()}
    assert got == pytest.approx(want, abs=1e-9)


def test_pruning_of_many_items(spark):
    m = many_members(spark)
    kept = {limit: {r.term for r in B.uncorrelated(m, limit).select("term").distinct().collect()} for limit in (0.9, 0.99)}
    assert kept == {0.9: {"a", "b", "d"}, 0.99: {"a", "b", "c", "d"}}


def test_bound_of_the_edit_distance():
    rng = random.Random(7)
    sub = lambda a, b: 0.0 if a == b else 1.0
    graph = lambda n, m: {(a, b): rng.choice("AB") for a, b in (rng.sample(range(n), 2) for _ in range(m))}
    flat = lambda g: {(a, b, k) for (a, b), k in g.items()}
    for _ in range(40):
        one, two = flat(graph(5, 6)), flat(graph(5, 6))
        assert M.edit_distance(one, two, sub, lambda _: 1.0) <= M.edit_distance_bound(one, two, sub, lambda _: 1.0)
    path = {(i, i + 1, "A") for i in range(30)}
    assert M.edit_distance_bound(path, {(a + 100, b + 100, k) for a, b, k in path}, sub, lambda _: 1.0) == 0
    kernel = N.RingKernel("R_graphlets", 1)
    assert kernel.r_graphlets([list(path)], [[(a + 9, b + 9, "A") for a, b, _ in path]]) == 1
    assert M.edit_distance_bound(set(), path, sub, lambda _: 1.0) == 30


def test_graph_handles(spark, tmp_path):
    from lattisca.model import GraphHandle

    value = {"name": "1abc", "nodes": ["1abc.A.1", "1abc.A.2"], "edges": [("1abc.A.1", "1abc.A.2", "B35"), ("1abc.A.1", "1abc.A.2", "cWW")]}
    g = GraphHandle.get(spark, value=value)
    assert g.to_dict() == value
    g.save(f"{tmp_path}/g")
    assert GraphHandle.get(spark, path=f"{tmp_path}/g").to_dict() == value | {"edges": value["edges"][:1]}  # the backbone wins
    assert GraphHandle.get(spark, name="1abc", among=g.collection).to_dict() == value
    with pytest.raises(ValueError, match="one of"):
        GraphHandle.get(spark, value=value, path="x")


def test_build_command(spark, tmp_path):
    """Structures to a collection, pieces and rings; a second run with --resume leaves what is there."""
    import argparse

    from lattisca.__main__ import build
    from lattisca.sources import structures as Z

    Z.write_structures(source_queries._atoms(spark, SF).where("pdbid in ('m0', 'm1', 'm2')"), f"{tmp_path}/cif")
    args = argparse.Namespace(structures=f"{tmp_path}/cif/*", out=f"{tmp_path}/out", pairs=None, debug=2, chop=False, annotate=True, resume=True)
    build(spark, args)
    graphs = spark.read.parquet(f"{tmp_path}/out/graphs/graphs")
    assert sorted(r.graph for r in graphs.collect()) == ["m0", "m1"]
    before = (tmp_path / "out/hashes/_SUCCESS").stat().st_mtime
    assert spark.read.parquet(f"{tmp_path}/out/hashes").count() > 0
    build(spark, args)
    assert (tmp_path / "out/hashes/_SUCCESS").stat().st_mtime == before
