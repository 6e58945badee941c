"""Ring kernels, annotations and vector features."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from lattisca.operators import annotate, represent
from lattisca.operators import kernels as N


def test_r_1_and_weights():
    k = N.RingKernel("R_1", depth=2, decay=0.5)
    assert k.compare([["B53"], []], [["B53"], []]) == pytest.approx(1)
    assert k.compare([["A", "B"], ["C"]], [["A"], []]) == pytest.approx((0.5 * 0.5 + 0.25 * 0) / 0.75)
    assert N.RingKernel("R_1", 1, 0.5, idf={"A": 2.0}).compare([["A", "B"]], [["A", "C"]]) == 1
    with pytest.raises(ValueError, match="no method"):
        N.RingKernel("R_9")


def test_r_iso_matches_pairs_best():
    one, two = ["cWW", "tSH", "B53"], ["tHS", "cWW", "cSS", "B53"]
    pairs = [x for x in two if x != "B53"]
    best = max(N.isostericity("cWW", a) + N.isostericity("tSH", b) for a, b in itertools.permutations(pairs, 2))
    assert N.RingKernel("R_iso").r_iso(one, two) == pytest.approx((best / 3 + 1) / 2)
    assert N.isostericity("B53", "B35") == 0.2 and N.isostericity("B53", "cWW") == 0 and N.isostericity("tSH", "cWW") == pytest.approx(math.exp(-8.2 / 8))


def test_kernel_matrix_and_edit_distance(spark):
    rings = spark.createDataFrame([("g", 1, [["B53"], ["cWW"]]), ("g", 2, [["B53"], ["cWW"]]), ("g", 3, [["B35"], []])], "graph string, root int, rings array<array<string>>")
    got = {(r.a, r.b): r.similarity for r in N.kernel_matrix(rings, N.RingKernel("R_1", 2)).collect()}
    assert got[1, 2] == pytest.approx(1) and got[1, 3] == 0
    assert N.kernel_matrix(rings, N.RingKernel("hungarian", 2)).count() == 3
    graphlets = spark.createDataFrame([("x", [(1, 2, "cWW")]), ("y", [(1, 2, "cWW"), (2, 3, "B53")])], "hash string, edges array<struct<src:int,dst:int,label:string>>")
    pairs = spark.createDataFrame([("x", "y"), ("y", "x"), ("x", "x")], "p string, q string")
    got = {(r.p, r.q): (r.ged, r.similarity) for r in N.memoised_edit_distance(pairs, "p", "q", graphlets).collect()}
    assert got["x", "y"] == got["y", "x"] == (1.0, pytest.approx(math.exp(-0.5))) and got["x", "x"][0] == 0


def test_neighbours_of_residues(spark):
    rows = [("1a", "ATOM", "A", i, "G", "P", float(i * 4), 0.0, 0.0) for i in range(4)]
    rows += [("1a", "ATOM", "B", i, "ALA", "CA", float(i * 5), 3.0, 0.0) for i in range(2)] + [("1a", "HETATM", "A", 90, "LIG", "C1", 8.0, 1.0, 0.0), ("1a", "HETATM", "A", 91, "MG", "MG", 0.0, 2.0, 0.0)]
    atoms = spark.createDataFrame(rows, "pdbid string, group string, chain string, pos int, comp string, atom string, x double, y double, z double")
    got = {r.node: (r["within_3.5"], r.within_6) for r in annotate.protein_neighbours(atoms, [3.5, 6.0]).collect()}
    assert got == {"1a.A.0": (1, 2), "1a.A.1": (1, 2), "1a.A.2": (0, 1)}
    kinds = spark.createDataFrame([("LIG", "ligand"), ("MG", "ion")], "comp string, class string")
    got = {r.node: (r.ligand_4, r.ion_4) for r in annotate.small_molecule_neighbours(atoms, kinds, [4.0]).collect()}
    assert got == {"1a.A.0": (None, "MG"), "1a.A.2": ("LIG", None)}


def test_molecules_by_class(spark):
    atoms = spark.createDataFrame([("HETATM", c, e) for c, e in [("LIG", "C"), ("LIG", "Cl"), ("MG", "Mg"), ("HOH", "O"), ("BIG", "C"), ("HGX", "C"), ("HGX", "Hg"), ("PSU", "C")]], "group string, comp string, element string")
    parts = spark.createDataFrame([("LIG", "non-polymer", 300.0), ("MG", "non-polymer", 24.3), ("HOH", "non-polymer", 18.0), ("BIG", "non-polymer", 2000.0), ("HGX", "non-polymer", 400.0), ("PSU", "RNA linking", 324.2)], "id string, type string, weight double")
    assert {(r.comp, r["class"]) for r in annotate.classify_molecules(atoms, parts).collect()} == {("LIG", "ligand"), ("MG", "ion")}


def test_vector_features(spark):
    points = spark.createDataFrame([("g", i, float(i), float(i * i), 0.0) for i in range(6)], "graph string, node int, x double, y double, z double")
    nodes, edges = represent.vector_features(points, ["graph"], 2)
    assert nodes.count() == 6 and edges.count() == 12
    assert nodes.where(F.size("scalars") != 5).count() == 0 and edges.where(F.size("scalars") != 64).count() == 0
    last = nodes.where("node = 5").first()
    assert last.vectors[0] == [0.0, 0.0, 0.0]
