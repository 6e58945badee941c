"""Annotations of residues from atoms around them, and from tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattisca.constants import IONS, LIGAND_ELEMENTS, LIGAND_MASS
from lattisca.operators.filters import ligand_class
from lattisca.operators.spatial import radius_join
from lattisca.sources.structures import AMINO, PHOSPHATE, STANDARD, node_id


def _residue_points(atoms: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """The first of the named atoms of each residue."""
    order = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("atom"))
    picked = atoms.where(F.col("atom").isin(*names) & F.col("comp").isin(*STANDARD))
    first = picked.groupBy("pdbid", "chain", "pos").agg(F.min_by(F.struct("x", "y", "z"), order).alias("p"))
    return first.select(F.col("pdbid").alias("graph"), node_id().alias("node"), "p.x", "p.y", "p.z")


def protein_neighbours(atoms: DataFrame, radii: list[float]) -> DataFrame:
    """(graph, node, within_<r> ...): alpha carbons of amino acids within each radius of a residue's phosphate; structures with
    fewer than two such atoms are left out."""
    carbons = atoms.where(F.col("comp").isin(*AMINO) & (F.col("atom") == "CA"))
    enough = carbons.groupBy("pdbid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("pdbid")
    carbons = carbons.join(enough, "pdbid", "left_semi").select(F.col("pdbid").alias("graph"), F.concat_ws(".", node_id(), "atom").alias("node"), "x", "y", "z")
    near = radius_join(_residue_points(atoms, PHOSPHATE), carbons, max(radii))
    return near.groupBy("graph", F.col("a").alias("node")).agg(*[F.count_if(F.col("distance") <= r).alias(f"within_{r:g}") for r in radii])


def small_molecule_neighbours(atoms: DataFrame, molecules: DataFrame, radii: list[float]) -> DataFrame:
    """(graph, node, ligand_<r>, ion_<r> ...): the closest ligand and ion with any atom within each radius of any atom of a
    residue. ``molecules`` is (comp, class), class ligand or ion."""
    named = lambda df: df.select(F.col("pdbid").alias("graph"), F.concat_ws("|", node_id(), "atom").alias("node"), "x", "y", "z")
    residues = named(atoms.where(F.col("comp").isin(*STANDARD) & (F.col("group") == "ATOM")))
    partners = atoms.where("group = 'HETATM'").join(molecules, "comp")
    tagged = partners.select(F.col("pdbid").alias("graph"), F.concat_ws("|", node_id(), "atom", "comp", "class").alias("node"), "x", "y", "z")
    near = radius_join(residues, tagged, max(radii))
    part = lambda c, i: F.split(c, r"\|")[i]
    rows = near.select("graph", part("a", 0).alias("node"), part("b", 2).alias("comp"), part("b", 3).alias("class"), "distance")
    best = lambda kind, r: F.min_by("comp", F.when((F.col("class") == kind) & (F.col("distance") <= r), F.struct("distance", "comp"))).alias(f"{kind}_{r:g}")
    return rows.groupBy("graph", "node").agg(*[best(kind, r) for r in radii for kind in ("ligand", "ion")])


def classify_molecules(atoms: DataFrame, components: DataFrame, mass: tuple[float, float] = LIGAND_MASS, additional: list[str] | None = None, disallowed: list[str] | None = None) -> DataFrame:
    """(comp, class): which hetero residues are ions and which are ligands. Water and residues that link into chains are
    neither; a ligand has a mass within the limits, carbon, and allowed elements alone, whatever their case."""
    allowed = [e.upper() for e in [*LIGAND_ELEMENTS, *(additional or [])] if e not in (disallowed or [])]
    held = atoms.where("group = 'HETATM'").groupBy("comp").agg(F.collect_set(F.upper("element")).alias("elements"))
    free = components.where("id <> 'HOH'").where(~F.upper("type").isin("RNA LINKING", "DNA LINKING")).select(F.col("id").alias("comp"), "weight").dropDuplicates(["comp"])
    named = held.join(free, "comp").withColumn("class", ligand_class(F.col("comp"), F.col("weight"), F.col("elements"), allowed, mass[0], mass[1], IONS))
    return named.where("class is not null").select("comp", "class")


def ligand_smiles(nodes: DataFrame, ligand: str, smiles: DataFrame) -> DataFrame:
    """(graph, ligand_to_smiles): the ligands that a graph's residues bind, with what ``smiles`` (ligand, smiles) has of them."""
    bound = nodes.where(F.col(ligand).isNotNull()).select("graph", F.col(ligand).alias("ligand")).distinct().join(smiles, "ligand")
    return bound.groupBy("graph").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("ligand", "smiles")))).alias("ligand_to_smiles"))


def atom_coordinates(atoms: DataFrame, names: list[str]) -> DataFrame:
    """(graph, node, xyz_<atom> ...): null where a residue lacks the atom."""
    at = lambda n: F.first(F.when(F.col("atom") == n, F.array("x", "y", "z")), ignorenulls=True).alias(f"xyz_{n}")
    found = atoms.where(F.col("atom").isin(*names)).groupBy("pdbid", "chain", "pos").agg(*[at(n) for n in names])
    return found.select(F.col("pdbid").alias("graph"), node_id().alias("node"), *[f"xyz_{n}" for n in names])


def binding_flag(columns: list[Column]) -> Column:
    """Whether any of the attributes is there."""
    return F.coalesce(*[c.cast("string") for c in columns]).isNotNull()


def lookup(nodes: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """Left join with a table of one value per key."""
    return nodes.join(table.select(key, value), key, "left")
