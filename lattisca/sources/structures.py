"""Structure files: an atom table from the loops of crystallographic files, and what is derived from it."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattisca.model import GraphCollection
from lattisca.shared import durable

# The columns of an atom record that are kept, and phosphate and standard residue names.
ATOM = {
    "group_PDB": "group", "auth_asym_id": "chain", "auth_seq_id": "pos", "pdbx_PDB_ins_code": "ins", "auth_comp_id": "comp", "auth_atom_id": "atom",
    "type_symbol": "element", "pdbx_PDB_model_num": "model", "Cartn_x": "x", "Cartn_y": "y", "Cartn_z": "z",
}
PHOSPHATE = ("P", "OP1", "OP2")
STANDARD = ("A", "C", "G", "U")
AMINO = ("ALA", "ARG", "ASN", "ASP", "CYS", "GLN", "GLU", "GLY", "HIS", "ILE", "LEU", "LYS", "MET", "PHE", "PRO", "SER", "THR", "TRP", "TYR", "VAL")

_VALUE = re.compile(r"'(?:[^']|'(?=\S))*'(?=\s|$)|\"(?:[^\"]|\"(?=\S))*\"(?=\s|$)|\S+")


def values(line: str) -> list[str]:
    """The values of a line; quotes around a value are gone."""
    return [v[1:-1] if len(v) > 1 and v[0] == v[-1] and v[0] in "'\"" else v for v in _VALUE.findall(line)]


def tables(text: str) -> Iterator[tuple[str, list[str], list[list[str]]]]:
    """(category, columns, rows) of every loop, and of every run of single items as a table of one row."""
    lines = text.splitlines()
    i = 0
    while i < len(lines):
        line = lines[i].strip()
        if line == "loop_":
            i += 1
            names = []
            while i < len(lines) and lines[i].strip().startswith("_"):
                names.append(lines[i].strip().split()[0])
                i += 1
            flat: list[str] = []
            while i < len(lines) and not re.match(r"\s*(_|loop_|#|data_)", lines[i]):
                if lines[i].startswith(";"):
                    held = [lines[i][1:]]
                    i += 1
                    while i < len(lines) and not lines[i].startswith(";"):
                        held.append(lines[i])
                        i += 1
                    flat.append("\n".join(held))
                else:
                    flat += values(lines[i])
                i += 1
            n = len(names)
            if n:
                yield names[0].split(".")[0], [x.split(".", 1)[-1] for x in names], [flat[k : k + n] for k in range(0, len(flat) - n + 1, n)]
        elif line.startswith("_"):
            category, columns, row = line.split(".")[0].split()[0], [], []
            while i < len(lines) and lines[i].strip().startswith(category + "."):
                found = values(lines[i].strip())
                columns.append(found[0].split(".", 1)[-1])
                if len(found) > 1:
                    row.append(found[1])
                elif i + 1 < len(lines) and lines[i + 1].startswith(";"):
                    held = [lines[i + 1][1:]]
                    i += 2
                    while i < len(lines) and not lines[i].startswith(";"):
                        held.append(lines[i])
                        i += 1
                    row.append("\n".join(held))
                elif i + 1 < len(lines):
                    i += 1
                    row.append(" ".join(values(lines[i])))
                i += 1
            yield category, columns, [row]
            if not columns:
                i += 1
        else:
            i += 1


def _files(spark: SparkSession, path: str) -> DataFrame:
    """Whole files by Spark's reader, so that any store that Spark reads will do."""
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"/pdbid=([^/]+)/[^/]*$", 1)
    name = F.when(folder != "", folder).otherwise(F.lower(F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]*)", 1)))
    return spark.read.text(path, wholetext=True).select(name.alias("pdbid"), "value")


def read_atoms(spark: SparkSession, path: str) -> DataFrame:
    """(pdbid, group, chain, pos, ins, comp, atom, element, model, x, y, z) of every atom record of the files at ``path``."""

    def run(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        for batch in batches:
            for pdbid, text in zip(batch["pdbid"], batch["value"], strict=True):
                for category, columns, rows in tables(text):
                    if category == "_atom_site" and rows:
                        frame = pd.DataFrame(rows, columns=columns)
                        out = pd.DataFrame({new: frame[old] if old in frame else None for old, new in ATOM.items()})
                        for c in ("pos", "model", "x", "y", "z"):
                            out[c] = pd.to_numeric(out[c], errors="coerce")
                        out["ins"] = out["ins"].where(~out["ins"].isin(["?", "."]), None)
                        out.insert(0, "pdbid", pdbid)
                        yield out.astype({"pos": "Int64", "model": "Int64"})

    return _files(spark, path).mapInPandas(run, "pdbid string, group string, chain string, pos long, ins string, comp string, atom string, element string, model long, x double, y double, z double")


def _read_items(spark: SparkSession, path: str, category: str, columns: dict[str, str]) -> DataFrame:
    """(pdbid, and a string for each of ``columns``) from one category's rows of each file; ``?`` and ``.`` are null."""

    def run(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        for batch in batches:
            for pdbid, text in zip(batch["pdbid"], batch["value"], strict=True):
                for found, names, rows in tables(text):
                    if found == category and rows:
                        frame = pd.DataFrame([r[: len(names)] for r in rows], columns=names[: len(rows[0])])
                        out = pd.DataFrame({new: frame[old] if old in frame else None for old, new in columns.items()}, index=frame.index, dtype=object)
                        out = out.where(~out.isin(["?", "."]), None)
                        out.insert(0, "pdbid", pdbid)
                        yield out

    return _files(spark, path).mapInPandas(run, "pdbid string, " + ", ".join(f"`{c}` string" for c in columns.values()))


def read_components(spark: SparkSession, path: str) -> DataFrame:
    """(pdbid, id, type, name, formula, weight) of the component table of each file."""
    found = _read_items(spark, path, "_chem_comp", {"id": "id", "type": "type", "name": "name", "formula": "formula", "formula_weight": "weight"})
    return found.where("id is not null").withColumn("weight", F.col("weight").try_cast("double"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(pdbid, resolution_low, resolution_high) as the files have them, for those that have any."""
    return _read_items(spark, path, "_reflns", {"d_resolution_low": "resolution_low", "d_resolution_high": "resolution_high"}).dropDuplicates(["pdbid"])


def read_component_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(id, type, letter, parent) of a dictionary of components, a file of many blocks ``data_ID``."""
    blocks = spark.read.text(path, lineSep="data_").where(F.col("value").contains("_chem_comp.id"))
    item = lambda name: F.regexp_extract("value", rf"(?m)^_chem_comp\.{name}[ \t]+(?:\"([^\"]*)\"|'([^']*)'|(\S+))", 0)
    value = lambda name: F.trim(F.regexp_replace(F.regexp_replace(item(name), r"^_chem_comp\.\S+\s+", ""), "[\"']", ""))
    parent = F.upper(F.substring(F.regexp_replace(value("mon_nstd_parent_comp_id"), "[^A-Za-z0-9]", ""), 1, 3))
    return blocks.select(value("id").alias("id"), value("type").alias("type"), value("one_letter_code").alias("letter"), F.nullif(parent, F.lit("")).alias("parent")).where("id <> ''")


def canonical_letters(components: DataFrame, rounds: int = 64) -> DataFrame:
    """(id, letter, kind) by the parents of ``read_component_dictionary``: a component has the letter of the last parent that
    is known; a letter that is a component's id is followed too. ``kind`` is protein, rna or the type in lower case. A circle
    of parents ends where it began; a chain longer than ``rounds`` is an error."""
    to = F.coalesce("parent", F.when(F.length("letter") > 1, F.col("letter")))
    known = components.select("id", "type", "letter", F.when(to != F.col("id"), to).alias("to")).dropDuplicates(["id"])
    targets = durable(known.select(F.col("id").alias("to"), F.col("type").alias("_type"), F.col("letter").alias("_letter"), F.col("to").alias("_to")))
    now = durable(known.withColumn("seen", F.array("id")))
    for _ in range(rounds):
        open_ = now.where("to is not null")
        if open_.isEmpty():
            kind = F.when(F.lower("type").contains("peptide"), "protein").when(F.col("type").contains("RNA") | F.col("type").contains("DNA"), "rna").otherwise(F.lower("type"))
            return now.where("letter <> '?' and letter is not null").select("id", "letter", kind.alias("kind"))
        met = open_.join(targets, "to", "left")
        stop = F.col("_letter").isNull() | F.array_contains("seen", F.col("to"))
        step = met.select("id", F.when(stop, F.col("type")).otherwise(F.col("_type")).alias("type"), F.when(stop, F.col("letter")).otherwise(F.col("_letter")).alias("letter"), F.when(~stop, F.col("_to")).alias("to"), F.concat("seen", F.array("to")).alias("seen"))
        now = durable(now.where("to is null").unionByName(step))
    raise RuntimeError(f"parents go on after {rounds} rounds")


def rna_chains(atoms: DataFrame, modified: list[str] | None = None) -> DataFrame:
    """(pdbid, chain) of which every polymer residue is a standard or modified nucleotide."""
    known = F.col("comp").isin(*STANDARD, *(modified or []))
    return atoms.where("group = 'ATOM'").groupBy("pdbid", "chain").agg(F.bool_and(known).alias("ok")).where("ok").select("pdbid", "chain")


def node_id() -> Column:
    return F.concat_ws(".", "pdbid", "chain", F.col("pos").cast("string"))


def residue_name_of(raw: Column) -> Column:
    """``3OX0|1|A|C|70`` as the name of its residue, ``3ox0.A.70``."""
    part = lambda k: F.split_part(raw, F.lit("|"), F.lit(k))
    return F.concat_ws(".", F.lower(part(1)), part(3), part(5))


def residue_nodes(atoms: DataFrame) -> DataFrame:
    """(graph, node, chain, pos, nt_code, x, y, z): a residue lies at its phosphorus, else at the mean of its atoms."""
    first = atoms.where((F.col("model").isNull()) | (F.col("model") == 1))
    at = lambda c: F.coalesce(F.min(F.when(F.col("atom") == "P", F.col(c))), F.avg(c)).alias(c)
    return first.groupBy("pdbid", "chain", "pos").agg(F.min("comp").alias("nt_code"), *[at(c) for c in "xyz"]).select(F.col("pdbid").alias("graph"), node_id().alias("node"), "chain", "pos", "nt_code", "x", "y", "z")


def structure_graphs(atoms: DataFrame, pairs: DataFrame | None = None, modified: list[str] | None = None) -> GraphCollection:
    """Graphs of the RNA chains: residues, backbone edges and, from ``pairs`` (graph, src, dst, label), both directions of
    each pair between residues that exist."""
    from lattisca.operators.edges import backbone_edges, flipped, induced

    nodes = residue_nodes(atoms.where("group = 'ATOM'").join(rna_chains(atoms, modified), ["pdbid", "chain"], "left_semi"))
    bb = backbone_edges(nodes, ["graph", "chain"])
    name = lambda c: F.concat_ws(".", "graph", "chain", F.col(c).cast("string"))
    edges = bb.select("graph", name("src").alias("src"), name("dst").alias("dst"), "label")
    if pairs is not None:
        both = pairs.select("graph", F.explode(F.array(F.struct("src", "dst", "label"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), flipped(F.col("label")).alias("label")))).alias("e"))
        edges = edges.union(induced(both.select("graph", "e.*"), nodes).select("graph", "src", "dst", "label"))
    return GraphCollection(nodes.select("graph").distinct(), nodes, edges)


def read_representatives(spark: SparkSession, path: str, resolution: str = "4.0A") -> DataFrame:
    """(pdbid, chains) from a list of a resolution, whose name stands in the path as ``{resolution}`` if there are several, a list of representative sets: quoted entries ``PDB|model|chain`` joined by plus signs in the
    second column."""
    rows = spark.read.csv(path.format(resolution=resolution)).select(F.explode(F.split("_c1", r"\+")).alias("entry")).where(F.col("entry").contains("|"))
    return rows.groupBy(F.lower(F.split_part("entry", F.lit("|"), F.lit(1))).alias("pdbid")).agg(F.array_sort(F.collect_set(F.split_part("entry", F.lit("|"), F.lit(3)))).alias("chains"))


def read_split_ids(spark: SparkSession, path: str) -> DataFrame:
    """(pdbid, chains, chain) from lines ``PDB_model_CHAIN-CHAIN``."""
    rows = spark.read.text(path).where("length(trim(value)) > 0").select(F.lower(F.split_part("value", F.lit("_"), F.lit(1))).alias("pdbid"), F.split_part("value", F.lit("_"), F.lit(3)).alias("chains"))
    return rows.select("pdbid", "chains", F.explode(F.split("chains", "-")).alias("chain"))


def read_family_terms(spark: SparkSession, path: str) -> DataFrame:
    """(family, term) from lines ``Rfam:RF00001 name > GO:… ; GO:0003735``."""
    rows = spark.read.text(path).where(F.col("value").startswith("Rfam:"))
    return rows.select(F.regexp_extract("value", r"^Rfam:(RF\d{5})", 1).alias("family"), F.regexp_extract("value", r"GO:(\d{7})\s*$", 1).alias("term")).where("family <> '' and term <> ''")


def read_family_slices(spark: SparkSession, path: str) -> DataFrame:
    """(pdbid, chain, first, last, family, selection) from tab-separated lines with a header ``rfam_acc pdb_id chain pdb_start
    pdb_end``; the selection names structure, chain and ends."""
    rows = spark.read.csv(path, sep="\t", header=True)
    first, last = F.col("pdb_start").try_cast("long"), F.col("pdb_end").try_cast("long")
    name = F.concat_ws("_", F.lower("pdb_id"), "chain", first.cast("string"), last.cast("string"))
    return rows.select(F.lower("pdb_id").alias("pdbid"), "chain", first.alias("first"), last.alias("last"), F.col("rfam_acc").alias("family"), name.alias("selection"))


def read_smiles(spark: SparkSession, path: str) -> DataFrame:
    """(ligand, smiles) from lines of two words; the first line of a ligand counts."""
    words = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where("length(trim(value)) > 0").select(words[0].alias("ligand"), F.get(words, 1).alias("smiles"))
    return rows.where("smiles is not null").groupBy("ligand").agg(F.min("smiles").alias("smiles"))


def _pairs_of(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(key, value) of a JSON object in each file at ``path``."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string,{kind}>")).alias("key", "value"))


def read_modifications(spark: SparkSession, path: str) -> DataFrame:
    """(kind, comp, letter) from JSON ``{"protein": {comp: letter}, "rna": {...}}``."""
    return _pairs_of(spark, path, "map<string,string>").select(F.col("key").alias("kind"), F.explode("value").alias("comp", "letter"))


def read_pockets(spark: SparkSession, path: str) -> DataFrame:
    """(graph, part, node) from JSON ``{graph: [[node, ...], ...]}``."""
    parts = _pairs_of(spark, path, "array<array<string>>").select(F.col("key").alias("graph"), F.posexplode("value").alias("part", "nodes"))
    return parts.select("graph", F.col("part").cast("long").alias("part"), F.explode("nodes").alias("node"))


def read_node_ligands(spark: SparkSession, path: str) -> DataFrame:
    """(node, ligand) from JSON ``{node: ligand}``."""
    return _pairs_of(spark, path, "string").select(F.col("key").alias("node"), F.col("value").alias("ligand"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(graph, key, value, n) from JSON ``{graph: {key: {value: n}}}``."""
    keys = _pairs_of(spark, path, "map<string,map<string,bigint>>").select(F.col("key").alias("graph"), F.explode("value").alias("key", "values"))
    return keys.select("graph", "key", F.explode("values").alias("value", "n"))


# --- structures as tables of atoms, and back


def residue_list(atoms: DataFrame, linking: list[str] | None = None) -> DataFrame:
    """(pdbid, chain, pos, comp) of the standard residues and the hetero residues that link into chains, in order."""
    known = (F.col("group") == "ATOM") | F.col("comp").isin(*(linking or [""]))
    return atoms.where(known).select("pdbid", "chain", "pos", "comp").distinct().orderBy("pdbid", "chain", "pos")


def find_node(nodes: DataFrame, chain: str, pos: int) -> DataFrame:
    """(graph, node): each graph's residue at a place, the first by name if there are several."""
    return nodes.where((F.col("chain") == chain) & (F.col("pos") == pos)).groupBy("graph").agg(F.min("node").alias("node"))


def keep_residues(atoms: DataFrame, residues: DataFrame) -> DataFrame:
    """The atoms of the named residues (pdbid, chain, pos)."""
    return atoms.join(residues.select("pdbid", "chain", "pos").distinct(), ["pdbid", "chain", "pos"], "left_semi").select(*atoms.columns)


def drop_residues(atoms: DataFrame, residues: DataFrame) -> DataFrame:
    return atoms.join(residues.select("pdbid", "chain", "pos").distinct(), ["pdbid", "chain", "pos"], "left_anti").select(*atoms.columns)


def first_model(atoms: DataFrame) -> DataFrame:
    """The atoms of each structure's lowest model."""
    least = atoms.groupBy("pdbid").agg(F.min("model").alias("_least"))
    return atoms.join(least, "pdbid").where(F.coalesce(F.col("model") == F.col("_least"), F.lit(True))).select(*atoms.columns)


def nucleotide_chains(atoms: DataFrame) -> DataFrame:
    """The atoms of chains that hold a standard nucleotide."""
    held = atoms.where(F.col("comp").isin(*STANDARD)).select("pdbid", "chain").distinct()
    return atoms.join(held, ["pdbid", "chain"], "left_semi").select(*atoms.columns)


def clean_structures(atoms: DataFrame) -> DataFrame:
    """The first model's chains with nucleotides."""
    return nucleotide_chains(first_model(atoms))


def split_structures(atoms: DataFrame, least: int = 0, most: int = -1) -> DataFrame:
    """Atoms under the name ``pdbid_chain``, for each chain with so many residues."""
    from lattisca.operators.partition import chains_of_size

    nodes = atoms.select(F.col("pdbid").alias("graph"), "chain", F.col("pos").alias("node"))
    sized = chains_of_size(nodes, least, most).select(F.col("graph").alias("pdbid"), "chain")
    return atoms.join(sized, ["pdbid", "chain"], "left_semi").withColumn("pdbid", F.concat_ws("_", "pdbid", "chain")).select(*atoms.columns)


def structure_texts(atoms: DataFrame) -> DataFrame:
    """(pdbid, value): each structure as a file's text, its atoms in one loop, by model, chain and place."""
    quoted = lambda c: F.when(F.col(c).isNull(), "?").when(F.col(c).cast("string").rlike(r"[\s'\"#]|^$"), F.concat(F.lit('"'), F.col(c), F.lit('"'))).otherwise(F.col(c).cast("string"))
    line = F.concat_ws(" ", *[quoted(c) for c in ATOM.values()])
    order = F.struct("model", "chain", "pos", "atom", "x", "y", "z", line.alias("line"))
    packed = atoms.groupBy("pdbid").agg(F.array_sort(F.collect_list(order)).alias("s"))  # a structure is bounded
    head = F.lit("loop_\n" + "".join(f"_atom_site.{c}\n" for c in ATOM))
    body = F.array_join(F.transform("s", lambda x: x["line"]), "\n")
    return packed.select("pdbid", F.concat(F.lit("data_"), F.upper("pdbid"), F.lit("\n#\n"), head, body, F.lit("\n#\n")).alias("value"))


def write_structures(atoms: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A folder ``pdbid=...`` with one file for each structure, which ``read_atoms`` reads again by name of folder."""
    texts = structure_texts(atoms)
    texts.repartition("pdbid").write.mode(mode).partitionBy("pdbid").option("lineSep", "\n").text(path)
