"""Tasks: a collection, a recipe that filters and partitions it, targets, a split without leakage, and metrics.

A task is a lazy plan until it is written. Written tasks hold their rows and splits as Parquet, a description as JSON, and a
fingerprint of names, nodes and splits.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lattisca.functions.encoders import BoolEncoder, FeaturesComputer, MultiHotEncoder, OneHotEncoder
from lattisca.model import GraphCollection
from lattisca.operators import filters as L
from lattisca.operators import labels as B
from lattisca.operators import metrics as K
from lattisca.operators import partition as P
from lattisca.operators import similarity as M
from lattisca.operators import split as X


#: Kinds of targets, or terms, that a description or an encoder takes.
MOST_CLASSES = 10_000


def by_components(c: GraphCollection) -> GraphCollection:
    """Each connected part becomes a graph; residues without an edge are parts of their own."""
    named = P.connected_components(c.edges)
    parts = c.nodes.select("graph", "node").join(named, ["graph", "node"], "left").select("graph", "node", F.coalesce("component", "node").alias("part"))
    return c.partition(parts)


def sized(least: int, most: int) -> Callable[[GraphCollection], GraphCollection]:
    return lambda c: c.keep(L.by_size(c.nodes, least, most))


def with_residues(condition: Column, least: int = 1) -> Callable[[GraphCollection], GraphCollection]:
    return lambda c: c.keep(L.by_residues(c.nodes, condition, least))


def sequence_distances(c: GraphCollection, words: int = 5) -> DataFrame:
    """(i, j, distance) of graphs that share a run of ``words`` letters: one less the Tanimoto similarity of their runs."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("graph", "chain").orderBy("pos")
    run = F.concat_ws("", *[F.lead(F.upper("nt_code"), k).over(order) for k in range(words)])
    grams = c.nodes.select(F.col("graph").alias("id"), run.alias("item")).where(F.length("item") >= words)
    return M.tanimoto(grams).select("i", "j", (1 - F.col("similarity")).alias("distance"))


def without_redundancy(threshold: float, words: int = 5) -> Callable[[GraphCollection], GraphCollection]:
    """One graph of each component of those no further apart than 1 - ``threshold``: the best resolved."""

    def step(c: GraphCollection) -> GraphCollection:
        close = sequence_distances(c, words).where(F.col("distance") <= 1 - threshold + 1e-12).select("i", "j")
        resolution = F.col("resolution") if "resolution" in c.graphs.columns else F.lit(None).cast("double")
        best = M.redundancy_removal(c.graphs.select(F.col("graph").alias("id"), resolution.alias("resolution")), close)
        return c.keep(best.select(F.col("id").alias("graph")))

    return step


@dataclass
class Task:
    """``recipe`` steps run in order on ``collection``; ``features`` computes node or graph columns; a split puts each cluster
    of ``cluster`` (a column of graphs, or their own names) into one part."""

    name: str
    collection: GraphCollection
    recipe: list[Callable[[GraphCollection], GraphCollection]] = field(default_factory=list)
    features: FeaturesComputer = field(default_factory=FeaturesComputer)
    level: str = "nodes"
    ratios: tuple[float, float, float] = (0.7, 0.15, 0.15)
    cluster: str = "graph"
    seed: int = 0

    def process(self) -> GraphCollection:
        return self.collection.transform(*self.recipe)

    def rows(self, c: GraphCollection | None = None) -> DataFrame:
        """Residues or graphs with features, targets and split."""
        c = c or self.process()
        split = X.cluster_split(c.graphs, self.cluster, "graph", self.ratios, self.seed).select("graph", "split")
        return self.features.compute(c.nodes if self.level == "nodes" else c.graphs).join(split, "graph")

    def class_counts(self, rows: DataFrame) -> DataFrame:
        """(slot, value, n): how often each place of the target has each value; a single place is the class itself."""
        return rows.select(F.posexplode("targets").alias("slot", "value")).groupBy("slot", "value").agg(F.count(F.lit(1)).alias("n"))

    def describe(self, rows: DataFrame) -> dict:
        """Dimensions, size, and how often each target comes; an error if there are over MOST_CLASSES kinds of targets."""
        classes = {}
        if self.features.targets:
            counts = rows.groupBy("targets").agg(F.count(F.lit(1)).alias("n")).limit(MOST_CLASSES + 1).collect()
            if len(counts) > MOST_CLASSES:
                raise ValueError(f"more than {MOST_CLASSES} kinds of targets; see class_counts")
            classes = {str(r.targets): r.n for r in sorted(counts, key=lambda r: (-r.n, str(r.targets)))}
        return {"name": self.name, "level": self.level, "num_node_features": self.features.input_dim, "num_classes": max(2, self.features.output_dim) if self.features.targets else 0, "dataset_size": rows.select("graph").distinct().count(), "class_distribution": classes}

    def part(self, split: str, rows: DataFrame | None = None) -> DataFrame:
        """The rows of train, val or test; the filter reaches a written task's folders."""
        return (self.rows() if rows is None else rows).where(F.col("split") == split)

    def loader(self, split: str, size: int, rows: DataFrame | None = None) -> Iterator[list[Row]]:
        """A part's graphs in batches of ``size``, each a list of (graph, rows in order), a partition at a time."""
        some = self.part(split, rows)
        columns = [c for c in some.columns if c not in ("graph", "split")]
        packed = some.groupBy("graph").agg(F.array_sort(F.collect_list(F.struct(*[c for c in ("node", "features", "targets") if c in columns]))).alias("rows"))
        kept: list[Row] = []
        for row in packed.orderBy("graph").toLocalIterator():
            kept.append(row)
            if len(kept) == size:
                yield kept
                kept = []
        if kept:
            yield kept

    def dummy(self, rows: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
        """The metrics, pooled and by graph, of predictions that know nothing: a target of one place is 0 or 1, of more the place."""
        width = self.features.output_dim
        key = F.concat_ws("|", *[F.col(c).cast("string") for c in ("graph", "node") if c in rows.columns])
        label = F.col("targets")[0].cast("int") if width == 1 else (F.array_position("targets", F.array_max("targets")) - 1).cast("int")
        guessed = K.dummy_predictions(rows.withColumn("label", label), key, width, seed)
        return evaluate(guessed)

    def fingerprint(self, rows: DataFrame) -> str:
        """Equal for tasks with the same graphs, residues and splits: rows' hashes are summed, so order doesn't matter."""
        columns = [c for c in ("graph", "node", "split") if c in rows.columns]
        r = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.xxhash64(*columns, F.lit(k)).cast("decimal(38,0)")).alias(f"h{k}") for k in range(2)]).first()
        import hashlib

        return hashlib.sha256(f"{r.n}|{r.h0}|{r.h1}".encode()).hexdigest()

    def write(self, path: str) -> dict:
        rows = self.rows()
        rows.write.partitionBy("split").parquet(f"{path}/rows")
        spark = rows.sparkSession
        back = spark.read.parquet(f"{path}/rows")
        meta = self.describe(back) | {"fingerprint": self.fingerprint(back)}
        spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/metadata")
        return meta

    @staticmethod
    def load(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
        return spark.read.parquet(f"{path}/rows"), json.loads(spark.read.text(f"{path}/metadata").first()[0])

    def table(self) -> DataFrame:
        """(residue or graph, split, target)."""
        key = "node" if self.level == "nodes" else "graph"
        return self.rows().select(key, "split", F.array_join(F.col("targets").cast("array<string>"), " ").alias("target"))

    def to_csv(self, path: str) -> None:
        self.table().write.option("header", True).csv(path)


def evaluate(predictions: DataFrame, label: str = "label", pred: str = "pred", graph: str = "graph") -> tuple[DataFrame, DataFrame]:
    """Pooled metrics, and the means of each graph's own (graphs of one class are left out)."""
    pooled = K.summary(K.per_class(K.confusion(predictions, label, pred)))
    each = K.per_class(K.confusion(predictions, label, pred, [graph]), [graph])
    mixed = each.where("support > 0").groupBy(graph).agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(graph)
    per = K.summary(each.join(mixed, graph, "left_semi"), [graph])
    return pooled, per.agg(*[F.avg(c).alias(c) for c in ("accuracy", "macro_f1", "balanced_accuracy", "mcc", "jaccard")])


def residue_task(name: str, collection: GraphCollection, target: str, condition: Column, limits: tuple[int, int] = (15, 500)) -> Task:
    """The common recipe: connected parts with at least one positive residue, within the size limits, none redundant."""
    f = FeaturesComputer(features=["nt_code"], targets=[target])
    return Task(name, collection, [by_components, with_residues(condition), sized(*limits), without_redundancy(0.9)], f)


def chemical_modification(collection: GraphCollection) -> Task:
    return residue_task("rna_cm", collection, "is_modified", F.col("is_modified"))


def protein_binding(collection: GraphCollection) -> Task:
    return residue_task("rna_prot", collection, "protein_binding", F.col("protein_binding"))


def inverse_folding(collection: GraphCollection) -> Task:
    """Structure alone as input, the letter as target."""
    return Task("rna_if", collection, [by_components, sized(15, 300), without_redundancy(0.9)], FeaturesComputer(targets=["nt_code"]))


def binding_site(collection: GraphCollection, limits: tuple[int, int] = (15, 500), most_protein: float = 10.0) -> Task:
    """Parts whose residues have little protein around them on average, with at least one bound residue."""

    def little_protein(c: GraphCollection) -> GraphCollection:
        return c.keep(L.by_aggregate(c.nodes, F.avg("protein_content"), F.col("agg") < most_protein))

    f = FeaturesComputer(features=["nt_code"], targets=["binding_site"], custom={"binding_site": BoolEncoder()})
    return Task("rna_site", collection, [by_components, little_protein, sized(*limits), with_residues(F.col("binding_site")), without_redundancy(0.9)], f)


def fixed_split(task: Task, train: list[str], val: list[str], test: list[str]) -> DataFrame:
    """A task's rows with a published split in place of its own."""
    c = task.process()
    rows = [(n, s) for s, names in zip(X.SPLITS, (train, val, test), strict=True) for n in names]
    lists = c.graphs.sparkSession.createDataFrame(rows, "graph string, split string")
    return task.features.compute(c.nodes if task.level == "nodes" else c.graphs).join(lists, "graph")


def benchmark_folding(collection: GraphCollection, groups: DataFrame, limits: tuple[int, int] = (15, 300)) -> tuple[Task, DataFrame]:
    """Inverse folding on published chain groups: ``groups`` is (graph, chains, split), chains like ``A-B``. Each group is a
    graph of its own; gives the task and its rows with the published split."""
    parts = P.by_groups(collection.nodes, groups)
    c = sized(*limits)(collection.partition(parts))
    task = Task("rna_if_bench", c, features=FeaturesComputer(targets=["nt_code"]))
    name = F.concat_ws("_", F.col("graph").cast("string"), "chains")
    return task, task.features.compute(c.nodes).join(groups.select(name.alias("graph"), "split").distinct(), "graph")


def benchmark_binding(collection: GraphCollection, chains: DataFrame, cutoff: float = 6.0) -> tuple[Task, DataFrame]:
    """Binding sites on published chains: ``chains`` is (graph, chain, split). Residues of other chains go, a residue with a
    ligand or ion within the cutoff is a site; gives the task and its rows with the published split."""
    from lattisca.transforms import BindingSiteAnnotator

    c = collection.keep_nodes(L.by_chains(collection.nodes, chains.select("graph", "chain")))
    c = BindingSiteAnnotator(include_ions=True, cutoff=cutoff)(c)
    task = Task("rna_site_bench", c, features=FeaturesComputer(features=["nt_code"], targets=["binding_site"], custom={"binding_site": BoolEncoder()}))
    return task, task.features.compute(c.nodes).join(chains.select("graph", "split").distinct(), "graph")


def screening_split(groups: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Pocket groups for training and, a tenth, validation."""
    return X.hash_split(groups, key, (0.9, 0.1, 0.0), seed)


def family_terms(collection: GraphCollection, slices: DataFrame, terms: DataFrame, more_than: int = 50, less_than: int = 1000) -> Task:
    """Slices of chains (graph, chain, first, last, family) with the terms of their family (family, term) that are neither
    rare, frequent nor correlated, as labels of whole graphs."""
    nodes = P.ordinal_slice(collection.nodes, slices.select("graph", "chain", "first", "last"))
    c = collection.keep_nodes(nodes)
    c = c.keep(L.by_size(c.nodes, 4)).keep(c.edges.groupBy("graph").agg(F.count(F.lit(1)).alias("n")).where("n >= 5"))
    members = slices.join(terms, "family").select(F.col("graph").alias("id"), "term").distinct()
    kept = B.uncorrelated(members.join(B.frequent(members, more_than, less_than).select("term"), "term", "left_semi"))
    names = [r.term for r in kept.select("term").distinct().orderBy("term").limit(MOST_CLASSES + 1).collect()]
    if len(names) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} terms; raise more_than or lower less_than")
    labels = kept.groupBy(F.col("id").alias("graph")).agg(F.array_sort(F.collect_set("term")).alias("go_terms"))
    f = FeaturesComputer(targets=["go_terms"], custom={"go_terms": MultiHotEncoder({t: i for i, t in enumerate(names)})})
    return Task("rna_go", GraphCollection(c.graphs.join(labels, "graph"), c.nodes, c.edges), [], f, level="graphs")


def ligand_identity(collection: GraphCollection, pockets: DataFrame, admissible: list[str], limits: tuple[int, int] = (15, 500)) -> Task:
    """Pockets (graph, part, node, ligand) as graphs, labelled with their ligand where it is admissible."""
    c = collection.partition(pockets.select("graph", "node", "part"))
    name = F.concat_ws("_", F.col("graph").cast("string"), F.col("part").cast("string"))
    labels = pockets.where(F.col("ligand").isin(admissible)).groupBy(name.alias("graph")).agg(F.min("ligand").alias("ligand"))
    c = GraphCollection(c.graphs.join(labels, "graph"), c.nodes, c.edges)
    f = FeaturesComputer(targets=["ligand"], custom={"ligand": OneHotEncoder({x: i for i, x in enumerate(admissible)})})
    return Task("rna_ligand", c, [lambda x: x.keep(x.graphs), sized(*limits)], f, level="graphs")


def virtual_screen(scores: DataFrame, least: int = 10) -> DataFrame:
    """The mean over pockets of the area under the curve of (pocket, score, label); small and one-sided pockets are left out."""
    sized_ = scores.groupBy("pocket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("pocket")
    each = K.roc_auc(scores, "label", "score", ["pocket"]).join(sized_, "pocket", "left_semi").where("auc is not null")
    return each.agg(F.avg("auc").alias("auc"), F.count(F.lit(1)).alias("pockets"))


TASKS: dict[str, Callable[[GraphCollection], Task]] = {"rna_cm": chemical_modification, "rna_prot": protein_binding, "rna_site": binding_site, "rna_if": inverse_folding}


def get_task(name: str, collection: GraphCollection) -> Task:
    if name not in TASKS:
        raise ValueError(f"no task is called {name}")
    return TASKS[name](collection)
