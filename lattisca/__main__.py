"""python -m lattisca list | query NAME SF_DIR OUT | graphs STRUCTURES OUT [--pairs] [--debug N] [--chop] [--annotate] [--resume] | task NAME COLLECTION OUT"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lattisca import catalog, tasks
from lattisca.model import GraphCollection
from lattisca.operators import edges as E
from lattisca.operators import kernels as N
from lattisca.operators import traverse as T
from lattisca.shipping import ship
from lattisca.sources import structures
from lattisca.transforms import Chop


def _there(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def build(spark: SparkSession, args: argparse.Namespace) -> None:
    """Structures to a collection, its pieces and its rings; the last thing a step writes tells that it is done."""
    if not (args.resume and _there(spark, f"{args.out}/graphs/parts/_SUCCESS")):
        pairs = spark.read.parquet(args.pairs) if args.pairs else None
        c = structures.structure_graphs(structures.read_atoms(spark, args.structures), pairs)
        (c.head(args.debug) if args.debug else c).save(f"{args.out}/graphs", mode="overwrite")
    whole = GraphCollection.load(spark, f"{args.out}/graphs")
    if args.chop and not (args.resume and _there(spark, f"{args.out}/chops/parts/_SUCCESS")):
        Chop()(whole).save(f"{args.out}/chops", mode="overwrite")
    if args.annotate and not (args.resume and _there(spark, f"{args.out}/hashes/_SUCCESS")):
        c = GraphCollection.load(spark, f"{args.out}/chops") if args.chop else whole
        roots = c.nodes.select("graph", F.col("node").alias("root"))
        N.ring_arrays(T.rings(E.undirected(c.edges), roots, 3), 3).write.mode("overwrite").parquet(f"{args.out}/rings")
        T.hash_table(T.ball_hashes(c.edges, roots)).write.mode("overwrite").parquet(f"{args.out}/hashes")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lattisca")
    sub = parser.add_subparsers(dest="what", required=True)
    sub.add_parser("list", help="names of queries")
    q = sub.add_parser("query", help="a query's rows as Parquet")
    q.add_argument("name")
    q.add_argument("sf_dir")
    q.add_argument("out")
    g = sub.add_parser("graphs", help="structure files to a collection")
    g.add_argument("structures")
    g.add_argument("out")
    g.add_argument("--pairs", help="Parquet table of pairs (graph, src, dst, label)")
    g.add_argument("--debug", type=int, default=0, help="take the first so many structures alone")
    g.add_argument("--chop", action="store_true", help="also write OUT/chops, pieces of at most 50 residues")
    g.add_argument("--annotate", action="store_true", help="also write OUT/rings, each residue's rings, and the table of their hashes")
    g.add_argument("--resume", action="store_true", help="leave steps alone whose output is there")
    t = sub.add_parser("task", help="a task's rows, split and description")
    t.add_argument("name", choices=sorted(tasks.TASKS))
    t.add_argument("collection")
    t.add_argument("out")
    args = parser.parse_args(argv)
    if args.what == "list":
        print("\n".join(sorted(catalog.queries())))
        return
    spark = SparkSession.builder.getOrCreate()
    ship(spark)
    if args.what == "query":
        catalog.queries()[args.name](spark, args.sf_dir).write.parquet(args.out)
    elif args.what == "graphs":
        build(spark, args)
    else:
        tasks.get_task(args.name, GraphCollection.load(spark, args.collection)).write(args.out)


if __name__ == "__main__":
    main()
