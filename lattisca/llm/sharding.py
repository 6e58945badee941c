"""Hierarchical weighted hash tree: regions hold racks, racks hold shards, and every row descends by weighted draws."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattisca.llm.common import gapless_rank, table

BASE_SHARDS = 24
REGIONS = 2
RACKS = 3


@dataclass(frozen=True)
class Node:
    """A region, a rack or, without children, a shard. The label must not change when others come or go."""

    label: str
    children: tuple[Node, ...] = ()
    shard: int = -1
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def tree(shards: int, base: int = BASE_SHARDS, regions: int = REGIONS, racks: int = RACKS) -> Node:
    """The first ``base`` shards spread over ``regions`` x ``racks``; each later one hangs below a region of its own.

    A later shard so changes the weight of no subtree that holds others: its region's draw takes rows from everywhere,
    and all of them end in the new shard. No row moves between old shards.
    """
    grid: dict[tuple[int, int], list[Node]] = {}
    for s in range(min(shards, base)):
        grid.setdefault((s % regions, s // regions % racks), []).append(Node(f"s{s}", shard=s))
    tops = []
    for r in range(regions):
        below = tuple(Node(f"k{k}", tuple(v)) for (q, k), v in sorted(grid.items()) if q == r)
        if below:
            tops.append(Node(f"r{r}", below))
    tops += [Node(f"x{s}", (Node("k0", (Node(f"s{s}", shard=s),)),)) for s in range(base, shards)]
    return Node("root", tuple(tops))


def _salt(path: str) -> int:
    return int.from_bytes(hashlib.blake2b(path.encode(), digest_size=8).digest(), "little", signed=True)


def _children(root: Node) -> list[list[tuple[float, int, int]]]:
    """For each inner node its children: weight, salt of the path of labels, and number of the node (leaves: -1 - shard)."""
    rows: list[list[tuple[float, int, int]]] = []
    todo = [(root, "")]
    for node, path in todo:  # grows as it goes
        entries = []
        for c in node.children:
            if c.weight > 0:
                here = f"{path}/{c.label}"
                number = -1 - c.shard
                if c.children:
                    number = len(todo)
                    todo.append((c, here))
                entries.append((c.weight, _salt(here), number))
        rows.append(entries)
    return rows


def descend(key: Column, root: Node) -> Column:
    """The shard of ``key``: at each level every child makes an exponential draw whose rate is its weight, and the smallest wins.

    A child's draw depends on the key and its path alone, so a changed weight moves rows only into or out of that child.
    """
    rows = _children(root)
    depth = _depth(root)
    kids = F.array(*[F.array(*[F.struct(F.lit(w).alias("w"), F.lit(s).cast("long").alias("salt"), F.lit(n).alias("node")) for w, s, n in row]) for row in rows])
    node = F.lit(0)
    for _ in range(depth):
        node = F.when(node < 0, node).otherwise(F.array_min(F.transform(F.get(kids, node), lambda c: F.struct(_draw(key, c["salt"], c["w"]).alias("draw"), c["node"].alias("node"))))["node"])
    return -1 - node


def _depth(node: Node) -> int:
    return 1 + max(map(_depth, node.children)) if node.children else 0


def _draw(key: Column, salt: Column, weight: Column) -> Column:
    unit = (F.shiftrightunsigned(F.xxhash64(key, salt), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(unit) / weight


def shard_documents(docs: DataFrame, shards: int = BASE_SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Puts every row of ``docs`` into a shard by its key alone (law ``key``).

    Returns key, size (UTF-8 bytes plus 8), text_crc32, law, shard, grown_shard (with one shard more) and slot (from 0 in
    each shard, without gaps). A null text has no bytes and checksum 0; a null key is a key like any other; repeated
    rows get slots of their own; an empty table gives an empty result; other columns of ``docs`` are not read.
    """
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 8).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.lit("key").alias("law"),
        descend(F.col(key), tree(shards)).alias("shard"),
        descend(F.col(key), tree(shards + 1)).alias("grown_shard"),
    )
    return gapless_rank(rows, ["shard"], ["doc_id", "size", "text_crc32"], "slot", F.col("doc_id"))


def op1_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
