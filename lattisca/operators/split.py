"""Train, validation and test splits: by hash, by name, by cluster; their balance; batches."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SPLITS = ("train", "val", "test")


def check_ratios(ratios: tuple[float, float, float]) -> None:
    if any(r < 0 for r in ratios) or not 0.99 <= sum(ratios) <= 1.01:
        raise ValueError("split ratios must not be negative and must sum to one")


def hash_unit(key: Column, seed: int) -> Column:
    """A number from 0 to 1 that follows from the key and the seed alone."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}"))), 1, 8), 16, 10).cast("double") / 4294967296.0


def hash_split(rows: DataFrame, key: str, ratios: tuple[float, float, float] = (0.7, 0.15, 0.15), seed: int = 0) -> DataFrame:
    """Adds ``split`` without a shuffle: each row's own hash decides, so the shares hold in the mean."""
    check_ratios(ratios)
    u = hash_unit(F.col(key), seed)
    return rows.withColumn("split", F.when(u < ratios[0], SPLITS[0]).when(u < ratios[0] + ratios[1], SPLITS[1]).otherwise(SPLITS[2]))


def name_split(rows: DataFrame, column: str, lists: DataFrame) -> DataFrame:
    """``lists`` (name, split): rows whose name is listed."""
    return rows.join(lists.withColumnRenamed("name", column), column)


def assign_clusters(sizes: list[int], labels: list[dict], ratios: tuple[float, ...], tolerance: float = 0.5, size_weight: float = 1.0, label_weight: float = 1.0, rounds: int = 50) -> list[int]:
    """A split for each cluster: the relative deviations of sizes and label counts are made small by a greedy start, the
    largest first, and by moves and swaps as long as they help. Sizes outside the tolerance cost dearly."""
    check_ratios(tuple(ratios))
    total, k = sum(sizes), len(ratios)
    all_labels: Counter = Counter()
    for c in labels:
        all_labels.update(c)

    def cost(size: list[int], count: list[Counter]) -> float:
        out = size_weight * sum(abs(size[j] - ratios[j] * total) for j in range(k)) / max(1, total)
        for j in range(k):
            want = ratios[j] * total
            if not max(1, want * (1 - tolerance)) <= size[j] <= want * (1 + tolerance):
                out += 10 + abs(size[j] - want) / max(1, total)
        return out + label_weight * sum(sum(abs(count[j][x] - ratios[j] * n) for j in range(k)) / n for x, n in all_labels.items() if n)

    size, count, where = [0] * k, [Counter() for _ in range(k)], [0] * len(sizes)

    def move(i: int, j: int, sign: int) -> None:
        size[j] += sign * sizes[i]
        for x, n in labels[i].items():
            count[j][x] += sign * n

    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        where[i] = max(range(k), key=lambda j: (ratios[j] * total - size[j], -j))
        move(i, where[i], 1)
    now = cost(size, count)
    for _ in range(rounds):
        better = False
        for i in range(len(sizes)):
            for j in range(k):
                a = where[i]
                if j == a:
                    continue
                move(i, a, -1)
                move(i, j, 1)
                swap, new = None, cost(size, count)
                if new >= now - 1e-12:
                    for o in range(len(sizes)):
                        if where[o] == j and o != i:
                            move(o, j, -1)
                            move(o, a, 1)
                            new = cost(size, count)
                            if new < now - 1e-12:
                                swap = o
                                break
                            move(o, a, -1)
                            move(o, j, 1)
                if new < now - 1e-12:
                    where[i], now, better = j, new, True
                    if swap is not None:
                        where[swap] = a
                else:
                    move(i, j, -1)
                    move(i, a, 1)
        if not better:
            break
    return where


def cluster_split(items: DataFrame, cluster: str, key: str, ratios: tuple[float, float, float] = (0.7, 0.15, 0.15), seed: int = 0) -> DataFrame:
    """Adds ``split`` so that a cluster is never divided: a cluster falls where its own hash does.

    This needs no driver and no shuffle. ``assign_clusters`` balances sizes and labels closer where clusters are few.
    """
    return hash_split(items.withColumn("_c", F.col(cluster)), "_c", ratios, seed).drop("_c")


def split_balance(rows: DataFrame, split: str, ratios: dict[str, float]) -> DataFrame:
    """(split, n, target, deviation): each split's size against its share."""
    wanted = F.create_map(*[x for k, v in ratios.items() for x in (F.lit(k), F.lit(v))])
    sizes = rows.groupBy(split).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # one row per split
    target = F.try_element_at(wanted, F.col(split)) * total
    return sizes.select(split, "n", target.alias("target"), (F.abs(F.col("n") - target) / target).alias("deviation"))


def batches(rows: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    """Adds ``batch``: consecutive blocks of ``size`` rows inside each group of ``keys``."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("batch", F.floor((rank - 1) / size).cast("long"))
