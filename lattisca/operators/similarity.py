"""Similarity of sets, vectors and rings; redundancy removal; matching and edit distance of small graphs."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from lattisca.operators.partition import linked_components
from lattisca.shared import durable, join_split

#: Combinations of a set's items in the index at most, for each band of sizes, where more than single items make a key.
COMBINATIONS = 32
#: Items that are broadcast at most with their counts; more are joined by a shuffle.
BROADCAST_ITEMS = 100_000
#: Members of a block of equal sets (about: they are dealt by hash), and pairs that a task writes out (about).
BLOCK = 1024
PAIRS_A_TASK = 4_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def tanimoto(members: DataFrame) -> DataFrame:
    """(i, j, similarity), i < j, of sets that share an item; others have 0. ``members`` is (id, item).

    An index from items to sets, so that only sets with a common item meet; each pair's shared items are counted before
    they are shuffled a second time.
    """
    rows = members.select("id", "item").distinct()
    sizes = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    one, two = rows.select("item", F.col("id").alias("i")), rows.select("item", F.col("id").alias("j"))
    shared = one.join(two, "item").where("i < j").groupBy("i", "j").agg(F.count(F.lit(1)).alias("common"))
    met = shared.join(sizes.select(F.col("id").alias("i"), F.col("n").alias("ni")), "i").join(sizes.select(F.col("id").alias("j"), F.col("n").alias("nj")), "j")
    return met.select("i", "j", (F.col("common") / (F.col("ni") + F.col("nj") - F.col("common"))).alias("similarity"))


def _at_least(x: float) -> int:
    return math.ceil(x - 1e-9)


@lru_cache(maxsize=8)
def _bands(least: float, most: int) -> list[tuple[int, int, int]]:
    """(first, last, level): sizes from 1 to ``most`` in bands, small sizes each for itself, and of how many items the keys are by
    which pairs meet whose smaller set is in the band: of as many as leave few combinations."""
    out, first = [], 1
    while first <= most:
        last = max(first, math.floor(first / math.sqrt(least) + 1e-9))
        largest = math.floor(last / least + 1e-9)
        spare, level = largest - _at_least(least * largest), 1
        highest = _at_least(2 * least / (1 + least) * first)
        if not spare:
            level = highest
        while level < highest and math.comb(spare + level + 1, level + 1) <= COMBINATIONS:
            level += 1
        out.append((first, last, level))
        first = last + 1
    return out


def _wanted(least: float, n: int, most: int) -> list[tuple[int, int, int, bool]]:
    """(band, level, items, larger): the keys of a set of ``n`` items are the combinations of ``level`` of its first ``items``, as
    the larger set of a pair for each band of smaller ones, and as the smaller one for its own band."""
    need = lambda x: _at_least(least * (x + n) / (1 + least))
    low, out = _at_least(least * n), []
    for first, last, level in _bands(least, most):
        if first <= n and last >= low:
            o = need(min(n, max(first, low)))
            if o < n:  # else only equal sets are alike, which are one class
                out.append((first, level, n - o + level, True))
            if n <= last:
                out.append((first, level, n - need(n) + level, False))
    return out


def _set_keys(classes: DataFrame, least: float, as_larger: bool) -> DataFrame:
    """(id, n, key) of each class as the larger or as the smaller set of a pair. Sets of n <= m items that are alike have at least o = least * (n + m) / (1 + least) in common. In one
    order of all items the l-th of these is among the first n - o + l of one and m - o + l of the other, so a combination of l
    of these is in both. The more items a key has, the fewer meet that are not alike; with l = o none do. Keys are hashes: what
    falls together is told apart on the sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).to_numpy()
            held = batch.column(2)
            starts, values = held.offsets.to_numpy(), held.values.to_numpy().view(np.uint64)
            long = np.diff(starts)
            most = 1 << int(max(sizes.max(initial=1), 1)).bit_length()
            for n, m in set(zip(sizes.tolist(), long.tolist(), strict=True)):
                at = np.flatnonzero((sizes == n) & (long == m))
                items = values[starts[at][:, None] + np.arange(m)[None, :]]
                for band, level, first in (k[:3] for k in _wanted(least, n, most) if k[3] == as_larger):
                    some = np.array(list(combinations(range(min(first, m)), level)), np.int64).reshape(-1, level)
                    key = np.full((len(at), len(some)), band, np.uint64)
                    for k in range(level):
                        key = (key ^ (key >> np.uint64(29))) * _MIX + items[:, some[:, k]]
                    key = (key ^ (key >> np.uint64(32))) * _MIX
                    of = pa.array(np.repeat(at, len(some)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(of), pa.array(np.full(len(of), n, np.int64)), pa.array(key.ravel().view(np.int64))], names=["id", "n", "key"])

    rows = classes.select("id", "n", F.transform("items", lambda x: F.xxhash64(x)).alias("h"))
    kind = classes.schema["id"].dataType
    return rows.mapInArrow(run, StructType([StructField("id", kind), StructField("n", LongType()), StructField("key", LongType())]))


def _alike_classes(classes: DataFrame, least: float) -> DataFrame:
    """(i, j, similarity) of classes; one of several members is alike to itself, but for a null item, which is never common."""
    one, two = (_set_keys(classes, least, larger).select("key", F.col("id").alias(c), F.col("n").alias(f"n{c}")) for c, larger in (("i", False), ("j", True)))
    met = one.join(two, "key").where((F.struct("ni", "i") < F.struct("nj", "j")) & (F.col("ni") >= F.col("nj") * least - 1e-9)).select("i", "j").distinct()
    a, b = (classes.select(F.col("id").alias(c), F.col("items").alias(f"s{c}"), F.col("n").alias(f"n{c}")) for c in "ij")
    both = met.join(a, "i").join(b, "j").withColumn("common", F.size(F.array_intersect("si", "sj")))
    own = classes.where("members > 1").select(F.col("id").alias("i"), F.col("id").alias("j"), F.col("n").alias("ni"), F.col("n").alias("nj"), F.size("items").alias("common"))
    every = both.select(*own.columns).union(own)
    return every.select("i", "j", (F.col("common") / (F.col("ni") + F.col("nj") - F.col("common"))).alias("similarity")).where(F.col("similarity") >= least - 1e-12)


def similar_sets(members: DataFrame, least: float, digits: int | None = None) -> DataFrame:
    """(i, j, similarity), i < j, of sets at least ``least`` alike (above 0), without the quadratic cost of common items; rounded to
    ``digits``. A null item counts in its set and is never common.

    Equal sets are one class. Classes meet by combinations of their rarest items and are compared as a whole; what is alike
    is then written out for all members, in blocks, so that a large class is no single task's work.
    """
    rows = members.select("id", "item").where("id is not null")
    rare = durable(rows.where("item is not null").groupBy("item").agg(F.count(F.lit(1)).alias("_n")))
    # Any order of the items serves, so repeated rows need not be told apart to count them.
    ranked_ = rows.join(F.broadcast(rare), "item", "left") if rare.count() <= BROADCAST_ITEMS else join_split(rows, rare, ["item"], "left")
    sets = ranked_.groupBy("id").agg(F.array_sort(F.collect_set(F.when(F.col("item").isNotNull(), F.struct("_n", "item")))).alias("s"), F.max(F.col("item").isNull()).alias("odd"))
    whole = durable(sets.select("id", F.transform("s", lambda x: x["item"]).alias("items"), "odd"))
    grouped = whole.groupBy("items", "odd").agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("members"))
    grouped = durable(grouped)
    classes = grouped.select(F.col("class").alias("id"), "items", (F.size("items") + F.col("odd").cast("long")).alias("n"), "members")
    alike = durable(_alike_classes(classes, least))
    # Members of a class in blocks, each pair of blocks a row.
    block = F.pmod(F.xxhash64("id"), F.ceil(F.col("members") / BLOCK)).cast("int")
    named = join_split(whole, grouped, ["items", "odd"]).select("class", "id", block.alias("block"))
    blocks = durable(named.groupBy("class", "block").agg(F.collect_list("id").alias("ids")))
    a, b = (blocks.select(F.col("class").alias(c), F.col("block").alias(f"b{c}"), F.col("ids").alias(f"ids{c}")) for c in "ij")
    pairs = durable(alike.join(a, "i").join(b, "j").where("i <> j or bi <= bj"))
    total = pairs.agg(F.sum(F.size("idsi").cast("long") * F.size("idsj"))).first()[0] or 0
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // PAIRS_A_TASK)
    dealt = pairs.repartition(tasks, "i", "bi", "j", "bj").select(
        F.when((F.col("i") == F.col("j")) & (F.col("bi") == F.col("bj")), True).otherwise(False).alias("same"),
        (F.col("similarity") if digits is None else F.round("similarity", digits)).alias("similarity"), "idsi", "idsj",
    )
    each = dealt.select("same", "similarity", "idsj", F.explode("idsi").alias("x")).select("same", "similarity", "x", F.explode("idsj").alias("y"))
    return each.where("not same or x < y").select(F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "similarity")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, floor: float = 1e-8) -> Column:
    return dot(a, b) / (F.greatest(F.sqrt(dot(a, a)), F.lit(floor)) * F.greatest(F.sqrt(dot(b, b)), F.lit(floor)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def against(rows: DataFrame, asked: DataFrame, key: str, blocks: int | None = None) -> DataFrame:
    """Every row with every one of ``asked``, a stated query set, in blocks: rows are dealt by the hash of ``key``, and the query
    set is given to each block, so that no task holds more than a block's rows and the queries pass through."""
    n = blocks or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(n)))
    return dealt.join(asked.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))), "_block").drop("_block")


def kernel_loss(pairs: DataFrame, found: str, wanted: str, keys: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """(keys, loss): the mean of squared differences, weighted where asked for."""
    w = F.col(weight) if weight else F.lit(1.0)
    return pairs.groupBy(*(keys or [])).agg((F.sum(w * F.pow(F.col(found) - F.col(wanted), 2)) / F.count(F.lit(1))).alias("loss"))


def ring_jaccard(counts: DataFrame, pairs: DataFrame, decay: float, depth: int) -> DataFrame:
    """(pairs' a and b, similarity): per ring the multiset Jaccard of edge labels, weighted by decay^hop. ``counts`` is (id, hop,
    label, n); rings that are empty on both sides count as equal."""
    one = pairs.join(counts.withColumnRenamed("id", "a"), "a").select("a", "b", "hop", "label", "n", F.lit(0).alias("m"))
    two = pairs.join(counts.withColumnRenamed("id", "b"), "b").select("a", "b", "hop", "label", F.lit(0).alias("n"), F.col("n").alias("m"))
    each = one.union(two).groupBy("a", "b", "hop", "label").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    ring = each.groupBy("a", "b", "hop").agg((F.sum(F.least("n", "m")) / F.sum(F.greatest("n", "m"))).alias("s"))
    hops = F.explode(F.sequence(F.lit(1), F.lit(depth))).alias("hop")
    norm = (1 - decay ** (depth + 1)) / (1 - decay) - 1
    full = pairs.select("a", "b", hops).join(ring, ["a", "b", "hop"], "left")
    return full.groupBy("a", "b").agg((F.sum(F.pow(F.lit(decay), F.col("hop")) * F.coalesce("s", F.lit(1.0))) / norm).alias("similarity"))


def redundancy_removal(items: DataFrame, close: DataFrame) -> DataFrame:
    """One of each component of ``close`` (i, j) stays: the lowest resolution, then the first by id; others' ids go."""
    named = linked_components(close).select(F.col("node").alias("id"), "component")
    whole = items.join(named, "id", "left").withColumn("component", F.coalesce("component", "id"))
    best = whole.groupBy("component").agg(F.min_by("id", F.struct(F.col("resolution").isNull(), F.col("resolution"), F.col("id"))).alias("id"), F.count(F.lit(1)).alias("members"))
    return best.select("id", "component", "members")


def greedy_clusters(items: DataFrame, close: DataFrame) -> DataFrame:
    """(id, cluster): in order of falling length, then id, an item joins the first earlier head that it is close to, or heads a
    cluster of its own.

    Whether an item heads a cluster depends on the earlier ones close to it alone, so in each round all items are settled whose
    earlier neighbours are: one with a head among them joins, one whose neighbours have all joined others is a head.
    """
    place = F.struct((-F.col("length")).alias("l"), F.col("id").alias("id"))
    at = items.select("id", place.alias("at"))
    ends = close.select("i", "j").distinct().join(at.select(F.col("id").alias("i"), F.col("at").alias("ai")), "i").join(at.select(F.col("id").alias("j"), F.col("at").alias("aj")), "j")
    later = F.col("ai") > F.col("aj")
    # (id, before): each item's earlier neighbours.
    earlier = durable(ends.select(F.when(later, F.col("i")).otherwise(F.col("j")).alias("id"), F.when(later, F.col("aj")).otherwise(F.col("ai")).alias("before")))
    bound = earlier.select("id").distinct()
    free = items.select("id").join(bound, "id", "left_anti")
    heads = durable(free)
    open_ = durable(bound)
    settled = heads.select("id", F.lit(True).alias("head"))
    while not open_.isEmpty():
        known = join_split(earlier.join(open_, "id", "left_semi").withColumn("other", F.col("before.id")), settled.select(F.col("id").alias("other"), "head"), ["other"], "left")
        seen = known.groupBy("id").agg(F.bool_or(F.coalesce("head", F.lit(False))).alias("joins"), F.bool_and(F.col("head").isNotNull()).alias("all"))
        done = durable(seen.where("joins or all").select("id", (~F.col("joins")).alias("head")))
        settled = durable(settled.union(done))
        open_ = durable(open_.join(done, "id", "left_anti"))
    joined = earlier.join(settled.where("head").select(F.col("id").alias("_head")), F.col("before.id") == F.col("_head"))
    own = joined.groupBy("id").agg(F.min("before").alias("best")).select("id", F.col("best.id").alias("cluster"))
    return items.select("id").join(own, "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster"))


def hungarian(cost: np.ndarray) -> tuple[np.ndarray, float]:
    """The cheapest assignment of rows to columns (no more rows than columns), by shortest augmenting paths."""
    n, m = cost.shape
    if n > m:
        back, total = hungarian(cost.T)
        out = np.full(n, -1)
        out[back] = np.arange(m)
        return out, total
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], at = i, 0
        least, came, done = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while match[at]:
            done[at] = True
            row = match[at]
            open_ = ~done[1:]
            reduced = cost[row - 1] - u[row] - v[1:]
            better = open_ & (reduced < least[1:])
            least[1:][better] = reduced[better]
            came[1:][better] = at
            to = int(np.where(open_, least[1:], np.inf).argmin()) + 1
            delta = least[to]
            u[match[done]] += delta
            v[done] -= delta
            least[1:][open_] -= delta
            at = to
        while at:
            match[at] = match[came[at]]
            at = came[at]
    out = np.full(n, -1)
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out, float(cost[np.arange(n), out].sum())


def edit_distance(one: set[tuple[int, int, str]], two: set[tuple[int, int, str]], substitute: Callable[[str, str], float], indel: Callable[[str], float], most_nodes: int = 9) -> float | None:
    """Graph edit distance with free node changes: the cheapest cost of edges over all injections of the smaller graph's nodes
    into the other's, by branch and bound. None if either has more than ``most_nodes``. Costs are not negative, and a label
    in place of itself costs nothing."""
    a, b = sorted({n for e in one for n in e[:2]}), sorted({n for e in two for n in e[:2]})
    if max(len(a), len(b)) > most_nodes:
        return None
    if len(a) > len(b):
        return edit_distance(two, one, substitute, indel, most_nodes)
    first, second = {(s, d): k for s, d, k in one}, {(s, d): k for s, d, k in two}
    # Nodes with most edges to those before come first, so that costs show early.
    order: list[int] = []
    while len(order) < len(a):
        tied = lambda n: (sum((n in e) and (e[0] in order or e[1] in order) for e in first), sum(n in e for e in first))
        order.append(max((n for n in a if n not in order), key=tied))
    between = lambda edges, n, others: [e for m in others for e in ((n, m), (m, n)) if e in edges] + [(n, n)] * ((n, n) in edges)
    rest = [Counter(first.values())]
    for i, n in enumerate(order):
        rest.append(rest[-1] - Counter(first[e] for e in between(first, n, order[:i])))
    known: dict[tuple, float] = {}

    def bound(p: Counter, q: Counter) -> float:
        """What the edges that are still open cost at least: of each label, those beyond the other side's change or go."""
        at = (frozenset(p.items()), frozenset(q.items()))
        if at not in known:
            left = sum((c - q[k]) * min([indel(k), *(substitute(k, x) for x in q if x != k)]) for k, c in p.items() if c > q[k])
            right = sum((c - p[k]) * min([indel(k), *(substitute(x, k) for x in p if x != k)]) for k, c in q.items() if c > p[k])
            known[at] = max(left, right)
        return known[at]

    best = math.inf

    def place(i: int, to: dict[int, int], cost: float, open_: Counter) -> None:
        nonlocal best
        if i == len(order):
            best = min(best, cost + sum(indel(k) * c for k, c in open_.items()))
            return
        n, steps = order[i], []
        mine = between(first, n, order[:i])
        for v in b:
            if v in to.values():
                continue
            there = set(between(second, v, to.values()))
            more, image = 0.0, {**to, n: v}
            for s, d in mine:
                e = (image[s], image[d])
                more += substitute(first[s, d], second[e]) if e in there else indel(first[s, d])
                there.discard(e)
            more += sum(indel(second[e]) for e in there)
            after = open_ - Counter(second[e] for e in between(second, v, to.values()))
            steps.append((cost + more + bound(rest[i + 1], after), v, cost + more, image, after))
        for least, _, now, image, after in sorted(steps, key=lambda x: x[:2]):
            if least >= best - 1e-12:
                break
            place(i + 1, image, now, after)

    place(0, {}, 0.0, Counter(second.values()))
    return best


def edit_distance_bound(one: set[tuple[int, int, str]], two: set[tuple[int, int, str]], substitute: Callable[[str, str], float], indel: Callable[[str], float]) -> float:
    """No less than the edit distance, for graphs of any size: nodes are assigned by the labels around them, and the edges are
    changed as that assignment asks for."""
    a, b = sorted({n for e in one for n in e[:2]}), sorted({n for e in two for n in e[:2]})
    around = [{n: Counter((k, n == s) for s, d, k in edges if n in (s, d)) for n in nodes} for edges, nodes in ((one, a), (two, b))]
    size = max(len(a), len(b))
    a, b = [*a, *[None] * (size - len(a))], [*b, *[None] * (size - len(b))]
    apart = lambda p, q: sum(((p - q) + (q - p)).values())
    cost = np.array([[apart(around[0].get(x, Counter()), around[1].get(y, Counter())) for y in b] for x in a], float)
    to = {x: b[j] for x, j in zip(a, hungarian(cost)[0].tolist(), strict=True) if x is not None} if size else {}
    second = {(s, d): k for s, d, k in two}
    total = 0.0
    for s, d, k in one:
        other = second.pop((to[s], to[d]), None)
        total += indel(k) if other is None else substitute(k, other)
    return total + sum(map(indel, second.values()))


def first_of_pure_clusters(rows: DataFrame, cluster: str, label: str, order: list[Column]) -> DataFrame:
    """Clusters with one distinct label, and of each the first row in ``order``."""
    pure = rows.groupBy(cluster).agg(F.countDistinct(label).alias("kinds")).where("kinds = 1").select(cluster)
    first = Window.partitionBy(cluster).orderBy(*order)
    return rows.join(pure, cluster, "left_semi").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
