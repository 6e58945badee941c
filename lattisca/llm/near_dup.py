"""Near-duplicates by an LSH forest: several orders of sorted MinHash signatures, in each of which documents that share a long
prefix are candidates. The shortest prefix makes a bucket; for a cheap first round crowded buckets are read deeper, region by
region, and in the second all documents of a bucket that lie in different components are compared.

Texts with equal shingle sets are one class from the start. Candidates are confirmed on full sets, and components of the
links are found without any of it on the driver. What is compared in memory is bounded by REGION: a larger bucket is cut into
blocks that all meet, in tasks of their own. Only pairs that could still join two components leave a task, so a group of copies
costs about as many pairs as it has members.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattisca.llm.common import Scratch, durable, hold, join_split, table

TREES = 16
DEPTH = 8
#: Values of a tree's signature that make the first prefix, and those of the deeper ones for crowded regions.
PREFIXES = (4, 6, 8)
#: The most documents that are compared in one piece (about: blocks are dealt by hash), and the most of which all pairs are
#: looked at at once.
REGION = 2048
SMALL = 24
#: Estimated similarity from which a pair may be a link, and from which it surely is one for choosing what to confirm. By the
#: binomial law one in 100,000 pairs of similarity 0.8 is estimated below the first.
MAYBE, SURE = 0.64, 0.92
#: Of a shingle's hash, what is kept where sets travel to crowded buckets; what is found with them is confirmed on whole hashes.
NARROW = np.uint32
#: Pairs for each document of a cell that are compared one by one at most, and columns that a matrix has when all are counted.
FEW_PAIRS = 8
COLUMNS = 2048
NEIGHBOURS = 3
HUBS = 3
KEPT_WORDS = 250_000
#: Ids of candidates that are broadcast at most (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20_240_229)
_A = _rng.integers(1, 2**63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(1, 2**63, TREES * DEPTH, dtype=np.uint64)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = v = xxhash.xxh64_intdigest(word)
        return v


_WORDS = _Words()


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``words`` words; A-Z count as a-z."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    if len(_WORDS) > KEPT_WORDS:
        _WORDS.clear()
    h = np.array([_WORDS[w] for w in found], np.uint64)
    k = min(words, len(h))
    n = len(h) - k + 1
    acc = np.full(n, np.uint64(k), np.uint64)
    for j in range(k):
        acc = (acc ^ (acc >> np.uint64(29))) * _MIX + h[j : j + n]
    acc = (acc ^ (acc >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(acc ^ (acc >> np.uint64(32)))


def signature(s: np.ndarray) -> np.ndarray:
    """TREES x DEPTH MinHash values of 32 bits; long sets are hashed in pieces."""
    out = np.full(TREES * DEPTH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 4096):
        out = np.minimum(out, (s[at : at + 4096][None, :] * _A[:, None] + _B[:, None]).min(1))
    return (out >> np.uint64(32)).astype(">u4")


def _signed(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("near_dup", _WORDS.clear)
        for batch in batches:
            sizes, first, second, sigs, briefs = [], [], [], [], []
            for t in batch.column(1):
                s = shingles(t.as_py(), words)
                d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                sizes.append(len(s))
                first.append(int.from_bytes(d[:8], "little", signed=True))
                second.append(int.from_bytes(d[8:], "little", signed=True))
                sig = signature(s) if len(s) else None
                sigs.append(None if sig is None else sig.tobytes())
                briefs.append(None if sig is None else (sig & 0xFF).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(sigs, pa.binary()), pa.array(briefs, pa.binary())], names=["id", "n", "k1", "k2", "sig", "brief"])

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"))
    return rows.mapInArrow(run, "id long, n long, k1 long, k2 long, sig binary, brief binary")


def _regions(reps: DataFrame) -> DataFrame:
    """Rows (bucket, region, place, id, brief): each document once in each tree in which its prefix, the bucket, is shared,
    ordered by place. A crowded bucket has several regions, which is where the first round looks for links; none is final. Any
    other is one, and its ``region`` null: hashes fill the disk."""
    def prefix(values: int) -> Column:
        return F.xxhash64("t", F.substring("sig", F.col("t") * (4 * DEPTH) + 1, F.lit(4 * values)))

    # Narrow rows find out which prefixes are shared at all; signatures then go to the members of those alone.
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("t")
    rows = reps.select("id", "sig", tree).select("id", "t", prefix(PREFIXES[0]).alias(f"p{PREFIXES[0]}"))
    shared = rows.groupBy(f"p{PREFIXES[0]}").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    found = rows.join(shared.where(F.col("m") <= REGION), f"p{PREFIXES[0]}").select("id", "t", F.col(f"p{PREFIXES[0]}").alias("bucket"), F.lit(None).cast("long").alias("region"))
    # Crowded prefixes, mostly none, are read deeper until they are small enough.
    deep = join_split(rows, shared.where(F.col("m") > REGION), [f"p{PREFIXES[0]}"]).select("id", "t", F.col(f"p{PREFIXES[0]}").alias("bucket")).join(reps.select("id", "sig"), "id")
    deep = deep.select("id", "t", "bucket", *[prefix(d).alias(f"p{d}") for d in PREFIXES[1:]], F.lit(None).cast("long").alias("region"))
    for d in PREFIXES[1:]:
        counts = deep.where(F.col("region").isNull()).groupBy(f"p{d}").agg(F.count(F.lit(1)).alias(f"m{d}"))
        deep = join_split(deep, counts, [f"p{d}"], "left").withColumn("region", F.coalesce("region", F.when(F.col(f"m{d}") <= REGION, F.col(f"p{d}"))))
    last = PREFIXES[-1]
    # Still too many alike to the last value: cut by chance, in each tree in another way.
    part = F.pmod(F.xxhash64("id", f"p{last}"), F.ceil(F.col(f"m{last}") / REGION))
    deep = deep.select("id", "t", "bucket", F.coalesce("region", F.xxhash64(f"p{last}", part)).alias("region"))
    place = F.substring("sig", F.col("t") * (4 * DEPTH) + 1, F.lit(4 * DEPTH))
    return found.union(deep).join(reps.select("id", "sig", "brief"), "id").select("bucket", "region", place.alias("place"), "id", "brief")


def _pairs_between(brief: np.ndarray, comp: np.ndarray | None, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and estimated similarity, the most alike first, of pairs that may be linked (of different components only, and
    across where there are two sides)."""
    across = side is not None and 0 < side.sum() < len(side)
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side)) if across else (np.arange(len(brief)),) * 2
    left, right = left.astype(np.int32), right.astype(np.int32)
    other = brief[right]
    one, two, est = [], [], []
    for i in range(0, len(left), 128):
        at = left[i : i + 128]
        same = (brief[at][:, None, :] == other[None, :, :]).sum(2, dtype=np.int16)
        alike = same >= MAYBE * brief.shape[1]
        if comp is not None:
            alike &= comp[at][:, None] != comp[right][None, :]
        a, b = np.nonzero(alike)
        up = slice(None) if across else right[b] > at[a]
        one.append(at[a][up])
        two.append(right[b][up])
        est.append(same[a, b][up])
    one, two, est = np.concatenate(one), np.concatenate(two), np.concatenate(est)
    order = np.argsort(-est, kind="stable")
    return one[order], two[order], est[order] / brief.shape[1]


def _candidates_of(ids: np.ndarray, brief: np.ndarray, comp: np.ndarray | None) -> list[tuple[int, int]]:
    """Pairs of a region to confirm. First time (no ``comp``): a spanning forest of those that seem alike, and all that are
    in doubt. Later: those alike enough between different components."""
    m = len(ids)
    if m <= SMALL or comp is not None:
        one, two, est = _pairs_between(brief, comp)
    else:
        major = np.array([np.bincount(brief[:, k], minlength=256).argmax() for k in range(brief.shape[1])], np.uint8)
        hubs = np.argsort(-(brief == major).sum(1), kind="stable")[:HUBS]
        steps = [(np.arange(m - d), np.arange(d, m)) for d in range(1, NEIGHBOURS + 1)] + [(np.full(m, h), np.arange(m)) for h in hubs]
        one, two = (np.concatenate(x) for x in zip(*steps, strict=True))
        est = (brief[one] == brief[two]).mean(1)
        ok = (est >= MAYBE) & (one != two)
        one, two, est = one[ok], two[ok], est[ok]
    low, high = np.minimum(ids[one], ids[two]), np.maximum(ids[one], ids[two])
    ok = low != high
    one, two, est, low, high = one[ok], two[ok], est[ok], low[ok], high[ok]
    if comp is not None:
        return list(zip(low.tolist(), high.tolist(), strict=True))
    parent = list(range(m))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for k in np.lexsort((high, low, -est)):
        x, y = find(int(one[k])), find(int(two[k]))
        if x != y:
            out.append((int(low[k]), int(high[k])))
            if est[k] >= SURE:
                parent[x] = y
    return out


def _by_region(dealt: DataFrame, of: Callable[[pa.Table], list[tuple[int, int]]]) -> DataFrame:
    """Pairs (a, b) that ``of`` finds in each region. Rows come dealt out and sorted by region; one region is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("near_dup", _WORDS.clear)
        held: list[pa.RecordBatch] = []

        def pairs(rows: pa.Table) -> pa.RecordBatch:
            cuts = np.flatnonzero(np.diff(rows.column("region").to_numpy())) + 1
            out: set[tuple[int, int]] = set()
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), rows.num_rows], strict=True):
                if j - i > 1:
                    out.update(of(rows.slice(i, j - i)))
            low, high = zip(*out, strict=True) if out else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(low, pa.int64()), pa.array(high, pa.int64())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            region = batch.column(0).to_numpy()
            cut = int(np.searchsorted(region, region[-1]))  # the last region may go on in the next batch
            if held and held[-1].column(0)[-1].as_py() != region[0]:
                yield pairs(pa.Table.from_batches(held))
                held = []
            if cut:
                yield pairs(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield pairs(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _brief(rows: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(rows.column("brief").to_pylist()), np.uint8).reshape(rows.num_rows, -1)


def _candidates(regions: DataFrame, with_comp: bool) -> DataFrame:
    order = ["region", "id"] if with_comp else ["region", "place", "id"]
    dealt = regions.select(*order, "brief", *["comp"] * with_comp).repartition("region").sortWithinPartitions(*order)
    return _by_region(dealt, lambda rows: _candidates_of(rows.column("id").to_numpy(), _brief(rows), rows.column("comp").to_numpy() if with_comp else None))


def _linked(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have 100 * intersection >= percent * union."""
    short, long = (p, q) if len(p) < len(q) else (q, p)
    if not len(short) or 100 * len(short) < percent * len(long):
        return False
    at = np.searchsorted(long, short)
    at[at == len(long)] = 0
    inter = int((long[at] == short).sum())
    return 100 * inter >= percent * (len(p) + len(q) - inter)


def _cells(crowded: DataFrame) -> DataFrame:
    """Rows (region, id, brief, comp, side) of crowded buckets, dealt to cells in which any two documents of a bucket
    and of different components meet. A bucket of at most REGION documents is one cell. A larger one is cut into blocks of
    half as many, those of its largest component apart, as they need not meet each other: each block of the rest meets
    itself in one cell and every other block, as the two sides of a cell, in another."""
    large = crowded.where(F.col("m") > REGION)
    each = large.groupBy("region", "comp").agg(F.count(F.lit(1)).alias("n"))
    half = F.lit(max(1, REGION // 2))
    cut = each.groupBy("region").agg(
        F.max_by("comp", F.struct("n", "comp")).alias("major"),
        F.ceil((F.sum("n") - F.max("n")) / half).alias("rest"),
        F.ceil(F.max("n") / half).alias("others"),
    )
    rows = join_split(large, cut, ["region"]).withColumn("in_major", F.col("comp") == F.col("major"))
    deal = lambda n: F.pmod(F.xxhash64("id", F.lit(REGION)), F.col(n))
    rows = rows.withColumn("block", F.when(F.col("in_major"), F.col("rest") + deal("others")).otherwise(deal("rest")))
    last = F.when(F.col("in_major"), F.col("rest") - 1).otherwise(F.col("rest") + F.col("others") - 1)
    met = rows.withColumn("met", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    cell = F.xxhash64("region", F.least("block", "met"), F.greatest("block", "met"))
    whole = crowded.where(F.col("m") <= REGION).select("region", "id", "brief", "comp", F.lit(0).alias("side"))
    return whole.union(met.select(cell.alias("region"), "id", "brief", "comp", (F.col("block") > F.col("met")).cast("int").alias("side")))


def _may_link(p: np.ndarray, q: np.ndarray, n: int, m: int, percent: int) -> bool:
    """Whether sets of ``n`` and ``m`` hashes may be linked, by sorted sets of parts of these hashes. Parts that fall together
    inside of a set hide at most as many common hashes as the set has lost, so no link is turned down."""
    if 100 * min(n, m) < percent * max(n, m) or not min(n, m):
        return False
    short, long = (p, q) if len(p) < len(q) else (q, p)
    at = np.searchsorted(long, short)
    at[at == len(long)] = 0
    common = int((long[at] == short).sum()) + min(n - len(p), m - len(q))
    return 100 * common >= percent * (n + m - common)


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many hashes each set of ``left`` has in common with each of ``right``, by products of 0/1 matrices of some columns at
    a time."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts[column] > 1
    column, owner = (np.cumsum(counts > 1) - 1)[column[shared]], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        i, j = np.searchsorted(column, [first, first + COLUMNS])
        held = np.zeros((len(sets), COLUMNS), np.float32)
        held[owner[i:j], column[i:j] - first] = 1
        out += held[left] @ held[right].T
    return out


def _forest(one: np.ndarray, two: np.ndarray, comp: np.ndarray) -> list[tuple[int, int]]:
    """Of links between places, some that join all components that they can, each round one for each component."""
    label = np.unique(comp, return_inverse=True)[1].astype(np.int32)
    out = []
    while True:
        a, b = label[one], label[two]
        apart = a != b
        one, two, a, b = one[apart], two[apart], a[apart], b[apart]
        if not len(one):
            return out
        parent = np.arange(label.max() + 1, dtype=np.int32)
        first = np.full(len(parent), -1)  # a component's first link; the last place that is put counts
        for ends in (b, a):
            first[ends[::-1]] = np.arange(len(one) - 1, -1, -1)
        first = first[first >= 0]

        def find(x: int) -> int:
            while parent[x] != x:  # noqa: B023
                parent[x] = parent[parent[x]]  # noqa: B023
                x = int(parent[x])  # noqa: B023
            return x

        for k in np.unique(first).tolist():
            x, y = find(int(a[k])), find(int(b[k]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((int(one[k]), int(two[k])))
        label = np.array([find(x) for x in range(len(parent))])[label]


def _joining_links(rows: pa.Table, percent: int, kind: type) -> list[tuple[int, int]]:
    """Of a cell, links between different components, found on the sets of hashes of ``kind``: only what joins
    two components leaves, never the pairs that were looked at. Where many pairs may be links, all are counted at once."""
    ids, comp, sizes = (rows.column(c).to_numpy() for c in ("id", "comp", "n"))
    side = rows.column("side").to_numpy()
    sets = [np.frombuffer(s, kind) for s in rows.column("s").to_pylist()]
    one, two, _ = _pairs_between(_brief(rows), comp, side)
    if len(one) > FEW_PAIRS * len(ids):
        del one, two, _
        across = 0 < side.sum() < len(side)
        left, right = (x.astype(np.int32) for x in ((np.flatnonzero(side == 0), np.flatnonzero(side)) if across else (np.arange(len(ids)),) * 2))
        lost = sizes - np.array([len(s) for s in sets])
        common = _common(sets, left, right)
        linked = np.empty(common.shape, bool)
        for k in range(0, len(left), 128):
            at = left[k : k + 128]
            most = common[k : k + 128] + np.minimum(lost[at][:, None], lost[right][None, :])
            linked[k : k + 128] = (100 * most >= percent * (sizes[at][:, None] + sizes[right][None, :] - most)) & (comp[at][:, None] != comp[right][None, :])
        i, j = np.nonzero(linked if across else np.triu(linked, 1))
        one, two = left[i], right[j]
        del common, linked, i, j
    else:
        ok = np.array([_may_link(sets[i], sets[j], int(sizes[i]), int(sizes[j]), percent) for i, j in zip(one.tolist(), two.tolist(), strict=True)], bool)
        one, two = one[ok], two[ok]
    return [(int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))) for i, j in _forest(one, two, comp)]


def _crowded_links(crowded: DataFrame, docs: DataFrame, key: str, text: str, words: int, percent: int, scratch: Scratch) -> DataFrame:
    """Confirmed links that join the components of crowded buckets. They are searched on narrow hashes; where one of the
    found pairs is no link on whole hashes, what it has hidden behind it is searched for again on those."""
    cells = _cells(crowded)

    def search(some: DataFrame, ids: DataFrame, kind: type) -> DataFrame:
        full = some.join(_sets(ids.select("id").distinct(), docs, key, text, words, scratch, kind), "id")
        dealt = full.select("region", "id", "brief", "comp", "side", "n", "s").repartition("region").sortWithinPartitions("region", "id")
        return scratch.keep(_by_region(dealt, lambda rows: _joining_links(rows, percent, kind)))

    joining = search(cells, crowded, NARROW)
    links = scratch.keep(_confirmed(joining, docs, key, text, words, percent, scratch))
    wrong = scratch.keep(joining.join(links, ["a", "b"], "left_anti"))
    if not wrong.isEmpty():
        ends = wrong.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        touched = cells.join(ends, "id", "left_semi").select("region").distinct()
        some = scratch.keep(cells.join(touched, "region", "left_semi"))
        again = search(some, some, np.uint64)
        links = links.union(_confirmed(again, docs, key, text, words, percent, scratch))
    return links


def _sets(ids: DataFrame, docs: DataFrame, key: str, text: str, words: int, scratch: Scratch, kind: type = np.uint64) -> DataFrame:
    """(id, n, s): of the documents with these ids how many shingles they have, and their hashes, or the upper parts of
    ``kind``, sorted, as bytes."""
    ids = scratch.keep(ids)
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    needed = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")).join(ids, "id", "left_semi")
    cut = np.uint64(64 - 8 * np.dtype(kind).itemsize)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("near_dup", _WORDS.clear)
        for batch in batches:
            whole = [shingles(t.as_py(), words) for t in batch.column(1)]
            found = [(np.unique((s >> cut).astype(kind)) if cut else s).tobytes() for s in whole]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in whole], pa.int64()), pa.array(found, pa.binary())], names=["id", "n", "s"])

    return scratch.keep(needed.mapInArrow(sets, "id long, n long, s binary"))


def _confirmed(pairs: DataFrame, docs: DataFrame, key: str, text: str, words: int, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""
    whole = _sets(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), docs, key, text, words, scratch)
    both = pairs.join(whole.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(whole.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("near_dup", _WORDS.clear)
        for batch in batches:
            ok = [_linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "sa", "sb").mapInArrow(confirm, "a long, b long")


def components(links: DataFrame, rounds: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """Rows (id, comp) for every end of a link: the smallest id that it reaches, by large and small stars in turn until
    nothing changes; an error if ``rounds`` are given and do not suffice. What the result reads is left to ``scratch``."""
    scratch, outer = Scratch(links.sparkSession), scratch
    edges = scratch.keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    if edges.isEmpty():
        return edges.select(F.col("u").alias("id"), F.col("v").alias("comp"))
    seen = None
    for _ in itertools.count() if rounds is None else range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # A large component's centre has an edge to each of its members.
        large = join_split(both, least, ["u"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = join_split(large, down, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(down.select("u", F.col("m").alias("v"))).distinct()
        edges = scratch.keep(small)
        scratch.drop(but=1)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == seen:
            if outer is not None:
                outer.paths += scratch.paths
            return edges.groupBy("u").agg(F.min("v").alias("comp")).select(F.col("u").alias("id"), "comp")
        seen = now
    raise RuntimeError(f"components still change after {rounds} rounds")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Returns for each document key, n_shingles, component_id (the smallest key that links reach) and kept (it is that one).

    Documents are linked if their sets of ``words``-word shingles have 100 * intersection >= percent * union; a text with
    fewer words is one shingle, a long one has all of its shingles. Null and empty texts have no set and are linked with
    nothing. Documents with equal sets are a class of their own before any search. Keys are whole numbers of 64 bits; rows
    that repeat a key are one document's, each returned. A null key has no component and is kept. An empty table gives no
    rows; other columns are not read. Only the result stays in the shared folder, what led to it is removed.
    """
    scratch = Scratch(docs.sparkSession)
    signed = scratch.keep(_signed(docs, key, text, words))
    filled = signed.where("n > 0 and id is not null")
    classes = filled.groupBy("k1", "k2").agg(F.min("id").alias("rep"))
    # Joined by id alone: what follows is dealt by id too, and signatures are shuffled once.
    owners = classes.select(F.col("rep").alias("id"), F.col("k1").alias("c1"), F.col("k2").alias("c2"))
    reps = filled.join(owners, "id").where("k1 = c1 and k2 = c2").select("id", "sig", "brief").distinct()
    regions = scratch.keep(_regions(reps))
    first = scratch.keep(_candidates(regions.withColumn("region", F.coalesce("region", "bucket")), False))
    links = scratch.keep(_confirmed(first, docs, key, text, words, percent, scratch))
    comp = components(links, scratch=scratch)
    # Buckets that still hold several components: what could join them and was not looked at before.
    # Ids and components tell which; signatures travel for those buckets alone.
    regions = regions.select(F.col("bucket").alias("region"), "id", "brief")
    marked = scratch.keep(regions.select("region", "id").join(comp, "id", "left").select("region", "id", F.coalesce("comp", "id").alias("comp")))
    mixed = marked.groupBy("region").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("m")).where("x < y").select("region", "m")
    open_ = scratch.keep(join_split(marked, mixed, ["region"]).join(regions, ["region", "id"]).select("region", "id", "brief", "comp", "m"))
    second = scratch.keep(_candidates(open_.where(F.col("m") <= SMALL), True).join(first, ["a", "b"], "left_anti"))
    more = links.limit(0) if second.isEmpty() else _confirmed(second, docs, key, text, words, percent, scratch)
    crowded = open_.where(F.col("m") > SMALL)
    if not crowded.isEmpty():
        more = more.union(_crowded_links(crowded, docs, key, text, words, percent, scratch))
    comp = components(comp.where("id <> comp").select(F.col("id").alias("a"), F.col("comp").alias("b")).union(more), scratch=scratch)
    # Classes by their representative's component, documents by their class. Those without a shingle are no class.
    named = classes.join(comp, classes.rep == comp.id, "left").select("k1", "k2", F.coalesce("comp", "rep").alias("comp"))
    full = join_split(filled.select("id", "n", "k1", "k2"), named, ["k1", "k2"]).select("id", "n", "comp")
    out = full.union(signed.where("n = 0 or id is null").select("id", "n", F.col("id").alias("comp")))
    found = durable(out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"), F.coalesce(F.col("id") == F.col("comp"), F.lit(True)).alias("kept")))
    scratch.drop()
    return found


def deduplicate(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: of each group the row with the smallest key stays.

    Rows that repeat a key and its text are one row, the one with the smallest hash of all columns. Rows that repeat a key
    with other texts are documents of their own, and the smallest hash of key and text decides between them. Rows without
    a key, without text or with texts alike to none stay. Ties of similarity don't matter, as all links count.
    """
    repeated = durable(docs.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(key))
    kept = lambda rows: near_duplicates(rows, words, percent, "_node", text).where("kept and _node is not null")
    if repeated.isEmpty():
        rows = docs.withColumn("_node", F.col(key).cast("long"))
        return rows.join(kept(rows).select("_node"), "_node", "left_semi").union(rows.where("_node is null").select("_node", *docs.columns)).select(*docs.columns)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    again = join_split(docs.where(F.col(key).isNotNull()), repeated, [key]).groupBy(F.col(key).alias("_key"), F.xxhash64(text).alias("_th")).agg(F.min_by(whole, F.xxhash64(whole)).alias("_row"))
    ones = docs.where(F.col(key).isNotNull()).join(repeated, key, "left_anti").select(*docs.columns)
    rows = ones.withColumn("_node", F.col(key).cast("long")).unionByName(again.select("_row.*", F.xxhash64("_key", "_th").alias("_node")))
    rows = durable(rows)
    found = near_duplicates(rows, words, percent, "_node", text).select("_node", F.col("component_id").alias("_comp"))
    best = rows.select("_node", F.col(key).alias("_key")).join(found, "_node").groupBy("_comp").agg(F.min_by("_node", F.struct("_key", "_node")).alias("_node")).select("_node")
    return rows.join(best, "_node", "left_semi").select(*docs.columns).union(docs.where(F.col(key).isNull()))


def op4_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)
