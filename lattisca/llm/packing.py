"""Pattern packing: how often each full pattern of a few lengths is used comes from non-negative least squares.

The histogram of piece lengths has at most ``capacity`` bins, whatever the number of documents; patterns, fit, rounding
and the packing of what is left work on it alone. Pieces then find their places by their rank among those of equal length.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattisca.llm.common import durable, gapless_rank, table
from lattisca.llm.tokens import encoder

CAPACITY = 2048
ROUNDS = 250


def patterns(counts: np.ndarray, capacity: int) -> np.ndarray:
    """All patterns of one to three present lengths, the largest first, that fill ``capacity``; missing parts are 0."""
    there = np.flatnonzero(counts[1:]) + 1
    rows = [np.array([[capacity, 0, 0]])] if counts[capacity] else []
    pair = there[(there * 2 >= capacity) & (there < capacity)]
    pair = pair[counts[capacity - pair] > 0]
    rows.append(np.stack([pair, capacity - pair, np.zeros_like(pair)], 1))
    for a in there[there * 3 >= capacity]:
        b = there[(there <= a) & (there * 2 >= capacity - a) & (there < capacity - a)]
        b = b[counts[capacity - a - b] > 0]
        rows.append(np.stack([np.full_like(b, a), b, capacity - a - b], 1))
    return np.concatenate(rows).astype(np.int64)


def fit(pats: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Non-negative least squares: repeat counts x with A x near the histogram, by accelerated projected gradients."""
    if not len(pats):
        return np.zeros(0)
    size, h = len(counts), counts.astype(float)
    used = pats > 0

    def apply(x: np.ndarray) -> np.ndarray:
        return sum(np.bincount(pats[used[:, k], k], x[used[:, k]], size) for k in range(pats.shape[1]))

    def back(r: np.ndarray) -> np.ndarray:
        return np.where(used, r[pats], 0.0).sum(1)

    v = np.ones(len(pats))
    for _ in range(12):  # the largest eigenvalue of A'A
        v = back(apply(v))
        v /= np.linalg.norm(v)
    step = 1.0 / max(1e-9, float(v @ back(apply(v))) * 1.05)
    x = np.zeros(len(pats))
    y, t = x, 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - step * back(apply(y) - h))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and how many sequences have each: fitted ones, then best fit of what is left, the longest first."""
    left = counts.astype(np.int64).copy()
    pats = patterns(left, capacity)
    x = fit(pats, left)
    out: list[tuple[tuple[int, ...], int]] = []
    for k in np.argsort(-x, kind="stable"):
        if x[k] < 0.5:
            break
        parts = [int(p) for p in pats[k] if p]
        times = min(int(np.floor(x[k] + 0.5)), *(int(left[p]) // parts.count(p) for p in parts))
        if times > 0:
            out.append((tuple(parts), times))
            for p in parts:
                left[p] -= times
    return out + best_fit(left, capacity)


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing where equal bins are one entry with a count, so that work follows the histogram, not the rows."""
    rooms: list[int] = []  # rising, the free places that some bin has
    bins: dict[int, list[list]] = {}
    done: list[tuple[tuple[int, ...], int]] = []

    def put(parts: tuple[int, ...], times: int) -> None:
        room = capacity - sum(parts)
        if not room:
            done.append((parts, times))
            return
        if room not in bins:
            bisect.insort(rooms, room)
            bins[room] = []
        bins[room].append([parts, times])

    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                if n // each:
                    put((length,) * each, n // each)
                if n % each:
                    put((length,) * (n % each), 1)
                break
            room = rooms[at]
            parts, times = bins[room].pop()
            if not bins[room]:
                del bins[room], rooms[at]
            take = min(times, n)
            if take < times:
                put(parts, times - take)
            put((*parts, length), take)
            n -= take
    return done + [(p, t) for v in bins.values() for p, t in v]


def places(planned: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys length << 40 | first rank, and for each the first sequence and the offset there."""
    entries, given, sequence = [], {}, 0
    for parts, times in planned:
        offset = 0
        for p in parts:
            entries.append((p << 40 | given.get(p, 0), sequence, offset))
            given[p] = given.get(p, 0) + times
            offset += p
        sequence += times
    entries.sort()
    keys, first, offsets = (np.array(c, np.int64) for c in zip(*entries, strict=True)) if entries else (np.zeros(0, np.int64),) * 3
    return keys, first, offsets


def pieces(docs: DataFrame, tokenizer: str, end_id: int, spaced: bool, capacity: int, key: str, text: str, ids: bool = False) -> DataFrame:
    """Documents as ids and an end id, cut every ``capacity`` ids."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer, spaced), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            who, piece, start, length, crc, all_ids = [], [], [], [], [], []
            for k in range(0, batch.num_rows, 128):
                for i, raw in enumerate(encode.encode_all(batch.column(1).slice(k, 128).to_pylist())):
                    raw += end
                    for n, at in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[at : at + 4 * capacity]
                        who.append(k + i)
                        piece.append(n)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if ids:
                            all_ids.append(np.frombuffer(part, "<u4").astype(np.int64))
            columns = [batch.column(0).take(pa.array(who, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc))]
            names = [key, "piece", "start", "length", "ids_crc32"]
            if ids:
                columns.append(pa.array(all_ids, pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if ids else ""))


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, spaced: bool = False, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """Packs every document, cut only where it is longer than ``capacity``, into few sequences of at most ``capacity`` ids.

    Returns key, piece, start, length, ids_crc32, sequence_id, offset and, with ``ids``, the ids. A null or empty text is
    the end id alone; repeated rows are packed as often as they come; an empty table gives no rows; other columns of
    ``docs`` are not read.
    """
    cut = durable(pieces(docs, tokenizer, end_id, spaced, capacity, key, text, ids))
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in cut.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[length] = n
    keys, first, offsets = places(plan(counts, capacity))
    ranked = gapless_rank(cut, ["length"], [key, "piece"], "_rank", F.struct(key, "piece"))
    held = [f.name for f in cut.schema]

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column(len(held)).to_numpy()
            at = batch.column(held.index("length")).to_numpy() << 40 | rank
            k = np.searchsorted(keys, at, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(first[k] + at - keys[k]), pa.array(offsets[k])], names=[*held, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    return ranked.select(*held, "_rank").mapInArrow(seat, kinds + ", sequence_id long, offset long")


def op10_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
