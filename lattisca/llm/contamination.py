"""Benchmark decontamination: one Aho-Corasick automaton over normalised passages of the test items.

The automaton holds every item's grams of GRAM words at steps that leave no window without a whole one, and short items as they
are. A gram that is found is followed on both sides along the item, so each window is compared in full and each text
scanned once, while the automaton is no larger than the items.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattisca.llm.common import Scratch, durable, hold, table, with_text

WINDOW = 10
GRAM = 5
#: Characters of items that one automaton takes (about 60 bytes of a worker's memory for each). The driver asks for their number
#: before it reads any; a larger benchmark is run over the documents in lots, one after the other.
AUTOMATON_CHARS = 3_000_000

#: Bytes to what they are in normalised text: A-Z in lower case, other ASCII that is no letter or digit a space.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_NORMAL).split()


class Contamination:
    """The automaton and what its patterns belong to."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        import ahocorasick

        self.names, self.window, self.items = [name for name, _ in items], window, [words_of(text) for _, text in items]
        gram = min(GRAM, window)
        owners: dict[bytes, list[tuple[int, int]]] = {}
        for k, words in enumerate(self.items):
            size = gram if len(words) >= window else len(words)
            for i in range(0, len(words) - size + 1, window - gram + 1) if words else ():
                owners.setdefault(b" ".join(words[i : i + size]), []).append((k, i))
        self.owners = list(owners.values())
        self.automaton = ahocorasick.Automaton()
        for n, pattern in enumerate(owners):
            # Latin-1 gives each byte of UTF-8 a character, so that places in the text are places in its bytes.
            self.automaton.add_word(f" {pattern.decode('latin-1')} ", (n, pattern.count(b" ") + 1, len(pattern) + 2))
        self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """The number of words; runs of hit words (first, behind the last); the items found."""
        words = words_of(text)
        if not words or not self.owners:
            return len(words), [], set()
        normal = b" " + b" ".join(words) + b" "
        found = list(self.automaton.iter(normal.decode("latin-1")))
        if not found:
            return len(words), [], set()
        spaces = np.flatnonzero(np.frombuffer(normal, np.uint8) == 32)
        starts = np.searchsorted(spaces, [end - size + 1 for end, (_, _, size) in found]).tolist()
        runs: list[tuple[int, int]] = []
        names: set[str] = set()
        passed: dict[tuple[int, int], int] = {}  # by item and shift: how far it was followed
        for at, (_, (n, count, _)) in sorted(zip(starts, found, strict=True), key=lambda x: x[0]):
            for k, i in self.owners[n]:
                if passed.get((k, at - i), -1) >= at + count:
                    continue
                item = self.items[k]
                first, behind = 0, count
                while first < min(at, i) and words[at - first - 1] == item[i - first - 1]:
                    first += 1
                while at + behind < len(words) and i + behind < len(item) and words[at + behind] == item[i + behind]:
                    behind += 1
                passed[k, at - i] = at + behind
                if first + behind >= min(self.window, len(item)):
                    names.add(self.names[k])
                    runs.append((at - first, at + behind))
        return len(words), merged(runs), names


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def original_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as places (first character, behind the last) in the text itself."""
    normal = text.encode("utf-8", "surrogatepass").translate(_NORMAL)
    word = np.frombuffer(normal, np.uint8) != 32
    edges = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    chars = np.cumsum((np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8) & 0xC0) != 0x80)
    return [(int(chars[starts[a]]) - 1, int(chars[ends[b - 1] - 1])) for a, b in runs]


_BUILT: dict[tuple[str, int], Contamination] = {}


def _built(items: list[tuple[str, str]], digest: str, window: int) -> Contamination:
    """One automaton at a time in a worker."""
    hold("contamination", _BUILT.clear)
    if (digest, window) not in _BUILT:
        _BUILT.clear()
        _BUILT[digest, window] = Contamination(items, window)
    return _BUILT[digest, window]


def _lots(items: DataFrame, limit: int) -> Iterator[list[tuple[str, str]]]:
    """The items, in lots whose texts have at most ``limit`` characters (or one item)."""
    lot: list[tuple[str, str]] = []
    size = 0
    for name, body in items.toLocalIterator():
        if lot and size + len(body) > limit:
            yield lot
            lot, size = [], 0
        lot.append((name, body))
        size += len(body)
    yield lot


HITS = "runs array<struct<first:long,behind:long>>, names array<string>"


def _hits(rows: DataFrame, lot: list[tuple[str, str]], window: int) -> DataFrame:
    """(_row, runs, names) of the rows (_row, text) with hits of the lot's items."""
    digest = hashlib.sha256(repr(lot).encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            automaton = _built(lot, digest, window)
            found = [automaton.scan(t.as_py()) for t in batch.column(1)]
            at = [i for i, f in enumerate(found) if f[1]]
            runs = pa.array([[{"first": a, "behind": b} for a, b in found[i][1]] for i in at], pa.list_(pa.struct([("first", pa.int64()), ("behind", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), runs, pa.array([sorted(found[i][2]) for i in at], pa.list_(pa.string()))], names=["_row", "runs", "names"])

    return rows.mapInArrow(run, f"_row long, {HITS}")


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", keep: list[str] | None = None, spans: bool = False) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated; with ``spans`` also the hit places in the text.

    A word is hit if an occurrence of an item's window covers it. Null or empty texts have no words and aren't
    contaminated; a long text is scanned whole; items without words or id have no windows; repeated items count once; a
    repeated document has a row each; an empty benchmark contaminates nothing. ``keep`` names columns of ``docs`` to carry along.
    """
    items = benchmark.select(F.col(item).cast("string").alias("name"), F.col(item_text).alias("body")).where("name is not null and body is not null")
    keep = [c for c in keep or [] if c not in (key, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans")]
    extra = ", spans array<struct<first:long,behind:long>>" if spans else ""
    rows, kept = with_text(docs, text, [key, *keep])
    keep = kept.fieldNames()
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields)
    schema = f"{kinds}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean{extra}"
    body_at = len(rows.columns) - 1  # the text, among those kept or behind them

    def figures(batch: pa.RecordBatch, bodies: list[str | None], found: list[tuple[int, list[tuple[int, int]], set[str]]]) -> pa.RecordBatch:
        out = []
        for body, (n, runs, names) in zip(bodies, found, strict=True):
            places = [[{"first": a, "behind": b} for a, b in original_spans(body, runs)] if runs else []] if spans else []
            out.append((n, sum(b - a for a, b in runs), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(runs), *places))
        cols = list(zip(*out, strict=True)) or [[]] * (6 if spans else 5)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), *([pa.list_(pa.struct([("first", pa.int64()), ("behind", pa.int64())]))] if spans else [])]
        names_ = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", *(["spans"] if spans else [])]
        return pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names=[*keep, *names_])

    if (items.agg(F.sum(F.length("body"))).first()[0] or 0) <= AUTOMATON_CHARS:
        lot = [(r.name, r.body) for r in items.collect()]
        digest = hashlib.sha256(repr(lot).encode("utf-8", "surrogatepass")).hexdigest()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                automaton, bodies = _built(lot, digest, window), batch.column(body_at).to_pylist()
                yield figures(batch, bodies, [automaton.scan(body) for body in bodies])

        return rows.mapInArrow(run, schema)

    scratch = Scratch(docs.sparkSession)
    numbered = durable(rows.withColumn("_row", F.monotonically_increasing_id()))
    hits = None
    for lot in _lots(items, AUTOMATON_CHARS):
        part = scratch.keep(_hits(numbered.select("_row", rows.columns[body_at]), lot, window))
        hits = part if hits is None else hits.union(part)
    each = durable(hits.groupBy("_row").agg(F.flatten(F.collect_list("runs")).alias("_runs"), F.flatten(F.collect_list("names")).alias("_names")))
    scratch.drop()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch.column(body_at).to_pylist()
            found = [
                (len(words_of(body)), merged([(x["first"], x["behind"]) for x in runs or []]), set(names or []))
                for body, runs, names in zip(bodies, batch.column(body_at + 1).to_pylist(), batch.column(body_at + 2).to_pylist(), strict=True)
            ]
            yield figures(batch, bodies, found)

    return numbered.join(each, "_row", "left").select(*[F.col(f"`{c}`") for c in rows.columns], "_runs", "_names").mapInArrow(join, schema)


def op9_benchmark_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With ``spans``, the places of the hit passages in the texts themselves."""
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), spans=True)
