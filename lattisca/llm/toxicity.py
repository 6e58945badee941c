"""Toxicity: Levenshtein automata over a lexicon trie find terms and their misspellings; the words around a hit tell
quotation from abuse; a logistic model turns the hits' scores into a probability."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattisca.llm.common import hash_unit, hold, smallest_hashes, table, with_text

#: The most labelled texts of one label that are learned from: those with the smallest hash of their id.
PER_LABEL = 2000
#: Words on either side of a hit that its score looks at.
CONTEXT = 6
#: Distinct words whose verdict a worker keeps; beyond, it starts anew. Speed only.
KEPT_WORDS = 300_000
#: States of an automaton that a worker keeps; beyond, it starts anew. Speed only.
KEPT_STATES = 200_000
#: A term's or stem's share among toxic texts must be so many times that among others.
MIN_RATIO = 15.0

# Marks that open or close quoted speech, and verbs that report it.
QUOTES = "\"“”„«»‹›‘’"
REPORTING = frozenset("said says say wrote writes called calls quote quoted reported reports sagte schrieb nannte zitat zitierte dit écrit appelé citation selon dijo escribió llamó cita según".split())

_WORD = re.compile(r"[^\W_]+")


def edits_for(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class LexiconAutomaton:
    """The trie of terms, walked by a Levenshtein automaton; their product is made deterministic as words need it.

    A state is the set of (trie node, edits so far) that a prefix of the word can reach. ``match`` gives None, or the
    kind of the best entry that the word meets: 0 a term itself, 1 a word that begins with a stem, 2 a misspelled term.
    """

    def __init__(self, terms: list[str], stems: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.end: list[int] = [-1]  # of a term: the edits allowed
        self.stem: list[bool] = [False]
        self.room: list[int] = [0]  # the most edits that a term below allows
        for term in terms:
            at = self._insert(term, edits_for(term))
            self.end[at] = edits_for(term)
        for term in stems:
            self.stem[self._insert(term, 0)] = True
        self._begin()

    def _begin(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.verdicts: list[int | None] = []
        self.dead = self._state({})
        self.start = self._state({0: 0})

    def _insert(self, term: str, edits: int) -> int:
        at = 0
        self.room[0] = max(self.room[0], edits)
        for c in term:
            if c not in self.children[at]:
                self.children[at][c] = len(self.children)
                self.children.append({})
                self.end.append(-1)
                self.stem.append(False)
                self.room.append(0)
            at = self.children[at][c]
            self.room[at] = max(self.room[at], edits)
        return at

    def _state(self, reached: dict[int, int]) -> int:
        todo = list(reached)
        while todo:  # letters of the term that the word leaves out
            node = todo.pop()
            if reached[node] < self.room[node]:
                for child in self.children[node].values():
                    e = reached[node] + 1
                    if e <= self.room[child] and e < reached.get(child, 99):
                        reached[child] = e
                        todo.append(child)
        key = frozenset(reached.items())
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
            ends = [e for n, e in key if 0 <= e <= self.end[n]]
            self.verdicts.append(1 if any(self.stem[n] and e == 0 for n, e in key) else None if not ends else 0 if min(ends) == 0 else 2)
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        out: dict[int, int] = {}

        def reach(node: int, e: int) -> None:
            if e <= self.room[node] and e < out.get(node, 99):
                out[node] = e

        for node, e in self.states[state]:
            if c in self.children[node]:
                reach(self.children[node][c], e)
            if e < self.room[node]:
                reach(node, e + 1)
                for child in self.children[node].values():
                    reach(child, e + 1)
        self.steps[state][c] = found = self._state(out)
        return found

    def match(self, word: str) -> int | None:
        if len(self.states) > KEPT_STATES:
            self._begin()
        state, steps, dead = self.start, self.steps, self.dead
        for c in word:
            after = steps[state].get(c)
            state = self._step(state, c) if after is None else after
            if state == dead:
                return None
            if self.verdicts[state] == 1:
                return 1
        return self.verdicts[state]


def independent(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """The rows without near copies of earlier ones, whose words would count as often as they come: of a text's eight
    smallest shingle hashes, two were seen before."""
    seen: set[int] = set()
    out = []
    for text, label in rows:
        words = _WORD.findall(text.lower())
        least = sorted({zlib.crc32(" ".join(words[i : i + 3]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(words) - 2))})[:8]
        if sum(h in seen for h in least) < min(2, len(least)):
            out.append((text, label))
        seen.update(least)
    return out


def learn_lexicon(texts: list[str], labels: list[int]) -> tuple[list[str], list[str]]:
    """Terms: words much commoner among toxic texts. Stems: beginnings that are so though no single word is, as long as
    they can be without losing texts."""
    counts = (Counter(), Counter())
    sizes = [0, 0]
    rows = independent(list(zip(texts, labels, strict=True)))
    for text, label in rows:
        words = set(_WORD.findall(text.lower()))
        sizes[label] += 1
        counts[label].update(words)
    share = sizes[1] / max(1, sum(sizes))

    def good(toxic: int, clean: int, tried: int) -> bool:
        """Much commoner among toxic texts, and by more than the luckiest of ``tried`` words would be by chance."""
        if toxic < 3 or clean * 100 > toxic or not 0 < share < 1:
            return False
        ratio = ((toxic + 0.5) / (sizes[1] + 1)) / ((clean + 0.5) / (sizes[0] + 1))
        luck = math.lgamma(toxic + clean + 1) - math.lgamma(toxic + 1) - math.lgamma(clean + 1) + toxic * math.log(share)
        return ratio >= MIN_RATIO and luck + math.log(20 * max(1, tried)) < 0

    tried = sum(n > 1 for n in counts[1].values())
    terms = sorted(w for w, t in counts[1].items() if len(w) >= 3 and good(t, counts[0][w], tried))
    # Texts by beginning, for words that are in toxic texts at all.
    begun = (Counter(), Counter())
    variety: dict[str, int] = Counter()
    largest: dict[str, int] = Counter()
    for w, t in counts[1].items():
        for k in range(3, min(len(w), 9)):
            variety[w[:k]] += 1
            largest[w[:k]] = max(largest[w[:k]], t)
    varied = {p for p, n in variety.items() if n >= 5}
    for text, label in rows:
        begun[label].update({w[:k] for w in set(_WORD.findall(text.lower())) for k in range(3, min(len(w), 9)) if w[:k] in varied})
    stems: list[str] = []
    for p in sorted((p for p in varied if 2 * largest[p] <= begun[1][p] and good(begun[1][p], begun[0][p], len(varied))), key=lambda p: (len(p), p)):
        if any(p.startswith(s) for s in stems):
            continue
        while longer := [q for q in varied if len(q) == len(p) + 1 and q.startswith(p) and begun[1][q] >= 0.95 * begun[1][p]]:
            p = max(longer, key=lambda q: (begun[1][q], q))
        if len(p) >= 4 and not any(p.startswith(s) for s in stems):
            stems.append(p)
    return terms, stems


@dataclass
class ToxicityModel:
    terms: list[str]
    stems: list[str]
    known: frozenset[str]  # words of clean texts that a misspelling could be, but isn't
    weights: np.ndarray = field(default_factory=lambda: np.array(PRIOR))

    def __post_init__(self) -> None:
        self.automaton = LexiconAutomaton(self.terms, self.stems)
        self.kept: dict[str, int | None] = {}

    def __reduce__(self):
        return ToxicityModel, (self.terms, self.stems, self.known, self.weights)

    def verdict(self, word: str) -> int | None:
        found = self.automaton.match(word)
        return None if found == 2 and word in self.known else found

    def hits(self, text: str) -> list[tuple[int, int, int, float]]:
        """First and last place, kind and context score of each hit: 1 for abuse, less if quoted, more beside other hits."""
        words = _WORD.findall(text.lower())
        kept = self.kept
        if len(kept) > KEPT_WORDS:
            kept.clear()
        kinds = []
        for w in words:
            try:
                kinds.append(kept[w])
            except KeyError:
                kept[w] = v = self.verdict(w)
                kinds.append(v)
        at = [i for i, k in enumerate(kinds) if k is not None]
        if not at:
            return []
        places = [m.span() for m in _WORD.finditer(text.lower())]
        out = []
        for i in at:
            near = range(max(0, i - CONTEXT), min(len(words), i + CONTEXT + 1))
            before, after = text[places[near[0]][0] : places[i][0]], text[places[i][1] : places[near[-1]][1] + 2]
            quoted = any(q in before for q in QUOTES) and any(q in after for q in QUOTES)
            reported = any(words[k] in REPORTING for k in near)
            others = sum(kinds[k] is not None for k in near) - 1
            out.append((*places[i], kinds[i], (0.25 if quoted else 1.0) * (0.6 if reported else 1.0) * (1 + 0.25 * min(others, 4))))
        return out

    def features(self, text: str | None) -> np.ndarray:
        hits = self.hits(text) if text else []
        sure = sum(s for _, _, k, s in hits if k != 2)
        near = sum(s for _, _, k, s in hits if k == 2)
        words = 1 + (text or "").count(" ") if hits else 1
        return np.array([1.0, math.log1p(sure), math.log1p(near), 20 * sure / (words + 20), 20 * near / (words + 20)])

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(self.features(text) @ self.weights)))))

    @classmethod
    def fit(cls, texts: list[str], labels: list[int]) -> ToxicityModel:
        terms, stems = learn_lexicon(texts, labels)
        automaton = LexiconAutomaton(terms, stems)

        def lookalikes(some: list[tuple[str, int]]) -> frozenset[str]:
            return frozenset(w for t, y in some if not y for w in set(_WORD.findall(t.lower())) if automaton.match(w) == 2)

        rows = list(zip(texts, labels, strict=True))
        if not rows:
            return cls(terms, stems, frozenset())
        # What near hits are worth is learned on texts whose own words aren't known as lookalikes.
        half = cls(terms, stems, lookalikes(rows[::2]))
        weights = _logistic(np.stack([half.features(t) for t, _ in rows[1::2] or rows]), np.array([y for _, y in rows[1::2] or rows], float))
        return cls(terms, stems, lookalikes(rows), weights)


#: Weights where nothing was learned: one, sure hits, near hits, and both by length.
PRIOR = (-2.5, 2.5, 1.2, 1.0, 0.5)


def _logistic(x: np.ndarray, y: np.ndarray, strength: float = 1.0) -> np.ndarray:
    """Newton steps for logistic loss (each label half of the weight) and a pull to PRIOR."""
    prior = np.array(PRIOR)
    w = prior.copy()
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum())) * len(y)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (share * (p - y)) + strength * (w - prior)
        h = (x * (share * p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit_toxicity_model(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, key: str = "doc_id", text: str = "text", label: str = "toxic") -> ToxicityModel:
    """Learns from at most ``per_label`` texts of each label, none of them held out: those with the smallest hash of their id, chosen before texts are read."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(F.col(key))).groupBy(F.col(key).alias("_k")).agg(F.max(label).alias("y"))
    ids = known.where(smallest_hashes(known, "_k", "y", per_label)).select("_k", "y")
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("_k"), F.col(text).alias("t")).join(F.broadcast(ids), "_k")  # about 3 * per_label ids
    some = rows.select("t", "y", hash_unit(F.col("_k")).alias("h")).collect()
    taken = [0, 0]
    texts, labels_ = [], []
    for r in sorted(some, key=lambda r: (r.h, r.t)):
        taken[r.y] += 1
        if taken[r.y] <= per_label:
            texts.append(r.t)
            labels_.append(int(r.y))
    return ToxicityModel.fit(texts, labels_)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 from 0.5) to the columns ``keep`` (all) of ``docs``; own columns of those names go.

    Only the text counts. Null and empty texts have no hits and the score of a text without; repeated rows get equal
    scores; an empty table gives none; without labels the prior weights hold and nothing is a term.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    rows, kept = with_text(docs, text, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("toxicity", lambda: None)
        for batch in batches:
            scores = [model.score(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=[*keep, "score", "predicted"])

    schema = kept.add("score", "double").add("predicted", "integer")
    return rows.mapInArrow(run, schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity_model(docs, table(spark, sf_dir, "labels"))
    out = score_toxicity(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), model, keep=["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "score", "predicted")
