"""Language of a text: the family first, then one-versus-one linear support vector machines inside the family.

All machines are linear in the frequencies of hashed byte trigrams, so a text's margins are means of table rows: one gather
for each text, whatever the number of machines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattisca.llm.common import hash_unit, hold, smallest_hashes, table, with_text

#: The most labelled texts of one language that the machines are fitted on: those with the smallest hash of their id.
PER_LANGUAGE = 400
BITS = 13
#: Rows or columns of the table of texts that are worked on at once: the driver holds that table and no copy of it.
BLOCK = 128
#: Below this score a document's language is not taken as known.
MIN_SCORE = 0.2

# Languages by family (ISO 639-1 codes). Others are families of their own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
}

_LETTER = re.compile(r"[^\W\d_]")
#: ASCII letters in lower case, other ASCII a space, other bytes as they are.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def family_of(language: str) -> str:
    return next((f for f, some in FAMILIES.items() if language in some), language)


def grams(text: str) -> np.ndarray:
    """Hashes of the byte trigrams that are not white space alone."""
    a = np.frombuffer(b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_NORMAL).split()) + b" ", np.uint8).astype(np.uint32)
    if len(a) < 3:
        return np.zeros(0, np.uint32)
    code = (a[:-2] << np.uint32(16)) | (a[1:-1] << np.uint32(8)) | a[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def squares(x: np.ndarray, scale: np.ndarray | float = 1.0) -> np.ndarray:
    """The sum of squares of each row times ``scale``."""
    return np.concatenate([((x[i : i + BLOCK] * scale) ** 2).sum(1) for i in range(0, len(x), BLOCK)])


def svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, epochs: int = 25, rows: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, by dual coordinate descent; the bias is the weight of a constant. ``y`` belongs
    to the ``rows`` (all) of ``x``, of which no copy is made."""
    n = len(y)
    rows = np.arange(n) if rows is None else rows
    rng = np.random.default_rng(0)
    w, bias, alpha = np.zeros(x.shape[1], x.dtype), 0.0, np.zeros(n)
    q = squares(x)[rows] + 1.0 + 0.5 / c
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(n):
            row = x[rows[i]]
            g = y[i] * (float(row @ w) + bias) - 1 + alpha[i] * 0.5 / c
            new = max(0.0, alpha[i] - g / q[i])
            step = (new - alpha[i]) * y[i]
            if step:
                most = max(most, abs(step))
                w += step * row
                bias += step
                alpha[i] = new
        if most < 1e-3:
            break
    return w, bias


@dataclass
class LanguageModel:
    """Families and their languages; the weights of all machines side by side, with their biases."""

    families: dict[str, list[str]] = field(default_factory=dict)
    machines: list[tuple[str, str]] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS, 0), np.float32))
    biases: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))

    @classmethod
    def fit(cls, texts: list[str], languages: list[str]) -> LanguageModel:
        """Machines ("family", f) tell f from the rest; (a, b) tell language a (positive) from b of the same family."""
        x, kept = np.zeros((len(texts), 1 << BITS), np.float32), []
        for text, language in zip(texts, languages, strict=True):
            g = grams(text)
            if len(g):
                x[len(kept)] = np.bincount(g, minlength=1 << BITS).astype(np.float32) / len(g)
                kept.append(language)
        model = cls()
        for language in sorted(set(kept)):
            model.families.setdefault(family_of(language), []).append(language)
        if not kept:
            return model
        x, names = x[: len(kept)], np.array(kept)
        scale = 1.0 / (np.concatenate([x[:, i : i + BLOCK].std(0) for i in range(0, x.shape[1], BLOCK)]) + 1e-4)
        scale /= np.sqrt(squares(x, scale).mean())
        x *= scale
        families = np.array([family_of(k) for k in kept])
        columns, biases = [], []
        for f in model.families if len(model.families) > 1 else ():
            w, b = svm(x, np.where(families == f, 1.0, -1.0))
            model.machines.append(("family", f))
            columns.append(w * scale)
            biases.append(b)
        for some in model.families.values():
            for one, two in combinations(some, 2):
                at = np.flatnonzero((names == one) | (names == two))
                w, b = svm(x, np.where(names[at] == one, 1.0, -1.0), rows=at)
                model.machines.append((one, two))
                columns.append(w * scale)
                biases.append(b)
        if columns:
            model.weights, model.biases = np.stack(columns, 1).astype(np.float32), np.array(biases, np.float32)
        return model

    def predict(self, text: str | None) -> tuple[str, float]:
        """A language and a score from 0 to 1; ``und`` and 0 for a text without letters, or where nothing was learned."""
        if not text or not self.families or not _LETTER.search(text):
            return "und", 0.0
        g = grams(text)
        if not len(g):
            return "und", 0.0
        margins = self.weights[g].mean(0, dtype=np.float64) + self.biases if self.machines else np.zeros(0)
        sure = 1 / (1 + np.exp(-4 * np.clip(margins, -30, 30)))
        of = {m: float(p) for m, p in zip(self.machines, sure, strict=True)}
        family = max(self.families, key=lambda f: (of.get(("family", f), 1.0), f))
        score = of.get(("family", family), 1.0)
        some = self.families[family]
        if len(some) > 1:
            wins = {k: [] for k in some}
            for one, two in combinations(some, 2):
                wins[one].append(of[one, two])
                wins[two].append(1 - of[one, two])
            best = max(some, key=lambda k: (sum(p >= 0.5 for p in wins[k]), sum(wins[k]), k))
            return best, min(1.0, max(0.0, score * float(np.mean(wins[best]))))
        return some[0], min(1.0, max(0.0, score))


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit_language_model(docs: DataFrame, per_language: int = PER_LANGUAGE, key: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel:
    """Fits on at most ``per_language`` texts of each language, none of them held out: those with the smallest hash of their id."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key))).select(F.col(key).alias("_k"), F.col(text).alias("t"), F.col(lang).alias("l"))
    some = known.where(smallest_hashes(known, "_k", "l", per_language)).select("t", "l", hash_unit(F.col("_k")).alias("h")).collect()
    taken: dict[str, int] = {}
    texts, languages = [], []
    for r in sorted(some, key=lambda r: (r.h, r.t)):
        taken[r.l] = taken.get(r.l, 0) + 1
        if taken[r.l] <= per_language:
            texts.append(r.t)
            languages.append(r.l)
    return LanguageModel.fit(texts, languages)


def identify_language(docs: DataFrame, model: LanguageModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds lang_pred and score to the columns ``keep`` (all) of ``docs``; own columns of those names are replaced.

    The prediction reads the text alone. Null texts and texts without a letter are ``und`` with score 0; each row gets
    its own answer, repeated or not; an empty table gives none; with nothing to learn from, all is ``und``.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    rows, kept = with_text(docs, text, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("language", lambda: None)
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array([k for k, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=[*keep, "lang_pred", "score"])

    schema = kept.add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(run, schema)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify_language(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), fit_language_model(docs), keep=["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", "score")
