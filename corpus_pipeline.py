"""The corpus pipeline: language, toxicity, near-duplicates, benchmark contamination, packing.

Every stage takes (spark, docs, sf_dir), works on all that the one before kept, and, but for the last, returns the columns of
the documents table. ``run`` writes each stage's result as Parquet and reads it again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattisca.llm.common import remove, shared_path, table
from lattisca.llm.contamination import find_contamination
from lattisca.llm.language import MIN_SCORE, fit_language_model, identify_language
from lattisca.llm.near_dup import deduplicate
from lattisca.llm.packing import pack
from lattisca.llm.toxicity import fit_toxicity_model, score_toxicity

#: Words of a shingle and percent of common shingles from which two documents are near copies.
SHINGLE_WORDS = 5
SIMILAR_PERCENT = 80
ORACLE_SQL = None


def _apart(docs: DataFrame, stage: Callable[[DataFrame], DataFrame], names: tuple[str, ...]) -> DataFrame:
    """``stage`` of ``docs``, whose own columns of these names are set aside meanwhile."""
    aside = {c: f"_own_{c}" for c in docs.columns if c in names}
    return stage(docs.withColumnsRenamed(aside)).select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without text or without a letter, or in no language that was learned, go; all others stay as they are, repeated
    rows as often as they come. An empty table stays empty, and where nothing can be learned all go."""
    model = fit_language_model(docs)
    known = (F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE)
    return _apart(docs, lambda rows: identify_language(rows, model).where(known), ("lang_pred", "score"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted to be toxic go. Those without text or words have no hits and stay, as all do where nothing
    was learned; repeated rows are judged each; an empty table stays empty."""
    model = fit_toxicity_model(docs, table(spark, sf_dir, "labels"))
    return _apart(docs, lambda rows: score_toxicity(rows, model).where("predicted = 0"), ("score", "predicted"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays, once if its row is repeated; documents without
    id, text or words stay, and so do other texts under a repeated id. An empty table stays empty."""
    return _apart(docs, lambda rows: deduplicate(rows, words=SHINGLE_WORDS, percent=SIMILAR_PERCENT), ("_node", "_key", "_th", "_row", "_split"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go. Those without text or words stay; repeated rows are judged each; an
    empty table stays empty, and an empty benchmark takes nothing."""
    benchmark = table(spark, sf_dir, "benchmark")
    clean = lambda rows: find_contamination(rows, benchmark, keep=rows.columns).where(~F.col("contaminated"))
    return _apart(docs, clean, ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", "_row", "_runs", "_names"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids and their places in sequences. A document without text is its end id; repeated rows are
    packed as often as they come; an empty table gives no pieces; other columns are not read."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", keep_known_languages),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage has written goes when the next one's result is whole; the last one's stays, as the
    result reads it."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        remove(spark, before)
        before = [path]
    return docs
