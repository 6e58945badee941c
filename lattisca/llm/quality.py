"""Cross-document line frequency, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattisca.llm.common import ASCII_SPACE, join_split, table

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
#: A line of at least LINE_WORDS words is removed if more documents of its host have it than MAX_DOCS and than
#: MAX_PER_THOUSAND of the host's documents; a document with less than LEFT_PERCENT of its words left is rejected.
LINE_WORDS = 3
MAX_DOCS = 20
MAX_PER_THOUSAND = 2
LEFT_PERCENT = 30


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, ASCII_SPACE), "")


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, also where it is used inside another lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of ``window`` words found at least twice: sorted (hash, place) pairs show which windows
    have an equal neighbour, and the places of those, in order, how many words they cover together."""

    def windows(hashed: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(hashed) - (window - 1)), lambda i: F.xxhash64(F.slice(hashed, i, window)))

    def twice(p: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(p, j)["h"] == x["h"], F.lit(False))
        return F.transform(p, lambda x, j: F.when(same(x, j - 1) | same(x, j + 1), x["i"]))

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return _let(pairs, lambda p: _cover(F.array_sort(F.filter(twice(p), lambda x: x.isNotNull())), window))

    def counted(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < window, F.lit(0).cast("long")).otherwise(_let(hashes, lambda hs: _let(windows(hs), counted)))


def _cover(starts: Column, window: int) -> Column:
    return F.aggregate(
        starts,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-window).alias("last")),
        lambda a, s: F.struct((a["n"] + F.least(F.lit(window), s - a["last"])).cast("long").alias("n"), s.alias("last")),
        lambda a: a["n"],
    )


def normal_line(line: Column) -> Column:
    """Lower case, digits as 0, white space as single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"[\x20\x09-\x0D]+", " "), "[0-9]", "0"))


def _lines(text: Column, line_words: int) -> Column:
    """The hashes and words of the lines that are counted. Lines with fewer words are cut off before anything is replaced."""
    long = F.filter(F.split(text, "\n"), lambda l: F.length(l) >= 2 * line_words - 1)  # noqa: E741
    kept = F.transform(long, lambda l: normal_line(l))  # noqa: E741
    counted = F.transform(kept, lambda l: F.struct(F.xxhash64(l).alias("h"), (F.length(l) - F.length(F.replace(l, F.lit(" "), F.lit(""))) + 1).alias("n")))  # noqa: E741
    return F.filter(counted, lambda x: x["n"] >= line_words)


def line_quality(docs: DataFrame, host: str = "source", key: str = "doc_id", text: str = "text", line_words: int = LINE_WORDS, max_docs: int = MAX_DOCS, max_per_thousand: int = MAX_PER_THOUSAND, left_percent: int = LEFT_PERCENT) -> DataFrame:
    """Base figures of each text, the words in lines that too many documents of its host have, and the verdict.

    Null texts count as empty and fail; documents without a host are a host of their own; repeated rows are documents
    of their own and have a row each; an empty table gives no rows; clashing names don't matter, as only three columns
    are read.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"))
    sizes = rows.groupBy("host").agg(F.count(F.lit(1)).alias("docs"))
    counts = (
        rows.select("host", F.explode(F.array_distinct(F.transform(_lines(F.col("t"), line_words), lambda x: x["h"]))).alias("h"))
        .groupBy("host", "h")
        .agg(F.count(F.lit(1)).alias("have"))
        .where(F.col("have") > max_docs)
        .join(sizes, "host")
        .where(F.col("have") * 1000 > F.col("docs") * max_per_thousand)
        .select("host", "h")
    )
    cut = rows.select("doc_id", "host", "t", F.xxhash64("t").alias("th"), _words(F.col("t")).alias("words"), F.filter(F.split("t", "\n"), lambda l: F.regexp_like(l, F.lit(r"[^\x20\x09-\x0D]"))).alias("lines"))  # noqa: E741
    base = cut.select(
        "doc_id",
        "host",
        "th",
        F.struct(
            F.size("words").cast("long").alias("n_words"),
            F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
            (F.length("t") - F.length(F.regexp_replace("t", "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            repeat_words(F.col("words")).alias("n_repeat_words"),
        ).alias("m"),
        _lines(F.col("t"), line_words).alias("counted"),
    )
    # A text's figures go with its first entry; its other entries are lines alone.
    first = F.struct(F.col("m").alias("m"), F.xxhash64("doc_id", "th").alias("h"), F.lit(0).alias("n"))
    each = base.select("doc_id", "host", "th", F.explode(F.concat(F.array(first), F.transform("counted", lambda x: F.struct(F.lit(None).cast(base.schema["m"].dataType).alias("m"), x["h"].alias("h"), x["n"].alias("n"))))).alias("e"))
    each = each.select("doc_id", "host", "th", F.col("e.m").alias("m"), F.col("e.h").alias("h"), F.col("e.n").alias("n"))
    # A host's commonest line stands in most of its documents.
    met = join_split(each, counts.withColumn("often", F.lit(True)), ["host", "h"], "left")
    out = met.groupBy("doc_id", "host", "th").agg(
        F.max("m").alias("m"), F.count("m").alias("copies"), F.coalesce(F.sum(F.when(F.col("often"), F.col("n"))), F.lit(0)).alias("removed")
    )
    out = out.select("doc_id", "m.*", F.expr("cast(removed / copies as long)").alias("n_removed_words"), F.explode(F.expr("sequence(1, cast(copies as int))")).alias("_copy")).drop("_copy")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    left = 100 * (F.col("n_words") - F.col("n_removed_words")) >= left_percent * F.col("n_words")
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & left)


def cleaned_text(docs: DataFrame, host: str = "source", key: str = "doc_id", text: str = "text", line_words: int = LINE_WORDS, max_docs: int = MAX_DOCS, max_per_thousand: int = MAX_PER_THOUSAND) -> DataFrame:
    """Key, host and the text without the lines that too many documents of its host have (null texts stay null)."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("t"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"))
    sizes = rows.groupBy("host").agg(F.count(F.lit(1)).alias("docs"))
    hashes = F.array_distinct(F.transform(_lines(F.coalesce("t", F.lit("")), line_words), lambda x: x["h"]))
    often = rows.select("host", F.explode(hashes).alias("h")).groupBy("host", "h").agg(F.count(F.lit(1)).alias("have")).where(F.col("have") > max_docs)
    often = often.join(sizes, "host").where(F.col("have") * 1000 > F.col("docs") * max_per_thousand).select("host", "h")
    found = rows.select("doc_id", F.xxhash64("t").alias("th"), "host", F.explode(hashes).alias("h"))
    found = join_split(found, often, ["host", "h"]).groupBy("doc_id", "th", "host").agg(F.collect_set("h").alias("drop"))
    body = rows.withColumn("th", F.xxhash64("t")).join(found, ["doc_id", "th", "host"], "left")
    line = F.filter(F.split("t", "\n"), lambda l: ~F.coalesce(F.array_contains("drop", F.xxhash64(normal_line(l))), F.lit(False)))  # noqa: E741
    return body.select("doc_id", "host", F.array_join(line, "\n").alias("text"))


def op8_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_quality(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")


OP8_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
places AS (SELECT rid, ws, unnest(generate_series(1, len(ws) - {WINDOW - 1})) AS i FROM w WHERE len(ws) >= {WINDOW}),
wins AS (SELECT rid, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS k FROM places),
twice AS (SELECT rid, unnest(list(i)) AS i FROM wins GROUP BY rid, k HAVING count(*) > 1),
cover AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest(generate_series(i, i + {WINDOW - 1})) AS j FROM twice) GROUP BY rid),
l AS (SELECT rid, host, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
nl AS (SELECT rid, host, trim(regexp_replace(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]', '0', 'g'), ' ') AS line FROM l),
cl AS (SELECT *, len(line) - len(replace(line, ' ', '')) + 1 AS n FROM nl WHERE len(line) - len(replace(line, ' ', '')) + 1 >= {LINE_WORDS}),
sizes AS (SELECT host, count(*) AS docs FROM d GROUP BY host),
often AS (SELECT c.host, line FROM cl c JOIN sizes USING (host) GROUP BY c.host, line, docs
          HAVING count(DISTINCT rid) > {MAX_DOCS} AND count(DISTINCT rid) * 1000 > docs * {MAX_PER_THOUSAND}),
gone AS (SELECT rid, sum(n) AS n FROM cl SEMI JOIN often USING (host, line) GROUP BY rid),
m AS (SELECT w.rid, doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cover.n, 0) AS BIGINT) AS n_repeat_words,
             CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed_words
      FROM w LEFT JOIN dup USING (rid) LEFT JOIN cover USING (rid) LEFT JOIN gone USING (rid)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * (n_words - n_removed_words) >= {LEFT_PERCENT} * n_words AS kept, n_removed_words
FROM f
"""
