"""The pipeline on a small corpus with planted cases, against what must be left; and the queries' columns."""

import base64
import hashlib
import math
import random
import re
import struct
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from lattisca.llm import queries

SF = "/root/testdata/sf0.001"
LANGS = {"en": "the of and thing with ing tion shall have were upon".split(), "de": "der und nicht schön keit ung heit auch über wird sehr".split()}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """300 clean documents, and toxic ones, copies, near copies, contaminated ones and ones without a letter."""
    rng = random.Random(5)

    def clean(lang, n=60):
        return [rng.choice(LANGS[lang]) + rng.choice(["", "a", "en", "is"]) + str(rng.randrange(1000)) * (rng.random() < 0.3) for _ in range(n)]

    rows, labels, gone = [], [], set()
    for i in range(300):
        lang = rng.choice(["en", "de"])
        rows.append([i, " ".join(clean(lang)), lang])
        labels.append((i, 1, 0))
    items = [" ".join(clean("en", 14)) for _ in range(5)]
    i = 300
    for _ in range(150):
        w = clean("en")
        for k in rng.sample(range(60), 4):
            w[k] = rng.choice(["scumbag", "worthless", "idiotic"])
        rows.append([i, " ".join(w), "en"])
        labels.append((i, 1, 1))
        gone.add(i)
        i += 1
    for k in range(20):
        rows.append([i, rows[k][1], rows[k][2]])  # a copy
        near = rows[k + 20][1].split()
        near[30] = "changed"
        rows.append([i + 1, " ".join(near), rows[k + 20][2]])
        w = clean("en")
        rows.append([i + 2, " ".join([*w[:20], *items[k % 5].upper().split(), *w[20:]]), "en"])
        rows.append([i + 3, "12 34 " * (k + 1), "en"])
        gone |= {i, i + 1, i + 2, i + 3}
        i += 4
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(a, t, g, "s", len(t)) for a, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), {a: t for a, t, _ in rows}, gone


def test_pipeline_drops_what_is_planted_and_packs_the_rest(spark, corpus):
    d, texts, gone = corpus
    rows = corpus_pipeline.run(spark, d).collect()
    assert {r.doc_id for r in rows} == texts.keys() - gone
    k = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in rows:
        ids = np.array([*k.encode(texts[r.doc_id], add_special_tokens=False).ids, 0], "<u4")[r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(ids.tobytes()) and len(ids) == r.length


def test_stages_keep_the_columns_of_documents(spark, corpus):
    d, _, _ = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns and out.schema == docs.schema
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), d).count() == 0


def test_stages_on_odd_rows(spark, corpus):
    """Null ids and texts, empty ones, a long one, repeated rows and columns named like what operators add: what stays is whole."""
    from pyspark.sql import functions as F

    d, texts, _ = corpus
    names = ("score", "lang_pred", "predicted", "n_words", "n_hit", "contaminated", "spans", "_node", "_key", "_row", "kept", "component_id")
    docs = spark.read.parquet(f"{d}/documents.parquet").where("doc_id < 60 or doc_id between 300 and 310")
    extra = spark.createDataFrame([(9001, None), (9002, ""), (9003, "  "), (None, texts[5] + " and more"), (9005, "der und nicht " * 30_000), (3, texts[3])], "doc_id long, text string")
    rows = docs.unionByName(extra.withColumns({c: F.lit(None).cast(docs.schema[c].dataType) for c in docs.columns if c not in extra.columns}))
    rows = rows.withColumns({c: F.concat(F.lit(f"{c}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, d)
        assert out.columns == rows.columns, name
        got = out.collect()
        assert got and all(r[c] == f"{c}-{'none' if r.doc_id is None else r.doc_id}" for r in got for c in names), name
        if name == "near_duplicates":
            ids = lambda some: ["none" if r.doc_id is None else r.doc_id for r in some]
            assert sorted(ids(got), key=str) == sorted(set(ids(rows.collect())), key=str)
        elif name != "language":
            assert {9001, 9002, 9003, 9005, None} <= {r.doc_id for r in got} and sum(r.doc_id == 3 for r in got) == 2
    pieces = corpus_pipeline.pack_sequences(spark, rows, d).collect()
    assert sum(r.piece == 0 for r in pieces) == rows.count()


COLUMNS = {
    "op1": "doc_id size text_crc32 law shard slot grown_shard",
    "op2": "doc_id start n_tokens ids_crc32",
    "op3": "doc_id held_out lang_pred score",
    "op4": "doc_id n_shingles component_id kept",
    "op5": "page_id payload_bytes payload_digest record_type refers_to",
    "op6": "page_id url text n_chars",
    "op7": "doc_id held_out score predicted",
    "op8": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op9": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op10": "doc_id piece start length ids_crc32 sequence_id offset",
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_returns_its_columns_for_every_row(spark, name):
    out = queries.queries()[name](spark, SF)
    want = COLUMNS[name.split("_")[0]].split()
    assert set(want) <= set(out.columns)
    rows = out.select(want[0]).collect()
    source = "pages" if want[0] == "page_id" else "documents"
    ids = {r[0] for r in spark.read.parquet(f"{SF}/{source}.parquet").select(want[0]).collect()}
    assert {r[0] for r in rows} == ids and (len(rows) == len(ids) or name.startswith("op10"))


def test_quality_query_equals_its_sql(spark):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = db.sql(queries.oracle_sql()["op8_line_frequency"]).df()
    got = queries.queries()["op8_line_frequency"](spark, SF).toPandas()[list(want.columns)]
    assert got.sort_values("doc_id").astype(object).values.tolist() == want.sort_values("doc_id").astype(object).values.tolist()


def test_sharding_of_whole_table_matches_plain_python(spark):
    got = {r.doc_id: r for r in queries.queries()["op1_hash_tree_shards"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        data = (r.text or "").encode()
        assert (got[r.doc_id].size, got[r.doc_id].text_crc32) == (len(data) + 8, zlib.crc32(data))


# --- the queries' whole results


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_shards_of_whole_table_match_plain_python(spark, documents):
    """Draws by the hash of the id and of each path, level by level."""
    from lattisca.llm import sharding

    def unit(key, salt):
        h = xxhash.xxh64_intdigest(struct.pack("<q", salt), seed=xxhash.xxh64_intdigest(struct.pack("<q", key), seed=42))
        return ((h >> 11) + 0.5) / 2**53

    def shard(key, node, path=""):
        if not node.children:
            return node.shard
        child = min(node.children, key=lambda c: -math.log(unit(key, sharding._salt(f"{path}/{c.label}"))) / c.weight)
        return shard(key, child, f"{path}/{child.label}")

    rows = queries.queries()["op1_hash_tree_shards"](spark, SF).collect()
    assert all((r.shard, r.grown_shard) == (shard(r.doc_id, sharding.tree(24)), shard(r.doc_id, sharding.tree(25))) for r in rows)
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_tokens_of_whole_table(spark, documents):
    k = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start, want = 0, []
    for i in sorted(documents):
        ids = [*k.encode(documents[i] or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = queries.queries()["op2_elias_fano_tokens"](spark, SF).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == want


def test_languages_of_whole_table_by_plain_sums(spark, documents):
    """Margins summed trigram by trigram; the family with the largest, then the most wins inside."""
    from lattisca.llm import language

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit_language_model(docs)
    got = {r.doc_id: r for r in queries.queries()["op3_language"](spark, SF).collect()}
    checked = 0
    for i, text in list(documents.items())[::3]:
        if not text or not any(c.isalpha() for c in text):
            assert got[i].lang_pred == "und" and got[i].score == 0
            continue
        words = "".join(c.lower() if c.isalpha() else c if ord(c) > 127 else " " for c in text).split()
        data = (" " + " ".join(words) + " ").encode()
        sums, n = [0.0] * len(model.machines), 0
        for j in range(len(data) - 2):
            slot = (int.from_bytes(data[j : j + 3], "big") * 2654435761 & 0xFFFFFFFF) >> (32 - language.BITS)
            for m, w in enumerate(model.weights[slot]):
                sums[m] += float(w)
            n += 1
        margin = {name: s / n + float(b) for name, s, b in zip(model.machines, sums, model.biases, strict=True)}
        family = max(model.families, key=lambda f: margin["family", f])
        some = model.families[family]
        wins = {x: sum((margin[a, b] >= 0) == (x == a) for a, b in margin if a != "family" and x in (a, b)) for x in some}
        assert wins[got[i].lang_pred] == max(wins.values()), i
        checked += 1
    assert checked > 30


def test_near_duplicates_of_whole_table(spark, documents):
    from tests.llm.test_training_operators import brute_components

    want = brute_components([(i, t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) if t else t) for i, t in documents.items()], 2, 80)
    got = {r.doc_id: r for r in queries.queries()["op4_lsh_forest"](spark, SF).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want and all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_archives_of_whole_table(spark):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    first = {}
    for i in sorted(pages):
        first.setdefault(pages[i], i)
    got = queries.queries()["op5_warc"](spark, SF).collect()
    want = [(i, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "response" if first[h] == i else "revisit", None if first[h] == i else first[h]) for i, h in pages.items()]
    assert sorted(map(tuple, got)) == sorted(want)


def test_toxic_hits_of_whole_table(spark, documents):
    """Every tenth distinct word against every term by edit distance; the scores then follow from the hits."""
    from lattisca.llm import toxicity
    from tests.llm.test_training_operators import levenshtein

    sf = SF.replace("0.001", "0.01")  # the smaller one has too few labels to learn from
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    documents = {r.doc_id: r.text for r in docs.collect()}
    model = toxicity.fit_toxicity_model(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert model.terms or model.stems
    seen = sorted({w for t in documents.values() for w in toxicity._WORD.findall((t or "").lower())})
    hits = 0
    for w in seen[::10] + model.terms:
        if any(w.startswith(s) for s in model.stems):
            want = 1
        elif w in model.terms:
            want = 0
        else:
            near = [t for t in model.terms if abs(len(t) - len(w)) <= toxicity.edits_for(t)]
            want = 2 if w not in model.known and any(levenshtein(w, t) <= toxicity.edits_for(t) for t in near) else None
        got = model.verdict(w)
        assert got == want or {got, want} == {0, 1}, w
        hits += got is not None
    assert hits
    rows = queries.queries()["op7_toxicity"](spark, sf).collect()
    assert all(r.score == model.score(documents[r.doc_id]) and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_contamination_of_whole_table(spark, documents):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows, lengths = {}, set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        q = split(r.text)
        for i in range(max(1, len(q) - 9) if q else 0):
            windows.setdefault(tuple(q[i : i + 10]), set()).add(str(r.item_id))
            lengths.add(len(q[i : i + 10]))
    got = {r.doc_id: r for r in queries.queries()["op9_benchmark_contamination"](spark, SF).collect()}
    for i, text in documents.items():
        w, hit, names = split(text), set(), set()
        for n in lengths:
            for j in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[j : j + n]))) is not None:
                    hit |= set(range(j, j + n))
                    names |= found
        want = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit))
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256, got[i].contaminated) == want
        places = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        inside = {j for x in got[i].spans or [] for j, (a, b) in enumerate(places) if x.first <= a and b <= x.behind}
        assert inside == hit
    assert any(r.contaminated for r in got.values())


def test_packing_of_whole_table(spark, documents):
    k = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = set()
    for i, text in documents.items():
        ids = np.array([*k.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want |= {(i, n, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for n, at in enumerate(range(0, len(ids), 2048))}
    rows = queries.queries()["op10_pattern_packing"](spark, SF).collect()
    assert len(rows) == len(want) and {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want
    here = {}
    for r in rows:
        here.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in here.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:j]) for j in range(len(parts))] and sum(n for _, n in parts) <= 2048
    assert len(here) <= 1.02 * -(-sum(r.length for r in rows) // 2048) + 1


def test_ties():
    """Equal margins go to the last name; a score of one half counts as toxic."""
    from lattisca.llm import language, toxicity

    model = language.LanguageModel({"germanic": ["de", "en"]}, [("de", "en")], np.zeros((1 << language.BITS, 1), np.float32), np.zeros(1, np.float32))
    assert model.predict("ein") == model.predict("one two") == ("en", 0.5)
    assert toxicity.ToxicityModel([], [], frozenset(), np.zeros(5)).score("any") == 0.5
