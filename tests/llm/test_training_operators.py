"""Each operator against brute force, a round trip or held-out accuracy, and on odd rows."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from lattisca.llm import contamination, html_text, language, near_dup, packing, quality, sharding, token_files, tokens, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, score string"
ODD = ["", "   ", "\n\n", "a", "Ünïcödé ß é́ 日本語 \U0001f600", "tab\tand  two spaces\r\n", "<|endoftext|> x", "x" * 50_000, "123 456", "…!?"]


def frame(spark, texts, first=0, **more):
    rows = [(first + i, t, more.get("lang", "en"), more.get("source", "src"), None, "own", "own") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and texts, repeated rows and columns with clashing names."""
    return frame(spark, [*ODD, None]).union(frame(spark, ["a", ""], 3)).union(spark.createDataFrame([(None, "null id here", None, None, None, None, None)], DOCS))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# --- 1


def test_shards_law_and_slots(spark, odd, none):
    rows = sharding.shard_documents(frame(spark, [f"t{i}" for i in range(2000)])).collect()
    assert {r.shard for r in rows} == set(range(24))
    assert all(r.grown_shard in (r.shard, 24) for r in rows)
    assert 20 < sum(r.grown_shard == 24 for r in rows) < 160
    for s in range(24):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    found = sharding.shard_documents(odd).collect()
    assert len(found) == odd.count() and all(r.size == 8 and r.text_crc32 == 0 for r in found if r.doc_id == len(ODD))
    assert {(r.size - 8, r.text_crc32) for r in found if r.doc_id == 4} >= {(len(ODD[4].encode()), zlib.crc32(ODD[4].encode()))}
    assert sharding.shard_documents(none).count() == 0


def test_changed_weight_moves_rows_within_its_subtree(spark):
    def leaf(i, w=1.0):
        return sharding.Node(f"s{i}", shard=i, own_weight=w)

    def build(w):
        return sharding.Node("root", tuple(sharding.Node(f"r{r}", (sharding.Node("k0", (leaf(4 * r, w if r == 0 else 1.0), leaf(4 * r + 1))), sharding.Node("k1", (leaf(4 * r + 2), leaf(4 * r + 3))))) for r in range(2)))

    from pyspark.sql import functions as F

    ids = spark.range(4000)
    rows = ids.select(sharding.descend(F.col("id"), build(1.0)).alias("a"), sharding.descend(F.col("id"), build(3.0)).alias("b")).collect()
    moved = [(r.a, r.b) for r in rows if r.a != r.b]
    assert moved and all(b < 4 for _, b in moved)  # only into the region whose weight rose
    inner = [(a, b) for a, b in moved if a < 4]
    assert all(b in (0, 1) for _, b in inner)  # and there only into its rack


# --- 2


def test_elias_fano_selects_every_value():
    rng = random.Random(1)
    for n in (0, 1, 5, 700):
        values = np.cumsum([rng.choice([1, 1, 3, 5000]) for _ in range(n)]) if n else np.zeros(0, int)
        ef = token_files.EliasFano.of(values)
        assert [ef.select(i) for i in range(n)] == values.tolist() == ef.select_run(0, n).tolist()
        for first, behind in ((0, 0), (n // 3, n), (n // 2, min(n, n // 2 + 3)), (min(n, 255), min(n, 257)), (min(n, 256), min(n, 600))):
            assert ef.select_run(first, behind).tolist() == values[first:behind].tolist()
        if n == 700:
            assert len(ef.low) + len(ef.high) < 8 * n / 2


def test_token_files_round_trip(spark, odd, none, tmp_path):
    k = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    path = f"file://{tmp_path}/t"
    token_files.write_token_files(odd, path, k_path := public_tokenizers.path("byte_bpe_50k.json"), end_id=2, partitions=3)
    got = token_files.read_token_files(spark, path, ids=True).orderBy("start").collect()
    assert len(got) == odd.count() and got[0].doc_id is None and got[0].start == 0
    keys = [r.doc_id for r in got[1:]]
    assert keys == sorted(keys)
    at = 0
    texts = {}
    for r in odd.collect():
        texts.setdefault(r.doc_id, set()).add(tuple([*k.encode(r.text or "", add_special_tokens=False).ids, 2]))
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and tuple(r.ids) in texts[r.doc_id]
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    token_files.write_token_files(none, f"file://{tmp_path}/e", k_path, end_id=2)
    assert token_files.read_token_files(spark, f"file://{tmp_path}/e").count() == 0


def test_token_file_runs_and_widths(spark, tmp_path, monkeypatch):
    """Runs end at so many documents or ids; single documents come by two selects; ids that don't fit are an error."""
    rng = random.Random(21)
    path, k = public_tokenizers.path("byte_bpe_50k.json"), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [words(rng, rng.choice([0, 1, 5, 400])) for _ in range(700)]
    token_files.write_token_files(frame(spark, texts), f"file://{tmp_path}/t", path, end_id=2, partitions=1)
    want = [[*k.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    name = next(p.name for p in tmp_path.glob("t/*.tok"))
    file = token_files.TokenFile(f"{tmp_path}/t/{name}")
    assert [file.document(i).tolist() for i in (0, 1, 255, 256, 699)] == [want[i] for i in (0, 1, 255, 256, 699)]
    cuts = [(first, c.tolist()) for first, c in file.runs(100, 500)]
    assert sum(len(c) - 1 for _, c in cuts) == 700 and all(len(c) <= 101 and (len(c) == 2 or c[-1] - c[0] <= 500) for _, c in cuts)
    ends = np.cumsum([len(w) for w in want]).tolist()
    assert [x for _, c in cuts for x in c[1:]] == ends
    assert token_files.id_width(path, 2) == 2 and token_files.id_width(path, 70_000) == 4
    monkeypatch.setattr(token_files, "encoder", lambda *_: type("E", (), {"encode_all": staticmethod(lambda texts: [np.array([70_000], "<u4").tobytes() for _ in texts])}))
    writer = token_files.TokenFileWriter({"path": f"{tmp_path}/w", "tokenizer": path, "end_id": "2", "width": "2"})
    import pyarrow as pa
    import pyspark

    monkeypatch.setattr(pyspark.TaskContext, "get", classmethod(lambda _: type("C", (), {"partitionId": staticmethod(lambda: 0)})))
    with pytest.raises(ValueError, match="does not fit"):
        writer.write(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["a"])], names=["doc_id", "text"])]))


def test_marks_are_text_where_asked_for():
    for name, spaced in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        k = Tokenizer.from_file(public_tokenizers.path(name))
        text = "a <|endoftext|> b<|endoftext|>"
        ids = lambda plain: np.frombuffer(tokens.TextEncoder(public_tokenizers.path(name), spaced, plain).encode_all([text])[0], "<u4").tolist()  # noqa: B023, E731
        whole = k.encode(text, add_special_tokens=False).ids
        k.encode_special_tokens = True
        plain = k.encode(text, add_special_tokens=False).ids
        assert ids(False) == whole != plain == ids(True)


@pytest.mark.parametrize(("name", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_pieces_give_the_ids_of_whole_texts(name, spaced):
    rng = random.Random(2)
    k = Tokenizer.from_file(public_tokenizers.path(name))
    bits = ["the", "Der,", " ", "  ", "\n", "é.", "don't", "12,3", "ΣΑΣ.", "İx", "ǅ", "'s", " ", "é", "...", "<|endoftext|>", "\x1c", "ß"]
    texts = ODD + ["".join(rng.choice(bits) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.randrange(30))) for _ in range(300)]
    got = tokens.TextEncoder(public_tokenizers.path(name), spaced).encode_all(texts)
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == [k.encode(t, add_special_tokens=False).ids for t in texts]


# --- 3

LANGS = {"en": "the of and thing with ing tion shall have".split(), "de": "der und nicht schön keit ung heit auch über".split(), "fr": "le est dans élève eaux tion pour où être".split(), "es": "el los ción para más año qué señor está".split()}


def test_language_held_out(spark, odd, none):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(LANGS[g]) for _ in range(30)), g) for i, g in enumerate(rng.choice(list(LANGS)) for _ in range(400))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit_language_model(docs)
    assert set(model.families) == {"germanic", "romance"}
    got = {r.doc_id: r for r in language.identify_language(docs, model).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert held and all(got[i].lang_pred == rows[i][2] for i in held)
    found = language.identify_language(odd, model).collect()
    assert len(found) == odd.count()
    assert all(0 <= r.score <= 1 for r in found)
    assert all((r.lang_pred == "und") == (not re.search(r"[^\W\d_]", r.text or "")) for r in found)
    assert language.identify_language(none, model).count() == 0
    assert {r.lang_pred for r in language.identify_language(odd, language.fit_language_model(none)).collect()} == {"und"}


# --- 4


def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    comp = {i: i for i in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_against_brute_force(spark, k):
    rng = random.Random(4)
    texts = [words(rng, rng.randrange(1, 80)) for _ in range(60)] + ["", None, "One two", "one TWO", "short", "SHORT"]
    base = words(rng, 300, 5000).split()
    for n in range(90):  # a star of copies around one text, as alike to each other as not
        copy = list(base)
        for _ in range(rng.randrange(0, 22)):
            copy[rng.randrange(len(copy))] = f"x{n}{rng.randrange(99)}"
        texts.append(" ".join(copy))
    texts += texts[:10] + [texts[-1].upper()]
    got = {r.doc_id: r for r in near_dup.near_duplicates(frame(spark, texts), words=k).collect()}
    want = brute_components(list(enumerate(texts)), k, 80)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_crowded_regions_are_read_deeper(spark, monkeypatch):
    """With regions of at most 40 documents, the prefixes of 150 copies must be read to six and eight values."""
    monkeypatch.setattr(near_dup, "REGION", 40)
    rng = random.Random(12)
    base, texts = words(rng, 200, 5000).split(), []
    for n in range(150):
        copy = list(base)
        for k in rng.sample(range(200), rng.randrange(0, 6)):
            copy[k] = f"y{n}{k}"
        texts.append(" ".join(copy))
    texts += [words(rng, 50) for _ in range(20)]
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(frame(spark, texts), words=2).collect()}
    assert got == {i: c for i, (_, c) in brute_components(list(enumerate(texts)), 2, 80).items()}


def test_crowded_buckets_lose_no_link(spark, monkeypatch):
    """Pairs of filled-in forms: the template crowds the prefixes of all trees, and each form is linked with its twin alone."""
    monkeypatch.setattr(near_dup, "REGION", 40)
    rng = random.Random(32)
    base, texts = words(rng, 200, 5000).split(), []
    for n in range(180):
        at = rng.sample(range(1, 199, 2), 14)
        form = list(base)
        for k in at[:4]:
            form[k] = f"p{n}_{k}"
        for twin, own in enumerate((at[4:9], at[9:14])):
            copy = list(form)
            for k in own:
                copy[k] = f"t{n}_{twin}_{k}"
            texts.append(" ".join(copy))
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(frame(spark, texts), words=2).collect()}
    assert got == {i: c for i, (_, c) in brute_components(list(enumerate(texts)), 2, 80).items()}


def test_narrow_hashes_lose_and_make_no_link(spark, monkeypatch):
    """With one byte of each hash kept in crowded buckets, sets fall together and alike; whole hashes must decide."""
    monkeypatch.setattr(near_dup, "NARROW", np.uint8)
    monkeypatch.setattr(near_dup, "SMALL", 4)
    monkeypatch.setattr(near_dup, "REGION", 60)
    rng = random.Random(33)
    base, texts = words(rng, 120, 5000).split(), []
    for n in range(60):
        at = rng.sample(range(1, 119, 2), 10)
        for twin, own in enumerate((at[:5], at[5:])):
            copy = list(base)
            for k in [*at[:3], *own]:
                copy[k] = f"t{n}_{twin * (k in own)}_{k}"
            texts.append(" ".join(copy))
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(frame(spark, texts), words=2).collect()}
    assert got == {i: c for i, (_, c) in brute_components(list(enumerate(texts)), 2, 80).items()}


@pytest.mark.parametrize("few", [0, 10**9])
@pytest.mark.parametrize("kind", [np.uint8, np.uint64])
def test_joining_links_of_a_cell(monkeypatch, few, kind):
    """Pair by pair or by matrix products, a cell's links join what all links on whole hashes join, and may join more on narrow ones."""
    import pyarrow as pa

    monkeypatch.setattr(near_dup, "FEW_PAIRS", few)
    monkeypatch.setattr(near_dup, "COLUMNS", 16)
    rng = np.random.default_rng(36)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, 36, replace=False), rng.integers(0, 2**63, int(rng.integers(0, 9)), dtype=np.uint64)])) for _ in range(60)] + [rng.integers(0, 2**63, 5, dtype=np.uint64)]
    cut = np.uint64(64 - 8 * np.dtype(kind).itemsize)
    parts = [np.unique((s >> cut).astype(kind)) if cut else s for s in sets]
    briefs = [(near_dup.signature(s) & 0xFF).astype(np.uint8).tobytes() for s in sets]
    comp = np.array([0] * 9 + list(range(9, len(sets))))
    for side in (np.zeros(len(sets), int), (np.arange(len(sets)) % 3 == 0).astype(int)):
        rows = pa.table({"id": np.arange(len(sets)), "brief": pa.array(briefs), "comp": comp, "side": side, "n": [len(s) for s in sets], "s": pa.array([p.tobytes() for p in parts])})
        got = near_dup._joining_links(rows, 80, kind)
        parent = list(range(len(sets)))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        def joined(links):
            parent[:] = [0] * 9 + list(range(9, len(sets)))  # noqa: B023
            for a, b in links:
                x, y = find(a), find(b)  # noqa: B023
                parent[max(x, y)] = min(x, y)  # noqa: B023
            return [find(x) for x in range(len(sets))]  # noqa: B023

        true = [(a, b) for a in range(len(sets)) for b in range(a) if (side[a] != side[b] or not side.any()) and near_dup._linked(sets[a], sets[b], 80)]
        want, found = joined(true), joined(got)
        assert found == want if kind is np.uint64 else all(found[a] == found[b] for a, b in true)
        assert len(got) <= len(set(comp.tolist()))


def test_deduplicate_keeps_other_texts_of_a_key(spark, odd, none):
    rng = random.Random(34)
    a, b, c = (words(rng, 60, 5000) for _ in range(3))
    near = " ".join(["changed", *a.split()[1:]])
    rows = [(5, a), (5, a), (5, b), (3, near), (7, b), (8, c), (None, c), (9, None), (9, ""), (4, "")]
    df = spark.createDataFrame([(i, t, "en", f"s{n}", None, "own", "own") for n, (i, t) in enumerate(rows)], DOCS)
    got = near_dup.deduplicate(df)
    assert got.schema == df.schema
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted([(3, near), (5, b), (8, c), (None, c), (9, None), (9, ""), (4, "")], key=repr)
    assert got.collect() == near_dup.deduplicate(df.repartition(3)).orderBy("doc_id").collect() or {r.source for r in got.collect()} == {r.source for r in near_dup.deduplicate(df.repartition(3)).collect()}
    ones = near_dup.deduplicate(df.where("source in ('s0', 's3', 's4', 's5', 's6')"))
    assert sorted((r.doc_id or 0, r.text) for r in ones.collect()) == sorted([(3, near), (7, b), (8, c), (0, c)])
    assert near_dup.deduplicate(none).count() == 0 and near_dup.deduplicate(odd).count() > 0


def test_components_fail_if_rounds_do_not_suffice(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    with pytest.raises(RuntimeError, match="rounds"):
        near_dup.components(links, rounds=1)


def test_results_leave_no_scratch(spark):
    from lattisca.llm.common import Scratch

    scratch = Scratch(spark)
    kept = [scratch.keep(spark.range(3)) for _ in range(3)]
    here = spark._jvm.org.apache.hadoop.fs.Path(scratch.paths[0])
    fs = here.getFileSystem(spark._jsc.hadoopConfiguration())
    assert fs.exists(here)
    scratch.drop(but=1)
    assert not fs.exists(here) and kept[2].count() == 3


def test_near_duplicates_odd_rows(spark, odd, none):
    found = near_dup.near_duplicates(odd).collect()
    assert len(found) == odd.count()
    assert [(r.component_id, r.kept) for r in found if r.doc_id is None] == [(None, True)]
    assert near_dup.near_duplicates(none).count() == 0


def test_components_of_long_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500)], "a long, b long")
    got = {r.id: r.comp for r in near_dup.components(links).collect()}
    assert all(got[i] == 0 for i in range(1, 201)) and got[501] == 500


# --- 5


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_warc_round_trip_and_filters(spark, tmp_path, compression):
    pages = [(0, "http://a/ x\r\nb", "<p>é</p>"), (1, None, None), (2, "u", ""), (3, "v", "<p>é</p>"), (4, "w", "z" * 3_000_000), (5, "q", "WARC/1.1\r\n\r\n\r\n")]
    df = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, record_type string").repartition(3)
    path = f"file://{tmp_path}/w"
    warc.write_warc(df, path, compression=compression)
    got = {r.page_id: r for r in warc.read_warc(spark, path, payload=True).collect()}
    for i, _, h in pages:
        data = (h or "").encode()
        assert got[i].payload_bytes == len(data)
        assert got[i].payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert got[i].record_type == ("revisit" if i in (2, 3) else "response")
        assert got[i].payload == (None if i in (2, 3) else data)
    assert got[3].refers_to == warc.record_id(0) and got[2].refers_to == warc.record_id(1)
    assert got[0].target_uri == "http://a/%20x%0D%0Ab" and got[1].target_uri is None
    some = warc.read_warc(spark, path).where("record_type = 'revisit' and page_id in (3, 4)")
    assert [r.page_id for r in some.collect()] == [3]
    assert "PushedFilters" in some._jdf.queryExecution().toString() or some.count() == 1
    warc.write_warc(df.limit(0), f"file://{tmp_path}/e")
    assert warc.read_warc(spark, f"file://{tmp_path}/e").count() == 0
    warc.write_warc(df, f"file://{tmp_path}/m", min_bytes=5)
    assert {r.page_id for r in warc.read_warc(spark, f"file://{tmp_path}/m").where("record_type = 'revisit'").collect()} == {3}


def test_warc_records_without_a_type(spark, tmp_path):
    """Filters on presence are applied, and null equals nothing."""
    plain = warc.encode_record(1, "u", b"p", "response", None, warc.digest32(b"p")).replace(b"WARC-Type: response\r\n", b"")
    other = warc.encode_record(2, None, b"q", "response", None, warc.digest32(b"q"))
    (tmp_path / "x.warc").write_bytes(plain + other)
    back = warc.read_warc(spark, f"file://{tmp_path}")
    at = lambda c: sorted(r.page_id for r in back.where(c).collect())
    assert at("true") == [1, 2]
    assert at("record_type is not null") == [2] and at("record_type = 'response'") == [2] and at("record_type is null") == [1]
    assert at("target_uri is not null") == [1] and at("record_type in ('response', null)") == [2]
    assert at("record_type is not null and target_uri is null") == [2] and at("refers_to is not null") == []


def test_warc_members_are_skipped_undecoded():
    """A member that tells its length is passed over by a seek; a broken payload behind the header isn't met."""
    import gzip as gz

    import pyarrow as pa

    rng = random.Random(35)
    payloads = [rng.randbytes(50_000) for _ in range(6)]
    members = [warc.gzip_member(warc.encode_record(i, None, p, "response", None, warc.digest32(p))) for i, p in enumerate(payloads)]
    assert b"".join(gz.decompress(m) for m in members) == gz.decompress(b"".join(members))
    broken = members[3][:8000] + b"\xff" * (len(members[3]) - 8000)
    data = b"".join([*members[:3], broken, *members[4:]])
    assert [r[6] for r in warc.read_records(pa.BufferReader(data), "f", True, {}, False)] == list(range(6))
    with pytest.raises(Exception, match="."):
        list(warc.read_records(pa.BufferReader(data), "f", True, {}, True))
    whole = list(warc.read_records(pa.BufferReader(b"".join(members)), "f", True, {}, True))
    assert [r[10] for r in whole] == payloads
    foreign = b"".join(gz.compress(gz.decompress(m)) for m in members)  # members without their lengths
    assert [r[:10] for r in warc.read_records(pa.BufferReader(foreign), "f", True, {}, False)] == [r[:10] for r in whole]


def test_warc_many_repeated_digests(spark, tmp_path, monkeypatch):
    """Beyond the limit of a broadcast, the keys of revisits are joined."""
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", 1)
    rows = [(i, "u", f"p{i % 7}") for i in range(60)] + [(None, "n", "p3"), (100, "o", "alone"), (0, "again", "p0")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    warc.write_warc(df, f"file://{tmp_path}/w", compression="gzip")
    got = warc.read_warc(spark, f"file://{tmp_path}/w").where("record_type <> 'warcinfo'").collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got if r.page_id is not None) == sorted((i, "response" if i in (*range(7), 100) else "revisit", None if i in (*range(7), 100) else warc.record_id(i % 7)) for i, _, _ in rows if i is not None)
    assert [(r.record_type, r.refers_to) for r in got if r.page_id is None] == [("revisit", warc.record_id(3))]


def test_warc_rejected_payloads_are_not_read(tmp_path):
    import pyarrow as pa

    records = [warc.encode_record(i, None, b"p" * 10_000, "response", None, warc.digest32(b"p" * 10_000)) for i in range(50)]
    broken = warc.encode_record(99, None, b"right", "response", None, warc.digest32(b"wrong"))
    file = pa.BufferReader(b"".join([*records, broken]))
    assert [r[6] for r in warc.read_records(file, "f", False, {"page_id": {7}}, True)] == [7]  # the broken one is passed over
    with pytest.raises(ValueError, match="digest"):
        list(warc.read_records(pa.BufferReader(broken), "f", False, {}, True))


# --- 6

LONG = "The quick thing is that it was in the house and they had to be with the others for a while, as he said to them. "


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<html><head><title>t</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><a href=/>home</a></nav><div class='ad'>Buy now</div><article><h1>Head &amp; er</h1><p><b>A&nbsp;b\n c<br><p>Two &lt;p&gt;</article><footer>&copy; x</footer>", "Head & er A b c Two <p>"),
        (f"<body><div id=menu><a href=a>one</a> <a href=b>two</a></div><h2>Title</h2><p>{LONG * 3}</p><p>Short one.</p><p>{LONG * 2}</p><div class='comments'><p>{LONG}</p></div></body>", f"Title {(LONG * 3).strip()} Short one. {(LONG * 2).strip()}"),
        (f"<article><p>{LONG}</p><aside>{LONG}</aside><form>{LONG}</form><section id=comments>{LONG}</section><div role=navigation>x</div><p hidden>y</p><p>End.</p></article>", f"{LONG.strip()} End."),
        ("", ""),
        (None, ""),
        ("<p", ""),
        ("<script>never closed <p>x</p>", ""),
        ("<!-- a > b --><article>Ti.</article>", "Ti."),
        (f"<div class='layout has-sidebar'><article><div class=entry-header><h1>T</h1></div><p>{LONG}</p><ol class=commentlist><li>{LONG}</ol></article></div>", f"T {LONG.strip()}"),
        ("<article>a < b &#x41;&#66; &unknown;</article>", "a < b AB &unknown;"),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("page", ["<a " * 330_000 + '"', "<a b='" * 160_000, "<div>" * 90_000 + "</i>" * 90_000, "<script>" + "</script " * 110_000, "<p>x</div>" * 90_000, "&#" * 500_000], ids=range(6))
def test_broken_pages_take_time_in_proportion(page):
    import time

    began = time.time()
    html_text.main_text(page)
    assert time.time() - began < 10  # a second or less; hours where it grows with the square


class Article(HTMLParser):
    """The words of article elements by the standard library's parser: a labelling of its own."""

    OUT = ("nav", "aside", "form", "footer", "script", "style")

    def __init__(self):
        super().__init__()
        self.inside, self.out, self.parts = 0, 0, []

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.out += tag in self.OUT
        self.parts.append(" " * (tag in html_text.BLOCKS or tag == "br"))

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        self.out -= tag in self.OUT
        self.parts.append(" " * (tag in html_text.BLOCKS))

    def handle_data(self, data):
        if self.inside and not self.out:
            self.parts.append(data)


@pytest.mark.parametrize(("marked", "precision", "recall"), [(True, 0.999, 0.999), (False, 0.98, 0.75)])
def test_main_text_of_pages_against_another_parser(marked, precision, recall):
    """Word precision and recall on the table; also where nothing marks the article and the block rules alone decide."""
    right = got_n = want_n = 0
    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist():
        parser = Article()
        parser.feed(page or "")
        want = Counter("".join(parser.parts).split())
        got = Counter(html_text.main_text(page if marked else re.sub("</?article", lambda m: m[0].replace("article", "div"), page or "")).split())
        right, got_n, want_n = right + (got & want).total(), got_n + got.total(), want_n + want.total()
    assert right >= precision * got_n and right >= recall * want_n


def test_extract_text_keeps_rows(spark):
    df = spark.createDataFrame([(1, None, "u", "own"), (2, "<article>Hallo \U0001f600</article>", None, "own"), (2, "<article>Hallo \U0001f600</article>", None, "own")], "page_id long, html string, url string, text string")
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_text.extract_text(df).collect())
    assert got == [(1, "", 0), (2, "Hallo \U0001f600", 7), (2, "Hallo \U0001f600", 7)]
    assert html_text.extract_text(df.limit(0)).count() == 0


# --- 7


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_against_edit_distance():
    rng = random.Random(7)
    terms = ["idiot", "scum", "disgusting", "loser", "losers"]
    auto = toxicity.LexiconAutomaton(terms, ["vequ"])
    for _ in range(3000):
        w = list(rng.choice([*terms, "vequel", "clean"]))
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randrange(2)] = rng.choice(["", rng.choice("abcdilostx")])
        w = "".join(w)
        want = 1 if w.startswith("vequ") else 0 if w in terms else 2 if any(levenshtein(w, t) <= toxicity.edits_for(t) for t in terms) else None
        got = auto.match(w)
        assert got == want or (want == 0 and got == 1), w


def test_toxicity_held_out(spark, odd, none):
    rng = random.Random(8)
    bad = ["scumbag", "worthless", "idiotic"]
    rows, labels = [], []
    for i in range(500):
        y = int(rng.random() < 0.3)
        t = words(rng, 60).split()
        for _ in range(3 * y):
            w = rng.choice(bad)
            t[rng.randrange(60)] = w if rng.random() < 0.8 else w[:3] + w[4:]
        rows.append((i, " ".join(t)))
        labels.append((i, 1, y))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit_toxicity_model(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert set(bad) <= set(model.terms)  # frequent misspellings may be terms of their own
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    held = [i for i in range(500) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i].predicted == labels[i][2] for i in held) >= 0.97 * len(held)
    assert model.score("you are an idiotic worthless scumbag") > model.score('he said "idiotic" in his report')
    found = toxicity.score_toxicity(odd, model).collect()
    assert len(found) == odd.count() and all(0 <= r.score < 0.5 and r.predicted == 0 for r in found)
    assert toxicity.score_toxicity(none, model).count() == 0
    empty = toxicity.fit_toxicity_model(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert empty.terms == [] and toxicity.score_toxicity(docs, empty).count() == 500


# --- 8


def brute_quality(rows):
    norm = lambda line: re.sub("[0-9]", "0", " ".join(w for w in re.split(r"[\x20\x09-\x0D]+", line.lower()) if w))
    hosts = {}
    for _, t, h in rows:
        lines = {x for x in map(norm, (t or "").split("\n")) if len(x.split(" ")) >= quality.LINE_WORDS}
        hosts.setdefault(h or "", []).append(lines)
    out = []
    for i, t, h in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        wins = {}
        for j in range(len(w) - 7):
            wins.setdefault(tuple(w[j : j + 8]), []).append(j)
        rep = {k for v in wins.values() if len(v) > 1 for j in v for k in range(j, j + 8)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        mine = hosts[h or ""]
        often = lambda x: sum(x in s for s in mine)
        gone = sum(len(x.split(" ")) for x in map(norm, t.split("\n")) if len(x.split(" ")) >= quality.LINE_WORDS and often(x) > quality.MAX_DOCS and often(x) * 1000 > len(mine) * quality.MAX_PER_THOUSAND)
        failed = len(w) < 20 or 100 * len(rep) > 30 * len(w)
        out.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep), failed, not failed and 100 * (len(w) - gone) >= quality.LEFT_PERCENT * len(w), gone))
    return sorted(out, key=repr)


def test_quality_against_brute_force(spark, none):
    rng = random.Random(9)
    rows = []
    for i in range(120):
        lines = [words(rng, rng.randrange(1, 12), 60) for _ in range(rng.randrange(1, 8))]
        if i % 3 == 0:
            lines += ["The same Line 12 everywhere"] * rng.randrange(1, 4)
        if i % 5 == 0:
            lines += [words(rng, 9, 9)] * 3
        if i % 3 == 1:
            lines = ["cookie  notice of\tthis site %d and then some more words to be long enough for twenty" % (i % 10)] * 2
        rows.append((i % 110, "\n".join(lines), "h1" if i % 3 < 2 else None))
    rows += [(200 + k, t, "h2") for k, t in enumerate(ODD)] + [(300, None, "h2"), (300, None, "h2"), (None, "x", None)]
    df = spark.createDataFrame([(*r, "own") for r in rows], "doc_id long, text string, source string, host string")
    got = quality.line_quality(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_quality(rows)
    assert quality.line_quality(none).count() == 0
    cleaned = {r.doc_id: r.text for r in quality.cleaned_text(df.where("doc_id < 200")).collect()}
    assert not any("same Line" in t for t in cleaned.values())


# --- 9


def brute_hits(text, items, window=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    w, hit, names = split(text), set(), set()
    for name, t in items:
        q = split(t)
        for i in range(max(1, len(q) - window + 1) if q else 0):
            part = q[i : i + window]
            for j in range(len(w) - len(part) + 1):
                if w[j : j + len(part)] == part:
                    hit |= set(range(j, j + len(part)))
                    names.add(str(name))
    return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


def test_contamination_against_brute_force(spark, odd, none, monkeypatch):
    rng = random.Random(10)
    items = [(n, words(rng, n_words, 12)) for n, n_words in enumerate([25, 12, 10, 4, 2, 0, 11, 25])] + [(20, None), (21, "é-Ü, 7"), (3, "dup id of a short one")]
    texts = [words(rng, rng.randrange(0, 60), 12) for _ in range(60)] + [f"…{items[k][1].upper().replace(' ', '; ')}! and" for k in range(4)] + ["É-Ü 7", "é ü 7 é ü 7"]
    bench = spark.createDataFrame([(*x, "own") for x in items], "item_id long, text string, doc_id string")
    df = frame(spark, texts)
    want = {i: brute_hits(t, [x for x in items if x[1] is not None]) for i, t in enumerate(texts)}
    for limit in (contamination.AUTOMATON_CHARS, 60):  # one automaton, and several
        monkeypatch.setattr(contamination, "AUTOMATON_CHARS", limit)
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in contamination.find_contamination(df, bench).collect()}
        assert got == want
    for limit in (10**6, 60):
        monkeypatch.setattr(contamination, "AUTOMATON_CHARS", limit)
        long = contamination.find_contamination(frame(spark, ["x " * 9 + "w1 " * 5000, None]), spark.createDataFrame([(1, "w1 " * 30), (2, "w1 " * 10 + "w2")], "item_id long, text string"), spans=True)
        assert [(r.n_words, r.n_hit, r.n_items) for r in long.orderBy("doc_id").collect()] == [(5009, 5000, 2), (0, 0, 0)]
    spans = contamination.find_contamination(frame(spark, ["ab É-Ü, 7!", "É; ü 7"]), spark.createDataFrame([(1, "É ü 7")], "item_id long, text string"), spans=True).collect()
    assert [[(x.first, x.behind) for x in r.spans] for r in spans if r.contaminated] == [[(0, 6)]]
    found = contamination.find_contamination(odd, bench, keep=odd.columns).collect()
    assert len(found) == odd.count()
    assert contamination.find_contamination(none, bench).count() == 0
    assert not any(r.contaminated for r in contamination.find_contamination(df, bench.limit(0)).collect())


# --- 10


def test_packing_is_whole_and_tight(spark, odd, none):
    rng = random.Random(11)
    path = public_tokenizers.path("word_bpe_49k.json")
    k = Tokenizer.from_file(path)
    df = frame(spark, [words(rng, rng.choice([5, 40, 300, 700, 2500])) for _ in range(150)]).union(odd)
    rows = packing.pack(df, path, ids=True).collect()
    want = sorted((r.doc_id is None, r.doc_id or 0, tuple([*k.encode(r.text or "", add_special_tokens=False).ids, 0])) for r in df.collect())
    docs, here = [], {}
    for r in rows:
        assert r.length == len(r.ids) <= 2048 and r.start == 2048 * r.piece and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        here.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in here.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in rows)
    assert total == sum(len(ids) for _, _, ids in want)
    lengths = np.bincount([r.length for r in rows], minlength=2049)
    assert -(-total // 2048) <= len(here) <= sum(times for _, times in packing.best_fit(lengths, 2048))
    single = {}
    for r in rows:
        single.setdefault(r.doc_id, []).append(r)
    for i, parts in single.items():
        if sum(x[1] == (i or 0) and x[0] == (i is None) for x in want) == 1:
            docs = next(x[2] for x in want if x[1] == (i or 0) and x[0] == (i is None))
            assert tuple(t for p in sorted(parts, key=lambda p: p.piece) for t in p.ids) == docs
    assert packing.pack(none, path).count() == 0


def test_fit_uses_full_patterns():
    counts = np.zeros(2049, np.int64)
    counts[[1024, 1500, 548, 683, 682, 2048]] = [10, 6, 6, 8, 4, 3]
    planned = packing.plan(counts, 2048)
    used = np.zeros(2049, np.int64)
    for parts, times in planned:
        assert sum(parts) <= 2048
        for p in parts:
            used[p] += times
    assert (used == counts).all() and sum(t for _, t in planned) == 3 + 5 + 6 + 4


def test_language_fit_holds_its_table_once():
    """The driver fits; beside the table of texts it has no room for copies of it."""
    import tracemalloc

    from lattisca.llm import language

    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abcdefghij"[k : k + 5]) for _ in range(6)) for _ in range(40)) for k in range(4) for _ in range(150)]
    names = [n for n in ("en", "de", "fr", "xx") for _ in range(150)]
    tracemalloc.start()
    model = language.LanguageModel.fit(texts, names)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.5 * len(texts) * 4 * (1 << language.BITS)
    assert sum(model.predict(t)[0] == n for t, n in zip(texts, names, strict=True)) > 0.95 * len(texts)


def test_near_duplicates_give_driver_memory_back(spark):
    """What lies unused in the JVM's old heap and in Python's native heap when a search begins is gone when it ends."""
    import ctypes
    import gc

    from lattisca.llm import common

    jvm, held = spark._jvm, spark.sparkContext._gateway.new_array(spark._jvm.Object, 8)
    ref = jvm.java.lang.ref.WeakReference(held)
    for _ in range(3):
        jvm.System.gc()  # ``held`` is old now
    del held
    gc.collect()
    libc = ctypes.CDLL(None)
    libc.malloc.restype, libc.free.argtypes = ctypes.c_void_p, [ctypes.c_void_p]
    blocks = [libc.malloc(4000) for _ in range(20_000)]
    for b in blocks:
        ctypes.memset(b, 1, 4000)
    for b in blocks[:-1]:  # the last one holds the heap's top
        libc.free(b)
    resident = lambda: int(next(x for x in open("/proc/self/status") if x.startswith("VmRSS")).split()[1])  # noqa: E731, SIM115
    before = resident()
    common._given_back[0] = float("-inf")
    found = near_dup.near_duplicates(frame(spark, ["a b c d e f g", "a b c d e f g", "other words are here"]), words=2)
    assert {r.doc_id: r.component_id for r in found.collect()} == {0: 0, 1: 0, 2: 2}
    assert ref.get() is None
    assert resident() < before - 60_000
    libc.free(blocks[-1])
    assert not common.give_back(spark, wait=1000)


def test_worker_gives_memory_back_when_another_operator_comes():
    """What an operator has kept is gone from the process once another one's task begins."""
    import ctypes

    from lattisca.llm import common

    libc = ctypes.CDLL(None)
    libc.malloc.restype, libc.free.argtypes = ctypes.c_void_p, [ctypes.c_void_p]
    blocks = [libc.malloc(4000) for _ in range(20_000)]
    for b in blocks:
        ctypes.memset(b, 1, 4000)

    def drop():  # all but the last, which holds the heap's top
        for b in blocks[:-1]:
            libc.free(b)

    resident = lambda: int(next(x for x in open("/proc/self/status") if x.startswith("VmRSS")).split()[1])  # noqa: E731, SIM115
    common.hold("one of the test", drop)
    before = resident()
    common.hold("another of the test", lambda: None)
    assert resident() < before - 60_000
    libc.free(blocks[-1])


def test_executors_give_heap_back():
    """An executor that has filled its heap has less of it once memory is given back."""
    import subprocess
    import sys
    from pathlib import Path

    code = """
import glob, re
from pathlib import Path
from pyspark.sql import SparkSession, functions as F
from lattisca.llm import common
conf = {"spark.master": "local-cluster[2,1,1000]", "spark.executor.memory": "700m", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.host": "127.0.0.1"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
app = spark.sparkContext.applicationId
def resident():
    found = [p for p in glob.glob("/proc/[0-9]*") if app.encode() in (c := Path(p, "cmdline").read_bytes()) and b"CoarseGrainedExecutorBackend" in c]
    return sorted(int(re.search(r"VmRSS:\\\\s+(\\\\d+)", Path(p, "status").read_text())[1]) for p in found)
rows = spark.range(0, 6_000_000, 1, 4).select((F.col("id") * 7919 % 3_000_001).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("s"))
for _ in range(2):
    rows.groupBy("k").agg(F.max("s")).sort("k").write.format("noop").mode("overwrite").save()
before = resident()
common.give_back(spark, wait=0)
print("FOUND", *before, *resident())
spark.stop()
""".replace("\\\\", "\\")
    said = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[2], capture_output=True, text=True, timeout=300)
    before, after = np.array(said.stdout.rpartition("FOUND")[2].split(), int).reshape(2, 2)
    assert (after < before - 100_000).all()


def test_cell_of_many_pairs_is_counted_in_little_memory():
    """All pairs of a full cell are looked at, but tables of all pairs are no wider than they must be."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**31, 40, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base, rng.integers(0, 2**31, 2, dtype=np.uint64)])).astype(np.uint32) for _ in range(2048)]
    sets[7] = np.sort(rng.integers(0, 2**31, 42, dtype=np.uint64)).astype(np.uint32)
    n = len(sets)
    rows = pa.table({"id": range(n), "brief": [bytes(128)] * n, "comp": range(n), "side": [0] * n, "n": [len(s) for s in sets], "s": [s.tobytes() for s in sets]})
    tracemalloc.start()
    found = near_dup._joining_links(rows, 80, np.uint32)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == n - 2 and all(7 not in p for p in found)
    assert peak < 160e6
