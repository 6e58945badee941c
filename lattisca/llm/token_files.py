"""Token files: concatenated ids, and the documents' boundaries in Elias-Fano form with a select directory.

A file, little-endian throughout::

    magic (8 bytes), ids (2 or 4 bytes each), document keys (int64), null flags of the keys (bit map),
    lower halves of the boundaries (bit map), upper halves (unary bit map), select directory (uint64),
    footer (JSON), footer length (uint32), magic

Boundaries are the ends of the documents, so n of them rise to the number u of ids: l = floor(log2(u / n)) low bits each, and
n + u / 2**l bits for the upper halves. The directory has the place of every 256th set bit, so that ``select`` reads a
few words.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from lattisca.llm.common import shared_path, table
from lattisca.llm.tokens import encoder

MAGIC = b"LTSKTOK1"
STEP = 256
#: Documents and ids that a reader holds at a time (a longer document is held whole).
RUN_DOCUMENTS, RUN_TOKENS = 4096, 1_000_000
SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"
SCHEMA_IDS = SCHEMA + ", ids array<long>"


class EliasFano:
    """A rising sequence of whole numbers; ``select(i)`` gives the i-th without decoding the others."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, directory: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.directory = n, low_bits, low, high, directory

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        l = max(0, (top // n).bit_length() - 1) if n else 0  # noqa: E741
        low = (values[:, None] >> np.arange(l, dtype=np.uint64)[None, :]) & np.uint64(1)
        places = (values >> np.uint64(l)) + np.arange(n, dtype=np.uint64)
        bits = np.zeros(n + (top >> l) + 1, np.uint8)
        bits[places.astype(np.int64)] = 1
        return cls(n, l, np.packbits(low.astype(np.uint8).ravel(), bitorder="little"), np.packbits(bits, bitorder="little"), places[::STEP])

    def select(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.directory[i // STEP]), i % STEP
        byte = at // 8
        word = int(self.high[byte]) >> (at % 8) << (at % 8)
        while (count := word.bit_count()) <= left:
            left -= count
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        upper = byte * 8 + (word & -word).bit_length() - 1 - i
        lower, first = 0, i * self.low_bits
        for k in range(self.low_bits):
            lower |= (int(self.low[(first + k) // 8]) >> ((first + k) % 8) & 1) << k
        return upper << self.low_bits | lower

    def select_run(self, first: int, behind: int) -> np.ndarray:
        """The values from ``first`` to before ``behind``: as many selects, for which the directory names the words of the
        upper halves to read. Nothing else is decoded."""
        if not 0 <= first <= behind <= self.n:
            raise IndexError((first, behind))
        if first == behind:
            return np.zeros(0, np.int64)
        block, last = first // STEP, (behind - 1) // STEP + 1
        byte = int(self.directory[block]) // 8
        end = int(self.directory[last]) // 8 + 1 if last < len(self.directory) else len(self.high)
        places = np.flatnonzero(np.unpackbits(self.high[byte:end], bitorder="little")) + 8 * byte
        places = places[np.searchsorted(places, int(self.directory[block])) :]  # bits of the block before
        places = places[first - block * STEP : behind - block * STEP]
        out = (places - np.arange(first, behind)) << self.low_bits
        if self.low_bits:
            at = first * self.low_bits
            size = (behind - first) * self.low_bits
            bits = np.unpackbits(self.low[at // 8 : (at + size + 7) // 8], bitorder="little")[at % 8 : at % 8 + size]
            out = out + bits.reshape(behind - first, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))
        return out.astype(np.int64)


def _fs(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path)


class TokenFile:
    """A finished file, read section by section."""

    def __init__(self, path: str):
        fs, place = _fs(path)
        self.file = fs.open_input_file(place)
        size = self.file.size()
        tail = self.file.read_at(12, size - 12)
        if tail[4:] != MAGIC:
            raise ValueError(f"{path} is not a token file")
        n = int.from_bytes(tail[:4], "little")
        self.meta = json.loads(self.file.read_at(n, size - 12 - n))
        self.n = self.meta["documents"]

    def _section(self, name: str, kind: str) -> np.ndarray:
        at, size = self.meta["sections"][name]
        return np.frombuffer(self.file.read_at(size, at), kind)

    def bounds(self) -> EliasFano:
        return EliasFano(self.n, self.meta["low_bits"], self._section("low", "u1"), self._section("high", "u1"), self._section("directory", "<u8"))

    def keys(self, first: int, behind: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys and null flags of a run of documents."""
        at, _ = self.meta["sections"]["keys"]
        flags, _ = self.meta["sections"]["nulls"]
        some = np.frombuffer(self.file.read_at((behind - first) * 8, at + first * 8), "<i8")
        bits = np.frombuffer(self.file.read_at((behind + 7) // 8 - first // 8, flags + first // 8), "u1")
        return some, np.unpackbits(bits, bitorder="little")[first % 8 : first % 8 + behind - first].astype(bool)

    def ids(self, first: int, last: int) -> np.ndarray:
        width = self.meta["width"]
        return np.frombuffer(self.file.read_at((last - first) * width, len(MAGIC) + first * width), f"<u{width}")

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document, by two selects."""
        ef = self.bounds()
        return self.ids(ef.select(i - 1) if i else 0, ef.select(i))

    def runs(self, documents: int, tokens: int) -> Iterator[tuple[int, np.ndarray]]:
        """Runs of documents as the number of the first one, and where each begins and the last ends; a run has at most so
        many documents and, unless it is one document, ids."""
        ef, first, start = self.bounds(), 0, 0
        while first < self.n:
            ends = ef.select_run(first, min(first + documents, self.n))
            ends = ends[: max(1, int(np.searchsorted(ends, start + tokens, "right")))]
            yield first, np.concatenate([[start], ends])
            first, start = first + len(ends), int(ends[-1])


class _Done(WriterCommitMessage):
    def __init__(self, entry: dict | None):
        self.entry = entry


class TokenFileWriter(DataSourceArrowWriter):
    """Rows (doc_id, text), already dealt out and sorted, to one file per task; only files that the manifest names count."""

    def __init__(self, options: dict):
        self.path, self.tokenizer = options["path"], options["tokenizer"]
        self.spaced, self.end_id = options.get("spaced", "true") == "true", int(options["end_id"])
        self.width = int(options.get("width", "4"))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        encode, end = encoder(self.tokenizer, self.spaced), np.array([self.end_id], f"<u{self.width}").tobytes()
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.tok"
        fs, place = _fs(self.path)
        fs.create_dir(place, recursive=True)
        lengths, keys, nulls, out, at = [], [], [], None, 0
        for batch in iterator:
            texts, ids = batch.column("text"), batch.column("doc_id")
            for k in range(0, batch.num_rows, 128):
                if out is None:
                    out = fs.open_output_stream(f"{place}/{name}")
                    out.write(MAGIC)
                coded = encode.encode_all(texts.slice(k, 128).to_pylist())
                for raw in coded:
                    if self.width != 4:
                        ids4 = np.frombuffer(raw, "<u4")
                        if len(ids4) and int(ids4.max()) >> 8 * self.width:
                            raise ValueError(f"id {ids4.max()} does not fit {self.width} bytes")
                        raw = ids4.astype(f"<u{self.width}").tobytes()
                    out.write(raw + end)
                    lengths.append(len(raw) // self.width + 1)
            nulls.append(np.asarray(ids.is_null().to_numpy(zero_copy_only=False), bool))
            keys.append(np.asarray(ids.fill_null(0).to_numpy(zero_copy_only=False), "<i8"))
        if out is None or not lengths:
            return _Done(None)
        ends = np.cumsum(np.array(lengths, np.int64))
        ef, at, sections = EliasFano.of(ends), len(MAGIC) + int(ends[-1]) * self.width, {}
        key = np.concatenate(keys)
        for section, data in (("keys", key.tobytes()), ("nulls", np.packbits(np.concatenate(nulls), bitorder="little").tobytes()), ("low", ef.low.tobytes()), ("high", ef.high.tobytes()), ("directory", ef.directory.astype("<u8").tobytes())):
            sections[section] = [at, len(data)]
            out.write(data)
            at += len(data)
        footer = json.dumps({"documents": len(lengths), "tokens": int(ends[-1]), "width": self.width, "low_bits": ef.low_bits, "sections": sections}).encode()
        out.write(footer + len(footer).to_bytes(4, "little") + MAGIC)
        out.close()
        null = np.concatenate(nulls)
        return _Done({"file": name, "part": TaskContext.get().partitionId(), "documents": len(lengths), "tokens": int(ends[-1]), "least": None if null[0] else int(key[0])})

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        entries = sorted((m.entry for m in messages if m is not None and m.entry), key=lambda e: (e["least"] is not None, e["least"] or 0))
        start = 0
        for e in entries:
            e["start"] = start
            start += e["tokens"]
        fs, place = _fs(self.path)
        fs.create_dir(place, recursive=True)
        with fs.open_output_stream(f"{place}/manifest.json") as f:
            f.write(json.dumps(entries).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, place = _fs(self.path)
        for m in messages:
            if m is not None and m.entry:
                fs.delete_file(f"{place}/{m.entry['file']}")


class _Part(InputPartition):
    def __init__(self, file: str, start: int):
        super().__init__(file)
        self.start = start


class TokenFileReader(DataSourceReader):
    """A partition for each file; a document's start is the file's, from the manifest, plus its own in the file."""

    def __init__(self, options: dict, with_ids: bool):
        self.path, self.with_ids = options["path"], with_ids

    def partitions(self) -> list[InputPartition]:
        fs, place = _fs(self.path)
        with fs.open_input_stream(f"{place}/manifest.json") as f:
            entries = json.loads(f.read())
        return [_Part(e["file"], e["start"]) for e in entries] or [_Part("", 0)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        if not partition.value:
            return
        file = TokenFile(f"{self.path}/{partition.value}")
        for first, cuts in file.runs(RUN_DOCUMENTS, RUN_TOKENS):
            keys, nulls = file.keys(first, first + len(cuts) - 1)
            ids = file.ids(int(cuts[0]), int(cuts[-1])).astype("<u4")
            places = (cuts - cuts[0]).tolist()
            crcs = [zlib.crc32(ids[a:b]) for a, b in zip(places, places[1:], strict=False)]
            columns = [pa.array(keys, pa.int64(), mask=nulls), pa.array(cuts[:-1] + partition.start), pa.array(np.diff(cuts)), pa.array(crcs, pa.int64())]
            names = ["doc_id", "start", "n_tokens", "ids_crc32"]
            if self.with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(ids.astype(np.int64))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)


class TokenFileSource(DataSource):
    """``format("token_files")``: options path, tokenizer, spaced, end_id, width; on reading path, and ids=true for the ids."""

    @classmethod
    def name(cls) -> str:
        return "token_files"

    def schema(self) -> str:
        return SCHEMA_IDS if self.options.get("ids") == "true" else SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return TokenFileReader(dict(self.options), self.options.get("ids") == "true")

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return TokenFileWriter(dict(self.options))


def id_width(tokenizer: str, end_id: int) -> int:
    """The bytes that every id of the vocabulary and the end id need: 2 or 4."""
    from tokenizers import Tokenizer

    most = max(end_id, *Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values())
    return 2 if most < 1 << 16 else 4


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, spaced: bool = True, width: int | None = None, key: str = "doc_id", text: str = "text", partitions: int | None = None) -> None:
    """Writes the ids of every whole text and the end id, in ascending order of ``key`` over all files.

    ``width`` is the bytes of an id, by the vocabulary if it isn't given; an id that doesn't fit is an error. Keys are
    whole numbers of 64 bits. A null text is one without words; a null key sorts first; equal keys stay together in one
    file, in the order of their texts; an empty table gives a manifest without files; other columns are not read. A
    text is held whole while it is encoded, so the longest one bounds a task's memory.
    """
    from pyspark.sql import functions as F

    width = id_width(tokenizer, end_id) if width is None else width
    docs.sparkSession.dataSource.register(TokenFileSource)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    dealt = rows.repartitionByRange(partitions, "doc_id") if partitions else rows.repartitionByRange("doc_id")
    (
        dealt.sortWithinPartitions("doc_id", "text")
        .write.format("token_files")
        .mode("append")
        .options(path=path, tokenizer=tokenizer, end_id=end_id, spaced=str(spaced).lower(), width=width)
        .save()
    )


def read_token_files(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    spark.dataSource.register(TokenFileSource)
    return spark.read.format("token_files").options(path=path, ids=str(ids).lower()).load()


def op2_elias_fano_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_path(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_token_files(spark, path)
