"""Token-ID output (operator 10): independent zstandard frames and a trailing seek table.

A file holds one frame for each document, in ascending order of ids, then one frame with
the documents' ids, then a skippable frame: a seek table in the public seekable format,
whose entries (compressed size, size, low 32 bits of XXH64) let a reader decompress and
verify only the documents asked for.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, tokens

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
# Fixed values of the public seekable format.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
HAS_CHECKSUMS = 0x80

#: A file is closed when it holds so many bytes.
FILE_BYTES = 256 << 20
SUMMARY = "part int, piece int, path string, n_docs long, n_tokens long"


class TokenWriter:
    """Streams documents' ids into one file; ``out`` has write(bytes)."""

    def __init__(self, out, level: int = 3):
        import zstandard

        self.out, self.zstd = out, zstandard.ZstdCompressor(level=level, write_checksum=False)
        self.entries, self.docs, self.n_tokens = bytearray(), [], 0

    def _frame(self, data: bytes) -> None:
        import xxhash

        packed = self.zstd.compress(data)
        self.out.write(packed)
        self.entries += struct.pack("<III", len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self._frame(ids.astype("<u4").tobytes())
        self.docs.append(doc_id)
        self.n_tokens += len(ids)

    def close(self) -> None:
        ids = np.array([d or 0 for d in self.docs], "<i8").tobytes()
        self._frame(ids + bytes(d is None for d in self.docs))
        n = len(self.entries) // 12
        self.out.write(struct.pack("<II", SKIPPABLE, len(self.entries) + 9))
        self.out.write(bytes(self.entries) + struct.pack("<IBI", n, HAS_CHECKSUMS, SEEKABLE))


class TokenReader:
    """Reads single documents of a file; ``source`` has seek, read and size()."""

    def __init__(self, source):
        import zstandard

        self.source, self.zstd = source, zstandard.ZstdDecompressor()
        size = source.size()
        source.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE or not flags & HAS_CHECKSUMS:
            raise ValueError("no seek table with checksums at the file's end")
        source.seek(size - 9 - 12 * n)
        self.table = np.frombuffer(source.read(12 * n), "<u4").reshape(n, 3)
        self.begin = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        data = self.frame(n - 1)
        self.n_docs = n - 1
        self.ids = np.frombuffer(data[: 8 * self.n_docs], "<i8")
        self.null = np.frombuffer(data[8 * self.n_docs :], np.uint8).astype(bool)
        #: Ids of all documents before each, within this file.
        self.starts = np.concatenate([[0], np.cumsum(self.table[:-1, 1] // 4, dtype=np.int64)])

    def frame(self, k: int) -> bytes:
        import xxhash

        self.source.seek(int(self.begin[k]))
        data = self.zstd.decompress(self.source.read(int(self.table[k, 0])), max_output_size=max(1, int(self.table[k, 1])))
        if len(data) != self.table[k, 1] or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.table[k, 2]:
            raise ValueError(f"frame {k} doesn't match its checksum")
        return data

    def tokens(self, k: int) -> np.ndarray:
        return np.frombuffer(self.frame(k), "<u4")

    def find(self, doc_id: int) -> list[int]:
        return np.flatnonzero((self.ids == doc_id) & ~self.null).tolist()


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID) -> list[tuple]:
    """Write ``docs`` (doc_id, text) in ascending doc_id (nulls first, then text); returns (part, piece, path, documents, ids).

    Files follow the ranges of ids and are closed at ``FILE_BYTES``; a retried task replaces its
    files whole.  Null texts are the end id alone, repeated rows are written as often as they
    come, an empty table gives no file, further columns go.
    """
    spark = docs.sparkSession
    path = path or tokens.tokenizer_path(VOCABULARY)
    shared.text_batches(spark)

    def run(batches):
        out = writer = None
        part, done = TaskContext.get().partitionId(), []
        end = np.array([end_id], np.uint32)

        def close():
            writer.close()
            done.append((part, len(done), out.commit(), len(writer.docs), writer.n_tokens))

        for pdf in batches:
            for doc, ids in zip(pdf["doc_id"], tokens.encoder(path).encode(pdf["text"].tolist()), strict=True):
                if out is None:
                    out = shared.AtomicFile(folder, f"part-{part:06d}-{len(done):04d}.tokens.zst")
                    writer = TokenWriter(out)
                writer.add(None if pd.isna(doc) else int(doc), np.concatenate([ids, end]))
                if out.size >= FILE_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        yield pd.DataFrame(done, columns=["part", "piece", "path", "n_docs", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranged = rows.repartitionByRange(shared.parts(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    return [tuple(r) for r in ranged.mapInPandas(run, SUMMARY).collect()]  # one row for each file


def read_token_files(spark: SparkSession, folder: str, files: list[tuple]) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, decoded from the files; start counts all ids before it."""
    base, rows = 0, []
    for part, piece, path, _, n in sorted(files):
        rows.append((part, piece, path, base))
        base += n

    def run(batches):
        fs, _ = shared.filesystem(folder)
        for pdf in batches:
            for path, first in zip(pdf["path"], pdf["base"], strict=True):
                with fs.open_input_file(path) as source:
                    r = TokenReader(source)
                    a = 0
                    while a < r.n_docs:
                        b, size = a, 0
                        while b < r.n_docs and b - a < 500 and size < 1 << 22:  # bounded by bytes as well
                            size += int(r.table[b, 1])
                            b += 1
                        ids = [r.frame(k) for k in range(a, b)]
                        doc = pd.array([None if r.null[k] else int(r.ids[k]) for k in range(a, b)], dtype="Int64")
                        yield pd.DataFrame({"doc_id": doc, "start": first + r.starts[a:b], "n_tokens": [len(x) // 4 for x in ids], "ids": ids})
                        a = b

    listed = spark.createDataFrame(rows, "part int, piece int, path string, base long")
    listed = listed.repartition(max(1, len(rows)), "part", "piece") if rows else listed
    return listed.mapInPandas(run, "doc_id long, start long, n_tokens long, ids binary")


def op10_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared.new_path(spark, "tokens")
    files = write_token_files(shared.table(spark, sf_dir, "documents"), folder)
    rows = read_token_files(spark, folder, files)
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
