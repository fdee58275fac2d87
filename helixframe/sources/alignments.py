"""Alignments and references: a data source for block-compressed BAM files, and FASTA pieces by their index.

A BAM file is a chain of compressed blocks.  It is cut at block boundaries; a task finds the
first record of its first block by reading on until a chain of records fits, and follows its
last record into the next task's blocks.  Nothing but the header is read on the driver.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, voffset long, name string, flag int, ref string, pos long, mapq int, score int, seq string, quals binary, ops array<int>, lens array<int>"
ARROW = pa.schema([("path", pa.string()), ("voffset", pa.int64()), ("name", pa.string()), ("flag", pa.int32()), ("ref", pa.string()), ("pos", pa.int64()), ("mapq", pa.int32()), ("score", pa.int32()), ("seq", pa.string()), ("quals", pa.binary()), ("ops", pa.list_(pa.int32())), ("lens", pa.list_(pa.int32()))])
# Fixed values of the public format: block magic, bases by nibble, sizes of tag values.
MAGIC = re.compile(rb"\x1f\x8b\x08\x04.{6}.{2}BC\x02\x00", re.DOTALL)
BASES = str.maketrans("0123456789abcdef", "=ACMGRSVTWYHKDBN")
TAG_BYTES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
TAG_FORMAT = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I"}
#: Records in a row that must fit before a place counts as a record's start.
CHAIN = 8
BATCH_ROWS = 4096


def open_file(path: str):
    """A seekable stream and its size, on any file system that pyarrow knows."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    where, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return where.open_input_file(inner)


class Blocks:
    """Blocks of a file by their offsets."""

    def __init__(self, path: str):
        self.file = open_file(path)
        self.size = self.file.size()

    def read(self, at: int) -> tuple[bytes, int]:
        """The block at ``at``, uncompressed, and the next one's offset."""
        self.file.seek(at)
        head = self.file.read(1 << 16)
        if not MAGIC.match(head):
            raise ValueError(f"no block at {at}")
        size = struct.unpack_from("<H", head, 16)[0] + 1
        head = head if len(head) >= size else head + self.file.read(size - len(head))
        begin = 12 + struct.unpack_from("<H", head, 10)[0]
        return zlib.decompress(head[begin : size - 8], -15), at + size

    def next_block(self, at: int) -> int:
        """First block's offset at or after ``at``: one whose successor is a block or the end."""
        while at < self.size:
            self.file.seek(at)
            data = self.file.read((1 << 17) + 18)
            for m in MAGIC.finditer(data):
                k = at + m.start()
                after = k + struct.unpack_from("<H", data, m.start() + 16)[0] + 1
                self.file.seek(after)
                if after == self.size or MAGIC.match(self.file.read(18)):
                    return k
            at += max(1, len(data) - 17)
        return self.size


class Stream:
    """Bytes of consecutive blocks, with the block and place of each."""

    def __init__(self, blocks: Blocks, at: int):
        self.blocks, self.next, self.data, self.marks, self.base = blocks, at, b"", [], 0

    def more(self) -> bool:
        """Appends a block that isn't empty; False at the end of the file."""
        while self.next < self.blocks.size:
            at = self.next
            new, self.next = self.blocks.read(at)
            if new:
                self.marks.append((self.base + len(self.data), at))
                self.data += new
                return True
        return False

    def fill(self, n: int) -> bool:
        while len(self.data) < n:
            if not self.more():
                return False
        return True

    def drop(self, n: int) -> None:
        self.data, self.base = self.data[n:], self.base + n
        while len(self.marks) > 1 and self.marks[1][0] <= self.base:
            self.marks.pop(0)

    def place(self, k: int) -> tuple[int, int]:
        """Block offset and place in the block of byte ``k`` of the data."""
        at = next(m for m in reversed(self.marks) if m[0] <= self.base + k)
        return at[1], self.base + k - at[0]


def read_header(path: str) -> tuple[list[tuple[str, int]], int, int]:
    """References (name, length), and the block and place of the first record."""
    s = Stream(Blocks(path), 0)
    if not s.fill(8) or s.data[:4] != b"BAM\1":
        raise ValueError(f"{path} isn't a BAM file")
    k = 8 + struct.unpack_from("<i", s.data, 4)[0]
    s.fill(k + 4)
    n, k, refs = struct.unpack_from("<i", s.data, k)[0], k + 4, []
    for _ in range(n):
        s.fill(k + 4)
        size = struct.unpack_from("<i", s.data, k)[0]
        s.fill(k + 8 + size)
        refs.append((s.data[k + 4 : k + 3 + size].decode(), struct.unpack_from("<i", s.data, k + 4 + size)[0]))
        k += 8 + size
    if len(s.data) == k and not s.more():
        return refs, s.blocks.size, 0
    return refs, *s.place(k)


def fits(data: bytes, k: int, n_refs: int) -> int:
    """End of the record that may stand at ``k``; -1 if it can't, 0 if the data don't tell."""
    if len(data) < k + 36:
        return 0
    size, ref, pos, l_name, _, _, n_ops, _, l_seq, ref2, pos2 = struct.unpack_from("<iiiBBHHHiii", data, k)
    if not (-1 <= ref < n_refs and -1 <= ref2 < n_refs and pos >= -1 and pos2 >= -1 and l_name >= 1 and l_seq >= 0 and size >= 32 + l_name + 4 * n_ops + (l_seq + 1) // 2 + l_seq):
        return -1
    name = data[k + 36 : k + 36 + l_name]
    if len(name) == l_name and (name[-1] or not all(33 <= c <= 126 for c in name[:-1])):
        return -1
    return k + 4 + size


def first_record(s: Stream, n_refs: int) -> int | None:
    """Place in the first block of ``s`` where a chain of records begins; None if none begins there."""
    s.more()
    first = len(s.data)
    for k in range(first):
        at, links = k, 0
        while links < CHAIN:
            end = fits(s.data, at, n_refs)
            if end == 0 and s.more():
                continue
            if end < 0 or (end == 0 and at < len(s.data)):
                links = -1
                break
            if end == 0:
                break  # the file ends with the chain
            at, links = end, links + 1
            s.fill(at)
        if links > 0 or (links == 0 and at == k == len(s.data)):
            return k
    return None


def alignment_score(tags: bytes) -> int | None:
    k = 0
    while k + 3 <= len(tags):
        name, kind = tags[k : k + 2], chr(tags[k + 2])
        k += 3
        if name == b"AS" and kind in TAG_FORMAT:
            return struct.unpack_from(TAG_FORMAT[kind], tags, k)[0]
        if kind in "ZH":
            k = tags.index(b"\0", k) + 1
        elif kind == "B":
            k += 5 + TAG_BYTES[chr(tags[k])] * struct.unpack_from("<I", tags, k + 1)[0]
        else:
            k += TAG_BYTES[kind]
    return None


def decoded(data: bytes, refs: list) -> tuple:
    """A record's fields, from name on."""
    ref, pos, l_name, mapq, _, n_ops, flag, l_seq = struct.unpack_from("<iiBBHHHi", data)
    k = 32 + l_name
    name = data[32 : k - 1].decode()
    ops = np.frombuffer(data, "<u4", n_ops, k)
    k += 4 * n_ops
    seq = data[k : k + (l_seq + 1) // 2].hex().translate(BASES)[:l_seq]
    k += (l_seq + 1) // 2
    quals = data[k : k + l_seq]
    quals = None if quals[:1] == b"\xff" else quals
    return name, flag, refs[ref] if ref >= 0 else None, pos, mapq, alignment_score(data[k + l_seq :]), seq, quals, (ops & 15).astype(np.int32), (ops >> 4).astype(np.int32)


class Part(InputPartition):
    def __init__(self, begin: int, place: int | None, end: int):
        self.begin, self.place, self.end = begin, place, end


class BamReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split
        refs, self.first, self.at = read_header(path)
        self.refs = [n for n, _ in refs]

    def partitions(self):
        size = Blocks(self.path).size
        cuts = [self.first, *range(self.first + self.split, size, self.split), size]
        return [Part(a, self.at if k == 0 else None, b) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]

    def read(self, part: Part):
        blocks = Blocks(self.path)
        at = part.begin if part.place is not None else blocks.next_block(part.begin)
        s = None
        while at < part.end:  # the first block in which a record begins
            s = Stream(blocks, at)
            k = part.place if part.place is not None else first_record(s, len(self.refs))
            if k is not None and s.fill(k):
                s.drop(k)
                break
            at, s = blocks.read(at)[1], None
        rows = []
        while s is not None and s.fill(36):
            block, place = s.place(0)
            if block >= part.end:
                break
            size = struct.unpack_from("<i", s.data)[0] + 4
            if not s.fill(size):
                raise ValueError(f"{self.path} ends within a record")
            rows.append((self.path, block << 16 | place, *decoded(s.data[4:size], self.refs)))
            s.drop(size)
            if len(rows) == BATCH_ROWS:
                yield self.batch(rows)
                rows = []
        if rows:
            yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


class BamSource(DataSource):
    """``spark.read.format("bam").load(path)``; option splitBytes is the size of a task's part."""

    @classmethod
    def name(cls):
        return "bam"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return BamReader(self.options["path"], int(self.options.get("splitbytes", self.options.get("splitBytes", 32 << 20))))


def alignments(spark: SparkSession, path: str, split_bytes: int = 32 << 20) -> DataFrame:
    """(path, voffset, name, flag, ref, pos from 0, mapq, score, seq, quals, ops, lens): a row for each record of a BAM file.

    Absent qualities, references and scores are null.  ``voffset`` is the record's place in the file.
    """
    spark.dataSource.register(BamSource)
    return spark.read.format("bam").option("splitBytes", split_bytes).load(path)


def reference_pieces(spark: SparkSession, path: str, size: int = 1 << 16, index: str | None = None) -> DataFrame:
    """(ref, piece, bases): consecutive pieces of each sequence of a FASTA file, read at places that its .fai index tells."""
    fai = spark.read.csv(index or f"{path}.fai", sep="\t", schema="ref string, length long, offset long, line_bases long, line_width long")
    pieces = fai.where("length > 0").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / size))))
    pieces = pieces.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "ref", "piece")

    def run(batches):
        with open_file(path) as file:
            for batch in batches:
                ref, length, offset, bases, width, piece = (batch.column(c).to_pylist() for c in ("ref", "length", "offset", "line_bases", "line_width", "piece"))
                out = []
                for n, at, b, w, k in zip(length, offset, bases, width, piece, strict=True):
                    begin, end = k * size, min(n, (k + 1) * size)
                    first, last = (at + x // b * w + x % b for x in (begin, end - 1))
                    file.seek(first)
                    out.append(file.read(last + 1 - first).translate(None, b"\r\n").decode())
                yield pa.RecordBatch.from_pydict({"ref": ref, "piece": pa.array(piece, pa.int64()), "bases": out})

    return pieces.mapInArrow(run, "ref string, piece long, bases string")


def with_reference(reads: DataFrame, pieces: DataFrame, size: int = 1 << 16) -> DataFrame:
    """``reads`` (path, voffset, ref, pos, ops, lens, ...) with ref_part, the bases that the alignment spans.

    A read meets the one piece, or the few, that it touches in a join by reference and piece.
    Reads without a place or operations have none.
    """
    spans = F.aggregate(F.arrays_zip("ops", "lens"), F.lit(0).cast("long"), lambda s, x: s + F.when(x["ops"].isin(0, 2, 3, 7, 8), x["lens"]).otherwise(0))
    at = reads.select("path", "voffset", "ref", "pos", spans.alias("span")).where("ref is not null and pos >= 0 and span > 0")
    at = at.withColumn("piece", F.explode(F.sequence(F.floor(F.col("pos") / size), F.floor((F.col("pos") + F.col("span") - 1) / size))))
    begin = F.greatest(F.col("pos") - F.col("piece") * size, F.lit(0)).cast("int")
    end = F.least(F.col("pos") + F.col("span") - F.col("piece") * size, F.lit(size)).cast("int")
    cut = at.join(pieces, ["ref", "piece"]).select("path", "voffset", "piece", F.substring("bases", begin + 1, end - begin).alias("bases"))
    found = cut.groupBy("path", "voffset").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece", "bases"))), lambda x: x["bases"]), "").alias("ref_part"))
    return reads.join(found, ["path", "voffset"], "left")
