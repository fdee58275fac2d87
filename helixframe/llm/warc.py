"""WARC archives (operator 6): each record a zstd frame, over a dictionary made from the records.

An archive is a leading skippable frame that holds the dictionary, then one frame for each
record.  Archives are cut at a bounded size, so each is read by one task.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

LEAST_REVISIT = 100
#: Payload bytes of an archive, of the records a dictionary is made from, and of a dictionary.
ARCHIVE_BYTES, SAMPLE_BYTES, DICT_BYTES = 64 << 20, 2 << 20, 48 << 10
# Fixed values of the public formats.
DICT_FRAME = 0x184D2A5D
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"

SUMMARY = "path string, n_records long"
RECORD = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_id(name: str) -> str:
    """A response's record is named by page and payload, so a revisit knows it; a page repeated as it is repeats its name."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, serial: str) -> bytes:
    """One WARC record; a revisit (``refers_to``) has no payload of its own and names its response's record."""
    revisit = refers_to is not None
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(f"{serial}:{page_id}") if revisit or page_id is None else record_id(f"{page_id}:{digest}")),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("X-Payload-Length", str(size)),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    if page_id is not None:
        head.append(("X-Page-Id", str(page_id)))
    if url is not None:
        head.append(("WARC-Target-URI", "".join(c if c.isprintable() and c != "%" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url)))
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(f"{refers_to}:{digest}")), ("X-Refers-To-Page", str(refers_to))]
    body = HTTP if revisit else HTTP + payload
    head.append(("Content-Length", str(len(body))))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head).encode()
    return VERSION + b"\r\n" + lines + b"\r\n" + body + b"\r\n\r\n"


def make_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; few or tiny records serve as a plain one."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICT_BYTES:] or b"\r\n"


def _dictionary(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data)


class ArchiveWriter:
    """Writes records to numbered archives in a shared folder, a new one when one is full."""

    def __init__(self, folder: str, stem: str):
        self.folder, self.stem, self.made, self.held, self.size, self.out = folder, stem, [], [], 0, None

    def add(self, record: bytes) -> None:
        if self.out is None:
            self.held.append(record)
            if sum(map(len, self.held[-1:])) + self.size >= SAMPLE_BYTES:
                self._open()
        else:
            self.out.write(self.zstd.compress(record))
        self.size += len(record)
        self.n = getattr(self, "n", 0) + 1
        if self.size >= ARCHIVE_BYTES:
            self.finish()

    def _open(self) -> None:
        import zstandard

        data = make_dictionary([r[: 64 << 10] for r in self.held])
        self.zstd = zstandard.ZstdCompressor(level=6, dict_data=_dictionary(data), write_checksum=True)
        self.out = shared.AtomicFile(self.folder, f"{self.stem}-{len(self.made):04d}.warc.zst")
        self.out.write(struct.pack("<II", DICT_FRAME, len(data)) + data)
        for r in self.held:
            self.out.write(self.zstd.compress(r))
        self.held = []

    def finish(self) -> None:
        if self.out is None and not self.held:
            return
        if self.out is None:
            self._open()
        self.made.append((self.out.commit(), self.n))
        self.out, self.size, self.n = None, 0, 0


def read_archive(source) -> Iterator[dict]:
    """Records of an open archive, in order: headers by lower-case name, payload under None."""
    import zstandard

    magic, size = struct.unpack("<II", source.read(8))
    if magic != DICT_FRAME:
        raise ValueError("no leading dictionary frame")
    zstd = zstandard.ZstdDecompressor(dict_data=_dictionary(source.read(size)))
    with zstd.stream_reader(source, read_size=1 << 20, read_across_frames=True) as stream:
        buf = b""
        while True:
            while (at := buf.find(b"\r\n\r\n")) < 0:
                more = stream.read(1 << 18)
                if not more:
                    if buf:
                        raise ValueError("the archive ends within a record")
                    return
                buf += more
            lines = buf[:at].decode().split("\r\n")
            if lines[0].encode() != VERSION:
                raise ValueError("not a WARC record")
            head: dict = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
            end = at + 4 + int(head["content-length"]) + 4
            if len(buf) < end:
                pieces, have = [buf], len(buf)
                while have < end:
                    more = stream.read(max(1 << 18, end - have))
                    if not more:
                        raise ValueError("the archive ends within a record")
                    pieces.append(more)
                    have += len(more)
                buf = b"".join(pieces)
            head[None] = buf[at + 4 + len(HTTP) : end - 4]
            yield head
            buf = buf[end:]


def write_archives(pages: DataFrame, folder: str) -> list[tuple[str, int]]:
    """Archive ``pages`` (page_id, url, html); returns (path, records) of each archive.

    Of rows with equal payloads of at least ``LEAST_REVISIT`` bytes, those with the smallest
    page_id are responses (so are rows whose group has no id), the others revisits; only
    responses' payloads travel.  Null html is an empty payload; an empty table, no archive.
    """
    spark = pages.sparkSession
    shared.text_batches(spark)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("size", F.length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    groups = rows.where(F.col("size") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n"))
    rows = rows.join(groups.where("_n > 1").drop("_n"), "digest", "left")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("_first")), F.col("_first"))
    rows = rows.withColumn("refers_to", refers).withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")))

    def run(batches):
        part = TaskContext.get().partitionId()
        out, serial = ArchiveWriter(folder, f"part-{part:06d}"), 0
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                page, refers = (None if pd.isna(x) else int(x) for x in (r.page_id, r.refers_to))
                out.add(record_bytes(page, r.url, r.payload or b"", int(r.size), r.digest, refers, f"{part}:{serial}"))
                serial += 1
        out.finish()
        yield pd.DataFrame(out.made, columns=["path", "n_records"])

    found = rows.select("page_id", "url", "payload", "size", "digest", "refers_to").mapInPandas(run, SUMMARY).collect()
    return [tuple(r) for r in found]  # one row for each archive


def read_archives(spark: SparkSession, folder: str, archives: list[tuple[str, int]]) -> DataFrame:
    """Every record of the archives; digests of responses are taken anew from their payloads."""

    def run(batches):
        fs, _ = shared.filesystem(folder)
        for pdf in batches:
            for path in pdf["path"]:
                rows, held = [], 0
                with fs.open_input_file(path) as source:
                    for h in read_archive(source):
                        revisit = h["warc-type"] == "revisit"
                        payload = None if revisit else h[None]
                        size = int(h["x-payload-length"]) if revisit else len(payload)
                        digest = h["warc-payload-digest"].removeprefix("sha256:") if revisit else hashlib.sha256(payload).hexdigest()
                        page, to = h.get("x-page-id"), h.get("x-refers-to-page")
                        rows.append((page and int(page), h.get("warc-target-uri"), payload, size, digest, h["warc-type"], to and int(to)))
                        held += len(payload or b"")
                        if held > 4 << 20 or len(rows) >= 1000:
                            yield _frame(rows)
                            rows, held = [], 0
                yield _frame(rows)

    listed = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(sorted(archives))], "k int, path string")
    listed = listed.repartition(max(1, len(archives)), "k") if archives else listed
    return listed.mapInPandas(run, RECORD)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in RECORD.split(", ")])
    for c in ("page_id", "refers_to"):
        out[c] = pd.array(out[c].tolist(), dtype="Int64")
    return out


def op6_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared.new_path(spark, "warc")
    archives = write_archives(shared.table(spark, sf_dir, "pages"), folder)
    rows = read_archives(spark, folder, archives)
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
d AS (SELECT page_id, n, sha256(h) AS digest, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY h) END AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM d
"""
