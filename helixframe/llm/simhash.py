"""SimHash near-duplicates (operator 11) by deletion-variant signatures.

A fingerprint is cut into ``len(CUTS)`` segments, fewer than the bits that may differ, so that
of two linked fingerprints one segment differs by at most one bit.  Each segment is indexed
once for each of its bits, with this bit left out: segments that differ by at most one bit
have such a variant in common.  Equal variants meet in an equality join by sorted ranges of
(variant, fingerprint), and what meets is verified on all 64 bits.

Equal fingerprints count once.  The first pass over the ranges links neighbours, and all pairs
of a variant with few fingerprints.  Variants with many, or on both sides of a task's end,
that still hold several components have their remaining pairs tried: fingerprints outside a
variant's main component meet its members in cells of bounded size (as in ``near_dup``), and
only links leave a task.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import components, near_dup, shared

SHINGLE, DISTANCE, HASH_SEED = 4, 4, 42
#: First bit and width of each segment: three, so that of five or fewer differing bits one segment has at most one.
CUTS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints of one variant of which all pairs are tried at once.
FEW = 64
#: Rows of one variant that a task holds at once.
HELD_ROWS = 100_000
INDEX_BATCH = "50000"
#: Bytes of text that are cut into words at once.
BLOCK = 1 << 20
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def shingle_hashes(text: bytes, size: int = SHINGLE):
    """Yields hashes of all windows of ``size`` words, in order, for blocks of a whole text in UTF-8."""
    text, start, before, digest = text.lower(), 0, [], xxhash.xxh64_intdigest
    told = False
    while start < len(text):
        end = min(start + BLOCK, len(text))
        gap = _GAP.search(text, end) if end < len(text) else None
        end = gap.start() if gap else len(text)
        words, start = before + text[start:end].split(), end
        before = words[max(0, len(words) - size + 1) :]
        if len(words) >= size or start >= len(text) and words and not told:
            line = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            begins = np.concatenate([[0], ends[:-1] + 1])
            n = max(1, len(words) - size + 1)
            last = ends[min(size, len(words)) - 1 :]
            yield np.array([digest(line[a:b], HASH_SEED) for a, b in zip(begins[:n].tolist(), last.tolist(), strict=True)], np.uint64)
            told = True


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """64 bits, each set where it is set in over half of the shingles' hashes; 0 where there is no word."""
    ones, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, size):
        for i in range(0, len(h), 4096):
            bits = np.unpackbits(h[i : i + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int32)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0]) if n else 0


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) for each row of ``docs`` (doc_id, text); fp is the fingerprint as a signed long."""
    shared.text_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            fp = np.array([fingerprint(t or b"", size) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def variants(fp: Column) -> Column:
    """Array of longs: each segment with each of its bits left out, numbered by segment and bit."""
    out = []
    for k, (first, width) in enumerate(CUTS):
        part = F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        for bit in range(width):
            number = (k << 8 | bit) << 32
            out.append(part.bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << bit)).cast("long")).bitwiseOR(F.lit(number).cast("long")))
    return F.array(*out)


def first_shared(x: np.ndarray) -> np.ndarray:
    """Number (segment and bit) of the first variant that two fingerprints with the difference ``x`` share, -1 for none."""
    out = np.full(len(x), -1, np.int64)
    for k, (first, width) in reversed(list(enumerate(CUTS))):
        part = (x >> np.uint64(first)) & np.uint64((1 << width) - 1)
        near = np.bitwise_count(part) <= 1
        bit = np.where(part == 0, 0, np.bitwise_count(part - (part != 0)))  # a power of two less one has as many bits as its place
        out[near] = (k << 8 | bit.astype(np.int64))[near]
    return out


def variant_pairs(key: np.ndarray, fp: np.ndarray, distance: int, few: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked (i, j) among rows in order of (key, fp): neighbours, and all pairs of keys with at most ``few`` rows.

    A pair of such a key is told only by the first variant that it shares.
    """
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    size = np.repeat(np.diff(cut), np.diff(cut))
    bits, found = fp.view(np.uint64), []
    for d in range(1, min(max(2, few), int(size.max())) if len(size) else 0):
        i = np.flatnonzero((key[d:] == key[:-d]) & ((size[:-d] <= few) | (d == 1)))
        x = bits[i] ^ bits[i + d]
        ok = np.bitwise_count(x) <= distance
        i, x = i[ok], x[ok]
        if d > 1:
            i = i[first_shared(x) == key[i] >> 32]
        found.append((i, i + d))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2


def index_links(rows: DataFrame, distance: int, few: int, held_rows: int) -> tuple[DataFrame, DataFrame]:
    """From rows (key, fp): links (a, b) as far as the first pass finds them, and the keys with pairs left."""
    spark = rows.sparkSession

    def run(batches):
        held, flushed, first, last = None, set(), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = tuple(batch.column(c).to_numpy() for c in ("key", "fp"))
            key, fp = new if held is None else (np.concatenate(x) for x in zip(held, new, strict=True))
            first, last = key[0] if first is None else first, key[-1]
            whole = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
            if not whole and len(key) > held_rows:
                flushed.add(int(key[-1]))
                whole = len(key) - 1  # a huge one goes on with its last row
            held = key[whole:], fp[whole:]
            if whole:  # with the row that a huge key goes on with, its neighbour
                yield from links(*((key, fp) if key[whole - 1] == key[whole] else (key[:whole], fp[:whole])), flushed)
        if held is not None:
            yield from links(*held, flushed)
            ends = np.array(sorted({int(first), int(last)} | flushed))
            yield pa.RecordBatch.from_pydict({"a": np.zeros(len(ends), np.int64), "b": ends, "kind": np.full(len(ends), 1, np.int32)})

    def links(key, fp, flushed):
        i, j = variant_pairs(key, fp, distance, few)
        a, b = np.minimum(fp[i], fp[j]), np.maximum(fp[i], fp[j])
        one = np.unique(np.stack([a, b], axis=1), axis=0)
        yield pa.RecordBatch.from_pydict({"a": one[:, 0].copy(), "b": one[:, 1].copy(), "kind": np.zeros(len(one), np.int32)})
        many, counts = np.unique(key, return_counts=True)
        many = many[counts > few]
        yield pa.RecordBatch.from_pydict({"a": np.zeros(len(many), np.int64), "b": many, "kind": np.full(len(many), 1, np.int32)})

    placed = rows.repartitionByRange(shared.parts(spark), "key", "fp").sortWithinPartitions("key", "fp")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", INDEX_BATCH)  # these rows are short
    found = shared.stage(placed.mapInArrow(run, "a long, b long, kind int"), "found")
    shared.text_batches(spark)
    return found.where("kind = 0").select("a", "b"), found.where("kind = 1").select(F.col("b").alias("key")).distinct()


def cell_links(fp: np.ndarray, label: np.ndarray, side: np.ndarray, stray: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Index pairs (probe, member) within the distance, one for each two components of a cell."""
    bits, out, joined = fp.view(np.uint64), [], set()
    one, two = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
    for k in range(0, len(one), 256):
        rows = one[k : k + 256]
        ok = np.bitwise_count(bits[rows, None] ^ bits[two]) <= distance
        i, j = np.nonzero(ok & (label[rows, None] != label[two]) & (~stray[two] | (fp[rows, None] < fp[two])))
        for x, y in zip(rows[i].tolist(), two[j].tolist(), strict=True):
            met = (min(label[x], label[y]), max(label[x], label[y]))
            if met not in joined:
                joined.add(met)
                out.append((x, y))
    return out


def remaining_links(members: DataFrame, comp: DataFrame, distance: int) -> DataFrame:
    """(a, b): links between members (key, fp) of one key that lie in different components, enough to join these."""
    slim = members.select("key", F.lit(0).alias("tree"), F.col("fp").alias("doc_id"), F.lit(1).cast("long").alias("n"))
    dealt = near_dup._dealt(slim, comp)

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["doc_id"].to_numpy()
        got = cell_links(ids, *(pdf[c].to_numpy() for c in ("label", "side", "stray")), distance) if pdf["side"].nunique() > 1 else []
        return pd.DataFrame({"a": [ids[i] for i, _ in got], "b": [ids[j] for _, j in got]}).astype("int64")

    return dealt.groupBy(*near_dup.CELL_KEY).applyInPandas(links, "a long, b long").distinct()


def simhash_groups(docs: DataFrame, size: int = SHINGLE, distance: int = DISTANCE, few: int = FEW, held_rows: int = HELD_ROWS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs`` (doc_id, text; other columns go).

    Null and empty texts have fingerprint 0, linked like any other.  Rows that repeat a doc_id
    are one document as far as links go and each get a row; rows with a null doc_id are left
    out of links and have a null component.  ``distance`` may be up to ``2 * len(CUTS) - 1``;
    ``few`` and ``held_rows`` change the work, never the result.
    """
    if distance > 2 * len(CUTS) - 1:
        raise ValueError(f"{len(CUTS)} segments find distances of at most {2 * len(CUTS) - 1}")
    signed = shared.stage(fingerprints(docs, size), "fingerprints")
    named = signed.where("doc_id is not null")
    distinct = shared.stage(named.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "distinct")
    # an id with several texts joins their groups
    several = named.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("_hi")).where("a <> _hi").select("doc_id", "a")
    several = named.join(several, "doc_id").where("a <> fp").select("a", F.col("fp").alias("b"))
    index = lambda fps: fps.select(F.explode(variants(F.col("fp"))).alias("key"), "fp")
    links, left = index_links(index(distinct), distance, few, held_rows)
    comp = shared.stage(components.connected_components(links.union(several)), "labels")
    left = shared.stage(left, "left")
    members = index(distinct).join(left, "key", "left_semi")
    more = shared.stage(remaining_links(members, comp, distance), "links")
    if more.limit(1).count():
        comp = shared.stage(near_dup._joined(comp, more), "components")

    label = distinct.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "doc_id", F.coalesce("component", "fp").alias("label"))
    least = label.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    group = label.join(least, "label").select("fp", "component_id")
    out = signed.join(group, "fp", "left")
    named_only = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), named_only.alias("component_id"))


def op11_simhash_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(shared.table(spark, sf_dir, "documents"))
