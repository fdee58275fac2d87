"""Importance resampling towards a target distribution (operator 13): two Arrow passes over hashed n-grams.

The first pass counts buckets: each task adds up one vector with np.bincount, and treeReduce
merges the tasks' vectors.  The second gathers each feature's gain from a broadcast vector and
sums documents with weighted np.bincount.  A vector has ``BUCKETS`` numbers whatever the corpus.
Documents are drawn without replacement by their weight plus Gumbel noise from their ids.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import manifest, shared

BUCKETS, SHORTEST, LONGEST = 10_000, 1, 1
LEAST_WORDS, PERCENT, SEED = 20, 10, 2024
#: Bytes of text that are cut into words at once.
BLOCK = 1 << 20
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9a-z\x80-\xff]")


def buckets(text: bytes, shortest: int = SHORTEST, longest: int = LONGEST):
    """Yields (number of words, buckets of the n-grams that end in them) for blocks of a whole text in UTF-8."""
    text, start, before = text.lower(), 0, []  # of bytes: A-Z alone
    while start < len(text):
        end = min(start + BLOCK, len(text))
        gap = _GAP.search(text, end) if end < len(text) else None
        end = gap.start() if gap else len(text)
        new = _WORD.findall(text, start, end)
        words, start = before + new, end
        found = []
        for n in range(shortest, longest + 1):
            rest = words[max(0, len(before) - n + 1) :]
            grams = rest if n == 1 else map(b" ".join, zip(*(rest[i:] for i in range(n)), strict=False))
            found.append(np.fromiter(map(zlib.crc32, grams), np.uint32) % np.uint32(BUCKETS))
        before = words[len(words) - longest + 1 :] if longest > 1 else []
        yield len(new), np.concatenate(found).astype(np.int64)


def texts_of(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """Features of all rows (text) by bucket: one vector for each task, merged in a tree."""
    shared.text_batches(docs.sparkSession)

    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in texts_of(batch):
                for _, found in buckets(text):
                    total += np.bincount(found, minlength=BUCKETS)
        yield pa.RecordBatch.from_pydict({"counts": pa.array([total.tobytes()], pa.binary())})

    vectors = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "counts binary").rdd
    if not vectors.getNumPartitions():
        return np.zeros(BUCKETS, np.int64)
    return vectors.map(lambda r: np.frombuffer(bytes(r[0]), np.int64)).treeReduce(np.add, depth=3)


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket, 1000 times the log ratio of its smoothed shares, rounded down."""
    s, t = corpus.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS))))


def weigh(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) for each row of ``docs`` (doc_id, text)."""
    shared.text_batches(docs.sparkSession)
    shared_gain = shared.broadcast(docs.sparkSession, gain)

    def score(batches):
        for batch in batches:
            n = batch.num_rows
            words, features, weight = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
            held, of, size = [], [], 0

            def add():
                doc = np.repeat(np.array(of, np.int64), [len(x) for x in held])  # noqa: B023
                weight[:] += np.bincount(doc, weights=shared_gain.value[np.concatenate(held)], minlength=n)  # noqa: B023

            for i, text in enumerate(texts_of(batch)):
                for k, found in buckets(text):
                    words[i] += k
                    features[i] += len(found)
                    held.append(found)
                    of.append(i)
                    size += len(found)
                    if size > BLOCK:
                        add()
                        held, of, size = [], [], 0
            if held:
                add()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words), pa.array(features), pa.array(weight.astype(np.int64))], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(score, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for each row of ``docs`` (doc_id, text; other columns go).

    ``target`` (text) is the distribution to reach.  Of the rows with ``least_words`` words,
    ``percent`` in a hundred with the highest scores have a rank from 1, ties to the smaller
    id; all others have none.  Null and empty texts have no features and weight 0, a null id is
    hashed as an empty one and comes first among ties, repeated rows are drawn one by one, an
    empty table gives no rows, and an empty target makes the rarest buckets the best.
    """
    gain = gains(bucket_counts(docs), bucket_counts(target))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = shared.stage(weigh(docs, gain).withColumn("score", F.col("weight") + noise), "scored")
    able = scored.where(F.col("n_words") >= least_words).withColumn("_all", F.lit("")).withColumn("_down", F.negative("score"))
    ranked = manifest.places(able, "_all", "_down", "doc_id")
    rank = F.when((F.col("pos") + 1) * 100 <= F.col("n") * percent, F.col("pos") + 1)
    columns = ["doc_id", "n_features", "weight", "score"]
    rest = scored.where(F.col("n_words") < least_words)
    return ranked.select(*columns, rank.alias("rank")).union(rest.select(*columns, F.lit(None).cast("long")))


def op13_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "benchmark"))


SQL = rf"""
WITH crc AS {manifest.CRC_TABLE},
low AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
aim AS (SELECT list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
f AS (SELECT doc_id, unnest(w) AS x FROM low), a AS (SELECT unnest(w) AS x FROM aim),
each AS (SELECT DISTINCT x, hex(encode(x)) AS h FROM (SELECT x FROM f UNION ALL SELECT x FROM a)),
bytes AS (SELECT x, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS b FROM each),
slot AS (SELECT x, {manifest.CRC} % 10000 AS k FROM bytes, crc),
s AS (SELECT k, count(*) AS s FROM f JOIN slot USING (x) GROUP BY 1), t AS (SELECT k, count(*) AS t FROM a JOIN slot USING (x) GROUP BY 1),
n AS (SELECT (SELECT count(*) FROM f)::DOUBLE AS s_all, (SELECT count(*) FROM a)::DOUBLE AS t_all),
gain AS (SELECT k, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000)))) AS g FROM s LEFT JOIN t USING (k), n),
w AS (SELECT doc_id, sum(g) AS weight FROM f JOIN slot USING (x) JOIN gain USING (k) GROUP BY 1),
d AS (SELECT doc_id, len(low.w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
             floor(-1000 * ln(-ln((('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS noise FROM low LEFT JOIN w USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS r, count(*) OVER () AS n FROM d WHERE n_features >= 20)
SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN r <= n // 10 THEN r END AS rank FROM d LEFT JOIN r USING (doc_id)
"""
