"""Corpus pipeline: language ID, near-dedup, PII, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and all but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.llm import language_id, mixing, near_dup, packing, pii, shared

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Mean over a document's words of the likeliest language's posterior.
LEAST_CERTAINTY = 0.4
#: Epochs of the rarest source at most.
REPEATS = 1.5


def identify_language(spark, docs, sf_dir):
    """Reject documents without a language ('und') or whose words are too uncertain; set lang.

    A document that mixes languages stays if each word is certain.  Null and empty texts are 'und'.
    """
    crf = language_id.fit(docs)
    rows = language_id.identify(docs.select(*COLUMNS), crf)
    kept = rows.where((F.col("lang_pred") != "und") & (F.col("certainty") >= LEAST_CERTAINTY))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark, docs, sf_dir):
    """Keep one document of each group: the one with the smallest doc_id.

    Rows that repeat an id and rows without one are documents too: each gets a key above all ids,
    so of their group one row stays, a document with an id of its own before them.
    """
    docs = docs.select(*COLUMNS)
    repeated = docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id")
    repeated = shared.stage(repeated, "repeated")
    odd = docs.join(repeated, "doc_id", "left_semi").select(*COLUMNS).union(docs.where("doc_id is null"))
    top = F.broadcast(docs.agg(F.coalesce(F.max("doc_id"), F.lit(0)).alias("_top")))  # one row
    odd = odd.withColumn("_nth", F.monotonically_increasing_id()).join(top)
    odd = shared.stage(odd.select((F.col("_top") + 1 + F.col("_nth")).alias("_key"), *COLUMNS), "odd")
    single = docs.where("doc_id is not null").join(repeated, "doc_id", "left_anti").select(F.col("doc_id").alias("_key"), *COLUMNS)
    keyed = single.union(odd)
    kept = near_dup.near_duplicates(keyed.select(F.col("_key").alias("doc_id"), "text"))
    gone = kept.where(~F.col("kept")).select(F.col("doc_id").alias("_key"))
    return keyed.join(gone, "_key", "left_anti").select(*COLUMNS)


def redact_personal_data(spark, docs, sf_dir):
    """Replace every span by a mark; n_chars follows the text.  Null texts stay null; rows repeat as they are."""
    rows = pii.detect(docs.select(*COLUMNS), pii.fit(docs), redacted=True).withColumn("text", F.col("redacted"))
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark, docs, sf_dir):
    """Repeat documents of the rarer sources; each stays at least once.  A null source is a source."""
    return mixing.mix_sources(docs.select(*COLUMNS), repeats=REPEATS).select(*COLUMNS)


def pack(spark, docs, sf_dir):
    """Places of all pieces in sequences, with their token ids.  A null text counts as empty."""
    return packing.best_fit_pack(packing.tokenize_pieces(docs), order=("doc_id", "piece", "ids"))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("mixing", mix),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = shared.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = shared.stage(docs, name)
    return docs
