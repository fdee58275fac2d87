"""Document fingerprints (operator 8): a Merkle tree over pieces, paragraphs and sections.

Paragraphs are lines, cut into pieces at sentence ends, and long sentences where a rolling hash
of the last few characters says so; sections are runs of paragraphs that end where a paragraph's own hash
says so.  Boundaries follow from what is near them, so an edit moves no distant one, but in
stretches without any (one character over and over), which are cut by length.  The printed
tree lets two fingerprints be compared branch by branch.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: Pieces of over ``LONG`` characters are cut where a rolling hash of ``WINDOW`` characters says so, at one place in ``PIECE``, and what is over ``LONGEST`` by length.
LONG, PIECE, WINDOW, LONGEST = 128, 64, 8, 512
_SENTENCES = re.compile(r"[^\n]*?[.!?;|](?=\s)|[^\n]+")
#: Characters that are looked at together.
BLOCK = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def rolling_ends(text: str) -> list[int]:
    """Places after which ``text`` is cut: each follows from the ``WINDOW`` characters before it alone."""
    out = []
    for a in range(0, len(text), BLOCK):
        back = min(a, WINDOW - 1)
        c = np.frombuffer(text[a - back : a + BLOCK].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        n = len(c) - (WINDOW - 1)
        if n <= 0:
            continue
        roll = np.zeros(n, np.uint64)
        for k in range(WINDOW):
            roll = (roll ^ c[k : k + n]) * _MIX
        out += (np.flatnonzero((roll >> np.uint64(32)) % np.uint64(PIECE) == 0) + a - back + WINDOW).tolist()
    return out


def line_pieces(lines: list[str]) -> list[list[str]]:
    """Pieces of each line, which make the line and follow from it alone."""
    out = [_SENTENCES.findall(line) for line in lines]
    long = [s for line in out for s in line if len(s) > LONG]
    if not long:
        return out
    # all long sentences together; a cut whose window would begin in the one before isn't theirs
    ends, k, start = rolling_ends("".join(long)), 0, 0
    for n, line in enumerate(out):
        if not any(len(s) > LONG for s in line):
            continue
        parts = []
        for s in line:
            if len(s) <= LONG:
                parts.append(s)
                continue
            stop, at = start + len(s), 0
            while at < len(s):
                while k < len(ends) and ends[k] < start + max(at + 1, WINDOW):
                    k += 1
                end = min(len(s), at + LONGEST, ends[k] - start if k < len(ends) and ends[k] < stop else len(s))
                parts.append(s[at:end])
                at = end
            start = stop
        out[n] = parts
    return out


def _hash(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle(text: str | None) -> str:
    """``root/section;section``, a section ``hash=paragraph+paragraph``, a paragraph ``piece.piece``.

    A paragraph is a line, so line feeds follow from the paragraphs.  A node's hash is that of
    its branches' hashes (128 bits each), up to the root, which is printed whole; of a piece and
    a section the first 32 bits are printed, of a piece its length in hex as well.  Null counts
    as empty; equal texts have equal fingerprints.
    """
    sections, paragraphs, shown = [], [], []

    def close():
        node = _hash(b"s" + b"".join(paragraphs))
        sections.append(node)
        out.append(node[:4].hex() + "=" + "+".join(shown))
        paragraphs.clear()
        shown.clear()

    out: list[str] = []
    for parts in line_pieces((text or "").split("\n")):
        marks = [_hash(p.encode("utf-8", "surrogatepass")) for p in parts]
        node = _hash(b"p" + b"".join(marks))
        paragraphs.append(node)
        shown.append(".".join(m[:4].hex() + format(len(p), "x") for m, p in zip(marks, parts, strict=True)))
        if not parts or node[0] % 4 == 0:
            close()
    if paragraphs:
        close()
    return _hash(b"r" + b"".join(sections)).hex() + "/" + ";".join(out)


def aligned(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Ascending index pairs of equal entries, in one order for both: ends first, then a longest run of ascending matches."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    at: dict[str, list[int]] = {}
    for j in range(len(b) - tail - 1, head - 1, -1):
        at.setdefault(b[j], []).append(j)
    # the k-th occurrence here is that there
    found = [(i, places.pop()) for i in range(head, len(a) - tail) if (places := at.get(a[i]))]
    ends: list[int] = []  # of the best ascending run of each length, its last match
    before, runs = [-1] * len(found), []
    for k, (_, j) in enumerate(found):
        n = bisect.bisect_left(ends, j)
        before[k] = runs[n - 1] if n else -1
        ends[n : n + 1], runs[n : n + 1] = [j], [k]
    middle, k = [], runs[-1] if runs else -1
    while k >= 0:
        middle.append(found[k])
        k = before[k]
    return [(i, i) for i in range(head)] + middle[::-1] + [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]


def _gaps(pairs: list[tuple[int, int]], n: int, m: int):
    """Slices of both sides between the matches, where both have entries."""
    i = j = 0
    for x, y in [*pairs, (n, m)]:
        if x > i and y > j:
            yield slice(i, x), slice(j, y)
        i, j = x + 1, y + 1


def _chars(paragraph: str) -> int:
    return sum(int(p[8:], 16) for p in paragraph.split(".") if p)


def likeness(a: str, b: str) -> float:
    """Share of both texts' characters in equal branches, in order (0 to 1); 1 for equal roots.

    Equal sections are matched first; between those that differ, equal paragraphs, and between
    these, equal pieces.
    """
    if a[:32] == b[:32]:
        return 1.0
    one, two = (x.partition("/")[2].split(";") for x in (a, b))
    lines = lambda sections: [p for s in sections for p in s.partition("=")[2].split("+")]
    total, both, found = sum(map(_chars, lines(one) + lines(two))), 0, aligned(one, two)
    both += sum(_chars(p) for i, _ in found for p in lines([one[i]]))
    for x, y in _gaps(found, len(one), len(two)):
        left, right = lines(one[x]), lines(two[y])
        same = aligned(left, right)
        both += sum(_chars(left[i]) for i, _ in same)
        for u, v in _gaps(same, len(left), len(right)):
            p, q = ([k for n in side for k in n.split(".") if k] for side in (left[u], right[v]))
            both += sum(int(p[i][8:], 16) for i, _ in aligned(p, q))
    return 2 * both / total if total else 0.0


def changed_sections(a: str, b: str) -> list[int]:
    """Numbers of ``a``'s sections that ``b`` lacks: the branches that locate an edit."""
    if a[:32] == b[:32]:
        return []
    known = {s[:8] for s in b.partition("/")[2].split(";")}
    return [i for i, s in enumerate(a.partition("/")[2].split(";")) if s[:8] not in known]


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by the beginning of the following one."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_with_next(docs: DataFrame) -> DataFrame:
    """OUT for each row of ``docs`` (doc_id, text), compared with the next in order and an edit by it.

    Order: doc_id (nulls first), then text; after the last comes the first.  Each range of
    ids is one task's, sorted by Spark and streamed; the first row of the next range comes
    along.  Repeated rows follow each other; a single row follows itself; further columns go.
    """
    spark = docs.sparkSession
    shared.text_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("_ord", F.coalesce("doc_id", F.lit(shared.MIN_LONG)))
    low, cuts = shared.order_bounds(rows, "_ord", shared.parts(spark))
    bounds, n = np.array(cuts, np.int64), len(cuts) + 1

    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, key.to_numpy(), side="right").astype(np.int32))

    range_of.__annotations__ = {"key": pd.Series, "return": pd.Series}
    rows = rows.withColumn("_range", F.pandas_udf(range_of, "int")("_ord"))
    # the head of each range also goes, as a lookahead, to the range before it (the first's to the last)
    head = F.col("_ord").isin([]) if low is None else (F.col("_ord") == low) | F.col("_ord").isin([int(c) for c in cuts])
    before = F.pmod(F.col("_range") - 1, F.lit(n))
    to = F.when(head, F.array(F.struct(F.col("_range").alias("r"), F.lit(False).alias("ahead")), F.struct(before.alias("r"), F.lit(True).alias("ahead")))).otherwise(F.array(F.struct(F.col("_range").alias("r"), F.lit(False).alias("ahead"))))
    rows = rows.withColumn("_to", F.explode(to)).select("doc_id", "text", "_to.r", "_to.ahead")
    placed = rows.repartitionById(n, F.col("r")).sortWithinPartitions("r", "ahead", "doc_id", "text")

    def run(batches):
        held = None  # (range, id, text, fingerprint) whose next row is still to come
        for pdf in batches:
            out = []
            for doc, text, r, ahead in pdf.itertuples(index=False):
                mark = merkle(text)
                if held is not None and held[0] == r:
                    _, own, mine, print_ = held
                    new = edited(mine, text)
                    other = merkle(new)
                    sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((own, len(mine), sha, print_, other, likeness(print_, other), likeness(print_, mark)))
                held = None if ahead else (r, doc, text, mark)
            got = pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])
            got["doc_id"] = pd.array([None if pd.isna(d) else int(d) for d in got["doc_id"]], dtype="Int64")
            yield got

    return placed.mapInPandas(run, OUT)


def op8_merkle_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_with_next(shared.table(spark, sf_dir, "documents"))
