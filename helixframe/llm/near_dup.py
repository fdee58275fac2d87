"""MinHash near-duplicates (operator 7) by an LSH forest.

Every distinct shingle set gets a signature of ``TREES * DEPTH`` minhashes.  Tree t orders
the signatures from position ``t * DEPTH`` on (cyclically).  Documents that share a tree's
first ``DEPTH`` values form a region.  Orders are range partitions of the trees' rows, so the
rows of a large region lie in several tasks, each of which links its ends to its neighbours.

A first pass over a few trees gives each document two candidates: the likeliest of its neighbours
in the orders (the longest common prefixes) and the likeliest of its regions' first members.
Those that hold join most of each group, by at most two links a member.  The second pass, over all
trees, looks only at members of different components: in a region of up to ``REGION`` members
every such pair is a candidate.  A larger region is ordered by further values, deeper where it
is denser, and each member and its neighbour in that order are candidates.  Candidates are
confirmed on the full sets.

Regions that are large, or may lie in several tasks, and still hold several components have
their remaining pairs tried, each in the first tree that brings it together.  Only members
outside a region's main component are dealt out as probes; they meet its members in cells by
set size and a hash, first by signatures, then those that are left by their full sets.  Only
links leave a task.

At a similarity of 0.75 two documents meet in some tree with probability
1 - (1 - 0.75**4)**32 > 0.99999.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import components, shared, shingles

TREES, DEPTH, DEEPER = 32, 4, 4
REGION = 48
#: Trees of the first pass, which joins most of each group.
FIRST_TREES = 4
#: Rounds in which each document tries its likeliest remaining candidate, before all that are left.
ROUNDS = 2
#: Rows of one region that a task holds at once.
REGION_ROWS = 100_000
#: Forest rows in one Arrow batch.
FOREST_BATCH = "20000"
#: Bits of the filter of documents that have candidates: a fixed size, it only saves shuffling.
FILTER_BITS = 1 << 23
#: Members of a cell, about, of a region whose remaining pairs are tried.
CELL = 1024
#: Set sizes of one class differ by less than this factor: similar sets lie in the same or the next class.
SIZE_STEP = 1.34
#: Of 128 minhashes, cut to a byte each, so many agree in all but about 1 of 10 million pairs of similarity 0.75.
FINE_AGREE = 70
#: Of 128 one-bit minhashes, so many agree in all but about 1 of 10 million pairs of similarity 0.75.
SKETCH_AGREE = 92

_RNG = np.random.Generator(np.random.PCG64(7))
_A = _RNG.integers(0, 2**31, TREES * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 2**32, TREES * DEPTH, dtype=np.uint32)


def signature(sets: np.ndarray) -> np.ndarray:
    """TREES * DEPTH minhashes (uint32) of a set of 64-bit hashes; blocks bound the memory."""
    low = (sets >> np.uint64(32)).astype(np.uint32) ^ sets.astype(np.uint32)
    out = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 2048):
        block = low[i : i + 2048, None] * _A + _B
        block ^= block >> np.uint32(15)
        np.minimum(out, block.min(axis=0), out=out)
    return out


def _digest(sets: np.ndarray) -> bytes:
    return hashlib.sha256(sets.tobytes()).digest()[:16]


def _signatures(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, digest, sig, bits): one row for each document, the last three null where the set is empty."""
    shared.text_batches(docs.sparkSession)

    def run(batches):
        hasher = shingles.WordHasher()
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                s = hasher.shingles(text, size)
                sig = signature(s) if len(s) else None
                rows.append((doc, len(s), *((_digest(s), sig.astype("<u4").tobytes(), _sketch(sig[None])[0].tobytes()) if len(s) else (None,) * 3)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_shingles", "digest", "sig", "bits"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_shingles long, digest binary, sig binary, bits binary")


def _forest_rows(reps: DataFrame, trees: int = TREES) -> DataFrame:
    """(key, tree, deep, doc_id, n, label, bits) for each tree: key hashes tree and first values, deep has 16 bits of each of the next ones."""
    wide = reps.select("doc_id", F.col("n_shingles").alias("n"), "label", "bits", F.concat("sig", "sig").alias("wide"))
    rows = wide.select("*", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    value = lambda d, width: F.substring("wide", 4 * (F.col("tree") * DEPTH + d) + 1, F.lit(width))
    key = F.xxhash64("tree", value(0, 4 * DEPTH))
    deep = F.concat(*(value(DEPTH + d, 2) for d in range(DEEPER)))
    return rows.select(key.alias("key"), "tree", deep.alias("deep"), "doc_id", "n", "label", "bits")


def _sketch(sig: np.ndarray) -> np.ndarray:
    """One bit for each minhash, packed."""
    return np.packbits((sig * np.uint32(0x9E3779B1) >> np.uint32(31)).astype(np.uint8), axis=1)


def _agree(bits: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return 8 * bits.shape[1] - np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)


def region_pairs(ids: np.ndarray, n: np.ndarray, label: np.ndarray, bits: np.ndarray, first: bool = False) -> list[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of different labels of one region, whose members are in its order.

    Of each member with the next one, and with all others if they are few; ``first``: of each
    with the next one, then of the region's first member with each.
    """
    at = np.arange(len(ids))
    if first:
        out = [(at[:-1], at[1:]), (np.zeros(max(0, len(ids) - 2), np.int64), at[2:])]
    elif (label == label[0]).all():
        return []
    else:
        out = [np.triu_indices(len(ids), 1) if len(ids) <= REGION else (at[:-1], at[1:])]
    kept = []
    for i, j in out:
        small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        ok = (100 * small >= 75 * large) & (label[i] != label[j])
        i, j = i[ok], j[ok]
        ok = _agree(bits, i, j) >= SKETCH_AGREE
        kept.append((i[ok], j[ok]))
    return kept


def _candidates(rows: DataFrame, first: bool = False) -> tuple[DataFrame, DataFrame]:
    """Distinct candidates (a, b, agree) with a < b, and members (key, tree, doc_id, n) of regions with pairs left.

    agree is -1 where no sketches were compared.  Of a region that has pairs left a task tells
    only the key and the labels' range; its members are then looked up among ``rows``.
    ``first``: only (a, b), at most two for each document.
    """
    spark = rows.sparkSession

    def run(batches):
        held = ends = flushed = None
        for pdf in batches:
            if not len(pdf):
                continue
            ends = (pdf.iloc[0] if ends is None else ends[0], pdf.iloc[-1], False)
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            key = pdf["key"].to_numpy()
            last = int(np.searchsorted(key, key[-1]))  # the last region may go on in the next batch
            if not last and len(pdf) > REGION_ROWS:
                last = len(pdf) - 1  # a huge region goes on with its last member
                flushed = key[-1]
            held = pdf.iloc[last:]
            if last:
                yield from pairs(pdf.iloc[:last] if key[last - 1] != key[last] else pdf, ends, flushed)
        if held is not None:
            yield from pairs(held, (ends[0], ends[1], True), flushed)
            part = TaskContext.get().partitionId()
            edge = [(int(x["doc_id"]), int(x["key"]), i, part) for i, x in enumerate(ends[:2])]
            yield pd.DataFrame(edge, columns=["a", "b", "agree", "part"])

    def pairs(pdf, ends, flushed):
        key, ids, n, label = (pdf[c].to_numpy() for c in ("key", "doc_id", "n", "label"))
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        sizes = np.diff(cut)
        if not first:
            # regions at a task's ends may go on in another task, and flushed ones have other parts, whatever their size here
            edge = (key[cut[:-1]] == ends[0]["key"]) | ((key[cut[:-1]] == ends[1]["key"]) & ends[2]) | (flushed is not None and key[cut[:-1]] == flushed)
            low, high = np.minimum.reduceat(label, cut[:-1]), np.maximum.reduceat(label, cut[:-1])
            left = edge | (sizes > REGION) & (low < high)
            if left.any():
                yield pd.DataFrame({"a": low[left], "b": key[cut[:-1]][left], "agree": high[left], "part": -2})
        a, b, w, kind = ([np.zeros(0, np.int64)] for _ in range(4))
        if sizes.max() > 1:
            bits = np.frombuffer(b"".join(pdf["bits"]), np.uint8).reshape(len(ids), -1)
            for x, y in zip(cut[:-1][sizes > 1], cut[1:][sizes > 1], strict=True):
                for k, (i, j) in enumerate(region_pairs(ids[x:y], n[x:y], label[x:y], bits[x:y], first)):
                    one, two, lead = ids[x:y][i], ids[x:y][j], first and k == 1
                    a.append(two if lead else np.minimum(one, two))
                    b.append(one if lead else np.maximum(one, two))
                    w.append(_agree(bits[x:y], i, j))
                    kind.append(np.full(len(i), -3 if lead else -1))
        out = pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b), "agree": np.concatenate(w), "part": np.concatenate(kind)})
        if len(out):
            yield out.drop_duplicates(["a", "b", "part"])

    placed = rows.repartitionByRange(shared.parts(spark), "key", "deep", "doc_id").sortWithinPartitions("key", "deep", "doc_id")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", FOREST_BATCH)  # these rows are short
    found = shared.stage(placed.mapInPandas(run, "a long, b long, agree long, part int"), "found")
    shared.text_batches(spark)
    # two rows for each task: where a region goes on in the next task, its neighbours there are linked
    regions = found.where("part = -2").groupBy(F.col("b").alias("key")).agg(F.min("a").alias("low"), F.max("agree").alias("high")).where("low < high")
    members = rows.join(shared.stage(regions.select("key"), "regions"), "key", "left_semi").select("key", "tree", "doc_id", "n")
    edges = sorted((r["part"], r["agree"], r["a"], r["b"]) for r in found.where("part >= 0").collect())
    joined = [(min(x[2], y[2]), max(x[2], y[2]), -1) for x, y in zip(edges, edges[1:], strict=False) if x[0] != y[0] and x[3] == y[3] and x[2] != y[2]]
    more = spark.createDataFrame(joined, "a long, b long, agree long")
    if first:
        best = found.where("part = -3").groupBy("a").agg(F.max(F.struct("agree", F.negative("b").alias("nb"))).alias("m")).select("a", F.negative("m.nb").alias("b"))
        near = _likeliest(found.where("part = -1").select("a", "b", "agree").union(more))
        return near.union(best.select(F.least("a", "b"), F.greatest("a", "b"))).distinct(), members
    return found.where("part = -1").select("a", "b", "agree").union(more).groupBy("a", "b").agg(F.max("agree").alias("agree")), members


def _filter(wanted: DataFrame):
    """Column test over doc_id that holds for all of ``wanted`` and for few others; of fixed size."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    words = wanted.select(slot.alias("s")).select(F.floor(F.col("s") / 64).alias("k"), F.expr("shiftleft(1L, cast(pmod(s, 64) AS int))").alias("v"))
    table = np.zeros(FILTER_BITS // 64, np.int64)
    for k, v in words.groupBy("k").agg(F.bit_or("v")).collect():  # at most FILTER_BITS / 64 rows
        table[k] = v
    shared_table = wanted.sparkSession.sparkContext.broadcast(table)

    def test(slot: pd.Series) -> pd.Series:
        s = slot.to_numpy()
        return pd.Series((shared_table.value[s >> 6] >> (s & 63)) & 1 == 1)

    test.__annotations__ = {"slot": pd.Series, "return": pd.Series}
    return F.pandas_udf(test, "boolean")(slot)


def _texts(docs: DataFrame, size: int | None = None) -> DataFrame:
    """(doc_id, packed): whole texts, compressed; smaller than their sets of hashes, so shuffles are too.

    With ``size`` also digest, that of the text's set.
    """

    def run(batches):
        pack, hasher = zstandard.ZstdCompressor(level=3).compress, shingles.WordHasher()
        for pdf in batches:
            out = pd.DataFrame({"doc_id": pdf["doc_id"], "packed": [pack((t or "").encode("utf-8", "surrogatepass")) for t in pdf["text"]]})
            yield out if size is None else out.assign(digest=[_digest(hasher.shingles(t, size)) for t in pdf["text"]])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, packed binary" + ", digest binary" * (size is not None))


class SetCache:
    """Sets of compressed texts; the ones used last are kept, up to ``limit`` bytes."""

    def __init__(self, size: int, limit: int = 64 << 20):
        self.size, self.limit, self.held, self.kept = size, limit, 0, OrderedDict()
        self.hasher, self.unpack = shingles.WordHasher(), zstandard.ZstdDecompressor().decompress

    def __call__(self, packed: bytes) -> np.ndarray:
        s = self.kept.pop(packed, None)
        if s is None:
            s = self.hasher.shingles(self.unpack(packed).decode("utf-8", "surrogatepass"), self.size)
            self.held += s.nbytes
        self.kept[packed] = s
        while self.held > self.limit and len(self.kept) > 1:
            self.held -= self.kept.popitem(last=False)[1].nbytes
        return s


def _confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets' intersection is at least ``percent`` of their union."""

    def run(batches):
        unpack = SetCache(size)
        for pdf in batches:
            ok = []
            for x, y in zip(pdf["x"], pdf["y"], strict=True):
                x, y = unpack(x), unpack(y)
                both = len(x) + len(y) - len(np.union1d(x, y))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pdf.loc[ok, ["a", "b"]]

    left = pairs.select("a", "b").join(texts.select(F.col("doc_id").alias("a"), F.col("packed").alias("x")), "a")
    both = left.join(texts.select(F.col("doc_id").alias("b"), F.col("packed").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInPandas(run, "a long, b long")


def _likeliest(pairs: DataFrame) -> DataFrame:
    """(a, b): for each document its candidate of the best sketch agreement, ties to small ids."""
    ends = pairs.select(F.col("a").alias("doc_id"), "a", "b", "agree").union(pairs.select(F.col("b"), "a", "b", "agree"))
    best = ends.groupBy("doc_id").agg(F.max(F.struct("agree", F.negative("a").alias("na"), F.negative("b").alias("nb"))).alias("m"))
    return best.select(F.negative("m.na").alias("a"), F.negative("m.nb").alias("b")).distinct()


def cell_pairs(tree: int, ids: np.ndarray, n: np.ndarray, sig: np.ndarray, label: np.ndarray, side: np.ndarray, stray: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (probe, member) of a cell that lie in different components and whose signatures agree.

    ``side`` is 1 for probes and 0 for members; a pair of two strays is left to the smaller id's
    probe, and pairs that an earlier tree brings together to that tree.
    """
    bits = _sketch(sig)
    fine = (sig * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8)
    one, two = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
    found = [(np.zeros(0, np.int64),) * 2]
    for k in range(0, len(one), 256):
        rows = one[k : k + 256]
        small, large = np.minimum(n[rows, None], n[two]), np.maximum(n[rows, None], n[two])
        ok = (100 * small >= 75 * large) & (label[rows, None] != label[two]) & (~stray[two] | (ids[rows, None] < ids[two]))
        i, j = np.nonzero(ok)
        i, j = rows[i], two[j]
        ok = _agree(bits, i, j) >= SKETCH_AGREE
        i, j = i[ok], j[ok]
        for x in range(0, len(i), 1 << 15):
            p, q = i[x : x + (1 << 15)], j[x : x + (1 << 15)]
            ok = (fine[p] == fine[q]).sum(axis=1) >= FINE_AGREE
            p, q = p[ok], q[ok]
            met = (sig[p, : tree * DEPTH] == sig[q, : tree * DEPTH]).reshape(len(p), tree, DEPTH).all(axis=2).any(axis=1)
            found.append((p[~met], q[~met]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def cell_links(pairs: tuple[np.ndarray, np.ndarray], set_of, label: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Of the index pairs whose full sets hold, one for each two components.  ``set_of`` gives the set of an index."""
    order = np.argsort(pairs[0], kind="stable")
    first, second = pairs[0][order], pairs[1][order]
    out, joined = [], {}
    for part in np.split(np.arange(len(first)), np.flatnonzero(np.diff(first)) + 1) if len(first) else []:
        i, js = int(first[part[0]]), second[part]
        x, mine = set_of(i), joined.setdefault(int(label[i]), set())
        while len(js):
            js = js[~np.isin(label[js], list(mine))]
            some, js = js[:64], js[64:]
            if not len(some):
                break
            sets = [set_of(int(j)) for j in some]
            sizes = np.array([len(s) for s in sets])
            every = np.concatenate(sets)
            at = np.minimum(np.searchsorted(x, every), len(x) - 1)
            both = np.add.reduceat((x[at] == every).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
            for j in some[100 * both >= percent * (len(x) + sizes - both)].tolist():
                if int(label[j]) not in mine:
                    out.append((i, j))
                    mine.add(int(label[j]))
                    joined.setdefault(int(label[j]), set()).add(int(label[i]))
    return out


CELL_KEY = ("key", "tree", "c", "x", "y")


def _dealt(members: DataFrame, comp: DataFrame) -> DataFrame:
    """(key, tree, c, x, y, doc_id, n, label, side, stray): regions of several components, by cells.

    Strays are the members outside a region's main component.  A stray probes the members of
    its own and both next size classes; members lie in their own class.  Probes and members are
    cut into blocks of about ``CELL``; a member is repeated for each block of probes, so rows
    grow with the members times one in ``CELL`` of the strays.
    """
    label = comp.select(F.col("node").alias("doc_id"), "component")
    m = members.join(label, "doc_id", "left").withColumn("label", F.coalesce("component", "doc_id")).drop("component")
    sizes = m.groupBy("key", "label").count()
    main = sizes.groupBy("key").agg(F.max(F.struct("count", "label"))["label"].alias("main"), F.count("*").alias("labels"))
    main = shared.stage(main.where("labels > 1").select("key", "main"), "mains")
    m = m.join(main, "key").withColumn("stray", F.col("label") != F.col("main"))
    m = m.withColumn("c", F.floor(F.log("n") / F.log(F.lit(SIZE_STEP))).cast("int")).drop("main")
    m = shared.stage(m, "members")
    probes = m.where("stray").withColumn("c", F.explode(F.array(F.col("c") - 1, F.col("c"), F.col("c") + 1))).withColumn("side", F.lit(1))
    held = m.withColumn("side", F.lit(0))
    count = lambda side: F.ceil(F.count(F.when(F.col("side") == side, 1)) / CELL).cast("int")
    blocks = probes.union(held.select(probes.columns)).groupBy("key", "c").agg(count(1).alias("probes"), count(0).alias("held")).where("probes > 0 and held > 0")
    blocks = shared.stage(blocks, "blocks")
    own = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = [*CELL_KEY, "doc_id", "n", "label", "side", "stray"]
    ask = probes.join(blocks, ["key", "c"]).withColumn("x", own("probes")).withColumn("y", every("held")).select(columns)
    answer = held.join(blocks, ["key", "c"]).withColumn("y", own("held")).withColumn("x", every("probes")).select(columns)
    return ask.union(answer)


def _remaining(docs: DataFrame, members: DataFrame, reps: DataFrame, comp: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b): links between regions' members that lie in different components, enough to join these."""
    columns = "key long, tree int, c int, x int, y int, doc_id long, n long, label long, side int, stray boolean, digest binary"

    def pairs(pdf):
        sig = np.frombuffer(b"".join(pdf["sig"]), np.uint32).reshape(len(pdf), -1)
        return cell_pairs(int(pdf["tree"].iloc[0]), *(pdf[x].to_numpy() if x != "sig" else sig for x in ("doc_id", "n", "sig", "label", "side", "stray")))

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        left = np.unique(np.concatenate(pairs(pdf))) if pdf["side"].nunique() > 1 else np.zeros(0, np.int64)
        return pdf.iloc[left].drop(columns="sig")

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        unpack, packed = SetCache(size), pdf["packed"].tolist()
        ids, label = pdf["doc_id"].to_numpy(), pdf["label"].to_numpy()
        got = cell_links(pairs(pdf), lambda i: unpack(packed[i]), label, percent)
        return pd.DataFrame({"a": [ids[i] for i, _ in got], "b": [ids[j] for _, j in got]}).astype("int64")

    dealt = shared.stage(_dealt(members, comp), "cells")
    # an id may stand for several sets: each comes with its own signature and text
    sig = reps.select("doc_id", "digest", "sig").where(_filter(dealt.select("doc_id").distinct()))
    held = dealt.join(sig, "doc_id").select(*CELL_KEY, "doc_id", "n", "label", "side", "stray", "digest", "sig")
    held = shared.stage(held.groupBy(*CELL_KEY).applyInPandas(near, columns), "remaining")
    wanted = held.select("doc_id").distinct()
    few = _filter(wanted)
    some = docs.where(few).join(wanted, "doc_id", "left_semi").select("doc_id", "text")
    texts = _texts(some, size).dropDuplicates(["doc_id", "digest"]).join(sig.where(few), ["doc_id", "digest"])
    texts = shared.stage(texts, "texts")
    return held.join(texts, ["doc_id", "digest"]).groupBy(*CELL_KEY).applyInPandas(links, "a long, b long").distinct()


def _texts_of(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    some = docs.where(_filter(wanted)).join(wanted, "doc_id", "left_semi")
    return shared.stage(_texts(some).dropDuplicates(["doc_id", "packed"]), "texts")


def _linked(docs: DataFrame, pairs: DataFrame, links: DataFrame, size: int, percent: int) -> DataFrame:
    """``links`` with the candidates that hold, but for those within a component that others made.

    Each document's likeliest candidate comes first; then the same among those that still lie
    in two components; then all that still do.
    """
    texts, rest = _texts_of(docs, pairs), pairs
    for k in range(ROUNDS + 1):
        tried = rest.select("a", "b") if k == ROUNDS else shared.stage(_likeliest(rest), "tried")
        links = links.union(shared.stage(_confirm(tried, texts, size, percent), "links"))
        if k == ROUNDS:
            break
        comp = shared.stage(components.connected_components(links, partial=2), "labels")
        of = lambda side: comp.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))  # noqa: B023, E731
        rest = rest.join(tried, ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left")
        rest = rest.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b", "agree")
        rest = shared.stage(rest, "rest")
        if not rest.limit(1).count():
            break
    return links


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text; other columns go).

    Sets are held as 64-bit hashes.  Empty sets link with nothing, even with each other.
    Rows that repeat a doc_id are one document as far as links go and each get a row; rows
    with a null doc_id are left out of links, have a null component and are kept.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    signed = shared.stage(_signatures(docs, size), "signatures")

    # equal sets collapse first: one representative each
    named = signed.where("doc_id is not null and digest is not null")
    reps = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.first("bits").alias("bits"))
    reps = shared.stage(reps, "representatives")
    first = reps.select("digest", F.col("doc_id").alias("a"))
    # an id with several texts joins their groups
    several = named.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("doc_id")
    several = named.select("doc_id", "digest").join(several, "doc_id", "left_semi").join(first, "digest").select("a", F.col("doc_id").alias("b")).distinct()
    several = shared.stage(several, "several")
    own = reps.withColumn("label", F.col("doc_id"))
    pairs, _ = _candidates(_forest_rows(own, FIRST_TREES), first=True)
    pairs = shared.stage(pairs, "candidates")
    links = shared.stage(_confirm(pairs, _texts_of(docs, pairs), size, percent), "links").union(several)
    comp = shared.stage(components.connected_components(links), "labels")
    labelled = reps.join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("component", "doc_id"))
    pairs, members = _candidates(_forest_rows(labelled))
    # known links are carried on as one from each node to its component
    known = comp.select(F.col("component").alias("a"), F.col("node").alias("b")).where("a <> b")
    links = _linked(docs, shared.stage(pairs, "candidates"), known, size, percent)
    comp = shared.stage(components.connected_components(links), "labels")
    more = shared.stage(_remaining(docs, members, reps, comp, size, percent), "links")
    if more.limit(1).count():
        comp = shared.stage(_joined(comp, more), "components")

    # each row follows its set's representative; the key of an empty set is its own id
    group = first.join(comp.withColumnRenamed("node", "a"), "a", "left").select(F.col("digest").alias("key"), F.coalesce("component", "a").alias("component"))
    out = signed.select("doc_id", "n_shingles", F.coalesce("digest", F.col("doc_id").cast("string").cast("binary")).alias("key"), F.col("digest").isNull().alias("empty"))
    out = out.join(group, "key", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.when(F.col("empty"), F.col("doc_id")).otherwise(F.coalesce("component", "doc_id")))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))


def _joined(comp: DataFrame, more: DataFrame) -> DataFrame:
    """Components after further links: only the links between components are followed."""
    heads = comp.select("component", "component")  # components have no row for their smallest node
    nodes = comp.union(heads).union(more.select("a", "a")).union(more.select("b", "b")).groupBy("node").agg(F.min("component").alias("component"))
    of = lambda side: nodes.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
    edges = more.join(of("a"), "a").join(of("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    new = components.connected_components(edges).select(F.col("node").alias("component"), F.col("component").alias("new"))
    return nodes.join(new, "component", "left").select("node", F.coalesce("new", "component").alias("component"))


def op7_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(shared.table(spark, sf_dir, "documents"))
