"""Merkle dataset manifest (operator 12): digests of rows, one tree for each group, one over the groups.

Rows of a group stand in ascending order; consecutive runs of ``fanout`` nodes hash to their
parent.  Leaves are cut into aligned blocks of ``fanout ** levels``, so a block's nodes depend
on its own leaves alone: a task holds one block as a contiguous matrix of 64-byte hex digests,
reshapes it by the fanout and hashes its rows level by level.  The blocks' nodes are the leaves
of the next round, until a group has one node.  Proofs go back down: a block gets its own path
to the root once, and the siblings of each of its leaves come by index arithmetic.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

FANOUT, LEVELS = 2, 9
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "g string, pos long, proof string, places string, subroot string, root string"
PROOF = "doc_id long, leaf string, subroot string, root string, proof string, places string, folded_root string"


# --- digest matrices ------------------------------------------------------------------------


def hash_rows(rows: np.ndarray) -> np.ndarray:
    """Hex digests, as a matrix of 64 bytes a row, of the rows of a matrix of bytes."""
    data, width = rows.tobytes(), rows.shape[1]
    out = "".join([sha256(data[i : i + width]).hexdigest() for i in range(0, len(data), width)])
    return np.frombuffer(out.encode(), np.uint8).reshape(-1, 64)


def parents(nodes: np.ndarray, fanout: int) -> np.ndarray:
    whole = len(nodes) // fanout * fanout
    out = [hash_rows(nodes[:whole].reshape(-1, fanout * 64))] if whole else []
    if whole < len(nodes):
        out.append(hash_rows(nodes[whole:].reshape(1, -1)))
    return np.concatenate(out)


def level_nodes(leaves: np.ndarray, fanout: int, levels: int | None) -> list[np.ndarray]:
    """The block's nodes by level; ``levels`` levels above the leaves, or (None) up to a single node."""
    out = [leaves]
    while len(out) - 1 < levels if levels is not None else len(out[-1]) > 1:
        out.append(parents(out[-1], fanout))
    return out


def runs(n_leaves: int, n_nodes: int, level: int, fanout: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each leaf at a level: the run's node indexes (clipped), which of them exist, the own place in the run."""
    own = np.arange(n_leaves) // fanout**level
    at = (own - own % fanout)[:, None] + np.arange(fanout)
    return np.minimum(at, n_nodes - 1), at < n_nodes, own % fanout


def proofs(levels: list[np.ndarray], fanout: int) -> tuple[list[str], list[str]]:
    """Siblings of each leaf, level by level and left to right, and its 'place/size' at each level, each ended by a comma."""
    n = len(levels[0])
    digests, kept, places = [], [], np.full(n, "", object)
    for k, nodes in enumerate(levels[:-1]):
        at, there, own = runs(n, len(nodes), k, fanout)
        digests.append(nodes[at])
        kept.append(there & (np.arange(fanout) != own[:, None]))
        places += np.array([f"{a}/{b}," for a, b in zip(own, there.sum(axis=1), strict=True)], object)
    if not digests:
        return [""] * n, [""] * n
    kept = np.concatenate(kept, axis=1)
    flat = np.concatenate(digests, axis=1)[kept].tobytes().decode()
    ends = np.cumsum(kept.sum(axis=1)) * 64
    return [flat[a:b] for a, b in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)], places.tolist()


def fold_block(leaves: np.ndarray, levels: list[np.ndarray], fanout: int) -> np.ndarray:
    """The block's node as each leaf alone would make it, with the siblings of ``levels``."""
    now = leaves
    for k, nodes in enumerate(levels[:-1]):
        at, there, own = runs(len(now), len(nodes), k, fanout)
        rows = nodes[at]
        rows[np.arange(len(now)), own] = now
        size, new = there.sum(axis=1), np.empty_like(now)
        for s in np.unique(size):  # the last run may be shorter
            new[size == s] = hash_rows(rows[size == s, :s].reshape(-1, 64 * s))
        now = new
    return now


def fold_path(now: np.ndarray, proof: str, places: str) -> np.ndarray:
    """Up a path that all rows of ``now`` share."""
    siblings, used = np.frombuffer(proof.encode(), np.uint8), 0
    for step in places.split(",")[:-1]:
        own, size = map(int, step.split("/"))
        near, used = siblings[used : used + 64 * (size - 1)], used + 64 * (size - 1)
        whole = np.tile(near, (len(now), 1))
        now = hash_rows(np.concatenate([whole[:, : 64 * own], now, whole[:, 64 * own :]], axis=1))
    return now


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer("".join(column.to_pylist()).encode(), np.uint8).reshape(-1, 64)


def strings(digests: np.ndarray) -> list[str]:
    text = digests.tobytes().decode()
    return [text[i : i + 64] for i in range(0, len(text), 64)]


# --- trees as tables ------------------------------------------------------------------------


def places(df: DataFrame, group: str, *order: str) -> DataFrame:
    """Adds pos, the row's place in its group from 0 by ``order``, and n, the group's rows.

    Ranges of (group, order), then places within a range and the ranges' counts: a hot group is
    many ranges, and a window sees at most a row for each range.
    """
    ranged = df.repartitionByRange(shared.parts(df.sparkSession), group, *order).sortWithinPartitions(group, *order)
    rows = shared.stage(ranged.withColumn("_row", F.monotonically_increasing_id()), "places").withColumn("_part", F.shiftright("_row", 33))
    found = rows.groupBy(group, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_k"))
    all_rows = Window.partitionBy(group).orderBy("_part")
    found = found.withColumn("_before", F.sum("_k").over(all_rows) - F.col("_k")).withColumn("n", F.sum("_k").over(Window.partitionBy(group)))
    out = rows.join(found, [group, "_part"]).withColumn("pos", F.col("_row") - F.col("_first") + F.col("_before"))
    return out.drop("_row", "_part", "_first", "_k", "_before")


def sorted_table(table: pa.Table, fanout: int, levels: int) -> tuple[pa.Table, int | None]:
    """A block's rows in order, and how many levels it has (None: up to one node)."""
    table = table.sort_by("pos")
    return table, levels if table["n"][0].as_py() > fanout**levels else None


def rounds(nodes: DataFrame, fanout: int, levels: int) -> list[DataFrame]:
    """``nodes`` (g, pos, digest, n) and the blocks' nodes of each round, until each group has one."""
    size = fanout**levels
    out, most = [nodes], nodes.agg(F.max("n")).first()[0] or 1

    def reduce(table: pa.Table) -> pa.Table:
        table, up = sorted_table(table, fanout, levels)
        top = level_nodes(matrix(table["digest"]), fanout, up)[-1]
        n, at = table["n"][0].as_py(), table["pos"][0].as_py() // size
        return pa.table({"g": table["g"][:1], "pos": pa.array([at], pa.int64()), "digest": strings(top), "n": pa.array([-(-n // size)], pa.int64())})

    while most > 1:
        blocks = out[-1].withColumn("_b", F.floor(F.col("pos") / size)).groupBy("g", "_b")
        out.append(shared.stage(blocks.applyInArrow(reduce, "g string, pos long, digest string, n long"), "nodes"))
        most = -(-most // size)
    return out


def blocks_with_paths(nodes: DataFrame, above: DataFrame, size: int):
    """Blocks of ``nodes`` beside the one row of ``above`` that holds the block's own path."""
    blocks = nodes.withColumn("_b", F.floor(F.col("pos") / size)).groupBy("g", "_b")
    return blocks.cogroup(above.withColumnRenamed("pos", "_b").groupBy("g", "_b"))


def paths(nodes: DataFrame, above: DataFrame, fanout: int, levels: int) -> DataFrame:
    """(g, pos, proof, places, subroot, root) of ``nodes`` from the same of the round above."""

    def extend(table: pa.Table, path: pa.Table) -> pa.Table:
        table, up = sorted_table(table, fanout, levels)
        path = path.to_pylist()[0]
        proof, places = proofs(level_nodes(matrix(table["digest"]), fanout, up), fanout)
        same = lambda c: pa.array([path[c]] * len(proof), pa.string())
        return pa.table({"g": table["g"], "pos": table["pos"], "proof": [x + path["proof"] for x in proof], "places": [x + path["places"] for x in places], "subroot": same("subroot"), "root": same("root")})

    return shared.stage(blocks_with_paths(nodes, above, fanout**levels).applyInArrow(extend, PATH), "paths")


def field(name: str, value: Column | None = None) -> Column:
    """'-' for null, else the UTF-8 byte count, ':' and the value."""
    v = (F.col(name) if value is None else value).cast("string")
    return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))


def manifest(docs: DataFrame, tampered: Column | None = None, fields=FIELDS, group: str = "lang", fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof, places, folded_root) for each row of ``docs`` (doc_id and ``fields``; others go).

    ``proof`` has the siblings' digests to the root, ``places`` the 'place/size' of each level.
    ``folded_root`` comes from the row's leaf, with n_chars one larger where ``tampered`` holds,
    and the original siblings.  Null fields are '-', a null group comes first, null ids are the
    group's first rows, rows of one id stand by their leaves, a repeated row is a leaf each
    time; no rows give no root and no rows.  ``levels`` sets the blocks' size, never the result.  Texts of any length are hashed where they are read.
    """
    leaf = F.sha2(F.concat(*[field(c) for c in fields]), 256)
    more = F.col("n_chars").cast("decimal(38,0)") + 1
    other = F.when(tampered, F.sha2(F.concat(*[field(c, more if c == "n_chars" else None) for c in fields]), 256)) if tampered is not None else F.lit(None)
    g = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))  # null before all, '' among the values
    leaves = docs.select(g.alias("g"), F.col("doc_id").cast("long").alias("doc_id"), leaf.alias("digest"), F.coalesce(other, leaf).alias("seen"))
    leaves = shared.stage(places(leaves, "g", "doc_id", "digest"), "leaves")
    own = rounds(leaves.select("g", "pos", "digest", "n"), fanout, levels)
    subroots = own[-1].select(F.lit("").alias("g"), F.col("g").alias("name"), "digest")
    subroots = shared.stage(places(subroots, "g", "name"), "subroots")
    top = rounds(subroots.select("g", "pos", "digest", "n"), fanout, levels)
    above = top[-1].select("g", "pos", F.lit("").alias("proof"), F.lit("").alias("places"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    for nodes in top[-2::-1]:
        above = paths(nodes, above, fanout, levels)
    names = subroots.select("pos", "name", F.col("digest").alias("_sub"))
    above = above.join(names, "pos").select(F.col("name").alias("g"), F.lit(0).cast("long").alias("pos"), "proof", "places", F.col("_sub").alias("subroot"), "root")
    for nodes in own[-2:0:-1]:
        above = paths(nodes, above, fanout, levels)

    def prove(table: pa.Table, path: pa.Table) -> pa.Table:
        table, up = sorted_table(table, fanout, levels)
        path = path.to_pylist()[0]
        nodes = level_nodes(matrix(table["digest"]), fanout, up)
        proof, steps = proofs(nodes, fanout)
        folded = fold_path(fold_block(matrix(table["seen"]), nodes, fanout), path["proof"], path["places"])
        same = lambda c: pa.array([path[c]] * len(proof), pa.string())
        return pa.table({
            "doc_id": table["doc_id"], "leaf": table["digest"], "subroot": same("subroot"), "root": same("root"),
            "proof": [x + path["proof"] for x in proof], "places": [x + path["places"] for x in steps], "folded_root": strings(folded),
        })

    return blocks_with_paths(leaves, above, fanout**levels).applyInArrow(prove, PROOF)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select(*FIELDS)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    rows = manifest(docs, tampered).withColumn("proof_sha256", F.sha2("proof", 256))
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: The table of the checksum and, of bytes ``b``, the checksum itself.
CRC_TABLE = "(SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) t(i))"
CRC = "xor(list_reduce([4294967295] || b, lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295)"

_FIELD = lambda c, v: f"coalesce(octet_length(encode({v}::VARCHAR)) || ':' || {v}::VARCHAR, '-')"
_LEAF = lambda n: "sha256(" + " || ".join(_FIELD(c, n if c == "n_chars" else c) for c in FIELDS) + ")"

SQL = f"""
WITH RECURSIVE crc AS {CRC_TABLE},
d AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {_LEAF("n_chars")} AS leaf, {_LEAF("(n_chars + 1)")} AS other,
             list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT) AS b FROM documents),
leaves AS (SELECT doc_id, g, leaf, CASE WHEN {CRC} % 7 = 0 THEN other ELSE leaf END AS seen,
                  row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM d, crc),
own AS (SELECT g, 0 AS level, pos, leaf AS h, n FROM leaves
        UNION ALL SELECT g, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM own WHERE n > 1 GROUP BY g, level, pos // 2),
sub AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM own WHERE n = 1),
top AS (SELECT 0 AS level, pos, h, n FROM sub
        UNION ALL SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM top WHERE n > 1 GROUP BY level, pos // 2),
every AS (SELECT 'own' || g AS t, level, pos, h, n FROM own UNION ALL SELECT 'top', level, pos, h, n FROM top),
walk AS (SELECT doc_id, leaf, g, 'own' || g AS t, 0 AS level, pos, n, seen AS now, '' AS proof FROM leaves
         UNION ALL
         SELECT doc_id, leaf, w.g, CASE WHEN w.n > 1 OR w.t = 'top' THEN w.t ELSE 'top' END, CASE WHEN w.n > 1 THEN level + 1 ELSE 0 END,
                CASE WHEN w.n > 1 THEN w.pos // 2 ELSE s.pos END, CASE WHEN w.n > 1 THEN (w.n + 1) // 2 ELSE s.n END,
                CASE WHEN w.n = 1 THEN now WHEN e.h IS NULL THEN sha256(now) WHEN w.pos % 2 = 0 THEN sha256(now || e.h) ELSE sha256(e.h || now) END,
                CASE WHEN w.n > 1 THEN proof || coalesce(e.h, '') ELSE proof END
         FROM (SELECT *, CASE WHEN pos % 2 = 0 THEN pos + 1 ELSE pos - 1 END AS other FROM walk WHERE n > 1 OR t <> 'top') w
         LEFT JOIN (SELECT t, level AS l, pos AS p, h FROM every) e ON e.t = w.t AND e.l = w.level AND e.p = w.other
         JOIN sub s ON s.g = w.g)
SELECT doc_id, leaf, sub.h AS subroot, root.h AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = root.h AS verified
FROM walk JOIN sub USING (g), (SELECT h FROM top WHERE n = 1) root WHERE walk.t = 'top' AND walk.n = 1
"""
