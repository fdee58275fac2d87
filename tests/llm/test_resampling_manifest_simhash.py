"""Operators 11 to 13 against plain versions, through their queries and on small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from helixframe.llm import fingerprint, manifest, mixing, near_dup, quality, queries, resampling, simhash, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"
LONG = "lorem ipsum dolor sit amet " * 60_000
ROWS = [
    (1, "The cat sat on the mat. " * 12, "en", "a", 1, "x"),
    (2, "The cat sat on the mat. " * 12, "en", "a", 1, "x"),
    (2, "The cat sat on the mat. " * 12, "en", "a", 1, "x"),
    (2, "Ein anderer Text mit neun Worten steht nun hier.", "de", None, None, "x"),
    (3, None, None, None, None, None),
    (4, "", "", "a", 0, "x"),
    (None, "le chat et la souris sont dans la maison", "fr", "b", 5, "x"),
    (6, LONG, "la", "b", 2**63 - 1, "x"),
    (7, " \t\n", "en", None, 3, "x"),
    (8, "42 17 %", None, "c", 3, "x"),
    (9, "\xc9t\xe9 中文 \U0001f600 et cetera", "fr", "c", 3, "x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Near copies, repeated texts, odd rows and a hot group, as the query reads them."""
    path, rng = str(tmp_path_factory.mktemp("tables")), np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    rows, base = [], [list(rng.choice(words, rng.integers(1, 90))) for _ in range(60)]
    hot = list(rng.choice(words, 400))
    for i in range(900):
        t = list(hot if i % 3 == 0 else base[rng.integers(len(base))])
        for _ in range(int(rng.integers(0, 3))):
            t[rng.integers(len(t))] = str(rng.choice(words))
        rows.append((int(rng.integers(0, 10**6)) * 1000 + i, "  ".join(t).upper() if i % 7 == 0 else " ".join(t), [None, "", "en", "fr", "en", "en"][i % 6], "s", i if i % 5 else None))
    rows += [(5, None, "en", None, 1), (3, "", None, None, None), (4, "\n\t ", "zz", "a", 1), (9, "\xc9T\xc9 A B C D " * 9, "zz", "b", 2)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, " ".join(b)) for i, b in enumerate(base[:9])] + [(99, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, [" ".join(b) for b in base[:9]]


# --- operator 11 -----------------------------------------------------------------------------


def plain_fingerprint(text):
    small = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", small) if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(ids, fps, distance=4):
    """Smallest id reachable, by all pairs."""
    head = {i: i for i in ids}

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    f = np.array(fps, np.uint64)
    for k in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(f[k + 1 :] ^ f[k]) <= distance) + k + 1:
            a, b = sorted((find(ids[k]), find(ids[j])))
            head[b] = a
    return {i: find(i) for i in ids}


def test_simhash_query_equals_all_pairs(spark, folder):
    path, rows, _ = folder
    got = {r["doc_id"]: r for r in queries.QUERIES["op11_simhash_variants"](spark, path).collect()}
    fps = [plain_fingerprint(r[1]) for r in rows]
    want = plain_groups([r[0] for r in rows], fps)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(got[r[0]]["fingerprint"] == f"{f:016x}" for r, f in zip(rows, fps, strict=True))
    assert len(set(want.values())) < len(rows) - 100 and len({f for f in fps}) > 200


def test_simhash_of_a_large_group_in_few_variants(spark, monkeypatch):
    """Thousands of fingerprints around a few centres: chains, cells and rows held in parts."""
    rng = np.random.default_rng(2)
    fps = []
    for centre in rng.integers(0, 2**64, 12, dtype=np.uint64):
        for _ in range(60):
            x = int(centre)
            for b in rng.choice(64, rng.integers(0, 7), replace=False):
                x ^= 1 << int(b)
            fps.append(x)
    fps = list(dict.fromkeys(fps))
    monkeypatch.setattr(simhash, "INDEX_BATCH", "16")
    monkeypatch.setattr(near_dup, "CELL", 16)
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, size: docs.selectExpr("doc_id", "cast(text as long) as fp"))
    ids = rng.permutation(len(fps)).tolist()
    rows = [(i, str(f - 2**64 if f >= 2**63 else f)) for i, f in zip(ids, fps, strict=True)]
    out = simhash.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), few=2, held_rows=10)
    assert {r["doc_id"]: r["component_id"] for r in out.collect()} == plain_groups(ids, fps)


def test_variants_meet_exactly_the_near_segments(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**64, 300, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, i % 8, replace=False):
            b[i] ^= np.uint64(1 << int(bit))
    rows = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a.view(np.int64), b.view(np.int64), strict=True)], "a long, b long")
    for r in rows.select("a", "b", simhash.variants(rows.a).alias("va"), simhash.variants(rows.b).alias("vb")).collect():
        x = np.array([r["a"] ^ r["b"]], np.int64).view(np.uint64)
        shared = sorted(set(r["va"]) & set(r["vb"]))
        assert (shared[0] >> 32 if shared else -1) == simhash.first_shared(x)[0]
        assert shared or bin(int(x[0])).count("1") > 5


def test_shingles_of_blocks_equal_those_of_whole_texts(monkeypatch):
    texts = [b"", b"  ", b"one", b" one  two\n", b"a b c d", b"A b c d e " * 40, b"x" * 500 + b" y", b" " * 70 + b"p q r s t" + b" " * 70]
    whole = [[h.tolist() for h in simhash.shingle_hashes(t)] for t in texts]
    monkeypatch.setattr(simhash, "BLOCK", 16)
    for t, w in zip(texts, whole, strict=True):
        assert [x for h in simhash.shingle_hashes(t) for x in h.tolist()] == [x for h in w for x in h]


def test_simhash_edge_rows(docs, none):
    out = simhash.simhash_groups(docs)
    rows = out.collect()
    assert out.columns == ["doc_id", "fingerprint", "component_id"] and len(rows) == len(ROWS)
    assert Counter((r["doc_id"], r["fingerprint"]) for r in rows) == Counter((r[0], f"{plain_fingerprint(r[1]):016x}") for r in ROWS)
    at = {r["doc_id"]: r["component_id"] for r in rows}
    assert at[1] == at[2] == 1 and at[3] == at[4] == at[7] == 3 and at[None] is None
    assert simhash.simhash_groups(none).count() == 0
    with pytest.raises(ValueError):
        simhash.simhash_groups(docs, distance=6)


# --- operator 7: what operator 11 shares with it -----------------------------------------------


def test_joined_components_take_their_smallest_node_along(spark):
    comp = spark.createDataFrame([(8, 5), (9, 5), (3, 1)], "node long, component long")
    more = spark.createDataFrame([(8, 3), (20, 30)], "a long, b long")
    got = {r["node"]: r["component"] for r in near_dup._joined(comp, more).collect()}
    assert {n: got[n] for n in (3, 5, 8, 9, 20, 30)} == {3: 1, 5: 1, 8: 1, 9: 1, 20: 20, 30: 20}


def test_an_id_with_two_texts_keeps_both_in_the_last_step(spark):
    a, b = (" ".join(f"{p}{i}" for i in range(60)) for p in "ab")
    rows = [(1, a + " end"), (1, b + " end"), (10, a), (20, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    reps = near_dup._signatures(docs, 5).withColumnRenamed("n_shingles", "n")
    members = reps.selectExpr("1L as key", "0 as tree", "doc_id", "n")
    comp = spark.createDataFrame([], "node long, component long")
    links = near_dup._remaining(docs, members, reps, comp, 5, 75).collect()
    assert {tuple(sorted(r)) for r in links} == {(1, 10), (1, 20)}


# --- operator 12 -----------------------------------------------------------------------------


def plain_manifest(rows, fields, fanout=2):
    """(doc_id, leaf, subroot, root, siblings, folded_root) of each row; ``rows`` are dicts."""
    h = lambda t: hashlib.sha256(t.encode()).hexdigest()
    value = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf_of = lambda r: h("".join(value(r[f]) for f in fields))

    def climb(nodes):
        path = [[] for _ in nodes]
        at = list(range(len(nodes)))
        while len(nodes) > 1:
            runs = [list(range(i, min(i + fanout, len(nodes)))) for i in range(0, len(nodes), fanout)]
            for leaf, k in enumerate(at):
                path[leaf].append(([nodes[i] for i in runs[k // fanout]], k % fanout))
            nodes, at = [h("".join(nodes[i] for i in run)) for run in runs], [k // fanout for k in at]
        return nodes[0], path

    groups = defaultdict(list)
    for r in rows:
        groups[r["lang"]].append((leaf_of(r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climb([x for x, _ in sorted(groups[g], key=lambda p: (p[1]["doc_id"] is not None, p[1]["doc_id"] or 0, p[0]))]) for g in names}
    root, top = climb([trees[g][0] for g in names]) if names else (None, [])
    out = []
    for g, way in zip(names, top, strict=True):
        order = sorted(groups[g], key=lambda p: (p[1]["doc_id"] is not None, p[1]["doc_id"] or 0, p[0]))
        for (leaf, r), path in zip(order, trees[g][1], strict=True):
            seen = leaf
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0:
                seen = leaf_of(r | {"n_chars": r["n_chars"] + 1 if r["n_chars"] is not None else None})
            siblings = ""
            for run, place in path + way:
                siblings += "".join(x for i, x in enumerate(run) if i != place)
                seen = h("".join(seen if i == place else x for i, x in enumerate(run)))
            out.append((r["doc_id"], leaf, trees[g][0], root, siblings, seen))
    return out


def test_manifest_query_equals_plain_trees(spark, folder):
    path, rows, _ = folder
    names = ("doc_id", "text", "lang", "source", "n_chars")
    want = plain_manifest([dict(zip(names, r, strict=True)) for r in rows], manifest.FIELDS)
    got = queries.QUERIES["op12_merkle_manifest"](spark, path).collect()
    assert sorted(tuple(r)[:6] for r in got) == sorted((d, leaf, sub, root, hashlib.sha256(s.encode()).hexdigest(), seen) for d, leaf, sub, root, s, seen in want)
    assert all(r["verified"] == (r["folded_root"] == r["root"]) for r in got) and 0 < sum(not r["verified"] for r in got) < len(got)


@pytest.mark.parametrize(("fanout", "levels"), [(2, 1), (3, 9)])
def test_manifest_edge_rows(docs, none, fanout, levels):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    want = plain_manifest([dict(zip(names, r, strict=True)) for r in ROWS], manifest.FIELDS, fanout)
    out = manifest.manifest(docs, fanout=fanout, levels=levels)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    got = sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof"]) for r in out.collect()), key=key)
    assert got == sorted((x[:5] for x in want), key=key)
    assert out.where("folded_root <> root").count() == 0
    assert manifest.manifest(none).count() == 0


def test_manifest_of_small_blocks(spark, folder):
    path, rows, _ = folder
    names = ("doc_id", "text", "lang", "source", "n_chars")
    want = plain_manifest([dict(zip(names, r, strict=True)) for r in rows], manifest.FIELDS, 3)
    out = manifest.manifest(spark.read.parquet(f"{path}/documents.parquet"), fanout=3, levels=2)
    assert sorted((r["doc_id"], r["leaf"], r["root"], r["proof"]) for r in out.collect()) == sorted((x[0], x[1], x[3], x[4]) for x in want)


# --- operator 13 -----------------------------------------------------------------------------


def plain_resample(rows, target, percent=10, least=20):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    slot = lambda w: zlib.crc32(w.encode()) % 10000
    s, t = (Counter(slot(w) for x in texts for w in words(x)) for texts in ([r[1] for r in rows], target))
    S, T = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in s}
    out = []
    for r in rows:
        w = words(r[1])
        h = int(hashlib.sha256(f"2024:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[slot(x)] for x in w)
        out.append((r[0], len(w), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[3], x[0] is not None, x[0] or 0))
    drawn = able[: percent * len(able) // 100]
    rank = Counter()
    ranks = defaultdict(list)
    for k, x in enumerate(drawn, 1):
        ranks[x].append(k)
    for x in out:
        rank[x] += 1
        yield (*x, ranks[x][rank[x] - 1] if rank[x] <= len(ranks[x]) else None)


KEY = lambda r: tuple((v is None, v or 0) for v in r)


def test_resample_query_equals_plain_version(spark, folder):
    path, rows, target = folder
    got = [tuple(r) for r in queries.QUERIES["op13_importance_resample"](spark, path).collect()]
    assert sorted(got, key=KEY) == sorted(plain_resample(rows, target), key=KEY)
    assert sorted(r[4] for r in got if r[4]) == list(range(1, sum(r[1] >= 20 for r in got) // 10 + 1))


def test_resample_edge_rows(spark, docs, none):
    target = ["the cat", None]
    aim = spark.createDataFrame([(x, 1) for x in target], "text string, doc_id long")
    for percent, least in ((10, 20), (50, 0), (100, 1)):
        got = [tuple(r) for r in resampling.resample(docs, aim, percent, least).collect()]
        assert sorted(got, key=KEY) == sorted(plain_resample([(r[0], r[1]) for r in ROWS], target, percent, least), key=KEY)
    assert resampling.resample(none, aim).count() == 0
    assert resampling.resample(docs, aim.limit(0)).count() == len(ROWS)


def test_pairs_of_words_cross_blocks(monkeypatch):
    text = b"One two, three four five-six seven eight nine ten " * 5
    words = re.findall(rb"[0-9a-z\x80-\xff]+", text.lower())
    want = Counter(zlib.crc32(x) % 10000 for x in [*words, *map(b" ".join, zip(words, words[1:], strict=False))])
    for block in (8, 1 << 20):
        monkeypatch.setattr(resampling, "BLOCK", block)
        found = list(resampling.buckets(text, 1, 2))
        assert sum(n for n, _ in found) == len(words)
        assert Counter(x for _, b in found for x in b.tolist()) == want


# --- operator 9: names -------------------------------------------------------------------------


def test_mixing_leaves_the_callers_columns_alone(docs):
    names = ["_n", "_turn", "_s", "_d", "_row", "_turns", "_own_n"]
    got = mixing.mix_sources(docs.selectExpr("*", *[f"concat('{n}', doc_id) as {n}" for n in names], "7 as block"))
    assert got.columns == [*docs.columns, *names, "epoch", "block", "place", "mix_tokens"]
    rows = got.collect()
    assert {r["doc_id"] for r in rows} == {r[0] for r in ROWS}
    assert all(r[n] == (None if r["doc_id"] is None else f"{n}{r['doc_id']}") for r in rows for n in names)


# --- operator 8: pieces by content, and its query against a plain version ------------------------


def test_an_insertion_moves_no_distant_piece(monkeypatch):
    rng = np.random.default_rng(0)
    letters = "".join(rng.choice(list("abcdefghij klm"), 8000))
    signs = "".join(chr(c) for c in rng.integers(0x4E00, 0x5000, 4000))
    for text in (letters, signs):
        whole = fingerprint.merkle(text)
        for at in (0, 1, len(text) // 2, len(text)):
            assert fingerprint.likeness(whole, fingerprint.merkle(text[:at] + "X" + text[at:])) > 0.95
    lines = [letters, "", "Short. One! two;", signs, "x" * 2000, letters[:130] + ". " + signs[:700]]
    want = fingerprint.line_pieces(lines)
    assert ["".join(p) for p in want] == lines and [fingerprint.line_pieces([x])[0] for x in lines] == want
    assert max(len(p) for line in want for p in line) <= fingerprint.LONGEST
    monkeypatch.setattr(fingerprint, "BLOCK", 50)
    assert fingerprint.line_pieces(lines) == want


def test_fingerprint_query_equals_plain_version(spark, folder):
    path, rows, _ = folder
    got = {r["doc_id"]: r for r in queries.QUERIES["op8_merkle_fingerprint"](spark, path).collect()}
    order = sorted((r[0], r[1] or "") for r in rows)
    assert len(got) == len(order)
    prints = {}
    for k, (i, text) in enumerate(order):
        r, after = got[i], order[(k + 1) % len(order)]
        n = len(text)
        edit = text[: n - n // 4] + after[1][: n // 4]
        assert r["n_chars"] == n and r["edited_sha256"] == hashlib.sha256(edit.encode()).hexdigest()
        prints.setdefault(text, set()).add(r["fingerprint"])
        prints.setdefault(edit, set()).add(r["edited_fingerprint"])
        # what both have in common, in order, is no more than all pieces that both have
        for other, near, print_ in ((edit, r["near_edited"], r["edited_fingerprint"]), (after[1], r["near_next"], got[after[0]]["fingerprint"])):
            sides = [Counter(p for line in fingerprint.line_pieces(x.split("\n")) for p in line) for x in (text, other)]
            shared = sum(len(p) * c for p, c in (sides[0] & sides[1]).items())
            assert near == 1 if text == other else near <= 2 * shared / max(1, n + len(other)) + 1e-9
            assert near == pytest.approx(fingerprint.likeness(r["fingerprint"], print_))
            # the untouched three quarters, but for the piece that the edit cuts
            assert other is not edit or near >= (2 * (n - n // 4 - fingerprint.LONGEST - fingerprint.LONG) / max(1, 2 * n))
    assert all(len(p) == 1 for p in prints.values()) and len({next(iter(p)) for p in prints.values()}) == len(prints)


# --- operator 6: records that other readers resolve -----------------------------------------------


def test_revisits_name_their_response_s_record(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "y" * (200 + i // 3)) for i in range(12)], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    heads = []
    for path, _ in warc.write_archives(pages, folder):
        with warc.shared.filesystem(folder)[0].open_input_file(path) as source:
            heads += list(warc.read_archive(source))
    ids = {h["warc-record-id"]: h for h in heads}
    assert len(ids) == 12
    for h in heads:
        if h["warc-type"] == "revisit":
            first = ids[h["warc-refers-to"]]
            assert first["warc-type"] == "response" and first["x-page-id"] == h["x-refers-to-page"] and first["warc-payload-digest"] == h["warc-payload-digest"]


# --- operator 3: the query against plain walks and splits -------------------------------------------


def test_quality_query_equals_plain_walks(spark, tmp_path):
    rng = np.random.default_rng(3)
    words = [f"word{i}" for i in range(50)]
    rows = [(i, " ".join(rng.choice(words, 60)) + ". " if i % 2 else "## " * int(rng.integers(3, 40)) + str(rng.choice(words))) for i in range(400)] + [(900, ""), (901, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i % 2 if rng.random() < 0.9 else 1 - i % 2)) for i in range(300)] + [(5, None)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: r for r in queries.QUERIES["op3_quality_trees"](spark, str(tmp_path)).collect()}
    out_of_fit = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    known = sorted((i, q) for i, q in labels if q is not None and not out_of_fit(i))
    x = np.array([quality.document_stats(dict(rows)[i]) for i, _ in known])
    y = np.array([float(q) for _, q in known])
    trees = quality.train(x, y)

    def walk(stats):
        total = trees.base
        for feature, cut, value in zip(trees.feature, trees.cut, trees.value, strict=True):
            at = 0
            while at < len(feature):
                at = 2 * at + 1 + int(stats[feature[at]] > cut[at])
            total += value[at - len(feature)]
        return 1 / (1 + math.exp(-total))

    assert len(got) == len(rows)
    for i, text in rows:
        r = got[i]
        assert r["held_out"] == out_of_fit(i) and r["score"] == pytest.approx(walk(quality.document_stats(text))) and r["predicted"] == (r["score"] >= 0.5)
    held = [i for i, q in labels if q is not None and out_of_fit(i)]
    assert np.mean([got[i]["predicted"] == i % 2 for i in held]) > 0.9
    # the first split is the best of all
    p = y.mean() * 0 + 1 / (1 + math.exp(-trees.base))
    g, h = p - y, np.full(len(y), p * (1 - p))
    gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
    every = np.ones(len(y), bool)
    best = max(
        gain(left) + gain(~left) - gain(every)
        for k in range(x.shape[1])
        for c in np.unique(np.quantile(x[:, k], np.linspace(0, 1, quality.BINS + 1)[1:-1], method="lower"))
        for left in [x[:, k] <= c]
        if min(left.sum(), (~left).sum()) >= quality.LEAST
    )
    left = x[:, trees.feature[0][0]] <= trees.cut[0][0]
    assert gain(left) + gain(~left) - gain(every) == pytest.approx(best)
