"""Alignment files cut into many parts, reference pieces, and the walk, against plain loops."""

import math
import struct
import zlib

import numpy as np
import pytest
from helixframe.operators import reads
from helixframe.sources import alignments

REFS = [("chr1", 3000), ("scaffold_2", 700), ("z", 90)]


def block(data):
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    return b"\x1f\x8b\x08\x04" + bytes(4) + b"\0\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def record(name, flag, ref, pos, mapq, cigar, seq, quals, tags=b""):
    packed = bytes(("=ACMGRSVTWYHKDBN".index(a) << 4) | ("=ACMGRSVTWYHKDBN".index(b)) for a, b in zip(seq[::2], seq[1::2] + "=" * (len(seq) % 2), strict=True))
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, mapq, 0, len(cigar), flag, len(seq), -1, -1, 0) + name.encode() + b"\0"
    body += b"".join(struct.pack("<I", n << 4 | op) for op, n in cigar) + packed + (bytes(quals) if quals is not None else b"\xff" * len(seq)) + tags
    return struct.pack("<i", len(body)) + body


def write_bam(path, records, rng, header=b"@HD\tVN:1.6\n"):
    data = b"BAM\1" + struct.pack("<i", len(header)) + header + struct.pack("<i", len(REFS))
    data += b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", k) for n, k in REFS)
    data += b"".join(records)
    with open(path, "wb") as f:
        k = 0
        while k < len(data):
            size = int(rng.choice([37, 200, 900]))
            f.write(block(data[k : k + size]))
            if rng.random() < 0.1:
                f.write(block(b""))
            k += size
        f.write(block(b""))


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    rng, folder = np.random.default_rng(11), tmp_path_factory.mktemp("bam")
    genome = {n: "".join(rng.choice(list("ACGTacgtN"), size, p=[0.23] * 4 + [0.015] * 4 + [0.02])) for n, size in REFS}
    with open(folder / "r.fa", "w") as f, open(folder / "r.fa.fai", "w") as index:
        for n, s in genome.items():
            f.write(f">{n} text\n")
            index.write(f"{n}\t{len(s)}\t{f.tell()}\t60\t61\n")
            f.write("".join(s[i : i + 60] + "\n" for i in range(0, len(s), 60)))
    rows, raw = [], []
    for i in range(500):
        ref = int(rng.integers(0, 3))
        middle = [[(0, 30)], [(0, 10), (1, 3), (0, 20)], [(0, 12), (2, 5), (0, 9)], [(7, 4), (0, 12), (8, 2)], [(0, 8), (3, 20), (0, 8)]][rng.integers(5)]
        cigar = [*([(5, 4)] if rng.random() < 0.2 else []), *([(4, 6)] if rng.random() < 0.3 else []), *middle, *([(4, 2)] if rng.random() < 0.2 else [])]
        span = sum(n for op, n in cigar if op in (0, 2, 3, 7, 8))
        length = sum(n for op, n in cigar if op in (0, 1, 4, 7, 8))
        pos = int(rng.integers(0, REFS[ref][1] - span))
        seq = "".join(rng.choice(list("ACGTN"), length, p=[0.24] * 4 + [0.04]))
        at = 0
        for op, n in cigar:  # mostly the reference's bases
            if op == 0 and rng.random() < 0.8:
                k = sum(m for o, m in cigar[: cigar.index((op, n))] if o in (0, 2, 3, 7, 8))
                seq = seq[:at] + "".join(c.upper() if rng.random() < 0.9 else "A" for c in genome[REFS[ref][0]][pos + k : pos + k + n]) + seq[at + n :]
            at += n if op in (0, 1, 4, 7, 8) else 0
        quals = None if i % 40 == 7 else [int(q) for q in rng.integers(2, 41, length)]
        mapped = i % 25 > 0
        tags = [b"NMC\x03ASc\xf7", b"MDZ10A5\0ASi" + struct.pack("<i", 77), b"ZBBs" + struct.pack("<Ihh", 2, 5, 6) + b"XAAq", b""][i % 4]
        score = [-9, 77, None, None][i % 4]
        name = f"read{i}" if i % 50 else "r" * 200
        raw.append(record(name, 0 if mapped else 4, ref if mapped else -1, pos if mapped else -1, i % 61, cigar if mapped else [], seq, quals, tags))
        rows.append((name, 0 if mapped else 4, REFS[ref][0] if mapped else None, pos if mapped else -1, i % 61, score, seq, None if quals is None else bytes(quals), cigar if mapped else []))
    raw.append(record("long", 0, 0, 5, 60, [(0, 2900)], genome["chr1"][5:2905].upper(), [30] * 2900))
    rows.append(("long", 0, "chr1", 5, 60, None, genome["chr1"][5:2905].upper(), bytes([30] * 2900), [(0, 2900)]))
    write_bam(folder / "a.bam", raw, rng)
    write_bam(folder / "none.bam", [], rng, b"@HD\tVN:1.6\n" + b"@CO\tmuch text\n" * 200)
    return folder, genome, rows


def test_parts_of_a_file_give_every_record_once(spark, files):
    folder, _, rows = files
    size = (folder / "a.bam").stat().st_size
    key = lambda r: (r[0], r[3], r[6])
    for split in (150, 1000, 7001, size * 2):
        df = alignments.alignments(spark, str(folder / "a.bam"), split)
        got = [(r["name"], r["flag"], r["ref"], r["pos"], r["mapq"], r["score"], r["seq"], None if r["quals"] is None else bytes(r["quals"]), list(zip(r["ops"], r["lens"], strict=True))) for r in df.collect()]
        assert sorted(got, key=key) == sorted(rows, key=key)
        assert df.select("voffset").distinct().count() == len(rows) and (df.rdd.getNumPartitions() > 1) == (split < size)
    assert alignments.alignments(spark, str(folder / "none.bam"), 100).count() == 0
    with pytest.raises(Exception, match="block|BAM"):
        alignments.alignments(spark, str(folder / "r.fa")).count()


def test_reference_pieces_join_to_the_sequences(spark, files):
    folder, genome, _ = files
    for size in (64, 100, 1 << 16):
        got = {}
        for r in alignments.reference_pieces(spark, str(folder / "r.fa"), size).orderBy("piece").collect():
            got[r["ref"]] = got.get(r["ref"], "") + r["bases"]
        assert got == genome


def test_batch_walk_equals_the_loop(files):
    _, genome, rows = files

    def plain(seq, quals, cigar, ref):
        i = j = matched = wrong = sub = clip = 0
        for op, n in cigar:
            for _ in range(n):
                if op == 0 and i < len(seq) and i < len(quals) and j < len(ref) and quals[i] >= 13 and "N" not in (seq[i], ref[j]):
                    matched += 1
                    wrong += seq[i] != ref[j]
                    sub += min(quals[i], 33) * (seq[i] != ref[j])
                clip += quals[i] if op == 4 and i < len(quals) else 13 * (op == 5)
                i, j = i + (op in (0, 1, 4, 7, 8)), j + (op in (0, 2, 3, 7, 8))
        return matched, wrong, sub, clip

    for cut in (0, 3):  # references that end early too
        spans = [genome[r[2]][r[3] : r[3] + sum(n for op, n in r[8] if op in (0, 2, 3, 7, 8)) - cut] if r[2] else "" for r in rows]
        got = reads.walk_batch([r[6].encode() for r in rows], [np.frombuffer(r[7] or b"", np.uint8) for r in rows], [np.array([o for o, _ in r[8]], int) for r in rows], [np.array([n for _, n in r[8]], int) for r in rows], [s.encode() for s in spans])
        assert [tuple(map(int, g)) for g in got] == [plain(r[6], r[7] or b"", r[8], s) for r, s in zip(rows, spans, strict=True)]
    assert reads.walk_batch([], [], [], [], []).shape == (0, 4)


def test_recap_of_files_equals_the_loop(spark, files):
    folder, genome, rows = files
    df = alignments.alignments(spark, str(folder / "a.bam"), 5000)
    pieces = alignments.reference_pieces(spark, str(folder / "r.fa"), 50)
    got = {(r["name"], r["orig_mq"], r["rl"], r["c"], round(r["t"], 6)): (r["new_mq"], r["as1"], r["sub_q"], r["clip_q"]) for r in reads.recap_alignments(df, pieces, (0, 50, 75), 50).collect()}
    want = {}
    for r in rows:
        if r[1] & 4:
            continue
        span = sum(n for op, n in r[8] if op in (0, 2, 3, 7, 8))
        m, wrong, sub, clip = map(float, reads.walk_batch([r[6].encode()], [np.frombuffer(r[7] or b"", np.uint8)], [np.array([o for o, _ in r[8]])], [np.array([n for _, n in r[8]])], [genome[r[2]][r[3] : r[3] + span].encode()])[0])
        t = sub - 4.343 * (wrong * math.log(m) - math.lgamma(wrong + 1) if wrong else 0.0) + clip / 5
        for c in (0, 50, 75):
            new = r[4] if c == 0 else 0 if t > c else int(c * math.sqrt((c - max(t, 0)) / c) + 0.499)
            want[r[0], r[4], len(r[6]), c, round(t, 6)] = (new, r[5], sub, clip)
    assert got == want and len(want) > 1400
