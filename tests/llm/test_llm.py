"""Edge cases and brute-force comparisons of the pipeline operators on small tables."""

import io
import re
import zlib

import numpy as np
import pytest
from helixframe.llm import fingerprint, host_rules, language_id, mixing, near_dup, packing, pii, quality, queries, shingles, token_file, tokens, warc
from hypothesis import given, settings
from hypothesis import strategies as st

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"
LONG = "lorem ipsum dolor sit amet " * 3000
ROWS = [
    (1, "The cat sat on the mat. " * 12, "en", "a", 1, "x"),
    (2, "The cat sat on the mat. " * 12, "en", "a", 1, "x"),
    (2, "The cat sat on the mat. " * 12, "en", "a", 1, "x"),
    (3, None, None, None, None, None),
    (4, "", "en", "a", 0, "x"),
    (None, "le chat et la souris sont dans la maison", "fr", "b", 5, "x"),
    (6, LONG, "la", "b", 5, "x"),
    (7, " \t\n", "en", None, 3, "x"),
    (8, "42 17 %", None, "c", 3, "x"),
    (9, "der Hund und die Katze sind in dem Haus", "de", "c", 3, "x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


VOCABULARIES = ("byte_bpe_50k.json", "word_bpe_49k.json")
#: Characters that are a letter and a mark once composed or made small, and others that are easily cut wrongly.
ODD = ["\u0130", "\u0149", "\u0958", "\u095f", "\u09dc", "\u0a36", "\ufb1d", "\ufb4e", "\u03a3", "\u0301", "\u212a", "\u1e9e", "\x1c", "\x85", "\xa0", "\u2009", "\u3000", "\u200b", "\u180e", "\xad"]
PIECES = [" ", " ", " ", "  ", "\n", "\t", ",", ".", "!", "'s", "'", "a", "B", "word", "Word.", "\xe9", "\xc9t\xe9,", "12", "7.", "<|endoftext|>", "<|startoftext|>,", "#", "\u0434\u0430", "\u4e2d\u6587", *ODD]


def test_chunked_ids_equal_whole_text_ids():
    odd = ["", " ", "  a  b\n\n c", "x<|endoftext|> y <|endoftext|>z", "a \x1c b\x85 c", "\n a\t b \xa0 \u3000 c 's don't", "12 345  6. A1, \xbd!", "a\nb. C\n\nd", *(f"{c}, a{c}. {c}b! {c}" for c in ODD)]
    for name in VOCABULARIES:
        enc = tokens.encoder(tokens.tokenizer_path(name))
        assert enc.form == ("spaced" if "byte" in name else "worded")
        for t in odd:
            assert enc.encode([t])[0].tolist() == enc.tok.encode(t, add_special_tokens=False).ids, t


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PIECES), st.text(st.characters(exclude_categories=["Cs"]), max_size=3)), max_size=14).map("".join))
def test_ids_of_any_text_equal_the_library_s(text):
    for name in VOCABULARIES:
        enc = tokens.encoder(tokens.tokenizer_path(name))
        assert enc.encode([text])[0].tolist() == enc.tok.encode(text, add_special_tokens=False).ids


def test_encoder_empties_its_cache(monkeypatch):
    monkeypatch.setattr(tokens, "CHUNKS", 50)
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{rng.integers(300)}{'.' * int(rng.integers(2))}" for _ in range(40)) for _ in range(60)]
    for name in VOCABULARIES:
        enc = tokens.ChunkEncoder(tokens.tokenizer_path(name))
        for k in range(0, 60, 4):
            for t, ids in zip(texts[k : k + 4], enc.encode(texts[k : k + 4]), strict=True):
                assert ids.tolist() == enc.tok.encode(t, add_special_tokens=False).ids
        assert enc.known <= 400


def test_other_vocabularies_go_to_the_library_whole(tmp_path):
    import json

    with open(tokens.tokenizer_path("word_bpe_49k.json"), encoding="utf-8") as f:
        j = json.load(f)
    j["normalizer"] = {"type": "NFD"}
    (tmp_path / "other.json").write_text(json.dumps(j))
    enc = tokens.ChunkEncoder(str(tmp_path / "other.json"))
    assert enc.form == "other" and enc.encode(["A \xe9, b", None])[0].tolist() == enc.tok.encode("A \xe9, b", add_special_tokens=False).ids


def test_queries_return_the_library_s_ids(spark):
    """op1 and op10 against whole-text encoding by the library, and op1's places against its contract."""
    from tokenizers import Tokenizer

    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    tok, at = Tokenizer.from_file(tokens.tokenizer_path("word_bpe_49k.json")), 0
    rows = {r.doc_id: r for r in token_file.op10_token_file(spark, d).collect()}
    assert len(rows) == len(docs)
    for k in sorted(docs):
        ids = [*tok.encode(docs[k], add_special_tokens=False).ids, 2]
        assert (rows[k].start, rows[k].n_tokens, rows[k].ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)
    tok = Tokenizer.from_file(tokens.tokenizer_path("byte_bpe_50k.json"))
    pieces, placed, total = {}, {}, 0
    for r in packing.op1_best_fit_packing(spark, d).collect():
        pieces.setdefault(r.doc_id, []).append(r)
        placed.setdefault(r.sequence_id, []).append(r)
    assert pieces.keys() == docs.keys()
    for k, own in pieces.items():
        ids, own = [*tok.encode(docs[k], add_special_tokens=False).ids, 0], sorted(own, key=lambda r: r.piece)
        total += len(ids)
        assert [r.piece for r in own] == list(range(-(-len(ids) // 2048))) and [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1].tolist()]
        assert all(r.length == 2048 for r in own[1:]) and sum(r.length for r in own) == len(ids)
        assert [r.ids_crc32 for r in own] == [crc(ids[r.start : r.start + r.length]) for r in own]
    for own in placed.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [0, *np.cumsum([r.length for r in own])[:-1].tolist()] and own[-1].offset + own[-1].length <= 2048
    assert len(placed) <= 1.02 * -(-total // 2048) + 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=8), st.integers(1, 30))
def test_sum_index_finds_what_brute_force_finds(lengths, gap):
    import itertools

    free = np.bincount(lengths, minlength=31)
    index = packing.SumIndex(free)
    for _ in range(4):
        got = index.exact(gap)
        left = [k for k, n in enumerate(index.free) for _ in range(n)]
        want = any(sum(c) == gap for n in (1, 2, 3) for c in itertools.combinations(left, n))
        assert (got is not None) == want and (got is None or sum(got) == gap)
        for k in got or ():
            index.free[k] -= 1
        assert min(index.free) >= 0


def test_packing_slices_of_a_frequent_length(spark, monkeypatch):
    monkeypatch.setattr(packing, "SLICE_ROWS", 30)
    rows = spark.createDataFrame([(i, 0, 700 if i % 3 else 648) for i in range(400)], "doc_id long, piece int, length long")
    out = packing.best_fit_pack(rows).collect()
    assert len({(r.sequence_id, r.offset) for r in out}) == 400 and max(r.offset + r.length for r in out) <= 2048
    assert len({r.sequence_id for r in out}) <= 135


def test_packing_slices_of_heavy_rows(spark, monkeypatch):
    given, broadcast = [], packing.shared.broadcast
    monkeypatch.setattr(packing, "SLICE_TOKENS", 40 * 2048, raising=False)
    monkeypatch.setattr(packing.shared, "broadcast", lambda spark, value: given.append(value) or broadcast(spark, value))
    rows = spark.createDataFrame([(i // 2, 0, 2048 if i % 5 else 900, bytes(8)) for i in range(500)], "doc_id long, piece int, length long, ids binary")
    out = packing.best_fit_pack(rows, order=("doc_id", "piece", "ids")).collect()
    assert sum(k[0] == 2048 for k in given[0][1]) >= 5  # none before: one slice held all rows of a length
    assert len({(r.sequence_id, r.offset) for r in out}) == 500 and max(r.offset + r.length for r in out) <= 2048
    assert len({r.sequence_id for r in out}) == 450


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=60))
def test_plan_places_every_piece_once(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    filled: dict[int, list] = {}
    for length, first, n, seq, at in packing.plan_packing(counts, 60):
        for i in range(n):
            filled.setdefault(seq + i, []).append((at, length, first + i))
    assert sorted((x[1], x[2]) for v in filled.values() for x in v) == sorted((k, i) for k, n in counts.items() for i in range(n))
    for v in filled.values():
        end = 0
        for at, length, _ in sorted(v):
            assert at == end
            end += length
        assert end <= 60
    assert len(filled) <= max(1, 1.7 * sum(lengths) / 60 + 1)


def test_packing_rows(docs, none):
    rows = packing.best_fit_pack(packing.tokenize_pieces(docs)).collect()
    total = sum(len(r.ids) // 4 for r in rows)
    assert total == sum(r.length for r in rows) and max(r.length for r in rows) == 2048
    assert {r.length for r in rows if r.doc_id in (3, 4)} == {1}
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert packing.best_fit_pack(packing.tokenize_pieces(none)).count() == 0


def test_token_file_round_trip():
    out, data = io.BytesIO(), [np.arange(n, dtype=np.uint32) for n in (0, 1, 5000)]
    w = token_file.TokenWriter(out)
    for i, x in zip((None, -4, 9), data, strict=True):
        w.add(i, x)
    w.close()
    raw = bytearray(out.getvalue())

    class Source(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    r = token_file.TokenReader(Source(bytes(raw)))
    assert [r.tokens(k).tolist() for k in range(3)] == [x.tolist() for x in data] and r.find(9) == [2] and r.null.tolist() == [True, False, False]
    raw[int(r.begin[2]) + 8] ^= 255
    with pytest.raises(Exception):  # noqa: B017
        token_file.TokenReader(Source(bytes(raw))).tokens(2)


def test_token_files(spark, docs, none, tmp_path):
    folder = f"file://{tmp_path}/t"
    files = token_file.write_token_files(docs, folder)
    rows = sorted(token_file.read_token_files(spark, folder, files).collect(), key=lambda r: r.start)
    assert len(rows) == len(ROWS) and [r.doc_id for r in rows] == [None, 1, 2, 2, 3, 4, 6, 7, 8, 9]
    at = 0
    for r in rows:
        assert r.start == at and len(r.ids) == 4 * r.n_tokens
        at += r.n_tokens
    assert token_file.write_token_files(none, f"{folder}2") == []


def test_language(docs, none):
    crf = language_id.fit(docs)
    rows = language_id.identify(docs, crf).collect()
    assert {r.lang_pred for r in rows if r.doc_id in (3, 4, 7, 8)} == {"und"} and all(0 <= r.score <= 1 for r in rows)
    assert "extra" in rows[0].asDict() and len(rows) == len(ROWS)
    assert language_id.identify(none, language_id.fit(none)).count() == 0


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    s, t = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3))
    post = language_id.forward_backward(s, np.array([4]), t)[0][0]
    want = np.zeros((4, 3))
    for p in np.ndindex(3, 3, 3, 3):
        w = np.exp(sum(s[0, i, k] for i, k in enumerate(p)) + sum(t[a, b] for a, b in zip(p, p[1:], strict=False)))
        for i, k in enumerate(p):
            want[i, k] += w
    assert np.allclose(post, want / want.sum(axis=1, keepdims=True))


def test_blocks_are_labelled_as_one_chain(monkeypatch):
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(["der", "the", "le", "und", "and", "12"], n)) for n in (1, 4, 5, 30, 41, 400, 0)]
    crf = language_id.train([("der und die das ist nicht", "de"), ("the and of to in is", "en"), ("le la et les des une", "fr")])
    whole = language_id.label_words(crf, texts)
    monkeypatch.setattr(language_id, "BLOCK", 5)
    monkeypatch.setattr(language_id, "PIECE", 16)
    for (a, x), (b, y) in zip(whole, language_id.label_words(crf, texts), strict=True):
        assert np.allclose(a, b, atol=1e-4) and x.tolist() == y.tolist()


def test_language_features_are_of_characters():
    crf = language_id.Crf(["a"], np.zeros((language_id.BUCKETS, 1), np.float32), np.zeros((1, 1), np.float32))
    assert [language_id.predict(crf, [t])[0][0] for t in ("\xbd \xb2 \xb3", "\u2014 \u2192 \U0001f600", "_ 12", "\u0434", "\u4e2d")] == ["und"] * 3 + ["a"] * 2
    f, first, has = language_id.word_features("\u0434\u043e\u043c ab")
    # windows of two and three characters, both affixes, the word
    assert np.diff([*first, len(f)]).tolist() == [2 * 3 + 4, 2 * 2 + 4] and has.all()
    g = language_id.word_features("ab")[0]
    assert f[first[1] :].tolist() == g.tolist()


def test_language_query_against_plain_posteriors(spark):
    """op2's own accuracy on held-out documents, and its scores against a plain chain over whole texts."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    known = {r.doc_id: r for r in docs.collect()}
    rows = queries.QUERIES["op2_language_crf"](spark, d).collect()
    assert {r.doc_id for r in rows} == set(known)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.lang_pred == known[r.doc_id].lang for r in rows if r.held_out]) > 0.95
    crf = language_id.fit(docs, ~language_id.shared.held_out(docs.doc_id, 5, 0))
    for r in rows[:40]:
        f, first, has = language_id.word_features(known[r.doc_id].text or "")
        if not has.any():
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        s = crf.emissions(f, first).astype(float)
        s[~has] = 0
        t, n = np.exp(crf.trans.astype(float)), len(s)
        e = np.exp(s - s.max(axis=1, keepdims=True))
        fwd, bwd = np.zeros_like(e), np.ones_like(e)
        for k in range(n):
            fwd[k] = e[k] * (fwd[k - 1] @ t if k else 1)
            fwd[k] /= fwd[k].sum()
        for k in range(n - 2, -1, -1):
            bwd[k] = t @ (e[k + 1] * bwd[k + 1])
            bwd[k] /= bwd[k].sum()
        post = fwd * bwd
        mean = (post / post.sum(axis=1, keepdims=True))[has].mean(axis=0)
        assert r.lang_pred == crf.langs[int(mean.argmax())] and abs(r.score - mean.max()) < 1e-3


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (9, None)], "doc_id long, quality int")
    rows = quality.score_quality(docs, quality.fit(docs, labels)).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert quality.score_quality(none, quality.fit(none, labels)).count() == 0
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    assert ((quality.train(x, y).score(x) >= 0.5) == y).mean() > 0.95


def test_host_rules(docs, none):
    rows = {r.doc_id: r for r in host_rules.apply_host_rules(docs).collect()}
    assert rows[3].n_words == 0 and rows[3].base_failed and not rows[3].kept and rows[1].n_repeat_words == 72
    assert rows[6].n_words == 15000 and host_rules.apply_host_rules(none).count() == 0


def test_pii_base_equals_plain_patterns(docs, none):
    pats = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    digits = lambda m: re.sub("[^0-9]", "", m)
    ok = {"email": lambda m: True, "ip": lambda m: all(int(p) < 256 for p in m.split(".")), "card": lambda m: 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m)), "phone": lambda m: 10 <= len(digits(m)) <= 15}
    rng = np.random.default_rng(2)
    for _ in range(800):
        t = "".join(rng.choice(list("a1.@+- 2(9)4"), 40))
        want = sorted(((k, *m.span()) for k, p in pats.items() for m in re.finditer(p, t) if ok[k](m.group())), key=lambda s: (s[1], list(pats).index(s[0])))
        assert pii.base_spans(t) == want
    net = pii.Tagger.new()
    assert pii.detect(docs, net).count() == len(ROWS) and pii.detect(none, net).count() == 0
    assert pii.base_spans("1" * 200_000) == [] and pii.base_spans("a" * 200_000) == [] and pii.base_spans(None) == []


class LabelsByCharacter:
    """A stand-in for the network: Z begins an e-mail, # is outside, all else goes on."""

    p = {"trans": np.zeros((pii.LABELS, pii.LABELS), np.float32)}

    def emissions(self, x):
        e = np.zeros((*x.shape, pii.LABELS), np.float32)
        np.put_along_axis(e, np.where(x == ord("Z") - 31, 1, np.where(x == ord("#") - 31, 0, 2))[:, :, None], 30, 2)
        return e


@pytest.mark.parametrize("part", ["Zane at example.com", "Zane[AT]example[DOT]com", "Zane AT example DOT com", "Zane(at)example(dot)com", "Zane at " + "sub." * 60 + "com", "Zane (at) " + "a" * 700 + " dot com", "Zane" + " dot of" * 400 + " at x.y"])
def test_pii_network_reads_all_that_may_be_valid(part):
    for before in (3, 31, 32, 64, 1000):
        text = "#" * before + part + "#" * 300
        assert pii._valid("email", text, before, before + len(part))
        ((base, spans),) = pii.find_spans(LabelsByCharacter(), [text])
        assert base == [] and spans == [("email", before, before + len(part))]


@settings(max_examples=1500, deadline=None)
@given(st.sampled_from(pii.ALL_KINDS), st.lists(st.sampled_from([*"0123456789", *" .-()+@/[]<", " at ", "[at]", "(AT)", " dot ", "(dot)", "[DOT]", "ab", "cd9", "12.34.56.78", "4111111111111111", "a1b2c3d4e5f6a7b8"]), max_size=14).map("".join), st.integers(0, 90))
def test_pii_valid_text_lies_in_an_open_run(kind, part, far):
    for n in range(len(part) + 1):
        text = "#" * far + part + "#" * far
        if pii._valid(kind, text, far, far + n):
            assert any(a <= far and b >= far + n for a, b in pii.open_runs(text))


def test_pii_runs_alone_give_what_whole_texts_give():
    """Windows over the whole text and one decoding of all its characters, with the others fixed to outside."""
    rng, net = np.random.default_rng(3), pii.Tagger.new(1)
    for text, _ in pii.examples(rng, ["some words of a text", "and of another one"], 40):
        runs = [(0, a, b) for a, b in pii.open_runs(text)]
        got = pii.decode(net, pii._emissions(net, [text], runs))
        (e,) = pii._emissions(net, [text], [(0, 0, len(text))])
        fixed = np.ones(len(text), bool)
        for _, a, b in runs:
            fixed[a:b] = False
        e[fixed] = -99
        e[fixed, 0] = 0
        ((path, sure),) = pii.decode(net, [e])
        for (_, a, b), (y, s) in zip(runs, got, strict=True):
            assert path[a:b].tolist() == y.tolist() and np.allclose(sure[a:b], s, atol=1e-3)


def test_pii_gradient_equals_differences():
    rng = np.random.default_rng(4)
    net = pii.Tagger({k: w.astype(np.float64) for k, w in pii.Tagger.new(2).p.items()})
    x, y = rng.integers(0, 98, (7, 3)), rng.integers(0, pii.LABELS, (7, 3))
    x[0] = [5, 5, 9]
    _, g = net.gradient(x, y)
    for k, w in net.p.items():
        for _ in range(6):
            at = tuple(int(x[0, 0]) if k in ("fx", "bx") and i == 0 else int(rng.integers(n)) for i, n in enumerate(w.shape))
            keep, step = w[at], 1e-3
            w[at] = keep + step
            up = net.gradient(x, y)[0]
            w[at] = keep - step
            down = net.gradient(x, y)[0]
            w[at] = keep
            assert abs((up - down) / (2 * step) - g[k][at]) < 2e-3 * max(1, abs(g[k][at])), k


@pytest.fixture(scope="module")
def tagger(spark):
    return pii.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_pii_recall_of_what_the_base_misses(tagger):
    """Fresh draws of the training's generator, and forms written out here."""
    fillers = ["It was a long way to the house, and they said nothing at all.", "Der Hund ist nicht hier; la maison est loin."]
    drawn = list(pii.examples(np.random.default_rng(77), fillers, 1500))
    hit = missed = wrong = 0
    for (_, want), (base, spans) in zip(drawn, pii.find_spans(tagger, [t for t, _ in drawn]), strict=True):
        new = set(spans) - set(base)
        wrong += bool(new) and not want
        if want and not any(s[1] < want[0][2] and s[2] > want[0][1] for s in base):
            hit, missed = hit + (want[0] in new), missed + (want[0] not in new)
    assert hit >= 0.9 * (hit + missed) and hit + missed > 400 and wrong <= 0.02 * len(drawn)
    said = [("You can write to {} about the house.", ["jane(at)example(dot)com", "jane [at] example [dot] com", "jane.doe [at] mail.example.org", "john dot smith at example dot com"]), ("Please call {} after lunch.", ["(415) 555-2671", "415-555-2671", "0044 207 9460958"])]
    spans = [(t.format(x), x) for t, xs in said for x in xs]
    found = sum(any(t[a:b] == x for _, a, b in s) for (t, x), (_, s) in zip(spans, pii.find_spans(tagger, [t for t, _ in spans]), strict=True))
    assert found >= len(spans) - 1


def test_pii_query_and_redaction(spark, tagger, monkeypatch):
    """op5's base columns against the plain patterns, and its spans through the redaction."""
    import hashlib

    d = "/root/testdata/sf0.001"
    monkeypatch.setattr(pii, "fit", lambda docs: tagger)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = pii.op5_pii_bilstm(spark, d).collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        base = pii.base_spans(texts[r.doc_id])
        assert [getattr(r, f"n_{k}") for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert set(filter(None, said.split(","))) <= set(r.spans.split(",")) and r.n_spans == len(list(filter(None, r.spans.split(","))))
    docs = spark.createDataFrame([(1, "a b@c.de, +1 (415) 555-7713!"), (2, None), (3, "")], "doc_id long, text string")
    out = {r.doc_id: r.t for r in pii.detect(docs, tagger).select("doc_id", pii.redact(docs.text, pii.F.col("spans")).alias("t")).collect()}
    assert out == {1: "a <PII>, <PII>!", 2: None, 3: ""}
    both = pii.detect(docs.withColumn("redacted", docs.doc_id), tagger, redacted=True)
    assert {r.doc_id: r.redacted for r in both.collect()} == out and both.columns == ["doc_id", "text", "base", "spans", "redacted"]
    assert pii.replaced("abcdef", [(4, 6), (1, 3), (2, 3), (3, 4)]) == "a<PII><PII><PII>" and pii.replaced(None, [(0, 1)]) is None


def test_warc(spark, tmp_path):
    html = ["é" * 60, "é" * 60, "short", "short", None, "", "x" * 5000, "é" * 60]
    pages = spark.createDataFrame([(None if i == 7 else i, f"http://h/{i}\n%", h, "y") for i, h in enumerate(html)], "page_id long, url string, html string, extra string")
    folder = f"file://{tmp_path}/w"
    rows = warc.read_archives(spark, folder, warc.write_archives(pages, folder)).collect()
    by = {r.page_id: r for r in rows}
    assert len(rows) == 8 and by[1].record_type == "revisit" and by[1].refers_to == 0 and by[None].refers_to == 0 and by[3].record_type == "response"
    assert bytes(by[6].payload) == b"x" * 5000 and by[4].payload_bytes == 0 and by[1].payload_digest == by[0].payload_digest
    assert warc.write_archives(pages.limit(0), f"{folder}2") == []


def brute_components(texts):
    sets = {}
    for k, t in texts.items():
        w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) if x]
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    comp = {k: k for k in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((comp[a], comp[b]))
                comp = {k: x if v == y else v for k, v in comp.items()}
    return {k: (len(sets[k]), comp[k]) for k in sets}


def test_near_duplicates_equal_brute_force(spark, none):
    rng = np.random.default_rng(4)
    texts, vocab = {}, [f"w{i}" for i in range(300)]
    for i in range(60):
        base = list(rng.choice(vocab, 60))
        for j in range(4):
            w = list(base)
            for _ in range(j):
                w[rng.integers(60)] = "zz"
            texts[i * 10 + j] = " ".join(w)
    hot = list(rng.choice(vocab, 80))
    for i in range(150):  # one large group
        w = list(hot)
        w[rng.integers(80)] = f"q{i}"
        texts[5000 + i] = " ".join(w)
    texts |= {9000: "", 9001: None, 9002: "A b", 9003: "a B", 9004: ""}
    docs = spark.createDataFrame([*texts.items(), (None, "a b"), (9002, "A b")], "doc_id long, text string").withColumn("component_id", docs_lit())
    got = near_dup.near_duplicates(docs).collect()
    want = brute_components(texts)
    assert len(got) == len(texts) + 2
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
        else:
            assert r.component_id is None and r.kept
    assert near_dup.near_duplicates(none).count() == 0


def test_remaining_pairs_join_what_brute_force_joins(spark):
    """Every tree's regions are given, and no link is known before."""
    rng = np.random.default_rng(5)
    base, texts = list(rng.choice([f"w{i}" for i in range(300)], 90)), {}
    for i in range(160):
        w = list(base)
        for _ in range(int(rng.integers(1, 5))):
            w[rng.integers(90)] = f"q{rng.integers(1000)}"
        texts[i] = " ".join(w[: 60 + i % 31])
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    signed = near_dup._signatures(docs, 5)
    members = near_dup._forest_rows(signed.withColumn("label", signed.doc_id)).select("key", "tree", "doc_id", "n")
    known = spark.createDataFrame([], "node long, component long")
    links = near_dup._remaining(docs, members, signed, known, 5, 75)
    got = {r.node: r.component for r in near_dup.components.connected_components(links).collect()}
    assert {k: got.get(k, k) for k in texts} == {k: v for k, (_, v) in brute_components(texts).items()}
    half = near_dup._remaining(docs, members, signed, spark.createDataFrame([(k, 0) for k in texts], "node long, component long"), 5, 75)
    assert half.count() == 0  # one component: nothing is left to try


def test_hot_group_equals_brute_force(spark):
    """A group of 2,000 near copies in several components, and unlike documents that share its words."""
    rng = np.random.default_rng(8)
    base, texts = [f"w{i}" for i in range(70)], {}
    for i in range(2000):
        w = list(base)
        if i % 5 == 0:
            for k in range(3, 70, 9):  # like the others, but under the limit
                w[k] = f"v{i % 25}x{k}"
        for _ in range(int(rng.integers(0, 3))):
            w[rng.integers(70)] = f"q{rng.integers(5000)}"
        texts[i] = " ".join(w)
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs).collect()}
    vocab: dict = {}
    sets = []
    for t in texts.values():
        w = t.split()
        sets.append({vocab.setdefault(tuple(w[i : i + 5]), len(vocab)) for i in range(len(w) - 4)})
    hot = np.zeros((2000, len(vocab)), np.float32)
    for i, x in enumerate(sets):
        hot[i, list(x)] = 1
    n = hot.sum(axis=1)
    both = hot @ hot.T
    near = 100 * both >= 75 * (n[:, None] + n[None] - both)
    want = np.arange(2000)
    while (new := np.where(near, want[None], 2000).min(axis=1)).tolist() != want.tolist():
        want = new
    assert len(set(want.tolist())) > 3 and got == dict(enumerate(want.tolist()))


def docs_lit():
    from pyspark.sql import functions as F

    return F.lit(1)


def test_shingle_counts_match_text():
    h = shingles.WordHasher()
    for t in ("", None, "a", "a b c d e", "a b c d e f a b c d e", "É é\x0bx " * 30):
        w = [x for x in re.split("[\x20\x09-\x0d]+", t or "") if x]
        assert len(h.shingles(t)) == (len({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}) if w else 0)


def test_fingerprints(spark, docs, none):
    rows = fingerprint.fingerprint_with_next(docs).collect()
    order = sorted(((-1 if d is None else d), t or "") for d, t, *_ in ROWS)
    got = sorted(rows, key=lambda r: (-1 if r.doc_id is None else r.doc_id))
    for i, (r, (_, t)) in enumerate(zip(got, order, strict=True)):
        nxt = order[(i + 1) % len(order)][1]
        assert r.n_chars == len(t) and r.fingerprint == fingerprint.merkle(t) and r.edited_fingerprint == fingerprint.merkle(fingerprint.edited(t, nxt))
    assert fingerprint.fingerprint_with_next(none).count() == 0
    assert fingerprint.likeness(fingerprint.merkle("a"), fingerprint.merkle("a")) == 1
    a, b = ("".join(f"Line {i}, nothing else here.\n" for i in range(200)) for _ in range(2))
    b = b.replace("Line 150,", "Row 150,")
    changed = fingerprint.changed_sections(fingerprint.merkle(a), fingerprint.merkle(b))
    assert 0 < len(changed) <= 3 and fingerprint.likeness(fingerprint.merkle(a), fingerprint.merkle(b)) > 0.98


def test_likeness_keeps_order():
    lines = [f"Line {i} says something of its own, {i * i} times. And more of {i}." for i in range(60)]
    a, b = (fingerprint.merkle("\n".join(x)) for x in (lines, lines[::-1]))
    assert a[:32] != b[:32] and fingerprint.likeness(a, b) < 0.2
    cut = fingerprint.merkle("\n".join(lines[:30] + ["Other words here."] + lines[30:]))
    assert 0.97 < fingerprint.likeness(a, cut) < 1 and abs(fingerprint.likeness(a, cut) - fingerprint.likeness(cut, a)) < 1e-9
    rng = np.random.default_rng(1)
    for _ in range(200):
        x, y = (list(map(str, rng.integers(0, 6, rng.integers(0, 9)))) for _ in range(2))
        got = fingerprint.aligned(x, y)
        assert all(x[i] == y[j] for i, j in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:], strict=False))
        assert x != y or len(got) == len(x)


def test_root_follows_from_branches():
    """The tree hashed again from the pieces' own hashes gives the printed root."""
    text = "One sentence. Another one; and more.\n\nA line without an end\n" * 9
    h = fingerprint._hash
    sections, held = [], []
    for line in text.split("\n"):
        (pieces,) = fingerprint.line_pieces([line])
        assert "".join(pieces) == line
        node = h(b"p" + b"".join(h(p.encode()) for p in pieces))
        held.append(node)
        if not line or node[0] % 4 == 0:
            sections.append(h(b"s" + b"".join(held)))
            held = []
    sections += [h(b"s" + b"".join(held))] if held else []
    mark = fingerprint.merkle(text)
    assert mark[:32] == h(b"r" + b"".join(sections)).hex() and [s[:8] for s in mark[33:].split(";")] == [s[:4].hex() for s in sections]


def test_mixing(docs, none):
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) >= len(ROWS) and {r.epoch for r in rows} <= {1, 2} and sum(r.epoch == 1 for r in rows) == len(ROWS)
    assert mixing.mix_sources(none).count() == 0
    flat = mixing.mix_sources(docs, repeats=None, entropy=10.0)
    assert flat.count() > len(rows)


def test_mixing_blocks_grow_with_the_corpus(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 10)
    docs = spark.range(500).selectExpr("id AS doc_id", "repeat('w ', int(id % 7) + 1) AS text", "if(id % 3 = 0, 'b', 'a') AS source")
    rows = mixing.mix_sources(docs).collect()
    assert {r.doc_id for r in rows} == set(range(500)) and 40 < len({r.block for r in rows}) <= 82
    first = sorted((r.source, r.place, r.mix_tokens) for r in rows if r.epoch == 1)
    at = {}
    for source, place, n in first:
        assert place == at.get(source, 0)
        at[source] = place + n


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    import oracle

    d = "/root/testdata/sf0.001"
    assert oracle.differences(queries.QUERIES[name](spark, d), oracle.connect(d), queries.SQL[name]) == ""


def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    rows = corpus_pipeline.run(spark, d).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    kept = {k for k, v in brute_components({k: r.text for k, r in docs.items()}).items() if v[1] == k}
    assert {r.doc_id for r in rows} == {k for k in kept if re.search(r"[^\W\d_]", docs[k].text or "")}
    assert all(r.length == len(r.ids) // 4 and r.offset + r.length <= 2048 for r in rows)
    assert zlib.crc32(bytes(rows[0].ids)) == zlib.crc32(np.frombuffer(rows[0].ids, "<u4").tobytes())


def test_pipeline_stages_on_edge_rows(spark, docs, none):
    """Nulls, empty texts, repeated ids, extra columns and no rows at all, stage by stage."""
    import corpus_pipeline as cp

    known = spark.createDataFrame([(i, f"{t} {i}", k, "s", 9) for i in range(100, 140) for t, k in [("the dog and the cat are in the house", "en"), ("le chien et le chat sont dans la maison", "fr")]], "doc_id long, text string, lang string, source string, n_chars long")
    mixed = [(500, "the dog and the cat are in the house le chien et le chat sont dans la maison", "en", "s", 9)]
    rows = cp.identify_language(spark, known.union(spark.createDataFrame(mixed, "doc_id long, text string, lang string, source string, n_chars long")).union(docs.select(*cp.COLUMNS)), None).collect()
    assert 500 in {r.doc_id for r in rows} and not {3, 4, 7, 8} & {r.doc_id for r in rows}

    kept = sorted((r.doc_id or -1, (r.text or "")[:9]) for r in cp.drop_near_duplicates(spark, docs, None).collect())
    assert kept == [(-1, "le chat e"), (1, "The cat s"), (3, ""), (4, ""), (6, "lorem ips"), (7, " \t\n"), (8, "42 17 %"), (9, "der Hund ")]
    same = [(None, "one two three four five six", "x", "y", 1)] * 3 + [(5, "a b c d e f", "x", "y", 1)] * 2 + [(5, "g h i j k l", "x", "y", 1)]
    kept = sorted(r.text for r in cp.drop_near_duplicates(spark, spark.createDataFrame(same, "doc_id long, text string, lang string, source string, n_chars long"), None).collect())
    assert kept == ["a b c d e f", "g h i j k l", "one two three four five six"]

    assert cp.mix(spark, docs, None).columns == list(cp.COLUMNS)
    packed = cp.pack(spark, docs, None).collect()
    assert len({(r.doc_id, r.piece) for r in packed}) >= len({r[0] for r in ROWS})
    for stage in (cp.identify_language, cp.drop_near_duplicates, cp.mix, cp.pack):
        assert stage(spark, none, None).count() == 0


def test_near_dup_keeps_all_rows_of_a_flushed_region(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "REGION_ROWS", 100)
    monkeypatch.setattr(near_dup, "FOREST_BATCH", "50")
    sizes = {1: 2, 2: 168, 3: 2, 4: 5, 5: 2}  # the last 20 rows of region 2 come after its first part
    rows = [(k, 0, b"\0" * 8, 1000 * k + i, 50, 1000 * k + i, bytes(16)) for k, m in sizes.items() for i in range(m)]
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        _, members = near_dup._candidates(spark.createDataFrame(rows, "key long, tree int, deep binary, doc_id long, n long, label long, bits binary"))
        found = [(r.key, r.doc_id) for r in members.collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert sorted(found) == [(k, 1000 * k + i) for k in (1, 2, 5) for i in range(sizes[k])]
