"""Language ID (operator 2): a linear-chain conditional random field over the words of a text.

Each word has hashed affix, character n-gram and lexicon (whole word) features; learned
transitions join neighbouring words, so code-switched texts are labelled word by word, by
forward-backward.  A document's language is the one with the largest mean posterior.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, shingles

#: Bounds of the fit: labelled documents taken for each language, and training sequences.
FIT_DOCS, FIT_SEQUENCES = 400, 3000
#: Runs of words that the fit takes from a document, and words in a run.
FIT_RUNS, RUN_WORDS = 8, 26
BUCKETS = 1 << 16
#: Words in a block of forward-backward; messages are carried from block to block.
BLOCK = 256
#: Characters whose features are held at once.
PIECE = 1 << 18
#: Longest affixes that are features of their own.
AFFIX = 4
_SPACE = re.compile(shared.SEPARATORS)


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _mixed(x: np.ndarray, factors: tuple[int, ...]) -> np.ndarray:
    """Bucket of each window of neighbouring characters."""
    n = len(x) - len(factors) + 1
    h = np.full(max(n, 0), len(factors), np.uint32)
    for k, f in enumerate(factors):
        h = (h ^ x[k : k + len(h)] * np.uint32(f)) * np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(15)
    return h & np.uint32(BUCKETS - 1)


def word_features(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature buckets, first feature of each word, whether a word has letters) of a text.

    Works on the characters of the lower-cased text: all windows of two and three that touch a
    word, the separator on either side included, the word's first and last ``AFFIX`` characters
    with that separator, then the word itself.
    """
    x = np.frombuffer((" " * AFFIX + text.lower() + " " * AFFIX).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    sep = (x == 32) | ((x >= 9) & (x <= 13))
    x[sep] = 32
    edge = np.flatnonzero(sep[1:] != sep[:-1]) + 1
    begin, end = edge[::2], edge[1::2]
    if not len(begin):
        z = np.zeros(0, np.int64)
        return z, z, z.astype(bool)
    two, three = _mixed(x, (0x9E3779B1, 0x85EBCA6B)), _mixed(x, (0xC2B2AE35, 0x27D4EB2F, 0x165667B1))
    salted = shingles.mix(x.astype(np.uint64) + np.uint64(1)) | np.uint64(1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(salted * _POW(len(x)), dtype=np.uint64)])

    def part(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
        """Bucket of the characters from a to b."""
        return (shingles.mix((sums[b] - sums[a]) * _INV(len(x))[a] + (b - a).astype(np.uint64) + np.uint64(salt << 40)) >> np.uint64(48)).astype(np.int64)

    # windows from one character before the word; those of two end one character later than those of three
    size = end - begin
    per = 2 * size + 1 + 3
    first = np.cumsum(per) - per
    out = np.empty(int(per.sum()), np.int64)
    local = np.arange(len(out)) - np.repeat(first, per)
    w = np.repeat(np.arange(len(begin)), per)
    b, s = begin[w] - 1, size[w]
    is_two = local <= s
    is_three = ~is_two & (local <= 2 * s)
    out[is_two] = two[(b + local)[is_two]]
    out[is_three] = three[(b + local - s - 1)[is_three]]
    out[first + per - 3] = part(begin - 1, np.minimum(begin + AFFIX, end), 1)
    out[first + per - 2] = part(np.maximum(end - AFFIX, begin), end + 1, 2)
    out[first + per - 1] = part(begin, end, 3)
    letters = np.concatenate([[0], np.cumsum(_is_letter()[x])])
    return out, first, letters[end] > letters[begin]


def _pieces(text: str):
    """A text in parts that end where words do."""
    a = 0
    while a < len(text):
        m = _SPACE.search(text, a + PIECE)
        b = m.start() if m else len(text)
        yield text[a:b]
        a = b


_CACHE: dict[int, list[np.ndarray]] = {0: [], 1: []}


def _grown(kind: int, base: int, n: int) -> np.ndarray:
    if not _CACHE[kind] or len(_CACHE[kind][0]) < n:
        _CACHE[kind][:] = [shingles._powers(base, max(2 * n, 1 << 16))]
    return _CACHE[kind][0]


def _POW(n: int) -> np.ndarray:
    return _grown(0, shingles._BASE, n)[:n]


def _INV(n: int) -> np.ndarray:
    return _grown(1, shingles._INVERSE, n)[:n]


@dataclass
class Crf:
    langs: list[str]
    emit: np.ndarray  # BUCKETS x labels
    trans: np.ndarray  # labels x labels

    def emissions(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        if not len(first):
            return np.zeros((0, len(self.langs)), np.float32)
        return np.add.reduceat(self.emit[features], first, axis=0)


def forward_backward(scores: np.ndarray, lens: np.ndarray, trans: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors of blocks (block x word x label), padded; blocks ordered by falling length.

    ``before``: forward messages of the words before the blocks (NaN where a text begins);
    ``after``: backward messages at the blocks' last words.  Also returned are the forward and
    backward messages and the words' potentials, from which training takes the expected
    transitions.
    """
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    t = np.exp(trans).astype(e.dtype)
    fwd, bwd = np.zeros_like(e), np.ones_like(e)
    active = [int((lens > k).sum()) for k in range(e.shape[1])]
    a = e[:, 0] if before is None else np.where(np.isnan(before), e[:, 0], (before @ t) * e[:, 0])
    fwd[:, 0] = a / a.sum(axis=1, keepdims=True)
    a = fwd[:, 0]
    for k in range(1, e.shape[1]):
        n = active[k]
        a = (a[:n] @ t) * e[:n, k]
        a /= a.sum(axis=1, keepdims=True)
        fwd[:n, k] = a
    if after is not None:
        bwd[np.arange(len(lens)), lens - 1] = after
    for k in range(e.shape[1] - 2, -1, -1):
        n = active[k + 1]
        b = (bwd[:n, k + 1] * e[:n, k + 1]) @ t.T
        bwd[:n, k] = b / b.sum(axis=1, keepdims=True)
    post = fwd * bwd
    post /= np.maximum(post.sum(axis=2, keepdims=True), 1e-30)
    return post, fwd, bwd, e


def transfers(scores: np.ndarray, lens: np.ndarray, trans: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """For each block the matrix that takes the message before it to that at its end, up to a factor.

    ``opens``: blocks that begin a text, into which no transition leads.
    """
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    t = np.exp(trans).astype(e.dtype)
    m = np.where(opens[:, None, None], np.eye(len(t), dtype=e.dtype), t) * e[:, 0, None, :]
    for k in range(1, e.shape[1]):
        n = int((lens > k).sum())
        x = (m[:n] @ t) * e[:n, k, None, :]
        m[:n] = x / x.sum(axis=(1, 2), keepdims=True)
    return m


def train(samples: list[tuple[str, str]], seed: int = 3, epochs: int = 3) -> Crf:
    """Fit on code-switched sequences, composed of runs of words of (text, language) samples."""
    langs = sorted({lang for _, lang in samples})
    rng = np.random.Generator(np.random.PCG64(seed))
    by = {k: [t.split() for t, lang in samples if lang == k and t and t.split()] for k in langs}
    labels = [k for k in langs if by[k]]
    crf = Crf(langs, np.zeros((BUCKETS, len(langs)), np.float32), np.zeros((len(langs), len(langs)), np.float32))
    if len(labels) < 2:
        return crf
    texts, gold = [], []
    for _ in range(FIT_SEQUENCES):
        words, tags = [], []
        for _ in range(int(rng.integers(1, 4))):
            k = labels[rng.integers(len(labels))]
            doc = by[k][rng.integers(len(by[k]))]
            n = int(rng.integers(4, 26))
            at = int(rng.integers(max(1, len(doc) - n + 1)))
            words += doc[at : at + n]
            tags += [langs.index(k)] * len(doc[at : at + n])
        texts.append(" ".join(words))
        gold.append(np.array(tags))
    feats = [word_features(t) for t in texts]
    ok = [i for i in range(len(texts)) if len(feats[i][1]) == len(gold[i])]
    m = [np.zeros_like(crf.emit), np.zeros_like(crf.trans)]  # adaptive steps: sums of squared gradients
    for _ in range(epochs):
        rng.shuffle(ok)
        for s in range(0, len(ok), 100):
            batch = sorted(ok[s : s + 100], key=lambda i: -len(gold[i]))
            lens = np.array([len(gold[i]) for i in batch])
            scores = np.zeros((len(batch), lens.max(), len(langs)), np.float32)
            mask = np.arange(lens.max()) < lens[:, None]
            for r, i in enumerate(batch):
                scores[r, : lens[r]] = crf.emissions(*feats[i][:2])
            post, fwd, bwd, e = forward_backward(scores, lens, crf.trans)
            diff = post.copy()
            tags = np.zeros(mask.shape, np.int64)
            tags[mask] = np.concatenate([gold[i] for i in batch])
            np.put_along_axis(diff, tags[:, :, None], np.take_along_axis(diff, tags[:, :, None], 2) - 1, 2)
            pair = fwd[:, :-1, :, None] * np.exp(crf.trans)[None, None] * (e * bwd)[:, 1:, None, :]
            pair /= np.maximum(pair.sum(axis=(2, 3), keepdims=True), 1e-30)
            inner = mask[:, 1:]
            g_t = pair[inner].sum(axis=0)
            np.add.at(g_t, (tags[:, :-1][inner], tags[:, 1:][inner]), -1)
            flat = np.concatenate([feats[i][0] for i in batch])
            per = np.concatenate([np.diff(np.append(feats[i][1], len(feats[i][0]))) for i in batch])
            d = np.repeat(diff[mask], per, axis=0)
            g_e = np.stack([np.bincount(flat, d[:, k], BUCKETS) for k in range(len(langs))], axis=1).astype(np.float32)
            for w, g, h in ((crf.emit, g_e, m[0]), (crf.trans, g_t.astype(np.float32), m[1])):
                g = g + 1e-3 * w * (g != 0)
                h += g * g
                w -= 0.25 * g / (np.sqrt(h) + 1e-3)
    return crf


def _padded(scores: list[np.ndarray], part: list[tuple[int, int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((len(part), part[0][0], scores[0].shape[1]), np.float32)
    for r, (n, i, _, a) in enumerate(part):
        x[r, :n] = scores[i][a : a + n]
    return x, np.array([p[0] for p in part])


def label_words(crf: Crf, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(posteriors of the words, whether they have letters) for each whole text.

    Exact over a whole text: a text's blocks are first reduced to transfer matrices, whose
    products give the messages at the blocks' edges; then each block is labelled from these.
    """
    scores, flags, blocks = [], [], []
    for i, t in enumerate(texts):
        own = [(crf.emissions(f, first), has) for f, first, has in map(word_features, _pieces(t))]
        s = np.concatenate([np.zeros((0, len(crf.langs)), np.float32), *(x for x, _ in own)])
        has = np.concatenate([np.zeros(0, bool), *(x for _, x in own)])
        s[~has] = 0
        scores.append(s)
        flags.append(has)
        blocks += [(min(BLOCK, len(s) - a), i, a // BLOCK, a) for a in range(0, len(s), BLOCK)]
    out = [np.zeros_like(s) for s in scores]
    before: dict[tuple[int, int], np.ndarray] = {}
    after: dict[tuple[int, int], np.ndarray] = {}
    long = sorted((b for b in blocks if len(scores[b[1]]) > BLOCK), reverse=True)
    matrix: dict[tuple[int, int], np.ndarray] = {}
    for k in range(0, len(long), 1024):
        part = long[k : k + 1024]
        x, lens = _padded(scores, part)
        for (_, i, b, _), m in zip(part, transfers(x, lens, crf.trans, np.array([p[2] == 0 for p in part])), strict=True):
            matrix[i, b] = m
    for i in {b[1] for b in long}:
        n = -(-len(scores[i]) // BLOCK)
        f = g = np.ones(len(crf.langs), np.float32)
        for b in range(n - 1):
            f = f @ matrix[i, b]
            f = f / f.sum()
            before[i, b + 1] = f
        for b in range(n - 1, 0, -1):
            g = matrix[i, b] @ g
            g = g / g.sum()
            after[i, b - 1] = g
    none, one = np.full(len(crf.langs), np.nan, np.float32), np.ones(len(crf.langs), np.float32)
    blocks.sort(reverse=True)
    for k in range(0, len(blocks), 1024):
        part = blocks[k : k + 1024]
        x, lens = _padded(scores, part)
        post = forward_backward(x, lens, crf.trans, np.stack([before.get(p[1:3], none) for p in part]), np.stack([after.get(p[1:3], one) for p in part]))[0]
        for r, (n, i, _, a) in enumerate(part):
            out[i][a : a + n] = post[r, :n]
    return list(zip(out, flags, strict=True))


def predict(crf: Crf, texts: list[str | None]) -> list[tuple[str, float, float]]:
    """(language or 'und', its mean posterior over the words that have letters, the mean of each word's largest).

    The last says how surely words are labelled, whatever number of languages a text mixes.
    """
    out = []
    for post, has in label_words(crf, [t or "" for t in texts]):
        if not has.any():
            out.append(("und", 0.0, 0.0))
            continue
        mean, sure = post[has].mean(axis=0, dtype=np.float64), post[has].max(axis=1).mean(dtype=np.float64)
        k = int(mean.argmax())
        out.append((crf.langs[k], float(min(1.0, mean[k])), float(min(1.0, sure))))
    return out


def fit(docs: DataFrame, eligible=None, per_lang: int = FIT_DOCS) -> Crf:
    """Learn from at most ``per_lang`` documents of each language, chosen by a hash of the id.

    A document gives ``FIT_RUNS`` runs of words, so what reaches the driver is bounded in rows
    and, but for words of any length, in bytes.  Rows with a null text or language teach nothing.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows if eligible is None else rows.where(eligible)
    counts = dict(rows.groupBy("lang").count().collect())  # one row for each language
    if not counts:
        return Crf(["und"], np.zeros((BUCKETS, 1), np.float32), np.zeros((1, 1), np.float32))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 1.5 * per_lang / n))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 30)) / float(1 << 30)
    some = rows.where(draw < share[F.col("lang")]).select("doc_id", "lang", "text")
    shared.text_batches(docs.sparkSession)

    def runs(batches):
        for pdf in batches:
            yield pd.DataFrame([(d, k, word_runs(t)) for d, k, t in zip(pdf["doc_id"], pdf["lang"], pdf["text"], strict=True)], columns=["doc_id", "lang", "runs"])

    some = some.mapInPandas(runs, "doc_id long, lang string, runs array<string>")
    some = some.orderBy("doc_id", "runs").limit(2 * per_lang * len(counts)).collect()
    taken: dict[str, list] = {}
    for r in some:
        own = taken.setdefault(r["lang"], [])
        if len(own) < per_lang:
            own.append(r["runs"])
    return train([(t, k) for k, v in sorted(taken.items()) for own in v for t in own])


def word_runs(text: str) -> list[str]:
    """``FIT_RUNS`` runs of up to ``RUN_WORDS`` words at even distances over a whole text; all of a short one."""
    words = text.split()
    step = max(RUN_WORDS, (len(words) - RUN_WORDS) // max(1, FIT_RUNS - 1))
    return [" ".join(words[a : a + RUN_WORDS]) for a in range(0, max(1, len(words)), step)][: FIT_RUNS + 1]


def identify(docs: DataFrame, crf: Crf) -> DataFrame:
    """``docs`` (doc_id, text) as (doc_id, text, lang_pred, score, certainty), one row for each row.

    A null text or one without a letter (``str.isalpha``) is 'und' with score and certainty 0;
    repeated rows repeat; only the text decides; clashing lang_pred, score and certainty columns
    are replaced, and the name ``_lang_id`` is kept for this function's use.  Memory grows with a batch's texts.
    """
    shared.text_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(crf)

    def tag(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(predict(model.value, texts.tolist()), columns=["lang_pred", "score", "certainty"])

    tag.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    tagged = F.pandas_udf(tag, "lang_pred string, score double, certainty double")
    docs = docs.drop("lang_pred", "score", "certainty")
    return docs.withColumn("_lang_id", tagged(F.col("text").cast("string"))).select("*", "_lang_id.lang_pred", "_lang_id.score", "_lang_id.certainty").drop("_lang_id")


def op2_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    out = shared.held_out(F.col("doc_id"), 5, 0)
    crf = fit(docs, ~out)
    rows = identify(docs.select("doc_id", "text"), crf)
    return rows.select("doc_id", shared.held_out(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", "score")
