"""Personal data (operator 5): base patterns, plus spans of a character BiLSTM with CRF transitions.

The network reads overlapping windows, laid out from a text's start; where windows overlap, their
emissions are averaged with weights that favour a window's middle, and one decoding of the whole
chain decides.  Characters that can't lie in a span of any kind's form (``open_runs`` tells the
others) are fixed to "outside".  At a fixed character the chain falls into independent parts, so
decoding each run of open characters between two fixed ones is the decoding of the whole text,
and windows without an open character have no part in it.  Runs have no longest length.
"""

from __future__ import annotations

import pickle
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

KINDS = ("email", "ip", "card", "phone")
#: The network also marks secrets: keys and tokens of 16 characters or more.
ALL_KINDS = (*KINDS, "secret")
#: Bounds of the fit: documents and contexts whose base spans are labels, and made-up examples.
FIT_DOCS, FIT_CONTEXTS, FIT_EXAMPLES = 400, 3000, 9000
WINDOW, STRIDE = 64, 32
#: Windows, and characters of runs, that a task holds at once.
GROUP, CELLS = 2048, 1 << 17
HIDDEN, CERTAIN = 24, 0.4

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = r"[\w%+-]++"
_AT = r"(?:\s?(?:@|[\[({<]\s?(?:at|@)\s?[\])}>])\s?|\sat\s)"
_DOT = r"(?:\.|\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?|\sdot\s)"
_EMAIL = re.compile(rf"{_WORD}(?:{_DOT}{_WORD})*{_AT}{_WORD}(?:{_DOT}{_WORD})+", re.IGNORECASE)
_HOST = re.compile(rf"{_AT}{_WORD}(?:{_DOT}{_WORD})++", re.IGNORECASE)
_MAIL_SIGN = re.compile(r"@|\bat\b", re.IGNORECASE)
_LAST_DOT = re.compile(rf"{_DOT}\Z", re.IGNORECASE)
_IP = re.compile(rf"[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}", re.IGNORECASE)
_NUMBER = re.compile(r"[+(]{0,2}[0-9](?:[ ().+/-]{0,3}[0-9])+")
_TOKEN = re.compile(r"[A-Za-z0-9_+/=-]{16,}+")
_ALPHA = re.compile(r"[A-Za-z]")

Span = tuple[str, int, int]


# --- base patterns ------------------------------------------------------------------------


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _emails(text: str):
    at, done = text.find("@"), 0
    while at >= 0:
        left = at
        while left > done and text[left - 1] in _LOCAL:
            left -= 1
        m = _DOMAIN.match(text, at + 1) if left < at else None
        if m:
            yield left, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _ips(text: str):
    for m in _DOTTED.finditer(text):
        if m.group().count(".") < 3:
            continue
        parts = m.group().split(".")
        begin = m.start()
        for k in range(0, len(parts) - 3, 4):
            size = sum(map(len, parts[k : k + 4])) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in parts[k : k + 4]):
                yield begin, begin + size
            begin += size + 1


def base_spans(text: str | None) -> list[Span]:
    """Spans of the four patterns by start, then kind; null counts as empty.  Linear in the text."""
    text, out = text or "", []
    out += [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        out += [("ip", a, b) for a, b in _ips(text)]
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        for m in _PHONE.finditer(text) if "+" in text else ():
            if 10 <= len(_DIGIT.findall(m.group())) <= 15:
                out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# --- network ------------------------------------------------------------------------------

LABELS = 1 + 2 * len(ALL_KINDS)  # outside, then first and further characters of each kind


def codes(text: str) -> np.ndarray:
    """Printable ASCII as itself, other letters as one code, the rest as another."""
    return np.array([ord(c) - 31 if 32 <= ord(c) < 127 else 96 if c.isalpha() else 97 for c in text], np.int64)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lstm(x: np.ndarray, wx: np.ndarray, wh: np.ndarray):
    """Hidden states of windows (time x window x unit) and what the gradient needs."""
    t, n = x.shape
    h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    hs, saved = np.zeros((t, n, HIDDEN), np.float32), []
    for k in range(t):
        z = wx[x[k]] + h @ wh
        gates, g = _sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        before, c = c, f * c + i * g
        tc = np.tanh(c)
        saved.append((h, before, i, f, o, g, tc))
        hs[k] = h = o * tc
    return hs, saved


def _lstm_grad(x, wx, wh, saved, dhs):
    dwh, dzs = np.zeros_like(wh), np.empty((*x.shape, wx.shape[1]), wx.dtype)
    dh = dc = np.zeros_like(dhs[0])
    for k in range(len(x) - 1, -1, -1):
        h0, c0, i, f, o, g, tc = saved[k]
        dh = dh + dhs[k]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        dzs[k] = dz
        dwh += h0.T @ dz
        dh, dc = dz @ wh.T, dc * f
    flat, order = dzs.reshape(-1, wx.shape[1]), np.argsort(x, axis=None, kind="stable")
    codes_, begin = np.unique(x.reshape(-1)[order], return_index=True)
    dwx = np.zeros_like(wx)
    dwx[codes_] = np.add.reduceat(flat[order], begin, axis=0)
    return dwx, dwh


@dataclass
class Tagger:
    p: dict[str, np.ndarray]

    @classmethod
    def new(cls, seed: int = 5) -> Tagger:
        r = np.random.Generator(np.random.PCG64(seed))
        draw = lambda *s: (r.normal(size=s) * 0.15).astype(np.float32)
        p = {"fx": draw(98, 4 * HIDDEN), "fh": draw(HIDDEN, 4 * HIDDEN), "bx": draw(98, 4 * HIDDEN), "bh": draw(HIDDEN, 4 * HIDDEN), "out": draw(2 * HIDDEN, LABELS), "bias": draw(LABELS), "trans": draw(LABELS, LABELS)}
        for k in ("fx", "bx"):
            p[k][:, HIDDEN : 2 * HIDDEN] += 0.5
        return cls(p)

    def emissions(self, x: np.ndarray, keep: bool = False):
        p = self.p
        f, sf = _lstm(x, p["fx"], p["fh"])
        b, sb = _lstm(x[::-1], p["bx"], p["bh"])
        h = np.concatenate([f, b[::-1]], axis=2)
        e = h @ p["out"] + p["bias"]
        return (e, h, sf, sb) if keep else e

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        p = self.p
        e, h, sf, sb = self.emissions(x, keep=True)
        post, pair, logz = marginals(e, p["trans"])
        t, n = x.shape
        own = np.take_along_axis(e, y[:, :, None], 2).sum() + p["trans"][y[:-1], y[1:]].sum()
        de = post.copy()
        np.put_along_axis(de, y[:, :, None], np.take_along_axis(de, y[:, :, None], 2) - 1, 2)
        dt = pair
        np.add.at(dt, (y[:-1], y[1:]), -1)
        dh = de @ p["out"].T
        g = {"out": h.reshape(t * n, -1).T @ de.reshape(t * n, -1), "bias": de.sum((0, 1)), "trans": dt}
        g["fx"], g["fh"] = _lstm_grad(x, p["fx"], p["fh"], sf, dh[:, :, :HIDDEN])
        g["bx"], g["bh"] = _lstm_grad(x[::-1], p["bx"], p["bh"], sb, dh[::-1, :, HIDDEN:])
        return float(logz.sum() - own) / n, {k: v / n for k, v in g.items()}


def marginals(e: np.ndarray, trans: np.ndarray):
    """Posteriors (time x sequence x label), summed pair posteriors and log partitions."""
    t, n, _ = e.shape
    top = e.max(axis=2, keepdims=True)
    x, m = np.exp(e - top), np.exp(trans)
    fwd, bwd, logz = np.empty_like(x), np.ones_like(x), top[:, :, 0].sum(axis=0).astype(np.float64)
    for k in range(t):
        a = x[k] if not k else (fwd[k - 1] @ m) * x[k]
        s = a.sum(axis=1, keepdims=True)
        fwd[k] = a / s
        logz += np.log(s[:, 0])
    pair = np.zeros_like(trans)
    for k in range(t - 2, -1, -1):
        r = bwd[k + 1] * x[k + 1]
        b = r @ m.T
        s = (fwd[k] * b).sum(axis=1, keepdims=True)
        pair += (fwd[k] / s).T @ r * m
        bwd[k] = b / b.sum(axis=1, keepdims=True)
    post = fwd * bwd
    return post / post.sum(axis=2, keepdims=True), pair, logz


def viterbi(e: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best label paths (time x sequence)."""
    t, n, _ = e.shape
    best, back = e[0], np.zeros(e.shape, np.int64)
    for k in range(1, t):
        s = best[:, :, None] + trans
        back[k] = s.argmax(axis=1)
        best = np.take_along_axis(s, back[k][:, None, :], 1)[:, 0] + e[k]
    path = np.zeros((t, n), np.int64)
    path[-1] = best.argmax(axis=1)
    for k in range(t - 1, 0, -1):
        path[k - 1] = back[k][np.arange(n), path[k]]
    return path


# --- training -----------------------------------------------------------------------------


def _example(rng: np.random.Generator) -> tuple[str | None, str]:
    """(kind or None, text) of a made-up piece of personal data, or of something like it."""
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    pick = lambda *of: of[rng.integers(len(of))]
    name = lambda a=3, b=9: "".join(map(chr, rng.integers(97, 123, int(rng.integers(a, b)))))
    cased = lambda t: pick(t, t, t.title(), t.upper())
    hexes = lambda n: "".join(pick(*"0123456789abcdef") for _ in range(n))
    mixed = lambda n: "".join(pick(*"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    kind = pick("email", "email", "email", "phone", "phone", "card", "ip", "secret", None, None, None)
    if kind == "email":
        open_, shut = pick("[]", "()", "[]", "()", "{}", "<>")
        around = pick("", "", " ")
        mark = lambda w: around + open_ + w + shut + around
        dot, at = pick((".", "@"), (".", "@"), (" dot ", " at "), (" dot ", " at "), (" dot ", " at "), (".", " at "), (".", " at "), (mark("dot"), mark("at")), (".", mark("at")), (mark("dot"), "@"), (".", mark("@")), (mark("."), "@"), (" dot ", mark("at")), (".", " @ "))
        own = name() + pick("", "", pick(".", dot, "_", "-") + pick(name(), digits(2)), digits(2))
        host = dot.join([name() + pick("", "", digits(1)), *([name()] if rng.random() < 0.3 else []), pick("com", "org", "net", "de", "io", "co" + dot + "uk", "example" + dot + "com")])
        return kind, pick(str, str, str, cased)(own + at + host)
    if kind == "ip":
        dot = pick(".", ".", "[.]", " dot ", "(.)", "[dot]", "(dot)")
        return kind, dot.join(str(rng.integers(0, 256)) for _ in range(4))
    if kind == "card":
        body = (pick("4", "5", "37", "6011") + digits(15))[:15]
        body += next(d for d in "0123456789" if luhn(body + d))
        sep = pick("", " ", "-", ".", ".", "/")
        return kind, sep.join(body[i : i + 4] for i in range(0, 16, 4))
    if kind == "phone":
        a, b, c, land = digits(3), digits(3), digits(4), int(rng.integers(1, 99))
        return kind, pick(f"+{land} ({a}) {b}-{c}", f"+{land} {a} {b} {c}", f"({a}) {b}-{c}", f"({a}) {b} {c}", f"({a}){b}-{c}", f"00{land} {a} {b}{c}", f"00{land} {a} {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"1-{a}-{b}-{c}", f"0{digits(2)} {b}{c}", f"0{a}/{b}{c}", f"+{land}{a}{b}{c}")
    if kind == "secret":
        return kind, pick(lambda: hexes(int(pick(32, 40, 40, 64))), lambda: "AKIA" + mixed(16).upper(), lambda: "ghp_" + mixed(36), lambda: "sk-" + mixed(int(rng.integers(20, 48))), lambda: mixed(int(rng.integers(20, 44))) + pick("", "=", "=="))()
    return None, pick(f"{digits(1)}.{digits(1)}", digits(4), f"{rng.integers(1990, 2030)}-{digits(2)}-{digits(2)} {digits(2)}:{digits(2)}", f"{digits(2)}.{digits(2)}.{rng.integers(1990, 2030)}", f"v{digits(1)}.{digits(1)}.{digits(1)}", f"${digits(3)}.{digits(2)}", f"{name()}{digits(3)}", f"{digits(2)}%", digits(int(rng.integers(5, 24))), digits(int(rng.integers(10, 20))), digits(16), f"@{name()}", f"look at {name()}.", f"{name()} at {name()}. {name()}", f"{name()} dot {name()}", f"{digits(3)} {name()} {digits(2)}", f"{digits(4)} {digits(4)} {digits(3)}, {digits(2)}", f"{digits(2)} {digits(3)} {digits(5)} {digits(2)} {digits(1)}", "-".join(name() for _ in range(4)), f"https://{name()}.com/{name()}/{digits(4)}", f"{name(6, 9)}_{name(6, 9)}_{name()}{digits(1)}", f"ISBN {digits(3)}-{digits(1)}-{digits(5)}-{digits(3)}-{digits(1)}")


def _labels(n: int, spans: list[Span], shift: int) -> np.ndarray:
    """Labels of the characters from ``shift`` on; of a span cut there, only further characters are seen."""
    y = np.zeros(n, np.int64)
    for kind, a, b in spans:
        k = 1 + 2 * ALL_KINDS.index(kind)
        a, b = a - shift, b - shift
        if b > 0 and a < n:
            y[max(0, a) : b] = k + 1
            if a >= 0:
                y[a] = k
    return y


def examples(rng: np.random.Generator, fillers: list[str], n: int):
    """``n`` made-up texts with their spans: pieces set into words of ``fillers``."""
    words = [w for t in fillers for w in t.split() if not _DIGIT.search(w) and "@" not in w] or ["of", "the", "and"]
    # a third of the words are any letters, so that the network doesn't lean on the fillers' own
    any_ = lambda: "".join(map(chr, rng.integers(97, 123, int(rng.integers(1, 9)))))
    some = lambda: " ".join(words[i] if rng.random() < 0.67 else any_() for i in rng.integers(0, len(words), 12))
    for _ in range(n):
        kind, text = _example(rng)
        lead = str(rng.choice([" ", " ", " ", ": ", "\n", " (", " = ", ' "'])) if kind != "secret" else str(rng.choice([" = ", ' = "', ": ", "=", ' "', " "]))
        lead = (str(rng.choice(["token", "api_key", "secret", "key", "TOKEN", "password", ""])) if kind == "secret" else str(rng.choice(["", "", "", "mail", "to", "is", "contact", "call", "tel", "at", "id", "no"]))) + lead
        before = some() + " " + lead
        after = str(rng.choice([" ", " ", " ", ". ", ", ", "\n", ") ", '" ', "! ", "### "])) + some()
        yield before + text + after, [(kind, len(before), len(before) + len(text))] if kind else []


def train(contexts: list[str], seed: int = 5, made: int = FIT_EXAMPLES, epochs: int = 8) -> Tagger:
    """Fit from the base spans of ``contexts`` (pieces of texts) and from made-up spans set into their words."""
    rng = np.random.Generator(np.random.PCG64(seed))
    xs, ys = [], []

    def add(text: str, spans: list[Span], at: int) -> None:
        at = max(0, min(at, len(text) - WINDOW))
        part = text[at : at + WINDOW].ljust(WINDOW)
        xs.append(codes(part))
        ys.append(_labels(WINDOW, [s for s in spans if s[2] > at and s[1] < at + WINDOW], at))

    for t in contexts:
        spans = base_spans(t)
        if any(all(b <= x or a >= y for _, x, y in spans) for a, b in open_runs(t)):
            continue  # it may hold what the base patterns don't label
        at = spans[0][1] if spans else int(rng.integers(0, max(1, len(t))))
        add(t, spans, at - int(rng.integers(0, WINDOW)))
    for text, spans in examples(rng, contexts, made):
        at = spans[0][1] if spans else len(text) // 2
        add(text, spans, at - int(rng.integers(-8, WINDOW - 16)))
    x, y = np.stack(xs), np.stack(ys)
    net = Tagger.new(seed)
    m, v, step = {k: 0 * w for k, w in net.p.items()}, {k: 0 * w for k, w in net.p.items()}, 0
    steps = epochs * -(-len(x) // 128)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for s in range(0, len(x), 128):
            part = order[s : s + 128]
            _, g = net.gradient(x[part].T, y[part].T)
            step += 1
            rate = 0.02 * min(1, step / 20) * (1 - 0.95 * step / steps)
            for k, w in net.p.items():
                gk = np.clip(g[k], -5, 5).astype(np.float32)
                m[k] = 0.9 * m[k] + 0.1 * gk
                v[k] = 0.99 * v[k] + 0.01 * gk * gk
                w -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
    return net


# --- application --------------------------------------------------------------------------


def _mail_runs(text: str):
    """Longest runs of the form of an e-mail, plain or spelled out."""
    if not _MAIL_SIGN.search(text):
        return
    for m in _HOST.finditer(text):
        a, word = m.start(), True
        while a:
            if word:
                b = a
                while b and (text[b - 1].isalnum() or text[b - 1] in "_%+-"):
                    b -= 1
                if b == a:
                    break
                a, word = b, False
            else:
                dot = _LAST_DOT.search(text, max(0, a - 12), a)
                if dot is None:
                    break
                a, word = dot.start(), True
        yield a, m.end()


def open_runs(text: str) -> list[tuple[int, int]]:
    """Ascending disjoint runs of characters that may lie in a span that ``_valid`` accepts."""
    runs = list(_mail_runs(text))
    if _DIGIT.search(text):
        runs += [m.span() for m in _NUMBER.finditer(text) if len(_DIGIT.findall(m.group())) >= 10]
        runs += [m.span() for m in _TOKEN.finditer(text) if _DIGIT.search(m.group()) and _ALPHA.search(m.group())]
        for m in _IP.finditer(text):
            a, b = m.span()
            while a and text[a - 1].isdigit():  # a longer number before it
                a -= 1
            runs.append((a, b))
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _valid(kind: str, whole: str, a: int, b: int) -> bool:
    """Whether a model span is one whole token or more, of the kind's form."""
    text = whole[a:b]
    if a and whole[a - 1].isalnum() or whole[b : b + 1].isalnum():
        return False
    digits = "".join(_DIGIT.findall(text))
    if kind == "email":
        return bool(_EMAIL.fullmatch(text))
    if kind == "ip":
        return bool(_IP.fullmatch(text)) and all(int(p) < 256 for p in re.findall("[0-9]+", text))
    if kind == "secret":
        return bool(_TOKEN.fullmatch(text) and digits and _ALPHA.search(text))
    if not _NUMBER.fullmatch(text):
        return False
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits) and "+" not in text and "(" not in text
    return 10 <= len(digits) <= 15 and (len(digits) < len(text) or text[:2] == "00")


def _emissions(net: Tagger, texts: list[str], runs: list[tuple[int, int, int]]) -> list[np.ndarray]:
    """Emissions of the characters of runs (text, start, end), over all windows that touch them."""
    rows: dict[tuple[int, int], int] = {}
    for d, a, b in runs:
        last = STRIDE * -(-max(0, len(texts[d]) - WINDOW) // STRIDE)
        for s in range(max(0, STRIDE * ((a - WINDOW) // STRIDE + 1)), min(b, last + 1), STRIDE):
            rows.setdefault((d, s), len(rows))
    weight = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)[:, None]
    sums = [np.zeros((b - a, LABELS + 1), np.float32) for _, a, b in runs]
    by_text: dict[int, list[int]] = {}
    for k, (d, _, _) in enumerate(runs):
        by_text.setdefault(d, []).append(k)
    listed, at = list(rows), {}
    for g in range(0, len(listed), GROUP):
        part = listed[g : g + GROUP]
        x = np.full((len(part), WINDOW), 1, np.int64)  # a space's code
        for r, (d, s) in enumerate(part):
            own = codes(texts[d][s : s + WINDOW])
            x[r, : len(own)] = own
        e = net.emissions(x.T)
        for r, (d, s) in enumerate(part):
            own, k = by_text[d], at.get(d, 0)
            while k < len(own) and runs[own[k]][2] <= s:
                k += 1
            at[d] = k  # windows of a text ascend
            while k < len(own) and runs[own[k]][1] < s + WINDOW:
                _, a, b = runs[own[k]]
                lo, hi = max(a, s), min(b, s + WINDOW)
                sums[own[k]][lo - a : hi - a, :LABELS] += e[lo - s : hi - s, r] * weight[lo - s : hi - s]
                sums[own[k]][lo - a : hi - a, LABELS:] += weight[lo - s : hi - s]
                k += 1
    return [x[:, :LABELS] / x[:, LABELS:] for x in sums]


def decode(net: Tagger, emissions: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Best labels and their posteriors of runs, each between two characters fixed to outside."""
    out: list = [None] * len(emissions)
    order, s = sorted(range(len(emissions)), key=lambda k: -len(emissions[k])), 0
    while s < len(order):
        longest = len(emissions[order[s]]) + 2
        part = order[s : s + max(1, CELLS // longest)]
        s += len(part)
        e = np.full((longest, len(part), LABELS), -99, np.float32)
        e[:, :, 0] = 0  # before, after and beyond: outside
        for r, k in enumerate(part):
            e[1 : 1 + len(emissions[k]), r] = emissions[k]
        path, post = viterbi(e, net.p["trans"]), marginals(e, net.p["trans"])[0]
        sure = np.take_along_axis(post, path[:, :, None], 2)[:, :, 0]
        for r, k in enumerate(part):
            n = len(emissions[k])
            out[k] = path[1 : 1 + n, r].astype(np.uint8), sure[1 : 1 + n, r].astype(np.float32)
    return out


def find_spans(net: Tagger, texts: list[str | None]) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of whole texts; a model span that touches a base one gives way to it.

    Memory grows with the texts given at once; a text's own with its length.
    """
    texts = [t or "" for t in texts]
    base = [base_spans(t) for t in texts]
    runs = [(d, lo, hi) for d, text in enumerate(texts) for lo, hi in open_runs(text)]
    extra: list[list[Span]] = [[] for _ in texts]
    for (d, lo, _), (y, sure) in zip(runs, decode(net, _emissions(net, texts, runs)), strict=True):
        for i in map(int, np.flatnonzero(y % 2 == 1)):
            j = i + 1
            while j < len(y) and y[j] == y[i] + 1:
                j += 1
            kind = ALL_KINDS[(y[i] - 1) // 2]
            if sure[i:j].mean() >= CERTAIN and _valid(kind, texts[d], lo + i, lo + j):
                extra[d].append((kind, lo + i, lo + j))
    out = []
    for own, more in zip(base, extra, strict=True):
        new = [s for s in more if all(s[2] <= b[1] or s[1] >= b[2] for b in own)]
        out.append((own, sorted(own + new, key=lambda s: (s[1], ALL_KINDS.index(s[0]), s[2]))))
    return out


def _contexts(text: str) -> list[str]:
    """Pieces of a text around its base spans, and as many from its other parts."""
    spans = base_spans(text)
    pieces = [text[max(0, a - WINDOW) : min(b, a + 2 * WINDOW) + WINDOW] for _, a, b in spans]
    step = max(1, len(text) // max(2, len(spans)))
    return pieces + [text[a : a + 2 * WINDOW] for a in range(0, len(text), step)]


def fit(docs: DataFrame, rows: int = FIT_DOCS, contexts: int = FIT_CONTEXTS) -> Tagger:
    """Learn from at most ``contexts`` short pieces of at most ``rows`` documents that hold a digit or an at sign.

    Both are chosen by hashes; pieces, not texts, reach the driver.
    """
    some = docs.where(F.col("text").rlike("[0-9@]") & F.col("doc_id").isNotNull())
    # ids first, so that no task sends texts that aren't taken
    ids = [r[0] for r in some.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()]
    if not ids:
        return train([])
    shared.text_batches(docs.sparkSession)

    def cut(batches):
        for pdf in batches:
            yield pd.DataFrame({"piece": [p for t in pdf["text"] for p in _contexts(t)]}, dtype=object)

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"net": [pickle.dumps(train(pdf.sort_values(["at", "piece"])["piece"].tolist()).p)]})

    pieces = some.where(F.col("doc_id").isin(ids)).select(F.col("text").cast("string")).mapInPandas(cut, "piece string")
    taken = pieces.select("piece", F.xxhash64("piece").alias("at")).orderBy("at", "piece").limit(contexts)
    # one task fits it, on one thread; what it reads is bounded
    return Tagger(pickle.loads(taken.groupBy(F.lit(1).alias("one")).applyInPandas(learn, "net binary").first()["net"]))


def detect(docs: DataFrame, net: Tagger, redacted: bool = False) -> DataFrame:
    """``docs`` with base and spans: arrays of (kind, start, end) in code points, end exclusive.

    Null and empty texts have none; repeated rows repeat; other columns stay, but for clashing
    ``base`` and ``spans``, which are replaced; the name ``_pii`` is kept for this function's use.
    ``redacted`` adds a column of that name: the text as ``redact`` gives it, by the same workers.
    """
    shared.text_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(net)
    kind = "array<struct<kind:string,start:long,end:long>>"

    def spans(texts: pd.Series) -> pd.DataFrame:
        found = find_spans(model.value, texts.tolist())
        listed = lambda s: [{"kind": k, "start": a, "end": b} for k, a, b in s]
        out = pd.DataFrame({"base": [listed(a) for a, _ in found], "spans": [listed(b) for _, b in found]})
        if redacted:
            out["redacted"] = pd.Series([replaced(t, [(a, e) for _, a, e in b]) for t, (_, b) in zip(texts, found, strict=True)], dtype=object)
        return out

    spans.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    new = ["base", "spans", *["redacted"] * redacted]
    udf = F.pandas_udf(spans, f"base {kind}, spans {kind}" + ", redacted string" * redacted)
    return docs.drop(*new).withColumn("_pii", udf(F.col("text").cast("string"))).select("*", *[f"_pii.{c}" for c in new]).drop("_pii")


def replaced(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text with each span, joined where they overlap, replaced by <PII>."""
    if text is None or not spans:
        return text
    parts, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            parts += [text[at:a], "<PII>"]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def redact(text, spans):
    """Column: the text with each span (joined where they overlap) replaced by <PII>."""

    def run(texts: pd.Series, found: pd.Series) -> pd.Series:
        pairs = ([(x["start"], x["end"]) for x in s] if s is not None else [] for s in found)
        return pd.Series([replaced(t, p) for t, p in zip(texts, pairs, strict=True)], dtype=object)

    run.__annotations__ = {"texts": pd.Series, "found": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")(text, spans)


def op5_pii_bilstm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = detect(docs, fit(docs)).select("doc_id", "base", "spans")
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return rows.select("doc_id", *[count(k) for k in KINDS], F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))
