"""Whole-text token ids of public tokenizers, with a cache of chunks that is bounded in bytes.

A text is cut only at single spaces that no token of the vocabulary can reach across, and each
distinct chunk is encoded once by the tokenizers library, so ids equal those of the whole text.
Where a text may be cut depends on the tokenizer's declared normaliser and pre-tokenizer: the
two forms that are known here are recognised when a vocabulary is loaded; texts of any other
vocabulary go to the library whole.
"""

from __future__ import annotations

import ctypes
import gc
import json
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np

#: A single space between two characters that aren't white space: no pre-token spans it.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_UNEVEN = re.compile(r"\s\s|\A\s|\s\Z")
_RARE = re.compile(r"[\t\v\f\r\x1c-\x1f]")
_RARE_WIDE = re.compile(r"[\t\v\f\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Marks that are pre-tokens of their own after an ASCII letter or digit, whatever stands before that.
_MARKS = frozenset(".,:;!?")
#: Words of letters that have no other composed form: pre-tokens of their own between spaces.
_PLAIN = re.compile(r"[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff\u0430-\u044f\u0451]+")
#: Texts whose small letters are those that the tokenizer's own normaliser gives.
_LATIN = re.compile(r"[^\x00-\u012f\u0131-\u0148\u014a-\u017f]")
#: Separators to Python that are no white space to the tokenizer.
_CONTROL = re.compile(r"[\x1c-\x1f]")
_FEED = ("\n",)
#: Bounds of the cache: distinct chunks and their characters.
CHUNKS, CHARACTERS = 500_000, 10_000_000

# What the two known forms of vocabulary declare.
BYTES_SPACED = (None, {"type": "ByteLevel", "use_regex": True, "add_prefix_space": False})
WORDS_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def declared_form(path: str) -> str:
    """``spaced`` (a word's token has its leading space), ``worded`` (white space is dropped) or ``other``."""
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    norm, pre, model = j.get("normalizer"), j.get("pre_tokenizer") or {}, j.get("model", {})
    plain = model.get("type") == "BPE" and not model.get("dropout") and not model.get("ignore_merges")
    if any(t.get("lstrip") or t.get("rstrip") or " " in t["content"] for t in j.get("added_tokens", [])) or not plain:
        return "other"
    if norm is None and all(pre.get(k) == v for k, v in BYTES_SPACED[1].items()):
        return "spaced"
    steps, cuts = (norm or {}).get("normalizers", []), pre.get("pretokenizers", [])
    if [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " ":
        split = {"pattern": {"Regex": WORDS_PATTERN}, "behavior": "Removed", "invert": True}
        if len(cuts) == 2 and all(cuts[0].get(k) == v for k, v in split.items()) and cuts[1].get("use_regex") is False and not cuts[1].get("add_prefix_space"):
            return "worded"
    return "other"


def _even(text: str) -> bool:
    """Whether each space surely stands alone between two other characters than white space."""
    if "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[0] == " " or text[-1] == " ":
        return False
    rare = _RARE if text.isascii() else _RARE_WIDE
    return not rare.search(text) or not _UNEVEN.search(text)


def byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write byte b as a printable character: its own, or one from 256 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = byte_letters()


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Index(dict):
    """Number of each chunk, new ones in order of appearance."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, chunk):
        self.new.append(chunk)
        self[chunk] = at = len(self)
        return at


class ChunkEncoder:
    """Token ids of whole texts.

    The ids of all known chunks lie in one flat array.  When the cache is full, chunks that came
    once since the last time are dropped, and all of them if that doesn't empty half of it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok, self.form = Tokenizer.from_file(path), declared_form(path)
        self.spaced = self.form == "spaced"
        self.marks = {m: self.tok.encode(m, add_special_tokens=False).ids for m in _MARKS}
        self.index = _Index()
        self._empty()

    def _empty(self) -> None:
        self.index.clear()
        self.characters = self.used = self.known = 0
        self.flat, self.ends, self.seen = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _shrink(self) -> None:
        often = self.seen[: self.known] > 1
        if 2 * int(often.sum()) > CHUNKS:
            return self._empty()
        size = np.diff(self.ends[: self.known + 1])
        flat = self.flat[: self.used][np.repeat(often, size)]
        kept = [c for c, k in zip(self.index, often, strict=True) if k]
        self._empty()
        for c in kept:
            self.index[c] = len(self.index)
        self._append(flat, size[often])
        self.characters = sum(map(_size, kept))

    def _append(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        total, n = len(ids), len(sizes)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.known + n + 1 > len(self.ends):
            self.ends, self.seen = (np.concatenate([x, np.zeros_like(x)]) for x in (self.ends, self.seen))
        self.flat[self.used : self.used + total] = ids
        self.ends[self.known + 1 : self.known + 1 + n] = self.used + np.cumsum(sizes)
        self.used += total
        self.known += n

    def _learn(self) -> None:
        """Encode the new chunks; one that ends in a mark of its own takes its ids from the chunk without it."""
        new, marked = self.index.new, []
        if not new:
            return
        first, known, k = self.known, self.index, 0
        while k < len(new):  # grows by the chunks without their marks
            c = new[k]
            # only ASCII: other characters may be several after normalisation, the last of them a mark
            if type(c) is str and len(c) > 1 and c[-1] in _MARKS and c[-2].isascii() and c[-2].isalnum():
                marked.append((k, known[c[:-1]], c[-1]))
            k += 1
        ids: list = [None] * len(new)
        of = {k: (base, mark) for k, base, mark in marked}
        model, plain, rest = self.tok.model.tokenize, _PLAIN.fullmatch, []
        for k, c in enumerate(new):
            if k in of:
                continue
            text = c[0] if type(c) is tuple else " " + c if self.spaced else c.lower() if c.isascii() else c
            if type(c) is str and plain(c) and (self.spaced or text is not c or c.islower()):
                ids[k] = [t.id for t in model(text.encode().decode("latin-1").translate(_LETTERS))]  # one pre-token
            else:
                rest.append((k, text))
        for (k, _), e in zip(rest, self.tok.encode_batch_fast([t for _, t in rest], add_special_tokens=False), strict=True):
            ids[k] = e.ids
        for k, (base, mark) in of.items():
            ids[k] = (ids[base - first] if base >= first else self.flat[self.ends[base] : self.ends[base + 1]].tolist()) + self.marks[mark]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self._append(np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())), sizes)
        self.characters += sum(map(_size, new))
        new.clear()

    def _chunks(self, text: str) -> list:
        """Chunks of a text that isn't empty; in spaced form one in a tuple has no space before it."""
        if not self.spaced:
            text = text if _LATIN.search(text) else text.lower()
            if not _CONTROL.search(text):
                return text.split()  # all of it white space to the tokenizer too
            cut = text.split(" ")
            return [c for c in cut if c] if "" in cut else cut
        if not _even(text):
            cut = _CUT.split(text)
            return [(cut[0],), *cut[1:]]
        out: list = []
        for line in text.split("\n"):  # single line feeds are tokens of their own
            cut = line.split(" ")
            out += [_FEED, (cut[0],), *cut[1:]] if out else [(cut[0],), *cut[1:]]
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """One uint32 array for each text; null is empty."""
        if self.form == "other":
            return [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        out, open_ = [], 0
        for text in texts:
            chunks = self._chunks(text) if text else []
            at = np.fromiter(map(self.index.__getitem__, chunks), np.int64, len(chunks))
            out.append(at)
            open_ += len(at)
            if open_ > 200_000:
                self._gather(out)
                open_ = 0
        self._gather(out)
        return out

    def _gather(self, out: list[np.ndarray]) -> None:
        """Replace the last entries, chunk numbers (int64), by the chunks' ids (uint32)."""
        self._learn()
        for k in range(len(out) - 1, -1, -1):
            a = out[k]
            if a.dtype != np.int64:
                break
            np.add.at(self.seen, a, 1)
            begin = self.ends[a]
            size = self.ends[a + 1] - begin
            shift = np.repeat(begin - (np.cumsum(size) - size), size)
            shift += np.arange(len(shift))
            out[k] = self.flat[shift]
        if self.known > CHUNKS or self.characters > CHARACTERS:
            self._shrink()


def _size(chunk: str | tuple) -> int:
    return len(chunk[0]) if isinstance(chunk, tuple) else len(chunk)


@lru_cache(maxsize=4)
def encoder(path: str) -> ChunkEncoder:
    """One encoder for each worker process and vocabulary."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return ChunkEncoder(path)


def forget() -> None:
    """Drop this process's encoders and give freed memory back, for tasks that come after the last encoding."""
    if encoder.cache_info().currsize:
        encoder.cache_clear()
        gc.collect()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library keeps its own account
            pass
