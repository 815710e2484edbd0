"""Fast exact use of a public tokenizer file over many texts.

A text is cut into units at places where the tokenizer's own pre-tokenizer always cuts, each
distinct unit is tokenized once by the tokenizers library, and the ids of the whole text are
put together by numpy. Units with characters whose class might depend on the Unicode version
go through the library's full encoder, all others straight to its model. The strings of special
tokens become those tokens, as the library has it by default, and part the text around them.
"""

from __future__ import annotations

import re
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import regex

from . import textbuf

#: Units kept per worker; when full the cache starts anew, so memory stays bounded.
CACHE_UNITS = 600_000
#: Fixed patterns of the two public pre-tokenizers.
BYTE_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
WORD_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: ASCII and Latin letters: the same classes and cases in every Unicode version.
_PLAIN = regex.compile(r"[\x09\x0a\x0d\x20-\x7e¡-¬®-įĲ-ž]*")
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".,;:!?#$%&*|)]-/"]] = True
_NOT_SPACE = np.ones(256, bool)
_NOT_SPACE[[32, 9, 10, 11, 12, 13, 28, 29, 30, 31, 0xC2, 0xE1, 0xE2, 0xE3]] = False


def _byte_letters() -> dict[int, str]:
    """The byte-to-letter rule of byte-level tokenizers: printable bytes stay, the rest move up from 256."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in keep}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - len(keep))
    return table


class UnitTokenizer:
    """encode(bytes, offsets) gives the ids of all texts in one array and the offsets of each text's ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = {t.content.encode(): i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.specials = re.compile(b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or b"(?!)")
        self.model = self.tokenizer.model
        self.words = self.tokenizer.normalizer is not None
        self.letters = _byte_letters()
        self._clear()

    def _clear(self) -> None:
        # hashes of the units seen, ascending, and where each stands: two arrays hold far less than a dictionary
        self.known, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.store = np.zeros(1 << 16, np.int32)
        self.begin = np.zeros(1 << 14, np.int64)
        self.used = 0

    def _unit(self, raw: bytes) -> list[int]:
        word = raw if self.words else raw[1:] if raw[:1] == b" " else raw
        if word.isalpha():  # ASCII letters only: one piece
            plain = word.decode("ascii")
            return [t.id for t in self.model.tokenize(plain.lower() if self.words else plain if word is raw else "\u0120" + plain)]
        text = raw.decode("utf-8", "replace")
        if _PLAIN.fullmatch(text) and (not self.words or is_normalized("NFC", text)):
            found = WORD_PATTERN.findall(text.lower()) if self.words else BYTE_PATTERN.findall(text)
            return [t.id for w in found for t in self.model.tokenize(w.encode().decode("latin-1").translate(self.letters))]
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _boundaries(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # a letter before a mark that no contraction starts with: always a cut
        marked = np.flatnonzero(_LETTER[buf[:-1]] & _MARK[buf[1:]]) + 1
        if self.words:
            starts, ends, _ = textbuf.word_spans(buf, offsets)
            cut = np.zeros(len(buf) + 1, bool)
            cut[starts] = cut[marked] = True
            stop = np.zeros(len(buf) + 1, bool)
            stop[ends] = stop[marked] = True
            return np.flatnonzero(cut), np.flatnonzero(stop)
        n = len(buf)
        solid = _NOT_SPACE[buf]
        cut = np.zeros(n + 1, bool)
        # a space before something solid belongs to what follows, whatever stands before it
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        cut[: n - 1] |= (buf[:-1] == 32) & solid[1:] & ~edge[1:n]
        # a single line feed between solid characters stands alone
        alone = np.flatnonzero((buf[1:-1] == 10) & solid[:-2] & solid[2:] & (buf[:-2] < 128)) + 1
        cut[alone] = True
        cut[alone + 1] = True
        cut[marked] = True
        cut[offsets] = True
        places = np.flatnonzero(cut)
        return places[:-1], places[1:]

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's ids begin."""
        spans = [(m.start(), m.end(), self.special[m[0]]) for m in self.specials.finditer(buf.tobytes())]
        if not spans:
            return self._encode(buf, offsets)
        # what stands between special tokens are texts of their own; a string across two texts is none
        whole = np.searchsorted(offsets, [a for a, _, _ in spans], "right") == np.searchsorted(offsets, [b for _, b, _ in spans], "left")
        spans = [s for s, own in zip(spans, whole, strict=True) if own]
        cuts = np.unique(np.concatenate([offsets, *(s[:2] for s in spans)])) if spans else offsets
        ids, ends = self._encode(buf, cuts)
        code = dict((int(a), i) for a, _, i in spans)
        parts = [np.array([code[c]], np.int32) if c in code else ids[x:y] for c, x, y in zip(cuts[:-1].tolist(), ends[:-1], ends[1:], strict=True)]
        total = np.cumsum([0, *map(len, parts)])
        return np.concatenate(parts), total[np.searchsorted(cuts, offsets)]

    def _encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(buf) < 3:
            ids = [self.tokenizer.encode(buf[a:b].tobytes().decode("utf-8", "replace"), add_special_tokens=False).ids for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            ends = np.cumsum([0, *map(len, ids)])
            return np.array([i for x in ids for i in x], np.int32), ends.astype(np.int64)
        starts, ends = self._boundaries(buf, offsets)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        found = pa.array(textbuf.span_hashes(buf, starts, ends)).dictionary_encode()
        codes, keys = found.indices.to_numpy(), found.dictionary.to_numpy()
        if len(self.known) + len(keys) > CACHE_UNITS:
            self._clear()
        at = np.searchsorted(self.known, keys)
        places = np.full(len(keys), -1, np.int64)
        hit = np.flatnonzero(at < len(self.known))
        hit = hit[self.known[at[hit]] == keys[hit]]
        places[hit] = self.places[at[hit]]
        fresh = np.flatnonzero(places < 0)
        if len(fresh):
            first = np.empty(len(keys), np.int64)
            first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            base = len(self.known)
            rows, data = [], buf.tobytes()
            for i in first[fresh].tolist():
                rows.append(self._unit(data[starts[i] : ends[i]]))
            sizes = np.fromiter(map(len, rows), np.int64, len(rows))
            flat = np.fromiter((i for r in rows for i in r), np.int32, int(sizes.sum()))
            while self.used + len(flat) > len(self.store):
                self.store = np.concatenate([self.store, np.zeros_like(self.store)])
            while base + len(rows) + 1 > len(self.begin):
                self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
            self.store[self.used : self.used + len(flat)] = flat
            self.begin[base + 1 : base + len(rows) + 1] = self.used + np.cumsum(sizes)
            self.used += len(flat)
            places[fresh] = np.arange(base, base + len(rows))
            order = fresh[np.argsort(keys[fresh])]
            at = np.searchsorted(self.known, keys[order])
            self.places = np.insert(self.places, at, places[order])
            self.known = np.insert(self.known, at, keys[order])
        where = places[codes]
        begin = self.begin[where]
        sizes = self.begin[where + 1] - begin
        total = np.concatenate([[0], np.cumsum(sizes)])
        take = np.repeat(begin - total[:-1], sizes) + np.arange(total[-1])
        return self.store[take], total[np.searchsorted(starts, offsets)]


@lru_cache(maxsize=4)
def loaded(path: str) -> UnitTokenizer:
    """One tokenizer with its cache for the life of the worker."""
    return UnitTokenizer(path)
