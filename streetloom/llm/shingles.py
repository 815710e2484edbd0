"""Word shingles of whole texts and their parity sketches, as numpy passes over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from . import textbuf

_MULTIPLIERS = np.array([0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingle_sets(column: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct 64-bit shingle hashes) of each text: runs of `words` lower-cased words; a
    shorter text is one run; a text without words has none."""
    for first, end, buf, offsets in textbuf.chunks(column):
        buf = textbuf.lowered(buf)
        starts, ends, at = textbuf.word_spans(buf, offsets)
        hashes = textbuf.span_hashes(buf, starts, ends)
        runs = np.zeros(max(len(hashes) - words + 1, 0), np.uint64)
        for k in range(words):
            runs += hashes[k : len(hashes) - words + 1 + k] * _MULTIPLIERS[k]
        runs = textbuf.mix(runs + np.uint64(words))
        for row in range(first, end):
            a, b = at[row - first], at[row - first + 1]
            if b - a >= words:
                own = np.sort(runs[a : b - words + 1])
                yield row, own[np.concatenate([[True], own[1:] != own[:-1]])]
            elif b > a:
                short = (hashes[a:b] * _MULTIPLIERS[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                yield row, textbuf.mix(np.array([short], np.uint64))
            else:
                yield row, np.zeros(0, np.uint64)


def signature(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart, as two signed longs."""
    if not len(hashes):
        return 0, 0
    a = np.bitwise_xor.reduce(textbuf.mix(hashes + np.uint64(0x51ED270B27F0A3C5)))
    b = textbuf.mix(hashes ^ np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64)
    return int(np.uint64(a).astype(np.int64)), int(np.uint64(b).astype(np.int64))


class Bands:
    """Size bands, and how many lanes a sketch has in each.

    For sets of a <= b members with similarity of at least num/den, b <= a*den/num and the symmetric
    difference is at most (a+b)(den-num)/(den+num), the band's `most`. A lane is the parity (XOR) of the
    hashes of the members dealt to it, so each differing member changes one lane: similar sets agree
    in all but `most` lanes. A band has `COMMON` times `most` lanes more than that, and some to spare
    for lanes that stay empty, so similar sets agree in many lanes and not in just one.
    """

    RATIO, COMMON = 1.6, 0.5

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.low, self.lanes, self.most = [1], [], []

    def _grow(self, n: int) -> None:
        while self.low[-1] <= n:
            low = self.low[-1]
            high = max(low + 1, int(np.ceil(low * self.RATIO)))
            top = high - 1
            most = (top + top * self.den // self.num) * (self.den - self.num) // (self.den + self.num)
            need = lanes = most + 1 + int(self.COMMON * most)
            for _ in range(8):
                empty = lanes * np.exp(-low / lanes)
                lanes = need + int(np.ceil(empty + 2 * np.sqrt(empty)))
            self.low.append(high)
            self.lanes.append(lanes)
            self.most.append(most)

    def of(self, n: int) -> list[int]:
        """The bands of a set of n members: its own, and lower ones that hold sets similar to it. Bands whose
        similar sets can only be equal need no lanes."""
        self._grow(n)
        own = int(np.searchsorted(self.low, n, "right")) - 1
        least = -(-n * self.num // self.den)
        return [k for k in range(own, -1, -1) if self.most[k] and (k == own or self.low[k + 1] - 1 >= least)]


@lru_cache
def bands(num: int, den: int) -> Bands:
    return Bands(num, den)


#: The low bits of a lane's key tell its band.
BAND_BITS = 6


def lane_keys(hashes: np.ndarray, table: Bands) -> tuple[np.ndarray, list[int]]:
    """The keys of a set's lanes in all its bands (parity of the members dealt to each lane), and for each band
    64 * (keys that any similar set of the band shares at least) + band. Empty lanes have keys only if a
    set has so many of them that the others might all differ."""
    found, shared = [np.zeros(0, np.uint64)], []
    parity = textbuf.mix(hashes + np.uint64(0x632BE59BD9B4E019))
    for k in table.of(len(hashes)):
        lanes = table.lanes[k]
        lane = ((hashes >> np.uint64(32)) * np.uint64(lanes) >> np.uint64(32)).astype(np.int64)  # ascending, as hashes are
        firsts = np.flatnonzero(np.concatenate([[True], lane[1:] != lane[:-1]]))
        values = np.bitwise_xor.reduceat(parity, firsts)
        keys = textbuf.mix(values ^ textbuf.mix(np.uint64((k + 1) << 40) + lane[firsts].astype(np.uint64)))
        least = len(firsts) - table.most[k]
        if least <= 0:
            missing = np.setdiff1d(np.arange(lanes), lane[firsts]).astype(np.uint64)
            keys = np.concatenate([keys, textbuf.mix(textbuf.mix(np.uint64((k + 1) << 40) + missing) ^ np.uint64(0x1D8E4E27C47D124F))])
            least = 1  # a similar set may lack keys for its own empty lanes
        found.append((keys >> np.uint64(BAND_BITS) << np.uint64(BAND_BITS)) | np.uint64(k))
        shared.append(least << BAND_BITS | k)
    return np.concatenate(found), shared


def bit_sketch(hashes: np.ndarray) -> bytes:
    """A parity bit sketch of four to eight bits per member (a power of two): every member flips one bit, so
    the Hamming distance of two sketches is at most the symmetric difference of the sets."""
    bits = 64
    while bits < 4 * len(hashes):
        bits *= 2
    flips = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """Sketches (along the last axis) of the same sets with fewer bits: halves over each other by XOR."""
    while sketches.shape[-1] > words:
        half = sketches.shape[-1] // 2
        sketches = sketches[..., :half] ^ sketches[..., half:]
    return sketches


def stacked(column: pa.Array, rows: np.ndarray, words: int) -> np.ndarray:
    """The sketches of some rows of a binary column (all of one length there), as a matrix of 64-bit words."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)
    size = int(offsets[rows[0] + 1] - offsets[rows[0]])
    return folded(data[offsets[rows][:, None] + np.arange(size)].view("<u8"), words)
