"""Packing token sequences into windows by best-fit decreasing.

A document longer than the window is first cut into full windows; what is left of every document
is placed whole, longest first, into the open window with the least room that still takes it. A
segment tree indexed by remaining capacity finds that window in log(window) steps. Windows that
stay poorly filled are cut anew: their tokens fill whole windows, and the last few are dealt to
sequences whose lengths are powers of two, which need no padding.

Packing runs inside each input partition over blocks of a bounded number of tokens, so it needs
no shuffle and its memory does not grow with the input; a lost task packs its rows again to the
same result.

Defined results: a null text is empty and holds its end id alone; null doc_ids stay null; repeated
rows are packed one by one; an empty table makes no pieces; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import runtime, textbuf
from .tokenize import loaded

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
#: Tokens that are packed together, and the share of a window that may stay empty.
BLOCK_TOKENS, SLACK = 4 << 20, 0.01


class RoomTree:
    """Open windows by remaining capacity; tightest(n) pops one with the least room of at least n."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(self.leaves)]

    def _add(self, room: int, by: int) -> None:
        node = self.leaves + room
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, room: int, window: int) -> None:
        self.open[room].append(window)
        self._add(room, 1)

    def tightest(self, need: int) -> tuple[int, int] | None:
        """(window, its room), or None if no open window takes need."""
        node, count = self.leaves + need, self.count
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._add(room, -1)
        return self.open[room].pop(), room


def best_fit_decreasing(lengths: list[int], window: int) -> list[list[int]]:
    """The items of each window, in the order placed."""
    tree, windows = RoomTree(window), []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = tree.tightest(lengths[item])
        if found is None:
            found = len(windows), window
            windows.append([])
        windows[found[0]].append(item)
        if left := found[1] - lengths[item]:
            tree.put(left, found[0])
    return windows


def pack_lengths(lengths: list[int], window: int, slack: float = SLACK) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, first token, tokens): best fit decreasing, then the poor windows cut anew."""
    done, poor = [], []
    for items in best_fit_decreasing(lengths, window):
        if window - sum(lengths[i] for i in items) <= slack * window:
            done.append([(i, 0, lengths[i]) for i in items])
        else:
            poor += items
    left = sum(lengths[i] for i in poor)
    sizes = [window] * (left // window) + [1 << b for b in range(window.bit_length(), -1, -1) if (left % window) >> b & 1]
    source = iter(poor)
    item, at = None, 0
    for size in sizes:
        sequence = []
        while size:
            if item is None or at == lengths[item]:
                item, at = next(source), 0
            n = min(size, lengths[item] - at)
            sequence.append((item, at, n))
            at, size = at + n, size - n
        done.append(sequence)
    return done


def _packer(tokenizer_file: str, end_id: int, window: int, block_tokens: int):
    @runtime.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, sequence = loaded(tokenizer_file), TaskContext.get().partitionId() << 40
        rest: list[tuple] = []  # (doc_id, start, doc_tokens, ids) of what is left of each document
        held = 0

        def rows(pieces: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*pieces, strict=True))
            kinds = [pa.int64()] * 6 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        def pack() -> Iterator[pa.RecordBatch]:
            nonlocal rest, held, sequence
            made: list[tuple] = []
            for parts in pack_lengths([len(r[3]) for r in rest], window):
                offset = 0
                for item, first, n in parts:
                    doc, start, total, ids = rest[item]
                    made.append((doc, start + first, n, total, sequence, offset, ids[first : first + n].tobytes()))
                    offset += n
                sequence += 1
                if len(made) >= 1000:
                    yield rows(made)
                    made = []
            if made:
                yield rows(made)
            rest, held = [], 0

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for first, end, buf, offsets in textbuf.chunks(batch.column(1)):
                ids, at = tokenizer.encode(buf, offsets)
                ids, whole = ids.astype("<u4"), []
                for row in range(first, end):
                    own = np.append(ids[at[row - first] : at[row - first + 1]], np.uint32(end_id)).astype("<u4")
                    full = len(own) // window * window
                    for start in range(0, full, window):
                        whole.append((doc_ids[row], start, window, len(own), sequence, 0, own[start : start + window].tobytes()))
                        sequence += 1
                    if full < len(own):
                        rest.append((doc_ids[row], full, len(own), own[full:].copy()))
                        held += len(own) - full
                if whole:
                    yield rows(whole)
                if held >= block_tokens:
                    yield from pack()
        if rest:
            yield from pack()

    return run


def pack(docs: DataFrame, tokenizer_file: str, end_id: int, window: int = 2048, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start and length in its document, doc_tokens, sequence_id, offset there,
    and ids (little-endian unsigned 32-bit)."""
    runtime.bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_packer(tokenizer_file, end_id, window, block_tokens), SCHEMA)
