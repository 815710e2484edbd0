"""Masked pseudo-likelihood scores from a small bidirectional window network.

The network sees the words on both sides of a masked one and predicts it in two steps: its group, and
its slot in the group. The most frequent words of the corpus have slots of their own, and their number
grows with the corpus; the others share the last slot of a group chosen by hash, in which a word's share
is its exact count in the corpus over that of all words there. So the probabilities of all words of the
corpus add up to one. A document's score is the sum, over every word, of the log probability of the
word given its neighbours on both sides.

Counts cover every word of the corpus and stay distributed: rare words travel to the part of the count
table that holds them. Training goes through every window of every document: each task trains from the
common weights on its own windows, and the tasks' weights are averaged by the windows they saw, for
ROUNDS rounds, each with its own share of the windows. A lost task trains again to the same weights.
The weights depend on how the input is split into tasks, as in any averaged training.

Defined results: a null text is empty; without words the sum is 0 and the mean null; null doc_ids
stay null; repeated rows are scored one by one; an empty table gives none; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime, textbuf

SIDE, WIDTH, HIDDEN = 2, 12, 32
#: Inputs that rare words share by hash; sums of counts by hash, from which those of any number of groups follow.
RARE_INPUTS, BUCKETS = 1024, 1 << 16
ROUNDS, RATE = 2, 0.08
SLICE = 16_384
#: Rare words that a task holds before it hands them on.
HELD = 2 << 20


def groups_for(n_words: int) -> int:
    """Groups, and slots of each, for a corpus of so many words: 35 for a quarter million, 62 for 80 million."""
    return max(4, int(np.ceil(10 * max(1, n_words) ** 0.1)))


def batch_for(n_words: int) -> int:
    """Windows of a training step: enough steps for a small corpus, few calls a window for a large one."""
    return min(8192, max(256, n_words // 256))


class Vocabulary:
    """Inputs, groups and slots of words by hash."""

    def __init__(self, frequent: np.ndarray, counts: np.ndarray, buckets: np.ndarray):
        """frequent: hashes of the most frequent words, in that order, at least as many as there are slots; buckets: counts of all words by hash."""
        self.n_words = int(buckets.sum())
        self.groups = groups_for(self.n_words)
        self.frequent = frequent[: self.groups * (self.groups - 1)]
        self.order = np.argsort(self.frequent)
        self.sorted = self.frequent[self.order]
        self.edge = len(self.frequent) + RARE_INPUTS  # the input that stands for a place before or after the text
        rest = np.bincount(np.arange(BUCKETS) % self.groups, buckets, self.groups)
        own = (self.frequent % np.uint64(BUCKETS) % np.uint64(self.groups)).astype(np.int64)
        rest -= np.bincount(own, counts[: len(self.frequent)], self.groups)
        self.log_rest = np.log(np.maximum(rest, 1))  # of the rare words of each group

    def classes(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Input, group and slot of each word, and which of them are rare. Narrow types, which sort fast."""
        kind = np.uint16 if self.edge < 1 << 16 else np.int32
        bucket = (hashes & np.uint64(BUCKETS - 1)).astype(np.int32)
        rank = np.full(len(hashes), -1, np.int32)
        if len(self.sorted):
            at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
            rank = np.where(self.sorted[at] == hashes, self.order[at], -1).astype(np.int32)
        rare = rank < 0
        inputs = np.where(rare, len(self.frequent) + bucket % RARE_INPUTS, rank).astype(kind)
        groups, slots = np.where(rare, bucket, rank) % self.groups, np.where(rare, self.groups - 1, rank // self.groups)
        return inputs, groups.astype(np.uint16), slots.astype(np.int32), rare

    def shapes(self) -> list[tuple[int, ...]]:
        g = self.groups
        return [(self.edge + 1, WIDTH), (2 * SIDE * WIDTH, HIDDEN), (HIDDEN,), (HIDDEN, g), (g,), (g, HIDDEN, g), (g, g)]


def fresh_weights(words: Vocabulary, seed: int = 5) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    scale = [0.1, 1 / np.sqrt(2 * SIDE * WIDTH), 0, 1 / np.sqrt(HIDDEN), 0, 1 / np.sqrt(HIDDEN), 0]
    return [rng.normal(0, s, shape).astype(np.float32) if s else np.zeros(shape, np.float32) for s, shape in zip(scale, words.shapes(), strict=True)]


def _windows(inputs: np.ndarray, at: np.ndarray, edge: int) -> np.ndarray:
    """The inputs on both sides of every word; places outside its document are the edge."""
    n = len(inputs)
    left = np.arange(n) - np.repeat(at[:-1], np.diff(at))  # words before and after it in its document
    right = np.repeat(at[1:], np.diff(at)) - np.arange(n) - 1
    out = np.full((n, 2 * SIDE), edge, inputs.dtype)
    for k, shift in enumerate((*range(-SIDE, 0), *range(1, SIDE + 1))):
        inside = np.flatnonzero(left >= -shift if shift < 0 else right >= shift)
        out[inside, k] = inputs[inside + shift]
    return out


def _hidden(weights: list[np.ndarray], windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = weights[0][windows].reshape(len(windows), -1)
    return x, np.tanh(x @ weights[1] + weights[2])


def _runs(groups: np.ndarray) -> tuple[np.ndarray, Iterator[tuple[int, int, int]]]:
    """An order that brings equal groups together, and the group, start and end of each run in it."""
    order = np.argsort(groups, kind="stable")
    own = groups[order]
    cuts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]]))
    return order, ((int(own[a]), int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True))


def log_probabilities(weights: list[np.ndarray], windows: np.ndarray, groups: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Of each word's group and slot given its window."""
    out = np.empty(len(windows))
    for first in range(0, len(windows), 16_384):
        part = slice(first, first + 16_384)
        _, h = _hidden(weights, windows[part])
        own, slot = groups[part], slots[part]
        z = h @ weights[3] + weights[4]
        logs = z[np.arange(len(h)), own] - np.log(np.exp(z).sum(1, dtype=np.float64))
        order, runs = _runs(own)
        h, slot = h[order], slot[order]
        inside = np.empty(len(h))
        for g, a, b in runs:
            z = h[a:b] @ weights[5][g] + weights[6][g]
            inside[a:b] = z[np.arange(b - a), slot[a:b]] - np.log(np.exp(z).sum(1, dtype=np.float64))
        logs[order] += inside
        out[part] = logs
    return out


class Trainer:
    """Adagrad on windows in the order they come."""

    def __init__(self, weights: list[np.ndarray]):
        self.weights = [w.copy() for w in weights]
        self.squares = [np.full_like(w, 1e-4) for w in weights]
        self.seen = 0

    def step(self, windows: np.ndarray, groups: np.ndarray, slots: np.ndarray) -> None:
        n, w = len(windows), self.weights
        order, runs = _runs(groups)
        windows, groups, slots = windows[order], groups[order], slots[order]
        x, h = _hidden(w, windows)
        # hidden values lie between -1 and 1 and weights stay small, so no exponential overflows
        p = np.exp(h @ w[3] + w[4])
        p *= (1 / n / p.sum(1, keepdims=True)).astype(np.float32)
        p[np.arange(n), groups] -= np.float32(1 / n)
        dh = p @ w[3].T
        for g, a, b in runs:
            q = np.exp(h[a:b] @ w[5][g] + w[6][g])
            q *= (1 / n / q.sum(1, keepdims=True)).astype(np.float32)
            q[np.arange(b - a), slots[a:b]] -= np.float32(1 / n)
            dh[a:b] += q @ w[5][g].T
            for k, d in ((5, h[a:b].T @ q), (6, q.sum(0))):
                self.squares[k][g] += d * d
                w[k][g] -= RATE * d / np.sqrt(self.squares[k][g])
        dh *= 1 - h * h
        dx = (dh @ w[1].T).reshape(n * 2 * SIDE, WIDTH)
        flat = windows.ravel()
        by = np.argsort(flat, kind="stable")
        flat = flat[by]
        starts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        table, rows = np.add.reduceat(dx[by], starts), flat[starts]
        self.squares[0][rows] += table**2
        w[0][rows] -= RATE * table / np.sqrt(self.squares[0][rows])
        for k, d in ((1, x.T @ dh), (2, dh.sum(0)), (3, h.T @ p), (4, p.sum(0))):
            self.squares[k] += d * d
            w[k] -= RATE * d / np.sqrt(self.squares[k])
        self.seen += n


def _hashed(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for first, end, buf, offsets in textbuf.chunks(column):
        buf = textbuf.lowered(buf)
        starts, ends, at = textbuf.word_spans(buf, offsets)
        yield first, end, textbuf.span_hashes(buf, starts, ends), at


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    """A bucket's words are in one part of the count table."""
    return (hashes % np.uint64(BUCKETS) % np.uint64(parts)).astype(np.int64)


def _count(parts: int):
    @runtime.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        pending: list[np.ndarray] = []
        held = 0

        def fold() -> None:
            nonlocal keys, counts, pending, held
            if pending:
                every = np.concatenate(pending)
                own, n = np.unique(every, return_counts=True)
                keys, at = np.unique(np.concatenate([keys, own]), return_inverse=True)
                counts = np.bincount(at, np.concatenate([counts, n]), len(keys)).astype(np.int64)
                pending, held = [], 0

        def emit() -> Iterator[pa.RecordBatch]:
            nonlocal keys, counts
            part = _part(keys, parts)
            for p in range(parts):
                mine = part == p
                if mine.any():
                    blob = np.stack([keys[mine].view(np.int64), counts[mine]]).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([blob], pa.binary())], ["part", "blob"])
            keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        for batch in batches:
            for _, _, hashes, _ in _hashed(batch.column(0)):
                pending.append(hashes)
                held += len(hashes)
                if held > 1 << 20:
                    fold()
                    if len(keys) > 1 << 20:
                        yield from emit()
        fold()
        yield from emit()

    return run


_COUNTS = "part int, words binary, counts binary, sums binary"


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(keys, return_inverse=True)
    return keys, np.bincount(at, counts, len(keys)).astype(np.int64)


def _of_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Runs of rows of one part (the first column)."""
    at, held = None, []
    for batch in batches:
        parts = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if held and at != int(parts[a]):
                yield at, held
                held = []
            at = int(parts[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield at, held


@runtime.lean
def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each part's exact counts: its words by hash, ascending, and the sums by bucket."""
    for part, rows in _of_part(batches):
        words, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        blobs = [blob for batch in rows for blob in batch.column(1)]
        for a in range(0, len(blobs), 32):
            own = np.concatenate([np.frombuffer(b.as_py(), np.int64).reshape(2, -1) for b in blobs[a : a + 32]], axis=1)
            words, counts = _summed(np.concatenate([words, own[0].view(np.uint64)]), np.concatenate([counts, own[1]]))
        bucket, sums = _summed((words % np.uint64(BUCKETS)).astype(np.int64), counts)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in (words, counts, np.stack([bucket, sums])))], ["part", "words", "counts", "sums"])


def _best(most: int):
    """Of the rows of several parts, the most frequent words and all sums by bucket, as one row; no word and no bucket is in two parts."""

    @runtime.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, sums = np.zeros(0, np.uint64), np.zeros(0, np.int64), [np.zeros((2, 0), np.int64)]
        for batch in batches:
            for r in range(len(batch)):
                words = np.concatenate([words, np.frombuffer(batch.column(0)[r].as_py(), np.uint64)])
                counts = np.concatenate([counts, np.frombuffer(batch.column(1)[r].as_py(), np.int64)])
                top = np.lexsort((words, -counts))[:most]
                words, counts = words[top], counts[top]
                sums.append(np.frombuffer(batch.column(2)[r].as_py(), np.int64).reshape(2, -1))
        yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (words, counts, np.concatenate(sums, axis=1))], ["words", "counts", "sums"])

    return run


def count_table(docs: DataFrame) -> DataFrame:
    """part, words, counts, sums: the exact counts of all words, in parts by hash."""
    parts = runtime.parallelism(docs.sparkSession)
    return docs.select("text").mapInArrow(_count(parts), "part int, blob binary").repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_tally, _COUNTS)


def vocabulary(counted: DataFrame) -> Vocabulary:
    """Only the most frequent words (as many as there are slots) and BUCKETS sums come to the driver."""
    parts = runtime.parallelism(counted.sparkSession)
    few = max(1, parts // 32)
    n_words = 0
    for r in counted.select("sums").mapInArrow(_totals, "n long").groupBy().sum("n").collect():
        n_words = int(r[0] or 0)
    rows = counted.select("words", "counts", "sums").repartition(few).mapInArrow(_best(groups_for(n_words) ** 2), "words binary, counts binary, sums binary").collect()
    buckets = np.zeros(BUCKETS, np.int64)
    for r in rows:
        at, n = np.frombuffer(r["sums"], np.int64).reshape(2, -1)
        buckets[at] = n
    words = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r["words"], np.uint64) for r in rows)])
    counts = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r["counts"], np.int64) for r in rows)])
    order = np.lexsort((words, -counts))
    return Vocabulary(words[order], counts[order], buckets)


@runtime.lean
def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([int(np.frombuffer(v.as_py(), np.int64).reshape(2, -1)[1].sum()) for v in batch.column(0)], pa.int64())], ["n"])


def _learn(words: Vocabulary, weights: list[np.ndarray], round_: int, rounds: int):
    @runtime.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, size = Trainer(weights), batch_for(words.n_words)
        held: list[tuple[np.ndarray, ...]] = []
        n = 0

        def drain(whole: bool) -> None:
            nonlocal held, n
            if n and (whole or n >= size):
                columns = [np.concatenate(c) for c in zip(*held, strict=True)]
                end = n if whole else n // size * size
                for a in range(0, end, size):
                    trainer.step(*(c[a : min(a + size, end)] for c in columns))
                held, n = [tuple(c[end:] for c in columns)], n - end

        for batch in batches:
            for _, _, hashes, at in _hashed(batch.column(0)):
                inputs, groups, slots, _ = words.classes(hashes)
                # every window belongs to one of the rounds, by the word and its place
                place = textbuf.mix(hashes + np.arange(len(hashes), dtype=np.uint64))
                chosen = np.flatnonzero(place % np.uint64(rounds) == round_)
                held.append((_windows(inputs, at, words.edge)[chosen], groups[chosen], slots[chosen]))
                n += len(chosen)
                drain(False)
        drain(True)
        if trainer.seen:
            flat = np.concatenate([w.ravel() for w in trainer.weights]).astype(np.float64) * trainer.seen
            pieces = range(0, len(flat), SLICE)
            yield pa.RecordBatch.from_arrays([pa.array([a // SLICE for a in pieces], pa.int32()), pa.array([flat[a : a + SLICE].tobytes() for a in pieces], pa.binary()), pa.array([trainer.seen for _ in pieces], pa.int64())], ["slice", "sums", "seen"])

    return run


@runtime.lean
def _sum_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    seen: dict[int, int] = {}
    for batch in batches:
        for k, raw, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = np.frombuffer(raw)
            sums[k] = sums[k] + own if k in sums else own
            seen[k] = seen.get(k, 0) + n
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary()), pa.array(list(seen.values()), pa.int64())], ["slice", "sums", "seen"])


def train(docs: DataFrame, words: Vocabulary, rounds: int = ROUNDS) -> list[np.ndarray]:
    weights, kinds = fresh_weights(words), "slice int, sums binary, seen long"
    for step in range(rounds):
        learnt = docs.select("text").mapInArrow(_learn(words, weights, step, rounds), kinds)
        # sorted by contents, so that the sums do not depend on which task ends first
        summed = learnt.repartition(runtime.parallelism(docs.sparkSession), "slice").sortWithinPartitions("slice", "seen", "sums").mapInArrow(_sum_slices, kinds).collect()
        if not summed:
            continue
        flat = np.concatenate([np.frombuffer(r["sums"]) / r["seen"] for r in sorted(summed, key=lambda r: r["slice"])]).astype(np.float32)
        ends = np.cumsum([int(np.prod(s)) for s in words.shapes()])
        weights = [flat[e - int(np.prod(s)) : e].reshape(s) for s, e in zip(words.shapes(), ends, strict=True)]
    return weights


_SCORED = "row long, doc_id long, n_words long, known double, part int, rare binary"


def _score(words: Vocabulary, weights: list[np.ndarray], parts: int):
    """Per document what the network says; and per block of documents (named by its first row) and part of the count
    table the rare words, with their documents' rows."""

    names = ["row", "doc_id", "n_words", "known", "part", "rare"]

    def asking(rare: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        part = _part(rare, parts)
        order = np.argsort(part, kind="stable")
        rare, rows, part = rare[order], rows[order], part[order]
        cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
        blobs = [np.concatenate([rare[a:b].view(np.int64), rows[a:b]]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        none = [pa.nulls(len(blobs), kind) for kind in (pa.int64(), pa.int64(), pa.float64())]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(blobs), rows.min())), *none, pa.array(part[cuts[:-1]].astype(np.int32)), pa.array(blobs, pa.binary())], names)

    @runtime.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            n = len(batch)
            sums, counts = np.zeros(n), np.zeros(n, np.int64)
            for first, end, hashes, at in _hashed(batch.column(1)):
                inputs, groups, slots, rare = words.classes(hashes)
                logs = log_probabilities(weights, _windows(inputs, at, words.edge), groups, slots) - np.where(rare, words.log_rest[groups], 0.0)
                logs = np.concatenate([[0.0], np.cumsum(logs)])
                sums[first:end] = logs[at[1:]] - logs[at[:-1]]
                counts[first:end] = np.diff(at)
                if rare.any():
                    held.append((hashes[rare], row + np.repeat(np.arange(first, end), np.diff(at))[rare]))
            yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(n)), batch.column(0), pa.array(counts), pa.array(sums), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
            if sum(len(h) for h, _ in held) > HELD:
                yield asking(*map(np.concatenate, zip(*held, strict=True)))
                held = []
            row += n
        if held:
            yield asking(*map(np.concatenate, zip(*held, strict=True)))

    return run


@runtime.lean
def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of a part, its counts before the rare words that ask for them: for each block the sums of log counts of its
    documents' words there."""
    at, words, counts = None, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for batch in batches:
        found: list[tuple[int, bytes]] = []
        for part, own_words, own_counts, rare, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own_words is not None:
                at, words, counts = part, np.frombuffer(own_words, np.uint64), np.frombuffer(own_counts, np.int64)
                continue
            if part != at:
                raise ValueError("a part of the count table is missing")
            asked = np.frombuffer(rare, np.int64).reshape(2, -1)
            rows, back = np.unique(asked[1], return_inverse=True)
            sums = np.bincount(back, np.log(counts[np.searchsorted(words, asked[0].view(np.uint64))]), len(rows))
            found.append((block, rows.tobytes() + sums.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], ["block", "sums"])


@runtime.lean
def _by_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of a block's answers: the sum for each of its documents."""

    def added(held: list[bytes]) -> pa.RecordBatch:
        rows = np.concatenate([np.frombuffer(x, np.int64, len(x) // 16) for x in held])
        sums = np.concatenate([np.frombuffer(x, np.float64, len(x) // 16, len(x) // 2) for x in held])
        names, back = np.unique(rows, return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.bincount(back, sums, len(names)))], ["row", "log_counts"])

    for _, rows in _of_part(batches):
        yield added([x.as_py() for batch in rows for x in batch.column(1)])


def score(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, log_likelihood (sum over all words) and mean_log of every document."""
    spark = docs.sparkSession
    runtime.bounded_batches(spark)
    tables, parts = runtime.Tables(spark), runtime.parallelism(spark)
    counted = tables.write(count_table(docs), "counts")
    words = vocabulary(counted)
    weights = train(docs, words)
    scored = tables.write(docs.select("doc_id", "text").mapInArrow(_score(words, weights, parts), _SCORED), "scored")
    none = F.lit(None).cast("binary")
    asking = scored.where("part IS NOT NULL").select("part", none.alias("words"), none.alias("counts"), "rare", F.col("row").alias("block"))
    met = counted.select("part", "words", "counts", none.alias("rare"), F.lit(None).cast("long").alias("block")).union(asking).repartition(parts, "part").sortWithinPartitions("part", F.col("words").isNull())
    answers = met.mapInArrow(_shares, "block long, sums binary").repartition(parts, "block").sortWithinPartitions("block", "sums")
    rare = answers.mapInArrow(_by_row, "row long, log_counts double")
    every = scored.where("part IS NULL").join(rare, "row", "left").select("doc_id", "n_words", (F.col("known") + F.coalesce("log_counts", F.lit(0.0))).alias("log_likelihood"))
    return tables.last(every.withColumn("mean_log", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words"))), "likelihood")
