"""Quality classifier by co-training two views of a document.

One logistic model sees the text (hashed words and character statistics), the other what is known
about the page (source, language, length). Both start from labelled documents. In each round both
score every unlabelled document of the corpus; the scores' histograms give the corpus-wide limits
beyond which a view is confident, and a growing share of its most confident labels trains the other
view: each task fits the documents it holds, kept near the common weights, the tasks' weights are
averaged by the documents they saw, and the labelled documents are fitted once more around the
average. On labelled rows kept out of training the views are calibrated and combined. Then every
document is scored, from its whole text.

LABELLED bounds the labelled rows that are gathered for fitting, drawn by a hash of doc_id; nothing
else is sampled. As in any averaged training the weights depend on how the input is split into tasks.

Defined results: a null text is empty; a null or unknown source or language is a value of its own;
rows without a label or with a null one only get scores; of several labels of one doc_id the greatest
counts; repeated rows are scored one by one; without labels of both kinds every score is 0.5; an
empty table gives none; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime, textbuf

LABELLED = 8_000
#: Rounds, the share of all unlabelled documents that each adds, and buckets of words.
ROUNDS, CONFIDENT, BUCKETS = 3, 0.05, 1 << 13
#: Documents that a task fits at once, steps of such a fit, and its pull to the common weights.
HELD, STEPS, PULL = 4096, 20, 1e-2
#: Bins of a histogram of logits between -RANGE and RANGE; labelled rows up to which their list is broadcast.
BINS, RANGE, BROADCAST_LABELS = 4096, 40.0, 1_000_000
SLICE = 4096
_META = 256
_KINDS = [range(65, 91), range(97, 123), range(48, 58), [32], [10], [ord(c) for c in ".,;:!?'\"()-"], [ord(c) for c in "#$%&*+/<=>@[]^_`{|}~\\"], range(128, 256)]
_KIND = np.zeros(256, np.int64) + len(_KINDS)
for _k, _bytes in enumerate(_KINDS):
    _KIND[list(_bytes)] = _k
DENSE = len(_KINDS) + 1 + 4
_FIELDS = "doc_id long, at binary, value binary, dense binary, meta binary"
_SLICES = "view int, slice int, sums binary, seen long"


def _meta(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    def code(kind: str, v: str | None) -> int:
        raw = f"{kind}{'' if v is None else '=' + v}".encode()
        return int(textbuf.mix(np.array([sum((i + 1) * b for i, b in enumerate(raw))], np.uint64))[0] % np.uint64(_META - 40))

    long = min(39, int(3 * np.log1p(max(0, n_chars or 0))))
    return np.array([code("s", source), code("l", lang), _META - 40 + long], np.int32)


def features(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """row, word buckets, their shares, character statistics, page features. Columns: text, source, lang, n_chars."""
    sources, langs, sizes = (batch.column(k).to_pylist() for k in (1, 2, 3))
    for first, end, buf, offsets in textbuf.chunks(batch.column(0)):
        kinds = _KIND[buf]
        starts, ends, at = textbuf.word_spans(buf, offsets)
        words = textbuf.span_hashes(textbuf.lowered(buf), starts, ends)
        buckets = (words % np.uint64(BUCKETS)).astype(np.int64)
        for row in range(first, end):
            a, b = at[row - first], at[row - first + 1]
            n, own = int(b - a), words[a:b]
            chars = np.bincount(kinds[offsets[row - first] : offsets[row - first + 1]], minlength=len(_KINDS) + 1)
            total = max(1, int(chars.sum()))
            distinct = len(np.unique(own)) / max(1, n)
            pairs = len(np.unique(own[1:] + own[:-1] * np.uint64(3))) / max(1, n - 1)
            dense = np.concatenate([4 * chars / total, [np.log1p(n) / 5, distinct, pairs, (ends[a:b] - starts[a:b]).mean() / 10 if n else 0.0]])
            if n:
                counts = np.bincount(buckets[a:b], minlength=BUCKETS)
                where = np.flatnonzero(counts)
                shares = counts[where] * (20.0 / n)
            else:
                where, shares = np.zeros(0, np.int64), np.zeros(0)
            yield row, where, shares, dense, _meta(sources[row], langs[row], sizes[row])


@runtime.lean
def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, rows = batch.column(0), []
        for row, where, shares, dense, meta in features(batch.select(["text", "source", "lang", "n_chars"])):
            rows.append((ids[row].as_py(), where.astype(np.uint16).tobytes(), shares.astype(np.float32).tobytes(), dense.astype(np.float32).tobytes(), meta.tobytes()))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])], ["doc_id", "at", "value", "dense", "meta"])


Rows = tuple[np.ndarray, np.ndarray, np.ndarray]  # of sparse rows: columns, values, row of each


def sparse(at: list, value: list, dense: list, meta: list) -> list[Rows]:
    """The rows of both views from the bytes of gathered features."""
    n = len(at)
    columns = [np.frombuffer(b"".join(at), np.uint16).astype(np.int64), np.tile(BUCKETS + np.arange(DENSE), n)]
    values = [np.frombuffer(b"".join(value), np.float32).astype(np.float64), np.frombuffer(b"".join(dense), np.float32).astype(np.float64)]
    rows = [np.repeat(np.arange(n), [len(x) // 2 for x in at]), np.repeat(np.arange(n), DENSE)]
    page = np.frombuffer(b"".join(meta), np.int32).astype(np.int64)
    return [tuple(map(np.concatenate, (columns, values, rows))), (page, np.ones(len(page)), np.repeat(np.arange(n), 3))]


def taken(rows: Rows, chosen: np.ndarray) -> Rows:
    """Some of the rows, renumbered; chosen is ascending."""
    at, value, row = rows
    keep = np.isin(row, chosen)
    return at[keep], value[keep], np.searchsorted(chosen, row[keep])


class View:
    """A logistic model over sparse rows, fitted by accelerated gradient descent."""

    def __init__(self, size: int, penalty: float = 1e-3):
        self.penalty, self.weights, self.bias = penalty, np.zeros(size), 0.0

    def logits(self, rows: Rows, n: int) -> np.ndarray:
        at, value, row = rows
        return np.bincount(row, self.weights[at] * value, n) + self.bias

    def fit(self, rows: Rows, labels: np.ndarray, steps: int = 150, pull: float | None = None) -> None:
        """From the present weights; `pull` (the penalty, if none) draws back to them, or to zero in a first fit."""
        (at, value, row), n, size = rows, len(labels), len(self.weights)
        pull, home = self.penalty if pull is None else pull, self.weights.copy()
        share = labels.mean()
        cost = np.where(labels > 0, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6)) / n
        scale = np.bincount(at, value**2 * cost[row], size) + pull
        scale = np.sqrt(scale * scale.max())
        w, b, v, c = home.copy(), self.bias, np.zeros(size), 0.0
        for _ in range(steps):
            z = np.bincount(row, w[at] * value, n) + b
            error = cost * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels)
            v = 0.9 * v - 0.1 * (np.bincount(at, error[row] * value, size) + pull * (w - home)) / scale
            c = 0.9 * c - 0.5 * error.sum()
            w, b = w + v, b + c
        self.weights, self.bias = w, b


def calibration(logits: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Logistic regression of the labels on the columns of logits, by Newton steps: one weight each and a bias."""
    x = np.column_stack([logits, np.ones(len(logits))])
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-2 * np.eye(len(w)), x.T @ (p - labels) + 1e-2 * w)
    return w


class Model:
    """Both views with their calibrations and the combination."""

    def __init__(self, text: View, meta: View, calibrations: list[np.ndarray], combination: np.ndarray):
        self.words, self.dense = text.weights[:BUCKETS].copy(), text.weights[BUCKETS:].copy()
        self.meta, self.biases = meta.weights.copy(), (text.bias, meta.bias)
        self.calibrations, self.combination = calibrations, combination


def _sigmoid(z: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _bins(logits: np.ndarray) -> np.ndarray:
    return np.clip((logits + RANGE) * (BINS / (2 * RANGE)), 0, BINS - 1).astype(np.int64)


def _batch_rows(batch: pa.RecordBatch) -> list[Rows]:
    return sparse(*(batch.column(k).to_pylist() for k in range(4)))


def _histogram(views: list[View]):
    """How many documents each view gives which logit, one row a task."""

    @runtime.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BINS), np.int64)
        for batch in batches:
            if n := len(batch):
                for view, own, rows in zip(views, counts, _batch_rows(batch), strict=True):
                    own += np.bincount(_bins(view.logits(rows, n)), minlength=BINS)
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array([c.tobytes() for c in counts], pa.binary())], ["view", "counts"])

    return run


@runtime.lean
def _add_histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            sums[k] = sums.get(k, 0) + np.frombuffer(raw, np.int64)
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([c.tobytes() for c in sums.values()], pa.binary())], ["view", "counts"])


def limits(counts: np.ndarray, share: float, positive: float, floor: float) -> tuple[int, int]:
    """The bins up to and from which the most confident documents lie: `share` of all, of which `positive` good; none nearer to 0 than floor."""
    total = counts.sum()
    low = int(np.searchsorted(np.cumsum(counts), share * (1 - positive) * total, "right")) - 1
    high = BINS - int(np.searchsorted(np.cumsum(counts[::-1]), share * positive * total, "right"))
    bound = [int(_bins(np.array([x]))[0]) for x in (-min(floor, RANGE), min(floor, RANGE))]
    return min(low, bound[0]), max(high, bound[1])


def _exchange(views: list[View], ends: list[tuple[int, int]]):
    """Per task: each view fitted to what the other is confident of, as slices of weights times documents."""

    @runtime.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = [View(len(v.weights)) for v in views]
        for own, view in zip(fitted, views, strict=True):
            own.weights, own.bias = view.weights.copy(), view.bias
        held: list[list[tuple[Rows, np.ndarray]]] = [[], []]
        seen = [0, 0]

        def drain(k: int) -> None:
            if held[k]:
                starts = np.cumsum([0, *(len(y) for _, y in held[k])])
                rows = tuple(np.concatenate(c) for c in zip(*((at, value, row + s) for ((at, value, row), _), s in zip(held[k], starts, strict=False)), strict=True))
                fitted[k].fit(rows, np.concatenate([y for _, y in held[k]]), STEPS, PULL)
                seen[k] += int(starts[-1])
                held[k] = []

        for batch in batches:
            if not (n := len(batch)):
                continue
            rows = _batch_rows(batch)
            for k, (low, high) in enumerate(ends):
                at = _bins(views[k].logits(rows[k], n))
                sure = np.flatnonzero((at <= low) | (at >= high))
                if len(sure):
                    held[1 - k].append((taken(rows[1 - k], sure), (at[sure] >= high).astype(np.float64)))
                    if sum(len(y) for _, y in held[1 - k]) >= HELD:
                        drain(1 - k)
        for k in range(2):
            drain(k)
            if seen[k]:
                flat = np.append(fitted[k].weights, fitted[k].bias) * seen[k]
                pieces = range(0, len(flat), SLICE)
                yield pa.RecordBatch.from_arrays([pa.array([k for _ in pieces], pa.int32()), pa.array([a // SLICE for a in pieces], pa.int32()), pa.array([flat[a : a + SLICE].tobytes() for a in pieces], pa.binary()), pa.array([seen[k] for _ in pieces], pa.int64())], ["view", "slice", "sums", "seen"])

    return run


@runtime.lean
def _add_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple[int, int], tuple[np.ndarray, int]] = {}
    for batch in batches:
        for view, k, raw, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            old, seen = sums.get((view, k), (0.0, 0))
            sums[view, k] = (old + np.frombuffer(raw), seen + n)
    yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in sums], pa.int32()), pa.array([k for _, k in sums], pa.int32()), pa.array([x.tobytes() for x, _ in sums.values()], pa.binary()), pa.array([n for _, n in sums.values()], pa.int64())], ["view", "slice", "sums", "seen"])


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", labelled: int = LABELLED, rounds: int = ROUNDS) -> Model | None:
    """A model from a bounded sample of labelled documents and all unlabelled ones; None without labels of both kinds."""
    spark = docs.sparkSession
    runtime.bounded_batches(spark)
    tables, parts = runtime.Tables(spark), runtime.parallelism(spark)
    known = tables.write(labels.where(F.col("doc_id").isNotNull() & F.col(target).isin(0, 1)).groupBy("doc_id").agg(F.max(target).cast("double").alias("label")), "labels")
    named = docs.where("doc_id IS NOT NULL").select("doc_id", "text", "source", "lang", "n_chars").mapInArrow(_gather, _FIELDS)
    listed = F.broadcast(known) if known.count() <= BROADCAST_LABELS else known
    gathered = tables.write(named.join(listed, "doc_id", "left"), "features")
    drawn = tables.write(known.join(gathered.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(labelled).select("doc_id"), "drawn")
    own = gathered.join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(F.min(F.struct("value", "at", "dense", "meta", "label")).alias("f"))
    sample = own.select("doc_id", "f.*").collect()  # a row for each drawn doc_id
    sample.sort(key=lambda r: r["doc_id"])
    truth = np.array([r["label"] for r in sample])
    try:
        return _cotrained(sample, truth, gathered.where("label IS NULL").select("at", "value", "dense", "meta"), rounds, parts) if len(np.unique(truth)) == 2 else None
    finally:
        runtime.delete(spark, tables.folder)


def _cotrained(sample: list, truth: np.ndarray, free: DataFrame, rounds: int, parts: int) -> Model:
    every = sparse(*([bytes(r[c]) for r in sample] for c in ("at", "value", "dense", "meta")))
    have = np.arange(len(truth))
    held, base = have[have % 5 == 0], have[have % 5 != 0]
    if len(np.unique(truth[base])) < 2 or len(np.unique(truth[held])) < 2:
        base = held = have
    views = [View(BUCKETS + DENSE), View(_META)]
    own, kept = ([taken(rows, chosen) for rows in every] for chosen in (base, held))
    for view, rows in zip(views, own, strict=True):
        view.fit(rows, truth[base])
    share = float(truth[base].mean())
    for step in range(1, rounds + 1):
        floors = []
        for view, rows in zip(views, kept, strict=True):  # only what it is surer of than of most it gets right
            logit = view.logits(rows, len(held))
            sure = np.abs(logit[(logit > 0) == (truth[held] > 0.5)])
            floors.append(float(np.quantile(sure, 0.75)) if len(sure) else np.inf)
        counts = np.zeros((2, BINS), np.int64)
        for r in free.mapInArrow(_histogram(views), "view int, counts binary").repartition(max(1, parts // 32)).mapInArrow(_add_histograms, "view int, counts binary").collect():
            counts[r["view"]] += np.frombuffer(r["counts"], np.int64)
        ends = [limits(c, CONFIDENT * step, share, floor) for c, floor in zip(counts, floors, strict=True)]
        learnt = free.mapInArrow(_exchange(views, ends), _SLICES).repartition(parts, "view", "slice").sortWithinPartitions("view", "slice", "seen", "sums").mapInArrow(_add_slices, _SLICES).collect()
        for k, view in enumerate(views):
            if slices := sorted((r for r in learnt if r["view"] == k), key=lambda r: r["slice"]):
                flat = np.concatenate([np.frombuffer(r["sums"]) / r["seen"] for r in slices])
                view.weights, view.bias = flat[:-1], float(flat[-1])
            view.fit(own[k], truth[base], 60, PULL)
    logits = np.column_stack([v.logits(rows, len(held)) for v, rows in zip(views, kept, strict=True)])
    calibrations = [calibration(logits[:, k], truth[held]) for k in range(2)]
    both = np.column_stack([logits[:, k] * c[0] + c[1] for k, c in enumerate(calibrations)])
    return Model(*views, calibrations, calibration(both, truth[held]))


def _scorer(model: Model | None):
    @runtime.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[float, float, float]] = []
            for _, where, shares, dense, meta in features(batch.select(["text", "source", "lang", "n_chars"])):
                if model is None:
                    rows.append((0.5, 0.5, 0.5))
                    continue
                z = (float(model.words[where] @ shares + model.dense @ dense) + model.biases[0], float(model.meta[meta].sum()) + model.biases[1])
                view = [a * c[0] + c[1] for a, c in zip(z, model.calibrations, strict=True)]
                rows.append((_sigmoid(view[0]), _sigmoid(view[1]), _sigmoid(float(np.dot(model.combination[:2], view) + model.combination[2]))))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.float64()) for c in columns)], ["doc_id", "text_score", "meta_score", "score"])

    return run


def score(docs: DataFrame, model: Model | None, least: float = 0.5) -> DataFrame:
    """doc_id, text_score, meta_score, score and kept of every document."""
    scored = docs.select("doc_id", "text", "source", "lang", "n_chars").mapInArrow(_scorer(model), "doc_id long, text_score double, meta_score double, score double")
    return scored.withColumn("kept", F.col("score") >= least)
