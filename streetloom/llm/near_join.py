"""N-gram Jaccard join by parity sketches.

A document's shingles are XOR-hashed into a sketch of lanes; each member that two sets do not share
changes one lane, so the number of differing lanes is at most the symmetric difference. Per size
band a sketch has more lanes than similar sets can differ in, so by the pigeonhole principle similar
sets meet in the buckets of many equal lanes. Pairs pass if the Hamming distance of their bit
sketches allows the threshold, and are then verified on the exact shingle sets.

All pairs are taken from small buckets. A set that has fewer keys in large buckets than it shares
with any similar set meets each of those in a small bucket, so it leaves the large ones. What is
left there (groups of many near copies) is linked to leaders drawn from its buckets, one verified
pair a set. Only where a large bucket then still holds several components, its sets are laid out in
packed blocks, each pair of blocks is compared once by bit sketch, two blocks of one component
never, and a spanning forest of the promising pairs is verified. Where a pair of the forest fails,
all promising pairs that its group still has between components are verified: then no link joins two
components. So every link counts, while no group's pairs are ever listed. Copies with equal sets are
one member.

Defined results: empty texts (and null) have no shingles and link with nothing; rows with a null
doc_id get their n_shingles and no component; rows that share a doc_id are one document, linked by
any of their texts; an empty table gives none; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import runtime, shingles, textbuf
from .components import components

#: Members of a bucket whose pairs are all listed, and of one that a task forwards; bytes of a packed block.
SMALL, FORWARD, BLOCK_BYTES = 16, 64, 1 << 19
#: Leaders that a set of large buckets is compared with; postings that a task holds before it hands them on; ids of a broadcast.
LEADERS, HELD, BROADCAST_IDS = 4, 1 << 18, 1_000_000
#: Pairs of two components that are verified at once (further ones in the next round, if none of these links).
MOST_BETWEEN = 256
_DOCS, _PAIRS, _MEMBERS = 0, 1, 2


def _deal(words: int, num: int, den: int, parts: int):
    """Per task: documents (once per distinct set with postings) and postings, packed by part."""

    @runtime.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = shingles.bands(num, den), set()
        docs: list[tuple] = []
        keys: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal docs, keys, owners, held
            out: list[tuple] = []
            for d in docs:
                out.append((((d[0] or 0) * 2654435761 >> 7) % parts, None, None, *d))
            if keys:
                key, owner = np.concatenate(keys), np.concatenate(owners)
                order = np.lexsort((owner, key))
                key, owner = key[order], owner[order]
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                place = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
                # of a bucket that is large already here, the rest goes by document, not by key
                rest = place >= FORWARD
                part = np.where(rest, textbuf.mix(owner.astype(np.uint64)), key >> np.uint64(shingles.BAND_BITS)) % np.uint64(parts)
                order = np.lexsort((rest, part))
                part, rest, key, owner = part[order], rest[order], key[order], owner[order]
                group = part * np.uint64(2) + rest
                cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    blob = np.concatenate([key[a:b].astype("<u8").view("<i8"), owner[a:b].astype("<i8")]).tobytes()
                    out.append((int(part[a]), int(rest[a]), blob, None, None, None, None, None, None))
            docs, keys, owners, held = [], [], [], 0
            kinds = [pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32())]
            for i in range(0, len(out), 2000):
                columns = zip(*out[i : i + 2000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["part", "rest", "blob", "doc_id", "n", "s1", "s2", "sketch", "shared"])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for row, own in shingles.shingle_sets(batch.column(1), words):
                s1, s2 = shingles.signature(own)
                fresh = (s1, s2) not in seen
                lanes, shared = shingles.lane_keys(own, table) if len(own) else (None, [])
                docs.append((ids[row], len(own), s1, s2, shingles.bit_sketch(own), shared))
                held += 1 + len(own) // 64
                if fresh and len(own) and ids[row] is not None:
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add((s1, s2))
                    keys.append(lanes)
                    owners.append(np.full(len(lanes), ids[row], np.int64))
                    held += len(lanes)
            if held >= HELD:
                yield from flush()
        yield from flush()

    return run


_FOUND = "kind int, doc_id long, n long, s1 long, s2 long, sketch binary, shared array<int>, x long, y long"
_DEALT = "part int, rest int, blob binary, doc_id long, n long, s1 long, s2 long, sketch binary, shared array<int>"


@runtime.lean
def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of a part meet: pairs of small buckets, members of large ones; documents pass through."""
    keys: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    names = ["kind", "doc_id", "n", "s1", "s2", "sketch", "shared", "x", "y"]

    def rows(kind: int, x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(x), 50_000):
            n = len(x[i : i + 50_000])
            none = [pa.nulls(n, pa.int64())] * 4 + [pa.nulls(n, pa.binary()), pa.nulls(n, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *none, pa.array(x[i : i + 50_000]), pa.array(y[i : i + 50_000])], names)

    for batch in batches:
        blobs = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
        plain = batch.filter(pa.array(~blobs))
        if n := len(plain):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, _DOCS, np.int32)), *(plain.column(k) for k in range(3, 9)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names)
        for i in np.flatnonzero(blobs):
            own = np.frombuffer(batch.column(2)[i].as_py(), "<i8").reshape(2, -1)
            if batch.column(1)[i].as_py():
                yield from rows(_MEMBERS, own[0], own[1])
            else:
                keys.append(own[0])
                owners.append(own[1])
    if not keys:
        return
    key, owner = np.concatenate(keys), np.concatenate(owners)
    keys.clear()
    owners.clear()
    order = np.lexsort((owner, key))
    key, owner = key[order], owner[order]
    # the same document may stand twice in a bucket
    fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])])
    key, owner = key[fresh], owner[fresh]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(first, len(key)))
    xs, ys = [], []
    for size in range(2, SMALL + 1):
        starts = first[sizes == size]
        if len(starts):
            a, b = np.triu_indices(size, 1)
            xs.append(owner[starts[:, None] + a].ravel())
            ys.append(owner[starts[:, None] + b].ravel())
    if xs:
        pairs = np.stack([np.concatenate(xs), np.concatenate(ys)])
        order = np.lexsort(pairs)
        pairs = pairs[:, order]
        pairs = pairs[:, np.concatenate([[True], (pairs[:, 1:] != pairs[:, :-1]).any(0)])]
        yield from rows(_PAIRS, pairs[0], pairs[1])
    large = np.repeat(sizes > SMALL, sizes)
    yield from rows(_MEMBERS, key[large], owner[large])


def _allowed(nx: np.ndarray, ny: np.ndarray, num: int, den: int) -> np.ndarray:
    """The most that two sets of these sizes may differ in; -1 if the sizes alone forbid a link."""
    small, large = np.minimum(nx, ny), np.maximum(nx, ny)
    return np.where(den * small >= num * large, (nx + ny) * (den - num) // (den + num), -1)


def _far(column_x: pa.Array, column_y: pa.Array, rows: np.ndarray) -> np.ndarray:
    """Hamming distances of the bit sketches of some rows, the larger one folded to the size of the smaller."""
    far = np.zeros(len(column_x), np.int64)
    sizes = np.stack([np.diff(np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]) for c in (column_x, column_y)])
    for x, y in np.unique(sizes[:, rows], axis=1).T:
        own = rows[(sizes[0, rows] == x) & (sizes[1, rows] == y)]
        step = max(1, (8 << 20) // int(x + y))
        for part in (own[i : i + step] for i in range(0, len(own), step)):
            words = min(x, y) // 8
            far[part] = np.bitwise_count(shingles.stacked(column_x, part, words) ^ shingles.stacked(column_y, part, words)).sum(1, dtype=np.int64)
    return far


def _promising(num: int, den: int):
    """Of pairs with sizes and bit sketches, those whose Hamming distance allows a link."""

    @runtime.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = _allowed(batch.column(1).to_numpy(), batch.column(4).to_numpy(), num, den)
            rows = np.flatnonzero(most >= 0)
            far = _far(batch.column(2), batch.column(5), rows) if len(rows) else np.zeros(len(batch), np.int64)
            good = pa.array(rows[far[rows] <= most[rows]], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(good), batch.column(3).take(good), pa.array(far).take(good)], ["x", "y", "far"])

    return run


def _exact(words: int, num: int, den: int):
    """Of pairs with texts, whether the exact shingle sets link. Pairs come by their second text, so each is hashed once."""

    @runtime.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(3).dictionary_encode()
            right = dict(shingles.shingle_sets(codes.dictionary, words))
            at = codes.indices.to_numpy()
            linked = np.zeros(len(batch), bool)
            for row, own in shingles.shingle_sets(batch.column(1), words):
                other = right[at[row]]
                both = len(np.intersect1d(own, other, assume_unique=True))
                linked[row] = both > 0 and den * both >= num * (len(own) + len(other) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(linked)], ["x", "y", "linked"])

    return run


class _Block:
    """A packed block of sets: members, sizes, components, bit sketches, and with whom they are known not to link."""

    def __init__(self, members, sizes, components, sketches, failed):
        self.members, self.sizes, self.components = (v.to_numpy(zero_copy_only=False) for v in (members, sizes, components))
        self.sketches, self.failed = sketches, failed
        offsets = np.frombuffer(sketches.buffers()[1], np.int32)[sketches.offset : sketches.offset + len(sketches) + 1]
        self.words = np.diff(offsets) // 8

    def bits(self, words: int) -> np.ndarray:
        out = np.empty((len(self.words), words), np.uint64)
        for size in np.unique(self.words):
            rows = np.flatnonzero(self.words == size)
            out[rows] = shingles.stacked(self.sketches, rows, words)
        return out

    def failing(self, other: _Block) -> tuple[np.ndarray, np.ndarray]:
        """Places here and in the other block of pairs that are known not to link."""
        ends = np.frombuffer(self.failed.buffers()[1], np.int32)[self.failed.offset : self.failed.offset + len(self.failed) + 1]
        names = self.failed.flatten().to_numpy(zero_copy_only=False)
        here = np.repeat(np.arange(len(self.members)), np.diff(ends))
        order = np.argsort(other.members, kind="stable")
        at = np.minimum(np.searchsorted(other.members[order], names), len(order) - 1)
        there = order[at]
        hit = other.members[there] == names
        return here[hit], there[hit]


def _between(a: _Block, b: _Block, same: bool, num: int, den: int, every: bool) -> tuple[list[tuple[int, int]], bool]:
    """A spanning forest, over components, of the promising pairs of two blocks (or one with itself); or every
    such pair, but of two components at most MOST_BETWEEN, and whether that left any out."""
    words = int(min(a.words.min(), b.words.min()))
    left, right = a.bits(words), b.bits(words)
    _, codes = np.unique(np.concatenate([a.components, b.components]), return_inverse=True)
    root = np.arange(codes.max() + 1)
    own, other = codes[: len(left)], codes[len(left) :]
    known = [a.failing(b), b.failing(a)[::-1]]
    known = np.unique(np.concatenate([i * len(right) + j for i, j in known]))
    step = max(1, (4 << 20) // (right.nbytes + 16 * len(right)))
    out: list[tuple[int, int]] = []
    between: dict[int, int] = {}

    def top(g: int) -> int:
        while root[g] != g:
            root[g] = g = root[root[g]]
        return int(g)

    for at in range(0, len(left), step):
        rows = slice(at, at + step)
        most = _allowed(a.sizes[rows, None], b.sizes[None], num, den)
        far = np.bitwise_count(left[rows, None] ^ right[None]).sum(2, dtype=np.int32)
        near = (far <= most) & (root[own[rows]][:, None] != root[other][None])
        if same:
            near &= np.arange(at, at + len(far))[:, None] < np.arange(len(right))[None]
        i, j = np.nonzero(near)
        if len(known):
            fresh = ~np.isin((i + at) * len(right) + j, known)
            i, j = i[fresh], j[fresh]
        if not len(i):
            continue
        order = np.argsort(far[i, j] - most[i, j], kind="stable")
        i, j = i[order], j[order]
        # the best pair of each two components comes first
        x, y = root[own[i + at]], root[other[j]]
        both = np.minimum(x, y) * len(root) + np.maximum(x, y)
        if every:
            for c, k in zip(both.tolist(), range(len(both)), strict=True):
                between[c] = between.get(c, 0) + 1
                if between[c] <= MOST_BETWEEN:
                    out.append((int(a.members[i[k] + at]), int(b.members[j[k]])))
            continue
        _, first = np.unique(both, return_index=True)
        for k in np.sort(first):
            p, q = top(x[k]), top(y[k])
            if p != q:
                root[max(p, q)] = min(p, q)
                out.append((int(a.members[i[k] + at]), int(b.members[j[k]])))
        while (deep := root[root] != root).any():
            root[deep] = root[root[deep]]
    return out, max(between.values(), default=0) > MOST_BETWEEN


def _blocks(num: int, den: int, every: bool):
    """Per row two blocks of a group: promising pairs between components, and a row without a pair if some are left out."""

    @runtime.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: tuple[list, list, list] = ([], [], [])
            for r in range(len(batch)):
                a, b = (_Block(*(batch.column(k)[r].values for k in range(first, first + 5))) for first in (2, 7))
                pairs, more = _between(a, b, batch.column(1)[r].as_py(), num, den, every)
                found[0].extend([batch.column(0)[r].as_py()] * (len(pairs) + more))
                found[1].extend([*(min(p) for p in pairs), *[None] * more])
                found[2].extend([*(max(p) for p in pairs), *[None] * more])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["g", "x", "y"])

    return run


_FIELDS = ("member", "n", "component", "sketch", "failed")


def _band() -> Column:
    return F.col("key").bitwiseAND(F.lit((1 << shingles.BAND_BITS) - 1))


class _Join:
    def __init__(self, docs: DataFrame, words: int, num: int, den: int):
        self.docs, self.words, self.num, self.den = docs.select("doc_id", "text"), words, num, den
        self.spark = docs.sparkSession
        self.tables = runtime.Tables(self.spark)
        self.parts = runtime.parallelism(self.spark)

    def run(self) -> DataFrame:
        """doc_id, n_shingles, component_id of every row."""
        runtime.bounded_batches(self.spark)
        write = self.tables.write
        dealt = self.docs.mapInArrow(_deal(self.words, self.num, self.den, 4 * self.parts), _DEALT)
        found = write(dealt.repartition(self.parts, "part").mapInArrow(_meet, _FOUND), "found")
        every = found.where(f"kind = {_DOCS}")
        sets = every.where("n > 0 AND doc_id IS NOT NULL")
        # documents with equal sets are one member: the smallest doc_id stands for all of them
        # the smallest ids are written first, so that a large group of copies can be split in the join
        least = write(sets.groupBy("s1", "s2").agg(F.min("doc_id").alias("member")), "least")
        stands = F.col("doc_id") == F.col("member")
        folded = sets.join(least, ["s1", "s2"]).select("doc_id", "member", *[F.when(stands, F.col(c)).alias(c) for c in ("n", "sketch", "shared")])
        self.folded = write(folded, "folded")
        self.own = self.folded.select("doc_id", "member")
        self.sketches = self.folded.where("n IS NOT NULL").select("member", "n", "sketch")

        pairs = found.where(f"kind = {_PAIRS}").select("x", "y")
        for c in ("x", "y"):
            pairs = pairs.join(self.own.select(F.col("doc_id").alias(c), F.col("member").alias(f"{c}_")), c)
        pairs = pairs.where("x_ <> y_").select(F.least("x_", "y_").alias("x"), F.greatest("x_", "y_").alias("y")).distinct()
        tested = self._verified(self._sifted(pairs).select("x", "y"))
        hot = write(found.where(f"kind = {_MEMBERS}").select(F.col("x").alias("key"), F.col("y").alias("doc_id")).join(self.own, "doc_id").select("key", "member").distinct(), "hot")
        hot = self._bound(hot)
        some = not hot.isEmpty()
        if some:
            tested = tested.union(self._verified(self._leaders(hot)))
        twice = self.own.groupBy("doc_id").agg(F.min("member").alias("a"), F.collect_set("member").alias("others")).where("size(others) > 1").select("a", F.explode("others").alias("b"))
        groups = components(tested.where("linked").select(F.col("x").alias("a"), F.col("y").alias("b")).union(twice), self.tables)
        if some:
            groups = self._settled(hot, groups, tested.where("NOT linked").select("x", "y"))
        known = self.own.join(groups, self.own["member"] == groups["node"], "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "member")).alias("component_id"))
        rows = every.select("doc_id", F.col("n").alias("n_shingles")).join(known, "doc_id", "left")
        return self.tables.last(rows.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")), "components")

    def _sifted(self, pairs: DataFrame) -> DataFrame:
        """x, y, far of the pairs that the bit sketches do not rule out (more than once, if rows share a doc_id)."""
        for c in ("x", "y"):
            pairs = pairs.join(self.sketches.select(F.col("member").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")), c)
        return pairs.select("x", "nx", "sx", "y", "ny", "sy").mapInArrow(_promising(self.num, self.den), "x long, y long, far long")

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """x, y, linked of each pair, once."""
        pairs = self.tables.write(pairs, "pairs")
        ids = self.tables.write(pairs.select(F.col("x").alias("doc_id")).union(pairs.select("y")).distinct(), "ids")
        chosen = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
        texts = self.tables.write(self.docs.join(chosen, "doc_id", "left_semi"), "texts")
        both = pairs
        for c in ("x", "y"):
            both = both.join(texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}")), c)
        exact = both.select("x", "text_x", "y", "text_y").mapInArrow(_exact(self.words, self.num, self.den), "x long, y long, linked boolean")
        # rows that share a doc_id link by any of their texts
        tested = self.tables.write(exact.groupBy("x", "y").agg(F.max("linked").alias("linked")), "verified")
        self.tables.drop(pairs, ids, texts)
        return tested

    def _bound(self, hot: DataFrame) -> DataFrame:
        """Of key, member in large buckets: the sets that have as many keys of a band there as they share with any similar set."""
        shared = self.folded.where("n IS NOT NULL").select("member", F.explode("shared").alias("v"))
        least = shared.groupBy("member", F.col("v").bitwiseAND(F.lit((1 << shingles.BAND_BITS) - 1)).cast("long").alias("band")).agg(F.min(F.shiftright("v", shingles.BAND_BITS)).alias("least"))
        counted = hot.groupBy("member", _band().alias("band")).agg(F.count("*").alias("keys"))
        stay = counted.join(least, ["member", "band"]).where("keys >= least").select("member", "band")
        return self.tables.write(hot.withColumn("band", _band()).join(stay, ["member", "band"], "left_semi").drop("band"), "bound")

    def _leaders(self, hot: DataFrame) -> DataFrame:
        """x, y: each set of large buckets with the nearest of a few leaders. Sets that share most of their keys
        mostly agree in the key that comes first in a drawn order, and so in the leader drawn for that key."""
        firsts = hot.groupBy("member", _band().alias("band")).agg(*[F.min_by("key", F.xxhash64("key", F.lit(r))).alias(f"k{r}") for r in range(LEADERS)])
        each = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.col(f"k{r}").alias("key")) for r in range(LEADERS)]))
        asked = self.tables.write(firsts.select("member", each.alias("e")).select("member", "e.r", "e.key"), "asked")
        leaders = self.tables.write(asked.groupBy("r", "key").agg(F.min_by("member", F.xxhash64("member", "r")).alias("leader")), "leaders")
        pairs = asked.join(leaders, ["r", "key"]).where("member <> leader").select(F.col("member").alias("x"), F.col("leader").alias("y")).distinct()
        return self._sifted(pairs).groupBy("x").agg(F.min_by("y", F.struct("far", "y")).alias("y"))

    def _settled(self, hot: DataFrame, groups: DataFrame, failed: DataFrame) -> DataFrame:
        """groups, with every link inside the large buckets."""
        write, drop = self.tables.write, self.tables.drop
        placed = hot.join(groups, hot["member"] == groups["node"], "left").select("key", "member", F.coalesce("component", "member").alias("component"))
        mixed = placed.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("key")
        rows = self._bound(placed.join(mixed, "key", "left_semi"))
        if rows.isEmpty():
            return groups
        # sets that share large buckets, directly or through others, are a group
        near = rows.join(rows.groupBy("key").agg(F.min("member").alias("first")), "key").select(F.col("member").alias("a"), F.col("first").alias("b"))
        group = components(near, self.tables).select(F.col("node").alias("member"), F.col("component").alias("g"))
        units = write(rows.select("member", _band().alias("band")).distinct().join(group, "member").join(self.sketches, "member"), "units")
        drop(hot, rows)
        every = False
        while True:
            pairs = write(self._block_pairs(units, groups, failed, every), "open")
            tested = self._verified(pairs.where("x IS NOT NULL").select("x", "y").distinct())
            by = lambda c, name: groups.select(F.col("node").alias(c), F.col("component").alias(name))  # noqa: E731, B023
            linked = tested.where("linked").join(by("x", "a"), "x", "left").join(by("y", "b"), "y", "left").select(F.coalesce("a", "x").alias("a"), F.coalesce("b", "y").alias("b"))
            moved = components(linked, self.tables).select(F.col("node").alias("component"), F.col("component").alias("new"))
            known = groups.select("node", "component").union(moved.select("component", "component")).distinct()
            merged = write(known.join(moved, "component", "left").groupBy("node").agg(F.min(F.coalesce("new", "component")).alias("component")), "groups")
            wrong = write(tested.where("NOT linked").select("x", "y"), "wrong")
            # a forest is settled if all of it holds; a list of all promising pairs, if none was left out
            left = pairs.where("x IS NULL") if every else pairs.join(wrong, ["x", "y"])
            again = write(left.select("g").distinct(), "again")
            drop(pairs, tested)
            groups, every = merged, True
            if again.isEmpty():
                return groups
            failed = write(failed.union(wrong), "failed")
            units = write(units.join(again, "g", "left_semi"), "units")

    def _block_pairs(self, units: DataFrame, groups: DataFrame, failed: DataFrame, every: bool) -> DataFrame:
        """g, x, y: promising pairs between the components of a group and band, as forests or all of them; a g without
        a pair tells that some of its pairs are left out."""
        write = self.tables.write
        # each failed pair is kept by one of its two sets, so that no set keeps all of a large group's
        side = F.pmod(F.xxhash64("x", "y"), F.lit(2)) == 0
        kept = failed.select(F.when(side, F.col("x")).otherwise(F.col("y")).alias("member"), F.when(side, F.col("y")).otherwise(F.col("x")).alias("other")).groupBy("member").agg(F.collect_set("other").alias("failed"))
        now = groups.select(F.col("node").alias("member"), F.col("component").alias("now"))
        placed = units.join(now, "member", "left").join(kept, "member", "left")
        placed = write(placed.select("member", "band", "g", "n", "sketch", F.coalesce("now", "member").alias("component"), F.coalesce("failed", F.array().cast("array<long>")).alias("failed")), "placed")
        unit = ["g", "band"]
        sizes = write(placed.groupBy(*unit, "component").agg(F.sum(F.octet_length("sketch") + 8 * F.size("failed") + 32).alias("bytes")), "sizes")
        # a large component has blocks of its own, small ones share blocks; a group of one component needs none
        solo = F.col("bytes") >= BLOCK_BYTES // 2
        pooled = sizes.groupBy(*unit).agg(F.sum(F.when(~solo, F.col("bytes"))).alias("pooled"), F.count("*").alias("components")).where("components > 1")
        chunks = sizes.join(pooled, unit).select(*unit, "component", solo.alias("solo"), F.ceil(F.when(solo, F.col("bytes")).otherwise(F.col("pooled")) / BLOCK_BYTES).alias("chunks"))
        dealt = placed.join(chunks, [*unit, "component"]).withColumn("owner", F.when(F.col("solo"), F.col("component")).otherwise(F.lit(0))).withColumn("chunk", F.pmod(F.xxhash64("member"), F.col("chunks")))
        packed = dealt.groupBy(*unit, "solo", "owner", "chunk").agg(F.collect_list(F.struct(*_FIELDS)).alias("sets"))
        blocks = write(packed.select(F.monotonically_increasing_id().alias("block"), *unit, "solo", "owner", *[F.col(f"sets.{c}").alias(c) for c in _FIELDS]), "blocks")
        end = lambda s: blocks.select(*unit, F.col("block").alias(s), F.col("solo").alias(f"solo_{s}"), F.col("owner").alias(f"owner_{s}"))
        met = end("p").join(end("q"), unit).where("p <= q AND NOT (solo_p AND solo_q AND owner_p = owner_q)").select("g", "p", "q")
        for s in ("p", "q"):
            met = met.join(blocks.select(F.col("block").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in _FIELDS]), s)
        met = met.select("g", (F.col("p") == F.col("q")).alias("same"), *[f"{c}_{s}" for s in ("p", "q") for c in _FIELDS])
        return met.mapInArrow(_blocks(self.num, self.den, every), "g long, x long, y long").distinct()


def near_components(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: documents whose sets of `words`-word shingles have a
    Jaccard similarity of at least num/den are linked."""
    return _Join(docs, words, num, den).run()


def one_of_each(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one document of each component: the one with the smallest doc_id. Rows without a doc_id stay."""
    found = near_components(docs, words, num, den)
    kept = found.where("doc_id = component_id").select("doc_id").distinct()
    first = Window.partitionBy("doc_id").orderBy(F.col("doc.text").asc_nulls_last())
    whole = docs.where("doc_id IS NOT NULL").select("doc_id", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    chosen = whole.join(kept, "doc_id").withColumn("place", F.row_number().over(first)).where("place = 1")
    return chosen.select("doc.*").union(docs.where("doc_id IS NULL"))
