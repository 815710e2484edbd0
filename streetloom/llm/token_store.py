"""Token ids as directly addressable codes (DAC), one binary file per shard.

Every id is cut into chunks of a few bits. Level 0 holds the lowest chunk of every id and one
continuation bit each; level k+1 holds the next chunk of those ids whose bit at level k is set.
A rank directory over the continuation bits tells where an id goes on, so any single id is read
with one chunk per level and nothing else is decoded. Chunk widths are chosen per shard so that
the shard is smallest.

File layout: 4 bytes magic, 4 bytes header length, JSON header, then the arrays that the header
names in order (document ids, null flags, offsets, and chunks, bits and ranks of each level),
then 4 bytes CRC of all before. What follows is padding. Shards are made in ascending document
order by a range partitioning, and the files are written and read through Spark, on any store.

Defined results: a null text is empty and still gets its end id; null doc_ids sort first and stay
null; repeated rows are kept one by one, ordered by text; an empty table makes no rows; other
columns are ignored.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import runtime, textbuf
from .tokenize import loaded

MAGIC = b"DAC1"
#: Ids and bytes of text that a shard holds at most (one longer document makes a shard of its own).
SHARD_TOKENS = 1 << 20
RANK_EVERY = 512
#: Values that are packed at once, a multiple of eight.
PIECE = 1 << 15
FIELDS = "doc_id long, part int, shard int, shard_start long, local_start long, n_tokens long, ids_crc32 long"


def chunk_widths(values: np.ndarray) -> list[int]:
    """Widths of the levels that make the fewest bits: dynamic programming over bit lengths."""
    if not len(values):
        return [1]
    lengths = np.frexp(values.astype(np.float64))[1]
    top = max(1, int(lengths.max()))
    longer = [int((lengths > b).sum()) for b in range(top)]
    longer[0] = len(values)
    best, choice = [0] * (top + 1), [0] * (top + 1)
    for b in range(top - 1, -1, -1):
        best[b], choice[b] = min((longer[b] * (w + 1) + best[b + w], w) for w in range(1, top - b + 1))
    widths, b = [], 0
    while b < top:
        widths.append(choice[b])
        b += choice[b]
    return widths


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    # in pieces that end on whole bytes: a value's bits take eight bytes each on the way
    pieces = [np.packbits(((values[a : a + PIECE, None] >> np.arange(width)) & 1).astype(np.uint8), bitorder="little") for a in range(0, len(values), PIECE)]
    return np.concatenate(pieces) if pieces else np.zeros(0, np.uint8)


def _unpack(chunks: np.ndarray, n: int, width: int) -> np.ndarray:
    out, weights = np.empty(n, np.int64), 1 << np.arange(width, dtype=np.int64)
    for a in range(0, n, PIECE):
        m = min(PIECE, n - a)
        out[a : a + m] = np.unpackbits(chunks[a * width // 8 :], count=m * width, bitorder="little").reshape(m, width) @ weights
    return out


def encode_shard(ids: np.ndarray, doc_ids: list, offsets: np.ndarray, **facts) -> bytes:
    """One shard file: the ids of several documents with their ids and offsets."""
    values = ids.astype(np.int64)
    arrays: list[tuple[str, np.ndarray]] = [
        ("doc_ids", np.array([d or 0 for d in doc_ids], "<i8")),
        ("nulls", np.array([d is None for d in doc_ids], np.uint8)),
        ("offsets", offsets.astype("<i8")),
    ]
    widths, sizes = chunk_widths(values), []
    for k, width in enumerate(widths):
        sizes.append(len(values))
        more = (values >> width) > 0
        bits = np.packbits(more, bitorder="little")
        ranks = np.concatenate([[0], np.cumsum(np.add.reduceat(more, np.arange(0, len(more), RANK_EVERY)))]) if len(more) else np.zeros(1)
        arrays += [(f"chunks{k}", _pack(values & ((1 << width) - 1), width)), (f"bits{k}", bits), (f"ranks{k}", ranks.astype("<u4"))]
        values = values[more] >> width
    header = json.dumps(facts | {"n": len(ids), "widths": widths, "sizes": sizes, "arrays": [[name, a.dtype.str, a.nbytes] for name, a in arrays]}).encode()
    body = b"".join([MAGIC, struct.pack("<I", len(header)), header, *(a.tobytes() for _, a in arrays)])
    return body + struct.pack("<I", zlib.crc32(body))


class Shard:
    """A shard file read back: whole, or any of its ids alone."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not a token shard")
        (length,) = struct.unpack_from("<I", raw, 4)
        self.header = json.loads(raw[8 : 8 + length])
        at, self.arrays = 8 + length, {}
        for name, kind, size in self.header["arrays"]:
            self.arrays[name] = np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at)
            at += size
        if zlib.crc32(memoryview(raw)[:at]) != struct.unpack_from("<I", raw, at)[0]:
            raise ValueError("a token shard is damaged")
        self.doc_ids = [None if null else int(d) for d, null in zip(self.arrays["doc_ids"], self.arrays["nulls"], strict=True)]
        self.offsets = self.arrays["offsets"]

    def ids(self) -> np.ndarray:
        """All ids, level by level from the top."""
        values = np.zeros(0, np.int64)
        for k in range(len(self.header["widths"]) - 1, -1, -1):
            width, n = self.header["widths"][k], self.header["sizes"][k]
            chunk = _unpack(self.arrays[f"chunks{k}"], n, width)
            more = np.unpackbits(self.arrays[f"bits{k}"], count=n, bitorder="little").astype(bool)
            chunk[more] |= values << width
            values = chunk
        return values.astype(np.uint32)

    def at(self, i: int) -> int:
        """The i-th id, by one chunk per level and the rank directories."""
        if not 0 <= i < self.header["n"]:
            raise IndexError(i)
        value = shift = 0
        for k, width in enumerate(self.header["widths"]):
            first = i * width
            piece = int.from_bytes(self.arrays[f"chunks{k}"][first // 8 : (first + width + 7) // 8].tobytes(), "little")
            value |= ((piece >> (first % 8)) & ((1 << width) - 1)) << shift
            bits = self.arrays[f"bits{k}"]
            if not bits[i // 8] >> (i % 8) & 1:
                break
            block = i // RANK_EVERY
            inside = np.unpackbits(bits[block * RANK_EVERY // 8 : i // 8 + 1], bitorder="little")[: i - block * RANK_EVERY]
            i = int(self.arrays[f"ranks{k}"][block]) + int(inside.sum())
            shift += width
        return value


def _encoder(tokenizer_file: str, end_id: int, shard_tokens: int):
    @runtime.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part = loaded(tokenizer_file), TaskContext.get().partitionId()
        docs: list = []
        pieces: list[np.ndarray] = []
        sizes: list[int] = [0]
        held = start = shard = 0

        def flush() -> pa.RecordBatch:
            nonlocal docs, pieces, sizes, held, start, shard
            ids = np.concatenate(pieces)
            raw = encode_shard(ids, docs, np.cumsum(sizes), part=part, shard=shard, start=start)
            start, shard = start + len(ids), shard + 1
            docs, pieces, sizes, held = [], [], [0], 0
            return pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], ["payload"])

        for batch in batches:
            ids_of = batch.column(0).to_pylist()
            for first, end, buf, offsets in textbuf.chunks(batch.column(1)):
                ids, at = tokenizer.encode(buf, offsets)
                for row in range(first, end):
                    own = ids[at[row - first] : at[row - first + 1]]
                    docs.append(ids_of[row])
                    pieces += [own, np.array([end_id], np.int32)]
                    sizes.append(len(own) + 1)
                    held += len(own) + 1
                    if held >= shard_tokens:
                        yield flush()
        if docs:
            yield flush()

    return run


def write(docs: DataFrame, path: str, tokenizer_file: str, end_id: int, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode all texts and write the shard files to path, in ascending doc_id order."""
    spark = docs.sparkSession
    runtime.bounded_batches(spark)
    ordered = docs.select("doc_id", "text").repartitionByRange(runtime.parallelism(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    shards = ordered.mapInArrow(_encoder(tokenizer_file, end_id, shard_tokens), "payload binary")
    # a text file takes the bytes of a string column as they are: a plain binary file per shard on any store
    shards.select(F.col("payload").cast("string")).write.option("maxRecordsPerFile", 1).option("compression", "none").text(path)


@runtime.lean
def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch.column(0):
            shard = Shard(raw.as_py())
            ids, at = shard.ids().astype("<u4"), shard.offsets
            n, h = len(shard.doc_ids), shard.header
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(shard.doc_ids, pa.int64()), pa.array(np.full(n, h["part"], np.int32)), pa.array(np.full(n, h["shard"], np.int32)), pa.array(np.full(n, h["start"], np.int64)),
                    pa.array(at[:-1].astype(np.int64)), pa.array(np.diff(at).astype(np.int64)), pa.array([zlib.crc32(ids[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.int64()),
                ],
                ["doc_id", "part", "shard", "shard_start", "local_start", "n_tokens", "ids_crc32"],
            )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files below path: doc_id, start, n_tokens, ids_crc32 and its place."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 8").select("content")
    rows = runtime.stage(files.mapInArrow(_summaries, FIELDS), "token_rows")
    # one row per range partition: as many as the writer had tasks
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.join(F.broadcast(parts.select("part", "base")), "part").select(
        "doc_id", (F.col("base") + F.col("shard_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32", "part", "shard", "local_start"
    )


def read_tokens(spark: SparkSession, path: str, places: DataFrame) -> DataFrame:
    """The ids at given places (part, shard, position): each shard is opened once and only those ids are read."""

    def pick(key, wanted, found):
        shard = Shard(found.column("content")[0].as_py())
        at = wanted.column("position").to_pylist()
        return pa.table({"part": pa.array([key[0].as_py()] * len(at), pa.int32()), "shard": pa.array([key[1].as_py()] * len(at), pa.int32()), "position": pa.array(at, pa.int64()), "token": pa.array([shard.at(i) for i in at], pa.int64())})

    def heads(batches):
        for batch in batches:
            for raw in batch.column(0):
                h = Shard(raw.as_py()).header
                yield pa.RecordBatch.from_arrays([pa.array([h["part"]], pa.int32()), pa.array([h["shard"]], pa.int32()), pa.array([raw.as_py()], pa.binary())], ["part", "shard", "content"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 8").select("content")
    shards = files.mapInArrow(heads, "part int, shard int, content binary").join(places.select("part", "shard").distinct(), ["part", "shard"], "left_semi")
    return places.groupBy("part", "shard").cogroup(shards.groupBy("part", "shard")).applyInArrow(pick, "part int, shard int, position long, token long")
