"""What every corpus operator shares: the common folder, bounded Arrow batches, stage tables."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from functools import lru_cache, wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of an Arrow batch that goes to a Python worker.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


@lru_cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="streetloom-")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset, a temporary one serves on a single machine;
    on a cluster it would be out of the executors' sight, so there the setting is asked for."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own_folder()
    return f"{base.rstrip('/')}/streetloom-{uuid.uuid4().hex}"


def bounded_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches small, so that very long texts do not add up in a worker. The setting
    must still hold when the lazy result is computed, so it stays; smaller ones are left as they are."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key)
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def lean(run):
    """A function over Arrow batches whose worker gives its free memory back to the system when the task ends: workers
    stay alive between tasks, and what they hold idly adds to the memory of an executor's other stages."""

    @wraps(run)
    def inner(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if hasattr(library := ctypes.CDLL(None), "malloc_trim"):
                library.malloc_trim(0)

    return inner


def stage(frame: DataFrame, name: str = "stage") -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives lost executors."""
    path = f"{shared_folder(frame.sparkSession)}/{name}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Tables:
    """The stage tables of one operator, each removed as soon as nothing reads it any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.made = spark, shared_folder(spark), 0

    def write(self, frame: DataFrame, name: str) -> DataFrame:
        self.made += 1
        path = f"{self.folder}/{self.made}-{name}"
        frame.write.parquet(path)
        written = self.spark.read.schema(frame.schema).parquet(path)
        written._path = path
        return written

    def drop(self, *frames: DataFrame | None) -> None:
        for frame in frames:
            if frame is not None:
                delete(self.spark, frame._path)

    def last(self, frame: DataFrame, name: str) -> DataFrame:
        """The operator's result as a table of its own; all others go."""
        written = stage(frame, name)
        delete(self.spark, self.folder)
        return written


def parallelism(spark: SparkSession) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
