"""Stage tables in the shared folder of the cluster, to cut the lineage of iterative plans."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


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
    return f"{base.rstrip('/')}/stage-{uuid.uuid4().hex}"


def stage(frame: DataFrame) -> DataFrame:
    path = shared_folder(frame.sparkSession)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
