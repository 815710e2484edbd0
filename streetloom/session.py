"""Making the engine's own code importable in the Python workers of any cluster."""

from __future__ import annotations

import io
import tempfile
import zipfile
from functools import wraps
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per Spark application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent))
    target = Path(tempfile.mkdtemp(prefix="streetloom-code-")) / "streetloom.zip"
    target.write_bytes(buffer.getvalue())
    context.addPyFile(str(target))
    _SHIPPED.add(context.applicationId)


def shipped(query):
    """A query that first makes sure that the workers can import the package."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str):
        ship(spark)
        return query(spark, sf_dir)

    return run
