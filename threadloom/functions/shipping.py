"""Sends this package to the executors, so that Python tasks can import it wherever they start."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Adds the package as a zip to the session's Python files, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    if not root.is_dir():  # already imported from a zip that Spark has sent
        return
    archive = Path(tempfile.mkdtemp(prefix="threadloom-package-")) / "threadloom.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
