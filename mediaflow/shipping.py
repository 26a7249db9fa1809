"""Makes this package importable in the Python workers of a session."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Hand the package to the executors, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    if package.parent.suffix != ".zip":
        # Spark copies the archive to its own file service; the local one is only the upload.
        archive = os.path.join(tempfile.mkdtemp(prefix="mediaflow-code-"), "mediaflow.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for source in sorted(package.rglob("*.py")):
                out.write(source, str(source.relative_to(package.parent)))
        context.addPyFile(archive)
    _shipped.add(context.applicationId)
