"""Make this package importable in the Python workers of any cluster."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's modules to the executors, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    path = Path(tempfile.mkdtemp()) / "fieldgauge_modules.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for module in sorted((root / "fieldgauge").rglob("*.py")):
            archive.write(module, module.relative_to(root))
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)
