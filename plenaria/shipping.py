"""Sends the package to the workers, so that functions pickled by name are found there."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application: a zip of the package that the driver serves to every worker."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    package = Path(__file__).resolve().parent
    made = f"{tempfile.mkdtemp(prefix='plenaria-')}/{package.name}.zip"
    with zipfile.ZipFile(made, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f"{package.name}/{f.relative_to(package)}")
    sc.addPyFile(made)
