"""Getting the package to the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package, zipped, to the Python path of this session's executors, once per application."""
    context = spark.sparkContext
    if not getattr(context, "_palimpsest_shipped", False):
        root = Path(__file__).resolve().parents[1]
        path = Path(tempfile.mkdtemp(prefix="palimpsest-")) / "palimpsest.zip"
        with zipfile.ZipFile(path, "w") as out:
            for file in sorted(root.rglob("*.py")):
                out.write(file, file.relative_to(root.parent))
        context.addPyFile(str(path))
        context._palimpsest_shipped = True
    return spark
