"""Ship this package to Python workers that can't import it from their own path."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Add the package to the session's Python files once, unless PYTHONPATH already names it."""
    sc = spark.sparkContext
    on_path = {str(Path(p).resolve()) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if str(_ROOT) in on_path or sc.applicationId in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="rillmark-")
    sc.addPyFile(shutil.make_archive(f"{folder}/rillmark", "zip", _ROOT, "rillmark"))
    _shipped.add(sc.applicationId)
