"""Code for Python workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers that don't have it on their path; call once a session before Python operators."""
    root = Path(__file__).resolve().parents[1]
    listed = {str(Path(p).resolve()) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    context = spark.sparkContext
    if str(root) in listed or getattr(ship, "done", None) == context.applicationId:
        return
    at = tempfile.mkdtemp(prefix="loam-code-")  # the driver's own; Spark sends the file to executors
    atexit.register(shutil.rmtree, at, ignore_errors=True)
    made = Path(at) / f"loam-{uuid.uuid4().hex}.zip"
    with zipfile.ZipFile(made, "w") as z:
        for p in sorted((root / "loam").rglob("*.py")):
            z.write(p, p.relative_to(root))
    context.addPyFile(str(made))
    ship.done = context.applicationId
