"""Sending this package to Python workers that would not find it otherwise."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application: add the package to the workers' path, unless PYTHONPATH already leads them to it."""
    root = Path(__file__).resolve().parents[2]
    known = {Path(p or ".").resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    app = spark.sparkContext.applicationId
    if root in known or app in _SENT:
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="millrace-"), "millrace.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted((root / "millrace").rglob("*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(archive)  # the driver serves it to every executor
    _SENT.add(app)
