"""Sends this package to the executors, so that a job runs from any working directory."""

from __future__ import annotations

import atexit
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the Python path of the executors, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    here = Path(__file__).resolve().parent
    with tempfile.NamedTemporaryFile(prefix="graftwork-", suffix=".zip", delete=False) as f, zipfile.ZipFile(f, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    sc.addPyFile(f.name)
    atexit.register(lambda: os.path.exists(f.name) and os.remove(f.name))  # executors that start later ask the driver for it
    _sent.add(sc.applicationId)
