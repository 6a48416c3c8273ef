"""Making the package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors once for each Spark application.

    Not needed, and not done, where it is on PYTHONPATH already, as executors inherit it.
    """
    sc = spark.sparkContext
    if getattr(sc, "_tetraclade_shipped", False):
        return
    sc._tetraclade_shipped = True
    if str(_ROOT.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    archive = Path(tempfile.mkdtemp()) / f"{_ROOT.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(_ROOT.rglob("*.py")):
            z.write(p, p.relative_to(_ROOT.parent))
    sc.addPyFile(str(archive))  # copied to the driver's file server
