"""The package itself, for executors that share no Python path with the driver."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parents[1]


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that they need no shared Python path."""
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="tessera-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "tessera_pkg.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(PACKAGE.rglob("*.py")):
            z.write(f, f.relative_to(PACKAGE.parent))
    sc.addPyFile(path)
    sc._tessera_shipped = True
