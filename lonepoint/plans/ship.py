"""The package's code for executors that cannot import it."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]


def ship(spark: SparkSession) -> None:
    """Hand the package to the executors once for each session, unless PYTHONPATH, which they share, has it."""
    sc = spark.sparkContext
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_lonepoint_shipped", False):
        return
    # The driver serves the file from here to executors that start later, so it stays until the driver ends.
    folder = tempfile.mkdtemp(prefix="lonepoint-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(to := f"{folder}/lonepoint_code.zip", "w") as z:
        for p in sorted((ROOT / "lonepoint").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(to)
    sc._lonepoint_shipped = True
