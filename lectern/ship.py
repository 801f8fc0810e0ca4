"""Making this package known to Python workers that do not share the driver's import path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once a session, unless workers find it by PYTHONPATH or, in local mode, by the current folder."""
    sc = spark.sparkContext
    known = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if sc.master.startswith("local[") or sc.master == "local":
        known.add(os.getcwd())
    if str(ROOT) in known or sc.applicationId in _shipped:
        return
    path = Path(tempfile.mkdtemp(prefix="lectern-"), "lectern.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted((ROOT / "lectern").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)
