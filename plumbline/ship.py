"""Making this package importable for Spark's Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package to the executors, once for each application; they need not share a folder with the driver."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        here = Path(__file__).resolve().parent
        name = os.path.join(tempfile.mkdtemp(prefix="plumbline-"), "plumbline.zip")
        with zipfile.ZipFile(name, "w") as z:
            for p in sorted(here.rglob("*.py")):
                z.write(p, f"plumbline/{p.relative_to(here)}")
        sc.addPyFile(name)
        _shipped.add(sc.applicationId)
    return spark
