"""Sends this package to the executors, so that Python workers can import it wherever they run."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

import turnwise

_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Once for each application: pack the package and let Spark's file server hand it out."""
    app = spark.sparkContext.applicationId
    if app not in _sent:
        root = Path(turnwise.__file__).parent
        target = Path(tempfile.mkdtemp(prefix="turnwise-ship-")) / "turnwise_package.zip"
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f"{root.name}/{f.relative_to(root)}")
        spark.sparkContext.addPyFile(str(target))
        _sent.add(app)
    return spark
