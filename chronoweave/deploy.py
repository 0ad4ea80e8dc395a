"""Makes this package importable in Python workers that do not share the driver's sys.path."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once an application."""
    sc = spark.sparkContext
    root = os.path.dirname(os.path.abspath(__file__))
    above = os.path.dirname(root)
    if sc.applicationId in _sent or above in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    _sent.add(sc.applicationId)
    path = os.path.join(tempfile.mkdtemp(), "chronoweave.zip")
    with zipfile.ZipFile(path, "w") as z:
        for top, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    z.write(full, os.path.relpath(full, above))
    sc.addPyFile(path)
