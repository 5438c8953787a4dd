"""Evidence analytics on Spark."""

from __future__ import annotations

import os
import tempfile
import zipfile
from typing import TYPE_CHECKING

if TYPE_CHECKING:
    from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Sends this package to the session's Python workers, once; needed where it isn't installed on every machine."""
    sc = spark.sparkContext
    if getattr(sc, "_has_tessera", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tessera-package-"), "tessera-package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    file = os.path.join(folder, name)
                    z.write(file, os.path.relpath(file, os.path.dirname(top)))
    sc.addPyFile(path)
    sc._has_tessera = True
