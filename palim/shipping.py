"""Readies a session for functions that run in Python on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


#: Bytes of rows that go to Python at once: long texts must not add up.
BATCH_BYTES = 3 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's files, once, so that functions which refer to it can be unpickled there; bounds Arrow batches where the session doesn't."""
    sc = spark.sparkContext
    if not sc.getConf().contains(_BATCH):
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    if getattr(sc, "_palim_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="palim-")), "palim_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("palim", os.path.relpath(full, top)))
    sc.addPyFile(path)
    sc._palim_shipped = True
