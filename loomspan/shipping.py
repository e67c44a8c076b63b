"""The package on the executors' Python workers."""

from __future__ import annotations

import os
import tempfile
import weakref
import zipfile

from pyspark.sql import SparkSession

from loomspan.shared import settle

#: Bytes of an Arrow batch on its way to Python.
BATCH_BYTES = 8 << 20

_SHIPPED: weakref.WeakSet = weakref.WeakSet()


def ship(spark: SparkSession) -> None:
    """Give this package to the session's Python workers (once), and bound their batches."""
    settle(spark)
    context = spark.sparkContext
    if context in _SHIPPED:
        return
    _SHIPPED.add(context)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    package = os.path.dirname(os.path.abspath(__file__))
    if not os.path.isdir(package):  # it came from an archive that the workers have as well
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="loomspan-"), "loomspan-source.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
