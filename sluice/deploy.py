"""Ships this package to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

#: Most bytes of rows that go to a Python worker at once: bounds a task's Arrow buffers and the worker's copy of them.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def ship(spark: SparkSession) -> SparkSession:
    """Add a zip of the package to the job, once per context, so that workers import it.

    Also lowers the session's Arrow batches to BATCH, unless the cluster sets a limit of its own.
    """
    context = spark.sparkContext
    if getattr(context, "_sluice_shipped", False):
        return spark
    if context.getConf().get(BATCH[0]) is None:
        spark.conf.set(*BATCH)
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="sluice-"), "sluice_package.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    path = os.path.join(folder, n)
                    z.write(path, os.path.join("sluice", os.path.relpath(path, root)))
    context.addPyFile(target)
    context._sluice_shipped = True
    return spark
