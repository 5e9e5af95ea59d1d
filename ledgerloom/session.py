"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once for each application, so that Python functions load wherever they run.

    Arrow batches are kept to 4,000 rows and 8 MB, which bounds the memory of Python workers and of the buffers that feed them.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4000)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        top = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="ledgerloom-"), "ledgerloom.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(top):
                for name in sorted(names):
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.join("ledgerloom", os.path.relpath(full, top)))
        spark.sparkContext.addPyFile(path)
        _SHIPPED.add(app)
    return spark
