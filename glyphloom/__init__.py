"""Snippet extraction, vector search and incremental snippet indexes on Spark."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once per application.

    Needed where it is not installed on them: its Arrow functions are imported there.
    """
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        home = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp(prefix="glyphloom-ship-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)  # served until the driver ends
        target = os.path.join(folder, "glyphloom")
        archive = shutil.make_archive(target, "zip", os.path.dirname(home), os.path.basename(home))
        context.addPyFile(archive)
        _shipped.add(context.applicationId)
    return spark
