"""Where intermediate tables go, and when they go away."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import SparkSession

#: Folders that this process has made, each with the file system settings to reach it by.
_made: list[tuple] = []


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below the cluster's shared checkpoint directory.

    That is ``spark.checkpoint.dir``, or what the context was told by setCheckpointDir. Only a
    session on one machine may do without and gets a local folder. Results may read from the folder,
    so it lasts until ``release_scratch`` or the end of the driver.
    """
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if shared:
        folder = f"{shared.rstrip('/')}/glyphloom-{uuid.uuid4().hex}"
    elif context.master.startswith("local") and not context.master.startswith("local-cluster"):
        folder = tempfile.mkdtemp(prefix="glyphloom-")
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    jvm = spark._jvm
    _made.append((jvm.org.apache.hadoop.fs.Path(folder), spark._jsc.hadoopConfiguration()))
    return folder


def release_scratch() -> None:
    """Remove the folders made so far; frames that read from them can no longer be used."""
    while _made:
        place, settings = _made.pop()
        with contextlib.suppress(Exception):  # at the driver's end the store may be gone
            place.getFileSystem(settings).delete(place, True)


atexit.register(release_scratch)
