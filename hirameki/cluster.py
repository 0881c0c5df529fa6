"""What a session's workers need."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import suppress
from pathlib import Path

from pyspark.sql import SparkSession

#: Bytes of an Arrow batch, and the session's own default that it takes the place of.
BATCH, BATCH_DEFAULT = "4m", 64 << 20


def ship(spark: SparkSession) -> None:
    """Sends this package to the session's Python workers, once: they need not have it installed.

    Batches for the workers get a bound in bytes, as rows with long texts would make them of many MB in both processes;
    a session that has set a bound of its own keeps it.
    """
    context = spark.sparkContext
    bound = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_DEFAULT}b")
    if bound in (f"{BATCH_DEFAULT}b", str(BATCH_DEFAULT), "64MB", "64m"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    if getattr(context, "_shipped_package", None) is None:
        top = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="package-")
        context._shipped_package = shutil.make_archive(f"{folder}/{top.name}", "zip", top.parent, top.name)
        context.addPyFile(context._shipped_package)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; in a local session without one, a temporary folder."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="checkpoints-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def workspace(spark: SparkSession) -> str:
    """A new folder's path in the shared folder; what is written there goes when the driver ends."""
    path = f"{shared_dir(spark)}/work-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def remove() -> None:
        with suppress(Exception):  # the session may have ended before
            files.delete(at, True)

    atexit.register(remove)
    return path
