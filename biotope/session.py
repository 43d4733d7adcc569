"""Session, shared folder, and tables written once for the jobs that read them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

_own_folder: list[str] = []
_shipped: set[str] = set()


def local_session(cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and benchmarks; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("biotope")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Set the runtime options the results depend on (time zone) or profit from (adaptive execution)."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers, once per application, wherever the driver imported it from."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="biotope-code-")  # Spark serves the file from here as long as the driver lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.addPyFile(shutil.make_archive(f"{folder}/{package.name}-{uuid.uuid4().hex[:8]}", "zip", package.parent, package.name))
    _shipped.add(context.applicationId)


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """New folder below the folder that driver and executors share.

    That is the one named in ``spark.checkpoint.dir``, or the one given to
    ``SparkContext.setCheckpointDir``. In local mode, where both are unset, a
    folder of our own is made and removed when the process ends. On a cluster
    such a folder would hold each executor's part on its own disk, so there it
    is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        named = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = named.get() if named.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own_folder:
            _own_folder.append(tempfile.mkdtemp(prefix="biotope-"))
            atexit.register(shutil.rmtree, _own_folder[0], ignore_errors=True)
        base = _own_folder[0]
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, purpose: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where several jobs read one intermediate table (iterative fits, edge
    sampling followed by the main pass). The files survive executor loss and cut
    the lineage. The schema is read from the files, so a folder that the reader
    cannot see is an error instead of an empty table.
    """
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
