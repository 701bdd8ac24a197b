"""Session settings, table access and the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str = "local[*]", app: str = "tallyweave", **extra: str) -> SparkSession:
    """A session with the settings this package is tested with; extra settings win."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in {**_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    Where none is named, a session on one machine (tests) gets a folder of its own; on a cluster that raises, as executors
    can't see each other's local folders.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not _one_machine(spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tallyweave-")
        atexit.register(shutil.rmtree, folder.removeprefix("file://"), True)
        spark.conf.set("spark.checkpoint.dir", folder)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def _one_machine(master: str) -> bool:
    return master == "local" or master.startswith("local[")


_MADE: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path inside the shared folder, removed by ``release``."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there, wherever the cluster keeps it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> int:
    """Delete all scratch tables this application has written so far; returns how many paths there were.

    To be called once the results that read them are written; a result that isn't written yet can't be computed any more.
    """
    made = _MADE.pop(spark.sparkContext.applicationId, [])
    for path in made:
        remove(spark, path)
    return len(made)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once into the shared folder and go on from the files.

    A written table, unlike cached blocks, survives the loss of an executor and is read column by column.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def finite(column) -> "F.Column":
    """True where a double is neither null, NaN nor infinite."""
    return column.isNotNull() & ~F.isnan(column) & (F.abs(column) != F.lit(float("inf")))
