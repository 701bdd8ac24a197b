"""Work that arrives in files and is done once: a checkpointed file stream and a key-based anti-join."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def pending(tasks: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks without a finished row of the same keys. Independent of order, so changed inputs never skip the wrong work."""
    return tasks.join(done.select(*keys), keys, "left_anti")


def run_available(spark: SparkSession, source: str, schema: StructType | str, out: str, checkpoint: str, keys: list[str], work: Callable[[DataFrame], DataFrame]) -> int:
    """Take in all new JSON files of ``source``, do the work that isn't done, append the results to the Parquet log ``out``.

    Each batch is joined against the log first, so a batch replayed after a failure adds nothing twice; repeated keys of a
    batch are done once. Returns how many batches ran.
    """
    ran = []

    def step(batch: DataFrame, number: int) -> None:
        fresh = batch.dropDuplicates(keys)
        if ran or _exists(spark, out):
            fresh = pending(fresh, spark.read.parquet(out), keys)
        work(fresh).write.mode("append").parquet(out)
        ran.append(number)

    stream = spark.readStream.schema(schema).json(source)
    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return len(ran)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def rounds(tasks: DataFrame, log: str, keys: list[str], work: Callable[[DataFrame], DataFrame], most: int = 10) -> int:
    """Run ``work`` on what is pending until nothing is, nothing more gets done, or ``most`` rounds went by.

    ``work`` returns only the rows that succeeded; they are appended to ``log``. Returns how many tasks stay open.
    """
    spark = tasks.sparkSession
    left = tasks.count()
    for _ in range(most):
        todo = pending(tasks, spark.read.parquet(log), keys) if _exists(spark, log) else tasks
        work(todo).write.mode("append").parquet(log)
        still = pending(tasks, spark.read.parquet(log), keys).count()
        if still in (0, left):
            return still
        left = still
    return left
