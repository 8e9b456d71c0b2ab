"""Intermediate tables of one operator call, in the folder all executors share.

The folder is the one named by ``spark.checkpoint.dir``. Only a local session
without that setting (tests) gets a temporary one; on a cluster it is an error.
Tables are plain Parquet, so a lost executor costs the tasks it ran and nothing
that was written before.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return str(folder).rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="engram-shared-"))
    return str(spark.sparkContext.getCheckpointDir())


def free_shuffles(spark: SparkSession) -> None:
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Scratch:
    """Named tables under one fresh folder; ``drop`` deletes those no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self._at_exit)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("errorifexists").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def tidy(self) -> None:
        """Lets go of the shuffle files of finished steps: Spark deletes them when the driver collects garbage."""
        free_shuffles(self.spark)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.root}/{name}")

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        target.getFileSystem(conf).delete(target, True)

    def _at_exit(self) -> None:
        if self.spark.sparkContext._jsc is not None and not self.spark.sparkContext._jsc.sc().isStopped():
            self._delete(self.root)
