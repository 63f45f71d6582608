"""Intermediate tables in the folder that driver and executors share.

A written table cuts the lineage, so that a lost executor costs only the tasks
it ran, and lets a costly pass over the texts be read again instead of done
again.  The folder is the session's checkpoint folder; a private one is made
only where the session names none and runs on one machine, as in tests.  What an
operator's result still reads is deleted when the session ends.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="orrery-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


class Scratch:
    """Parquet tables under one fresh subfolder of the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: list[tuple[str, object]] = []
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._path = path
        self._files = path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._files.mkdirs(path(self.root))
        self._files.deleteOnExit(path(self.root))

    def keep(self, frame: DataFrame, name: str) -> DataFrame:
        """Write ``frame`` and return it as read from the written table."""
        path = f"{self.root}/{len(self.paths)}-{name}"
        self.paths.append((name, self._path(path)))
        frame.write.parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self, *names: str, but_last: bool = False) -> None:
        """Delete the tables called ``names`` (but for the last one); nothing may read them afterwards."""
        for name in names:
            own = [path for n, path in self.paths if n == name]
            for path in own[:-1] if but_last else own:
                self._files.delete(path, True)
