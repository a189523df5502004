"""Tables that are computed once: written to storage that all executors share, read back, and removed when they are done with."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where that is unset and all of Spark runs in this process."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master, app = spark.sparkContext.master, spark.sparkContext.applicationId
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="citeloom-core-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return "file://" + _own[app]


def file_system(spark: SparkSession, path: str):
    """A path and its file system, as the JVM knows them."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


class Kept:
    """Tables of one run below one folder; ``close`` removes them, as does the end of the driver."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, f"{shared_dir(spark)}/citeloom/{uuid.uuid4().hex}"
        self._names = 0

    def __call__(self, df: DataFrame) -> DataFrame:
        """``df``, computed once. A lost executor costs at most the tasks since this table."""
        self._names += 1
        path = f"{self.path}/{self._names}"
        df.write.parquet(path)
        if self._names == 1:
            place, files = file_system(self.spark, self.path)
            files.deleteOnExit(place)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        place, files = file_system(self.spark, self.path)
        files.delete(place, True)
