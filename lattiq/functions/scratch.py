"""Tables written in the middle of a job.

Long or iterative plans cut their lineage by writing a Parquet table into the folder that all
executors share.  The cluster names that folder in ``spark.checkpoint.dir``; only where the setting
is absent and Spark runs in one process (tests, a laptop) a temporary folder is used.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one only where nothing is set and the master is local."""
    found = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY, None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError(f"{_KEY} must name a folder that all executors of {master} share")
    if not _local:
        made = tempfile.mkdtemp(prefix="lattiq-")
        _local.append(made)
        atexit.register(shutil.rmtree, made, True)
    return "file://" + _local[0]


class Scratch:
    """Names and drops the intermediate tables of one job."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{_home(spark)}/{label}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return the stored table; survives the loss of any executor."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a stored table that no later plan reads."""
        _delete(self.spark, f"{self.root}/{name}")


    def clear(self) -> None:
        """Delete all tables of this job; its result must have been written before."""
        _delete(self.spark, self.root)


def cleanup(spark: SparkSession) -> None:
    """Delete every intermediate table of this application; results must have been written before."""
    _delete(spark, _home(spark))


def _home(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lattiq/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
