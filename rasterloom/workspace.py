"""Where intermediate tables go.

A table written here cuts the lineage of whatever reads it, so a lost executor
costs a re-read and not a recomputation from the source.  The folder is the one
that the cluster names in ``spark.checkpoint.dir``; only a session without that
setting (tests, a laptop) gets a folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session, made up only where none is set and everything runs on this machine."""
    found = spark.conf.get(_SETTING, None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"{_SETTING} must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="rasterloom-")
        spark.conf.set(_SETTING, found)
    return found.rstrip("/")


class Workspace:
    """A folder for the tables of one operator call."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str, **options) -> DataFrame:
        """Writes ``df`` and returns the DataFrame that reads it back."""
        at = f"{self.path}/{name}"
        df.write.options(**options).parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, name: str = "") -> None:
        """Removes one table, or everything; nothing may read it afterwards."""
        remove(self.spark, f"{self.path}/{name}" if name else self.path)


def _hadoop(spark: SparkSession, path: str):
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(conf), at


def remove(spark: SparkSession, path: str) -> None:
    store, at = _hadoop(spark, path)
    store.delete(at, True)


def finished(spark: SparkSession, path: str) -> list[str]:
    """Names of the tables under a folder whose writing ended well, sorted."""
    store, at = _hadoop(spark, path)
    if not store.exists(at):
        return []
    found = [f.getPath() for f in store.listStatus(at) if f.isDirectory()]
    return sorted(p.getName() for p in found if store.exists(p.suffix("/_SUCCESS")))
