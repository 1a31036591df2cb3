"""Shared scratch tables: how a plan cuts its lineage so that a lost executor costs a re-read, not a re-run."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a local master may run without that setting; it then gets a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="kindred-")
    return _LOCAL[app]


def drop(spark: SparkSession, path: str) -> None:
    """Delete a scratch table through Hadoop's file system, wherever it lies."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables that one run writes below the shared folder. ``cut`` writes and rereads; ``drop`` frees what no later step reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/kindred-{name}-{uuid.uuid4().hex[:12]}"
        self.paths: dict[int, str] = {}
        atexit.register(self._forget)

    def cut(self, df: DataFrame, **options: str) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex[:12]}"
        df.write.options(**options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for t in tables:
            if t is not None:
                drop(self.spark, t._scratch_path)

    def _forget(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                drop(self.spark, self.root)
        except Exception:  # the session may be gone at exit; the folder then stays for its owner's clean-up
            pass
