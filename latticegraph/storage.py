"""Tables written to the folder that driver and executors share, to cut lineage, and their removal."""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_held = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. In local mode an unset one becomes a temporary folder; on a cluster it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="latticegraph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """Cut lineage: write df as Parquet to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if scopes := getattr(_held, "scopes", None):
        scopes[-1].append((spark, path))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release(df: DataFrame) -> None:
    """Delete what written() wrote for df; df must not be read afterwards."""
    if path := getattr(df, "_written_path", None):
        _delete(df.sparkSession, path)


@contextmanager
def scratch():
    """Tables written inside are deleted at the end, but for those given to the function that this yields.

    Those belong to the scope around, if there is one. A DataFrame that leaves the scope may only read kept tables.
    """
    if not hasattr(_held, "scopes"):
        _held.scopes = []
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._written_path)
        return df

    _held.scopes.append([])
    try:
        yield keep
    finally:
        own = _held.scopes.pop()
        for spark, path in own:
            if path not in kept:
                _delete(spark, path)
            elif _held.scopes:
                _held.scopes[-1].append((spark, path))
