"""Where intermediate tables go, so that a lost executor costs no recomputation and no lineage grows."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Folders of the tables stored so far.
_STORED: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a local one, set once, only in local mode where none is named.

    On a cluster executors don't share local folders, so there a session without the setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        local = tempfile.mkdtemp(prefix="granary-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(local)
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def dropped(spark: SparkSession) -> None:
    """Deletes what this application has stored; for when no table built on it is read any more."""
    _delete(spark, _STORED)
    _STORED.clear()


def stored(df: DataFrame) -> DataFrame:
    """The rows, written as Parquet in the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/granary-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STORED.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_alone(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """stored(make()), without the tables that were stored on the way to it; make must not hand out others of those."""
    first = len(_STORED)
    done = stored(make())
    on_the_way = _STORED[first:-1]
    del _STORED[first:-1]
    _delete(spark, on_the_way)
    return done
