"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .errors import NoSharedFolder


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir.

    Where it is unset and the master is local (tests, one machine) a temporary
    folder is made, set for the session and removed at exit. On a cluster its
    executors would each write to a disk of their own, so there it must be set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise NoSharedFolder("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="foldspark-")
        atexit.register(shutil.rmtree, found, True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and return a reader of it.

    Cuts the lineage: what is read again survives the loss of any executor, and
    several readers don't compute it again. Columns are pruned on reading.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def owning(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """df, which reads these tables and is the last to: ``discard(df)`` deletes them."""
    df._reads = [t for t in tables if t is not df]
    return df


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` gave and that nothing reads any more, and those that a table owns. Others are left alone."""
    for df in tables:
        discard(*getattr(df, "_reads", ()))
        path = getattr(df, "_written_to", None)
        if path is not None:
            jvm = df.sparkSession.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
            df._written_to = None
