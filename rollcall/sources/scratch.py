"""Tables written to the folder that driver and executors share, to cut lineage or to be read more than once."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


_REMOVE: dict[str, Callable[[], None]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a local session (tests) gets a folder of its own; on a cluster
    that is an error, since a folder of the driver's machine is none of the executors'."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='rollcall-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/rollcall/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm

    def remove() -> None:
        try:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM may have gone before us
            pass

    atexit.register(remove)
    _REMOVE[path] = remove
    return path


def discard(*frames: DataFrame) -> None:
    """Removes the tables behind results of materialize; nothing that is still to be computed may read them."""
    for df in frames:
        _REMOVE[df._scratch_path]()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out
