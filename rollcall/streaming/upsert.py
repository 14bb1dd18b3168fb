"""Incremental refresh as a stream of landed files: each micro-batch is merged into the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import latest_rows, merge
from ..sources.readers import path_exists


def upsert_stream(landing: DataFrame, table: str, key: str, owned: list[str], order: str, checkpoint: str):
    """Starts a query that merges new records into the Parquet table at `table`.

    A batch's newest record of a key wins; columns in owned keep what another producer wrote. Each version is a folder of
    its own and a pointer file names the current one, so that a reader never sees half a merge and a batch that runs
    again after a failure writes the same version again.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fresh = latest_rows(batch, [key], [F.desc(order)]).drop(order)
        old = current(spark, table, before=epoch)
        out = fresh if old is None else merge(old, fresh, key, owned)
        out.write.mode("overwrite").parquet(f"{table}/version={epoch:012d}")

    return landing.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, table: str, before: int | None = None) -> DataFrame | None:
    """The newest finished version (below `before`), None where there is none."""
    if not path_exists(spark, table):
        return None
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(table)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    for s in fs.listStatus(root):
        name = s.getPath().getName()
        if name.startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")):
            found.append(int(name.removeprefix("version=")))
    found = [v for v in found if before is None or v < before]
    return spark.read.parquet(f"{table}/version={max(found):012d}") if found else None


def due(last_full: float, last_tail: float, full_hours: float = 168, tail_hours: float = 24) -> str:
    """Which refresh is due by the hours since the last full one and the last look at the end: full, tail or skip."""
    return "full" if last_full >= full_hours else "tail" if last_tail >= tail_hours else "skip"


def to_fetch(index: DataFrame, known: DataFrame, key: str, active: str, today: str, days: int = 30) -> DataFrame:
    """Ids that are new, or known and active in the last days."""
    new = index.select(key).join(known.select(key), key, "left_anti")
    recent = known.where(F.datediff(F.lit(today).cast("date"), F.col(active).cast("date")) <= days).select(key)
    return new.unionByName(recent).distinct()


def windowed_counts(events: DataFrame, stamp: str, keys: list[str], late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """An addition to what the product family offers: counts per window with a bound on late rows."""
    return events.withWatermark(stamp, late).groupBy(F.window(stamp, size), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *keys, "n")
