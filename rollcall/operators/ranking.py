"""Ranks, running histories, percentiles and changes: window functions with a full order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import group_quantiles, keyed_before
from .relational import numbered, running_total


def positions(df: DataFrame, score: str, key: str, groups: dict[str, list[str]]) -> DataFrame:
    """Unique places from 1 by falling score, ties by key; groups names a column for each partitioning. A place over the
    whole table is counted from range partitions, not in one task."""
    order = [F.col(score).desc_nulls_last(), F.col(key).asc()]
    for name, keys in groups.items():
        if keys:
            df = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        else:
            df = numbered(df, order, name).withColumn(name, (F.col(name) + 1).cast("int"))
    return df


def running_before(df: DataFrame, keys: list[str], order: list[str], **sums: Column) -> DataFrame:
    """Sums over a group's rows before the current one, null (no history) as 0. Groups may be of any size."""
    return keyed_before(df, keys, order, sums)


def history_rate(df: DataFrame, keys: list[str], order: list[str], usable: Column, won: Column, empty: float = -1.0) -> DataFrame:
    """Earlier usable rows of the group and the share won of them; empty where there are none."""
    df = running_before(df, keys, order, filed_before=F.when(usable, 1).otherwise(0), won_before=F.when(usable & won, 1).otherwise(0))
    return df.withColumn("rate_before", F.when(F.col("filed_before") > 0, F.col("won_before") / F.col("filed_before")).otherwise(F.lit(empty)))


def average_rank_percentile(df: DataFrame, column: str, name: str) -> DataFrame:
    """The percentile (0 to 100, whole) of a value by its average rank among ties, from counts per distinct value that
    are summed over range partitions."""
    per = df.groupBy(column).agg(F.count(F.lit(1)).alias("__n"))
    ranked = running_total(per, [F.col(column)], F.col("__n"), "__upto")
    total = per.agg(F.sum("__n").alias("__total"))
    rank = F.col("__upto") - F.col("__n") + (F.col("__n") + 1) / 2
    ranked = ranked.crossJoin(total).select(column, F.when(F.col("__total") > 1, F.floor((rank - 1) / (F.col("__total") - 1) * 100)).otherwise(0).cast("int").alias(name))
    return df.join(ranked, column)


def changes(df: DataFrame, keys: list[str], order: list[str], column: str, counted: Column) -> DataFrame:
    """Rows whose value differs from the last counted one before them in their group."""
    df = keyed_before(df, keys, order, lasts={"previous": F.when(counted, F.col(column))})
    return df.where(counted & F.col("previous").isNotNull() & (F.col("previous") != F.col(column)))


def neighbours(df: DataFrame, keys: list[str], order: list[str], column: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumns({"left": F.lag(column).over(w), "right": F.lead(column).over(w)})


def time_split(df: DataFrame, order: list[str], share: float = 0.7) -> DataFrame:
    """is_train for the first int(n * share) rows in order."""
    n = df.agg(F.count(F.lit(1)).alias("__n"))
    df = numbered(df, [F.col(o) for o in order], "__pos").crossJoin(F.broadcast(n))
    return df.withColumn("is_train", F.col("__pos") < F.floor(F.col("__n") * F.lit(share))).drop("__pos", "__n")


def entity_split(df: DataFrame, key: str, share: float = 0.7) -> DataFrame:
    """is_train by distinct keys in order: all rows of a key are on one side."""
    keys = time_split(df.select(key).distinct(), [key], share)
    return df.join(keys, key)


def retained(df: DataFrame, stamp: str, keep: int = 20) -> DataFrame:
    """The rows of the newest snapshots."""
    newest = df.select(stamp).distinct().orderBy(F.desc(stamp)).limit(keep)
    return df.join(F.broadcast(newest), stamp, "left_semi")


def windows_of(df: DataFrame, order: list[str], size: int, recent: str = "recent", base: str = "baseline") -> DataFrame:
    """The last size rows and the size rows before them, labelled."""
    last = df.orderBy(*(F.desc(o) for o in order)).limit(2 * size)
    place = F.row_number().over(Window.orderBy(*(F.desc(o) for o in order)))
    return last.withColumn("window", F.when(place <= size, recent).otherwise(base))


def nearest_rank(df: DataFrame, column: str, at: float) -> DataFrame:
    return group_quantiles(df, [], column, {"value": at}, nearest=True)
