"""Lookups, filters, pages, samples, set operations and merges over any DataFrame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import date_or_last, parse_date
from ..sources.scratch import materialize


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys to spark.sql.shuffle.partitions tasks, which adaptive execution then leaves as they are: what a task
    holds in a following aggregate is that share of the rows, not what it makes of 64 MB or of a file's split."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def lookup(df: DataFrame, column: str, value) -> DataFrame:
    """The rows whose column is value; None finds nothing."""
    return df.where(F.col(column) == F.lit(value))


def filters(df: DataFrame, **wanted) -> DataFrame:
    """All given conditions together: equality, or min_/max_ of a column; None is no condition."""
    for name, value in wanted.items():
        if value is None:
            continue
        if name.startswith("min_"):
            df = df.where(F.col(name[4:]) >= value)
        elif name.startswith("max_"):
            df = df.where(F.col(name[4:]) <= value)
        else:
            df = df.where(F.lower(F.col(name)) == value.lower() if isinstance(value, str) else F.col(name) == value)
    return df


def between_dates(df: DataFrame, column: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Both ends count. A row without a date is later than any; an end that is no date is no condition."""
    day = date_or_last(F.col(column)) if dict(df.dtypes)[column] == "string" else F.coalesce(F.col(column).cast("date"), F.lit("9999-12-31").cast("date"))
    for end, side in ((first, 0), (last, 1)):
        if end:
            bound = parse_date(F.lit(end))
            df = df.where(bound.isNull() | (day >= bound if side == 0 else day <= bound))
    return df


def page(df: DataFrame, order: list[Column], offset: int = 0, limit: int = 0) -> DataFrame:
    """A page of a total order; limit 0 is no limit. Spark keeps offset + limit rows per task, not the whole table."""
    df = df.orderBy(*order)
    df = df.offset(offset) if offset else df
    return df.limit(limit) if limit else df


def page_info(df: DataFrame, offset: int, limit: int) -> DataFrame:
    """Total, has_next and has_previous as one row."""
    return df.agg(F.count(F.lit(1)).alias("total")).select("total", (F.lit(limit > 0) & (F.lit(offset + limit) < F.col("total"))).alias("has_next"), F.lit(offset > 0).alias("has_previous"))


def every_nth(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """Rows 0, n, 2n, … of a total order: a systematic sample. Positions come from range partitions and their counts, so
    no task holds the table."""
    return numbered(df, order, "__pos").where(F.col("__pos") % n == 0).drop("__pos")


def _ranged(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df dealt by ranges of order and sorted, with its range (__part) and place in it (__at), written once: whatever reads
    it sees the same ranges, which Spark would otherwise draw anew from a sample for each branch of a plan."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return materialize(ranged.withColumns({"__part": F.spark_partition_id(), "__at": at}), name)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with its positions (from 0) in a total order, without a single sorting task.

    Rows are dealt by ranges and written; each range numbers its own, and the counts of those before it (a row per range)
    are added. df is computed once, when this is called.
    """
    local = _ranged(df, order, "numbered")
    counts = local.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    return local.join(F.broadcast(before), "__part").withColumn(name, F.col("__at") + F.col("__before")).drop("__part", "__at", "__before")


def running_total(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """df with the sum of value over all rows up to each one in a total order, without a single task over the table: sums
    run within ranges that are written once, and the totals of the ranges before (a row each) are added."""
    ranged = _ranged(df.withColumn("__v", value), order, "running-total")
    local = ranged.withColumn("__local", F.sum("__v").over(Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)))
    totals = ranged.groupBy("__part").agg(F.sum("__v").alias("__t"))
    before = totals.select("__part", (F.sum("__t").over(Window.orderBy("__part")) - F.col("__t")).alias("__before"))
    return local.join(F.broadcast(before), "__part").withColumn(name, F.col("__local") + F.coalesce("__before", F.lit(0))).drop("__v", "__part", "__at", "__local", "__before")


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 0, strata: str | None = None) -> DataFrame:
    """n rows without replacement, the same ones on any layout; with strata n rows of each of its values."""
    order = [F.xxhash64(F.col(key), F.lit(seed)), F.col(key)]
    if strata is None:
        return df.orderBy(*order).limit(n)
    return top_n(df, [strata], order, n)


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first n rows of each group. Spark's group limit drops rows before the shuffle."""
    name = rank or "__rank"
    df = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)
    return df if rank else df.drop(name)


def latest_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_n(df, keys, order, 1)


def by_key(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """The rows whose column is among keys (a semi-join), for batches of lookups."""
    return df.join(keys, column, "left_semi")


def new_rows(df: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not known yet (an anti-join)."""
    return df.join(known.select(*keys), keys, "left_anti")


def merge(old: DataFrame, new: DataFrame, key: str, owned: list[str]) -> DataFrame:
    """An upsert: new rows win, but columns in owned keep what old holds where new has nothing."""
    columns = [c for c in new.columns if c != key]
    o, n = old.alias("o"), new.alias("n")
    out = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    cells = []
    for c in columns:
        mine, theirs = F.col(f"n.{c}"), F.col(f"o.{c}")
        cells.append((F.coalesce(theirs, mine) if c in owned else F.when(F.col(f"n.{key}").isNotNull(), mine).otherwise(theirs)).alias(c))
    return out.select(F.coalesce(f"n.{key}", f"o.{key}").alias(key), *cells)


def relaxed_union(*frames: DataFrame) -> DataFrame:
    """Columns by name; missing ones are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def fill_with_flags(df: DataFrame, fills: dict[str, object]) -> DataFrame:
    """Fills nulls and records where they were; the flags are taken before anything is filled."""
    df = df.withColumns({f"{c}_missing": F.col(c).isNull().cast("int") for c in fills})
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fills.items()})


def hydrate(arrays: DataFrame, ids: str, dimension: DataFrame, key: str) -> DataFrame:
    """A row per element of an array of ids that the dimension knows, with its position."""
    exploded = arrays.select("*", F.posexplode(ids).alias("ord", "__id")).drop(ids)
    return exploded.join(dimension, exploded["__id"] == dimension[key], "inner").drop("__id")


def sponsorships(bills: DataFrame, bill_id: str, senate: str, house: str) -> DataFrame:
    """(bill, member, ord, role): the first of both lists together is the chief sponsor."""
    both = F.concat(F.coalesce(senate, F.array().cast("array<string>")), F.coalesce(house, F.array().cast("array<string>")))
    rows = bills.select(F.col(bill_id).alias("bill_id"), F.posexplode(both).alias("ord", "member_id"))
    return rows.withColumn("role", F.when(F.col("ord") == 0, "PRIMARY").otherwise("CO"))


def with_members(rows: DataFrame, by: list[str], key: str, value: Column, name: str) -> DataFrame:
    """One row per group with an ordered list of structs."""
    return rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(key), value.alias("value")))).alias(name))


def kind_priority(number: Column) -> Column:
    """SB and HB first, AM last, others between, unknown before it."""
    kind = F.upper(F.regexp_extract(number, "^([A-Za-z]+)", 1))
    order = F.array(*(F.lit(x) for x in ("SB", "HB", "SR", "HR", "SJR", "HJR")))
    at = F.array_position(order, kind)
    return F.when(kind == "AM", 99).when(at > 0, at - 1).otherwise(50).cast("int")


def is_stalled(actions: Column, prefixes: tuple[str, ...] = ("Referred to Assignments", "Rule 3-9", "Rule 19", "Filed with", "First Reading")) -> Column:
    """No actions, or only such as begin with one of the prefixes."""
    wanted = F.array(*(F.lit(p) for p in prefixes))
    return F.coalesce(F.size(actions) <= 0, F.lit(True)) | F.forall(actions, lambda a: F.exists(wanted, lambda p: F.startswith(a, p)))
