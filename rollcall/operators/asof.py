"""Point-in-time panels: what was known at a snapshot, and what came after it."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import keyed_before


def snapshots(entities: DataFrame, key: str, start: str, days: tuple[int, ...]) -> DataFrame:
    """(key, snapshot_day, snapshot_date) for each entity and day after its start."""
    return entities.select(key, F.explode(F.array(*(F.lit(d) for d in days))).alias("snapshot_day"), F.col(start).cast("date").alias("__s")).select(key, "snapshot_day", F.date_add("__s", F.col("snapshot_day")).alias("snapshot_date"))


@dataclass(frozen=True)
class Counted:
    """A figure of the facts around a snapshot, for as_of(): kind is known, after, recent, first or last."""

    kind: str
    condition: Column
    days: int = 0


def known(condition: Column) -> Counted:
    """How many facts up to the snapshot meet the condition."""
    return Counted("known", condition)


def after(condition: Column) -> Counted:
    """1 if a fact later than the snapshot meets the condition, else 0."""
    return Counted("after", condition)


def recent(condition: Column, days: int) -> Counted:
    """How many facts of the `days` days that end with the snapshot meet the condition."""
    return Counted("recent", condition, days)


def first_day() -> Counted:
    return Counted("first", F.lit(True))


def last_day() -> Counted:
    return Counted("last", F.lit(True))


def as_of(snaps: DataFrame, facts: DataFrame, key: str, day: str, /, **figures: Counted) -> DataFrame:
    """Figures of the facts around each snapshot (key, snapshot_day, snapshot_date), kept for snapshots without any.

    Facts are added up by key and day and merged with the snapshots in one order of key and date, in which running sums up
    to each snapshot are taken: what is shuffled are facts and snapshots, not their product, and an entity of any number
    of facts lies in as many ranges as it fills. Facts without a day are none. A snapshot without a date knows nothing, and
    every fact is later.
    """
    f = facts.where(F.col(day).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key), F.col(day).cast("date").alias("__day"))
    f = f.agg(*(F.count_if(x.condition).alias(n) for n, x in figures.items()))
    zero = [F.lit(0).cast("long").alias(n) for n in figures]
    none = F.lit(None).cast("int")
    lines = [f.select(key, F.col("__day").alias("__date"), F.lit(0).alias("__mark"), none.alias("snapshot_day"), F.lit(None).cast("date").alias("snapshot_date"), *figures)]
    spans = sorted({x.days for x in figures.values() if x.kind == "recent"})
    for mark, days in enumerate([0, *spans], 1):  # a snapshot's own mark, and one before each span of days that it asks for
        lines.append(snaps.select(key, F.date_sub("snapshot_date", days).alias("__date"), F.lit(mark).alias("__mark"), F.col("snapshot_day").cast("int"), F.col("snapshot_date").cast("date"), *zero))
    merged = reduce(DataFrame.unionByName, lines)
    fact = F.when(F.col("__mark") == 0, F.col("__date"))
    sums = {n: F.col(n) for n, x in figures.items() if x.kind in ("known", "after", "recent")}
    lasts = {n: fact for n, x in figures.items() if x.kind == "last"}
    mins = {n: fact for n, x in figures.items() if x.kind == "first"}
    rows = keyed_before(merged.drop(*lasts, *mins), [key], ["__date", "__mark", "snapshot_day", "snapshot_date"], sums, lasts, [n for n, x in figures.items() if x.kind == "after"], mins)
    own = F.col("__mark") == 1
    cells = []
    for n, x in figures.items():
        here = F.max(F.when(own, F.col(n)))
        if x.kind == "after":
            here = F.max(F.when(own, (F.col(f"{n}_total") > F.col(n)).cast("int")))
        elif x.kind == "recent":
            here = F.coalesce(here - F.max(F.when(F.col("__mark") == 2 + spans.index(x.days), F.col(n))), F.lit(0))
        cells.append(here.alias(n))
    return rows.where("__mark > 0").groupBy(key, "snapshot_day", "snapshot_date").agg(*cells)


def panel(entities: DataFrame, facts: DataFrame, key: str, start: str, day: str, days: tuple[int, ...], today: str, mature: int, /, **labels: Counted) -> DataFrame:
    """Labels of what happened after each snapshot that is at least mature days old."""
    snaps = snapshots(entities, key, start, days).where(F.datediff(F.lit(today).cast("date"), "snapshot_date") >= mature)
    return as_of(snaps, facts, key, day, **labels)


def staleness(snaps: DataFrame, facts: DataFrame, key: str, day: str) -> DataFrame:
    """Days since the last fact and from the first one, and facts in the last 30 days, as of each snapshot."""
    every = F.lit(True)
    out = as_of(snaps, facts, key, day, last=last_day(), first=first_day(), actions=known(every), recent=recent(every, 30))
    return out.withColumns({"days_idle": F.coalesce(F.datediff("snapshot_date", "last"), F.lit(-1)), "days_active": F.coalesce(F.datediff("last", "first"), F.lit(-1))}).drop("first", "last")


def early_actions(facts: DataFrame, entities: DataFrame, key: str, start: str, day: str, within: int, /, **conditions: Column) -> DataFrame:
    """Counts of facts at most `within` days after the start (facts before it count too)."""
    rows = entities.select(key, F.col(start).cast("date").alias("__s")).join(facts, key, "left")
    near = F.coalesce(F.datediff(F.col(day).cast("date"), "__s") <= within, F.lit(False))
    return rows.groupBy(key).agg(*(F.count_if(near & c).alias(n) for n, c in conditions.items()))
