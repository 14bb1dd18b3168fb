"""Running values within groups, and quantiles of groups, without a task that holds a group.

Rows are dealt by ranges of (keys, order) and written once, so that a group of any size lies in as many ranges as its rows
fill. Each range works on its own part of a group; what a group brings along from the ranges before is one row per range and
group that crosses a border. Borders are fewer than ranges, so these rows are twice as many as ranges at most, and are
broadcast.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import _ranged


def keyed_before(df: DataFrame, keys: list[str], order: list, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, totals: Iterable[str] = (), mins: dict[str, Column] | None = None) -> DataFrame:
    """df with values over the rows of its group (keys; null is a group, none makes the table one) before each row:

    sums: their sum, 0 where there is nothing; lasts: the last one that isn't null; mins: the least; for the names of sums in totals also
    `<name>_total`, the sum over the whole group. order ought to be total; rows that it leaves tied lie in one range, in any
    order. df is computed once, when this is called.
    """
    sums, lasts, mins, totals = sums or {}, lasts or {}, mins or {}, tuple(totals)
    given = df.columns
    inputs = {f"__v_{n}": v for n, v in {**sums, **lasts, **mins}.items()}
    ranged = _ranged(df.withColumns(inputs), [*map(F.col, keys), *(F.col(o) if isinstance(o, str) else o for o in order)], "keyed")
    here = Window.partitionBy("__part", *keys)
    before = here.orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    local = {n: F.coalesce(F.sum(f"__v_{n}").over(before), F.lit(0)) for n in sums}
    local |= {n: F.last(f"__v_{n}", ignorenulls=True).over(before) for n in lasts}
    local |= {n: F.min(f"__v_{n}").over(before) for n in mins}
    local |= {f"{n}_total": F.coalesce(F.sum(f"__v_{n}").over(here), F.lit(0)) for n in totals}
    per = ranged.groupBy("__part", *keys).agg(
        F.count(F.lit(1)).alias("__n"),
        *(F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums),
        *(F.max_by(f"__v_{n}", F.when(F.col(f"__v_{n}").isNotNull(), F.col("__at"))).alias(f"__t_{n}") for n in lasts),
        *(F.min(f"__v_{n}").alias(f"__t_{n}") for n in mins),
    )
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = {f"__c_{n}": F.coalesce(F.sum(f"__t_{n}").over(earlier), F.lit(0)) for n in sums}
    carried |= {f"__c_{n}": F.last(f"__t_{n}", ignorenulls=True).over(earlier) for n in lasts}
    carried |= {f"__c_{n}": F.min(f"__t_{n}").over(earlier) for n in mins}
    carried |= {f"__c_{n}_total": F.sum(f"__t_{n}").over(group) for n in totals}
    crossing = per.withColumns(carried | {"__ranges": F.count(F.lit(1)).over(group)}).where("__ranges > 1")
    crossing = crossing.select(F.col("__part").alias("__p"), *(F.col(k).alias(f"__k_{k}") for k in keys), *carried)
    rows = ranged.withColumns(local)
    match = F.col("__part") == F.col("__p")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    rows = rows.join(F.broadcast(crossing), match, "left")
    out = {n: F.col(n) + F.coalesce(f"__c_{n}", F.lit(0)) for n in sums}
    out |= {n: F.coalesce(n, f"__c_{n}") for n in lasts}
    out |= {n: F.least(n, f"__c_{n}") for n in mins}
    out |= {f"{n}_total": F.coalesce(f"__c_{n}_total", f"{n}_total") for n in totals}
    return rows.select(*(c for c in given if c not in out), *(v.alias(n) for n, v in out.items()))


def group_quantiles(df: DataFrame, keys: list[str], column: str, at: dict[str, float], nearest: bool = False) -> DataFrame:
    """(keys, a column per name of at): exact quantiles of a column that has an order, nulls left out.

    Between two places the value is interpolated; with nearest it is the first value that at least that share of the rows
    doesn't exceed. Equal values are counted first; the running count within the group says which value a place falls on.
    Groups without a value give no row.
    """
    per = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("__count"))
    placed = keyed_before(per, keys, [column], {"__upto": F.col("__count")}, totals=["__upto"])
    total = F.col("__upto_total")

    def on(place: Column) -> Column:
        return F.max(F.when((F.col("__upto") <= place) & (place < F.col("__upto") + F.col("__count")), F.col(column)))

    cells, found = [], []
    for name, q in at.items():
        if nearest:
            found.append(on(F.greatest(F.ceil(total * F.lit(q) - 1e-9), F.lit(1)) - 1).alias(name))
            cells.append(F.col(name))
            continue
        place = (total - 1) * F.lit(float(q))
        found += [on(F.floor(place)).alias(f"__low_{name}"), on(F.ceil(place)).alias(f"__high_{name}"), F.max(place - F.floor(place)).alias(f"__part_{name}")]
        low, high = F.col(f"__low_{name}").cast("double"), F.col(f"__high_{name}").cast("double")
        part = F.col(f"__part_{name}")
        cells.append(F.when(low == high, low).otherwise((1 - part) * low + part * high).alias(name))
    rows = placed.groupBy(*keys).agg(*found) if keys else placed.agg(*found)
    return rows.select(*keys, *cells)
