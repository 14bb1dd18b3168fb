"""Running values and quantiles over ranges against windows and percentile, at several numbers of ranges."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rollcall.operators import asof, metrics, ranges, ranking


@pytest.fixture(scope="module")
def rows(spark):
    """Half of the rows under one key, some under null, ties in values, nulls in values."""
    rng = random.Random(8)
    key = lambda i: "hot" if i % 2 else rng.choice([None, "a", "b", "c", *map(str, range(30))])
    made = [(key(i), rng.randrange(50), i, rng.choice([None, *range(12)]), rng.choice([None, "x", "y", "z"])) for i in range(3000)]
    return spark.createDataFrame(made, "k string, day int, i int, v int, kind string").repartition(7).cache()


@pytest.fixture(params=[2, 8, 211])
def parts(spark, request):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", old)


def same(a, b, columns):
    get = lambda df: sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect())))
    assert get(a) == get(b)


@pytest.mark.parametrize("keys", [["k"], []])
def test_running_values_equal_windows(rows, parts, keys):
    got = ranges.keyed_before(rows, keys, ["day", "i"], {"s": F.col("v"), "n": F.lit(1)}, {"kind_before": F.col("kind")}, ["s"])
    w = Window.partitionBy(*keys).orderBy("day", "i").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    want = rows.withColumns({"s": F.coalesce(F.sum("v").over(w), F.lit(0)), "n": F.coalesce(F.sum(F.lit(1)).over(w), F.lit(0)), "kind_before": F.last("kind", ignorenulls=True).over(w), "s_total": F.coalesce(F.sum("v").over(whole), F.lit(0))})
    same(got, want, ["i", "s", "n", "kind_before", "s_total"])


def test_no_range_holds_a_hot_key(rows, spark, parts):
    """With 8 ranges none holds twice the mean, though one key has half of the rows."""
    if parts != 8:
        return
    from rollcall.operators.relational import _ranged

    sizes = [r["count"] for r in _ranged(rows, [F.col("k"), F.col("day"), F.col("i")], "t").groupBy("__part").count().collect()]
    assert max(sizes) <= 2 * 3000 / 8


@pytest.mark.parametrize("keys", [["k"], []])
def test_quantiles_equal_percentile(rows, parts, keys):
    at = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p93": 0.93, "p100": 1.0}
    got = ranges.group_quantiles(rows, keys, "v", at)
    want = rows.where("v is not null").groupBy(*keys).agg(*(F.percentile("v", F.lit(q)).alias(n) for n, q in at.items()))
    get = lambda df: sorted((tuple(round(x, 9) if isinstance(x, float) else repr(x) for x in r) for r in df.collect()), key=repr)
    assert get(got) == get(want)
    near = ranges.group_quantiles(rows, keys, "v", at, nearest=True)
    for r in near.collect():
        mine = sorted(x["v"] for x in rows.where(F.col("v").isNotNull() & (F.col("k").eqNullSafe(r["k"]) if keys else F.lit(True))).select("v").collect())
        for n, q in at.items():
            assert r[n] == next(x for x in mine if sum(y <= x for y in mine) >= q * len(mine) - 1e-9)
        if keys and r["k"] not in ("hot", None, "a"):
            break


def test_small_tables(spark, rows):
    assert ranges.keyed_before(rows.limit(0), ["k"], ["i"], {"s": F.col("v")}).count() == 0
    assert ranges.group_quantiles(rows.limit(0), ["k"], "v", {"m": 0.5}).count() == 0
    assert ranges.group_quantiles(rows.limit(0), [], "v", {"m": 0.5}).collect()[0]["m"] is None
    q = metrics.quantiles(spark.createDataFrame([("a", None), (None, 3.0), (None, 5.0)], "k string, v double"), ["k"], "v")
    assert {tuple(r) for r in q.collect()} == {("a", None, None, None, 1), (None, 3.0, 5.0, 4.0, 2)}
    m = metrics.group_median(spark.createDataFrame([("a", 1.0), ("a", 4.0), ("b", None)], "k string, v double"), ["k"], "v", "m", "times")
    assert {(r["k"], r["v"], r["m"], r["times"]) for r in m.collect()} == {("a", 1.0, 2.5, 0.4), ("a", 4.0, 2.5, 1.6), ("b", None, None, None)}


def test_changes_over_ranges(rows, parts):
    counted = F.col("kind").isin("x", "y")
    got = ranking.changes(rows, ["k"], ["day", "i"], "kind", counted)
    w = Window.partitionBy("k").orderBy("day", "i").rowsBetween(Window.unboundedPreceding, -1)
    want = rows.withColumn("previous", F.last(F.when(counted, F.col("kind")), ignorenulls=True).over(w)).where(counted & F.col("previous").isNotNull() & (F.col("previous") != F.col("kind")))
    same(got, want, ["i", "kind", "previous"])


def test_as_of_equals_a_join_of_all(spark, parts):
    """One entity with half of the facts, days on the snapshot itself, entities without facts, facts without a day or entity,
    repeated snapshots, and one without a date."""
    rng = random.Random(6)
    facts = [(0 if i % 2 else rng.choice([1, 2, 3, 4, None]), None if i % 41 == 0 else f"2024-{rng.randint(1, 4):02d}-{rng.randint(1, 28):02d}", rng.choice(["a", "b", None])) for i in range(800)]
    f = spark.createDataFrame(facts, "e int, day string, kind string").select("e", F.col("day").cast("date").alias("day"), "kind")
    starts = spark.createDataFrame([(e, d) for e, d in ((0, "2024-01-15"), (1, "2024-02-01"), (2, "2024-01-01"), (3, None), (9, "2024-01-01"), (None, "2024-01-01"))], "e int, start string")
    snaps = asof.snapshots(starts, "e", "start", (0, 30, 60))
    condition = F.col("kind") == "a"
    got = asof.as_of(snaps.unionByName(snaps.where("e = 1")), f, "e", "day", n=asof.known(F.lit(True)), a=asof.known(condition), later=asof.after(condition), near=asof.recent(condition, 7), wide=asof.recent(F.lit(True), 40), first=asof.first_day(), last=asof.last_day())
    s = [(r["e"], r["snapshot_day"], r["snapshot_date"]) for r in snaps.collect()]
    known = [(r["e"], r["day"], r["kind"]) for r in f.collect() if r["day"] is not None and r["e"] is not None]
    want = set()
    for e, d, at in s:
        mine = [x for x in known if x[0] == e]
        before = [x for x in mine if at is not None and x[1] <= at]
        days = sorted(x[1] for x in before)
        count = lambda keep, span: sum(keep(x) and (at - x[1]).days < span for x in before)  # noqa: B023, E731
        later = any(x[2] == "a" for x in mine if x not in before)
        want.add((e, d, at, len(before), sum(x[2] == "a" for x in before), int(later), count(lambda x: x[2] == "a", 7), count(lambda x: True, 40), days[0] if days else None, days[-1] if days else None))
    assert {tuple(r[c] for c in ("e", "snapshot_day", "snapshot_date", "n", "a", "later", "near", "wide", "first", "last")) for r in got.collect()} == want
    assert got.count() == len(set(s))
