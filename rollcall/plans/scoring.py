"""From the star schema to scored bills: labels, point-in-time features, models, scores and their backtest."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify as c
from ..functions.actions import outcomes, stage_number, stage_progress
from ..functions.dates import calendar_features
from ..operators import ml
from ..operators.metrics import confidence_bucket, confusion, slip_summary
from ..operators.ranking import history_rate
from ..operators.relational import fill_with_flags, top_n


def labels(bills: DataFrame, actions: DataFrame, as_of: str, mature_days: int = 120) -> DataFrame:
    """advanced (past committee), law, and is_mature (introduced at least mature_days before as_of)."""
    o = outcomes(actions, "bill_id", "date", "ord", "action_text")
    rows = bills.select("bill_id", "introduction_date").join(o, "bill_id", "left")
    age = F.datediff(F.lit(as_of).cast("date"), "introduction_date")
    return rows.select(
        "bill_id", (F.coalesce(stage_number(F.col("highest_stage")), F.lit(0)) >= 2).cast("int").alias("advanced"), (F.coalesce("lifecycle", F.lit("OPEN")) == "PASSED").cast("int").alias("law"),
        F.coalesce(age >= mature_days, F.lit(False)).alias("is_mature"), "current_stage", "highest_stage", "lifecycle", "has_veto",
    )


#: Columns that are known on the day a bill is introduced.
INTRINSIC = ["sponsor_count", "month", "day_of_year", "lame_duck", "is_senate", "filed_before", "rate_before"]
LATER = ["slips", "pro_ratio", "opp_ratio", "written_ratio", "actions", "days_idle"]


def features(bills: DataFrame, actions: DataFrame, slips: DataFrame, outcome: DataFrame, as_of: str) -> DataFrame:
    """One row per bill with INTRINSIC and LATER columns; facts after as_of don't count. Ratios without slips are -1 and
    flagged; a sponsor's record holds its earlier mature bills only."""
    day = F.lit(as_of).cast("date")
    cal = calendar_features(F.col("introduction_date"))
    base = bills.select("bill_id", "primary_sponsor_id", "introduction_date", "sponsor_count", cal["month"].alias("month"), cal["day_of_year"].alias("day_of_year"), cal["lame_duck"].cast("int").alias("lame_duck"), (F.col("chamber_origin") == "S").cast("int").alias("is_senate"))
    base = base.join(outcome.select("bill_id", "advanced", "is_mature"), "bill_id", "left")
    base = history_rate(base, ["primary_sponsor_id"], ["introduction_date", "bill_id"], F.coalesce("is_mature", F.lit(False)), F.col("advanced") == 1)
    a = actions.where(F.col("date") <= day).groupBy("bill_id").agg(F.count(F.lit(1)).alias("actions"), F.datediff(day, F.max("date")).alias("days_idle"))
    s = slips.where(F.col("hearing_date") <= day).select("bill_id", "position", F.col("testimony_type").alias("testimony"), F.col("organization_clean").alias("organization"))
    s = slip_summary(s, ["bill_id"])
    s = s.select("bill_id", "slips", *((F.col(k) / F.greatest("slips", F.lit(1))).alias(n) for k, n in (("proponents", "pro_ratio"), ("opponents", "opp_ratio"), ("written", "written_ratio"))))
    rows = base.join(a, "bill_id", "left").join(s, "bill_id", "left")
    return fill_with_flags(rows, {"slips": 0, "pro_ratio": -1.0, "opp_ratio": -1.0, "written_ratio": -1.0, "actions": 0, "days_idle": -1, "month": 0, "day_of_year": 0, "lame_duck": 0, "sponsor_count": 0}).drop("introduction_date")


def probability(rows: DataFrame, label: str, columns: list[str], name: str, model=None) -> DataFrame:
    """(bill_id, name): the model's probability, fitted on mature bills, calibrated on their out-of-fold scores."""
    data = ml.assemble(rows.withColumn(label, F.col(label).cast("double")), columns)
    known = data.where("is_mature")
    model = model or ml.models(label)["logistic"]
    if known.select(label).distinct().count() < 2:
        return rows.select("bill_id", F.lit(0.0).alias(name))
    map_ = ml.calibrate(ml.out_of_fold(known, label, "bill_id", model, 3), label)
    scored = model.fit(known).transform(data).select("bill_id", vector_to_array("probability")[1].alias("p"))
    return map_.transform(scored.withColumn("features", array_to_vector(F.array("p")))).select("bill_id", F.least(F.greatest("prediction", F.lit(0.0)), F.lit(1.0)).alias(name))


def score_bills(bills: DataFrame, actions: DataFrame, slips: DataFrame, as_of: str) -> DataFrame:
    """Every bill with its probabilities, forecast (intrinsic columns only), stage, stuck status and destination."""
    outcome = labels(bills, actions, as_of)
    rows = features(bills, actions, slips, outcome, as_of).join(outcome.select("bill_id", "law"), "bill_id")
    p = probability(rows, "advanced", INTRINSIC + LATER, "prob_advance").join(probability(rows, "law", INTRINSIC + LATER, "prob_law"), "bill_id").join(probability(rows, "advanced", INTRINSIC, "forecast"), "bill_id")
    day = F.lit(as_of).cast("date")
    out = outcome.join(p, "bill_id").join(rows.select("bill_id", "days_idle"), "bill_id").join(bills.select("bill_id", "introduction_date"), "bill_id")
    stage, vetoed = F.coalesce("current_stage", F.lit("FILED")), F.coalesce("has_veto", F.lit(False))
    life = F.coalesce("lifecycle", F.lit("OPEN"))
    final = F.when(life == "PASSED", 1.0).when(life == "VETOED", 0.0)
    stuck = c.stuck_status(vetoed, F.datediff(day, "introduction_date"), F.col("days_idle"))
    return out.select(
        "bill_id", F.coalesce(final, F.col("prob_advance")).alias("prob_advance"), F.coalesce(final, F.col("prob_law")).alias("prob_law"), "forecast", c.forecast_confidence(F.col("forecast")).alias("forecast_confidence"),
        stage.alias("stage"), stage_progress(stage, vetoed).alias("progress"), stuck.alias("stuck_status"), c.stuck_reason(stuck, F.col("days_idle")).alias("stuck_reason"), c.predicted_destination(life, stage, F.col("prob_law"), F.col("prob_advance")).alias("destination"), "advanced", "law", "is_mature",
    )


def backtest(snapshot: DataFrame, now: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(figures, figures by confidence, largest misses) of an older snapshot's prob_advance against labels known now."""
    rows = snapshot.select("bill_id", "prob_advance").join(now.select("bill_id", "advanced"), "bill_id").withColumn("predicted", (F.col("prob_advance") >= 0.5).cast("int"))
    sure = F.greatest(F.col("prob_advance"), 1 - F.col("prob_advance"))
    rows = rows.withColumn("bucket", confidence_bucket(sure))
    misses = rows.where("predicted <> advanced").orderBy(F.desc(F.abs(F.col("prob_advance") - F.col("advanced"))), "bill_id").limit(10)
    return confusion(rows, "advanced", "predicted"), confusion(rows, "advanced", "predicted", ["bucket"]), misses


def principal(df: DataFrame, key: str, vector: str, k: int = 8) -> DataFrame:
    """The first k components of the centred vectors."""
    data = df.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    model = PCA(k=k, inputCol="v", outputCol="p").fit(data)
    return model.transform(data).select(key, vector_to_array("p").alias("components"))


def diagnostics(frames: dict[str, DataFrame], wanted: dict[str, list[str]]) -> DataFrame:
    """Per table its number of rows and the wanted columns that it lacks."""
    out = None
    for name, df in frames.items():
        missing = [x for x in wanted.get(name, []) if x not in df.columns]
        row = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows", F.lit(", ".join(missing)).alias("missing"))
        out = row if out is None else out.unionByName(row)
    return out


def summary(scored: DataFrame) -> DataFrame:
    """Bills by stuck status and their mean probability."""
    return scored.groupBy("stuck_status").agg(F.count(F.lit(1)).alias("bills"), F.avg("prob_advance").alias("mean_prob"))


def watch_list(scored: DataFrame, n: tuple[int, int, int] = (3, 2, 2)) -> DataFrame:
    """Open bills to watch: likely laws, stuck bills that could move, new bills; each bill once, under its first heading."""
    groups = (("likely law", F.col("prob_law") >= 0.5, F.desc("prob_law")), ("could move", F.col("stuck_status").isin("SLOW", "STAGNANT"), F.desc("prob_advance")), ("new", F.col("stuck_status") == "NEW", F.desc("forecast")))
    out = None
    for i, ((name, condition, order), k) in enumerate(zip(groups, n, strict=True)):
        part = scored.where((F.col("progress") >= 0) & (F.col("progress") < 1) & condition).orderBy(order, "bill_id").limit(k).select("bill_id", F.lit(i).alias("ord"), F.lit(name).alias("heading"))
        out = part if out is None else out.unionByName(part)
    return top_n(out, ["bill_id"], [F.col("ord")], 1)


def gold_sample(scored: DataFrame, n: int = 200, seed: int = 0) -> DataFrame:
    """n bills of each label for people to check, by hash."""
    from ..operators.relational import hash_sample

    return hash_sample(scored, "bill_id", n, seed, "advanced")
