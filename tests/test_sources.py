"""Readers, writers, parsers and small operators that no query binds, on small exact cases."""

import datetime
import json
import time

import pytest
from pyspark.sql import functions as F

from rollcall.functions import classify, text
from rollcall.operators import ml, ranking, relational, resolve
from rollcall.sources import parsers, readers, sinks
from rollcall.streaming import upsert


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


def test_last_runs_of_a_log(spark, tmp_path):
    runs = [{"task": t, "started": f"2024-01-0{d} 00:00:00", "total_s": float(d), "status": "ok", "phases": [{"name": "load", "seconds": d * 1.0}, {"name": "save", "seconds": 0.5}]} for d, t in ((1, "a"), (2, "b"), (3, "a"), (4, "a"))]
    (tmp_path / "runs.jsonl").write_text("\n".join(map(json.dumps, runs)))
    log = readers.run_log(spark, f"{tmp_path}/runs.jsonl", 2, "a")
    assert [r["total_s"] for r in log.collect()] == [4.0, 3.0]
    assert readers.run_log(spark, f"{tmp_path}/runs.jsonl", 9).count() == 4
    assert [(r["phase"], r["seconds"], r["runs"]) for r in readers.phase_means(log, 1).collect()] == [("load", 3.5, 2)]


def test_age_of_files(spark, tmp_path):
    (tmp_path / "x.json").write_text("{}")
    later = time.strftime("%Y-%m-%d %H:%M:%S", time.gmtime(time.time() + 3 * 86400))
    row = readers.older_than(spark, f"{tmp_path}/x.json", 2, later).first()
    assert row["stale"] and 2.9 < row["age_days"] < 3.1
    assert not readers.older_than(spark, f"{tmp_path}/x.json", 4, later).first()["stale"]


def test_refresh_state_and_what_to_fetch(spark):
    bills = spark.createDataFrame([("HB0009",), ("HB0120",), ("SB0007",)], "bill_number string")
    assert {(r["kind"], r["highest"], r["taken"]) for r in readers.refresh_state(bills, "2024-05-01 06:00:00").collect()} == {(k, n, datetime.datetime(2024, 5, 1, 6)) for k, n in (("HB", 120), ("SB", 7))}
    index = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    known = spark.createDataFrame([("a", "2024-04-30"), ("b", "2023-01-01"), ("gone", None)], "id string, day string")
    assert {r["id"] for r in upsert.to_fetch(index, known, "id", "day", "2024-05-01").collect()} == {"a", "c"}


def test_rows_as_json(spark, tmp_path):
    df = spark.createDataFrame([("b", 2), ("a", None)], "k string, v int")
    assert {r["record"] for r in readers.as_json(df).collect()} == {'{"k":"b","v":2}', '{"k":"a"}'}
    sinks.sorted_json(df, "k", f"{tmp_path}/sorted")
    (part,) = (tmp_path / "sorted").glob("part-*")
    assert [json.loads(x)["k"] for x in part.read_text().splitlines()] == ["a", "b"]


def test_logs_grow(spark, tmp_path):
    df = spark.createDataFrame([(1, "x, y")], "n int, note string")
    for _ in range(2):
        sinks.append_csv(df, f"{tmp_path}/csv")
        sinks.append_json(df, f"{tmp_path}/json")
    assert [tuple(r) for r in spark.read.option("header", True).csv(f"{tmp_path}/csv").collect()] == [("1", "x, y")] * 2
    assert spark.read.json(f"{tmp_path}/json").count() == 2


def test_bill_note(spark):
    df = spark.createDataFrame([("HB0001", "passed", None, "Mary Jones"), ("S/B:2", "stuck", "Roads", None)], "bill_number string, status string, description string, sponsor string")
    got = {r["path"]: r["body"] for r in sinks.bill_note(df).collect()}
    assert got["HB0001.md"] == "---\ntype: bill\nstatus: passed\n---\n# HB0001\n\nSponsor: [[Mary Jones]]"
    assert set(got) == {"HB0001.md", "SB2.md"} and "Roads" in got["SB2.md"]


def test_narrative_leaves_out_what_is_unknown(spark):
    assert one(spark, sinks.narrative({"Bills": F.col("a"), "Laws": F.col("b")}), a="3", b=None) == "Bills 3."


def test_saved_model_predicts_the_same(spark, tmp_path):
    from pyspark.ml.classification import LogisticRegressionModel

    rows = ml.assemble(spark.createDataFrame([(i, float(i > 5), float(i)) for i in range(12)], "id long, label double, x double"), ["x"])
    model = ml.models("label")["logistic"].fit(rows)
    sinks.save_model(model, f"{tmp_path}/model")
    again = LogisticRegressionModel.load(f"{tmp_path}/model")
    assert again.coefficients == model.coefficients and again.intercept == model.intercept


def test_bill_page(spark):
    html = "<html><style>HB 9</style><b>HB 0042</b> Synopsis As Introduced <p>Amends the&nbsp;Code.</p> Last Action <td>Do Pass</td> Actions <a>x</a></html>"
    pages = spark.createDataFrame([(1, html), (2, "<p>nothing</p>"), (3, None)], "id int, html string")
    got = {r["id"]: tuple(r)[1:] for r in parsers.bill_page(pages, "id", "html").collect()}
    assert got == {1: ("HB 0042", "Amends the Code.", "Do Pass"), 2: ("", "", ""), 3: (None, None, None)}


@pytest.mark.parametrize("number, parent, want", [("HB1", "HB9", "HB9"), ("HB1", "", "HB1"), ("HB1", None, "HB1")])
def test_parent_number(spark, number, parent, want):
    assert one(spark, parsers.parent_number(F.col("n"), F.col("p")), n=number, p=parent) == want


def test_clean_pdf_text(spark):
    raw = "Page 3\n 1 “An Act” — concerning\n12  roads.\n- 4 -\n\n\n\nSection 5."
    assert one(spark, text.clean_pdf_text(F.col("t")), t=raw) == '"An Act" - concerning\nroads.\n\nSection 5.'


def test_progress_bar(spark):
    bars = spark.createDataFrame([(0.0,), (0.34,), (1.0,), (2.0,), (-1.0,)], "x double").select(text.progress_bar(F.col("x"), 5).alias("b")).collect()
    assert [r["b"] for r in bars] == ["░" * 5, "█" * 2 + "░" * 3, "█" * 5, "█" * 5, "░" * 5]


@pytest.mark.parametrize(
    "rule, yes, no",
    [
        (classify.missed_committee_deadline, "Rule 19(a) / Re-referred to Rules Committee", "Rule 19(b) / Re-referred"),
        (classify.missed_floor_deadline, " rule 19(b) / Re-referred", "Rule 3-9(a) / Re-referred"),
        (classify.is_tabled, "Motion to Table Amendment", "Placed on Calendar"),
        (classify.on_consent_calendar, "Placed on Consent Calendar", "Third Reading"),
    ],
)
def test_rule_predicates(spark, rule, yes, no):
    assert one(spark, rule(F.col("a")), a=yes) is True and one(spark, rule(F.col("a")), a=no) is False


def test_windows_of_recent_runs(spark):
    runs = spark.range(1, 8).toDF("n")
    assert {r["n"]: r["window"] for r in ranking.windows_of(runs, ["n"], 2).collect()} == {7: "recent", 6: "recent", 5: "baseline", 4: "baseline"}


@pytest.mark.parametrize("at, want", [(0.5, 3.0), (0.9, 5.0), (0.2, 1.0), (0.21, 2.0)])
def test_nearest_rank(spark, at, want):
    assert ranking.nearest_rank(spark.createDataFrame([(float(x),) for x in (5, 1, 4, 2, 3)], "x double"), "x", at).first()["value"] == want


def test_with_members(spark):
    rows = spark.createDataFrame([("g", 2, "b"), ("g", 1, "a"), ("h", 3, None)], "g string, k int, v string")
    got = {r["g"]: [tuple(x) for x in r["all"]] for r in relational.with_members(rows, ["g"], "k", F.col("v"), "all").collect()}
    assert got == {"g": [(1, "a"), (2, "b")], "h": [(3, None)]}


def test_resolution_stats(spark):
    names = [("exact", 1), ("fuzzy", 2), ("unresolved", None), ("unresolved", None), ("non_member", None)]
    found = spark.createDataFrame(names, "method string, member_id int")
    assert tuple(resolve.resolution_stats(found).first()) == (5, 2, 0.5)
    assert tuple(resolve.resolution_stats(found.where("false")).first()) == (0, 0, 0.0)


def test_fit_quality(spark):
    p = spark.createDataFrame([(1.0, 0.5), (2.0, -0.5), (3.0, 0.0)], "actual double, residual double")
    assert tuple(ml.fit_quality(p).first()) == pytest.approx((0.75, 1 / 3))


def test_best_share_is_that_of_the_labels(spark):
    """The ten highest of a hundred scores are labelled: a flagged share of 0.10 fits best."""
    scored = spark.range(100).selectExpr("id", "cast(id as double) score")
    gold = spark.range(100).selectExpr("id", "cast(id >= 90 as int) label")
    assert ml.best_share(scored, gold, "id") == 0.10


def test_windowed_counts_of_a_stream(spark, tmp_path):
    rows = [("2024-01-01 10:05:00", "a"), ("2024-01-01 10:55:00", "a"), ("2024-01-01 11:00:00", "a"), ("2024-01-01 10:30:00", "b")]
    spark.createDataFrame(rows, "t string, k string").selectExpr("cast(t as timestamp) t", "k").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("t timestamp, k string").parquet(f"{tmp_path}/in")
    q = upsert.windowed_counts(stream, "t", ["k"]).writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {(r["start"].hour, r["k"], r["n"]) for r in spark.table("counts").collect()}
    assert got == {(10, "a", 2), (11, "a", 1), (10, "b", 1)}


def test_counts_of_words_in_few_but_not_most_rows(spark):
    rows = spark.createDataFrame([(["law", "rare"] if i == 0 else ["law", "tax"] if i < 4 else ["law"],) for i in range(10)], "w array<string>")
    assert ml.count_vectors(rows, "w", 10, 3, 0.8).vocabulary == ["tax"]


def test_all_parts_of_a_rules_glossary(spark, tmp_path):
    import json

    whole = {
        "_meta": {"v": 1},
        "stages": {"FILED": {"progress_fraction": 0.1, "next_stages": ["IN_COMMITTEE"]}, "SIGNED": {"progress_fraction": 1.0, "next_stages": []}},
        "committees": {"procedural": [{"name": "assignments", "formal_name": "Committee on Assignments", "chamber": "senate", "aliases": ["assignments"]}], "house_standing": {"rule": "Rule 1", "committees": ["Energy", "Labor"]}},
        "actions": {"deadline": {"senate_rule": "Rule 2", "description": "Late.", "outcome_signal": "negative_weak", "types": {"a": 1}}},
        "outcomes": {"favorable_report": {"patterns": ["do pass", "be adopted"], "signal": "positive", "is_terminal": False}, "lost": {"is_terminal": True}},
        "vote_thresholds": {"simple": {"description": "half"}, "elected": {"senate_votes_required": 30, "senate_total_members": 59, "house_votes_required": 60, "house_total_members": 118}},
    }
    path = tmp_path / "rules.json"
    path.write_text(json.dumps(whole, indent=1))
    facts = readers.rule_facts(spark, str(path))
    assert {r["part"] for r in facts.select("part").distinct().collect()} == set(readers.RULE_PARTS) - {"deadlines"}
    assert {tuple(r) for r in readers.rule_table(facts, "stages", progress_fraction="double", next_stages="array<string>").select("name", "progress_fraction", F.concat_ws(",", "next_stages")).collect()} == {("FILED", 0.1, "IN_COMMITTEE"), ("SIGNED", 1.0, "")}
    assert [tuple(r) for r in readers.rule_table(facts, "actions", senate_rule="string", house_rule="string", outcome_signal="string").collect()] == [("deadline", "Rule 2", None, "negative_weak")]
    got = {r["name"]: (r["patterns"], r["is_terminal"]) for r in readers.rule_table(facts, "outcomes", patterns="array<string>", is_terminal="boolean").collect()}
    assert got == {"favorable_report": (["do pass", "be adopted"], False), "lost": (None, True)}
    assert {tuple(r) for r in readers.rule_votes(facts).collect()} == {("elected", "senate", 30, 59), ("elected", "house", 60, 118)}
    assert {(r["name"], r["chamber"]) for r in readers.rule_committees(facts).collect()} == {("assignments", "senate"), ("Energy", "house"), ("Labor", "house")}
    assert readers.rule_table(facts, "deadlines", rule="string").count() == 0
