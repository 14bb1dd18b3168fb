from pyspark.sql import functions as F

from rollcall.plans import scoring, star, views
from rollcall.sources import readers, sinks


def raw(spark):
    rows = []
    for i in range(60):
        acts = [("1/2/2025", "Senate", "Filed with Secretary"), ("1/20/2025", "Senate", "Assigned to Judiciary")]
        if i % 2:
            acts.append(("2/20/2025", "Senate", "Do Pass Judiciary; 010-000-000"))
        if i % 6 == 1:
            acts.append(("5/30/2025", "Senate", "Public Act . . . 104-0001"))
        if i % 20 == 0:
            acts.append(("6/30/2025", "Senate", "Total Veto Stands"))
        slips = [("A", f"Org {j}", "x", "Proponent" if i % 2 else "Opponent", "Exec", "2025-02-01", "Oral", f"SB{i:04d}") for j in range(i % 4)]
        rows.append((f"SB{i:04d}", str(i), "EDUCATION", "Senate", acts[-1][2], acts[-1][0], "S", "syn", "u", [str(i % 5)], ["9"] * (i % 3), acts, None, slips, None))
    return spark.createDataFrame(rows, readers.BILL)


def test_bills_are_scored(spark):
    t = star.star(spark.createDataFrame([], readers.MEMBER), raw(spark))
    b, a, s = t["dim_bills"], t["fact_bill_actions"], t["fact_witness_slips"]
    lab = {r["bill_id"]: r for r in scoring.labels(b, a, "2025-09-01").collect()}
    assert lab["1"]["law"] == 1 and lab["1"]["advanced"] == 1 and lab["2"]["advanced"] == 0 and lab["0"]["lifecycle"] == "VETOED" and lab["1"]["is_mature"]
    out = scoring.score_bills(b, a, s, "2025-09-01")
    got = {r["bill_id"]: r for r in out.collect()}
    assert len(got) == 60 and got["1"]["destination"] == "Became Law" and got["0"]["stuck_status"] == "DEAD" and got["2"]["stuck_status"] == "STAGNANT"
    assert got["3"]["prob_advance"] > 0.5 > got["2"]["prob_advance"]
    figures, _, misses = scoring.backtest(out, out)
    assert figures.first()["n"] == 60 and misses.count() <= 10
    assert scoring.summary(out).agg(F.sum("bills")).first()[0] == 60
    assert scoring.watch_list(out).count() <= 7 and scoring.gold_sample(out, 5).count() == 10
    early = scoring.features(b, a, s, scoring.labels(b, a, "2025-01-25"), "2025-01-25")
    assert early.agg(F.max("slips"), F.max("actions")).first() == (0, 2)


def test_views_of_names(spark):
    df = spark.createDataFrame([(0, "X", 5, 3, 2), (1, "X", 5, 3, 2), (2, "Y", 1, 1, 0)], "coalition_id long, name string, members long, dems long, reps long")
    from rollcall.functions.classify import unique_names

    got = [r["name"] for r in unique_names(df, "name", "members", "dems", "reps", "coalition_id").orderBy("coalition_id").collect()]
    assert got == ["X — 5 members (3D/2R) #1", "X — 5 members (3D/2R) #2", "Y"]
    n = spark.createDataFrame([("HB0007",), ("HB8",), ("HB9",)], "number string")
    b = spark.createDataFrame([("HB0007", "seven"), ("HB0008", "eight")], "bill_number string, description string")
    from rollcall.functions.text import compact_number

    got = {r["number"]: r["description"] for r in views.describe_bill(n, b, compact_number(F.col("number")), compact_number(F.col("bill_number"))).collect()}
    assert got == {"HB0007": "seven", "HB8": "eight", "HB9": None}


def test_zip_and_ally(spark):
    mates = spark.createDataFrame([("1", "2"), ("1", "3")], "member_id string, other_id string")
    prof = spark.createDataFrame([("2", 0.1), ("3", 0.9)], "member_id string, bridge double")
    assert views.allies(mates, prof).first()["ally_id"] == "3"
    assert views.allies(mates, prof, spark.createDataFrame([("2",)], "member_id string")).first()["ally_id"] == "2"
    found = spark.createDataFrame([("60601", "1", "8")], "zip string, senator string, representative string")
    broker = spark.createDataFrame([("3",)], "member_id string")
    r = views.zip_search(found, broker, views.allies(mates, prof)).first()
    assert r["broker_is_ally"] and r["ally"] is None
    for rows, shown in (([("9",), ("5",)], "5"), ([], None)):
        some = views.zip_search(found, spark.createDataFrame(rows, "member_id string"), views.allies(mates, prof)).collect()
        assert [(r["broker"], r["ally"], r["broker_is_ally"]) for r in some] == [(shown, "3", False)]


def test_small_sources(spark, tmp_path):
    (tmp_path / "rules.json").write_text('{"stages": {"FILED": {"progress_fraction": 0.1, "next_stages": ["IN_COMMITTEE"]}}}')
    assert readers.rules(spark, str(tmp_path / "rules.json")).first()["next_stages"] == ["IN_COMMITTEE"]
    (tmp_path / "c.json").write_text('[{"code": "A", "name": "x", "roster": [{"member_id": "1", "member_name": "n", "role": "Chair"}], "bill_numbers": ["HB1", "HB2"]}]')
    com = readers.committees(spark, str(tmp_path / "c.json"))
    assert readers.rosters(com).first()["role"] == "Chair" and readers.committee_bills(com).count() == 2
    sinks.save_views(spark, {"three": "select 3 as n"})
    assert spark.sql("select n from three").first()[0] == 3
    d = scoring.diagnostics({"t": com}, {"t": ["code", "missing"]}).first()
    assert (d["rows"], d["missing"]) == (1, "missing")
    v = spark.createDataFrame([(i, [float(i), float(-i), 1.0]) for i in range(5)], "id long, v array<double>")
    assert len(scoring.principal(v, "id", "v", 2).first()["components"]) == 2
    assert sinks.vectors_long(sinks.vectors_wide(v, "id", "v", 3), "id").first()["vector"] == [0.0, 0.0, 1.0]
