import pytest
from pyspark.sql import functions as F

from rollcall.operators import asof, graph, metrics, ml, ranking, relational, resolve, search, votes
from rollcall.plans import star
from rollcall.sources import parsers, readers, sinks
from rollcall.streaming import upsert

MEMBERS = [("5001", "Alice Smith", "House", "Democrat"), ("5002", "Bob Jones", "House", "Republican"), ("5003", "Carol Davis", "House", "Democrat"), ("5004", "Empty Earl", "House", "Republican"), ("5005", "Res Rita", "Senate", "Democrat")]
BILLS = [("1", "HB0100", "EDUCATION", "Public Act 104-0001"), ("2", "SB0200", "HEALTH", "Signed by Governor"), ("3", "HB0300", "ROADS", "Referred to Assignments"), ("4", "HR0010", "HONOR", "Resolution Adopted"), ("5", "SJR0001", "HONOR", "Resolution Adopted"), ("6", "SR0020", "HONOR", "Resolution Adopted")]
SPONSORS = [("1", "5001", "PRIMARY"), ("2", "5001", "PRIMARY"), ("3", "5001", "PRIMARY"), ("4", "5001", "PRIMARY"), ("5", "5001", "PRIMARY"), ("6", "5005", "PRIMARY"), ("1", "5002", "CO"), ("1", "5003", "CO"), ("2", "5003", "CO")]


@pytest.fixture(scope="module")
def frames(spark):
    return (
        spark.createDataFrame(MEMBERS, "member_id string, name string, chamber string, party string"),
        spark.createDataFrame(BILLS, "bill_id string, bill_number string, description string, last_action string"),
        spark.createDataFrame(SPONSORS, "bill_id string, member_id string, role string"),
    )


def test_scorecards(frames):
    got = {r["member_id"]: r for r in metrics.scorecards(*frames).collect()}
    alice = got["5001"]
    assert (alice["laws"], alice["laws_passed"], alice["resolutions"]) == (3, 2, 2)
    assert alice["law_rate"] == pytest.approx(2 / 3) and alice["magnet"] == pytest.approx(1.0) and alice["bridge"] == pytest.approx(1 / 3)
    assert got["5004"]["bills"] == 0 and got["5004"]["success_rate"] == 0.0
    assert got["5005"]["laws"] == 0 and got["5005"]["resolutions_passed"] == 1


def test_pages(spark):
    df = spark.range(10).toDF("id")
    take = lambda o, n: [r[0] for r in relational.page(df, [F.col("id")], o, n).collect()]
    assert take(0, 0) == list(range(10)) and take(0, 3) == [0, 1, 2] and take(8, 5) == [8, 9] and take(20, 5) == []
    info = relational.page_info(df, 8, 2).first()
    assert (info["total"], info["has_next"], info["has_previous"]) == (10, False, True)


def test_numbers_over_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    got = relational.numbered(df, [F.col("v")], "pos").collect()
    assert all(r["pos"] == r["v"] for r in got)
    assert relational.every_nth(df, [F.col("v")], 10).count() == 100


@pytest.mark.parametrize("parts", [2, 4, 8, 211])
def test_numbers_and_sums_with_further_columns(spark, parts):
    """More rows than a range sample holds, and columns beside the order, so that the branches read different columns."""
    n = 20_000
    df = spark.range(n).select((F.col("id") * 7919 % n).alias("v"), F.lit("x").alias("other"), (F.col("id") % 7).alias("k"))
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = relational.numbered(df, [F.desc("v")], "pos").where(F.col("pos") != n - 1 - F.col("v"))
        assert got.count() == 0
        want = [0] * n
        for i in range(n):
            want[i * 7919 % n] = i % 7
        for i in range(1, n):
            want[i] += want[i - 1]
        sums = relational.running_total(df, [F.col("v")], F.col("k"), "upto").collect()
        assert len(sums) == n and all(r["upto"] == want[r["v"]] for r in sums)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long, v double")
    assert relational.every_nth(none, [F.col("id")], 3).count() == 0
    assert ranking.positions(none, "v", "id", {"r": []}).count() == 0
    assert ranking.average_rank_percentile(none, "v", "p").count() == 0


def test_percentile_of_ties(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 2.0), (4, 3.0)], "id long, v double")
    got = {r["id"]: r["p"] for r in ranking.average_rank_percentile(df, "v", "p").collect()}
    assert got == {1: 0, 2: 50, 3: 50, 4: 100}


def test_threshold_place(spark, frames):
    vol = spark.createDataFrame([("1", 5), ("2", 3), ("3", 1)], "bill_id string, volume long")
    got = {r["bill_id"]: r["threshold"] for r in metrics.advancement(frames[1], vol).collect()}
    assert got == {"1": 1, "2": 1, "3": 1}
    got = {r["bill_id"]: r["passed"] for r in metrics.advancement(frames[1], vol, top_fraction=True).collect()}
    assert got == {"1": True}


def test_betweenness_and_degree(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "n string")
    star_ = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "d")], "a string, b string")
    got = {r["n"]: r["betweenness"] for r in graph.betweenness(nodes, star_, "n").collect()}
    assert got == {"a": 1.0, "b": 0.0, "c": 0.0, "d": 0.0}
    deg = {r["n"]: r["centrality"] for r in graph.degree_centrality(nodes, star_, "n").collect()}
    assert deg["a"] == 1.0 and deg["b"] == pytest.approx(1 / 3)
    assert {r["n"]: r["betweenness"] for r in graph.betweenness(nodes, star_, "n", most_edges=2).collect()} == got
    assert graph.betweenness_by_levels(nodes.limit(2), star_, "n").agg({"betweenness": "sum"}).first()[0] == 0


def test_betweenness_by_levels(spark):
    """By joins and batches as by sources; a sample keeps to its bound."""
    import numpy as np

    rng = np.random.default_rng(5)
    n = 40
    pairs = sorted({(int(min(p)), int(max(p))) for p in rng.integers(0, n - 2, (70, 2))})  # loops and unlinked nodes among them
    edges = spark.createDataFrame(pairs, "a long, b long")
    nodes = spark.range(n).toDF("n")
    loopless = edges.where("a <> b")
    exact = {r["n"]: r["betweenness"] for r in graph.betweenness(nodes, loopless, "n").collect()}
    assert {r["n"]: r["betweenness"] for r in graph.betweenness_by_levels(nodes, edges, "n", batch=25).collect()} == pytest.approx(exact, abs=2e-6)
    assert graph.sources_needed(n, 0.3, 0.9) == 38 and graph.sources_needed(10**6, 0.02, 0.95) == 21_881
    near = {r["n"]: r["betweenness"] for r in graph.betweenness_by_levels(nodes, edges, "n", error=0.35, confidence=0.9).collect()}
    assert max(abs(near[v] - exact[v]) for v in exact) <= 0.35


def test_blend(spark):
    ag = spark.createDataFrame([("a", "b", 0.9)], "a string, b string, weight double")
    sp = spark.createDataFrame([("a", "b", 10), ("c", "d", 5), ("e", "f", 1)], "a string, b string, weight long")
    got = {(r["a"], r["b"]): r["weight"] for r in graph.blend(ag, sp).collect()}
    assert got == {("a", "b"): 1.0, ("c", "d"): pytest.approx(0.6)}


def test_pivotality_tie_is_won_by_yes(spark):
    rows = spark.createDataFrame([(1, "floor", "2025-01-01", m, v) for m, v in (("a", "Y"), ("b", "Y"), ("c", "N"), ("d", "N"))], "event_id long, vote_type string, date string, member_id string, vote string")
    got = {r["member_id"]: (r["winning"], r["losing"], r["swing"]) for r in votes.pivotality(rows).collect()}
    assert got == {"a": (1, 0, 1), "b": (1, 0, 1), "c": (0, 1, 1), "d": (0, 1, 1)}


def test_timeline(spark):
    rows = [("b", 1, "2025-01-01", "committee", "x", "Y"), ("b", 1, "2025-01-01", "committee", "y", "N"), ("b", 2, "2025-01-01", "floor", "x", "N"), ("b", 2, "2025-01-01", "floor", "z", "Y"), ("b", 3, "2025-02-01", "floor", "z", "Y")]
    df = spark.createDataFrame(rows, "bill string, event_id long, date string, vote_type string, member_id string, vote string")
    got = {r["member_id"]: r for r in votes.timeline(df, ["bill"]).collect()}
    assert got["x"]["codes"] == "Y N --" and got["x"]["flipped"] and got["x"]["dropped"]
    assert got["z"]["newcomer"] and got["z"]["steady_yes"] and not got["y"]["flipped"] and got["y"]["steady_no"]


def test_name_resolution(spark):
    m = spark.createDataFrame([("1", "Laura M. Murphy", "S"), ("2", "Napoleon Harris III", "S"), ("3", "Sara Feigenholtz", "S"), ("4", "Mary Harris", "S"), ("5", "Laura Murphy", "H")], "member_id string, name string, chamber string")
    names = ["Murphy, Laura M.", "Murphy,Laura", "Harris III, N", "Feigenholtz", "Y Feigenholtz", "Harris", "Fiegenholtz, Sara", "Mr. President", "Zebra"]
    n = spark.createDataFrame([("S", x) for x in names], "chamber string, name string")
    got = {r["name"]: (r["member_id"], r["method"]) for r in resolve.resolve(n, m, threshold=80.0).collect()}
    assert got["Murphy, Laura M."] == ("1", "exact") and got["Murphy,Laura"] == ("1", "exact") and got["Harris III, N"] == ("2", "exact")
    assert got["Feigenholtz"] == ("3", "exact") and got["Y Feigenholtz"] == ("3", "stripped") and got["Harris"][1] != "exact"
    assert got["Mr. President"] == (None, "non_member") and got["Zebra"] == (None, "unresolved")


def test_seats(spark):
    m = spark.createDataFrame([("1", "Doris Turner"), ("2", "Sally Turner"), ("3", "Suzy Glowiak Hilton"), ("4", "Don Harmon")], "member_id string, name string")
    s = spark.createDataFrame([("a", 0, "D. Turner"), ("a", 1, "VACANT"), ("a", 2, "GLOWIAK HILTON"), ("a", 3, "Harmon"), ("a", 4, "Turner")], "section string, idx int, seat string")
    got = resolve.match_seats(s, m)
    assert {r["seat"]: r["member_id"] for r in got.collect()} == {"D. Turner": "1", "VACANT": None, "GLOWIAK HILTON": "3", "Harmon": "4", "Turner": None}
    assert ("3", "4") in {(r[0], r[1]) for r in resolve.seatmates(got).collect()}


def test_search_order(spark):
    m = spark.createDataFrame([("9", "Ann Lee", "lee fan"), ("8", "Lee", None), ("7", "Leeds", None)], "member_id string, name string, bio string")
    got = [(r["id"], r["field"], r["score"]) for r in search.search_all("lee", {"member": (m, "member_id", search.MEMBER)}).collect()]
    assert got == [("8", "name", 0.95), ("7", "name", 0.80), ("9", "name", 0.60)]
    assert search.search_all("  ", {"member": (m, "member_id", search.MEMBER)}).count() == 0


def test_panel_ignores_later_facts(spark):
    e = spark.createDataFrame([("b", "2025-01-01")], "bill string, start string")
    f = spark.createDataFrame([("b", "2025-01-10", "x"), ("b", "2025-03-01", "law")], "bill string, day string, kind string")
    got = asof.panel(e, f, "bill", "start", "day", (30, 90), "2025-07-01", 90, law=asof.after(F.col("kind") == "law"), facts=asof.known(F.lit(True)))
    assert {r["snapshot_day"]: (r["law"], r["facts"]) for r in got.collect()} == {30: (1, 1), 90: (0, 2)}
    young = asof.panel(e, f, "bill", "start", "day", (30, 90), "2025-04-15", 90, law=asof.after(F.lit(True)))
    assert young.count() == 0
    none = asof.panel(e, f.limit(0), "bill", "start", "day", (30,), "2025-07-01", 90, law=asof.after(F.lit(True))).first()
    assert none["law"] == 0


def test_upsert_and_flags(spark):
    old = spark.createDataFrame([(1, "a", "slips"), (2, "b", None)], "id long, v string, slips string")
    new = spark.createDataFrame([(2, "B", None), (3, "c", None)], "id long, v string, slips string")
    got = {r["id"]: (r["v"], r["slips"]) for r in relational.merge(old, new, "id", ["slips"]).collect()}
    assert got == {1: ("a", "slips"), 2: ("B", None), 3: ("c", None)}
    filled = {r["id"]: (r["slips"], r["slips_missing"]) for r in relational.fill_with_flags(old, {"slips": ""}).collect()}
    assert filled == {1: ("slips", 0), 2: ("", 1)}


def test_stream_upsert(spark, tmp_path):
    land, table = str(tmp_path / "land"), str(tmp_path / "table")
    schema = "id long, v string, slips string, at long"
    for rows in ([(1, "a", "s", 1), (1, "b", "s", 2)], [(1, "c", None, 3), (2, "x", None, 3)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(land)
        q = upsert.upsert_stream(spark.readStream.schema(schema).parquet(land), table, "id", ["slips"], "at", str(tmp_path / "cp"))
        q.awaitTermination()
    got = {r["id"]: (r["v"], r["slips"]) for r in upsert.current(spark, table).collect()}
    assert got == {1: ("c", "s"), 2: ("x", None)}


def test_readers(spark, tmp_path):
    (tmp_path / "bills.json").write_text('{"7": {"bill_number": "HB1", "sponsor_ids": ["1", "2"], "action_history": [{"date": "1/2/2025", "chamber": "House", "action": "Filed with Clerk"}]}}')
    b = readers.bills(spark, str(tmp_path / "bills.json"))
    assert b.first()["leg_id"] == "7"
    (tmp_path / "slips.txt").write_text("Legislation|Name|Firm|Representation|Position|Committee|ScheduledDateTime\nHB1075| Paul |AES|x|Proponent|Executive|2025-05-31 17:00\nbad|line\n")
    assert [(r["name"], r["position"]) for r in readers.slip_export(spark, str(tmp_path / "slips.txt")).collect()] == [("Paul", "Proponent")]
    (tmp_path / "seats.json").write_text('{"chamber": "S", "rings": [{"ring_number": 1, "sections": [{"label": "A", "seats": ["x", "y"]}]}]}')
    assert [(r["idx"], r["seat"]) for r in readers.seating(spark, str(tmp_path / "seats.json")).orderBy("idx").collect()] == [(0, "x"), (1, "y")]
    (tmp_path / "t.csv").write_text("2025,dev,1,2,3,0.1,0.2,0.3,0.4,2.0\n2025,dev,1,2,3,4,0.1,,0.3,0.4,0.5,2.0\nbad\n")
    got = readers.timings(spark, str(tmp_path / "t.csv")).orderBy("slips").collect()
    assert [round(r["overhead_s"], 6) for r in got] == [1.0, 0.7]
    (tmp_path / "gold.json").write_text('{"_note": "x", "a": "1", "b": {"label": "0"}}')
    assert {(r["key"], r["label"]) for r in readers.gold_labels(spark, str(tmp_path / "gold.json")).collect()} == {("a", "1"), ("b", "0")}
    with pytest.raises(ValueError):
        readers.census(spark, str(tmp_path / "slips.txt"), "Z", "G", "L")


def test_star(spark):
    m = spark.createDataFrame([], readers.MEMBER)
    row = ("HB0001", "7", "EDUCATION", "House", "Filed", "1/2/2025", "Smith", "syn", "u", ["5"], ["6"], [("1/2/2025", "House", "Filed with Clerk")], [("HB0001", "May 1, 2025", "3rd", "House", ["a", "b"], ["c"], None, ["d"], "p", "floor")], [("Al", "Org", "x", "Proponent", "Exec", "2025-05-31", "Oral", "HB0001")], None)
    b = spark.createDataFrame([row], readers.BILL)
    got = star.star(m, b, b.select(F.explode("vote_events").alias("v")).select("v.*"))
    assert got["dim_bills"].first()["bill_type"] == "HB" and got["dim_bills"].first()["sponsor_count"] == 2
    assert got["fact_vote_events"].count() == 1 and got["fact_vote_events"].first()["outcome"] == "passed"
    assert {(r["raw_voter_name"], r["vote_cast"]) for r in got["fact_vote_casts_raw"].collect()} == {("a", "Y"), ("b", "Y"), ("c", "N"), ("d", "NV")}
    assert got["fact_bill_actions"].first()["action_category"] == "filing" and got["fact_witness_slips"].count() == 1


def test_parsers(spark):
    df = spark.createDataFrame([("Y Smith, J  N Jones\nE Brown  NV Green\n 001 YEAS 001 NAYS",)], "t string")
    r = parsers.roll_call(df, "t").first()
    assert (r["yea_votes"], r["nay_votes"], sorted(r["nv_votes"]), r["printed_yeas"]) == (["Smith, J"], ["Jones"], ["Brown", "Green"], 1)
    v = parsers.validate(spark.createDataFrame([("a", "")], "id string, name string"), ("id",), ("name",)).first()
    assert v["warnings"] == ["missing recommended name"]
    html = spark.createDataFrame([(1, "<table><tr><td>A&amp;B</td><td> c </td></tr></table><a href='/x?witnessslip&LegDocId=5'>")], "id int, html string")
    assert parsers.table_rows(html, "id", "html").first()["cells"] == ["A&B", "c"]
    assert [r["doc_id"] for r in parsers.document_ids(html, "id", "html").collect()] == ["5"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("1", "A/B: C", "S", "D", 3, 1)], "member_id string, name string, chamber string, party string, bills long, passed long")
    note = sinks.member_note(df).first()
    assert note["path"] == "AB C.md" and "| Bills | 3 |" in note["body"]
    for k in range(3):
        sinks.snapshot(df, str(tmp_path / "s"), f"2025-01-0{k + 1}")
    snaps = spark.read.parquet(str(tmp_path / "s"))
    assert {str(r[0]) for r in sinks.expired(snaps, 2).collect()} == {"2025-01-01"}
    assert sinks.latest(snaps).count() == 1


def test_ridge_matches_refits(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(12, 2)), rng.normal(size=12)
    df = spark.createDataFrame([(i, float(x[i, 0]), float(x[i, 1]), float(y[i])) for i in range(12)], "id long, a double, b double, y double")
    got = {r["id"]: r["prediction"] for r in ml.ridge_leave_one_out(df, "id", ["a", "b"], "y").collect()}
    for i in range(12):
        k = np.arange(12) != i
        z = np.column_stack([np.ones(11), x[k]])
        beta = np.linalg.solve(z.T @ z + np.diag([0, 1, 1]), z.T @ y[k])
        assert got[i] == pytest.approx(float(np.r_[1, x[i]] @ beta), abs=1e-8)


def test_isolation_finds_the_outlier(spark):
    rows = [(i, float(i % 7), float(i % 5)) for i in range(200)] + [(999, 60.0, 60.0)]
    got = ml.isolation_scores(spark.createDataFrame(rows, "id long, a double, b double"), "id", ["a", "b"], trees=30).orderBy(F.desc("score")).first()
    assert got["id"] == 999
