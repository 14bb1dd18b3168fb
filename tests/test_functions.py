import datetime as dt

import pytest
from pyspark.sql import functions as F

from rollcall.functions import actions, classify, dates, text


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'long'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("action", "status", "depth"),
    [
        ("Rule 3-9(a) / Re-referred to Assignments", "stuck", 1),
        ("Referred to Assignments", "stuck", 1),
        ("Public Act 104-0001", "passed", 6),
        ("Signed by Governor", "passed", 6),
        ("Resolution Adopted", "passed", 5),
        ("Governor Vetoed; Total Veto Stands", "vetoed", 0),
        ("Do Pass / Short Debate Judiciary", "in_progress", 2),
        ("Third Reading - Passed; 060-050-001", "in_progress", 4),
        ("Placed on Calendar Order of 2nd Reading", "in_progress", 3),
        ("", "in_progress", 0),
    ],
)
def test_status_and_depth(spark, action, status, depth):
    assert one(spark, classify.bill_status(F.col("a")), a=action) == status
    assert one(spark, classify.pipeline_depth(F.col("a")), a=action) == depth


@pytest.mark.parametrize(("number", "law"), [("HB0100", True), ("sb1", True), ("HR0010", False), ("SJR1", False), ("HJR2", False), ("AM3", False)])
def test_substantive(spark, number, law):
    assert one(spark, classify.is_substantive(F.col("a")), a=number) is law


@pytest.mark.parametrize(("text_", "shell"), [("LOCAL GOVERNMENT-TECH", True), ("Technical change", True), ("SHELL BILL", True), ("EDUCATION", False), (None, False)])
def test_shell(spark, text_, shell):
    assert one(spark, classify.is_shell(F.col("a")), a=text_) is shell


@pytest.mark.parametrize(("role", "leads", "weight"), [("President of the Senate", True, 1.0), ("Majority Whip", True, 0.25), ("Chairperson", False, 0.5), ("Republican Caucus Chair", True, 0.25), ("Senator", False, 0.0), ("", False, 0.0)])
def test_roles(spark, role, leads, weight):
    assert one(spark, classify.is_leadership(F.col("a")), a=role) is leads
    assert one(spark, classify.institutional_weight(F.array().cast("array<string>"), F.col("a")), a=role) == weight


@pytest.mark.parametrize(("raw", "compact", "padded"), [("HB0100", "HB100", "HB0100"), ("sb79", "SB79", "SB0079"), ("SB228 (SCA1)", "SB228", "SB0228"), ("HB12345", "HB12345", "HB12345"), ("x", "X", "X")])
def test_numbers(spark, raw, compact, padded):
    assert one(spark, text.compact_number(F.col("a")), a=raw) == compact
    assert one(spark, text.padded_number(F.col("a")), a=raw) == padded


@pytest.mark.parametrize("raw", ["5/31/2025", "May 31, 2025", "2025-05-31 17:00", "2025-05-31"])
def test_dates(spark, raw):
    assert one(spark, dates.parse_date(F.col("a")), a=raw) == dt.date(2025, 5, 31)


def test_dates_that_are_none(spark):
    assert one(spark, dates.parse_date(F.col("a")), a="soon") is None
    assert one(spark, dates.iso_or_same(F.col("a")), a="soon") == "soon"
    assert one(spark, dates.iso_or_same(F.col("a")), a=None) == ""
    assert one(spark, dates.date_or_last(F.col("a")), a="soon") == dt.date(9999, 12, 31)


@pytest.mark.parametrize(("raw", "code"), [("Senate", "S"), ("h", "H"), (" joint ", "J"), ("Other ", "Other")])
def test_chamber(spark, raw, code):
    assert one(spark, dates.chamber_code(F.col("a")), a=raw) == code


def test_snippet(spark):
    long = "x" * 100 + "Needle" + "y" * 100
    got = one(spark, text.snippet(F.col("a"), "needle"), a=long)
    assert got == "..." + "x" * 80 + "Needle" + "y" * 80 + "..."
    assert one(spark, text.snippet(F.col("a"), "needle"), a="a needle") == "a needle"


def test_names(spark):
    p = one(spark, text.member_name_parts(F.col("a")), a="Laura M. Murphy, Jr.")
    assert (p["first"], p["last"], p["suffix"]) == ("Laura M.", "Murphy", "Jr.")
    assert one(spark, text.name_key(F.col("a")), a=" Murphy,  Laura M. ") == "murphy, laura m"
    assert one(spark, text.similarity(F.col("a"), F.col("b")), a="Jones Mary", b="mary jones") == 100.0


@pytest.mark.parametrize(
    ("action", "category", "stage", "bill"),
    [
        ("Assigned toTransportation", "assignment", "IN_COMMITTEE", True),
        ("ToElections", "assignment", "IN_COMMITTEE", True),
        ("Total Veto Stands", "veto", None, True),
        ("House Committee Amendment No. 1 Tabled", "amendment", None, False),
        ("Third Reading - Passed; 058-000-000", "floor_vote", "CHAMBER_PASSED", True),
        ("Recommends Be Adopted State Government", "committee_action", "PASSED_COMMITTEE", True),
        ("Rule 2-10 Committee Deadline", "deadline", None, True),
        ("Placed on Calendar Order of 3rd Reading", "floor_process", "FLOOR_VOTE", True),
        ("", "other", None, True),
        (None, "other", None, True),
        ("Nothing known", "other", None, True),
    ],
)
def test_actions(spark, action, category, stage, bill):
    got = one(spark, actions.classify_action(F.col("a")), a=action)
    assert (got["category"], got["stage"], got["bill_action"]) == (category, stage, bill)


def test_rollback(spark):
    texts = ["Filed with Secretary", "Assigned to Judiciary", "Do Pass", "Third Reading - Passed; 100-000-000", "Arrive in Senate", "Passed Both Houses", "Rule 19(b) / Re-referred to Rules Committee"]
    rows = spark.createDataFrame([(1, i, i, t) for i, t in enumerate(texts)], "bill long, day int, ord int, action string")
    got = actions.outcomes(rows, "bill", "day", "ord", "action").first()
    assert (got["highest_stage"], got["current_stage"], got["lifecycle"]) == ("PASSED_BOTH", "IN_COMMITTEE", "OPEN")


def test_stuck_status(spark):
    f = lambda v, a, b: one(spark, classify.stuck_status(F.col("v") == 1, F.col("a"), F.col("b")), v=v, a=a, b=b)
    assert [f(1, 10, 0), f(0, 10, 0), f(0, 300, 200), f(0, 300, 70), f(0, 300, 5)] == ["DEAD", "NEW", "STAGNANT", "SLOW", "PENDING"]


def test_organizations(spark):
    f = lambda a: one(spark, classify.canonical_organization(F.col("a")), a=a)
    assert [f("N/A"), f(None), f("Self"), f("aes  clean energy")] == ["No organization", "No organization", "Individual", "aes  clean energy"]


def test_every_kind_of_action(spark):
    from rollcall.plans.catalog_functions import ACTION_TEXTS

    rows = spark.createDataFrame([(i, x[0]) for i, x in enumerate(ACTION_TEXTS)], "i int, a string")
    got = {r["i"]: (r["c"]["category"], r["c"]["signal"], r["c"]["stage"]) for r in rows.select("i", actions.classify_action(F.col("a")).alias("c")).collect()}
    assert {i: (ACTION_TEXTS[i][0], *x) for i, x in got.items()} == dict(enumerate(ACTION_TEXTS))


def test_a_lost_vote_is_no_passage(spark):
    history = ["Filed with the Clerk", "Assigned to Judiciary", "Do Pass Judiciary; 007-000-000", "Second Reading", "Third Reading - Lost; 020-035-000"]
    rows = spark.createDataFrame([(1, "2024-01-01", i, t) for i, t in enumerate(history)] + [(2, "2024-01-01", 0, "Do Not Pass Judiciary"), (2, "2024-01-02", 1, "Governor Amendatory Veto")], "b long, day string, ord int, a string")
    got = {r["bill_id"]: r for r in actions.outcomes(rows, "b", "day", "ord", "a").collect()}
    assert (got[1]["highest_stage"], got[1]["lifecycle"], got[1]["positive_signals"], got[1]["negative_signals"]) == ("FLOOR_VOTE", "OPEN", 3, 1)
    assert (got[2]["highest_stage"], got[2]["has_veto"], got[2]["negative_signals"]) == ("IN_COMMITTEE", False, 2)


def folded(texts, kinds):
    """The fold action by action: kinds give each text's signal and stage."""
    order = actions.STAGE_ORDER
    high = now = pos = neg = 0
    signed = veto = override = False
    terminal = None
    for t in texts:
        _, signal, stage, bill = kinds[t]
        if not bill:
            continue
        at = order.index(stage) if stage else -1
        low = (t or "").lower().strip()
        back = low.startswith(("rule 19(a)", "rule 19(b)", "rule 3-9(a)", "rule 3-9(b)")) or "re-referred to rules" in low or "re-referred to assignments" in low
        if back and 5 <= now <= 7:
            now = 1
        high, now = max(high, at), max(now, at)
        pos, neg = pos + signal.startswith("positive"), neg + signal.startswith("negative")
        signed, veto = signed or signal == "positive_terminal", veto or signal == "negative_terminal"
        override = override or "override" in low or "veto stands" in low
        terminal = t if signal.endswith("_terminal") else terminal
    return order[high], order[now], "PASSED" if signed else "VETOED" if veto else "OPEN", pos, neg, veto, override, terminal


def test_random_histories_fold_like_single_steps(spark):
    """Histories of up to sixty actions, steps back among them, and one of four thousand."""
    import random

    from rollcall.plans.catalog_functions import ACTION_TEXTS

    rng = random.Random(2)
    texts = [x[0] for x in ACTION_TEXTS if x[0] is not None]
    kinds = {r["a"]: (r["c"]["category"], r["c"]["signal"], r["c"]["stage"], r["c"]["bill_action"]) for r in spark.createDataFrame([(t,) for t in texts], "a string").select("a", actions.classify_action(F.col("a")).alias("c")).collect()}
    back = "Rule 19(b) / Re-referred to Rules Committee"
    often = ["Arrive in Senate", "Do Pass Licensed Activities; 007-000-000", "Second Reading - Short Debate", back, "Passed Both Houses", "Sent to the Governor"]
    histories = [[rng.choice(rng.choice([texts, often])) for _ in range(rng.randint(1, 60))] for _ in range(150)] + [[rng.choice(often[:5]) for _ in range(4000)]]
    rows = [(b, f"2024-01-{1 + i * 27 // len(h):02d}", i, t) for b, h in enumerate(histories) for i, t in enumerate(h)]
    got = actions.outcomes(spark.createDataFrame(rows, "b int, day string, ord int, a string"), "b", "day", "ord", "a").collect()
    want = {b: folded(h, kinds) for b, h in enumerate(histories) if any(kinds[t][3] for t in h)}
    assert {r["bill_id"]: tuple(r)[1:] for r in got} == want
