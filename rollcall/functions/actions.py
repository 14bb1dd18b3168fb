"""Action texts as categories, signals and stages, and the ordered fold over a bill's actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranges import keyed_before
from .classify import is_favorable_report, is_re_referral, is_unfavorable_report, starts_any

STAGE_ORDER = ("FILED", "IN_COMMITTEE", "PASSED_COMMITTEE", "FLOOR_VOTE", "CHAMBER_PASSED", "CROSSED_CHAMBERS", "PASSED_BOTH", "GOVERNOR", "SIGNED")
CROSSED = STAGE_ORDER.index("CROSSED_CHAMBERS")

#: (pattern, how it is matched, category, signal, stage), first match wins. startswith, contains and exact ignore case; of a
#: pattern in two parts ("third reading|lost") the text starts with the first and contains the second; subject is "To ..."
#: with a subject other than a veto or total. Report types, referral forms, concurrence options and kinds of veto are those
#: of the chambers' rules; signals and stages of lost votes, unfavourable reports and vetoes are this library's own choice: a
#: lost vote reaches no further stage, an unfavourable report leaves a bill in committee, only a veto that stands ends it.
PATTERNS = (
    ("prefiled", "startswith", "filing", "neutral", "FILED"),
    ("filed with", "startswith", "filing", "neutral", "FILED"),
    ("first reading", "startswith", "filing", "neutral", "FILED"),
    ("added as", "contains", "sponsorship", "positive_weak", None),
    ("chief sponsor changed", "contains", "sponsorship", "neutral", None),
    ("sponsor removed", "contains", "sponsorship", "negative_weak", None),
    ("assignments refers to", "startswith", "assignment", "neutral", "IN_COMMITTEE"),
    ("approved for consideration", "startswith", "assignment", "positive", "IN_COMMITTEE"),
    ("assigned to", "startswith", "assignment", "positive_weak", "IN_COMMITTEE"),
    ("referred to", "startswith", "assignment", "neutral", "IN_COMMITTEE"),
    ("re-assigned to", "startswith", "assignment", "neutral", "IN_COMMITTEE"),
    ("to ", "subject", "assignment", "neutral", "IN_COMMITTEE"),
    ("do not pass", "startswith", "committee_action", "negative", "IN_COMMITTEE"),
    ("be not adopted", "startswith", "committee_action", "negative", "IN_COMMITTEE"),
    ("recommend do not adopt", "startswith", "committee_action", "negative", "IN_COMMITTEE"),
    ("without recommendation", "startswith", "committee_action", "negative_weak", "IN_COMMITTEE"),
    ("motion do pass|lost", "startswith", "committee_action", "negative", "IN_COMMITTEE"),
    ("be adopted", "startswith", "committee_action", "positive", "PASSED_COMMITTEE"),
    ("recommend do adopt", "startswith", "committee_action", "positive", "PASSED_COMMITTEE"),
    ("do pass", "startswith", "committee_action", "positive", "PASSED_COMMITTEE"),
    ("reported out", "startswith", "committee_action", "positive", "PASSED_COMMITTEE"),
    ("postponed", "startswith", "committee_action", "negative_weak", "IN_COMMITTEE"),
    ("rule 19(a)", "startswith", "deadline", "negative", None),
    ("rule 19(b)", "startswith", "deadline", "negative", None),
    ("rule 3-9", "startswith", "deadline", "negative_weak", None),
    ("re-referred", "startswith", "deadline", "negative_weak", None),
    ("placed on calendar order of 2nd reading", "startswith", "floor_process", "positive_weak", "FLOOR_VOTE"),
    ("second reading", "startswith", "floor_process", "positive_weak", "FLOOR_VOTE"),
    ("held on calendar", "startswith", "floor_process", "neutral", "FLOOR_VOTE"),
    ("third reading|lost", "startswith", "floor_vote", "negative", "FLOOR_VOTE"),
    ("third reading|postponed", "startswith", "floor_vote", "negative_weak", "FLOOR_VOTE"),
    ("third reading", "startswith", "floor_vote", "positive", "CHAMBER_PASSED"),
    ("house concurs", "startswith", "concurrence", "positive", "PASSED_BOTH"),
    ("senate concurs", "startswith", "concurrence", "positive", "PASSED_BOTH"),
    ("house non-concurs", "startswith", "concurrence", "negative_weak", None),
    ("senate non-concurs", "startswith", "concurrence", "negative_weak", None),
    ("house recedes", "startswith", "concurrence", "positive", "PASSED_BOTH"),
    ("senate recedes", "startswith", "concurrence", "positive", "PASSED_BOTH"),
    ("house refuses to recede", "startswith", "concurrence", "negative_weak", None),
    ("senate refuses to recede", "startswith", "concurrence", "negative_weak", None),
    ("house requests conference committee", "startswith", "concurrence", "neutral", None),
    ("senate requests conference committee", "startswith", "concurrence", "neutral", None),
    ("conference committee report", "startswith", "concurrence", "neutral", None),
    ("arrive in", "startswith", "cross_chamber", "positive", "CROSSED_CHAMBERS"),
    ("arrived in", "startswith", "cross_chamber", "positive", "CROSSED_CHAMBERS"),
    ("passed both houses", "startswith", "both_passed", "positive", "PASSED_BOTH"),
    ("adopted both houses", "startswith", "both_passed", "positive_terminal", "PASSED_BOTH"),
    ("sent to the governor", "startswith", "governor", "positive", "GOVERNOR"),
    ("governor approved", "startswith", "enacted", "positive_terminal", "SIGNED"),
    ("public act", "startswith", "enacted", "positive_terminal", "SIGNED"),
    ("signed by governor", "startswith", "enacted", "positive_terminal", "SIGNED"),
    ("effective date", "startswith", "enacted", "positive", None),
    ("total veto stands", "contains", "veto", "negative_terminal", None),
    ("bill dead|veto", "startswith", "veto", "negative_terminal", None),
    ("override|lost", "startswith", "veto", "negative", None),
    ("override|passed", "startswith", "veto", "positive", None),
    ("accept amendatory veto|lost", "startswith", "veto", "negative", None),
    ("accept amendatory veto|passed", "startswith", "veto", "positive", None),
    ("governor amendatory veto", "startswith", "veto", "negative", None),
    ("governor item", "startswith", "veto", "negative_weak", None),
    ("governor reduction veto", "startswith", "veto", "negative_weak", None),
    ("item/reduction veto", "startswith", "veto", "negative_weak", None),
    ("item veto", "startswith", "veto", "negative_weak", None),
    ("reduction veto", "startswith", "veto", "negative_weak", None),
    ("governor vetoed", "startswith", "veto", "negative_terminal", None),
    ("resolution adopted", "startswith", "resolution", "positive_terminal", None),
    ("appointment confirmed", "startswith", "appointment", "positive_terminal", None),
    ("motion", "startswith", "motion", "neutral", None),
    ("tabled", "exact", "terminal", "negative", None),
    ("session sine die", "contains", "terminal", "negative", None),
    ("fiscal note", "contains", "note", "neutral", None),
)


def spaced(text: Column) -> Column:
    """Puts blanks back after to, by and from and takes a vote tally off the end."""
    t = F.regexp_replace(text, "(to|by|from)([A-Z])", "$1 $2")
    t = F.regexp_replace(t, "^To([A-Z])", "To $1")
    return F.trim(F.regexp_replace(t, r"[;,]?\s*\d{3}-\d{3}-\d{3}\s*$", ""))


AMENDMENT = r"(?i)^(?:(?:House|Senate)\s+(?:Committee|Floor)\s+Amendment\s+No\.\s+\d+|Conference Committee Report\s+No\.\s+\d+)\s*"


def pattern_table(spark: SparkSession) -> DataFrame:
    """The patterns as a small table with their order."""
    return spark.createDataFrame([(i, *p) for i, p in enumerate(PATTERNS)], "ord int, pattern string, match string, category string, signal string, stage string")


def bound(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _matched(text: Column) -> Column:
    """The first pattern that fits, as a struct; null where none does. The patterns are one literal array, so that the
    expression stays small however many there are."""
    rows = F.array(*(F.struct(F.lit(p.partition("|")[0]).alias("p"), F.lit(p.partition("|")[2]).alias("also"), F.lit(how).alias("how"), F.lit(category).alias("category"), F.lit(signal).alias("signal"), F.lit(stage).cast("string").alias("stage")) for p, how, category, signal, stage in PATTERNS))

    def fits(r: Column, v: Column) -> Column:
        p, low, raw, rest = r["p"], v["low"], v["raw"], v["rest"]
        subject = F.startswith(low, F.lit("to ")) & (rest != "") & ~F.startswith(rest, F.lit("total")) & ~F.startswith(rest, F.lit("the ")) & ~F.contains(rest, F.lit("veto"))
        return (
            F.when(r["how"] == "exact", (low == p) | (raw == p))
            .when(r["how"] == "contains", F.contains(low, p) | F.contains(raw, p))
            .when(r["how"] == "subject", subject)
            .otherwise((F.startswith(low, p) | F.startswith(raw, p)) & F.contains(low, r["also"]))
        )

    low = F.lower(spaced(text))
    forms = F.struct(low.alias("low"), F.lower(text).alias("raw"), F.trim(F.substring(low, 4, 1000)).alias("rest"))
    return bound(forms, lambda v: F.get(F.filter(rows, lambda r: fits(r, v)), F.lit(0)))


def classify_action(text: Column) -> Column:
    """A struct of category, signal, stage and bill_action (false for an amendment's own actions)."""
    text = F.trim(F.coalesce(text, F.lit("")))
    none = F.lit(None).cast("string")
    plain = lambda c, s, g: F.struct(F.lit(c).alias("category"), F.lit(s).alias("signal"), F.lit(g).cast("string").alias("stage"), F.lit(True).alias("bill_action"))
    row = lambda m: F.struct(m["category"].alias("category"), m["signal"].alias("signal"), m["stage"].alias("stage"), F.lit(True).alias("bill_action"))

    def bill(v: Column) -> Column:
        low, found = F.lower(v["text"]), v["found"]
        return (
            F.when(v["amended"], F.struct(F.lit("amendment").alias("category"), F.coalesce(found["signal"], F.lit("neutral")).alias("signal"), none.alias("stage"), F.lit(False).alias("bill_action")))
            .when(v["text"] == "", plain("other", "neutral", None))
            .when(found["category"].isNotNull(), row(found))
            .when(F.contains(low, F.lit("recommends be adopted")), plain("committee_action", "positive", "PASSED_COMMITTEE"))
            .when(F.contains(low, F.lit("executive appointments")) & F.contains(low, F.lit("placed on calendar")), plain("appointment", "neutral", None))
            .when(F.startswith(low, F.lit("rule 2-10")), plain("deadline", "neutral", None))
            .when(is_re_referral(v["text"]), plain("deadline", "negative_weak", None))
            .when(is_unfavorable_report(v["text"]), plain("committee_action", "negative", "IN_COMMITTEE"))
            .when(is_favorable_report(v["text"]), plain("committee_action", "positive", "PASSED_COMMITTEE"))
            .when(starts_any(low, ("placed on calendar", "placed calendar")), plain("floor_process", "positive_weak", "FLOOR_VOTE"))
            .otherwise(plain("other", "neutral", None))
        )

    seen = F.struct(text.alias("text"), text.rlike(AMENDMENT).alias("amended"), _matched(F.regexp_replace(text, AMENDMENT, "")).alias("found"))
    return bound(seen, bill)


def is_rollback(text: Column) -> Column:
    low = F.lower(F.trim(text))
    back = starts_any(low, ("rule 19(a)", "rule 19(b)", "rule 3-9(a)", "rule 3-9(b)"))
    return back | F.contains(low, F.lit("re-referred to rules")) | F.contains(low, F.lit("re-referred to assignments"))


def stage_number(stage: Column) -> Column:
    """0 to 8, -1 for none."""
    return F.coalesce((F.array_position(F.array(*(F.lit(s) for s in STAGE_ORDER)), stage) - 1).cast("int"), F.lit(-1))


def outcomes(actions: DataFrame, bill_id: str, day: str, order: str, text: str) -> DataFrame:
    """Per bill its highest and current stage, lifecycle, signals and flags, folded over its actions in order.

    A step back after both chambers sets the current stage to committee before the action's own stage counts. What the fold
    needs of the order is this: a step back begins a new stretch; one whose stages reached CROSSED_CHAMBERS ends at committee
    when a further stretch follows, a lower one hands its stage on, and SIGNED is never left. So the current stage is the
    highest of the stretches behind the last one that was set back. Stretches are numbered by running counts over ranges of
    (bill, order), and reduced before they are counted again: a bill of any number of actions lies in many tasks.
    """
    c = actions.select(F.col(bill_id).alias("bill_id"), F.col(day).alias("day"), F.col(order).alias("ord"), F.col(text).alias("text"), classify_action(F.col(text)).alias("c"))
    c = c.where("c.bill_action").select("bill_id", "day", "ord", "text", stage_number(F.col("c.stage")).alias("stage"), F.col("c.signal").alias("signal"), F.coalesce(is_rollback(F.col("text")), F.lit(False)).cast("int").alias("back"))
    rows = keyed_before(c, ["bill_id"], ["day", "ord", "text"], {"stretch": F.col("back")}, totals=["stretch"])
    low, signal = F.lower("text"), F.col("signal")
    parts = rows.groupBy("bill_id", (F.col("stretch") + F.col("back")).alias("stretch"), (F.col("stretch_total")).alias("last")).agg(
        F.max("stage").alias("stage"),
        F.count_if(F.startswith(signal, F.lit("positive"))).alias("pos"),
        F.count_if(F.startswith(signal, F.lit("negative"))).alias("neg"),
        F.max(signal == "positive_terminal").alias("signed"),
        F.max(signal == "negative_terminal").alias("veto"),
        F.max(F.contains(low, F.lit("override")) | F.contains(low, F.lit("veto stands"))).alias("override"),
        F.max_by(F.struct("text"), F.when(F.endswith(signal, F.lit("_terminal")), F.struct("day", "ord", "text"))).alias("terminal"),
    )
    left = (F.col("stage") >= CROSSED) & (F.col("stretch") < F.col("last"))
    parts = keyed_before(parts, ["bill_id"], ["stretch"], {"set_back": left.cast("int")}, totals=["set_back"])
    whole = parts.groupBy("bill_id").agg(
        F.greatest(F.max("stage"), F.lit(0)).alias("high"),
        F.greatest(F.max(F.when(F.col("set_back") == F.col("set_back_total"), F.col("stage"))), F.max(F.when(F.col("set_back_total") > 0, 1).otherwise(0))).alias("now"),
        F.sum("pos").cast("int").alias("pos"),
        F.sum("neg").cast("int").alias("neg"),
        F.max("signed").alias("signed"),
        F.max("veto").alias("veto"),
        F.max("override").alias("override"),
        F.max_by("terminal", F.when(F.col("terminal").isNotNull(), F.col("stretch"))).alias("terminal"),
    )
    names = F.array(*(F.lit(x) for x in STAGE_ORDER))
    now = F.when(F.col("high") == len(STAGE_ORDER) - 1, F.col("high")).otherwise(F.col("now"))
    return whole.select(
        "bill_id",
        F.element_at(names, F.col("high") + 1).alias("highest_stage"),
        F.element_at(names, now + 1).alias("current_stage"),
        F.when(F.col("signed"), "PASSED").when(F.col("veto"), "VETOED").otherwise("OPEN").alias("lifecycle"),
        F.col("pos").alias("positive_signals"),
        F.col("neg").alias("negative_signals"),
        F.col("veto").alias("has_veto"),
        F.col("override").alias("has_override"),
        F.col("terminal.text").alias("terminal_action"),
    )


#: How far along a stage is, for display (fixed values).
STAGE_PROGRESS = {"FILED": 0.10, "IN_COMMITTEE": 0.25, "PASSED_COMMITTEE": 0.40, "FLOOR_VOTE": 0.55, "CHAMBER_PASSED": 0.60, "CROSSED_CHAMBERS": 0.70, "PASSED_BOTH": 0.85, "GOVERNOR": 0.95, "SIGNED": 1.0}


def stage_progress(stage: Column, vetoed: Column) -> Column:
    """From 0 to 1; a veto is -1."""
    table = F.create_map(*(x for k, v in STAGE_PROGRESS.items() for x in (F.lit(k), F.lit(v))))
    return F.when(vetoed, -1.0).otherwise(F.coalesce(table[stage], F.lit(0.0)))


#: Stages that may follow a stage, and votes needed by chamber (fixed values).
NEXT_STAGES = {"FILED": ("IN_COMMITTEE",), "IN_COMMITTEE": ("PASSED_COMMITTEE",), "PASSED_COMMITTEE": ("FLOOR_VOTE",), "FLOOR_VOTE": ("CROSSED_CHAMBERS",), "CHAMBER_PASSED": ("CROSSED_CHAMBERS",), "CROSSED_CHAMBERS": ("PASSED_BOTH",), "PASSED_BOTH": ("GOVERNOR",), "GOVERNOR": ("SIGNED", "VETOED"), "SIGNED": (), "VETOED": ()}
VOTES = {("S", "members"): 59, ("S", "passage"): 30, ("S", "override"): 36, ("S", "discharge"): 36, ("H", "members"): 118, ("H", "passage"): 60, ("H", "override"): 71, ("H", "discharge"): 60}


def stage_table(spark: SparkSession) -> DataFrame:
    """Stages with their order, progress and successors."""
    rows = [(i, s, STAGE_PROGRESS.get(s, -1.0), list(NEXT_STAGES[s])) for i, s in enumerate(NEXT_STAGES)]
    return spark.createDataFrame(rows, "ord int, stage string, progress double, next_stages array<string>")


def vote_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, k, n) for (c, k), n in VOTES.items()], "chamber string, purpose string, votes int")


def category_table(spark: SparkSession) -> DataFrame:
    """The categories with their patterns, as a reference for readers."""
    return pattern_table(spark).groupBy("category").agg(F.array_sort(F.collect_list(F.struct("ord", "pattern", "signal", "stage"))).alias("patterns"))
