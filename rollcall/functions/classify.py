"""Domain categories as Spark expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The words by which an action tells what became of a bill. Matching minds case.
PASSED = ("Public Act", "Adopted Both Houses", "Resolution Adopted", "Appointment Confirmed", "Signed by Governor")
STUCK = ("Referred to Assignments", "Re-referred", "Rule 3-9", "Rule 19")
SIGNED = ("Public Act", "Signed by Governor", "Appointment Confirmed")
CROSSED = ("Adopted Both Houses", "Passed Both Houses", "Sent to the Governor", "Resolution Adopted")
CHAMBER_PASSED = ("Third Reading - Passed", "Third Reading - Short Debate - Passed", "Passed the Senate", "Passed the House")
COMMITTEE_PASSED = ("Do Pass", "Reported Out", "Be Adopted")
SECOND_READING = ("Second Reading", "Third Reading", "Placed on Calendar", "Short Debate")
COMMITTEE = ("Referred to", "Assigned to", "Re-referred")
STAGES = ("filed", "committee", "committee_passed", "second_reading", "chamber_passed", "crossed", "signed")


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def starts_any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.startswith(text, F.lit(w)) for w in words))


def bill_status(action: Column) -> Column:
    return F.when(has_any(action, PASSED), "passed").when(F.contains(action, F.lit("Veto")), "vetoed").when(has_any(action, STUCK), "stuck").otherwise("in_progress")


def pipeline_stage(action: Column) -> Column:
    """The most advanced stage that the text names; committee passage is looked for before second reading."""
    return (
        F.when(has_any(action, SIGNED), "signed").when(has_any(action, CROSSED), "crossed").when(has_any(action, CHAMBER_PASSED), "chamber_passed")
        .when(has_any(action, COMMITTEE_PASSED), "committee_passed").when(has_any(action, SECOND_READING), "second_reading").when(has_any(action, COMMITTEE), "committee").otherwise("filed")
    )


def stage_depth(stage: Column) -> Column:
    return (F.array_position(F.array(*(F.lit(s) for s in STAGES)), stage) - 1).cast("int")


def pipeline_depth(action: Column) -> Column:
    return stage_depth(pipeline_stage(action))


def is_substantive(number: Column) -> Column:
    return F.upper(number).rlike("^(HB|SB)")


def is_shell(description: Column) -> Column:
    up = F.upper(F.trim(F.coalesce(description, F.lit(""))))
    return F.contains(up, F.lit("TECHNICAL")) | F.contains(up, F.lit("SHELL")) | F.endswith(up, F.lit("-TECH"))


#: What a role title holds if it is a leader's. Longer titles hold one of these too.
LEADER_WORDS = ("leader", "whip", "speaker pro", "president pro", "speaker of the house", "president of the senate", "caucus chair", "conference chair")


def is_leadership(role: Column) -> Column:
    return has_any(F.lower(F.trim(F.coalesce(role, F.lit("")))), LEADER_WORDS)


def role_weight(role: Column) -> Column:
    low = F.lower(role)
    return F.when(has_any(low, ("president", "leader", "speaker")), 1.0).when(has_any(low, ("caucus chair", "whip")), 0.25).when(has_any(low, ("chair", "spokesperson")), 0.5).otherwise(0.0)


def institutional_weight(roles: Column, role: Column) -> Column:
    """The best weight of a member's roles; the profile's role counts where there are none."""
    best = F.array_max(F.transform(roles, role_weight))
    return F.coalesce(F.when(F.size(roles) > 0, best), F.when(F.coalesce(role, F.lit("")) != "", role_weight(role)), F.lit(0.0))


def stuck_status(vetoed: Column, days_since_intro: Column, days_idle: Column) -> Column:
    return F.when(vetoed, "DEAD").when(days_since_intro < 30, "NEW").when(days_idle >= 180, "STAGNANT").when(days_idle >= 60, "SLOW").otherwise("PENDING")


def stuck_reason(status: Column, days_idle: Column) -> Column:
    months = F.floor(days_idle / 30).cast("int")
    return F.when(status == "DEAD", "Vetoed").when(status == "NEW", "Introduced within a month").when(status == "PENDING", "Active within two months").otherwise(F.format_string("No action for %d months", months))


def loyalty_tier(rate: Column) -> Column:
    return F.when(rate >= 0.80, "Champion").when(rate >= 0.65, "Lean Support").when(rate >= 0.45, "Swing").when(rate >= 0.25, "Lean Oppose").otherwise("Oppose")


def party_code(party: Column) -> Column:
    low = F.lower(F.coalesce(party, F.lit("")))
    return F.when(F.contains(low, F.lit("republican")), "R").when(F.contains(low, F.lit("democrat")), "D").otherwise(F.upper(F.substring(party, 1, 1)))


def bipartisan_label(a: Column, b: Column) -> Column:
    """By the share of the smaller of two counts."""
    share = F.when(a + b > 0, F.least(a, b) / (a + b))
    return F.when(share >= 0.3, "Strong").when(share >= 0.15, "Moderate").when(share > 0, "Low").otherwise("None")


def badges(p: dict[str, Column]) -> Column:
    """The achievements that a profile's figures earn, in a fixed order."""
    rules = (
        ("Closer", (p["laws_filed"] > 0) & (p["effectiveness_rate"] >= 0.25)),
        ("Coalition Builder", p["magnet_score"] >= 10),
        ("Bipartisan Bridge", p["bridge_score"] >= 0.20),
        ("Pipeline Driver", (p["pipeline_depth_avg"] >= 4.0) & (p["laws_filed"] >= 3)),
        ("Network Hub", p["network_centrality"] >= 0.5),
        ("Bridge Connector", p["betweenness"] >= 0.02),
        ("Wide Tent", p["unique_collaborators"] >= 20),
        ("Ceremonial Focus", (p["resolutions_filed"] > 0) & (p["laws_filed"] > 0) & (p["resolutions_filed"] > 2 * p["laws_filed"])),
        ("Hidden Gem", ~p["is_leadership"] & (p["laws_passed"] >= 2) & (p["effectiveness_rate"] >= 0.15) & (p["magnet_score"] >= 2.0)),
    )
    return F.array_compact(F.array(*(F.when(condition, name) for name, condition in rules)))


def power_badges(weight: Column, chaired: Column, rank: Column, size: Column) -> Column:
    """Leadership, a committee's chair, and a rank in the chamber's top twentieth (one member at least)."""
    cutoff = F.greatest(F.ceil(size * 0.05), F.lit(1))
    percent = F.floor(rank * 100.0 / size).cast("int")
    top = F.format_string("TOP %d%% INFLUENCE", F.greatest(percent, F.lit(1)))
    return F.array_compact(F.array(F.when(weight >= 0.25, "LEADERSHIP"), F.when(F.size(chaired) > 0, "COMMITTEE CHAIR"), F.when((size > 0) & (rank > 0) & (rank <= cutoff), F.when(percent <= 5, top).otherwise("TOP 5% INFLUENCE"))))


def influence_label(score: Column) -> Column:
    return F.when(score >= 60, "High").when(score >= 30, "Moderate").otherwise("Low")


def influence_signals(moneyball: Column, betweenness: Column, pivotality: Column, swings: Column, lift: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(moneyball >= 0.5, "effective"),
            F.when(betweenness >= 0.3, "connector"),
            F.when(pivotality >= 0.5, "pivotal"),
            F.when(swings >= 2, F.format_string("decided %d votes", swings.cast("int"))),
            F.when(lift > 0.1, "pull"),
        )
    )


def forecast_confidence(p: Column) -> Column:
    return F.when(p >= 0.6, "High").when(p >= 0.35, "Medium").otherwise("Low")


def trust(auc: Column, f1_pos: Column, support_pos: Column) -> Column:
    """How far a model's figures can be relied on: at most one weakness and an area of 0.8 or more make it reliable."""
    weak = (auc < 0.8).cast("int") + (support_pos < 50).cast("int") + ((f1_pos > 0) & (f1_pos < 0.5)).cast("int")
    return F.when((weak <= 1) & (auc >= 0.8), "RELIABLE").when(auc >= 0.7, "MODERATE").otherwise("USE WITH CAUTION")


def predicted_destination(lifecycle: Column, stage: Column, p_law: Column, p_advance: Column) -> Column:
    far, floor = stage.isin("PASSED_BOTH", "GOVERNOR", "SIGNED"), stage.isin("FLOOR_VOTE", "CROSSED_CHAMBERS")
    return (
        F.when(lifecycle == "PASSED", "Became Law").when(lifecycle == "VETOED", "Vetoed").when((far & (p_law >= 0.3)) | (p_law >= 0.5), "→ Law")
        .when(floor & (p_advance >= 0.5), "→ Passed").when(p_advance >= 0.5, "→ Floor").otherwise("Stuck")
    )


#: How open a loyalty tier is to persuasion (fixed values).
PERSUADABILITY = {"Swing": 1.0, "Lean Support": 0.7, "Lean Oppose": 0.5, "Champion": 0.2, "Oppose": 0.1}


def persuadability(tier: Column) -> Column:
    return F.coalesce(F.create_map(*(x for k, v in PERSUADABILITY.items() for x in (F.lit(k), F.lit(v))))[tier], F.lit(0.5))


def value_label(percentile: Column) -> Column:
    return F.when(percentile >= 70, "Undervalued").when(percentile <= 30, "Overvalued").otherwise("Fairly Valued")


def rank_percentile(rank: Column, size: Column) -> Column:
    return F.round((1 - (rank - 1) / size) * 100).cast("int")


def coalition_name(dems: Column, reps: Column, yes_rate: Column, cohesion: Column, topics: Column) -> Column:
    """A bloc's name from its mix of parties, its share of yes, its two main topics and its cohesion."""
    ratio = F.when((dems > 0) & (reps > 0), F.least(dems, reps) / F.greatest(dems, reps))
    side = F.when(ratio > 0.3, "Bipartisan").when(ratio.isNotNull() & (dems > reps), "Dem-Leaning").when(ratio.isNotNull(), "GOP-Leaning").when(dems > 0, "Democrat").when(reps > 0, "Republican").otherwise("Mixed")
    style = F.when(yes_rate > 0.85, "Consensus").when(yes_rate < 0.55, "Opposition")
    focus = F.when(F.size(topics) > 0, F.array_join(F.slice(topics, 1, 2), " & "))
    return F.concat_ws(" ", style, side, focus, F.when(cohesion > 0.9, "Bloc").when(cohesion > 0.75, "Coalition").otherwise("Caucus"))


def unique_names(df: DataFrame, name: str, size: str, dems: str, reps: str, number: str) -> DataFrame:
    """Blocs of one name get their size and parties added, and if that isn't enough their number."""
    count = lambda: F.count(F.lit(1)).over(Window.partitionBy(name))
    longer = F.format_string("%s — %d members (%dD/%dR)", F.col(name), F.col(size).cast("long"), F.col(dems).cast("long"), F.col(reps).cast("long"))
    df = df.withColumn(name, F.when(count() > 1, longer).otherwise(F.col(name)))
    return df.withColumn(name, F.when(count() > 1, F.format_string("%s #%d", F.col(name), (F.col(number) + 1).cast("long"))).otherwise(F.col(name)))


#: Committees of procedure and service (fixed values).
PROCEDURAL = ("assignments", "committee on assignments", "rules committee", "rules", "executive", "executive appointments")


def is_procedural(committee: Column) -> Column:
    return F.lower(F.trim(committee)).isin(*PROCEDURAL)


#: What people write for no organization, and for speaking for themselves.
NO_ORGANIZATION = ("na", "n/a", "none", "not applicable", "not specified", "no organization", "(no organization)", "—", "-", "")
INDIVIDUAL = ("self", "myself", "on behalf of self", "individual", "citizen", "family", "personal", "retired", "private citizen", "self-employed", "me")


def canonical_organization(name: Column) -> Column:
    raw = F.trim(F.coalesce(name, F.lit("")))
    return F.when(F.lower(raw).isin(*NO_ORGANIZATION), "No organization").when(F.lower(raw).isin(*INDIVIDUAL), "Individual").otherwise(raw)


def vote_outcome(yeas: Column, nays: Column) -> Column:
    return F.when(yeas > nays, "passed").when(yeas < nays, "lost").otherwise("tied")


def humanize(feature: Column) -> Column:
    """A feature's name for readers."""
    return F.initcap(F.replace(F.regexp_replace(feature, r"^(is_|has_|n_)", ""), F.lit("_"), F.lit(" ")))


# Rule predicates on an action's text.
def _low(action: Column) -> Column:
    return F.lower(F.trim(action))


#: How a report, a step back, a tabling or a consent calendar is written (fixed values).
FAVORABLE = ("do pass", "be adopted", "recommend do adopt", "approved for consideration")
UNFAVORABLE = ("do not pass", "be not adopted", "recommend do not adopt", "without recommendation", "tabled")
RE_REFERRAL = ("rule 19(a)", "rule 19(b)", "rule 3-9(a)", "rule 3-9(b)", "pursuant to senate rule 3-9", "re-referred to rules committee", "re-referred to assignments")
TABLING = ("tabled", "motion to table", "laid on the table")
CONSENT = ("consent calendar", "agreed resolutions")


def is_favorable_report(action: Column) -> Column:
    return starts_any(_low(action), FAVORABLE)


def is_unfavorable_report(action: Column) -> Column:
    return starts_any(_low(action), UNFAVORABLE)


def is_re_referral(action: Column) -> Column:
    return starts_any(_low(action), RE_REFERRAL)


def missed_committee_deadline(action: Column) -> Column:
    return starts_any(_low(action), ("rule 19(a)", "rule 3-9(a)"))


def missed_floor_deadline(action: Column) -> Column:
    return F.startswith(_low(action), F.lit("rule 19(b)"))


def is_tabled(action: Column) -> Column:
    return starts_any(_low(action), TABLING)


def on_consent_calendar(action: Column) -> Column:
    return has_any(_low(action), CONSENT)


#: Words in a committee's name that tell its topics (fixed values).
TOPICS = {
    "Transportation": ("transport", "vehicle", "roads"),
    "Agriculture": ("agricultur", "farm", "conservation"),
    "Commerce": ("commerce", "small business", "business", "consumer protect", "licensed activit", "gaming", "tourism", "trade", "economic opportun"),
    "Criminal Justice": ("criminal", "judiciary", "public safety", "restorative justice", "police", "fire committee", "gun violence", "human rights", "immigration"),
    "Education": ("education", "school", "early childhood"),
    "Energy & Environment": ("energy", "environment", "public utilit", "utilities"),
    "Healthcare": ("health", "human services", "child welfare", "mental health", "addiction", "medicaid", "prescription drug", "public health", "behavioral", "end of life"),
    "Housing": ("housing",),
    "Insurance & Finance": ("insurance", "financial instit"),
    "Labor": ("labor", "workforce", "workers", "wage", "personnel"),
    "Revenue & Pensions": ("revenue", "pension", "appropriat", "tax", "budget"),
    "State Government": ("state government", "government admin", "election", "ethics & election", "local government", "cities", "counties", "cybersecur", "data analytics"),
}


def topics(committee: Column) -> Column:
    """The topics of a committee by its name, in the order above."""
    low = F.lower(F.coalesce(committee, F.lit("")))
    return F.array_compact(F.array(*(F.when(has_any(low, words), topic) for topic, words in TOPICS.items())))


def anomaly_reason(top_share: Column, duplication: Column, unanimity: Column, diversity: Column, hhi: Column) -> Column:
    """Up to five clauses on what is odd about a bill's slips. duplication: slips per distinct name."""
    plain = lambda x, d: F.replace(F.format_number(x, d), F.lit(","), F.lit(""))  # noqa: E731  (thousands aren't grouped)
    percent = lambda x, d: F.concat(plain(100 * x, d), F.lit("%"))
    parts = F.array_compact(
        F.array(
            F.when(top_share > 0.5, F.concat(F.lit("one organization files "), percent(top_share, 0))),
            F.when(duplication > 2.0, F.concat(F.lit("names recur "), plain(duplication, 1), F.lit(" times"))),
            F.when(unanimity > 0.95, "nearly all on one side"),
            F.when(diversity < 0.05, F.concat(F.lit("few organizations ("), percent(diversity, 1), F.lit(")"))),
            F.when(hhi > 0.3, F.concat(F.lit("concentrated (HHI "), plain(hhi, 2), F.lit(")"))),
        )
    )
    return F.when(F.size(parts) > 0, F.array_join(parts, "; ")).otherwise("unusual pattern")
