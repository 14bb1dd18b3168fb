"""Composite views: what a reader asks for in one go, built from the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import classify as c
from ..operators.metrics import INFLUENCE, MONEYBALL, RECRUITMENT, max_share, min_max, slip_summary, weighted
from ..operators.relational import page, top_n
from ..sources.scratch import materialize


def leaderboard(profiles: DataFrame, chamber: str | None = None, exclude_leaders: bool = False, sort: str = "score", descending: bool = True, offset: int = 0, limit: int = 0) -> DataFrame:
    """Profiles by one of their measures. Without a chamber leaders are never left out."""
    if chamber:
        profiles = profiles.where(F.lower("chamber") == chamber.lower())
        profiles = profiles.where(~F.col("is_leadership")) if exclude_leaders else profiles
    order = F.desc_nulls_last(sort) if descending else F.asc_nulls_last(sort)
    return page(profiles, [order, F.col("member_id")], offset, limit)


def influence(profiles: DataFrame, pivotality: DataFrame, pull: DataFrame) -> DataFrame:
    """The four parts, each from 0 to 1, their weighted score, label and signals. profiles: member_id, score, betweenness."""
    p = profiles.join(pivotality.select("member_id", "pivotal_rate", "swing"), "member_id", "left").join(pull.select("member_id", "pull", "sponsor_lift"), "member_id", "left")
    p = materialize(p, "influence")  # a row per member; maxima are taken of it and joined with it
    p = max_share(p.withColumn("moneyball", F.round(F.col("score") / 100, 4)).withColumnRenamed("betweenness", "__b"), "__b", "betweenness")
    p = min_max(p.withColumn("__p", F.col("pull")), "__p", "__share")
    p = p.withColumns({"pivotality": F.coalesce(F.round("pivotal_rate", 4), F.lit(0.0)), "pull": F.round(F.when(F.col("__p").isNull(), 0.0).otherwise(F.col("__share")), 4), "betweenness": F.round("betweenness", 4)})
    p = p.withColumn("influence", weighted(INFLUENCE))
    swing, lift = F.coalesce("swing", F.lit(0)), F.coalesce("sponsor_lift", F.lit(0.0))
    return p.select("member_id", "moneyball", "betweenness", "pivotality", "pull", "influence", c.influence_label(F.col("influence")).alias("label"), c.influence_signals(F.col("moneyball"), F.col("betweenness"), F.col("pivotality"), swing, lift).alias("signals"))


def power_broker(members: DataFrame, roster: DataFrame, profiles: DataFrame, outside: str, codes: list[str] | None = None, limit_to: DataFrame | None = None) -> DataFrame:
    """One row: a senator from another district who chairs one of the committees (by their order), or else the one with
    the best score (among limit_to, where given)."""
    senate = members.where((F.col("chamber") == "Senate") & (F.col("district") != outside)).join(profiles.select("member_id", "score"), "member_id", "left")
    low = F.lower("role")
    order = F.array(*(F.lit(x) for x in codes or []))
    chairs = roster.where(F.contains(low, F.lit("chair")) & ~F.contains(low, F.lit("vice"))).select("member_id", F.array_position(order.cast("array<string>"), F.col("code")).alias("place")).where("place > 0")
    first = senate.join(chairs, "member_id").select("member_id", "name", "score", F.lit(1).alias("rule"), F.col("place").cast("double").alias("key"))
    pool = senate.join(limit_to, "member_id", "left_semi") if limit_to is not None else senate
    rest = pool.where("score is not null").select("member_id", "name", "score", F.lit(2).alias("rule"), (-F.col("score")).alias("key"))
    return first.unionByName(rest).orderBy("rule", "key", "member_id").limit(1).select("member_id", "name", "score", F.when(F.col("rule") == 1, "committee chair").otherwise("highest score").alias("why"))


def allies(seatmates: DataFrame, profiles: DataFrame, limit_to: DataFrame | None = None) -> DataFrame:
    """Each member's seatmate of the highest bridge score, in the committee if one of them is."""
    rows = seatmates.join(profiles.select(F.col("member_id").alias("other_id"), "bridge"), "other_id", "left")
    if limit_to is not None:
        rows = rows.join(limit_to.select(F.col("member_id").alias("other_id"), F.lit(1).alias("inside")).distinct(), "other_id", "left")
    else:
        rows = rows.withColumn("inside", F.lit(1))
    order = [F.desc(F.coalesce("inside", F.lit(0))), F.desc(F.coalesce("bridge", F.lit(0.0))), F.col("other_id")]
    return top_n(rows, ["member_id"], order, 1).select("member_id", F.col("other_id").alias("ally_id"), F.coalesce("bridge", F.lit(0.0)).alias("bridge"))


def zip_search(found: DataFrame, brokers: DataFrame, ally: DataFrame) -> DataFrame:
    """A row per zip with its legislators, broker and ally; one who is both is shown once with both roles. Of several
    brokers the one of the least id is shown, and null where there is none."""
    one = brokers.agg(F.min("member_id").alias("broker"))  # always one row
    rows = found.crossJoin(F.broadcast(one)).join(ally.select(F.col("member_id").alias("senator"), F.col("ally_id").alias("ally")), "senator", "left")
    both = F.coalesce(F.col("broker") == F.col("ally"), F.lit(False))
    return rows.select("zip", "senator", "representative", "broker", F.when(~both, F.col("ally")).alias("ally"), both.alias("broker_is_ally"))


def member_cards(members: DataFrame, cards: DataFrame, ranks: DataFrame, alignment: DataFrame, summary: DataFrame, roles: DataFrame) -> DataFrame:
    """Wide rows for display: a member with scorecard, rank, votes and committees. Facts are grouped before they are joined."""
    size = F.count(F.lit(1)).over(Window.partitionBy("chamber"))
    out = members.select("member_id", "name", "chamber", "party").join(cards.select("member_id", F.struct("bills", "laws", "law_rate", "magnet", "bridge").alias("scorecard")), "member_id", "left")
    out = out.join(ranks.select("member_id", "rank_chamber", "score"), "member_id", "left").join(alignment.select("member_id", "alignment"), "member_id", "left")
    out = out.join(summary.select("member_id", F.struct("votes", "yes_percent").alias("votes")), "member_id", "left").join(roles, "member_id", "left")
    return out.withColumns({"party_code": c.party_code(F.col("party")), "percentile": c.rank_percentile(F.col("rank_chamber"), size)})


def bill_detail(bills: DataFrame, slips: DataFrame, events: DataFrame, actions: DataFrame) -> DataFrame:
    """A bill with its slip counts, votes and actions as nested lists."""
    s = slip_summary(slips, ["bill_id"]).select("bill_id", F.struct("slips", "proponents", "opponents", "controversy").alias("slip_summary"))
    v = events.groupBy("bill_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "yeas", "nays", "outcome"))).alias("votes"))
    a = actions.groupBy("bill_id").agg(F.array_sort(F.collect_list(F.struct("day", "ord", "action"))).alias("history"))
    return bills.join(s, "bill_id", "left").join(v, "bill_id", "left").join(a, "bill_id", "left")


def overview(scored: DataFrame, coalitions: DataFrame, anomalies: DataFrame, committees: DataFrame) -> DataFrame:
    """One row of counts."""
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    out = one(scored, "bills_scored").crossJoin(one(coalitions.select("coalition_id").distinct(), "coalitions"))
    return out.crossJoin(one(anomalies.where("flagged"), "flagged")).crossJoin(one(committees.where("total >= 10"), "active_committees"))


def recruitment(value: DataFrame, rates: DataFrame, profiles: DataFrame) -> DataFrame:
    """Per topic the members worth winning over, by affinity, predicted effectiveness, openness and reach."""
    p = max_share(profiles.select("member_id", F.col("betweenness").alias("__b")), "__b", "network").drop("__b")
    v = max_share(value.select("member_id", F.col("prediction").alias("__v")), "__v", "effectiveness").drop("__v")
    rows = rates.join(v, "member_id").join(p, "member_id").withColumn("tier", c.loyalty_tier(F.col("yes_rate")))
    rows = rows.withColumns({"affinity": F.col("yes_rate"), "persuadability": c.persuadability(F.col("tier"))})
    rows = rows.withColumn("recruitment", weighted(RECRUITMENT, 4))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("recruitment"), "member_id")))


def topic_tiers(rates: DataFrame, members: DataFrame, shown: int = 5) -> DataFrame:
    """Per topic and tier its size, parties and mean share of yes, with the members of most votes."""
    rows = rates.withColumn("tier", c.loyalty_tier(F.col("yes_rate"))).join(members.select("member_id", c.party_code(F.col("party")).alias("code")), "member_id")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("topic", "tier").orderBy(F.desc("votes"), "member_id")))
    top = F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= shown, F.struct("place", "member_id")))), lambda x: x["member_id"])
    return rows.groupBy("topic", "tier").agg(F.count(F.lit(1)).alias("members"), F.count_if(F.col("code") == "D").alias("democrats"), F.count_if(F.col("code") == "R").alias("republicans"), F.avg("yes_rate").alias("avg_yes_rate"), top.alias("top_members"))


def coalition_profiles(blocs: DataFrame, casts: DataFrame, topics: DataFrame, members: DataFrame, least: int = 20) -> DataFrame:
    """Per bloc size, parties, share of yes, its topics with the most yes, its bills with most yes, and its name."""
    v = casts.where(F.col("vote").isin("Y", "N")).join(blocs, "member_id")
    yes = F.count_if(F.col("vote") == "Y")
    parties = blocs.join(members.select("member_id", c.party_code(F.col("party")).alias("code")), "member_id").groupBy("coalition_id").agg(F.count(F.lit(1)).alias("members"), F.count_if(F.col("code") == "D").alias("dems"), F.count_if(F.col("code") == "R").alias("reps"))
    rate = v.groupBy("coalition_id").agg((yes / F.count(F.lit(1))).alias("yes_rate"))
    per_topic = v.join(topics, "bill_id").groupBy("coalition_id", "topic").agg((yes / F.count(F.lit(1))).alias("r"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    tops = top_n(per_topic, ["coalition_id"], [F.desc("r"), F.col("topic")], 3, rank="place").groupBy("coalition_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "topic"))), lambda x: x["topic"].cast("string")).alias("topics"))
    per_bill = v.groupBy("coalition_id", "bill_id").agg(yes.alias("n"))
    bills = top_n(per_bill, ["coalition_id"], [F.desc("n"), F.col("bill_id")], 5, rank="place").groupBy("coalition_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "bill_id"))), lambda x: x["bill_id"]).alias("bills"))
    ev = v.groupBy("coalition_id", "event_id").agg((F.greatest(yes, F.count(F.lit(1)) - yes) / F.count(F.lit(1))).alias("x")).groupBy("coalition_id").agg(F.avg("x").alias("cohesion"))
    out = parties.join(rate, "coalition_id", "left").join(tops, "coalition_id", "left").join(bills, "coalition_id", "left").join(ev, "coalition_id", "left")
    none = F.array().cast("array<string>")
    out = out.withColumn("topics", F.coalesce("topics", none)).withColumn("name", c.coalition_name(F.col("dems"), F.col("reps"), F.col("yes_rate"), F.col("cohesion"), F.col("topics")))
    return c.unique_names(out, "name", "members", "dems", "reps", "coalition_id")


def first_names(df: DataFrame, keys: list[str], name: str, shown: int = 8) -> DataFrame:
    """The first names of a group and how many more there are."""
    ordered = F.array_sort(F.collect_set(name))
    out = df.groupBy(*keys).agg(ordered.alias("__n"))
    more = F.size("__n") - shown
    return out.select(*keys, F.concat(F.array_join(F.slice("__n", 1, shown), ", "), F.when(more > 0, F.format_string(" and %d more", more)).otherwise("")).alias("names"))


def describe_bill(numbers: DataFrame, bills: DataFrame, key: Column, loose: Column) -> DataFrame:
    """Descriptions by number as written, or else without leading zeros."""
    exact = bills.select(F.col("bill_number").alias("__e"), F.col("description").alias("d1")).dropDuplicates(["__e"])
    near = bills.select(loose.alias("__l"), F.col("description").alias("d2")).groupBy("__l").agg(F.min("d2").alias("d2"))
    out = numbers.withColumn("__l", key)
    return out.join(exact, out["number"] == exact["__e"], "left").join(near, "__l", "left").select("number", F.coalesce("d1", "d2").alias("description"))


#: (kind, meaning, formula) by metric. Counts and shares come from bills alone; of a score, the weights are those it is made with.
METRICS = {
    "laws": ("count", "House and Senate bills of which the member is the chief sponsor; shells are left out.", "bills of the two kinds"),
    "laws_passed": ("count", "Laws of the member that passed.", "laws with status passed"),
    "law_rate": ("share", "Share of a member's laws that passed.", "laws_passed / laws"),
    "passed": ("count", "Chief-sponsored bills of any kind that passed.", ""),
    "vetoed": ("count", "Chief-sponsored bills that ended in a veto.", ""),
    "stuck": ("count", "Chief-sponsored bills that never left their committee.", ""),
    "in_progress": ("count", "Chief-sponsored bills neither passed, vetoed nor stuck.", ""),
    "resolutions_passed": ("count", "Resolutions of the member that were adopted.", ""),
    "depth_avg": ("mean", "Mean stage, 0 to 6, that the member's laws reached.", "sum of stages / laws"),
    "magnet": ("mean", "Co-sponsors per law.", "co-sponsors of laws / laws"),
    "bridge": ("share", "Share of laws with a co-sponsor of another party.", "laws with one / laws"),
    "centrality": ("share", "Share of the other members with whom the member shares a bill.", "partners / (members - 1)"),
    "volume": ("product", "Bills times the share of them that passed; mixes amount with success.", "bills * passed / bills"),
    "institutional": ("weight", "Weight of the member's offices, 0 to 1.", "1 leaders, 0.5 chairs, 0.25 whips"),
    "score": ("composite", "Weighted mean of shares and of values over their maximum, 0 to 100.", "weights"),
    "pivotal_rate": ("share", "Share of close votes on the winning side.", ""),
    "pull": ("difference", "How much better than the chamber's average the member's bills are predicted to do.", ""),
}


def glossary(spark: SparkSession) -> DataFrame:
    """(metric, kind, meaning, formula), formula null where the meaning says all, and a row per weight of the score."""
    rows = [(k, kind, meaning, formula or None) for k, (kind, meaning, formula) in METRICS.items()]
    rows += [(f"score.{k}", "weight of score", f"Part of {k} in the score.", f"{w:.2f}") for k, w in MONEYBALL.items()]
    return spark.createDataFrame(rows, "metric string, kind string, meaning string, formula string")
