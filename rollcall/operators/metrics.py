"""Scorecards, composites, committee and slip statistics: grouped aggregation with conditional counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify as c
from ..functions.text import compact_number
from .ranges import group_quantiles
from .relational import dealt, running_total


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.coalesce(F.when(whole != 0, part / whole), F.lit(0.0))


def bill_facts(bills: DataFrame) -> DataFrame:
    """bills with status, depth and whether each is a law proper (substantive and no shell)."""
    return bills.withColumns(
        {
            "status": c.bill_status(F.col("last_action")),
            "depth": c.pipeline_depth(F.col("last_action")),
            "is_law": c.is_substantive(F.col("bill_number")) & ~c.is_shell(F.col("description")),
            "is_resolution": ~c.is_substantive(F.col("bill_number")),
        }
    )


def scorecards(members: DataFrame, bills: DataFrame, sponsors: DataFrame) -> DataFrame:
    """A row per member, those without bills too.

    members: member_id, party; bills: bill_id, bill_number, description, last_action; sponsors: bill_id, member_id, role.
    Co-sponsors are counted per bill first, so that bills are joined once; an empty denominator gives 0.
    """
    party = members.select(F.col("member_id").alias("co_id"), F.col("party").alias("co_party"))
    co = sponsors.where("role = 'CO'").select("bill_id", F.col("member_id").alias("co_id")).distinct().join(party, "co_id")
    chief = sponsors.where("role = 'PRIMARY'").select("bill_id", "member_id").join(members.select("member_id", "party"), "member_id")
    reach = co.join(chief, "bill_id").where("co_id <> member_id").groupBy("bill_id").agg(F.count(F.lit(1)).alias("n_co"), F.bool_or(F.col("co_party") != F.col("party")).alias("crosses"))
    own = chief.join(bill_facts(bills), "bill_id").join(reach, "bill_id", "left")
    passed = F.col("status") == "passed"
    per = own.groupBy("member_id").agg(
        F.count(F.lit(1)).alias("bills"),
        F.count_if(passed).alias("passed"),
        F.count_if(F.col("status") == "vetoed").alias("vetoed"),
        F.count_if(F.col("status") == "stuck").alias("stuck"),
        F.count_if(F.col("status") == "in_progress").alias("in_progress"),
        F.count_if("is_law").alias("laws"),
        F.count_if(F.col("is_law") & passed).alias("laws_passed"),
        F.count_if("is_resolution").alias("resolutions"),
        F.count_if(F.col("is_resolution") & passed).alias("resolutions_passed"),
        F.sum(F.when(F.col("is_law"), F.coalesce("n_co", F.lit(0))).otherwise(0)).alias("cosponsors"),
        F.count_if(F.col("is_law") & F.coalesce("crosses", F.lit(False))).alias("bridged"),
        F.sum(F.when(F.col("is_law"), F.col("depth")).otherwise(0)).alias("depth_total"),
    )
    counts = [x for x in per.columns if x != "member_id"]
    out = members.join(per, "member_id", "left").fillna(0, counts)
    return out.withColumns(
        {
            "success_rate": share(F.col("passed"), F.col("bills")),
            "law_rate": share(F.col("laws_passed"), F.col("laws")),
            "resolution_rate": share(F.col("resolutions_passed"), F.col("resolutions")),
            "magnet": share(F.col("cosponsors"), F.col("laws")),
            "bridge": share(F.col("bridged"), F.col("laws")),
            "depth_avg": share(F.col("depth_total"), F.col("laws")),
        }
    ).withColumn("effectiveness", F.round(F.col("bills") * F.col("success_rate"), 2))


#: Default weights; they are divided by their sum.
MONEYBALL = {"effectiveness_rate": 0.24, "pipeline": 0.16, "magnet_share": 0.16, "bridge": 0.12, "centrality": 0.12, "institutional": 0.20}
INFLUENCE = {"moneyball": 0.40, "betweenness": 0.20, "pivotality": 0.20, "pull": 0.20}
RECRUITMENT = {"affinity": 0.35, "effectiveness": 0.30, "persuadability": 0.20, "network": 0.15}


def weighted(weights: dict[str, float], digits: int = 2) -> Column:
    """100 times the weighted mean of the columns."""
    total = sum(weights.values()) or 1.0
    return F.round(sum((F.lit(w) * F.col(k) for k, w in weights.items()), F.lit(0.0)) / total * 100, digits)


def with_scalars(df: DataFrame, **aggregates: Column) -> DataFrame:
    """df with columns of whole-table aggregates: one partially aggregated row, joined to every row."""
    return df.crossJoin(F.broadcast(df.agg(*(a.alias(k) for k, a in aggregates.items()))))


def max_share(df: DataFrame, column: str, name: str) -> DataFrame:
    """column as a share of its greatest value, at most 1, 0 where that isn't positive."""
    df = with_scalars(df, __max=F.max(column))
    return df.withColumn(name, F.when(F.col("__max") > 0, F.least(F.col(column) / F.col("__max"), F.lit(1.0))).otherwise(0.0)).drop("__max")


def min_max(df: DataFrame, column: str, name: str) -> DataFrame:
    df = with_scalars(df, __lo=F.min(column), __hi=F.max(column))
    return df.withColumn(name, share(F.col(column) - F.col("__lo"), F.col("__hi") - F.col("__lo"))).drop("__lo", "__hi")


def moneyball(cards: DataFrame) -> DataFrame:
    """The composite score. cards: law_rate, depth_avg, magnet, bridge, centrality, institutional."""
    df = cards.withColumns({"effectiveness_rate": F.col("law_rate"), "pipeline": F.round(F.col("depth_avg") / 6.0, 4)})
    return max_share(df, "magnet", "magnet_share").withColumn("score", weighted(MONEYBALL))


def group_ratio(df: DataFrame, keys: list[str], column: str, valid: Column, average: str, ratio: str, digits: int = 1) -> DataFrame:
    """A group's average over its valid rows, and each valid row's multiple of it."""
    means = df.where(valid).groupBy(*keys).agg(F.avg(column).alias(average))
    out = df.join(means, keys, "left")
    return out.withColumn(ratio, F.when(valid & (F.col(average) > 0), F.round(F.col(column) / F.col(average), digits)))


def group_median(df: DataFrame, keys: list[str], column: str, median: str, ratio: str) -> DataFrame:
    """The exact median of a group, and each row's multiple of it. The medians go where adaptive execution sends them: they
    are as many as groups."""
    out = df.join(group_quantiles(df, keys, column, {median: 0.5}), keys, "left")
    return out.withColumn(ratio, F.when(F.col(median) > 0, F.round(F.col(column) / F.col(median), 1)))


def collaborators(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Per member the number of collaborators by party. edges: a, b in both directions."""
    code = c.party_code(F.col("party"))
    rows = edges.join(members.select(F.col("member_id").alias("b"), code.alias("code")), "b")
    return rows.groupBy(F.col("a").alias("member_id")).agg(F.count_if(F.col("code") == "R").alias("republicans"), F.count_if(F.col("code") == "D").alias("democrats"), F.count_if(~F.col("code").isin("R", "D")).alias("others"))


def sponsor_pull(sponsors: DataFrame, scores: DataFrame, members: DataFrame) -> DataFrame:
    """How much better than its chamber's average a member's bills are predicted to do; chief sponsorship counts twice."""
    rows = sponsors.join(scores.select("bill_id", "prob"), "bill_id").join(members.select("member_id", "chamber"), "member_id")
    base = rows.where("role = 'PRIMARY'").groupBy("chamber").agg(F.avg("prob").alias("chamber_avg"))
    per = rows.groupBy("member_id", "chamber").agg(
        F.count_if(F.col("role") == "PRIMARY").alias("sponsored"),
        F.avg(F.when(F.col("role") == "PRIMARY", F.col("prob"))).alias("sponsored_avg"),
        F.count_if(F.col("role") == "CO").alias("cosponsored"),
        F.avg(F.when(F.col("role") == "CO", F.col("prob"))).alias("cosponsored_avg"),
    )
    lift = lambda x: F.coalesce(F.round(F.col(x) - F.col("chamber_avg"), 4), F.lit(0.0))
    out = per.join(base, "chamber", "left").withColumns({"sponsor_lift": lift("sponsored_avg"), "cosponsor_lift": lift("cosponsored_avg")})
    return out.withColumn("pull", F.round((2 * F.col("sponsor_lift") + F.col("cosponsor_lift")) / 3, 4))


def committee_stats(listed: DataFrame, assigned: DataFrame, bills: DataFrame) -> DataFrame:
    """Per committee the distinct bills listed with it or assigned to it, how many advanced and how many passed."""
    pairs = listed.select("code", "number").unionByName(assigned.select("code", "number"))
    facts = bill_facts(bills).select(compact_number(F.col("bill_number")).alias("__n"), "depth", "status")
    rows = dealt(pairs.select("code", compact_number(F.col("number")).alias("__n")), "__n").distinct().join(facts, "__n")
    out = rows.groupBy("code").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("depth") >= 2).alias("advanced"), F.count_if(F.col("status") == "passed").alias("passed"))
    return out.withColumns({"advance_rate": share(F.col("advanced"), F.col("total")), "pass_rate": share(F.col("passed"), F.col("total"))})


ROLE_ORDER = ("Chair", "Vice-Chair", "Minority Spokesperson", "Member")


def committee_roles(roster: DataFrame, stats: DataFrame) -> DataFrame:
    """Per member its committees as one ordered list: leading roles first, then by code."""
    order = F.array(*(F.lit(r) for r in ROLE_ORDER))
    rank = F.when(F.array_position(order, F.col("role")) > 0, F.array_position(order, F.col("role")) - 1).otherwise(99).cast("int")
    rows = roster.join(stats, "code", "left")
    item = F.struct(rank.alias("rank"), F.col("code").alias("code"), F.col("role").alias("role"), (rank <= 2).alias("leads"), F.coalesce("total", F.lit(0)).alias("bills"))
    return rows.groupBy("member_id").agg(F.array_sort(F.collect_list(item)).alias("committees"))


def member_roles(members: DataFrame, roster: DataFrame) -> DataFrame:
    """All role titles of a member, the profile's first, each once, in roster order."""
    listed = roster.groupBy("member_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "role"))), lambda r: r["role"]).alias("__r"))
    own = F.when(F.coalesce(F.col("role"), F.lit("")) != "", F.array("role")).otherwise(F.array().cast("array<string>"))
    return members.join(listed, "member_id", "left").select(*members.columns, F.filter(F.array_distinct(F.concat(own, F.coalesce("__r", F.array().cast("array<string>")))), lambda r: F.coalesce(r, F.lit("")) != "").alias("roles"))


def slip_summary(slips: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by position and the controversy: opponents' share of both sides, 0 without any."""
    pro, opp = F.count_if(F.col("position") == "Proponent"), F.count_if(F.col("position") == "Opponent")
    out = slips.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("slips"), pro.alias("proponents"), opp.alias("opponents"),
        F.count_if(F.contains(F.lower("position"), F.lit("no position"))).alias("no_position"),
        F.count_if(F.col("testimony").rlike("(?i)record|written")).alias("written"),
        F.countDistinct("organization").alias("organizations"),
    )
    return out.withColumn("controversy", F.round(share(F.col("opponents"), F.col("proponents") + F.col("opponents")), 4))


def concentration(df: DataFrame, keys: list[str], part: str) -> DataFrame:
    """The Herfindahl index of a group's parts and the largest part's share, from counts alone."""
    n = df.groupBy(*keys, part).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*keys).agg((F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("hhi"), (F.max("n") / F.sum("n")).alias("top_share"))


def anomaly_features(slips: DataFrame, key: str, least: int = 10) -> DataFrame:
    """Per bill with at least so many slips: duplication, unanimity, written and diversity ratios, concentration, volume."""
    n = F.count(F.lit(1))
    base = slips.groupBy(key).agg(
        n.alias("total"), F.countDistinct("name").alias("names"), F.countDistinct("organization").alias("organizations"),
        F.count_if(F.col("position") == "Proponent").alias("pro"), F.count_if(F.col("position") == "Opponent").alias("opp"), F.count_if(F.col("testimony").rlike("(?i)record|written")).alias("written"),
    ).where(F.col("total") >= least)
    out = base.join(concentration(slips, [key], "organization"), key)
    return out.select(
        key, "total", "hhi", "top_share",
        (F.col("total") / F.greatest("names", F.lit(1))).alias("duplication"), (F.abs(F.col("pro") - F.col("opp")) / F.col("total")).alias("unanimity"),
        (F.col("written") / F.col("total")).alias("written_ratio"), (F.col("organizations") / F.col("total")).alias("diversity"),
        (F.col("names") / F.greatest("organizations", F.lit(1))).alias("names_per_org"), F.log("total").alias("log_total"),
    )


def advancement(bills: DataFrame, volumes: DataFrame, fraction: float = 0.9, top_fraction: bool = False) -> DataFrame:
    """Bills of high slip volume with whether they passed. volumes: bill_id, volume.

    The threshold is the volume at place int(n * fraction) of the volumes in descending order; with top_fraction at place
    int(n * (1 - fraction)), which is what the words "top tenth" say. It is found from counts per volume.
    """
    rows = bill_facts(bills).join(volumes.where("volume > 0"), "bill_id")
    per = rows.groupBy("volume").agg(F.count(F.lit(1)).alias("n"))
    running = running_total(per, [F.desc("volume")], F.col("n"), "__upto")
    total = per.agg(F.sum("n").alias("__n"))
    place = F.least(F.floor(F.col("__n") * F.lit(1 - fraction if top_fraction else fraction)), F.col("__n") - 1)
    bound = running.crossJoin(total).where(F.col("__upto") > place).agg(F.greatest(F.max("volume"), F.lit(1)).alias("threshold"))
    return rows.crossJoin(bound).where("volume >= threshold").select("bill_id", "volume", "threshold", (F.col("status") == "passed").alias("passed"))


def alignment(slips: DataFrame, sponsors: DataFrame, bills: DataFrame) -> DataFrame:
    """Per member and organization the proponent slips on the bills that the member leads, by normalized bill number."""
    own = sponsors.where("role = 'PRIMARY'").join(bills.select("bill_id", compact_number(F.col("bill_number")).alias("__n")), "bill_id").select("member_id", "__n").distinct()
    said = slips.where((F.col("position") == "Proponent") & (F.coalesce("organization", F.lit("")) != "")).groupBy(compact_number(F.col("bill_number")).alias("__n"), "organization").agg(F.count(F.lit(1)).alias("n"))
    return own.join(said, "__n").groupBy("member_id", "organization").agg(F.sum("n").alias("slips"))


def churn(old: DataFrame, new: DataFrame, key: str, label: str) -> DataFrame:
    """How labels changed between two snapshots, as one row."""
    both = old.select(key, F.col(label).alias("a")).join(new.select(key, F.col(label).alias("b")), key)
    out = both.agg(F.count(F.lit(1)).alias("compared"), F.count_if(F.col("a") != F.col("b")).alias("changed"), F.count_if((F.col("a") == 0) & (F.col("b") == 1)).alias("up"), F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("down"))
    return out.withColumn("rate", share(F.col("changed"), F.col("compared")))


def confusion(df: DataFrame, actual: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """Counts and accuracy, precision, recall and F1."""
    a, p = F.col(actual) == 1, F.col(predicted) == 1
    out = df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), F.count_if(a & p).alias("tp"), F.count_if(~a & p).alias("fp"), F.count_if(a & ~p).alias("fn"), F.count_if(~a & ~p).alias("tn"))
    out = out.withColumns({"accuracy": share(F.col("tp") + F.col("tn"), F.col("n")), "precision": share(F.col("tp"), F.col("tp") + F.col("fp")), "recall": share(F.col("tp"), F.col("tp") + F.col("fn"))})
    return out.withColumn("f1", share(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def confidence_bucket(p: Column) -> Column:
    return F.when(p >= 0.9, "0.9-1.0").when(p >= 0.8, "0.8-0.9").when(p >= 0.7, "0.7-0.8").when(p >= 0.6, "0.6-0.7").otherwise("0.5-0.6")


def majority(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """A group's most frequent value; the least value wins a tie."""
    n = df.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(column).alias("v"))).alias("b"))
    return best.select(*keys, F.col("b.v").alias(column), (-F.col("b.m")).alias("n"))


def dominant(df: DataFrame, key: str, value: str, weight: str, order: str) -> DataFrame:
    """Per key the value of the greatest weight; the first in order wins a tie."""
    return df.groupBy(key).agg(F.min(F.struct((-F.col(weight)).alias("w"), F.col(order).alias("o"), F.col(value).alias("v"))).alias("b")).select(key, F.col("b.v").alias(value))


def coalition_influence(blocs: DataFrame, influence: DataFrame) -> DataFrame:
    """Per bloc its size, mean and greatest influence, the member who has it, the best connector and the count of High."""
    rows = blocs.where("coalition_id >= 0").join(influence, "member_id", "left")
    top = lambda score: F.min(F.struct((-F.col(score)).alias("s"), F.col("member_id").alias("m")))
    return rows.groupBy("coalition_id").agg(
        F.count(F.lit(1)).alias("members"), F.round(F.avg("score"), 2).alias("avg_influence"), F.round(F.max("score"), 2).alias("max_influence"),
        top("score")["m"].alias("top_member"), top("betweenness")["m"].alias("bridge_member"), F.count_if(F.col("score") >= 60).alias("high"),
    )


def cohesion(casts: DataFrame, keys: list[str]) -> DataFrame:
    """The mean over events of the larger side's share of yes and no."""
    y, n = F.count_if(F.col("vote") == "Y"), F.count_if(F.col("vote") == "N")
    per = casts.where(F.col("vote").isin("Y", "N")).groupBy(*keys, "event_id").agg((F.greatest(y, n) / (y + n)).alias("x"))
    return per.groupBy(*keys).agg(F.avg("x").alias("cohesion"), F.count(F.lit(1)).alias("events"))


def quantiles(df: DataFrame, keys: list[str], column: str, at: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """Nearest-rank quantiles and the mean; a group without values has none of them."""
    whole = df.groupBy(*keys).agg(F.avg(column).alias("mean"), F.count(F.lit(1)).alias("n"))
    found = group_quantiles(df, keys, column, {f"p{round(q * 100)}": q for q in at}, nearest=True)
    match = F.lit(True)
    for k in keys:
        match = match & whole[k].eqNullSafe(found[k])
    return whole.join(found, match, "left").select(*(whole[k] for k in keys), *(c for c in found.columns if c not in keys), "mean", "n")
