"""Raw records to the star schema, one DataFrame per table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.actions import classify_action
from ..functions.classify import vote_outcome
from ..functions.dates import chamber_code, parse_date
from ..functions.text import collapse, number_parts, surrogate_key
from ..operators.votes import casts


def dim_members(members: DataFrame) -> DataFrame:
    years = F.col("career_ranges")
    return members.select(
        F.col("id").alias("member_id"), "name", F.upper(F.trim("name")).alias("name_clean"), "party", chamber_code(F.col("chamber")).alias("chamber"),
        F.when(F.col("district").rlike("^[0-9]+$"), F.col("district").try_cast("int")).alias("district"),
        F.array_min(F.transform(years, lambda r: r["start_year"])).alias("career_start"), F.array_max(F.transform(years, lambda r: r["end_year"])).alias("career_end"),
        "role", "email", F.coalesce(F.size("sponsored_bill_ids"), F.lit(0)).alias("sponsored_bill_count"), F.coalesce(F.size("co_sponsor_bill_ids"), F.lit(0)).alias("cosponsor_bill_count"),
    )


def dim_bills(bills: DataFrame) -> DataFrame:
    p = number_parts(F.col("bill_number"))
    return bills.select(
        F.col("leg_id").alias("bill_id"), F.col("bill_number").alias("bill_number_raw"), p["kind"].alias("bill_type"), p["number"].alias("bill_number_int"), p["suffix"].alias("amendment_suffix"),
        "description", F.col("synopsis").alias("synopsis_text"), F.when(F.startswith("bill_number", F.lit("S")), "S").otherwise("H").alias("chamber_origin"), "primary_sponsor",
        F.get("sponsor_ids", F.lit(0)).alias("primary_sponsor_id"), parse_date(F.get("action_history", F.lit(0))["date"]).alias("introduction_date"),
        "last_action", parse_date(F.col("last_action_date")).alias("last_action_date"), (F.coalesce(F.size("sponsor_ids"), F.lit(0)) + F.coalesce(F.size("house_sponsor_ids"), F.lit(0))).alias("sponsor_count"), "status_url", "full_text",
    )


def fact_actions(bills: DataFrame) -> DataFrame:
    a = bills.select(F.col("leg_id").alias("bill_id"), F.posexplode("action_history").alias("ord", "a"))
    return a.select(
        surrogate_key(F.col("bill_id"), F.col("a.date"), F.col("a.chamber"), F.col("a.action"), F.col("ord")).alias("action_id"), "bill_id", "ord", parse_date(F.col("a.date")).alias("date"),
        chamber_code(F.col("a.chamber")).alias("chamber"), F.col("a.action").alias("action_text"), classify_action(F.col("a.action"))["category"].alias("action_category"),
    )


def _events(rows: DataFrame) -> DataFrame:
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return rows.select(
        surrogate_key(F.col("bill_number"), F.col("date"), F.col("description")).alias("vote_event_id"), "bill_id", "bill_number", parse_date(F.col("date")).alias("date"), chamber_code(F.col("chamber")).alias("chamber"),
        "vote_type", "description", vote_outcome(size("yea_votes"), size("nay_votes")).alias("outcome"), size("yea_votes").alias("total_yea"), size("nay_votes").alias("total_nay"), size("present_votes").alias("total_present"), size("nv_votes").alias("total_nv"), "pdf_url",
        "yea_votes", "nay_votes", "present_votes", "nv_votes",
    )


LISTS = ["yea_votes", "nay_votes", "present_votes", "nv_votes"]


def votes(bills: DataFrame, standalone: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(fact_vote_events, fact_vote_casts_raw). Standalone events and their casts join those of the bills; an event that a
    bill already has is not added again."""
    own = bills.select(F.col("leg_id").alias("bill_id"), F.explode("vote_events").alias("v")).select("bill_id", "v.*")
    events = _events(own).dropDuplicates(["vote_event_id"])
    if standalone is not None:
        ids = bills.select("bill_number", F.col("leg_id").alias("bill_id"))
        extra = _events(standalone.join(ids, "bill_number", "left")).dropDuplicates(["vote_event_id"])
        events = events.unionByName(extra.join(events.select("vote_event_id"), "vote_event_id", "left_anti"))
    raw = casts(events.select("vote_event_id", "bill_id", "chamber", "date", *LISTS), "vote_event_id").withColumnsRenamed({"name": "raw_voter_name", "vote": "vote_cast"})
    return events.drop(*LISTS), raw


def fact_slips(bills: DataFrame) -> DataFrame:
    s = bills.select(F.col("leg_id").alias("bill_id"), "bill_number", F.posexplode("witness_slips").alias("ord", "s"))
    return s.select(
        surrogate_key(F.col("bill_id"), F.col("s.name"), F.col("s.organization"), F.col("s.position"), F.col("ord")).alias("slip_id"), "bill_id", F.col("s.bill_number").alias("bill_number"),
        F.col("s.name").alias("name_raw"), F.upper(collapse(F.coalesce("s.name", F.lit("")))).alias("name_clean"), F.col("s.organization").alias("organization_raw"), F.upper(collapse(F.coalesce("s.organization", F.lit("")))).alias("organization_clean"),
        F.col("s.representing").alias("representing"), F.col("s.position").alias("position"), F.col("s.testimony_type").alias("testimony_type"), F.col("s.hearing_committee").alias("hearing_committee"), parse_date(F.col("s.hearing_date")).alias("hearing_date"),
    )


def star(members: DataFrame, bills: DataFrame, standalone: DataFrame | None = None) -> dict[str, DataFrame]:
    events, raw = votes(bills, standalone)
    return {"dim_members": dim_members(members), "dim_bills": dim_bills(bills), "fact_bill_actions": fact_actions(bills), "fact_vote_events": events, "fact_vote_casts_raw": raw, "fact_witness_slips": fact_slips(bills)}
