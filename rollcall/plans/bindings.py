"""The domain's tables over the test data: members are customers, bills are orders, co-sponsors and voters are the
suppliers of an order's lines, slips and actions are events. SQL has the same views for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import dealt

KINDS = {"1": "HR", "2": "SB", "3": "SJR"}
LAST_ACTIONS = {
    "F1": "Resolution Adopted", "F2": "Public Act . . . . . . . . . 104-0001", "F3": "Governor Vetoed; Total Veto Stands", "F4": "Third Reading - Passed; 060-050-001", "F5": "Do Pass / Short Debate Judiciary; 010-005-000",
    "O1": "Referred to Assignments", "O2": "Placed on Calendar Order of 2nd Reading", "O3": "Assigned to Judiciary", "O4": "Sent to the Governor", "O5": "Filed with Secretary",
}
OTHER_ACTION = "Rule 3-9(a) / Re-referred to Assignments"
ACTIONS = {"view": "Assigned to Judiciary Committee", "click": "Do Pass / Short Debate Judiciary; 010-005-000", "purchase": "Third Reading - Passed; 060-050-001", "signup": "Arrive in House", "error": "Rule 19(b) / Re-referred to Rules Committee"}
POSITIONS = {"click": "Proponent", "purchase": "Proponent", "error": "Opponent", "view": "No Position On Merits"}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _case(column, values: dict[str, str], other):
    out = None
    for k, v in values.items():
        out = F.when(column == k, v) if out is None else out.when(column == k, v)
    return out.otherwise(other)


def members(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    c = table(spark, d, "customer").join(F.broadcast(nation), "c_nationkey")  # a fixed table of 25 rows
    return c.select(F.col("c_custkey").alias("member_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("party"), F.when(F.col("n_regionkey") % 2 == 0, "House").otherwise("Senate").alias("chamber"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("district"))


def bills(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    digit = F.substring("o_orderpriority", 1, 1)
    key = F.col("o_orderkey").cast("string")
    number = F.concat(_case(digit, KINDS, F.lit("HB")), F.when(F.length(key) >= 4, key).otherwise(F.lpad(key, 4, "0")))
    text = F.when(F.col("o_orderkey") % 7 == 0, "LOCAL GOVERNMENT-TECH").when(F.col("o_orderkey") % 11 == 0, "Technical correction").otherwise(F.concat(F.lit("EDUCATION-"), "o_orderpriority"))
    return o.select(F.col("o_orderkey").alias("bill_id"), number.alias("bill_number"), text.alias("description"), _case(F.concat("o_orderstatus", digit), LAST_ACTIONS, OTHER_ACTION).alias("last_action"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_custkey").alias("member_id"), F.col("o_totalprice").alias("price"))


def sponsors(spark: SparkSession, d: str) -> DataFrame:
    chief = table(spark, d, "orders").select(F.col("o_orderkey").alias("bill_id"), F.col("o_custkey").alias("member_id"), F.lit("PRIMARY").alias("role"))
    co = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("bill_id"), F.col("l_suppkey").alias("member_id"), F.lit("CO").alias("role"))
    return chief.unionByName(dealt(co, "bill_id").distinct())


def casts(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("event_id"), F.col("l_suppkey").alias("member_id")).agg(F.min("l_returnflag").alias("flag"))
    b = table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), F.when(F.col("o_orderstatus") == "F", "floor").otherwise("committee").alias("vote_type"), F.col("o_orderdate").cast("date").alias("date"), (F.col("o_orderkey") % 500).alias("bill_id"))
    m = members(spark, d).select("member_id", "party", "chamber")
    vote = F.when(F.col("flag") == "R", "Y").when(F.col("flag") == "A", "N").otherwise("P")
    return v.join(b, "event_id").join(m, "member_id").select("event_id", "bill_id", "vote_type", "date", "member_id", "party", "chamber", vote.alias("vote"))


def slips(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    bill = F.col("event_id") % 300
    return e.select(
        F.col("event_id").alias("slip_id"), bill.alias("bill_id"), F.concat(F.lit("Person "), (F.col("event_id") * 7 % 90).cast("string")).alias("name"), F.concat(F.lit("Org "), (F.col("user_id") % 20).cast("string")).alias("organization"),
        _case(F.col("event_type"), POSITIONS, "No Position").alias("position"), F.when(F.col("value") > 20, "Written Statement").otherwise("Oral").alias("testimony"),
    )


def actions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("bill_id"), F.col("ts").cast("date").alias("day"), F.col("event_id").alias("ord"), _case(F.col("event_type"), ACTIONS, "Filed with Secretary").alias("action"), "event_type", "ts", "value")


def _sql_case(column: str, values: dict[str, str], other: str) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then '{v}'" for k, v in values.items()) + f" else '{other}' end"


SQL = {
    "members": "select c_custkey member_id, c_name name, c_mktsegment party, case when n_regionkey % 2 = 0 then 'House' else 'Senate' end chamber, c_acctbal balance, c_nationkey district from customer join nation on n_nationkey = c_nationkey",
    "bills": f"""select o_orderkey bill_id, ({_sql_case("substr(o_orderpriority,1,1)", KINDS, "HB")}) || case when length(o_orderkey::varchar) >= 4 then o_orderkey::varchar else lpad(o_orderkey::varchar, 4, '0') end bill_number,
 case when o_orderkey % 7 = 0 then 'LOCAL GOVERNMENT-TECH' when o_orderkey % 11 = 0 then 'Technical correction' else 'EDUCATION-' || o_orderpriority end description,
 {_sql_case("o_orderstatus || substr(o_orderpriority,1,1)", LAST_ACTIONS, OTHER_ACTION)} last_action, o_orderdate::date as day, o_custkey member_id, o_totalprice price from orders""",
    "sponsors": "select o_orderkey bill_id, o_custkey member_id, 'PRIMARY' as role from orders union all select distinct l_orderkey, l_suppkey, 'CO' from lineitem",
    "casts": """select v.event_id, o_orderkey % 500 bill_id, case when o_orderstatus = 'F' then 'floor' else 'committee' end vote_type, o_orderdate::date as date, v.member_id, m.party, m.chamber, case flag when 'R' then 'Y' when 'A' then 'N' else 'P' end vote
 from (select l_orderkey event_id, l_suppkey member_id, min(l_returnflag) flag from lineitem group by all) v join orders on o_orderkey = v.event_id join members m on m.member_id = v.member_id""",
    "slips": f"""select event_id slip_id, event_id % 300 bill_id, 'Person ' || (event_id * 7 % 90)::varchar as name, 'Org ' || (user_id % 20)::varchar organization, {_sql_case("event_type", POSITIONS, "No Position")} as position,
 case when value > 20 then 'Written Statement' else 'Oral' end testimony from events""",
    "actions": f"select user_id bill_id, ts::date as day, event_id ord, {_sql_case('event_type', ACTIONS, 'Filed with Secretary')} as action, event_type, ts, value from events",
    "facts": """select *, case when contains(last_action,'Public Act') or contains(last_action,'Adopted Both Houses') or contains(last_action,'Resolution Adopted') or contains(last_action,'Appointment Confirmed') or contains(last_action,'Signed by Governor') then 'passed'
  when contains(last_action,'Veto') then 'vetoed' when contains(last_action,'Referred to Assignments') or contains(last_action,'Re-referred') or contains(last_action,'Rule 3-9') or contains(last_action,'Rule 19') then 'stuck' else 'in_progress' end status,
 case when contains(last_action,'Public Act') or contains(last_action,'Signed by Governor') then 6 when contains(last_action,'Sent to the Governor') or contains(last_action,'Resolution Adopted') or contains(last_action,'Both Houses') then 5
  when contains(last_action,'Third Reading - Passed') then 4 when contains(last_action,'Do Pass') then 2 when contains(last_action,'Second Reading') or contains(last_action,'Placed on Calendar') or contains(last_action,'Third Reading') then 3
  when contains(last_action,'Referred to') or contains(last_action,'Assigned to') or contains(last_action,'Re-referred') then 1 else 0 end depth,
 regexp_matches(upper(bill_number), '^(HB|SB)') and not (contains(upper(description),'TECHNICAL') or contains(upper(description),'SHELL') or suffix(upper(description),'-TECH')) is_law, not regexp_matches(upper(bill_number), '^(HB|SB)') is_resolution from bills""",
}
NEEDS = {"facts": ["bills"], "casts": ["members"]}


def with_views(*names: str) -> str:
    """WITH and the views by name, those they need first."""
    order: list[str] = []

    def add(n: str) -> None:
        for x in NEEDS.get(n, []):
            add(x)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "with " + ",\n".join(f"{n} as ({SQL[n]})" for n in order)
