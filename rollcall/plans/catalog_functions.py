"""Column functions and small operators bound to the test tables, each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import actions as act
from ..functions import classify as c
from ..functions import dates, text
from ..operators import asof, metrics, relational, resolve, search, votes
from ..sources import readers, sinks
from ..sources.scratch import work_path
from . import views
from .bindings import bills, casts, members, table
from .catalog import query


def one_of(column, *values: str):
    """values[column % n], to make texts from numbers."""
    return F.get(F.array(*map(F.lit, values)), F.pmod(column, F.lit(len(values))).cast("int"))


def sql_one_of(column: str, *values: str) -> str:
    return "(case " + " ".join(f"when {column} % {len(values)} = {i} then '{v}'" for i, v in enumerate(values)) + " end)"


# Classes ------------------------------------------------------------------------------------------------------------------
ROLES = ("Majority Leader", "Deputy Whip", "Member", "Speaker of the House", "  Caucus Chair ", "Chairperson")


@query(f"select c_custkey, {sql_one_of('c_custkey', 'true', 'true', 'false', 'true', 'true', 'false')}::boolean leads from customer")
def a5_leadership(s, d):
    return table(s, d, "customer").select("c_custkey", c.is_leadership(one_of(F.col("c_custkey"), *ROLES)).alias("leads"))


@query("select c_custkey, case when c_acctbal / 100 >= 60 then 'High' when c_acctbal / 100 >= 30 then 'Moderate' else 'Low' end label from customer")
def a24_influence_label(s, d):
    return table(s, d, "customer").select("c_custkey", c.influence_label(F.col("c_acctbal") / 100).alias("label"))


@query("""with k as (select c_custkey, (c_custkey % 101) / 100.0::double auc, (c_custkey % 11) / 10.0::double f1, c_custkey % 90 support from customer)
 select c_custkey, case when auc >= 0.8 and ((auc < 0.8)::int + (support < 50)::int + (f1 > 0 and f1 < 0.5)::int) <= 1 then 'RELIABLE' when auc >= 0.7 then 'MODERATE' else 'USE WITH CAUTION' end trust,
 case when auc >= 0.6 then 'High' when auc >= 0.35 then 'Medium' else 'Low' end confidence from k""")
def a28_trust(s, d):
    k, auc = F.col("c_custkey"), F.col("c_custkey") % 101 / 100.0
    return table(s, d, "customer").select("c_custkey", c.trust(auc, k % 11 / 10.0, k % 90).alias("trust"), c.forecast_confidence(auc).alias("confidence"))


@query(f"""with k as (select c_custkey, c_custkey % 13 a, c_custkey % 7 b from customer)
 select c_custkey, {sql_one_of('c_custkey', 'D', 'R', 'I', 'D')} party, case when a + b = 0 then 'None' when least(a, b) / (a + b)::double >= 0.3 then 'Strong' when least(a, b) / (a + b)::double >= 0.15 then 'Moderate' when least(a, b) > 0 then 'Low' else 'None' end label from k""")
def a31_party_labels(s, d):
    k = F.col("c_custkey")
    return table(s, d, "customer").select("c_custkey", c.party_code(one_of(k, "Democrat", "Republican Party", "independent", "DEMOCRATIC")).alias("party"), c.bipartisan_label(k % 13, k % 7).alias("label"))


@query(f"select c_custkey, {sql_one_of('c_custkey', 'true', 'true', 'false', 'true', 'false')}::boolean procedural from customer")
def a32_procedural(s, d):
    return table(s, d, "customer").select("c_custkey", c.is_procedural(one_of(F.col("c_custkey"), "Assignments", " rules committee ", "Education", "EXECUTIVE", "Rules of Law")).alias("procedural"))


@query(f"select c_custkey, {sql_one_of('c_custkey', 'Bipartisan', 'Slip Count', 'Days Since Action', 'Chief Sponsor Rate')} shown from customer")
def a33_humanize(s, d):
    return table(s, d, "customer").select("c_custkey", c.humanize(one_of(F.col("c_custkey"), "is_bipartisan", "n_slip_count", "days_since_action", "has_chief_sponsor_rate")).alias("shown"))


@query("select bill_id, case when b.bill_id is null then 'Unknown' else status end status from facts b", "facts")
def a35_status_labels(s, d):
    return metrics.bill_facts(bills(s, d)).select("bill_id", F.coalesce("status", F.lit("Unknown")).alias("status"))


# Dates and names ----------------------------------------------------------------------------------------------------------
WRITTEN = "case o_orderkey % 5 when 0 then strftime(o_orderdate::date, '%-m/%-d/%Y') when 1 then strftime(o_orderdate::date, '%B %-d, %Y') when 2 then strftime(o_orderdate::date, '%Y-%m-%d') when 3 then 'no date' end"


def _written():
    k, day = F.col("o_orderkey") % 5, F.col("o_orderdate").cast("date")
    return F.when(k == 0, F.date_format(day, "M/d/yyyy")).when(k == 1, F.date_format(day, "MMMM d, yyyy")).when(k == 2, F.date_format(day, "yyyy-MM-dd")).when(k == 3, "no date")


@query("select o_orderkey, case o_orderkey % 5 when 3 then 'no date' when 4 then '' else strftime(o_orderdate::date, '%Y-%m-%d') end iso from orders")
def c6_normalized_dates(s, d):
    return table(s, d, "orders").select("o_orderkey", dates.iso_or_same(_written()).alias("iso"))


@query(f"select c_custkey, {sql_one_of('c_custkey', 'S', 'H', 'J', 'S', 'H', 'Congress')} code from customer")
def c7_chamber_codes(s, d):
    return table(s, d, "customer").select("c_custkey", dates.chamber_code(one_of(F.col("c_custkey"), "Senate", "HOUSE", " joint ", "s", "h", " Congress ")).alias("code"))


@query("select o_orderkey, case when o_orderkey % 5 >= 3 then date '9999-12-31' else o_orderdate::date end as day from orders")
def c8_date_keys(s, d):
    return table(s, d, "orders").select("o_orderkey", dates.date_or_last(_written()).alias("day"))


@query("select c_custkey, 'Mary A.' as first, 'Jones' || c_custkey::varchar as last, case c_custkey % 3 when 0 then 'Jr.' when 1 then 'III' else '' end suffix from customer")
def c10_member_names(s, d):
    k = F.col("c_custkey")
    name = F.concat(F.lit("Mary  A. Jones"), k.cast("string"), F.when(k % 3 == 0, ", Jr.").when(k % 3 == 1, " III").otherwise(""))
    parts = text.member_name_parts(name)
    return table(s, d, "customer").select("c_custkey", parts["first"].alias("first"), parts["last"].alias("last"), parts["suffix"].alias("suffix"))


@query("select c_custkey, 'Jones' || c_custkey::varchar as last, case when c_custkey % 4 = 0 then '' else 'Mary A.' end as first, case when c_custkey % 4 = 3 then 'Jr.' else '' end suffix from customer")
def c11_vote_names(s, d):
    k = F.col("c_custkey")
    name = F.concat(F.lit("Jones"), k.cast("string"), F.when(k % 4 == 0, "").when(k % 4 == 3, ", Mary A., Jr.").otherwise(", Mary A."))
    parts = text.vote_name_parts(name)
    return table(s, d, "customer").select("c_custkey", parts["last"].alias("last"), parts["first"].alias("first"), parts["suffix"].alias("suffix"))


@query("select c_custkey, case when c_custkey % 2 = 0 then 'M' else '' end as initial, 'Jones' || c_custkey::varchar as last from customer")
def c12_seat_names(s, d):
    k = F.col("c_custkey")
    parts = text.seat_name_parts(F.concat(F.when(k % 2 == 0, "M. ").otherwise(""), F.lit("Jones"), k.cast("string")))
    return table(s, d, "customer").select("c_custkey", parts["initial"].alias("initial"), parts["last"].alias("last"))


@query(f"select c_custkey, {sql_one_of('c_custkey', 'o-neil', 'van dam', 'jones', 'smith')} as last from customer")
def c13_last_names(s, d):
    return table(s, d, "customer").select("c_custkey", text.last_name(one_of(F.col("c_custkey"), "O-Neil, Mary", "Van Dam, P.", "Mary A. Jones", " Ann SMITH ")).alias("last"))


@query(f"select c_custkey, {sql_one_of('c_custkey', 'ab cd e', 'x y')} as key from customer")
def c32_seat_keys(s, d):
    return table(s, d, "customer").select("c_custkey", text.seat_key(one_of(F.col("c_custkey"), "AB-CD.  E", "X-Y")).alias("key"))


@query("select date_diff('day', o_orderdate::date, date '1999-01-01')::int age, o_orderkey from orders")
def c19_age(s, d):
    return table(s, d, "orders").select("o_orderkey", dates.age_days(F.col("o_orderdate").cast("date"), F.lit("1999-01-01").cast("date")).alias("age"))


@query("select event_id, case when event_id % 9 = 0 then 'infinity'::double else round((epoch(timestamp '2030-01-01') - floor(epoch(ts))) / 3600.0, 6) end as hours from events")
def c27_hours_since(s, d):
    e = table(s, d, "events")
    never = F.coalesce(F.col("event_id") % 9 == 0, F.lit(False))
    stamp = F.when(~never, dates.instant(F.col("ts"), dict(e.dtypes)["ts"]))
    hours = F.when(never | F.col("ts").isNotNull(), dates.hours_since(stamp, F.lit("2030-01-01T00:00:00Z").cast("timestamp")))
    return e.select("event_id", F.round(hours, 6).alias("hours"))


@query("select c_custkey, case when c_custkey % 3 = 2 then '' else (c_custkey % 120)::varchar end district from customer")
def c24_districts(s, d):
    k = F.col("c_custkey")
    return table(s, d, "customer").select("c_custkey", text.district_of_geoid(F.when(k % 3 == 2, "17ZZZ").otherwise(F.concat(F.lit("17"), F.lpad((k % 120).cast("string"), 3, "0")))).alias("district"))


@query("select o_orderkey, 'HB' || lpad((o_orderkey % 10000)::varchar, 4, '0') as number, 'https://x.org/Legislation/BillStatus/Votes?DocNum=' || (o_orderkey % 10000)::varchar || '&DocTypeID=hb' as votes from orders")
def c25_addresses(s, d):
    url = F.concat(F.lit("https://x.org/Legislation/BillStatus?DocNum="), (F.col("o_orderkey") % 10000).cast("string"), F.lit("&DocTypeID=hb"))
    return table(s, d, "orders").select("o_orderkey", text.url_number(url).alias("number"), text.tab_url(url, "Votes").alias("votes"))


@query("select o_orderkey, case o_orderkey % 3 when 0 then 'Local - Government' when 1 then 'Schools' else 'alone' end description from orders")
def c26_labels(s, d):
    return table(s, d, "orders").select("o_orderkey", text.label_description(one_of(F.col("o_orderkey"), "HB1 - Local - Government - Third Reading", "SB2 - Schools - Filed", "alone")).alias("description"))


@query("select o_orderkey, case when o_orderkey % 4 = 0 then 0 else (o_orderkey % 100000)::int end n, case when o_orderkey % 4 = 0 then 'HR' else 'SB' end kind from orders")
def c33_number_parts(s, d):
    k = F.col("o_orderkey")
    number = F.when(k % 4 == 0, F.lit("hr-none")).otherwise(F.concat(F.lit("sb"), (k % 100000).cast("string"), F.lit(" ")))
    return table(s, d, "orders").select("o_orderkey", text.numeric_suffix(number).alias("n"), text.number_kind(number).alias("kind"))


@query("select doc_id, case when strpos(lower(text), 'licensed') > 0 then (case when strpos(lower(text), 'licensed') - 80 > 1 then '...' else '' end) || substr(text, greatest(strpos(lower(text), 'licensed') - 80, 1), least(strpos(lower(text), 'licensed') + 88, length(text) + 1) - greatest(strpos(lower(text), 'licensed') - 80, 1)) || (case when strpos(lower(text), 'licensed') + 88 <= length(text) then '...' else '' end) else substr(text, 1, 160) || (case when length(text) > 160 then '...' else '' end) end snippet from documents")
def c15_snippets(s, d):
    return table(s, d, "documents").select("doc_id", text.snippet(F.col("text"), "Licensed").alias("snippet"))


@query("select c_custkey, round((0.4 * (c_custkey % 10) / 10.0 + 0.2 * (c_custkey % 7) / 10.0 + 0.2 * (c_custkey % 5) / 10.0 + 0.2 * (c_custkey % 3) / 10.0) * 100, 1)::double score from customer")
def c22_influence_score(s, d):
    k = F.col("c_custkey")
    rows = table(s, d, "customer").select("c_custkey", *((k % n / 10.0).alias(name) for n, name in ((10, "moneyball"), (7, "betweenness"), (5, "pivotality"), (3, "pull"))))
    return rows.select("c_custkey", F.round(metrics.weighted(metrics.INFLUENCE, 4), 1).alias("score"))


# Lookups, orders, joins -----------------------------------------------------------------------------------------------------
@query("select event_id, member_id, vote from casts where bill_id = 42", "casts")
def f4_votes_of_bill(s, d):
    return relational.lookup(casts(s, d), "bill_id", 42).select("event_id", "member_id", "vote")


@query("select bill_id, status, depth::int depth from facts where bill_id = 7", "facts")
def f19_one_bill(s, d):
    return relational.lookup(metrics.bill_facts(bills(s, d)), "bill_id", 7).select("bill_id", "status", F.col("depth").cast("int").alias("depth"))


@query("select p_partkey, p_name from part where p_partkey in (select l_partkey from lineitem where l_quantity >= 50)")
def p2_by_key(s, d):
    """The parts of large orders, whose keys repeat."""
    keys = table(s, d, "lineitem").where("l_quantity >= 50").select(F.col("l_partkey").alias("p_partkey"))
    return relational.by_key(table(s, d, "part"), keys, "p_partkey").select("p_partkey", "p_name")


@query("select kind, id, field, score, snippet from (select 'supplier' kind, s_suppkey::varchar id, case when lower(s_name) = 'supplier#000000003' then 'name' when lower(s_name) like '%supplier#000000003%' then 'name' end as field, case when lower(s_name) = 'supplier#000000003' then 0.95 else 0.6 end::double score, s_name snippet from supplier) where field is not null")
def f17_search(s, d):
    return search.search_all("Supplier#000000003", {"supplier": (table(s, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name")), "key", (("name", 0.95, 0.80, 0.60),))})


@query("select o_orderkey, (i - 1)::int as ord, n_nationkey, n_name from (select o_orderkey, unnest([o_orderkey % 25, 99, o_orderkey % 7]) id, unnest([1, 2, 3]) i from orders) join nation on n_nationkey = id")
def j2_hydrated(s, d):
    k = F.col("o_orderkey")
    arrays = table(s, d, "orders").select("o_orderkey", F.array((k % 25).cast("long"), F.lit(99).cast("long"), (k % 7).cast("long")).alias("ids"))
    return relational.hydrate(arrays, "ids", table(s, d, "nation"), "n_nationkey").select("o_orderkey", "ord", "n_nationkey", "n_name")


@query("select o_orderkey::varchar bill_id, unnest([o_custkey::varchar, 's' || (o_orderkey % 9)::varchar, 'h' || (o_orderkey % 4)::varchar]) member_id, unnest([0, 1, 2])::int as ord, unnest(['PRIMARY', 'CO', 'CO']) as role from orders")
def j3_sponsorships(s, d):
    k = F.col("o_orderkey")
    rows = table(s, d, "orders").select(k.cast("string").alias("id"), F.array(F.col("o_custkey").cast("string"), F.concat(F.lit("s"), (k % 9).cast("string"))).alias("senate"), F.array(F.concat(F.lit("h"), (k % 4).cast("string"))).alias("house"))
    return relational.sponsorships(rows, "id", "senate", "house").select("bill_id", "member_id", "ord", "role")


@query("select user_id, count(*) filter (ts::date <= d + 10)::bigint n, count(*) filter (ts::date <= d + 10 and event_type = 'view')::bigint viewed from events join (select user_id, min(ts)::date d from events group by 1) using (user_id) group by 1")
def j9_early_actions(s, d):
    e = table(s, d, "events")
    start = e.groupBy("user_id").agg(F.min("ts").alias("start"))
    return asof.early_actions(e.select("user_id", F.col("ts").alias("at"), "event_type"), start, "user_id", "start", "at", 10, n=F.lit(True), viewed=F.col("event_type") == "view")


@query("select c_custkey, round(case when (select max(c_acctbal) from customer) > 0 then least(c_acctbal / (select max(c_acctbal) from customer), 1.0) else 0 end, 9) share from customer")
def g17_share_of_greatest(s, d):
    return metrics.max_share(table(s, d, "customer"), "c_acctbal", "share").select("c_custkey", F.round("share", 9).alias("share"))


@query("with r as (select event_type task, 'p' || (user_id % 8)::varchar phase, avg(value) x, count(*) runs from events group by all) select task, phase, round(x, 6) as seconds, runs from (select *, row_number() over (partition by task order by x desc, phase) r from r) where r <= 5")
def g30_phase_means(s, d):
    e = table(s, d, "events")
    phase = F.struct(F.concat(F.lit("p"), (F.col("user_id") % 8).cast("string")).alias("name"), F.col("value").alias("seconds"))
    return readers.phase_means(e.select(F.col("event_type").alias("task"), F.array(phase).alias("phases"))).select("task", "phase", F.round("seconds", 6).alias("seconds"), "runs")


@query("select o_custkey, arg_min(o_orderkey, (-o_totalprice, o_orderkey)) best from orders group by 1")
def w14_first_of_the_greatest(s, d):
    return relational.latest_rows(table(s, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", F.col("o_orderkey").alias("best"))


@query("select c_custkey, row_number() over (order by c_mktsegment, c_acctbal desc nulls last, c_custkey)::int as place from customer")
def o1_places_in_order(s, d):
    rows = relational.numbered(table(s, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), [F.col("c_mktsegment"), F.desc_nulls_last("c_acctbal"), F.col("c_custkey")], "place")
    return rows.select("c_custkey", (F.col("place") + 1).cast("int").alias("place"))


@query("select c_custkey as key, c_name as name from customer union all select s_suppkey, s_name from supplier")
def o2_union(s, d):
    return relational.relaxed_union(table(s, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name")), table(s, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name")))


@query("select l_orderkey event_id, (count(*) filter (l_returnflag = 'R') = count(*) filter (l_returnflag <> 'A')) tally_ok from lineitem group by 1")
def s14_tally_check(s, d):
    n = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("event_id")).agg(F.collect_list(F.when(F.col("l_returnflag") == "R", F.col("l_suppkey"))).alias("yea_votes"), F.collect_list(F.when(F.col("l_returnflag") == "A", F.col("l_suppkey"))).alias("nay_votes"), F.count_if(F.col("l_returnflag") != "A").alias("printed_yeas"), F.count_if(F.col("l_returnflag") == "A").alias("printed_nays"))
    return votes.tally_matches(n).select("event_id", "tally_ok")


@query("select 'X' chamber, 'Unknown' || (member_id % 7)::varchar as name, count(*) n from casts group by all", "casts")
def e5_unresolved_names(s, d):
    rows = casts(s, d).select(F.lit("X").alias("chamber"), F.concat(F.lit("Unknown"), (F.col("member_id") % 7).cast("string")).alias("name"))
    resolved = rows.distinct().select("chamber", "name", F.lit(None).cast("long").alias("member_id"), F.lit("unresolved").alias("method"))
    return resolve.unresolved_queue(rows, resolved)


@query("select event_id, m.member_id, 'exact' as resolution_method, m.name member_name from casts c join members m using (member_id)", "casts")
def e4_applied_resolution(s, d):
    m = members(s, d).select("member_id", "chamber", "name")
    rows = casts(s, d).select("event_id", "member_id").join(m, "member_id").select("event_id", "chamber", "name")
    return resolve.apply_resolution(rows, m.withColumn("method", F.lit("exact")), m).select("event_id", "member_id", "resolution_method", "member_name")


@query("select o_orderkey, case when o_orderstatus = 'F' then 'EXACT' || o_orderkey::varchar end description from orders")
def v11_described_bills(s, d):
    """Finished orders are described; every second number is written without its zero."""
    k = F.col("o_orderkey")
    known = table(s, d, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("HB0"), k.cast("string")).alias("bill_number"), F.concat(F.lit("EXACT"), k.cast("string")).alias("description"))
    asked = table(s, d, "orders").select("o_orderkey", F.concat(F.when(k % 2 == 0, "HB0").otherwise("HB"), k.cast("string")).alias("number"))
    out = views.describe_bill(asked.select("number"), known, F.regexp_replace("number", "^HB0?", "HB"), F.regexp_replace("bill_number", "^HB0", "HB"))
    return asked.join(out, "number").select("o_orderkey", "description")


# Sources and sinks --------------------------------------------------------------------------------------------------------
@query("select n_nationkey, n_name, n_regionkey from nation")
def s1_json_array(s, d):
    """Written as one JSON array (the table has 25 rows) and read again."""
    path = work_path(s, "json-array")
    n = table(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    n.agg(F.to_json(F.collect_list(F.struct("*"))).alias("value")).write.text(path)
    return readers.json_array(s, f"{path}-absent", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in n.schema), fallback=path)


@query("select n_nationkey::varchar code, n_name from nation")
def s2_json_object(s, d):
    path = work_path(s, "json-object")
    n = table(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("k"), F.struct("n_name").alias("v"))
    n.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("k", "v")))).alias("value")).write.text(path)
    return readers.json_map(s, path, "code string, n_name string", "code")


@query("select p_partkey, p_name, p_retailprice from part")
def k1_parquet_tables(s, d):
    path = work_path(s, "tables")
    for _ in range(2):  # the second one overwrites
        sinks.tables({"part": table(s, d, "part").select("p_partkey", "p_name", "p_retailprice")}, path)
    return s.read.parquet(f"{path}/part")


@query("select p_partkey, i::bigint as reading from part, (values (1), (2)) t(i)")
def k7_appended_json(s, d):
    path = work_path(s, "append")
    for i in (1, 2):
        sinks.append_json(table(s, d, "part").select("p_partkey", F.lit(i).cast("long").alias("reading")), path)
    return s.read.schema("p_partkey long, reading long").json(path)


@query("select vec_id, i::int as dim, round(v::double, 6) as value from (select vec_id, unnest(embedding) v, unnest(range(len(embedding))) i from embeddings)")
def k12_vectors(s, d):
    rows = table(s, d, "embeddings").select("vec_id", "embedding")
    wide = sinks.vectors_wide(rows, "vec_id", "embedding", rows.agg(F.max(F.size("embedding"))).first()[0])
    return sinks.vectors_long(wide, "vec_id").select("vec_id", F.posexplode("vector").alias("dim", "v")).select("vec_id", F.col("dim").cast("int").alias("dim"), F.round(F.col("v").cast("double"), 6).alias("value"))


#: Texts of actions with their category, signal and stage: one of each kind, as pages write them, nulls and odd forms included.
ACTION_TEXTS = (
    ("Filed with the Clerk by Rep. Carol Ammons", "filing", "neutral", "FILED"),
    ("First Reading", "filing", "neutral", "FILED"),
    ("Prefiled with Clerk", "filing", "neutral", "FILED"),
    ("Added as Chief Co-Sponsor Sen. Ann Gill", "sponsorship", "positive_weak", None),
    ("Referred to Rules Committee", "assignment", "neutral", "IN_COMMITTEE"),
    ("Assigned toTransportation", "assignment", "positive_weak", "IN_COMMITTEE"),
    ("Assigned to Health Care Licenses Committee", "assignment", "positive_weak", "IN_COMMITTEE"),
    ("Assignments Refers to Judiciary", "assignment", "neutral", "IN_COMMITTEE"),
    ("Approved for Consideration Assignments", "assignment", "positive", "IN_COMMITTEE"),
    ("ToElections Subcommittee", "assignment", "neutral", "IN_COMMITTEE"),
    ("Do Pass / Short Debate Health Care Licenses Committee; 014-000-000", "committee_action", "positive", "PASSED_COMMITTEE"),
    ("Do Pass Licensed Activities; 007-000-000", "committee_action", "positive", "PASSED_COMMITTEE"),
    ("Be Adopted State Government; 009-000-000", "committee_action", "positive", "PASSED_COMMITTEE"),
    ("Do Not Pass Judiciary; 002-009-000", "committee_action", "negative", "IN_COMMITTEE"),
    ("Do Not Pass as Amended Judiciary", "committee_action", "negative", "IN_COMMITTEE"),
    ("Be Not Adopted Executive", "committee_action", "negative", "IN_COMMITTEE"),
    ("Without Recommendation Executive", "committee_action", "negative_weak", "IN_COMMITTEE"),
    ("Motion Do Pass - Lost Judiciary; 004-006-000", "committee_action", "negative", "IN_COMMITTEE"),
    ("Postponed - Judiciary", "committee_action", "negative_weak", "IN_COMMITTEE"),
    ("Placed on Calendar Order of 2nd Reading", "floor_process", "positive_weak", "FLOOR_VOTE"),
    ("Second Reading - Short Debate", "floor_process", "positive_weak", "FLOOR_VOTE"),
    ("Placed on Calendar Order of Concurrence Senate Amendment(s) 1", "floor_process", "positive_weak", "FLOOR_VOTE"),
    ("Third Reading - Short Debate - Passed 107-000-000", "floor_vote", "positive", "CHAMBER_PASSED"),
    ("Third Reading - Passed; 056-000-000", "floor_vote", "positive", "CHAMBER_PASSED"),
    ("Third Reading - Lost; 020-035-000", "floor_vote", "negative", "FLOOR_VOTE"),
    ("Third Reading - Consideration Postponed", "floor_vote", "negative_weak", "FLOOR_VOTE"),
    ("Arrive in Senate", "cross_chamber", "positive", "CROSSED_CHAMBERS"),
    ("Arrived in House", "cross_chamber", "positive", "CROSSED_CHAMBERS"),
    ("House Concurs", "concurrence", "positive", "PASSED_BOTH"),
    ("Senate Non-Concurs in House Amendment(s)", "concurrence", "negative_weak", None),
    ("Senate Refuses to Recede", "concurrence", "negative_weak", None),
    ("House Recedes", "concurrence", "positive", "PASSED_BOTH"),
    ("Conference Committee Report Submitted", "concurrence", "neutral", None),
    ("Passed Both Houses", "both_passed", "positive", "PASSED_BOTH"),
    ("Adopted Both Houses", "both_passed", "positive_terminal", "PASSED_BOTH"),
    ("Sent to the Governor", "governor", "positive", "GOVERNOR"),
    ("Governor Approved", "enacted", "positive_terminal", "SIGNED"),
    ("Public Act . . . . . . . . . 104-0001", "enacted", "positive_terminal", "SIGNED"),
    ("Governor Vetoed", "veto", "negative_terminal", None),
    ("Total Veto Stands - No Positive Action Taken", "veto", "negative_terminal", None),
    ("Governor Amendatory Veto", "veto", "negative", None),
    ("Governor Item/Reduction Veto PA 103-0006", "veto", "negative_weak", None),
    ("Item/Reduction Veto", "veto", "negative_weak", None),
    ("Override Amendatory Veto - Senate Passed 040-010-000", "veto", "positive", None),
    ("Override Total Veto - House Lost 060-050-000", "veto", "negative", None),
    ("Bill Dead - Amendatory Veto", "veto", "negative_terminal", None),
    ("Rule 19(b) / Re-referred to Rules Committee", "deadline", "negative", None),
    ("Rule 3-9(a) / Re-referred to Assignments", "deadline", "negative_weak", None),
    ("Rule 2-10 Third Reading Deadline Established As May 31", "deadline", "neutral", None),
    ("House Committee Amendment No. 1 Adopted", "amendment", "neutral", None),
    ("Senate Floor Amendment No. 2 Referred to Assignments", "amendment", "neutral", None),
    ("Resolution Adopted", "resolution", "positive_terminal", None),
    ("Session Sine Die", "terminal", "negative", None),
    ("Tabled", "terminal", "negative", None),
    ("Something nobody has seen", "other", "neutral", None),
    ("", "other", "neutral", None),
    ("  ", "other", "neutral", None),
    (None, "other", "neutral", None),
)


def _literal(value: str | None) -> str:
    return "null" if value is None else "'" + value.replace("'", "''") + "'"


_ACTION_ROWS = ", ".join(f"({i}, {', '.join(map(_literal, row))})" for i, row in enumerate(ACTION_TEXTS))


@query(f"select p_partkey, category, signal, stage from part join (values {_ACTION_ROWS}) t(i, action, category, signal, stage) on p_partkey % {len(ACTION_TEXTS)} = i")
def a7_action_texts(s, d):
    """One text of every kind of action, dealt over the parts."""
    texts = F.array(*(F.lit(x).cast("string") for x, *_ in ACTION_TEXTS))
    found = act.classify_action(F.get(texts, (F.col("p_partkey") % len(ACTION_TEXTS)).cast("int")))
    return table(s, d, "part").select("p_partkey", found.alias("c")).select("p_partkey", "c.category", "c.signal", "c.stage")
