"""Every operator bound to the test tables, each with SQL for the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import actions as act
from ..functions import classify as c
from ..functions import dates, text
from ..operators import asof, graph, metrics, ml, ranking, relational, resolve, search, search_index, votes
from ..sources import parsers
from ..sources.scratch import materialize
from .bindings import actions, bills, casts, members, slips, sponsors, table, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, views: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = (with_views(*views.split()) + "\n" if views else "") + sql.strip()
        return f

    return add


# Lookups, filters, pages ------------------------------------------------------------------------------------------------
@query("select member_id, name, chamber from members where name = 'Customer#000000042'", "members")
def f1_member(s, d):
    return relational.lookup(members(s, d), "name", "Customer#000000042").select("member_id", "name", "chamber")


@query("select member_id, name, chamber from members where lower(chamber) = 'senate' order by name, member_id limit 25 offset 10", "members")
def f2_members_page(s, d):
    return relational.page(relational.filters(members(s, d), chamber="SENATE"), [F.col("name"), F.col("member_id")], 10, 25).select("member_id", "name", "chamber")


@query("select bill_id, bill_number, day from bills where day between date '1996-01-01' and date '1996-12-31' order by day desc, bill_id limit 50 offset 20", "bills")
def f8_bills_by_date(s, d):
    rows = relational.between_dates(bills(s, d), "day", "1996-01-01", "12/31/1996")
    return relational.page(rows, [F.desc("day"), F.col("bill_id")], 20, 50).select("bill_id", "bill_number", "day")


@query("select count(*) total, 40 < count(*) has_next, true has_previous from members", "members")
def p1_page_info(s, d):
    return relational.page_info(members(s, d), 20, 20)


@query("select event_id, member_id, vote from casts where vote_type = 'floor' and chamber = 'House'", "casts")
def f6_vote_events(s, d):
    return relational.filters(casts(s, d), vote_type="floor", chamber="house").select("event_id", "member_id", "vote")


@query("select r_regionkey code, list(n_name order by n_name) nations, count(*) n from region join nation on n_regionkey = r_regionkey group by 1")
def f9_committee_with_roster(s, d):
    n = table(s, d, "nation")
    return table(s, d, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey"), "left").groupBy(F.col("r_regionkey").alias("code")).agg(F.array_sort(F.collect_list("n_name")).alias("nations"), F.count("n_name").alias("n"))


SLIP_SQL = """select {key} count(*) slips, count(*) filter (position = 'Proponent') proponents, count(*) filter (position = 'Opponent') opponents, count(*) filter (contains(lower(position), 'no position')) no_position,
 count(*) filter (regexp_matches(testimony, '(?i)record|written')) written, count(distinct organization) organizations,
 round(coalesce(count(*) filter (position = 'Opponent') / nullif(count(*) filter (position in ('Proponent','Opponent')), 0)::double, 0), 4) controversy from slips {where} group by all"""


@query(SLIP_SQL.format(key="bill_id,", where=""), "slips")
def f13_slip_summaries(s, d):
    return metrics.slip_summary(slips(s, d), ["bill_id"])


@query(SLIP_SQL.format(key="bill_id,", where="where bill_id = 17"), "slips")
def f12_slip_summary(s, d):
    return metrics.slip_summary(relational.lookup(slips(s, d), "bill_id", 17), ["bill_id"])


@query("select bill_id, volume, threshold, status = 'passed' passed from (select bill_id, count(*) volume from slips group by 1) v join facts using (bill_id), (select greatest(1, (list(n order by n desc))[least(floor(count(*) * 0.9)::bigint, count(*) - 1) + 1]) threshold from (select bill_id, count(*) n from slips group by 1) join facts using (bill_id)) where volume >= threshold", "slips facts")
def f16_advancement(s, d):
    return metrics.advancement(bills(s, d), slips(s, d).groupBy("bill_id").agg(F.count(F.lit(1)).alias("volume")))


@query("select bill_id, price from bills where price >= 100000 and bill_number like 'HB%' order by price desc, bill_id limit 50", "bills")
def f18_predictions_filtered(s, d):
    rows = relational.filters(bills(s, d).where(F.startswith("bill_number", F.lit("HB"))), min_price=100000.0)
    return relational.page(rows, [F.desc("price"), F.col("bill_id")], 0, 50).select("bill_id", "price")


@query("select party, chamber, count(*) n, list(member_id order by member_id)[1:5] first_five from members group by all", "members")
def f20_voting_coalitions(s, d):
    m = relational.top_n(members(s, d), ["party", "chamber"], [F.col("member_id")], 5)
    n = members(s, d).groupBy("party", "chamber").agg(F.count(F.lit(1)).alias("n"))
    return n.join(m.groupBy("party", "chamber").agg(F.array_sort(F.collect_list("member_id")).alias("first_five")), ["party", "chamber"])


@query("select * from (select o_orderkey, o_orderdate::date as day from orders order by o_orderdate desc, o_orderkey desc limit 20) order by 2, 1")
def f22_last_runs(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(20)
    return o.orderBy("o_orderdate", "o_orderkey").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))


@query("select 'members' as name, count(*) n from customer union all select 'bills', count(*) from orders union all select 'slips', count(*) from events")
def f23_health(s, d):
    one = lambda n, t: table(s, d, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n")
    return one("members", "customer").unionByName(one("bills", "orders")).unionByName(one("slips", "events"))


@query("select o_orderkey, o_orderdate::date as day from (select *, row_number() over (order by o_orderdate, o_orderkey) - 1 as pos from orders) where pos % 10 = 0")
def p3_every_tenth(s, d):
    return relational.every_nth(table(s, d, "orders"), [F.col("o_orderdate"), F.col("o_orderkey")], 10).select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))


@query("select bill_id, bill_number, case when bill_number like 'SB%' then 0 when bill_number like 'HB%' then 1 when bill_number like 'HR%' then 3 when bill_number like 'SJR%' then 4 else 50 end priority from bills", "bills")
def p4_kind_priority(s, d):
    return bills(s, d).select("bill_id", "bill_number", relational.kind_priority(F.col("bill_number")).alias("priority"))


@query("select bill_id, bool_and(starts_with(action, 'Rule 19') or starts_with(action, 'Filed with')) stalled from actions group by 1", "actions")
def p5_stalled(s, d):
    a = actions(s, d).groupBy("bill_id").agg(F.collect_list("action").alias("acts"))
    return a.select("bill_id", relational.is_stalled(F.col("acts")).alias("stalled"))


# Joins and set operations --------------------------------------------------------------------------------------------
@query("select o_orderkey bill_id, o_custkey member_id, 0 ord, 'PRIMARY' as role from orders join customer on c_custkey = o_custkey union all select l_orderkey, l_suppkey, row_number() over (partition by l_orderkey order by l_suppkey)::int, 'CO' from (select distinct l_orderkey, l_suppkey from lineitem)")
def j1_sponsor_bridge(s, d):
    co = table(s, d, "lineitem").select("l_orderkey", "l_suppkey").distinct().groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_suppkey")).alias("house"))
    b = table(s, d, "orders").join(co, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.array("o_custkey").alias("senate"), F.coalesce("house", F.array().cast("array<bigint>")).alias("house"))
    rows = b.select(F.col("o_orderkey").alias("bill_id"), F.posexplode(F.concat("senate", "house")).alias("ord", "member_id"))
    rows = rows.withColumn("role", F.when(F.col("ord") == 0, "PRIMARY").otherwise("CO"))
    return rows.join(table(s, d, "customer").select(F.col("c_custkey").alias("member_id")), "member_id", "left_semi").select("bill_id", "member_id", "ord", "role")


@query("select a.l_suppkey a, b.l_suppkey b, count(*) weight from (select distinct l_orderkey, l_suppkey from lineitem) a join (select distinct l_orderkey, l_suppkey from lineitem) b using (l_orderkey) where a.l_suppkey < b.l_suppkey group by all having count(*) >= 2")
def j4_cosponsor_pairs(s, d):
    return graph.pair_counts(table(s, d, "lineitem"), "l_orderkey", "l_suppkey", least=2)


@query("with d as (select distinct l_orderkey g, l_suppkey n from lineitem), k as (select g from d group by g having count(*) between 2 and 40) select x.n a, y.n b, count(*) weight from d x join d y using (g) join k using (g) where x.n < y.n group by all")
def j5_weighted_pairs_capped(s, d):
    return graph.pair_counts(table(s, d, "lineitem"), "l_orderkey", "l_suppkey", 2, 40)


AGREE = "select x.member_id a, y.member_id b, count(*) shared, count(*) filter (x.vote = y.vote) agreed, count(*) filter (x.vote = y.vote) / count(*)::double weight from casts x join casts y using (event_id) where x.vote in ('Y','N') and y.vote in ('Y','N') and x.member_id < y.member_id group by all having count(*) >= 2"


@query(AGREE, "casts")
def j6_vote_agreement(s, d):
    return graph.agreement(casts(s, d), 2)


@query(f""", ag as ({AGREE}), sp as (select a.l_suppkey a, b.l_suppkey b, count(*)::double bills from (select distinct l_orderkey, l_suppkey from lineitem) a join (select distinct l_orderkey, l_suppkey from lineitem) b using (l_orderkey) where a.l_suppkey < b.l_suppkey group by all),
 j as (select coalesce(ag.a, sp.a) a, coalesce(ag.b, sp.b) b, weight, bills, (select max(bills) from sp) top from ag full join sp on ag.a = sp.a and ag.b = sp.b)
 select a, b, round(case when weight is not null then least(1.0, weight + coalesce(0.2 * bills / top, 0)) else 0.5 + 0.2 * bills / top end, 9) weight from j where weight is not null or bills >= 3""", "casts")
def j7_blended_edges(s, d):
    sp = graph.pair_counts(table(s, d, "lineitem"), "l_orderkey", "l_suppkey")
    return graph.blend(graph.agreement(casts(s, d), 2), sp).select("a", "b", F.round("weight", 9).alias("weight"))


@query("select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def j11_semi_join(s, d):
    keys = table(s, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return relational.by_key(table(s, d, "orders").select("o_orderkey", "o_custkey"), keys, "o_custkey")


@query("select c_custkey o_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')")
def j12_anti_join(s, d):
    return relational.new_rows(table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey")), table(s, d, "orders").where("o_orderstatus = 'F'"), ["o_custkey"])


@query("""with o as (select o_orderkey k, o_orderstatus status, o_totalprice price, o_orderpriority note from orders where o_orderstatus <> 'P'), n as (select o_orderkey k, 'N' status, o_totalprice + 1 price, null::varchar note from orders where o_orderstatus <> 'F')
 select coalesce(n.k, o.k) k, case when n.k is not null then n.status else o.status end status, case when n.k is not null then n.price else o.price end price, coalesce(o.note, n.note) note from o full join n on o.k = n.k""")
def j22_upsert(s, d):
    """Old are the orders that aren't pending, new those that aren't finished: open ones are updated."""
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("note"))
    new = o.where("status <> 'F'").select("k", F.lit("N").alias("status"), (F.col("price") + 1).alias("price"), F.lit(None).cast("string").alias("note"))
    return relational.merge(o.where("status <> 'P'"), new, "k", ["note"])


@query("select l_orderkey k, l_quantity from lineitem where l_returnflag = 'R' union all select o_orderkey, -1.0 from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')")
def j21_fill_missing_groups(s, d):
    """Returned lines, and a row for every order without one."""
    main = table(s, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k"), "l_quantity")
    extra = table(s, d, "orders").select(F.col("o_orderkey").alias("k"), F.lit(-1.0).alias("l_quantity"))
    return resolve.fill_missing_groups(main, extra, "k")


@query("select doc_id, n_name member from documents, nation where contains(lower(text), lower(n_name)) union all select p_partkey, r_name from part, region where contains(lower(p_name), lower(substr(r_name, 1, 3)))")
def j19_name_in_text(s, d):
    n = table(s, d, "nation").select(F.col("n_nationkey").alias("member_id"), F.col("n_name").alias("name"))
    r = table(s, d, "region").select(F.col("r_regionkey").alias("member_id"), F.substring("r_name", 1, 3).alias("name"), "r_name")
    one = resolve.named_in(table(s, d, "documents"), n, "text").select("doc_id", F.col("__n").alias("member"))
    two = resolve.named_in(table(s, d, "part"), r, "p_name").select(F.col("p_partkey").alias("doc_id"), F.col("__n").alias("member"))
    back = r.select(F.col("name").alias("member"), "r_name")
    return one.unionByName(two.join(F.broadcast(back), "member").select("doc_id", F.col("r_name").alias("member")))


@query("select c_custkey id, c_name as name, c_acctbal balance, null::varchar note from customer union all select s_suppkey, s_name, null, 'supplier' from supplier")
def o3_relaxed_union(s, d):
    a = table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    return relational.relaxed_union(a, table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("supplier").alias("note")))


@query("select c_custkey, coalesce(n, 0) n, coalesce(last, date '1900-01-01') as last, (n is null)::int n_missing, (last is null)::int last_missing from customer left join (select o_custkey, count(*) n, max(o_orderdate)::date as last from orders group by 1) on o_custkey = c_custkey")
def o9_fill_with_flags(s, d):
    o = table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.max("o_orderdate").cast("date").alias("last"))
    rows = table(s, d, "customer").select("c_custkey").join(o, "c_custkey", "left")
    out = relational.fill_with_flags(rows.withColumn("last", F.col("last").cast("string")), {"n": 0, "last": "1900-01-01"})
    return out.withColumn("last", F.col("last").cast("date"))


@query()
def o10_balanced_sample(s, d):
    return relational.hash_sample(table(s, d, "labels"), "doc_id", 20, 3, "quality")


@query("select distinct on (c_mktsegment, c_nationkey) c_mktsegment, c_nationkey, c_custkey, c_acctbal from customer order by c_mktsegment, c_nationkey, c_acctbal desc, c_custkey")
def o4_first_per_key(s, d):
    return relational.latest_rows(table(s, d, "customer"), ["c_mktsegment", "c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")]).select("c_mktsegment", "c_nationkey", "c_custkey", "c_acctbal")


# Scorecards and aggregates -------------------------------------------------------------------------------------------
CARD_SQL = """, co as (select distinct bill_id, member_id co_id from sponsors where role = 'CO'),
 reach as (select c.bill_id, count(*) n_co, bool_or(m2.party <> m1.party) crosses from co c join bills b on b.bill_id = c.bill_id join members m1 on m1.member_id = b.member_id join members m2 on m2.member_id = c.co_id where c.co_id <> b.member_id group by 1),
 per as (select f.member_id, count(*) bills, count(*) filter (status = 'passed') passed, count(*) filter (status = 'vetoed') vetoed, count(*) filter (status = 'stuck') stuck, count(*) filter (status = 'in_progress') in_progress,
  count(*) filter (is_law) laws, count(*) filter (is_law and status = 'passed') laws_passed, count(*) filter (is_resolution) resolutions, count(*) filter (is_resolution and status = 'passed') resolutions_passed,
  coalesce(sum(coalesce(n_co, 0)) filter (is_law), 0)::bigint cosponsors, count(*) filter (is_law and coalesce(crosses, false)) bridged, coalesce(sum(depth) filter (is_law), 0)::bigint depth_total
  from facts f join members m using (member_id) left join reach r on r.bill_id = f.bill_id group by 1),
 cards as (select m.member_id, m.name, m.party, m.chamber, coalesce(bills,0) bills, coalesce(passed,0) passed, coalesce(vetoed,0) vetoed, coalesce(stuck,0) stuck, coalesce(in_progress,0) in_progress, coalesce(laws,0) laws, coalesce(laws_passed,0) laws_passed,
  coalesce(resolutions,0) resolutions, coalesce(resolutions_passed,0) resolutions_passed, coalesce(cosponsors,0) cosponsors, coalesce(bridged,0) bridged, coalesce(depth_total,0) depth_total,
  coalesce(passed / nullif(bills, 0)::double, 0) success_rate, coalesce(laws_passed / nullif(laws, 0)::double, 0) law_rate, coalesce(resolutions_passed / nullif(resolutions, 0)::double, 0) resolution_rate,
  coalesce(cosponsors / nullif(laws, 0)::double, 0) magnet, coalesce(bridged / nullif(laws, 0)::double, 0) bridge, coalesce(depth_total / nullif(laws, 0)::double, 0) depth_avg from members m left join per using (member_id))"""


def cards(s: SparkSession, d: str) -> DataFrame:
    return metrics.scorecards(members(s, d).select("member_id", "name", "party", "chamber"), bills(s, d).drop("member_id"), sponsors(s, d))


@query(CARD_SQL + " select *, round(bills * success_rate, 2) effectiveness from cards", "members bills sponsors facts")
def g1_scorecards(s, d):
    return cards(s, d)


MONEY_SQL = CARD_SQL + """, deg as (select member_id, count(distinct peer) degree from (select x.member_id, y.member_id peer from (select distinct bill_id, member_id from sponsors) x join (select distinct bill_id, member_id from sponsors) y using (bill_id) where x.member_id <> y.member_id) group by 1),
 scored as (select c.*, coalesce(degree, 0) / ((select count(*) from members) - 1)::double centrality, case when magnet > 0 then least(magnet / (select max(magnet) from cards), 1.0) else 0.0 end magnet_share, round(depth_avg / 6.0, 4) pipeline from cards c left join deg using (member_id)),
 board as (select member_id, chamber, party, laws, magnet, law_rate, round((0.24 * law_rate + 0.16 * pipeline + 0.16 * magnet_share + 0.12 * bridge + 0.12 * centrality + 0.20 * 0.0) / 1.0 * 100, 2) score from scored)"""


def board(s: SparkSession, d: str) -> DataFrame:
    m = members(s, d).select("member_id")
    edges = graph.pair_counts(sponsors(s, d), "bill_id", "member_id")
    deg = graph.degree_centrality(m, edges, "member_id").select("member_id", "centrality")
    rows = materialize(cards(s, d).join(deg, "member_id"), "board")  # a row per member; scores, maxima and ranks read it often
    return metrics.moneyball(rows.withColumn("institutional", F.lit(0.0)))


@query(MONEY_SQL + " select member_id, chamber, score, row_number() over (order by score desc, member_id)::int rank_overall, row_number() over (partition by chamber order by score desc, member_id)::int rank_chamber from board", "members bills sponsors facts")
def g1_w1_leaderboard(s, d):
    out = ranking.positions(board(s, d).select("member_id", "chamber", "score"), "score", "member_id", {"rank_overall": [], "rank_chamber": ["chamber"]})
    return out.select("member_id", "chamber", "score", "rank_overall", "rank_chamber")


@query(MONEY_SQL + " select member_id, chamber, score from (select *, row_number() over (partition by chamber order by score desc, member_id) r from board) where r = 1", "members bills sponsors facts")
def w2_best_per_chamber(s, d):
    return relational.top_n(board(s, d).select("member_id", "chamber", "score"), ["chamber"], [F.desc("score"), F.col("member_id")], 1)


@query(CARD_SQL + " select member_id, chamber, round(avg(magnet) filter (laws > 0) over (partition by chamber), 6) chamber_avg, case when laws > 0 and avg(magnet) filter (laws > 0) over (partition by chamber) > 0 then round(magnet / avg(magnet) filter (laws > 0) over (partition by chamber), 1) end ratio from cards", "members bills sponsors facts")
def g7_magnet_vs_chamber(s, d):
    out = metrics.group_ratio(cards(s, d), ["chamber"], "magnet", F.col("laws") > 0, "chamber_avg", "ratio")
    return out.select("member_id", "chamber", F.round("chamber_avg", 6).alias("chamber_avg"), "ratio")


@query(CARD_SQL + " select member_id, round(avg(law_rate) filter (laws > 0) over (partition by chamber, party), 6) caucus_avg from cards", "members bills sponsors facts")
def g8_caucus_rate(s, d):
    out = metrics.group_ratio(cards(s, d), ["chamber", "party"], "law_rate", F.col("laws") > 0, "caucus_avg", "ratio")
    return out.select("member_id", F.round("caucus_avg", 6).alias("caucus_avg"))


@query(", r as (select chamber, s.member_id, count(*) filter (status = 'passed') / count(*)::double rate from sponsors s join facts f on f.bill_id = s.bill_id join members m on m.member_id = s.member_id where s.role = 'CO' and is_law group by all) select member_id, rate, median(rate) over (partition by chamber) median_rate, case when median(rate) over (partition by chamber) > 0 then round(rate / median(rate) over (partition by chamber), 1) end multiple from r", "members sponsors facts")
def g9_median_multiplier(s, d):
    f = metrics.bill_facts(bills(s, d)).where("is_law").select("bill_id", "status")
    r = sponsors(s, d).where("role = 'CO'").join(f, "bill_id").join(members(s, d).select("member_id", "chamber"), "member_id").groupBy("chamber", "member_id").agg((F.count_if(F.col("status") == "passed") / F.count(F.lit(1))).alias("rate"))
    return metrics.group_median(r, ["chamber"], "rate", "median_rate", "multiple").select("member_id", "rate", "median_rate", "multiple")


@query(", e as (select distinct x.member_id a, y.member_id b from sponsors x join sponsors y using (bill_id) where x.member_id <> y.member_id) select a member_id, count(*) filter (party like 'B%') b_party, count(*) filter (party not like 'B%') other_party from e join members on members.member_id = b group by 1", "members sponsors")
def g6_collaborators(s, d):
    edges = graph.both_ways(graph.pair_counts(sponsors(s, d), "bill_id", "member_id").select("a", "b"))
    m = members(s, d).withColumn("party", F.when(F.startswith("party", F.lit("B")), "Republican").otherwise("Democrat"))
    return metrics.collaborators(edges, m).select("member_id", F.col("republicans").alias("b_party"), F.col("democrats").alias("other_party"))


@query(", sc as (select bill_id, (depth::double) / 6 prob from facts), r as (select s.*, prob, chamber from sponsors s join sc using (bill_id) join members using (member_id)), base as (select chamber, avg(prob) chamber_avg from r where role = 'PRIMARY' group by 1) select member_id, chamber, count(*) filter (role = 'PRIMARY') sponsored, count(*) filter (role = 'CO') cosponsored, round(avg(prob) filter (role = 'PRIMARY'), 6) sponsored_avg, round(avg(prob) filter (role = 'CO'), 6) cosponsored_avg, round(any_value(chamber_avg), 6) chamber_avg from r join base using (chamber) group by 1, 2", "members sponsors facts")
def g10_sponsor_pull(s, d):
    sc = metrics.bill_facts(bills(s, d)).select("bill_id", (F.col("depth") / 6).alias("prob"))
    out = metrics.sponsor_pull(sponsors(s, d), sc, members(s, d))
    return out.select("member_id", "chamber", "sponsored", "cosponsored", *(F.round(x, 6).alias(x) for x in ("sponsored_avg", "cosponsored_avg", "chamber_avg")))


@query("""select x.code, count(*) total, count(*) filter (depth >= 2) advanced, count(*) filter (status = 'passed') passed, count(*) filter (depth >= 2) / count(*)::double advance_rate, count(*) filter (status = 'passed') / count(*)::double pass_rate
 from (select distinct n_regionkey code, bill_id from sponsors join customer on c_custkey = member_id join nation on n_nationkey = c_nationkey) x join facts using (bill_id) group by 1""", "sponsors facts")
def g2_committee_stats(s, d):
    c_ = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("member_id"), F.col("n_regionkey").alias("code"))
    pairs = sponsors(s, d).join(c_, "member_id").join(bills(s, d).select("bill_id", F.col("bill_number").alias("number")), "bill_id").select("code", "number", "role")
    return metrics.committee_stats(pairs.where("role = 'CO'"), pairs.where("role = 'PRIMARY'"), bills(s, d))


PIVOT_SQL = """, e as (select event_id, count(*) filter (vote = 'Y') y, count(*) filter (vote = 'N') n from casts group by 1), k as (select event_id, abs(y - n) margin, case when y >= n then 'Y' else 'N' end side from e where y + n >= 3 and abs(y - n) <= 1),
 v as (select c.*, margin, vote = side won from casts c join k using (event_id) where vote in ('Y','N'))
 select member_id, count(*) close_votes, count(*) filter (won) winning, count(*) filter (not won) losing, count(*) filter (margin <= 1) swing, count(*) filter (won and vote_type = 'floor') floor_wins, count(*) filter (won and vote_type <> 'floor') committee_wins,
 coalesce(list(event_id order by margin, date, event_id) filter (won), [])[1:20] tightest, round(count(*) filter (won) / count(*)::double, 4) pivotal_rate from v group by 1"""


@query(PIVOT_SQL, "casts")
def g11_pivotality(s, d):
    return votes.pivotality(casts(s, d), margin=1)


@query("select member_id, count(*) votes, count(*) filter (vote_type = 'floor') floor, count(*) filter (vote_type <> 'floor') committee, count(*) filter (vote = 'Y') yes, count(*) filter (vote = 'N') as no, count(*) filter (vote = 'P') present, count(*) filter (vote = 'NV') absent, round(100.0::double * count(*) filter (vote = 'Y') / count(*), 1) yes_percent from casts group by 1", "casts")
def g12_vote_summary(s, d):
    return votes.summaries(casts(s, d), ["member_id"])


@query(", p as (select event_id, party, count(*) filter (vote = 'Y') y, count(*) filter (vote = 'N') n from casts where vote_type = 'floor' group by all), j as (select c.member_id, c.vote = case when y > n then 'Y' else 'N' end ok from casts c join p using (event_id, party) where vote_type = 'floor' and y <> n) select member_id, count(*) total, count(*) filter (ok) aligned, count(*) filter (not ok) defections, count(*) filter (ok) / count(*)::double alignment from j group by 1", "casts")
def g13_party_alignment(s, d):
    return votes.party_alignment(casts(s, d))


@query("select c.member_id, count(*) votes, count(*) filter (vote = 'Y') yes from casts c where bill_id in (select distinct event_id % 300 from events where event_type = 'error') group by 1", "casts")
def g14_category_votes(s, d):
    keys = slips(s, d).where("position = 'Opponent'").select("bill_id").distinct()
    return votes.summaries(relational.by_key(casts(s, d), keys, "bill_id"), ["member_id"]).select("member_id", "votes", "yes")


@query(", n as (select n_nationkey, l_suppkey, count(*) n from lineitem join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey group by all) select n_nationkey, sum(n * n) / (sum(n) * sum(n))::double hhi, max(n) / sum(n)::double top_share from n group by 1".replace(", n as", "with n as", 1))
def g16_concentration(s, d):
    rows = table(s, d, "lineitem").join(table(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_nationkey").alias("n_nationkey"), "l_suppkey")
    return metrics.concentration(rows, ["n_nationkey"], "l_suppkey")


@query(""", o as (select bill_id, organization, count(*) n from slips group by all), h as (select bill_id, sum(n * n) / (sum(n) * sum(n))::double hhi, max(n) / sum(n)::double top_share from o group by 1)
 select bill_id, count(*) total, any_value(hhi) hhi, any_value(top_share) top_share, count(*) / count(distinct name)::double duplication, abs(count(*) filter (position = 'Proponent') - count(*) filter (position = 'Opponent')) / count(*)::double unanimity,
 count(*) filter (testimony like 'Written%') / count(*)::double written_ratio, count(distinct organization) / count(*)::double diversity, count(distinct name) / count(distinct organization)::double names_per_org, round(ln(count(*)), 9) log_total from slips join h using (bill_id) group by 1 having count(*) >= 10""", "slips")
def g18_anomaly_features(s, d):
    return metrics.anomaly_features(slips(s, d), "bill_id").withColumn("log_total", F.round("log_total", 9))


@query(", v as (select bill_id % 5 topic, bill_id, member_id, vote from casts where vote in ('Y','N')), t as (select topic from v group by 1 having count(distinct bill_id) >= 10) select topic, member_id, count(*) votes, count(*) filter (vote = 'Y') yes, count(*) filter (vote = 'Y') / count(*)::double yes_rate from v join t using (topic) group by 1, 2 having count(*) >= 3", "casts")
def g19_topic_rates(s, d):
    topics = bills(s, d).select((F.col("bill_id") % 500).alias("bill_id")).distinct().withColumn("topic", F.col("bill_id") % 5)
    return votes.topic_rates(casts(s, d), topics)


@query(", p as (select party, event_id, greatest(count(*) filter (vote = 'Y'), count(*) filter (vote = 'N')) / count(*)::double x from casts where vote in ('Y','N') group by all) select party, round(avg(x), 9) cohesion, count(*) events from p group by 1", "casts")
def g22_cohesion(s, d):
    return metrics.cohesion(casts(s, d), ["party"]).withColumn("cohesion", F.round("cohesion", 9))


@query("select count(*) filter (n_b = 0) without_b, count(*) filter (n_b = n) only_b, count(*) filter (n_b > 0 and n_b < n) mixed from (select district, count(*) n, count(*) filter (party = 'BUILDING') n_b from members group by 1)", "members")
def g23_bloc_mix(s, d):
    b = members(s, d).groupBy("district").agg(F.bool_or(F.col("party") == "BUILDING").alias("some"), F.bool_or(F.col("party") != "BUILDING").alias("others"))
    return b.agg(F.count_if(~F.col("some")).alias("without_b"), F.count_if(~F.col("others")).alias("only_b"), F.count_if(F.col("some") & F.col("others")).alias("mixed"))


@query("select district coalition_id, count(*) members, round(avg(balance)::decimal(18,6), 2)::double avg_influence, round(max(balance), 2) max_influence, arg_min(member_id, (-balance, member_id)) top_member, arg_min(member_id, (balance, member_id)) bridge_member, count(*) filter (balance >= 60) high from members group by 1", "members")
def g24_coalition_influence(s, d):
    m = members(s, d)
    inf = m.select("member_id", F.col("balance").alias("score"), (-F.col("balance")).alias("betweenness"))
    return metrics.coalition_influence(m.select("member_id", F.col("district").alias("coalition_id")), inf)


@query(", o as (select bill_id, organization, count(*) n, row_number() over (partition by bill_id order by count(*) desc, organization) r from slips group by bill_id, organization) select bill_id, organization, n from o where r <= 3", "slips")
def g25_top_organizations(s, d):
    n = slips(s, d).groupBy("bill_id", c.canonical_organization(F.col("organization")).alias("organization")).agg(F.count(F.lit(1)).alias("n"))
    return relational.top_n(n, ["bill_id"], [F.desc("n"), F.col("organization")], 3)


@query("select p_brand, count(*) total, count(*) filter (l_returnflag = 'R') advanced, count(*) filter (l_returnflag = 'R') / count(*)::double rate from lineitem join part on p_partkey = l_partkey group by 1 having count(*) >= 10 order by rate desc, p_brand limit 10")
def g26_leaderboard(s, d):
    g = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("l_returnflag") == "R").alias("advanced"))
    g = g.where("total >= 10").withColumn("rate", metrics.share(F.col("advanced"), F.col("total")))
    return relational.page(g, [F.desc("rate"), F.col("p_brand")], 0, 10)


@query("select count(*) compared, count(*) filter (quality <> toxic) changed, count(*) filter (quality = 0 and toxic = 1) up, count(*) filter (quality = 1 and toxic = 0) down, count(*) filter (quality <> toxic) / count(*)::double rate from labels")
def g27_churn(s, d):
    lab = table(s, d, "labels")
    return metrics.churn(lab.select("doc_id", F.col("quality").alias("y")), lab.select("doc_id", F.col("toxic").alias("y")), "doc_id", "y")


@query("""with n as (select doc_id % 2 part, count(*) n, count(*) filter (quality = 1 and toxic = 1) tp, count(*) filter (quality <> 1 and toxic = 1) fp, count(*) filter (quality = 1 and toxic <> 1) fn, count(*) filter (quality <> 1 and toxic <> 1) tn from labels group by 1)
 select *, (tp + tn) / n::double accuracy, coalesce(tp / nullif(tp + fp, 0)::double, 0) as precision, coalesce(tp / nullif(tp + fn, 0)::double, 0) recall, coalesce(2.0::double * tp / nullif(2 * tp + fp + fn, 0), 0) f1 from n""")
def g28_confusion(s, d):
    return metrics.confusion(table(s, d, "labels").withColumn("part", F.col("doc_id") % 2), "quality", "toxic", ["part"])


@query("select case when p >= 0.9 then '0.9-1.0' when p >= 0.8 then '0.8-0.9' when p >= 0.7 then '0.7-0.8' when p >= 0.6 then '0.6-0.7' else '0.5-0.6' end bucket, count(*) n from (select 0.5 + l_discount * 4 p from lineitem) group by 1")
def g28_confidence_buckets(s, d):
    return table(s, d, "lineitem").groupBy(metrics.confidence_bucket(0.5 + F.col("l_discount") * 4).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("select regexp_extract(bill_number, '^([A-Za-z]+)', 1) kind, max(regexp_extract(bill_number, '([0-9]+)$', 1)::int) highest from bills group by 1", "bills")
def g29_highest_number(s, d):
    n = F.col("bill_number")
    return bills(s, d).groupBy(text.number_kind(n).alias("kind")).agg(F.max(text.numeric_suffix(n)).alias("highest"))


@query("select event_type, round(avg(value), 6) mean_value, quantile_disc(value, 0.5) p50, quantile_disc(value, 0.9) p90, count(*) n from events group by 1")
def g31_quantiles(s, d):
    out = metrics.quantiles(table(s, d, "events"), ["event_type"], "value")
    return out.select("event_type", F.round("mean", 6).alias("mean_value"), "p50", "p90", "n")


@query("select round(corr(l_quantity, l_extendedprice), 6) r from lineitem")
def g31_correlation(s, d):
    return table(s, d, "lineitem").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"))


@query(", n as (select district, party, count(*) n from members group by all) select district, arg_min(party, (-n, party)) party, max(n) n from n group by 1", "members")
def g32_majority(s, d):
    return metrics.majority(members(s, d), ["district"], "party")


@query("select l_partkey zip, arg_min(l_suppkey, (-l_quantity, l_orderkey, l_linenumber, l_suppkey)) supplier from lineitem group by 1")
def g33_dominant(s, d):
    rows = table(s, d, "lineitem").withColumn("ord", F.struct("l_orderkey", "l_linenumber"))
    return metrics.dominant(rows.withColumnRenamed("l_partkey", "zip"), "zip", "l_suppkey", "l_quantity", "ord").withColumnRenamed("l_suppkey", "supplier")


# Classification, text and dates --------------------------------------------------------------------------------------
@query("select bill_id, status, depth, is_law, is_resolution from facts", "facts")
def a1_a4_bill_class(s, d):
    return metrics.bill_facts(bills(s, d)).select("bill_id", "status", "depth", "is_law", "is_resolution")


@query("select bill_id, ord, case event_type when 'view' then 'assignment' when 'click' then 'committee_action' when 'purchase' then 'floor_vote' when 'signup' then 'cross_chamber' else 'deadline' end category, case event_type when 'view' then 'IN_COMMITTEE' when 'click' then 'PASSED_COMMITTEE' when 'purchase' then 'CHAMBER_PASSED' when 'signup' then 'CROSSED_CHAMBERS' end stage from actions", "actions")
def a7_classify_actions(s, d):
    return actions(s, d).select("bill_id", "ord", act.classify_action(F.col("action")).alias("c")).select("bill_id", "ord", "c.category", "c.stage")


@query(""", x as (select bill_id, day, ord, case event_type when 'view' then 1 when 'click' then 2 when 'purchase' then 4 when 'signup' then 5 else -1 end st, event_type = 'error' back, event_type in ('view','click','purchase','signup') pos from actions),
 l as (select bill_id, list({'st': st, 'back': back} order by day, ord) acts, greatest(0, max(st)) high, count(*) filter (pos) positive_signals, count(*) filter (not pos) negative_signals from x group by 1),
 f as (select bill_id, high, positive_signals, negative_signals, list_reduce(list_prepend({'st': 0, 'back': false}, acts), lambda a, b: {'st': greatest(case when b.back and a.st between 5 and 7 then 1 else a.st end, b.st), 'back': false}).st now from l)
 select bill_id, ['FILED','IN_COMMITTEE','PASSED_COMMITTEE','FLOOR_VOTE','CHAMBER_PASSED','CROSSED_CHAMBERS'][high + 1] highest_stage, ['FILED','IN_COMMITTEE','PASSED_COMMITTEE','FLOOR_VOTE','CHAMBER_PASSED','CROSSED_CHAMBERS'][now + 1] current_stage, positive_signals::int positive_signals, negative_signals::int negative_signals from f""", "actions")
def a12_stage_fold(s, d):
    return act.outcomes(actions(s, d), "bill_id", "day", "ord", "action").select("bill_id", "highest_stage", "current_stage", "positive_signals", "negative_signals")


@query("select bill_id, case when depth = 6 then 'none' when since < 30 then 'NEW' when idle >= 180 then 'STAGNANT' when idle >= 60 then 'SLOW' else 'PENDING' end status from (select bill_id, case when status = 'vetoed' then 6 else 0 end depth, date '2001-08-02' - day since, (date '2001-08-02' - day) // 2 idle from facts where status <> 'vetoed') union all select bill_id, 'DEAD' from facts where status = 'vetoed'", "facts")
def a15_stuck_status(s, d):
    f = metrics.bill_facts(bills(s, d)).withColumn("since", dates.age_days(F.col("day"), F.lit("2001-08-02").cast("date")))
    return f.select("bill_id", c.stuck_status(F.col("status") == "vetoed", F.col("since"), F.floor(F.col("since") / 2)).alias("status"))


@query("select member_id, case when p >= 0.80 then 'Champion' when p >= 0.65 then 'Lean Support' when p >= 0.45 then 'Swing' when p >= 0.25 then 'Lean Oppose' else 'Oppose' end tier from (select member_id, count(*) filter (vote = 'Y') / count(*)::double p from casts group by 1)", "casts")
def a21_loyalty_tier(s, d):
    v = casts(s, d).groupBy("member_id").agg((F.count_if(F.col("vote") == "Y") / F.count(F.lit(1))).alias("p"))
    return v.select("member_id", c.loyalty_tier(F.col("p")).alias("tier"))


@query("select bill_id, upper(regexp_extract(bill_number, '^([A-Za-z]+)0*([0-9]+)', 1)) || regexp_extract(bill_number, '^([A-Za-z]+)0*([0-9]+)', 2) compact, bill_number padded, regexp_extract(bill_number, '([0-9]+)$', 1)::int number from bills", "bills")
def c1_c3_numbers(s, d):
    n = F.col("bill_number")
    return bills(s, d).select("bill_id", text.compact_number(n).alias("compact"), text.padded_number(F.concat(n, F.lit(" (SCA1)"))).alias("padded"), text.number_parts(n)["number"].alias("number"))


@query("select o_orderkey, substr(md5(o_orderkey::varchar || '|' || o_custkey::varchar || '|' || o_orderpriority), 1, 16) as key from orders")
def c4_surrogate_key(s, d):
    return table(s, d, "orders").select("o_orderkey", text.surrogate_key(F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderpriority")).alias("key"))


@query("select o_orderkey, o_orderdate::date::varchar as iso from orders")
def c5_parse_dates(s, d):
    day = F.col("o_orderdate")
    written = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(day, "M/d/yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format(day, "MMMM d, yyyy")).otherwise(F.date_format(day, "yyyy-MM-dd"))
    return table(s, d, "orders").select("o_orderkey", dates.iso_or_same(written).alias("iso"))


@query("select c_custkey, lower(replace(c_name, '#', ' ')) as key, 'customer' as first, regexp_extract(c_name, '#(.*)$', 1) as last from customer")
def c9_names(s, d):
    n = F.replace("c_name", F.lit("#"), F.lit(". "))
    p = text.member_name_parts(n)
    return table(s, d, "customer").select("c_custkey", text.name_key(n).alias("key"), text.name_key(p["first"]).alias("first"), p["last"].alias("last"))


@query("select doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))::int word_count, length(text) > 10000 is_long, length(text) > 0 and length(text) < 500 is_short from documents")
def c17_content_features(s, d):
    f = text.content_features(F.col("text"))
    return table(s, d, "documents").select("doc_id", f["word_count"].alias("word_count"), f["is_long"].alias("is_long"), f["is_short"].alias("is_short"))


@query("select o_orderkey, month(o_orderdate)::int as month, dayofyear(o_orderdate)::int day_of_year, month(o_orderdate) >= 11 or month(o_orderdate) = 1 lame_duck from orders")
def c18_calendar(s, d):
    f = dates.calendar_features(F.col("o_orderdate"))
    return table(s, d, "orders").select("o_orderkey", f["month"].alias("month"), f["day_of_year"].alias("day_of_year"), f["lame_duck"].alias("lame_duck"))


@query("select c_custkey, round(least(c_acctbal / (select max(c_acctbal) from customer), 1.0), 9) share, round((c_acctbal - (select min(c_acctbal) from customer)) / ((select max(c_acctbal) from customer) - (select min(c_acctbal) from customer)), 9) scaled from customer")
def c20_scaling(s, d):
    rows = metrics.min_max(metrics.max_share(table(s, d, "customer"), "c_acctbal", "share"), "c_acctbal", "scaled")
    return rows.select("c_custkey", F.round("share", 9).alias("share"), F.round("scaled", 9).alias("scaled"))


@query("select page_id, regexp_extract(html, '(?i)<title>([^<]*)</title>', 1) title, len(regexp_extract_all(html, '(?i)<p\\b'))::int paragraphs from pages")
def s11_page_parts(s, d):
    return table(s, d, "pages").select("page_id", F.regexp_extract("html", r"(?i)<title>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit(r"(?i)<p\b"), 0)).alias("paragraphs"))


@query("select page_id, len(list_distinct(regexp_extract_all(html, '(?i)href\\s*=\\s*[\"'']([^\"''#]+)', 1)))::int links from pages")
def s11_page_links(s, d):
    p = table(s, d, "pages")
    n = parsers.links(p, "page_id", "html").groupBy("page_id").agg(F.count(F.lit(1)).alias("links"))
    return p.select("page_id").join(n, "page_id", "left").select("page_id", F.coalesce("links", F.lit(0)).cast("int").alias("links"))


# Windows ---------------------------------------------------------------------------------------------------------------
@query("select o_orderkey, coalesce(count(*) over w, 0) filed_before, coalesce(sum((o_orderstatus = 'F')::int) over w, 0)::bigint won_before, coalesce(sum((o_orderstatus = 'F')::int) over w / nullif(count(*) over w, 0)::double, -1) rate_before from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and 1 preceding)")
def w3_prior_rate(s, d):
    out = ranking.history_rate(table(s, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], F.lit(True), F.col("o_orderstatus") == "F")
    return out.select("o_orderkey", "filed_before", "won_before", "rate_before")


@query("select o_orderkey, coalesce(sum((o_orderdate < timestamp '1999-01-01')::int) over w, 0)::bigint filed_before from orders window w as (partition by o_orderpriority order by o_orderdate, o_orderkey rows between unbounded preceding and 1 preceding)")
def w4_committee_history(s, d):
    out = ranking.history_rate(table(s, d, "orders"), ["o_orderpriority"], ["o_orderdate", "o_orderkey"], F.col("o_orderdate") < "1999-01-01", F.lit(True))
    return out.select("o_orderkey", "filed_before")


@query("select user_id, arg_min(event_type, (ts, event_id)) first_type from events group by 1")
def w5_first_event(s, d):
    return relational.latest_rows(table(s, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", F.col("event_type").alias("first_type"))


@query("with r as (select c_custkey, rank() over (order by c_acctbal) + (count(*) over (partition by c_acctbal) - 1) / 2.0::double r, count(*) over () n from customer) select c_custkey, floor((r - 1) / (n - 1) * 100)::int percentile from r")
def w6_rank_percentile(s, d):
    return ranking.average_rank_percentile(table(s, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "percentile").select("c_custkey", "percentile")


@query("select p_brand, p_partkey, p_retailprice from (select *, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) r from part) where r <= 3")
def w7_top_three(s, d):
    return relational.top_n(table(s, d, "part"), ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")], 3).select("p_brand", "p_partkey", "p_retailprice")


@query("with k as (select *, lag(event_type) over (partition by user_id order by ts, event_id) previous from events where event_type in ('click', 'view')) select event_id, user_id, event_type, previous from k where previous <> event_type")
def w8_changes(s, d):
    out = ranking.changes(table(s, d, "events"), ["user_id"], ["ts", "event_id"], "event_type", F.col("event_type").isin("click", "view"))
    return out.select("event_id", "user_id", "event_type", "previous")


@query("select n_nationkey, lag(n_name) over (partition by n_regionkey order by n_nationkey) as \"left\", lead(n_name) over (partition by n_regionkey order by n_nationkey) as \"right\" from nation")
def w10_neighbours(s, d):
    return ranking.neighbours(table(s, d, "nation"), ["n_regionkey"], ["n_nationkey"], "n_name").select("n_nationkey", "left", "right")


@query("select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) <= floor(count(*) over () * 0.7) is_train from orders")
def w11_time_split(s, d):
    return ranking.time_split(table(s, d, "orders"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "is_train")


@query("with k as (select distinct l_orderkey from lineitem), t as (select l_orderkey, row_number() over (order by l_orderkey) <= floor(count(*) over () * 0.7) is_train from k) select is_train, count(*) n from lineitem join t using (l_orderkey) group by 1")
def w12_entity_split(s, d):
    return ranking.entity_split(table(s, d, "lineitem"), "l_orderkey").groupBy("is_train").agg(F.count(F.lit(1)).alias("n"))


@query("select event_id, ts::date as day from events where ts::date in (select distinct ts::date from events order by 1 desc limit 20)")
def w13_retention(s, d):
    e = table(s, d, "events").select("event_id", F.col("ts").cast("date").alias("day"))
    return ranking.retained(e, "day", 20)


# Point in time -----------------------------------------------------------------------------------------------------------
PANEL_SQL = ", st as (select bill_id, min(day) s from actions group by 1), sn as (select bill_id, n snapshot_day, s + n::int snapshot_date from st, (values (3), (7), (14)) t(n) where date '2024-01-31' - (s + n::int) >= 10)"


@query(PANEL_SQL + " select bill_id, snapshot_day, snapshot_date, coalesce(max((day > snapshot_date and event_type = 'purchase')::int), 0) advanced_after from sn left join actions using (bill_id) group by all", "actions")
def o7_panel_labels(s, d):
    a = actions(s, d)
    start = a.groupBy("bill_id").agg(F.min("day").alias("start"))
    return asof.panel(start, a.select("bill_id", "day", "event_type"), "bill_id", "start", "day", (3, 7, 14), "2024-01-31", 10, advanced_after=asof.after(F.col("event_type") == "purchase"))


@query(PANEL_SQL + " select bill_id, snapshot_day, snapshot_date, count(*) filter (day <= snapshot_date) n_facts, count(*) filter (day <= snapshot_date and event_type = 'click') clicks from sn left join actions using (bill_id) group by all", "actions")
def j20_as_of_counts(s, d):
    a = actions(s, d)
    start = a.groupBy("bill_id").agg(F.min("day").alias("start"))
    snaps = asof.snapshots(start, "bill_id", "start", (3, 7, 14)).where("datediff(date'2024-01-31', snapshot_date) >= 10")
    return asof.as_of(snaps, a.select("bill_id", "day", "event_type"), "bill_id", "day", n_facts=asof.known(F.lit(True)), clicks=asof.known(F.col("event_type") == "click"))


@query(PANEL_SQL + " select bill_id, snapshot_day, snapshot_date, count(*) filter (day <= snapshot_date) actions, count(*) filter (day <= snapshot_date and day > snapshot_date - 30) recent, coalesce(snapshot_date - max(day) filter (day <= snapshot_date), -1)::int days_idle, coalesce(max(day) filter (day <= snapshot_date) - min(day) filter (day <= snapshot_date), -1)::int days_active from sn left join actions using (bill_id) group by bill_id, snapshot_day, snapshot_date", "actions")
def m5_staleness(s, d):
    a = actions(s, d)
    start = a.groupBy("bill_id").agg(F.min("day").alias("start"))
    snaps = asof.snapshots(start, "bill_id", "start", (3, 7, 14)).where("datediff(date'2024-01-31', snapshot_date) >= 10")
    return asof.staleness(snaps, a.select("bill_id", "day"), "bill_id", "day")


@query(", st as (select bill_id, min(day) s from actions group by 1) select bill_id, count(*) filter (day - s <= 5) early, count(*) filter (day - s <= 5 and event_type in ('view', 'click')) referrals from actions join st using (bill_id) group by 1", "actions")
def m5_early_actions(s, d):
    a = actions(s, d)
    start = a.groupBy("bill_id").agg(F.min("day").alias("start"))
    return asof.early_actions(a.select("bill_id", "day", "event_type"), start, "bill_id", "start", "day", 5, early=F.lit(True), referrals=F.col("event_type").isin("view", "click"))


# Graph -------------------------------------------------------------------------------------------------------------------
@query("with e as (select distinct a.l_suppkey x, b.l_suppkey y from lineitem a join lineitem b using (l_orderkey) where a.l_suppkey <> b.l_suppkey) select s_suppkey, coalesce(count(y), 0) degree, coalesce(count(y), 0) / ((select count(*) from supplier) - 1)::double centrality from supplier left join e on x = s_suppkey group by 1")
def h2_degree(s, d):
    return graph.degree_centrality(table(s, d, "supplier"), graph.pair_counts(table(s, d, "lineitem"), "l_orderkey", "l_suppkey"), "s_suppkey")


@query()
def h3_betweenness(s, d):
    return graph.betweenness(table(s, d, "supplier").select("s_suppkey"), graph.pair_counts(table(s, d, "lineitem"), "l_orderkey", "l_suppkey"), "s_suppkey")


PEERS = "with d as (select distinct l_orderkey g, l_suppkey n from lineitem), e as (select x.n a, y.n b, count(*) weight from d x join d y using (g) where x.n < y.n group by all), u as (select a, b, weight from e union all select b, a, weight from e), r as (select *, row_number() over (partition by a order by weight desc, b) r from u) "


@query(PEERS + "select distinct least(a, b) a, greatest(a, b) b, weight from r where r <= 8")
def h7_pruned_graph(s, d):
    return graph.top_peers(graph.pair_counts(table(s, d, "lineitem"), "l_orderkey", "l_suppkey"), 8)


@query("with t as (select distinct l_suppkey m, l_orderkey b from lineitem), n as (select distinct m, m + 1 o from t where m + 1 in (select m from t)) select n.m member_id, n.o other_id, (select count(*) from t x join t y using (b) where x.m = n.m and y.m = n.o) / (select count(*) from t where t.m = n.m)::double affinity from n")
def h8_affinity(s, d):
    t = table(s, d, "lineitem").select(F.col("l_suppkey").alias("member_id"), F.col("l_orderkey").alias("bill_id"))
    ids = t.select("member_id").distinct()
    near = ids.join(ids.select((F.col("member_id") - 1).alias("member_id"), F.col("member_id").alias("other_id")), "member_id")
    return graph.affinity(t, near)


@query()
def h5_node_vectors(s, d):
    edges = graph.pair_counts(table(s, d, "lineitem"), "l_orderkey", "l_suppkey", most_size=40)
    return graph.node_vectors(edges, table(s, d, "supplier").select("s_suppkey"), "s_suppkey", dim=64, window=10, per_node=200, length=30)


@query()
def h6_spectral(s, d):
    edges = graph.pair_counts(table(s, d, "lineitem"), "l_orderkey", "l_suppkey")
    return graph.spectral(edges, table(s, d, "supplier").select("s_suppkey"), "s_suppkey")


# Votes -------------------------------------------------------------------------------------------------------------------
@query(""", ev as (select bill_id, event_id, date, vote_type, row_number() over (partition by bill_id order by date, case when vote_type = 'committee' then 0 else 1 end, event_id) seq, count(*) over (partition by bill_id) n_events from (select distinct bill_id, event_id, date, vote_type from casts)),
 c as (select bill_id, seq, n_events, member_id, vote from casts join ev using (bill_id, event_id)), m as (select bill_id, member_id, min(seq) first, max(seq) as last, any_value(n_events) n_events from c group by all),
 g as (select m.bill_id, m.member_id, string_agg(coalesce(c.vote, '--'), ' ' order by ev.seq) codes from m join ev using (bill_id) left join c on c.bill_id = m.bill_id and c.member_id = m.member_id and c.seq = ev.seq group by all)
 select bill_id, member_id, codes, first::int as first, last::int as last, n_events::int n_events, first > 1 newcomer, last < n_events dropped from m join g using (bill_id, member_id)""", "casts")
def t1_timeline(s, d):
    return votes.timeline(casts(s, d).select("bill_id", "event_id", "date", "vote_type", "member_id", "vote"), ["bill_id"]).select("bill_id", "member_id", "codes", "first", "last", "n_events", "newcomer", "dropped")


@query("select c.event_id, c.member_id, c.vote, b.description, case when b.bill_id is null then 'Unknown' else b.status end status from casts c left join facts b on b.bill_id = c.bill_id", "casts facts")
def t2_vote_records(s, d):
    b = metrics.bill_facts(bills(s, d)).select("bill_id", "description", F.col("status").alias("st"))
    return casts(s, d).join(b, "bill_id", "left").select("event_id", "member_id", "vote", "description", F.coalesce("st", F.lit("Unknown")).alias("status"))


@query("select event_id, count(*) filter (vote = 'Y') yeas, count(*) filter (vote = 'N') nays, count(*) filter (vote = 'P') present, count(*) filter (vote = 'NV') absent, case when count(*) filter (vote = 'Y') > count(*) filter (vote = 'N') then 'passed' when count(*) filter (vote = 'Y') < count(*) filter (vote = 'N') then 'lost' else 'tied' end outcome from casts group by 1", "casts")
def t5_outcomes(s, d):
    return votes.tallies(casts(s, d), ["event_id"])


@query("select event_id, member_id, vote from casts", "casts")
def t4_unpivot(s, d):
    lists = casts(s, d).groupBy("event_id").agg(*(F.collect_list(F.when(F.col("vote") == v, F.col("member_id").cast("string"))).alias(k) for k, v in votes.CODES.items()))
    return votes.casts(lists).select("event_id", F.col("name").cast("long").alias("member_id"), "vote")


# Search and names --------------------------------------------------------------------------------------------------------
@query("""with h as (select 'part' kind, p_partkey::varchar id, p_name v from part union all select 'supplier', s_suppkey::varchar, s_name from supplier union all select 'nation', n_nationkey::varchar, n_name from nation),
 k as (select kind, id, case when lower(v) = 'small ring' then 0.95 when starts_with(lower(v), 'small ring') then 0.80 when contains(lower(v), 'small ring') then 0.60 end score, v snippet from h) select kind, id, 'name' as field, score::double score, snippet from k where score is not null""")
def x5_search(s, d):
    t = {n: (table(s, d, n).select(F.col(k).alias("key"), F.col(v).alias("name")), "key", (("name", 0.95, 0.80, 0.60),)) for n, k, v in (("part", "p_partkey", "p_name"), ("supplier", "s_suppkey", "s_name"), ("nation", "n_nationkey", "n_name"))}
    return search.search_all("Small Ring", t)


X3_SQL = "with k as (select doc_id::varchar id, text, strpos(lower(text), 'licensed under') as pos from documents where contains(lower(text), 'licensed under')) select 'document' kind, id, 'text' as field, (case when pos = 1 then 0.42 else 0.40 end)::double score, (case when pos - 80 > 1 then '...' else '' end) || substr(text, greatest(pos - 80, 1), least(pos + 14 + 80, length(text) + 1) - greatest(pos - 80, 1)) || (case when pos + 94 <= length(text) then '...' else '' end) snippet from k"


@query(X3_SQL)
def x3_search_text(s, d):
    return search.search_one(table(s, d, "documents").select("doc_id", "text"), "document", "doc_id", (("text", 0.45, 0.42, 0.40),), "Licensed under")


@query(X3_SQL)
def x3_search_indexed(s, d):
    """The same hits by way of an inverted index."""
    docs = table(s, d, "documents").select("doc_id", "text")
    return search_index.build(docs, "doc_id", (("text", 0.45, 0.42, 0.40),)).search(docs, "document", "Licensed under")



@query("select name, chamber, member_id, 'exact' as method, 1.0::double confidence from members", "members")
def e2_resolve_names(s, d):
    m = members(s, d)
    names = m.select("chamber", F.upper("name").alias("name"))
    return resolve.resolve(names, m).select(F.initcap("name").alias("name"), "chamber", "member_id", "method", "confidence")


@query()
def e3_fuzzy_candidates(s, d):
    sup = table(s, d, "supplier").select(F.col("s_suppkey").alias("member_id"), F.col("s_name").alias("name"), (F.col("s_suppkey") % 10).cast("string").alias("chamber"))
    return resolve.candidates(sup.select("chamber", F.concat("name", F.lit("1")).alias("name")), sup, 5, 50.0).select("chamber", "name", "member_id", "score", "place")


@query("select chamber, count(*) n, count(distinct name) names from members group by 1", "members")
def g35_ambiguity(s, d):
    return members(s, d).groupBy("chamber").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(text.name_key(F.col("name"))).alias("names"))


# Models ------------------------------------------------------------------------------------------------------------------
@query()
def m2_tfidf(s, d):
    """Every weight of 500 terms; the rows of a document have length one."""
    return ml.tfidf(table(s, d, "documents").select("doc_id", "text"), "doc_id", "text", 500)


def _training(s: SparkSession, d: str) -> DataFrame:
    """Three figures of each labelled document, taken before the join, so that no text is shuffled, and written, as models read
    them many times."""
    f = text.content_features(F.col("text"))
    share_of = lambda kept: F.regexp_count("text", F.lit(kept)) / F.greatest(F.length("text"), F.lit(1))
    figures = table(s, d, "documents").select("doc_id", f["log_words"].alias("log_words"), share_of(r"[#*$%&|!]").alias("symbols"), share_of(r"[A-Z]").alias("capitals"))
    rows = figures.join(table(s, d, "labels"), "doc_id").select("doc_id", F.col("quality").cast("double").alias("label"), "log_words", "symbols", "capitals")
    rows = materialize(rows, "training")
    return ml.assemble(rows, ["log_words", "symbols", "capitals"])


@query()
def m6_model_comparison(s, d):
    found = ml.compare(_training(s, d), "label", "doc_id")
    return s.createDataFrame([(k, round(v, 4)) for k, v in found.items()], "model string, auc double")


@query()
def m7_tuned_depth(s, d):
    depth, area = ml.tune(_training(s, d), "label", "doc_id")
    return s.createDataFrame([(depth, round(area, 4))], "depth int, auc double")


@query()
def m8_calibrated_scores(s, d):
    """Out-of-fold probabilities of five folds, and what the isotonic map makes of them."""
    scored = ml.out_of_fold(_training(s, d), "label", "doc_id", ml.models("label")["logistic"], 5)
    mapped = ml.calibrate(scored, "label").transform(scored.withColumn("features", array_to_vector(F.array("prob"))))
    return mapped.select("doc_id", "label", F.round("prob", 6).alias("prob"), F.round("prediction", 6).alias("calibrated"))


@query()
def m14_clusters(s, d):
    _, _, out = ml.clusters(table(s, d, "embeddings"), "vec_id", "embedding")
    return out


@query()
def m15_anomalies(s, d):
    f = metrics.anomaly_features(slips(s, d), "bill_id")
    return ml.flag(ml.isolation_scores(f, "bill_id", ["hhi", "top_share", "duplication", "unanimity", "written_ratio", "diversity", "log_total"]))


@query()
def m18_ridge(s, d):
    rows = cards(s, d).select("member_id", F.col("bills").cast("double").alias("bills"), "magnet", "bridge", "law_rate")
    return ml.ridge_leave_one_out(rows, "member_id", ["bills", "magnet", "bridge"], "law_rate")


@query(MONEY_SQL + ", t as (select member_id, case when party = 'BUILDING' then 'A' else 'B' end topic, score from board) select topic, member_id, score from (select *, row_number() over (partition by topic order by score desc, member_id) r from t) where r <= 30", "members bills sponsors facts")
def m20_recruitment(s, d):
    b = board(s, d).select("member_id", F.when(F.col("party") == "BUILDING", "A").otherwise("B").alias("topic"), "score")
    return relational.top_n(b, ["topic"], [F.desc("score"), F.col("member_id")], 30)


@query(", a as (select bill_id, 0 p, price from facts where status = 'passed' order by price desc, bill_id limit 3), b as (select bill_id, 1 p, price from facts where depth >= 4 order by price desc, bill_id limit 2), z as (select bill_id, 2 p, price from facts order by price desc, bill_id limit 2), u as (select * from a union all select * from b union all select * from z) select bill_id, min(p)::int as list from u group by 1", "facts")
def m22_bills_to_watch(s, d):
    f = metrics.bill_facts(bills(s, d)).select("bill_id", "status", "depth", "price")
    pick = lambda rows, n, p: rows.orderBy(F.desc("price"), "bill_id").limit(n).select("bill_id", F.lit(p).alias("list"))
    rows = pick(f.where("status = 'passed'"), 3, 0).unionByName(pick(f.where("depth >= 4"), 2, 1)).unionByName(pick(f, 2, 2))
    return rows.groupBy("bill_id").agg(F.min("list").alias("list"))
