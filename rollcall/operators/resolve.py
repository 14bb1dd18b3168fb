"""Names to members: written variants, a cascade of matches, seats, districts and committees by name."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import indel_ratio, member_name_parts, name_key, ratios, seat_key, seat_name_parts, token_sort
from ..sources.scratch import materialize


def variants(members: DataFrame) -> DataFrame:
    """(chamber, key, member_id, name): every written form that leads to one member.

    members: member_id, name, chamber. Forms that are always taken (the whole name, "Last, First" and its kinds, a last
    name that is alone in its chamber) go to the last member in order of member_id; the looser ones (first name or initial
    only) to the first, and only where no firm form has the key.
    """
    p = members.select("member_id", "name", "chamber", member_name_parts(F.col("name")).alias("p"))
    p = p.select("member_id", "name", "chamber", F.trim(F.replace(F.col("p.first"), F.lit("."), F.lit(""))).alias("first"), F.col("p.last").alias("last"), F.col("p.suffix").alias("suffix"))
    alone = F.count(F.lit(1)).over(Window.partitionBy("chamber", name_key(F.col("last")))) == 1
    p = p.withColumn("alone", alone)
    given, only, initial = F.col("first"), F.split("first", " ")[0], F.substring("first", 1, 1)

    def forms(first: Column) -> list[Column]:
        lasts = (F.col("last"), F.when(F.col("suffix") != "", F.concat_ws(" ", "last", "suffix")))
        return [F.when((given != "") & last.isNotNull(), F.concat(last, F.lit(comma), first)) for last in lasts for comma in (", ", ",")]

    firm = [F.col("name"), *forms(given), F.when(F.col("alone"), F.col("last"))]
    loose = [*forms(only), *forms(initial)]
    items = F.array(*(F.struct(F.lit(0 if i < len(firm) else 1).alias("loose"), F.lit(i).alias("rule"), f.alias("text")) for i, f in enumerate([*firm, *loose])))
    rows = p.select("member_id", "name", "chamber", F.explode(items).alias("x")).where("x.text is not null")
    rows = rows.select("chamber", name_key(F.col("x.text")).alias("key"), "member_id", "name", F.col("x.loose").alias("loose"), F.col("x.rule").alias("rule"))
    order = [F.col("loose"), F.when(F.col("loose") == 0, -F.dense_rank().over(Window.partitionBy("chamber", "key").orderBy("member_id"))).otherwise(F.dense_rank().over(Window.partitionBy("chamber", "key").orderBy("member_id"))), F.col("rule")]
    rows = rows.withColumn("__o", order[1])
    w = Window.partitionBy("chamber", "key").orderBy("loose", "__o", "rule")
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("chamber", "key", "member_id", "name")


#: What stands in a list of names without being a member (fixed values).
NOT_MEMBERS = ("", "vacant", "mr. president", "mr. speaker", "mr president", "mr speaker", "chair")
CODE_PREFIX = r"^(?:Y|N|P|NV|E|A)\s+(?=[A-Z])"


def resolve(names: DataFrame, members: DataFrame, gold: DataFrame | None = None, threshold: float = 90.0) -> DataFrame:
    """(chamber, name, member_id, method, confidence) for each distinct name.

    In turn: no member, a known mapping, a variant, a variant without a vote code before it, the most similar member of
    the chamber from threshold on, unresolved. Only names left over are looked for among similar ones.
    """
    n = names.select("chamber", "name").distinct().withColumn("key", name_key(F.col("name")))
    n = n.withColumn("stripped", name_key(F.regexp_replace("name", CODE_PREFIX, "")))
    v = variants(members)
    out = n.join(v.select("chamber", "key", F.col("member_id").alias("m1")), ["chamber", "key"], "left")
    out = out.join(v.select("chamber", F.col("key").alias("stripped"), F.col("member_id").alias("m2")), ["chamber", "stripped"], "left")
    kind = dict(members.dtypes)["member_id"]
    out = out.join(gold.select("name", F.col("member_id").alias("m0")), "name", "left") if gold is not None else out.withColumn("m0", F.lit(None).cast(kind))
    none = F.lower(F.trim("name")).isin(*NOT_MEMBERS)
    found = out.withColumn("member_id", F.when(none, None).otherwise(F.coalesce("m0", "m1", "m2")))
    method = F.when(none, "non_member").when(F.col("m0").isNotNull(), "gold").when(F.col("m1").isNotNull(), "exact").when(F.col("m2").isNotNull(), "stripped")
    found = found.select("chamber", "name", "member_id", method.alias("method"))
    open_ = found.where("method is null").select("chamber", "name")
    best = candidates(open_, members, 1, threshold).select("chamber", "name", F.col("member_id").alias("m3"), "score")
    out = found.join(best, ["chamber", "name"], "left")
    confidence = F.when(F.col("method").isin("gold", "exact"), 1.0).when(F.col("method") == "stripped", 0.95).otherwise(F.coalesce(F.col("score") / 100.0, F.lit(0.0)))
    return out.select("chamber", "name", F.coalesce("member_id", "m3").alias("member_id"), F.coalesce("method", F.when(F.col("m3").isNotNull(), "fuzzy").otherwise("unresolved")).alias("method"), confidence.alias("confidence"))


#: Grams that are ordered by frequency, the most frequent last; all others come before them.
FREQUENT = 4096


def _grams(rows: DataFrame, keys: list[str], text: str, frequent: DataFrame | None, threshold: float, q: int) -> DataFrame:
    """rows (keys, text) with a row per q-gram of a prefix: gram, at, k (its place by falling rarity), size and bucket.

    Texts are framed, so that n code points have n + q - 1 grams. The prefix is as long as any partner's length may ask for:
    q times the number of code points by which the shortest partner can differ, and one. Buckets grow by the factor of lengths
    that can still be similar, so that partners lie in the same bucket or a neighbouring one. Without frequent: all grams.
    """
    t = threshold / 100
    size = F.length(text)
    framed = F.concat(F.lit("\u0002" * (q - 1)), text, F.lit("\u0003" * (q - 1)))
    each = F.transform(F.sequence(F.lit(1), size + q - 1), lambda i: F.struct(framed.substr(i, F.lit(q)).alias("gram"), i.alias("at")))
    out = rows.select(*keys, size.alias("size"), F.explode(each).alias("x")).select(*keys, "size", "x.*")
    if frequent is None:
        return out
    out = out.join(F.broadcast(frequent), "gram", "left").groupBy(*keys, "size")
    out = out.agg(F.array_sort(F.collect_list(F.struct(F.coalesce("place", F.lit(-1)).alias("place"), "gram", "at"))).alias("__all"))
    most = F.floor(q * F.col("size") * (2 - 2 * t) / (2 - t) + 1e-9) + 1
    grow = 1.0001 * (2 - t) / t  # a little more, for rounded logarithms
    bucket = F.floor(F.log(F.greatest("size", F.lit(1)).cast("double")) / float(np.log(grow))).cast("int")
    return out.select(*keys, "size", bucket.alias("bucket"), F.posexplode(F.slice("__all", F.lit(1), most.cast("int"))).alias("k", "x")).select(*keys, "size", "bucket", "k", "x.gram", "x.at")


def similar_pairs(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str], left_text: str, right_text: str, by: str, threshold: float) -> DataFrame:
    """All pairs of a row of left and one of right with the same value of `by` whose texts have an indel ratio of threshold
    (a percentage of two thirds at least) or more: left_keys, right_keys, by and both texts, not yet scored but for the
    filters, and met, the number of places that they share. Keys with the texts name the rows; names of columns must differ
    between the sides. What is asked of a pair next should depend on met: Spark would ask it before pairs are taken once.

    d insertions and deletions between texts of n and m code points (d at most (n + m) (1 - threshold), of the parity of
    n - m) are (d + n - m) / 2 deletions, which spoil q grams of the left text each, and (d - n + m) / 2 insertions, which
    spoil q - 1. So both texts keep a shared gram among their rarest: q deletions + (q - 1) insertions + 1 of the left one's,
    q insertions + (q - 1) deletions + 1 of the right one's (of trigrams from 80 on, of bigrams below: there are always as
    many); and it moves to the right by at most the insertions, to the left by at
    most the deletions. Rows meet by (by, length bucket, gram); prefixes and places are held against each pair's own
    lengths, and a pair that meets more than once is taken once. No pair is lost.
    """
    if threshold < 200 / 3:
        raise ValueError("below two thirds similar texts need not share a gram")
    spread, q = 1 - threshold / 100, 3 if threshold >= 80 else 2
    kl, kr = [*left_keys, left_text], [*right_keys, right_text]
    counts = _grams(right.where(F.col(right_text).isNotNull()), [by, *kr], right_text, None, threshold, q).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), "gram").limit(FREQUENT)
    frequent = materialize(top.select("gram", (-F.dense_rank().over(Window.orderBy(F.desc("n"), "gram")) + FREQUENT).alias("place")), "frequent-grams")
    x = _grams(left.where(F.col(left_text).isNotNull()), [by, *kl], left_text, frequent, threshold, q)
    x = x.withColumn("bucket", F.explode(F.array(F.col("bucket") - 1, "bucket", F.col("bucket") + 1)))
    x = x.select(by, "bucket", "gram", *kl, F.col("size").alias("__n"), F.col("k").alias("__kx"), F.col("at").alias("__ax"))
    y = _grams(right.where(F.col(right_text).isNotNull()), [by, *kr], right_text, frequent, threshold, q)
    y = y.select(by, "bucket", "gram", *kr, F.col("size").alias("__m"), F.col("k").alias("__ky"), F.col("at").alias("__ay"))
    room = F.floor((F.col("__n") + F.col("__m")) * spread + 1e-9)
    d = room - F.pmod(room - F.col("__n") + F.col("__m"), F.lit(2))  # the most edits of the right parity
    gone, new = (d + F.col("__n") - F.col("__m")) / 2, (d - F.col("__n") + F.col("__m")) / 2
    moved = F.col("__ay") - F.col("__ax")
    fits = (gone >= 0) & (new >= 0) & (moved <= new) & (moved >= -gone) & (F.col("__kx") <= q * gone + (q - 1) * new) & (F.col("__ky") <= q * new + (q - 1) * gone)
    return x.join(y, [by, "bucket", "gram"]).where(fits).groupBy(by, *kl, *kr).agg(F.count(F.lit(1)).alias("met"))


def candidates(names: DataFrame, members: DataFrame, n: int = 5, threshold: float = 50.0, blocks: int = 32) -> DataFrame:
    """The n most similar members of its chamber for each name.

    The score is the token-sort ratio of the texts as they are written (case counts). From a threshold of two thirds on,
    only pairs that share a rare gram at a fitting place are looked at (similar_pairs), and of these none whose lengths, and
    then edit distance, differ by more than the threshold allows to insertions and deletions, which are no fewer. Below that
    similar texts need not share any: then all pairs of a chamber are scored, with its members dealt to blocks that every
    name of the chamber meets, so that the few chambers don't bound the number of tasks. A block is scored as a table, and
    only the n best of a name in it leave the task.
    """
    x = names.select("chamber", "name", token_sort(F.col("name"), False).alias("__x"))
    y = members.select("chamber", "member_id", F.col("name").alias("full"), token_sort(F.col("name"), False).alias("__y"))
    if threshold >= 200 / 3:
        near = similar_pairs(x, y, ["name"], ["member_id", "full"], "__x", "__y", "chamber", threshold)
        room = (F.length("__x") + F.length("__y")) * (1 - threshold / 100) + 1e-9
        near = near.where(F.when((F.col("met") > 0) & (F.abs(F.length("__x") - F.length("__y")) <= room), F.levenshtein("__x", "__y") <= room))
        pairs = near.withColumn("score", indel_ratio("__x", "__y")).drop("__x", "__y", "met").where(F.col("score") >= threshold)
    else:
        pairs = _best_of_blocks(x, y, n, threshold, blocks)
    w = Window.partitionBy("chamber", "name").orderBy(F.desc("score"), "member_id")
    return pairs.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def _best_of_blocks(x: DataFrame, y: DataFrame, n: int, threshold: float, blocks: int, most: int = 50_000) -> DataFrame:
    """The n best pairs of each name with each block of its chamber's members. Blocks of either side hold most rows or so."""
    x = x.where(F.col("chamber").isNotNull() & F.col("__x").isNotNull())
    y = y.where(F.col("chamber").isNotNull() & F.col("__y").isNotNull())
    parts, blocks = max(1, -(-x.count() // most)), max(blocks, -(-y.count() // most))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    x = x.withColumn("__part", F.pmod(F.xxhash64("name"), F.lit(parts)).cast("int")).withColumn("__block", every(blocks))
    y = y.withColumn("__block", F.pmod(F.xxhash64("member_id", "full"), F.lit(blocks)).cast("int")).withColumn("__part", every(parts))
    kinds = dict(x.dtypes) | dict(y.dtypes)

    def best(names: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("member_id", na_position="first", kind="stable")  # the first of equal scores are the best
        texts, rows, columns, scores = block["__y"].tolist(), [], [], []
        step = max(1, 16_384 // max(1, len(texts)))
        for i in range(0, len(names), step) if texts else ():
            found = ratios(names["__x"].iloc[i : i + step].tolist(), texts)
            top = np.argsort(-found, 1, kind="stable")[:, :n]
            score = np.take_along_axis(found, top, 1)
            row, place = np.nonzero(score >= threshold)
            rows.append(row + i), columns.append(top[row, place]), scores.append(score[row, place])
        rows, columns = (np.concatenate(k) if k else np.zeros(0, int) for k in (rows, columns))
        x, y = (f.iloc[k].reset_index(drop=True) for f, k in ((names, rows), (block, columns)))
        return pd.DataFrame({"chamber": x["chamber"], "name": x["name"], "member_id": y["member_id"], "full": y["full"], "score": np.concatenate(scores) if scores else np.zeros(0)})

    keys = ["chamber", "__part", "__block"]
    return x.groupBy(*keys).cogroup(y.groupBy(*keys)).applyInPandas(best, ", ".join(f"`{c}` {kinds[c]}" for c in ("chamber", "name", "member_id", "full")) + ", score double")


def unresolved_queue(casts: DataFrame, resolved: DataFrame) -> DataFrame:
    """Names without a member by how often they occur."""
    left = resolved.where("method = 'unresolved'").select("chamber", "name")
    return casts.join(left, ["chamber", "name"], "left_semi").groupBy("chamber", "name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "chamber", "name")


def apply_resolution(casts: DataFrame, resolved: DataFrame, members: DataFrame) -> DataFrame:
    r = resolved.select("chamber", "name", "member_id", F.col("method").alias("resolution_method"))
    return casts.join(r, ["chamber", "name"], "left").join(members.select("member_id", F.col("name").alias("member_name")), "member_id", "left")


def resolution_stats(resolved: DataFrame) -> DataFrame:
    """Totals and the resolved share of names that can be members; 0 when empty."""
    n = F.count_if(F.col("method") != "non_member")
    ok = F.count_if(F.col("member_id").isNotNull())
    return resolved.agg(F.count(F.lit(1)).alias("names"), ok.alias("resolved"), F.coalesce(F.when(n != 0, ok / n), F.lit(0.0)).alias("rate"))


def match_seats(seats: DataFrame, members: DataFrame) -> DataFrame:
    """seats (section, idx, seat) with member_id: by initial and last name, a compound last name, or one that is alone."""
    m = members.select("member_id", "name", member_name_parts(F.col("name")).alias("p"), F.split(F.trim("name"), r"\s+").alias("w"))
    last = seat_key(F.col("p.last"))
    m = m.withColumn("last", last).withColumn("alone", F.count(F.lit(1)).over(Window.partitionBy("last")) == 1)
    two = F.when(F.size("w") >= 3, seat_key(F.array_join(F.slice("w", -2, 2), " ")))
    three = F.when(F.size("w") >= 4, seat_key(F.array_join(F.slice("w", -3, 3), " ")))
    keys = F.array(F.struct(F.lit(1).alias("rule"), F.concat(F.upper(F.substring("p.first", 1, 1)), F.lit("|"), "last").alias("key")), F.struct(F.lit(2).alias("rule"), two.alias("key")), F.struct(F.lit(2).alias("rule"), three.alias("key")), F.struct(F.lit(3).alias("rule"), F.when(F.col("alone"), F.col("last")).alias("key")))
    m = m.select("member_id", F.explode(keys).alias("k")).select("member_id", "k.rule", "k.key").where("key is not null")
    m = m.groupBy("rule", "key").agg(F.min("member_id").alias("member_id"))
    s = seats.select("*", seat_name_parts(F.col("seat")).alias("p")).where(~F.lower(F.trim("seat")).isin("vacant", ""))
    last = seat_key(F.col("p.last"))
    wanted = F.array(F.struct(F.lit(1).alias("rule"), F.when(F.col("p.initial") != "", F.concat(F.upper("p.initial"), F.lit("|"), last)).alias("key")), F.struct(F.lit(2).alias("rule"), F.when(F.contains(last, F.lit(" ")), last).alias("key")), F.struct(F.lit(3).alias("rule"), last.alias("key")))
    hits = s.select("section", "idx", F.explode(wanted).alias("k")).select("section", "idx", "k.rule", "k.key").where("key is not null").join(m, ["rule", "key"])
    best = hits.groupBy("section", "idx").agg(F.min(F.struct("rule", "member_id")).alias("b")).select("section", "idx", F.col("b.member_id").alias("member_id"))
    return seats.join(best, ["section", "idx"], "left")


def seatmates(seated: DataFrame) -> DataFrame:
    """(member_id, other_id) of neighbouring places in a section; empty places are no neighbours."""
    w = Window.partitionBy("section").orderBy("idx")
    x = seated.select("member_id", F.lag("member_id").over(w).alias("left"), F.lead("member_id").over(w).alias("right"))
    x = x.select("member_id", F.explode(F.array("left", "right")).alias("other_id"))
    return x.where("member_id is not null and other_id is not null").distinct()


def districts_of_zip(zips: DataFrame, crosswalk: DataFrame, members: DataFrame) -> DataFrame:
    """The senator and representative of each zip; district numbers compare as texts."""
    z = zips.join(crosswalk, "zip", "left")
    m = members.select("chamber", F.col("district").cast("string").alias("d"), "member_id")
    s = m.where(F.col("chamber").isin("S", "Senate")).select(F.col("d").alias("senate"), F.col("member_id").alias("senator"))
    h = m.where(F.col("chamber").isin("H", "House")).select(F.col("d").alias("house"), F.col("member_id").alias("representative"))
    return z.join(s, "senate", "left").join(h, "house", "left")


def committee_codes(names: DataFrame, committees: DataFrame) -> DataFrame:
    """Codes of committee names by several keys: as written, without "Committee", with & for and."""
    def keys(c: Column) -> Column:
        low = F.trim(F.lower(c))
        bare = F.trim(F.regexp_replace(low, r"\s*\bcommittee\b\s*(on\s+)?", " "))
        return F.array_distinct(F.array(low, bare, F.replace(bare, F.lit("&"), F.lit("and")), F.replace(bare, F.lit(" and "), F.lit(" & "))))

    known = committees.select("code", F.explode(keys(F.col("name"))).alias("key")).groupBy("key").agg(F.min("code").alias("code"))
    return names.select("name", F.explode(keys(F.col("name"))).alias("key")).join(known, "key").groupBy("name").agg(F.min("code").alias("code"))


def named_in(texts: DataFrame, members: DataFrame, text: str, limit: int = 32 << 20) -> DataFrame:
    """Rows of texts with member_id and __n of each member (member_id, name) whose name they contain, in any case.

    Each text is read once, by an automaton over all names. Names of over limit bytes together are looked for in several
    passes, so that no task holds more. Null texts contain nothing and null names are nowhere; an empty name is everywhere.
    """
    named = members.where(F.col("name").isNotNull()).select("member_id", F.col("name").alias("__n"), F.lower("name").alias("__low"))
    distinct = materialize(named.select("__low").distinct(), "names")
    size = distinct.agg(F.sum(F.octet_length("__low") + 16)).first()[0] or 0
    passes = max(1, -(-size // limit))
    out = None
    for k in range(passes):
        block = [r["__low"] for r in distinct.where(F.pmod(F.xxhash64("__low"), F.lit(passes)) == k).collect()]  # limit bytes or so
        shared = texts.sparkSession.sparkContext.broadcast(sorted(block))
        found = texts.withColumn("__low", F.explode(_names_in(shared)(F.lower(F.col(text)))))
        out = found if out is None else out.unionByName(found)
    return out.join(named, "__low").drop("__low")


def _names_in(shared):
    """A function of texts that gives the names of the broadcast list in each, once each."""

    def find(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        names = shared.value
        automaton = ahocorasick.Automaton()
        for n in names:
            if n:
                automaton.add_word(n, n)
        everywhere = {""} & set(names)
        automaton.make_automaton()
        for part in texts:
            yield pd.Series([sorted({n for _, n in automaton.iter(t)} | everywhere) if len(automaton) and t is not None else sorted(everywhere) if t is not None else [] for t in part])

    find.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(find, "array<string>")


def fill_missing_groups(main: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """main, and the rows of extra for keys that main has none of."""
    return main.unionByName(extra.join(main.select(key).distinct(), key, "left_anti"))
