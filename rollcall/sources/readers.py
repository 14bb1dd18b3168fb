"""Readers: nested JSON, keyed JSON, pipe-separated exports, timing and run logs, seating charts, gold labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import BILL, COMMITTEE, MEMBER, SEATING, VOTE_EVENT


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def json_array(spark: SparkSession, path: str, schema: str, fallback: str | None = None) -> DataFrame:
    """Records of a JSON array, or of the fallback where path doesn't exist."""
    if not path_exists(spark, path) and fallback:
        path = fallback
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_map(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """Records of a JSON object by key: the key becomes a column. Such a file is one record; convert() makes it splittable."""
    whole = spark.read.text(path, wholetext=True)
    parsed = whole.select(F.from_json("value", f"map<string,struct<{schema}>>").alias("m"))
    return parsed.select(F.explode("m").alias("__key", "r")).select("__key", "r.*").withColumn(key, F.coalesce(F.col(key), F.col("__key"))).drop("__key")


def convert(df: DataFrame, path: str) -> None:
    """Writes records as Parquet, which reads in parts and by columns."""
    df.write.mode("overwrite").parquet(path)


def members(spark: SparkSession, path: str) -> DataFrame:
    return json_array(spark, path, MEMBER)


def bills(spark: SparkSession, path: str) -> DataFrame:
    return json_map(spark, path, BILL, "leg_id")


def committees(spark: SparkSession, path: str) -> DataFrame:
    return json_array(spark, path, COMMITTEE)


def vote_events(spark: SparkSession, path: str) -> DataFrame:
    return json_array(spark, path, VOTE_EVENT)


def seating(spark: SparkSession, path: str) -> DataFrame:
    """(ring, section, idx, seat) of a nested seating chart, in order."""
    chart = json_array(spark, path, SEATING)
    rings = chart.select(F.posexplode("rings").alias("r", "ring"))
    sections = rings.select(F.col("ring.ring_number").alias("ring"), F.posexplode("ring.sections").alias("s", "section"))
    return sections.select("ring", F.concat_ws("/", F.col("ring").cast("string"), F.col("s").cast("string")).alias("section"), F.col("section.label").alias("label"), F.posexplode("section.seats").alias("idx", "seat"))


def slip_export(spark: SparkSession, path: str) -> DataFrame:
    """Witness slips of a pipe-separated export. Lines of fewer than seven fields and the heading are left out; fields are
    trimmed."""
    fields = F.transform(F.split("value", r"\|"), lambda x: F.trim(x))
    lines = spark.read.text(path).select(fields.alias("f")).where((F.size("f") >= 7) & (F.lower(F.col("f")[0]) != "legislation"))
    names = ("bill_number", "name", "organization", "representing", "position", "hearing_committee", "hearing_date")
    return lines.select(*(F.col("f")[i].alias(n) for i, n in enumerate(names)))


def census(spark: SparkSession, path: str, zcta: str, geoid: str, land: str) -> DataFrame:
    """(zip, geoid, land, ord) of a relationship file; an error names the columns that are missing."""
    df = spark.read.option("sep", "|").option("header", True).csv(path)
    if missing := [c for c in (zcta, geoid, land) if c not in df.columns]:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return df.select(F.col(zcta).alias("zip"), F.col(geoid).alias("geoid"), F.col(land).try_cast("long").alias("land"), F.monotonically_increasing_id().alias("ord")).where("zip is not null and geoid is not null")


TIMING = ("stamp", "mode", "members", "committees", "bills", "load_s", "analytics_s", "export_s", "votes_s", "total_s")
TIMING_NEW = ("stamp", "mode", "members", "committees", "bills", "slips", "load_s", "analytics_s", "export_s", "votes_s", "slips_s", "total_s")


def timings(spark: SparkSession, path: str) -> DataFrame:
    """Start-up timings of both file versions, told apart by their number of columns; other lines are left out. Blank
    numbers count as 0; overhead is what the steps don't explain."""
    f = spark.read.text(path).select(F.split("value", ",").alias("f")).where(F.lower(F.col("f")[0]) != "stamp")
    size, cells = F.size("f"), {}
    for i, name in enumerate(TIMING_NEW):
        cells[name] = F.when(size == len(TIMING_NEW), F.get("f", F.lit(i)))
        if name in TIMING:
            cells[name] = cells[name].when(size == len(TIMING), F.get("f", F.lit(TIMING.index(name))))
    rows = f.where(F.size("f").isin(len(TIMING), len(TIMING_NEW))).select(*(c.alias(n) for n, c in cells.items()))
    numbers = [n for n in cells if n.endswith("_s")]
    rows = rows.withColumns({n: F.coalesce(F.trim(n).try_cast("double"), F.lit(0.0)) for n in numbers} | {n: F.coalesce(F.trim(n).try_cast("int"), F.lit(0)) for n in ("members", "committees", "bills", "slips")})
    steps = sum((F.col(n) for n in numbers if n != "total_s"), F.lit(0.0))
    return rows.withColumn("steps_s", steps).withColumn("overhead_s", F.greatest(F.lit(0.0), F.col("total_s") - F.col("steps_s")))


def run_log(spark: SparkSession, path: str, n: int = 20, task: str | None = None) -> DataFrame:
    """The last n runs of a JSON-lines log, newest first."""
    df = spark.read.schema("task string, started timestamp, total_s double, status string, phases array<struct<name:string,seconds:double>>").json(path)
    df = df.where(F.col("task") == task) if task else df
    return df.orderBy(F.desc("started")).limit(n)


def phase_means(runs: DataFrame, n: int = 5) -> DataFrame:
    """Mean seconds by task and phase, the n longest of each task."""
    from ..operators.relational import top_n

    rows = runs.select("task", F.explode("phases").alias("p")).groupBy("task", F.col("p.name").alias("phase")).agg(F.avg("p.seconds").alias("seconds"), F.count(F.lit(1)).alias("runs"))
    return top_n(rows, ["task"], [F.desc("seconds"), F.col("phase")], n)


def gold_labels(spark: SparkSession, path: str) -> DataFrame:
    """(key, label) of a label file: an object of values, or of objects with a label; keys that begin with _ are remarks."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "raw"))
    label = F.coalesce(F.get_json_object("raw", "$.label"), F.col("raw"))
    return whole.where(~F.startswith("key", F.lit("_"))).select("key", label.alias("label"))


def older_than(spark: SparkSession, path: str, days: float, now: str) -> DataFrame:
    """Files with whether they are older than so many days at now."""
    files = spark.read.format("binaryFile").load(path).select("path", "modificationTime")
    age = (F.lit(now).cast("timestamp").cast("long") - F.col("modificationTime").cast("long")) / 86400
    return files.select("path", age.alias("age_days"), (age > days).alias("stale"))


def crosswalk(house: DataFrame, senate: DataFrame, congress: DataFrame) -> DataFrame:
    """One row per zip that any of the three (zip, district) maps knows; a missing district is empty."""
    out = None
    for name, df in (("house", house), ("senate", senate), ("us_house", congress)):
        part = df.select("zip", F.col("district").alias(name))
        out = part if out is None else out.join(part, "zip", "full_outer")
    return out.select("zip", *(F.coalesce(c, F.lit("")).alias(c) for c in ("house", "senate", "us_house")))


def rosters(committees: DataFrame) -> DataFrame:
    """(code, member_id, member_name, role, ord) of committees with nested rosters."""
    return committees.select("code", F.posexplode("roster").alias("ord", "r")).select("code", "r.member_id", "r.member_name", "r.role", "ord")


def committee_bills(committees: DataFrame) -> DataFrame:
    return committees.select("code", F.explode("bill_numbers").alias("number"))


def rules(spark: SparkSession, path: str) -> DataFrame:
    """(stage, progress, next_stages) of a rules glossary; rule_facts reads all of its parts."""
    whole = spark.read.text(path, wholetext=True)
    stages = whole.select(F.explode(F.from_json("value", "struct<stages:map<string,struct<progress_fraction:double,next_stages:array<string>>>>")["stages"]).alias("stage", "s"))
    return stages.select("stage", F.col("s.progress_fraction").alias("progress"), F.col("s.next_stages").alias("next_stages"))


#: The parts of a rules glossary, each an object of named entries.
RULE_PARTS = ("stages", "committees", "actions", "outcomes", "vote_thresholds", "deadlines")


def rule_facts(spark: SparkSession, path: str) -> DataFrame:
    """(part, name, field, value) of every field of every entry of a rules glossary's six parts; nested values as JSON text.
    An entry that is no object (a list of committees) has one field without a name. Parts that are missing have no rows."""
    whole = spark.read.text(path, wholetext=True)
    parts = F.from_json("value", "struct<" + ",".join(f"{p}:map<string,string>" for p in RULE_PARTS) + ">")
    rows = whole.select(F.explode(F.array(*(F.struct(F.lit(p).alias("part"), parts[p].alias("entries")) for p in RULE_PARTS))).alias("x"))
    rows = rows.select("x.part", F.explode("x.entries").alias("name", "text"))
    fields = F.coalesce(F.from_json("text", "map<string,string>"), F.create_map(F.lit(""), F.col("text")))
    return rows.select("part", "name", F.explode(fields).alias("field", "value"))


def rule_table(facts: DataFrame, part: str, **fields: str) -> DataFrame:
    """One part as a table: a row per entry with the wanted fields in the types given, null where an entry lacks one."""
    cells = []
    for name, kind in fields.items():
        value = F.max(F.when(F.col("field") == name, F.col("value")))
        cells.append((F.from_json(value, kind) if kind.startswith(("array", "struct", "map")) else value.try_cast(kind)).alias(name))
    return facts.where(F.col("part") == part).groupBy("name").agg(*cells)


def rule_committees(facts: DataFrame) -> DataFrame:
    """(name, formal_name, chamber, aliases) of the procedural committees, and those of each chamber's standing list by name."""
    entries = facts.where("part = 'committees'")
    listed = entries.where("field = ''").select(F.explode(F.from_json("value", "array<struct<name:string,formal_name:string,chamber:string,aliases:array<string>>>")).alias("x")).select("x.*")
    standing = entries.where("field = 'committees'").select(F.regexp_extract("name", "^(senate|house)", 1).alias("chamber"), F.explode(F.from_json("value", "array<string>")).alias("name"))
    return listed.unionByName(standing.select("name", F.col("name").alias("formal_name"), "chamber", F.array().cast("array<string>").alias("aliases")))


def rule_votes(facts: DataFrame) -> DataFrame:
    """(name, chamber, votes, members): what each threshold asks of a chamber, where it is a number."""
    t = rule_table(facts, "vote_thresholds", senate_votes_required="int", senate_total_members="int", house_votes_required="int", house_total_members="int")
    sides = F.array(*(F.struct(F.lit(c).alias("chamber"), F.col(f"{c}_votes_required").alias("votes"), F.col(f"{c}_total_members").alias("members")) for c in ("senate", "house")))
    return t.select("name", F.explode(sides).alias("x")).select("name", "x.*").where("votes is not null")


def refresh_state(bills: DataFrame, stamp: str) -> DataFrame:
    """What an incremental refresh starts from: the highest number of each kind, and when it was taken."""
    from ..functions.text import number_kind, numeric_suffix

    n = F.col("bill_number")
    return bills.groupBy(number_kind(n).alias("kind")).agg(F.max(numeric_suffix(n)).alias("highest")).withColumn("taken", F.lit(stamp).cast("timestamp"))


def as_json(df: DataFrame, name: str = "record") -> DataFrame:
    """Each row as one JSON text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))
