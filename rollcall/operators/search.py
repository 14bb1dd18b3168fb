"""Search over several kinds of records with scores by field and kind of match."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import snippet

#: Field, and the scores of an exact match, a match at the start, and one inside (fixed values).
MEMBER = (("name", 0.95, 0.80, 0.60), ("id", 1.0, 0.80, 0.60), ("role", 0.25, 0.22, 0.20), ("party", 0.25, 0.22, 0.20), ("district", 0.25, 0.22, 0.20), ("chamber", 0.25, 0.22, 0.20), ("email", 0.25, 0.22, 0.20), ("bio", 0.40, 0.40, 0.40))
BILL = (("number", 1.0, 0.80, 0.60), ("description", 0.45, 0.42, 0.40), ("synopsis", 0.43, 0.41, 0.40), ("sponsor", 0.25, 0.22, 0.20), ("last_action", 0.25, 0.22, 0.20), ("chamber", 0.25, 0.22, 0.20))
COMMITTEE = (("code", 1.0, 0.80, 0.60), ("name", 0.95, 0.80, 0.60))


def field_score(value: Column, query: str, exact: float, prefix: float, inside: float) -> Column:
    low, q = F.lower(value), F.lit(query.lower())
    return F.when(low == q, exact).when(F.startswith(low, q), prefix).when(F.contains(low, q), inside)


def search_one(df: DataFrame, kind: str, key: str, fields: tuple, query: str) -> DataFrame:
    """(kind, id, field, score, snippet): the best field of each row that matches; the first one on a tie."""
    query = query.strip()
    have = [f for f in fields if f[0] in df.columns or f[0] == "id"]
    at = lambda f: F.col(key).cast("string") if f == "id" else F.col(f).cast("string")
    hits = F.array(*(F.struct(field_score(at(f), query, *s).alias("score"), F.lit(-i).alias("ord"), F.lit(f).alias("field"), at(f).alias("value")) for i, (f, *s) in enumerate(have)))
    best = F.array_max(F.filter(hits, lambda h: h["score"].isNotNull()))
    out = df.select(F.col(key).cast("string").alias("id"), best.alias("b")).where("b is not null")
    return out.select(F.lit(kind).alias("kind"), "id", F.col("b.field").alias("field"), F.col("b.score").alias("score"), snippet(F.col("b.value"), query).alias("snippet"))


def search_all(query: str, tables: dict[str, tuple[DataFrame, str, tuple]], kinds: set[str] | None = None) -> DataFrame:
    """Hits over all tables by falling score, kind and id; a blank query finds nothing."""
    parts = [search_one(df, kind, key, fields, query) for kind, (df, key, fields) in tables.items() if kinds is None or kind in kinds]
    out = reduce(DataFrame.unionByName, parts)
    return (out if query.strip() else out.where("false")).orderBy(F.desc("score"), "kind", "id")
