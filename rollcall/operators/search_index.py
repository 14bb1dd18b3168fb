"""An inverted index for search inside texts: postings of trigrams, from which few rows are left to look at.

Postings (gram, id, field) and the number of postings of each gram are Parquet tables in folders by a hash of the gram, sorted
by gram, so that a query reads the folders of its own grams and of these the row groups that hold them. A query's rarest
grams name the candidates; they are then searched like any table, so that hits, fields, scores and snippets are those of a
scan. Queries of fewer than three code points have no gram and scan.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import work_path
from .search import search_one

SIZE = 3
#: So many of a query's grams, the rarest, are looked up.
LOOKED_UP = 4
SCHEMAS = {"postings": "gram string, id string, field string, bucket int", "counts": "gram string, n long, bucket int"}


def grams(value: Column) -> Column:
    """The distinct trigrams of a text in lower case; none for a null or shorter one."""
    letters = F.split(F.lower(value), "")
    # Shifted copies side by side: what a lambda says of the text itself would be computed anew for every place in it.
    shifted = [F.slice(letters, i + 1, F.greatest(F.size(letters) - SIZE + 1, F.lit(0))).alias(f"l{i}") for i in range(SIZE)]
    every = F.transform(F.arrays_zip(*shifted), lambda x: F.concat(*(x[f"l{i}"] for i in range(SIZE))))
    return F.when(F.size(letters) >= SIZE, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def postings(df: DataFrame, key: str, fields: tuple, buckets: int) -> DataFrame:
    """(bucket, gram, id, field) of the fields that df has, once for each row of df; field id is the key itself."""
    at = lambda f: F.col(key) if f == "id" else F.col(f)
    names = [f for f, *_ in fields if f in df.columns or f == "id"]
    cells = F.array(*(F.struct(F.lit(f).alias("field"), at(f).cast("string").alias("value")) for f in names))
    rows = df.select(F.col(key).cast("string").alias("id"), F.explode(cells).alias("x")).select("id", "x.field", F.explode(grams(F.col("x.value"))).alias("gram"))
    return rows.select((F.crc32(F.col("gram").cast("binary")) % buckets).cast("int").alias("bucket"), "gram", "id", "field")


@dataclass(frozen=True)
class TextIndex:
    """Where an index is, and what it was made of."""

    path: str
    key: str
    fields: tuple
    buckets: int

    def grams_of(self, spark: SparkSession, kind: str, wanted: list[str]) -> DataFrame:
        folders = sorted({zlib.crc32(g.encode()) % self.buckets for g in wanted})
        return spark.read.schema(SCHEMAS[kind]).parquet(f"{self.path}/{kind}").where(F.col("bucket").isin(folders) & F.col("gram").isin(wanted))

    def candidates(self, spark: SparkSession, query: str) -> DataFrame | None:
        """(id) of the rows that may match; None where the query is too short to say."""
        q = query.strip().lower()
        wanted = sorted({q[i : i + SIZE] for i in range(len(q) - SIZE + 1)})
        if not wanted:
            return None
        counts = {r["gram"]: r["n"] for r in self.grams_of(spark, "counts", wanted).collect()}  # a row per gram of the query
        rare = sorted(wanted, key=lambda g: (counts.get(g, 0), g))[:LOOKED_UP]
        found = self.grams_of(spark, "postings", rare).groupBy("id", "field").agg(F.countDistinct("gram").alias("n"))
        return found.where(F.col("n") == len(rare)).select("id").distinct()

    def search(self, df: DataFrame, kind: str, query: str) -> DataFrame:
        """As search.search_one over df, the table that the index was made of or brought up to."""
        near = self.candidates(df.sparkSession, query)
        if near is not None:
            df = df.join(near.withColumnRenamed("id", "__id"), F.col(self.key).cast("string") == F.col("__id"), "left_semi")
        return search_one(df, kind, self.key, self.fields, query)

    def updated(self, changed: DataFrame, gone: DataFrame | None = None) -> TextIndex:
        """An index in which the rows of changed stand in place of those of their keys, and those of the keys of gone in none.
        Only changed rows are taken apart."""
        spark = changed.sparkSession
        keys = changed.select(F.col(self.key).cast("string").alias("id"))
        if gone is not None:
            keys = keys.unionByName(gone.select(F.col(self.key).cast("string").alias("id")))
        old = spark.read.schema(SCHEMAS["postings"]).parquet(f"{self.path}/postings").select("bucket", "gram", "id", "field").join(keys.distinct(), "id", "left_anti")
        return written(old.unionByName(postings(changed, self.key, self.fields, self.buckets)), self.key, self.fields, self.buckets)


def written(rows: DataFrame, key: str, fields: tuple, buckets: int) -> TextIndex:
    """An index of postings, in a new place. Postings of a gram are dealt by gram and id: a frequent one is no single task."""
    path = work_path(rows.sparkSession, "text-index")
    dealt = rows.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("bucket", "gram", "id")
    dealt.write.partitionBy("bucket").parquet(f"{path}/postings")
    counts = rows.sparkSession.read.schema(SCHEMAS["postings"]).parquet(f"{path}/postings").groupBy("bucket", "gram").agg(F.count(F.lit(1)).alias("n"))
    counts.repartition("bucket").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{path}/counts")
    return TextIndex(path, key, fields, buckets)


def build(df: DataFrame, key: str, fields: tuple, buckets: int = 64) -> TextIndex:
    """The index of a table for the fields of a search (see search.MEMBER). Null values and keys of null have no postings."""
    return written(postings(df.where(F.col(key).isNotNull()), key, fields, buckets), key, fields, buckets)
