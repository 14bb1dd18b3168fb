"""Writers: Parquet tables, reports, snapshots with retention, markdown notes, appended logs, seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import safe_filename, wikilink
from ..operators.relational import top_n


def tables(frames: dict[str, DataFrame], folder: str) -> None:
    """Each table as Parquet, written whole or not at all by Spark's committer."""
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def report(df: DataFrame, path: str) -> None:
    """Nested rows as JSON lines."""
    df.write.mode("overwrite").json(path)


def append_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def snapshot(df: DataFrame, path: str, stamp: str) -> None:
    """Adds a snapshot under its stamp; running again replaces it."""
    df.withColumn("snapshot", F.lit(stamp)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot").parquet(path)


def expired(snapshots: DataFrame, keep: int = 20) -> DataFrame:
    """The stamps beyond the newest `keep`."""
    newest = snapshots.select("snapshot").distinct().orderBy(F.desc("snapshot")).limit(keep)
    return snapshots.select("snapshot").distinct().join(newest, "snapshot", "left_anti")


def latest(snapshots: DataFrame) -> DataFrame:
    top = snapshots.agg(F.max("snapshot").alias("snapshot"))
    return snapshots.join(F.broadcast(top), "snapshot", "left_semi")


def frontmatter(fields: dict[str, Column]) -> Column:
    lines = [F.concat(F.lit(f"{k}: "), F.coalesce(v.cast("string"), F.lit(""))) for k, v in fields.items()]
    return F.concat_ws("\n", F.lit("---"), *lines, F.lit("---"))


def member_note(df: DataFrame) -> DataFrame:
    """(path, body): a markdown note per member with its scorecard."""
    body = F.concat_ws(
        "\n", frontmatter({"type": F.lit("member"), "chamber": F.col("chamber"), "party": F.col("party")}), F.concat(F.lit("# "), F.col("name")),
        F.lit("| Metric | Value |"), F.lit("| --- | --- |"), F.format_string("| Bills | %d |", F.col("bills").cast("long")), F.format_string("| Passed | %d |", F.col("passed").cast("long")),
    )
    return df.select(F.concat(safe_filename(F.col("name")), F.lit(".md")).alias("path"), body.alias("body"))


def bill_note(df: DataFrame) -> DataFrame:
    body = F.concat_ws("\n", frontmatter({"type": F.lit("bill"), "status": F.col("status")}), F.concat(F.lit("# "), F.col("bill_number")), F.coalesce("description", F.lit("")), F.concat(F.lit("Sponsor: "), wikilink(F.col("sponsor"))))
    return df.select(F.concat(safe_filename(F.col("bill_number")), F.lit(".md")).alias("path"), body.alias("body"))


def notes(df: DataFrame, folder: str) -> None:
    """Notes as text files, a folder per note; those of an earlier run go with the folder."""
    df.select(F.col("path").alias("note"), F.col("body").alias("value")).write.mode("overwrite").partitionBy("note").text(folder)


def seed(members: DataFrame, bills: DataFrame, n_members: int = 20, n_bills: int = 200) -> tuple[DataFrame, DataFrame]:
    """A small extract: members taken from the parties in turn, and the newest bills."""
    ranked = top_n(members, ["party"], [F.col("member_id")], n_members, rank="turn")
    return ranked.orderBy("turn", "party", "member_id").limit(n_members).drop("turn"), bills.orderBy(F.desc("last_action_date"), "bill_id").limit(n_bills)


def vectors_wide(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """key, dim_0, dim_1, …"""
    return df.select(key, *(F.get(F.col(vector), F.lit(i)).alias(f"dim_{i}") for i in range(dim)))


def vectors_long(df: DataFrame, key: str) -> DataFrame:
    cols = sorted((c for c in df.columns if c.startswith("dim_")), key=lambda c: int(c[4:]))
    return df.select(key, F.array(*cols).alias("vector"))


def save_views(spark, views: dict[str, str]) -> None:
    """Named views from their SQL, for sessions that ask in SQL."""
    for name, sql in views.items():
        spark.sql(f"create or replace temp view {name} as {sql}")


def sorted_json(df: DataFrame, key: str, path: str) -> None:
    """A small mapping as one file in order of its key."""
    df.orderBy(key).coalesce(1).write.mode("overwrite").json(path)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def narrative(fields: dict[str, Column]) -> Column:
    """One sentence per field that is not null."""
    return F.concat_ws(" ", *(F.when(v.isNotNull(), F.concat(F.lit(f"{k} "), v.cast("string"), F.lit("."))) for k, v in fields.items()))
