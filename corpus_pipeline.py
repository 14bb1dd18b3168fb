"""A training corpus in five stages: toxicity, quality classifier, SimHash near-dedup, suffix-array dedup, packing.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame, and works on all that the one before it kept.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm import classifier, packing, simhash, suffix
from rollcall.llm import toxicity as toxic
from rollcall.llm.common import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity reaches one half go; none where the labels don't show both kinds."""
    docs = docs.select(*COLUMNS)
    machine = toxic.fit(docs, _labels(spark, sf_dir))
    if not machine.fitted:
        return docs
    return classifier.with_score(docs, machine, name="__toxic").where("__toxic < 0.5").drop("__toxic")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality is below 0.3 go."""
    docs = docs.select(*COLUMNS)
    model = classifier.fit(docs, _labels(spark, sf_dir))
    return classifier.with_score(docs, model, name="__quality").where("__quality >= 0.3").drop("__quality")


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id stays; of rows that repeat an id and a text, one. Rows
    of one id but different texts are documents of their own. A document without an id goes by a negative number made
    from its text."""
    key = F.struct(F.coalesce(F.col("doc_id"), -F.abs(F.shiftrightunsigned(F.xxhash64("text"), 1)) - 1).alias("id"), F.xxhash64("text").alias("text"))
    keyed = docs.select(*COLUMNS, key.alias("__key"))
    found = materialize(simhash.near_duplicates(keyed, doc_id="__key").select("doc_id", "component_id"), "pipeline-groups")
    first = found.where("doc_id = component_id").groupBy("doc_id").count()
    kept = keyed.join(first.select(F.col("doc_id").alias("__key")), "__key", "left_semi")
    twice = first.where("count > 1").select(F.col("doc_id").alias("__key"))
    once = kept.join(twice, "__key", "left_anti").unionByName(kept.join(twice, "__key", "left_semi").dropDuplicates(["__key"]))
    return once.select(*COLUMNS)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat are cut out: the maximal runs of repeated strings of 200 bytes that hold over 50 words or 400
    bytes and more. (51 words of prose have 285 bytes at least on the test tables, so that 400 bytes would miss most.)
    A code point that a cut splits goes whole (and with it any replacement character of such a text). A document may be
    left without text."""
    found = suffix.remove_repeats(docs, keep=("doc_id", "lang", "source"), length=200, gram=32, least_words=50, always=400)
    text = F.replace(F.make_valid_utf8(F.col("kept").cast("string")), F.lit("\ufffd"), F.lit(""))
    cut = F.size("spans") > 0
    out = found.select("doc_id", F.when(cut, text).otherwise(F.col("kept").cast("string")).alias("text"), "lang", "source")
    return out.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document with its bin."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express trained models, fingerprints and suffix arrays; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
