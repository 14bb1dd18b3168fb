"""The inverted index against scans."""

import re

import pytest
from pyspark.sql import functions as F

from rollcall.operators import search, search_index

FIELDS = (("text", 0.45, 0.42, 0.40), ("id", 1.0, 0.80, 0.60))


@pytest.fixture(scope="module")
def docs(spark, sf):
    made = [(900001, None), (900002, ""), (900003, "ab"), (900004, "ÄÖÜ straße 漢字漢字"), (900005, "aaaa"), (900006, "x" * 30_000 + "needle" + "y" * 30_000)]
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return rows.unionByName(spark.createDataFrame(made, rows.schema)).cache()


@pytest.fixture(scope="module")
def index(docs):
    return search_index.build(docs, "doc_id", FIELDS, 16)


def hits(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("query", ["Licensed under", "the", "ab", "a", "öü str", "漢字漢", "needle", "aaaaa", "900005", "17", "  needle ", "nowhere to be found"])
def test_hits_are_those_of_a_scan(docs, index, query):
    assert hits(index.search(docs, "document", query)) == hits(search.search_one(docs, "document", "doc_id", FIELDS, query))


def test_little_is_read(spark, docs, index):
    """Of the postings' folders only those of the query's rarest grams, and few rows are left to verify."""
    plan = index.grams_of(spark, "postings", ["nee", "eed"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*bucket", plan) and "PushedFilters: [In(gram" in plan
    assert index.candidates(spark, "needle").count() < 0.1 * docs.count()
    assert index.candidates(spark, "ab") is None


def test_updates(spark, docs, index):
    changed = spark.createDataFrame([(900006, "no such word"), (900007, "a needle, new")], docs.schema)
    gone = spark.createDataFrame([(900004,)], "doc_id long")
    now = docs.where(~F.col("doc_id").isin(900004, 900006)).unionByName(changed)
    later = index.updated(changed, gone)
    for query in ("needle", "such word", "straße", "aaaa"):
        assert hits(later.search(now, "document", query)) == hits(search.search_one(now, "document", "doc_id", FIELDS, query))
    assert {r["id"] for r in later.candidates(spark, "straße").collect()} == set()


def test_empty_tables(spark, docs):
    empty = search_index.build(docs.limit(0), "doc_id", FIELDS, 4)
    assert empty.search(docs.limit(0), "document", "needle").count() == 0
