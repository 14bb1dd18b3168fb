"""Pipeline stages and learning samples on odd rows."""

from pyspark.sql import functions as F


def test_simhash_stage_keeps_unrelated_texts_of_one_id(spark, tmp_path):
    """An id with two clean texts keeps both; where one is a near copy of a smaller id, that one goes; a repeated row stays once."""
    import corpus_pipeline as pipeline

    long = " ".join(f"w{i * i}" for i in range(400))
    rows = [(5, "one text about rivers and lakes"), (5, "quite another on trains, tickets and timetables"), (1, long), (7, long + " end"), (7, "a third subject: bread, ovens and flour"), (8, "said twice in the same words"), (8, "said twice in the same words"), (None, "no id here"), (None, "no id here")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(((r["doc_id"], r["text"]) for r in pipeline.simhash_near_dedup(spark, docs, str(tmp_path)).collect()), key=repr)
    assert kept == sorted({x for x in rows if x != (7, long + " end")}, key=repr)


def test_sample_passes_over_what_does_not_fit(spark):
    """However large one text is, all that fit beside it are used."""
    from rollcall.llm.hashing import fold_of, labelled_sample

    ids = [r["doc_id"] for r in spark.range(60).toDF("doc_id").where(fold_of(F.col("doc_id")) != 0).orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    for large in (ids[0], ids[5]):
        docs = spark.createDataFrame([(i, "x" * (10_000 if i == large else 10)) for i in ids], "doc_id long, text string")
        labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
        assert len(list(labelled_sample(docs, labels, "toxic", 100, 1000))) == len(ids) - 1


def test_toxicity_stage_without_both_labels_keeps_all(spark, tmp_path):
    import corpus_pipeline as pipeline

    docs = spark.createDataFrame([(i, f"text {i}", "en", "s", 6) for i in range(20)], "doc_id long, text string, lang string, source string, n_chars long")
    for k, rows in enumerate(([], [(i, 1, 1) for i in range(20)])):
        spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{k}/labels.parquet")
        assert pipeline.toxicity(spark, docs, f"{tmp_path}/{k}").count() == 20


def test_labels_of_other_documents_take_no_place_in_the_sample(spark):
    """Labels for a hundred times as many ids as there are documents: the sample is as full as its bound allows."""
    from rollcall.llm.hashing import fold_of, labelled_sample

    labels = spark.range(60_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("toxic"))
    docs = spark.range(0, 60_000, 100).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    learnable = docs.where(fold_of(F.col("doc_id")) != 0).count()
    assert learnable > 400
    assert len(list(labelled_sample(docs, labels, "toxic", 300, 1 << 20))) == 300
    assert len(list(labelled_sample(docs, labels, "toxic", 5_000, 1 << 20))) == learnable
