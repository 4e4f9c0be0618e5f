"""Texts reach the Python of the pipeline's stages in small Arrow batches."""

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline

SIZE = "spark.sql.execution.arrow.maxBytesPerBatch"


def largest_batch(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    docs = spark.range(0, 3000, 1, 1).select("id", F.repeat(F.lit("word "), 1000).alias("text"))
    return docs.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0]


def test_stages_bound_the_bytes_of_a_batch_unless_the_session_does(spark):
    docs = spark.createDataFrame([(1, "a b c", None, "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    before = spark.conf.get(SIZE)
    try:
        for stage in (corpus_pipeline.quality, corpus_pipeline.tokens):
            spark.conf.unset(SIZE)
            assert largest_batch(spark) > 14_000_000
            stage(spark, docs, "")
            assert largest_batch(spark) < 5_000_000
        spark.conf.set(SIZE, "8m")
        corpus_pipeline.tokens(spark, docs, "")
        assert spark.conf.get(SIZE) == "8m"
    finally:
        spark.conf.set(SIZE, before)
