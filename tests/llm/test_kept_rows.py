"""Which of repeated rows stays does not depend on how they are dealt."""

from pyspark.sql import functions as F

from matquarry.llm import shingles


def test_repeated_rows_keep_the_same_one(spark):
    rows = [(1, "the same long text of some words that repeats " * 5, f"source {i % 7}", i) for i in range(40)] + [(None, "other words", "b", 1), (None, "other words", "a", 2)]
    kept = set()
    for parts in (1, 3, 7):
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n long").repartition(parts, F.rand(parts))
        kept.add(tuple(sorted(map(repr, shingles.drop_near_duplicates(docs).collect()))))
    assert len(kept) == 1 and len(next(iter(kept))) == 2
