"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, source mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor
kept; what it returns is written as Parquet and read again as the next one's docs.
Ids may be null or repeat: rows count each for themselves. Null texts count as empty; the quality rules let neither through. An empty
table gives an empty result in every stage. Stages with Python hand over texts in Arrow batches of 4 MB, unless the
session sets another size than Spark's. Columns besides doc_id, text, source and n_chars pass through under any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matquarry.llm import bytebpe, linededup, mixing, repetition, shingles
from matquarry.llm.common import rewritten, small_batches


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null, empty and very short texts go. Repeated rows stay or go together."""
    small_batches(spark)
    return repetition.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later repeats of runs of 50 words or more; n_chars follows the text.

    Null ids come first in the order of documents, repeated rows keep the same text, and a text may become empty."""
    small_batches(spark)
    kept = linededup.drop_repeated_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts with 0.8 or more of their five-word shingles in common.

    Empty texts are one group. The row of the smallest id stays, null ids last; of repeated rows one stays."""
    small_batches(spark)
    return shingles.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: not at all, once or twice.

    A null source is a source; rows with equal ids are taken together."""
    return mixing.take(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and digests of the ids and of what they decode to.

    A row for each row; empty texts have no ids."""
    small_batches(spark)
    return bytebpe.round_trip(docs).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near duplicates", near_duplicates),
    ("mixing", mix),
    ("byte BPE", tokens),
]

#: Shingle similarity, winnowing and the vocabulary's merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each reading what the one before it wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = rewritten(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
