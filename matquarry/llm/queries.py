"""The registered query of each operator of this subpackage, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import additive, bytebpe, fingerprint, graphann, licenses, linededup, mixing, prefixtrie, repetition, secretscan, simhash, spelling, toxicity
from .common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bytebpe.round_trip(table(spark, sf_dir, "documents"))
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    both = docs.select("doc_id", "text", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).alias("n_lines"))
    kept = linededup.drop_repeated_lines(both)
    left = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n")))
    return kept.select(
        "doc_id",
        "n_lines",
        F.coalesce(left, F.lit(0)).alias("n_kept_lines"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def op4_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repetition.quality_rules(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.round(c, 6) for c in ("top_share", "dup_share", "dup_line_chars")})


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    cited = F.transform("evidence", lambda e: F.concat_ws(":", e["doc_id"], F.round(e["similarity"], 4), e["label"]))
    return found.select("doc_id", "held_out", "score", "predicted", F.array_join(cited, ",").alias("evidence"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secretscan.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select(
        "doc_id",
        *(secretscan.count_kind(k).alias(f"n_{k}") for k in secretscan.KINDS),
        F.sha2(secretscan.listed(base), 256).alias("base_sha256"),
        secretscan.listed(F.col("spans")).alias("spans"),
    )


def op7_additive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_graph_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return graphann.nearest(vectors, vectors.where("vec_id % 50 = 0"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.trie(table(spark, sf_dir, "conversations"))


def op13_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint.printed(F.col("vector")).alias("fingerprint"),
        fingerprint.printed(F.col("edited_vector")).alias("edited_fingerprint"),
        fingerprint.likeness(F.col("vector"), F.col("edited_vector")).alias("near_edited"),
        fingerprint.likeness(F.col("vector"), F.col("next_vector")).alias("near_next"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_byte_bpe": op2_byte_bpe,
        "op3_line_dedup": op3_line_dedup,
        "op4_repetition": op4_repetition,
        "op5_toxicity": op5_toxicity,
        "op6_secrets": op6_secrets,
        "op7_additive": op7_additive,
        "op8_licenses": op8_licenses,
        "op9_mixing": op9_mixing,
        "op10_graph_ann": op10_graph_ann,
        "op11_spelling": op11_spelling,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_fingerprint": op13_fingerprint,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_repetition": repetition.oracle_sql(),
        "op8_licenses": licenses.oracle_sql(),
        "op9_mixing": mixing.ORACLE_SQL,
        "op11_spelling": spelling.ORACLE_SQL,
        "op12_prefix_trie": prefixtrie.ORACLE_SQL,
        "op13_fingerprint": fingerprint.oracle_sql(),
    }
