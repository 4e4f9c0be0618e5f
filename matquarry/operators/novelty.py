"""Novelty of candidates against external reference records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formulas as fx
from ..functions import values as vx

SOURCES = ("MP", "OQMD", "AFLOW")


def known_filter(candidates: DataFrame, records: DataFrame, formula: str = "formula") -> DataFrame:
    """``candidates`` with is_known, matched_sources, n_records and all_unavailable.

    A candidate is known if a source has a record of the same reduced formula.
    ``records``: (source, query_ok, formula); records of failed queries do not count;
    all_unavailable tells that every query failed, when "novel" means nothing."""
    answered = records.where("query_ok AND formula IS NOT NULL").select("source", fx.reduced_formula(F.col("formula")).alias("key"))
    per_source = answered.groupBy("key", "source").agg(F.count("*").alias("n"))
    found = per_source.groupBy("key").agg(
        F.array_sort(F.collect_list("source")).alias("matched_sources"), F.sum("n").alias("n_records")
    )
    state = records.agg((F.coalesce(F.count_if("query_ok"), F.lit(0)) == 0).alias("all_unavailable"))
    keyed = candidates.withColumn("__key", fx.reduced_formula(F.col(formula)))
    joined = keyed.join(found, keyed["__key"] == found["key"], "left").drop("key", "__key").join(F.broadcast(state))
    return joined.withColumns(
        {
            "is_known": F.col("n_records").isNotNull(),
            "n_records": F.coalesce("n_records", F.lit(0)),
            "matched_sources": F.coalesce("matched_sources", F.array().cast("array<string>")),
        }
    )


def novel(candidates: DataFrame, records: DataFrame, formula: str = "formula") -> DataFrame:
    """Candidates that no source has."""
    return _split(candidates, records, formula, "left_anti")


def known(candidates: DataFrame, records: DataFrame, formula: str = "formula") -> DataFrame:
    """Candidates that a source has."""
    return _split(candidates, records, formula, "left_semi")


def _split(candidates: DataFrame, records: DataFrame, formula: str, how: str) -> DataFrame:
    keys = records.where("query_ok AND formula IS NOT NULL").select(fx.reduced_formula(F.col("formula")).alias("key")).distinct()
    own = candidates.withColumn("__key", fx.reduced_formula(F.col(formula)))
    return own.join(keys, own["__key"] == keys["key"], how).drop("__key")


def exact_records(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """Records whose reduced formula is that of a wanted formula."""
    keys = wanted.select(fx.reduced_formula(F.col("formula")).alias("__key")).distinct()
    own = records.withColumn("__key", fx.reduced_formula(F.col("formula")))
    return own.join(keys, "__key", "left_semi").drop("__key")


def by_strategy(records: DataFrame, strategy: str = "parallel_all", order: tuple[str, ...] = SOURCES) -> DataFrame:
    """Records under a source strategy: all; ``tiered`` (for each formula the first source that has any); ``mp_only``."""
    if strategy == "mp_only":
        return records.where(F.col("source") == order[0])
    if strategy == "parallel_all":
        return records
    priority = F.array_position(F.array(*map(F.lit, order)), F.col("source"))
    first = records.groupBy(fx.reduced_formula(F.col("formula")).alias("__key")).agg(F.min(priority).alias("__first"))
    keyed = records.withColumns({"__key": fx.reduced_formula(F.col("formula")), "__priority": priority})
    return keyed.join(first, "__key").where("__priority = __first").drop("__key", "__priority", "__first")


def novelty_status(materials: DataFrame, checks: DataFrame, skip: DataFrame | None = None, key: str = "material_id") -> DataFrame:
    """(material columns, novelty_status, reasons): known, novel or undetermined for each material.

    ``checks``: (key, source, query_ok, n_candidates, n_structures, n_matched). A match in any
    source means known; else a source whose answer is unusable leaves it undetermined.
    reasons maps a source to matched, query_failed, no_candidates,
    structure_unavailable_or_parse_failed or candidates_not_isomorphic. Materials in
    ``skip`` (key, novelty_status) take the status given there."""
    reason = (
        F.when(F.col("n_matched") > 0, "matched")
        .when(~F.col("query_ok"), "query_failed")
        .when(F.col("n_candidates") == 0, "no_candidates")
        .when(F.col("n_structures") == 0, "structure_unavailable_or_parse_failed")
        .otherwise("candidates_not_isomorphic")
    )
    per_source = checks.groupBy(key, "source").agg(
        F.bool_and("query_ok").alias("query_ok"), *(F.sum(c).alias(c) for c in ("n_candidates", "n_structures", "n_matched"))
    )
    marked = per_source.withColumn("reason", reason)
    open_reasons = ("query_failed", "structure_unavailable_or_parse_failed")
    status = (
        F.when(F.count_if(F.col("reason") == "matched") > 0, "known")
        .when(F.count_if(F.col("reason").isin(*open_reasons)) > 0, "undetermined")
        .otherwise("novel")
    )
    each = marked.groupBy(key).agg(
        status.alias("__status"), F.array_sort(F.collect_list(F.concat_ws(":", "source", "reason"))).alias("reasons")
    )
    joined = materials.join(each, key, "left")
    final = F.coalesce("__status", F.lit("undetermined"))
    if skip is not None:
        joined = joined.join(skip.select(key, F.col("novelty_status").alias("__skip")), key, "left")
        final = F.coalesce("__skip", final)
    return joined.withColumn("novelty_status", final).drop("__status", "__skip")


def merge_inputs(success: DataFrame, stable: DataFrame) -> DataFrame:
    """(key, formula, cif_file, path, source_types): success and stable rows, one a path or else a formula and file."""
    both = success.withColumn("source_type", F.lit("success")).unionByName(stable.withColumn("source_type", F.lit("stable")))
    key = F.coalesce(vx.clean_text(F.col("path")), F.concat_ws("|", "formula", "cif_file"))
    return both.groupBy(key.alias("key")).agg(
        *(F.min(c).alias(c) for c in ("formula", "cif_file", "path")), F.array_sort(F.collect_set("source_type")).alias("source_types")
    )


def status_counts(statuses: DataFrame) -> DataFrame:
    """(novelty_status, n) for each of the three statuses, 0 where none."""
    spark = statuses.sparkSession
    every = spark.createDataFrame([("known",), ("novel",), ("undetermined",)], "novelty_status string")
    counted = statuses.groupBy("novelty_status").agg(F.count("*").alias("n"))
    return every.join(counted, "novelty_status", "left").select("novelty_status", F.coalesce("n", F.lit(0)).alias("n"))


def success_digest(records: DataFrame, top: int = 10) -> DataFrame:
    """One row: cases, first formulas, range of k, commonest elements, share with a chalcogen, rows with a structure."""
    elements = records.select(F.explode(fx.element_set(F.col("formula"))).alias("element")).groupBy("element").agg(F.count("*").alias("n"))
    common = elements.orderBy(F.col("n").desc(), "element").limit(top)
    listed = common.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("n"), "element"))), lambda x: x["element"]), ",").alias("top_elements"))
    names = records.select("formula").where("formula IS NOT NULL").distinct().orderBy("formula").limit(top)
    first = names.agg(F.array_join(F.array_sort(F.collect_list("formula")), ",").alias("formulas"))
    chalcogen = F.arrays_overlap(fx.element_set(F.col("formula")), F.array(*map(F.lit, ("S", "Se", "Te"))))
    total = records.agg(
        F.count("*").alias("n_cases"), F.min("k").alias("min_k"), F.max("k").alias("max_k"),
        F.coalesce(F.try_divide(F.count_if(chalcogen), F.count("*")), F.lit(0.0)).alias("chalcogen_share"),
        F.count("structure").alias("n_structures"),
    )
    return total.join(F.broadcast(listed)).join(F.broadcast(first))


def field_completeness(rows: DataFrame, fields: dict[str, list[str]]) -> DataFrame:
    """(field, n_present, n_rows): rows with a non-blank value under any alias of each field, in one pass."""
    counted = rows.agg(F.count("*").alias("__rows"), *(F.count(vx.coalesce_alias(rows, names)).alias(f) for f, names in fields.items()))
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").alias("n_present")) for f in fields))
    return counted.select(F.inline(pairs), F.col("__rows").alias("n_rows"))


def lowest_per_key(records: DataFrame, key: list[str], value: str, ties: list[str]) -> DataFrame:
    """One record a key: the least value, ties by the given columns."""
    order = Window.partitionBy(*key).orderBy(F.col(value).asc_nulls_last(), *ties)
    return records.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
