"""Selecting candidates: re-ranking by responses, guarded selection, traces and summaries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formulas as fx

RESPONSE = "struct<ranked_materials: array<struct<final_rank: string, formula: string, ranking_reason: string, main_risk: string, original_rank: string, scores: map<string, string>>>>"


def parse_responses(raw: DataFrame, text: str = "raw_text") -> DataFrame:
    """Typed rows of responses whose text is JSON or holds a fenced JSON block.

    (response columns …, position, final_rank, formula, ranking_reason, main_risk, original_rank, scores):
    ranks that are no numbers are null, scores are clamped to 0..10; a text that holds no JSON gives no rows."""
    fenced = F.regexp_extract(F.col(text), r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    parsed = F.coalesce(*(F.when(F.size(p["ranked_materials"]) > 0, p) for p in (F.from_json(F.trim(F.col(text)), RESPONSE), F.from_json(fenced, RESPONSE))))
    rows = raw.select(*(c for c in raw.columns if c != text), F.posexplode(parsed["ranked_materials"]).alias("position", "r"))
    clamped = F.transform_values("r.scores", lambda _, v: F.least(F.greatest(v.try_cast("double"), F.lit(0.0)), F.lit(10.0)))
    return rows.select(
        *(c for c in rows.columns if c != "r"),
        F.col("r.final_rank").try_cast("double").cast("int").alias("final_rank"),
        F.trim("r.formula").alias("formula"),
        F.col("r.ranking_reason").alias("ranking_reason"),
        F.col("r.main_risk").alias("main_risk"),
        F.col("r.original_rank").try_cast("double").cast("int").alias("original_rank"),
        clamped.alias("scores"),
    )


def rerank(candidates: DataFrame, responses: DataFrame, n_select: int, by: list[str] | None = None) -> DataFrame:
    """Selected candidates in the order of the responses.

    ``candidates``: (*by, formula, rank, …); ``responses``: (*by, formula, final_rank,
    position, ranking_reason). Formulas are compared without white space and
    subscripts; unknown ones are ignored, of repeated ones the first counts. Final ranks become 1..n."""
    by = by or []
    key = fx.normalize_formula(F.col("formula"))
    first = Window.partitionBy(*by, "key").orderBy("position")
    said = (
        responses.withColumn("key", key).where("key <> ''").withColumn("__n", F.row_number().over(first)).where("__n = 1")
        .select(*by, "key", F.col("final_rank").alias("said_rank"), "position", "ranking_reason")
    )
    joined = candidates.withColumn("key", key).join(said, [*by, "key"]).drop("key")
    order = Window.partitionBy(*by).orderBy(F.col("said_rank").asc_nulls_last(), "formula", "rank")
    return joined.withColumn("final_rank", F.row_number().over(order)).where(F.col("final_rank") <= n_select).drop("said_rank", "position")


def selection_trace(candidates: DataFrame, selected: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Every candidate with selected, final_rank and ranking_reason; a candidate that was not picked says so."""
    by = by or []
    chosen = selected.select(*by, "formula", "rank", "final_rank", "ranking_reason")
    joined = candidates.join(chosen, [*by, "formula", "rank"], "left")
    return joined.withColumn("selected", F.col("final_rank").isNotNull()).withColumn(
        "ranking_reason", F.coalesce("ranking_reason", F.when(F.col("selected"), "").otherwise("not selected"))
    )


def rank_cutoff(candidates: DataFrame, n: int, by: list[str] | None = None) -> DataFrame:
    """The fallback without responses: candidates with ``selected`` for the n best ranks and a reason for each."""
    order = Window.partitionBy(*(by or [])).orderBy("rank", "formula")
    place = F.row_number().over(order)
    return candidates.withColumn("final_rank", place).withColumns(
        {
            "selected": F.col("final_rank") <= n,
            "ranking_reason": F.when(F.col("final_rank") <= n, F.concat(F.lit("rank "), F.col("rank"), F.lit(" within the cutoff"))).otherwise("beyond the cutoff"),
        }
    )


def compact_ranks(rows: DataFrame, n: int, by: list[str] | None = None) -> DataFrame:
    """Rows by (final_rank, formula), renumbered 1..n and cut there."""
    order = Window.partitionBy(*(by or [])).orderBy(F.col("final_rank").asc_nulls_last(), "formula")
    return rows.withColumn("final_rank", F.row_number().over(order)).where(F.col("final_rank") <= n)


def dedup_scores(rows: DataFrame, by: str) -> DataFrame:
    """(…) of each group in the order of (original_rank, formula) without rows whose rank or formula was kept before.

    Each decision depends on those before, so a group is walked in one task: groups are
    the rows of one response, some tens."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        ranks, names, keep = set(), set(), []
        for row in pdf.sort_values(["original_rank", "formula"], kind="stable").itertuples():
            if row.original_rank in ranks or row.formula in names:
                continue
            ranks.add(row.original_rank)
            names.add(row.formula)
            keep.append(row.Index)
        return pdf.loc[keep]

    return rows.groupBy(by).applyInPandas(walk, rows.schema)


def guarded_selection(candidates: DataFrame, picks: DataFrame, locked: int = 5, supplement: int = 5, pool: int = 20, by: list[str] | None = None) -> DataFrame:
    """(*by, final_rank, formula, bo_rank, selection_source): locked candidates, then picks, then a backfill.

    ``candidates``: (*by, formula, rank 1..n), ``picks``: (*by, formula, position). The
    first ``locked`` ranks stay; picks from the rest of the pool follow in their order
    up to ``supplement``; the best ranks left fill up. A formula comes once."""
    by = by or []
    key = fx.normalize_formula(F.col("formula"))
    ranked = candidates.select(*by, "formula", F.col("rank").alias("bo_rank"), key.alias("key")).where(F.col("bo_rank") <= pool)
    picked = picks.select(*by, key.alias("key"), "position").groupBy(*by, "key").agg(F.min("position").alias("position"))
    joined = ranked.join(picked, [*by, "key"], "left")
    source = (
        F.when(F.col("bo_rank") <= locked, "bo_locked").when(F.col("position").isNotNull(), "ai_supplement").otherwise("bo_backfill")
    )
    kind = F.when(source == "bo_locked", 0).when(source == "ai_supplement", 1).otherwise(2)
    once = Window.partitionBy(*by, "key").orderBy("kind", "bo_rank")
    named = joined.withColumns({"selection_source": source, "kind": kind}).withColumn("__n", F.row_number().over(once)).where("__n = 1")
    order = Window.partitionBy(*by, F.col("kind") == 0).orderBy("kind", F.coalesce("position", F.col("bo_rank")), "bo_rank")
    room = F.when(F.col("kind") == 0, locked).otherwise(supplement)
    cut = named.withColumn("__place", F.row_number().over(order)).where(F.col("__place") <= room)
    final = Window.partitionBy(*by).orderBy(F.col("kind") > 0, F.when(F.col("kind") == 0, F.col("bo_rank")).otherwise(F.col("__place")))
    return cut.select(*by, F.row_number().over(final).alias("final_rank"), "formula", "bo_rank", "selection_source")


def formula_set(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(formula): distinct non-blank formulas of any of the columns, without white space."""
    every = rows.select(F.explode(F.array(*(F.regexp_replace(c, r"\s+", "") for c in columns))).alias("formula"))
    return every.where("formula <> ''").distinct()


def membership(selected: DataFrame, success: DataFrame, stable: DataFrame) -> DataFrame:
    """``selected`` with is_success and is_stable: its formula is in the set of that name."""
    marked = selected
    for name, rows in (("is_success", success), ("is_stable", stable)):
        known = rows.select("formula").distinct().withColumn(name, F.lit(True))
        marked = marked.join(known, "formula", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return marked


def _rate(flag: Column) -> Column:
    return F.coalesce(F.try_divide(F.count_if(flag), F.count("*")), F.lit(0.0))


def screening_summary(selected: DataFrame, by: str = "iteration", protected: int = 3, tail: tuple[int, int] = (13, 20)) -> DataFrame:
    """Counts, rates and best k of the selected rows of each iteration.

    Needs is_success, is_stable, k and original_rank (null: counted in no band)."""
    band = F.col("original_rank")
    in_tail = band.between(*tail)
    return selected.groupBy(by).agg(
        F.count("*").alias("n_selected"),
        F.count_if("is_success").alias("n_success"),
        F.count_if("is_stable").alias("n_stable"),
        _rate(F.col("is_success")).alias("success_rate"),
        _rate(F.col("is_stable")).alias("stable_rate"),
        F.min(F.when(F.col("is_success"), F.col("k"))).alias("best_k"),
        F.count_if(band <= protected).alias("n_protected"),
        F.count_if(in_tail).alias("n_tail"),
        F.count_if(in_tail & F.col("is_success")).alias("n_tail_success"),
    )


def source_summary(selected: DataFrame, by: str = "selection_source") -> DataFrame:
    """Counts by selection source: all, success, stable."""
    return selected.groupBy(by).agg(F.count("*").alias("n_all"), F.count_if("is_success").alias("n_success"), F.count_if("is_stable").alias("n_stable"))
