"""The search loop as DataFrame jobs: extraction, one iteration, dataset update, warm start."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import formulas as fx
from ..operators import novelty, results, scoring, selection, structures
from ..sources import datasets, shared


@dataclass(frozen=True)
class Extracted:
    """Success and stable rows of one iteration, and the counts of the extraction."""

    success: DataFrame
    stable: DataFrame
    counts: DataFrame


def extract(kappa: DataFrame, phonon: DataFrame, by: list[str], blocks: DataFrame | None = None, checks: DataFrame | None = None,
            threshold: float = 1.0, wide: float = 5.0, tolerance: float = -0.1) -> Extracted:
    """Join, classify and filter results; with ``blocks`` drop structural duplicates, with ``checks`` add the novelty status.

    No materials give empty tables: that is a success. The classified input is written to the shared folder for all outputs."""
    joined = results.backfill_stability(kappa, phonon, by=tuple(by))
    place = shared.new_place(kappa.sparkSession)
    results.classify_stability(joined, tolerance).write.parquet(place)
    classified = kappa.sparkSession.read.parquet(place)
    counts = results.extraction_counts(classified, "iteration", threshold=threshold, wide=wide)
    good, near = results.success(classified, threshold), results.stable(classified, wide)
    if blocks is not None:
        gone = structures.drop_similar(blocks, key="structure_id").where("NOT kept").select("structure_id")
        good, near = (t.join(gone, "structure_id", "left_anti") for t in (good, near))
    if checks is not None:
        good, near = (novelty.novelty_status(t, checks, key="structure_id") for t in (good, near))
    return Extracted(good, near, counts)


def update(origin: DataFrame, extracted: Extracted) -> DataFrame:
    """The next training table: success rows, else stable rows, folded into the last one; with neither it is copied."""
    winners = results.warm_start(extracted.success.select("formula", "k"), extracted.stable.select("formula", "k"))
    return results.update_dataset(origin, winners)


def warm_rows(extracted: Extracted, fallback: DataFrame | None = None, threshold: float = 5.0) -> DataFrame:
    """(formula, k) to start the next iteration from: success, else stable below the threshold, else the fallback candidates."""
    rows = results.warm_start(extracted.success.select("formula", "k"), extracted.stable.select("formula", "k"), threshold)
    if fallback is None:
        return rows
    have = rows.agg((F.count("*") == 0).alias("__none"))
    extra = fallback.select("formula", "k").join(F.broadcast(have)).where("__none").drop("__none")
    return rows.unionByName(extra)


def run_iteration(
    iteration: int, candidates: DataFrame, history: DataFrame, responses: DataFrame | None, out: str, top_k: int = 20, n_select: int = 10, known: DataFrame | None = None
) -> DataFrame:
    """Score, rank and select candidates of one iteration; the trace is written to its own partition, so a rerun replaces it.

    ``candidates``: (formula, mu_log, sigma_log); ``history``: (iteration, k). Without
    responses the rank cut-off decides; ``known`` reference records drop known materials."""
    past = history.where(F.col("iteration") < iteration).agg(F.log(F.coalesce(F.min(F.when(F.col("k") > 0, F.col("k"))), F.lit(1.0))).alias("f_min"))
    pool = candidates.withColumn("total_atoms", fx.total_atoms(fx.parse_formula(F.col("formula")))).join(F.broadcast(past))
    if known is not None:
        pool = novelty.novel(pool, known)
    ranked = scoring.top_by_ei(scoring.score(pool, F.col("f_min")), top_k)
    if responses is None:
        trace = selection.rank_cutoff(ranked, n_select)
    else:
        trace = selection.selection_trace(ranked, selection.rerank(ranked, responses, n_select))
    datasets.overwrite_iteration(trace.withColumn("iteration", F.lit(iteration)), out)
    return trace.sparkSession.read.parquet(out).where(F.col("iteration") == iteration)
