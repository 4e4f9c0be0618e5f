"""Scoring and ranking of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as nx


def score(candidates: DataFrame, f_min: Column | float = 0.0, xi: float = 0.01) -> DataFrame:
    """``candidates`` (mu_log, sigma_log, …) with ei, k_pred, k_lower, k_upper and weight.

    k is exp(mu), bounds are the 95 % interval; ``f_min`` is the best known log objective."""
    mu, sigma = F.col("mu_log"), F.col("sigma_log")
    best = F.lit(f_min) if isinstance(f_min, float) else f_min
    scored = candidates.withColumns(
        {
            "ei": nx.expected_improvement(mu, sigma, best, xi),
            "k_pred": F.exp(mu),
            "k_lower": F.exp(mu - 1.96 * sigma),
            "k_upper": F.exp(mu + 1.96 * sigma),
        }
    )
    return scored.withColumn("weight", nx.composite_weight(F.col("ei"), F.col("sigma_log"), F.col("k_pred")))


def ei_order() -> list[Column]:
    """Order of scored candidates: most improvement first."""
    return [F.col("ei").desc(), F.col("k_pred"), F.col("formula"), F.col("total_atoms")]


def top_by_ei(scored: DataFrame, k: int = 20, ties: tuple[str, ...] = ()) -> DataFrame:
    """The k best rows in that order with ``rank`` 1..k, equal ones in the order of ``ties``. The cut comes before the rank, so only k rows meet in one task."""
    order = [*ei_order(), *ties]
    best = scored.orderBy(*order).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def rank_by_score(rows: DataFrame, k: int, position: str = "position") -> DataFrame:
    """The k best rows by ei, else score; ties keep the order of ``position``."""
    score_column = F.coalesce(*(F.col(c) for c in ("ei", "score") if c in rows.columns), F.lit(0.0))
    order = [score_column.desc(), F.col(position)]
    return rows.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def score_statistics(scored: DataFrame) -> DataFrame:
    """One row: n and min, max and mean of ei, k_pred and sigma_log."""
    parts = [f(c).alias(f"{f.__name__}_{c}") for c in ("ei", "k_pred", "sigma_log") for f in (F.min, F.max, F.avg)]
    return scored.agg(F.count("*").alias("n"), *parts)


def arity_counts(candidates: DataFrame) -> DataFrame:
    """(n_elements, n): candidates by number of elements."""
    return candidates.groupBy("n_elements").agg(F.count("*").alias("n"))


def best_known(history: DataFrame, iteration: str = "iteration", k: str = "k", default: float = 1.0) -> DataFrame:
    """(iteration, f_min): log of the lowest positive k of all earlier iterations, log of ``default`` without any.

    Rows are first reduced to one an iteration, so the running window holds iterations, not rows."""
    per_round = history.groupBy(iteration).agg(F.min(F.when(F.col(k) > 0, F.col(k))).alias("low"))
    earlier = Window.orderBy(iteration).rowsBetween(Window.unboundedPreceding, -1)
    return per_round.select(iteration, F.log(F.coalesce(F.min("low").over(earlier), F.lit(default))).alias("f_min"))
