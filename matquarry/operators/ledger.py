"""Run analytics: progress ledger and termination rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def substeps_done(ledger: DataFrame, substeps: DataFrame) -> DataFrame:
    """(iteration, step, done): a step with substeps is done when all of them are, else when its own row says so."""
    per_step = ledger.where("substep IS NULL").groupBy("iteration", "step").agg(F.bool_or("completed").alias("own"))
    wanted = substeps.groupBy("step").agg(F.countDistinct("substep").alias("n_wanted"))
    have = ledger.where("substep IS NOT NULL AND completed").join(substeps, ["step", "substep"], "left_semi")
    counted = have.groupBy("iteration", "step").agg(F.countDistinct("substep").alias("n_have"))
    joined = per_step.join(counted, ["iteration", "step"], "full").join(F.broadcast(wanted), "step", "left")
    done = F.when(F.col("n_wanted").isNull(), F.coalesce("own", F.lit(False))).otherwise(F.coalesce("own", F.lit(False)) | (F.coalesce("n_have", F.lit(0)) >= F.col("n_wanted")))
    return joined.select("iteration", "step", done.alias("done"))


def iteration_state(done: DataFrame, steps: DataFrame) -> DataFrame:
    """(iteration, complete, next_step, reset_from): where each iteration stands.

    ``steps``: (step, step_no). next_step is the first that is not done; if a later one is
    done, the round is reset from that gap."""
    rounds = done.select("iteration").distinct()
    every = steps.agg(F.collect_list(F.struct("step", "step_no")).alias("__steps"))  # one row, of a fixed number of steps
    grid = rounds.join(F.broadcast(every)).select("iteration", F.inline("__steps"))
    marked = grid.join(done, ["iteration", "step"], "left").withColumn("done", F.coalesce("done", F.lit(False)))
    first_gap = F.min(F.when(~F.col("done"), F.struct("step_no", "step")))
    state = marked.groupBy("iteration").agg(first_gap.alias("gap"), F.max(F.when(F.col("done"), F.col("step_no"))).alias("last"))
    return state.select(
        "iteration",
        F.col("gap").isNull().alias("complete"),
        F.col("gap.step").alias("next_step"),
        F.when(F.col("last") > F.col("gap.step_no"), F.col("gap.step")).alias("reset_from"),
    )


def termination(rounds: DataFrame, max_iterations: int = 20, target: int = 20, empty: int = 10, window: int = 10, rate: float = 0.05) -> DataFrame:
    """``rounds`` (iteration, n_selected, n_success, success_rate) with stop and stop_reason after each iteration.

    Stops at the last iteration, at ``target`` successes in all, after ``empty`` rounds
    without one in a row, or when the last ``window`` rates are all below ``rate``. One
    row is one iteration, so the windows are small."""
    order = Window.orderBy("iteration")
    frame = order.rowsBetween(1 - window, 0)
    total = F.sum("n_success").over(order)
    island = F.sum((F.col("n_success") > 0).cast("int")).over(order)
    counted = rounds.withColumns({"total_success": total, "__island": island, "__n": F.count("*").over(frame), "__high": F.max("success_rate").over(frame)})
    streak = F.count_if(F.col("n_success") == 0).over(Window.partitionBy("__island").orderBy("iteration"))
    marked = counted.withColumn("empty_streak", streak)
    reason = (
        F.when(F.col("total_success") >= target, "target reached")
        .when(F.col("empty_streak") >= empty, "no success in a row")
        .when((F.col("__n") == window) & (F.col("__high") < rate), "low success rate")
        .when(F.col("iteration") >= max_iterations, "last iteration")
    )
    return marked.withColumns({"stop_reason": reason, "stop": reason.isNotNull()}).drop("__island", "__n", "__high")
