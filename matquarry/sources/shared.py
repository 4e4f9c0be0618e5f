"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_place(spark: SparkSession) -> str:
    """A new path in the cluster's checkpoint folder; a local folder is made only in local mode, where the session names none."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return f"{context.getCheckpointDir()}/place-{uuid.uuid4()}"


def written(rows: DataFrame) -> DataFrame:
    """``rows`` written to the shared folder once, for what reads them several times. The cluster's owner clears the folder."""
    place = new_place(rows.sparkSession)
    rows.write.parquet(place)
    return rows.sparkSession.read.parquet(place)
