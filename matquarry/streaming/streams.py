"""Streaming jobs: dataset upkeep, task status and the best objective, as results arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType



def file_stream(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files under a path as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


LAYOUT = "formula string, k double, part int, v long"


def upkeep(results_stream: DataFrame, path: str, checkpoint: str, available_now: bool = True, parts: int = 64) -> StreamingQuery:
    """Keep the lowest k of each formula in a table at ``path``, dealt by hash into ``parts``, each in versions ``v=<batch>``.

    A batch reads and writes only the parts that its formulas fall into: their last versions before it are merged with its rows.
    A batch that is run again reads the same versions and overwrites its own, so replays and
    files out of order end in the table that one batch over all rows gives. Of a part that it wrote, a batch keeps its own version and the one
    before, which a replay and readers under way need, and removes the others: what a batch costs does not grow with the batches before it."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        part = F.pmod(F.xxhash64("formula"), F.lit(parts)).cast("int").alias("part")
        new = batch.where("formula IS NOT NULL AND k IS NOT NULL").select("formula", F.col("k").cast("double").alias("k"), part)
        every = new
        touched = [r["part"] for r in new.select("part").distinct().collect()]  # at most ``parts``
        if number:
            before = spark.read.schema(LAYOUT).parquet(path).where(F.col("part").isin(touched) & (F.col("v") < number))
            every = _latest(before).drop("v").unionByName(new)
        best = every.groupBy("part", "formula").agg(F.min("k").alias("k")).withColumn("v", F.lit(number).cast("long"))
        best.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "v").parquet(path)
        for p in touched:
            _remove_superseded(spark, f"{path}/part={p}", number)

    writer = results_stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _remove_superseded(spark: SparkSession, part: str, number: int) -> None:
    """Delete the versions of a part older than the last one before ``number``."""
    place = spark._jvm.org.apache.hadoop.fs.Path(part)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.listStatus(place) if files.exists(place) else []
    versions = {int(f.getPath().getName()[2:]): f.getPath() for f in found if f.getPath().getName().startswith("v=")}
    before = [v for v in versions if v < number]
    for v in before:
        if v != max(before):
            files.delete(versions[v], True)


def _latest(rows: DataFrame) -> DataFrame:
    """Rows of the last version of each part; there are as many parts as ``upkeep`` was given."""
    return rows.join(F.broadcast(rows.groupBy("part").agg(F.max("v").alias("v"))), ["part", "v"])


def current(spark: SparkSession, path: str) -> DataFrame:
    """(formula, k): the table that ``upkeep`` keeps."""
    return _latest(spark.read.schema(LAYOUT).parquet(path)).select("formula", "k")


def status_log(log: DataFrame, path: str, checkpoint: str, watermark: str = "1 day") -> StreamingQuery:
    """Append the attempts of a log stream (ts, attempt_id, …) to a table, each once within the watermark.

    Progress is ``task_progress`` of that table."""
    once = log.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["attempt_id"])
    writer = once.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def best_stream(rows: DataFrame, window: str = "1 hour", watermark: str = "1 hour") -> DataFrame:
    """(window_start, f_min, n): log of the lowest positive k of each event-time window; late rows beyond the watermark are left out."""
    return (
        rows.where("k > 0").withWatermark("ts", watermark).groupBy(F.window("ts", window).alias("w"))
        .agg(F.log(F.min("k")).alias("f_min"), F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "f_min", "n")
    )


def to_memory(stream: DataFrame, name: str, mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """Run a stream over what is there now into a memory table, and return that; for small results such as aggregates."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start().awaitTermination()
    return stream.sparkSession.table(name)
