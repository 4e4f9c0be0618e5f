"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word, as every operator here counts them: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder: the cluster's shared one, or in local mode one made here where none is named."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def rewritten(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to a new place in the shared folder, and read from there."""
    place = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4()}"
    df.write.parquet(place)
    return df.sparkSession.read.parquet(place)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there.

    What several later steps read is computed once, and a lost executor costs no
    more than the tasks it held."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """Hand texts to Python in Arrow batches of ``size``, where the session leaves Spark's own 64 MB.

    Both the executor and its Python workers hold a batch at a time, beside what they keep of earlier stages."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":
        spark.conf.set(name, size)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Number of words of a text, null counting as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """Rows that no label may be learnt from: crc32 of the id's text is a multiple of 5."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def map_batches(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    schema: str,
    per_task: Callable[[], Callable[[list], Iterable]],
    encoded: bool = True,
) -> DataFrame:
    """One output row for each row of ``docs``: its id, then what ``per_task`` makes of the whole text.

    ``per_task`` is called once a task and returns a function from a list of texts, as
    UTF-8 bytes (``encoded``) or str, to the new columns; null texts arrive empty.
    ``schema`` names the new columns. Only the id and the text column leave the JVM, so
    other columns of ``docs`` may have any name."""
    picked = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )
    fields = T._parse_datatype_string(schema)
    out = T.StructType([picked.schema["doc_id"], *fields.fields])
    arrow = _arrow_schema(out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = per_task()
        for batch in batches:
            for part in pieces(batch):
                texts = part.column(1)
                if encoded:
                    texts = texts.cast(pa.binary())
                made = work(texts.to_pylist())
                columns = [part.column(0), *(pa.array(c, type=f.type) for c, f in zip(made, list(arrow)[1:]))]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return picked.mapInArrow(run, out)


def map_texts(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    schema: str,
    per_task: Callable[[], Callable[[bytes], tuple]],
    encoded: bool = True,
) -> DataFrame:
    """``map_batches`` with a function of one text, which returns the values of its row."""

    def of_batch() -> Callable[[list], Iterable]:
        work = per_task()
        return lambda texts: zip(*map(work, texts))

    return map_batches(docs, id_col, text_col, schema, of_batch, encoded)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label_col: str, fit_rows: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, text, label) of at most ``fit_rows`` labelled rows that are not held out, picked by hash.

    The picked ids are broadcast: ``fit_rows`` bounds them. Of texts that share an id the first in order stands for it, so
    the result has no more rows than were picked."""
    usable = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    usable = usable.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id"))).distinct()
    # a share of the hash range that holds somewhat more than is asked for, so that what is sorted is as small as the sample
    parts = 1_000_000
    share = min(parts, -(-(2 * fit_rows + 100) * parts // max(1, usable.count())))
    near = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) < share)
    picked = near.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(fit_rows)
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")


def pieces(batch: pa.RecordBatch, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Short slices of an Arrow batch, so that what is made of one is small."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
