"""Mixing sources to target weights by hash-threshold histograms.

Each source gets a word budget. A document's hash places it on a line from 0 to
2^60; a source takes every document below its threshold once more than the whole
passes it affords. Thresholds come from histograms: words are summed by source and
hash bucket, the running sum finds the bucket in which the budget ends, and only that
bucket is summed again by the next bits of the hash, until it holds one hash value.
Nothing is sorted but the buckets of a source, and a smaller budget always takes a
subset of what a larger one takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, n_words

HASH_BITS = 60
BITS = 10
#: Sources up to which their thresholds are broadcast; beyond it they are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def id_hash(doc_id: Column, text: Column, seed: str = "") -> Column:
    """A number of 60 bits from the md5 digest of the id's text; a row with a null id has its own text's, null counting as empty."""
    text = F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), text.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """(source, source_size, target) from (source, size): ``share`` of all sizes dealt by weight.

    Sources in code point order, null last, weigh ``weights``, repeating. A target stops
    at ``most`` times its source's size and the excess is dealt to the others by weight
    until none is above. There is one row a source here, so one task ranks them."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    cap = F.col("source_size") * F.lit(float(most))
    ranked = (
        totals.withColumn("weight", F.get(cycle, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))))
        .withColumn("cap", cap)
        .withColumn("all", F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share)))
    )
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing))
    level = ranked.withColumn("level", (F.col("all") - before) / left)
    full = F.col("cap") <= F.col("level") * F.col("weight")
    final = F.min(F.when(~full, F.struct(F.col("cap") / F.col("weight"), "level"))).over(Window.partitionBy())
    return level.select(
        "source", "source_size", F.when(full, F.col("cap")).otherwise(F.col("weight") * final["level"]).alias("target")
    )


def _by_source(left: DataFrame, right: DataFrame, how: str = "inner", few: bool = False) -> DataFrame:
    """Join on the source, null to null; ``few``: the right side is known to be small and broadcast."""
    right = right.withColumnRenamed("source", "right_source")
    near = F.broadcast(right) if few else right
    return left.join(near, F.col("source").eqNullSafe(F.col("right_source")), how).drop("right_source")


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """``budgets`` (source, budget, ...) with ``threshold``: the hashes below it sum nearest to the budget.

    ``sized``: (source, size, hash)."""
    state = materialise(
        budgets.select("*", F.lit(0).cast("long").alias("low"), F.col("budget").alias("rest"), F.lit(False).alias("found"))
    )
    kept = budgets.columns
    few = state.count() <= BROADCAST_SOURCES
    bits = HASH_BITS
    while bits:
        bits -= BITS
        open_sources = state.where("NOT found").select("source", "low", "rest")
        inside = _by_source(sized, open_sources, few=few)
        inside = inside.where(F.shiftright("hash", bits + BITS) == F.shiftright("low", bits + BITS))
        buckets = inside.groupBy("source", F.shiftright("hash", bits).alias("bucket")).agg(
            F.sum("size").alias("words"), F.min("hash").alias("first"), F.max("hash").alias("last")
        )
        order = Window.partitionBy("source").orderBy("bucket")
        summed = buckets.withColumn("through", F.sum("words").over(order))
        summed = _by_source(summed, open_sources, few=few)
        ends = F.col("through") > F.col("rest")
        end = (
            summed.where(ends)
            .groupBy("source")
            .agg(F.min(F.struct("bucket", "words", "through", "first", "last")).alias("end"))
        )
        single = F.col("end.first") == F.col("end.last")
        over = F.col("end.through") - F.col("rest") < F.col("rest") - (F.col("end.through") - F.col("end.words"))
        joined = _by_source(state, end, "left")
        missing = F.col("end").isNull()
        state = materialise(
            joined.select(
                *kept,
                F.when(F.col("found"), F.col("low"))
                .when(missing, F.lit(1 << HASH_BITS))
                .when(single, F.col("end.first") + over.cast("long"))
                .otherwise(F.shiftleft(F.col("end.bucket"), bits))
                .alias("low"),
                F.when(F.col("found") | missing, F.col("rest"))
                .otherwise(F.col("rest") - (F.col("end.through") - F.col("end.words")))
                .alias("rest"),
                (F.col("found") | missing | single).alias("found"),
            )
        )
        if state.where("NOT found").isEmpty():
            break
    return state.select(*kept, F.col("low").alias("threshold"))


def limits_of(sized: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target, whole, budget, threshold) from (source, size, hash).

    A source takes each document ``whole`` times, and those below the threshold once more."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    budgets = (
        source_targets(sized, weights, share, most)
        .withColumn("whole", whole.cast("int"))
        .withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    )
    return thresholds(sized.select("source", "size", "hash"), budgets)


def _sized(docs: DataFrame, id_col: str, source_col: str, text_col: str, seed: str) -> DataFrame:
    return docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.col(f"`{source_col}`").alias("source"),
        n_words(F.col(f"`{text_col}`")).alias("size"),
        id_hash(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), seed).alias("hash"),
    )


def _with_repeats(rows: DataFrame, limits: DataFrame) -> DataFrame:
    few = limits.count() <= BROADCAST_SOURCES
    repeats = F.col("whole") + (F.col("hash") < F.col("threshold")).cast("int") * (F.col("budget") > 0).cast("int")
    return _by_source(rows, limits, few=few).withColumn("repeats", repeats)


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: str = "",
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, source, size, source_size, target, repeats, taken.

    size is the number of words (null text: 0), repeats how often the mix takes the
    document, taken the words it takes with that. Rows that share an id share a hash
    and are taken alike; rows with null ids are told apart by their texts; the null source is a source of
    its own, last in order. Documents of size 0 take 0 words. Other columns are ignored; an empty
    table gives an empty result."""
    sized = materialise(_sized(docs, id_col, source_col, text_col, seed))
    found = _with_repeats(sized, limits_of(sized, weights, share, most))
    return found.select(
        "doc_id", "source", "size", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken")
    )


def take(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: str = "",
) -> DataFrame:
    """The rows of ``docs`` as often as ``mix`` takes them, with the columns of ``docs``; texts are not shuffled."""
    sized = materialise(_sized(docs, id_col, source_col, text_col, seed).select("source", "size", "hash"))
    rows = docs.select(
        F.struct("*").alias("row"), F.col(f"`{source_col}`").alias("source"), id_hash(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), seed).alias("hash")
    )
    found = _with_repeats(rows, limits_of(sized, weights, share, most)).where("repeats > 0")
    repeated = found.select("row", F.explode(F.array_repeat(F.lit(0), F.col("repeats"))))
    return repeated.select(*(F.col("row")[c].alias(c) for c in docs.columns))


#: DuckDB SQL for ``mix`` over documents: budgets from the definition, thresholds from sorted running sums.
ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS hash
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0 ELSE 2.0 END AS weight
  FROM totals),
levels AS (
  SELECT a.cap / a.weight AS fill,
         (1.5::DOUBLE * (SELECT sum(source_size) FROM totals)
          - (SELECT coalesce(sum(b.cap), 0) FROM ranked b WHERE b.cap / b.weight < a.cap / a.weight))
         / (SELECT sum(b.weight) FROM ranked b WHERE b.cap / b.weight >= a.cap / a.weight) AS level
  FROM ranked a),
final AS (SELECT arg_min(level, fill) AS level FROM levels WHERE level < fill),
targets AS (
  SELECT source, source_size, least(cap, weight * coalesce((SELECT level FROM final), cap / weight)) AS target
  FROM ranked),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole,
         target - CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END * source_size AS budget
  FROM targets),
summed AS (
  SELECT s.doc_id, s.size, b.source_size, b.target, b.whole, b.budget,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.hash) AS through,
         sum(s.size) OVER (PARTITION BY s.source, s.hash) AS own
  FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN budget > 0 AND (through <= budget
         OR (through - own <= budget AND through - budget < budget - (through - own))) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM summed
"""
