"""Materials-search inputs derived from the general tables, in Spark and in SQL.

The tables hold no chemistry; compositions, predictions and results follow from their
keys by integer arithmetic that both engines state alike, so they grow with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

A, B, C = ("Ag", "Cu", "In", "Sn", "Pb"), ("As", "Sb", "Ge", "Bi", "Ti", "V"), ("S", "Se", "Te")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` over as many tasks as the session gives a shuffle, for work that is large beside the rows that it begins with."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _pick(names: tuple[str, ...], index: str) -> F.Column:
    return F.get(F.array(*map(F.lit, names)), F.expr(index).cast("int"))


def compositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, a, na, b, nb, c, nc, formula, raw): raw is the formula as written in one of four styles."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size", "p_retailprice")
    base = part.select(
        "id", "p_retailprice",
        _pick(A, "id % 5").alias("a"), F.expr("cast(2 + id % 9 AS int)").alias("na"),
        _pick(B, "(id div 5) % 6").alias("b"), F.expr("cast(1 + p_size % 10 AS int)").alias("nb"),
        _pick(C, "(id div 30) % 3").alias("c"), F.expr("cast(1 + (id div 7) % 10 AS int)").alias("nc"),
    ).withColumn("formula", F.concat("a", "na", "b", "nb", "c", "nc"))
    raw = (
        F.when(F.expr("id % 4 = 1"), F.concat(F.concat("a", "na"), F.lit(" "), F.concat("b", "nb"), F.lit(" "), F.concat("c", "nc")))
        .when(F.expr("id % 4 = 2"), F.translate("formula", "0123456789", "₀₁₂₃₄₅₆₇₈₉"))
        .when(F.expr("id % 4 = 3"), F.concat(F.lit("("), F.concat("a", "na", "b", "nb"), F.lit(")2"), F.concat("c", "nc")))
        .otherwise(F.col("formula"))
    )
    return base.withColumn("raw", raw)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, formula, total_atoms, mu_log, sigma_log)."""
    return compositions(spark, sf_dir).select(
        "id", "formula", F.expr("na + nb + nc").alias("total_atoms"),
        F.log(F.col("p_retailprice") / 1000).alias("mu_log"), F.expr("cast(0.05 AS double) + (id % 20) / cast(40 AS double)").alias("sigma_log"),
    )


def _file_key() -> F.Column:
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return F.concat_ws("_", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents)


def kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cif_file, structure_id, formula, iteration, k): one conductivity result a line item."""
    items = table(spark, sf_dir, "lineitem")
    made = compositions(spark, sf_dir).select("id", "formula")
    return items.join(made, items["l_partkey"] == made["id"]).select(
        _file_key().alias("structure_id"),
        F.concat(_file_key(), F.lit(".cif")).alias("cif_file"),
        "formula", F.expr("cast(l_suppkey % 20 AS int)").alias("iteration"), (F.col("l_extendedprice") / 10000).alias("k"),
    )


def phonon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cif_file, ts, min_frequency, has_imaginary, …): an append-only log, some files attempted twice."""
    items = table(spark, sf_dir, "lineitem").where("l_linenumber % 3 <> 0")
    tries = items.withColumn("attempt", F.explode(F.when(F.expr("l_linenumber = 1"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return tries.select(
        F.concat(_file_key(), F.lit(".cif")).alias("cif_file"),
        F.col("attempt").alias("ts"),
        F.expr("CASE WHEN l_tax <> 0 OR attempt = 2 THEN round(l_discount - 0.15 + 0.1 * attempt, 2) END").alias("min_frequency"),
        F.expr("CASE l_returnflag WHEN 'R' THEN '是' WHEN 'A' THEN 'No' ELSE 'N' END").alias("has_imaginary"),
        F.expr("round(l_tax * 10, 2)").alias("gamma_min_optical"),
        F.expr("round(l_tax * 5, 2)").alias("gamma_max_acoustic"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, query_ok, material_id, formula): reference records with multiplied counts."""
    supplier = table(spark, sf_dir, "supplier")
    made = compositions(spark, sf_dir)
    joined = supplier.join(made, supplier["s_suppkey"] * 7 == made["id"])
    times = F.expr("cast(1 + s_suppkey % 3 AS int)")
    return joined.select(
        _pick(("MP", "OQMD", "AFLOW"), "s_suppkey % 3").alias("source"),
        F.expr("s_suppkey % 11 <> 0").alias("query_ok"),
        F.concat(F.lit("m-"), "s_suppkey").alias("material_id"),
        F.concat("c", F.col("nc") * times, "a", F.col("na") * times, "b", F.col("nb") * times).alias("formula"),
    )


def _listed(names: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


COMP = f"""
comp0 AS (SELECT p_partkey AS id, p_retailprice, {_listed(A)}[p_partkey % 5 + 1] AS a, CAST(2 + p_partkey % 9 AS INT) AS na,
  {_listed(B)}[(p_partkey // 5) % 6 + 1] AS b, CAST(1 + p_size % 10 AS INT) AS nb,
  {_listed(C)}[(p_partkey // 30) % 3 + 1] AS c, CAST(1 + (p_partkey // 7) % 10 AS INT) AS nc FROM part),
comp AS (SELECT *, a || na || b || nb || c || nc AS formula, CASE WHEN id % 4 = 3 THEN 2 ELSE 1 END AS times FROM comp0)"""

PRED = f"""{COMP},
pred AS (SELECT id, formula, na + nb + nc AS total_atoms, ln(p_retailprice / 1000) AS mu_log,
  0.05::DOUBLE + (id % 20) / 40.0::DOUBLE AS sigma_log FROM comp)"""

KAPPA = f"""{COMP},
kappa AS (SELECT l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey || '_' || CAST(round(l_extendedprice * 100) AS BIGINT) AS structure_id, l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey || '_' || CAST(round(l_extendedprice * 100) AS BIGINT) || '.cif' AS cif_file, formula,
  CAST(l_suppkey % 20 AS INT) AS iteration, l_extendedprice / 10000 AS k FROM lineitem JOIN comp ON l_partkey = id)"""

PHONON = """
tries AS (SELECT l.*, t.attempt FROM lineitem l JOIN (VALUES (1), (2)) t(attempt) ON t.attempt = 1 OR l.l_linenumber = 1 WHERE l_linenumber % 3 <> 0),
phonon AS (SELECT l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey || '_' || CAST(round(l_extendedprice * 100) AS BIGINT) || '.cif' AS cif_file, attempt AS ts,
  CASE WHEN l_tax <> 0 OR attempt = 2 THEN round(l_discount - 0.15 + 0.1 * attempt, 2) END AS min_frequency,
  CASE l_returnflag WHEN 'R' THEN '是' WHEN 'A' THEN 'No' ELSE 'N' END AS has_imaginary,
  round(l_tax * 10, 2) AS gamma_min_optical, round(l_tax * 5, 2) AS gamma_max_acoustic FROM tries)"""

#: Stability of each result by its latest attempt.
STATE = f"""{KAPPA}, {PHONON},
latest AS (SELECT p.* FROM phonon p JOIN (SELECT cif_file, max(ts) AS ts FROM phonon GROUP BY cif_file) m USING (cif_file, ts)),
state AS (SELECT k.*, l.min_frequency, l.has_imaginary, l.gamma_min_optical, l.gamma_max_acoustic,
  CASE WHEN l.min_frequency >= 0 THEN 'strict_stable' WHEN l.min_frequency >= -0.1 THEN 'quasi_stable' WHEN l.min_frequency IS NOT NULL THEN 'unstable'
       WHEN lower(l.has_imaginary) IN ('no', 'n') THEN 'strict_stable_by_flag' ELSE 'unstable_by_flag' END AS stability_class
  FROM kappa k LEFT JOIN (SELECT DISTINCT cif_file, min_frequency, has_imaginary, gamma_min_optical, gamma_max_acoustic FROM latest) l USING (cif_file)),
stated AS (SELECT *, stability_class NOT LIKE 'unstable%' AS dynamic_stable FROM state)"""

RECORDS = f"""{COMP},
records AS (SELECT ['MP', 'OQMD', 'AFLOW'][s_suppkey % 3 + 1] AS source, s_suppkey % 11 <> 0 AS query_ok, 'm-' || s_suppkey AS material_id,
  id AS part_id, a, na, b, nb, c, nc FROM supplier JOIN comp ON s_suppkey * 7 = id)"""

#: Reduced formula of a row of three elements and counts.
REDUCED = (
    "list_reduce(list_transform(list_sort([a || ' ' || na // gcd(gcd(na, nb), nc), b || ' ' || nb // gcd(gcd(na, nb), nc), c || ' ' || nc // gcd(gcd(na, nb), nc)]), "
    "lambda x: CASE WHEN split_part(x, ' ', 2) = '1' THEN split_part(x, ' ', 1) ELSE replace(x, ' ', '') END), lambda x, y: x || y)"
)

#: The normal law by its series, for arguments up to about 8: phi(z) and Phi(z) of a column z.
SERIES = """(0.5 + sign({z}) * exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 160),
  lambda k: CASE WHEN {z} = 0 THEN 0 ELSE exp((2 * k + 1) * ln(abs({z})) - (lgamma(2 * k + 2) - k * ln(2) - lgamma(k + 1))) END)))"""
