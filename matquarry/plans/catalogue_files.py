"""Registered queries of the sources and sinks: what is written from the tables is read back by each reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import datasets, shared
from . import inputs as i
from .catalogue import _cifs, registered, rounded


@registered(f"""WITH {i.COMP} SELECT formula, CASE WHEN id % 7 <> 0 AND id % 5 <> 0 THEN na::DOUBLE END AS Ag, round(p_retailprice / 1000, 6) AS k FROM comp""")
def q_read_dataset(spark: SparkSession, d: str) -> DataFrame:
    """A training table written as CSV with a byte order mark, unnamed and empty columns, blank cells and NaN."""
    place = shared.new_place(spark)
    amount = F.when(F.expr("id % 7 = 0"), "NaN").when(F.expr("id % 5 = 0"), " ").otherwise(F.col("na").cast("string"))
    rows = i.compositions(spark, d).select(
        F.col("formula").alias("﻿formula"), F.col("id").alias("Unnamed: 0"), amount.alias("Ag"), (F.col("p_retailprice") / 1000).alias("k"), F.lit(None).cast("string").alias("note")
    )
    rows.write.csv(place, header=True)
    return rounded(datasets.read_dataset(spark, place).select("formula", "Ag", "k"))


@registered(f"""WITH {i.COMP} SELECT id, CAST(id % 4 AS INT) AS iteration, CASE WHEN id % 4 = 1 THEN 'b' || id END AS extra FROM comp WHERE id % 4 < 3""")
def q_scan_iterations(spark: SparkSession, d: str) -> DataFrame:
    """Iteration 0 has both files, of which the first counts; 1 has only the second, 2 only the first, 3 neither."""
    place, rows = shared.new_place(spark), i.compositions(spark, d).select("id")
    for n, name in ((0, "a.csv"), (2, "a.csv")):
        rows.where(f"id % 4 = {n}").write.csv(f"{place}/iteration_{n}/success/{name}", header=True)
    for n, of in ((0, 3), (1, 1)):
        rows.where(f"id % 4 = {of}").withColumn("extra", F.concat(F.lit("b"), "id")).write.csv(f"{place}/iteration_{n}/success/b.csv", header=True)
    found = datasets.scan_iterations(spark, place, "success", ("a.csv", "b.csv"))
    return found.select(F.col("id").cast("long").alias("id"), "iteration", "extra")


@registered(f"""WITH {i.COMP} SELECT id, round(2 * p_retailprice, 6) AS k, 3 AS iteration FROM comp WHERE id % 10 = 3""")
def q_latest_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Iterations 0, 1, 2, 3 and 5 are written, 3 is replaced; the newest up to 4 is read."""
    place = shared.new_place(spark)
    rows = i.compositions(spark, d).select("id", F.col("p_retailprice").alias("k"), F.expr("cast(CASE id % 5 WHEN 4 THEN 5 ELSE id % 5 END AS int)").alias("iteration"))
    datasets.overwrite_iteration(rows, place)
    datasets.overwrite_iteration(rows.where("iteration = 3 AND id % 10 = 3").withColumn("k", F.col("k") * 2), place)
    return rounded(datasets.latest_snapshot(spark.read.parquet(place), 4))


@registered("""WITH r AS (SELECT o_orderkey, o_totalprice, [o_orderstatus, o_orderpriority] AS tags FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50)
SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank, o_orderkey AS id, '["' || tags[1] || '","' || tags[2] || '"]' AS tags FROM r""")
def q_export_ranked(spark: SparkSession, d: str) -> DataFrame:
    """The fifty largest orders as a ranked CSV report, read back."""
    from pyspark.sql import Window

    place, best = shared.new_place(spark), (F.col("o_totalprice").desc(), F.col("o_orderkey"))
    top = i.table(spark, d, "orders").orderBy(*best).limit(50)
    ranked = top.select(F.row_number().over(Window.orderBy(*best)).alias("rank"), F.col("o_orderkey").alias("id"), F.array("o_orderstatus", "o_orderpriority").alias("tags"))
    datasets.export_ranked(ranked, place)
    back = spark.read.csv(place, header=True, escape="\\")
    return back.select(F.col("rank").cast("long").alias("rank"), F.col("id").cast("long").alias("id"), "tags")


_HEAD = "'data_' || formula || chr(10) || '_symmetry_space_group_name_H-M   ''P ' || (1 + id % 4) || ''''"
#: The structure text of each part in SQL.
CIFS = f"""cifs AS (SELECT id, a, na, b, nb, c, nc, formula, {_HEAD} || chr(10) || '_cell_length_a   ' || (4 + id % 7) || '.25(2)' || chr(10) || '_cell_length_b   ' || (5 + id % 3)
  || '.123456' || chr(10) || '_cell_length_c   6.5' || chr(10) || '_cell_angle_alpha   ' || (85 + id % 90) || chr(10) || '_cell_angle_beta   90' || chr(10) || '_cell_angle_gamma   90' || chr(10)
  || '_cell_volume   ' || (100 + id % 50) || '.5' || chr(10) || '_cell_formula_units_Z   ' || (id % 3) || chr(10) || '_chemical_formula_structural   ' || formula || chr(10)
  || '_chemical_formula_sum   ''' || a || na || ' ' || b || nb || ' ' || c || nc || '''' || chr(10) || 'loop_' || chr(10) || ' _symmetry_equiv_pos_site_id' || chr(10)
  || ' _symmetry_equiv_pos_as_xyz' || chr(10) || '  1  ''x, y, z''' || chr(10) || '  2  ''-x, -y, -z''' || chr(10) || 'loop_' || chr(10) || ' _atom_site_type_symbol' || chr(10)
  || ' _atom_site_label' || chr(10) || ' _atom_site_symmetry_multiplicity' || chr(10) || ' _atom_site_fract_x' || chr(10) || ' _atom_site_fract_y' || chr(10) || ' _atom_site_fract_z' || chr(10)
  || '  ' || a || '  ' || a || '1  ' || na || '  0.0  0.0  0.0' || chr(10) || '  ' || b || '  ' || b || '2  ' || nb || '  0.5  0.5  0.5' || chr(10)
  || '  ' || c || '  ' || c || '3  ' || (nc + (id % 5 = 0)::INT) || '  0.25  0.123456  0.75' || chr(10) AS cif FROM comp)"""


@registered(f"WITH {i.COMP}, {CIFS} SELECT id::VARCHAR AS id, md5(cif) AS digest FROM cifs")
def q_structure_archives(spark: SparkSession, d: str) -> DataFrame:
    """Structure texts packed into archives, a partition each, and unpacked again."""
    packed = datasets.export_archives(_cifs(spark, d).withColumn("id", F.col("id").cast("string")), shared.new_place(spark))
    return datasets.unpack_archives(packed).select("id", F.md5("cif").alias("digest"))


@registered(f"WITH {i.COMP}, {CIFS} SELECT id::VARCHAR AS id, md5(cif) AS digest FROM cifs")
def q_benchmark_csv(spark: SparkSession, d: str) -> DataFrame:
    """Texts over several lines in the cells of a CSV file."""
    place = shared.new_place(spark)
    rows = _cifs(spark, d).select(F.col("id").alias("material_id"), "cif")
    rows.write.csv(place, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return datasets.read_benchmark(spark, place).select("id", F.md5("cif").alias("digest"))


@registered("""WITH s AS (SELECT s_suppkey AS n, 'F' || s_suppkey AS f, round(s_acctbal / 10000, 4) AS e FROM supplier)
SELECT 'MP' AS source, 'mp-' || n AS material_id, f AS formula, 'Pnma' AS symmetry, e AS stability, e + 1 AS band_gap, e AS energy_above_hull, 'https://materialsproject.org/materials/mp-' || n AS source_url, n % 3 = 0 AS structure_available FROM s WHERE n % 5 <> 0
UNION ALL SELECT 'OQMD', n::VARCHAR, f, 'R-3m', e, NULL, e, 'https://oqmd.org/materials/entry/' || n, false FROM s
UNION ALL SELECT 'AFLOW', 'aflow:' || n, f, CASE WHEN n % 2 = 0 THEN '62' ELSE 'Pnma' END, e, 0.5::DOUBLE, NULL, 'https://aflow.org/material/?id=aflow:' || n, n % 2 = 1 FROM s""")
def q_reference_records(spark: SparkSession, d: str) -> DataFrame:
    """Dumps of three sources, the last in two shapes, as one table of records; a blank formula gives none."""
    s = i.table(spark, d, "supplier").select(F.col("s_suppkey").alias("n"), F.concat(F.lit("F"), "s_suppkey").alias("f"), F.round(F.col("s_acctbal") / 10000, 4).alias("e"))
    structure, none = F.lit("data_x"), F.lit(None).cast("string")
    mp = F.struct(
        F.concat(F.lit("mp-"), "n").alias("material_id"), F.when(F.expr("n % 5 = 0"), " ").otherwise(F.col("f")).alias("formula_pretty"), F.struct(F.lit("Pnma").alias("symbol")).alias("symmetry"),
        F.col("e").alias("energy_above_hull"), (F.col("e") + 1).alias("band_gap"), F.when(F.expr("n % 3 = 0"), structure).alias("cif"),
    )
    oqmd = F.struct(F.col("n").alias("entry_id"), F.col("f").alias("name"), F.lit("R-3m").alias("spacegroup"), F.col("e").alias("stability"), F.lit("none").alias("band_gap"))
    aflow = F.struct(
        F.concat(F.lit("aflow:"), "n").alias("auid"), F.when(F.expr("n % 2 = 0"), F.col("f")).alias("compound"), F.when(F.expr("n % 2 = 1"), F.col("f")).alias("formula"),
        F.when(F.expr("n % 2 = 0"), 62).alias("spacegroup_relax"), F.when(F.expr("n % 2 = 1"), "Pnma").alias("sg2"), F.col("e").alias("enthalpy_formation_atom"),
        F.lit(0.5).alias("Egap"), F.when(F.expr("n % 2 = 1"), structure).otherwise(none).alias("cif"),
    )
    dumps = {name: s.select(F.to_json(shape).alias("value")) for name, shape in (("MP", mp), ("OQMD", oqmd), ("AFLOW", aflow))}
    return rounded(datasets.all_records(dumps).drop("metadata", "cif"))


@registered("""SELECT event_type AS cif_file, count(*) AS attempts, count(*) FILTER (value > 10) AS successes FROM events GROUP BY 1""")
def q_status_append(spark: SparkSession, d: str) -> DataFrame:
    """A status log appended to in two steps."""
    place, rows = shared.new_place(spark), i.table(spark, d, "events").select(F.col("event_type").alias("cif_file"), "user_id", (F.col("value") > 10).alias("ok"))
    for half in (0, 1):
        datasets.append_status(rows.where(f"user_id % 2 = {half}"), place)
    return spark.read.parquet(place).groupBy("cif_file").agg(F.count("*").alias("attempts"), F.count_if("ok").alias("successes"))


_BY_NATION = "p_type AS element, count(*)::DOUBLE AS mass, round(avg(p_size), 6) AS radius, CASE WHEN count(*) % 2 = 0 THEN 0.0::DOUBLE ELSE max(p_size)::DOUBLE END AS eneg"


@registered(f"""SELECT {_BY_NATION}, 3.0::DOUBLE AS "group", min(p_size)::DOUBLE AS period, 2.0::DOUBLE AS valence FROM part GROUP BY p_type""")
def q_element_json(spark: SparkSession, d: str) -> DataFrame:
    """A JSON map of properties with bare NaN values, one entry a part type."""
    place = shared.new_place(spark)
    stats = i.table(spark, d, "part").groupBy("p_type").agg(F.count("*").alias("n"), F.round(F.avg("p_size"), 6).alias("radius"), F.max("p_size").alias("hi"), F.min("p_size").alias("lo"))
    eneg = F.when(F.expr("n % 2 = 0"), "NaN").otherwise(F.col("hi").cast("string"))
    entry = F.format_string('"%s": {"mass": %d, "radius": %s, "eneg": %s, "group": 3, "period": %d, "valence": 2}', "p_type", "n", F.col("radius").cast("string"), eneg, "lo")
    # one row a part type: a small dimension
    stats.agg(F.concat(F.lit("{"), F.array_join(F.collect_list(entry), ","), F.lit("}")).alias("value")).write.text(place)
    return rounded(datasets.read_element_table(spark, place))


@registered("""SELECT p_type AS element, round(avg(p_size), 6) AS mean_size, round(max(p_retailprice), 6) AS top_price, CAST(NULL AS DOUBLE) AS missing FROM part GROUP BY 1""")
def q_element_vectors(spark: SparkSession, d: str) -> DataFrame:
    place = shared.new_place(spark)
    rows = i.table(spark, d, "part").groupBy("p_type").agg(F.round(F.avg("p_size"), 6).alias("v0"), F.round(F.max("p_retailprice"), 6).alias("v1"), F.lit("n/a").alias("v2"))
    rows.coalesce(1).write.csv(place, header=True)
    found = datasets.read_embeddings(spark, place)
    return found.select("element", *(F.get("vector", F.lit(n)).alias(c) for n, c in enumerate(("mean_size", "top_price", "missing"))))
