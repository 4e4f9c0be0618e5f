"""Result tables: joining, classifying, keeping the best, and dataset upkeep."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formulas as fx
from ..functions import values as vx

STABILITY = ("has_imaginary", "min_frequency", "gamma_min_optical", "gamma_max_acoustic")


def latest_rows(log: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """One row for each key: the last in the order of ``by``, nulls first; ties by the other columns."""
    rest = [c for c in log.columns if c not in (*keys, *by)]
    order = Window.partitionBy(*keys).orderBy(*(F.col(c).desc_nulls_last() for c in (*by, *rest)))
    return log.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def merge_stability(kappa: DataFrame, phonon: DataFrame, keys: list[str], by: list[str], columns: Iterable[str] = STABILITY) -> DataFrame:
    """``kappa`` with the stability columns of the latest ``phonon`` row of each key.

    A value of the left side wins, the right side fills nulls; a column that neither
    has is null. The log is append-only, so it is reduced to a row a key first."""
    columns = list(columns)
    latest = latest_rows(phonon, keys, by)
    right = latest.select(*keys, *(F.col(c).alias(f"__{c}") for c in columns if c in phonon.columns))
    joined = kappa.join(right, keys, "left")

    def merged(c: str) -> Column:
        found = [F.col(x) for x in (c if c in kappa.columns else None, f"__{c}" if c in phonon.columns else None) if x]
        return (F.coalesce(*found) if found else F.lit(None).cast("string")).alias(c)

    return joined.select(*(F.col(c) for c in kappa.columns if c not in columns), *map(merged, columns))


def backfill_stability(
    rows: DataFrame, phonon: DataFrame | None, other: DataFrame | None = None, by: tuple[str, ...] = ("ts",), columns: Iterable[str] = STABILITY
) -> DataFrame:
    """``rows`` as they are if they have every stability column, else merged with the first log that is there.

    Keys are those of cif_file and structure_id that both sides have; without a log or a key ``rows`` stay as they are."""
    columns = list(columns)
    log = phonon if phonon is not None else other
    if log is None or all(c in rows.columns for c in columns):
        return rows
    keys = [c for c in ("cif_file", "structure_id") if c in rows.columns and c in log.columns]
    return merge_stability(rows, log, keys, [c for c in by if c in log.columns] or keys, columns) if keys else rows


def classify_stability(rows: DataFrame, tolerance: float = -0.1, frequency: str = "min_frequency", flag: str = "has_imaginary") -> DataFrame:
    """``rows`` with stability_class and dynamic_stable.

    By the lowest frequency: strict_stable from 0, quasi_stable from the tolerance,
    unstable below; without one, by the flag (strict_stable_by_flag, unstable_by_flag)."""
    no_imaginary = vx.no_imaginary_flag(F.col(flag)) if flag in rows.columns else F.lit(False)
    by_flag = F.when(no_imaginary, "strict_stable_by_flag").otherwise("unstable_by_flag")
    if frequency not in rows.columns:
        return rows.withColumns({"stability_class": by_flag, "dynamic_stable": no_imaginary})
    value = vx.safe_double(F.col(frequency))
    by_value = F.when(value >= 0, "strict_stable").when(value >= tolerance, "quasi_stable").when(value < tolerance, "unstable")
    return rows.withColumns(
        {
            "stability_class": F.when(value.isNull(), by_flag).otherwise(by_value),
            "dynamic_stable": F.when(value.isNull(), no_imaginary).otherwise(value >= tolerance),
        }
    )


def success(classified: DataFrame, threshold: float = 1.0, k: str = "k") -> DataFrame:
    """Stable rows with k below the threshold."""
    return classified.where(F.col("dynamic_stable") & (F.col(k) < threshold))


def stable(classified: DataFrame, threshold: float = 5.0, k: str = "k") -> DataFrame:
    """Stable rows with k below the wider threshold."""
    return success(classified, threshold, k)


def filter_stable(phonons: DataFrame, tolerance: float = -0.1, frequency: str = "min_frequency") -> DataFrame:
    """Structures whose lowest frequency is known and not below the tolerance."""
    return phonons.where(F.col(frequency) >= tolerance)


def exact_distinct(rows: DataFrame) -> DataFrame:
    """The fallback where rows name no structure to compare: rows that are equal in all columns count once."""
    return rows.dropDuplicates()


def below_threshold(rows: DataFrame, threshold: float, k: str = "k") -> DataFrame:
    """Rows with a k below the threshold; null and NaN are not."""
    return rows.where(F.col(k).isNotNull() & ~F.isnan(k) & (F.col(k) < threshold))


def usable_rows(rows: DataFrame, formula_names: list[str], k_names: list[str], k_pattern: str | None = r"W/m.*K") -> DataFrame:
    """``rows`` with columns ``formula`` and ``k`` from the first usable alias; rows without either are left out."""
    formula = vx.coalesce_alias(rows, formula_names)
    k = vx.safe_double(vx.coalesce_alias(rows, k_names, k_pattern))
    return rows.withColumns({"formula": formula, "k": k}).where(F.col("formula").isNotNull() & F.col("k").isNotNull())


def warm_start(success_rows: DataFrame, stable_rows: DataFrame, threshold: float = 5.0, k: str = "k") -> DataFrame:
    """The success rows; where there are none, the stable rows with k below the threshold."""
    first = success_rows.withColumn("__source", F.lit(0))
    second = stable_rows.where(F.col(k) < threshold).withColumn("__source", F.lit(1))
    every = first.unionByName(second, allowMissingColumns=True)
    best = success_rows.select(F.lit(0).alias("__best")).limit(1)
    have = best.agg(F.count("*").alias("__have"))
    return every.join(F.broadcast(have)).where((F.col("__source") == 0) | (F.col("__have") == 0)).drop("__source", "__have")


def lowest_k(rows: DataFrame, keys: list[str], k: str = "k", ties: tuple[str, ...] = ()) -> DataFrame:
    """One row for each key: the lowest k, ties by the given columns."""
    order = Window.partitionBy(*keys).orderBy(F.col(k).asc_nulls_last(), *ties)
    return rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def update_dataset(origin: DataFrame, winners: DataFrame, elements: tuple[str, ...] = fx.FEATURE_ELEMENTS) -> DataFrame:
    """(formula, <elements>, k): both tables' rows featurised, the lowest k of each formula kept.

    Formulas lose their white space. Rows without a formula or k are left out."""
    both = origin.select("formula", "k").unionByName(winners.select("formula", "k"))
    plain = both.select(F.regexp_replace("formula", r"\s+", "").alias("formula"), "k").where("formula <> '' AND k IS NOT NULL AND NOT isnan(k)")
    best = plain.groupBy("formula").agg(F.min("k").alias("k"))
    composition = fx.parse_formula(F.col("formula"))
    with_map = best.withColumn("__c", composition)
    return with_map.select("formula", *(F.coalesce(F.col("__c")[e], F.lit(0.0)).alias(e) for e in elements), "k")


def aggregate_materials(success_rows: DataFrame, stable_rows: DataFrame) -> DataFrame:
    """(formula, id, iteration, k, source): the lowest k of each material over iterations, success before stable.

    A material is its formula and its path or structure id."""

    def picked(rows: DataFrame, stable: bool) -> DataFrame:
        chosen = rows.select("formula", F.coalesce("path", "structure_id").alias("id"), F.struct("k", F.lit(stable).alias("stable"), "iteration").alias("r"))
        return chosen.where("formula IS NOT NULL AND r.k IS NOT NULL")

    # one aggregate, which combines before the shuffle
    best = picked(success_rows, False).unionByName(picked(stable_rows, True)).groupBy("formula", "id").agg(F.min("r").alias("r"))
    return best.select("formula", "id", "r.iteration", "r.k", F.when(F.col("r.stable"), "stable").otherwise("success").alias("source"))


def complete_results(tasks: DataFrame, results: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Every task with its result; missing results take the defaults."""
    joined = tasks.join(results.dropDuplicates([key]), key, "left")
    return joined.select(*(F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in joined.columns))


def join_properties(tables: list[DataFrame], key: str = "structure_id") -> DataFrame:
    """Inner join of property tables on the structure id."""
    return reduce(lambda a, b: a.join(b, key), tables)


def drop_removed(rows: DataFrame, removed: DataFrame, name: str = "cif_file") -> DataFrame:
    """Rows whose file is not among the removed ones; .cif endings do not matter."""
    gone = removed.select(vx.structure_id(F.col(name)).alias("__id")).distinct()
    return rows.join(gone, vx.structure_id(rows[name]) == gone["__id"], "left_anti")


def extraction_counts(classified: DataFrame, by: str = "source_file", k: str = "k", threshold: float = 1.0, wide: float = 5.0) -> DataFrame:
    """Rows, stable, quasi-stable, success and stable-set counts of each source."""
    ok = F.col("dynamic_stable")
    return classified.groupBy(by).agg(
        F.count("*").alias("n"),
        F.count_if(ok).alias("n_dynamic_stable"),
        F.count_if(F.col("stability_class") == "quasi_stable").alias("n_quasi_stable"),
        F.count_if(ok & (F.col(k) < threshold)).alias("n_success"),
        F.count_if(ok & (F.col(k) < wide)).alias("n_stable"),
    )


def task_progress(log: DataFrame, by: str = "formula") -> DataFrame:
    """Attempts and successes of each material."""
    return log.groupBy(by).agg(
        F.count("*").alias("processed"), F.count_if("relax_success").alias("relax_success"), F.count_if("phonon_success").alias("phonon_success")
    )


def unfinished(sources: DataFrame, attempted: DataFrame, produced: DataFrame, keys: list[str]) -> DataFrame:
    """Source files neither attempted nor produced: a material is complete if it has none."""
    done = attempted.select(*keys).union(produced.select(*keys)).distinct()
    return sources.select(*keys).distinct().join(done, keys, "left_anti")


def top_messages(log: DataFrame, column: str = "error", n: int = 3) -> DataFrame:
    """The n most frequent messages, ties by text."""
    counted = log.where(vx.clean_text(F.col(column)).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counted.orderBy(F.col("n").desc(), column).limit(n)


def phonon_summary(bands: DataFrame, tolerance: float = -0.1) -> DataFrame:
    """(structure_id, min, max, gamma_min_optical, gamma_max_acoustic, has_imaginary) from (structure_id, q_index, is_gamma, branch, frequency).

    Branches 1 to 3 are acoustic. A structure without optical branches takes its lowest
    and highest frequency instead."""
    f, gamma = F.col("frequency"), F.col("is_gamma")
    few = F.max("branch") <= 3
    return bands.groupBy("structure_id").agg(
        F.min(f).alias("min_frequency"),
        F.max(f).alias("max_frequency"),
        F.when(few, F.min(f)).otherwise(F.min(F.when(gamma & (F.col("branch") > 3), f))).alias("gamma_min_optical"),
        F.when(few, F.max(f)).otherwise(F.max(F.when(gamma & (F.col("branch") <= 3), f))).alias("gamma_max_acoustic"),
        (F.min(f) < tolerance).alias("has_imaginary"),
    )


#: Output columns of a success record and the input names each takes its value from, in order.
SUCCESS_COLUMNS = {
    "composition": ("Composition", "composition"), "formula": ("Formula", "formula", "composition"),
    "material_dir": ("material_dir", "Material_Dir"), "structure_id": ("Structure_ID", "structure_id"),
    "cif_file": ("CIF_File", "cif_file"), "structure": ("structure", "Structure"), "space_group": ("Space_Group", "space_group"),
    "thermal_conductivity_w_mk": ("thermal_conductivity_w_mk", "kappa_slack", "kappa", "k"),
    "volume_a3": ("Volume (Å³)", "Volume", "volume"), "density_g_cm3": ("Density (g/cm³)", "Density", "density"),
    "n_atoms": ("Number of Atoms", "n_atoms"), "debye_temperature_k": ("Debye_Temperature", "debye_temperature"),
    "gruneisen_parameter": ("Gruneisen", "gruneisen"), "min_frequency": ("Min_Frequency", "min_frequency"),
    "gamma_min_optical": ("Gamma_Min_Optical", "gamma_min_optical"), "gamma_max_acoustic": ("Gamma_Max_Acoustic", "gamma_max_acoustic"),
    "csv_path": ("csv_path",), "relative_cif_path": ("relative_cif_path", "path"),
}
NUMERIC = ("thermal_conductivity_w_mk", "volume_a3", "density_g_cm3", "n_atoms", "debye_temperature_k", "gruneisen_parameter",
           "min_frequency", "gamma_min_optical", "gamma_max_acoustic")


def success_records(classified: DataFrame, tolerance: float = -0.1) -> DataFrame:
    """Typed success records from drifting result columns, with structure_type, stability_class, dynamic_stable and imag_tol_thz."""
    columns = [
        (vx.safe_double(vx.coalesce_alias(classified, list(names))) if out in NUMERIC else vx.coalesce_alias(classified, list(names))).alias(out)
        for out, names in SUCCESS_COLUMNS.items()
    ]
    place = vx.coalesce_alias(classified, ["relative_cif_path", "path", "material_dir"])
    kept = [c for c in ("stability_class", "dynamic_stable", "iteration") if c in classified.columns]
    return classified.select(*columns, vx.structure_variant(F.coalesce(place, F.lit(""))).alias("structure_type"), *kept, F.lit(tolerance).alias("imag_tol_thz"))


def compact_results(rows: DataFrame, n: int = 20) -> DataFrame:
    """(rank, formula, path, k) of the n lowest k."""
    order = [F.col("k").asc_nulls_last(), F.col("formula"), F.col("path")]
    best = rows.select("formula", "path", "k").orderBy(*order).limit(n)
    return best.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), "formula", "path", "k")
