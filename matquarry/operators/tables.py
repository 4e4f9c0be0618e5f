"""Table jobs that bring formulas and records into their standard form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import formulas as fx
from ..functions import values as vx
from .results import success_records

#: Typed columns of each kind of record and the input names each takes its value from, in order.
KINDS = {
    "kappa": {
        "formula": ("formula", "Formula", "composition", "Composition"), "cif_file": ("cif_file", "CIF_File", "CIF文件"),
        "structure_id": ("structure_id", "Structure_ID"), "space_group": ("space_group", "Space_Group"),
        "k": ("thermal_conductivity_w_mk", "kappa_slack", "kappa", "k"), "volume": ("Volume (Å³)", "Volume", "volume"),
    },
    "phonon": {
        "formula": ("formula", "Formula"), "cif_file": ("cif_file", "CIF_File"), "has_imaginary": ("has_imaginary", "Has_Imaginary_Freq"),
        "min_frequency": ("min_frequency", "Min_Frequency"), "gamma_min_optical": ("gamma_min_optical", "Gamma_Min_Optical"),
        "gamma_max_acoustic": ("gamma_max_acoustic", "Gamma_Max_Acoustic"),
    },
}
NUMBERS = ("k", "volume", "min_frequency", "gamma_min_optical", "gamma_max_acoustic")


def standardise_formulas(rows: DataFrame, formula: str = "formula", key: str = "id") -> DataFrame:
    """(key, normalized, canonical, reduced, elements, n_elements, total_atoms, composition) of each row; a null formula gives nulls."""
    parsed = rows.select(key, F.col(formula).alias("__f"), fx.parse_formula(F.col(formula)).alias("composition"))
    return parsed.select(
        key,
        fx.normalize_formula(F.col("__f")).alias("normalized"),
        fx.canonical_formula(F.col("__f")).alias("canonical"),
        fx.reduced_formula(F.col("__f")).alias("reduced"),
        fx.element_set(F.col("__f")).alias("elements"),
        fx.n_elements(F.col("composition")).alias("n_elements"),
        fx.total_atoms(F.col("composition")).alias("total_atoms"),
        "composition",
    )


def conform_records(rows: DataFrame, kind: str) -> DataFrame:
    """Typed records of a kind (kappa, phonon, success) from columns under any of their known names; what is absent is null."""
    if kind == "success":
        return success_records(rows)
    columns = []
    for out, names in KINDS[kind].items():
        value = vx.coalesce_alias(rows, list(names), r"W/m.*K" if out == "k" else None)
        columns.append((vx.safe_double(value) if out in NUMBERS else value).alias(out))
    typed = rows.select(*columns)
    return typed.withColumn("no_imaginary", vx.no_imaginary_flag(F.col("has_imaginary"))) if kind == "phonon" else typed
