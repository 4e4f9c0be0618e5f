"""Reading and writing the search's tables: datasets, iteration partitions, snapshots, archives, reference dumps."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import values as vx


def read_dataset(spark: SparkSession, path: str, formula: str = "formula", target: str = "k") -> DataFrame:
    """A training table from CSV: a formula, numbers, a target.

    A byte order mark, blank-named and all-null columns go; NaN and blank cells become
    null. Raises ValueError if the formula or target column is absent or has nulls. One
    pass over the file profiles all columns."""
    raw = spark.read.csv(path, header=True, encoding="UTF-8")
    names = {c: c.lstrip("﻿").strip() for c in raw.columns}
    kept = [c for c in raw.columns if names[c] and not names[c].startswith(("_c", "Unnamed:"))]
    named = raw.select(*(vx.clean_text(F.col(f"`{c}`")).alias(names[c]) for c in kept))
    for c in (formula, target):
        if c not in named.columns:
            raise ValueError(f"column {c} is missing")
    profile = named.agg(F.count("*").alias("__rows"), *(F.count(F.col(f"`{c}`")).alias(c) for c in named.columns)).first()
    for c in (formula, target):
        if profile[c] < profile["__rows"]:
            raise ValueError(f"column {c} has {profile['__rows'] - profile[c]} missing values")
    full = [c for c in named.columns if profile[c] or c in (formula, target)]
    return named.select(*(F.col(f"`{c}`") if c == formula else vx.safe_double(F.col(f"`{c}`")).alias(c) for c in full))


def scan_iterations(spark: SparkSession, root: str, kind: str, preferred: Iterable[str]) -> DataFrame:
    """Result files of all iterations: of each iteration the first existing of the preferred names.

    Adds iteration, source_type and source_file from the path; columns that only some
    files have are null in others; no file at all gives an empty table with these three columns."""
    preferred = list(preferred)
    found = None
    for place, name in enumerate(preferred):
        try:
            rows = spark.read.csv(f"{root}/iteration_*/{kind}/{name}", header=True, encoding="UTF-8", mode="PERMISSIVE")
        except Exception as error:  # no file of this name in any iteration
            if "PATH_NOT_FOUND" not in str(error):
                raise
            continue
        rows = rows.withColumnsRenamed({c: c.lstrip("﻿") for c in rows.columns}).withColumns(
            {"source_file": F.col("_metadata.file_path"), "__place": F.lit(place)}
        )
        found = rows if found is None else found.unionByName(rows, allowMissingColumns=True)
    if found is None:
        return spark.createDataFrame([], "iteration int, source_type string, source_file string")
    numbered = found.withColumns(
        {"iteration": F.regexp_extract("source_file", r"iteration_(\d+)", 1).cast("int"), "source_type": F.lit(kind)}
    )
    best = numbered.groupBy("iteration").agg(F.min("__place").alias("__best"))
    return numbered.join(best, "iteration").where("__place = __best").drop("__place", "__best")


def latest_snapshot(table: DataFrame, n: int, column: str = "iteration") -> DataFrame:
    """Rows of the newest iteration up to n; on a partitioned table only that partition is read."""
    newest = table.where(F.col(column) <= n).agg(F.max(column).alias("n")).first()["n"]
    return table.where(F.col(column) == newest) if newest is not None else table.where(F.lit(False))


def overwrite_iteration(rows: DataFrame, path: str, column: str = "iteration") -> None:
    """Replace the iterations that ``rows`` holds in a partitioned table, and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def append_status(rows: DataFrame, path: str) -> None:
    """Append attempts to the status log."""
    rows.write.mode("append").parquet(path)


def export_ranked(ranked: DataFrame, path: str, kind: str = "csv", order: str = "rank") -> None:
    """One file of a ranked top-k result as CSV or JSON; nested columns become JSON text in CSV."""
    nested = [c for c, t in ranked.dtypes if t.startswith(("array", "map", "struct"))]
    flat = ranked.withColumns({c: F.to_json(F.col(c)) for c in nested}) if kind == "csv" and nested else ranked
    writer = flat.orderBy(order).coalesce(1).write.mode("overwrite")
    writer.csv(path, header=True) if kind == "csv" else writer.json(path)


def empty_like(spark: SparkSession, schema: str) -> DataFrame:
    """An empty source: no materials is a success, not an error."""
    return spark.createDataFrame([], schema)


def read_structures(spark: SparkSession, path: str) -> DataFrame:
    """(id, cif) from .tar.gz archives (one task each, members streamed) or loose .cif files under the path; id is the file's stem."""
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar.gz").option("recursiveFileLookup", "true").load(path)
    loose = spark.read.text(path, wholetext=True, pathGlobFilter="*.cif", recursiveFileLookup=True)
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)\.cif$", 1)

    return unpack_archives(archives).unionByName(loose.select(stem.alias("id"), F.col("value").alias("cif")))


def unpack_archives(archives: DataFrame) -> DataFrame:
    """(id, cif) of the .cif members of .tar.gz archives in the binary column ``content``, one task an archive, members streamed."""

    def members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import tarfile

        for frame in frames:
            for content in frame["content"]:
                with tarfile.open(fileobj=io.BytesIO(content), mode="r:gz") as archive:
                    for member in archive:
                        if member.isfile() and member.name.endswith(".cif"):
                            text = archive.extractfile(member).read().decode("utf-8", "replace")
                            yield pd.DataFrame({"id": [member.name.rsplit("/", 1)[-1][:-4]], "cif": [text]})

    return archives.select("content").mapInPandas(members, "id string, cif string")


def export_archives(structures: DataFrame, path: str) -> DataFrame:
    """(content, n): one .tar.gz of (id, cif) for each partition, as bytes to write out; the table itself stays Parquet at ``path``."""
    structures.write.mode("overwrite").parquet(path)

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import tarfile

        buffer, n = io.BytesIO(), 0
        with tarfile.open(fileobj=buffer, mode="w:gz") as archive:
            for frame in frames:
                for name, text in zip(frame["id"], frame["cif"]):
                    data = (text or "").encode()
                    info = tarfile.TarInfo(f"{name}.cif")
                    info.size = len(data)
                    archive.addfile(info, io.BytesIO(data))
                    n += 1
        if n:
            yield pd.DataFrame({"content": [buffer.getvalue()], "n": [n]})

    return structures.sparkSession.read.parquet(path).select("id", "cif").mapInPandas(pack, "content binary, n long")


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """(id, cif) of a benchmark CSV with columns material_id and cif, texts over several lines."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return rows.select(F.col("material_id").alias("id"), "cif")


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """(element, vector) of a CSV whose first column names the element."""
    rows = spark.read.csv(path, header=True)
    name, *rest = rows.columns
    return rows.select(F.col(f"`{name}`").alias("element"), F.array(*(F.col(f"`{c}`").try_cast("double") for c in rest)).alias("vector"))


def read_element_table(spark: SparkSession, path: str) -> DataFrame:
    """(element, mass, radius, eneg, group, period, valence) of a JSON map of elements; NaN counts as 0."""
    inner = "struct<mass: double, radius: double, eneg: double, `group`: double, period: double, valence: double>"
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"\bNaN\b", "0").alias("value"))
    rows = text.select(F.explode(F.from_json("value", f"map<string, {inner}>")).alias("element", "p")).select("element", "p.*")
    return rows.select("element", *(F.coalesce(F.col(f"`{c}`"), F.lit(0.0)).alias(c) for c in rows.columns[1:]))


def valence_electrons(group: F.Column) -> F.Column:
    """Valence electrons by group: those of groups 1 and 2, of 13 to 18 less ten, else the group's number up to 12 at most."""
    return F.when(group >= 13, group - 10).otherwise(F.least(group, F.lit(12)))


#: Of each reference source the path of a unified field in its dumps, several where shapes differ.
RECORD_FIELDS = {
    "MP": {"material_id": ("material_id",), "formula": ("formula_pretty", "formula"), "symmetry": ("symmetry.symbol",), "stability": ("energy_above_hull",),
           "band_gap": ("band_gap",), "energy_above_hull": ("energy_above_hull",), "cif": ("cif",)},
    "OQMD": {"material_id": ("entry_id",), "formula": ("name", "composition"), "symmetry": ("spacegroup",), "stability": ("stability",), "band_gap": ("band_gap",),
             "energy_above_hull": ("stability",), "cif": ("cif",)},
    "AFLOW": {"material_id": ("auid",), "formula": ("compound", "formula"), "symmetry": ("spacegroup_relax", "sg2"), "stability": ("enthalpy_formation_atom",),
              "band_gap": ("Egap",), "energy_above_hull": ("energy_above_hull",), "cif": ("cif",)},
}
RECORD_URLS = {"MP": "https://materialsproject.org/materials/", "OQMD": "https://oqmd.org/materials/entry/", "AFLOW": "https://aflow.org/material/?id="}


def reference_records(dump: DataFrame, source: str, text: str = "value") -> DataFrame:
    """Unified records from a dump of one JSON object a row: typed fields, url, structure_available and the rest as metadata."""

    def field(name: str) -> F.Column:
        return F.coalesce(*(vx.clean_text(F.get_json_object(F.col(text), f"$.{p}")) for p in RECORD_FIELDS[source][name]))

    numbers = ("stability", "band_gap", "energy_above_hull")
    typed = {n: vx.safe_double(field(n)) if n in numbers else field(n) for n in RECORD_FIELDS[source]}
    rows = dump.select(F.lit(source).alias("source"), *(c.alias(n) for n, c in typed.items()), F.from_json(text, "map<string, string>").alias("metadata"))
    return rows.where("formula IS NOT NULL").withColumns(
        {"source_url": F.concat(F.lit(RECORD_URLS[source]), "material_id"), "structure_available": F.col("cif").isNotNull()}
    )


def all_records(dumps: dict[str, DataFrame]) -> DataFrame:
    """Unified records of several sources."""
    out = None
    for source, dump in dumps.items():
        rows = reference_records(dump, source)
        out = rows if out is None else out.unionByName(rows)
    return out


def first_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key, the first in an order."""
    window = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("__n", F.row_number().over(window)).where("__n = 1").drop("__n")
