"""Column expressions that type and repair drifting input values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spellings of "no imaginary frequency" and of its opposite.
NO = ("否", "no", "n", "false", "0")
YES = ("是", "yes", "y", "true", "1")


def clean_text(column: Column) -> Column:
    """Text without surrounding white space; blank and the text of a missing number become null."""
    text = F.trim(column.cast("string"))
    return F.when((text == "") | F.lower(text).isin("nan", "none"), F.lit(None)).otherwise(text)


def safe_double(column: Column, default: float | None = None) -> Column:
    """Double of the first white-space token; anything else, and NaN, is the default."""
    token = F.get(F.split(F.trim(column.cast("string")), r"\s+"), F.lit(0))
    number = token.try_cast("double")
    return F.coalesce(F.when(~F.isnan(number), number), F.lit(default).cast("double"))


def coalesce_alias(df: DataFrame, names: list[str], pattern: str | None = None) -> Column:
    """First non-blank of the aliases that ``df`` has; then of any column whose name matches ``pattern``."""
    import re

    present = [n for n in names if n in df.columns]
    if pattern:
        present += [c for c in df.columns if c not in present and re.search(pattern, c)]
    return F.coalesce(*(clean_text(F.col(f"`{n}`")) for n in present)) if present else F.lit(None).cast("string")


def no_imaginary_flag(column: Column) -> Column:
    """True for a spelling of "no", false for anything else, null included."""
    return F.coalesce(F.lower(F.trim(column.cast("string"))).isin(*NO), F.lit(False))


def derive_seed(*parts: Column) -> Column:
    """First 8 bytes of sha256 of the ``::``-joined parts, modulo 2^32 - 1."""
    digest = F.sha2(F.concat_ws("::", *(p.cast("string") for p in parts)), 256)
    return (F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(4294967295).cast("decimal(20,0)")).cast("long")


def coerce_list(text: Column) -> Column:
    """array<string> of a bracketed list (either quote) or of one plain value; blank gives an empty array."""
    trimmed = F.trim(text)
    listed = F.from_json(F.translate(trimmed, "'", '"'), "array<string>")
    whole = F.when(trimmed.startswith("[") & listed.isNotNull(), listed).otherwise(F.array(trimmed))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.array().cast("array<string>")).otherwise(whole)


def structure_id(name: Column) -> Column:
    """File name without its .cif ending."""
    return F.regexp_replace(name, r"(?i)\.cif$", "")


def generation_of(name: Column) -> Column:
    """struct<id, n> of ``id__n.cif``, split at the last double underscore; null fields without one."""
    pattern = r"^(.*)__([^_]*)\.cif$"
    return F.struct(
        F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")).alias("id"), F.nullif(F.regexp_extract(name, pattern, 2), F.lit("")).alias("n")
    )


def structure_variant(path: Column) -> Column:
    """original, primitive or conventional, by the directory in a path."""
    low = F.lower(path)
    return F.when(low.contains("primitive"), "primitive").when(low.contains("conventional"), "conventional").otherwise("original")


def version_key(version: Column) -> Column:
    """Array of integers of ``v0.0.n``, which orders as versions do."""
    return F.transform(F.regexp_extract_all(version, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("int"))
