"""Structure texts (CIF): typed tables, quality gates, duplicates, and corpus preparation."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import formulas as fx
from ..functions import numeric as nx
from ..sources import shared

LENGTHS, ANGLES = ("a", "b", "c"), ("alpha", "beta", "gamma")
SPACE_GROUP, SUM = "_symmetry_space_group_name_H-M", "_chemical_formula_sum"
XYZ = "_symmetry_equiv_pos_as_xyz"


def cif_property(text: Column, tag: str) -> Column:
    """Value of a tag, quoted or bare, case of the tag aside; null where the tag is absent."""
    head = rf"(?i){re.escape(tag)}\s+"
    found = [F.nullif(F.regexp_extract(text, head + body, 1), F.lit("")) for body in ("'([^']*)'", '"([^"]*)"', r"""([^\s'"]\S*)""")]
    return F.coalesce(*found)


def cif_number(text: Column, tag: str) -> Column:
    """Number of a tag without its uncertainty in parentheses; null where it is none."""
    return F.regexp_replace(cif_property(text, tag), r"\(.*\)", "").try_cast("double")


def structure_table(structures: DataFrame, text: str = "cif") -> DataFrame:
    """``structures`` with data_formula, formula_sum, formula_structural, space_group, z, volume, lattice and cell_volume.

    Missing tags are null; cell_volume is computed from the lattice."""
    t = F.col(text)
    cell = {x: cif_number(t, f"_cell_length_{x}") for x in LENGTHS} | {x: cif_number(t, f"_cell_angle_{x}") for x in ANGLES}
    lattice = F.struct(*(c.alias(x) for x, c in cell.items()))
    return structures.withColumns(
        {
            "data_formula": F.nullif(F.regexp_extract(t, r"data_([A-Za-z0-9]+)", 1), F.lit("")),
            "formula_sum": cif_property(t, SUM),
            "formula_structural": cif_property(t, "_chemical_formula_structural"),
            "space_group": cif_property(t, SPACE_GROUP),
            "z": cif_number(t, "_cell_formula_units_Z").cast("int"),
            "volume": cif_number(t, "_cell_volume"),
            "lattice": lattice,
            "cell_volume": fx.let(lattice, lambda v: nx.cell_volume(*(v[x] for x in (*LENGTHS, *ANGLES)))),
        }
    )


def atom_sites(structures: DataFrame, key: str = "id", text: str = "cif") -> DataFrame:
    """(key, position, element, multiplicity, x, y, z): rows of the atom-site loop, columns in the order of its header."""
    block = F.regexp_extract(F.col(text), r"(?i)loop_\s*\n((?:[ \t]*_atom_site_[^\n]*\n)+(?:[ \t]*(?!loop_|_|data_|#)[^\s][^\n]*(?:\n|$))*)", 1)
    lines = F.filter(F.transform(F.split(block, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    header = F.transform(F.filter(lines, lambda x: x.startswith("_")), F.lower)
    rows = F.filter(lines, lambda x: ~x.startswith("_"))
    each = structures.select(key, header.alias("h"), F.posexplode(rows).alias("position", "line"))
    cells = each.withColumn("c", F.split("line", r"\s+"))

    def cell(name: str) -> Column:
        at = F.array_position("h", F.lit(f"_atom_site_{name}"))
        return F.when(at > 0, F.get(F.col("c"), (at - 1).cast("int")))

    def number(name: str) -> Column:
        return F.regexp_replace(cell(name), r"\(.*\)", "").try_cast("double")

    element = F.regexp_extract(F.coalesce(cell("type_symbol"), cell("label")), "^[A-Z][a-z]?", 0)
    return cells.select(
        key,
        "position",
        element.alias("element"),
        F.coalesce(number("symmetry_multiplicity").cast("int"), F.lit(1)).alias("multiplicity"),
        *(number(f"fract_{x}").alias(x) for x in ("x", "y", "z")),
    )


def is_sensible(text: Column, length: tuple[float, float] = (0.5, 1000.0), angle: tuple[float, float] = (10.0, 170.0)) -> Column:
    """Every cell length and angle within bounds; texts without them pass."""

    def inside(pattern: str, bounds: tuple[float, float]) -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        return F.forall(found, lambda x: F.coalesce(x.try_cast("double"), F.lit(bounds[0])).between(*bounds))

    return inside(r"_cell_length_[abc]\s+([\d.]+)", length) & inside(r"_cell_angle_(?:alpha|beta|gamma)\s+([\d.]+)", angle)


def is_formula_consistent(table: DataFrame) -> Column:
    """Data line, formula sum and structural formula reduce to one formula; a missing one is no agreement."""
    keys = [fx.reduced_formula(F.col(c)) for c in ("data_formula", "formula_sum", "formula_structural")]
    return F.coalesce((keys[0] == keys[1]) & (keys[1] == keys[2]), F.lit(False))


def multiplicity_check(table: DataFrame, sites: DataFrame, key: str = "id") -> DataFrame:
    """(key, multiplicity_consistent): sums of site multiplicities equal the counts of the formula sum."""
    stated = table.select(key, F.explode(fx.parse_formula(F.col("formula_sum"))).alias("element", "stated"))
    actual = sites.groupBy(key, "element").agg(F.sum("multiplicity").cast("double").alias("actual"))
    both = stated.join(actual, [key, "element"], "full")
    checked = both.groupBy(key).agg(F.bool_and(F.coalesce(F.col("stated") == F.col("actual"), F.lit(False))).alias("same"))
    return table.select(key).join(checked, key, "left").select(key, F.coalesce("same", F.lit(False)).alias("multiplicity_consistent"))


def site_distances(table: DataFrame, sites: DataFrame, radius: float = 8.0, key: str = "id", most: int = 64) -> DataFrame:
    """(key, i, j, distance): distances of site pairs with periodic images within the radius.

    Structures of at most ``most`` sites pair them in place: of each pair only the images in the box of that radius are made, axis by axis. Larger
    ones meet through cubes. No pair within the radius is missed. A site's own images count. Cells without a volume give no rows.
    Sites and cells are written once, a row a structure."""
    cart = {
        "ax": F.col("a"),
        "bx": F.expr("b * cos(radians(gamma))"),
        "by": F.expr("b * sin(radians(gamma))"),
        "cx": F.expr("c * cos(radians(beta))"),
        "cy": F.expr("c * (cos(radians(alpha)) - cos(radians(beta)) * cos(radians(gamma))) / sin(radians(gamma))"),
    }
    # heights over the faces: the volume over each face's area
    faces = {"u": "b * c * sin(radians(alpha))", "v": "a * c * sin(radians(beta))", "w": "a * b * sin(radians(gamma))"}
    steps = {f"n{x}": F.expr(f"cast(ceil({radius} * {area} / (ax * by * cz)) + 1 AS int)") for x, area in faces.items()}
    cell = table.groupBy(key).agg(F.first("lattice").alias("lattice")).select(key, "lattice.*").withColumns(cart).withColumn("cz", F.expr("sqrt(greatest(0, c * c - cx * cx - cy * cy))"))
    cell = cell.where("ax * by * cz > 1e-6").withColumns(steps).select(key, *cart, "cz", *steps)
    own = sites.where("x + y + z IS NOT NULL").groupBy(key).agg(F.collect_list(F.struct("position", "x", "y", "z")).alias("__sites"))
    whole = shared.written(own.join(cell, key))
    found = _pairs_in_place(whole.where(F.size("__sites") <= most), radius, key)
    large = whole.where(F.size("__sites") > most)
    return found if large.isEmpty() else found.unionByName(_pairs_by_cubes(large.select(F.inline("__sites"), key, *cart, "cz", *steps), [*cart, "cz"], radius, key))


_DISTANCE = "sqrt(pow(ax * fx + bx * fy + cx * fz, 2) + pow(by * fy + cy * fz, 2) + pow(cz * fz, 2))"


def _pairs_in_place(whole: DataFrame, radius: float, key: str) -> DataFrame:
    """Pairs of structures that hold their sites as an array, dealt by key so that what groups them by it needs no other shuffle."""
    edge = f"{radius * (1 + 1e-9)!r}D"

    def images(rows: DataFrame, axis: str, rest: str, height: str, start: str) -> DataFrame:
        """A row for each whole number of the axis that brings rest + height * (start + number) within the radius."""
        middle, half = f"(-({rest}) / {height} - {start})", f"({edge} / abs({height}) + 1e-9)"
        ends = rows.withColumns({"__lo": F.expr(f"ceil({middle} - {half})"), "__hi": F.expr(f"floor({middle} + {half})")})
        return ends.withColumn(axis, F.explode(F.expr("CASE WHEN __lo <= __hi THEN sequence(__lo, __hi) ELSE cast(array() AS array<bigint>) END"))).drop("__lo", "__hi")

    dealt = whole.repartition(int(whole.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    pairs = dealt.withColumn("l", F.explode("__sites")).withColumn("r", F.explode("__sites")).drop("__sites")
    pairs = pairs.withColumns({f"d{x}": F.expr(f"r.{x} - l.{x}") for x in "xyz"})
    pairs = images(pairs, "w", "0D", "cz", "dz").withColumn("fz", F.expr("dz + w"))
    pairs = images(pairs, "v", "cy * fz", "by", "dy").withColumn("fy", F.expr("dy + v"))
    pairs = images(pairs, "u", "bx * fy + cx * fz", "ax", "dx").withColumn("fx", F.expr("dx + u"))
    others = pairs.where("l.position <> r.position OR u <> 0 OR v <> 0 OR w <> 0")
    return others.select(key, F.col("l.position").alias("i"), F.col("r.position").alias("j"), F.expr(_DISTANCE).alias("distance")).where(F.col("distance") <= radius)


def _pairs_by_cubes(placed: DataFrame, cart: list[str], radius: float, key: str) -> DataFrame:
    """Pairs of structures of any size, a row a site.

    Sites and images of a structure are dealt to cubes as wide as the radius, and a site meets the images of its cube and the 26 around, so
    the pairs tried grow with those found, however large a structure is. Along each axis as many images are made as the radius holds
    distances between the cell's faces, and one more, as positions inside a cell differ by less than one; those farther than the radius from the box
    around the sites are left out."""
    at = {"px": "ax * ({x}) + bx * ({y}) + cx * ({z})", "py": "by * ({y}) + cy * ({z})", "pz": "cz * ({z})"}
    edge = radius * (1 + 1e-9)  # so that rounding does not part neighbours by two cubes

    def cubes(names: str) -> list[Column]:
        return [F.floor(F.col(f"p{x}") / edge).alias(f"q{x}") for x in names]

    home = placed.withColumns({c: F.expr(e.format(x="x", y="y", z="z")) for c, e in at.items()})
    box = home.groupBy(key).agg(*(f(c).alias(f"{n}_{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in at))
    images = placed
    for axis in "uvw":
        images = images.withColumn(axis, F.explode(F.expr(f"sequence(-n{axis}, n{axis})")))
    images = images.withColumns({c: F.expr(e.format(x="x + u", y="y + v", z="z + w")) for c, e in at.items()}).join(box, key)
    for c in at:
        images = images.where(F.col(c).between(F.col(f"lo_{c}") - edge, F.col(f"hi_{c}") + edge))
    images = images.select(key, F.col("position").alias("j"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("z").alias("z2"), "u", "v", "w", *cubes("xyz"))
    left = home.select(key, F.col("position").alias("i"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("z").alias("z1"), *cart, *cubes("xyz"))
    for axis in "xyz":
        left = left.withColumn(f"q{axis}", F.explode(F.array(*(F.col(f"q{axis}") + d for d in (-1, 0, 1)))))
    pairs = left.join(images, [key, "qx", "qy", "qz"])
    shifted = pairs.selectExpr("*", "x2 - x1 + u AS fx", "y2 - y1 + v AS fy", "z2 - z1 + w AS fz")
    return shifted.where("i <> j OR u <> 0 OR v <> 0 OR w <> 0").select(key, "i", "j", F.expr(_DISTANCE).alias("distance")).where(F.col("distance") <= radius)


def neighbour_lists(distances: DataFrame, n: int = 12, radius: float = 8.0, key: str = "id") -> DataFrame:
    """(key, i, neighbours array<struct<distance, j>>): the n nearest of each site, padded with (radius + 1, null)."""
    order = Window.partitionBy(key, "i").orderBy("distance", "j")
    near = distances.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n)
    lists = near.groupBy(key, "i").agg(F.array_sort(F.collect_list(F.struct("distance", "j"))).alias("found"))
    pad = F.array_repeat(F.struct(F.lit(radius + 1).alias("distance"), F.lit(None).cast("int").alias("j")), n)
    return lists.select(key, "i", F.slice(F.concat("found", pad), 1, n).alias("neighbours"))


def quality_gate(table: DataFrame, distances: DataFrame, lengths: tuple[float, float] = (0.5, 50.0), least: float = 1.5, key: str = "id") -> DataFrame:
    """``table`` with min_distance and passes_gate: lengths in bounds and no two sites too close; unknown distances pass."""
    shortest = distances.groupBy(key).agg(F.min("distance").alias("min_distance"))
    inside = [F.col(f"lattice.{x}").between(*lengths) for x in LENGTHS]
    ok = inside[0] & inside[1] & inside[2] & F.coalesce(F.col("min_distance") >= least, F.lit(True))
    return table.join(shortest, key, "left").withColumn("passes_gate", F.coalesce(ok, F.lit(False)))


def structural_validity(table: DataFrame, distances: DataFrame, least: float = 0.5, volume: float = 0.1, key: str = "id") -> DataFrame:
    """(key, structure_valid): smallest distance and volume are not below the limits."""
    shortest = distances.groupBy(key).agg(F.min("distance").alias("d"))
    ok = F.coalesce(F.col("d") >= least, F.lit(True)) & F.coalesce(F.coalesce("cell_volume", "volume") >= volume, F.lit(False))
    return table.join(shortest, key, "left").select(key, ok.alias("structure_valid"))


def charge_balance(rows: DataFrame, oxidation: DataFrame, key: str = "id", formula: str = "formula", most: float = 1e7) -> DataFrame:
    """(key, charge_valid): one element, or all metals, or some oxidation states that sum to zero.

    ``oxidation``: (element, states array<int>, is_metal, eneg). Sums that the elements so
    far can reach are folded into one set, element by element, so work grows with the
    range of charges instead of the number of combinations; compositions with more than
    ``most`` combinations are not valid, nor are those with an element of no known state."""
    amounts = rows.select(key, F.explode(fx.parse_formula(F.col(formula))).alias("element", "amount"))
    joined = amounts.join(F.broadcast(oxidation), "element", "left")
    parts = joined.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("eneg", "element", F.round("amount").cast("int").alias("n"), "states"))).alias("parts"),
        F.bool_and(F.coalesce("is_metal", F.lit(False))).alias("metals"),
    )
    sums = F.aggregate(
        "parts",
        F.array(F.lit(0)),
        lambda acc, p: F.array_distinct(
            F.flatten(F.transform(acc, lambda a: F.transform(F.coalesce(p["states"], F.array().cast("array<int>")), lambda s: a + s * p["n"])))
        ),
    )
    tried = F.aggregate("parts", F.lit(1.0), lambda acc, p: acc * F.greatest(F.size(p["states"]), F.lit(1)))
    valid = (F.size("parts") == 1) | F.col("metals") | ((tried <= most) & F.array_contains(sums, 0))
    return parts.select(key, valid.alias("charge_valid"))


def fingerprint_blocks(table: DataFrame, sites: DataFrame, key: str = "id", n: int = 12, radius: float = 4.0, profiled: bool = True) -> DataFrame:
    """(key, block, n_sites, lengths, angles, profile): what duplicates are compared by.

    Lengths are those of the cell at unit volume, sorted; the block is the reduced formula. The profile tells arrangements of sites
    apart: the mean distance of the sites' first, second … ``n``-th neighbours in units of the mean room of a site, null beyond ``radius``.
    Without ``profiled`` there is none, and no distances are made."""
    counted = sites.groupBy(key).agg(F.sum("multiplicity").alias("n_sites"))
    # rows of a generator: the texts are read once, and what filters the numbers does not read them again
    read = F.struct(F.coalesce("formula_sum", "data_formula").alias("__formula"), F.col("lattice"), F.coalesce("cell_volume", "volume").alias("__volume"))
    scaled = table.select(key, F.inline(F.array(read))).withColumn("__scale", F.pow(F.nullif("__volume", F.lit(0.0)), F.lit(1 / 3)))
    scale = F.col("__scale")
    room = scale / F.pow(F.greatest(F.coalesce("n_sites", F.lit(0)), F.lit(1)).cast("double"), F.lit(1 / 3))
    profile = []
    joined = scaled.join(counted, key, "left")
    if profiled:
        order = Window.partitionBy(key, "i").orderBy("distance")
        near = site_distances(table, sites, radius, key).withColumn("r", F.row_number().over(order)).where(F.col("r") <= n)
        means = near.groupBy(key, "r").agg(F.avg("distance").alias("d")).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("r", "d"))).alias("found"))
        joined = joined.join(means, key, "left")
        profile = [F.transform(F.sequence(F.lit(1), F.lit(n)), lambda r: F.try_element_at("found", r) / room).alias("profile")]
    return joined.select(
        key,
        fx.reduced_formula(F.col("__formula")).alias("block"),
        F.coalesce("n_sites", F.lit(0)).alias("n_sites"),
        F.array_sort(F.array(*(F.col(f"lattice.{x}") / scale for x in LENGTHS))).alias("lengths"),
        F.array_sort(F.array(*(F.col(f"lattice.{x}") for x in ANGLES))).alias("angles"),
        *profile,
    )


def similar(left: str, right: str, length: float = 0.2, angle: float = 5.0, site: float | None = None) -> Column:
    """Sorted unit-volume lengths within a relative tolerance, sorted angles within degrees and, if ``site`` is given, profiles within that.

    A profile's number that only one side has is a difference."""

    def zipped(column: str) -> Column:
        return F.arrays_zip(F.col(f"{left}.{column}").alias("l"), F.col(f"{right}.{column}").alias("r"))

    near = F.forall(zipped("lengths"), lambda p: F.abs(p["l"] - p["r"]) <= length * F.greatest(p["l"], p["r"]))
    turned = F.forall(zipped("angles"), lambda p: F.abs(p["l"] - p["r"]) <= angle)
    if site is None:
        return F.coalesce(near & turned, F.lit(False))
    placed = F.forall(zipped("profile"), lambda p: F.coalesce(F.abs(p["l"] - p["r"]) <= site, p["l"].isNull() & p["r"].isNull()))
    return F.coalesce(near & turned & F.coalesce(placed, F.lit(True)), F.lit(False))


def _cells(blocks: DataFrame, length: float, angle: float, around: bool) -> DataFrame:
    """``blocks`` with ``__cell``, a grid cell by logarithms of the shortest and longest length and the smallest angle; ``around``: each of the 27 about its own.

    Similar structures are at most one cell apart on each axis."""
    width = -math.log(1 - length)

    def step(value: Column, size: float) -> Column:
        own = F.floor(value / size)
        return F.explode(F.array(own - 1, own, own + 1)) if around else own

    def log(value: Column) -> Column:
        return F.when(value > 0, F.log(value)).otherwise(F.lit(-1e6))

    out = blocks.withColumn("__c1", step(log(F.col("lengths")[0]), width)).withColumn("__c2", step(log(F.col("lengths")[2]), width))
    out = out.withColumn("__c3", step(F.col("angles")[0], angle))
    return out.withColumn("__cell", F.struct("__c1", "__c2", "__c3")).drop("__c1", "__c2", "__c3")


def _alike(first: DataFrame, second: DataFrame, by: tuple[str, ...], key: str, length: float, angle: float, site: float | None, ordered: bool) -> DataFrame:
    """(a, b): keys of similar structures of two tables that agree in ``by``, if ``ordered`` with a before b."""
    left, right = _cells(first, length, angle, False).alias("l"), _cells(second, length, angle, True).alias("r")
    meets = F.col("l.__cell") == F.col("r.__cell")
    for c in by:
        meets = meets & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    if ordered:
        meets = meets & (F.col(f"l.{key}") < F.col(f"r.{key}"))
    return left.join(right, meets).where(similar("l", "r", length, angle, site)).select(F.col(f"l.{key}").alias("a"), F.col(f"r.{key}").alias("b"))


def _numbered(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``__rank``, their place in the order of the key, from counts of ranges and places inside each."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = shared.written(rows.repartitionByRange(parts, key).withColumn("__part", F.spark_partition_id()))
    counts = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))  # a row a range
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(key))
    return dealt.withColumn("__i", inside).join(F.broadcast(before), "__part").withColumn("__rank", F.col("__before") + F.col("__i") - 1).drop("__part", "__i", "__before")


def drop_similar(
    blocks: DataFrame, length: float = 0.2, angle: float = 5.0, by: tuple[str, ...] = ("block", "n_sites"), key: str = "id", site: float = 0.3, first_batch: int = 4096
) -> DataFrame:
    """(key, kept, duplicate_of): keep-first deduplication inside each block, in the order of the key.

    A structure is a duplicate of the first kept one that it is similar to: what is kept is the lexicographically first maximal
    independent set of the similar pairs. Structures of equal numbers count as their first one. Blocks of at most ``first_batch`` others are walked in
    order, an array each. Those of larger blocks are taken in batches of the order, each as large as all before it: first those similar to a structure kept already go, so that crowds of near copies never meet each
    other; among the rest, rounds keep what no undecided smaller structure is similar to, and drop what is similar to that. Pairs meet in grid
    cells of the lattice by joins; no task holds a block. Structures without a whole lattice are left out. Profiles are compared where ``blocks`` have them."""
    profiled = ["profile"] if "profile" in blocks.columns else []
    compared = [*by, "lengths", "angles", *profiled]
    whole = F.forall(F.concat("lengths", "angles"), lambda v: v.isNotNull() & ~F.isnan(v))
    rows = blocks.where(F.coalesce(whole, F.lit(False))).select(key, *compared).withColumn("__shape", F.md5(F.to_json(F.struct(*compared))))
    rows = shared.written(rows)
    firsts = rows.groupBy("__shape").agg(F.min(F.struct(key, *compared)).alias("r")).select("r.*")
    near = site if profiled else None
    sized = shared.written(firsts.withColumn("__n", F.count("*").over(Window.partitionBy(*by))))
    duplicates = [_walked(sized.where(F.col("__n") <= first_batch), by, key, length, angle, near)]
    large = sized.where(F.col("__n") > first_batch).drop("__n")
    numbered = None if large.isEmpty() else shared.written(_numbered(large, key))
    count, kept, start, end = 0 if numbered is None else numbered.count(), None, 0, first_batch
    while start < count:
        batch = numbered.where(F.col("__rank").between(start, end - 1)).drop("__rank")
        if kept is not None:
            gone = shared.written(_alike(kept, batch, by, key, length, angle, near, False).groupBy("b").agg(F.min("a").alias("a")))
            duplicates.append(gone)
            batch = shared.written(batch.join(gone.select(F.col("b").alias(key)), key, "left_anti"))
        edges = shared.written(_alike(batch, batch, by, key, length, angle, near, True))
        dropped = _dropped(edges).withColumnRenamed("b", key)
        new = batch.join(dropped, key, "left_anti")
        kept = shared.written(new if kept is None else kept.unionByName(new))
        duplicates.append(edges.join(kept.select(F.col(key).alias("a")), "a").groupBy("b").agg(F.min("a").alias("a")))
        start, end = end, 2 * end
    found = duplicates[0]
    for d in duplicates[1:]:
        found = found.unionByName(d)
    stands = rows.groupBy("__shape").agg(F.min(key).alias("__first"))
    every = rows.select(key, "__shape").join(stands, "__shape").join(found.select(F.col("b").alias("__first"), F.col("a").alias("__of")), "__first", "left")
    of = F.coalesce("__of", F.when(F.col(key) != F.col("__first"), F.col("__first")))
    return every.select(key, of.isNull().alias("kept"), of.alias("duplicate_of"))


def _walked(rows: DataFrame, by: tuple[str, ...], key: str, length: float, angle: float, site: float | None) -> DataFrame:
    """(b, a): duplicates and the first kept structure of their block that each is similar to, as ``similar`` has it, by a walk over each block's array."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def walk(blocks: pd.Series) -> pd.Series:
        return pd.Series([_keep_first(block, length, angle, site) for block in blocks], dtype=object)

    profile = F.col("profile") if site is not None else F.lit(None).cast("array<double>")
    # nulls and NaN look alike in Arrow's arrays: what is null is said beside the numbers
    numbers = F.struct(
        F.coalesce("lengths", F.array().cast("array<double>")).alias("lengths"), F.coalesce("angles", F.array().cast("array<double>")).alias("angles"),
        F.transform(profile, lambda v: F.coalesce(v, F.lit(0.0))).alias("profile"), F.transform(profile, lambda v: v.isNull()).alias("gaps"),
    )
    members = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), numbers.alias("v")))).alias("m"))
    told = members.where(F.size("m") > 1).select(F.transform("m", lambda x: x["k"]).alias("k"), walk(F.transform("m", lambda x: x["v"])).alias("of"))
    each = told.select("k", F.posexplode("of").alias("at", "of")).where("of >= 0")
    return each.select(F.get("k", F.col("at")).alias("b"), F.get("k", F.col("of")).alias("a"))


def _keep_first(block: list, length: float, angle: float, site: float | None) -> list[int]:
    """For each structure of a block in order the place of the first kept one that it is similar to, or -1."""
    n = len(block)

    def table(name: str, rest: float) -> np.ndarray:
        wide = max((len(v[name]) for v in block if v[name] is not None), default=0)
        out = np.full((n, wide), rest)
        for row, v in zip(out, block):
            if v[name] is not None:
                row[: len(v[name])] = v[name]
        return out

    lengths, angles = table("lengths", np.nan), table("angles", np.nan)  # a number that is missing is like none
    profile, gaps = (table("profile", 0.0), table("gaps", 1.0) > 0) if site is not None else (None, None)
    free = np.array([v["profile"] is None for v in block])
    kept, at, out = 0, np.zeros(n, int), [-1] * n
    for i in range(n):
        if kept:
            k = at[:kept]
            with np.errstate(invalid="ignore"):
                near = (np.abs(lengths[k] - lengths[i]) <= length * np.maximum(lengths[k], lengths[i])).all(1) & (np.abs(angles[k] - angles[i]) <= angle).all(1)
                if site is not None:
                    same = np.where(gaps[k] | gaps[i], gaps[k] & gaps[i], np.abs(profile[k] - profile[i]) <= site)
                    near &= same.all(1) | free[k] | free[i]
            if near.any():
                out[i] = int(k[near.argmax()])
                continue
        at[kept], kept = i, kept + 1
    return out


def _dropped(edges: DataFrame) -> DataFrame:
    """(b): what the first maximal independent set leaves out, by rounds over (a, b) with a before b."""
    out, left = None, edges
    while not left.isEmpty():
        sure = left.select("a").distinct().join(left.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        gone = shared.written(left.join(sure, "a").select("b").distinct())
        out = gone if out is None else out.unionByName(gone)
        # with what is dropped go its edges both ways; those of kept rows lead to dropped ones only
        left = shared.written(left.join(gone, "b", "left_anti").join(gone.select(F.col("b").alias("a")), "a", "left_anti"))
    return edges.select("b").limit(0) if out is None else out


def novelty_vs_base(generated: DataFrame, base: DataFrame, length: float = 0.2, angle: float = 5.0, key: str = "id", site: float = 0.3) -> DataFrame:
    """(key, novel, reason): novel by composition if the base has no such formula, else unless a base structure is similar."""
    keys = base.select("block").distinct().withColumn("has", F.lit(True))
    shape = ["block", "lengths", "angles", *(["profile"] if "profile" in base.columns else [])]
    matched = _alike(base.dropDuplicates(shape), generated, ("block",), key, length, angle, site if "profile" in generated.columns else None, False)
    matched = matched.select(F.col("b").alias(key)).distinct()
    marked = generated.select(key, "block").join(keys, "block", "left").join(matched.withColumn("hit", F.lit(True)), key, "left")
    reason = F.when(F.col("has").isNull(), "composition").when(F.col("hit").isNull(), "structure").otherwise("matched")
    return marked.select(key, (reason != "matched").alias("novel"), reason.alias("reason"))


def lowest_volume(table: DataFrame, key: str = "id", position: str = "position") -> DataFrame:
    """One structure for each (formula, space group): the lowest volume a formula unit, ties to the first."""
    unit = F.col("volume") / F.when(F.coalesce("z", F.lit(0)) == 0, 1).otherwise(F.col("z"))
    order = Window.partitionBy("data_formula", "space_group").orderBy(unit.asc_nulls_last(), position)
    return table.withColumn("volume_per_unit", unit).withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def in_set(table: DataFrame, wanted: DataFrame) -> DataFrame:
    """``table`` with under_represented: its (formula, space group) is in the given set."""
    keys = wanted.select("data_formula", "space_group").distinct().withColumn("under_represented", F.lit(True))
    return table.join(keys, ["data_formula", "space_group"], "left").withColumn("under_represented", F.coalesce("under_represented", F.lit(False)))


def merge_datasets(base: DataFrame, include: DataFrame | None, exclude: DataFrame | None, keys: tuple[str, ...] = ("reduced", "z", "space_group"), position: str = "position") -> DataFrame:
    """base ∪ (include − base) − exclude by key; of repeated keys in one input the last counts; null keys are dropped."""

    def one(rows: DataFrame) -> DataFrame:
        good = rows.dropna(subset=[*keys])
        order = Window.partitionBy(*keys).orderBy(F.col(position).desc())
        return good.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")

    out = one(base)
    if include is not None:
        out = out.unionByName(one(include).join(out.select(*keys), [*keys], "left_anti"), allowMissingColumns=True)
    if exclude is not None:
        out = out.join(exclude.select(*keys).dropna().distinct(), [*keys], "left_anti")
    return out


# corpus preparation


@F.pandas_udf(T.StringType())
def _rounded(texts: pd.Series, digits: pd.Series) -> pd.Series:
    number = re.compile(r"[-+]?\d+\.\d+")

    def one(text: str | None, n: int) -> str | None:
        if text is None:
            return None
        return number.sub(lambda m: m[0] if len(m[0].split(".")[1]) <= n else f"{float(m[0]):.{n}f}", text)

    return pd.Series([one(t, int(d)) for t, d in zip(texts, digits)], dtype=object)


def round_numbers(text: Column, decimals: int = 4) -> Column:
    """Every float literal with more decimals rounded to that many; a replacement by computed values needs Arrow."""
    return _rounded(text, F.lit(decimals))


def plain_formula(text: Column) -> Column:
    return F.regexp_replace(cif_property(text, SUM), r"['\s]", "")


def with_formula_line(text: Column) -> Column:
    """The data line renamed to the compact formula sum; null without a formula sum."""
    line = r"(?m)^data_[^\n]*"

    def renamed(t: Column, name: Column, at: Column) -> Column:
        old = F.length(F.regexp_extract(t, line, 0))
        return F.when(at > 0, F.concat(F.substring(t, F.lit(1), at - 1), F.lit("data_"), name, F.substring(t, at + old, F.length(t)))).otherwise(t)

    found = F.struct(text.alias("t"), plain_formula(text).alias("name"), F.regexp_instr(text, F.lit(line)).alias("at"))
    return fx.let(found, lambda v: F.when(v["name"].isNotNull(), renamed(v["t"], v["name"], v["at"])))


def identity_symmetry(text: Column) -> Column:
    """The symmetry loop cut down to the identity; its other operators go."""
    return F.regexp_replace(text, rf"(?i)({XYZ}[ \t]*\n)(?:[ \t]*\d*[ \t]*'[^'\n]*'[ \t]*\n?)*", "$1  1  'x, y, z'\n")


def property_block(formula: Column, elements: DataFrame) -> Column:
    """Text of the element-property loop for a formula, elements by electronegativity, four decimals."""
    rows = elements.select("element", "eneg", "radius").collect()
    table = F.array(*(F.struct(F.lit(float(r["eneg"] or 0)).alias("eneg"), F.lit(r["element"]).alias("element"), F.lit(float(r["radius"] or 0)).alias("radius")) for r in rows))
    own = fx.let(fx.element_set(formula), lambda wanted: F.array_sort(F.filter(table, lambda t: F.array_contains(wanted, t["element"]))))
    lines = F.transform(own, lambda t: F.format_string("  %s  %.4f  %.4f", t["element"], t["eneg"], t["radius"]))
    head = "loop_\n _atom_type_symbol\n _atom_type_electronegativity\n _atom_type_radius\n"
    return F.concat(F.lit(head), F.array_join(lines, "\n"))


def with_properties(text: Column, elements: DataFrame) -> Column:
    """The text with the property block before its space-group line; null without that line or a formula sum."""

    def placed(t: Column) -> Column:
        at = F.locate(SPACE_GROUP, t)
        whole = F.concat(F.substring(t, F.lit(1), at - 1), property_block(plain_formula(t), elements), F.lit("\n\n"), F.substring(t, at, F.length(t)))
        return F.when(at > 0, whole)

    return fx.let(text, placed)


def without_properties(text: Column) -> Column:
    """The text without its property block."""
    return F.regexp_replace(text, rf"(?is)loop_\s+_atom_type_symbol.*?({SPACE_GROUP})", "$1")


def prepare_corpus(structures: DataFrame, elements: DataFrame, decimals: int = 4, key: str = "id", text: str = "cif") -> DataFrame:
    """(key, cif, rejected): training texts; rejected names why a row has none (no text, z is 0, no formula, no space group).

    Every row has one of both. Each step's text is one value, however often the next reads it; as rows of a generator the texts are made where their table is
    dealt to, and no filter on them makes them again below that."""

    def made(t: Column) -> Column:
        reason = (
            F.when(F.coalesce(F.trim(t), F.lit("")) == "", "no text").when(cif_number(t, "_cell_formula_units_Z") == 0, "z is 0")
            .when(plain_formula(t).isNull(), "no formula").when(~t.contains(SPACE_GROUP), "no space group")
        )
        done = identity_symmetry(with_properties(with_formula_line(t), elements))
        return fx.let(reason, lambda r: F.struct(F.when(r.isNull(), done).alias("__text"), r.alias("rejected")))

    each = structures.select(key, F.inline(F.transform(F.array(text), made)))
    return each.select(key, round_numbers(F.col("__text"), decimals).alias("cif"), "rejected")


def filter_lines(text: Column) -> Column:
    """Lines that are not blank, a comment or a generator's banner, and a blank line at the end."""
    keep = F.filter(F.split(text, "\n"), lambda x: (F.trim(x) != "") & ~F.trim(x).startswith("#") & ~x.contains("pymatgen"))
    return F.concat(F.array_join(keep, "\n"), F.lit("\n\n"))


def prompt(text: Column, with_space_group: bool = False) -> Column:
    """The text through its data line, or through its space-group line."""
    if with_space_group:
        return F.nullif(F.regexp_extract(text, rf"(?s)^.*?{SPACE_GROUP}[^\n]*\n", 0), F.lit(""))
    return F.nullif(F.regexp_extract(text, r"(?s)^.*?data_[^\n]*\n", 0), F.lit(""))


def tokenise(rows: DataFrame, vocabulary: list[str], key: str = "id", text: str = "cif", unknown: str = "<unk>") -> DataFrame:
    """(key, tokens, ids, n_unknown): longest match over the vocabulary, any other character unknown.

    Space-group values get the suffix _sg, so that they differ from equal element
    symbols; runs of blanks become one. Ids are positions in the vocabulary, the unknown
    token the first after it."""
    pattern = token_pattern(vocabulary)
    ids = F.create_map(*(x for i, v in enumerate(vocabulary) for x in (F.lit(v), F.lit(i))))
    marked = F.regexp_replace(F.col(text), rf"({SPACE_GROUP}\s+)(\S+)", "$1$2_sg")
    found = F.regexp_extract_all(F.regexp_replace(marked, "[ \t]+", " "), F.lit(pattern), F.lit(0))
    names, last = F.array(*map(F.lit, [*vocabulary, unknown])), len(vocabulary)
    numbered = rows.select(key, F.transform(found, lambda t: F.coalesce(ids[t], F.lit(last))).alias("ids"))
    return numbered.select(
        key, F.transform("ids", lambda i: F.get(names, i)).alias("tokens"), "ids", F.size(F.filter("ids", lambda i: i == last)).alias("n_unknown")
    )


def token_pattern(vocabulary: list[str]) -> str:
    """Longest match over the vocabulary, else any character.

    Java tries alternatives one by one, so characters that begin no longer token, and those that begin none, are told by a class before the others."""
    by_length = sorted(vocabulary, key=lambda v: (-len(v), v))
    firsts, longer = {v[0] for v in vocabulary if v}, {v[0] for v in vocabulary if len(v) > 1}
    alone, listed = ("".join(rf"\x{{{ord(c):x}}}" for c in sorted(chars)) for chars in ({v for v in vocabulary if len(v) == 1} - longer, firsts))
    classes = [f"[{alone}]"] * bool(alone) + [f"[^{listed}]"] * bool(listed)
    return "(?s)" + "|".join([*classes, *(_quoted(v) for v in by_length if v[:1] in longer), "."])


def _quoted(token: str) -> str:
    return r"\Q" + token + r"\E"


def detokenise(tokens: Column) -> Column:
    """Text of the tokens, the space-group suffix taken off."""
    return F.regexp_replace(F.array_join(tokens, ""), "_sg", "")


def length_statistics(tokenised: DataFrame) -> DataFrame:
    """One row: n, min, max, mean and deviation of token counts, and unknown tokens in all."""
    n = F.size("ids")
    return tokenised.agg(
        F.count("*").alias("n"), F.min(n).alias("min"), F.max(n).alias("max"), F.avg(n).alias("mean"), F.stddev_pop(n).alias("std"),
        F.coalesce(F.sum("n_unknown"), F.lit(0)).alias("n_unknown"),
    )


def record_starts(rows: DataFrame, size: str, order: str, bucket_rows: int = 100_000) -> DataFrame:
    """``rows`` with ``start``: the sum of ``size`` over all rows before it in the order of an integer column.

    Two passes: sums of ranges of the order column, then running sums inside each
    range. Only one row a range meets in one task."""
    ranged = rows.withColumn("__r", F.floor(F.col(order) / bucket_rows))
    totals = ranged.groupBy("__r").agg(F.sum(size).alias("__t"))
    before = totals.withColumn("__b", F.sum("__t").over(Window.orderBy("__r")) - F.col("__t")).drop("__t")
    inside = F.sum(size).over(Window.partitionBy("__r").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(size)
    return ranged.withColumn("__i", inside).join(before, "__r").withColumn("start", F.col("__b") + F.col("__i")).drop("__r", "__i", "__b")


def crystal_table(table: DataFrame, sites: DataFrame, elements: DataFrame, key: str = "id") -> DataFrame:
    """(key, reduced_formula, n_atoms, mass, volume, density, lattice, space_group): one row a structure."""
    weighed = sites.join(F.broadcast(elements.select("element", "mass")), "element", "left")
    sums = weighed.groupBy(key).agg(F.sum("multiplicity").alias("n_atoms"), F.sum(F.col("multiplicity") * F.col("mass")).alias("mass"))
    volume = F.coalesce("volume", "cell_volume")
    return table.join(sums, key, "left").select(
        key, fx.reduced_formula(F.col("formula_sum")).alias("reduced_formula"), "n_atoms", "mass", volume.alias("volume"),
        (F.col("mass") * 1.66053906660 / F.nullif(volume, F.lit(0.0))).alias("density"), "lattice", "space_group",
    )
