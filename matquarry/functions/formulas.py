"""Column expressions over chemical formulas and compositions.

A composition is ``map<string, double>``: element to amount. All are built-in
expressions, so Catalyst sees through them and they run in generated code or its
collection functions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The element order of the feature vector.
FEATURE_ELEMENTS = ("Ag", "As", "Bi", "Cu", "Ge", "In", "Pb", "S", "Sb", "Se", "Sn", "Te", "Ti", "V")

SUBSCRIPTS = "₀₁₂₃₄₅₆₇₈₉"
NUMBER = r"\d+(?:\.\d+)?|\.\d+"
ELEMENT = rf"([A-Z][a-z]?)({NUMBER})?"
PIECE = rf"\([^()]*\)(?:{NUMBER})?|[A-Z][a-z]?(?:{NUMBER})?"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def normalize_formula(formula: Column) -> Column:
    """The formula without white space, Unicode subscripts as digits; null stays null."""
    return F.translate(F.regexp_replace(formula, r"\s+", ""), SUBSCRIPTS, "0123456789")


def _count(text: Column) -> Column:
    """A count as written: none is 1."""
    return F.coalesce(F.nullif(text, F.lit("")).cast("double"), F.lit(1.0))


def formula_entries(formula: Column) -> Column:
    """array<struct<element, amount>>: the formula's element tokens in order, amounts times their group's."""
    pieces = F.regexp_extract_all(normalize_formula(formula), F.lit(PIECE), F.lit(0))

    def tokens(piece: Column) -> Column:
        grouped = piece.startswith("(")
        inner = F.when(grouped, F.regexp_extract(piece, r"\(([^()]*)\)", 1)).otherwise(piece)
        times = F.when(grouped, _count(F.regexp_extract(piece, rf"\)({NUMBER})$", 1))).otherwise(F.lit(1.0))
        found = F.regexp_extract_all(inner, F.lit(ELEMENT), F.lit(0))
        return F.transform(
            found,
            lambda t: F.struct(
                F.regexp_extract(t, ELEMENT, 1).alias("element"), (_count(F.regexp_extract(t, ELEMENT, 2)) * times).alias("amount")
            ),
        )

    return F.flatten(F.transform(pieces, tokens))


def entries_to_map(entries: Column) -> Column:
    """Map of the entries in the order of elements, repeated elements summed."""
    return let(entries, _summed)


def _summed(entries: Column) -> Column:
    elements = F.array_sort(F.array_distinct(F.transform(entries, lambda e: e["element"])))
    amounts = F.transform(
        elements,
        lambda el: F.aggregate(F.filter(entries, lambda e: e["element"] == el), F.lit(0.0), lambda acc, e: acc + e["amount"]),
    )
    return F.map_from_arrays(elements, amounts)


def parse_formula(formula: Column) -> Column:
    """Composition of a formula with at most one level of groups ``( … )n``; null for null, empty without elements."""
    return F.when(formula.isNotNull(), entries_to_map(formula_entries(formula)))


def format_count(amount: Column) -> Column:
    """A count as text: an integer when within 1e-8 of one, else up to six decimals; 1 is left out."""
    whole = F.abs(amount - F.round(amount)) < 1e-8
    digits = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", amount), "0+$", ""), r"\.$", "")
    text = F.when(whole, F.round(amount).cast("long").cast("string")).otherwise(digits)
    return F.when(text == "1", F.lit("")).otherwise(text)


def _join_entries(entries: Column, show: object = format_count) -> Column:
    return F.array_join(F.transform(entries, lambda e: F.concat(e["element"], show(e["amount"]))), "")


def canonical_formula(formula: Column) -> Column:
    """Element tokens sorted by element with normal counts; text without elements is returned compact."""
    compact = normalize_formula(formula)
    return let(F.array_sort(formula_entries(formula)), lambda entries: F.when(F.size(entries) > 0, _join_entries(entries)).otherwise(compact))


def composition_to_formula(composition: Column) -> Column:
    """Formula of a composition, elements sorted, counts of 1 left out."""
    entries = F.array_sort(F.transform(F.map_entries(composition), lambda e: F.struct(e["key"].alias("element"), e["value"].alias("amount"))))
    return _join_entries(entries)


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of two non-negative integers by Euclid's steps, as many as numbers of that length can need."""
    steps = F.ceil(4.785 * F.log10(F.greatest(F.least(a, b), F.lit(1)).cast("double"))).cast("int") + 3
    pair = F.aggregate(
        F.sequence(F.lit(1), steps),
        F.struct(a.cast("long").alias("x"), b.cast("long").alias("y")),
        lambda acc, _: F.when(acc["y"] == 0, acc).otherwise(F.struct(acc["y"].alias("x"), (acc["x"] % acc["y"]).alias("y"))),
    )
    return pair["x"]


def reduce_composition(composition: Column) -> Column:
    """The composition over the greatest common divisor of its counts, if all are positive integers."""
    return let(composition, _reduced)


def _reduced(composition: Column) -> Column:
    amounts = F.map_values(composition)
    whole = F.forall(amounts, lambda v: (F.abs(v - F.round(v)) < 1e-8) & (v > 0.5)) & (F.size(amounts) > 0)
    divisor = F.aggregate(amounts, F.lit(0).cast("long"), lambda acc, v: gcd(F.round(v).cast("long"), acc))
    scaled = let(divisor, lambda d: F.transform_values(composition, lambda _, v: F.round(v) / d))
    return F.when(whole, scaled).otherwise(composition)


def reduced_formula(formula: Column) -> Column:
    """Equality key of a formula: canonical text of its reduced composition; compact text where nothing parses."""
    compact = normalize_formula(formula)
    return let(
        parse_formula(formula), lambda c: F.when(F.size(c) > 0, composition_to_formula(reduce_composition(c))).otherwise(compact)
    )


def formula_variants(formula: Column) -> Column:
    """Distinct spellings in order: as given, integer, reduced, expanded with explicit ones."""
    given = F.trim(formula)
    return let(parse_formula(given), lambda composition: _variants(given, composition))


def _variants(given: Column, composition: Column) -> Column:
    sorted_entries = F.array_sort(
        F.transform(F.map_entries(composition), lambda e: F.struct(e["key"].alias("element"), e["value"].alias("amount")))
    )
    integer = F.when(F.forall(F.map_values(composition), lambda v: F.abs(v - F.round(v)) < 1e-8), composition_to_formula(composition))
    expanded = _join_entries(sorted_entries, lambda a: F.when(format_count(a) == "", F.lit("1")).otherwise(format_count(a)))
    every = F.array(given, integer, composition_to_formula(reduce_composition(composition)), expanded)
    return F.array_distinct(F.filter(every, lambda v: v.isNotNull() & (v != "")))


def element_set(formula: Column) -> Column:
    """Distinct element symbols, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(formula, F.lit("[A-Z][a-z]?"), F.lit(0))))


def feature_vector(composition: Column, elements: tuple[str, ...] = FEATURE_ELEMENTS) -> Column:
    """Raw amounts in the fixed element order, 0 where absent."""
    return F.transform(F.array(*map(F.lit, elements)), lambda e: F.coalesce(F.element_at(composition, e), F.lit(0.0)))


def n_elements(composition: Column) -> Column:
    return F.size(composition)


def total_atoms(composition: Column) -> Column:
    return F.aggregate(F.map_values(composition), F.lit(0.0), lambda acc, v: acc + v)


def _key_in(members: tuple[str, ...]):
    return lambda entry: entry["key"].isin(*members)


def is_valid_composition(
    composition: Column, groups: dict[str, tuple[tuple[str, ...], int, int]], max_atoms: int = 20
) -> Column:
    """Every element in a group, exactly one element a group, group counts within bounds, total within max_atoms."""
    return let(composition, lambda c: _valid(c, groups, max_atoms))


def _valid(composition: Column, groups: dict[str, tuple[tuple[str, ...], int, int]], max_atoms: int) -> Column:
    known = F.array(*(F.lit(e) for members, _, _ in groups.values() for e in members))
    entries = F.map_entries(composition)
    valid = F.forall(entries, lambda e: F.array_contains(known, e["key"]) & (e["value"] >= 1)) & (total_atoms(composition) <= max_atoms)
    for members, least, most in groups.values():
        own = F.filter(entries, _key_in(members))
        count = F.aggregate(own, F.lit(0.0), lambda acc, e: acc + e["value"])
        valid = valid & (F.size(own) == 1) & count.between(least, most)
    return F.coalesce(valid, F.lit(False))


def formula_of_printed_structure(text: Column) -> Column:
    """Formula out of a printed structure ("Full Formula (…)"), null without one."""
    return F.nullif(F.regexp_extract(text, r"Full Formula \(([^)]*)\)", 1), F.lit(""))


def strip_weight_percent(text: Column) -> Column:
    """A weight-percent formula without ``;``, ``:`` and ``,``; null becomes empty."""
    return F.coalesce(F.regexp_replace(text, "[;:,]", ""), F.lit(""))
