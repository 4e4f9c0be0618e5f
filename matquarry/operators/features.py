"""Feature engineering over compositions, and the profile of feature tables."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formulas as fx

PROPERTIES = ("mass", "radius", "eneg", "group", "period", "valence")

#: Public periodic-table data of the search space's elements
#: (atomic mass, covalent radius in pm, Pauling electronegativity, group, period, valence electrons).
ELEMENTS = (
    ("S", 32.06, 105.0, 2.58, 16.0, 3.0, 6.0),
    ("Ti", 47.867, 160.0, 1.54, 4.0, 4.0, 4.0),
    ("V", 50.9415, 153.0, 1.63, 5.0, 4.0, 5.0),
    ("Cu", 63.546, 132.0, 1.90, 11.0, 4.0, 1.0),
    ("Ge", 72.630, 120.0, 2.01, 14.0, 4.0, 4.0),
    ("As", 74.9216, 119.0, 2.18, 15.0, 4.0, 5.0),
    ("Se", 78.971, 120.0, 2.55, 16.0, 4.0, 6.0),
    ("Ag", 107.8682, 145.0, 1.93, 11.0, 5.0, 1.0),
    ("In", 114.818, 142.0, 1.78, 13.0, 5.0, 3.0),
    ("Sn", 118.710, 139.0, 1.96, 14.0, 5.0, 4.0),
    ("Sb", 121.760, 139.0, 2.05, 15.0, 5.0, 5.0),
    ("Te", 127.60, 138.0, 2.10, 16.0, 5.0, 6.0),
    ("Pb", 207.2, 146.0, 2.33, 14.0, 6.0, 4.0),
    ("Bi", 208.9804, 148.0, 2.02, 15.0, 6.0, 5.0),
)


def element_table(spark: SparkSession) -> DataFrame:
    """(element, mass, radius, eneg, group, period, valence) of the default elements."""
    return spark.createDataFrame([*ELEMENTS], "element string, " + ", ".join(f"`{p}` double" for p in PROPERTIES))


def long_compositions(rows: DataFrame, formula: str = "formula", key: str = "id") -> DataFrame:
    """(key, element, amount): one row for each element of each formula with a positive amount."""
    return rows.select(key, F.explode(fx.parse_formula(F.col(formula))).alias("element", "amount")).where("amount > 0")


def composition_features(rows: DataFrame, elements: DataFrame, key: str = "id", formula: str = "formula") -> DataFrame:
    """One row for each key: the 48 composition features.

    Counts and fractions, configurational entropy; of each property the fraction-weighted
    mean, variance and deviation and the plain minimum, maximum and range; relative
    deviations of radius, mass, electronegativity and valence; mixing enthalpy and entropy.
    Elements without properties count in the fractions only. All sums of one key come
    from one aggregation: variances as the mean of squares about the mean need the mean
    first, so sums of products are kept and combined."""
    amounts = long_compositions(rows, formula, key)
    joined = amounts.join(F.broadcast(elements), "element", "left")
    collected = joined.groupBy(key).agg(
        F.count("*").alias("n_elements"),
        F.sum("amount").alias("total_atoms"),
        F.array_sort(F.collect_list(F.struct("element", "amount", *PROPERTIES))).alias("parts"),
    )
    part = F.col("parts")

    def total(value) -> F.Column:
        return F.aggregate(part, F.lit(0.0), lambda acc, p: acc + value(p))

    def fraction(p):
        return p["amount"] / F.col("total_atoms")

    fractions = F.transform(part, fraction)
    # deviations about a mean are small: the mean is made a column first
    with_means = collected.withColumns({f"{p.capitalize()}_mean": total(lambda x, p=p: fraction(x) * F.coalesce(x[p], F.lit(0.0))) for p in PROPERTIES})
    variance = {
        p: total(lambda x, p=p: fraction(x) * F.pow(F.coalesce(x[p], F.lit(0.0)) - F.col(f"{p.capitalize()}_mean"), F.lit(2.0))) for p in PROPERTIES
    }

    def values(p: str):
        return F.filter(F.transform(part, lambda x: x[p]), lambda v: v.isNotNull())

    out = {
        "max_atom_fraction": F.array_max(fractions),
        "min_atom_fraction": F.array_min(fractions),
        "atom_fraction_std": F.sqrt(
            F.greatest(
                F.lit(0.0),
                F.aggregate(fractions, F.lit(0.0), lambda acc, f: acc + F.pow(f - 1 / F.col("n_elements"), F.lit(2.0))) / F.col("n_elements"),
            )
        ),
        "config_entropy": -F.aggregate(fractions, F.lit(0.0), lambda acc, f: acc + f * F.log(F.greatest(f, F.lit(1e-12)))),
    }
    for p in PROPERTIES:
        name = p.capitalize()
        out |= {
            f"{name}_variance": variance[p],
            f"{name}_std": F.sqrt(F.greatest(variance[p], F.lit(0.0))),
            f"{name}_min": F.coalesce(F.array_min(values(p)), F.lit(0.0)),
            f"{name}_max": F.coalesce(F.array_max(values(p)), F.lit(0.0)),
            f"{name}_range": F.coalesce(F.array_max(values(p)) - F.array_min(values(p)), F.lit(0.0)),
        }
    for p in ("radius", "mass", "eneg", "valence"):
        mean = F.col(f"{p.capitalize()}_mean")
        spread = total(lambda x, p=p: fraction(x) * F.pow(1 - F.coalesce(x[p], F.lit(0.0)) / F.col(f"{p.capitalize()}_mean"), F.lit(2.0)))
        out[f"{p.capitalize()}_delta"] = F.when(mean == 0, F.lit(0.0)).otherwise(F.sqrt(spread))
    pairs = F.aggregate(
        part, F.lit(0.0),
        lambda acc, a: acc + F.aggregate(
            part, F.lit(0.0),
            lambda inner, b: inner + F.when(a["element"] < b["element"], fraction(a) * fraction(b) * F.pow(a["eneg"] - b["eneg"], F.lit(2.0))).otherwise(F.lit(0.0)),
        ),
    )
    features = with_means.withColumns(out)
    return features.withColumns({"Mixing_enthalpy": 4 * F.coalesce(pairs, F.lit(0.0)), "Mixing_entropy": F.col("config_entropy") * 8.314}).drop("parts")


def mixing_enthalpy(rows: DataFrame, elements: DataFrame, key: str = "id", formula: str = "formula") -> DataFrame:
    """(key, mixing_enthalpy): 4 Σ x_i x_j (χ_i − χ_j)² by a self-join of the long table on the key."""
    amounts = long_compositions(rows, formula, key).join(F.broadcast(elements.select("element", "eneg")), "element")
    total = amounts.groupBy(key).agg(F.sum("amount").alias("total"))
    left = amounts.select(key, F.col("element").alias("e1"), F.col("amount").alias("a1"), F.col("eneg").alias("x1"))
    right = amounts.select(key, F.col("element").alias("e2"), F.col("amount").alias("a2"), F.col("eneg").alias("x2"))
    pairs = left.join(right, key).where("e1 < e2").groupBy(key).agg(F.sum(F.expr("a1 * a2 * pow(x1 - x2, 2)")).alias("s"))
    return total.join(pairs, key, "left").select(key, (4 * F.coalesce("s", F.lit(0.0)) / (F.col("total") * F.col("total"))).alias("mixing_enthalpy"))


def element_block(rows: DataFrame, key: str = "id", formula: str = "formula", elements: tuple[str, ...] = fx.FEATURE_ELEMENTS) -> DataFrame:
    """(key, one column an element): raw amounts, 0 where absent."""
    composition = fx.parse_formula(F.col(formula))
    return rows.select(key, composition.alias("__c")).select(key, *(F.coalesce(F.col("__c")[e], F.lit(0.0)).alias(e) for e in elements))


def correlation_matrix(table: DataFrame, columns: list[str], few: int = 16) -> DataFrame:
    """(left, right, correlation) of every ordered pair of columns: one pass, undefined ones are 0.

    Up to ``few`` columns each pair takes the rows that have both; more columns go through
    the distributed Gram matrix, which takes the rows that have all."""
    if len(columns) > few:
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.stat import Correlation

        vectors = VectorAssembler(inputCols=columns, outputCol="__v", handleInvalid="skip").transform(table.select(*(F.col(c).cast("double").alias(c) for c in columns)))
        matrix = Correlation.corr(vectors, "__v").first()[0].toArray()
        cells = [(a, b, float(v) if v == v else 0.0) for a, row in zip(columns, matrix) for b, v in zip(columns, row)]
        return table.sparkSession.createDataFrame(cells, "left string, right string, correlation double")
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    once = table.agg(*(F.coalesce(F.nanvl(F.corr(a, b), F.lit(0.0)), F.lit(0.0)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)))
    rows = [F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"c{i}").alias("correlation")) for i, (a, b) in enumerate(pairs)]
    rows += [F.struct(F.lit(b).alias("left"), F.lit(a).alias("right"), F.col(f"c{i}").alias("correlation")) for i, (a, b) in enumerate(pairs)]
    rows += [F.struct(F.lit(a).alias("left"), F.lit(a).alias("right"), F.lit(1.0).alias("correlation")) for a in columns]
    return once.select(F.inline(F.array(*rows)))


def sanitise(table: DataFrame, columns: list[str], key: str) -> tuple[list[str], dict[str, str]]:
    """(columns kept, reason of each removed one): all-null, constant, then equal to an earlier column.

    One pass profiles all columns; equal fingerprints of columns are confirmed exactly."""
    parts = []
    for i, c in enumerate(columns):
        parts += [F.count(c).alias(f"n{i}"), F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}"), F.bit_xor(F.xxhash64(key, c)).alias(f"f{i}")]
    profile = table.agg(*parts).first()
    removed: dict[str, str] = {}
    seen: dict[int, str] = {}
    for i, c in enumerate(columns):
        if not profile[f"n{i}"]:
            removed[c] = "all null"
        elif profile[f"lo{i}"] == profile[f"hi{i}"]:
            removed[c] = "constant"
        elif (other := seen.get(profile[f"f{i}"])) and table.where(~F.col(c).eqNullSafe(F.col(other))).isEmpty():
            removed[c] = f"equal to {other}"
        else:
            seen.setdefault(profile[f"f{i}"], c)
    return [c for c in columns if c not in removed], removed


def prune_correlated(table: DataFrame, columns: list[str], target: str, limit: float = 0.85) -> DataFrame:
    """(feature, kept, correlated_with): greedy pruning of features correlated above the limit.

    Pairs are visited in column order; of two that are left the one less correlated
    with the target goes. The rule is sequential by definition, so it runs on the
    collected matrix, which is as small as the number of columns squared."""
    matrix = {(r["left"], r["right"]): r["correlation"] for r in correlation_matrix(table, [*columns, target]).collect()}
    gone: dict[str, str] = {}
    for a, b in itertools.combinations(columns, 2):
        if a in gone or b in gone or abs(matrix[a, b]) <= limit:
            continue
        weak, strong = (a, b) if abs(matrix[a, target]) < abs(matrix[b, target]) else (b, a)
        gone[weak] = strong
    rows = [(c, c not in gone, gone.get(c)) for c in columns]
    return table.sparkSession.createDataFrame(rows, "feature string, kept boolean, correlated_with string")


def regression_metrics(table: DataFrame, truth: str, guess: str, by: list[str] | None = None) -> DataFrame:
    """r2 (1 − SSE/SST), mae and rmse, overall or for each group, from sums in one pass."""
    e = F.col(truth) - F.col(guess)
    sums = table.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), F.sum(e * e).alias("sse"), F.var_pop(truth).alias("v"), F.avg(F.abs(e)).alias("mae")
    )
    return sums.select(
        *(by or []), "n", F.when(F.col("v") > 0, 1 - F.col("sse") / (F.col("v") * F.col("n"))).alias("r2"), "mae", F.sqrt(F.col("sse") / F.col("n")).alias("rmse")
    )


def value_ranges(rows: DataFrame, value: str, ranges: int = 256) -> DataFrame:
    """``rows`` with ``__range``: the number of a range of values; ranges hold about equally many rows however values are spread.

    Their bounds are approximate quantiles, one row that is broadcast. Rows of one value are in one range."""
    cuts = [n / ranges for n in range(1, ranges)]
    bounds = rows.agg(F.percentile_approx(value, F.array(*map(F.lit, cuts)), F.lit(4 * ranges)).alias("__bounds"))
    placed = rows.join(F.broadcast(bounds)).withColumn("__range", F.lit(0))
    step = 1 << (ranges - 1).bit_length() - 1 if ranges > 1 else 0
    while step:  # a binary search for the number of bounds below the value
        passes = F.get("__bounds", F.col("__range") + (step - 1)) < F.col(value)
        placed = placed.withColumn("__range", F.col("__range") + F.when(passes, step).otherwise(0))
        step //= 2
    return placed.drop("__bounds")


def classification_metrics(table: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """One row: precision, recall, f1, accuracy and auc of a score for a 0/1 label.

    AUC is the rank-sum statistic. Distinct scores are dealt into ranges by approximate quantiles; counts of the ranges
    below and running counts inside each range make it up, so no task sorts all scores."""
    from pyspark.sql import Window

    y, p = F.col(label) == 1, F.col(score) >= threshold
    counts = table.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count("*").alias("n"))
    by_score = table.groupBy(score).agg(F.count_if(y).alias("pos"), F.count_if(~y).alias("neg"))
    ranged = value_ranges(by_score, score)
    inside = F.sum("neg").over(Window.partitionBy("__range").orderBy(score).rowsBetween(Window.unboundedPreceding, -1))
    sums = ranged.groupBy("__range").agg(F.sum("neg").alias("__neg"))
    before = sums.select("__range", (F.sum("__neg").over(Window.orderBy("__range")) - F.col("__neg")).alias("__before"))
    area = ranged.withColumn("__inside", F.coalesce(inside, F.lit(0))).join(F.broadcast(before), "__range").withColumn("below", F.col("__inside") + F.col("__before")).agg(
        F.try_divide(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)), F.sum("pos") * F.sum("neg")).alias("auc")
    )
    precision, recall = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.join(F.broadcast(area)).select(
        precision.alias("precision"),
        recall.alias("recall"),
        F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
        F.try_divide(F.col("n") - F.col("fp") - F.col("fn"), F.col("n")).alias("accuracy"),
        "auc",
    )


def split_labels(rows: DataFrame, key: str, fractions: dict[str, float], seed: int = 42) -> DataFrame:
    """``rows`` with ``split``: the shares of a hash order, so any row's split is decided by its key alone.

    The last split takes what the others leave."""
    position = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), 1, 12), 16, 10).cast("double") / float(16**12)
    label, at = None, 0.0
    names = list(fractions)
    for name in names[:-1]:
        at += fractions[name]
        label = F.when(position < at, name) if label is None else label.when(position < at, name)
    return rows.withColumn("split", F.lit(names[-1]) if label is None else label.otherwise(names[-1]))


def exact_ranks(rows: DataFrame, key: str, name: str, seed: int | str = 42) -> DataFrame:
    """``rows`` with their place 0.. in the order of a hash of (seed, key) in a column ``name``.

    Ranks come from two passes: rows are counted by the hash's leading digits, and rank
    within them, so no task sorts all rows."""
    from pyspark.sql import Window

    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    keyed = rows.withColumns({"__h": digest, "__b": F.substring(digest, 1, 3)})
    counts = keyed.groupBy("__b").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.sum("__n").over(Window.orderBy("__b")) - F.col("__n"))
    inside = F.row_number().over(Window.partitionBy("__b").orderBy("__h", key))
    ranked = keyed.withColumn("__r", inside).join(F.broadcast(before), "__b")
    return ranked.withColumn(name, F.col("__before") + F.col("__r") - 1).drop("__h", "__b", "__n", "__before", "__r")


def exact_folds(rows: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """``rows`` with ``fold`` 0..k-1 of equal sizes (to one row), by the order of a hash."""
    return exact_ranks(rows, key, "__place", seed).withColumn("fold", F.pmod(F.col("__place"), F.lit(k)).cast("int")).drop("__place")
