"""Column functions against plain Python, and properties of formulas."""

import hashlib
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from matquarry.functions import formulas as fx
from matquarry.functions import numeric as nx
from matquarry.functions import values as vx


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("(GeTe)0.7(AgSnSe2)0.3", {"Ag": 0.3, "Ge": 0.7, "Se": 0.6, "Sn": 0.3, "Te": 0.7}), ("Ag2 Se", {"Ag": 2, "Se": 1}), ("Bi₂Te₃", {"Bi": 2, "Te": 3}),
        ("AgAg2", {"Ag": 3}), ("", {}), ("(AgBi)2S0.5", {"Ag": 2, "Bi": 2, "S": 0.5}),
    ],
)
def test_parse_formula(spark, text, want):
    assert one(spark, fx.parse_formula(F.lit(text))) == pytest.approx(want)


def test_null_formula(spark):
    assert one(spark, fx.parse_formula(F.lit(None).cast("string"))) is None


counts = st.dictionaries(st.sampled_from(fx.FEATURE_ELEMENTS), st.integers(1, 60), min_size=1, max_size=5)


@settings(max_examples=12, deadline=None)
@given(counts, st.integers(1, 9))
def test_format_parse_and_scale(spark, composition, times):
    text = "".join(f"{e}{n}" for e, n in composition.items())
    scaled = "".join(f"{e}{n * times}" for e, n in composition.items())
    row = spark.range(1).select(
        fx.parse_formula(F.lit(text)).alias("m"), fx.composition_to_formula(fx.parse_formula(F.lit(text))).alias("f"),
        fx.reduced_formula(F.lit(text)).alias("a"), fx.reduced_formula(F.lit(scaled)).alias("b"), fx.feature_vector(fx.parse_formula(F.lit(text))).alias("v"),
    ).first()
    assert row["m"] == composition and row["a"] == row["b"]
    assert row["f"] == "".join(f"{e}{n if n > 1 else ''}" for e, n in sorted(composition.items()))
    assert row["v"] == [float(composition.get(e, 0)) for e in fx.FEATURE_ELEMENTS]
    divisor = math.gcd(*composition.values())
    assert row["a"] == "".join(f"{e}{n // divisor if n > divisor else ''}" for e, n in sorted(composition.items()))


def test_formula_variants(spark):
    assert one(spark, fx.formula_variants(F.lit("Se2Ag4"))) == ["Se2Ag4", "Ag4Se2", "Ag2Se"]


def test_normal_law(spark):
    zs = [-40.0, -9.0, -6.5, -3.0, -1.0, -1e-3, 0.0, 0.3, 2.0, 5.0, 7.2, 8.5, 40.0]
    rows = spark.createDataFrame([(z,) for z in zs], "z double").select("z", nx.normal_cdf(F.col("z")).alias("p")).collect()
    assert all(r["p"] == pytest.approx(0.5 * math.erfc(-r["z"] / math.sqrt(2)), rel=2e-7, abs=1e-15) for r in rows)


def test_expected_improvement_grows_with_uncertainty(spark):
    rows = [(0.1 * s,) for s in range(30)]
    got = [r["e"] for r in spark.createDataFrame(rows, "s double").select(nx.expected_improvement(F.lit(0.0), F.col("s"), F.lit(0.01)).alias("e")).collect()]
    assert got == sorted(got) and 0 <= got[0] < 1e-8


def test_seed_is_sha256(spark):
    digest = hashlib.sha256(b"a::7").digest()[:8]
    assert one(spark, vx.derive_seed(F.lit("a"), F.lit(7))) == int.from_bytes(digest, "big") % (2**32 - 1)


def test_value_repair(spark):
    assert one(spark, vx.safe_double(F.lit(" 1.5 W/mK"))) == 1.5 and one(spark, vx.safe_double(F.lit("nan"), 3.0)) == 3.0
    assert one(spark, vx.coerce_list(F.lit("['a', 'b']"))) == ["a", "b"] and one(spark, vx.coerce_list(F.lit("a"))) == ["a"] and one(spark, vx.coerce_list(F.lit(" "))) == []
    assert tuple(one(spark, vx.generation_of(F.lit("x__y__12.cif")))) == ("x__y", "12") and one(spark, vx.version_key(F.lit("v0.0.12"))) == [0, 0, 12]
    df = spark.createDataFrame([(None, " ", "2.5")], "k string, kappa string, `cond (W/m.K)` string")
    assert df.select(vx.coalesce_alias(df, ["k", "kappa"], r"W/m.*K")).first()[0] == "2.5"


def test_transport_models(spark):
    long, trans, mean = (one(spark, c) for c in nx.sound_velocities(F.lit(50.0), F.lit(20.0), F.lit(5.0)))
    vl, vt = math.sqrt((50 + 80 / 3) / 5), 2.0
    assert (long, trans) == pytest.approx((vl * 1000, vt * 1000)) and mean == pytest.approx(1000 * ((1 / vl**3 + 2 / vt**3) / 3) ** (-1 / 3))
    assert one(spark, nx.mtp_kappa(F.lit(0.0), F.lit(1.0), F.lit(1.0), F.lit(0), F.lit(1.0))) == 0
    assert one(spark, nx.cell_volume(*map(F.lit, (2.0, 3.0, 4.0, 90.0, 90.0, 90.0)))) == pytest.approx(24)
    assert one(spark, nx.gaussian_expansion(F.lit(1.0), 0.0, 2.0, 1.0)) == pytest.approx([math.exp(-1), 1, math.exp(-1)])
