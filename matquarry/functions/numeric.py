"""Numeric column expressions: the normal law, expected improvement, transport models."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of Hart's rational approximation of the normal tail, highest power first.
HART_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
HART_BOTTOM = (
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)

PLANCK = 6.62607015e-34
BOLTZMANN = 1.380649e-23


def _horner(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def _over(a: Column | float, b: Column) -> Column:
    """Quotient of doubles; null where the divisor is 0."""
    top = a if isinstance(a, Column) else F.lit(float(a))
    return F.try_divide(top.cast("double"), b.cast("double"))


def normal_pdf(z: Column) -> Column:
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi)


def normal_cdf(z: Column) -> Column:
    """Cumulative normal law to about 1e-15, by Hart's approximation; Spark has no error function."""
    x = F.abs(z)
    tail = x + 0.65
    for n in (4, 3, 2, 1):
        tail = x + F.lit(float(n)) / tail
    near = F.exp(-x * x / 2) * _horner(x, HART_TOP) / _horner(x, HART_BOTTOM)
    upper = F.when(x > 37, F.lit(0.0)).when(x < 7.07106781186547, near).otherwise(F.exp(-x * x / 2) / tail / math.sqrt(2 * math.pi))
    return F.when(z > 0, 1 - upper).otherwise(upper)


def expected_improvement(mu: Column, sigma: Column, f_min: Column, xi: float = 0.01) -> Column:
    """Expected improvement of a log objective to be minimised; never negative."""
    s = F.greatest(sigma, F.lit(1e-9))
    gain = f_min - mu - F.lit(xi)
    z = gain / s
    return F.greatest(F.lit(0.0), gain * normal_cdf(z) + s * normal_pdf(z))


def composite_weight(ei: Column, sigma: Column, k: Column, w_ei: float = 1.0, w_sigma: float = 0.5, w_k: float = 1.0) -> Column:
    """Log weight of a candidate from its improvement, uncertainty and predicted k."""
    return F.lit(w_ei) * F.log1p(F.greatest(ei, F.lit(0.0))) + F.lit(w_sigma) * F.log1p(F.greatest(sigma, F.lit(0.0))) - F.lit(
        w_k
    ) * F.log(F.greatest(k, F.lit(1e-12)))


def cell_volume(a: Column, b: Column, c: Column, alpha: Column, beta: Column, gamma: Column) -> Column:
    """Volume of a unit cell from lengths and degrees; 0 where the radicand is negative."""
    ca, cb, cg = (F.cos(F.radians(x)) for x in (alpha, beta, gamma))
    square = a * a * b * b * c * c * (1 - ca * ca - cb * cb - cg * cg + 2 * ca * cb * cg)
    return F.when(square < 0, F.lit(0.0)).otherwise(F.sqrt(square))


def sound_velocities(bulk: Column, shear: Column, density: Column) -> tuple[Column, Column, Column]:
    """Longitudinal, transverse and mean velocities in m/s from GPa and g/cm3; the mean is null without shear stiffness."""
    longitudinal = F.sqrt(_over(bulk + 4 * shear / 3, density))
    transverse = F.sqrt(_over(shear, density))
    mean = F.pow((_over(1, F.pow(longitudinal, F.lit(3.0))) + _over(2, F.pow(transverse, F.lit(3.0)))) / 3, F.lit(-1 / 3))
    return longitudinal * 1000, transverse * 1000, mean * 1000


def debye_temperature(volume: Column, velocity: Column) -> Column:
    """Acoustic Debye temperature in K from a volume in cubic angstroms and m/s."""
    return F.lit(PLANCK / BOLTZMANN * 1e10) * F.pow(_over(3, 4 * math.pi * volume), F.lit(1 / 3)) * velocity


def poisson_ratio(longitudinal: Column, transverse: Column) -> Column:
    ratio = _over(longitudinal, transverse)
    return _over(ratio * ratio - 2, 2 * ratio * ratio - 2)


def gruneisen(poisson: Column) -> Column:
    return _over(3 * (1 + poisson), 2 * (2 - 3 * poisson))


def slack_constant(gamma: Column, n: int = 1) -> Column:
    if n == 1:
        return _over(2.43e-8, 1 - _over(0.514, gamma) + _over(0.228, gamma * gamma))
    return _over(1, 1 + _over(1, gamma) + _over(8.3e5, F.pow(gamma, F.lit(2.4))))


def slack_kappa(constant: Column, mass: Column, volume: Column, debye: Column, gamma: Column, atoms: Column, temperature: float = 300.0) -> Column:
    top = constant * mass * F.pow(volume, F.lit(1 / 3)) * F.pow(debye, F.lit(3.0))
    return _over(top, gamma * gamma * temperature * atoms) * 100


def finite_or_zero(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)


def mtp_kappa(shear: Column, velocity: Column, volume: Column, atoms: Column, gamma: Column, temperature: float = 300.0) -> Column:
    """Conductivity G v V^(1/3) exp(-gamma) / (N T) in SI units; 0 where it is not finite."""
    value = _over(shear * 1e9 * velocity * F.pow(volume * 1e-30, F.lit(1 / 3)), atoms * temperature) * F.exp(-gamma)
    return finite_or_zero(value)


def simple_slack_kappa(mass: Column, volume: Column, atoms: Column, velocity: float = 3000.0, gamma: float = 2.0) -> Column:
    """Slack conductivity with a fixed velocity and Grüneisen parameter, all atoms in the Debye temperature."""
    debye = F.lit(PLANCK / BOLTZMANN * 1e10 * velocity) * F.pow(_over(3 * atoms, 4 * math.pi * volume), F.lit(1 / 3))
    return slack_kappa(slack_constant(F.lit(gamma)), mass, volume, debye, F.lit(gamma), atoms)


def gaussian_expansion(distance: Column, low: float, high: float, step: float) -> Column:
    """array<double>: exp(-((d - m) / step)^2) on the grid of m from low to high."""
    n = int(round((high - low) / step)) + 1
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.exp(-F.pow((distance - (F.lit(low) + i * F.lit(step))) / step, F.lit(2.0))))


def standardise(vector: Column, means: list[float], deviations: list[float]) -> Column:
    """Vector minus stored means over stored deviations, a deviation of 0 counting as 1."""
    mean, scale = F.array(*map(F.lit, means)), F.array(*(F.lit(d or 1.0) for d in deviations))
    return F.zip_with(F.zip_with(vector, mean, lambda v, m: v - m), scale, lambda v, s: v / s)


def decode_log10(value: Column) -> Column:
    return F.pow(F.lit(10.0), value)
