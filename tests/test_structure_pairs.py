"""Structures that meet through cells: near duplicates and neighbours against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from matquarry.operators import structures

BLOCKS = "id int, block string, n_sites int, lengths array<double>, angles array<double>, profile array<double>"


def near(a, b, length=0.2, angle=5.0, site=0.3):
    if any(abs(x - y) > length * max(x, y) for x, y in zip(a[3], b[3])) or any(abs(x - y) > angle for x, y in zip(a[4], b[4])):
        return False
    return all((x is None and y is None) or (x is not None and y is not None and abs(x - y) <= site) for x, y in zip(a[5], b[5]))


def keep_first(rows):
    kept, out = {}, {}
    for r in sorted(rows, key=lambda r: r[0]):
        own = kept.setdefault((r[1], r[2]), [])
        out[r[0]] = next((k[0] for k in own if near(k, r)), None)
        if out[r[0]] is None:
            own.append(r)
    return out


def made(n, seed, centres=40, jitter=0.12):
    """Structures around some centres, some exact copies, two blocks, one of which holds most."""
    rng = np.random.default_rng(seed)
    middle = [(np.sort(rng.uniform(0.6, 1.6, 3)), np.sort(rng.uniform(60, 120, 3)), rng.uniform(0.8, 2, 2)) for _ in range(centres)]
    rows = []
    for i in range(n):
        lengths, angles, profile = middle[rng.integers(centres)]
        lengths, angles = np.sort(lengths * np.exp(rng.normal(0, jitter, 3))), np.sort(angles + rng.normal(0, 2, 3))
        row = (i, "B" if i % 9 else None, 2, lengths.tolist(), angles.tolist(), [float(profile[0] + rng.normal(0, 0.1)), None if rng.random() < 0.2 else float(profile[1])])
        rows.append((i, *rows[rng.integers(len(rows))][1:]) if rows and rng.random() < 0.2 else row)
    return rows


@pytest.mark.parametrize("batch", [40, 4096])
def test_near_duplicates_equal_the_plain_loop(spark, batch):
    rows = made(700, 3)
    found = structures.drop_similar(spark.createDataFrame(rows, BLOCKS).repartition(5), first_batch=batch).collect()
    assert {r["id"]: r["duplicate_of"] for r in found} == keep_first(rows)
    assert all(r["kept"] == (r["duplicate_of"] is None) for r in found)


def test_chains_of_near_duplicates(spark):
    rows = [(i, "B", 1, [math.exp(0.15 * i)] * 3, [90.0] * 3, []) for i in range(60)]
    found = structures.drop_similar(spark.createDataFrame(rows, BLOCKS)).collect()
    assert {r["id"]: r["duplicate_of"] for r in found} == keep_first(rows)


def test_near_duplicates_without_whole_lattices(spark):
    rows = [(1, "B", 1, [1.0, 1.0, None], [90.0] * 3, []), (2, "B", 1, [1.0, 1.0, 1.0], [90.0, 90.0, float("nan")], []), (3, "B", 1, None, None, None)]
    assert structures.drop_similar(spark.createDataFrame(rows, BLOCKS)).count() == 0
    assert structures.drop_similar(spark.createDataFrame([], BLOCKS)).count() == 0


def test_novel_structures_equal_the_plain_loop(spark):
    rows = made(300, 5)
    df = spark.createDataFrame(rows, BLOCKS)
    found = {r["id"]: r["reason"] for r in structures.novelty_vs_base(df.where("id % 2 = 1"), df.where("id % 2 = 0")).collect()}
    base = rows[::2]
    for r in rows[1::2]:
        if r[1] is not None:
            assert found[r[0]] == ("matched" if any(b[1] == r[1] and near(b, r) for b in base) else "structure")


def test_neighbours_equal_all_pairs(spark):
    rng = np.random.default_rng(4)
    cells = {1: (9.0, 7.0, 11.0, 80.0, 95.0, 110.0, 60), 2: (2.0, 2.5, 3.0, 90.0, 90.0, 90.0, 1), 3: (4.0, 4.0, 4.0, 60.0, 60.0, 60.0, 3)}
    sites = [(k, i, *rng.uniform(-0.1, 1.05, 3).tolist()) for k, c in cells.items() for i in range(c[6])] + [(1, 60, None, 0.5, 0.5)]
    table = spark.createDataFrame([(k, *c[:6]) for k, c in cells.items()], "id int, a double, b double, c double, alpha double, beta double, gamma double")
    table = table.select("id", F.struct("a", "b", "c", "alpha", "beta", "gamma").alias("lattice"))
    radius = 3.5
    got = structures.site_distances(table, spark.createDataFrame(sites, "id int, position int, x double, y double, z double"), radius)
    got = sorted((r["id"], r["i"], r["j"], round(r["distance"], 8)) for r in got.collect())
    want = []
    for k, (a, b, c, al, be, ga, _) in cells.items():
        al, be, ga = map(math.radians, (al, be, ga))
        cx, cy = c * math.cos(be), c * (math.cos(al) - math.cos(be) * math.cos(ga)) / math.sin(ga)
        m = np.array([[a, b * math.cos(ga), cx], [0, b * math.sin(ga), cy], [0, 0, math.sqrt(c * c - cx * cx - cy * cy)]])
        own = [s for s in sites if s[0] == k and s[2] is not None]
        shifts = np.array(np.meshgrid(*[range(-5, 6)] * 3)).reshape(3, -1).T
        for s in own:
            for t in own:
                d = np.linalg.norm((np.array(t[2:]) - np.array(s[2:]) + shifts) @ m.T, axis=1)
                zero = (shifts == 0).all(1) & (s[1] == t[1])
                want += [(k, s[1], t[1], round(float(x), 8)) for x in d[(d <= radius) & ~zero]]
    assert got == sorted(want)
