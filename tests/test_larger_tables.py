"""What went wrong on larger tables, on small ones: long texts, ties, work done again and again."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from matquarry.operators import evaluation, scoring, structures, textops
from matquarry.plans import catalogue, catalogue_texts


def _parts(spark, place, n):
    spark.range(n).selectExpr("id AS p_partkey", "cast(1 + id % 50 AS int) AS p_size", "900D + id / 10D AS p_retailprice").write.parquet(f"{place}/part.parquet")
    return str(place)


def test_equal_scores_come_by_the_stated_ties(spark):
    rows = [(i, "Ag2Se", 3, 0.1, 0.2) for i in range(200, 0, -1)]
    scored = scoring.score(spark.createDataFrame(rows, "id int, formula string, total_atoms int, mu_log double, sigma_log double").repartition(7))
    assert [r["id"] for r in scoring.top_by_ei(scored, 20, ties=("id",)).orderBy("rank").collect()] == [*range(1, 21)]


def test_evidence_of_long_bodies(spark):
    body = 'say "x" \\ ' * 20_000
    raw = spark.createDataFrame([(1, f"{json.dumps({'body': body})} and {json.dumps({'body': ''})}")], "doc_id int, text string")
    assert [r["snippet"] for r in textops.evidence(raw).collect()] == [body, ""]


def test_structure_texts_are_made_once(spark, tmp_path):
    place = _parts(spark, tmp_path, 40)
    for query in (catalogue_texts.q_without_properties, catalogue_texts.q_corpus_ids, catalogue_texts.q_token_lengths, catalogue.q_corpus_tokens):
        plan = query(spark, place)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("_chemical_formula_structural") == 1 and plan.count("regexp_extract(") < 40
    assert catalogue.q_corpus_tokens(spark, place).count() == sum(i % 3 > 0 for i in range(40))


def test_token_pattern_is_longest_match(spark):
    vocabulary = ["S", "Se", "_sg", "_s", "\n", " ", ".", "-", "]", "^", "data_", "d", "é", "\\"]
    text = "Se SeS_sg_s_x\\]^-.\ndata_dat€é😀d"
    plain, rest = [], text
    while rest:
        plain.append(next((v for v in sorted(vocabulary, key=len, reverse=True) if rest.startswith(v)), rest[0]))
        rest = rest[len(plain[-1]):]
    frame = spark.createDataFrame([(text,)], "t string")
    assert frame.select(F.regexp_extract_all("t", F.lit(structures.token_pattern(vocabulary)), F.lit(0))).first()[0] == plain
    got = structures.tokenise(spark.createDataFrame([(1, text)], "id int, cif string"), vocabulary).first()
    assert got["ids"] == [vocabulary.index(t) if t in vocabulary else len(vocabulary) for t in plain]
    assert got["tokens"] == [t if t in vocabulary else "<unk>" for t in plain] and got["n_unknown"] == sum(t not in vocabulary for t in plain)


@pytest.mark.parametrize("most", [0, 2, 64])
def test_pairs_in_place_and_by_cubes_are_the_same(spark, most):
    rng = np.random.default_rng(6)
    cells = [(k, *rng.uniform(2, 9, 3).tolist(), *rng.uniform(60, 110, 3).tolist()) for k in range(30)]
    table = spark.createDataFrame(cells, "id int, a double, b double, c double, alpha double, beta double, gamma double")
    table = table.select("id", F.struct("a", "b", "c", "alpha", "beta", "gamma").alias("lattice"))
    sites = spark.createDataFrame([(k, i, *rng.uniform(0, 1, 3).tolist()) for k in range(30) for i in range(k % 5)], "id int, position int, x double, y double, z double")
    got = structures.site_distances(table, sites, 4.0, most=most)
    want = []
    shifts = np.array(np.meshgrid(*[range(-7, 8)] * 3)).reshape(3, -1).T
    at = {}
    for r in sites.collect():
        at.setdefault(r["id"], []).append((r["position"], np.array([r["x"], r["y"], r["z"]])))
    for k, a, b, c, al, be, ga in cells:
        al, be, ga = map(math.radians, (al, be, ga))
        cx, cy = c * math.cos(be), c * (math.cos(al) - math.cos(be) * math.cos(ga)) / math.sin(ga)
        if c * c - cx * cx - cy * cy <= 0.25:
            continue
        m = np.array([[a, b * math.cos(ga), cx], [0, b * math.sin(ga), cy], [0, 0, math.sqrt(c * c - cx * cx - cy * cy)]])
        for i, p in at.get(k, []):
            for j, q in at[k]:
                d = np.linalg.norm((q - p + shifts) @ m.T, axis=1)
                want += [(k, i, j, round(float(x), 7)) for x in d[(d <= 4.0) & ~((shifts == 0).all(1) & (i == j))]]
    solid = {w[0] for w in want}
    assert len(want) > 300 and sorted((r["id"], r["i"], r["j"], round(r["distance"], 7)) for r in got.collect() if r["id"] in solid) == sorted(want)


def test_pairs_of_small_structures_need_no_join_of_pairs(spark, tmp_path):
    plan = catalogue_texts.q_neighbour_lists(spark, _parts(spark, tmp_path, 8))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


@pytest.mark.parametrize("batch", [1, 4096])
def test_blocks_walked_in_place_tell_null_from_nan(spark, batch):
    lone, nan = [1.0, 1.0, 1.0], float("nan")
    profiles = [[1.0, None], [1.0, None], [1.0, nan], [1.0, nan], [1.0, 2.0], [1.1, 2.2], [1.1], [None, None], None, [5.0, 5.0]]
    rows = [(i, "B", 1, [1.0, 1.0, 1.0 + i / 1000], [90.0] * 3, p) for i, p in enumerate(profiles)] + [(90, None, 1, lone, [90.0] * 3, [5.0, 5.0])]
    frame = spark.createDataFrame(rows, "id int, block string, n_sites int, lengths array<double>, angles array<double>, profile array<double>")
    got = {r["id"]: r["duplicate_of"] for r in structures.drop_similar(frame, first_batch=batch).collect()}
    assert got == {0: None, 1: 0, 2: None, 3: None, 4: None, 5: 4, 6: 0, 7: None, 8: 0, 9: None, 90: None}


def test_blocks_read_their_texts_once(spark, tmp_path):
    texts = catalogue._cifs(spark, _parts(spark, tmp_path, 8))
    blocks = structures.fingerprint_blocks(structures.structure_table(texts), structures.atom_sites(texts), profiled=False)
    plan = blocks.where(F.forall("lengths", lambda v: v > 0))._jdf.queryExecution().optimizedPlan().toString()
    assert "profile" not in blocks.columns and "collect_list" not in plan and plan.count("_cell_length_a") < 20


def test_nearest_distances_in_blocks_are_exact(spark):
    rng = np.random.default_rng(8)
    b = np.vstack([rng.normal(size=(300, 6)) + 1e5, np.full((40, 6), 3.0)])
    a = np.vstack([b[:20] + 1e-7 * rng.normal(size=(20, 6)), b[5:9], rng.normal(size=(5, 6))])
    left = [(i, v.tolist()) for i, v in enumerate(a)] + [(100, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (101, [float("nan")] + [0.0] * 5), (102, [3.0, 3.0]), (103, None), (104, [1.0])]
    right = [(i, v.tolist()) for i, v in enumerate(b)] + [(900, [float("nan")] * 6), (901, [3.0, 5.0]), (902, None), (903, [None] * 6)]
    left, right = (spark.createDataFrame(x, "id int, fp array<double>") for x in (left, right))
    got = {r["id"]: r["fp"] for r in evaluation.nearest_distance(left, right, ["fp"], width=64).collect()}
    assert {i: got.pop(i) for i in range(len(a))} == pytest.approx({i: float(np.sqrt(((b - v) ** 2).sum(1)).min()) for i, v in enumerate(a)}, rel=1e-12, abs=0)
    assert math.isnan(got.pop(101)) and got == {100: None, 102: 2.0}


def test_nearest_distances_take_products_of_blocks(spark):
    frame = spark.range(50).selectExpr("cast(id AS int) AS id", "array(cast(id AS double)) AS fp")
    plan = evaluation.nearest_distance(frame, frame, ["fp"])._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan and "_least" in plan
