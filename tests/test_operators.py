"""Sequential and iterative operators against plain loops; sources, the loop and streams on small tables."""

import gzip
import io
import json
import math
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from matquarry.functions import formulas as fx
from matquarry.operators import candidates, evaluation, features, ledger, novelty, results, selection, structures, surrogate, textops
from matquarry.plans import loop
from matquarry.sources import datasets
from matquarry.streaming import streams

CIF = """data_Ag4Se2
_symmetry_space_group_name_H-M   'P 21'
_cell_length_a   4.00(2)
_cell_length_b   4.00
_cell_length_c   4.00
_cell_angle_alpha   90
_cell_angle_beta   90
_cell_angle_gamma   90
_cell_volume   64.123456
_cell_formula_units_Z   2
_chemical_formula_structural   Ag2Se
_chemical_formula_sum   'Ag4 Se2'
loop_
 _symmetry_equiv_pos_site_id
 _symmetry_equiv_pos_as_xyz
  1  'x, y, z'
  2  '-x, -y, -z'
loop_
 _atom_site_type_symbol
 _atom_site_symmetry_multiplicity
 _atom_site_fract_x
 _atom_site_fract_y
 _atom_site_fract_z
  Ag  4  0.0  0.0  0.0
  Se  2  0.5  0.5  0.5
"""


def test_candidate_space_size(spark):
    space = candidates.candidate_space(spark)
    assert space.count() == 61290 and space.select("formula").distinct().count() == 61290


def test_chains_stay_in_the_space(spark):
    seeds = spark.createDataFrame([(1,), (2,), (None,)], "chain long")
    def score(counts):
        return -counts.sum(1)

    rows = candidates.metropolis_chains(seeds, score, 15, burn_in=20).collect()
    assert rows == candidates.metropolis_chains(seeds.repartition(1), score, 15, burn_in=20).orderBy("chain").collect()
    names = {r["formula"] for r in candidates.candidate_space(spark).collect()}
    assert rows and all(r["formula"] in names and 0 < r["acceptance"] <= 1 for r in rows)
    assert len({(r["chain"], r["formula"]) for r in rows}) == len(rows)
    assert candidates.metropolis_chains(seeds.limit(0), score, 15).count() == 0


def test_chains_equal_a_plain_loop(spark):
    groups = {"A": (("Ag", "Cu"), 1, 900), "B": (("As",), 1, 900), "C": (("S", "Se", "Te"), 1, 900)}  # some 10^9 compositions
    names = ["Ag", "Cu", "As", "S", "Se", "Te"]

    def score(counts):
        return -abs(counts @ np.array([1.0, 2.0, 0.5, 1.0, 1.5, 3.0]) - 700) / 50

    got = {}
    for r in candidates.metropolis_chains(spark.createDataFrame([(7,), (-8,), (9,)], "chain long"), score, 12, groups, 30, 3, 0.3, 1.0, 2000).collect():
        got.setdefault(r["chain"], []).append((r["formula"], r["weight"], r["step"], r["acceptance"]))
    for chain in (7, -8, 9):
        def u(step, draw):
            return float(candidates.uniform(np.array([chain]), step, draw)[0])

        members = [m for m, _, _ in groups.values()]
        state = [[int(u(0, g) * len(m)), 1] for g, m in enumerate(members)]
        for g in range(3):
            state[g][1] = 1 + int(u(0, 3 + g) * min(900, 2000 - sum(c for k, (_, c) in enumerate(state) if k != g)))

        def weigh(state):
            return float(score(np.array([[float(sum(c for g, (e, c) in enumerate(state) if members[g][e] == x)) for x in names]]))[0])

        kept, accepted, step, weight = {}, 0, 0, weigh(state)
        while len(kept) < 12 and step < 30 + 3 * 12 * 10:
            step += 1
            new = [list(s) for s in state]
            g = int(u(step, 0) * 3)
            if u(step, 1) < 0.3:
                rest = [e for e in range(len(members[g])) if e != new[g][0]]
                if rest:
                    new[g][0] = rest[int(u(step, 2) * len(rest))]
            else:
                new[g][1] += 1 if u(step, 3) < 0.5 else -1
            if 1 <= new[g][1] <= 900 and sum(c for _, c in new) <= 2000 and math.log(u(step, 4)) < weigh(new) - weight:
                state, weight, accepted = new, weigh(new), accepted + 1
            if step > 30 and step % 3 == 0:
                name = "".join(f"{e}{c if c != 1 else ''}" for e, c in sorted((members[g][e], c) for g, (e, c) in enumerate(state)))
                kept.setdefault(name, (weight, step))
        assert got[chain] == [(f, pytest.approx(w), s, accepted / step) for f, (w, s) in kept.items()]


def test_score_dedup_is_sequential(spark):
    rng = np.random.default_rng(0)
    rows = [(int(g), f"f{rng.integers(6)}", int(rng.integers(8)), i) for i, g in enumerate(rng.integers(3, size=60))]
    got = {r["i"] for r in selection.dedup_scores(spark.createDataFrame(rows, "g int, formula string, original_rank int, i int"), "g").collect()}
    want = set()
    for g in range(3):
        ranks, names = set(), set()
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], r[1])):
            if r[2] not in ranks and r[1] not in names:
                ranks.add(r[2])
                names.add(r[1])
                want.add(r[3])
    assert got == want


def test_responses(spark):
    body = json.dumps({"ranked_materials": [{"formula": "A", "final_rank": "x", "scores": {"s": "99"}}, {"formula": "B", "final_rank": 2}]})
    raw = spark.createDataFrame([(1, body), (2, f"text\n```json\n{body}\n```"), (3, "none"), (4, None)], "id int, raw_text string")
    rows = selection.parse_responses(raw).orderBy("id", "position").collect()
    assert [(r["id"], r["formula"], r["final_rank"]) for r in rows] == [(1, "A", None), (1, "B", 2), (2, "A", None), (2, "B", 2)] and rows[0]["scores"] == {"s": 10.0}


def test_novel_and_known_partition_candidates(spark):
    c = spark.createDataFrame([("Ag4Se2",), ("AgSe",), ("CuS",)], "formula string")
    r = spark.createDataFrame([("MP", True, "SeAg2"), ("OQMD", False, "CuS")], "source string, query_ok boolean, formula string")
    assert {x[0] for x in novelty.known(c, r).collect()} == {"Ag4Se2"} and {x[0] for x in novelty.novel(c, r).collect()} == {"AgSe", "CuS"}


def test_dataset_update_is_idempotent(spark):
    origin = spark.createDataFrame([("Ag2 Se", 1.0), ("AgSe", 2.0), (None, 1.0)], "formula string, k double")
    once = results.update_dataset(origin, spark.createDataFrame([("Ag2Se", 0.5)], "formula string, k double"))
    assert sorted((r["formula"], r["k"], r["Ag"]) for r in once.collect()) == [("Ag2Se", 0.5, 2.0), ("AgSe", 2.0, 1.0)]
    assert sorted(once.collect()) == sorted(results.update_dataset(once, once).collect())


def test_stability_without_frequency_column(spark):
    rows = spark.createDataFrame([("否",), ("Y",), (None,)], "has_imaginary string")
    assert [r["stability_class"] for r in results.classify_stability(rows).collect()] == ["strict_stable_by_flag", "unstable_by_flag", "unstable_by_flag"]
    edge = spark.createDataFrame([(-0.1, None), (0.0, None), (-0.2, "no"), (None, "no"), (float("nan"), None)], "min_frequency double, has_imaginary string")
    assert [r["stability_class"] for r in results.classify_stability(edge).collect()] == ["quasi_stable", "strict_stable", "unstable", "strict_stable_by_flag", "unstable_by_flag"]


def test_feature_profile(spark):
    table = spark.createDataFrame([(i, float(i), float(i), 1.0, None, float(i % 3)) for i in range(20)], "id int, a double, b double, c double, d double, y double")
    kept, removed = features.sanitise(table, ["a", "b", "c", "d"], "id")
    assert kept == ["a"] and removed == {"b": "equal to a", "c": "constant", "d": "all null"}
    pruned = {r["feature"]: r["kept"] for r in features.prune_correlated(table, ["a", "b"], "y").collect()}
    assert sum(pruned.values()) == 1


def test_structures(spark):
    texts = spark.createDataFrame([(1, CIF), (2, CIF.replace("Se  2", "Se  3").replace("alpha   90", "alpha   175")), (3, None), (4, "data_x\n_cell_formula_units_Z 0")], "id int, cif string")
    table, sites = structures.structure_table(texts), structures.atom_sites(texts)
    rows = {r["id"]: r for r in table.withColumn("ok", structures.is_sensible(F.col("cif"))).collect()}
    assert rows[1]["lattice"]["a"] == 4.0 and rows[1]["space_group"] == "P 21" and rows[1]["z"] == 2 and rows[1]["cell_volume"] == pytest.approx(64)
    assert rows[1]["ok"] and not rows[2]["ok"] and rows[3]["space_group"] is None
    checked = {r["id"]: r["multiplicity_consistent"] for r in structures.multiplicity_check(table, sites).collect()}
    assert checked == {1: True, 2: False, 3: False, 4: False}
    assert [r["c"] for r in table.where("id = 1").select(structures.is_formula_consistent(table).alias("c")).collect()] == [True]
    near = structures.site_distances(table.where("id = 1"), sites.where("id = 1"))
    assert near.agg(F.min("distance")).first()[0] == pytest.approx(math.sqrt(3) * 2)
    lists = structures.neighbour_lists(near).where("i = 0").first()["neighbours"]
    assert len(lists) == 12 and [round(n["distance"], 6) for n in lists[:8]] == [round(math.sqrt(12), 6)] * 8
    made = {r["id"]: r for r in structures.prepare_corpus(texts, features.element_table(spark)).collect()}
    assert made[3]["rejected"] == "no text" and made[4]["rejected"] == "z is 0" and "64.1235" in made[1]["cif"] and made[1]["cif"].startswith("data_Ag4Se2")
    assert "'-x, -y, -z'" not in made[1]["cif"] and made[1]["cif"].index("_atom_type_symbol") < made[1]["cif"].index("_symmetry_space_group")
    text = spark.createDataFrame([(made[1]["cif"],)], "t string")
    assert "_atom_type_symbol" not in text.select(structures.without_properties(F.col("t"))).first()[0]


def test_tokens_round_trip(spark):
    rows = spark.createDataFrame([(1, "data_Ag2Se\n_symmetry_space_group_name_H-M Pm\nQ")], "id int, cif string")
    vocabulary = ["Ag", "A", "g", "Se", "2", "\n", " ", "data_", "_symmetry_space_group_name_H-M", "Pm_sg"]
    got = structures.tokenise(rows, vocabulary).first()
    assert got["tokens"] == ["data_", "Ag", "2", "Se", "\n", "_symmetry_space_group_name_H-M", " ", "Pm_sg", "\n", "<unk>"] and got["n_unknown"] == 1
    back = spark.createDataFrame([(got["tokens"],)], "t array<string>").select(structures.detokenise(F.col("t"))).first()[0]
    assert back == "data_Ag2Se\n_symmetry_space_group_name_H-M Pm\n<unk>"


def test_greedy_structure_dedup(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "B", 2, sorted(float(v) for v in rng.choice([1.0, 1.1, 1.5], 3)), [90.0, 90.0, 90.0]) for i in range(30)]
    got = {r["id"]: r["duplicate_of"] for r in structures.drop_similar(spark.createDataFrame(rows, "id int, block string, n_sites int, lengths array<double>, angles array<double>")).collect()}
    kept = []
    for i, _, _, lengths, _ in rows:
        match = next((k for k, other in kept if all(abs(a - b) <= 0.2 * max(a, b) for a, b in zip(lengths, other))), None)
        assert got[i] == match
        if match is None:
            kept.append((i, lengths))


def test_structures_of_one_cell_are_told_apart_by_their_sites(spark):
    moved = CIF.replace("0.5", "0.1")
    assert moved != CIF
    texts = spark.createDataFrame([(1, CIF), (2, CIF.replace("4.0", "4.1")), (3, moved), (4, moved)], "id int, cif string")
    blocks = structures.fingerprint_blocks(structures.structure_table(texts), structures.atom_sites(texts), radius=6.0)
    assert {r["id"]: r["duplicate_of"] for r in structures.drop_similar(blocks).collect()} == {1: None, 2: 1, 3: None, 4: 3}
    found = structures.novelty_vs_base(blocks.where("id IN (2, 3)"), blocks.where("id = 1"))
    assert {r["id"]: r["reason"] for r in found.collect()} == {2: "matched", 3: "structure"}


def test_charge_balance(spark):
    states = spark.createDataFrame([("Ag", [1], True, 1.9), ("Se", [-2, 4], False, 2.5), ("Cu", [1, 2], True, 1.9)], "element string, states array<int>, is_metal boolean, eneg double")
    rows = spark.createDataFrame([(1, "Ag2Se"), (2, "AgSe"), (3, "AgCu"), (4, "Se"), (5, "XeAg")], "id int, formula string")
    assert {r["id"]: r["charge_valid"] for r in structures.charge_balance(rows, states).collect()} == {1: True, 2: False, 3: True, 4: True, 5: False}


def test_nearest_and_wasserstein(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(40, 5)), rng.normal(size=(700, 5))
    left, right = (spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9999, None)], "id int, fp array<double>") for x in (a, b))
    got = {r["id"]: r["fp"] for r in evaluation.nearest_distance(left, right, ["fp"]).collect()}
    assert got == pytest.approx({i: float(np.linalg.norm(b - v, axis=1).min()) for i, v in enumerate(a)})
    x, y = rng.normal(size=300), rng.normal(1, 2, size=300)
    frames = [spark.createDataFrame([(float(v),) for v in z], "v double") for z in (x, y)]
    assert evaluation.wasserstein(*frames, "v").first()[0] == pytest.approx(np.abs(np.sort(x) - np.sort(y)).mean())


def test_text_operators(spark):
    docs = spark.createDataFrame([(1, "intro\n## One\nalpha\n### Deep\nbeta\n## Two\ngamma\n| **Rate** | 0.5 |\n")], "doc_id int, text string")
    assert [(r["section_no"], r["title"]) for r in textops.sections(docs).collect()] == [(0, ""), (1, "One"), (2, "Two")]
    assert textops.heading_blocks(docs, "One").first()["body"] == "## One\nalpha\n### Deep\nbeta"
    assert textops.keyword_context(docs, "BETA", 1).first()["context"] == "### Deep\nbeta\n## Two"
    found = textops.settings_rows(docs)
    assert [tuple(r) for r in found.collect()] == [(1, "rate", "0.5")]
    wanted = spark.createDataFrame([("rate", "0.6"), ("size", "1")], "name string, value string")
    assert sorted(r["name"] for r in textops.settings_mismatch(found, wanted).collect()) == ["rate", "size"]
    raw = spark.createDataFrame([(1, r'{"body": "a \"b\" c"}, {"body": "d"}')], "doc_id int, text string")
    assert [r["snippet"] for r in textops.evidence(raw).collect()] == ['a "b" c', "d"]


def test_termination(spark):
    rows = [(i, 10, 0 if i < 11 else 1, 0.0 if i < 11 else 0.1) for i in range(1, 13)]
    got = ledger.termination(spark.createDataFrame(rows, "iteration int, n_selected int, n_success int, success_rate double")).orderBy("iteration").collect()
    assert [r["stop_reason"] for r in got] == [None] * 9 + ["no success in a row", None, None]


def test_dataset_source(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿formula,Ag,empty,k,\nAg2Se,2,,1.5,\n AgSe ,nan,,2,\n", encoding="utf-8")
    df = datasets.read_dataset(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["formula", "Ag", "k"] and [tuple(r) for r in df.collect()] == [("Ag2Se", 2.0, 1.5), ("AgSe", None, 2.0)]
    (tmp_path / "b.csv").write_text("formula,k\nAg,\n")
    with pytest.raises(ValueError):
        datasets.read_dataset(spark, str(tmp_path / "b.csv"))


def test_iteration_sources(spark, tmp_path):
    for n, name in ((1, "success.csv"), (1, "dedup.csv"), (2, "success.csv")):
        place = tmp_path / f"iteration_{n}" / "success_examples"
        place.mkdir(parents=True, exist_ok=True)
        (place / name).write_text(f"formula,{name[0]}\n{name},{n}\n")
    rows = datasets.scan_iterations(spark, str(tmp_path), "success_examples", ["dedup.csv", "success.csv"]).collect()
    assert sorted((r["iteration"], r["formula"]) for r in rows) == [(1, "dedup.csv"), (2, "success.csv")]
    assert datasets.scan_iterations(spark, str(tmp_path), "other", ["x.csv"]).collect() == []
    table = spark.createDataFrame([(1, "a"), (2, "b")], "iteration int, x string")
    datasets.overwrite_iteration(table, str(tmp_path / "t"))
    datasets.overwrite_iteration(spark.createDataFrame([(2, "c")], "iteration int, x string"), str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    assert sorted(r["x"] for r in stored.collect()) == ["a", "c"] and [r["x"] for r in datasets.latest_snapshot(stored, 5).collect()] == ["c"]


def test_archives_and_dumps(spark, tmp_path):
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w") as archive:
        data = CIF.encode()
        info = tarfile.TarInfo("d/x__1.cif")
        info.size = len(data)
        archive.addfile(info, io.BytesIO(data))
    (tmp_path / "a.tar.gz").write_bytes(gzip.compress(buffer.getvalue()))
    (tmp_path / "y.cif").write_text(CIF)
    got = datasets.read_structures(spark, str(tmp_path))
    assert sorted(r["id"] for r in got.collect()) == ["x__1", "y"] and all(r["cif"] == CIF for r in got.collect())
    assert datasets.export_archives(got, str(tmp_path / "out")).agg(F.sum("n")).first()[0] == 2
    dump = spark.createDataFrame([('{"auid": "1", "compound": "Ag2Se", "Egap": "x", "extra": 3}',), ("{}",)], "value string")
    rows = datasets.reference_records(dump, "AFLOW").collect()
    assert len(rows) == 1 and rows[0]["formula"] == "Ag2Se" and rows[0]["band_gap"] is None and not rows[0]["structure_available"] and rows[0]["metadata"]["extra"] == "3"


def test_loop(spark, tmp_path):
    kappa = spark.createDataFrame([(1, "s1", "a.cif", "Ag2Se", 0.5), (1, "s2", "b.cif", "AgSe", 2.0)], "iteration int, structure_id string, cif_file string, formula string, k double")
    log = spark.createDataFrame([("a.cif", 1, -5.0, "Y"), ("a.cif", 2, 0.1, "N"), ("b.cif", 1, -0.05, "N")], "cif_file string, ts int, min_frequency double, has_imaginary string")
    found = loop.extract(kappa, log, ["ts"])
    assert [r["formula"] for r in found.success.collect()] == ["Ag2Se"] and found.stable.count() == 2 and found.counts.first()["n_quasi_stable"] == 1
    origin = spark.createDataFrame([("Ag2Se", 0.9)], "formula string, k double")
    assert [(r["formula"], r["k"]) for r in loop.update(origin, found).collect()] == [("Ag2Se", 0.5)]
    pool = spark.createDataFrame([(f"Ag{n}Se", 0.1 * n, 0.2) for n in range(2, 9)], "formula string, mu_log double, sigma_log double")
    trace = loop.run_iteration(2, pool, kappa.select("iteration", "k"), None, str(tmp_path / "trace"), top_k=5, n_select=2)
    first = [r["formula"] for r in trace.where("selected").orderBy("rank").collect()]
    again = loop.run_iteration(2, pool, kappa.select("iteration", "k"), None, str(tmp_path / "trace"), top_k=5, n_select=2)
    assert first == ["Ag2Se", "Ag3Se"] and again.count() == 5


def test_stream_equals_batch_on_replay(spark, tmp_path):
    rows = [("A", 3.0), ("B", 1.0), ("A", 2.0), ("C", None)]
    for n, r in enumerate(rows):
        spark.createDataFrame([r], "formula string, k double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = streams.file_stream(spark, str(tmp_path / "in"), "formula string, k double", 1)
        streams.upkeep(stream, str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    assert sorted(map(tuple, streams.current(spark, str(tmp_path / "t")).collect())) == [("A", 2.0), ("B", 1.0)]
    versions = [len(list(p.glob("v=*"))) for p in (tmp_path / "t").glob("part=*")]
    assert versions and max(versions) <= 2
