"""Registered queries of the materials-search operators, each with the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formulas as fx
from ..functions import numeric as nx
from ..functions import values as vx
from ..operators import candidates, evaluation, features, ledger, novelty, results, scoring, selection, structures, surrogate, tables, textops
from ..sources import shared
from ..streaming import streams
from . import inputs as i

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def registered(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql:
            SQL[query.__name__] = sql
        return query

    return keep


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# formulas


@registered(f"""WITH {i.COMP}
SELECT id, a AS element, CAST(na * times AS DOUBLE) AS amount FROM comp UNION ALL SELECT id, b, CAST(nb * times AS DOUBLE) FROM comp
UNION ALL SELECT id, c, CAST(nc AS DOUBLE) FROM comp""")
def q_formula_parse(spark: SparkSession, d: str) -> DataFrame:
    return features.long_compositions(i.compositions(spark, d), "raw")


@registered(f"""WITH {i.COMP}
SELECT id, CASE WHEN id % 4 = 3 THEN '(' || a || na || b || nb || ')2' || c || nc ELSE formula END AS normalized FROM comp""")
def q_formula_norm(spark: SparkSession, d: str) -> DataFrame:
    return i.compositions(spark, d).select("id", fx.normalize_formula(F.col("raw")).alias("normalized"))


@registered(f"""WITH {i.COMP}
SELECT id, list_reduce(list_transform(list_sort([a || ' ' || na * times, b || ' ' || nb * times, c || ' ' || nc]),
  lambda x: CASE WHEN split_part(x, ' ', 2) = '1' THEN split_part(x, ' ', 1) ELSE replace(x, ' ', '') END), lambda x, y: x || y) AS canonical FROM comp""")
def q_formula_canonical(spark: SparkSession, d: str) -> DataFrame:
    return i.compositions(spark, d).select("id", fx.canonical_formula(F.col("raw")).alias("canonical"))


@registered(f"WITH {i.COMP} SELECT id, {i.REDUCED} AS reduced FROM comp")
def q_formula_reduced(spark: SparkSession, d: str) -> DataFrame:
    return i.compositions(spark, d).select("id", fx.reduced_formula(F.col("formula")).alias("reduced"))


@registered(f"""WITH {i.COMP},
spelled AS (SELECT id, formula, list_reduce(list_transform(list_sort([a || ' ' || na, b || ' ' || nb, c || ' ' || nc]), lambda x: replace(x, ' ', '')), lambda x, y: x || y) AS expanded,
  list_reduce(list_transform(list_sort([a || ' ' || na, b || ' ' || nb, c || ' ' || nc]),
    lambda x: CASE WHEN split_part(x, ' ', 2) = '1' THEN split_part(x, ' ', 1) ELSE replace(x, ' ', '') END), lambda x, y: x || y) AS whole, {i.REDUCED} AS reduced FROM comp)
SELECT id, formula || CASE WHEN whole <> formula THEN ',' || whole ELSE '' END || CASE WHEN reduced NOT IN (formula, whole) THEN ',' || reduced ELSE '' END
  || CASE WHEN expanded NOT IN (formula, whole, reduced) THEN ',' || expanded ELSE '' END AS variants FROM spelled""")
def q_formula_variants(spark: SparkSession, d: str) -> DataFrame:
    return i.compositions(spark, d).select("id", F.array_join(fx.formula_variants(F.col("formula")), ",").alias("variants"))


@registered(f"WITH {i.COMP} SELECT id, array_to_string(list_sort([a, b, c]), ',') AS elements, 3 AS n_elements FROM comp")
def q_element_set(spark: SparkSession, d: str) -> DataFrame:
    elements = fx.element_set(F.col("formula"))
    return i.compositions(spark, d).select("id", F.array_join(elements, ",").alias("elements"), F.size(elements).alias("n_elements"))


@registered(f"""WITH {i.COMP} SELECT id, """ + ", ".join(
    f"CAST(CASE WHEN a = '{e}' THEN na WHEN b = '{e}' THEN nb WHEN c = '{e}' THEN nc ELSE 0 END AS DOUBLE) AS \"{e}\"" for e in fx.FEATURE_ELEMENTS) + " FROM comp")
def q_features14(spark: SparkSession, d: str) -> DataFrame:
    return features.element_block(i.compositions(spark, d))


@registered(f"""WITH {i.COMP} SELECT id, na BETWEEN 2 AND 10 AND nb BETWEEN 1 AND 10 AND nc BETWEEN 1 AND 10 AND na + nb + nc <= 20 AS valid,
  CAST(na + nb + nc AS DOUBLE) AS total_atoms FROM comp""")
def q_constraints(spark: SparkSession, d: str) -> DataFrame:
    composition = fx.parse_formula(F.col("formula"))
    return i.compositions(spark, d).select(
        "id", fx.is_valid_composition(composition, candidates.DEFAULT_GROUPS).alias("valid"), fx.total_atoms(composition).alias("total_atoms")
    )


@registered("""SELECT o_orderkey, CAST(('0x' || substr(sha256('orders::' || o_orderkey || '::' || o_custkey), 1, 16))::UBIGINT % 4294967295 AS BIGINT) AS seed FROM orders""")
def q_derived_seed(spark: SparkSession, d: str) -> DataFrame:
    return i.table(spark, d, "orders").select("o_orderkey", vx.derive_seed(F.lit("orders"), F.col("o_orderkey"), F.col("o_custkey")).alias("seed"))


@registered(f"""WITH {i.PHONON}
SELECT cif_file, ts, lower(trim(has_imaginary)) IN ('否', 'no', 'n', 'false', '0') AS no_imaginary, regexp_replace(cif_file, '\\.cif$', '') AS structure_id FROM phonon""")
def q_conform_flags(spark: SparkSession, d: str) -> DataFrame:
    return i.phonon(spark, d).select(
        "cif_file", "ts", vx.no_imaginary_flag(F.col("has_imaginary")).alias("no_imaginary"), vx.structure_id(F.col("cif_file")).alias("structure_id")
    )


@registered(f"""WITH {i.COMP} SELECT id, {i.REDUCED} AS reduced, array_to_string(list_sort([a, b, c]), ',') AS elements, 3 AS n_elements, CAST(na + nb + nc AS DOUBLE) AS total_atoms
FROM (SELECT id, a, na * times AS na, b, nb * times AS nb, c, nc FROM comp)""")
def q_standard_formulas(spark: SparkSession, d: str) -> DataFrame:
    made = tables.standardise_formulas(i.compositions(spark, d), "raw")
    return made.select("id", "reduced", F.array_join("elements", ",").alias("elements"), "n_elements", "total_atoms")


@registered(f"""WITH {i.KAPPA} SELECT cif_file, formula, round(k, 6) AS k FROM kappa""")
def q_conform_records(spark: SparkSession, d: str) -> DataFrame:
    """Results under drifting names, typed again."""
    drifted = i.kappa(spark, d).select(
        F.col("formula").alias("Formula"), F.col("cif_file").alias("CIF_File"), F.concat(F.col("k").cast("string"), F.lit(" W/mK")).alias("kappa (W/m.K)")
    )
    return rounded(tables.conform_records(drifted, "kappa").select("cif_file", "formula", "k"))


# candidates and scores


@registered(f"""WITH {i.COMP}, known AS (SELECT DISTINCT {i.REDUCED} AS reduced FROM comp),
space AS (SELECT a, b, c, na, nb, nc FROM (SELECT unnest({i._listed(i.A)}) AS a), (SELECT unnest({i._listed(i.B)}) AS b), (SELECT unnest({i._listed(i.C)}) AS c),
  (SELECT unnest(range(2, 11)) AS na), (SELECT unnest(range(1, 11)) AS nb), (SELECT unnest(range(1, 11)) AS nc) WHERE na + nb + nc <= 20)
SELECT list_reduce(list_transform(list_sort([a || ' ' || na, b || ' ' || nb, c || ' ' || nc]),
  lambda x: CASE WHEN split_part(x, ' ', 2) = '1' THEN split_part(x, ' ', 1) ELSE replace(x, ' ', '') END), lambda x, y: x || y) AS formula
FROM space WHERE {i.REDUCED} NOT IN (SELECT reduced FROM known)""")
def q_candidate_space(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of the constraint space that no part is a multiple of."""
    known = i.compositions(spark, d).select(fx.reduced_formula(F.col("formula")).alias("key")).distinct()
    space = candidates.candidate_space(spark)
    return space.join(known, fx.composition_to_formula(fx.reduce_composition(F.col("composition"))) == known["key"], "left_anti").select("formula")


Z = "(ln(1.0::DOUBLE) - mu_log - 0.01) / greatest(sigma_log, 1e-9)"
EI = f"""{i.PRED}, scored AS (SELECT *, exp(mu_log) AS k_pred,
  greatest(0, (-mu_log - 0.01) * {i.SERIES.format(z=Z)} + sigma_log * exp(-({Z}) * ({Z}) / 2) / sqrt(2 * pi())) AS ei FROM pred)"""


@registered(f"""WITH {EI}, cut AS (SELECT * FROM scored ORDER BY ei DESC, k_pred, formula, total_atoms LIMIT 20)
SELECT CAST(row_number() OVER (ORDER BY ei DESC, k_pred, formula, total_atoms) AS INT) AS rank, id, formula, round(ei, 6) AS ei, round(k_pred, 6) AS k_pred FROM cut""")
def q_ei_topk(spark: SparkSession, d: str) -> DataFrame:
    """Parts equal in all that the SQL orders by come by their id, which is one of the orders it leaves open."""
    return rounded(scoring.top_by_ei(scoring.score(i.predictions(spark, d)), ties=("id",)).select("rank", "id", "formula", "ei", "k_pred"))


@registered("""WITH cut AS (SELECT l_orderkey, l_linenumber, l_discount AS score FROM lineitem ORDER BY score DESC, l_orderkey, l_linenumber LIMIT 50)
SELECT CAST(row_number() OVER (ORDER BY score DESC, l_orderkey, l_linenumber) AS INT) AS rank, l_orderkey, l_linenumber FROM cut""")
def q_rank_by_score(spark: SparkSession, d: str) -> DataFrame:
    """Ties keep their order: discounts have few values."""
    rows = i.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("score"), F.struct("l_orderkey", "l_linenumber").alias("position"))
    return scoring.rank_by_score(rows, 50).select("rank", "l_orderkey", "l_linenumber")


@registered(f"""WITH {EI} SELECT id, round(ln(1 + ei) + 0.5 * ln(1 + sigma_log) - ln(k_pred), 6) AS weight, round(exp(mu_log - 1.96 * sigma_log), 6) AS k_lower,
  round(exp(mu_log + 1.96 * sigma_log), 6) AS k_upper, round(ei, 6) AS ei FROM scored""")
def q_weight_rank(spark: SparkSession, d: str) -> DataFrame:
    return rounded(scoring.score(i.predictions(spark, d)).select("id", "weight", "k_lower", "k_upper", "ei"))


@registered(f"""WITH {EI} SELECT count(*) AS n, """ + ", ".join(f"round({f}({c}), 6) AS {f}_{c}" for c in ("ei", "k_pred", "sigma_log") for f in ("min", "max", "avg")) + " FROM scored")
def q_score_statistics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(scoring.score_statistics(scoring.score(i.predictions(spark, d))))


@registered("""WITH h AS (SELECT o_custkey % 20 AS iteration, o_totalprice / 100000 AS k FROM orders),
low AS (SELECT iteration, min(k) FILTER (k > 0) AS k FROM h GROUP BY iteration)
SELECT CAST(a.iteration AS INT) AS iteration, round(ln(coalesce((SELECT min(b.k) FROM low b WHERE b.iteration < a.iteration), 1.0)), 6) AS f_min FROM low a""")
def q_fmin_history(spark: SparkSession, d: str) -> DataFrame:
    history = i.table(spark, d, "orders").select(F.expr("cast(o_custkey % 20 AS int)").alias("iteration"), (F.col("o_totalprice") / 100000).alias("k"))
    return rounded(scoring.best_known(history))


@registered(f"""WITH {i.COMP},
base AS (SELECT id, formula, a, na, b, nb, c, nc FROM comp),
steps AS (
  SELECT id, x AS a, na, b, nb, c, nc FROM base, (SELECT unnest({i._listed(i.A)}) AS x) WHERE x <> a
  UNION ALL SELECT id, a, na, x, nb, c, nc FROM base, (SELECT unnest({i._listed(i.B)}) AS x) WHERE x <> b
  UNION ALL SELECT id, a, na, b, nb, x, nc FROM base, (SELECT unnest({i._listed(i.C)}) AS x) WHERE x <> c
  UNION ALL SELECT id, a, na + s, b, nb, c, nc FROM base, (VALUES (-1), (1)) t(s) UNION ALL SELECT id, a, na, b, nb + s, c, nc FROM base, (VALUES (-1), (1)) t(s)
  UNION ALL SELECT id, a, na, b, nb, c, nc + s FROM base, (VALUES (-1), (1)) t(s))
SELECT id, count(*) AS n_neighbours FROM steps WHERE na BETWEEN 2 AND 10 AND nb BETWEEN 1 AND 10 AND nc BETWEEN 1 AND 10 AND na + nb + nc <= 20 GROUP BY id""")
def q_neighbours(spark: SparkSession, d: str) -> DataFrame:
    base = i.compositions(spark, d).select("id", "formula", fx.parse_formula(F.col("formula")).alias("composition"))
    moved = candidates.neighbours(base.select(F.col("id").alias("formula"), "composition"))
    return moved.groupBy(F.col("formula").alias("id")).agg(F.count("*").alias("n_neighbours"))


@registered(f"""WITH {i.COMP} SELECT formula, md5('42|' || formula) AS h FROM (SELECT DISTINCT formula FROM comp) ORDER BY h, formula LIMIT 100""")
def q_hash_sample(spark: SparkSession, d: str) -> DataFrame:
    """A sample of 100 formulas: the sampling operator's own limit."""
    picked = candidates.hash_sample(i.compositions(spark, d).select("formula").distinct(), 100)
    return picked.select("formula", F.md5(F.concat(F.lit("42|"), "formula")).alias("h"))


CANON = """list_reduce(list_transform(list_sort([a || ' ' || na, b || ' ' || nb, c || ' ' || nc]),
  lambda x: CASE WHEN split_part(x, ' ', 2) = '1' THEN split_part(x, ' ', 1) ELSE replace(x, ' ', '') END), lambda x, y: x || y)"""
_SWAPS = ", ".join(f"('{old}', '{new}')" for old, news in candidates.SUBSTITUTES.items() for new in news)
MUTATED = f"""{i.COMP}, win AS (SELECT DISTINCT a, na, b, nb, c, nc, {CANON} AS formula FROM comp WHERE p_retailprice < 1000), swap AS (SELECT * FROM (VALUES {_SWAPS}) t(old, new)),
moved AS (SELECT new AS a, na, b, nb, c, nc FROM win JOIN swap ON old = a WHERE new NOT IN (b, c) UNION ALL SELECT a, na, new, nb, c, nc FROM win JOIN swap ON old = b WHERE new NOT IN (a, c)
  UNION ALL SELECT a, na, b, nb, new, nc FROM win JOIN swap ON old = c WHERE new NOT IN (a, b) UNION ALL SELECT a, na + d, b, nb, c, nc FROM win, (VALUES (-1), (1)) t(d)
  UNION ALL SELECT a, na, b, nb + d, c, nc FROM win, (VALUES (-1), (1)) t(d) UNION ALL SELECT a, na, b, nb, c, nc + d FROM win, (VALUES (-1), (1)) t(d)),
mutated AS (SELECT DISTINCT {CANON} AS formula FROM moved WHERE least(na, nb, nc) >= 1 AND na + nb + nc <= 20),
new AS (SELECT formula FROM mutated WHERE formula NOT IN (SELECT formula FROM win) ORDER BY md5('42|' || formula), formula LIMIT 70),
space AS (SELECT a, b, c, na, nb, nc FROM (SELECT unnest({i._listed(i.A)}) AS a), (SELECT unnest({i._listed(i.B)}) AS b), (SELECT unnest({i._listed(i.C)}) AS c),
  (SELECT unnest(range(2, 11)) AS na), (SELECT unnest(range(1, 11)) AS nb), (SELECT unnest(range(1, 11)) AS nc) WHERE na + nb + nc <= 20),
named AS (SELECT {CANON} AS formula FROM space),
drawn AS (SELECT formula FROM named WHERE formula NOT IN (SELECT formula FROM win) AND formula NOT IN (SELECT formula FROM new) ORDER BY md5('42|' || formula), formula LIMIT 100)"""


@registered(f"""WITH {MUTATED}, every AS (SELECT formula, 'mutation' AS origin FROM new UNION ALL SELECT formula, 'random' FROM drawn)
SELECT formula, origin FROM every ORDER BY origin, md5('42|' || formula), formula LIMIT 100""")
def q_mutation_mix(spark: SparkSession, d: str) -> DataFrame:
    winners = i.compositions(spark, d).where("p_retailprice < 1000").select("formula").distinct()
    winners = winners.select(F.col("formula").alias("f")).select(
        fx.canonical_formula(F.col("f")).alias("formula"), fx.parse_formula(F.col("f")).alias("composition")
    )
    return candidates.mixed_candidates(candidates.candidate_space(spark), winners, 100).select("formula", "origin")


@registered()
def q_mcmc(spark: SparkSession, d: str) -> DataFrame:
    """One chain a supplier over compositions weighted by the parts' mean prices of their elements."""
    price = i.compositions(spark, d).select(F.explode(F.array("a", "b", "c")).alias("element"), "p_retailprice").groupBy("element").agg(F.avg("p_retailprice").alias("p"))
    known = {r["element"]: r["p"] for r in price.collect()}  # a row an element
    prices = np.array([known.get(e, 0.0) for members, _, _ in candidates.DEFAULT_GROUPS.values() for e in members])
    seeds = i.table(spark, d, "supplier").select(F.col("s_suppkey").alias("chain"))
    return candidates.metropolis_chains(seeds, lambda counts: -(counts * prices).sum(1) / 1000, 20, burn_in=50)


# results


def _classified(spark: SparkSession, d: str) -> DataFrame:
    return results.classify_stability(results.merge_stability(i.kappa(spark, d), i.phonon(spark, d), ["cif_file"], ["ts"]))


@registered(f"WITH {i.STATE} SELECT cif_file, min_frequency, has_imaginary, gamma_min_optical, gamma_max_acoustic, round(k, 6) AS k FROM stated")
def q_merge_stability(spark: SparkSession, d: str) -> DataFrame:
    merged = results.backfill_stability(i.kappa(spark, d), i.phonon(spark, d))
    return rounded(merged.select("cif_file", *("min_frequency", "has_imaginary", "gamma_min_optical", "gamma_max_acoustic"), "k"))


@registered(f"WITH {i.STATE} SELECT cif_file, stability_class, dynamic_stable FROM stated")
def q_stability_class(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d).select("cif_file", "stability_class", "dynamic_stable")


@registered(f"WITH {i.STATE} SELECT cif_file, formula, round(k, 6) AS k FROM stated WHERE dynamic_stable AND k < 1.0")
def q_success(spark: SparkSession, d: str) -> DataFrame:
    return rounded(results.success(_classified(spark, d)).select("cif_file", "formula", "k"))


@registered(f"WITH {i.STATE} SELECT cif_file, formula, round(k, 6) AS k FROM stated WHERE dynamic_stable AND k < 5.0")
def q_stable(spark: SparkSession, d: str) -> DataFrame:
    return rounded(results.stable(_classified(spark, d)).select("cif_file", "formula", "k"))


@registered(f"""WITH {i.STATE} SELECT iteration, count(*) AS n, count(*) FILTER (dynamic_stable) AS n_dynamic_stable, count(*) FILTER (stability_class = 'quasi_stable') AS n_quasi_stable,
  count(*) FILTER (dynamic_stable AND k < 1.0) AS n_success, count(*) FILTER (dynamic_stable AND k < 5.0) AS n_stable FROM stated GROUP BY iteration""")
def q_extraction_counts(spark: SparkSession, d: str) -> DataFrame:
    return results.extraction_counts(_classified(spark, d), "iteration")


@registered(f"""WITH {i.STATE} SELECT structure_id, cif_file, formula, round(k, 6) AS thermal_conductivity_w_mk, min_frequency, stability_class, dynamic_stable, iteration
FROM stated WHERE dynamic_stable AND k < 1.0""")
def q_success_records(spark: SparkSession, d: str) -> DataFrame:
    made = results.success_records(results.success(_classified(spark, d)))
    return rounded(made.select("structure_id", "cif_file", "formula", "thermal_conductivity_w_mk", "min_frequency", "stability_class", "dynamic_stable", "iteration"))


@registered(f"""WITH {i.KAPPA}, origin AS (SELECT formula, p_retailprice / 500 AS k FROM comp),
every_row AS (SELECT formula, k FROM origin UNION ALL SELECT formula, k FROM kappa WHERE k < 1.0)
SELECT formula, round(min(k), 6) AS k FROM every_row GROUP BY formula""")
def q_dedup_lowest_k(spark: SparkSession, d: str) -> DataFrame:
    origin = i.compositions(spark, d).select(F.col("formula"), (F.col("p_retailprice") / 500).alias("k"))
    winners = results.below_threshold(i.kappa(spark, d), 1.0)
    return rounded(results.update_dataset(origin, winners).select("formula", "k"))


@registered(f"""WITH {i.STATE}, good AS (SELECT formula, structure_id, iteration, k FROM stated WHERE dynamic_stable AND k < 5.0)
SELECT formula, structure_id AS id, iteration, round(k, 6) AS k, CASE WHEN k < 1.0 THEN 'success' ELSE 'stable' END AS source FROM good
QUALIFY row_number() OVER (PARTITION BY formula, structure_id ORDER BY k, iteration) = 1""")
def q_aggregate(spark: SparkSession, d: str) -> DataFrame:
    rows = _classified(spark, d).withColumn("path", F.lit(None).cast("string"))
    return rounded(results.aggregate_materials(results.success(rows), results.stable(rows)))


@registered(f"""WITH {i.STATE}, s AS (SELECT * FROM stated WHERE dynamic_stable AND k < 0.0), t AS (SELECT * FROM stated WHERE dynamic_stable AND k < 5.0)
SELECT cif_file, round(k, 6) AS k FROM s UNION ALL SELECT cif_file, round(k, 6) FROM t WHERE NOT EXISTS (SELECT 1 FROM s)""")
def q_warm_start(spark: SparkSession, d: str) -> DataFrame:
    rows = _classified(spark, d)
    return rounded(results.warm_start(results.success(rows, 0.0), results.stable(rows)).select("cif_file", "k"))


@registered(f"""WITH {i.KAPPA}, {i.PHONON}, tasks AS (SELECT DISTINCT cif_file FROM kappa), log AS (SELECT cif_file, max(has_imaginary) AS has_imaginary FROM phonon GROUP BY cif_file)
SELECT t.cif_file, coalesce(l.has_imaginary, 'unknown') AS has_imaginary FROM tasks t LEFT JOIN log l USING (cif_file)""")
def q_complete_results(spark: SparkSession, d: str) -> DataFrame:
    done = i.phonon(spark, d).groupBy("cif_file").agg(F.max("has_imaginary").alias("has_imaginary"))
    return results.complete_results(i.kappa(spark, d).select("cif_file").distinct(), done, "cif_file", {"has_imaginary": "unknown"})


@registered(f"""WITH {i.KAPPA}, {i.PHONON} SELECT formula, cif_file FROM (SELECT DISTINCT formula, cif_file FROM kappa) k WHERE NOT EXISTS (SELECT 1 FROM phonon p WHERE p.cif_file = k.cif_file)""")
def q_unfinished(spark: SparkSession, d: str) -> DataFrame:
    kappa = i.kappa(spark, d)
    named = i.phonon(spark, d).join(kappa.select("formula", "cif_file"), "cif_file")
    return results.unfinished(kappa, named.where("ts = 1"), named.where("ts = 2"), ["formula", "cif_file"])


@registered("""WITH b AS (SELECT user_id AS structure_id, event_id % 4 AS q, event_id % 6 + 1 AS branch, round(value - 5, 3) AS f FROM events)
SELECT CAST(structure_id AS VARCHAR) AS structure_id, min(f) AS min_frequency, max(f) AS max_frequency, min(f) FILTER (q = 0 AND branch > 3) AS gamma_min_optical,
  max(f) FILTER (q = 0 AND branch <= 3) AS gamma_max_acoustic, min(f) < -0.1 AS has_imaginary FROM b GROUP BY structure_id HAVING max(branch) > 3
UNION ALL SELECT CAST(structure_id AS VARCHAR), min(f), max(f), min(f), max(f), min(f) < -0.1 FROM b GROUP BY structure_id HAVING max(branch) <= 3""")
def q_phonon_summary(spark: SparkSession, d: str) -> DataFrame:
    bands = i.table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("structure_id"), F.expr("event_id % 4").alias("q_index"), F.expr("event_id % 4 = 0").alias("is_gamma"),
        F.expr("event_id % 6 + 1").alias("branch"), F.round(F.col("value") - 5, 3).alias("frequency"),
    )
    return results.phonon_summary(bands)


@registered("""SELECT event_type AS error, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, 1 LIMIT 3""")
def q_top_messages(spark: SparkSession, d: str) -> DataFrame:
    return results.top_messages(i.table(spark, d, "events").select(F.col("event_type").alias("error")))


@registered(f"""WITH {i.KAPPA}, best AS (SELECT formula, cif_file AS path, k FROM kappa ORDER BY k, formula, cif_file LIMIT 20)
SELECT CAST(row_number() OVER (ORDER BY k, formula, path) AS INT) AS rank, formula, path, round(k, 6) AS k FROM best""")
def q_compact_results(spark: SparkSession, d: str) -> DataFrame:
    return rounded(results.compact_results(i.kappa(spark, d).withColumn("path", F.col("cif_file"))))


# selection


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    """(iteration, formula, rank, k, id): parts dealt to rounds of up to about 30 candidates, ranked by price."""
    from pyspark.sql import Window

    rows = i.compositions(spark, d).select("id", fx.canonical_formula(F.col("formula")).alias("formula"), F.expr("id div 30").alias("iteration"), (F.col("p_retailprice") / 1000).alias("k"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("iteration").orderBy("k", "id")))


RANKED = f"""{i.COMP}, ranked AS (SELECT id, {CANON} AS formula, id // 30 AS iteration, p_retailprice / 1000 AS k,
  row_number() OVER (PARTITION BY id // 30 ORDER BY p_retailprice / 1000, id) AS rank FROM comp)"""


@registered(f"""WITH {RANKED},
pool AS (SELECT *, CASE WHEN id % 3 = 0 THEN id * 7919 % 101 END AS said FROM ranked WHERE rank <= 20),
picks AS (SELECT iteration, formula, min(said) AS position FROM pool WHERE said IS NOT NULL GROUP BY ALL),
named AS (SELECT r.iteration, r.formula, r.rank, p.position, CASE WHEN r.rank <= 5 THEN 0 WHEN p.position IS NOT NULL THEN 1 ELSE 2 END AS kind FROM pool r LEFT JOIN picks p USING (iteration, formula)),
once AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY iteration, formula ORDER BY kind, rank) = 1),
placed AS (SELECT *, row_number() OVER (PARTITION BY iteration, kind = 0 ORDER BY kind, coalesce(position, rank), rank) AS place FROM once)
SELECT iteration, CAST(row_number() OVER (PARTITION BY iteration ORDER BY kind > 0, CASE WHEN kind = 0 THEN rank ELSE place END) AS INT) AS final_rank, formula, CAST(rank AS INT) AS bo_rank,
  ['bo_locked', 'ai_supplement', 'bo_backfill'][kind + 1] AS selection_source FROM placed WHERE place <= 5""")
def q_guarded(spark: SparkSession, d: str) -> DataFrame:
    ranked = _ranked(spark, d)
    picks = ranked.where("rank <= 20 AND id % 3 = 0").select("iteration", "formula", F.expr("id * 7919 % 101").alias("position"))
    return selection.guarded_selection(ranked, picks, by=["iteration"])


def _responses(ranked: DataFrame) -> DataFrame:
    """Responses as text, one a round: every second candidate, in an order of their own, in a fenced block."""
    item = F.struct(
        F.expr("cast(1 + id * 31 % 17 AS string)").alias("final_rank"), "formula", F.lit("low k").alias("ranking_reason"),
        F.lit("none").alias("main_risk"), F.col("rank").cast("string").alias("original_rank"),
    )
    packed = ranked.where("id % 2 = 0").groupBy("iteration").agg(F.array_sort(F.collect_list(F.struct("id", item.alias("item")))).alias("items"))
    body = F.to_json(F.struct(F.transform("items", lambda x: x["item"]).alias("ranked_materials")))
    return packed.select("iteration", F.concat(F.lit("Ranking:\n```json\n"), body, F.lit("\n```\nDone.")).alias("raw_text"))


RERANKED = f"""{RANKED}, said AS (SELECT iteration, formula, 1 + id * 31 % 17 AS said_rank FROM ranked WHERE id % 2 = 0
  QUALIFY row_number() OVER (PARTITION BY iteration, formula ORDER BY id) = 1),
chosen AS (SELECT r.iteration, r.formula, r.rank, row_number() OVER (PARTITION BY r.iteration ORDER BY said_rank, r.formula, r.rank) AS final_rank FROM ranked r JOIN said USING (iteration, formula))"""


@registered(f"""WITH {RERANKED}
SELECT r.iteration, r.formula, CAST(r.rank AS INT) AS rank, CAST(c.final_rank AS INT) AS final_rank, c.final_rank IS NOT NULL AS selected,
  CASE WHEN c.final_rank IS NULL THEN 'not selected' ELSE 'low k' END AS ranking_reason
FROM ranked r LEFT JOIN (SELECT * FROM chosen WHERE final_rank <= 10) c USING (iteration, formula, rank)""")
def q_rerank_trace(spark: SparkSession, d: str) -> DataFrame:
    ranked = _ranked(spark, d)
    said = selection.parse_responses(_responses(ranked))
    chosen = selection.rerank(ranked, said, 10, ["iteration"])
    return selection.selection_trace(ranked, chosen, ["iteration"]).select("iteration", "formula", "rank", "final_rank", "selected", "ranking_reason")


@registered(f"""WITH {RANKED}, s AS (SELECT *, k < 1.0 AS is_success, k < 1.5 AS is_stable FROM ranked WHERE rank <= 25)
SELECT iteration, count(*) AS n_selected, count(*) FILTER (is_success) AS n_success, count(*) FILTER (is_stable) AS n_stable,
  round(count(*) FILTER (is_success) / count(*), 6) AS success_rate, round(count(*) FILTER (is_stable) / count(*), 6) AS stable_rate, round(min(k) FILTER (is_success), 6) AS best_k,
  count(*) FILTER (rank <= 3) AS n_protected, count(*) FILTER (rank BETWEEN 13 AND 20) AS n_tail, count(*) FILTER (rank BETWEEN 13 AND 20 AND is_success) AS n_tail_success FROM s GROUP BY iteration""")
def q_screening_summary(spark: SparkSession, d: str) -> DataFrame:
    picked = _ranked(spark, d).where("rank <= 25").withColumns({"is_success": F.col("k") < 1.0, "is_stable": F.col("k") < 1.5, "original_rank": F.col("rank")})
    return rounded(selection.screening_summary(picked))


@registered(f"""WITH {RANKED}, s AS (SELECT *, row_number() OVER (PARTITION BY iteration ORDER BY rank, formula) AS place FROM ranked)
SELECT iteration, formula, CAST(rank AS INT) AS rank, CAST(place AS INT) AS final_rank, place <= 10 AS selected FROM s""")
def q_rank_cutoff(spark: SparkSession, d: str) -> DataFrame:
    return selection.rank_cutoff(_ranked(spark, d), 10, ["iteration"]).select("iteration", "formula", "rank", "final_rank", "selected")


@registered()
def q_dedup_scores(spark: SparkSession, d: str) -> DataFrame:
    """Sequential rule, not SQL-expressible: tests hold it against a plain loop."""
    rows = _ranked(spark, d).select(F.col("iteration").alias("response_id"), "formula", F.expr("cast(rank % 20 AS int)").alias("original_rank"), "id")
    return selection.dedup_scores(rows, "response_id")


@registered(f"""WITH {RANKED}, ok AS (SELECT DISTINCT formula FROM ranked WHERE k < 1.0), wide AS (SELECT DISTINCT formula FROM ranked WHERE k < 1.5)
SELECT id, formula IN (SELECT formula FROM ok) AS is_success, formula IN (SELECT formula FROM wide) AS is_stable FROM ranked WHERE rank <= 10""")
def q_membership(spark: SparkSession, d: str) -> DataFrame:
    ranked = _ranked(spark, d)
    marked = selection.membership(ranked.where("rank <= 10"), ranked.where("k < 1.0"), ranked.where("k < 1.5"))
    return marked.select("id", "is_success", "is_stable")


@registered(f"""WITH {i.COMP} SELECT DISTINCT f AS formula FROM (SELECT formula AS f FROM comp UNION ALL SELECT a || na FROM comp)""")
def q_formula_set(spark: SparkSession, d: str) -> DataFrame:
    rows = i.compositions(spark, d).select("formula", F.concat(F.lit(" "), F.concat("a", "na")).alias("other"))
    return selection.formula_set(rows, ["formula", "other"])


# novelty


@registered(f"""WITH {i.STATE}, s AS (SELECT formula, cif_file, CASE WHEN iteration % 2 = 0 THEN structure_id END AS path, k FROM stated WHERE dynamic_stable AND k < 5.0),
b AS (SELECT *, 'stable' AS t FROM s UNION ALL SELECT *, 'success' FROM s WHERE k < 1.0)
SELECT coalesce(path, formula || '|' || cif_file) AS key, min(formula) AS formula, string_agg(DISTINCT t, ',' ORDER BY t) AS source_types FROM b GROUP BY 1""")
def q_merge_inputs(spark: SparkSession, d: str) -> DataFrame:
    rows = _classified(spark, d).withColumn("path", F.expr("CASE WHEN iteration % 2 = 0 THEN structure_id END"))
    made = novelty.merge_inputs(*(t.select("formula", "cif_file", "path") for t in (results.success(rows), results.stable(rows))))
    return made.select("key", "formula", F.array_join("source_types", ",").alias("source_types"))


@registered(f"""WITH {i.RECORDS}, known AS (SELECT DISTINCT {i.REDUCED} AS reduced FROM records WHERE query_ok)
SELECT id FROM comp WHERE {i.REDUCED} NOT IN (SELECT reduced FROM known)""")
def q_known_filter_novel(spark: SparkSession, d: str) -> DataFrame:
    return novelty.novel(i.compositions(spark, d), i.records(spark, d)).select("id")


@registered(f"""WITH {i.RECORDS}, known AS (SELECT {i.REDUCED} AS reduced, source, count(*) AS n FROM records WHERE query_ok GROUP BY ALL),
grouped AS (SELECT reduced, array_to_string(list_sort(list(source)), ',') AS matched_sources, CAST(sum(n) AS BIGINT) AS n_records FROM known GROUP BY reduced)
SELECT id, reduced IS NOT NULL AS is_known, coalesce(matched_sources, '') AS matched_sources, coalesce(n_records, 0) AS n_records, false AS all_unavailable
FROM (SELECT id, {i.REDUCED} AS own FROM comp) LEFT JOIN grouped ON own = reduced""")
def q_known_filter(spark: SparkSession, d: str) -> DataFrame:
    found = novelty.known_filter(i.compositions(spark, d), i.records(spark, d))
    return found.select("id", "is_known", F.array_join("matched_sources", ",").alias("matched_sources"), "n_records", "all_unavailable")


@registered(f"""WITH {i.RECORDS}, wanted AS (SELECT DISTINCT {i.REDUCED} AS reduced FROM comp WHERE id % 3 = 0)
SELECT material_id, source FROM records WHERE {i.REDUCED} IN (SELECT reduced FROM wanted)""")
def q_exact_records(spark: SparkSession, d: str) -> DataFrame:
    wanted = i.compositions(spark, d).where("id % 3 = 0").select("formula")
    return novelty.exact_records(i.records(spark, d), wanted).select("material_id", "source")


@registered(f"""WITH {i.RECORDS}, keyed AS (SELECT *, {i.REDUCED} AS reduced, list_position(['MP', 'OQMD', 'AFLOW'], source) AS priority FROM records)
SELECT material_id, source FROM keyed k WHERE priority = (SELECT min(priority) FROM keyed o WHERE o.reduced = k.reduced)""")
def q_tiered(spark: SparkSession, d: str) -> DataFrame:
    return novelty.by_strategy(i.records(spark, d), "tiered").select("material_id", "source")


CHECKS = """checks AS (SELECT o_custkey AS material_id, ['MP', 'OQMD', 'AFLOW'][o_orderkey % 3 + 1] AS source, o_orderstatus <> 'P' OR o_orderkey % 5 <> 0 AS query_ok,
  o_orderkey % 4 AS n_candidates, (o_orderkey % 4) * (o_orderkey % 3 > 0)::INT AS n_structures, (o_orderkey % 29 = 0)::INT AS n_matched FROM orders),
sources AS (SELECT material_id, source, bool_and(query_ok) AS ok, sum(n_candidates) AS c, sum(n_structures) AS s, sum(n_matched) AS m FROM checks GROUP BY ALL),
reasons AS (SELECT *, CASE WHEN m > 0 THEN 'matched' WHEN NOT ok THEN 'query_failed' WHEN c = 0 THEN 'no_candidates' WHEN s = 0 THEN 'structure_unavailable_or_parse_failed'
  ELSE 'candidates_not_isomorphic' END AS reason FROM sources),
statuses AS (SELECT material_id, CASE WHEN bool_or(reason = 'matched') THEN 'known' WHEN bool_or(reason IN ('query_failed', 'structure_unavailable_or_parse_failed')) THEN 'undetermined'
  ELSE 'novel' END AS status, array_to_string(list_sort(list(source || ':' || reason)), ',') AS reasons FROM reasons GROUP BY material_id)"""


def _statuses(spark: SparkSession, d: str) -> DataFrame:
    orders = i.table(spark, d, "orders")
    checks = orders.select(
        F.col("o_custkey").alias("material_id"), i._pick(novelty.SOURCES, "o_orderkey % 3").alias("source"),
        F.expr("o_orderstatus <> 'P' OR o_orderkey % 5 <> 0").alias("query_ok"), F.expr("o_orderkey % 4").alias("n_candidates"),
        F.expr("(o_orderkey % 4) * cast(o_orderkey % 3 > 0 AS int)").alias("n_structures"), F.expr("cast(o_orderkey % 29 = 0 AS int)").alias("n_matched"),
    )
    return novelty.novelty_status(i.table(spark, d, "customer").select(F.col("c_custkey").alias("material_id")), checks)


@registered(f"""WITH {CHECKS} SELECT c_custkey AS material_id, coalesce(status, 'undetermined') AS novelty_status, coalesce(reasons, '') AS reasons
FROM customer LEFT JOIN statuses ON c_custkey = material_id""")
def q_novelty_status(spark: SparkSession, d: str) -> DataFrame:
    found = _statuses(spark, d)
    return found.select("material_id", "novelty_status", F.coalesce(F.array_join("reasons", ","), F.lit("")).alias("reasons"))


@registered(f"""WITH {CHECKS}, each AS (SELECT coalesce(status, 'undetermined') AS s FROM customer LEFT JOIN statuses ON c_custkey = material_id)
SELECT s AS novelty_status, (SELECT count(*) FROM each WHERE each.s = v.s) AS n FROM (VALUES ('known'), ('novel'), ('undetermined')) v(s)""")
def q_novelty_counts(spark: SparkSession, d: str) -> DataFrame:
    return novelty.status_counts(_statuses(spark, d))


@registered(f"""WITH {i.COMP}, e AS (SELECT unnest([a, b, c]) AS e FROM comp), n AS (SELECT e, count(*) AS n FROM e GROUP BY e ORDER BY n DESC, e LIMIT 10)
SELECT count(*) AS n_cases, round(min(p_retailprice / 1000), 6) AS min_k, round(max(p_retailprice / 1000), 6) AS max_k, 1.0::DOUBLE AS chalcogen_share, count(*) FILTER (id % 2 = 0) AS n_structures,
  (SELECT string_agg(e, ',' ORDER BY n DESC, e) FROM n) AS top_elements, (SELECT string_agg(f, ',' ORDER BY f) FROM (SELECT DISTINCT formula AS f FROM comp ORDER BY f LIMIT 10)) AS formulas FROM comp""")
def q_digest(spark: SparkSession, d: str) -> DataFrame:
    rows = i.compositions(spark, d).select("formula", (F.col("p_retailprice") / 1000).alias("k"), F.expr("CASE WHEN id % 2 = 0 THEN raw END").alias("structure"))
    return rounded(novelty.success_digest(rows))


@registered("""SELECT 'priority' AS field, count(*) FILTER (o_orderkey % 2 = 0) AS n_present, count(*) AS n_rows FROM orders
UNION ALL SELECT 'date', count(o_orderdate), count(*) FROM orders""")
def q_field_completeness(spark: SparkSession, d: str) -> DataFrame:
    rows = i.table(spark, d, "orders").select(F.expr("CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '  ' END").alias("Priority"), "o_orderdate")
    return novelty.field_completeness(rows, {"priority": ["priority_zh", "Priority"], "date": ["o_orderdate"]})


# features and models

PROPS = "props(element, mass, radius, eneg, grp, period, valence) AS (VALUES " + ", ".join(
    "('%s', %s)" % (e[0], ", ".join(f"{v}::DOUBLE" for v in e[1:])) for e in features.ELEMENTS
) + ")"
FEATURE_SQL = f"""{i.COMP}, {PROPS},
long AS (SELECT id, a AS element, na::DOUBLE AS n FROM comp UNION ALL SELECT id, b, nb::DOUBLE FROM comp UNION ALL SELECT id, c, nc::DOUBLE FROM comp),
frac AS (SELECT l.*, n / sum(n) OVER (PARTITION BY id) AS x, p.* EXCLUDE (element) FROM long l JOIN props p USING (element)),
means AS (SELECT id, {", ".join(f"sum(x * {c}) AS m_{c}" for c in ("mass", "radius", "eneg", "grp", "period", "valence"))} FROM frac GROUP BY id)"""


@registered(f"""WITH {FEATURE_SQL}
SELECT id, count(*) AS n_elements, sum(n) AS total_atoms, round(1e-9 + max(x), 6) AS max_atom_fraction, round(1e-9 + min(x), 6) AS min_atom_fraction, round(1e-9 + stddev_pop(x), 6) AS atom_fraction_std,
  round(1e-9 + -sum(x * ln(x)), 6) AS config_entropy, round(1e-9 + -sum(x * ln(x)) * 8.314, 6) AS "Mixing_entropy",
  {", ".join(f'round(1e-9 + any_value(m_{c}), 6) AS "{n}_mean", round(1e-9 + sum(x * power({c} - m_{c}, 2)), 6) AS "{n}_variance", round(1e-9 + sqrt(sum(x * power({c} - m_{c}, 2))), 6) AS "{n}_std", min({c}) AS "{n}_min", max({c}) AS "{n}_max", round(1e-9 + max({c}) - min({c}), 6) AS "{n}_range"'
             for c, n in (("mass", "Mass"), ("radius", "Radius"), ("eneg", "Eneg"), ("grp", "Group"), ("period", "Period"), ("valence", "Valence")))},
  {", ".join(f'round(1e-9 + sqrt(sum(x * power(1 - {c} / m_{c}, 2))), 6) AS "{n}_delta"' for c, n in (("radius", "Radius"), ("mass", "Mass"), ("eneg", "Eneg"), ("valence", "Valence")))},
  round(1e-9 + 2 * (sum(x * eneg * eneg) - power(any_value(m_eneg), 2)) * 2, 6) AS "Mixing_enthalpy"
FROM frac JOIN means USING (id) GROUP BY id""")
def q_comp_features(spark: SparkSession, d: str) -> DataFrame:
    made = features.composition_features(i.compositions(spark, d).select("id", "formula"), features.element_table(spark))
    # sixteenths of two-digit values end in exact halves of the last digit: a small shift puts both engines on one side
    return rounded(made.select(*((F.col(c) + 1e-9).alias(c) if t == "double" else F.col(c) for c, t in made.dtypes)))


@registered(f"""WITH {FEATURE_SQL}
SELECT p.id, round(4 * sum(p.x * q.x * power(p.eneg - q.eneg, 2)), 6) AS mixing_enthalpy FROM frac p JOIN frac q ON p.id = q.id AND p.element < q.element GROUP BY p.id""")
def q_mixing_enthalpy(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.mixing_enthalpy(i.compositions(spark, d), features.element_table(spark)))


ITEM = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@registered(" UNION ALL ".join(
    f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", round({'1.0::DOUBLE' if a == b else f'coalesce(corr({a}, {b}), 0)'}, 6) AS correlation FROM lineitem"
    for a in ITEM for b in ITEM if a != b) + "".join(f" UNION ALL SELECT '{a}', '{a}', 1.0::DOUBLE" for a in ITEM))
def q_corr_matrix(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.correlation_matrix(i.table(spark, d, "lineitem"), [*ITEM]))


@registered()
def q_prune_features(spark: SparkSession, d: str) -> DataFrame:
    table = features.composition_features(i.compositions(spark, d).select("id", "formula"), features.element_table(spark))
    table = table.join(i.compositions(spark, d).select("id", F.col("p_retailprice").alias("k")), "id")
    names = [c for c in table.columns if c not in ("id", "k")]
    kept, _ = features.sanitise(table, names, "id")
    return features.prune_correlated(table, kept, "k")


@registered("""WITH t AS (SELECT l_linestatus AS s, l_extendedprice / 10000 AS y, l_quantity / 10 AS g FROM lineitem)
SELECT s, count(*) AS n, round(1 - sum((y - g) * (y - g)) / (var_pop(y) * count(*)), 6) AS r2, round(avg(abs(y - g)), 6) AS mae, round(sqrt(avg((y - g) * (y - g))), 6) AS rmse FROM t GROUP BY s""")
def q_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = i.table(spark, d, "lineitem").select(F.col("l_linestatus").alias("s"), (F.col("l_extendedprice") / 10000).alias("y"), (F.col("l_quantity") / 10).alias("g"))
    return rounded(features.regression_metrics(rows, "y", "g", ["s"]))


@registered("""WITH t AS (SELECT quality AS y, (d.n_chars % 97) / 97.0::DOUBLE AS p FROM labels l JOIN documents d USING (doc_id)),
c AS (SELECT count(*) FILTER (y = 1 AND p >= 0.5) AS tp, count(*) FILTER (y <> 1 AND p >= 0.5) AS fp, count(*) FILTER (y = 1 AND p < 0.5) AS fn, count(*) AS n, sum(y) AS pos FROM t),
r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM t)
SELECT round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((n - fp - fn) / n, 6) AS accuracy,
  round(((SELECT sum(r) FROM r WHERE y = 1) - pos * (pos + 1) / 2.0) / (pos * (n - pos)), 6) AS auc FROM c""")
def q_classification(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = i.table(spark, d, "documents"), i.table(spark, d, "labels")
    rows = labels.join(docs, "doc_id").select("quality", (F.expr("n_chars % 97") / F.lit(97.0)).alias("p"))
    return rounded(features.classification_metrics(rows, "quality", "p"))


HEX12 = "('0x' || substr(md5('42|' || doc_id), 1, 12))::BIGINT / 281474976710656.0::DOUBLE"


@registered(f"SELECT doc_id, CASE WHEN {HEX12} < 0.8 THEN 'train' WHEN {HEX12} < 0.9::DOUBLE THEN 'val' ELSE 'test' END AS split FROM documents")
def q_split(spark: SparkSession, d: str) -> DataFrame:
    return features.split_labels(i.table(spark, d, "documents").select("doc_id"), "doc_id", {"train": 0.8, "val": 0.1, "test": 0.1})


@registered("SELECT doc_id, CAST((row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) - 1) % 5 AS INT) AS fold FROM documents")
def q_kfold(spark: SparkSession, d: str) -> DataFrame:
    return features.exact_folds(i.table(spark, d, "documents").select("doc_id"), "doc_id", 5)


def _table14(spark: SparkSession, d: str) -> DataFrame:
    made = i.compositions(spark, d)
    price = made.select("id", (F.col("p_retailprice") / 1000).alias("k"))
    return features.element_block(made).join(price, "id")


@registered()
def q_gp_tune(spark: SparkSession, d: str) -> DataFrame:
    return surrogate.tune(_table14(spark, d), [*fx.FEATURE_ELEMENTS], "k", "id")


@registered()
def q_gp_predict(spark: SparkSession, d: str) -> DataFrame:
    """Predictions by the setting that cross-validation chooses."""
    table = _table14(spark, d)
    trained = surrogate.train(table, [*fx.FEATURE_ELEMENTS], "k", "id")
    return surrogate.predict(table, trained.model, [*fx.FEATURE_ELEMENTS], "id").select("id", "mu_log", "sigma_log", "k_pred", "k_lower", "k_upper")


@registered()
def q_gp_report(spark: SparkSession, d: str) -> DataFrame:
    """The report of the chosen setting on the tenth of the rows that it has not seen."""
    return surrogate.train(_table14(spark, d), [*fx.FEATURE_ELEMENTS], "k", "id").report


@registered()
def q_importance(spark: SparkSession, d: str) -> DataFrame:
    return surrogate.rank_features(_table14(spark, d), [*fx.FEATURE_ELEMENTS], "k", "id", method="random_forest")


@registered(f"""WITH {i.COMP} SELECT id, true AS adds_up, 14 AS n_features FROM comp WHERE p_retailprice > 0""")
def q_attribution(spark: SparkSession, d: str) -> DataFrame:
    """Of every part: whether base and attributions add up to the values of the leaves that it reaches."""
    explained = surrogate.explain_rows(_table14(spark, d), [*fx.FEATURE_ELEMENTS], "k", "id")
    sums = explained.groupBy("id").agg(F.first("base").alias("base"), F.first("prediction").alias("p"), F.sum("attribution").alias("s"), F.count("*").cast("int").alias("n_features"))
    return sums.select("id", (F.abs(F.col("base") + F.col("s") - F.col("p")) < 1e-9).alias("adds_up"), "n_features")


@registered()
def q_feature_curve(spark: SparkSession, d: str) -> DataFrame:
    return surrogate.feature_curve(_table14(spark, d), [*fx.FEATURE_ELEMENTS], "k", "id", folds=2)


@registered()
def q_feature_sets(spark: SparkSession, d: str) -> DataFrame:
    sets = {"cations": ["Ag", "Cu", "In", "Sn", "Pb"], "framework": ["As", "Sb", "Ge", "Bi", "Ti", "V"], "anions": ["S", "Se", "Te"]}
    return surrogate.compare_sets(_table14(spark, d), {**sets, "all": [*fx.FEATURE_ELEMENTS]}, "k", "id")


# transport models

ELASTIC = """elastic AS (SELECT p_partkey AS id, 20.0::DOUBLE + p_size AS bulk, 5.0::DOUBLE + p_partkey % 40 AS shear, 4.0::DOUBLE + p_partkey % 5 AS density,
  100.0::DOUBLE + p_partkey % 300 AS volume, 200.0::DOUBLE + p_size * 10 AS mass, 4 + p_partkey % 16 AS n FROM part),
v AS (SELECT *, sqrt((bulk + 4 * shear / 3) / density) AS vl, sqrt(shear / density) AS vt FROM elastic),
w AS (SELECT *, pow((1 / pow(vl, 3) + 2 / pow(vt, 3)) / 3, -1.0 / 3) * 1000 AS vs, (pow(vl / vt, 2) - 2) / (2 * pow(vl / vt, 2) - 2) AS nu FROM v),
g AS (SELECT *, 3 * (1 + nu) / (2 * (2 - 3 * nu)) AS gamma, 6.62607015e-34 / 1.380649e-23 * 1e10 * pow(3 / (4 * pi() * volume), 1.0 / 3) * vs AS debye FROM w)"""


def _elastic(spark: SparkSession, d: str) -> DataFrame:
    rows = i.table(spark, d, "part").selectExpr(
        "p_partkey AS id", "cast(20 + p_size AS double) AS bulk", "cast(5 + p_partkey % 40 AS double) AS shear", "cast(4 + p_partkey % 5 AS double) AS density",
        "cast(100 + p_partkey % 300 AS double) AS volume", "cast(200 + p_size * 10 AS double) AS mass", "4 + p_partkey % 16 AS n",
    )
    long, trans, mean = nx.sound_velocities(F.col("bulk"), F.col("shear"), F.col("density"))
    rows = rows.withColumns({"vl": long, "vt": trans, "vs": mean}).withColumn("nu", nx.poisson_ratio(F.col("vl"), F.col("vt")))
    return rows.withColumns({"gamma": nx.gruneisen(F.col("nu")), "debye": nx.debye_temperature(F.col("volume"), F.col("vs"))})


@registered(f"""WITH {ELASTIC} SELECT id, round(debye, 4) AS debye, round(gamma, 6) AS gamma,
  round(2.43e-8 / (1 - 0.514 / gamma + 0.228 / pow(gamma, 2)) * mass * pow(volume, 1.0 / 3) * pow(debye, 3) / (pow(gamma, 2) * 300 * n) * 100, 6) AS kappa FROM g""")
def q_slack(spark: SparkSession, d: str) -> DataFrame:
    rows = _elastic(spark, d)
    kappa = nx.slack_kappa(nx.slack_constant(F.col("gamma")), F.col("mass"), F.col("volume"), F.col("debye"), F.col("gamma"), F.col("n"))
    return rows.select("id", F.round("debye", 4).alias("debye"), F.round("gamma", 6).alias("gamma"), F.round(kappa, 6).alias("kappa"))


@registered(f"""WITH {ELASTIC} SELECT id, round(shear * 1e9 * vs * pow(volume * 1e-30, 1.0 / 3) / (n * 300.0::DOUBLE) * exp(-gamma), 6) AS kappa FROM g""")
def q_mtp(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_elastic(spark, d).select("id", nx.mtp_kappa(F.col("shear"), F.col("vs"), F.col("volume"), F.col("n"), F.col("gamma")).alias("kappa")))


@registered("""WITH c AS (SELECT p_partkey AS id, 3.0::DOUBLE + p_partkey % 7 AS a, 4.0::DOUBLE + p_size % 5 AS b, 5.0::DOUBLE + p_partkey % 3 AS c, radians(60.0 + p_partkey % 60) AS al,
  radians(70.0 + p_size) AS be, radians(80.0 + p_partkey % 30) AS ga FROM part),
s AS (SELECT id, a * a * b * b * c * c * (1 - cos(al) * cos(al) - cos(be) * cos(be) - cos(ga) * cos(ga) + 2 * cos(al) * cos(be) * cos(ga)) AS sq FROM c)
SELECT id, round(CASE WHEN sq < 0 THEN 0 ELSE sqrt(greatest(sq, 0)) END, 4) AS volume FROM s""")
def q_cell_volume(spark: SparkSession, d: str) -> DataFrame:
    rows = i.table(spark, d, "part").selectExpr(
        "p_partkey AS id", "cast(3 + p_partkey % 7 AS double) AS a", "cast(4 + p_size % 5 AS double) AS b", "cast(5 + p_partkey % 3 AS double) AS c",
        "cast(60 + p_partkey % 60 AS double) AS al", "cast(70 + p_size AS double) AS be", "cast(80 + p_partkey % 30 AS double) AS ga",
    )
    return rows.select("id", F.round(nx.cell_volume(*map(F.col, ("a", "b", "c", "al", "be", "ga"))), 4).alias("volume"))


# evaluation

EMB = """e AS (SELECT vec_id, embedding::DOUBLE[] AS v, vec_id % 100 = 0 AS gen FROM embeddings WHERE embedding IS NOT NULL),
near AS (SELECT g.vec_id, min(list_distance(g.v, t.v)) AS fp FROM e g JOIN e t ON g.gen AND NOT t.gen GROUP BY g.vec_id)"""


def _nearest(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = i.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("fp"))
    asked = rows.where("vec_id % 100 = 0")
    return evaluation.nearest_distance(asked, rows.where("vec_id % 100 <> 0"), ["fp"], "vec_id"), asked


@registered(f"WITH {EMB} SELECT vec_id, round(fp, 6) AS fp FROM near")
def q_nearest_distance(spark: SparkSession, d: str) -> DataFrame:
    """Vectors whose id is divisible by 100 are the generated set, searched against all others."""
    return rounded(_nearest(spark, d)[0])


@registered(f"WITH {EMB} SELECT (SELECT count(*) FROM e WHERE gen) AS n, round(count(*) FILTER (fp <= 1.1) / (SELECT count(*) FROM e WHERE gen), 6) AS share, round(avg(fp), 6) AS mean_fp FROM near")
def q_coverage(spark: SparkSession, d: str) -> DataFrame:
    found, asked = _nearest(spark, d)
    return rounded(evaluation.coverage(found, asked, {"fp": 1.1}))


@registered("""WITH s AS (SELECT o_totalprice / 1000 AS v, o_orderstatus = 'F' AS a FROM orders WHERE o_orderstatus IN ('F', 'O')),
p AS (SELECT v, sum(a::INT) AS a, sum((NOT a)::INT) AS b FROM s GROUP BY v),
c AS (SELECT v, sum(a) OVER w / (SELECT sum(a) FROM p) AS fa, sum(b) OVER w / (SELECT sum(b) FROM p) AS fb, lead(v) OVER w AS nv FROM p WINDOW w AS (ORDER BY v))
SELECT round(sum(abs(fa - fb) * (nv - v)), 6) AS distance FROM c""")
def q_wasserstein(spark: SparkSession, d: str) -> DataFrame:
    rows = i.table(spark, d, "orders").withColumn("v", F.col("o_totalprice") / 1000)
    return rounded(evaluation.wasserstein(rows.where("o_orderstatus = 'F'"), rows.where("o_orderstatus = 'O'"), "v"))


@registered("""WITH p AS (SELECT o_custkey AS id, CASE WHEN o_orderstatus = 'F' THEN o_totalprice / 500000 END AS rms FROM orders), m AS (SELECT id, min(rms) AS r FROM p GROUP BY id)
SELECT (SELECT count(*) FROM customer) AS n, round(count(r) / (SELECT count(*) FROM customer), 6) AS match_rate, round(avg(r), 6) AS mean_rms FROM m""")
def q_match_rate(spark: SparkSession, d: str) -> DataFrame:
    pairs = i.table(spark, d, "orders").selectExpr("o_custkey AS id", "CASE WHEN o_orderstatus = 'F' THEN o_totalprice / 500000 END AS rms")
    return rounded(evaluation.match_rate(pairs, i.table(spark, d, "customer").selectExpr("c_custkey AS id")))


@registered("""WITH c AS (SELECT o_custkey AS id, bool_and(o_totalprice > 10000) AS a, bool_or(o_orderstatus = 'F') AS b FROM orders GROUP BY 1)
SELECT count(*) AS n, round(avg(coalesce(a, false)::INT), 6) AS a_rate, round(avg(coalesce(b, false)::INT), 6) AS b_rate, round(avg((coalesce(a, false) AND coalesce(b, false))::INT), 6) AS all_rate
FROM customer LEFT JOIN c ON id = c_custkey""")
def q_validity_rates(spark: SparkSession, d: str) -> DataFrame:
    checks = i.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(
        F.bool_and(F.expr("o_totalprice > 10000")).alias("a"), F.bool_or(F.expr("o_orderstatus = 'F'")).alias("b")
    )
    return rounded(evaluation.validity_rates(i.table(spark, d, "customer").selectExpr("c_custkey AS id"), checks, ["a", "b"]))


@registered("""SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 3""")
def q_first_generations(spark: SparkSession, d: str) -> DataFrame:
    """The first three of each id: the operator's own cut."""
    return evaluation.first_generations(i.table(spark, d, "orders").select("o_custkey", "o_orderkey"), 3, "o_custkey", "o_orderkey")


# structures


def _cifs(spark: SparkSession, d: str) -> DataFrame:
    """(id, cif): a structure text for each part, with quoted values, uncertainties and an atom-site loop."""
    made = i.dealt(i.compositions(spark, d))
    text = F.concat(
        F.lit("data_"), "formula", F.lit("\n_symmetry_space_group_name_H-M   'P "), F.expr("1 + id % 4"), F.lit("'\n_cell_length_a   "), F.expr("4 + id % 7"),
        F.lit(".25(2)\n_cell_length_b   "), F.expr("5 + id % 3"), F.lit(".123456\n_cell_length_c   6.5\n_cell_angle_alpha   "), F.expr("85 + id % 90"),
        F.lit("\n_cell_angle_beta   90\n_cell_angle_gamma   90\n_cell_volume   "), F.expr("100 + id % 50"), F.lit(".5\n_cell_formula_units_Z   "), F.expr("id % 3"),
        F.lit("\n_chemical_formula_structural   "), "formula", F.lit("\n_chemical_formula_sum   '"), F.concat_ws(" ", F.concat("a", "na"), F.concat("b", "nb"), F.concat("c", "nc")),
        F.lit("'\nloop_\n _symmetry_equiv_pos_site_id\n _symmetry_equiv_pos_as_xyz\n  1  'x, y, z'\n  2  '-x, -y, -z'\nloop_\n _atom_site_type_symbol\n _atom_site_label\n"
              " _atom_site_symmetry_multiplicity\n _atom_site_fract_x\n _atom_site_fract_y\n _atom_site_fract_z\n  "),
        "a", F.lit("  "), "a", F.lit("1  "), "na", F.lit("  0.0  0.0  0.0\n  "), "b", F.lit("  "), "b", F.lit("2  "), "nb", F.lit("  0.5  0.5  0.5\n  "),
        "c", F.lit("  "), "c", F.lit("3  "), F.expr("nc + cast(id % 5 = 0 AS int)"), F.lit("  0.25  0.123456  0.75\n"),
    )
    return made.select("id", text.alias("cif"))


@registered(f"""WITH {i.COMP} SELECT id, 'P ' || (1 + id % 4) AS space_group, CAST(id % 3 AS INT) AS z, 100.5::DOUBLE + id % 50 AS volume, 4.25::DOUBLE + id % 7 AS a,
  (85 + id % 90) BETWEEN 10 AND 170 AS sensible, id % 5 <> 0 AS multiplicity_consistent FROM comp""")
def q_structure_table(spark: SparkSession, d: str) -> DataFrame:
    texts = _cifs(spark, d)
    table = structures.structure_table(texts)
    checked = structures.multiplicity_check(table, structures.atom_sites(texts))
    return table.withColumn("sensible", structures.is_sensible(F.col("cif"))).join(checked, "id").select(
        "id", "space_group", "z", "volume", F.col("lattice.a").alias("a"), "sensible", "multiplicity_consistent"
    )


@registered(f"""WITH {i.COMP} SELECT id, 0 AS position, a AS element, na AS multiplicity, 0.0::DOUBLE AS x FROM comp UNION ALL SELECT id, 1, b, nb, 0.5 FROM comp
UNION ALL SELECT id, 2, c, nc + (id % 5 = 0)::INT, 0.25 FROM comp""")
def q_atom_sites(spark: SparkSession, d: str) -> DataFrame:
    return structures.atom_sites(_cifs(spark, d)).select("id", "position", "element", "multiplicity", "x")


@registered(f"""WITH {i.COMP} SELECT id, true AS consistent FROM comp""")
def q_formula_consistent(spark: SparkSession, d: str) -> DataFrame:
    table = structures.structure_table(_cifs(spark, d))
    return table.select("id", structures.is_formula_consistent(table).alias("consistent"))


@registered(f"""WITH {i.COMP}, t AS (SELECT id, formula, 'P ' || (1 + id % 4) AS g, (100.5::DOUBLE + id % 50) / CASE WHEN id % 3 = 0 THEN 1 ELSE id % 3 END AS v FROM comp)
SELECT id, round(v, 6) AS volume_per_unit FROM t QUALIFY row_number() OVER (PARTITION BY formula, g ORDER BY v, id) = 1""")
def q_lowest_volume(spark: SparkSession, d: str) -> DataFrame:
    table = structures.structure_table(_cifs(spark, d))
    return rounded(structures.lowest_volume(table, position="id").select("id", "volume_per_unit"))


@registered(f"""WITH {i.COMP} SELECT id, CASE WHEN id % 3 = 0 THEN 'z is 0' END AS rejected FROM comp""")
def q_prepare_corpus(spark: SparkSession, d: str) -> DataFrame:
    return structures.prepare_corpus(_cifs(spark, d), features.element_table(spark)).select("id", "rejected")


@registered()
def q_corpus_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Prepared texts as token ids; tests hold encoding and decoding against a plain loop."""
    prepared = structures.prepare_corpus(_cifs(spark, d), features.element_table(spark)).where("rejected IS NULL")
    words = [*fx.FEATURE_ELEMENTS, *"0123456789", ".", "\n", " ", "data_", "loop_", "_cell_length_a", "_cell_length_b", "_cell_length_c", "_cell_volume", "'", "x", "y", "z", ",", "-"]
    return structures.tokenise(prepared, words).select("id", F.size("ids").alias("n_tokens"), "n_unknown")


@registered()
def q_neardup(spark: SparkSession, d: str) -> DataFrame:
    """Keep-first duplicates in blocks of equal reduced formula; sequential, so tests hold it against a plain loop."""
    texts = _cifs(spark, d)
    table = structures.structure_table(texts)
    blocks = structures.fingerprint_blocks(table, structures.atom_sites(texts))
    return structures.drop_similar(blocks)


#: Unit-volume lengths and angles of the parts' lattices, and when two are similar.
LATTICE = f"""lattice AS (SELECT id, a, {i.REDUCED} AS r, list_sort([(4.25 + id % 7) / s, (5.123456 + id % 3) / s, 6.5 / s]) AS l, list_sort([85.0 + id % 90, 90.0, 90.0]) AS g
  FROM (SELECT *, pow((4.25::DOUBLE + id % 7) * (5.123456 + id % 3) * 6.5 * sin(radians(85.0::DOUBLE + id % 90)), 1.0::DOUBLE / 3) AS s FROM comp))"""
SIMILAR = "list_bool_and(list_transform([1, 2, 3], lambda i: abs({0}.l[i] - {1}.l[i]) <= 0.2 * greatest({0}.l[i], {1}.l[i]) AND abs({0}.g[i] - {1}.g[i]) <= 5))"


@registered(f"""WITH RECURSIVE {i.COMP}, {LATTICE}, t AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY id) AS n FROM lattice),
walk AS (
  SELECT a, n, [{{'id': id, 'l': l, 'g': g}}] AS kept, id, CAST(NULL AS BIGINT) AS of FROM t WHERE n = 1
  UNION ALL
  SELECT a, n, CASE WHEN m IS NULL THEN list_append(kept, {{'id': id, 'l': l, 'g': g}}) ELSE kept END, id, m
  FROM (SELECT t.*, w.kept, list_filter(w.kept, lambda k: {SIMILAR.format("k", "t")})[1].id AS m FROM walk w JOIN t ON t.a = w.a AND t.n = w.n + 1))
SELECT id, of IS NULL AS kept, of AS duplicate_of FROM walk""")
def q_neardup_lattice(spark: SparkSession, d: str) -> DataFrame:
    """Keep-first duplicates by lattice among the parts of one first element: five large blocks, which SQL walks row by row."""
    texts = _cifs(spark, d)
    blocks = structures.fingerprint_blocks(structures.structure_table(texts), structures.atom_sites(texts), profiled=False).drop("block")
    return structures.drop_similar(blocks.join(i.compositions(spark, d).select("id", F.col("a").alias("block")), "id"), by=("block",))


@registered(f"""WITH {i.COMP}, {LATTICE}, base AS (SELECT * FROM lattice WHERE id % 2 = 0),
hits AS (SELECT DISTINCT t.id FROM lattice t JOIN base b ON t.r = b.r AND {SIMILAR.format("t", "b")} WHERE t.id % 2 = 1)
SELECT id, CASE WHEN r NOT IN (SELECT r FROM base) THEN 'composition' WHEN id IN (SELECT id FROM hits) THEN 'matched' ELSE 'structure' END AS reason
FROM lattice WHERE id % 2 = 1""")
def q_novelty_vs_base(spark: SparkSession, d: str) -> DataFrame:
    """Odd parts against even ones, by composition and lattice."""
    texts = _cifs(spark, d)
    blocks = shared.written(structures.fingerprint_blocks(structures.structure_table(texts), structures.atom_sites(texts), profiled=False))
    return structures.novelty_vs_base(blocks.where("id % 2 = 1"), blocks.where("id % 2 = 0")).select("id", "reason")


@registered(f"""WITH {i.COMP}, t AS (SELECT id, {i.REDUCED} AS r, id % 3 AS z, id % 2 AS half FROM comp),
base AS (SELECT * FROM t WHERE half = 0 QUALIFY row_number() OVER (PARTITION BY r, z ORDER BY id DESC) = 1),
inc AS (SELECT * FROM t WHERE half = 1 AND (r, z) NOT IN (SELECT (r, z) FROM base) QUALIFY row_number() OVER (PARTITION BY r, z ORDER BY id DESC) = 1),
ex AS (SELECT DISTINCT r, z FROM t WHERE id % 10 = 0)
SELECT id FROM (SELECT * FROM base UNION ALL SELECT * FROM inc) WHERE (r, z) NOT IN (SELECT (r, z) FROM ex)""")
def q_merge_datasets(spark: SparkSession, d: str) -> DataFrame:
    rows = i.compositions(spark, d).select("id", fx.reduced_formula(F.col("formula")).alias("reduced"), F.expr("id % 3").alias("z"), F.lit("P 1").alias("space_group"))
    merged = structures.merge_datasets(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), rows.where("id % 10 = 0"), position="id")
    return merged.select("id")


@registered("""WITH e AS (SELECT doc_id, coalesce(n_chars, 0) AS n FROM documents) SELECT doc_id, CAST(sum(n) OVER (ORDER BY doc_id) - n AS BIGINT) AS start FROM e""")
def q_token_offsets(spark: SparkSession, d: str) -> DataFrame:
    rows = i.table(spark, d, "documents").select("doc_id", F.coalesce("n_chars", F.lit(0)).alias("n"))
    return structures.record_starts(rows, "n", "doc_id", 1000).select("doc_id", "start")


@registered()
def q_site_distances(spark: SparkSession, d: str) -> DataFrame:
    texts = _cifs(spark, d)
    table, sites = structures.structure_table(texts), structures.atom_sites(texts)
    found = structures.site_distances(table, sites, radius=1.5)
    return structures.quality_gate(table, found, least=1.5).select("id", "passes_gate")


# documents


@registered("""SELECT doc_id, CAST(i - 1 AS INT) AS section_no, parts[i] AS body FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents), unnest(range(1, len(parts) + 1)) u(i)""")
def q_lines(spark: SparkSession, d: str) -> DataFrame:
    docs = i.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return textops.text_lines(docs).select("doc_id", (F.col("line_no") - 1).alias("section_no"), F.col("line").alias("body"))


@registered(r"""WITH t AS (SELECT doc_id, chr(10) || replace(text, chr(10), chr(10) || '## ') AS text FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, string_split(text, chr(10) || '## ') AS parts FROM t), e AS (SELECT doc_id, i, parts[i] AS part FROM p, unnest(range(1, len(parts) + 1)) u(i))
SELECT doc_id, CAST(i - 1 AS INT) AS section_no, CASE WHEN i > 1 THEN trim(string_split(part, chr(10))[1]) ELSE '' END AS title FROM e""")
def q_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections of the documents with each line turned into a heading."""
    docs = i.table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n## ")).alias("text"))
    return textops.sections(docs).select("doc_id", "section_no", "title")


@registered("""WITH l AS (SELECT doc_id, i, parts[i] AS line, parts FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL), unnest(range(1, len(parts) + 1)) u(i))
SELECT doc_id, CAST(i AS INT) AS line_no, array_to_string(parts[greatest(i - 3, 1):i + 3], chr(10)) AS context FROM l WHERE contains(lower(line), 'license')""")
def q_kwic(spark: SparkSession, d: str) -> DataFrame:
    return textops.keyword_context(i.table(spark, d, "documents"), "license")


@registered("""WITH s AS (SELECT doc_id, 'en' = lang AND contains(lower(text), 'the') AND NOT contains(lower(text), 'idiot') AS on_topic FROM documents) SELECT doc_id, coalesce(on_topic, false) AS on_topic FROM s""")
def q_on_topic(spark: SparkSession, d: str) -> DataFrame:
    docs = i.table(spark, d, "documents")
    return docs.select("doc_id", F.coalesce((F.col("lang") == "en") & textops.is_on_topic(F.col("text"), ("the",), ("idiot",)), F.lit(False)).alias("on_topic"))


WEIGHTS = {"license": 3.0, "token": 2.0, "and": 1.0, "der": 1.0, "que": 1.0}


@registered(r"""WITH b AS (SELECT conv_id AS doc_id, turn AS position, text AS snippet FROM conversations WHERE length(text) >= 30),
s AS (SELECT *, """ + " + ".join(f"CASE WHEN contains(lower(snippet), '{w}') THEN {v} ELSE 0 END" for w, v in WEIGHTS.items()) + r""" + CASE WHEN regexp_matches(snippet, '\b(?:19|20)\d\d\b') THEN 1 ELSE 0 END AS score FROM b),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, position) AS place FROM s QUALIFY place <= 16),
c AS (SELECT *, CASE WHEN length(snippet) > 280 THEN rtrim(substr(snippet, 1, 279)) || '…' ELSE snippet END AS cut FROM p),
o AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY doc_id, lower(trim(cut)) ORDER BY place) = 1)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY place) AS INT) AS rank, cut AS snippet, score::DOUBLE AS score FROM o QUALIFY rank <= 8""")
def q_snippets(spark: SparkSession, d: str) -> DataFrame:
    turns = i.table(spark, d, "conversations").selectExpr("conv_id AS doc_id", "turn AS position", "text AS snippet")
    return textops.best_snippets(turns, WEIGHTS)


@registered("""WITH t AS (SELECT conv_id, turn, lower(trim(role)) AS v, role, row_number() OVER (PARTITION BY conv_id, lower(trim(role)) ORDER BY turn, role) AS n FROM conversations WHERE trim(role) <> '')
SELECT conv_id, string_agg(role, ',' ORDER BY turn, role) AS roles FROM t WHERE n = 1 GROUP BY conv_id""")
def q_collected_values(spark: SparkSession, d: str) -> DataFrame:
    rows = i.table(spark, d, "conversations")
    return textops.collected_values(rows, F.array("role"), "turn", ["conv_id"]).select("conv_id", F.array_join("values", ",").alias("roles"))


# ledger

STEPS = ("signup", "view", "click", "purchase", "error")


def _ledger(spark: SparkSession, d: str) -> DataFrame:
    return i.table(spark, d, "events").selectExpr("user_id % 50 AS iteration", "event_type AS step", "cast(NULL AS string) AS substep", "value > 9.5 AS completed", "ts")


@registered(f"""WITH done AS (SELECT user_id % 50 AS iteration, event_type AS step, bool_or(value > 9.5) AS done FROM events GROUP BY ALL),
steps AS (SELECT unnest({i._listed(STEPS)}) AS step, unnest(range(1, 6)) AS no),
grid AS (SELECT r.iteration, s.step, s.no, coalesce(d.done, false) AS done FROM (SELECT DISTINCT iteration FROM done) r CROSS JOIN steps s LEFT JOIN done d ON d.iteration = r.iteration AND d.step = s.step),
agg AS (SELECT iteration, min(no) FILTER (NOT done) AS gap, max(no) FILTER (done) AS last FROM grid GROUP BY iteration)
SELECT iteration, gap IS NULL AS complete, {i._listed(STEPS)}[gap] AS next_step, CASE WHEN last > gap THEN {i._listed(STEPS)}[gap] END AS reset_from FROM agg""")
def q_ledger_next(spark: SparkSession, d: str) -> DataFrame:
    none = spark.createDataFrame([], "step string, substep string")
    steps = spark.createDataFrame([(s, n) for n, s in enumerate(STEPS, 1)], "step string, step_no int")
    return ledger.iteration_state(ledger.substeps_done(_ledger(spark, d), none), steps)


@registered("""WITH r AS (SELECT user_id % 50 AS iteration, count(*) AS n, count(*) FILTER (value > 45) AS s FROM events GROUP BY 1),
t AS (SELECT *, sum(s) OVER (ORDER BY iteration) AS total, count(*) OVER w AS c, max(s / n) OVER w AS high, sum((s > 0)::INT) OVER (ORDER BY iteration) AS island FROM r WINDOW w AS (ORDER BY iteration ROWS 9 PRECEDING)),
u AS (SELECT *, count(*) FILTER (s = 0) OVER (PARTITION BY island ORDER BY iteration) AS streak FROM t)
SELECT iteration, CASE WHEN total >= 200 THEN 'target reached' WHEN streak >= 10 THEN 'no success in a row' WHEN c = 10 AND high < 0.02 THEN 'low success rate'
  WHEN iteration >= 45 THEN 'last iteration' END AS stop_reason, streak AS empty_streak FROM u""")
def q_termination(spark: SparkSession, d: str) -> DataFrame:
    rounds = i.table(spark, d, "events").groupBy(F.expr("user_id % 50").alias("iteration")).agg(F.count("*").alias("n_selected"), F.count_if(F.expr("value > 45")).alias("n_success"))
    rounds = rounds.withColumn("success_rate", F.col("n_success") / F.col("n_selected"))
    return ledger.termination(rounds, max_iterations=45, target=200, rate=0.02).select("iteration", "stop_reason", "empty_streak")


@registered("""WITH l AS (SELECT CAST(user_id AS VARCHAR) AS formula, event_type AS cif_file, ts, event_id, value FROM events)
SELECT formula, cif_file, event_id, round(value, 6) AS value FROM l QUALIFY row_number() OVER (PARTITION BY formula, cif_file ORDER BY ts DESC, event_id DESC) = 1""")
def q_status_latest(spark: SparkSession, d: str) -> DataFrame:
    log = i.table(spark, d, "events").selectExpr("cast(user_id AS string) AS formula", "event_type AS cif_file", "ts", "event_id", "value")
    return rounded(results.latest_rows(log, ["formula", "cif_file"], ["ts", "event_id"]).drop("ts"))


@registered("""SELECT user_id AS formula, count(*) AS processed, count(*) FILTER (event_type = 'view') AS relax_success, count(*) FILTER (event_type = 'click') AS phonon_success FROM events GROUP BY 1""")
def q_task_progress(spark: SparkSession, d: str) -> DataFrame:
    log = i.table(spark, d, "events").selectExpr("user_id AS formula", "event_type = 'view' AS relax_success", "event_type = 'click' AS phonon_success")
    return results.task_progress(log)


# streams over what has arrived, held against one batch

def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    # a pattern takes a single file as well as a directory of files
    return streams.file_stream(spark, f"{d}/events.parque[t]", spark.read.parquet(f"{d}/events.parquet").schema)


@registered("SELECT CAST(user_id AS VARCHAR) AS formula, round(min(value), 6) AS k FROM events GROUP BY 1")
def q_stream_lowest_k(spark: SparkSession, d: str) -> DataFrame:
    place = shared.new_place(spark)
    rows = _event_stream(spark, d).selectExpr("cast(user_id AS string) AS formula", "value AS k")
    streams.upkeep(rows, f"{place}/table", f"{place}/state", parts=8).awaitTermination()
    return rounded(streams.current(spark, f"{place}/table"))


@registered("""SELECT user_id AS formula, count(*) AS processed, count(*) FILTER (event_type = 'view') AS relax_success, count(*) FILTER (event_type = 'click') AS phonon_success
FROM events GROUP BY 1""")
def q_stream_status(spark: SparkSession, d: str) -> DataFrame:
    place = shared.new_place(spark)
    log = _event_stream(spark, d).selectExpr(
        "user_id AS formula", "cast(ts AS timestamp) AS ts", "event_id AS attempt_id", "event_type = 'view' AS relax_success", "event_type = 'click' AS phonon_success"
    )
    streams.status_log(log, f"{place}/table", f"{place}/state", "400 days").awaitTermination()
    return results.task_progress(spark.read.parquet(f"{place}/table"))


@registered("""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, round(ln(min(value)), 6) AS f_min, count(*) AS n FROM events WHERE value > 0 GROUP BY 1""")
def q_stream_best(spark: SparkSession, d: str) -> DataFrame:
    place = shared.new_place(spark)
    rows = _event_stream(spark, d).selectExpr("cast(ts AS timestamp) AS ts", "value AS k")
    found = streams.to_memory(streams.best_stream(rows), "best_" + place[-12:].replace("-", "_"), checkpoint=f"{place}/state")
    return rounded(found.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("hour"), "f_min", "n"))
