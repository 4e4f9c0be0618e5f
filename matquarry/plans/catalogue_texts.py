"""Registered queries of the structure texts, documents and the remaining joins, filters and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formulas as fx
from ..functions import numeric as nx
from ..functions import values as vx
from ..operators import candidates, evaluation, features, results, selection, structures, textops
from ..sources import shared
from . import inputs as i
from . import loop
from .catalogue import EI, _cifs, _classified, _ranked, RANKED, registered, rounded
from .catalogue_files import CIFS

# structure texts

_LINE = "chr(10)"
_ELEMENTS = ", ".join(f"('{e[0]}', {e[1]}::DOUBLE, {e[2]}::DOUBLE, {e[3]}::DOUBLE)" for e in features.ELEMENTS)
#: Prepared training text of each part.
PREPARED = f"""{i.COMP}, {CIFS}, el AS (SELECT * FROM (VALUES {_ELEMENTS}) e(element, mass, radius, eneg)),
props AS (SELECT id, string_agg(printf('  %s  %.4f  %.4f', element, eneg, radius), chr(10) ORDER BY eneg, element) AS block FROM comp JOIN el ON element IN (a, b, c) GROUP BY id),
prepared AS (SELECT id, formula, CASE WHEN id % 3 > 0 THEN replace(replace(replace(replace(cif, '_symmetry_space', 'loop_' || chr(10) || ' _atom_type_symbol' || chr(10) || ' _atom_type_electronegativity'
  || chr(10) || ' _atom_type_radius' || chr(10) || block || chr(10) || chr(10) || '_symmetry_space'), '.123456', '.1235'), '0.123456', '0.1235'), '  2  ''-x, -y, -z''' || chr(10), '') END AS cif FROM cifs JOIN props USING (id))"""


def _renamed(spark: SparkSession, d: str) -> DataFrame:
    """The structure texts under a data line that says nothing."""
    return _cifs(spark, d).withColumn("cif", F.regexp_replace("cif", r"^data_\S+", "data_entry"))


@registered(f"WITH {PREPARED} SELECT id, cif FROM prepared")
def q_prepared_text(spark: SparkSession, d: str) -> DataFrame:
    """Whole prepared texts: data line by formula, property block, identity symmetry, four decimals."""
    return structures.prepare_corpus(_renamed(spark, d), features.element_table(spark)).select("id", "cif")


@registered(f"WITH {PREPARED} SELECT id, CASE WHEN id % 3 > 0 THEN cif END AS cif FROM (SELECT id, replace(replace(cif, '.123456', '.1235'), '  2  ''-x, -y, -z''' || chr(10), '') AS cif FROM cifs)")
def q_without_properties(spark: SparkSession, d: str) -> DataFrame:
    prepared = structures.prepare_corpus(_cifs(spark, d), features.element_table(spark))
    return prepared.select("id", structures.without_properties(F.col("cif")).alias("cif"))


VOCABULARY = (*fx.FEATURE_ELEMENTS, *"0123456789", ".", "\n", " ", "data_", "loop_", "_cell_length_a", "_cell_length_b", "_cell_length_c", "_cell_volume", "'", "x", "y", "z", ",", "-")
_PATTERN = "(?s)" + "|".join([*(r"\Q" + v + r"\E" for v in sorted(VOCABULARY, key=lambda v: (-len(v), v))), "."]).replace("'", "''")
TOKENS = f"""{PREPARED}, marked AS (SELECT id, regexp_replace(regexp_replace(cif, '(_symmetry_space_group_name_H-M\\s+)(\\S+)', '\\1\\2_sg', 'g'), '[ ' || chr(9) || ']+', ' ', 'g') AS t FROM prepared WHERE cif IS NOT NULL),
tokens AS (SELECT id, regexp_extract_all(t, '{_PATTERN}') AS tokens FROM marked), vocabulary AS (SELECT [{", ".join("'" + v.replace("'", "''") + "'" for v in VOCABULARY)}] AS words),
coded AS (SELECT id, list_transform(tokens, lambda t: CASE WHEN list_contains(words, t) THEN list_position(words, t) - 1 ELSE {len(VOCABULARY)} END) AS ids FROM tokens, vocabulary)"""


@registered(f"WITH {TOKENS} SELECT id, CAST(len(ids) AS INT) AS n_tokens, array_to_string(ids, ',') AS ids, CAST(len(list_filter(ids, lambda x: x = {len(VOCABULARY)})) AS INT) AS n_unknown FROM coded")
def q_corpus_ids(spark: SparkSession, d: str) -> DataFrame:
    prepared = structures.prepare_corpus(_cifs(spark, d), features.element_table(spark)).where("rejected IS NULL")
    coded = structures.tokenise(prepared, [*VOCABULARY])
    return coded.select("id", F.size("ids").alias("n_tokens"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), "n_unknown")


@registered(f"""WITH {TOKENS}, n AS (SELECT len(ids) AS n, len(list_filter(ids, lambda x: x = {len(VOCABULARY)})) AS u FROM coded)
SELECT count(*) AS n, CAST(min(n) AS INT) AS min, CAST(max(n) AS INT) AS max, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS std, CAST(sum(u) AS BIGINT) AS n_unknown FROM n""")
def q_token_lengths(spark: SparkSession, d: str) -> DataFrame:
    prepared = structures.prepare_corpus(_cifs(spark, d), features.element_table(spark)).where("rejected IS NULL")
    return rounded(structures.length_statistics(structures.tokenise(prepared, [*VOCABULARY])))


@registered(f"""WITH {i.COMP}, {CIFS} SELECT id, 'data_' || formula || chr(10) AS by_data, 'data_' || formula || chr(10) || '_symmetry_space_group_name_H-M   ''P ' || (1 + id % 4) || '''' || chr(10) AS by_group FROM cifs""")
def q_prompts(spark: SparkSession, d: str) -> DataFrame:
    texts = _cifs(spark, d)
    return texts.select("id", structures.prompt(F.col("cif")).alias("by_data"), structures.prompt(F.col("cif"), True).alias("by_group"))


@registered("""SELECT doc_id, md5(array_to_string(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' AND NOT starts_with(trim(x), '#') AND NOT contains(x, 'pymatgen')), chr(10)) || chr(10) || chr(10)) AS digest FROM documents""")
def q_filtered_lines(spark: SparkSession, d: str) -> DataFrame:
    return i.table(spark, d, "documents").select("doc_id", F.md5(structures.filter_lines(F.col("text"))).alias("digest"))


def _odd(spark: SparkSession, d: str) -> DataFrame:
    """Texts some of which have a cell out of bounds, another structural formula or a doubled formula sum."""
    t = F.col("cif")
    t = F.when(F.expr("id % 6 = 1"), F.replace(t, F.lit("_cell_length_c   6.5"), F.lit("_cell_length_c   0.25"))).when(
        F.expr("id % 6 = 2"), F.replace(t, F.lit("_cell_length_c   6.5"), F.lit("_cell_length_c   1200.5"))).otherwise(t)
    t = F.when(F.expr("id % 4 = 1"), F.regexp_replace(t, r"(formula_structural\s+)\S+", "$1Xe2")).when(
        F.expr("id % 4 = 2"), F.regexp_replace(t, r"_chemical_formula_structural[^\n]*\n", "")).otherwise(t)
    return _cifs(spark, d).withColumn("cif", t)


@registered(f"""WITH {i.COMP} SELECT id, id % 4 IN (0, 3) AS consistent, id % 6 NOT IN (1, 2) AND (85 + id % 90) <= 170 AS sensible FROM comp""")
def q_odd_structures(spark: SparkSession, d: str) -> DataFrame:
    table = structures.structure_table(_odd(spark, d))
    return table.select("id", structures.is_formula_consistent(table).alias("consistent"), structures.is_sensible(F.col("cif")).alias("sensible"))


@registered(f"""WITH {i.COMP}, el AS (SELECT * FROM (VALUES {_ELEMENTS}) e(element, mass, radius, eneg)),
m AS (SELECT id, na * x.mass + nb * y.mass + (nc + (id % 5 = 0)::INT) * z.mass AS mass, na + nb + nc + (id % 5 = 0)::INT AS n_atoms, 100.5::DOUBLE + id % 50 AS volume, 'P ' || (1 + id % 4) AS space_group
  FROM comp JOIN el x ON x.element = a JOIN el y ON y.element = b JOIN el z ON z.element = c)
SELECT m.id, {i.REDUCED} AS reduced_formula, n_atoms, round(mass, 4) AS mass, volume, round(mass * 1.66053906660 / volume, 4) AS density, space_group FROM m JOIN comp ON m.id = comp.id""")
def q_crystal_table(spark: SparkSession, d: str) -> DataFrame:
    texts = _cifs(spark, d)
    found = structures.crystal_table(structures.structure_table(texts), structures.atom_sites(texts), features.element_table(spark))
    return rounded(found.select("id", "reduced_formula", "n_atoms", "mass", "volume", "density", "space_group"), 4)


@registered(f"""WITH {i.COMP}, t AS (SELECT id, formula, 'P ' || (1 + id % 4) AS g FROM comp), s AS (SELECT DISTINCT formula, g FROM t WHERE id % 7 = 0)
SELECT id, (formula, g) IN (SELECT (formula, g) FROM s) AS under_represented FROM t""")
def q_under_represented(spark: SparkSession, d: str) -> DataFrame:
    table = structures.structure_table(_cifs(spark, d)).select("id", "data_formula", "space_group")
    return structures.in_set(table, table.where("id % 7 = 0")).select("id", "under_represented")


def _cells(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Lattices and three sites for each part."""
    part = i.table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    lattice = F.struct(*(F.expr(f"cast({e} AS double)").alias(n) for n, e in (
        ("a", "3 + id % 4"), ("b", "4 + id % 3"), ("c", "5"), ("alpha", "75 + id % 30"), ("beta", "90"), ("gamma", "90 + id % 20"))))
    table = part.select("id", lattice.alias("lattice")).withColumn("cell_volume", nx.cell_volume(*(F.col(f"lattice.{x}") for x in ("a", "b", "c", "alpha", "beta", "gamma"))))
    spots = F.array(*(F.struct(F.lit(p).alias("position"), *(F.expr(f"cast({v} AS double)").alias(n) for n, v in zip("xyz", xyz))) for p, xyz in enumerate(
        (("0", "0", "0"), ("0.5", "0.5", "0.5"), ("(id % 8) / 8.0D", "0.25", "0.75")))))
    return table.withColumn("volume", F.col("cell_volume")), part.select("id", F.inline(spots))


#: Distances up to 4 over nine images along each axis, more than any of these cells needs.
DISTANCES = """cell AS (SELECT p_partkey AS id, 3.0::DOUBLE + p_partkey % 4 AS a, 4.0::DOUBLE + p_partkey % 3 AS b, 5.0::DOUBLE AS c, radians(75.0 + p_partkey % 30) AS al, pi() / 2 AS be, radians(90.0 + p_partkey % 20) AS ga FROM part),
axes AS (SELECT id, a AS ax, b * cos(ga) AS bx, b * sin(ga) AS bw, c * cos(be) AS cx, c * (cos(al) - cos(be) * cos(ga)) / sin(ga) AS cy, c FROM cell),
base AS (SELECT *, sqrt(c * c - cx * cx - cy * cy) AS cz FROM axes),
site AS (SELECT p_partkey AS id, unnest([0, 1, 2]) AS s, unnest([0.0::DOUBLE, 0.5, (p_partkey % 8) / 8.0::DOUBLE]) AS x, unnest([0.0::DOUBLE, 0.5, 0.25]) AS y, unnest([0.0::DOUBLE, 0.5, 0.75]) AS z FROM part),
shift AS (SELECT u.n AS u, v.n AS v, w.n AS w FROM (SELECT unnest(range(-4, 5)) AS n) u, (SELECT unnest(range(-4, 5)) AS n) v, (SELECT unnest(range(-4, 5)) AS n) w),
pair AS (SELECT l.id, l.s AS i, sqrt(pow(ax * (r.x - l.x + u) + bx * (r.y - l.y + v) + cx * (r.z - l.z + w), 2) + pow(bw * (r.y - l.y + v) + cy * (r.z - l.z + w), 2) + pow(cz * (r.z - l.z + w), 2)) AS d
  FROM site l JOIN site r USING (id) JOIN base USING (id), shift WHERE l.s <> r.s OR u <> 0 OR v <> 0 OR w <> 0),
near AS (SELECT * FROM pair WHERE d <= 4)"""


@registered(f"""WITH {DISTANCES}, r AS (SELECT *, row_number() OVER (PARTITION BY id, i ORDER BY d) AS n FROM near)
SELECT id, CAST(i AS INT) AS i, round(sum(d) + greatest(0, 12 - count(*)) * 5, 4) AS total, round(min(d), 4) AS nearest FROM r WHERE n <= 12 GROUP BY ALL""")
def q_neighbour_lists(spark: SparkSession, d: str) -> DataFrame:
    """The twelve nearest of each site, padded; equal distances make any order of ties give the same sums."""
    near = structures.neighbour_lists(structures.site_distances(*_cells(spark, d), radius=4.0), 12, 4.0)
    total = F.aggregate("neighbours", F.lit(0.0), lambda acc, x: acc + x["distance"])
    return rounded(near.select("id", F.col("i").cast("int").alias("i"), total.alias("total"), F.array_min(F.transform("neighbours", lambda x: x["distance"])).alias("nearest")), 4)


@registered(f"""WITH {DISTANCES}, m AS (SELECT id, min(d) AS m FROM near GROUP BY id) SELECT p_partkey AS id, coalesce(m >= 2.0, true) AND 3 + p_partkey % 4 BETWEEN 3.5 AND 50 AS passes_gate,
  coalesce(m >= 1.0, true) AS structure_valid FROM part LEFT JOIN m ON id = p_partkey""")
def q_structure_validity(spark: SparkSession, d: str) -> DataFrame:
    table, sites = _cells(spark, d)
    found = structures.site_distances(table, sites, radius=4.0)
    gated = structures.quality_gate(table, found, lengths=(3.5, 50.0), least=2.0).select("id", "passes_gate")
    return gated.join(structures.structural_validity(table, found, least=1.0), "id")


#: Usual oxidation states and which elements are metals.
STATES = {
    "Ag": ([1], True), "Cu": ([1, 2], True), "In": ([1, 3], True), "Sn": ([2, 4], True), "Pb": ([2, 4], True), "As": ([-3, 3, 5], False), "Sb": ([-3, 3, 5], False),
    "Ge": ([2, 4], False), "Bi": ([3], True), "Ti": ([2, 3, 4], True), "V": ([2, 3, 4, 5], True), "S": ([-2, 4, 6], False), "Se": ([-2, 4, 6], False), "Te": ([-2, 4, 6], False),
}


@registered(f"""WITH {i.COMP}, st AS (SELECT element, unnest(states) AS s FROM (VALUES {", ".join(f"('{e}', {s})" for e, (s, _) in STATES.items())}) t(element, states)),
sums AS (SELECT id, bool_or(na * x.s + nb * y.s + nc * z.s = 0) AS ok FROM comp JOIN st x ON x.element = a JOIN st y ON y.element = b JOIN st z ON z.element = c GROUP BY id) SELECT id, ok AS charge_valid FROM sums""")
def q_charge_balance(spark: SparkSession, d: str) -> DataFrame:
    table = spark.createDataFrame([(e, s, m, float(n)) for n, (e, (s, m)) in enumerate(STATES.items())], "element string, states array<int>, is_metal boolean, eneg double")
    return structures.charge_balance(i.compositions(spark, d), table)


# documents


def _markdown(spark: SparkSession, d: str) -> DataFrame:
    """A document for each conversation: a heading of level 2 or 3 for each turn, and its text on one line."""
    turn = F.concat(F.when(F.expr("turn % 3 = 1"), "### ").otherwise("## "), F.coalesce("role", F.lit("")), F.lit("\n"), F.translate(F.coalesce("text", F.lit("")), "\n\r#", "   "))
    rows = i.table(spark, d, "conversations").select("conv_id", F.struct("turn", turn.alias("body")).alias("t"))
    texts = rows.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["body"]), "\n").alias("text"))
    return texts


MARKDOWN = """turns AS (SELECT conv_id AS doc_id, turn, coalesce(role, '') AS role, translate(coalesce(text, ''), chr(10) || chr(13) || '#', '   ') AS body, CASE WHEN turn % 3 = 1 THEN 3 ELSE 2 END AS level,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)"""


@registered(f"""WITH {MARKDOWN}, ends AS (SELECT t.doc_id, t.n, min(o.n) AS stop FROM turns t LEFT JOIN turns o ON o.doc_id = t.doc_id AND o.n > t.n AND o.level <= t.level WHERE starts_with(t.role, 'user') GROUP BY ALL)
SELECT e.doc_id, CAST(2 * e.n - 1 AS INT) AS line_no, md5(string_agg(CASE t.level WHEN 3 THEN '### ' ELSE '## ' END || t.role || chr(10) || t.body, chr(10) ORDER BY t.n)) AS digest
FROM ends e JOIN turns t ON t.doc_id = e.doc_id AND t.n >= e.n AND (e.stop IS NULL OR t.n < e.stop) GROUP BY e.doc_id, e.n""")
def q_heading_blocks(spark: SparkSession, d: str) -> DataFrame:
    return textops.heading_blocks(_markdown(spark, d), "user").select("doc_id", "line_no", F.md5("body").alias("digest"))


@registered(f"""WITH {MARKDOWN}, s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 0 AS section_no FROM turns WHERE level = 2), w AS (SELECT unnest(['user', 'assist']) AS wanted)
SELECT doc_id, wanted, role AS title, CAST(section_no AS INT) AS section_no FROM s JOIN w ON contains(lower(role), wanted) QUALIFY row_number() OVER (PARTITION BY doc_id, wanted ORDER BY (lower(role) = wanted) DESC, section_no) = 1""")
def q_find_section(spark: SparkSession, d: str) -> DataFrame:
    return textops.find_section(textops.sections(_markdown(spark, d)), ["User", "assist "]).select("doc_id", "wanted", "title", "section_no")


@registered(r"""WITH p AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '(?m)^[ \t\n\x0B\f\r]*(?:#+|[-*+]|\d+\.|>)[ \t\n\x0B\f\r]+', '', 'g'), '[*_`|]+', '', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) > 200 THEN rtrim(substr(t, 1, 199)) || '…' ELSE t END AS plain FROM p""")
def q_compact_markdown(spark: SparkSession, d: str) -> DataFrame:
    return i.table(spark, d, "documents").select("doc_id", textops.compact_markdown(F.col("text"), 200).alias("plain"))


@registered("""WITH f AS (SELECT lower('Part ' || p_partkey) AS name, CAST(p_size AS VARCHAR) AS value FROM part), e AS (SELECT lower('Part ' || p_partkey) AS name, CAST(p_size + (p_partkey % 5 = 0)::INT AS VARCHAR) AS expected FROM part WHERE p_partkey % 7 <> 0)
SELECT name, value, expected FROM f LEFT JOIN e USING (name) WHERE expected IS DISTINCT FROM value""")
def q_settings_mismatch(spark: SparkSession, d: str) -> DataFrame:
    """Settings in Markdown tables, one document a part, against a table of expected ones."""
    part = i.table(spark, d, "part")
    text = F.concat(F.lit("# Settings\n| name | value |\n|-|-|\n| **Part "), "p_partkey", F.lit("** | "), "p_size", F.lit(" |\n| plain | 1 |\nend"))
    found = textops.settings_rows(part.select(F.col("p_partkey").alias("doc_id"), text.alias("text")))
    expected = part.where("p_partkey % 7 <> 0").select(F.concat(F.lit("part "), "p_partkey").alias("name"), F.expr("cast(p_size + cast(p_partkey % 5 = 0 AS int) AS string)").alias("value"))
    return textops.settings_mismatch(found, expected)


@registered("""WITH r AS (SELECT conv_id AS doc_id, text AS snippet, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position FROM conversations WHERE text IS NOT NULL)
SELECT doc_id, CAST(position AS INT) AS position, md5(snippet) AS digest FROM r WHERE position < 12""")
def q_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Raw texts that hold each turn as a JSON object, the text escaped."""
    rows = i.table(spark, d, "conversations").where("text IS NOT NULL")
    raw = rows.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("turn", F.to_json(F.struct(F.col("text").alias("body"))).alias("j")))).alias("t"))
    docs = raw.select("doc_id", F.concat(F.lit("fetched: "), F.array_join(F.transform("t", lambda x: x["j"]), " and "), F.lit(".")).alias("text"))
    return textops.evidence(docs).select("doc_id", "position", F.md5("snippet").alias("digest"))


# joins, filters and reports


@registered("""SELECT s.p_partkey AS structure_id, p_size AS bulk, p_retailprice AS shear, p_brand AS structure FROM part s WHERE p_partkey % 3 <> 0 AND p_partkey % 4 <> 1""")
def q_join_properties(spark: SparkSession, d: str) -> DataFrame:
    part = i.table(spark, d, "part").withColumnRenamed("p_partkey", "structure_id")
    bulk, shear = part.where("structure_id % 3 <> 0").select("structure_id", F.col("p_size").alias("bulk")), part.where("structure_id % 4 <> 1").select("structure_id", F.col("p_retailprice").alias("shear"))
    return results.join_properties([bulk, shear, part.select("structure_id", F.col("p_brand").alias("structure"))])


@registered(f"WITH {i.KAPPA} SELECT structure_id, round(k, 6) AS k FROM kappa WHERE split_part(structure_id, '_', 2)::INT % 3 <> 1")
def q_drop_removed(spark: SparkSession, d: str) -> DataFrame:
    rows = i.kappa(spark, d)
    removed = rows.where(F.split("structure_id", "_")[1].cast("int") % 3 == 1).select(F.concat("structure_id", F.when(F.expr("iteration % 2 = 0"), ".CIF").otherwise("")).alias("cif_file"))
    return rounded(results.drop_removed(rows, removed).select("structure_id", "k"))


@registered("SELECT DISTINCT l_partkey, l_returnflag, l_linestatus FROM lineitem")
def q_exact_distinct(spark: SparkSession, d: str) -> DataFrame:
    return results.exact_distinct(i.table(spark, d, "lineitem").select("l_partkey", "l_returnflag", "l_linestatus"))


@registered("""SELECT l_orderkey, l_linenumber, l_extendedprice / 10000 AS k FROM lineitem WHERE l_linenumber % 4 <> 0 AND l_returnflag <> 'N'""")
def q_usable_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows under drifting names: no formula, no number, or a column that only its unit names."""
    rows = i.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.expr("l_linenumber % 4 = 0"), " ").otherwise(F.concat(F.lit("F"), "l_partkey")).alias("Formula"),
        F.when(F.expr("l_returnflag = 'N'"), "n/a").otherwise((F.col("l_extendedprice") / 10000).cast("string")).alias("kappa (W/m·K)"),
    )
    return results.usable_rows(rows, ["formula", "Formula"], ["k"]).select("l_orderkey", "l_linenumber", "k")


@registered(f"WITH {i.PHONON} SELECT cif_file, ts, min_frequency FROM phonon WHERE min_frequency >= -0.1")
def q_filter_stable(spark: SparkSession, d: str) -> DataFrame:
    return results.filter_stable(i.phonon(spark, d)).select("cif_file", "ts", "min_frequency")


@registered(f"""WITH {RANKED}, r AS (SELECT *, CASE WHEN id % 4 > 0 THEN CAST(rank % 7 AS INT) END AS final_rank FROM ranked)
SELECT iteration, id, CAST(row_number() OVER (PARTITION BY iteration ORDER BY final_rank NULLS LAST, formula, id) AS INT) AS final_rank FROM r QUALIFY row_number() OVER (PARTITION BY iteration ORDER BY final_rank NULLS LAST, formula, id) <= 10""")
def q_compact_ranks(spark: SparkSession, d: str) -> DataFrame:
    rows = _ranked(spark, d).withColumn("final_rank", F.when(F.expr("id % 4 > 0"), F.expr("cast(rank % 7 AS int)")))
    # equal formulas in one round are told apart by the id in this query
    named = rows.withColumn("formula", F.concat("formula", F.lit(" "), F.lpad(F.col("id").cast("string"), 12, "0")))
    return selection.compact_ranks(named, 10, ["iteration"]).select("iteration", "id", "final_rank")


@registered(f"""WITH RECURSIVE {RANKED}, o AS (SELECT DISTINCT iteration AS response_id, formula, CAST(rank % 20 AS INT) AS original_rank FROM ranked),
n AS (SELECT *, row_number() OVER (PARTITION BY response_id ORDER BY original_rank, formula) AS n FROM o),
w AS (SELECT response_id, 0::BIGINT AS n, []::INT[] AS ranks, []::VARCHAR[] AS names, NULL::VARCHAR AS formula, NULL::INT AS original_rank, false AS kept FROM (SELECT DISTINCT response_id FROM o)
 UNION ALL SELECT w.response_id, n.n, CASE WHEN list_contains(ranks, n.original_rank) OR list_contains(names, n.formula) THEN ranks ELSE list_append(ranks, n.original_rank) END,
  CASE WHEN list_contains(ranks, n.original_rank) OR list_contains(names, n.formula) THEN names ELSE list_append(names, n.formula) END, n.formula, n.original_rank,
  NOT (list_contains(ranks, n.original_rank) OR list_contains(names, n.formula)) FROM w JOIN n ON n.response_id = w.response_id AND n.n = w.n + 1)
SELECT response_id, formula, original_rank FROM w WHERE kept""")
def q_dedup_responses(spark: SparkSession, d: str) -> DataFrame:
    rows = _ranked(spark, d).select(F.col("iteration").alias("response_id"), "formula", F.expr("cast(rank % 20 AS int)").alias("original_rank"))
    return selection.dedup_scores(rows, "response_id")


@registered("""SELECT o_orderkey FROM orders QUALIFY row_number() OVER (ORDER BY o_orderkey) BETWEEN 11 AND 40""")
def q_positional_slice(spark: SparkSession, d: str) -> DataFrame:
    """The eleventh to the fortieth in order: the operator's own cut."""
    return evaluation.positional_slice(i.table(spark, d, "orders").select("o_orderkey"), 11, 40, "o_orderkey")


@registered("""SELECT o_orderpriority AS selection_source, count(*) AS n_all, count(*) FILTER (o_orderstatus = 'F') AS n_success, count(*) FILTER (o_totalprice > 100000) AS n_stable FROM orders GROUP BY 1""")
def q_source_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = i.table(spark, d, "orders").selectExpr("o_orderpriority AS selection_source", "o_orderstatus = 'F' AS is_success", "o_totalprice > 100000 AS is_stable")
    return selection.source_summary(rows)


@registered("""WITH r AS (SELECT o_orderstatus = 'F' AS f, o_orderkey % 3 = 0 AS g, least(1.0, o_totalprice / 200000) AS s, o_orderkey % 2 = 0 AS v, o_orderkey % 1000 AS n FROM orders)
SELECT count(*) AS n, count(*) FILTER (f) AS n_formula_ok, count(*) FILTER (g) AS n_space_group_ok, round(avg(s), 6) AS mean_score, round(stddev_pop(s), 6) AS std_score, count(*) FILTER (s >= 1.0) AS n_full_score,
  count(*) FILTER (v) AS n_valid, round(count(*) FILTER (v) / count(*), 6) AS valid_rate, max(n) FILTER (v) AS longest_valid, round(avg(n) FILTER (v), 6) AS mean_valid_length FROM r""")
def q_generation_report(spark: SparkSession, d: str) -> DataFrame:
    rows = i.table(spark, d, "orders").selectExpr(
        "o_orderstatus = 'F' AS formula_ok", "o_orderkey % 3 = 0 AS space_group_ok", "least(1.0D, o_totalprice / 200000) AS bond_score", "o_orderkey % 2 = 0 AS valid", "o_orderkey % 1000 AS n_tokens"
    )
    return rounded(evaluation.generation_report(rows))


@registered(r"""SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'a|b ' || p_size WHEN 1 THEN p_brand WHEN 2 THEN '' ELSE '[broken' END AS items, CASE WHEN p_partkey % 2 = 0 THEN 'Ag' || p_size END AS printed,
  CASE p_partkey % 3 WHEN 0 THEN 'primitive' WHEN 1 THEN 'conventional' ELSE 'original' END AS variant, CASE WHEN p_partkey % 2 = 0 THEN 'm__x' || p_partkey END AS gen_id, CASE WHEN p_partkey % 2 = 0 THEN p_size::VARCHAR END AS gen_n,
  CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'Ag 50 Te 5' || p_size END AS weight FROM part""")
def q_value_parsing(spark: SparkSession, d: str) -> DataFrame:
    """Lists, printed structures, variants, generations and weight-percent formulas out of drifting cells."""
    part = i.table(spark, d, "part").withColumnRenamed("p_partkey", "id")
    listed = F.expr("CASE id % 4 WHEN 0 THEN concat('[''a'', \"b ', p_size, '\"]') WHEN 1 THEN concat('  ', p_brand, ' ') WHEN 2 THEN ' ' ELSE '[broken' END")
    printed = F.when(F.expr("id % 2 = 0"), F.concat(F.lit("Full Formula (Ag"), "p_size", F.lit(")\nReduced Formula: Ag"))).otherwise("nothing")
    path = F.expr("concat('run/', CASE id % 3 WHEN 0 THEN 'Primitive_cell' WHEN 1 THEN 'conventional' ELSE 'x' END, '/f.cif')")
    file = F.when(F.expr("id % 2 = 0"), F.concat(F.lit("m__x"), "id", F.lit("__"), "p_size", F.lit(".cif"))).otherwise("plain.cif")
    weight = F.when(F.expr("id % 5 <> 0"), F.concat(F.lit("Ag: 50; Te,: 5"), "p_size"))
    generation = vx.generation_of(file)
    return part.select(
        "id", F.array_join(vx.coerce_list(listed), "|").alias("items"), fx.formula_of_printed_structure(printed).alias("printed"), vx.structure_variant(path).alias("variant"),
        generation["id"].alias("gen_id"), generation["n"].alias("gen_n"), fx.strip_weight_percent(weight).alias("weight"),
    )


@registered("""WITH p AS (SELECT p_partkey AS id, p_size::DOUBLE AS size, p_retailprice / 1000 AS price FROM part)
SELECT id, 'part_' || id AS structure_id, round(pow(10.0, price), 4) AS decoded, round(exp(-pow((size - 0) / 10, 2)), 6) AS g0, round(exp(-pow((size - 30) / 10, 2)), 6) AS g3, round((size - 25.5) / 14.0, 6) AS z0, round(price - 1.0, 6) AS z1,
  round(2.43e-8 / (1 - 0.514 / 2 + 0.228 / 4) * (200 + size) * pow(100 + size, 1.0 / 3) * pow(6.62607015e-34 / 1.380649e-23 * 1e10 * 3000 * pow(3 * 6 / (4 * pi() * (100 + size)), 1.0 / 3), 3) / (4 * 300 * 6) * 100, 4) AS kappa FROM p""")
def q_numeric_models(spark: SparkSession, d: str) -> DataFrame:
    """Decoded predictions, Gaussian expansion, stored standardisation and the simplified conductivity."""
    rows = i.table(spark, d, "part").selectExpr("p_partkey AS id", "cast(p_size AS double) AS size", "p_retailprice / 1000 AS price")
    grid, scaled = nx.gaussian_expansion(F.col("size"), 0.0, 50.0, 10.0), nx.standardise(F.array("size", "price"), [25.5, 1.0], [14.0, 0.0])
    return rounded(rows.select(
        "id", vx.structure_id(F.concat(F.lit("part_"), "id", F.lit(".cif"))).alias("structure_id"), F.round(nx.decode_log10(F.col("price")), 4).alias("decoded"), grid[0].alias("g0"), grid[3].alias("g3"),
        scaled[0].alias("z0"), scaled[1].alias("z1"), F.round(nx.simple_slack_kappa(200 + F.col("size"), 100 + F.col("size"), F.lit(6)), 4).alias("kappa"),
    ))


@registered(f"WITH {i.COMP}, e AS (SELECT o_orderkey, CAST(1 + o_orderkey % 4 AS INT) AS n_elements FROM orders) SELECT n_elements, count(*) AS n FROM e GROUP BY 1")
def q_arity_counts(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import scoring

    names = F.array(*map(F.lit, ("Ag", "Te", "Sb", "S")))
    formula = F.array_join(F.transform(F.slice(names, F.lit(1), F.expr("cast(1 + o_orderkey % 4 AS int)")), lambda e: F.concat(e, F.lit("2"))), "")
    rows = i.table(spark, d, "orders").select(fx.n_elements(fx.parse_formula(formula)).alias("n_elements"))
    return scoring.arity_counts(rows)


# the loop


@registered(f"""WITH {EI}, cut AS (SELECT * FROM scored ORDER BY ei DESC, k_pred, formula, total_atoms LIMIT 20),
r AS (SELECT *, row_number() OVER (ORDER BY ei DESC, k_pred, formula, total_atoms) AS rank FROM cut)
SELECT CAST(rank AS INT) AS rank, formula, round(ei, 6) AS ei, CAST(rank AS INT) AS final_rank, rank <= 10 AS selected, 7 AS iteration FROM r""")
def q_run_iteration(spark: SparkSession, d: str) -> DataFrame:
    """Iteration 7 without responses; its history has no conductivity above zero, so the best known is that of the default."""
    history = i.kappa(spark, d).select("iteration", (-F.col("k")).alias("k"))
    trace = loop.run_iteration(7, i.predictions(spark, d).select("formula", "mu_log", "sigma_log"), history, None, shared.new_place(spark))
    return rounded(trace.select("rank", "formula", "ei", "final_rank", "selected", "iteration"))


@registered(f"""WITH {i.STATE}, good AS (SELECT formula, k FROM stated WHERE dynamic_stable AND k < 1.0), origin AS (SELECT formula, 5.5::DOUBLE AS k FROM comp),
every AS (SELECT * FROM good UNION ALL SELECT * FROM origin) SELECT formula, round(min(k), 6) AS k FROM every GROUP BY formula""")
def q_loop_update(spark: SparkSession, d: str) -> DataFrame:
    """Results joined, classified and filtered, and the success rows folded into the training table."""
    found = loop.extract(i.kappa(spark, d), i.phonon(spark, d), ["ts"])
    origin = i.compositions(spark, d).select("formula", F.lit(5.5).alias("k"))
    return rounded(loop.update(origin, found).select("formula", "k"))


@registered(f"""WITH {i.STATE} SELECT iteration, count(*) AS n, count(*) FILTER (dynamic_stable) AS n_dynamic_stable, count(*) FILTER (stability_class = 'quasi_stable') AS n_quasi_stable,
  count(*) FILTER (dynamic_stable AND k < 0.5) AS n_success, count(*) FILTER (dynamic_stable AND k < 3) AS n_stable FROM stated GROUP BY 1""")
def q_loop_extract(spark: SparkSession, d: str) -> DataFrame:
    return loop.extract(i.kappa(spark, d), i.phonon(spark, d), ["ts"], threshold=0.5, wide=3.0).counts


@registered(f"""WITH {i.STATE} SELECT formula, round(k, 6) AS k FROM stated WHERE dynamic_stable AND k < 5 AND k >= 2""")
def q_loop_warm(spark: SparkSession, d: str) -> DataFrame:
    """No row is a success at this threshold, so the stable rows start the next iteration."""
    found = loop.extract(i.kappa(spark, d).where("k >= 2"), i.phonon(spark, d), ["ts"], threshold=0.1, wide=9.0)
    return rounded(loop.warm_rows(found, i.predictions(spark, d).select("formula", F.lit(1.0).alias("k"))))


# features


@registered("""WITH t AS (SELECT l_quantity AS q, l_quantity + 5 * l_discount AS near_q, l_tax AS t, l_extendedprice AS y, CAST(NULL AS DOUBLE) AS z, 1.0::DOUBLE AS c FROM lineitem),
m AS (SELECT abs(corr(q, near_q)) AS qn, abs(corr(q, t)) AS qt, abs(corr(near_q, t)) AS nt, abs(corr(q, y)) AS qy, abs(corr(near_q, y)) AS ny, count(z) AS n_z, min(c) = max(c) AS one FROM t)
SELECT 'q' AS feature, CASE WHEN qn > 0.85 AND qy < ny THEN 'like near_q' ELSE 'kept' END AS outcome FROM m UNION ALL SELECT 'again', 'equal to q' FROM m
UNION ALL SELECT 'near_q', CASE WHEN qn > 0.85 AND qy >= ny THEN 'like q' ELSE 'kept' END FROM m UNION ALL SELECT 't', 'kept' FROM m WHERE qt <= 0.85 AND nt <= 0.85
UNION ALL SELECT 'z', 'all null' FROM m WHERE n_z = 0 UNION ALL SELECT 'c', 'constant' FROM m WHERE one""")
def q_pruned_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns of the line items sanitised and pruned: null, constant, repeated and correlated ones go."""
    table = i.table(spark, d, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("id"), F.col("l_quantity").alias("q"), F.col("l_quantity").alias("again"),
        (F.col("l_quantity") + 5 * F.col("l_discount")).alias("near_q"), F.col("l_tax").alias("t"), F.lit(None).cast("double").alias("z"), F.lit(1.0).alias("c"), F.col("l_extendedprice").alias("y"),
    )
    kept, removed = features.sanitise(table, ["q", "again", "near_q", "t", "z", "c"], "id")
    gone = spark.createDataFrame([*removed.items()], "feature string, outcome string")
    pruned = features.prune_correlated(table, kept, "y")
    return pruned.select("feature", F.when(F.col("kept"), "kept").otherwise(F.concat(F.lit("like "), "correlated_with")).alias("outcome")).unionByName(gone)
