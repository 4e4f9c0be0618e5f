"""Document fingerprints by a homomorphic multiset hash, in DataFrame functions only.

A text is the multiset of its paragraphs, the pieces between line feeds. Each
paragraph is hashed to a wide vector, and a text's fingerprint is the sum of these vectors modulo
2^32, lane by lane. So it does not depend on the paragraphs' order, and inserting or deleting
paragraphs adds or subtracts their vectors (``plus``, ``minus``) without reading the rest.

Lanes of a vector: eight are the SHA-256 of the paragraph, which tell multisets apart; one is its number
of phrases, 60 count how many of these have a bit of their MD5 set. A phrase ends at a space after one of
``ENDS`` or with its paragraph, so an edit changes few of them. Twice a count less the number of
phrases is a sum of random signs, so the inner product of two texts' sums estimates how many phrases they share (``likeness``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Lanes are sums modulo this power.
MODULUS = 1 << 32
DIGEST_LANES = 8
SIGN_LANES = 60
#: Characters that end a phrase before a space.
ENDS = "aeo.,;:!?"
PHRASES = rf"[\x20\x09-\x0D](?<=\n|[{ENDS}][\x20\x09-\x0D])"
#: Bits are counted eight to a long, each in a byte of its own, in runs of so many phrases.
RUN = 127


def _hex_long(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("long")


def with_vector(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with the vector of the column ``text`` as ``out``, an array of longs; a null text counts as empty.

    The steps are columns of their own, so that each is computed once a row."""
    digests, marks, runs = (f"__{out}_{x}" for x in ("digests", "marks", "runs"))
    whole, zero, ones = F.coalesce(F.col(text), F.lit("")), F.lit(0).cast("long"), F.lit(0x0101010101010101).cast("long")
    df = df.withColumns(
        {
            digests: F.transform(F.split(whole, "\n", -1), lambda p: F.sha2(p, 256)),
            marks: F.transform(F.filter(F.split(whole, PHRASES, -1), lambda u: u != ""), lambda u: _hex_long(F.substring(F.md5(u), 1, 15))),
        }
    )

    def of_run(start: Column) -> Column:
        run = F.slice(marks, start, RUN)
        return F.array(*(F.aggregate(run, zero, lambda total, m: total + F.shiftrightunsigned(m, bit).bitwiseAND(ones)) for bit in range(8)))

    def bit_count(bit: int) -> Column:
        return F.aggregate(runs, zero, lambda total, r: total + F.shiftrightunsigned(r[bit % 8], bit - bit % 8).bitwiseAND(F.lit(255)))

    def digest_lane(lane: int) -> Column:
        return F.aggregate(digests, zero, lambda total, d: (total + _hex_long(F.substring(d, 8 * lane + 1, 8))) % MODULUS)

    df = df.withColumn(runs, F.transform(F.sequence(F.lit(1), F.greatest(F.size(marks), F.lit(1)), F.lit(RUN)), of_run))
    lanes = [*(digest_lane(i) for i in range(DIGEST_LANES)), F.size(marks).cast("long"), *(bit_count(b) for b in range(SIGN_LANES))]
    return df.withColumn(out, F.array(*lanes)).drop(digests, marks, runs)


def plus(a: Column, b: Column) -> Column:
    """The fingerprint of both texts' paragraphs together."""
    return F.zip_with(a, b, lambda x, y: (x + y) % MODULUS)


def minus(a: Column, b: Column) -> Column:
    """The fingerprint of the first text's paragraphs without the second's."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x - y, F.lit(MODULUS)))


def printed(vector: Column) -> Column:
    """Eight hexadecimal digits a lane."""
    return F.array_join(F.transform(vector, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def _signs(vector: Column) -> Column:
    """Sums of signs, from their counts of ones."""
    return F.transform(F.slice(vector, DIGEST_LANES + 2, SIGN_LANES), lambda c: 2 * c - vector[DIGEST_LANES])


def likeness(a: Column, b: Column) -> Column:
    """From 0 to 1: 1 for equal fingerprints, else the cosine of the sums of signs where positive; six decimals.

    It estimates the share of phrases that both texts have, give or take an eighth."""

    def inner(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(_signs(x), _signs(y), lambda p, q: p * q), F.lit(0).cast("long"), lambda t, v: t + v)

    both = F.sqrt(inner(a, a).cast("double")) * F.sqrt(inner(b, b).cast("double"))
    cosine = F.when(both > 0, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), inner(a, b) / both)), 6)).otherwise(0.0)
    return F.when(a == b, 1.0).otherwise(cosine)


def next_places(keys: DataFrame) -> DataFrame:
    """(doc_id, text_md5, next_id, next_md5, n_chars): the document after each in descending doc_id (null last), then by MD5.

    ``keys`` has distinct (doc_id, text_md5). They are dealt by ranges, so each is looked for in its range alone; the last of a range is
    followed by the first of the next one that has rows, the last of all by the first of all. One row a range is ordered in one task."""
    order = [F.col("doc_id").desc_nulls_last(), F.col("text_md5")]
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialise(keys.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    place = F.struct(F.col("doc_id").alias("next_id"), F.col("text_md5").alias("next_md5"))
    inside = Window.partitionBy("part").orderBy(*order)
    numbered = dealt.withColumns({"after": F.lead(place).over(inside), "nth": F.row_number().over(inside)})
    firsts = numbered.where("nth = 1").select("part", place.alias("first"))
    ranges = Window.orderBy("part")
    every = ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select("part", F.coalesce(F.lead("first").over(ranges), F.first("first").over(every)).alias("follows"))
    after = F.coalesce("after", "follows")
    found = numbered.join(F.broadcast(firsts), "part")  # a row a range
    return found.select("doc_id", "text_md5", "n_chars", after["next_id"].alias("next_id"), after["next_md5"].alias("next_md5"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: doc_id, text, n_chars, edited, vector, edited_vector, next_vector, next_id.

    The edited text has its last third, floor(n_chars / 3) code points, replaced by as many of the next document (by ``next_places``) or
    all of it. Its vector is the text's without that of the paragraphs from the cut one on, with that of those that
    take their place. Null texts count as empty. Rows with equal ids and texts stand at one place, so each
    of them gets the same; of equal ids with other texts each has its place. A table of one document is followed by itself, an empty one
    gives no rows; other columns of ``docs`` may have any name."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"))
    texts = texts.withColumn("text_md5", F.md5("text"))
    keys = texts.select("doc_id", "text_md5", F.length("text").cast("long").alias("n_chars"))
    places = materialise(next_places(keys.distinct()))
    texts = with_vector(texts, "text", "vector")
    # both joins deal the same columns of the texts by the same key, so they are shuffled once
    owners = places.select(
        F.col("next_id").alias("key_id"), F.col("next_md5").alias("key_md5"), F.col("doc_id").alias("owner_id"), F.col("text_md5").alias("owner_md5"), F.floor(F.col("n_chars") / 3).alias("cut")
    )
    follows = texts.join(owners, F.col("doc_id").eqNullSafe(F.col("key_id")) & (F.col("text_md5") == F.col("key_md5")))
    follows = follows.select("owner_id", "owner_md5", F.expr("substring(text, 1, cut)").alias("head"), F.col("vector").alias("next_vector"), F.col("doc_id").alias("next_id"))
    follows = follows.dropDuplicates(["owner_id", "owner_md5"])
    both = texts.join(follows, F.col("doc_id").eqNullSafe(F.col("owner_id")) & (F.col("text_md5") == F.col("owner_md5")))
    both = both.withColumn("n_chars", F.length("text").cast("long"))
    stays = F.col("n_chars") - F.floor(F.col("n_chars") / 3)
    both = both.withColumn("kept", F.expr("substring(text, 1, n_chars - floor(n_chars / 3))"))
    opened = F.substring_index("kept", "\n", -1)  # of the paragraph that is cut
    both = both.withColumns(
        {
            "edited": F.concat("kept", "head"),
            "leaving": F.concat(opened, F.substring(F.col("text"), stays.cast("int") + 1, F.col("n_chars").cast("int"))),
            "coming": F.concat(opened, F.col("head")),
        }
    )
    both = with_vector(with_vector(both, "leaving", "gone"), "coming", "new")
    both = both.withColumn("edited_vector", plus(minus(F.col("vector"), F.col("gone")), F.col("new")))
    return both.select("doc_id", "text", "n_chars", "edited", "vector", "edited_vector", "next_vector", "next_id")


def _sql_vector(text: str) -> str:
    """DuckDB: the vector of a text as a list; ``text`` is SQL."""
    digest = ", ".join(
        f"CAST(list_sum(list_transform(pieces, lambda p: CAST('0x' || substr(sha256(p), {8 * i + 1}, 8) AS BIGINT))) % {MODULUS} AS BIGINT)" for i in range(DIGEST_LANES)
    )
    counts = ", ".join(f"CAST(coalesce(list_sum(list_transform(marks, lambda m: (m >> {b}) & 1)), 0) AS BIGINT)" for b in range(SIGN_LANES))
    cut = rf"regexp_replace({text}, '([{ENDS}])[\x20\x09\x0B-\x0D]', '\1' || chr(10), 'g')"
    return f"""(SELECT [{digest}, CAST(len(marks) AS BIGINT), {counts}] FROM (
    SELECT string_split({text}, chr(10)) AS pieces,
           list_transform(list_filter(string_split({cut}, chr(10)), lambda u: u <> ''), lambda u: CAST('0x' || substr(md5(u), 1, 15) AS BIGINT)) AS marks))"""


def _sql_likeness(a: str, b: str) -> str:
    def signs(v: str) -> str:
        return f"list_transform({v}[{DIGEST_LANES + 2}:], lambda c: 2 * c - {v}[{DIGEST_LANES + 1}])"

    def inner(x: str, y: str) -> str:
        return f"CAST(list_sum(list_transform(list_zip({signs(x)}, {signs(y)}), lambda z: z[1] * z[2])) AS DOUBLE)"

    both = f"(sqrt({inner(a, a)}) * sqrt({inner(b, b)}))"
    return f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN {both} > 0 THEN round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, {inner(a, b)} / {both})), 6) ELSE 0.0::DOUBLE END"


def oracle_sql() -> str:
    """The query in DuckDB's SQL: vectors of the whole edited texts, not by difference."""
    printed_sql = "array_to_string(list_transform({0}, lambda x: lpad(lower(printf('%x', x)), 8, '0')), '')"
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, md5(coalesce(text, '')) AS text_md5 FROM documents),
places AS (
  SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id DESC NULLS LAST, text_md5), first(text) OVER (ORDER BY doc_id DESC NULLS LAST, text_md5
           ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS follows
  FROM (SELECT DISTINCT * FROM texts)),
edits AS (
  SELECT *, CAST(length(text) AS BIGINT) AS n_chars, substr(text, 1, length(text) - length(text) // 3) || substr(follows, 1, length(text) // 3) AS edited
  FROM places),
vectors AS (SELECT *, {_sql_vector("text")} AS v, {_sql_vector("edited")} AS e, {_sql_vector("follows")} AS f FROM edits)
SELECT t.doc_id, n_chars, sha256(edited) AS edited_sha256, {printed_sql.format("v")} AS fingerprint, {printed_sql.format("e")} AS edited_fingerprint,
       {_sql_likeness("v", "e")} AS near_edited, {_sql_likeness("v", "f")} AS near_next
FROM texts t JOIN vectors x ON t.doc_id IS NOT DISTINCT FROM x.doc_id AND t.text_md5 = x.text_md5
"""
