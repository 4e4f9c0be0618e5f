"""Spelling variants: words one edit apart, found by dense prefix-suffix tiling, and the common form of each.

Two words are near if they differ by one inserted, deleted or replaced character: that
is, if their common prefix and common suffix together reach the longer length less one. Let m be the shorter length. The words have the first
m // 2 characters or the last m - m // 2 in common, so they meet under one of these keys. A key with more than ``dense`` words is
split in the same way over the characters that it leaves open, until few words or one open character are left; nothing is
capped. Rows are sorted by key and cut into blocks; the code points of each pair of blocks that share a key are compared as padded
matrices, from the left and from the right.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

RUN = r"[a-zÀ-ÿ]{%d,}"
#: Distinct words that a task counts before it hands them on.
MEMORY = 300_000
#: Words of a block, and characters of one, so that a tile stays small whatever the words' lengths.
BLOCK, BLOCK_CHARACTERS = 256, 1 << 20
#: Words under a key that are compared without splitting it.
DENSE = 4096


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 7, spoil: int = 31) -> DataFrame:
    """(word, n): runs of letters of ``min_length`` characters or more, with how often they stand in all texts.

    Only A-Z are lower-cased. A run whose crc32 with its document's id is a multiple of ``spoil`` first loses a character.
    Null texts have none, a null id counts as an empty string; repeated rows count each."""
    picked = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    find = re.compile(RUN % min_length).findall

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                seed = zlib.crc32(f"{doc_id}:".encode())
                for run, n in Counter(find(text.as_py().lower().decode())).items():
                    h = zlib.crc32(run.encode(), seed)
                    if h % spoil == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < min_length:
                            continue
                    total[run] += n
                if len(total) >= MEMORY:
                    yield _counted(total)
                    total.clear()
        if total:
            yield _counted(total)

    counted = picked.where("text IS NOT NULL").mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def _counted(total: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])


def _split(rows: DataFrame) -> DataFrame:
    """Two rows of each: with the first half of the open characters shared too, and with the last, where the first half is not."""
    half = F.floor((F.col("m") - F.col("head") - F.col("tail")) / 2).cast("int")
    begun = F.col("head") + half
    halves = F.array(
        F.struct(begun.alias("head"), F.col("tail").alias("tail"), F.col("below").alias("below")),
        F.struct(F.col("head").alias("head"), (F.col("m") - begun).alias("tail"), begun.alias("below")),
    )
    return rows.select("word", "n", "m", F.explode(halves).alias("h")).select("word", "n", "m", "h.*")


def _keyed(rows: DataFrame) -> DataFrame:
    """The key of each row: what its words have in common, whatever the rest."""
    shared = F.concat_ws("|", "m", "head", "tail", "below", F.expr("left(word, head)"), F.expr("right(word, tail)"))
    return rows.withColumn("key", shared)


def near_candidates(words: DataFrame, dense: int = DENSE) -> DataFrame:
    """(key, word, n, m, below): words under their keys, those of one word left out.

    A pair is to be taken only under a key whose m is its shorter length and whose ``below`` is more than its common prefix: else another key has it too."""
    lengths = F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("m")
    rows = words.select("word", "n", lengths).withColumns({"head": F.lit(0), "tail": F.lit(0), "below": F.col("m") + 1})
    done = None
    while True:
        rows = materialise(_keyed(_split(rows)))
        sizes = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
        rows = materialise(rows.join(sizes, "key"))
        ready = (F.col("size") <= dense) | (F.col("m") - F.col("head") - F.col("tail") <= 1)
        few = rows.where(ready).select("key", "word", "n", "m", "below")
        done = few if done is None else done.unionByName(few)
        rows = rows.where(~ready).select("word", "n", "m", "head", "tail", "below")
        if rows.isEmpty():
            return done


class Block:
    """Words as matrices of code points, padded on the right and on the left."""

    def __init__(self, keys: list[str], words: list[str], counts: list[int], below: list[int], shorter: list[int]) -> None:
        self.keys, self.words, self.counts = keys, words, counts
        self.lengths, self.below, self.shorter = np.array([len(w) for w in words]), np.array(below), np.array(shorter)
        self.width = int(self.lengths.max())
        self.left = np.zeros((len(words), self.width), np.uint32)
        self.right = np.zeros((len(words), self.width), np.uint32)
        for i, w in enumerate(words):
            code = np.frombuffer(w.encode("utf-32-le"), np.uint32)
            self.left[i, : len(code)] = code
            self.right[i, self.width - len(code) :] = code[: self.width]

    def common(self, other: Block, side: str) -> np.ndarray:
        """Characters that each of these words has in common with each of the other's, from one side."""
        width = min(self.width, other.width)
        a, b = (getattr(x, side) for x in (self, other))
        alike = np.ones((len(a), len(b)), bool)
        total = np.zeros((len(a), len(b)), np.int32)
        for i in range(width):
            at = i if side == "left" else -1 - i
            alike &= (a[:, at][:, None] == b[:, at][None, :]) & (a[:, at] != 0)[:, None]
            if not alike.any():
                break
            total += alike
        return total


def tile(a: Block, b: Block) -> list[tuple[int, int]]:
    """Pairs of rows of two blocks (or of one, each pair once) under one key whose words are one edit apart."""
    names = {k: i for i, k in enumerate(dict.fromkeys(a.keys + b.keys))}
    same = np.array([names[k] for k in a.keys])[:, None] == np.array([names[k] for k in b.keys])[None, :]
    prefix = a.common(b, "left")
    longer = np.maximum(a.lengths[:, None], b.lengths[None, :])
    near = same & (prefix < a.below[:, None]) & (np.minimum(a.lengths[:, None], b.lengths[None, :]) == a.shorter[:, None])
    if a is b:
        near = np.triu(near, 1)
    if near.any():
        near &= prefix + a.common(b, "right") >= longer - 1
    return list(zip(*(x.tolist() for x in np.nonzero(near))))


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[Block]:
    held, characters = [], 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("key", "word", "n", "below", "m"))):
            held.append(row)
            characters += len(row[1])
            if len(held) >= BLOCK or characters >= BLOCK_CHARACTERS:
                yield Block(*map(list, zip(*held)))
                held, characters = [], 0
    if held:
        yield Block(*map(list, zip(*held)))


def _tiles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n, other, other_n) of near pairs, both ways, from rows sorted by key."""
    open_blocks: list[Block] = []  # with the key that the newest begins with
    for block in _blocks(batches):
        open_blocks = [b for b in open_blocks if b.keys[-1] == block.keys[0]]
        found = []
        for before in [*open_blocks, block]:
            for i, j in tile(before, block):
                one, two = (before.words[i], before.counts[i]), (block.words[j], block.counts[j])
                found += [(*one, *two), (*two, *one)]
        open_blocks.append(block)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], names=["word", "n", "other", "other_n"])


def near_pairs(words: DataFrame, dense: int = DENSE) -> DataFrame:
    """(word, n, other, other_n) of words one edit apart, both ways, each once. ``words`` has distinct (word, n)."""
    rows = near_candidates(words, dense)
    dealt = rows.repartition("key").sortWithinPartitions("key").select("key", "word", "n", "below", "m")
    return dealt.mapInArrow(_tiles, "word string, n long, other string, other_n long")


def variants(words: DataFrame, ratio: int = 10, dense: int = DENSE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct (word, n).

    The form is the near word of largest n (of equal ones the first by code points), if its n is ``ratio`` times the word's or more. The root is
    reached by following forms: their n grows by the ratio at each step, so a few doublings of the steps end it."""
    pairs = near_pairs(words, dense)
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("other"))).alias("best"))
    known = materialise(words.join(best, "word", "left"))
    fits = -F.col("best.minus") >= ratio * F.col("n")
    known = known.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fits, F.col("best.other")).alias("form"), F.when(fits, -F.col("best.minus")).alias("form_n"))
    steps = known.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    steps = materialise(steps)
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = steps.join(further, "root", "left")
        steps = materialise(joined.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if steps.where("moved").isEmpty():
            break
        steps = steps.drop("moved")
    return known.join(steps.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 7, min_count: int = 2, spoil: int = 31, ratio: int = 10) -> DataFrame:
    """``variants`` of the words that all texts have ``min_count`` times or more (see ``word_counts``).

    An empty table gives no rows; other columns of ``docs`` may have any name."""
    words = word_counts(docs, id_col, text_col, min_length, spoil)
    return variants(materialise(words.where(F.col("n") >= min_count)), ratio)


#: The query in DuckDB's SQL: words meet by equal deletions. Runs hold no character above U+00FF, so each is one or two bytes.
ORACLE_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS crc),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents) WHERE length(run) >= 7),
once AS (SELECT id, run, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(list_reduce(flatten(list_transform(string_split(id || run, ''),
           lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [CAST(192 + (unicode(x) >> 6) AS BIGINT), CAST(128 + (unicode(x) & 63) AS BIGINT)] END)),
           lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS h
  FROM once, bits),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
gaps AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
links AS (
  SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM gaps a JOIN gaps b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM gaps a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM gaps a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM links GROUP BY word),
known AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * w.n THEN other END AS form, CASE WHEN other_n >= 10 * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word),
walk AS (SELECT word, word AS root, form AS next FROM known UNION ALL SELECT w.word, k.word, k.form FROM walk w JOIN known k ON w.next = k.word)
SELECT k.word, k.form, w.root, k.n, k.n_near, k.form_n FROM known k JOIN walk w ON k.word = w.word AND w.next IS NULL
"""
