"""Line dedup by winnowing over line hashes.

A repeated run is a sequence of ``min_words`` words or more that also stands at an earlier
position; positions are ordered by document id, text and word. Copies of a passage are seldom broken into
lines alike, so the lines that are hashed are reflowed: a line of ``line_words`` words
begins at each word, whatever the text's own breaks.

Of each window of ``min_words`` words the smallest line hash (the last of equal ones) is
a fingerprint, so two windows that are equal have the same fingerprint at the same place. Positions of equal fingerprints
are joined and extended both ways: the windows that have a position as their minimum follow each other, and all their words are
its span. Positions with equal spans match in whole; all but the first of them are repeated runs. There are few unlike spans beside the
positions. The first positions of these meet again, extended to the left by each number of words that their span
holds and to the right by the rest of ``min_words``: of equal windows all but the first are repeated runs. Every window lies in one
span, and the first place of a window is the first position of its span, so no repeated run is lost, whichever earlier position
it stands at. Runs that touch or overlap are one. Deleted are the words of a run at its later position, and each line that keeps none of its words.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, materialise, n_words, pieces, rewritten

BASE = 0x9E3779B97F4A7C15
MIX = np.uint64(0xBF58476D1CE4E5B9)
#: White space between words, by byte.
SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
#: Rows of a record batch that is sent back at once.
ROWS = 20_000
#: Texts without their words (copies, or texts with runs) that are sent to all tasks at most; beyond it they meet through a shuffle.
BROADCAST = 200_000
#: Positions or runs, some 20 bytes each, that are sent to all tasks at most to meet the texts; beyond it they meet through a shuffle.
BROADCAST_SPANS = 500_000


class Powers:
    """Powers of BASE and of its inverse modulo 2^64, as many as the longest text so far has bytes."""

    def __init__(self) -> None:
        self.up, self.down = self._rows(1 << 14)

    @staticmethod
    def _rows(n: int) -> tuple[np.ndarray, np.ndarray]:
        def row(base: int) -> np.ndarray:
            out = np.full(n, base, np.uint64)
            out[0] = 1
            return np.multiply.accumulate(out)

        return row(BASE), row(pow(BASE, -1, 1 << 64))

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            self.up, self.down = self._rows(1 << n.bit_length())
        return self.up[:n], self.down[:n]


def word_hashes(text: bytes, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts): 64-bit hash and first byte of each word, all at once: differences of running sums of the bytes' polynomial, moved to the word's start."""
    letters = np.frombuffer(text, np.uint8)
    edges = np.diff(np.concatenate(([True], SPACE[letters], [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edges < 0), np.flatnonzero(edges > 0)
    up, down = powers.upto(len(letters) or 1)
    sums = np.concatenate(([np.uint64(0)], np.cumsum((letters.astype(np.uint64) + np.uint64(1)) * up[: len(letters)])))
    words = (sums[ends] - sums[starts]) * down[starts]
    words = (words ^ (words >> np.uint64(30))) * MIX
    return words ^ (words >> np.uint64(27)), starts


def line_hashes(words: np.ndarray, line_words: int) -> np.ndarray:
    """Hash of the reflowed line that begins at each word and has all its words."""
    total, upto, power, step = np.zeros(len(words) - line_words + 1, np.uint64), 0, words, 1
    while step <= line_words:  # power: hash of the step words from each word on
        if line_words & step:
            total = total * np.uint64(pow(BASE, step, 1 << 64)) + power[upto : upto + len(total)]
            upto += step
        power = power[:-step] * np.uint64(pow(BASE, step, 1 << 64)) + power[step:] if len(power) > step else power[:0]
        step *= 2
    total = (total ^ (total >> np.uint64(31))) * MIX
    return total ^ (total >> np.uint64(29))


def run_hashes(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray | int, powers: Powers) -> np.ndarray:
    """Hash of the ``sizes`` words from each of ``starts`` on."""
    up, down = powers.upto(len(words) or 1)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(words * up[: len(words)])))
    total = (sums[starts + sizes] - sums[starts]) * down[starts] + np.atleast_1d(sizes).astype(np.uint64) * MIX
    total = (total ^ (total >> np.uint64(31))) * MIX
    return total ^ (total >> np.uint64(29))


def fingerprints(words: np.ndarray, owner: np.ndarray, min_words: int, line_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, n, hash) of the lines that are the smallest of a window, the last of equal ones: those of the ``n`` windows from ``first`` on.

    ``owner`` numbers the text of each word; a window has words of one text only."""
    if len(words) < min_words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = line_hashes(words, line_words)
    at = np.arange(len(least))
    window, size = min_words - line_words + 1, 1
    while size < window:  # least, at: the smallest of the size lines from each on, and where it is
        step = min(size, window - size)
        later = least[step:] <= least[:-step]
        least, at = np.where(later, least[step:], least[:-step]), np.where(later, at[step:], at[:-step])
        size += step
    inside = np.flatnonzero(owner[: len(at)] == owner[min_words - 1 :])
    at = at[inside]
    new = np.flatnonzero(np.diff(at, prepend=-1))
    return inside[new], np.diff(np.append(new, len(at))), least[inside[new]]


def text_words(texts: list[bytes], powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, owner, begins): the words of all texts one after another, the number of each one's text, and where each text's words begin."""
    joined = b" ".join(texts)
    hashes, starts = word_hashes(joined, powers)
    ends = np.cumsum([len(t) + 1 for t in texts])
    owner = np.searchsorted(ends, starts, side="right")
    return hashes, owner, np.searchsorted(owner, np.arange(len(texts)))


def by_size(batches: Iterable[pa.RecordBatch], column: int, most: int = 1 << 19) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with the texts of ``column``, of ``most`` bytes together or of one text."""
    for batch in batches:
        for part in pieces(batch):
            texts = part.column(column).cast(pa.binary()).to_pylist()
            begin, size = 0, 0
            for i, text in enumerate(texts):
                if i > begin and size + len(text) > most:
                    yield part.slice(begin, i - begin), texts[begin:i]
                    begin, size = i, 0
                size += len(text)
            if texts:
                yield part.slice(begin), texts[begin:]


def text_key(text: Column) -> Column:
    """With its id, what tells a text from others."""
    return F.xxhash64(text)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    picked = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return picked.where("text IS NOT NULL").withColumn("text_key", text_key(F.col("text")))


def _with_keys(texts: DataFrame, columns: str) -> T.StructType:
    return T.StructType([*texts.select("doc_id", "text_key").schema.fields, *T._parse_datatype_string(columns).fields])


def span_table(texts: DataFrame, min_words: int, line_words: int) -> DataFrame:
    """(doc_id, text_key, first, n, fingerprint, span) of every text: ``fingerprint`` is the minimum of the ``n`` windows from word ``first`` on,
    whose words have the hash ``span``."""
    schema = _with_keys(texts, "first int, n int, fingerprint long, span long")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for part, texts in by_size(batches, 1):
            words, owner, begins = text_words(texts, powers)
            first, n, marks = fingerprints(words, owner, min_words, line_words)
            spans = run_hashes(words, first, n + (min_words - 1), powers)
            of = owner[first]
            values = ((first - begins[of]).astype(np.int32), n.astype(np.int32), marks.view(np.int64), spans.view(np.int64))
            own = pa.array(of)
            made = [part.column(0).take(own), part.column(2).take(own), *map(pa.array, values)]
            yield pa.RecordBatch.from_arrays(made, names=schema.fieldNames())

    return texts.mapInArrow(run, schema)


def window_table(texts: DataFrame, heads: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, text_key, begin, fingerprint, words): the windows of the positions ``heads`` (doc_id, text_key, first, n, fingerprint), with the hashes of their words."""
    spots = heads.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("first", "n", "fingerprint")).alias("spots"))
    if heads.count() <= BROADCAST_SPANS:
        spots = F.broadcast(spots)
    asked = _meet(texts, spots, {"doc_id": "doc_id", "text_key": "text_key"})
    schema = _with_keys(texts, "begin int, fingerprint long, words long")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for part, texts in by_size(batches, 2):
            words, _, begins = text_words(texts, powers)
            spots = part.column(3)
            first, n, marks = (spots.flatten().field(c).to_numpy() for c in range(3))
            of = np.repeat(np.arange(len(texts)), spots.value_lengths().to_numpy())
            begin = np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            of = np.repeat(of, n)
            hashes = run_hashes(words, begin + begins[of], min_words, powers)
            own = pa.array(of)
            values = (begin.astype(np.int32), np.repeat(marks, n), hashes.view(np.int64))
            made = [part.column(0).take(own), part.column(1).take(own), *map(pa.array, values)]
            for batch in pieces(pa.RecordBatch.from_arrays(made, names=schema.fieldNames()), ROWS):
                yield batch

    return asked.select("doc_id", "text_key", "text", "spots").mapInArrow(run, schema)


def _meet(left: DataFrame, right: DataFrame, keys: dict[str, Column | str]) -> DataFrame:
    """Inner join in which nulls are equal; ``keys`` tells for each key of ``right`` what equals it in ``left``."""
    named = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = [(F.col(v) if isinstance(v, str) else v).eqNullSafe(F.col(f"__{k}")) for k, v in keys.items()]
    return left.join(named, on).drop(*(f"__{k}" for k in keys))


def whole_copies(texts: DataFrame) -> DataFrame:
    """(doc_id, text_key) of the texts that an earlier document has too."""
    whole = [F.col("text_key"), F.xxhash64(F.lit(1), "text").alias("other_key")]
    owners = materialise(texts.select("doc_id", *whole).distinct())
    several = owners.groupBy("text_key", "other_key").agg(F.min(F.struct("doc_id")).alias("first"), F.count("*").alias("n")).where("n > 1")
    several = materialise(several.select("text_key", "other_key", F.col("first.doc_id").alias("first_id")))
    return materialise(owners.join(several, ["text_key", "other_key"]).where(~F.col("doc_id").eqNullSafe(F.col("first_id"))).select("doc_id", "text_key"))


def _later(rows: DataFrame, keys: list[str], start: str) -> DataFrame:
    """The rows of a group of equal ``keys`` but the first by document, text and ``start``."""
    place = F.struct("doc_id", "text_key", start)
    # the small side is written first, so that a join can split a hot key
    firsts = materialise(rows.groupBy(*keys).agg(F.min(place).alias("__first"), F.count("*").alias("__n")).where("__n > 1").drop("__n"))
    return rows.join(firsts, keys).where(~place.eqNullSafe(F.col("__first"))).drop("__first")


def repeated_runs(texts: DataFrame, copies: DataFrame, min_words: int, line_words: int) -> DataFrame:
    """(doc_id, text_key, start, end): words ``start`` to ``end``, exclusive, stand at an earlier position too. What is in no such row does not.

    ``copies`` are the texts that take no part, as an earlier document has the whole of them."""
    # where they are few enough to tell beforehand, their texts are not read for it
    gone = copies.withColumnsRenamed({"doc_id": "copy_id", "text_key": "copy_key"})
    copied = F.col("doc_id").eqNullSafe(F.col("copy_id")) & (F.col("text_key") == F.col("copy_key"))
    if copies.count() <= BROADCAST:
        every = span_table(texts.join(F.broadcast(gone), copied, "left_anti"), min_words, line_words)
    else:
        every = span_table(texts, min_words, line_words).join(gone, copied, "left_anti")
    every = rewritten(every)
    place = F.xxhash64("doc_id", "text_key", "first")
    seeds = every.groupBy("fingerprint").agg((F.min(place) != F.max(place)).alias("shared"), (F.min("span") != F.max("span")).alias("several"))
    seeds = materialise(seeds.where("shared").drop("shared"))
    shared = rewritten(every.join(seeds, "fingerprint"))
    spans = shared.groupBy("fingerprint", "span", "several").agg(F.min(F.struct("doc_id", "text_key", "first", "n")).alias("head"), F.count("*").alias("size"))
    spans = materialise(spans)
    whole = spans.where("size > 1").select("fingerprint", "span", "head")
    whole = shared.join(whole, ["fingerprint", "span"]).where(~F.struct("doc_id", "text_key", "first", "n").eqNullSafe(F.col("head")))
    whole = whole.select("doc_id", "text_key", F.col("first").alias("start"), (F.col("first") + F.col("n") + (min_words - 1)).alias("end"))

    heads = spans.where("several").select("head.*", "fingerprint")
    windows = rewritten(window_table(texts, heads, min_words))
    again = _later(windows, ["fingerprint", "words"], "begin")
    again = again.select("doc_id", "text_key", F.col("begin").alias("start"), (F.col("begin") + min_words).alias("end"))
    return whole.union(again)


def joined_runs(runs: DataFrame) -> DataFrame:
    """(doc_id, text_key, found): the runs of each text, those that touch or overlap as one; they are no more than its words."""
    lists = runs.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("found"))

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(2)
            start, end = (found.flatten().field(c).to_numpy() for c in range(2))
            of = np.repeat(np.arange(batch.num_rows, dtype=np.int64), found.value_lengths().to_numpy())
            # running maximum of the ends, each text's beyond those of the texts before
            far = np.maximum.accumulate(end + (of << 32))
            new = np.flatnonzero(np.concatenate(([True], start[1:] + (of[1:] << 32) > far[:-1]))) if len(of) else np.zeros(0, np.int64)
            ends = far[np.append(new[1:], len(of)) - 1] - (of[new] << 32) if len(of) else end
            kept = pa.StructArray.from_arrays([pa.array(start[new].astype(np.int32)), pa.array(ends.astype(np.int32))], names=["start", "end"])
            offsets = np.searchsorted(of[new], np.arange(batch.num_rows + 1)).astype(np.int32)
            columns = [batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets), kept)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "found"])

    return lists.mapInArrow(join, lists.schema)


def without(text: str, gone: np.ndarray) -> str:
    """The text without the marked words, nor the lines that keep none of theirs, nor blank lines between marked words."""
    out, at = [], 0
    for line in text.split("\n"):
        spans = [m.span() for m in re.finditer(WORD, line)]
        own = gone[at : at + len(spans)]
        inside = 0 < at < len(gone) and bool(gone[at - 1] and gone[at])
        at += len(spans)
        if not own.any():
            if spans or not inside:
                out.append(line)
        elif not own.all():
            edges = np.flatnonzero(np.diff(np.concatenate(([True], own, [True])).astype(np.int8)))
            parts = [line[spans[a][0] if a else 0 : spans[b - 1][1] if b < len(spans) else len(line)] for a, b in zip(edges[::2], edges[1::2])]
            out.append(" ".join(parts))
    return "\n".join(out)


def drop_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, line_words: int = 16
) -> DataFrame:
    """``docs`` with the same rows and columns, its texts without later repeated runs.

    A text of ``min_words`` or more that an earlier document has too becomes empty. Texts may
    become empty otherwise; null texts stay null; shorter texts stay as they are. Rows with equal
    ids and texts count as one document, which keeps what it keeps in each of them; rows with equal ids and other
    texts are documents in the order of their texts' hashes; null ids come first. Any
    other columns pass through; an empty table gives an empty result."""
    texts = _texts(docs, id_col, text_col)
    copies = whole_copies(texts)
    runs = repeated_runs(texts, copies, min_words, line_words)
    found = joined_runs(runs).withColumn("copy", F.lit(False))
    gone = rewritten(found.unionByName(copies.withColumn("copy", F.lit(True)), allowMissingColumns=True))
    size = gone.agg(F.count("*").alias("texts"), F.coalesce(F.sum(F.size("found")), F.lit(0)).alias("runs")).first()
    if size["texts"] <= BROADCAST and size["runs"] <= BROADCAST_SPANS:
        gone = F.broadcast(gone)

    @F.pandas_udf(T.StringType())
    def cut(texts: pd.Series, found: pd.Series) -> pd.Series:
        def one(text: str, runs: list[dict]) -> str:
            gone = np.zeros(len(re.findall(WORD, text)), bool)
            for run in runs:
                gone[run["start"] : run["end"]] = True
            return without(text, gone)

        return pd.Series([None if t is None else one(t, r) for t, r in zip(texts, found)], dtype=object)

    rows = docs.select(
        F.struct("*").alias("row"), F.col(f"`{id_col}`").alias("own_id"), F.col(f"`{text_col}`").cast("string").alias("own_text")
    ).withColumn("own_key", text_key(F.col("own_text")))
    joined = rows.join(gone, rows["own_id"].eqNullSafe(gone["doc_id"]) & (rows["own_key"] == gone["text_key"]), "left")
    matched = cut(F.when(F.col("found").isNotNull(), F.col("own_text")), "found")
    emptied = F.when(n_words(F.col("own_text")) >= min_words, F.lit("")).otherwise(F.col("own_text"))
    text = F.when(F.col("copy"), emptied).when(F.col("found").isNotNull(), matched).otherwise(F.col("own_text"))
    return joined.select(*(text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))
