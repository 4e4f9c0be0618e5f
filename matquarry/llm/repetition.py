"""Quality rules by repetition coverage.

Words of a text become numbers; rolling hashes of n-grams of several lengths come
from numpy, each length from the one before by one multiplication and one sum. For each length
the rules measure which part of the text's word characters lies inside n-grams found twice or
more, or inside the single most frequent n-gram, and which part lies in lines equal
to an earlier line.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, map_texts

#: Symbols that the rules count.
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Rules:
    """Limits of the rules; a text that exceeds one is not kept.

    Shares are of the text's word characters. A most frequent n-gram counts only if it
    is found at least ``top_least`` times, as short texts repeat a pair of words by
    chance."""

    min_words: int = 10
    max_repeat_word_percent: int = 20
    max_top_share: tuple[tuple[int, float], ...] = ((2, 0.20), (3, 0.18), (4, 0.16))
    top_least: int = 5
    max_dup_share: tuple[tuple[int, float], ...] = ((5, 0.20), (6, 0.18), (8, 0.15), (10, 0.15))
    max_dup_line_share: float = 0.30
    max_dup_line_chars: float = 0.20
    max_symbols_per_word: float = 0.10

    @property
    def lengths(self) -> list[int]:
        return sorted({WINDOW, *(n for n, _ in self.max_top_share), *(n for n, _ in self.max_dup_share)})


def word_numbers(words: list[bytes]) -> np.ndarray:
    """A well-mixed 64-bit number for each word, equal for equal words alone."""
    code = {w: i for i, w in enumerate(dict.fromkeys(words), 1)}
    x = np.fromiter(map(code.__getitem__, words), np.uint64, len(words)) * BASE
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def rolling(numbers: np.ndarray, lengths: list[int]):
    """(n, hash of each window of n numbers) for each of the lengths that fit, ascending."""
    hashes, at = numbers, 1
    for n in lengths:
        if n > len(numbers):
            return
        while at < n:
            hashes = hashes[:-1] * BASE + numbers[at:]
            at += 1
        yield n, hashes


def covered(repeated: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in a window of n that is marked."""
    edges = np.zeros(len(repeated) + n, np.int32)
    edges[: len(repeated)] += repeated
    edges[n:] -= repeated
    return np.cumsum(edges[:-1]) > 0


def measure(text: bytes, rules: Rules = Rules()) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, top_share, dup_share, dup_line_chars."""
    words = text.split()
    n_words = len(words)
    joined = b"".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n_words))
    if not joined.isascii():  # characters: bytes that do not continue one
        ends = np.cumsum((np.frombuffer(joined, np.uint8) & 0xC0) != 0x80)[ends - 1]
    ends = np.concatenate(([0], ends))
    sizes, word_chars = np.diff(ends), int(ends[-1])
    n_symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    n_dup_lines = len(lines) - len(set(lines))
    line_chars, once = (sum(len(x.decode()) for x in some) for some in (lines, set(lines))) if n_dup_lines else (1, 1)
    n_repeat_words, broken, top_most, dup_most = 0, False, 0.0, 0.0
    top, dup, total = dict(rules.max_top_share), dict(rules.max_dup_share), max(1, word_chars)
    for n, hashes in rolling(word_numbers(words), rules.lengths):
        order = np.sort(hashes)
        if (order[1:] != order[:-1]).all():
            if n >= WINDOW:
                break  # a longer n-gram found twice holds a shorter one found twice
            continue
        _, first, which, counts = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        if n in top and counts.max() >= rules.top_least:
            at = first[counts == counts.max()]
            share = counts.max() * (ends[at + n] - ends[at]).max() / total
            top_most = max(top_most, share)
            broken |= bool(share > top[n])
        if n == WINDOW or n in dup:
            inside = covered(counts[which] > 1, n)
            if n == WINDOW:
                n_repeat_words = int(inside.sum())
            if n in dup:
                share = sizes[inside].sum() / total
                dup_most = max(dup_most, share)
                broken |= bool(share > dup[n])
    dup_line_chars = 1 - once / line_chars
    broken |= n_dup_lines > rules.max_dup_line_share * len(lines) and n_dup_lines > 2
    broken |= dup_line_chars > rules.max_dup_line_chars
    broken |= n_symbols > rules.max_symbols_per_word * n_words
    failed = n_words < rules.min_words or 100 * n_repeat_words > rules.max_repeat_word_percent * n_words
    return (
        n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed, not (failed or broken),
        float(top_most), float(dup_most), float(dup_line_chars),
    )


SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, top_share double, dup_share double, dup_line_chars double"
)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """One row for each row of ``docs``: doc_id, the counts of the base rules, base_failed, kept and the shares.

    Null and empty texts have no words, so they fail the base rules. Repeated rows
    each return their row, with equal results; ids may be null; other columns are ignored; an
    empty table gives an empty result."""
    return map_texts(docs, id_col, text_col, SCHEMA, lambda: lambda text: measure(text, rules))


def keep_good(docs: DataFrame, text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` whose text the rules keep, all columns as they are; null texts go."""

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        return pd.Series([measure((t or "").encode(), rules)[6] for t in texts], dtype=bool)

    return docs.where(good(F.col(f"`{text_col}`").cast("string")))


def oracle_sql(rules: Rules = Rules()) -> str:
    """DuckDB SQL for ``quality_rules`` over documents with unique ids, shares to six digits: every n-gram as text."""
    lengths = sorted({WINDOW, *(n for n, _ in rules.max_top_share), *(n for n, _ in rules.max_dup_share)})
    grams = " UNION ALL ".join(
        f"SELECT doc_id, {n} AS n, s, array_to_string(words[s:s + {n - 1}], ' ') AS gram, upto[s + {n - 1}] - upto[s] + len(words[s]) AS chars FROM "
        f"(SELECT *, unnest(range(1, len(words) - {n - 2})) AS s FROM w)"
        for n in lengths
    )
    top = ", ".join(f"({n}, {most})" for n, most in rules.max_top_share)
    dup = ", ".join(f"({n}, {most})" for n, most in rules.max_dup_share)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w0 AS (SELECT doc_id, text, regexp_extract_all(text, '{WORD}') AS words FROM d),
e AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w0),
u0 AS (SELECT doc_id, i, sum(len(word)) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM e),
u1 AS (SELECT doc_id, list(n ORDER BY i) AS upto FROM u0 GROUP BY doc_id),
w AS (SELECT w0.*, upto, coalesce(list_last(upto), 0)::BIGINT AS word_chars FROM w0 LEFT JOIN u1 USING (doc_id)),
g0 AS ({grams}),
g AS (SELECT *, count(*) OVER (PARTITION BY doc_id, n, gram) AS times FROM g0),
most AS (SELECT doc_id, n, max(times) AS times FROM g GROUP BY ALL),
tops AS (SELECT g.doc_id, g.n, max(g.times * g.chars) / max(w.word_chars) AS share FROM g JOIN most USING (doc_id, n, times) JOIN w USING (doc_id) WHERE g.times >= {rules.top_least} GROUP BY ALL),
top AS (SELECT doc_id, max(share) AS share, bool_or(share > limits.most) AS broken FROM tops JOIN (VALUES {top}) limits(n, most) USING (n) GROUP BY doc_id),
inside AS (SELECT DISTINCT doc_id, n, unnest(range(s, s + n)) AS i FROM g WHERE times > 1),
cover AS (SELECT doc_id, n, sum(len(words[i])) / max(word_chars) AS share, count(*) AS repeated FROM inside JOIN w USING (doc_id) GROUP BY ALL),
dup AS (SELECT doc_id, max(share) AS share, bool_or(share > limits.most) AS broken FROM cover JOIN (VALUES {dup}) limits(n, most) USING (n) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
l1 AS (SELECT doc_id, line, count(*) AS times FROM l WHERE regexp_matches(line, '{WORD}') GROUP BY ALL),
lines AS (SELECT doc_id, sum(times) AS n_lines, sum(times - 1) AS n_dup_lines, sum((times - 1) * length(line)) / sum(times * length(line)) AS dup_line_chars FROM l1 GROUP BY doc_id),
base AS (SELECT w.doc_id, len(words) AS n_words, word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
  coalesce(c.repeated, 0) AS n_repeat_words, coalesce(dup_line_chars, 0) AS dup_line_chars, coalesce(t.share, 0) AS top_share, coalesce(u.share, 0) AS dup_share, coalesce(t.broken, false) OR coalesce(u.broken, false) AS broken
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN cover c ON c.doc_id = w.doc_id AND c.n = {WINDOW} LEFT JOIN top t ON t.doc_id = w.doc_id LEFT JOIN dup u ON u.doc_id = w.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words,
  n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_word_percent} * n_words AS base_failed,
  NOT (n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_word_percent} * n_words OR broken OR (n_dup_lines > {rules.max_dup_line_share} * n_lines AND n_dup_lines > 2)
    OR dup_line_chars > {rules.max_dup_line_chars} OR n_symbols > {rules.max_symbols_per_word} * n_words) AS kept,
  round(top_share, 6) AS top_share, round(dup_share, 6) AS dup_share, round(dup_line_chars, 6) AS dup_line_chars
FROM base
"""
