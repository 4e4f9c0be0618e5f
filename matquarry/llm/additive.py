"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins; boosting visits the features in turn and fits
a tree of a few leaves to the gradients of one feature at a time, adding its leaves to
that feature's lookup table. Then pairs of features that explain the most of what is left
get tables over coarse bins of both, boosted the same way. A score is the sum of one table
entry a feature and a pair, through the logistic function.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, labelled_sample, map_batches

FEATURES = (
    "log_words", "word_length", "symbols_per_word", "marked_words", "upper_share", "exclaims_per_word", "bars_per_word",
    "digit_share", "distinct_share", "stutter_share", "top_word_share", "repeat_pair_share", "words_per_line",
    "dup_line_share", "stops_per_word", "commas_per_word", "capital_share", "non_ascii_share",
)
SYMBOLS = b"#*$%&|<>"
MARKS = tuple("#*$%&!|")


def features(text: bytes) -> list[float]:
    """Measures of one whole text; a text without words has zeros."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    decoded = text.decode("utf-8", "replace")
    size = len(text)
    counts = Counter(words)
    pairs = Counter(zip(words, words[1:]))
    lines = [x for x in text.split(b"\n") if x.strip()]
    letters = sum(map(str.isalpha, decoded)) if not text.isascii() else size - len(text.translate(None, _LETTERS))
    upper = size - len(text.translate(None, _UPPER))
    ends = [w[-1:] for w in words]
    return [
        math.log1p(n),
        sum(map(len, words)) / n,
        (size - len(text.translate(None, SYMBOLS))) / n,
        sum(e in _MARKS for e in ends) / n,
        upper / max(1, letters),
        text.count(b"!") / n,
        text.count(b"|") / n,
        (size - len(text.translate(None, b"0123456789"))) / size,
        len(counts) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        max(counts.values()) / n,
        sum(c for c in pairs.values() if c > 1) / n,
        n / len(lines),
        1 - len(set(lines)) / len(lines),
        text.count(b".") / n,
        text.count(b",") / n,
        sum(w[:1].isupper() for w in words) / n,
        (size - len(decoded)) / size,
    ]


_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_MARKS = {m.encode() for m in MARKS}


@dataclass
class Model:
    """Cuts and lookup tables. ``pairs``: (feature, feature, coarse cuts of each, table)."""

    start: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]

    def margins(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for j, (cuts, table) in enumerate(zip(self.cuts, self.tables)):
            total += table[np.searchsorted(cuts, x[:, j], side="right")]
        for i, j, of_i, of_j, table in self.pairs:
            total += table[np.searchsorted(of_i, x[:, i], side="right"), np.searchsorted(of_j, x[:, j], side="right")]
        return total

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -35, 35)))


def quantile_cuts(values: np.ndarray, bins: int) -> np.ndarray:
    """Cut points between bins of about equal counts, at distinct values."""
    return np.unique(np.quantile(values, np.arange(1, bins) / bins, method="inverted_cdf")) if len(values) else np.array([])


def _leaf(g: np.ndarray, h: np.ndarray, penalty: float) -> np.ndarray:
    return g / (h + penalty)


def best_split(g: np.ndarray, h: np.ndarray, penalty: float) -> tuple[float, int]:
    """(gain, bins on the left) of the best cut of a row of bins."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(left_g):
        return 0.0, 0
    gain = left_g**2 / (left_h + penalty) + (g.sum() - left_g) ** 2 / (h.sum() - left_h + penalty) - g.sum() ** 2 / (h.sum() + penalty)
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def tree_on_bins(g: np.ndarray, h: np.ndarray, penalty: float, leaves: int = 3) -> np.ndarray:
    """Values of the bins under a tree of a few leaves over one feature."""
    spans = [(0, len(g))]
    while len(spans) < leaves:
        options = [(*best_split(g[a:b], h[a:b], penalty), i) for i, (a, b) in enumerate(spans)]
        gain, cut, i = max(options, key=lambda o: o[0])
        if gain <= 1e-9:
            break
        a, b = spans[i]
        spans[i : i + 1] = [(a, a + cut), (a + cut, b)]
    out = np.zeros(len(g))
    for a, b in spans:
        out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum(), penalty)
    return out


def tree_on_pair(g: np.ndarray, h: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """Values of the cells under the best tree that cuts one feature, then the other on each side; and its gain."""
    best, value = -1.0, np.zeros_like(g)
    for turned in (False, True):
        gg, hh = (g.T, h.T) if turned else (g, h)
        for cut in range(1, len(gg)):
            gain, out = 0.0, np.zeros_like(gg)
            for part in (slice(0, cut), slice(cut, None)):
                rows_g, rows_h = gg[part].sum(axis=0), hh[part].sum(axis=0)
                inner, at = best_split(rows_g, rows_h, penalty)
                gain += inner + rows_g.sum() ** 2 / (rows_h.sum() + penalty)
                out[part, :at] = _leaf(rows_g[:at].sum(), rows_h[:at].sum(), penalty)
                out[part, at:] = _leaf(rows_g[at:].sum(), rows_h[at:].sum(), penalty)
            if gain > best:
                best, value = gain, out.T if turned else out
    return value, best - g.sum() ** 2 / (h.sum() + penalty)


def fit(
    x: np.ndarray, y: np.ndarray, bins: int = 32, pair_bins: int = 6, n_pairs: int = 6,
    rounds: int = 80, pair_rounds: int = 25, rate: float = 0.15, penalty: float = 2.0,
) -> Model:
    """Fit to bounded samples; without rows of both labels the score is the smoothed share of label 1."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Model(math.log(share / (1 - share)), [quantile_cuts(x[:, j], bins) for j in range(x.shape[1])], [], [])
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    if not 0 < y.sum() < len(y):
        return model
    where = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.cuts)]
    margin = np.full(len(y), model.start)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for at, table in zip(where, model.tables):
            g, h = slopes()
            step = rate * tree_on_bins(np.bincount(at, g, len(table)), np.bincount(at, h, len(table)), penalty)
            table += step
            margin += step[at]
    coarse = [quantile_cuts(x[:, j], pair_bins) for j in range(x.shape[1])]
    cell = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(coarse)]

    def sums(i: int, j: int, v: np.ndarray) -> np.ndarray:
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        return np.bincount(cell[i] * shape[1] + cell[j], v, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    every = [(tree_on_pair(sums(i, j, g), sums(i, j, h), penalty)[1], i, j) for i in range(x.shape[1]) for j in range(i)]
    for _, i, j in sorted(every, reverse=True)[:n_pairs]:
        model.pairs.append((i, j, coarse[i], coarse[j], np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))))
    for _ in range(pair_rounds):
        for i, j, _, _, table in model.pairs:
            g, h = slopes()
            step = rate * tree_on_pair(sums(i, j, g), sums(i, j, h), penalty)[0]
            table += step
            margin += step[cell[i], cell[j]]
    return model


def train(
    docs: DataFrame, labels: DataFrame, label_col: str = "quality", fit_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text"
) -> Model:
    """Fit on at most ``fit_rows`` labelled rows that are not held out; only their features reach the driver."""
    sample = labelled_sample(docs, labels, label_col, fit_rows, id_col, text_col)
    joined = sample.select(F.struct("doc_id", "label").alias("key"), "text")
    rows = map_batches(joined, "key", "text", "x array<double>", lambda: lambda texts: ([features(t) for t in texts],)).select(
        "doc_id.doc_id", "doc_id.label", "x"
    )
    rows = rows.toPandas().sort_values(["doc_id", "label"], kind="stable")
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), len(FEATURES))
    return fit(x, rows["label"].to_numpy(float))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): probability of label 1 for each row of ``docs``.

    Null and empty texts are scored as texts without words. Repeated rows return equal
    scores; ids may be null; other columns are ignored; an empty table gives an empty result."""

    def work(texts: list[bytes]) -> tuple:
        return (model.scores(np.array([features(t) for t in texts]).reshape(len(texts), -1)),)

    return map_batches(docs, id_col, text_col, "score double", lambda: work)


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", threshold: float = 0.3, fit_rows: int = 20_000) -> DataFrame:
    """(doc_id, held_out, score, predicted): ``train`` on the labels, then ``score`` every row of ``docs``."""
    scored = score(docs, train(docs, labels, label_col, fit_rows))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
