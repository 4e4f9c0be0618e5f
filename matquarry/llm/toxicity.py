"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are all words of the labelled examples, lower-cased; none is left out, and document frequencies come from all documents.
A term's weight in a text is its TF-IDF times how well it tells the labels apart: a power of its log-likelihood
ratio, and a little for every term. By TF-IDF alone the nearest of a long text are those of its subject, not of its
tone. The examples' vectors lie in an inverted index cut into blocks of consecutive examples, with the largest weight of each
term in each block. A search bounds every block by the query's weights times those
maxima, visits the quarter with the highest bounds, then those whose bound still reaches
the k-th best similarity: its result is exact. Neighbours vote by their similarity;
the votes, calibrated on examples scored without themselves, are the score, and the
neighbours are its evidence.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, labelled_sample, map_batches, rewritten

STRIP = ".,;:!?()[]{}\"'«»…"
#: Added to each log-likelihood ratio, so that terms that tell nothing weigh something; the power that is taken of the sum.
LITTLE, POWER = 0.01, 0.75
Vector = tuple[np.ndarray, np.ndarray]


def words(text: str) -> set[str]:
    """The words of a text, as terms."""
    return {w.strip(STRIP) for w in set(text.lower().split())} - {""}


class Counts:
    """Term counts of texts over a vocabulary: (terms in order, times)."""

    def __init__(self, vocabulary: list[str]) -> None:
        self.number = {t: i for i, t in enumerate(vocabulary)}

    def __call__(self, text: str) -> Vector:
        number_of, found = self.number.get, {}
        for word, n in Counter(text.lower().split()).items():
            i = number_of(word.strip(STRIP))
            if i is not None:
                found[i] = found.get(i, 0) + n
        terms = np.fromiter(found, np.int64, len(found))
        order = np.argsort(terms)
        return terms[order], np.fromiter(found.values(), np.int64, len(found))[order]


def term_statistics(sample: DataFrame) -> DataFrame:
    """(term, positive, negative): labelled texts of either label that hold each term."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1)):
                counts[label.as_py()].update(words(text.as_py()))
            if len(counts[0]) + len(counts[1]) > 500_000:
                yield flush(counts)
        yield flush(counts)

    def flush(counts: tuple[Counter, Counter]) -> pa.RecordBatch:
        terms = [*counts[1].keys(), *counts[0].keys()]
        positive = [*counts[1].values(), *([0] * len(counts[0]))]
        negative = [*([0] * len(counts[1])), *counts[0].values()]
        for c in counts:
            c.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(terms, pa.string()), pa.array(positive, pa.int64()), pa.array(negative, pa.int64())],
            names=["term", "positive", "negative"],
        )

    rows = sample.select("text", "label").mapInArrow(run, "term string, positive long, negative long")
    return rows.groupBy("term").agg(F.sum("positive").alias("positive"), F.sum("negative").alias("negative"))


def likelihood_ratios(positive: np.ndarray, negative: np.ndarray, n_positive: int, n_negative: int) -> np.ndarray:
    """Log-likelihood ratio of each term: how far its shares of either label's texts are from one share of all."""

    def part(observed: np.ndarray, expected: np.ndarray) -> np.ndarray:
        some = observed > 0
        return np.where(some, observed * np.log(np.where(some, observed, 1) / np.where(some, expected, 1)), 0.0)

    share = (positive + negative) / (n_positive + n_negative)
    cells = ((positive, n_positive), (negative, n_negative))
    ratio = 2 * sum(part(seen, share * n) + part(n - seen, (1 - share) * n) for seen, n in cells)
    return np.maximum(np.round(ratio, 9), 0.0)


def document_frequencies(docs: DataFrame, vocabulary: Broadcast, text_col: str = "text") -> tuple[int, np.ndarray]:
    """(rows of ``docs``, how many of their texts hold each term), over all of them."""
    size = len(vocabulary.value)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        counts, total, rows = Counts(vocabulary.value), np.zeros(size + 1, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                total[counts(text.as_py())[0]] += 1
                rows += 1
        total[-1] = rows
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["term", "n"])

    texts = docs.select(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    summed = texts.mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size + 1, np.int64)
    out[summed["term"].to_numpy()] = summed["n"].to_numpy()
    return int(out[-1]), out[:-1]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, … of every range, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


@dataclass
class BlockMaxIndex:
    """Inverted index of unit vectors in blocks of ``block`` consecutive examples.

    Postings are ordered by term, then example. A cell is a term in a block that has it: those of term t are
    ``term_cells[t]`` to ``term_cells[t + 1]``; cell c lies in block ``cell_block[c]``, its largest weight is ``cell_most[c]``, and
    its postings are ``cell_start[c]`` to ``cell_start[c + 1]``. ``rank`` orders the examples by id; examples of one
    ``twin`` number have equal vectors. ``weight`` is what a term's TF is multiplied with."""

    ids: list
    rank: np.ndarray
    labels: np.ndarray
    twin: np.ndarray
    weight: np.ndarray
    examples: np.ndarray
    weights: np.ndarray
    term_cells: np.ndarray
    cell_block: np.ndarray
    cell_most: np.ndarray
    cell_start: np.ndarray

    @classmethod
    def build(cls, ids: list, labels: list[int], vectors: list[Vector], weight: np.ndarray, block: int = 64) -> BlockMaxIndex:
        """Index of vectors that are not empty, ``ids`` in their order."""
        # examples that share their heaviest term stand together, which makes block bounds tight
        order = sorted(range(len(ids)), key=lambda i: (int(vectors[i][0][vectors[i][1].argmax()]), i))
        sizes = [len(vectors[i][0]) for i in order]
        terms = np.concatenate([vectors[i][0] for i in order] or [np.zeros(0, np.int64)])
        weights = np.concatenate([vectors[i][1] for i in order] or [np.zeros(0)])
        examples = np.repeat(np.arange(len(order)), sizes)
        by_term = np.lexsort((examples, terms))
        terms, examples, weights = terms[by_term], examples[by_term], weights[by_term]
        blocks = -(-len(ids) // block) or 1
        cells, start = np.unique(terms * blocks + examples // block, return_index=True)
        most = np.maximum.reduceat(weights, start) if len(start) else np.zeros(0)
        term_cells = np.searchsorted(cells, np.arange(len(weight) + 1) * blocks)
        twins: dict[tuple, int] = {}
        twin = np.array([twins.setdefault((vectors[i][0].tobytes(), vectors[i][1].tobytes()), len(twins)) for i in order], np.int64)
        return cls(
            [ids[i] for i in order], np.array(order, np.int64), np.array([labels[i] for i in order], np.int64), twin, weight,
            examples, weights, term_cells, cells % blocks, most, np.append(start, len(weights)),
        )

    def vector(self, counts: Vector) -> Vector:
        """Unit vector of term counts; empty without terms."""
        terms, times = counts
        raw = (1 + np.log(times)) * self.weight[terms]
        return terms, raw / math.sqrt(raw @ raw) if len(raw) else raw

    def nearest(self, vector: Vector, k: int, without: int = -1) -> list[tuple[float, int]]:
        """(similarity, example) of the k nearest examples that share a term, ties to the smaller id; none of the twin ``without``."""
        terms, query = vector
        if not len(terms) or not self.ids:
            return []
        begin = self.term_cells[terms]
        size = self.term_cells[terms + 1] - begin
        cells, query = _ranges(begin, size), np.repeat(query, size)
        within = self.cell_block[cells]
        bound = np.bincount(within, query * self.cell_most[cells])
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        best_s, best_e = np.zeros(0), np.zeros(0, np.int64)
        taken, rest = np.split(order, [max(8, len(bound) // 4)])
        while len(taken):
            visited = np.zeros(len(bound), bool)
            visited[taken] = True
            held = visited[within]
            begin = self.cell_start[cells[held]]
            size = self.cell_start[cells[held] + 1] - begin
            spots = _ranges(begin, size)
            sums = np.bincount(self.examples[spots], self.weights[spots] * np.repeat(query[held], size), len(self.ids))
            found = np.flatnonzero(sums)
            if without >= 0:
                found = found[self.twin[found] != without]
            near = np.round(sums[found], 12)
            if len(near) > k:
                keep = near >= np.partition(near, len(near) - k)[len(near) - k]
                found, near = found[keep], near[keep]
            best_s, best_e = np.concatenate([best_s, near]), np.concatenate([best_e, found])
            first = np.lexsort((self.rank[best_e], -best_s))[:k]
            best_s, best_e = best_s[first], best_e[first]
            if len(best_s) == k:
                rest = rest[bound[rest] >= best_s[-1] - 1e-9]
            taken, rest = rest, rest[:0]
        return list(zip(best_s.tolist(), best_e.tolist()))


@dataclass
class Model:
    """Index, shares of label 1 among all examples and among those without a term, and the calibration."""

    vocabulary: list[str]
    index: BlockMaxIndex
    share: float
    share_without: float
    slope: float
    shift: float
    k: int

    def vote(self, found: list[tuple[float, int]]) -> float:
        """Votes weighted by similarity squared, with the share of all examples as one faint vote."""
        weight = sum(s * s for s, _ in found)
        return (sum(s * s * self.index.labels[e] for s, e in found) + 0.1 * self.share) / (weight + 0.1)

    def score(self, found: list[tuple[float, int]]) -> float:
        if not found:
            return self.share_without
        return float(1 / (1 + math.exp(-(self.slope * _logit(self.vote(found)) + self.shift))))


def _logit(p: float) -> float:
    p = min(max(p, 1e-4), 1 - 1e-4)
    return math.log(p / (1 - p))


def platt(votes: np.ndarray, labels: np.ndarray, penalty: float = 1.0) -> tuple[float, float]:
    """Slope and shift of the logistic calibration of votes; near 1 and 0 where there is little to fit."""
    slope, shift = 1.0, 0.0
    x = np.array([_logit(v) for v in votes])
    for _ in range(25 if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(slope * x + shift, -30, 30)))
        g = np.array([((labels - p) * x).sum() - penalty * (slope - 1), (labels - p).sum() - penalty * shift])
        w = p * (1 - p)
        h = np.array([[(w * x * x).sum() + penalty, (w * x).sum()], [(w * x).sum(), w.sum() + penalty]])
        step = np.linalg.solve(h, g)
        slope, shift = slope + step[0], shift + step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(slope, 0.1)), float(shift)


def train(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "toxic",
    fit_rows: int = 3000,
    k: int = 15,
    calibration_rows: int = 2000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Model:
    """Index of at most ``fit_rows`` labelled rows that are not held out, one row an id.

    The votes are calibrated on some ``calibration_rows`` of them with different vectors, spread evenly over their order, each scored
    without the examples of its own vector. What reaches the driver are the term counts of ``fit_rows`` texts; texts do not."""
    sample = rewritten(labelled_sample(docs, labels, label_col, fit_rows, id_col, text_col))
    totals = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    positive, negative = totals.get(1, 0), totals.get(0, 0)
    told = (term_statistics(sample) if positive and negative else term_statistics(sample).limit(0)).toArrow().sort_by("term")
    vocabulary = told["term"].to_pylist()
    ratios = likelihood_ratios(told["positive"].to_numpy(), told["negative"].to_numpy(), positive, negative) if vocabulary else np.zeros(0)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows, frequency = document_frequencies(docs, shared, text_col) if vocabulary else (0, np.zeros(0, np.int64))
    weight = (np.log((rows + 1) / (frequency + 1)) + 1) * (ratios + LITTLE) ** POWER
    keyed = sample.select(F.struct("doc_id", "label").alias("key"), "text")

    def per_task():
        counts = Counts(shared.value)

        def work(texts: list[str]) -> tuple:
            found = [counts(t) for t in texts]
            return [t.tobytes() for t, _ in found], [n.tobytes() for _, n in found]

        return work

    counted = map_batches(keyed, "key", "text", "terms binary, times binary", per_task, encoded=False)
    examples = sorted(
        ((r["doc_id"]["doc_id"], r["doc_id"]["label"], (np.frombuffer(r["terms"], np.int64), np.frombuffer(r["times"], np.int64))) for r in counted.collect()),
        key=lambda r: r[:2],
    )
    held = [e for e in examples if len(e[2][0])]
    empty = BlockMaxIndex.build([], [], [], weight)
    index = BlockMaxIndex.build([e[0] for e in held], [e[1] for e in held], [empty.vector(e[2]) for e in held], weight)
    bare = [e[1] for e in examples if not len(e[2][0])]
    share = (positive + 0.5) / (positive + negative + 1)
    model = Model(vocabulary, index, share, (sum(bare) + share) / (len(bare) + 1), 1.0, 0.0, k)
    _, tried = np.unique(index.twin, return_index=True)
    tried = tried[:: max(1, len(tried) // calibration_rows)].tolist()
    own = ((i, held[index.rank[i]]) for i in tried)
    votes = [(model.vote(index.nearest(index.vector(e[2]), k, int(index.twin[i]))), e[1]) for i, e in own]
    model.slope, model.shift = platt(np.array([v for v, _ in votes]), np.array([y for _, y in votes], float))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", evidence: int = 3) -> DataFrame:
    """(doc_id, score, evidence array<struct<doc_id, similarity, label>>) for each row of ``docs``.

    Texts without any word of the examples, null and empty ones among them, score the
    smoothed share of label 1 among such examples and have no evidence. Repeated rows
    return equal rows; ids may be null; other columns are ignored; an empty table gives
    an empty result. The index is broadcast: the texts of ``fit_rows`` rows bound it."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def per_task():
        own = shared.value
        counts, index = Counts(own.vocabulary), own.index

        def one(text: str) -> tuple[float, list]:
            found = index.nearest(index.vector(counts(text)), own.k)
            seen = [{"doc_id": index.ids[e], "similarity": s, "label": int(index.labels[e])} for s, e in found[:evidence]]
            return own.score(found), seen

        return lambda texts: zip(*map(one, texts))

    id_type = docs.select(F.col(f"`{id_col}`")).schema[0].dataType.simpleString()
    schema = f"score double, evidence array<struct<doc_id: {id_type}, similarity: double, label: int>>"
    return map_batches(docs, id_col, text_col, schema, per_task, encoded=False)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence): ``train`` on the labels, then ``score`` every row of ``docs``."""
    scored = score(docs, train(docs, labels, **options))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence"
    )
