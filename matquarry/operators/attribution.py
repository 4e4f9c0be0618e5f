"""Exact attribution of tree ensembles' predictions to their features.

A row's attribution to a feature is its Shapley value where a tree with some features unknown predicts by its nodes' shares of
rows: at a split on an unknown feature both branches count, by their rows. A leaf contributes to the features on its path only. With z
the product of the row shares of a feature's splits on the path, and o 1 where the row passes them all, else 0, the
leaf is worth the product of o or z over its features, times its value; the Shapley weights of the subsets are read off the
coefficients of the polynomial product of z + o t over the other features. This is done for all rows of a batch at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import shared


@dataclass
class Leaf:
    """A leaf's value, weighted by its tree; for each feature on its path, the interval that passes and the share of rows that go there."""

    value: float
    features: list[int]
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray


def leaves(model) -> list[Leaf]:
    """The leaves of a fitted Spark ML tree ensemble for regression, from its saved node table: as many as the ensemble's parameters allow."""
    session = SparkSession.active()
    place = shared.new_place(session)
    model.save(place)
    trees: dict[int, dict[int, tuple]] = {}
    for r in session.read.parquet(f"{place}/data").select("treeID", "nodeData.*").collect():
        trees.setdefault(r["treeID"], {})[r["id"]] = r
    weights = list(model.treeWeights)
    averaged = type(model).__name__.startswith("RandomForest")
    out: list[Leaf] = []
    for tree, nodes in sorted(trees.items()):
        weight = weights[tree] / (sum(weights) if averaged else 1.0)
        stack: list[tuple[int, dict[int, tuple[float, float, float]]]] = [(0, {})]
        while stack:
            at, path = stack.pop()
            node = nodes[at]
            if node["leftChild"] < 0:
                names = sorted(path)
                low, high, share = (np.array([path[f][i] for f in names]) for i in range(3))
                out.append(Leaf(weight * node["prediction"], names, low, high, share))
                continue
            split = node["split"]
            feature, cut = split["featureIndex"], split["leftCategoriesOrThreshold"][0]
            low, high, share = path.get(feature, (-math.inf, math.inf, 1.0))
            for child, bounds in ((node["leftChild"], (low, min(high, cut))), (node["rightChild"], (max(low, cut), high))):
                stack.append((child, {**path, feature: (*bounds, share * nodes[child]["rawCount"] / node["rawCount"])}))
    return out


def expected(found: list[Leaf]) -> float:
    """The prediction with every feature unknown."""
    return float(sum(leaf.value * np.prod(leaf.share) for leaf in found))


def predictions(found: list[Leaf], x: np.ndarray) -> np.ndarray:
    """What the ensemble predicts: the values of the leaves that a row reaches. A row passes low < x <= high."""
    out = np.zeros(len(x))
    for leaf in found:
        own = x[:, leaf.features]
        out += leaf.value * ((own > leaf.low) & (own <= leaf.high)).all(1)
    return out


def attributions(found: list[Leaf], x: np.ndarray) -> np.ndarray:
    """Rows by features: with ``expected`` they add up to the predictions."""
    out = np.zeros(x.shape)
    for leaf in found:
        d = len(leaf.features)
        if not d:
            continue
        own = x[:, leaf.features]
        passes = ((own > leaf.low) & (own <= leaf.high)).astype(float)
        subsets = np.array([math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d) for k in range(d)])
        for i in range(d):
            poly = np.zeros((len(x), d))  # coefficient of t^k: subsets of k known features
            poly[:, 0] = 1.0
            for j in range(d):
                if j != i:
                    poly[:, 1:] = poly[:, 1:] * leaf.share[j] + poly[:, :-1] * passes[:, j : j + 1]
                    poly[:, 0] *= leaf.share[j]
            out[:, leaf.features[i]] += leaf.value * (passes[:, i] - leaf.share[i]) * (poly @ subsets)
    return out


def explain(rows: DataFrame, model, columns: list[str], key: str) -> DataFrame:
    """(key, base, prediction, feature, value, attribution): a row for each row and feature; base and the attributions add up to the prediction.

    ``model`` is a regression ensemble over ``columns`` in this order. Rows with a null or NaN in a column are left out."""
    found = leaves(model)
    base, n = expected(found), len(columns)
    kept = rows.select(key, F.array(*(F.col(c).cast("double") for c in columns)).alias("x"))
    kept = kept.where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 1000):
                part = frame.iloc[at : at + 1000]
                x = np.array(part["x"].tolist(), float).reshape(len(part), n)
                phi = attributions(found, x)
                yield pd.DataFrame(
                    {
                        key: np.repeat(part[key].to_numpy(), n), "base": base, "prediction": np.repeat(predictions(found, x), n),
                        "feature": np.tile(columns, len(part)), "value": x.ravel(), "attribution": phi.ravel(),
                    }
                )

    kind = rows.schema[key].dataType.simpleString()
    return kept.mapInPandas(run, f"`{key}` {kind}, base double, prediction double, feature string, value double, attribution double")


def importance(explained: DataFrame) -> DataFrame:
    """(feature, importance, rank): mean absolute attribution over all rows, ties by name."""
    means = explained.groupBy("feature").agg(F.avg(F.abs("attribution")).alias("importance"))
    return means.withColumn("rank", F.row_number().over(Window.orderBy(F.col("importance").desc(), "feature")))  # a row a feature
