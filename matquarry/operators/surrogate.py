"""Surrogate models: sparse Gaussian processes, and feature ranking by tree ensembles."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import shared
from . import attribution
from .features import exact_folds, regression_metrics

JITTER = 1e-6


def standardisation(table: DataFrame, columns: list[str]) -> tuple[list[float], list[float]]:
    """Means and population deviations of the columns in one pass; a deviation of 0 becomes 1."""
    row = table.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)), *(F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns))).first()
    n = len(columns)
    return [float(row[i] or 0.0) for i in range(n)], [float(row[n + i] or 1.0) for i in range(n)]


def kernel(a: np.ndarray, b: np.ndarray, length: float, amplitude: float, rq_length: float | None = None, alpha: float = 1.0) -> np.ndarray:
    """Product of a squared-exponential and a rational-quadratic kernel; ``rq_length`` is the latter's own scale, ``alpha`` its mixture."""
    square = np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)
    rational = (1 + square / (2 * alpha * (rq_length or length) ** 2)) ** -alpha
    return amplitude * np.exp(-square / (2 * length * length)) * rational


@dataclass
class Expert:
    """An exact Gaussian process, which the sparse one is held against."""

    x: np.ndarray
    alpha: np.ndarray
    factor: np.ndarray
    mean: float
    length: float
    amplitude: float
    noise: float
    rq_length: float | None = None

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, length: float, noise: float, rq_length: float | None = None) -> Expert:
        mean, amplitude = float(y.mean()), float(max(y.var(), 1e-6))
        k = kernel(x, x, length, amplitude, rq_length) + (noise * amplitude + JITTER) * np.eye(len(x))
        factor = np.linalg.cholesky(k)
        alpha = np.linalg.solve(factor.T, np.linalg.solve(factor, y - mean))
        return cls(x, alpha, factor, mean, length, amplitude, noise, rq_length)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mean, variance and prior variance of the latent value."""
        across = kernel(self.x, x, self.length, self.amplitude, self.rq_length)
        half = np.linalg.solve(self.factor, across)
        variance = np.maximum(self.amplitude - (half * half).sum(0), 1e-12)
        return self.mean + across.T @ self.alpha, variance, np.full(len(x), self.amplitude)


@dataclass
class SparseProcess:
    """A Gaussian process on inducing points: all rows count, in sums over the points.

    With every row as a point it is the exact process (``Expert``). ``weights`` are of the points' kernel values in the mean, ``root`` and
    ``inner`` the Cholesky factors of the points' own kernel and of I + root^-1 S root^-T / noise, where S sums the rows' outer products."""

    points: np.ndarray
    weights: np.ndarray
    root: np.ndarray
    inner: np.ndarray
    mean: float
    amplitude: float
    length: float
    rq_length: float
    shift: np.ndarray
    scale: np.ndarray

    @classmethod
    def solve(cls, points: np.ndarray, sums: Sums, setting: Setting, shift: np.ndarray, scale: np.ndarray) -> SparseProcess:
        mean = sums.y / max(sums.n, 1)
        amplitude = max(sums.yy / max(sums.n, 1) - mean * mean, 1e-6)
        root = np.linalg.cholesky(kernel(points, points, setting.length, 1.0, setting.rq_length) + JITTER * np.eye(len(points)))
        half = np.linalg.solve(root, np.linalg.solve(root, sums.outer).T)
        inner = np.linalg.cholesky(np.eye(len(points)) + (half + half.T) / (2 * setting.noise))
        target = np.linalg.solve(root, sums.cross - mean * sums.plain) / setting.noise
        weights = np.linalg.solve(root.T, np.linalg.solve(inner.T, np.linalg.solve(inner, target)))
        return cls(points, weights, root, inner, mean, amplitude, setting.length, setting.rq_length, shift, scale)

    def predict(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and variance of the latent value of unscaled rows."""
        across = kernel(self.points, (rows - self.shift) / self.scale, self.length, 1.0, self.rq_length)
        half = np.linalg.solve(self.root, across)
        left = np.linalg.solve(self.inner, half)
        variance = self.amplitude * np.maximum(1 - (half * half).sum(0) + (left * left).sum(0), 1e-12)
        return self.mean + across.T @ self.weights, variance


@dataclass(frozen=True)
class Setting:
    length: float
    rq_length: float
    noise: float


@dataclass
class Sums:
    """What a process needs of its rows: outer products of their kernel values at the points, these times the target, these alone, and the targets' moments."""

    outer: np.ndarray
    cross: np.ndarray
    plain: np.ndarray
    n: float
    y: float
    yy: float

    @classmethod
    def none(cls, m: int) -> Sums:
        return cls(np.zeros((m, m)), np.zeros(m), np.zeros(m), 0.0, 0.0, 0.0)

    def add(self, across: np.ndarray, y: np.ndarray) -> None:
        self.outer += across @ across.T
        self.cross += across @ y
        self.plain += across.sum(1)
        self.n, self.y, self.yy = self.n + len(y), self.y + y.sum(), self.yy + (y * y).sum()

    def without(self, other: Sums) -> Sums:
        return Sums(*(a - b for a, b in zip(self._parts(), other._parts())))

    def plus(self, other: Sums) -> Sums:
        return Sums(*(a + b for a, b in zip(self._parts(), other._parts())))

    def _parts(self) -> tuple:
        return self.outer, self.cross, self.plain, self.n, self.y, self.yy

    def packed(self) -> bytes:
        return np.concatenate([np.ravel(x) for x in self._parts()]).tobytes()

    @classmethod
    def unpacked(cls, data: bytes, m: int) -> Sums:
        v = np.frombuffer(data)
        return cls(v[: m * m].reshape(m, m), v[m * m : m * m + m], v[m * m + m : m * m + 2 * m], *v[m * m + 2 * m :].tolist())


DEFAULT_LENGTHS, DEFAULT_RQ_LENGTHS, DEFAULT_NOISES = (1.0, 2.0, 4.0), (1.0, 4.0), (1e-3, 1e-2)


def _modelled(table: DataFrame, columns: list[str], target: str, key: str) -> DataFrame:
    """(key, columns, __y): rows with whole features and a positive target, its log as ``__y``."""
    rows = table.where(F.col(target) > 0).select(key, *(F.col(c).cast("double").alias(c) for c in columns), F.log(F.col(target).cast("double")).alias("__y"))
    whole = F.forall(F.array(*columns), lambda v: v.isNotNull() & ~F.isnan(v))
    return rows.where(whole)


def inducing_points(rows: DataFrame, columns: list[str], m: int) -> np.ndarray:
    """At most ``m`` distinct rows' features, those of the least hash; what a driver holds of the table is bounded by ``m``."""
    distinct = rows.select(*columns).distinct()
    found = distinct.orderBy(F.xxhash64(*columns), *columns).limit(m).collect()
    return np.array([tuple(r) for r in found], float).reshape(len(found), len(columns))


def _sums(rows: DataFrame, columns: list[str], points: np.ndarray, kernels: list[tuple[float, float]], shift: np.ndarray, scale: np.ndarray, tasks: int) -> dict[tuple[int, int], Sums]:
    """Sums of each (kernel, fold), added up in every task first; ``rows`` have ``__y`` and ``fold``. They are as many as kernels times folds."""
    m = len(points)

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[tuple[int, int], Sums] = {}
        for frame in frames:
            x = (frame[columns].to_numpy(float) - shift) / scale
            y, folds = frame["__y"].to_numpy(float), frame["fold"].to_numpy()
            for k, (length, rq_length) in enumerate(kernels):
                across = kernel(points, x, length, 1.0, rq_length)
                for f in np.unique(folds):
                    found.setdefault((k, int(f)), Sums.none(m)).add(across[:, folds == f], y[folds == f])
        for (k, f), s in found.items():
            yield pd.DataFrame({"k": [k], "fold": [f], "data": [s.packed()]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        total = Sums.none(m)
        for data in pdf["data"]:
            total = total.plus(Sums.unpacked(data, m))
        return pd.DataFrame({"k": pdf["k"].iloc[:1], "fold": pdf["fold"].iloc[:1], "data": [total.packed()]})

    # no more tasks than asked for, so that what is merged stays small
    parts = rows.coalesce(tasks).mapInPandas(add, "k int, fold int, data binary").groupBy("k", "fold").applyInPandas(merge, "k int, fold int, data binary")
    return {(r["k"], r["fold"]): Sums.unpacked(bytes(r["data"]), m) for r in parts.collect()}


def _solved(spark: SparkSession, points: np.ndarray, jobs: list[tuple[Sums, Setting]], shift: np.ndarray, scale: np.ndarray) -> list[SparseProcess]:
    """The process of each job's sums, solved in tasks, whose linear algebra keeps to the cores they were given."""
    m = len(points)
    table = spark.createDataFrame([(i, s.packed(), t.length, t.rq_length, t.noise) for i, (s, t) in enumerate(jobs)], "i int, data binary, length double, rq_length double, noise double")

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                model = SparseProcess.solve(points, Sums.unpacked(bytes(r.data), m), Setting(r.length, r.rq_length, r.noise), shift, scale)
                yield pd.DataFrame({"i": [r.i], "model": [pickle.dumps(vars(model))]})

    return [SparseProcess(**pickle.loads(bytes(r["model"]))) for r in sorted(table.mapInPandas(solve, "i int, model binary").collect())]


def tune(
    table: DataFrame, columns: list[str], target: str, key: str, lengths: tuple[float, ...] = DEFAULT_LENGTHS, rq_lengths: tuple[float, ...] = DEFAULT_RQ_LENGTHS,
    noises: tuple[float, ...] = DEFAULT_NOISES, folds: int = 10, m: int = 128, seed: int = 42, tasks: int = 200,
) -> DataFrame:
    """(length, rq_length, noise, fold, n, r2, mae, rmse): cross-validation of each setting over all rows with a positive target.

    The log target is modelled by a sparse process. One pass adds up the rows of each fold for each kernel; a fold's process is solved from the
    sums of the others, and a second pass takes its errors on the fold. Both are linear in rows; noises need no sums of their own."""
    rows = exact_folds(_modelled(table, columns, target, key), key, folds, seed)
    return _cross_validated(shared.written(rows), columns, lengths, rq_lengths, noises, m, tasks)


def _cross_validated(rows: DataFrame, columns: list[str], lengths, rq_lengths, noises, m: int, tasks: int) -> DataFrame:
    shift, scale = map(np.array, standardisation(rows, columns))
    points = (inducing_points(rows, columns, m) - shift) / scale
    kernels = [(a, r) for a in lengths for r in rq_lengths]
    sums = _sums(rows, columns, points, kernels, shift, scale, tasks)
    jobs, names_of = [], []
    for k, (length, rq_length) in enumerate(kernels):
        own = {f: s for (j, f), s in sums.items() if j == k}
        total = Sums.none(len(points))
        for s in own.values():
            total = total.plus(s)
        for noise in noises:
            for f, s in own.items():
                setting = Setting(length, rq_length, noise)
                jobs.append((total.without(s), setting))
                names_of.append((setting, f))
    models = [(setting, f, model) for (setting, f), model in zip(names_of, _solved(rows.sparkSession, points, jobs, shift, scale))]

    def errors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = np.zeros((len(models), 5))
        for frame in frames:
            x, y, folds = frame[columns].to_numpy(float), frame["__y"].to_numpy(float), frame["fold"].to_numpy()
            for i, (_, f, model) in enumerate(models):
                mine = folds == f
                if mine.any():
                    e = model.predict(x[mine])[0] - y[mine]
                    found[i] += (mine.sum(), (e * e).sum(), abs(e).sum(), y[mine].sum(), (y[mine] ** 2).sum())
        yield pd.DataFrame([(s.length, s.rq_length, s.noise, f, *v) for (s, f, _), v in zip(models, found)], columns=[*names, "n", "sse", "sae", "y", "yy"])

    names = ["length", "rq_length", "noise", "fold"]
    schema = "length double, rq_length double, noise double, fold int, n double, sse double, sae double, y double, yy double"
    got = rows.mapInPandas(errors, schema).groupBy(*names).agg(*(F.sum(c).alias(c) for c in ("n", "sse", "sae", "y", "yy"))).where("n > 0")
    spread = F.col("yy") - F.col("y") * F.col("y") / F.col("n")
    return got.select(*names, F.col("n").cast("long").alias("n"), F.when(spread > 1e-12, 1 - F.col("sse") / spread).alias("r2"), (F.col("sae") / F.col("n")).alias("mae"), F.sqrt(F.col("sse") / F.col("n")).alias("rmse"))


def best_setting(validated: DataFrame) -> Setting | None:
    """The setting of the highest mean r2 over its folds, ties to the first in order."""
    names = ("length", "rq_length", "noise")
    row = validated.groupBy(*names).agg(F.avg("r2").alias("r2")).orderBy(F.col("r2").desc_nulls_last(), *names).first()
    return Setting(*(row[c] for c in names)) if row else None


@dataclass
class Trained:
    """A fitted surrogate: the process, its setting, the cross-validation it was chosen by, and its report on rows it has not seen."""

    model: SparseProcess
    setting: Setting
    validated: DataFrame
    report: DataFrame


def train(
    table: DataFrame, columns: list[str], target: str, key: str, lengths: tuple[float, ...] = DEFAULT_LENGTHS, rq_lengths: tuple[float, ...] = DEFAULT_RQ_LENGTHS,
    noises: tuple[float, ...] = DEFAULT_NOISES, folds: int = 10, m: int = 128, fit_m: int = 512, seed: int = 42, tasks: int = 200,
) -> Trained:
    """Choose a setting, fit it, and report on a tenth of the rows, which neither step sees.

    The other nine tenths are cross-validated on ``m`` inducing points; the best setting is fitted to all of them on ``fit_m`` points. The report is one row:
    n_train, n_test, cv_r2, r2_log, r2, mae and rmse, the last three of the target itself. Raises ValueError for fewer than two usable rows."""
    split = shared.written(exact_folds(_modelled(table, columns, target, key), key, 10, seed).withColumnRenamed("fold", "__tenth"))
    rows, test = split.where("__tenth > 0").drop("__tenth"), split.where("__tenth = 0").drop("__tenth")
    rows = shared.written(exact_folds(rows, key, folds, seed + 1))
    if rows.count() < 2:
        raise ValueError("a surrogate needs two rows with whole features and a positive target")
    validated = shared.written(_cross_validated(rows, columns, lengths, rq_lengths, noises, m, tasks))
    setting = best_setting(validated)
    shift, scale = map(np.array, standardisation(rows, columns))
    points = (inducing_points(rows, columns, fit_m) - shift) / scale
    sums = _sums(rows.withColumn("fold", F.lit(0)), columns, points, [(setting.length, setting.rq_length)], shift, scale, tasks)
    model = _solved(rows.sparkSession, points, [(sums[0, 0], setting)], shift, scale)[0]
    guessed = predict(test, model, columns, key).select("__y", "mu_log", F.exp("__y").alias("truth"), "k_pred")
    report = regression_metrics(guessed, "truth", "k_pred").withColumnRenamed("n", "n_test")
    logs = regression_metrics(guessed, "__y", "mu_log").select(F.col("r2").alias("r2_log"))
    chosen = validated.where((F.col("length") == setting.length) & (F.col("rq_length") == setting.rq_length) & (F.col("noise") == setting.noise))
    cv = chosen.agg(F.avg("r2").alias("cv_r2"))
    report = report.join(F.broadcast(logs)).join(F.broadcast(cv)).withColumn("n_train", F.lit(rows.count()))  # one row each
    return Trained(model, setting, validated, report.select("n_train", "n_test", "cv_r2", "r2_log", "r2", "mae", "rmse"))


def predict(candidates: DataFrame, model: SparseProcess, columns: list[str], key: str) -> DataFrame:
    """``candidates`` with mu_log, sigma_log, k_pred, k_lower and k_upper; rows with a null or NaN feature get nulls. Linear in rows, no shuffle."""
    @F.pandas_udf("mu double, sigma double")
    def guess(features: pd.Series) -> pd.DataFrame:
        x = np.array([np.asarray(v, float) for v in features]).reshape(len(features), len(columns))
        known = np.isfinite(x).all(1)
        mu, variance = np.full(len(x), np.nan), np.full(len(x), np.nan)
        if known.any():
            mu[known], variance[known] = model.predict(x[known])
        return pd.DataFrame({"mu": mu, "sigma": np.sqrt(variance)})

    made = candidates.drop("mu_log", "sigma_log", "k_pred", "k_lower", "k_upper").withColumn("__p", guess(F.array(*(F.col(c).cast("double") for c in columns))))
    mu, sigma = (F.when(~F.isnan(c), F.col(c)) for c in ("__p.mu", "__p.sigma"))
    scored = made.withColumns({"mu_log": mu, "sigma_log": sigma, "k_pred": F.exp(mu), "k_lower": F.exp(mu - 1.96 * sigma), "k_upper": F.exp(mu + 1.96 * sigma)})
    return scored.drop("__p")


def _ensemble(method: str, seed: int):
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    if method == "gradient_boosting":
        return GBTRegressor(featuresCol="__v", labelCol="__y", predictionCol="__g", maxIter=20, maxDepth=4, seed=seed)
    return RandomForestRegressor(featuresCol="__v", labelCol="__y", predictionCol="__g", numTrees=40, maxDepth=6, seed=seed)


def rank_features(
    table: DataFrame, columns: list[str], target: str, key: str, method: str = "gradient_boosting", seed: int = 42
) -> DataFrame:
    """(feature, importance, rank): mean absolute attribution over all rows, of an ensemble fitted on four fifths of them."""
    return attribution.importance(explain_rows(table, columns, target, key, method, seed))


def explain_rows(table: DataFrame, columns: list[str], target: str, key: str, method: str = "gradient_boosting", seed: int = 42) -> DataFrame:
    """(key, base, prediction, feature, value, attribution) of every row, by an ensemble for the log target fitted on four fifths of them."""
    from pyspark.ml.feature import VectorAssembler

    rows = shared.written(exact_folds(_modelled(table, columns, target, key), key, 5, seed))
    model = _ensemble(method, seed).fit(VectorAssembler(inputCols=columns, outputCol="__v").transform(rows.where("fold > 0")))
    return attribution.explain(rows, model, columns, key)


def feature_curve(
    table: DataFrame, ranked: list[str], target: str, key: str, method: str = "random_forest", folds: int = 3, most: int | None = None, seed: int = 42
) -> DataFrame:
    """(n_features, n, r2, mae, rmse): cross-validated metrics of the first 1..n features."""
    from pyspark.ml.feature import VectorAssembler

    rows = exact_folds(table.select(key, *(F.col(c).cast("double").alias(c) for c in ranked), F.log(target).alias("__y")), key, folds, seed).dropna()
    rows = shared.written(rows)
    parts = []
    for n in range(1, min(most or len(ranked), len(ranked)) + 1):
        assembled = VectorAssembler(inputCols=ranked[:n], outputCol="__v").transform(rows)
        for fold in range(folds):
            model = _ensemble(method, seed).fit(assembled.where(F.col("fold") != fold))
            parts.append(model.transform(assembled.where(F.col("fold") == fold)).select(F.lit(n).alias("n_features"), "__y", "__g"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionAll(p)
    return regression_metrics(every, "__y", "__g", ["n_features"])


def best_count(curve: DataFrame, metric: str = "rmse", least: int = 1, most: int | None = None) -> int:
    """Number of features with the best metric (highest r2, lowest mae or rmse), ties to fewer, clamped."""
    order = F.col(metric).desc() if metric == "r2" else F.col(metric)
    row = curve.orderBy(order, "n_features").first()
    n = max(least, row["n_features"] if row else least)
    return min(n, most) if most else n


def compare_sets(table: DataFrame, sets: dict[str, list[str]], target: str, key: str, folds: int = 3, seed: int = 42) -> DataFrame:
    """(feature_set, n_features, n, r2, mae, rmse, best): cross-validated metrics of each feature set; best by mae, rmse, count."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.sql import Window

    columns = list(dict.fromkeys(c for s in sets.values() for c in s))
    rows = exact_folds(table.select(key, *(F.col(c).cast("double").alias(c) for c in columns), F.log(target).alias("__y")), key, folds, seed).dropna()
    rows = shared.written(rows)
    every = None
    for name, chosen in sets.items():
        assembled = VectorAssembler(inputCols=chosen, outputCol="__v").transform(rows)
        for fold in range(folds):
            model = _ensemble("random_forest", seed).fit(assembled.where(F.col("fold") != fold))
            part = model.transform(assembled.where(F.col("fold") == fold)).select(F.lit(name).alias("feature_set"), F.lit(len(chosen)).alias("n_features"), "__y", "__g")
            every = part if every is None else every.unionAll(part)
    metrics = regression_metrics(every, "__y", "__g", ["feature_set", "n_features"])
    order = Window.orderBy("mae", "rmse", "n_features", "feature_set")
    return metrics.withColumn("best", F.row_number().over(order) == 1)
