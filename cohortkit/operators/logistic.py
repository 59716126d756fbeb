"""Logistic regression (M2) by Newton's method, many fits in one pass.

A fit is a strength of regularization and the fold it must not see.  Every iteration is
one job: each task adds up the loss, gradient and Hessian of all fits over its rows
(a few hundred numbers a fit, whatever the rows), the sums are grouped by fit and place,
and the driver takes the Newton step.  So a whole grid with cross-validation costs some
ten passes over the data, and no rows are collected or cut.

Features are standardised by the fit's own rows (population deviation; a constant
feature becomes 0).  The objective is C * log loss + |coefficients|^2 / 2 without the
intercept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ITER = 100
TOLERANCE = 1e-7         # on the largest part of the gradient of the mean loss


@dataclass
class LinearModel:
    """A fitted logistic regression; coefficients belong to the standardised features."""

    features: list[str]
    mean: list[float]
    scale: list[float]
    coefficients: list[float]
    intercept: float

    def margin(self):
        z = F.lit(float(self.intercept))
        for f, m, s, c in zip(self.features, self.mean, self.scale, self.coefficients):
            z = z + F.lit(float(c)) * ((F.col(f).cast("double") - F.lit(float(m))) / F.lit(float(s)))
        return z

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``probability`` (a vector of both classes) and ``prediction``."""
        from pyspark.ml.functions import array_to_vector
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-self.margin()))
        scored = df.withColumn("_p", p)
        return scored.withColumn("probability", array_to_vector(F.array(1 - F.col("_p"), F.col("_p")))).withColumn(
            "prediction", (F.col("_p") > 0.5).cast("double")).drop("_p")


def _moments(data: DataFrame, features: list[str], fold: str):
    """{fold: (rows, sums, sums of squares)}; values are shifted by the first fold's mean for the squares."""
    shift = data.agg(*[F.avg(F.col(f).cast("double")).alias(f"m{i}") for i, f in enumerate(features)]).first()
    shift = np.array([shift[f"m{i}"] or 0.0 for i in range(len(features))])
    moved = [F.col(f).cast("double") - F.lit(float(m)) for f, m in zip(features, shift)]
    rows = data.groupBy(fold).agg(F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(moved)],
                                  *[F.sum(x * x).alias(f"q{i}") for i, x in enumerate(moved)]).collect()      # one row a fold
    k = range(len(features))
    return shift, {r[fold]: (r["n"], np.array([r[f"s{i}"] for i in k]), np.array([r[f"q{i}"] for i in k])) for r in rows}


def fit_many(data: DataFrame, features: list[str], label: str, fits: list[tuple[float, int | None]], fold: str = "fold",
             max_iter: int = MAX_ITER, tolerance: float = TOLERANCE) -> list[LinearModel]:
    """One model for each (C, fold left out or None) of ``fits``."""
    d = len(features)
    shift, moments = _moments(data, features, fold)
    seen = []
    for _, out in fits:
        parts = [m for k, m in moments.items() if out is None or k != out]
        n = max(1, sum(p[0] for p in parts))
        mean = sum(p[1] for p in parts) / n
        spread = np.sqrt(np.maximum(sum(p[2] for p in parts) / n - mean * mean, 0))
        seen.append((n, shift + mean, np.where(spread > 1e-12, spread, 1.0)))
    upper = np.triu_indices(d + 1)
    x = data.select(F.array(*[F.col(f).cast("double") for f in features]).alias("x"), F.col(label).cast("double").alias("y"),
                    F.col(fold).cast("int").alias("fold"))

    def sums(weights: dict):
        """{fit: (loss, gradient, Hessian)} of the log loss at the given weights (intercept last)."""
        def part(batches):
            import pyarrow as pa
            total = {i: np.zeros(1 + d + 1 + len(upper[0])) for i in weights}
            for b in batches:
                rows = b.column(0).flatten().to_numpy().reshape(-1, d)
                y, of = b.column(1).to_numpy(), b.column(2).to_numpy()
                left_out = None                  # fits that leave out one fold see the same standardised rows
                for i, w in sorted(weights.items(), key=lambda x: -1 if fits[x[0]][1] is None else fits[x[0]][1]):
                    if left_out != (fits[i][1],):
                        left_out = (fits[i][1],)
                        some = slice(None) if fits[i][1] is None else np.flatnonzero(of != fits[i][1])
                        _, mean, scale = seen[i]
                        a = np.concatenate([(rows[some] - mean) / scale, np.ones((len(y[some]), 1))], axis=1)
                    z, t = a @ w, y[some]
                    p = 1.0 / (1.0 + np.exp(-z))
                    loss = (np.logaddexp(0.0, z) - t * z).sum()
                    h = (a * (p * (1 - p))[:, None]).T @ a
                    total[i] += np.concatenate([[loss], a.T @ (p - t), h[upper]])
            for i, v in total.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), i), pa.int32()), pa.array(np.arange(len(v)), pa.int32()),
                                                  pa.array(v)], names=["fit", "place", "value"])
        rows = x.mapInArrow(part, "fit int, place int, value double").groupBy("fit", "place").agg(F.sum("value").alias("v")).collect()
        flat = {i: np.zeros(1 + d + 1 + len(upper[0])) for i in weights}
        for r in rows:                                     # fits x features^2 numbers
            flat[r["fit"]][r["place"]] = r["v"]
        out = {}
        for i, v in flat.items():
            h = np.zeros((d + 1, d + 1))
            h[upper] = v[d + 2:]
            out[i] = v[0], v[1:d + 2], h + np.triu(h, 1).T
        return out

    at = {i: np.zeros(d + 1) for i in range(len(fits))}
    best: dict = {}                                          # fit -> (objective, weights, Newton step)
    done: dict = {}
    for _ in range(max_iter):
        if not at:
            break
        found, following = sums(at), {}
        for i, w in at.items():
            n, c = seen[i][0], fits[i][0]
            ridge = np.append(np.full(d, 1.0 / c), 0.0)
            loss, gradient, hessian = found[i]
            value = loss + (ridge * w * w).sum() / 2
            if i in best and value > best[i][0] + 1e-10 * abs(best[i][0]):      # overshot: half the step
                old = best[i]
                best[i] = (old[0], old[1], old[2] / 2)
                following[i] = old[1] - best[i][2]
                if np.abs(best[i][2]).max() < 1e-12:
                    done[i] = old[1]
                    following.pop(i)
                continue
            gradient = gradient + ridge * w
            if np.abs(gradient).max() <= tolerance * n:
                done[i] = w
                continue
            step = np.linalg.solve(hessian + np.diag(ridge) + 1e-9 * np.eye(d + 1), gradient)
            best[i] = (value, w, step)
            following[i] = w - step
        at = following
    done |= {i: best[i][1] for i in at}
    return [LinearModel(features, seen[i][1].tolist(), seen[i][2].tolist(), done[i][:d].tolist(), float(done[i][d]))
            for i in range(len(fits))]


def fold_scores(data: DataFrame, models: dict[tuple, LinearModel], label: str, key: str, fold: str = "fold") -> DataFrame:
    """Long rows (model, fold, key, label, score, prediction): each row scored by the models that left its
    fold out.  ``models`` has the keys (name, fold)."""
    names = sorted({n for n, _ in models})

    def score(name):
        z = None
        for (n, k), m in models.items():
            if n == name:
                z = F.when(F.col(fold) == k, m.margin()) if z is None else z.when(F.col(fold) == k, m.margin())
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), score(n).alias("score")) for n in names])).alias("m")
    return data.select(F.col(key).alias("key"), F.col(fold).alias("fold"), F.col(label).cast("int").alias("label"), each).select(
        F.col("m.model").alias("model"), "fold", "key", "label", F.col("m.score").alias("score"),
        (F.col("m.score") > 0.5).cast("int").alias("prediction"))
