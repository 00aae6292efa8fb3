"""Ridge and least squares for all candidates, folds and probe subsets from one scan.

Each task adds up the products of its rows ([1, x, y] with itself) per cell; cells are
folds, holdouts or split labels. The sums are small, so any training set that is a union
of cells, any feature subset and any penalty is then solved without reading data again.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_WIDTH = 4_000
FAN_IN = 16
SHARED = -1


class Moments:
    """Sums of products per (cell, target). Target -1 holds all outputs together."""

    def __init__(self, cells: dict[tuple[int, int], np.ndarray], n_features: int, n_outputs: int, masked: bool):
        self.cells, self.d, self.m, self.masked = cells, n_features, n_outputs, masked

    def total(self, include: Iterable[int] | None = None, target: int = SHARED) -> np.ndarray:
        width = 2 + self.d if self.masked else 1 + self.d + self.m
        wanted = {c for c, _ in self.cells} if include is None else set(include)
        out = np.zeros((width, width))
        for (cell, t), value in self.cells.items():
            if t == target and cell in wanted:
                out += value
        return out


def _accumulate(x: np.ndarray, y: np.ndarray, masked: bool, into: dict, cell: int) -> None:
    cell, sign = (cell, 1.0) if cell >= 0 else (~cell, -1.0)
    head = np.hstack([np.ones((len(x), 1)), x])
    if not masked:
        z = np.hstack([head, y])
        into[(cell, SHARED)] = into.get((cell, SHARED), 0.0) + sign * (z.T @ z)
        return
    for j in range(y.shape[1]):
        seen = np.isfinite(y[:, j])
        z = np.hstack([head[seen], y[seen, j : j + 1]])
        into[(cell, j)] = into.get((cell, j), 0.0) + sign * (z.T @ z)


def _matrix(series: pd.Series) -> np.ndarray:
    return np.array(series.tolist(), dtype=float)


SUMS = T.StructType(
    [T.StructField("cell", T.IntegerType()), T.StructField("target", T.IntegerType()), T.StructField("z", T.ArrayType(T.DoubleType()))]
)


def _row(sums: dict) -> pd.DataFrame:
    return pd.DataFrame([{"cell": c, "target": t, "z": z.ravel()} for (c, t), z in sums.items()], columns=SUMS.names)


def moments(rows: DataFrame, x: str, y: str, cells: str | None = None, masked: bool = False) -> Moments:
    """Collect the per-cell sums. `cells` is an int array of the cells a row counts in; ~c takes the row away from cell c.

    With `masked`, outputs may be null: each candidate then has its own sums over the rows
    that observe it. Null and non-finite features count as 0.
    """
    head = rows.select(F.size(x).alias("d"), F.size(y).alias("m")).first()
    if head is None:
        raise ValueError("no training rows")
    d, m = head.d, head.m
    if d + m + 1 > MAX_WIDTH:
        raise ValueError(f"{d} features are too many for dense moments; use a sparse learner")
    src = rows.select(F.col(x).alias("x"), F.col(y).alias("y"), (F.col(cells) if cells else F.array(F.lit(0))).alias("cells"))

    def partial(batches):
        sums: dict = {}
        for b in batches:
            if not len(b):
                continue
            xs = np.nan_to_num(_matrix(b["x"]), nan=0.0, posinf=0.0, neginf=0.0)
            ys = _matrix(b["y"])
            sizes = b["cells"].map(len).to_numpy()
            at = np.repeat(np.arange(len(b)), sizes)
            ids = np.concatenate([np.asarray(c) for c in b["cells"]]) if sizes.sum() else np.array([], int)
            for cell in np.unique(ids):
                take = at[ids == cell]
                _accumulate(xs[take], ys[take], masked, sums, int(cell))
        if sums:
            yield _row(sums)

    def merge(batches):
        sums: dict = {}
        for b in batches:
            for cell, target, z in zip(b["cell"], b["target"], b["z"]):
                key = (int(cell), int(target))
                sums[key] = sums.get(key, 0.0) + np.asarray(z)
        if sums:
            yield _row(sums)

    parts = src.mapInPandas(partial, SUMS)
    # Sums are added up by (cell, target) in the cluster, in two rounds, so the driver gets one array of each.
    parts = parts.repartition(FAN_IN, "cell", "target", F.pmod(F.monotonically_increasing_id(), F.lit(FAN_IN))).mapInPandas(merge, SUMS)
    parts = parts.repartition(FAN_IN, "cell", "target").mapInPandas(merge, SUMS)
    width = 2 + d if masked else 1 + d + m
    out: dict = {}
    table = parts.toArrow()
    for cell, target, z in zip(table["cell"].to_pylist(), table["target"].to_pylist(), table["z"], strict=True):
        key = (cell, target)
        out[key] = out.get(key, 0.0) + z.values.to_numpy().reshape(width, width)
    return Moments(out, d, m, masked)


def solve(z: np.ndarray, d: int, alpha: float, keep: list[int] | None = None, standardize: bool = True) -> np.ndarray:
    """Coefficients (outputs, 1 + d), intercept first, from one sum of products.

    Features are scaled to unit population deviation first (a constant one is left alone);
    the intercept is not penalised. Without a penalty the least-norm solution is taken,
    since the levels of one probe sum to 1. Features outside `keep` get 0.
    """
    n = z[0, 0]
    if n < 2:
        raise ValueError("fewer than two training rows")
    use = list(range(d)) if keep is None else list(keep)
    at = [1 + i for i in use]
    mean_x, mean_y = z[0, at] / n, z[0, 1 + d :] / n
    sxx = z[np.ix_(at, at)] - n * np.outer(mean_x, mean_x)
    sxy = z[np.ix_(at, range(1 + d, z.shape[0]))] - n * np.outer(mean_x, mean_y)
    var = np.diag(sxx) / n
    flat = var <= 1e-12 * np.maximum(1.0, mean_x**2)
    scale = np.where(flat, 1.0, np.sqrt(np.maximum(var, 0.0))) if standardize else np.ones(len(use))
    a = sxx / np.outer(scale, scale)
    b = sxy / scale[:, None]
    if alpha > 0:
        w = np.linalg.solve(a + alpha * np.eye(len(use)), b)
    else:
        w = np.linalg.pinv(a, rcond=1e-10, hermitian=True) @ b
    w = w / scale[:, None]
    out = np.zeros((z.shape[0] - 1 - d, 1 + d))
    out[:, 0] = mean_y - mean_x @ w
    out[:, at] = w.T
    return out


def fit(
    mo: Moments, alpha: float | list[float] = 1.0, include: Iterable[int] | None = None, keep: list[int] | None = None, standardize: bool = True
) -> np.ndarray:
    """Coefficients of every output, trained on the given cells: (outputs, 1 + d).

    Masked sums allow a penalty per output.
    """
    if not mo.masked:
        return solve(mo.total(include), mo.d, alpha, keep, standardize)
    rows = []
    for j in range(mo.m):
        z = mo.total(include, j)
        if z[0, 0] < 2:
            raise ValueError(f"output {j} has fewer than two observed training rows")
        rows.append(solve(z, mo.d, alpha[j] if isinstance(alpha, list) else alpha, keep, standardize)[0])
    return np.array(rows)


def fit_without(mo: Moments, cells: list[int], **kw) -> np.ndarray:
    """One coefficient set per held-out cell, trained on all the others: (cells, candidates, 1 + d)."""
    every = {c for c, _ in mo.cells}
    return np.array([fit(mo, include=every - {c}, **kw) for c in cells])


def score(rows: DataFrame, x: str, coefs: np.ndarray, which: Column | None = None, out: str = "pred", floor: float | None = None) -> DataFrame:
    """Add predictions per candidate. `coefs` is (sets, candidates, 1 + d); `which` picks the set per row.

    One matrix product per Arrow batch; inside codegen the same product would be an
    interpreted lambda per feature.
    """
    sets = coefs if coefs.ndim == 3 else coefs[None]
    shared = rows.sparkSession.sparkContext.broadcast(sets)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def predict(xs: pd.Series, ks: pd.Series) -> pd.Series:
        w = shared.value
        head = np.nan_to_num(_matrix(xs), nan=0.0, posinf=0.0, neginf=0.0)
        ids = ks.to_numpy(int)
        res = np.empty((len(head), w.shape[1]))
        for k in np.unique(ids):
            on = ids == k
            res[on] = w[k][:, 0] + head[on] @ w[k][:, 1:].T
        if floor is not None:
            res = np.maximum(res, floor)
        return pd.Series(list(res))

    return rows.withColumn(out, predict(F.col(x), which.cast("int") if which is not None else F.lit(0)))


def picks(rows: DataFrame, x: str, coefs: np.ndarray, which: list[Column], out: str = "slots") -> DataFrame:
    """Add the 1-based best slot under several systems at once.

    `coefs` is (systems, sets, candidates, 1 + d) and `which[i]` the set of system i; a
    set below 0 gives a null slot. Ties go to the first candidate.
    """
    shared = rows.sparkSession.sparkContext.broadcast(coefs)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def choose(xs: pd.Series, ks: pd.Series) -> pd.Series:
        w = shared.value
        head = np.nan_to_num(_matrix(xs), nan=0.0, posinf=0.0, neginf=0.0)
        ids = np.array(ks.tolist(), dtype=int)
        res = np.zeros(ids.shape, dtype=int)
        for s in range(w.shape[0]):
            for k in np.unique(ids[:, s]):
                if k < 0:
                    continue
                on = ids[:, s] == k
                res[on, s] = 1 + np.argmax(w[s, k][:, 0] + head[on] @ w[s, k][:, 1:].T, axis=1)
        return pd.Series([[int(v) if v else None for v in r] for r in res])

    return rows.withColumn(out, choose(F.col(x), F.array(*[k.cast("int") for k in which])))


def picks_under(rows: DataFrame, x: str, coefs: np.ndarray, which: str, out: str = "slots") -> DataFrame:
    """Add the 1-based best slots under the coefficient sets that the int array `which` of the row lists, in its order.

    `coefs` is (sets, candidates, 1 + d). Features travel once a row, however many sets it has. Ties go to the first candidate.
    """
    shared = rows.sparkSession.sparkContext.broadcast(coefs)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def choose(xs: pd.Series, ks: pd.Series) -> pd.Series:
        w = shared.value
        head = np.nan_to_num(_matrix(xs), nan=0.0, posinf=0.0, neginf=0.0)
        sizes = ks.map(len).to_numpy()
        ids = np.concatenate(ks.tolist()) if sizes.sum() else np.zeros(0, int)
        at = np.repeat(np.arange(len(head)), sizes)
        res = np.zeros(len(ids), np.int32)
        order = np.argsort(ids, kind="stable")
        for on in np.split(order, np.nonzero(np.diff(ids[order]))[0] + 1):
            if len(on):
                k = ids[on[0]]
                res[on] = 1 + np.argmax(w[k][:, 0] + head[at[on]] @ w[k][:, 1:].T, axis=1)
        return pd.Series(np.split(res, np.cumsum(sizes)[:-1]))

    return rows.withColumn(out, choose(F.col(x), F.col(which)))


def coefficient_rows(spark, coefs: np.ndarray, names: list[str], models: list[str]) -> DataFrame:
    """(model, feature, value) rows of one coefficient set; the intercept is named so."""
    data = [
        (m, f, float(v)) for m, row in zip(models, coefs) for f, v in zip(["(intercept)", *names], row)
    ]
    return spark.createDataFrame(data, "model string, feature string, value double")


def save_router(spark, path: str, coefs: np.ndarray, names: list[str], models: list[str]) -> None:
    """Coefficients with the feature and candidate order, as one small table."""
    order = {n: i for i, n in enumerate(["(intercept)", *names])}
    rank = {m: i for i, m in enumerate(models)}
    data = [
        (rank[m], order[f], m, f, v) for m, f, v in coefficient_rows(spark, coefs, names, models).collect()
    ]
    spark.createDataFrame(
        data, "model_pos int, feature_pos int, model string, feature string, value double"
    ).write.parquet(path)


def load_router(spark, path: str) -> tuple[np.ndarray, list[str], list[str]]:
    """(coefficients, feature names, candidate names) in their saved order."""
    rows = spark.read.parquet(path).orderBy("model_pos", "feature_pos").collect()
    models = list(dict.fromkeys(r.model for r in rows))
    names = list(dict.fromkeys(r.feature for r in rows))[1:]
    coefs = np.array([r.value for r in rows]).reshape(len(models), 1 + len(names))
    return coefs, names, models
