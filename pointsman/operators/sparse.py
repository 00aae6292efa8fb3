"""Ridge on sparse rows (terms of texts) for all candidates at once, without forming a matrix of products.

The normal equations are solved by conjugate gradients: a step multiplies the current directions of all
candidates by X'X in one pass over the cached rows. Centring is part of the product, so rows stay sparse and
the intercept is not penalised. An unobserved outcome leaves its row out for that candidate.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointsman.operators import blocks as bl


@dataclass
class SparseRidge:
    """Coefficients (terms, candidates), intercepts, and the steps the solver took."""

    weights: np.ndarray
    bias: np.ndarray
    steps: int = 0


def slots(vocab: DataFrame) -> tuple[DataFrame, int]:
    """(term, slot) of every term of a vocabulary, which its feature limit bounds, and their number."""
    table = vocab.select("term", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("term")) - 1).alias("slot")).persist()
    return table, table.count()


def sparse_rows(weights: DataFrame, table: DataFrame, ids: DataFrame) -> DataFrame:
    """`ids` with `slots` and `values` of their terms, in order; a sample without known terms has none."""
    pairs = weights.join(F.broadcast(table), "term").groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("slot", "weight"))).alias("_p"))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    return ids.join(pairs, "sample_id", "left").select(
        *ids.columns, F.coalesce("_p.slot", none("int")).alias("slots"), F.coalesce("_p.weight", none("double")).alias("values")
    )


class _Block:
    """Rows in compressed form."""

    def __init__(self, n: int, begin: bytes, at: bytes, values: bytes):
        self.n = n
        self.begin, self.at, self.values = np.frombuffer(begin, "<i8"), np.frombuffer(at, "<i4"), np.frombuffer(values, "<f8")
        self.row = np.repeat(np.arange(n), np.diff(self.begin))

    def times(self, v: np.ndarray) -> np.ndarray:
        """X v for (width, k)."""
        out = np.zeros((self.n, v.shape[1]))
        for j in range(v.shape[1]):
            out[:, j] = np.bincount(self.row, self.values * v[self.at, j], self.n)
        return out

    def back(self, u: np.ndarray, width: int) -> np.ndarray:
        """X' u for (n, k)."""
        return np.stack([np.bincount(self.at, self.values * u[self.row, j], width) for j in range(u.shape[1])], axis=1)


def fit(rows: DataFrame, width: int, alpha: float = 5.0, max_iter: int = 100, tolerance: float = 1e-10, y: str = "score") -> SparseRidge:
    """Solve for all candidates of the array `y`; stops when every residual has fallen to `tolerance` of its start."""
    head = rows.select(F.size(y).alias("m")).first()
    if head is None:
        raise ValueError("no training rows")
    m = head.m

    def build(c):
        begin = np.concatenate([[0], np.cumsum(c["slots"].value_lengths().to_numpy())]).astype("<i8")
        return {
            "begin": begin.tobytes(), "at": c["slots"].flatten().to_numpy(zero_copy_only=False).astype("<i4").tobytes(),
            "values": c["values"].flatten().to_numpy(zero_copy_only=False).astype("<f8").tobytes(), "y": bl.dense(c["_y"], m).astype("<f8").tobytes(),
        }

    parts = ["begin", "at", "values", "y"]
    data = bl.pack(rows.select("slots", "values", F.col(y).alias("_y")), ["slots", "values", "_y"], build, parts)

    def sums(out, n, begin, at, values, yb):
        block, ys = _Block(n, begin, at, values), bl.floats(yb, m)
        seen = np.isfinite(ys)
        out[:m] += seen.sum(0)
        out[m : 2 * m] += np.where(seen, ys, 0.0).sum(0)
        out[2 * m :] += block.back(seen.astype(float), width).ravel()

    z = data.total(sums, 2 * m + width * m)
    count = z[:m]
    if (count < 2).any():
        raise ValueError(f"output {int(np.argmin(count))} has fewer than two observed training rows")
    mean_y, mean_x = z[m : 2 * m] / count, z[2 * m :].reshape(width, m) / count

    def right(out, n, begin, at, values, yb):
        ys = bl.floats(yb, m)
        out += _Block(n, begin, at, values).back(np.where(np.isfinite(ys), ys - mean_y, 0.0), width).ravel()

    def product(v: np.ndarray) -> np.ndarray:
        shift = (mean_x * v).sum(0)

        def add(out, n, begin, at, values, yb):
            block = _Block(n, begin, at, values)
            out += block.back(np.where(np.isfinite(bl.floats(yb, m)), block.times(v) - shift, 0.0), width).ravel()

        return data.total(add, width * m).reshape(width, m) + alpha * v

    w = np.zeros((width, m))
    r = data.total(right, width * m).reshape(width, m)
    p, rr, steps = r.copy(), (r * r).sum(0), 0
    goal = rr * tolerance**2
    while steps < max_iter and (rr > goal).any():
        q = product(p)
        curve = (p * q).sum(0)
        a = np.where(rr > goal, rr / np.where(curve > 0, curve, 1.0), 0.0)
        w, r = w + a * p, r - a * q
        after = (r * r).sum(0)
        p = r + np.where(rr > 0, after / np.where(rr > 0, rr, 1.0), 0.0) * p
        rr, steps = after, steps + 1
    data.release()
    return SparseRidge(w, mean_y - (mean_x * w).sum(0), steps)


def predict(rows: DataFrame, fitted: SparseRidge, out: str = "pred") -> DataFrame:
    """Add predictions to rows with `slots` and `values`, which are dropped."""
    shared = rows.sparkSession.sparkContext.broadcast((fitted.weights, fitted.bias))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(at: pd.Series, values: pd.Series) -> pd.Series:
        weights, bias = shared.value
        return pd.Series([bias + np.asarray(v, float) @ weights[np.asarray(s, int)] if len(s) else bias for s, v in zip(at, values, strict=True)])

    return rows.withColumn(out, run("slots", "values")).drop("slots", "values")


