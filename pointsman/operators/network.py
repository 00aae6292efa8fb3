"""A regression network for all candidates: rectified layers, squared error, gradients summed in the cluster.

Each step is one pass over the cached blocks: tasks add up the gradient of their training rows and the
error of their validation rows, the driver takes one Adam step. Training stops when the validation error has
not improved for some steps, and the best weights are kept. Inputs are scaled to mean 0 and deviation 1.
Unobserved outcomes (null) count neither in the error nor in the gradient.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointsman.functions import draws
from pointsman.operators import blocks as bl


@dataclass
class Network:
    layers: list[tuple[np.ndarray, np.ndarray]]
    mean: np.ndarray
    scale: np.ndarray
    steps: int = 0
    error: float = float("nan")

    def predict(self, x: np.ndarray) -> np.ndarray:
        return forward(self.layers, (x - self.mean) / self.scale)[-1]


def shapes(sizes: list[int]) -> list[tuple[int, int]]:
    return list(zip(sizes[:-1], sizes[1:]))


def unflat(theta: np.ndarray, sizes: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for a, b in shapes(sizes):
        out.append((theta[at : at + a * b].reshape(a, b), theta[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def flat(layers) -> np.ndarray:
    return np.concatenate([np.concatenate([w.ravel(), b]) for w, b in layers])


def start(sizes: list[int], seed: int) -> np.ndarray:
    """Uniform weights whose bound falls with the widths of the two layers they join."""
    rng = np.random.default_rng(seed)
    layers = []
    for a, b in shapes(sizes):
        bound = np.sqrt(6.0 / (a + b))
        layers.append((rng.uniform(-bound, bound, (a, b)), rng.uniform(-bound, bound, b)))
    return flat(layers)


def forward(layers, x: np.ndarray) -> list[np.ndarray]:
    """Outputs of every layer, the input first; the last one is linear."""
    out = [x]
    for k, (w, b) in enumerate(layers):
        z = out[-1] @ w + b
        out.append(z if k == len(layers) - 1 else np.maximum(z, 0.0))
    return out


def gradient(layers, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, int]:
    """Gradient of half the squared error over observed outcomes, that error and how many there are."""
    outs = forward(layers, x)
    seen = np.isfinite(y)
    diff = np.where(seen, outs[-1] - np.where(seen, y, 0.0), 0.0)
    error, parts, delta = 0.5 * float((diff**2).sum()), [], diff
    for k in range(len(layers) - 1, -1, -1):
        parts.append((outs[k].T @ delta, delta.sum(0)))
        if k:
            delta = (delta @ layers[k][0].T) * (outs[k] > 0)
    return flat(parts[::-1]), error, int(seen.sum())


def fit(
    train: DataFrame, x: str = "x", y: str = "score", hidden: tuple[int, ...] = (64, 32), alpha: float = 1e-4, rate: float = 0.01, max_iter: int = 300,
    patience: int = 20, validation: float = 0.1, seed: int = 3407, tolerance: float = 1e-4, **_,
) -> Network:
    """Adam on all training rows, one pass per step; a share of them, drawn by hash, is the validation set."""
    return fit_sets(train, [F.lit(True)], x, y, hidden, alpha, rate, max_iter, patience, validation, seed, tolerance)[0]


def fit_sets(
    train: DataFrame, sets: list[Column], x: str = "x", y: str = "score", hidden: tuple[int, ...] = (64, 32), alpha: float = 1e-4, rate: float = 0.01,
    max_iter: int = 300, patience: int = 20, validation: float = 0.1, seed: int = 3407, tolerance: float = 1e-4, **_,
) -> list[Network]:
    """A network per training set (a condition on the rows). All take their steps in the same jobs; one that has stopped is left out of the next."""
    head = train.select(F.size(x).alias("d"), F.size(y).alias("m")).first()
    if head is None:
        raise ValueError("no training rows")
    d, m, n_sets = head.d, head.m, len(sets)
    drawn = (draws.hash_unit(seed, F.col("sample_id")) < validation).cast("int").alias("_v")
    inside = F.array(*[F.coalesce(c, F.lit(False)).cast("int") for c in sets])
    rows = train.select(F.col(x).alias("_x"), F.col(y).alias("_y"), drawn, inside.alias("_in"))

    def build(c):
        return {
            "x": bl.cleaned(bl.dense(c["_x"], d)).tobytes(), "y": bl.dense(c["_y"], m).tobytes(), "v": c["_v"].to_numpy().astype(np.int8).tobytes(),
            "own": bl.dense(c["_in"], n_sets).astype(np.int8).tobytes(),
        }

    data = bl.pack(rows, ["_x", "_y", "_v", "_in"], build, ["x", "y", "v", "own"])

    def of(own: bytes, k: int) -> np.ndarray:
        return np.frombuffer(own, np.int8).reshape(-1, n_sets)[:, k] > 0

    def moments(out, n, xb, yb, vb, own):
        for k, z in enumerate(out.reshape(n_sets, -1)):
            xs = bl.floats(xb, d)[of(own, k)]
            z[0] += len(xs)
            z[1 : 1 + d] += xs.sum(0)
            z[1 + d :] += (xs**2).sum(0)

    means, scales = [], []
    for sums in data.total(moments, n_sets * (1 + 2 * d)).reshape(n_sets, -1):
        if not sums[0]:
            raise ValueError("no training rows")
        means.append(sums[1 : 1 + d] / sums[0])
        var = sums[1 + d :] / sums[0] - means[-1] ** 2
        scales.append(np.where(var > 1e-12 * np.maximum(1.0, means[-1] ** 2), np.sqrt(np.maximum(var, 0.0)), 1.0))
    sizes = [d, *hidden, m]
    runs = [_Run(sizes, seed) for _ in sets]
    size = len(runs[0].theta)
    for step in range(1, max_iter + 1):
        going = [(k, unflat(r.theta, sizes), means[k], scales[k]) for k, r in enumerate(runs) if not r.done]
        if not going:
            break

        def add(out, n, xb, yb, vb, own, going=going):
            xs, ys, held = bl.floats(xb, d), bl.floats(yb, m), np.frombuffer(vb, np.int8) > 0
            for z, (k, layers, mean, scale) in zip(out.reshape(len(going), -1), going, strict=True):
                on = of(own, k)
                scaled = (xs[on] - mean) / scale
                g, e, seen = gradient(layers, scaled[~held[on]], ys[on & ~held])
                _, ve, vk = gradient(layers, scaled[held[on]], ys[on & held])
                z[:size] += g
                z[size:] += [e, seen, ve, vk]

        z = data.total(add, len(going) * (size + 4)).reshape(len(going), -1)
        for sums, (k, layers, *_) in zip(z, going, strict=True):
            runs[k].move(sums, layers, step, alpha, rate, patience, tolerance)
    data.release()
    return [Network(unflat(r.kept, sizes), mean, scale, r.step, float(r.best)) for r, mean, scale in zip(runs, means, scales, strict=True)]


class _Run:
    """Weights of a network, its Adam moments, and the best weights so far."""

    def __init__(self, sizes: list[int], seed: int):
        self.theta = start(sizes, seed)
        self.first, self.second = np.zeros(len(self.theta)), np.zeros(len(self.theta))
        self.best, self.kept, self.since, self.step, self.done = np.inf, self.theta, 0, 0, False

    def move(self, z: np.ndarray, layers, step: int, alpha: float, rate: float, patience: int, tolerance: float) -> None:
        """One step from the sums of a pass: gradient, training error and outcomes, validation error and outcomes."""
        size, self.step = len(self.theta), step
        if z[size + 1] < 2:
            raise ValueError("fewer than two observed training outcomes")
        # Without validation rows the training error decides.
        error = z[size + 2] / z[size + 3] if z[size + 3] else z[size] / z[size + 1]
        self.since = 0 if error < self.best - tolerance * 1e-2 else self.since + 1
        if error < self.best:
            self.best, self.kept = error, self.theta.copy()
        if self.since >= patience:
            self.done = True
            return
        decay = np.concatenate([np.concatenate([w.ravel(), np.zeros(len(b))]) for w, b in layers])
        g = z[:size] / z[size + 1] + alpha * decay / z[size + 1]
        self.first, self.second = 0.9 * self.first + 0.1 * g, 0.999 * self.second + 0.001 * g**2
        self.theta = self.theta - rate * (self.first / (1 - 0.9**step)) / (np.sqrt(self.second / (1 - 0.999**step)) + 1e-8)


def predict(rows: DataFrame, net: Network, x: str = "x", out: str = "pred") -> DataFrame:
    """Add the array of predictions, one per candidate."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(xs: pd.Series) -> pd.Series:
        return pd.Series(list(net.predict(bl.cleaned(np.array(xs.tolist(), dtype=float)))))

    return rows.withColumn(out, run(F.col(x)))
