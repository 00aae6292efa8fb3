"""Boosted trees of squared error for all candidates, folds and seeds together.

Features are cut once into bins at approximate quantiles, shared by everything that is fitted. A model is a
head: a set of training rows and the outputs it predicts, all with the same trees or one each. Every tree
asks one question per level (a feature and a border, the same in all its leaves). A level is one job: tasks add up,
for every head, the residuals by leaf, feature and bin, of the smaller side of the last question only, since the
other is the difference; the driver picks each head's best question from the sums. So a fit costs rounds times
depth small jobs, however many candidates, folds and seeds there are. A job takes longer than adding up a small table,
so heads of tables with at most `LOCAL` numbers per level are fitted whole, each in a task that gets its rows, unless there are few levels.

Residuals travel with the packed rows. The trees of the last few rounds are subtracted on the fly; every `KEEP`
rounds the rows are written anew to the shared folder, so their lineage stays short and a lost executor costs
little. Rows whose outputs are not all observed are left out of a head.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointsman.operators import blocks as bl
from pointsman.session import written

BINS = 32
#: Numbers that one task adds up for a level of a head, whose rows it then holds; more are added up by a job per level.
LOCAL = 10**8
#: Levels of all rounds up to which a job for each costs no more than dealing the rows to a task per head.
FEW_JOBS = 60
#: Rows added up at a time, so their codes stay in a core's cache.
ROWS_AT_ONCE = 4096
#: Rounds between written states.
KEEP = 10


@dataclass
class Tree:
    features: list[int]
    bins: list[int]
    values: np.ndarray  # (2^depth, outputs)

    def leaves(self, binned: np.ndarray) -> np.ndarray:
        out = np.zeros(len(binned), np.int64)
        for k, (f, b) in enumerate(zip(self.features, self.bins, strict=True)):
            out |= (binned[:, f] > b).astype(np.int64) << k
        return out


@dataclass
class Head:
    """A model: its training set, its outputs, their start values and its trees."""

    rows: int
    outputs: list[int]
    base: np.ndarray
    trees: list[Tree] = field(default_factory=list)
    gains: dict[int, float] = field(default_factory=dict)


@dataclass
class Boosted:
    borders: list[np.ndarray]
    heads: list[Head]
    rate: float
    n_outputs: int

    def predict(self, x: np.ndarray, rows: int = 0) -> np.ndarray:
        # Trees read columns.
        binned = np.asfortranarray(binned_rows(x, self.borders))
        out = np.zeros((len(x), self.n_outputs))
        for h in self.heads:
            if h.rows == rows:
                total = np.tile(h.base, (len(x), 1))
                for t in h.trees:
                    total += self.rate * t.values[t.leaves(binned)]
                out[:, h.outputs] = total
        return out


def binned_rows(x: np.ndarray, borders: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(x.shape, np.uint8)
    for f, b in enumerate(borders):
        out[:, f] = np.searchsorted(b, x[:, f], side="left")
    return out


def quantile_borders(rows: DataFrame, x: str, d: int, bins: int) -> list[np.ndarray]:
    """At most `bins` - 1 borders per feature, from one pass of quantile sketches; the last value is no border."""
    clean = lambda i: F.coalesce(F.when(F.abs(F.col(x)[i]) < float("inf"), F.nanvl(F.col(x)[i], F.lit(0.0))), F.lit(0.0))
    shares = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    found = rows.agg(*[F.struct(F.percentile_approx(clean(i), shares, 100 * bins).alias("b"), F.max(clean(i)).alias("m")).alias(f"_{i}") for i in range(d)]).first()
    return [np.array(sorted({v for v in found[i]["b"] or [] if v < found[i]["m"]})) for i in range(d)]


def _sums(b: np.ndarray, leaf: np.ndarray, res: np.ndarray, leaves: int, offsets: np.ndarray) -> np.ndarray:
    """(outputs + 1, leaves, bins of all features): sums of the residuals `res` (outputs, rows), and rows, of `b` (features, rows)."""
    d, width = len(b), int(offsets[-1])
    cells = leaves * width
    out, start = np.zeros((len(res) + 1, cells)), offsets[:-1, None]
    for s in range(0, b.shape[1], ROWS_AT_ONCE):
        part = slice(s, s + ROWS_AT_ONCE)
        code = (leaf[part] * width + start + b[:, part]).ravel()
        for j in range(len(res)):
            out[j] += np.bincount(code, np.tile(res[j, part], d), cells)
        out[-1] += np.bincount(code, minlength=cells)
    return out.reshape(-1, leaves, width)


def _best(sums: np.ndarray, offsets: np.ndarray, l2: float) -> tuple[int, int, float]:
    """Feature, bin and gain of the best question, from the sums of `_sums`; the first of (nearly) equal ones."""
    sizes = np.diff(offsets)
    shape = (*sums.shape[:2], len(sizes), int(sizes.max()))
    if np.prod(shape) != sums.size:
        padded = np.zeros((*shape[:2], shape[2] * shape[3]))
        padded[..., np.repeat(np.arange(shape[2]) * shape[3] - offsets[:-1], sizes) + np.arange(offsets[-1])] = sums
        sums = padded
    run = np.cumsum(sums.reshape(shape), axis=3)
    last = run[:, :, :1, -1:]
    whole = float((last[:-1, :, 0, 0] ** 2 / (last[-1, :, 0, 0] + l2)).sum())
    left, right = run[..., :-1], last - run[..., :-1]
    scores = sum(((s[:-1] ** 2).sum(axis=0) / (s[-1] + l2)).sum(axis=0) for s in (left, right))
    # A feature's last bin has no border.
    scores[np.arange(scores.shape[1]) >= sizes[:, None] - 1] = -np.inf
    best = (-1.0, 0, 0)
    if not scores.size:
        return 0, 0, best[0] - whole
    top = scores.max(axis=1)
    with np.errstate(invalid="ignore"):
        bins = np.argmax(scores >= (top - 1e-9 * np.abs(top))[:, None], axis=1)
    for f in np.flatnonzero(sizes > 1).tolist():
        score = float(scores[f, bins[f]])
        if score > best[0] * (1 + 1e-9) + 1e-300:
            best = (score, f, int(bins[f]))
    return best[1], best[2], best[0] - whole


class _Growing:
    """A tree that grows by a question per level, from the sums of the rows on the side `few` of its last question."""

    def __init__(self):
        self.features: list[int] = []
        self.bins: list[int] = []
        self.gains: list[float] = []
        self.few, self.above, self.values = 0, None, None

    def ask(self, sums: np.ndarray, offsets: np.ndarray, l2: float, last: bool) -> None:
        if self.features:
            # The other side of the last question is what is left of the leaves it was asked in; it is the highest bit of a leaf.
            rest = self.above - sums
            sums = np.concatenate([rest, sums] if self.few else [sums, rest], axis=1)
        f, b, gain = _best(sums, offsets, l2)
        self.features.append(f)
        self.bins.append(b)
        self.gains.append(max(0.0, gain))
        own = sums[:, :, offsets[f] : offsets[f + 1]]
        left, whole = own[..., : b + 1].sum(2), own.sum(2)
        self.few, self.above = int(2 * left[-1].sum() > whole[-1].sum()), sums
        if last:
            both = np.concatenate([left, whole - left], axis=1)
            self.values, self.above = (both[:-1] / (both[-1] + l2)).T, None


def _grown(b: np.ndarray, res: np.ndarray, offsets: np.ndarray, max_iter: int, depth: int, step: float, l2: float) -> tuple[list[Tree], dict[int, float]]:
    """All trees of a head from the bins (features, rows) and residuals (outputs, rows) of its rows, and the gains by feature."""
    trees, gains, res = [], {}, res.copy()
    for _ in range(max_iter if depth else 0):
        tree, leaf = _Growing(), np.zeros(b.shape[1], np.int64)
        for level in range(depth):
            on = np.flatnonzero(leaf >> (level - 1) == tree.few) if level else slice(None)
            own = leaf[on] & ((1 << level - 1) - 1) if level else leaf
            tree.ask(_sums(b[:, on], own, res[:, on], 1 << max(0, level - 1), offsets), offsets, l2, level == depth - 1)
            leaf |= (b[tree.features[-1]] > tree.bins[-1]).astype(np.int64) << level
        trees.append(Tree(tree.features, tree.bins, tree.values))
        for f, gain in zip(tree.features, tree.gains, strict=True):
            gains[f] = gains.get(f, 0.0) + gain
        res -= step * tree.values[leaf].T
    return trees, gains


def fit(
    train: DataFrame, x: str = "x", y: str = "score", sets: list[Column] | None = None, shared: bool = True, max_iter: int = 500, depth: int = 6,
    step: float = 0.05, l2: float = 3.0, bins: int = BINS, local: int | None = None, **_,
) -> Boosted:
    """One head per training set (a condition on the rows, or all of them), or one per set and output if the trees are not `shared`.

    If no head has more than `local` numbers to add up for a level (rows x features x outputs), each is fitted in a task of its own.
    """
    top = train.select(F.size(x).alias("d"), F.size(y).alias("m")).first()
    if top is None:
        raise ValueError("no training rows")
    if not 2 <= bins <= 256:
        raise ValueError("bins must be between 2 and 256")
    d, m = top.d, top.m
    sets = sets or [F.lit(True)]
    n_sets = len(sets)
    borders = quantile_borders(train, x, d, bins)
    offsets = np.concatenate([[0], np.cumsum([len(b) + 1 for b in borders])])
    width = int(offsets[-1])
    heads = [Head(s, out, np.zeros(len(out))) for s in range(len(sets)) for out in ([list(range(m))] if shared else [[j] for j in range(m)])]
    columns = [(h, j) for h, head in enumerate(heads) for j in head.outputs]
    begin = np.cumsum([0, *[len(h.outputs) for h in heads]])
    inside = F.array(*[F.coalesce(c, F.lit(False)).cast("int") for c in sets])
    rows = train.select(F.col(x).alias("_x"), F.col(y).alias("_y"), inside.alias("_in"))

    def build(c):
        ys, own = bl.dense(c["_y"], m), bl.dense(c["_in"], n_sets) > 0
        used = np.stack([own[:, h.rows] & np.isfinite(ys[:, h.outputs]).all(1) for h in heads], axis=1)
        r = np.nan_to_num(ys[:, [j for _, j in columns]], nan=0.0, posinf=0.0, neginf=0.0)
        return {"bins": binned_rows(bl.cleaned(bl.dense(c["_x"], d)), borders).tobytes(), "used": used.astype(np.uint8).tobytes(), "r": r.astype("<f8").tobytes()}

    parts = ["bins", "used", "r"]
    data = bl.pack(rows, ["_x", "_y", "_in"], build, parts)

    def unpack(n, bins_, used, r):
        return np.frombuffer(bins_, np.uint8).reshape(n, d), np.frombuffer(used, np.uint8).reshape(n, len(heads)) > 0, np.frombuffer(r, "<f8").reshape(n, len(columns))

    def means(out, n, bins_, used, r):
        _, u, res = unpack(n, bins_, used, r)
        for h in range(len(heads)):
            out[h] += u[:, h].sum()
            out[len(heads) + begin[h] : len(heads) + begin[h + 1]] += res[u[:, h], begin[h] : begin[h + 1]].sum(0)

    z = data.total(means, len(heads) + len(columns))
    for h, head in enumerate(heads):
        if z[h] < 2:
            raise ValueError(f"outputs {head.outputs} have fewer than two observed training rows")
        head.base = z[len(heads) + begin[h] : len(heads) + begin[h + 1]] / z[h]

    if local is None:
        local = LOCAL if max_iter * depth > FEW_JOBS else 0
    if max(z[h] * d * (len(head.outputs) + 1) for h, head in enumerate(heads)) <= local:
        _whole(data, heads, begin, unpack, offsets, max_iter, depth, step, l2)
        data.release()
        return Boosted(borders, heads, step, m)

    def histogram(out, level, chosen, few, b, u, res):
        """Sums by leaf, feature and bin of every head; from the second level on only of rows on the side `few` of the last question."""
        at, leaves = 0, 1 << max(0, level - 1)
        columns = np.ascontiguousarray(b.T)
        for h in range(len(heads)):
            on, leaf = u[:, h], np.zeros(len(b), np.int64)
            if level:
                leaf = Tree(*chosen[h], np.zeros(0)).leaves(b)
                on = on & (leaf >> (level - 1) == few[h])
                leaf &= (1 << (level - 1)) - 1
            z = _sums(columns[:, on], leaf[on], np.ascontiguousarray(res[on, begin[h] : begin[h + 1]].T), leaves, offsets)
            out[at : at + z.size] += z.ravel()
            at += z.size

    def length(level):
        return sum((1 << max(0, level - 1)) * width * (begin[h + 1] - begin[h] + 1) for h in range(len(heads)))

    schema = "n long, bins binary, used binary, r binary"

    def less(pending: list[list[Tree]], row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A block's bins, uses and residuals after the pending trees."""
        b, u, res = unpack(*row)
        res = res.copy()
        for trees in pending:
            for h, tree in enumerate(trees):
                res[:, begin[h] : begin[h + 1]] -= tree.values[tree.leaves(b)] * (step if tree.features else 1.0)
        return b, u, res

    state, tasks, blocks = data.frame, data.tasks, data
    # The start values are the first thing to subtract: a tree without questions.
    pending = [[Tree([], [], h.base[None]) for h in heads]]
    for _ in range(max_iter if depth else 0):
        if len(pending) > KEEP:

            def settled(batches: Iterator[pa.RecordBatch], pending=tuple(pending)) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for row in zip(*(batch.column(c).to_pylist() for c in ("n", *parts)), strict=True):
                        res = less(pending, row)[2]
                        yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), *[pa.array([v], pa.binary()) for v in (row[1], row[2], res.tobytes())]], ["n", *parts])

            before = state
            state = written(state.mapInArrow(settled, schema), "boosting").coalesce(tasks).persist()
            blocks = bl.Blocks(state, parts, tasks)
            before.unpersist()
            pending = []
        growing = [_Growing() for _ in heads]
        for level in range(depth):
            questions, few = [(list(t.features), list(t.bins)) for t in growing], [t.few for t in growing]

            def add(out, *row, level=level, questions=questions, pending=tuple(pending), few=few):
                histogram(out, level, questions, few, *less(pending, row))

            z, at = blocks.total(add, length(level)), 0
            for h, tree in enumerate(growing):
                shape = (int(begin[h + 1] - begin[h]) + 1, 1 << max(0, level - 1), width)
                size = int(np.prod(shape))
                tree.ask(z[at : at + size].reshape(shape), offsets, l2, level == depth - 1)
                at += size
                heads[h].gains[tree.features[-1]] = heads[h].gains.get(tree.features[-1], 0.0) + tree.gains[-1]
        last = [Tree(t.features, t.bins, t.values) for t in growing]
        pending.append(last)
        for head, tree in zip(heads, last, strict=True):
            head.trees.append(tree)
    state.unpersist()
    return Boosted(borders, heads, step, m)


def _whole(data: bl.Blocks, heads: list[Head], begin: np.ndarray, unpack, offsets: np.ndarray, max_iter: int, depth: int, step: float, l2: float) -> None:
    """Fit every head in a task of its own, which gets the head's rows."""
    bases = [h.base for h in heads]

    def deal(row: tuple) -> Iterator[tuple[int, tuple[bytes, bytes]]]:
        b, used, res = unpack(*row)
        for h in range(len(bases)):
            on = used[:, h]
            yield h, (b[on].tobytes(), res[on, begin[h] : begin[h + 1]].tobytes())

    def run(parts: Iterator[tuple[int, tuple[bytes, bytes]]]) -> Iterator[tuple]:
        # Blocks come in any order; sums do not depend on it.
        found = sorted(parts)
        if found:
            h = found[0][0]
            b = np.frombuffer(b"".join(p[0] for _, p in found), np.uint8).reshape(-1, len(offsets) - 1)
            res = np.frombuffer(b"".join(p[1] for _, p in found), "<f8").reshape(-1, len(bases[h]))
            trees, gains = _grown(np.ascontiguousarray(b.T), np.ascontiguousarray((res - bases[h]).T), offsets, max_iter, depth, step, l2)
            yield h, [(t.features, t.bins, t.values) for t in trees], gains

    # The model and nothing else comes to the driver.
    for h, trees, gains in data.rows.flatMap(deal).partitionBy(len(heads), lambda h: h).mapPartitions(run).collect():
        heads[h].trees, heads[h].gains = [Tree(*t) for t in trees], gains


def predict(rows: DataFrame, model: Boosted, x: str = "x", out: str = "pred", which: Column | None = None) -> DataFrame:
    """Add the array of predictions, one per candidate; `which` picks the training set whose heads predict a row."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(xs: pd.Series, ks: pd.Series) -> pd.Series:
        values, ids = bl.cleaned(np.array(xs.tolist(), dtype=float)), ks.to_numpy(int)
        res = np.zeros((len(values), shared.value.n_outputs))
        for k in np.unique(ids):
            res[ids == k] = shared.value.predict(values[ids == k], int(k))
        return pd.Series(list(res))

    return rows.withColumn(out, run(F.col(x), which.cast("int") if which is not None else F.lit(0)))


def importances(spark, model: Boosted, names: list[str], models: list[str], rows: int = 0) -> DataFrame:
    """(model, feature, importance): each feature's share of the gains, most important first."""
    data = []
    for h in model.heads:
        whole = sum(h.gains.values()) or 1.0
        if h.rows == rows:
            data += [(models[j], n, float(h.gains.get(i, 0.0) / whole)) for j in h.outputs for i, n in enumerate(names)]
    return spark.createDataFrame(data, "model string, feature string, importance double").orderBy("model", F.desc("importance"), "feature")


def save_router(spark, path: str, model: Boosted, names: list[str], models: list[str]) -> None:
    """Trees, borders, and the feature and candidate order, as small tables."""
    trees = [
        (h, head.rows, head.outputs, k, t.features, t.bins, t.values.ravel().tolist()) for h, head in enumerate(model.heads)
        for k, t in enumerate([Tree([], [], head.base[None]), *head.trees])
    ]
    spark.createDataFrame(trees, "head int, rows int, outputs array<int>, pos int, features array<int>, bins array<int>, values array<double>").coalesce(1).write.parquet(f"{path}/trees")
    order = [("feature", i, n, b.tolist(), model.rate) for i, (n, b) in enumerate(zip(names, model.borders, strict=True))]
    order += [("model", i, n, [], model.rate) for i, n in enumerate(models)]
    spark.createDataFrame(order, "kind string, pos int, name string, borders array<double>, rate double").coalesce(1).write.parquet(f"{path}/order")


def load_router(spark, path: str) -> tuple[Boosted, list[str], list[str]]:
    """(model, feature names, candidate names) in their saved order."""
    order = spark.read.parquet(f"{path}/order").orderBy("pos").collect()
    names, models = ([r.name for r in order if r.kind == kind] for kind in ("feature", "model"))
    heads: list[Head] = []
    for r in spark.read.parquet(f"{path}/trees").orderBy("head", "pos").collect():
        values = np.array(r["values"]).reshape(1 << len(r.features), len(r.outputs))
        if r.pos == 0:
            heads.append(Head(r.rows, list(r.outputs), values[0]))
        else:
            heads[r.head].trees.append(Tree(list(r.features), list(r.bins), values))
    borders = [np.array(r.borders) for r in order if r.kind == "feature"]
    return Boosted(borders, heads, order[0].rate, len(models)), names, models
