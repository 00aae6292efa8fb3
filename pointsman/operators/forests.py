"""Forests of squared error, one per candidate: bootstrapped trees with a few random features a node.

Features are cut once into bins at approximate quantiles, and rows are packed into blocks. As long as a node holds
more than `LOCAL` rows, all trees grow level by level from sums that tasks add up by node, feature and bin. What is
left of a node then goes to one task, which grows it to the end: sums of nodes of a few rows would be far larger
than the rows. Tables of at most `LOCAL` rows go there whole, to a task per few trees. A row's weight in a tree is a
Poisson draw seeded by its block's bytes and the tree, so all candidates share them and a lost task draws them again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointsman.operators import blocks as bl
from pointsman.operators.boosting import BINS, binned_rows, quantile_borders
from pointsman.session import spread

#: The most rows of a node that one task finishes.
LOCAL = 1 << 20
#: Groups that trees are dealt into when a task can hold all rows.
GROUPS = 100
#: Numbers that the sums of one job hold.
SUMS = 1 << 23
LEAF = 65535


@dataclass
class Nodes:
    """A tree: `child` is the left one of a node, the right one follows it; a leaf's feature is `LEAF`."""

    feature: np.ndarray  # uint16
    border: np.ndarray  # uint8, rows beyond this bin go right
    child: np.ndarray  # int32
    value: np.ndarray  # float32

    def leaves(self, b: np.ndarray) -> np.ndarray:
        at = np.zeros(len(b), np.int64)
        flat, row = b.ravel(), np.arange(len(b)) * b.shape[1]
        on = np.nonzero(self.feature[at] != LEAF)[0]
        while len(on):
            node = at[on]
            node = self.child[node] + (flat[row[on] + self.feature[node]] > self.border[node])
            at[on] = node
            on = on[self.feature[node] != LEAF]
        return at


@dataclass
class Forest:
    borders: list[np.ndarray]
    trees: list[Nodes]
    featureImportances: np.ndarray  # as MLlib's models name it

    def predict(self, binned: np.ndarray) -> np.ndarray:
        total = np.zeros(len(binned))
        for t in self.trees:
            total += t.value[t.leaves(binned)]
        return total / len(self.trees)


def _questions(counts: np.ndarray, sums: np.ndarray, min_leaf: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per node the best (feature slot, bin), its gain and the rows on its left, from (nodes, slots, bins) sums; a node without a question has no gain."""
    left, ls = np.cumsum(counts, axis=2), np.cumsum(sums, axis=2)
    n, s = left[:, :1, -1:], ls[:, :1, -1:]
    right, rs = n - left, s - ls
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where((left >= min_leaf) & (right >= min_leaf), ls * ls / left + rs * rs / right - s * s / n, 0.0)
    flat = gain.reshape(len(gain), -1)
    best = flat.argmax(axis=1)
    rows = np.arange(len(best))
    slot, bin_ = np.divmod(best, counts.shape[2])
    # Sums that are equal up to rounding are no gain.
    found = flat[rows, best]
    found = np.where(found > 1e-10 * (1e-300 + np.abs(s[:, 0, 0] * s[:, 0, 0] / np.maximum(n[:, 0, 0], 1))), found, 0.0)
    return slot, bin_, found, left[rows, slot, bin_]


def _sums(b: np.ndarray, rows: np.ndarray, node: np.ndarray, chosen: np.ndarray, w: np.ndarray, wy: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, slots, bins) weights and weighted outputs of `rows`, over the features chosen for their nodes."""
    k, slots = chosen.shape
    flat, at = b.ravel(), rows * b.shape[1]
    counts, sums = np.empty((k, slots, bins)), np.empty((k, slots, bins))
    for j in range(slots):
        code = node * bins + flat[at + chosen[node, j]]
        counts[:, j] = np.bincount(code, w, k * bins).reshape(k, bins)
        sums[:, j] = np.bincount(code, wy, k * bins).reshape(k, bins)
    return counts, sums


def _chosen(rng: np.random.Generator, nodes: int, d: int) -> np.ndarray:
    """The features each node may ask for: the root of their number, rounded up."""
    return np.argpartition(rng.random((nodes, d)), min(d - 1, int(np.ceil(np.sqrt(d)))), axis=1)[:, : int(np.ceil(np.sqrt(d)))]


def grown(b: np.ndarray, y: np.ndarray, w: np.ndarray, depth: int, min_leaf: int, bins: int, rng: np.random.Generator) -> tuple[Nodes, np.ndarray]:
    """A tree of at most `depth` levels of questions on the rows with a weight, and the gains by feature."""
    d = b.shape[1]
    gains = np.zeros(d)
    rows = np.nonzero(w)[0]
    w = w[rows].astype(float)
    wy = w * y[rows]
    node, k, made = np.zeros(len(rows), np.int64), 1, 1
    levels: list[tuple[np.ndarray, ...]] = []
    for level in range(depth + 1):
        n, s = np.bincount(node, w, k), np.bincount(node, wy, k)
        feature, border, child = np.full(k, LEAF, np.uint16), np.zeros(k, np.uint8), np.zeros(k, np.int32)
        value = (s / np.maximum(n, 1)).astype(np.float32)
        asks = np.nonzero(n >= 2 * min_leaf)[0] if level < depth else np.zeros(0, np.int64)
        if len(asks):
            place = np.full(k, -1)
            place[asks] = np.arange(len(asks))
            on = place[node] >= 0
            rows, node, w, wy = rows[on], place[node[on]], w[on], wy[on]
            chosen = _chosen(rng, len(asks), d)
            slot, bin_, gain, _ = _questions(*_sums(b, rows, node, chosen, w, wy, bins), min_leaf)
            cut = np.nonzero(gain > 0)[0]
            f = chosen[cut, slot[cut]]
            feature[asks[cut]], border[asks[cut]], child[asks[cut]] = f, bin_[cut], made + 2 * np.arange(len(cut))
            np.add.at(gains, f, gain[cut])
        levels.append((feature, border, child, value))
        if not len(asks) or not len(cut):
            break
        place = np.full(len(asks), -1)
        place[cut] = np.arange(len(cut))
        on = place[node] >= 0
        rows, node, w, wy = rows[on], place[node[on]], w[on], wy[on]
        node = 2 * node + (b.ravel()[rows * d + f[node]] > bin_[cut][node])
        k, made = 2 * len(cut), made + 2 * len(cut)
    return Nodes(*(np.concatenate(p) for p in zip(*levels, strict=True))), gains


class _Growing:
    """The upper levels of a tree while they grow; `open` are the nodes that may still ask, with their level."""

    def __init__(self, rows: float, d: int):
        self.feature, self.border, self.child, self.value = [LEAF], [0], [0], [0.0]
        self.open, self.gains = {0: (0, rows)}, np.zeros(d)

    def nodes(self) -> Nodes:
        return Nodes(np.array(self.feature, np.uint16), np.array(self.border, np.uint8), np.array(self.child, np.int32), np.array(self.value, np.float32))

    def ask(self, node: int, feature: int, border: int, left: float) -> None:
        level, rows = self.open.pop(node)
        self.feature[node], self.border[node], self.child[node] = feature, border, len(self.feature)
        for n in (left, rows - left):
            self.open[len(self.feature)] = (level + 1, n)
            self.feature.append(LEAF)
            self.border.append(0)
            self.child.append(0)
            self.value.append(0.0)

    def graft(self, node: int, own: Nodes, gains: np.ndarray) -> None:
        """Put a tree that was grown elsewhere in the place of an open node; its root takes the node's place."""
        at = len(self.feature) - 1
        for k, to in enumerate([node, *range(at + 1, at + len(own.feature))]):
            if to == len(self.feature):
                for column in (self.feature, self.border, self.child, self.value):
                    column.append(0)
            self.feature[to], self.border[to], self.value[to] = int(own.feature[k]), int(own.border[k]), float(own.value[k])
            self.child[to] = int(own.child[k]) + at if own.feature[k] != LEAF else 0
        self.gains += gains


def _weights(seed: int, tree: int, mark: int, n: int) -> np.ndarray:
    return np.random.default_rng([seed, tree, mark]).poisson(1.0, n)


def fit(
    train: DataFrame, models: list[str], x: str = "x", y: str = "score", trees: int = 400, min_leaf: int = 2, depth: int = 12, seed: int = 3407, bins: int = BINS,
    local: int | None = None, **_,
) -> list[Forest]:
    """One forest per candidate, on the rows that observe it."""
    top = train.select(F.size(x).alias("d")).first()
    if top is None:
        raise ValueError("no training rows")
    d, m, local = top.d, len(models), LOCAL if local is None else local
    if d >= LEAF:
        raise ValueError(f"at most {LEAF - 1} features")
    # A row without outputs is observed by no candidate.
    train = train.where(F.col(y).isNotNull())
    borders = quantile_borders(train, x, d, bins)

    def build(c):
        xs, ys = bl.cleaned(bl.dense(c["_x"], d)), bl.dense(c["_y"], m)
        return {"bins": binned_rows(xs, borders).tobytes(), "y": ys.astype("<f8").tobytes()}

    data = bl.pack(train.select(F.col(x).alias("_x"), F.col(y).alias("_y")), ["_x", "_y"], build, ["bins", "y"])

    def unpack(n, bins_, y_):
        return np.frombuffer(bins_, np.uint8).reshape(n, d), np.frombuffer(y_, "<f8").reshape(n, m), zlib.crc32(y_, zlib.crc32(bins_))

    def seen(out, *row):
        out[0] += row[0]
        out[1:] += np.isfinite(unpack(*row)[1]).sum(0)

    n_rows, *observed = data.total(seen, 1 + m)
    for name, n in zip(models, observed, strict=True):
        if n < 2:
            raise ValueError(f"candidate {name!r} has fewer than two observed training rows")
    growing = {(t, c): _Growing(observed[c], d) for t in range(trees) for c in range(m)}
    if n_rows <= local:
        parts = _whole(data, trees, m, unpack, depth, min_leaf, bins, seed)
    else:
        _upper(data, growing, d, unpack, depth, min_leaf, bins, seed, local)
        parts = _rest(data, growing, d, unpack, depth, min_leaf, bins, seed)
    # The model and nothing else comes to the driver.
    arrow = parts.toArrow()
    data.release()
    names = ("tree", "candidate", "node", "feature", "border", "child", "value", "gains")
    for t, c, node, feature, border, child, value, gains in zip(*(arrow.column(k) for k in names), strict=True):
        own = Nodes(
            np.frombuffer(feature.as_buffer(), "<u2"), np.frombuffer(border.as_buffer(), np.uint8), np.frombuffer(child.as_buffer(), "<i4"),
            np.frombuffer(value.as_buffer(), "<f4"),
        )
        tree, gains = growing[t.as_py(), c.as_py()], np.frombuffer(gains.as_buffer(), "<f8")
        if node.as_py() == 0 and len(tree.feature) == 1:
            growing[t.as_py(), c.as_py()] = (own, gains)
        else:
            tree.graft(node.as_py(), own, gains)
    out = []
    for c in range(m):
        done = [(g.nodes(), g.gains) if isinstance(g, _Growing) else g for g in (growing[t, c] for t in range(trees))]
        shares = sum(g / g.sum() if g.sum() > 0 else g for _, g in done)
        out.append(Forest(borders, [n for n, _ in done], shares / shares.sum() if shares.sum() > 0 else shares))
    return out


_PARTS = "tree int, candidate int, node int, feature binary, border binary, child binary, value binary, gains binary"


def _part(t: int, c: int, node: int, own: Nodes, gains: np.ndarray) -> tuple:
    return t, c, node, own.feature.astype("<u2").tobytes(), own.border.tobytes(), own.child.astype("<i4").tobytes(), own.value.astype("<f4").tobytes(), gains.tobytes()


def _frame(parts: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(parts, columns=["tree", "candidate", "node", "feature", "border", "child", "value", "gains"])


def _whole(data: bl.Blocks, trees: int, m: int, unpack, depth: int, min_leaf: int, bins: int, seed: int) -> DataFrame:
    """Trees of a table that one task can hold: a task gets all blocks and grows a few trees of every candidate."""
    groups = min(trees, GROUPS)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        made = sorted((unpack(*row) for row in zip(pdf["n"], pdf["bins"], pdf["y"], strict=True)), key=lambda r: (r[2], r[1].tobytes()))
        b, ys = np.concatenate([r[0] for r in made]), np.concatenate([r[1] for r in made])
        parts = []
        for t in range(key[0], trees, groups):
            w = np.concatenate([_weights(seed, t, mark, len(own)) for own, _, mark in made])
            for c in range(m):
                on = np.isfinite(ys[:, c])
                own = grown(b, np.where(on, ys[:, c], 0.0), w * on, depth, min_leaf, bins, np.random.default_rng([seed, t, c, 0]))
                parts.append(_part(t, c, 0, *own))
        return _frame(parts)

    dealt = data.frame.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return spread(dealt, "part").groupBy("part").applyInPandas(run, _PARTS)


def _upper(data: bl.Blocks, growing: dict, d: int, unpack, depth: int, min_leaf: int, bins: int, seed: int, local: int) -> None:
    """Grow the nodes of more than `local` rows, a level of all trees at a time, in jobs of `SUMS` numbers at most."""
    slots = int(np.ceil(np.sqrt(d)))
    for level in range(depth):
        wanted = [(key, [n for n, (at, rows) in g.open.items() if at == level and rows > local]) for key, g in growing.items()]
        wanted = [(key, nodes) for key, nodes in wanted if nodes]
        while wanted:
            batch, size = [], 0
            while wanted and (not batch or size + 2 * len(wanted[0][1]) * slots * bins <= SUMS):
                (t, c), nodes = wanted.pop(0)
                chosen = _chosen(np.random.default_rng([seed, t, c, level + 1]), len(nodes), d)
                batch.append((t, c, np.array(nodes), chosen, growing[t, c].nodes(), size))
                size += 2 * len(nodes) * slots * bins

            def add(out, *row, batch=tuple(batch)):
                b, ys, mark = unpack(*row)
                for t, c, nodes, chosen, tree, at in batch:
                    w = _weights(seed, t, mark, len(b)) * np.isfinite(ys[:, c])
                    rows = np.nonzero(w)[0]
                    place = np.full(len(tree.feature), -1)
                    place[nodes] = np.arange(len(nodes))
                    node = place[tree.leaves(b[rows])]
                    rows, node = rows[node >= 0], node[node >= 0]
                    both = np.stack(_sums(b, rows, node, chosen, w[rows], w[rows] * ys[rows, c], bins))
                    out[at : at + both.size] += both.ravel()

            z = data.total(add, size)
            for t, c, nodes, chosen, _, at in batch:
                counts, sums = z[at : at + 2 * len(nodes) * slots * bins].reshape(2, len(nodes), slots, bins)
                slot, border, gain, left = _questions(counts, sums, min_leaf)
                n, s = counts[:, 0].sum(1), sums[:, 0].sum(1)
                tree = growing[t, c]
                for k, node in enumerate(nodes.tolist()):
                    # The number of the weighted rows is known from here on.
                    tree.open[node] = (level, float(n[k]))
                    if gain[k] > 0:
                        f = int(chosen[k, slot[k]])
                        tree.gains[f] += gain[k]
                        tree.ask(node, f, int(border[k]), float(left[k]))
                    else:
                        tree.open.pop(node)
                        tree.value[node] = float(s[k] / max(n[k], 1.0))


def _rest(data: bl.Blocks, growing: dict, d: int, unpack, depth: int, min_leaf: int, bins: int, seed: int) -> DataFrame:
    """Finish all open nodes: the rows of each go to one task. Nodes at the last level get their value there."""
    cut = [(t, c, g.nodes(), np.array(sorted(g.open), np.int64), dict(g.open)) for (t, c), g in growing.items() if g.open]
    spark = data.frame.sparkSession
    shared = spark.sparkContext.broadcast(cut)
    key = ["tree", "candidate", "node", "level"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("n", "bins", "y")), strict=True):
                b, ys, mark = unpack(*row)
                for t, c, tree, nodes, levels in shared.value:
                    w = _weights(seed, t, mark, len(b)) * np.isfinite(ys[:, c])
                    rows = np.nonzero(w)[0]
                    at = tree.leaves(b[rows])
                    order = np.argsort(at, kind="stable")
                    rows, at = rows[order], at[order]
                    low, high = np.searchsorted(at, nodes, "left"), np.searchsorted(at, nodes, "right")
                    out = []
                    for node, i, j in zip(nodes.tolist(), low, high, strict=True):
                        if i < j:
                            own = rows[i:j]
                            out.append((t, c, node, levels[node][0], mark, b[own].tobytes(), ys[own, c].astype("<f8").tobytes(), w[own].astype(np.uint8).tobytes()))
                    if out:
                        yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=[*key, "mark", "bins", "y", "w"]), schema=schema, preserve_index=False)

    schema = pa.schema([*((k, pa.int32()) for k in key), ("mark", pa.int64()), *((k, pa.binary()) for k in ("bins", "y", "w"))])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        t, c, node, level = (int(k) for k in key)
        pdf = pdf.sort_values(["mark", "bins"])
        b = np.frombuffer(b"".join(pdf["bins"]), np.uint8).reshape(-1, d)
        ys, w = np.frombuffer(b"".join(pdf["y"]), "<f8"), np.frombuffer(b"".join(pdf["w"]), np.uint8)
        own = grown(b, ys, w, depth - level, min_leaf, bins, np.random.default_rng([seed, t, c, 0, node]))
        return _frame([_part(t, c, node, *own)])

    dealt = data.frame.mapInArrow(deal, "tree int, candidate int, node int, level int, mark bigint, bins binary, y binary, w binary")
    return dealt.groupBy(*key).applyInPandas(run, _PARTS)


def predict(rows: DataFrame, forests: list[Forest], x: str = "x", out: str = "pred") -> DataFrame:
    """Add the array of predictions, one per candidate."""
    shared = rows.sparkSession.sparkContext.broadcast(forests)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for xs in batches:
            binned = binned_rows(bl.cleaned(np.array(xs.tolist(), dtype=float).reshape(len(xs), -1)), shared.value[0].borders)
            yield pd.Series(list(np.stack([f.predict(binned) for f in shared.value], axis=1)))

    return rows.withColumn(out, run(F.col(x)))


def save(spark, path: str, forest: Forest) -> None:
    """A forest as a table of its trees and one of its borders."""
    trees = [(k, *_part(0, 0, 0, t, np.zeros(0))[3:7]) for k, t in enumerate(forest.trees)]
    spark.createDataFrame(trees, "pos int, feature binary, border binary, child binary, value binary").coalesce(1).write.parquet(f"{path}/trees")
    rows = [(k, b.tolist(), float(v)) for k, (b, v) in enumerate(zip(forest.borders, forest.featureImportances, strict=True))]
    spark.createDataFrame(rows, "pos int, borders array<double>, importance double").coalesce(1).write.parquet(f"{path}/borders")


def load(spark, path: str) -> Forest:
    trees = [
        Nodes(np.frombuffer(r.feature, "<u2"), np.frombuffer(r.border, np.uint8), np.frombuffer(r.child, "<i4"), np.frombuffer(r.value, "<f4"))
        for r in spark.read.parquet(f"{path}/trees").orderBy("pos").collect()
    ]
    rows = spark.read.parquet(f"{path}/borders").orderBy("pos").collect()
    return Forest([np.array(r.borders) for r in rows], trees, np.array([r.importance for r in rows]))
