"""Near-duplicates by SimHash, found with a self-join of binary tries.

Fingerprints link when at most `budget` of their 64 bits differ. Two tries are joined with
themselves: one reads the bits as they are, one from the middle on. Of two linked fingerprints one
half differs in at most budget // 2 bits, so each trie prunes a node pair as soon as the upper half
has more than that many differing bits, or the whole more than `budget`.

The upper levels are traversed as tables: nodes are prefixes with their number of fingerprints,
node pairs descend four bits at a time while they hold more than `leaf` fingerprints. The rest of
each pair is traversed in one task of bounded size, which returns a spanning forest of its links
(never all pairs), and forests are merged to components by alternating stars.

Defined cases: a null text is empty; texts without words have fingerprint zero and link like any
other; fewer words than a shingle make one shingle; component_id is the smallest doc_id reachable
(null only if all ids of the component are null); repeated rows are rows of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointsman.llm.common import attach, checked
from pointsman.llm.exact_stream import located
from pointsman.session import written

BITS, HALF, STEP = 64, 32, 4


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit SimHash of the text's word shingles, unsigned."""
    # bytes.lower() and bytes.split() know ASCII only: A-Z, and white space 20 and 09 to 0D.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    first, last = (ends - sizes)[:n].tolist(), (ends[min(shingle, len(words)) - 1 :]).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(flat[a:b], 42) for a, b in zip(first, last, strict=True)), np.uint64, n)
    counts = np.zeros(BITS, np.int64)
    for k in range(0, n, 1 << 15):
        part = hashes[k : k + (1 << 15)].byteswap().view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, *more: str, shingle: int = 3) -> DataFrame:
    """doc_id, fp (signed) and the columns `more` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text")
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps), *[b.column(m) for m in more]], ["doc_id", "fp", *more])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([f"doc_id {kinds['doc_id']}", "fp bigint", *[f"`{m}` {kinds[m]}" for m in more]])
    return docs.select("doc_id", "text", *more).mapInArrow(run, schema)


# ---- traversal of one node pair -------------------------------------------------------------


def _budget(bit: int, budget: int) -> int:
    """Differing bits allowed among all bits down to `bit` (63 is the uppermost)."""
    return budget // 2 if bit >= HALF else budget


def trie_pairs(a: np.ndarray, b: np.ndarray, itself: bool, budget: int, top: int = BITS, small: int = 64, chunk: int = 1 << 17):
    """Index pairs (i into a, j into b) of sorted unsigned fingerprints within the budget, in chunks.

    The tries of `a` and `b` are traversed together, all node pairs of a level at once; a node is a
    range of the sorted array. Pairs of few fingerprints are compared directly.
    """
    one = np.uint64(1)
    start = np.array([[0], [len(a)], [0], [len(b)], [0]], np.int64)
    stack = [(top - 1, start)] if len(a) and len(b) else []
    while stack:
        bit, (la, ha, lb, hb, err) = stack.pop()
        few = (ha - la) * (hb - lb) <= small if bit >= 0 else np.ones(len(la), bool)
        if few.any():
            na, nb = (ha - la)[few], (hb - lb)[few]
            each = na * nb
            cuts = np.searchsorted(np.cumsum(each), np.arange(chunk, each.sum() + chunk, chunk), "left") + 1
            for s, e in zip([0, *cuts[:-1]], cuts, strict=True):
                m = each[s:e]
                if not m.sum():
                    continue
                k = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                i = np.repeat(la[few][s:e], m) + k // np.repeat(nb[s:e], m)
                j = np.repeat(lb[few][s:e], m) + k % np.repeat(nb[s:e], m)
                ok = np.bitwise_count(a[i] ^ b[j]) <= budget
                if itself:
                    ok &= i < j
                if ok.any():
                    yield i[ok], j[ok]
        la, ha, lb, hb, err = (x[~few] for x in (la, ha, lb, hb, err))
        if not len(la):
            continue
        t, above = np.uint64(bit), np.uint64(bit + 1) if bit < BITS - 1 else None
        base = lambda x: (x >> above << above if above is not None else np.zeros_like(x)) | (one << t)
        ma, mb = np.searchsorted(a, base(a[la])), np.searchsorted(b, base(b[lb]))
        ma, mb = np.clip(ma, la, ha), np.clip(mb, lb, hb)
        same = (la == lb) & (ha == hb) & itself
        parts = [
            np.array([la, ma, lb, mb, err]), np.array([ma, ha, mb, hb, err]), np.array([la, ma, mb, hb, err + 1]),
            np.array([ma, ha, lb, mb, err + 1])[:, ~same],
        ]
        nxt = np.concatenate(parts, axis=1)
        nxt = nxt[:, (nxt[0] < nxt[1]) & (nxt[2] < nxt[3]) & (nxt[4] <= _budget(bit, budget))]
        stack += [(bit - 1, nxt[:, k : k + chunk]) for k in range(0, nxt.shape[1], chunk)]


def _merge(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Labels (smallest index of the component) after adding the links u-v."""
    while True:
        x, y = label[u], label[v]
        far = x != y
        if not far.any():
            return label
        u, v, x, y = u[far], v[far], x[far], y[far]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, up := label[label]):
            label = up


def _linked(pdf: pd.DataFrame, budget: int) -> pd.DataFrame:
    """A spanning forest (fingerprint, smaller fingerprint) of the links in one node pair."""
    values = pdf["v"].to_numpy().view(np.uint64)
    side = pdf["side"].to_numpy()
    itself = bool(pdf["itself"].iloc[0])
    a = np.sort(values[side == 0])
    b = a if itself else np.sort(values[side == 1])
    label = np.arange(len(a) + (0 if itself else len(b)))
    shift = 0 if itself else len(a)
    for i, j in trie_pairs(a, b, itself, budget):
        label = _merge(label, i, j + shift)
    every = a if itself else np.concatenate([a, b])
    k = np.nonzero(label != np.arange(len(label)))[0]
    out = pd.DataFrame({"u": every[k].view(np.int64), "v": every[label[k]].view(np.int64)})
    return out.assign(turn=int(pdf["turn"].iloc[0]))


# ---- upper levels as tables -----------------------------------------------------------------


def _masks(n: int) -> list[int]:
    return [sum(1 << i for i in c) for r in range(n + 1) for c in combinations(range(STEP), r)]


def _prefix(depth: int):
    return F.shiftrightunsigned("v", BITS - depth).alias("node")


def node_pairs(values: DataFrame, budget: int, leaf: int) -> list[tuple[int, DataFrame]]:
    """(depth, node pairs turn, a, b) of the traversal's lower ends; a pair with at most `leaf` fingerprints ends."""
    ends, above = [], None
    for depth in range(STEP, BITS + 1, STEP):
        allowed = _budget(BITS - depth, budget)
        nodes = values.groupBy("turn", _prefix(depth)).agg(F.count("*").alias("n"))
        masks = F.array(*[F.struct(F.lit(m).cast("long").alias("mask"), F.lit(m.bit_count()).alias("e")) for m in _masks(allowed)])
        if above is None:
            grown = nodes.select("turn", F.col("node").alias("a"), F.lit(0).cast("long").alias("over"), F.lit(0).alias("err"), F.lit(True).alias("twin"), F.col("n").alias("na"))
        else:
            up = nodes.withColumn("pa", F.shiftright("node", STEP))
            grown = above.join(up, (F.col("up_a") == F.col("pa")) & (F.col("up_turn") == F.col("turn"))).select(
                "turn", F.col("node").alias("a"), F.shiftleft("up_b", STEP).alias("over"), "err", (F.col("up_a") == F.col("up_b")).alias("twin"), F.col("n").alias("na")
            )
        low = (1 << STEP) - 1
        tried = grown.select("*", F.explode(masks).alias("m")).where(F.col("err") + F.col("m.e") <= allowed)
        tried = tried.select("turn", "a", "na", (F.col("err") + F.col("m.e")).alias("err"), "twin", F.col("over").bitwiseOR(F.col("a").bitwiseAND(F.lit(low)).bitwiseXOR(F.col("m.mask"))).alias("b"))
        tried = tried.where(~F.col("twin") | (F.col("a") <= F.col("b")))
        pairs = tried.join(nodes.select("turn", F.col("node").alias("b"), F.col("n").alias("nb")), ["turn", "b"])
        pairs = written(pairs.select("turn", "a", "b", "err", (F.col("na") + F.col("nb")).alias("n")), "trie-pairs")
        large = F.col("n") > leaf if depth < BITS else F.lit(False)
        ends.append((depth, pairs.where(~large).select("turn", "a", "b")))
        above = pairs.where(large).select(F.col("turn").alias("up_turn"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), "err")
        if above.isEmpty():
            break
    return ends


def links(fps: DataFrame, budget: int = 3, leaf: int = 40_000) -> DataFrame:
    """Links u, v between different fingerprints (column fp) with the same components as all links within the budget."""
    turned = F.shiftleft("fp", HALF).bitwiseOR(F.shiftrightunsigned("fp", HALF))
    values = fps.select(F.explode(F.array(F.struct(F.lit(0).alias("turn"), F.col("fp").alias("v")), F.struct(F.lit(1).alias("turn"), turned.alias("v")))).alias("x")).select("x.*")
    dealt = None
    for depth, pairs in node_pairs(values, budget, leaf):
        itself = F.col("a") == F.col("b")
        sides = F.when(itself, F.array(F.struct(F.col("a").alias("node"), F.lit(0).alias("side")))).otherwise(
            F.array(F.struct(F.col("a").alias("node"), F.lit(0).alias("side")), F.struct(F.col("b").alias("node"), F.lit(1).alias("side")))
        )
        ends = pairs.select("turn", "a", "b", itself.alias("itself"), F.explode(sides).alias("s")).select("turn", "a", "b", "itself", "s.*")
        part = values.withColumn("node", _prefix(depth)).join(checked(ends), ["turn", "node"]).select("turn", "a", "b", "itself", "side", "v", F.lit(depth).alias("depth"))
        dealt = part if dealt is None else dealt.unionByName(part)
    found = dealt.groupBy("turn", "depth", "a", "b").applyInPandas(lambda pdf: _linked(pdf, budget), "u bigint, v bigint, turn int")
    back = lambda c: F.when(F.col("turn") == 1, F.shiftleft(c, HALF).bitwiseOR(F.shiftrightunsigned(c, HALF))).otherwise(F.col(c))
    return found.select(back("u").alias("u"), back("v").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """u, root: the smallest node reachable from every node of `edges` (u, v), roots included; alternating stars."""
    edges = written(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
    mark = lambda e: tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())
    before = mark(edges)
    if not before[0]:
        return edges.select("u", F.col("v").alias("root"))
    while True:
        for large in (True, False):
            near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
            best = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
            joined = attach(near, best, "u", "n", 2 * before[0], F.col("v"))
            if large:
                joined = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            else:
                joined = joined.select("v", "m").unionByName(best.select(F.col("u").alias("v"), "m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
            edges = written(joined.where("u != v").distinct(), "stars")
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges.select("u", F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())


def near_copies(docs: DataFrame, *more: str, shingle: int = 3, budget: int = 3, leaf: int = 40_000) -> DataFrame:
    """doc_id, fp, component_id, root and the columns `more` of every row of `docs`."""
    rows = written(fingerprints(docs, *more, shingle=shingle), "simhash")
    fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "simhash-values")
    total = rows.count()
    roots = components(links(fps, budget, leaf)) if total else fps.select(F.col("fp").alias("u"), F.col("fp").alias("root")).limit(0)
    rooted = fps.join(roots, F.col("fp") == F.col("u"), "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    tops = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("fps"))
    named = attach(rooted.select("fp", "n", "root"), tops, "root", "fps", total, F.col("fp")).select("fp", "n", "root", "component_id")
    return attach(rows, named, "fp", "n", total, F.xxhash64("doc_id", *more)).select("doc_id", "fp", "component_id", "root", *more)


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# ---- one of each group of near copies ---------------------------------------------------------

#: Tries of the wide budget (each reads the bits from another quarter on) and the ratio of shingle counts of one size class.
QUARTERS, RATIO = 4, 1.25


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The sorted, distinct 64-bit hashes of the text's word shingles; none for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = max(1, len(words) - shingle + 1) if words else 0
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(words[k : k + shingle]), 42) for k in range(n)), np.uint64, n))


def sketch(hashes: np.ndarray) -> bytes:
    """How many of the (distinct) hashes fall into each of 2^k equal ranges, one byte each, about two a range; empty if a count needs more."""
    bits = max(1, int(np.ceil(np.log2(max(1, len(hashes) / 2)))))
    counts = np.bincount((hashes >> np.uint64(BITS - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 256 else b""


def may_be_alike(x: bytes, y: bytes, m: int, n: int, similarity: float) -> bool:
    """Whether sets of m and n hashes with these sketches can have the similarity: they share no more than the smaller count of any range."""
    if not x or not y:
        return True
    a, b = sorted((np.frombuffer(v, np.uint8) for v in (x, y)), key=len)
    b = b.reshape(len(a), -1).sum(axis=1, dtype=np.int64)
    both = int(np.minimum(a, b).sum(dtype=np.int64))
    return both >= similarity * (m + n - both)


def quarter_pairs(a: np.ndarray, b: np.ndarray, budget: int, chunk: int = 1 << 15):
    """Index pairs (into the sorted unsigned `a` and `b`) within `budget` bits, of which at most a quarter in the leading quarter.

    Both tries are traversed together down to the leading quarter's last bit; what is left of a node pair is compared directly.
    """
    lead = BITS // QUARTERS
    stack = [(0, np.array([[0], [len(a)], [0], [len(b)], [0]], np.int64))] if len(a) and len(b) else []
    while stack:
        depth, nodes = stack.pop()
        la, ha, lb, hb, _ = nodes
        few = ((ha - la) * (hb - lb) <= 16) if depth < lead else np.ones(len(la), bool)
        large = few & ((ha - la) * (hb - lb) > chunk)
        if large.any():
            # Halved on the longer side until a piece fits.
            big = nodes[:, large]
            on_a = (big[1] - big[0]) >= (big[3] - big[2])
            mid = np.where(on_a, big[0] + big[1], big[2] + big[3]) // 2
            lower, upper = big.copy(), big.copy()
            lower[1], upper[0] = np.where(on_a, mid, big[1]), np.where(on_a, mid, big[0])
            lower[3], upper[2] = np.where(on_a, big[3], mid), np.where(on_a, big[2], mid)
            stack += [(depth, lower), (depth, upper)]
            nodes, few = nodes[:, ~large], few[~large]
            la, ha, lb, hb, _ = nodes
        if few.any():
            na, nb = (ha - la)[few], (hb - lb)[few]
            each = na * nb
            cuts = np.searchsorted(np.cumsum(each), np.arange(chunk, each.sum() + chunk, chunk), "left") + 1
            for s, e in zip([0, *cuts[:-1]], cuts, strict=True):
                m = each[s:e]
                if not m.sum():
                    continue
                k = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                i = np.repeat(la[few][s:e], m) + k // np.repeat(nb[s:e], m)
                j = np.repeat(lb[few][s:e], m) + k % np.repeat(nb[s:e], m)
                ok = np.bitwise_count(a[i] ^ b[j]) <= budget
                if ok.any():
                    yield i[ok], j[ok]
        la, ha, lb, hb, err = nodes[:, ~few]
        if not len(la):
            continue
        bit = np.uint64(BITS - 1 - depth)
        top = lambda x: (x >> bit | np.uint64(1)) << bit
        ma, mb = np.clip(np.searchsorted(a, top(a[la])), la, ha), np.clip(np.searchsorted(b, top(b[lb])), lb, hb)
        parts = [np.array([la, ma, lb, mb, err]), np.array([ma, ha, mb, hb, err]), np.array([la, ma, mb, hb, err + 1]), np.array([ma, ha, lb, mb, err + 1])]
        nxt = np.concatenate(parts, axis=1)
        nxt = nxt[:, (nxt[0] < nxt[1]) & (nxt[2] < nxt[3]) & (nxt[4] <= budget // QUARTERS)]
        stack += [(depth + 1, nxt[:, k : k + chunk]) for k in range(0, nxt.shape[1], chunk)]


def _class(size: str) -> Column:
    """Sets of a similarity of 0.8 or more are of the same size class or of neighbouring ones."""
    return F.floor(F.log(F.greatest(F.col(size), F.lit(1)).cast("double")) / float(np.log(RATIO))).cast("long")


def _dealt(rows: DataFrame, budget: int, leaf: int) -> DataFrame:
    """`rows` (i, fp, class, asks) with the node pair they meet in: turn, window, a, mask, side.

    A window is a size class and the next larger one. Prefixes of the leading quarter are as long as groups of about `leaf` rows need; a row
    goes to every prefix within the quarter's share of the budget. A node pair is named by its lower prefix and the difference.
    """
    turned = [F.shiftleft("fp", k * BITS // QUARTERS).bitwiseOR(F.shiftrightunsigned("fp", BITS - k * BITS // QUARTERS)) if k else F.col("fp") for k in range(QUARTERS)]
    turns = F.array(*[F.struct(F.lit(k).alias("turn"), v.alias("v")) for k, v in enumerate(turned)])
    most = rows.groupBy("class").count().agg(F.max("count")).first()[0] or 0
    depth = min(BITS // QUARTERS, max(0, int(np.ceil(np.log2(max(1, 2 * most / leaf))))))
    node = F.shiftrightunsigned("v", BITS - depth) if depth else F.lit(0).cast("long")
    masks = [sum(1 << i for i in c) for r in range(min(budget // QUARTERS, depth) + 1) for c in combinations(range(depth), r)]
    met = rows.select("i", "asks", "class", F.explode(turns).alias("t")).select("i", "asks", "class", "t.*")
    met = met.withColumn("low", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("window", F.col("class") - F.col("low")).drop("class").withColumn("node", node)
    met = met.withColumn("mask", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])))
    met = met.withColumn("a", F.least("node", F.col("node").bitwiseXOR(F.col("mask"))))
    return met.withColumn("side", (F.col("node") != F.col("a")).cast("int")).drop("node")


class _Meeting:
    """The rows of one node pair, in the order of their numbers."""

    def __init__(self, pdf: pd.DataFrame, budget: int):
        pdf = pdf.sort_values("i")
        self.ids, self.v, self.asks = pdf["i"].to_numpy(), pdf["v"].to_numpy().view(np.uint64), pdf["asks"].to_numpy()
        self.side, self.low, self.budget = pdf["side"].to_numpy(), pdf["low"].to_numpy(), budget
        self.one = pdf["mask"].iloc[0] == 0

    def pairs(self, q: np.ndarray, h: np.ndarray):
        """Pairs of the rows q and h within the budget (in a window, not two of its larger class, which meet in another)."""
        sides = [(q, h)] if self.one else [(q[self.side[q] == s], h[self.side[h] != s]) for s in (0, 1)]
        for x, y in sides:
            x, y = x[np.argsort(self.v[x], kind="stable")], y[np.argsort(self.v[y], kind="stable")]
            for i, j in quarter_pairs(self.v[x], self.v[y], self.budget):
                i, j = x[i], y[j]
                ok = ((self.low[i] == 0) | (self.low[j] == 0)) & (i != j)
                yield i[ok], j[ok]


def _first_neighbours(rows: DataFrame, budget: int, leaf: int) -> DataFrame:
    """(i, m): the smallest row number that each row is within the budget of, if it is smaller than its own.

    Equal fingerprints of a size class are one row first. In a task, rows look among the first ones before they look further, and leave once they
    have found one, so a group of near copies costs no more than its size.
    """
    rows = rows.withColumn("key", F.concat_ws(":", "fp", "class"))
    groups = written(rows.groupBy("key", "fp", "class").agg(F.min("i").alias("i"), F.count("*").alias("n")), "simhash-groups")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        met = _Meeting(pdf, budget)
        n = len(met.ids)
        best, left, start, size = np.arange(n), np.arange(n), 0, 1024
        while start < n and len(left):
            for i, j in met.pairs(left, np.arange(start, min(n, start + size))):
                np.minimum.at(best, i, j)
            start, size = start + size, 2 * size
            left = left[(left >= start) & (best[left] == left)]
        k = np.nonzero(best < np.arange(n))[0]
        return pd.DataFrame({"i": met.ids[k], "m": met.ids[best[k]]})

    met = _dealt(groups.withColumn("asks", F.lit(False)), budget, leaf).groupBy("turn", "window", "a", "mask").applyInPandas(run, "i bigint, m bigint")
    least = met.groupBy("i").agg(F.min("m").alias("m"))
    least = groups.join(least, "i", "left").select("key", "n", F.least("i", F.coalesce("m", "i")).alias("m"))
    found = attach(rows.select("i", "key"), least, "key", "n", rows.count(), F.col("i"))
    return found.where("m < i").select("i", "m")


def _asked(rows: DataFrame, budget: int, leaf: int) -> DataFrame:
    """(i, hub): rows that do not ask, each with every asking row within the budget."""
    # Rows are spread over copies of the asking ones, which are few where rows are near each other.
    salts = 1 + rows.count() // (20 * leaf)
    salt = F.when(F.col("asks"), F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).otherwise(F.array(F.pmod(F.xxhash64("i"), F.lit(salts).cast("long"))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        met = _Meeting(pdf, budget)
        out = [np.zeros((2, 0), np.int64)]
        for i, j in met.pairs(np.nonzero(~met.asks)[0], np.nonzero(met.asks)[0]):
            out.append(np.stack([met.ids[i], met.ids[j]]))
        found = np.unique(np.concatenate(out, axis=1), axis=1)
        return pd.DataFrame({"i": found[0], "hub": found[1]})

    dealt = _dealt(rows, budget, leaf).withColumn("salt", F.explode(salt))
    return dealt.groupBy("turn", "window", "a", "mask", "salt").applyInPandas(run, "i bigint, hub bigint").distinct()


def _alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (len(x) + len(y) - both)


def _possible(pairs: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """The `pairs` (i, hub) whose sketches allow the similarity; `rows` has i, size and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column(c) for c in ("own", "theirs", "m", "n")]
            keep = [may_be_alike(x.as_py(), y.as_py(), m.as_py(), n.as_py(), similarity) for x, y, m, n in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("i"), b.column("hub")], ["i", "hub"]).filter(pa.array(keep, pa.bool_()))

    pairs = written(pairs, "simhash-asked")
    both = _joined(pairs, rows, F.col("size").alias("n"), F.col("sketch").alias("theirs"))
    both = both.join(rows.select("i", F.col("size").alias("m"), F.col("sketch").alias("own")), "i")
    return written(both.select("i", "hub", "own", "theirs", "m", "n").mapInArrow(run, "i bigint, hub bigint"), "simhash-possible")


def _joined(pairs: DataFrame, rows: DataFrame, *columns: Column) -> DataFrame:
    """`pairs` with `columns` of their hubs' rows; a hub may have any share of the pairs."""
    sizes = written(pairs.groupBy("hub").agg(F.count("*").alias("_n")), "simhash-hubs")
    hubs = sizes.join(rows.select(F.col("i").alias("hub"), *columns), "hub")
    return attach(pairs, hubs, "hub", "_n", pairs.count(), F.col("i"))


def _similar(pairs: DataFrame, sets: Callable[[DataFrame], DataFrame], similarity: float) -> DataFrame:
    """The rows i of `pairs` (i, hub) whose shingles have the similarity with some hub's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column("own"), b.column("theirs")]
            keep = [_alike(*(np.frombuffer(v.as_py(), np.uint64) for v in both), similarity) for both in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("i")], ["i"]).filter(pa.array(keep, pa.bool_()))

    wanted = written(sets(pairs.select("i").unionByName(pairs.select(F.col("hub").alias("i"))).distinct()), "simhash-wanted")
    both = _joined(pairs, wanted, F.col("set").alias("theirs")).join(wanted.select("i", F.col("set").alias("own")), "i")
    return both.select("i", "own", "theirs").mapInArrow(run, "i bigint").distinct()


#: The last rows (and bytes of their shingle sets) that one task finishes.
LAST, LAST_BYTES = 10_000, 64 << 20


def _finished(rows: DataFrame, budget: int, similarity: float) -> DataFrame:
    """(i) of the rows of (i, fp, class, set) that stay when they are taken one by one: what further rounds would keep."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        v, kind = pdf["fp"].to_numpy().view(np.uint64), pdf["class"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in pdf["set"]]
        kept = np.zeros(0, np.int64)
        for k in range(len(v)):
            near = kept[(np.bitwise_count(v[kept] ^ v[k]) <= budget) & (np.abs(kind[kept] - kind[k]) <= 1)]
            if not any(_alike(sets[k], sets[j], similarity) for j in near):
                kept = np.append(kept, k)
        return pd.DataFrame({"i": pdf["i"].to_numpy()[kept]})

    return rows.withColumn("whole", F.lit(0)).groupBy("whole").applyInPandas(run, "i bigint")


def kept_rows(rows: DataFrame, sets: Callable[[DataFrame], DataFrame], budget: int = 15, similarity: float = 0.8, leaf: int = 100_000) -> DataFrame:
    """(i) of the rows of (i, fp, size, sketch) that stay: each other row is similar to one that stays, and no two of them are found similar.

    In a round, a row without an earlier neighbour within the budget stays, and rows whose shingles have the similarity with it go; the others try again
    among themselves. That keeps the rows that taking all rows in order would keep, so the last few, which would need a round for every link of a
    chain, are taken in order by one task. `sets` gives (i, set) of the rows of a frame (i): only pairs whose sketches allow the similarity need them.
    """
    if similarity < 1 / RATIO:
        raise ValueError("size classes are made for a similarity of 0.8 or more")
    left = written(rows.select("i", "fp", "size", _class("size").alias("class")), "simhash-left")
    stay = None
    while True:
        first = written(_first_neighbours(left, budget, leaf), "simhash-first")
        marked = left.join(first.select("i", F.lit(False).alias("asks")), "i", "left")
        marked = written(marked.withColumn("asks", F.coalesce("asks", F.lit(True))), "simhash-round")
        hubs = marked.where("asks").select("i")
        stay = hubs if stay is None else stay.unionByName(hubs)
        rest = marked.where("not asks").drop("asks")
        if rest.isEmpty():
            return stay
        possible = _possible(_asked(marked, budget, leaf), rows, similarity)
        gone = written(_similar(possible, sets, similarity), "simhash-gone")
        left = written(rest.join(gone, "i", "left_anti"), "simhash-left")
        n, size = left.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        if n <= LAST and 8 * size <= LAST_BYTES:
            return stay.unionByName(written(_finished(left.join(sets(left.select("i")), "i"), budget, similarity), "simhash-last")) if n else stay


def one_of_each(docs: DataFrame, shingle: int = 5, budget: int = 15, similarity: float = 0.8) -> DataFrame:
    """The rows of `docs` that stay when of similar ones (shingles of five words, Jaccard 0.8 or more) one is kept, with all their columns.

    Candidates are fingerprints of the same shingles within `budget` bits: near copies at the very limit of the similarity differ in ten bits on
    average, so most are found; every candidate is compared by its whole shingles, so no other row goes. A row goes only for its similarity with one
    that stays, never through others; of two similar rows that of the smaller id is tried first. Texts without words are similar to each other. Rows with
    equal ids are told apart by file and row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, sizes, sketches = [], [], []
            for t in b.column("text"):
                hashes = shingle_set(t := t.as_py(), shingle)
                fps.append(fingerprint(t, shingle))
                sizes.append(len(hashes))
                sketches.append(sketch(hashes))
            columns = [pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("d"), b.column("f"), b.column("r"), *columns], ["d", "f", "r", "fp", "size", "sketch"])

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                sets = pa.array([shingle_set(t.as_py(), shingle).tobytes() for t in part.column("text")], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("i"), sets], ["i", "set"])

    places, file, row = located(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = places.select(F.col("doc_id").alias("d"), F.col(file).alias("f"), F.col(row).alias("r"), "text")
    # Written first, as ordering by ranges reads its input twice.
    made = written(made.mapInArrow(run, f"d {kind}, f string, r bigint, fp bigint, size bigint, sketch binary"), "simhash-made")
    # Row numbers in the order of ids, whatever files the rows came from.
    made = made.repartitionByRange("d", "f", "r").sortWithinPartitions("d", "f", "r")
    rows = written(made.withColumn("i", F.monotonically_increasing_id()).drop("d"), "simhash-rows")

    def sets_of(wanted: DataFrame) -> DataFrame:
        """Shingle sets are made anew of the texts that need them, as all of them would be far larger than the texts."""
        found = checked(rows.select("i", F.col("f").alias(file), F.col("r").alias(row)).join(wanted, "i", "left_semi"), 100_000)
        return places.select("text", file, row).join(found, [file, row]).select("i", "text").mapInArrow(shingled, "i bigint, set binary")

    keep = rows.join(kept_rows(rows, sets_of, budget, similarity), "i", "left_semi").select(F.col("f").alias(file), F.col("r").alias(row))
    return places.join(keep, [file, row], "left_semi").drop(file, row)
