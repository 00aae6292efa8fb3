"""Repeated byte strings by a distributed merge sort of front-coded suffix runs.

A string of `width` bytes that starts twice repeats. Each such window is owned by the suffix that
starts with its smallest `gram`-byte hash, so equal windows are owned by equal suffixes and only
those, about one in forty, are sorted (a sparse suffix array). Every task sorts its suffixes into
runs, front-codes them (bytes shared with the predecessor are sent as a number) and deals them by
splitters; a loser tree merges the runs of a range, comparing only bytes past the known common
prefix. Suffixes of one task with the same first bytes travel once.

Suffixes that share their first `gram` bytes with another are hits. A second merge sort of the same
form takes, for the hits alone, all bytes of the windows they own and finds for every window
whether an equal one starts earlier. Equal surroundings travel once per task, the rest being
decided there; first bytes with more than `wide` hits are dealt by whole windows instead.

Defined cases: null texts are empty; order is by doc_id (null first), then by the text's hash, then by
place; rows with equal doc_id and text are one document and get the same result; documents under
`width` bytes lose nothing and hide nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointsman.llm.common import checked
from pointsman.session import written

WIDTH, GRAM = 100, 24
NULL_ID = -(2**63)
#: Characters of a run before it is sealed, and of the text scanned at once.
RUN_BYTES, SCAN = 48 << 20, 1 << 19
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


# ---- owners of windows ----------------------------------------------------------------------


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _A
    x ^= x >> np.uint64(29)
    x += b
    x *= _B
    x ^= x >> np.uint64(32)
    return x


def owners(flat: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(p, first, last): suffix p owns the windows that start at first..last (all inside `flat`).

    A window's owner is the leftmost of its smallest gram hashes, so owners never move backwards.
    """
    n = len(flat) - width + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    g, have = flat.astype(np.uint64), 1
    while have < gram:
        step = min(have, gram - have)
        g, have = _mix(g[:-step], g[step:]), have + step
    places = np.uint64(max(1, (len(g) - 1).bit_length()))
    low = (g >> places << places) | np.arange(len(g), dtype=np.uint64)
    have, wide = 1, width - gram + 1
    while have < wide:
        step = min(have, wide - have)
        low, have = np.minimum(low[:-step], low[step:]), have + step
    own = (low & ((np.uint64(1) << places) - np.uint64(1))).astype(np.int64)
    turn = np.concatenate([[0], np.nonzero(own[1:] != own[:-1])[0] + 1])
    return own[turn], turn, np.concatenate([turn[1:], [n]]) - 1


def _owned(data: bytes, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """owners() of one text of any length, scanned in overlapping parts."""
    flat = np.frombuffer(data, np.uint8)
    parts = []
    for s in range(0, max(1, len(flat) - width + 1), SCAN):
        p, a, b = owners(flat[s : s + SCAN + width - 1], width, gram)
        parts.append((p + s, a + s, b + s))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


# ---- front-coded runs and their merge -------------------------------------------------------


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which `known` bytes are known."""
    n = min(len(a), len(b))
    while known + 16 <= n and a[known : known + 16] == b[known : known + 16]:
        known += 16
    while known < n and a[known] == b[known]:
        known += 1
    return known


def front_code(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Of sorted strings: bytes shared with the predecessor, lengths, and all other bytes."""
    shared = np.fromiter((common(a, b) for a, b in zip([b"", *strings[:-1]], strings, strict=True)), np.int32, len(strings))
    return shared, np.fromiter(map(len, strings), np.int32, len(strings)), b"".join(s[k:] for s, k in zip(strings, shared.tolist(), strict=True))


def seal(shared: np.ndarray, lengths: np.ndarray, tails: bytes, *fields: np.ndarray) -> bytes:
    """One run as bytes: counts, then every column (64-bit fields by columns, so that they compress)."""
    head = np.array([len(shared), len(fields)], np.int64).tobytes()
    return head + shared.astype(np.int32).tobytes() + lengths.astype(np.int32).tobytes() + b"".join(f.astype(np.int64).tobytes() for f in fields) + tails


def unseal(blob: bytes) -> tuple[list[int], list[int], bytes, list[np.ndarray]]:
    n, k = np.frombuffer(blob, np.int64, 2).tolist()
    at = 16
    shared, lengths = (np.frombuffer(blob, np.int32, n, at + i * 4 * n).tolist() for i in (0, 1))
    at += 8 * n
    fields = [np.frombuffer(blob, np.int64, n, at + i * 8 * n) for i in range(k)]
    return shared, lengths, blob[at + 8 * n * k :], fields


class LoserTree:
    """Merge of sorted front-coded runs. Yields (bytes shared with the string before, string, run, entry).

    Every loser keeps the prefix length it shares with the last winner that passed it; the one
    that shares more is smaller, and only on equal lengths are the bytes behind them compared.
    """

    def __init__(self, runs: list[tuple[list[int], list[int], bytes]]):
        self.runs = runs

    def _strings(self, r: int) -> Iterator[tuple[int, bytes]]:
        shared, lengths, tails = self.runs[r]
        at, text = 0, b""
        for k, n in zip(shared, lengths, strict=True):
            text = text[:k] + tails[at : at + n - k]
            at += n - k
            yield k, text

    def __iter__(self) -> Iterator[tuple[int, bytes, int, int]]:
        k = len(self.runs)
        if not k:
            return
        sources = [self._strings(r) for r in range(k)]
        entry = [-1] * k
        size = 1 << (k - 1).bit_length()
        # A player is (bytes shared with the last winner, string, run); no string is the largest.
        nodes: list = [None] * size

        def less(x, y):
            """(winner, loser) of two players, both compared with the same last winner."""
            if x[1] is None:
                return y, x
            if y[1] is None or x[0] > y[0]:
                return x, y
            if x[0] < y[0]:
                return y, x
            h = common(x[1], y[1], x[0])
            if x[1][h:] < y[1][h:] or (len(x[1]) == len(y[1]) == h and x[2] < y[2]):
                return x, (h, y[1], y[2])
            return y, (h, x[1], x[2])

        def fetch(r):
            if r >= k:
                return (0, None, r)
            entry[r] += 1
            h, s = next(sources[r], (0, None))
            return (h, s, r)

        def build(node):
            if node >= size:
                return fetch(node - size)
            win, nodes[node] = less(build(2 * node), build(2 * node + 1))
            return win

        top = build(1) if size > 1 else fetch(0)
        while top[1] is not None:
            h, s, r = top
            yield h, s, r, entry[r]
            top = fetch(r)
            node = (size + r) >> 1
            while node:
                other = nodes[node]
                # Most players are told apart by their prefix lengths alone.
                if other[1] is not None:
                    if top[1] is None or top[0] < other[0]:
                        nodes[node], top = top, other
                    elif top[0] == other[0]:
                        top, nodes[node] = less(top, other)
                node >>= 1


# ---- first sort: suffixes that share their first bytes ---------------------------------------

_ROWS = "part int, run binary"
_BATCH = ["part", "run"]
HIT = "doc_id long, mark long, p long, first int, last int, head long"


def _blob_rows(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], _BATCH)


def _first_bytes(texts: list[bytes], which: np.ndarray, p: np.ndarray, gram: int) -> np.ndarray:
    """A matrix of the first `gram` bytes of suffixes p of texts `which` (ascending)."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.frombuffer(b"".join(texts), np.uint8)
    return flat[((np.cumsum(sizes) - sizes)[which] + p)[:, None] + np.arange(gram)]


def _fixed(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows).view(f"V{rows.shape[1]}").ravel()


def _numbers(grams: np.ndarray) -> np.ndarray:
    """The rows as columns of numbers in the order of the bytes."""
    words = np.zeros((len(grams), -(-grams.shape[1] // 8) * 8), np.uint8)
    words[:, : grams.shape[1]] = grams
    return words.view(">u8").astype(np.uint64)


def _fixed_run(blob: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
    """Strings (all of one length) and fields of a run, column by column: a byte that is shared is the last one sent in its column."""
    n, k = np.frombuffer(blob, np.int64, 2).tolist()
    shared, lengths = (np.frombuffer(blob, np.int32, n, 16 + i * 4 * n) for i in (0, 1))
    at = 16 + 8 * n
    fields = [np.frombuffer(blob, np.int64, n, at + i * 8 * n) for i in range(k)]
    width = int(lengths[0]) if n else 0
    tails = np.frombuffer(blob, np.uint8, offset=at + 8 * n * k)
    own = width - shared.astype(np.int64)
    begin = np.cumsum(own) - own
    grams = np.empty((n, width), np.uint8)
    row = np.arange(n)
    for c in range(width):
        sent = np.maximum.accumulate(np.where(shared <= c, row, 0))
        grams[:, c] = tails[begin[sent] + c - shared[sent]]
    return grams, fields


def _suffix_run(grams: np.ndarray, fields: list[np.ndarray], splitters: np.ndarray, width: int) -> list[tuple[int, bytes]]:
    """Sorted, front-coded runs by part of one task's suffixes, and its own hits.

    Of suffixes with equal bytes one entry travels, without a place, since all are hits already.
    """
    keys = _numbers(grams)
    order = np.lexsort(keys.T[::-1])
    grams, keys, fields = grams[order], keys[order], [f[order] for f in fields]
    fresh = np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])
    count = np.diff(np.concatenate([np.nonzero(fresh)[0], [len(grams)]]))
    several = np.repeat(count > 1, count)
    head = _heads(grams)
    out = []
    mine = [f[several] for f in [*fields, head]]
    if several.any():
        out.append((-1, seal(np.zeros(several.sum(), np.int32), np.zeros(several.sum(), np.int32), b"", *mine)))
    one = np.nonzero(fresh)[0]
    grams, fields, count = grams[one], [np.where(count > 1, -1, f[one]) if i == 2 else f[one] for i, f in enumerate(fields)], count
    part = np.searchsorted(splitters, _sortable(grams), "right") if len(splitters) else np.zeros(len(grams), np.int64)
    for s in np.unique(part):
        a, b = np.searchsorted(part, [s, s + 1])
        g = grams[a:b]
        shared = np.zeros(len(g), np.int32)
        if len(g) > 1:
            same = g[1:] == g[:-1]
            shared[1:] = np.where(same.all(axis=1), g.shape[1], same.argmin(axis=1))
        tails = g[np.arange(g.shape[1])[None, :] >= shared[:, None]].tobytes()
        out.append((int(s), seal(shared, np.full(len(g), g.shape[1], np.int32), tails, *[f[a:b] for f in fields])))
    return out


def _sortable(grams: np.ndarray) -> np.ndarray:
    """The first eight bytes as a number in the order of the bytes; parts are ranges of it."""
    return np.ascontiguousarray(grams[:, :8]).view(">u8").ravel().astype(np.uint64)


def _heads(grams: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the rows."""
    x = np.zeros(len(grams), np.uint64)
    for c in range(grams.shape[1]):
        x = (x ^ grams[:, c].astype(np.uint64)) * np.uint64(0x100000001B3)
        x ^= x >> np.uint64(29)
    return x.view(np.int64)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]


def _suffixes(splitters: np.ndarray, width: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, fields, size = [], [], 0

        def sealed():
            rows = _suffix_run(np.concatenate(grams), [np.concatenate(x) for x in zip(*fields, strict=True)], splitters, width)
            grams.clear()
            fields.clear()
            return _blob_rows(rows)

        for b in batches:
            texts = _texts(b)
            ids, marks = b.column("doc_id").to_numpy(zero_copy_only=False), b.column("mark").to_numpy(zero_copy_only=False)
            found = [_owned(t, width, gram) for t in texts]
            counts = [len(f[0]) for f in found]
            if sum(counts):
                p, first, last = (np.concatenate(x) for x in zip(*found, strict=True))
                which = np.repeat(np.arange(len(texts)), counts)
                grams.append(_first_bytes(texts, which, p, gram))
                fields.append([ids[which], marks[which], p, p - first, last - first])
            size += sum(map(len, texts))
            if size >= RUN_BYTES and grams:
                yield sealed()
                size = 0
        if grams:
            yield sealed()

    return run


def _hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the runs of each range; entries whose bytes stand in two runs, or twice in one, are hits."""
    parts: dict[int, list[bytes]] = {}
    columns = ["doc_id", "mark", "p", "first", "last", "head"]

    def batch(fields):
        d, m, p, back, ahead, head = fields
        return pa.RecordBatch.from_arrays(
            [pa.array(d), pa.array(m), pa.array(p), pa.array(back.astype(np.int32)), pa.array((ahead - back).astype(np.int32)), pa.array(head)], columns
        )

    for b in batches:
        for part, blob in zip(b.column("part").to_pylist(), b.column("run").to_pylist(), strict=True):
            if part < 0:
                yield batch(unseal(blob)[3])
            else:
                parts.setdefault(part, []).append(blob)
    for blobs in parts.values():
        runs = [_fixed_run(x) for x in blobs]
        grams = np.concatenate([r[0] for r in runs])
        fields = [np.concatenate(x) for x in zip(*[r[1] for r in runs], strict=True)]
        keys = _numbers(grams)
        # A stable sort of runs that stand one behind the other merges them.
        order = np.lexsort(keys.T[::-1])
        keys = keys[order]
        same = np.concatenate([[False], (keys[1:] == keys[:-1]).all(axis=1), [False]])
        # An entry without a place stands for several hits of its own task.
        at = order[(same[1:] | same[:-1]) & (fields[2][order] >= 0)]
        if len(at):
            yield batch([*[f[at] for f in fields], _heads(grams[at])])


# ---- second sort: windows of the hits --------------------------------------------------------


def _contexts(width: int, gram: int, parts: int):
    """Runs of the bytes around hits, turned so that they begin with the suffix; covered spans decided here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, bytes], tuple] = {}
        size = 0

        def sealed(spans):
            rows = []
            if spans:
                z = np.zeros(len(spans), np.int32)
                rows.append((-1, seal(z, z, b"", *[np.array(c, np.int64) for c in zip(*spans, strict=True)])))
            dealt: dict[int, list] = {}
            for (back, around), v in best.items():
                # From here on a string begins with the suffix.
                s = around[back:] + around[:back]
                dealt.setdefault(zlib.crc32(s if v[3] else s[:gram]) % parts, []).append((s, back, v))
            for part, items in dealt.items():
                items.sort(key=lambda x: (x[0], x[1]))
                f = [np.array(c, np.int64) for c in zip(*[(v[0], v[1], v[2], back) for _, back, v in items], strict=True)]
                rows.append((part, seal(*front_code([x[0] for x in items]), *f)))
            best.clear()
            return _blob_rows(rows)

        spans: list[tuple] = []
        for b in batches:
            lists = b.column("hits")
            hits = lists.flatten()
            named = {hits.type.field(i).name: x.to_numpy(zero_copy_only=False) for i, x in enumerate(hits.flatten())}
            p, first, last, wide = (named[c] for c in ("p", "first", "last", "wide"))
            counts = lists.value_lengths().to_numpy(zero_copy_only=False)
            # In the order of their places, so that covered spans of neighbours grow together.
            order = np.lexsort((p, np.repeat(np.arange(len(counts)), counts)))
            p, first, last, wide = (x[order].astype(np.int64) for x in (p, first, last, wide))
            backs, begins, ends, wides = first.tolist(), (p - first).tolist(), (p + last + width).tolist(), (wide > 0).tolist()
            at = 0
            for text, doc, mark, n in zip(_texts(b), b.column("doc_id").to_pylist(), b.column("mark").to_pylist(), counts.tolist(), strict=True):
                span = None
                for back, a, z, w in zip(backs[at : at + n], begins[at : at + n], ends[at : at + n], wides[at : at + n], strict=True):
                    for back, a, z in [(back - i, a + i, a + i + width) for i in range(z - width - a + 1)] if w else [(back, a, z)]:
                        # Before its suffix a window of its own keeps what it has of it; behind, nothing.
                        key, mine = (back, text[a:z]), (doc, mark, a, w)
                        other = best.setdefault(key, mine)
                        if other is mine:
                            size += z - a + 150
                            continue
                        if other < mine:
                            if span is not None and a <= span[1]:
                                span[1] = z
                            else:
                                if span is not None:
                                    spans.append((doc, mark, *span))
                                span = [a, z]
                        elif mine < other:
                            best[key] = mine
                            spans.append((other[0], other[1], other[2], other[2] + z - a))
                at += n
                if span is not None:
                    spans.append((doc, mark, *span))
                if size >= RUN_BYTES:
                    yield sealed(spans)
                    spans, size = [], 0
        if best or spans:
            yield sealed(spans)

    return run


def _earlier(width: int, gram: int):
    """Spans of windows for which an equal one starts earlier, from merged runs."""

    def spans_of(block: list[tuple[bytes, int, tuple[int, int, int]]]) -> list[tuple[int, int, int, int]]:
        """block: (string, bytes before the suffix, (doc, mark, first window)) with the same first bytes."""
        out = []
        # Of equal surroundings all but the earliest are covered whole, and only that one can hide windows of others.
        lead: dict[tuple[bytes, int], tuple] = {}
        for s, back, at in block:
            other = lead.setdefault((s, back), at)
            if other != at:
                late = max(other, at)
                lead[s, back] = min(other, at)
                out.append((late[0], late[1], late[2], late[2] + len(s)))
        if len(lead) < 2:
            return out
        seen: dict[tuple[int, bytes], tuple] = {}
        for (s, back), at in sorted(lead.items(), key=lambda x: x[1]):
            doc, mark, first = at
            n = len(s) - width + 1
            ahead = len(s) - back
            start = None
            for i in range(n):
                # Window first + i: the last back - i bytes before the suffix, then the suffix.
                left = back - i
                key = (left, s[: width - left] + s[ahead + i :] if left > 0 else s[-left : width - left])
                here = (doc, mark, first + i)
                other = seen.setdefault(key, here)
                if other < here:
                    start = i if start is None else start
                elif start is not None:
                    out.append((doc, mark, first + start, first + i - 1 + width))
                    start = None
            if start is not None:
                out.append((doc, mark, first + start, first + n - 1 + width))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[bytes]] = {}
        names = ["doc_id", "mark", "start", "end"]
        for b in batches:
            for part, blob in zip(b.column("part").to_pylist(), b.column("run").to_pylist(), strict=True):
                if part < 0:
                    yield pa.RecordBatch.from_arrays([pa.array(f) for f in unseal(blob)[3]], names)
                else:
                    parts.setdefault(part, []).append(blob)
        for blobs in parts.values():
            runs = [unseal(x) for x in blobs]
            fields = [[f.tolist() for f in r[3]] for r in runs]
            out, block = [], []
            for h, s, r, e in LoserTree([x[:3] for x in runs]):
                if h < gram and block:
                    if len(block) > 1:
                        out += spans_of(block)
                    block = []
                doc, mark, first, back = (f[e] for f in fields[r])
                block.append((s, back, (doc, mark, first)))
            if len(block) > 1:
                out += spans_of(block)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)

    return run


def _cut(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256", "kept"]
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            rows = []
            for text, spans in zip(_texts(b), b.column("spans").to_pylist(), strict=True):
                merged: list[list[int]] = []
                for s, e in sorted((x["start"], x["end"]) for x in spans or []):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
                edges = [0, *[x for m in merged for x in m], len(text)]
                kept = b"".join(text[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True))
                rows.append((len(text), len(text) - len(kept), [{"start": a, "end": z} for a, z in merged], hashlib.sha256(kept).hexdigest(), kept))
            c = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], span), pa.array(c[3], pa.string()), pa.array(c[4], pa.binary())], names
            )

    return run


def splitters(docs: DataFrame, parts: int, width: int, gram: int, sample: int = 200_000) -> np.ndarray:
    """Borders of `parts` ranges of suffixes, from about `sample` suffixes of documents drawn by hash.

    A border only decides which task merges a suffix, never the result.
    """
    n = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    share = min(1.0, sample * 40 / max(1, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in _texts(b):
                p, _, _ = _owned(t, width, gram)
                if len(p):
                    flat = np.frombuffer(t, np.uint8)
                    yield pa.RecordBatch.from_arrays([pa.array(_sortable(flat[p[:, None] + np.arange(8)]).view(np.int64))], ["x"])

    drawn = docs.where(F.pmod(F.xxhash64(F.lit("splitters"), "mark"), F.lit(1_000_000)) < share * 1_000_000)
    # Grouped by value: at most a few times `sample` numbers.
    x = np.sort(drawn.mapInArrow(run, "x long").toArrow()["x"].to_numpy().view(np.uint64))
    return np.unique(x[np.linspace(0, len(x) - 1, parts + 1).astype(int)[1:-1]]) if len(x) else np.zeros(0, np.uint64)


def without_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, wide: int = 50_000) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (maximal removed runs), kept_sha256 and kept (bytes) of every row."""
    spark = docs.sparkSession
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark"))
    runs = rows.select("doc_id", "mark", "text").mapInArrow(_suffixes(splitters(rows, parts, width, gram), width, gram), _ROWS)
    # Own hits (part -1) go anywhere; a range goes to one task.
    runs = runs.repartition(parts, F.when(F.col("part") < 0, F.xxhash64("run")).otherwise(F.col("part").cast("long")))
    hits = written(runs.mapInArrow(_hits, HIT), "suffix-hits")
    many = checked(hits.groupBy("head").agg(F.count("*").alias("n")).where(F.col("n") > wide).select("head", F.lit(True).alias("wide")))
    own = hits.join(many, "head", "left").withColumn("wide", F.coalesce("wide", F.lit(False)))
    own = own.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("p", "first", "last", "wide")).alias("hits"))
    around = rows.select("doc_id", "mark", "text").join(own, ["doc_id", "mark"]).mapInArrow(_contexts(width, gram, parts), _ROWS)
    around = around.repartition(parts, F.when(F.col("part") < 0, F.xxhash64("run")).otherwise(F.col("part").cast("long")))
    spans = written(around.mapInArrow(_earlier(width, gram), "doc_id long, mark long, start long, end long"), "suffix-spans")
    spans = spans.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    joined = rows.join(spans, ["doc_id", "mark"], "left").select("id", "text", "spans")
    return joined.mapInArrow(_cut(id_kind), f"doc_id {id_kind}, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept_sha256 string, kept binary")
