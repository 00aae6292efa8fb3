"""Near-duplicate lines by a segment-partition edit join.

Two lines within `threshold` edits (over UTF-8 bytes) share one of threshold + 1 even segments of the
shorter one, at one of few places that depend on both lengths. Every distinct line of a task is
indexed by the hash of each segment with its length and number, and probes the segments of lines up
to `threshold` shorter (multi-match-aware places only). Hashes met by different lines are candidates; their
lines are compared by a banded bit-parallel automaton. Links are counted once, at the smallest
shared hash, and a bucket returns its links' spanning forest only. A bucket with many lines is cut
into tiles, pairs of blocks of its lines, so one task holds two blocks at most.

Segments need a byte each: lines of at most 2 * threshold bytes, which can be linked to one without, also
meet by every string that up to `threshold` deletions leave of them (two lines within that many edits
have one in common).

A line is dropped when an equal or linked line (in the same class) stands earlier by doc_id and place.
Lines under `shortest` bytes are classed with equal ones only; at 0 no link is left out.

Defined cases: a null text has no lines, an empty one has one empty line; blank lines are never
dropped; ties of doc_id are broken by the text's hash, and rows equal in both count as one;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointsman.llm.common import attach
from pointsman.llm.simhash_trie import components
from pointsman.session import written

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def line_id(line: bytes) -> int:
    """XXH64 with seed 42 as a signed number, as xxhash64() gives for the line."""
    x = xxhash.xxh64_intdigest(line, 42)
    return x - (1 << 64) if x >> 63 else x


def places(length: int, threshold: int) -> list[tuple[int, int, int, int, bool]]:
    """(indexed length, segment number, start, size, own) of all substrings of a line that are to be looked up.

    `own` marks the segments of the line itself. Of a line that much shorter, segment i can start at
    most i places (from 0) off on the left, and correspondingly seen from the right end.
    """
    out = []
    for shorter in range(threshold + 1):
        n = length - shorter
        size, longer, start = n // (threshold + 1), n % (threshold + 1), 0
        for i in range(threshold + 1):
            m = size + (i >= threshold + 1 - longer)
            low = max(0, start - i, start + shorter - (threshold - i))
            high = min(length - m, start + i, start + shorter + (threshold - i))
            out += [(n, i, p, m, shorter == 0 and p == start) for p in range(low, high + 1)]
            start += m
    return out


@lru_cache(1 << 14)
def _spec(length: int, threshold: int) -> np.ndarray:
    """places() as numbers. Lines shorter than the segments are many meet by variants only."""
    return np.array([p for p in places(length, threshold) if p[0] > threshold], np.int64).reshape(-1, 5)


def variants(line: bytes, threshold: int) -> set[bytes]:
    """What up to `threshold` deletions leave of a line."""
    out = last = {line}
    for _ in range(threshold):
        last = {x[:i] + x[i + 1 :] for x in last for i in range(len(x))}
        out = out | last
    return out


def signatures(lines: list[bytes], threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, line, own) of all looked-up substrings of all lines, and of the variants of short ones."""
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    flat = np.frombuffer(b"".join(lines), np.uint8).astype(np.uint64) + np.uint64(1)
    power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(flat), _BASE)]))
    inverse = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(flat), _INVERSE)]))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(flat * power[:-1])])
    begin = np.cumsum(sizes) - sizes
    keys, which, own = [], [], []
    lengths, kind = np.unique(sizes, return_inverse=True)
    specs = [_spec(n, threshold) for n in lengths.tolist()]
    counts = np.array([len(x) for x in specs], np.int64)
    # Lines of different lengths mostly have equally many places: they are worked on together.
    for count in np.unique(counts[counts > 0]).tolist():
        some = np.nonzero(counts == count)[0]
        at = np.full(len(lengths), -1)
        at[some] = np.arange(len(some))
        group = np.nonzero(at[kind] >= 0)[0]
        spec = np.stack([specs[k] for k in some.tolist()])[at[kind[group]]]
        start = begin[group][:, None] + spec[:, :, 2]
        value = (sums[start + spec[:, :, 3]] - sums[start]) * inverse[start]
        label = (spec[:, :, 0] * 8 + spec[:, :, 1]).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        value = (value ^ label) * np.uint64(0xBF58476D1CE4E5B9)
        keys.append((value ^ (value >> np.uint64(31))).ravel())
        which.append(np.repeat(group, count))
        own.append((spec[:, :, 4] > 0).ravel())
    short = [(line_id(v + b"\0variant") % (1 << 64), k) for k in np.nonzero(sizes <= 2 * threshold)[0].tolist() for v in variants(lines[k], threshold)]
    if short:
        keys.append(np.array([v for v, _ in short], np.uint64))
        which.append(np.array([k for _, k in short], np.int64))
        own.append(np.ones(len(short), bool))
    empty = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool))
    return tuple(np.concatenate(x) for x in (keys, which, own)) if keys else empty


def within(a: bytes, b: bytes, threshold: int) -> bool:
    """Whether at most `threshold` edits turn a into b.

    Bit-parallel over the diagonals of the band: row e holds, as bits, the diagonals that can be
    reached with e edits. Common ends are stripped first.
    """
    if abs(len(a) - len(b)) > threshold:
        return False
    n = min(len(a), len(b))
    s = 0
    while s + 32 <= n and a[s : s + 32] == b[s : s + 32]:
        s += 32
    while s < n and a[s] == b[s]:
        s += 1
    a, b, n = a[s:], b[s:], n - s
    s = 0
    while s + 32 <= n and a[len(a) - s - 32 : len(a) - s] == b[len(b) - s - 32 : len(b) - s]:
        s += 32
    while s < n and a[-1 - s] == b[-1 - s]:
        s += 1
    a, b = a[: len(a) - s], b[: len(b) - s]
    if not a or not b:
        return max(len(a), len(b)) <= threshold
    band = (1 << (2 * threshold + 1)) - 1
    where: dict[int, int] = {}
    for j, c in enumerate(b):
        where[c] = where.get(c, 0) | 1 << (j + threshold)  # bit of b[j] on the main diagonal at row j
    rows = [0] * (threshold + 1)
    for e in range(threshold + 1):  # e insertions before the first byte of a
        rows[e] = (((1 << (e + 1)) - 1) << threshold) & band
    for i, c in enumerate(a):
        match = (where.get(c, 0) >> i) & band
        last = 0
        for e in range(threshold + 1):
            was = rows[e]
            now = was & match
            if e:
                # A substitution stays on the diagonal, a deletion falls to the one below, an insertion rises.
                now |= last | last >> 1 | rows[e - 1] << 1
            rows[e], last = now & band, was
        if not rows[threshold]:
            return False
    goal = len(b) - len(a) + threshold
    return bool(rows[threshold] >> goal & 1)


def _lines(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "surrogatepass").split(b"\n")


def _looked_up(threshold: int, shortest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            lines, ids, size = [], [], 0

            def out():
                k, w, own = signatures(lines, threshold)
                return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(np.array(ids, np.int64)[w]), pa.array(own)], ["key", "id", "own"])

            for t in b.column("text"):
                for line in _lines(t.as_py()):
                    if len(line) >= shortest and (x := line_id(line)) not in seen:
                        seen.add(x)
                        lines.append(line)
                        ids.append(x)
                        size += len(line)
                        if size > 1 << 21:
                            yield out()
                            lines, ids, size = [], [], 0
            if lines:
                yield out()
            if len(seen) > 1_000_000:
                seen.clear()

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of sorted keys that different lines have, one of them by its own segment; a key may be of any size."""
    # The last key, which the next batch may continue: its first line, its rows while it has no other line, and whether it has one.
    key, first, waiting, emitting = None, None, [], False
    for b in batches:
        if not b.num_rows:
            continue
        keys, ids, own = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "id", "own"))
        starts = np.concatenate([[0], np.nonzero(keys[1:] != keys[:-1])[0] + 1])
        sizes = np.diff(np.concatenate([starts, [len(keys)]]))
        several = np.minimum.reduceat(ids, starts) != np.maximum.reduceat(ids, starts)
        out = []
        if keys[0] == key:
            several[0] |= emitting or ids[0] != first
            if several[0]:
                out, waiting = waiting, []
        else:
            waiting = []
        mask = np.repeat(several, sizes)
        if mask.any():
            out = [*out, [x[mask] for x in (keys, ids, own)]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["key", "id", "own"])
        last = slice(starts[-1], None)
        if keys[-1] != key:
            key, first, waiting = keys[-1], ids[-1], []
        emitting = bool(several[-1])
        if not emitting:
            waiting.append([x[last].copy() for x in (keys, ids, own)])


def _shared(a: bytes, b: bytes, threshold: int) -> np.ndarray:
    """Hashes by which the two lines meet."""
    k, w, own = signatures([a, b], threshold)
    x, y = w == 0, w == 1
    return np.union1d(np.intersect1d(k[x & own], k[y]), np.intersect1d(k[x], k[y & own]))


def _verified(threshold: int):
    def links(key: int, tile: str, rows: list[tuple[int, bool, bytes, int]]) -> list[tuple[int, int, int]]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        out, counted = [], {}
        lines: dict[int, list] = {}
        for i, own, line, block in rows:
            have = lines.setdefault(i, [line, False, block])
            have[1] |= own
        items = sorted(lines.items(), key=lambda x: len(x[1][0]))
        low, high = tile.split("-")
        for n, (i, (a, own_a, block_a)) in enumerate(items):
            for j, (b, own_b, block_b) in items[n + 1 :]:
                if len(b) - len(a) > threshold:
                    break
                if not (own_a or own_b) or (low != high and block_a == block_b):
                    continue
                if within(a, b, threshold):
                    if int(_shared(a, b, threshold).view(np.int64).min()) == key:
                        counted[i] = counted.get(i, 0) + 1
                        counted[j] = counted.get(j, 0) + 1
                    x, y = root(i), root(j)
                    if x != y:
                        up[max(x, y)] = min(x, y)
        for i in lines:
            out.append((i, root(i), counted.get(i, 0)))
        return [r for r in out if r[0] != r[1] or r[2]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, out = None, [], []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["u", "v", "n"])

        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("key", "tile", "id", "own", "line", "block")]
            for key, tile, i, own, line, block in zip(*columns, strict=True):
                if (key, tile) != at:
                    if len(rows) > 1:
                        out += links(*at, rows)
                    at, rows = (key, tile), []
                rows.append((i, own, line.encode("utf-8", "surrogatepass"), block))
            if out:
                yield batch()
                out = []
        if len(rows) > 1:
            out += links(*at, rows)
        if out:
            yield batch()

    return run


def linked_lines(docs: DataFrame, threshold: int = 2, shortest: int = 12, block: int = 500) -> DataFrame:
    """u, v, n: a spanning forest of the links between distinct lines (by line_id), and counts of links to add up per u."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("text").mapInArrow(_looked_up(threshold, shortest), "key long, id long, own boolean")
    met = written(rows.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_met, "key long, id long, own boolean"), "line-keys")
    met = met.groupBy("key", "id").agg(F.max("own").alias("own"))
    lines = docs.select(F.explode(F.split("text", "\n")).alias("line")).withColumn("id", F.xxhash64("line"))
    lines = lines.join(met.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.first("line").alias("line"))
    sized = met.join(met.groupBy("key").agg(F.count("*").alias("of")), "key")
    blocks = F.ceil(F.col("of") / block)
    mine = F.pmod(F.xxhash64(F.lit("block"), "id"), blocks).cast("int")
    # Tiles of a key: all pairs of blocks; a line joins those with its own block.
    other = F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int")))
    tiled = sized.select("key", "id", "own", mine.alias("block"), other.alias("other"))
    tile = F.format_string("%d-%d", F.least("block", "other"), F.greatest("block", "other"))
    tiled = tiled.select("key", "id", "own", "block", tile.alias("tile")).join(lines, "id")
    tiled = tiled.repartition(parts, "key", "tile").sortWithinPartitions("key", "tile")
    return tiled.mapInArrow(_verified(threshold), "u long, v long, n long")


def without_near_lines(docs: DataFrame, threshold: int = 2, shortest: int = 12) -> DataFrame:
    """doc_id, n_lines, n_links, classes (of every line), kept (numbers of the lines that stay) of every document."""
    links = written(linked_lines(docs, threshold, shortest), "line-links")
    classes = components(links.select("u", "v").where("u != v"))
    counts = links.groupBy("u").agg(F.sum("n").alias("links"))
    named = counts.join(classes, "u", "full").select(F.col("u").alias("id"), F.coalesce("root", "u").alias("class"), F.coalesce("links", F.lit(0)).alias("links"))
    base = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.col("text").isNull().alias("none"), F.posexplode_outer(F.split("text", "\n")).alias("line", "text"))
    lines = base.select("doc_id", "mark", "none", "line", F.xxhash64("text").alias("id"), (F.trim("text") == "").alias("blank"))
    per_id = lines.groupBy("id").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "mark", "line")).alias("at"))
    per_id = per_id.join(named, "id", "left").select("id", "n", "at", F.coalesce("class", "id").alias("class"), F.coalesce("links", F.lit(0)).alias("links"))
    per_id = written(per_id, "line-ids")
    total = per_id.agg(F.sum("n")).first()[0] or 0
    top = per_id.groupBy("class").agg(F.min("at").alias("top"), F.count("*").alias("ids"))
    placed = attach(per_id.select("id", "n", "class", "links"), top, "class", "ids", total, F.col("id")).select("id", "n", "class", "links", "top")
    all_lines = attach(lines, placed, "id", "n", total, F.xxhash64("doc_id", "mark", "line"))
    mine = F.struct("doc_id", "mark", "line")
    stays = F.col("blank") | mine.eqNullSafe(F.col("top"))
    out = all_lines.groupBy("doc_id", "mark", "none").agg(
        F.sort_array(F.collect_set(F.struct("line", "class", "links", stays.alias("kept")))).alias("l")
    )
    real = F.when(F.col("none"), F.array().cast("array<struct<line:int,class:bigint,links:bigint,kept:boolean>>")).otherwise(F.col("l"))
    out = out.withColumn("l", real)
    return out.select(
        "doc_id", F.size("l").cast("long").alias("n_lines"), F.aggregate("l", F.lit(0).cast("long"), lambda a, x: a + x["links"]).alias("n_links"),
        F.transform("l", lambda x: x["class"]).alias("classes"), F.transform(F.filter("l", lambda x: x["kept"]), lambda x: x["line"]).alias("kept"),
    )
