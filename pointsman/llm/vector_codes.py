"""Vector codes by product quantization, with codebooks fitted by active-entry Lloyd rounds.

A vector of integers is cut into equal parts; each part position has a codebook. A round assigns
every part to its nearest entry and replaces entries by the floored means of their parts. A part's
exact distance to its entry is kept between rounds. After a round most entries stand where they
were: a part whose own entry did not move is compared with the moved entries only, because none of
the others can have come nearer; a part whose entry moved is compared with all. Equal distances go to
the lower entry in both cases, so the codes are those of full rounds.

Vectors are read once and then pass from round to round as a written table with their codes and
distances. Each task adds up its parts by entry; the sums (as many numbers as the codebooks have) are
added in the cluster, and only the codebooks are with the driver.

Defined cases: rows whose vector is null or holds a null or non-finite component are left out (a null
id or label is a value); repeated rows are rows of their own; of equal ids the smaller vector comes
first among the initial entries, null ids come last; vectors shorter than the longest one, or than a
multiple of the number of parts, end in zeros; scaled components beyond 2^27 count as that bound; with
fewer vectors than entries each gives an entry; an empty table gives an empty result and empty
codebooks; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointsman.llm.common import BROADCAST_ROWS, attach
from pointsman.session import written

#: Bound of scaled components, and vectors compared at once.
LIMIT, CHUNK = 1 << 27, 4096
#: Products and sums up to this are exact in floating point.
_EXACT = 1 << 53


@dataclass
class Codes:
    """`rows`: vec_id, label, codes (array of entry numbers), error; `codebooks`: (parts, entries, width) integers."""

    rows: DataFrame
    codebooks: np.ndarray


def integers(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, label and the scaled, floored vector (64-bit integers) of every row whose vector is whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("embedding")
            n = lists.value_lengths().fill_null(0).to_numpy()
            x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null components become NaN
            ends = np.cumsum(n)
            wrong = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
            keep = ~lists.is_null().to_numpy(zero_copy_only=False) & (wrong[ends] == wrong[ends - n])
            whole = np.clip(np.floor(np.where(np.isfinite(x), x, 0) * scale), -LIMIT, LIMIT).astype("<i8")
            values = [whole[e - k : e].tobytes() if ok else None for e, k, ok in zip(ends, n, keep, strict=True)]
            out = pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(values, pa.binary())], ["vec_id", "label", "x"])
            yield out.filter(pa.array(keep))

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    rows = vectors.select("vec_id", "label", "embedding")
    return rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, x binary")


def matrix(column: pa.Array, parts: int, width: int) -> np.ndarray:
    """(rows, parts, width) integers of the binary vectors, with zeros at the end."""
    out = np.zeros((len(column), parts * width), np.int64)
    for row, x in zip(out, column, strict=True):
        v = np.frombuffer(x.as_py(), "<i8")
        row[: len(v)] = v
    return out.reshape(len(column), parts, width)


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row of x to every entry."""
    bound = max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0))
    if int(bound) ** 2 * 4 * max(1, x.shape[1]) < _EXACT:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    out = np.zeros((len(x), len(entries)), np.int64)
    for k in range(x.shape[1]):
        out += (x[:, k, None] - entries[None, :, k]) ** 2
    return out


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of every row, the lowest of equals, and its distance."""
    d = distances(x, entries)
    code = d.argmin(1)
    return code, d[np.arange(len(x)), code]


def reassigned(x: np.ndarray, entries: np.ndarray, moved: np.ndarray, code: np.ndarray, error: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entries after the entries `moved` (numbers, ascending) have changed, from the codes and exact distances before."""
    code, error = code.copy(), error.copy()
    if not len(moved):
        return code, error
    gone = np.isin(code, moved)
    if gone.any():
        code[gone], error[gone] = nearest(x[gone], entries)
    stay = np.nonzero(~gone)[0]
    if len(stay):
        best, d = nearest(x[stay], entries[moved])
        best = moved[best]
        nearer = (d < error[stay]) | ((d == error[stay]) & (best < code[stay]))
        code[stay[nearer]], error[stay[nearer]] = best[nearer], d[nearer]
    return code, error


def assigned(rows: DataFrame, codebooks: np.ndarray, moved: list[np.ndarray] | None, last: bool) -> DataFrame:
    """Rows with their codes and distances under `codebooks`; each task ends with a row of sums by part, entry and position, then counts.

    `moved` lists the entries of each part position that changed since the rows' codes were found; None if they have none.
    The last round adds nothing up.
    """
    parts, entries, width = codebooks.shape
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, entries, width), np.int64)
        counts = np.zeros((parts, entries), np.int64)
        empty = None
        for b in batches:
            empty = b.slice(0, 0)
            for s in range(0, b.num_rows, CHUNK):
                part = b.slice(s, CHUNK)
                x = matrix(part.column("x"), parts, width)
                codes, errors = np.zeros((len(x), parts), np.uint16), np.zeros((len(x), parts), np.int64)
                if moved is not None:
                    codes[:] = np.frombuffer(b"".join(part.column("codes").to_pylist()), "<u2").reshape(-1, parts)
                    errors[:] = np.frombuffer(b"".join(part.column("errors").to_pylist()), "<i8").reshape(-1, parts)
                for p in range(parts):
                    own = np.ascontiguousarray(x[:, p])
                    if moved is None:
                        code, error = nearest(own, codebooks[p])
                    else:
                        code, error = reassigned(own, codebooks[p], moved[p], codes[:, p].astype(np.int64), errors[:, p])
                    codes[:, p], errors[:, p] = code, error
                    if not last:
                        for k in range(width):
                            # At most 2^27 times a chunk: exact in floating point.
                            sums[p, :, k] += np.bincount(code, own[:, k], entries).astype(np.int64)
                        counts[p] += np.bincount(code, minlength=entries)
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), part.column("label"), part.column("x"), _binary(codes.astype("<u2")), _binary(errors.astype("<i8")), pa.nulls(len(x), pa.list_(pa.int64()))],
                    ["vec_id", "label", "x", "codes", "errors", "sums"],
                )
        if empty is not None and not last:
            total = pa.array([np.concatenate([sums.ravel(), counts.ravel()])], pa.list_(pa.int64()))
            none = [pa.nulls(1, empty.schema.field(c).type) for c in ("vec_id", "label")]
            yield pa.RecordBatch.from_arrays([*none, *[pa.nulls(1, pa.binary())] * 3, total], ["vec_id", "label", "x", "codes", "errors", "sums"])

    return rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, x binary, codes binary, errors binary, sums array<long>")


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def moved_means(table: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """The codebooks with every used entry replaced by the floored mean of its parts."""
    own = table.where("sums is not null").select(F.posexplode("sums").alias("at", "value"))
    # As many rows as the codebooks have numbers.
    rows = own.groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("total")).collect()
    parts, entries, width = codebooks.shape
    flat = {r["at"]: int(r["total"]) for r in rows}
    out = codebooks.copy()
    for p in range(parts):
        for e in range(entries):
            if n := flat.get(parts * entries * width + p * entries + e, 0):
                at = (p * entries + e) * width
                out[p, e] = [flat[at + k] // n for k in range(width)]
    return out


def compressed(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> Codes:
    """Codes of all vectors (vec_id, label, embedding) and the codebooks after `rounds` rounds."""
    rows = written(integers(vectors, scale), "vectors")
    longest = rows.agg(F.max(F.octet_length("x"))).first()[0]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    if longest is None:
        none = rows.sparkSession.createDataFrame([], f"vec_id {kinds['vec_id']}, label {kinds['label']}, codes array<int>, error long")
        return Codes(none, np.zeros((parts, 0, 0), np.int64))
    width = -(-(longest // 8) // parts)
    first = rows.select("vec_id", "x").orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).toArrow()
    codebooks = np.ascontiguousarray(matrix(first["x"].combine_chunks(), parts, width).transpose(1, 0, 2))
    moved = None
    for _ in range(rounds):
        rows = written(assigned(rows, codebooks, moved, last=False), "vector-codes")
        after = moved_means(rows, codebooks)
        moved = [np.nonzero((a != b).any(1))[0] for a, b in zip(after, codebooks, strict=True)]
        codebooks, rows = after, rows.where("sums is null")

    final = assigned(rows, codebooks, moved, last=True).select("vec_id", "label", "codes", "errors")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = [np.frombuffer(c.as_py(), "<u2").astype(np.int32) for c in b.column("codes")]
            error = [int(np.frombuffer(e.as_py(), "<i8").sum()) for e in b.column("errors")]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(codes, pa.list_(pa.int32())), pa.array(error, pa.int64())], ["vec_id", "label", "codes", "error"])

    return Codes(written(final.mapInArrow(read, f"vec_id {kinds['vec_id']}, label {kinds['label']}, codes array<int>, error long"), "codes"), codebooks)


def with_label_error(codes: DataFrame) -> DataFrame:
    """`codes` with label_error: the error summed over rows with the same label (nulls together)."""
    # One text for each label; the prefix keeps null apart from every value.
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("null"))
    keyed = codes.withColumn("_label", key)
    sums = keyed.groupBy("_label").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n"))
    sums = written(sums, "label-errors")
    if sums.count() <= BROADCAST_ROWS:
        return keyed.join(F.broadcast(sums), "_label").drop("_label", "_n")
    return attach(keyed, sums, "_label", "_n", codes.count(), F.xxhash64("vec_id", "codes")).drop("_label", "_n")


def hexadecimal(codes: Column) -> Column:
    """Two hex digits for each code."""
    return F.array_join(F.transform(codes, lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")


def listed(codebooks: np.ndarray) -> str:
    """All entries' components by part, entry and position, joined with commas."""
    return ",".join(map(str, codebooks.ravel().tolist()))


def decoded(codes: DataFrame, codebooks: np.ndarray, scale: int = 256) -> DataFrame:
    """vec_id and the vector its codes stand for (array of doubles)."""
    parts = np.arange(codebooks.shape[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = [(codebooks[parts, np.array(c.as_py())] / scale).ravel() for c in b.column("codes")]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(vectors, pa.list_(pa.float64()))], ["vec_id", "vector"])

    kind = codes.schema["vec_id"].dataType.simpleString()
    return codes.select("vec_id", "codes").mapInArrow(run, f"vec_id {kind}, vector array<double>")
