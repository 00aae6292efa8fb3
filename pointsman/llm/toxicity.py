"""Toxic passages as maximum-scoring segments of token log-odds, calibrated by extreme values.

Tokens are hashed into a fixed number of buckets. Their log-odds between toxic and clean documents
are shrunk by a Dirichlet prior whose shape is the token distribution of the whole corpus; tokens
whose log-odds are not clearly positive get a small negative score. A linear scan returns all
maximal scoring segments of a text (each token run that no longer or shorter run beats). A
segment's significance follows the extreme-value law of best segments, 1 - exp(-K n exp(-lambda S)),
with lambda from the clean token scores and K fitted to the clean documents. A document's evidence is
the sum over its significant segments, and a monotone fit on the learned rows turns it into a
probability.

Defined cases: a null or empty text has no tokens and no evidence; without toxic or without clean
labels every score is the share of toxic labels (or 0); a label row with null is not learned from;
repeated labels of an id count once, as the largest; repeated documents are separate rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointsman.llm.common import checked
from pointsman.session import written

BUCKETS = 1 << 18
TOKEN = re.compile(r"\w+")
DRIFT, CLEAR, MOST, PRIOR = 0.1, 2.5, 8.0, 1000.0


class _Ids(dict):
    """Bucket of a token, remembered; forgotten when too many."""

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[token] = b = zlib.crc32(token.encode("utf-8", "surrogatepass")) % BUCKETS
        return b


_IDS = _Ids()


def buckets(text: str | None) -> np.ndarray:
    found = TOKEN.findall((text or "").lower())
    return np.fromiter(map(_IDS.__getitem__, found), np.int64, len(found))


def segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, start, end) of a sequence, in one pass.

    Candidates form a stack; each carries the running total before and after it. A new one is
    joined with the nearest earlier candidate that starts lower, unless that ends as high.
    """
    totals = np.concatenate([[0.0], np.cumsum(scores)])
    stack: list[tuple[float, float, int, int, int]] = []  # before, after, start, end, nearest earlier with a lower `before`
    for i in np.nonzero(scores > 0)[0].tolist():
        before, after, start, end = float(totals[i]), float(totals[i + 1]), i, i + 1
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= before:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= after:
                stack.append((before, after, start, end, j))
                break
            before, start = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a - b, s, e) for b, a, s, e, _ in stack]


def token_counts(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each bucket the documents with it: of all rows, of toxic and of clean ones (column y: 1, 0 or null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((3, BUCKETS), np.int64)
        for b in batches:
            for text, y in zip(b.column("text"), b.column("y").to_pylist(), strict=True):
                own = np.unique(buckets(text.as_py()))
                n[0, own] += 1
                if y is not None:
                    n[1 if y else 2, own] += 1
        k = np.nonzero(n[0])[0]
        yield pa.RecordBatch.from_arrays([pa.array(k), *[pa.array(x[k]) for x in n]], ["bucket", "every", "toxic", "clean"])

    parts = labelled.select("text", "y").mapInArrow(run, "bucket long, every long, toxic long, clean long")
    rows = parts.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("every", "toxic", "clean")]).toArrow()  # at most BUCKETS rows
    out = np.zeros((3, BUCKETS))
    out[:, rows["bucket"].to_numpy()] = [rows[c].to_numpy() for c in ("every", "toxic", "clean")]
    return out[0], out[1], out[2]


def weights(every: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """A token's score by bucket: its log-odds where clearly positive, else the drift."""
    alpha = PRIOR * (every + 1e-3) / (every.sum() + 1e-3 * len(every))
    odds = lambda y: np.log((y + alpha) / np.maximum(y.sum() + PRIOR - y - alpha, 1e-9))
    delta = odds(toxic) - odds(clean)
    deviation = np.sqrt(1 / (toxic + alpha) + 1 / (clean + alpha))
    return np.where((delta > CLEAR * deviation) & (toxic >= 5), np.minimum(delta, MOST), -DRIFT)


def decay(w: np.ndarray, every: np.ndarray, clean: np.ndarray) -> float:
    """lambda: the positive root of E[exp(lambda s)] = 1 over clean tokens, smoothed by the prior."""
    p = clean + PRIOR * (every + 1e-3) / (every.sum() + 1e-3 * len(every))
    p = p / p.sum()
    up = w > 0
    if not up.any():
        return 1.0
    low, high = 1e-6, 20.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (low, mid) if (p[up] * np.exp(mid * w[up])).sum() + p[~up].sum() * math.exp(-mid * DRIFT) > 1 else (mid, high)
    return low


def scanned(labelled: DataFrame, w: np.ndarray) -> DataFrame:
    """doc_id, held_out, y, number of tokens and all maximal segments (score, start, end) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("score", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            n, found = [], []
            for text in b.column("text"):
                own = w[buckets(text.as_py())]
                n.append(len(own))
                found.append([{"score": s, "start": a, "end": e} for s, a, e in segments(own)] if (own > 0).any() else [])
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("doc_id", "held_out", "y")], pa.array(n, pa.int64()), pa.array(found, kind)], ["doc_id", "held_out", "y", "n_tokens", "segments"])

    kinds = {f.name: f.dataType.simpleString() for f in labelled.schema}
    return labelled.select("doc_id", "held_out", "y", "text").mapInArrow(
        run, f"doc_id {kinds['doc_id']}, held_out boolean, y int, n_tokens long, segments array<struct<score:double,start:long,end:long>>"
    )


def monotone(bins: list[tuple[int, int, int]]) -> tuple[list[int], list[float]]:
    """Non-decreasing shares of toxic rows by evidence bin (bin, rows, toxic), by pooling neighbours that fall."""
    pools: list[list[float]] = []
    for b, n, y in sorted(bins):
        pools.append([b, n, y])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            _, n1, y1 = pools.pop()
            pools[-1][1] += n1
            pools[-1][2] += y1
    return [int(p[0]) for p in pools], [(p[2] + 0.01) / (p[1] + 0.1) for p in pools]


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text, mod 3, is 1. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def toxic_passages(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, n_tokens and the significant segments (with log_e, the log of the number expected by chance) of every row of `docs`."""
    known = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    rows = docs.select("doc_id", "text").join(checked(known), "doc_id", "left").withColumn("held_out", held_out(F.col("doc_id")))
    every, toxic, clean = token_counts(rows)
    w = weights(every, toxic, clean)
    lam = decay(w, every, clean)
    found = written(scanned(rows, w), "segments")
    best = F.coalesce(F.array_max(F.transform("segments", lambda s: s["score"])), F.lit(0.0))
    fit = found.where((F.col("y") == 0) & (F.col("n_tokens") > 0)).agg(F.count("*").alias("n"), F.sum(F.col("n_tokens") * F.exp(-lam * best)).alias("s")).first()
    k = max(fit["n"] / fit["s"], 1e-12) if fit["s"] else 1e-3
    # Logarithms, since the expected number itself may be too small for a double.
    log_e = lambda s: F.log(F.lit(k) * F.col("n_tokens")) - F.lit(lam) * s["score"]
    significant = F.filter(F.transform("segments", lambda s: F.struct(s["score"].alias("score"), s["start"].alias("start"), s["end"].alias("end"), log_e(s).alias("log_e"))), lambda s: s["log_e"] < 0)
    scored = found.withColumn("passages", significant)
    scored = scored.withColumn("evidence", F.aggregate("passages", F.lit(0.0), lambda acc, s: acc - s["log_e"]))
    scored = scored.withColumn("bin", F.floor(F.log1p("evidence") * 4).cast("int"))
    bins = [(r["bin"], r["n"], r["y"]) for r in scored.where("y IS NOT NULL").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("y")).collect()]
    at, share = monotone(bins) if bins else ([0], [0.0])
    score = F.lit(share[0])
    for b, s in zip(at[1:], share[1:], strict=True):
        score = F.when(F.col("bin") >= b, s).otherwise(score)
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))
    out = scored.withColumn("score", score)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_tokens", "evidence", "passages")
