"""Language identification in two steps: the family first, then pairwise linear machines within it.

Features are hashed character n-grams of one to three bytes of the lower-cased text, as
frequencies, over the whole text. A multinomial logistic model separates families; within a family
one linear support vector machine per pair of languages votes. A text's scores are means of the
models' weights over its n-grams, so scoring is a table lookup per n-gram in Arrow batches.

Models are fitted on at most about `per_language` labelled rows of each language (drawn by a hash
of the id, a documented bound; fewer are used whole). Everything else covers all rows.

Defined cases: a null text or one without any letter gives `und` with score 1; with no labelled
language all texts give `und` with score 0; one learned language is always predicted. Rows with a
null lang are not learned from. Repeated rows are separate rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Families of languages by their two-letter codes. Other codes are families of their own.
FAMILIES = {
    "germanic": "da de en fy is nl no nb nn sv".split(),
    "romance": "ca es fr gl it oc pt ro".split(),
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk".split(),
    "uralic": "et fi hu".split(),
    "turkic": "az kk ky tr tt uz".split(),
    "indic": "bn gu hi mr ne pa ur".split(),
}
BUCKETS = 2048
_BLANKS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_ORDERS = (1, 2, 3)


def family(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang in codes), lang)


def grams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Bucket of every n-gram start for each order, and starts and lengths of the texts in them.

    Texts are laid end to end with blanks between, so the last n-grams read blanks.
    """
    clean = [t.lower().encode("utf-8", "surrogatepass").translate(_BLANKS) for t in texts]
    sizes = np.fromiter(map(len, clean), np.int64, len(clean)) + 2
    flat = np.frombuffer(b"  ".join(clean) + b"    ", np.uint8).astype(np.uint32)
    n = int(sizes.sum())
    out, code = [], np.zeros(n, np.uint32)
    for k, order in enumerate(_ORDERS):
        code = code * np.uint32(257) + flat[k : k + n]
        out.append(((code * np.uint32(2654435761) + np.uint32(order * 40503)) >> np.uint32(16)) % np.uint32(BUCKETS))
    return out, np.cumsum(sizes) - sizes, sizes


def vectors(texts: list[str]) -> np.ndarray:
    """One row of BUCKETS frequencies per text."""
    out = np.zeros((len(texts), BUCKETS))
    if texts:
        codes, starts, sizes = grams(texts)
        for c in codes:
            for i, (s, n) in enumerate(zip(starts, sizes, strict=True)):
                out[i] += np.bincount(c[s : s + n], minlength=BUCKETS) / n
    return out


def linear(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """vectors(texts) @ weights without the vectors."""
    if not texts:
        return np.zeros((0, weights.shape[1]))
    codes, starts, sizes = grams(texts)
    total = np.zeros((len(texts), weights.shape[1]))
    for c in codes:
        for m in range(weights.shape[1]):
            total[:, m] += np.add.reduceat(weights[:, m][c], starts)
    return total / sizes[:, None]


def _batches(b: pa.RecordBatch, column: str, chunk: int = 1 << 20):
    """Slices of the batch's texts of about `chunk` characters."""
    texts = [t or "" for t in b.column(column).to_pylist()]
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chunk or i + 1 == len(texts):
            yield start, texts[start : i + 1]
            start, size = i + 1, 0


def fit(labelled: DataFrame, per_language: int = 1000) -> dict:
    """Models from rows (doc_id, text, lang)."""
    labelled = labelled.where(F.col("lang").isNotNull())
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    families = sorted({family(x) for x in langs})
    model = {"langs": langs, "families": families, "family_weights": None, "pairs": []}
    if len(langs) < 2:
        return model
    share = F.create_map(*[F.lit(v) for x in langs for v in (x, min(1.0, per_language / counts[x]))])
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_000)) / 1_000_000
    sample = labelled.where(draw < share[F.col("lang")]).select("lang", "text")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, texts in _batches(b, "text"):
                v = vectors(texts)
                flat = pa.array(v.ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, BUCKETS, dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays([b.column("lang").slice(start, len(texts)), lists], ["lang", "x"])

    rows = sample.mapInArrow(featured, "lang string, x array<double>").select("lang", array_to_vector("x").alias("features"))
    # The sample is bounded, so a few partitions hold it, whatever the number of input files.
    rows = rows.repartition(max(1, len(langs) * per_language // 1000)).persist()
    try:
        index = lambda names, of: F.create_map(*[F.lit(v) for x in langs for v in (x, float(names.index(of(x))))])[F.col("lang")]
        if len(families) > 1:
            lr = LogisticRegression(family="multinomial", maxIter=20, regParam=1e-4).fit(rows.withColumn("label", index(families, family)))
            model["family_weights"] = (lr.coefficientMatrix.toArray().T, lr.interceptVector.toArray())
        for a, b in combinations(langs, 2):
            if family(a) == family(b):
                two = rows.where(F.col("lang").isin(a, b)).withColumn("label", (F.col("lang") == b).cast("double"))
                svm = LinearSVC(maxIter=20, regParam=1e-4).fit(two)
                model["pairs"].append((a, b, svm.coefficients.toArray(), svm.intercept))
    finally:
        rows.unpersist()
    return model


def decide(texts: list[str], model: dict) -> tuple[list[str], np.ndarray]:
    """Predicted language and a confidence from 0 to 1 of every text."""
    langs, families = model["langs"], model["families"]
    letters = np.array([any(map(str.isalpha, t)) for t in texts], bool)  # the letter categories: no digits, fractions or circled numbers
    if not langs:
        return ["und"] * len(texts), np.where(letters, 0.0, 1.0)
    fw = model["family_weights"]
    columns = ([] if fw is None else [fw[0]]) + [p[2][:, None] for p in model["pairs"]]
    scores = linear(texts, np.concatenate(columns, axis=1)) if columns else np.zeros((len(texts), 0))
    k = 0
    if fw is None:
        prob = np.ones((len(texts), 1))
    else:
        k = len(families)
        z = scores[:, :k] + fw[1]
        e = np.exp(z - z.max(axis=1, keepdims=True))
        prob = e / e.sum(axis=1, keepdims=True)
    chosen = prob.argmax(axis=1)
    votes, sure = np.zeros((len(texts), len(langs))), np.ones(len(texts))
    margins = [scores[:, k + i] + p[3] for i, p in enumerate(model["pairs"])]
    for (a, b, *_), m in zip(model["pairs"], margins, strict=True):
        votes[:, langs.index(a)] += m <= 0
        votes[:, langs.index(b)] += m > 0
    own = np.array([families.index(family(x)) for x in langs])
    best = np.where(own[None, :] == chosen[:, None], votes, -1).argmax(axis=1)
    for (a, b, *_), m in zip(model["pairs"], margins, strict=True):
        mine = (best == langs.index(a)) | (best == langs.index(b))
        p = 1 / (1 + np.exp(-2 * np.clip(np.where(best == langs.index(b), m, -m), -30, 30)))
        sure = np.where(mine, np.minimum(sure, p), sure)
    out = [langs[i] if ok else "und" for i, ok in zip(best, letters, strict=True)]
    return out, np.where(letters, prob[np.arange(len(texts)), chosen] * sure, 1.0)


def predict(docs: DataFrame, model: dict, *more: str) -> DataFrame:
    """doc_id, lang_pred, score and the columns `more` of every row of `docs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, texts in _batches(b, "text"):
                langs, score = decide(texts, model)
                kept = [b.column(c).slice(start, len(texts)) for c in ("doc_id", *more)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(langs, pa.string()), pa.array(score)], ["doc_id", *more, "lang_pred", "score"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ("doc_id", *more)) + ", lang_pred string, score double"
    return docs.select("doc_id", "text", *more).mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text, mod 4, is 2. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2
