"""TF-IDF features: word 1- and 2-grams, sublinear counts, smoothed idf, unit length."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointsman.session import spread, written

MAX_FEATURES = 50_000
MIN_DF = 2
#: Samples whose terms are in a task's memory at once.
TEXTS = 256
# Fixed value: a word is at least two word characters.
WORD = r"(?U)\b\w\w+\b"


def terms(text: Column) -> Column:
    """Lower-case words and pairs of neighbours, with repeats."""
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)
    pairs = F.when(
        F.size(words) > 1,
        F.zip_with(
            F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b)
        ),
    ).otherwise(F.array().cast("array<string>"))
    return F.concat(words, pairs)


def term_lists(docs: DataFrame) -> DataFrame:
    """(sample_id, terms, tfs): the distinct terms of each sample over its whole texts, one row per sample.

    Terms are counted text by text where they are cut; only a sample of several texts meets the others by its id.
    A table of all (sample, term) rows, many times the texts, is never sorted or hashed.
    """
    kind = docs.schema["sample_id"].dataType.simpleString()
    # Texts are spread by id before they are cut: a file of few row groups would be cut by few tasks. Null texts have no terms.
    spread_ = docs.select("sample_id", "query").groupBy("sample_id").agg(F.collect_list("query").alias("texts"))
    texts = spread(spread_, "sample_id").select("sample_id", F.transform("texts", lambda t: F.regexp_extract_all(F.lower(t), F.lit(WORD), 0)).alias("texts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for start in range(0, big.num_rows, TEXTS):
                b = big.slice(start, TEXTS)
                names, counts, ends = [], [], [0]
                for texts in b.column("texts").to_pylist():
                    found = Counter()
                    for ws in texts:
                        found.update(ws)
                        found.update(map(" ".join, zip(ws, ws[1:])))
                    names += found.keys()
                    counts += found.values()
                    ends.append(len(names))
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, t)) for v, t in ((names, pa.string()), (counts, pa.int64()))]
                yield pa.RecordBatch.from_arrays([b.column("sample_id"), *lists], ["sample_id", "terms", "tfs"])

    return texts.mapInArrow(run, f"sample_id {kind}, terms array<string>, tfs array<bigint>")


def exploded(lists: DataFrame) -> DataFrame:
    """(sample_id, term, tf) of term lists."""
    return lists.select("sample_id", F.explode(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf"))).alias("t")).select("sample_id", "t.*")


def vocabulary(counts: DataFrame, max_features: int = MAX_FEATURES, min_df: int = MIN_DF) -> DataFrame:
    """(term, df): terms of enough documents, the most frequent in the corpus first; ties by term."""
    stats = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
    return stats.where(F.col("df") >= min_df).orderBy(F.desc("total"), "term").limit(max_features).select("term", "df")


def weights(lists: DataFrame, vocab: list, n_docs: int) -> DataFrame:
    """(sample_id, term, weight), each sample scaled to unit length; each task looks terms up in the vocabulary, so none are joined or sorted."""
    known = lists.sparkSession.sparkContext.broadcast({r.term: log((1.0 + n_docs) / (1.0 + r.df)) + 1.0 for r in vocab})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = known.value
        for big in batches:
            for start in range(0, big.num_rows, TEXTS):
                b = big.slice(start, TEXTS)
                at, names, out = [], [], [np.zeros(0)]
                for k, (terms, tfs) in enumerate(zip(b.column("terms").to_pylist(), b.column("tfs").to_pylist(), strict=True)):
                    own = [(t, (1.0 + log(n)) * idf[t]) for t, n in zip(terms, tfs, strict=True) if t in idf]
                    if own:
                        w = np.array([v for _, v in own])
                        names += [t for t, _ in own]
                        at += [k] * len(own)
                        out.append(w / np.sqrt((w * w).sum()))
                yield pa.RecordBatch.from_arrays([b.column("sample_id").take(pa.array(at, pa.int32())), pa.array(names, pa.string()), pa.array(np.concatenate(out))], ["sample_id", "term", "weight"])

    return lists.select("sample_id", "terms", "tfs").mapInArrow(run, f"sample_id {lists.schema['sample_id'].dataType.simpleString()}, term string, weight double")


def tfidf_features(docs: DataFrame, max_features: int = MAX_FEATURES, min_df: int = MIN_DF) -> DataFrame:
    # Cutting texts into words costs most, so it is done once.
    lists = written(term_lists(docs), "terms")
    # The vocabulary is at most max_features rows.
    return weights(lists, vocabulary(exploded(lists), max_features, min_df).collect(), docs.count())
