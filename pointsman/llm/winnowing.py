"""Benchmark decontamination by winnowing (built-in expressions only).

A document's fingerprints are the smallest k-gram hashes of its windows of w consecutive k-grams.
With w + k - 1 equal to the shortest span to find, every shared span of that many words keeps a
fingerprint on both sides. Fingerprints are joined with those of the benchmark, each hit is
extended to the spans around it, and the spans are compared word by word with the benchmark's.

Benchmark items with fewer words than a span are looked up whole: a window of one gram as long as
the item, which keeps every gram.

Defined cases: a null or empty text has no words and is not contaminated; an item without words is
in no document; a null item_id counts as the id ''; repeated rows each get their own result row;
items with equal ids count once. Other columns are ignored. An empty benchmark leaves all clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointsman.llm.common import checked
from pointsman.llm.exact_stream import located

#: Bytes that separate words: all ASCII but digits and lower-case letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST = -(2**63)


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS), "")


def _shifted(a: Column, b: Column, shift: int, fn) -> Column:
    """fn(a[i], b[i + shift]) for all i that both have."""
    n = F.greatest(F.least(F.size(a), F.size(b) - shift), F.lit(0))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, shift + 1, n), fn)


def _spanning(df: DataFrame, base: str, width: int, fn, out: str) -> DataFrame:
    """Column `out`: fn folded over every `width` consecutive elements of `base`, by doubling."""
    have, at = 1, base
    while have < width:
        step = min(have, width - have)
        nxt = out if have + step == width else f"_{out}{have + step}"
        df = df.withColumn(nxt, _shifted(F.col(at), F.col(at), step, fn))
        have, at = have + step, nxt
    return df if at == out else df.withColumn(out, F.col(at))


def fingerprints(df: DataFrame, k: int, window: int) -> DataFrame:
    """Column `marks`: for every k-gram of `words` its hash if some window keeps it, else null.

    Of equal smallest hashes all are kept, so both sides of a shared span keep the same ones.
    """
    mix = lambda a, b: F.xxhash64(a, b)
    df = df.withColumn("_h", F.transform("words", lambda x: F.xxhash64(x)))
    df = _spanning(df, "_h", k, mix, "_g")
    df = _spanning(df, "_g", window, lambda a, b: F.least(a, b), "_m")
    edge = F.array_repeat(F.lit(LEAST), window - 1)
    df = df.withColumn("_p", F.concat(edge, F.col("_m"), edge))
    df = _spanning(df, "_p", window, lambda a, b: F.greatest(a, b), "_x")
    return df.withColumn("marks", F.zip_with("_g", "_x", lambda g, x: F.when(g == x, g)))


def _grams(df: DataFrame, length: int, out: str) -> DataFrame:
    """Column `out`: a hash of every `length` consecutive words, apart from those of other lengths."""
    df = _spanning(df, "_h", length, lambda a, b: F.xxhash64(a, b), f"_s{length}")
    return df.withColumn(out, F.transform(f"_s{length}", lambda x: F.xxhash64(x, F.lit(length))))


def spans(benchmark: DataFrame, span: int) -> DataFrame:
    """One row per different window of the benchmark: its words joined by blanks, their number, the items with it."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("words"))
    items = items.withColumn("n", F.size("words")).where("n > 0").withColumn("len", F.least("n", F.lit(span)))
    starts = items.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("len") + 1)))
    joined = starts.select("item", F.col("len"), F.array_join(F.expr("slice(words, at, len)"), " ").alias("span"))
    return joined.groupBy("span", "len").agg(F.sort_array(F.collect_set("item")).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, *more: str, span: int = 10, k: int = 5) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted ids of the items found), contaminated and the columns `more` of every row."""
    window = span - k + 1
    found = spans(benchmark, span)
    short = sorted(r["len"] for r in found.where(F.col("len") < span).select("len").distinct().collect())  # below `span`

    def marked(df: DataFrame) -> DataFrame:
        df = fingerprints(df, k, window)
        for n in short:
            df = _grams(df, n, f"short{n}")
        return df

    # The benchmark's marks: those of its windows, each taken as a text of its own.
    own = marked(found.select("len", F.split("span", " ").alias("words")))
    kept = F.when(F.col("len") == span, F.array_compact("marks"))
    for n in short:
        kept = kept.when(F.col("len") == n, F.col(f"short{n}"))
    marks = checked(own.select(F.explode_outer(kept).alias("mark")).where("mark IS NOT NULL").distinct(), 2_000_000)

    row = F.struct(F.monotonically_increasing_id().alias("row"), "doc_id", *more)
    rows = docs.select(row.alias("row"), words(F.col("text")).alias("words"))
    rows = marked(rows.withColumn("n_words", F.size("words").cast("long")))
    # One leading null per row, so that rows without any hit come through as well; then all marks in one array.
    pieces, ends = [F.array(F.lit(None).cast("long")), F.col("marks")], []
    end = F.size("marks")
    for n in short:
        pieces.append(F.col(f"short{n}"))
        ends.append((n, end))
        end = end + F.size(f"short{n}")
    rows = rows.select("row", "n_words", "words", F.concat(*pieces).alias("all_marks"), *[e.alias(f"end{n}") for n, e in ends])
    # The outer form, since the optimizer would copy the whole chain of marks into a size filter below the plain one.
    hits = rows.select("*", F.posexplode_outer("all_marks").alias("pos", "mark")).where("pos = 0 OR mark IS NOT NULL").drop("all_marks")
    # A row's leading null meets nothing (its hit is not asked for), but each under a key of its own: as null they would all be in one task.
    hits = hits.withColumn("mark", F.coalesce("mark", F.xxhash64("row.row", F.lit("none"))))
    hits = hits.join(marks.withColumn("hit", F.lit(True)), "mark", "left").where("pos = 0 OR hit")
    at, length = F.col("pos") - 1, F.lit(span)
    start = F.greatest(at - (window - 1), F.lit(0))
    stop = F.least(at, F.col("n_words").cast("int") - span)
    for n, e in ends:
        here = F.col("pos") - 1 >= F.col(f"end{n}")
        start, stop = F.when(here, F.col("pos") - 1 - F.col(f"end{n}")).otherwise(start), F.when(here, F.col("pos") - 1 - F.col(f"end{n}")).otherwise(stop)
        length = F.when(here, n).otherwise(length)
    wanted = F.when((F.col("pos") > 0) & (stop >= start), F.sequence(start, stop))
    near = hits.select("row", "n_words", "words", length.alias("len"), F.explode_outer(wanted).alias("start"))
    near = near.select("row", "n_words", "len", "start", F.when(F.col("start").isNotNull(), F.array_join(F.expr("slice(words, start + 1, len)"), " ")).alias("span"))
    # Words hold no blank before the first one, so these keys are no spans.
    near = near.withColumn("span", F.coalesce("span", F.concat(F.lit(" "), F.col("row.row").cast("string"))))
    true = near.join(checked(found.drop("len"), 200_000), "span", "left")
    per_row = true.groupBy("row").agg(
        F.first("n_words").alias("n_words"),
        F.sort_array(F.collect_set(F.when(F.col("items").isNotNull(), F.struct("start", "len")))).alias("at"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    covered = F.aggregate(
        "at", zero,
        lambda acc, x: F.struct(
            F.greatest(acc["end"], x["start"] + x["len"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), x["start"] + x["len"] - F.greatest(acc["end"], x["start"]))).alias("n"),
        ),
        lambda acc: acc["n"],
    )
    out = per_row.select("row.doc_id", *[f"row.{m}" for m in more], "n_words", covered.cast("long").alias("n_hit"), "items")
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def without_leaks(docs: DataFrame, benchmark: DataFrame, span: int = 10) -> DataFrame:
    """The rows of `docs` without any span of the benchmark, with all their columns."""
    places, file, row = located(docs)
    keep = contamination(places, benchmark, file, row, span=span).where(~F.col("contaminated"))
    return places.join(keep.select(file, row), [file, row], "left_semi").drop(file, row)
