"""Ranks and order statistics that never put a whole stratum in one task.

A stratum (a dataset, a domain, the whole table) may hold any share of the rows, so a
window partitioned by it alone would sort that share in one task. Rows are cut into
ordered buckets instead: counts per bucket give each bucket's offset, and only rows of one
bucket are sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointsman.session import join_checked, summary

HASH_DIGITS = 3
VALUE_BUCKETS = 128
#: Rows of a bucket that one task sorts; a larger bucket is cut again.
SORT_ROWS = 200_000


def _offsets(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows before each bucket and rows of the whole stratum, from counts per bucket."""
    stratum = Window.partitionBy(*keys)
    before = stratum.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(
        *keys,
        "_bucket",
        "_size",
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"),
        F.sum("_size").over(stratum).alias("_n"),
    )


def _hash_buckets(df: DataFrame, order: str) -> DataFrame:
    return df.withColumn("_bucket", F.substring(order, 1, HASH_DIGITS))


def stratum_cutoffs(units: DataFrame, keys: list[str], order: str, ranks) -> DataFrame:
    """Per stratum, `cuts`: the values of `order` at the ranks that `ranks(n)` lists.

    `order` holds hash text, so its leading digits are even buckets. Everything up to a
    cutoff can later be labelled row by row, without ranking or moving the rows. Only the
    buckets that a cutoff falls in are sorted. A rank of 0 gives an empty text, which sorts
    before every hash.
    """
    rows = _hash_buckets(units.select(*keys, order), order)
    counts = rows.groupBy(*keys, "_bucket").agg(F.count("*").alias("_size"))
    spans = _offsets(counts, keys)
    inside = spans.withColumn("_rank", F.explode(F.array_distinct(ranks(F.col("_n"))))).where(
        (F.col("_rank") > F.col("_before")) & (F.col("_rank") <= F.col("_before") + F.col("_size"))
    )
    wanted = inside.groupBy(*keys, "_bucket").agg(
        F.collect_set(F.col("_rank") - F.col("_before")).alias("_wanted"),
        F.first("_before").alias("_before"),
    )
    hit = join_checked(rows, wanted, [*keys, "_bucket"])
    in_bucket = Window.partitionBy(*keys, "_bucket").orderBy(order)
    found = (
        hit.withColumn("_rn", F.row_number().over(in_bucket))
        .where(F.array_contains("_wanted", F.col("_rn").cast("long")))
        .groupBy(*keys)
        .agg(
            F.map_from_entries(
                F.collect_list(F.struct((F.col("_rn") + F.col("_before")).alias("k"), F.col(order).alias("v")))
            ).alias("_found")
        )
    )
    sizes = counts.groupBy(*keys).agg(F.sum("_size").alias("n"))
    return sizes.join(found, keys, "left").select(
        *keys,
        "n",
        F.transform(
            ranks(F.col("n")), lambda r: F.coalesce(F.element_at("_found", r.cast("long")), F.lit(""))
        ).alias("cuts"),
    )


def cutoffs_without(units: DataFrame, keys: list[str], part: str, order: str, ranks) -> DataFrame:
    """`stratum_cutoffs` of every stratum without the rows of each of its parts, and of the whole: (keys, part, n, cuts).

    `part` is null in the row of the whole stratum; a unit whose part is null belongs to none and is never left
    out. What is left of a bucket is its count minus that of the part, so rows are not listed once per part:
    only those of a bucket that some cut falls in are ranked, with the parts whose cut it is.
    """
    rows = _hash_buckets(units.select(*keys, F.col(part).alias("_part"), order), order)
    # One row per (bucket, part) from here on.
    counts = summary(rows.groupBy(*keys, "_bucket", "_part").agg(F.count("*").alias("_c")))
    whole = counts.groupBy(*keys, "_bucket").agg(F.sum("_c").alias("_size"))
    parts = counts.where("_part is not null").select(*keys, F.col("_part").alias("_out")).distinct()
    parts = parts.unionByName(counts.select(*keys).distinct().withColumn("_out", F.lit(None).cast(counts.schema["_part"].dataType)))
    own = counts.where("_part is not null").select(*keys, "_bucket", F.col("_part").alias("_out"), "_c")
    left = parts.join(whole, keys).join(own, [*keys, "_bucket", "_out"], "left")
    left = left.select(*keys, "_out", "_bucket", (F.col("_size") - F.coalesce("_c", F.lit(0))).alias("_size"))
    stratum = Window.partitionBy(*keys, "_out")
    before = stratum.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    spans = left.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).withColumn("n", F.sum("_size").over(stratum))
    spans = summary(spans)
    hits = spans.withColumn("_rank", F.explode(F.array_distinct(ranks(F.col("n"))))).where((F.col("_rank") > F.col("_before")) & (F.col("_rank") <= F.col("_before") + F.col("_size")))
    wanted = hits.groupBy(*keys, "_bucket").agg(F.collect_list(F.struct("_out", (F.col("_rank") - F.col("_before")).alias("_local"), "_rank")).alias("_wanted"))
    inside = join_checked(rows, wanted, [*keys, "_bucket"])
    listed = inside.select(*keys, "_bucket", "_part", order, F.explode("_wanted").alias("w")).where("w._out is null or _part is null or _part <> w._out")
    place = F.row_number().over(Window.partitionBy(*keys, "_bucket", "w._out", "w._rank").orderBy(order))
    found = listed.withColumn("_rn", place).where(F.col("_rn") == F.col("w._local"))
    found = found.groupBy(*keys, F.col("w._out").alias("_out")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("w._rank").alias("k"), F.col(order).alias("v")))).alias("_found"))
    sizes = spans.groupBy(*keys, "_out").agg(F.first("n").alias("n"))
    same = [sizes[k] == found[k] for k in keys] + [sizes["_out"].eqNullSafe(found["_out"])]
    joined = sizes.join(found, same, "left")
    cuts = F.transform(ranks(sizes["n"]), lambda r: F.coalesce(F.element_at("_found", r.cast("long")), F.lit("")))
    return joined.select(*[sizes[k] for k in keys], sizes["_out"].alias(part), sizes["n"], cuts.alias("cuts"))


def hash_positions(df: DataFrame, keys: list[str], order: str, position: str = "pos") -> DataFrame:
    """Position 1..n of every row within its stratum by hash text, plus the stratum size `n`."""
    rows = _hash_buckets(df, order)
    counts = rows.groupBy(*keys, "_bucket").agg(F.count("*").alias("_size"))
    return _positions(rows, counts, keys, [F.col(order)], position)


def _positions(
    rows: DataFrame, counts: DataFrame, keys: list[str], order: list[Column], position: str
) -> DataFrame:
    spans = _offsets(counts, keys).select(*keys, "_bucket", "_before", F.col("_n").alias("n"))
    in_bucket = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        rows.withColumn("_rn", F.row_number().over(in_bucket))
        .join(spans, [*keys, "_bucket"])
        .withColumn(position, (F.col("_rn") + F.col("_before")).cast("long"))
        .drop("_bucket", "_rn", "_before")
    )


def value_buckets(df: DataFrame, keys: list[str], value: str, tie: str | None = None, level: int = 0) -> DataFrame:
    """Add `_bucket`, ordered like (value, tie), with no bucket much above its even share.

    Borders are approximate quantiles; the open range before a border is one bucket and the
    border value itself, which may hold any share of the rows, the next. That one is cut
    again by digits of `tie` (hash text) when there is a tie column, further ones at each `level`.
    """
    shares = [i / VALUE_BUCKETS for i in range(1, VALUE_BUCKETS)]
    borders = F.array_distinct(F.percentile_approx(value, F.array(*[F.lit(s) for s in shares]), 20 * VALUE_BUCKETS))
    if keys:
        marked = join_checked(df, df.groupBy(*keys).agg(borders.alias("_borders")), keys)
        found = F.col("_borders")
    else:
        row = df.agg(borders.alias("b")).first()
        marked, found = df, F.array(*[F.lit(float(b)) for b in (row.b or [0.0])])
    below = F.size(F.filter(found, lambda b: b < F.col(value)))
    on_border = F.array_contains(found, F.col(value))
    within = F.substring(tie, 1 + level * HASH_DIGITS, HASH_DIGITS) if tie else F.lit("")
    bucket = F.concat(
        F.lpad(below.cast("string"), 4, "0"),
        F.when(on_border, F.concat(F.lit("b"), within)).otherwise(F.lit("a")),
    )
    return marked.withColumn("_bucket", bucket).drop("_borders")


def value_positions(df: DataFrame, keys: list[str], value: str, tie: str, position: str = "pos") -> DataFrame:
    """Position 1..n of every row within its stratum by (value, tie), plus the stratum size `n`."""
    const = [] if keys else ["_all"]
    rows = value_buckets(df, keys, value, tie)
    for c in const:
        rows = rows.withColumn(c, F.lit(0))
    counts = rows.groupBy(*keys, *const, "_bucket").agg(F.count("*").alias("_size"))
    return _positions(rows, counts, [*keys, *const], [F.col(value), F.col(tie)], position).drop(*const)


def first_sums(df: DataFrame, keys: list[str], value: str, tie: str, measures: list[str], ranks, level: int = 0) -> DataFrame:
    """(keys, n, rank, sum_<measure>...): sums over the first `rank` rows of a stratum by (value, tie).

    `ranks` gives the ranks from the size of a stratum, or is a table of keys and `ranks`. Selection
    instead of sorting: counts and sums per value bucket answer all but the buckets that a rank falls into
    the middle of. Only their rows are ranked, and where such a bucket has more than `SORT_ROWS` rows it is
    cut into buckets of its own. Strata, values and ties may have any share of the rows.
    """
    const = [] if keys else ["_all"]
    strata = [*keys, *const]
    src = df.select(*keys, *[F.lit(0).alias(c) for c in const], value, tie, *measures)
    rows = value_buckets(src, keys, value, tie, level).persist()
    # One row per bucket from here on.
    counts = rows.groupBy(*strata, "_bucket").agg(F.count("*").alias("_size"), *[F.coalesce(F.sum(m), F.lit(0.0)).alias(f"_t_{m}") for m in measures])
    before = Window.partitionBy(*strata).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    spans = summary(
        counts.select(
            *strata, "_bucket", "_size", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"),
            F.sum("_size").over(Window.partitionBy(*strata)).alias("n"),
            *[F.coalesce(F.sum(f"_t_{m}").over(before), F.lit(0.0)).alias(f"_b_{m}") for m in measures], *[f"_t_{m}" for m in measures],
        )
    )
    listed = spans.withColumn("ranks", ranks(F.col("n"))) if callable(ranks) else spans.join(ranks, strata)
    each = listed.withColumn("rank", F.explode(F.array_distinct(F.col("ranks").cast("array<bigint>")))).drop("ranks")
    inside = (F.col("rank") > F.col("_before")) & (F.col("rank") <= F.col("_before") + F.col("_size"))
    ends = F.col("rank") == F.col("_before") + F.col("_size")
    out = each.where("rank <= 0 and _before = 0").select(*strata, "n", "rank", *[F.lit(0.0).alias(f"sum_{m}") for m in measures])
    out = out.unionByName(each.where(inside & ends).select(*strata, "n", "rank", *[(F.col(f"_b_{m}") + F.col(f"_t_{m}")).alias(f"sum_{m}") for m in measures]))
    # At most one bucket per stratum and rank.
    cut = summary(each.where(inside & ~ends).withColumn("_local", F.col("rank") - F.col("_before")))
    largest = cut.agg(F.max("_size")).first()[0]
    if largest is None:
        return _fixed(out.drop(*const), rows)
    wanted = cut.groupBy(*strata, "_bucket").agg(F.array_sort(F.collect_set("_local")).alias("ranks"))
    hit = join_checked(rows, wanted, [*strata, "_bucket"])
    if largest <= SORT_ROWS or (level + 2) * HASH_DIGITS > 32:
        place = F.row_number().over(Window.partitionBy(*strata, "_bucket").orderBy(value, tie))
        ranked = hit.withColumn("_rn", place).select("*", F.explode(F.filter("ranks", lambda w: w >= F.col("_rn"))).alias("_local"))
        part = ranked.groupBy(*strata, "_bucket", "_local").agg(*[F.sum(m).alias(f"_p_{m}") for m in measures])
    else:
        deeper = f"_within{level}"
        names = [*strata, deeper]
        below = first_sums(hit.withColumnRenamed("_bucket", deeper), names, value, tie, measures, wanted.withColumnRenamed("_bucket", deeper), level + 1)
        part = below.select(*strata, F.col(deeper).alias("_bucket"), F.col("rank").alias("_local"), *[F.col(f"sum_{m}").alias(f"_p_{m}") for m in measures])
    done = cut.join(part, [*strata, "_bucket", "_local"])
    out = out.unionByName(done.select(*strata, "n", "rank", *[(F.col(f"_b_{m}") + F.coalesce(f"_p_{m}", F.lit(0.0))).alias(f"sum_{m}") for m in measures]))
    return _fixed(out.drop(*const), rows)


def _fixed(out: DataFrame, cached: DataFrame) -> DataFrame:
    """A summary that no longer needs the rows it was made of."""
    table = summary(out)
    cached.unpersist()
    return table


def exact_quantiles(df: DataFrame, value: str, shares: list[float], keys: list[str] | None = None) -> DataFrame:
    """Exact linearly interpolated quantiles: (keys, n, quantile `share`, `value`).

    Rows are first counted per distinct value, so a hot value is one row, and the distinct
    values of one bucket are all that a task sorts.
    """
    keys = list(keys or [])
    src = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    rows = value_buckets(src, keys, "_v")
    if not keys:
        rows = rows.withColumn("_all", F.lit(0))
    strata = keys or ["_all"]
    counts = rows.groupBy(*strata, "_bucket", "_v").agg(F.count("*").alias("_size")).persist()
    spans = _offsets(
        counts.groupBy(*strata, "_bucket").agg(F.sum("_size").alias("_size")), strata
    )
    in_bucket = Window.partitionBy(*strata, "_bucket").orderBy("_v")
    within = in_bucket.rowsBetween(Window.unboundedPreceding, -1)
    values = (
        counts.withColumn("_in", F.coalesce(F.sum("_size").over(within), F.lit(0)))
        .withColumnRenamed("_size", "_w")
        .join(spans, [*strata, "_bucket"])
        .withColumn("_lo", F.col("_before") + F.col("_in"))
    )
    wanted = F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")
    hits = values.select("*", wanted).withColumn("_at", (F.col("_n") - 1) * F.col("share"))

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("_lo")) & (rank < F.col("_lo") + F.col("_w")), F.col("_v")))

    low, high = at(F.floor("_at")), at(F.ceil("_at"))
    part = F.max(F.col("_at") - F.floor("_at"))
    found = hits.groupBy(*strata, "share").agg(F.max("_n").alias("n"), (low + (high - low) * part).alias("value"))
    return found if keys else found.drop("_all")
