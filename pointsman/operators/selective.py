"""Selective routing: risk-coverage curves, thresholds and abstention controls."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointsman.functions import draws, numeric
from pointsman.operators import ranking
from pointsman.operators.metrics import sample_std
from pointsman.session import fetched, join_checked, spread, summary, written

# Default coverage points.
RISK_COVERAGES = [1.0, 0.95, 0.9, 0.85, 0.8, 0.7, 0.6, 0.5]
#: Blocks of repeats that tasks draw for, about how many rows a task draws from at least, and leading digits (1 or 2) of a hash that are counted together.
REPEAT_BLOCKS, REPEAT_ROWS, DRAW_DIGITS = 16, 50_000, 2
#: Cells that cutoffs fall into which every task may know.
CUT_CELLS = 1_000_000
#: Domains of a batch whose draws are added up at a time.
RUNS_AT_ONCE = 32
ABSTENTION_COVERAGES = [0.5, 0.6, 0.7, 0.8, 0.9, 1.0]


def risk_coverage_curve(rows: DataFrame, uncertainty: str, coverages: list[float] = RISK_COVERAGES) -> DataFrame:
    """Mean regret of the most certain share, per coverage. Ties are broken by a hash of the id.

    Sums of the first k rows are selected, not sorted (`ranking.first_sums`).
    """
    src = rows.select("sample_id", "regret", F.col(uncertainty).alias("_u")).withColumn("_tie", draws.hash_text(F.col("sample_id")))
    share = F.array(*[F.lit(float(c)) for c in sorted(set(coverages))])
    kept = lambda n: F.transform(share, lambda c: F.greatest(F.lit(1).cast("long"), numeric.half_even(n * c)))
    sums = ranking.first_sums(src, [], "_u", "_tie", ["regret"], kept)
    # Coverages that keep the same number of rows are points of their own.
    each = summary(sums).select("n", "rank", "sum_regret", F.explode(kept(F.col("n"))).alias("_k")).where(F.col("_k") == F.col("rank"))
    return each.select((F.col("rank") / F.col("n")).alias("coverage"), (F.col("sum_regret") / F.col("rank")).alias("risk"), F.col("rank").alias("n"))


def aurc(curve: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Area under the curve by trapezoids. A curve is a handful of rows."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    w = w.orderBy("coverage", "risk")
    step = (F.col("coverage") - F.lag("coverage").over(w)) * (F.col("risk") + F.lag("risk").over(w)) / 2.0
    return curve.withColumn("_a", step).groupBy(*keys).agg(F.coalesce(F.sum("_a"), F.lit(0.0)).alias("aurc"))


def threshold_grid(min_coverage: float = 0.5, grid_size: int = 101) -> list[float]:
    n = max(2, int(grid_size))
    return [min_coverage + (1.0 - min_coverage) * i / (n - 1) for i in range(n)]


def select_threshold(
    rows: DataFrame, min_coverage: float = 0.5, grid_size: int = 101, keys: tuple[str, ...] = ()
) -> DataFrame:
    """The uncertainty quantile with the best routed-or-fallback score; higher coverage, then the lower quantile, on ties.

    `rows` has uncertainty, router_score and fallback_score. Each row is counted once, in
    the grid cell of the first threshold that admits it; running sums over the grid then
    give every threshold's score, instead of a pass per threshold. A group without any
    threshold (no finite uncertainty) fails the job.
    """
    const = [] if keys else ["_all"]
    strata = [*keys, *const]
    src = rows.select(*keys, *[F.lit(0).alias(c) for c in const], "uncertainty", "router_score", "fallback_score").persist()
    quantiles = ranking.exact_quantiles(src, "uncertainty", threshold_grid(min_coverage, grid_size), list(keys))
    for c in const:
        quantiles = quantiles.withColumn(c, F.lit(0))
    taus = quantiles.groupBy(*strata).agg(
        F.array_sort(F.array_distinct(F.collect_list("value"))).alias("_taus"), F.first("n").alias("_n")
    )
    taus = summary(taus)
    placed = join_checked(src, taus, strata)
    cell = F.size(F.filter("_taus", lambda t: t < F.col("uncertainty")))
    cells = placed.groupBy(*strata, cell.alias("_cell")).agg(
        F.count("*").alias("_c"),
        F.sum("router_score").alias("_r"),
        F.sum("fallback_score").alias("_f"),
    )
    upto = Window.partitionBy(*strata).orderBy("_cell")
    whole = Window.partitionBy(*strata)
    total_f = F.sum("_f").over(whole)
    swept = cells.join(taus, strata).select(
        *strata,
        F.get("_taus", F.col("_cell")).alias("threshold"),
        (F.sum("_c").over(upto) / F.col("_n")).alias("coverage"),
        ((F.sum("_r").over(upto) + total_f - F.sum("_f").over(upto)) / F.col("_n")).alias("score"),
    )
    fits = (F.col("coverage") + numeric.TINY >= min_coverage) & F.col("threshold").isNotNull() & ~F.isnan("threshold")
    # Scores are sums in varying order; equal ones are told apart no finer than this.
    rank = F.struct(-F.round("score", 12), -F.col("coverage"), F.col("threshold"))
    best = swept.groupBy(*strata).agg(F.min_by(F.struct("threshold", "coverage", "score"), F.when(fits, rank)).alias("b"))
    found = F.coalesce("b", F.raise_error(F.lit("no threshold reaches the least coverage")))
    return best.select(*keys, found.alias("b")).select(*keys, "b.*")


def _routed_means(base: DataFrame, coverages: list[float], value: str, selector: str) -> DataFrame:
    """Score per domain and coverage when the rows with the smallest `value` are routed and the others fall back."""
    sums = ranking.first_sums(base, ["domain"], value, "_tie", ["router_score", "fallback_score"], lambda n: _counts(n, coverages))
    total = base.groupBy("domain").agg(F.sum("fallback_score").alias("_f"))
    points = F.arrays_zip(F.array(*[F.lit(float(c)) for c in coverages]).alias("coverage"), _counts(F.col("n"), coverages).alias("k"))
    each = join_checked(sums, total, "domain").select("*", F.explode(points).alias("p")).where(F.col("p.k") == F.col("rank"))
    score = (F.col("sum_router_score") + F.col("_f") - F.col("sum_fallback_score")) / F.col("n")
    return each.select("domain", F.col("p.coverage").alias("coverage"), score.alias("score"), F.lit(selector).alias("selector"))


def _counts(n: Column, coverages: list[float]) -> Column:
    shares = F.array(*[F.lit(float(c)) for c in coverages])
    return F.transform(shares, lambda c: F.greatest(F.lit(0).cast("long"), F.least(n, numeric.half_even(n * c))))


def _heads(seed: int, low: int, high: int) -> list[bytes]:
    """What comes before the id in the hashes of a block of repeats."""
    return [f"{seed}:{r}".encode() for r in range(low, high + 1)]


def _runs(batch: pa.RecordBatch) -> tuple[list, np.ndarray]:
    """The runs of equal (first repeat, last repeat, domain) in sorted rows, and where each begins; the last entry is the end."""
    keys = list(zip(*(batch.column(c).to_pylist() for c in ("a", "b", "domain")), strict=True))
    starts = [i for i, k in enumerate(keys) if not i or k != keys[i - 1]]
    return [keys[i] for i in starts], np.array([*starts, len(keys)])


def _number(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column, 0 where null, and whether they are not null."""
    seen = np.asarray(column.is_valid())
    return np.where(seen, column.to_numpy(zero_copy_only=False), 0.0), seen.astype(float)


def _drawn_sums(batches: Iterator[pa.RecordBatch], seed: int, digits: int) -> Iterator[pa.RecordBatch]:
    """Per domain, repeat and leading digits of the hash: rows, sums and counts of both scores. Rows come sorted by block and domain."""
    held, sums, wide, type_ = None, np.zeros(0), 16**digits, None

    def found() -> pa.RecordBatch:
        at, bucket = np.nonzero(sums[0])
        size, *cells = sums[:, at, bucket]
        columns = [pa.array([held[2]] * len(at), type_), pa.array(at.astype(np.int32) + np.int32(held[0])), pa.array(bucket.astype(np.int32)), pa.array(size.astype(np.int64))]
        return pa.RecordBatch.from_arrays([*columns, *[pa.array(v) for v in cells[:2]], *[pa.array(v.astype(np.int64)) for v in cells[2:]]], _SUMS)

    for batch in batches:
        names, starts = _runs(batch)
        texts = [None if t is None else t.encode() for t in batch.column("sample_id").to_pylist()]
        (r, has_r), (f, has_f) = _number(batch.column("_r")), _number(batch.column("_f"))
        type_ = batch.schema.field("domain").type
        for low in sorted({n[0] for n in names}):
            own = [k for k, n in enumerate(names) if n[0] == low]
            part = slice(starts[own[0]], starts[own[-1] + 1])
            hashes = np.stack([*draws.hash_ints(_heads(seed, *names[own[0]][:2]), texts[part])]) >> np.uint32(32 - 4 * digits)
            # A batch may hold as many domains as rows.
            for some in (own[i : i + RUNS_AT_ONCE] for i in range(0, len(own), RUNS_AT_ONCE)):
                first, end = starts[some[0]], starts[some[-1] + 1]
                run = np.repeat(np.arange(len(some)) * wide, np.diff(starts)[some])
                made = np.empty((5, len(hashes), len(some), wide))
                for k, bucket in enumerate(hashes[:, first - part.start : end - part.start]):
                    for j, w in enumerate((None, r, f, has_r, has_f)):
                        made[j, k] = np.bincount(run + bucket, w if w is None else w[first:end], len(some) * wide).reshape(-1, wide)
                for k, place in enumerate(some):
                    if held != names[place]:
                        if held is not None:
                            yield found()
                        held, sums = names[place], np.zeros((5, len(hashes), wide))
                    sums += made[:, :, k]
    if held is not None:
        yield found()


def _drawn_rows(batches: Iterator[pa.RecordBatch], seed: int, digits: int, wanted: dict) -> Iterator[pa.RecordBatch]:
    """The rows of the wanted (repeat, leading digits) of each domain, with their whole hash."""
    for batch in batches:
        names, starts = _runs(batch)
        texts = [None if t is None else t.encode() for t in batch.column("sample_id").to_pylist()]
        for low in sorted({n[0] for n in names}):
            own = [k for k, n in enumerate(names) if n[0] == low]
            first, end = starts[own[0]], starts[own[-1] + 1]
            heads = _heads(seed, *names[own[0]][:2])
            # Runs of which nothing is wanted share the first place.
            cut = [k for k in own if names[k][2] in wanted]
            asked, slots = np.zeros((len(heads), 1 + len(cut), 16**digits), bool), np.zeros(len(names), np.int64)
            slots[cut] = np.arange(1, 1 + len(cut))
            for k in cut:
                for repeat, bucket in wanted[names[k][2]]:
                    if 0 <= repeat - low < len(heads):
                        asked[repeat - low, slots[k], bucket] = True
            if not asked.any():
                continue
            run = np.repeat(slots[own], np.diff(starts)[own])
            for k, hashes in enumerate(draws.hash_ints(heads, texts[first:end])):
                bucket = hashes >> np.uint32(32 - 4 * digits)
                at = np.flatnonzero(asked[k, run, bucket])
                if len(at):
                    rows = pa.array(at + first)
                    whole = pa.array([draws.md5_digest(heads[k], texts[i]) for i in (at + first).tolist()], pa.binary())
                    columns = [batch.column("domain").take(rows), pa.array(np.full(len(at), low + k, np.int32)), pa.array(bucket[at].astype(np.int32)), whole]
                    yield pa.RecordBatch.from_arrays([*columns, *[batch.column(c).take(rows) for c in ("_r", "_f")]], _ROWS)


_SUMS = ["domain", "repeat", "_bucket", "_size", "_s_r", "_s_f", "_c_r", "_c_f"]
_ROWS = ["domain", "repeat", "_bucket", "_h", "_r", "_f"]


def _random_draws(base: DataFrame, coverages: list[float], repeats: int, seed: int) -> DataFrame:
    """Mean and deviation over draws. A draw of k rows is the set up to the k-th hash, so it needs only a cutoff.

    Sums per leading digits of the hash answer all but the digits that a cutoff falls into; only their rows are ranked.
    """
    # A task draws for a block of repeats, so its sums are few beside its draws.
    blocks = [(repeats * k // REPEAT_BLOCKS, repeats * (k + 1) // REPEAT_BLOCKS) for k in range(REPEAT_BLOCKS)]
    parts = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b - 1).alias("b")) for a, b in blocks if a < b])
    scores = [F.col(c).cast("double").alias(n) for c, n in (("router_score", "_r"), ("fallback_score", "_f"))]
    few = base.where("domain is not null").select("domain", F.col("sample_id").cast("string").alias("sample_id"), *scores, F.explode(parts).alias("_p"))
    # Some shares for each task, as it sums up whatever share it has.
    tasks = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = min(1 + base.count() // REPEAT_ROWS, -(-4 * tasks // REPEAT_BLOCKS))
    share = F.pmod(F.xxhash64("sample_id"), F.lit(shares)).alias("_share")
    dealt = spread(few.select("*", "_p.a", "_p.b", share), "a", "_share").drop("_p", "_share").sortWithinPartitions("a", "domain")
    keys = ["domain", "repeat", "_bucket"]
    digits, name = DRAW_DIGITS, base.schema["domain"].dataType.simpleString()
    sums = dealt.mapInArrow(lambda rows: _drawn_sums(rows, seed, digits), f"domain {name}, repeat int, _bucket int, _size long, _s_r double, _s_f double, _c_r long, _c_f long")
    counts = written(sums.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in _SUMS[3:]]), "draws")
    stratum = Window.partitionBy("domain", "repeat")
    before = stratum.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    after = stratum.orderBy("_bucket").rowsBetween(1, Window.unboundedFollowing)
    outside = lambda k: F.coalesce(F.sum(f"_{k}_r").over(before), F.lit(0)) + F.coalesce(F.sum(f"_{k}_f").over(after), F.lit(0))
    spans = counts.select(
        "*", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"), F.sum("_size").over(stratum).alias("n"), outside("s").alias("_s"), outside("c").alias("_c")
    )
    each = spans.withColumn("rank", F.explode(F.array_distinct(_counts(F.col("n"), coverages)))).withColumn("_local", F.col("rank") - F.col("_before"))
    first = (F.col("rank") == 0) & (F.col("_before") == 0)
    cut = summary(each.where(first | ((F.col("_local") > 0) & (F.col("_local") <= F.col("_size")))))
    wanted = cut.where("_local > 0 and _local < _size").groupBy(*keys).agg(F.collect_set("_local").alias("_wanted"))
    cells = fetched(wanted.select(*keys), CUT_CELLS)
    if cells is None:
        rows = dealt.withColumn("repeat", F.explode(F.sequence("a", "b"))).withColumn("_t", draws.hash_text(seed, F.col("repeat"), F.col("sample_id")))
        rows = rows.select("domain", "repeat", F.conv(F.substring("_t", 1, digits), 16, 10).cast("int").alias("_bucket"), F.unhex("_t").alias("_h"), "_r", "_f")
    else:
        asked: dict = {}
        for domain, repeat, bucket in zip(*(cells.toArrow().column(c).to_pylist() for c in keys), strict=True):
            asked.setdefault(domain, []).append((repeat, bucket))
        shared = base.sparkSession.sparkContext.broadcast(asked)
        rows = dealt.mapInArrow(lambda rows: _drawn_rows(rows, seed, digits, shared.value), f"domain {name}, repeat int, _bucket int, _h binary, _r double, _f double")
    # Rows of one hash are drawn together.
    place = F.rank().over(Window.partitionBy(*keys).orderBy("_h"))
    ranked = join_checked(rows, wanted, keys).withColumn("_rk", place).select(*keys, "_rk", "_r", "_f", F.explode("_wanted").alias("_local"))
    value = F.when(F.col("_rk") <= F.col("_local"), F.col("_r")).otherwise(F.col("_f"))
    inner = ranked.groupBy(*keys, "_local").agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("_is"), F.count(value).alias("_ic"))
    whole = lambda k, i: F.col(f"_{k}") + F.when(F.col("_local") == 0, F.col(f"_{k}_f")).when(F.col("_local") == F.col("_size"), F.col(f"_{k}_r")).otherwise(F.col(i))
    done = cut.join(inner, [*keys, "_local"], "left").withColumn("_total", whole("s", "_is")).withColumn("_seen", whole("c", "_ic"))
    points = F.arrays_zip(F.array(*[F.lit(float(c)) for c in coverages]).alias("coverage"), _counts(F.col("n"), coverages).alias("k"))
    drawn = done.select("domain", "rank", F.when(F.col("_seen") > 0, F.col("_total") / F.col("_seen")).alias("score"), F.explode(points).alias("p"))
    return (
        drawn.where(F.col("p.k") == F.col("rank"))
        .groupBy("domain", "p.coverage")
        .agg(F.avg("score").alias("_m"), sample_std("score").alias("std"))
        .select("domain", "coverage", F.col("_m").alias("score"), F.lit("random").alias("selector"), "std")
    )


def _random_moments(base: DataFrame, coverages: list[float]) -> DataFrame:
    """Mean and deviation of the score of a uniform draw of k of n rows, from the moments of the advantage."""
    adv = F.col("router_score") - F.col("fallback_score")
    m = base.groupBy("domain").agg(
        F.count("*").alias("n"),
        F.avg("fallback_score").alias("f"),
        F.avg(adv).alias("a"),
        F.coalesce(F.var_samp(adv), F.lit(0.0)).alias("v"),
    )
    each = F.explode(F.arrays_zip(F.array(*[F.lit(float(c)) for c in coverages]).alias("coverage"), _counts(F.col("n"), coverages).alias("k")))
    share = F.col("p.k") / F.col("n")
    return m.select("*", each.alias("p")).select(
        "domain",
        F.col("p.coverage").alias("coverage"),
        (F.col("f") + share * F.col("a")).alias("score"),
        F.lit("random").alias("selector"),
        F.sqrt(share * (1.0 - share) * F.col("v") / F.col("n")).alias("std"),
    )


def abstention_controls(
    rows: DataFrame,
    coverages: list[float] = ABSTENTION_COVERAGES,
    random_repeats: int = 1000,
    seed: int = 3407,
    domain: str = "domain",
    random: str = "draws",
) -> DataFrame:
    """Score per domain, coverage and selector: by entropy, at random, and by true advantage.

    `rows` has sample_id, the domain, uncertainty, router_score and fallback_score. The
    random selector repeats its `draws` or, with `moments`, gives the exact mean and
    deviation that the draws converge to.
    """
    base = rows.select(F.col(domain).alias("domain"), "sample_id", "uncertainty", "router_score", "fallback_score")
    base = base.withColumn("_tie", draws.hash_text(F.col("sample_id"))).persist()
    oracle = base.withColumn("_adv", F.col("fallback_score") - F.col("router_score"))
    if random not in ("draws", "moments"):
        raise ValueError(f"unknown random selector: {random}")
    chance = _random_draws(base, coverages, random_repeats, seed) if random == "draws" else _random_moments(base, coverages)
    fixed = _routed_means(base, coverages, "uncertainty", "semantic_entropy").unionByName(_routed_means(oracle, coverages, "_adv", "oracle"))
    return fixed.withColumn("std", F.lit(0.0)).unionByName(chance)


def abstention_macro(table: DataFrame) -> DataFrame:
    return table.groupBy("coverage", "selector").agg(F.avg("score").alias("score"), F.avg("std").alias("std"))


def domain_macro(results: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Unweighted means over domains."""
    return results.groupBy(*keys).agg(
        F.avg("test_score").alias("macro_test_score"),
        F.avg("router_only_score").alias("macro_router_only_score"),
        F.avg("best_single_score").alias("macro_best_single_score"),
        F.avg("test_coverage").alias("macro_test_coverage"),
    )


def calibrated_seed_summary(per_seed: DataFrame) -> DataFrame:
    """Means and deviations over seeds, in percent."""
    pairs = [("test_score", "macro_test_score"), ("router_only", "macro_router_only_score"), ("coverage", "macro_test_coverage")]
    stats = [
        (f(c) * 100.0).alias(f"{name}_{tag}_pct")
        for name, c in pairs
        for tag, f in (("mean", F.avg), ("std", F.stddev_samp))
    ]
    return per_seed.agg(F.count("*").alias("n_seeds"), *stats)
