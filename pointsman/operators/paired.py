"""Paired comparison of two systems: differences, bootstrap intervals, permutation p-values.

Two ways of drawing, chosen by the caller. `hash`: every draw is a hash of (seed, replicate,
unit), which SQL can repeat; tasks that hold a chunk of a dataset's units draw for a block of replicates and return sums. `counts`:
units with equal values are first counted, and a replicate draws how often each value occurs
(multinomial for the bootstrap, binomial for sign flips), which has the same distribution and
costs replicates times distinct values; scores of 0 and 1 leave three values, however many
samples there are. Distinct values are spread over chunks. A chunk's share of a replicate comes
down a binary tree over the chunks of its dataset: at every node the draws above are split by a
binomial that all chunks below it repeat, so a chunk knows the masses of its ancestors only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointsman.functions import draws, text
from pointsman.operators import ranking
from pointsman.operators.metrics import sample_std
from pointsman.session import join_checked, spread

VALUES_PER_CHUNK = 10_000
#: Replicates are cut into this many blocks, each a task of its own for every chunk of values.
BLOCKS = 16
#: Units of a dataset that one task of hash draws holds.
SLOTS = 1 << 19
SIGN_BITS = 32
TOLERANCE = 1e-15


def paired_frame(samples: DataFrame, a: DataFrame, b: DataFrame, grouped: bool = False) -> DataFrame:
    """sample_id, dataset, [leakage_group], score_a, score_b, diff.

    A sample that only one side predicts, or one unknown to `samples`, fails the job.
    """
    both = a.select("sample_id", F.col("selected_score").alias("score_a")).join(
        b.select("sample_id", F.col("selected_score").alias("score_b")), "sample_id", "full_outer"
    )
    meta = [F.col("sample_id"), F.col("dataset")]
    if grouped:
        meta.append(text.leakage_group(F.col("dataset"), F.col("query")).alias("leakage_group"))
    rows = both.join(samples.select(*meta), "sample_id", "left")
    odd = F.col("score_a").isNull() | F.col("score_b").isNull() | F.col("dataset").isNull()
    fail = F.raise_error(F.concat(F.lit("unpaired or unknown sample "), F.col("sample_id")))
    return rows.withColumn("diff", F.when(odd, fail).otherwise(F.col("score_a") - F.col("score_b")))


def dataset_sizes(frame: DataFrame) -> DataFrame:
    """(dataset, n_dataset, n_datasets): a row per dataset."""
    sizes = frame.groupBy("dataset").agg(F.count("*").alias("n_dataset"))
    return sizes.join(F.broadcast(sizes.agg(F.count("*").alias("n_datasets"))))


def with_macro_weights(frame: DataFrame) -> DataFrame:
    """Add `weight` = 1 / (datasets x rows of the dataset)."""
    return join_checked(frame, dataset_sizes(frame), "dataset").withColumn(
        "weight", 1.0 / (F.col("n_datasets") * F.col("n_dataset"))
    ).drop("n_dataset", "n_datasets")


def difference(frame: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per key: macro and micro difference, wins, losses, ties and counts."""
    per = frame.groupBy(*keys, "dataset").agg(
        F.avg("diff").alias("mean"),
        F.sum("diff").alias("total"),
        F.count("*").alias("n"),
        F.count_if(F.col("diff") > 0).alias("w"),
        F.count_if(F.col("diff") < 0).alias("l"),
        F.count_if(F.col("diff") == 0).alias("t"),
    )
    return per.groupBy(*keys).agg(
        F.avg("mean").alias("macro_diff"),
        (F.sum("total") / F.sum("n")).alias("micro_diff"),
        F.sum("w").alias("query_wins"),
        F.sum("l").alias("query_losses"),
        F.sum("t").alias("query_ties"),
        F.sum("n").alias("n_queries"),
        F.count("*").alias("n_datasets"),
    )


def units(frame: DataFrame, grouped: bool = False) -> DataFrame:
    """Resampling units: (dataset, unit, total, size). A group of repeated inputs is one unit."""
    if grouped:
        return frame.groupBy("dataset", F.col("leakage_group").alias("unit")).agg(
            F.sum("diff").alias("total"), F.count("*").alias("size")
        )
    return frame.select(
        "dataset", F.col("sample_id").alias("unit"), F.col("diff").alias("total"), F.lit(1).cast("long").alias("size")
    )


def _by_hash(draw: str) -> bool:
    """Whether draws are hashes, which SQL can repeat, or counts per value, whose cost does not depend on the rows."""
    if draw not in ("hash", "counts"):
        raise ValueError(f"unknown way to draw: {draw}")
    return draw == "hash"


def bootstrap_replicates(u: DataFrame, n_bootstrap: int, seed: int = 3407, draw: str = "hash") -> DataFrame:
    """(replicate, macro): the mean of dataset means of each resample, drawn within datasets."""
    per_dataset = _hash_bootstrap(u, n_bootstrap, seed) if _by_hash(draw) else _count_bootstrap(u, n_bootstrap, seed)
    return per_dataset.groupBy("replicate").agg(F.avg(F.col("total") / F.col("size")).alias("macro"))


def _hash_bootstrap(u: DataFrame, n_bootstrap: int, seed: int) -> DataFrame:
    """Draws are made and added up where their units are: neither draws nor a dataset's units are joined, listed or broadcast."""
    placed = ranking.hash_positions(u.withColumn("_h", F.md5("unit")), ["dataset"], "_h")
    many = F.raise_error(F.lit("too many units of a dataset for hash draws; draw counts")).cast("long")
    n = F.when(F.col("n") <= draws.MIX_LIMIT, F.col("n")).otherwise(many)
    slot = F.col("pos") - 1
    table = placed.select(
        "dataset", n.alias("n"), (slot / F.lit(SLOTS)).cast("int").alias("chunk"), (slot % SLOTS).cast("int").alias("slot"),
        F.coalesce(F.col("total").cast("double"), F.lit(0.0)).alias("total"), F.col("size").cast("double").alias("size"),
    )

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        size, first = int(min(SLOTS, pdf["n"].iloc[0] - SLOTS * pdf["chunk"].iloc[0])), pdf[["dataset", "n", "chunk"]].iloc[:1]
        # A slot whose unit has no id stays empty; the one beyond the last takes draws of other chunks.
        both = np.zeros((2, size + 1))
        both[:, pdf["slot"]] = pdf["total"], pdf["size"]
        return first.assign(values=[both.tobytes()])

    name = u.schema["dataset"].dataType.simpleString()
    chunks = table.groupBy("dataset", "chunk").applyInPandas(packed, f"dataset {name}, n long, chunk int, values binary")
    ends = _block_ends(n_bootstrap)
    parts = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in zip(ends, ends[1:]) if a < b]
    few = chunks.withColumn("part", F.explode(F.array(*parts))).select("dataset", "n", "chunk", "values", "part.a", "part.b")
    keys = F.transform(F.sequence("a", F.col("b") - 1), lambda r: draws.hash_int(seed, r, F.col("dataset")))

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                low = int(row.chunk) * SLOTS
                both = np.frombuffer(row.values, "<f8").reshape(2, -1)
                total, size = draws.drawn_sums(np.asarray(row.keys, np.uint32), int(row.n), low, both)
                yield pd.DataFrame({"dataset": row.dataset, "replicate": np.arange(row.a, row.b, dtype=np.int32), "total": total, "size": np.rint(size).astype(np.int64)})

    spaced = spread(few, "dataset", "chunk", "a").select("dataset", "n", "chunk", "values", "a", "b", keys.alias("keys"))
    sums = spaced.mapInPandas(drawn, f"dataset {name}, replicate int, total double, size long")
    return sums.groupBy("dataset", "replicate").agg(F.sum("total").alias("total"), F.sum("size").alias("size")).where("size > 0")


def _chunked(values: DataFrame, columns: list[str]) -> tuple[DataFrame, int]:
    """Spread the distinct values over 2^levels chunks of bounded size."""
    levels = max(0, ceil(values.count() / VALUES_PER_CHUNK) - 1).bit_length()
    return values.withColumn("chunk", F.pmod(F.xxhash64(*columns), F.lit(1 << levels)).cast("int")), levels


def _block_ends(n: int) -> list[int]:
    return [n * k // BLOCKS for k in range(BLOCKS + 1)]


def _count_bootstrap(u: DataFrame, n_bootstrap: int, seed: int) -> DataFrame:
    values = u.groupBy("dataset", "total", "size").agg(F.count("*").alias("times"))
    chunks, levels = _chunked(values, ["dataset", "total", "size"])
    per_chunk = chunks.groupBy("dataset", "chunk").agg(F.sum("times").alias("m"))
    # The units below each ancestor of a chunk, from the root (all units of the dataset) down to the chunk itself.
    path = per_chunk.select("dataset", "chunk")
    for level in range(levels + 1):
        node = F.shiftright("chunk", levels - level)
        below = per_chunk.groupBy("dataset", node.alias("_node")).agg(F.sum("m").alias(f"_m{level}"))
        path = path.withColumn("_node", F.shiftright("chunk", levels - level)).join(below, ["dataset", "_node"]).drop("_node")
    path = path.select("dataset", "chunk", F.array(*[f"_m{k}" for k in range(levels + 1)]).alias("masses"))
    ends = _block_ends(n_bootstrap)

    def replicate(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        dataset, chunk, part = key[0], int(key[1]), int(key[2])
        masses = [int(m) for m in pdf["masses"].iloc[0]]
        name = zlib.crc32(str(dataset).encode())
        n = ends[part + 1] - ends[part]
        share = np.full(n, masses[0], np.int64)
        for level in range(1, levels + 1):
            node = chunk >> (levels - level)
            # Both children draw the same split of their parent's share: how much goes to the left one.
            own, parent = masses[level], masses[level - 1]
            left = own if not node & 1 else parent - own
            rng = np.random.default_rng([seed, name, part, level, node >> 1])
            drawn = rng.binomial(share, left / parent)
            share = share - drawn if node & 1 else drawn
        pdf = pdf.sort_values(["total", "size"])
        p = pdf["times"].to_numpy(float)
        tot, siz = pdf["total"].to_numpy(float), pdf["size"].to_numpy(float)
        own_draws = np.random.default_rng([seed, name, part, levels + 1, chunk])
        out_t, out_s = np.empty(n), np.empty(n)
        step = max(1, 2_000_000 // len(p))
        for at in range(0, n, step):
            c = own_draws.multinomial(share[at : at + step], p / p.sum())
            out_t[at : at + step], out_s[at : at + step] = c @ tot, c @ siz
        return pd.DataFrame({"dataset": dataset, "replicate": np.arange(ends[part], ends[part + 1]), "total": out_t, "size": out_s})

    blocks = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))
    rows = chunks.join(path, ["dataset", "chunk"]).withColumn("part", blocks)
    parts = rows.groupBy("dataset", "chunk", "part").applyInPandas(replicate, "dataset string, replicate int, total double, size double")
    return parts.groupBy("dataset", "replicate").agg(F.sum("total").alias("total"), F.sum("size").alias("size"))


def bootstrap_quantiles(replicates: DataFrame, shares: list[float]) -> DataFrame:
    """One row with q0, q1, ... of the replicate values; there are only as many as replicates."""
    q = F.percentile("macro", F.array(*[F.lit(s) for s in shares]))
    return replicates.agg(q.alias("_q")).select(*[F.col("_q")[i].alias(f"q{i}") for i in range(len(shares))])


def contributions(frame: DataFrame, grouped: bool = False) -> DataFrame:
    """(unit, contribution): macro-weighted differences, summed over repeated inputs when grouped."""
    weighted = with_macro_weights(frame).withColumn("_c", F.col("diff") * F.col("weight"))
    if grouped:
        return weighted.groupBy("dataset", F.col("leakage_group").alias("unit")).agg(F.sum("_c").alias("contribution")).drop("dataset")
    return weighted.select(F.col("sample_id").alias("unit"), F.col("_c").alias("contribution"))


def permutation_stats(c: DataFrame, n_permutations: int, seed: int = 3407, draw: str = "hash") -> DataFrame:
    """(permutation, stat): the sum of contributions under random signs."""
    # One hash yields the signs of 32 permutations, hence the division.
    if _by_hash(draw):
        return _hash_signs(c, n_permutations, seed)
    return _count_signs(c, n_permutations, seed)


def _hash_signs(c: DataFrame, n_permutations: int, seed: int) -> DataFrame:
    blocks = ceil(n_permutations / SIGN_BITS)
    heads = [f"{seed}:{b}".encode() for b in range(blocks)]
    # +1 or -1 for each bit of a byte.
    signs = 2.0 * (np.arange(256)[:, None] >> np.arange(8) & 1) - 1.0

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's sums of all blocks: contributions are added up by the bytes of their words first, from the lowest on."""
        held, seen = np.zeros((blocks, SIGN_BITS // 8, 256)), False
        for batch in batches:
            values = batch.column("contribution").to_numpy(zero_copy_only=False)
            texts = [None if t is None else t.encode() for t in batch.column("unit").to_pylist()]
            for own, words in zip(held, draws.hash_ints(heads, texts), strict=True):
                for k, cells in enumerate(own):
                    cells += np.bincount(words >> np.uint32(8 * k) & np.uint32(255), values, 256)
            seen = seen or len(texts) > 0
        if seen:
            stats = (held @ signs).reshape(blocks, SIGN_BITS)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(blocks, dtype=np.int32)), *[pa.array(v) for v in np.ascontiguousarray(stats.T)]], ["block", *bits])

    bits = [f"s{i}" for i in range(SIGN_BITS)]
    value = F.coalesce(F.col("contribution").cast("double"), F.lit(0.0)).alias("contribution")
    rows = spread(c.select(F.col("unit").cast("string").alias("unit"), value), "unit")
    sums = rows.mapInArrow(signed, "block int, " + ", ".join(f"{b} double" for b in bits)).groupBy("block").agg(*[F.sum(b).alias(b) for b in bits])
    flat = sums.select("block", F.posexplode(F.array(*[F.col(b) for b in bits])).alias("bit", "stat"))
    return flat.select((F.col("block") * SIGN_BITS + F.col("bit")).cast("int").alias("permutation"), "stat").where(
        F.col("permutation") < n_permutations
    )


def _count_signs(c: DataFrame, n_permutations: int, seed: int) -> DataFrame:
    values = c.groupBy(F.abs("contribution").alias("v")).agg(F.count("*").alias("times"))

    chunks, _ = _chunked(values, ["v"])
    ends = _block_ends(n_permutations)

    def flip(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(key[1])
        rng = np.random.default_rng([seed, int(key[0]), part])
        pdf = pdf.sort_values("v")
        v, m = pdf["v"].to_numpy(float), pdf["times"].to_numpy(np.int64)
        n = ends[part + 1] - ends[part]
        out = np.empty(n)
        step = max(1, 2_000_000 // len(v))
        for at in range(0, n, step):
            k = min(step, n - at)
            out[at : at + k] = (2.0 * rng.binomial(m, 0.5, size=(k, len(v))) - m) @ v
        return pd.DataFrame({"permutation": np.arange(ends[part], ends[part + 1]), "stat": out})

    blocks = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))
    parts = chunks.withColumn("part", blocks).groupBy("chunk", "part").applyInPandas(flip, "permutation int, stat double")
    return parts.groupBy("permutation").agg(F.sum("stat").alias("stat"))


def permutation_p(stats: DataFrame, observed: DataFrame) -> DataFrame:
    """(n_extreme, n_permutations, p_value): at least as extreme as `observed.macro_diff`, two-sided."""
    rows = stats.join(F.broadcast(observed.select("macro_diff")))
    hit = F.abs("stat") >= F.abs("macro_diff") - TOLERANCE
    counted = rows.agg(F.count_if(hit).alias("n_extreme"), F.count("*").alias("n_permutations"))
    return counted.withColumn("p_value", (F.col("n_extreme") + 1.0) / (F.col("n_permutations") + 1.0))


def prediction_test(
    samples: DataFrame,
    a: DataFrame,
    b: DataFrame,
    n_bootstrap: int = 5000,
    n_permutations: int = 10000,
    seed: int = 3407,
    grouped: bool = False,
    draw: str = "hash",
) -> DataFrame:
    """One row: differences, 95 % bootstrap interval, permutation p-value and counts."""
    frame = paired_frame(samples, a, b, grouped).persist()
    diff = difference(frame)
    u = units(frame, grouped)
    ci = bootstrap_quantiles(bootstrap_replicates(u, n_bootstrap, seed, draw), [0.025, 0.975])
    p = permutation_p(permutation_stats(contributions(frame, grouped), n_permutations, seed, draw), diff)
    # Each side of these joins is one row.
    one = diff.join(F.broadcast(ci)).join(F.broadcast(p)).join(F.broadcast(u.agg(F.count("*").alias("n_inference_clusters"))))
    return one.select(
        "macro_diff",
        (F.col("macro_diff") * 100.0).alias("macro_diff_pp"),
        "micro_diff",
        (F.col("micro_diff") * 100.0).alias("micro_diff_pp"),
        F.col("q0").alias("bootstrap_ci_low"),
        F.col("q1").alias("bootstrap_ci_high"),
        (F.col("q0") * 100.0).alias("bootstrap_ci_low_pp"),
        (F.col("q1") * 100.0).alias("bootstrap_ci_high_pp"),
        F.col("p_value").alias("permutation_p_two_sided"),
        F.lit(n_bootstrap).cast("long").alias("n_bootstrap"),
        F.lit(n_permutations).cast("long").alias("n_permutations"),
        "n_queries",
        "n_datasets",
        "n_inference_clusters",
        F.lit(grouped).alias("cluster_duplicate_inputs"),
        "query_wins",
        "query_losses",
        "query_ties",
    )


def slot_test(
    rows: DataFrame, a: int, b: int, margin_pp: float = 0.5, n_bootstrap: int = 10_000, n_permutations: int = 20_000, seed: int = 3407,
    confidence: float = 0.95, grouped: bool = True, draw: str = "hash",
) -> DataFrame:
    """One row for the runs at places `a` and `b` (from 0) of rows that hold the picks of all runs: two-sided test and one-sided bound.

    Both sides stand in the row, so nothing is joined, and the interval, the bound and its decision come from the same replicates.
    """
    if margin_pp <= 0:
        raise ValueError("margin_pp must be > 0")
    if not 0.5 < confidence < 1.0:
        raise ValueError("confidence must be between 0.5 and 1")
    one, two = (F.element_at("score", F.col("slots")[k]) for k in (a, b))
    fail = F.raise_error(F.concat(F.lit("unpaired sample "), F.col("sample_id")))
    meta = [text.leakage_group(F.col("dataset"), F.col("query")).alias("leakage_group")] if grouped else []
    both = rows.where(F.col("slots")[a].isNotNull() | F.col("slots")[b].isNotNull())
    frame = both.select("sample_id", "dataset", *meta, F.when(one.isNull() | two.isNull(), fail).otherwise(one - two).alias("diff")).persist()
    u = units(frame, grouped)
    q = bootstrap_quantiles(bootstrap_replicates(u, n_bootstrap, seed, draw), [1.0 - confidence, 0.025, 0.975])
    diff = difference(frame)
    p = permutation_p(permutation_stats(contributions(frame, grouped), n_permutations, seed, draw), diff)
    # Each side of these joins is one row.
    whole = diff.join(F.broadcast(q)).join(F.broadcast(p)).join(F.broadcast(u.agg(F.count("*").alias("n_inference_clusters"))))
    return whole.select(
        (F.col("macro_diff") * 100.0).alias("macro_diff_pp"),
        (F.col("q1") * 100.0).alias("bootstrap_ci_low_pp"),
        (F.col("q2") * 100.0).alias("bootstrap_ci_high_pp"),
        F.col("p_value").alias("permutation_p_two_sided"),
        F.lit(float(margin_pp)).alias("margin_pp"),
        (F.col("q0") * 100.0).alias("lower_one_sided_pp"),
        (F.col("q0") * 100.0 > -margin_pp).alias("noninferior_A_to_B"),
        "n_queries", "n_datasets", "n_inference_clusters", "query_wins", "query_losses", "query_ties",
    )


def equivalence(test: DataFrame, margin_pp: float = 0.5) -> DataFrame:
    """Decisions from the interval of `prediction_test`: inside both margins, above the lower one."""
    low, high = F.col("bootstrap_ci_low_pp"), F.col("bootstrap_ci_high_pp")
    return test.select(
        "macro_diff_pp",
        "bootstrap_ci_low_pp",
        "bootstrap_ci_high_pp",
        F.lit(float(margin_pp)).alias("margin_pp"),
        (low > -margin_pp).alias("noninferior_A_to_B"),
        ((low > -margin_pp) & (high < margin_pp)).alias("equivalent_within_margin"),
        "n_queries",
        "n_datasets",
    )


def noninferiority(
    samples: DataFrame,
    a: DataFrame,
    b: DataFrame,
    margin_pp: float = 0.5,
    n_bootstrap: int = 10000,
    seed: int = 3407,
    confidence: float = 0.95,
    grouped: bool = False,
    draw: str = "hash",
) -> DataFrame:
    """One row: A is not inferior when the one-sided lower bound of A - B exceeds the margin."""
    if margin_pp <= 0:
        raise ValueError("margin_pp must be > 0")
    if not 0.5 < confidence < 1.0:
        raise ValueError("confidence must be between 0.5 and 1")
    frame = paired_frame(samples, a, b, grouped).persist()
    u = units(frame, grouped)
    q = bootstrap_quantiles(bootstrap_replicates(u, n_bootstrap, seed, draw), [1.0 - confidence, 0.025, 0.975])
    one = difference(frame).join(F.broadcast(q)).join(F.broadcast(u.agg(F.count("*").alias("n_inference_clusters"))))
    return one.select(
        (F.col("macro_diff") * 100.0).alias("macro_diff_pp"),
        F.lit(float(margin_pp)).alias("margin_pp"),
        F.lit(float(confidence)).alias("confidence"),
        (F.col("q0") * 100.0).alias("lower_one_sided_pp"),
        (F.col("q1") * 100.0).alias("bootstrap_ci_low_pp"),
        (F.col("q2") * 100.0).alias("bootstrap_ci_high_pp"),
        (F.col("q0") * 100.0 > -margin_pp).alias("noninferior_A_to_B"),
        "n_queries",
        "n_datasets",
        "n_inference_clusters",
    )


def seed_suite(tests: DataFrame) -> DataFrame:
    """Over one test row per seed: mean and deviation of the differences and the sign counts.

    P-values stay per seed: splits overlap, so they are not pooled.
    """
    return tests.agg(
        F.count("*").alias("n_seeds"),
        F.avg("macro_diff_pp").alias("macro_diff_pp_mean"),
        sample_std("macro_diff_pp").alias("macro_diff_pp_std"),
        F.avg("micro_diff_pp").alias("micro_diff_pp_mean"),
        sample_std("micro_diff_pp").alias("micro_diff_pp_std"),
        F.count_if(F.col("macro_diff") > 0).alias("positive_seeds"),
        F.count_if(F.col("macro_diff") < 0).alias("negative_seeds"),
    )
