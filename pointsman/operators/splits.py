"""Leakage-safe splits, folds and holdouts.

Rows (or whole groups of identical router input) are ordered by a hash of the seed and
their id. A split needs only the hash at each stratum's cut rank, so rows are labelled in
place and a dataset or a group of copies may be of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointsman.functions import draws, numeric, text
from pointsman.operators.ranking import cutoffs_without, stratum_cutoffs
from pointsman.session import join_checked

INNER_SEED_STEP = 104729


def _ordered(samples: DataFrame, seed: int, grouped: bool) -> DataFrame:
    """Add `_h`, the shuffling hash of the row or of its leakage group."""
    unit = text.leakage_group(F.col("dataset"), F.col("query")) if grouped else F.col("sample_id")
    return samples.withColumn("_h", draws.hash_text(seed, unit))


def _cutoffs(marked: DataFrame, grouped: bool, ranks) -> DataFrame:
    units = marked.select("dataset", "_h")
    if grouped:
        units = units.distinct()
    return stratum_cutoffs(units, ["dataset"], "_h", ranks)


def id_split(samples: DataFrame, train_ratio: float = 0.7, seed: int = 3407, grouped: bool = False) -> DataFrame:
    """Add `partition`: per dataset, the first share of rows (or groups) is train, the rest test."""
    if not 0 < train_ratio < 1:
        raise ValueError("train_ratio must be in (0, 1)")
    marked = _ordered(samples, seed, grouped)
    cuts = _cutoffs(marked, grouped, lambda n: F.array(numeric.clamped_share(n, train_ratio)))
    return (
        join_checked(marked, cuts.select("dataset", F.col("cuts")[0].alias("_cut")), "dataset")
        .withColumn("partition", F.when(F.col("_h") <= F.col("_cut"), "train").otherwise("test"))
        .drop("_h", "_cut")
    )


def _keyed_cutoffs(samples: DataFrame, seeds: list[int], takes_part: list[Column], grouped: bool, ranks) -> DataFrame:
    """Add `_hs` (a shuffling hash per seed, null where the row takes no part) and `_cuts` (cut values per seed).

    All seeds are keys of one cutoff pass, so the input is read for it once however many there are.
    """
    unit = text.leakage_group(F.col("dataset"), F.col("query")) if grouped else F.col("sample_id")
    marked = samples.withColumn("_hs", F.array(*[F.when(t, draws.hash_text(s, unit)) for s, t in zip(seeds, takes_part, strict=True)]))
    units = marked.select("dataset", F.posexplode("_hs").alias("_k", "_h")).where("_h is not null")
    if grouped:
        units = units.distinct()
    cuts = stratum_cutoffs(units, ["_k", "dataset"], "_h", ranks)
    per_dataset = cuts.groupBy("dataset").agg(F.map_from_entries(F.collect_list(F.struct("_k", "cuts"))).alias("_cuts"))
    return join_checked(marked, per_dataset, "dataset")


def id_splits(samples: DataFrame, seeds: list[int], train_ratio: float = 0.7, grouped: bool = False) -> tuple[DataFrame, dict[int, str]]:
    """Add the labels of `id_split` under every seed, and return which column holds which."""
    if not 0 < train_ratio < 1:
        raise ValueError("train_ratio must be in (0, 1)")
    cut = _keyed_cutoffs(samples, seeds, [F.lit(True)] * len(seeds), grouped, lambda n: F.array(numeric.clamped_share(n, train_ratio)))
    names = {s: f"partition_{s}" for s in seeds}
    train = [F.col("_hs")[i] <= F.element_at("_cuts", F.lit(i))[0] for i in range(len(seeds))]
    labels = {names[s]: F.when(t, "train").otherwise("test") for s, t in zip(seeds, train, strict=True)}
    return cut.withColumns(labels).drop("_hs", "_cuts"), names


def nested_folds(
    samples: DataFrame, outer: str, outer_folds: int, inner_folds: int, seeds: list[int], grouped: bool = False, out: str = "inner"
) -> DataFrame:
    """Add `inner`, an array with the fold of the row inside the training set of each outer fold, -1 where it is held out.

    Folds are those of `stratified_folds` over the rows outside that outer fold, with its own seed.
    """
    if inner_folds < 2:
        raise ValueError("inner_folds must be >= 2")
    trains = [F.col(outer) != o for o in range(outer_folds)]
    cut = _keyed_cutoffs(samples, seeds, trains, grouped, lambda n: _fold_ends(n, inner_folds))

    def fold(o: int) -> Column:
        passed = F.filter(F.element_at("_cuts", F.lit(o)), lambda c: F.col("_hs")[o] > c)
        return F.when(trains[o], F.size(passed)).otherwise(-1).cast("int")

    return cut.withColumn(out, F.array(*[fold(o) for o in range(outer_folds)])).drop("_hs", "_cuts")


def holdout_split(samples: DataFrame, column: str, holdout: str) -> DataFrame:
    """Rows of one dataset or domain (any case) are test, all others train."""
    test = F.lower(F.col(column)) == F.lit(holdout.lower())
    if samples.where(test).limit(1).count() == 0:
        raise ValueError(f"unknown holdout {column}: {holdout}")
    return samples.withColumn("partition", F.when(test, "test").otherwise("train"))


def _fold_ends(n: Column, k: int) -> Column:
    """Last position of each fold but the last; sizes differ by at most one, larger ones first."""
    base, extra = F.floor(n / k), n % k
    return F.array(*[base * i + F.least(extra, F.lit(i)) for i in range(1, k)])


def stratified_folds(
    samples: DataFrame, n_folds: int = 5, seed: int = 3407, grouped: bool = False, out: str = "fold"
) -> DataFrame:
    """Add `fold`: per dataset, equal runs of the shuffled rows or groups."""
    if n_folds < 2:
        raise ValueError("n_folds must be >= 2")
    marked = _ordered(samples, seed, grouped)
    cuts = _cutoffs(marked, grouped, lambda n: _fold_ends(n, n_folds))
    passed = F.filter(F.col("_cuts"), lambda c: F.col("_h") > c)
    return (
        join_checked(marked, cuts.select("dataset", F.col("cuts").alias("_cuts")), "dataset")
        .withColumn(out, F.size(passed).cast("int"))
        .drop("_h", "_cuts")
    )


def nested_split(
    samples: DataFrame, train_ratio: float = 0.7, validation_ratio: float = 0.2, seed: int = 3407, grouped: bool = True
) -> DataFrame:
    """Add `partition`: test, and inside the outer train rows inner_fit or validation."""
    outer = id_split(samples, train_ratio, seed, grouped).persist()
    test = outer.where("partition = 'test'")
    train = outer.where("partition = 'train'").drop("partition")
    inner = id_split(train, 1.0 - validation_ratio, seed + INNER_SEED_STEP, grouped)
    renamed = F.when(F.col("partition") == "train", "inner_fit").otherwise("validation")
    return inner.withColumn("partition", renamed).unionByName(test)


def calibration_split(
    samples: DataFrame, domain: str, calibration_ratio: float = 0.2, seed: int = 3407, grouped: bool = False
) -> DataFrame:
    """Add `partition`: the held-out domain is test, the rest fit or calibration."""
    held = holdout_split(samples, "domain", domain)
    test = held.where("partition = 'test'")
    pool = held.where("partition = 'train'").drop("partition")
    inner = id_split(pool, 1.0 - calibration_ratio, seed, grouped)
    renamed = F.when(F.col("partition") == "train", "fit").otherwise("calibration")
    return inner.withColumn("partition", renamed).unionByName(test)


def holdout_labels(
    samples: DataFrame, holdouts: list[str], ratio: float, seed: int = 3407, column: str = "domain", grouped: bool = False
) -> DataFrame:
    """Add `labels`, an array with one of test, fit or calibration per held-out value of `column`.

    The cutoff of a holdout is that of the dataset without the rows of the holdout, from counts by subtraction
    (`ranking.cutoffs_without`); a dataset that a holdout does not occur in keeps its own. Every row looks up its
    cutoffs in place.
    """
    marked = _ordered(samples, seed, grouped)
    names = F.array(*[F.lit(h) for h in holdouts])
    held = F.lower(F.col(column))
    units = marked.select("dataset", "_h", held.alias("_d"))
    if grouped:
        # A group is left out with a holdout only if all its rows are.
        one = F.when((F.min("_d") == F.max("_d")) & (F.count("_d") == F.count("*")), F.min("_d"))
        units = units.groupBy("dataset", "_h").agg(one.alias("_d"))
    cuts = cutoffs_without(units, ["dataset"], "_d", "_h", lambda n: F.array(numeric.clamped_share(n, 1.0 - ratio)))
    # One row per dataset; the entry * is the dataset as a whole. Cutoffs are listed in the order of the holdouts, so no row searches them.
    per_dataset = cuts.groupBy("dataset").agg(F.map_from_entries(F.collect_list(F.struct(F.coalesce(F.concat(F.lit("="), "_d"), F.lit("*")), F.col("cuts")[0]))).alias("_all"))
    own = lambda h: F.coalesce(F.element_at("_all", F.concat(F.lit("="), F.lower(h))), F.element_at("_all", F.lit("*")))
    per_dataset = per_dataset.select("dataset", F.transform(names, own).alias("_cuts"))
    label = lambda h, k: (
        F.when(F.lower(h) == held, "test")
        .when(F.col("_h") <= F.col("_cuts")[k], "fit")
        .otherwise("calibration")
    )
    joined = join_checked(marked, per_dataset, "dataset", "left")
    return joined.withColumn("labels", F.transform(names, label)).drop("_h", "_cuts")
