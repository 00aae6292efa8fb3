"""Experiments: fit, predict, pick and score under splits, folds and holdouts.

A training frame has one row per sample: sample_id, dataset, domain, query, x and the
score array (for cost experiments also the cost array). Linear learners read it once per
experiment, whatever the number of folds, seeds, systems or probe subsets.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointsman.functions import numeric
from pointsman.operators import boosting, cost, features, linear, matrix, metrics, network, paired, routing, selective, sparse, splits, tfidf, trees
from pointsman.operators.features import FeatureSet
from pointsman.operators.metrics import Runs
from pointsman.session import summary, written

# Seeds of the published protocols.
SEEDS = (42, 999, 2024, 2025, 3407)
COST_SEEDS = (42, 3407, 0, 1, 2)
INPUT_PRICE_PER_MILLION = 0.042
FOLD_SEED_STEP = 1009
INNER_FOLD_SEED_STEP = 100_003

LINEAR = {"ridge": 1.0, "ols": 0.0, "embedding_ridge": 5.0}


def training_frame(
    samples: DataFrame, outcomes: DataFrame, fs: FeatureSet, models: list[str], values: tuple[str, ...] = ("score",), dense: bool = True
) -> DataFrame:
    """Samples with outcome arrays and features; a missing outcome (when dense) or feature row fails the job."""
    rows = matrix.sample_frame(samples, outcomes, models, values)
    if dense:
        rows = matrix.require_dense(rows, models)
    return features.join_features(rows, fs)


def fit_predict(train: DataFrame, test: DataFrame, models: list[str], learner: str, **params) -> DataFrame:
    """The test rows with `pred`, from one of ridge, ols, embedding_ridge, gbt, random_forest, mlp and tfidf."""
    if learner in LINEAR:
        mo = linear.moments(train, "x", "score")
        coefs = linear.fit(mo, params.get("alpha", LINEAR[learner]), standardize=learner != "embedding_ridge")
        return linear.score(test, "x", coefs)
    if learner == "tfidf":
        return _fit_predict_text(train, test, models, **params)
    if learner == "gbt":
        return boosting.predict(test, boosting.fit(train, **params))
    if learner == "mlp":
        return network.predict(test, network.fit(train, **params))
    return trees.predict(test, trees.fit_per_candidate(train, models, learner, **params))


def _fit_predict_text(train: DataFrame, test: DataFrame, models: list[str], alpha: float = 5.0, max_iter: int = 100, **_) -> DataFrame:
    """TF-IDF learned on the training texts, ridge on top; test texts use the training vocabulary."""
    lists = tfidf.term_lists(train).persist()
    vocab = tfidf.vocabulary(tfidf.exploded(lists)).collect()
    table, width = sparse.slots(train.sparkSession.createDataFrame(vocab, "term string, df bigint"))
    n_docs = train.count()
    rows = sparse.sparse_rows(tfidf.weights(lists, vocab, n_docs), table, train.select("sample_id", "score"))
    fitted = sparse.fit(rows, width, alpha, max_iter)
    lists.unpersist()
    return sparse.predict(sparse.sparse_rows(tfidf.weights(tfidf.term_lists(test), vocab, n_docs), table, test), fitted)


def evaluate(predicted: DataFrame, train: DataFrame, models: list[str]) -> DataFrame:
    """One row of micro metrics, with the best single candidate of the training rows."""
    best = metrics.best_single_train(train, models).first().best_single_model
    picks = predicted.withColumn("selected_score", F.element_at("score", routing.first_best(F.col("pred"))))
    return metrics.routing_metrics(picks, models, F.lit(best)).withColumn("best_single_model", F.lit(best))


def train_evaluate(frame: DataFrame, models: list[str], learner: str = "ridge", **params) -> tuple[DataFrame, DataFrame]:
    """(picks, metrics) of the test rows of a frame with `partition`."""
    train, test = frame.where("partition = 'train'"), frame.where("partition = 'test'")
    predicted = fit_predict(train, test, models, learner, **params)
    return routing.selected(predicted, models), evaluate(predicted, train, models)


def held_out(frame: DataFrame, models: list[str], cell: Column, n_cells: int, learner: str = "ridge", **params) -> DataFrame:
    """Every row predicted by a model trained on the rows of all other cells; adds `pred`."""
    if learner in LINEAR:
        rows = frame.withColumn("_cell", cell.cast("int")).withColumn("_cells", F.array("_cell"))
        mo = linear.moments(rows, "x", "score", "_cells")
        kw = {"alpha": params.get("alpha", LINEAR[learner]), "standardize": learner != "embedding_ridge"}
        coefs = linear.fit_without(mo, list(range(n_cells)), **kw)
        return linear.score(rows, "x", coefs, F.col("_cell")).drop("_cell", "_cells")
    if learner == "gbt":
        # One fit for all cells: each is a training set of the same jobs.
        model = boosting.fit(frame, sets=[cell != k for k in range(n_cells)], **params)
        return boosting.predict(frame, model, which=cell)
    out = None
    for k in range(n_cells):
        part = fit_predict(
            frame.where(cell != k), frame.where(cell == k), models, learner,
            **{**params, "seed": params.get("seed", 3407) + k * FOLD_SEED_STEP},
        )
        out = part if out is None else out.unionByName(part)
    return out


def oof(frame: DataFrame, models: list[str], learner: str = "ridge", n_folds: int = 5, seed: int = 3407, grouped: bool = True, **params) -> DataFrame:
    """Out-of-fold picks, one per sample, with their fold."""
    folded = splits.stratified_folds(frame, n_folds, seed, grouped)
    return routing.selected(held_out(folded, models, F.col("fold"), n_folds, learner, **params), models)


def ood(frame: DataFrame, models: list[str], column: str, learner: str = "ridge", **params) -> DataFrame:
    """Leave-one-out picks over the values of `column` (dataset or domain), one per sample."""
    values = matrix.few_values(frame, column)
    cell = F.array_position(F.array(*[F.lit(v) for v in values]), F.col(column)) - 1
    return routing.selected(held_out(frame, models, cell, len(values), learner, **params), models)


def linear_slots(
    frame: DataFrame, models: list[str], systems: dict[str, list[int]], partitions: dict[int, str], alpha: float = 1.0
) -> tuple[DataFrame, Runs]:
    """The frame with `slots`, the test pick of every system (a subset of x) under every seed, and the runs' names; one scan.

    `partitions` maps a seed to the column with its split label. A row outside a seed's test part has no picks of it.
    """
    seeds = list(partitions)
    cells = F.array_compact(F.array(*[F.when(F.col(partitions[s]) == "train", F.lit(i)) for i, s in enumerate(seeds)]))
    rows = frame.withColumn("_cells", cells)
    mo = linear.moments(rows, "x", "score", "_cells")
    pairs = [(i, s, name) for i, s in enumerate(seeds) for name in systems]
    coefs = np.array([[linear.fit(mo, alpha, include=[i], keep=systems[name])] for i, _, name in pairs])
    which = [F.when(F.col(partitions[s]) == "test", 0).otherwise(-1) for _, s, _ in pairs]
    return linear.picks(rows, "x", coefs, which).drop("_cells"), Runs([(s, name) for _, s, name in pairs], ("seed", "system"))


def linear_suite(
    frame: DataFrame, models: list[str], systems: dict[str, list[int]], partitions: dict[int, str], alpha: float = 1.0
) -> DataFrame:
    """The picks of `linear_slots` as rows: (seed, system, sample_id, dataset, selected_model, selected_score)."""
    return metrics.slot_picks(*_slot_args(linear_slots(frame, models, systems, partitions, alpha), models))


def _slot_args(found: tuple[DataFrame, Runs], models: list[str]) -> tuple[DataFrame, list[str], Runs]:
    return found[0], models, found[1]


def with_partitions(frame: DataFrame, seeds, train_ratio: float = 0.7, grouped: bool = True) -> tuple[DataFrame, dict[int, str]]:
    """Add one split column per seed."""
    return splits.id_splits(frame, list(seeds), train_ratio, grouped)


def representation_systems(fs: FeatureSet, backend: str, modes=features.MODES) -> tuple[FeatureSet, dict[str, list[int]]]:
    """All representations side by side in one array, and the slots of each."""
    full = features.representation(fs, "full", backend)
    hard = features.representation(fs, "hard", backend)
    both = FeatureSet(
        full.df.withColumnRenamed("x", "_f").join(hard.df.withColumnRenamed("x", "_h"), "sample_id").select(
            "sample_id", F.concat("_f", "_h").alias("x")
        ),
        [*full.names, *hard.names],
    )
    return both, representation_slots(full.names, hard.names, backend, modes)


def representation_slots(full: list[str], hard: list[str], backend: str, modes=features.MODES) -> dict[str, list[int]]:
    """The slots of each representation among the full features, followed by the hard decisions."""
    at = {n: i for i, n in enumerate(full)}
    slots = {}
    for mode in modes:
        if mode == "hard":
            slots[mode] = list(range(len(full), len(full) + len(hard)))
        else:
            slots[mode] = [at[c] for c in features.representation_names(full, mode, backend)]
    return slots


def probe_systems(names: list[str], backend: str) -> dict[str, list[int]]:
    """all_probes, and one system without each probe."""
    out = {"all_probes": list(range(len(names)))}
    for p in features.probe_names(names, backend):
        out[f"drop_{p}"] = [i for i, n in enumerate(names) if features.probe_name(n, backend) != p]
    return out


def drop_effects(summary: DataFrame, baseline: str = "all_probes") -> DataFrame:
    """Add `drop_vs_all_pp`: what accuracy loses without the probe."""
    base = summary.where(F.col("system") == baseline).select(F.col("AvgAcc_mean").alias("_base"))
    return summary.join(F.broadcast(base)).withColumn("drop_vs_all_pp", F.col("_base") - F.col("AvgAcc_mean")).drop("_base")


def learner_slots(frame: DataFrame, models: list[str], partitions: dict[int, str], learners: dict[str, dict]) -> tuple[DataFrame, Runs]:
    """The frame with the test picks of several learners under several seeds, one slot each."""
    out, slots, names = frame, [], []
    sets = [F.col(c) == "train" for c in partitions.values()]
    for name, params in learners.items():
        # All seeds are training sets of one fit.
        if name == "gbt":
            model = boosting.fit(frame, sets=sets, **params)
        elif name == "mlp":
            nets = network.fit_sets(frame, sets, **params)
        for k, (s, col) in enumerate(partitions.items()):
            slots.append(f"_slot{len(slots)}")
            names.append((s, name))
            if name == "gbt":
                out = boosting.predict(out, model, which=F.lit(k))
            elif name == "mlp":
                out = network.predict(out, nets[k])
            else:
                out = fit_predict(frame.where(F.col(col) == "train"), out, models, name, **params)
            picked = F.when(F.col(col) == "test", routing.first_best(F.col("pred")))
            out = out.withColumn(slots[-1], picked).drop("pred")
    return out.withColumn("slots", F.array(*slots)).drop(*slots), Runs(names, ("seed", "system"))


def learner_suite(frame: DataFrame, models: list[str], partitions: dict[int, str], learners: dict[str, dict]) -> DataFrame:
    """The picks of `learner_slots` as rows."""
    return metrics.slot_picks(*_slot_args(learner_slots(frame, models, partitions, learners), models))


def nested_probe_selection(
    frame: DataFrame,
    names: list[str],
    models: list[str],
    backend: str,
    keep: int = 12,
    outer_folds: int = 5,
    inner_folds: int = 3,
    seed: int = 3407,
    grouped: bool = True,
    alpha: float = 1.0,
) -> tuple[DataFrame, DataFrame, Runs]:
    """(selection, rows with `slots`, runs): probes ranked inside each outer training set, then full and lite picks.

    A probe's contribution is what inner out-of-fold accuracy loses without it. All models
    (outer x inner x dropped probe) are solved from one set of sums per (outer, inner) cell.
    """
    probes = features.probe_names(names, backend)
    if not 1 <= keep < len(probes):
        raise ValueError(f"keep must be between 1 and {len(probes) - 1}")
    rows = splits.stratified_folds(frame, outer_folds, seed, grouped, "_outer")
    seeds = [seed + (o + 1) * INNER_FOLD_SEED_STEP for o in range(outer_folds)]
    rows = written(splits.nested_folds(rows, "_outer", outer_folds, inner_folds, seeds, grouped, "_inner"), "nested-folds")
    cell = F.transform("_inner", lambda g, o: F.when(g >= 0, g + o * inner_folds))
    rows = rows.withColumn("_cells", F.array_compact(cell))
    mo = linear.moments(rows, "x", "score", "_cells")
    systems = probe_systems(names, backend)
    pairs = [(o, s) for o in range(outer_folds) for s in systems]

    def block(o: int, without: int | None = None) -> list[int]:
        return [o * inner_folds + g for g in range(inner_folds) if g != without]

    coefs = np.array(
        [[linear.fit(mo, alpha, include=block(o, g), keep=systems[s]) for g in range(inner_folds)] for o, s in pairs]
    )
    chosen = linear.picks(rows, "x", coefs, [F.col("_inner")[o] for o, _ in pairs])
    inner_acc = metrics.slot_accuracy(chosen, Runs(pairs, ("outer_fold", "system"))).withColumn("AvgAcc", F.col("AvgAcc") * 100.0).persist()
    base = inner_acc.where("system = 'all_probes'").select("outer_fold", F.col("AvgAcc").alias("inner_all_avgacc"))
    position = F.array_position(F.array(*[F.lit(p) for p in probes]), F.col("probe"))
    table = (
        inner_acc.where("system <> 'all_probes'")
        .select("outer_fold", F.regexp_replace("system", "^drop_", "").alias("probe"), F.col("AvgAcc").alias("inner_drop_avgacc"))
        .join(base, "outer_fold")
        .withColumn("contribution_pp", F.round(F.col("inner_all_avgacc") - F.col("inner_drop_avgacc"), 12))
        .withColumn("position", position)
    )
    selection = routing.probe_ranks(table, keep).persist()
    kept: dict[int, set[str]] = {}
    # At most outer folds times probes rows.
    for r in selection.where("selected").collect():
        kept.setdefault(r.outer_fold, set()).add(r.probe)
    subset = [[i for i, n in enumerate(names) if features.probe_name(n, backend) in kept[o]] for o in range(outer_folds)]
    final = np.array(
        [
            [linear.fit(mo, alpha, include=block(o)) for o in range(outer_folds)],
            [linear.fit(mo, alpha, include=block(o), keep=subset[o]) for o in range(outer_folds)],
        ]
    )
    out = linear.picks(rows, "x", final, [F.col("_outer"), F.col("_outer")])
    out = out.withColumn("fold", F.col("_outer")).drop("_outer", "_inner", "_cells")
    return selection.drop("position"), out, Runs([("full",), ("lite",)], ("system",), support=0)


def selection_frequency(selection: DataFrame, outer_folds: int) -> DataFrame:
    """Per probe: folds that kept it, mean rank, mean and deviation of the contribution."""
    return selection.groupBy("probe").agg(
        F.count_if("selected").alias("selected_folds"),
        F.avg("rank").alias("mean_rank"),
        F.avg("contribution_pp").alias("mean_contribution_pp"),
        F.stddev_samp("contribution_pp").alias("std_contribution_pp"),
        (F.count_if("selected") / F.lit(float(outer_folds))).alias("selection_frequency"),
    ).orderBy(F.desc("selected_folds"), F.desc("mean_contribution_pp"), "mean_rank", "probe")


def calibrated_domain_ood(
    frame: DataFrame,
    entropy: DataFrame | None,
    models: list[str],
    domains: list[str],
    calibration_ratio: float = 0.2,
    min_coverage: float = 0.5,
    grid_size: int = 101,
    seed: int = 3407,
    alpha: float = 1.0,
) -> DataFrame:
    """Per held-out domain: threshold from the calibration rows, scores on the domain. One row per domain.

    Every domain is a key of the same jobs; only the small solves run in a loop. `entropy`
    has sample_id and uncertainty; without it, the frame has the uncertainty.
    """
    d = len(domains)
    labelled = splits.holdout_labels(frame, domains, calibration_ratio, seed)
    # Hardly any row is fit for some domains and calibration for others. A row that is fit for most of them counts once, in the cell of its domain,
    # and the others' training sums are those of all cells but one; where a label differs, the row is added to or taken from a cell of corrections.
    places = lambda label: F.filter(F.transform("labels", lambda v, k: F.when(label(v), k)), lambda k: k.isNotNull())
    tested = F.array_position("labels", "test").cast("int")
    n_fitted, n_spared = F.size(places(lambda v: v == "fit")), F.size(places(lambda v: v == "calibration"))
    own = F.when(tested > 0, tested - 1).otherwise(d)
    out_of = F.transform(F.filter(places(lambda v: v != "fit"), lambda k: k != own), lambda k: F.bitwise_not(k + (d + 1)))
    into = F.transform(places(lambda v: v == "fit"), lambda k: k + (d + 1))
    cells = F.when(n_fitted >= n_spared, F.concat(F.array(own), out_of)).otherwise(into)
    # Sets whose picks of the row are asked for, and their labels: the domain's number, doubled, plus one where the row is test.
    asked = F.filter(F.transform("labels", lambda v, k: F.when(v != "fit", 2 * k + (v == "test").cast("int"))), lambda k: k.isNotNull())
    uncertainty = ["uncertainty"] if entropy is None else []
    labelled = labelled.select("sample_id", "x", "score", *uncertainty, cells.alias("_cells"), asked.alias("_asked"))
    labelled = written(labelled, "holdout-labels")
    mo = linear.moments(labelled, "x", "score", "_cells")
    sums = [mo.total([*(c for c in range(d + 1) if c != k), d + 1 + k]) for k in range(d)]
    coefs = np.array([linear.solve(z, mo.d, alpha) for z in sums])
    # Training means of the candidates are in the same sums.
    safe = [models[int(np.argmax(z[0, 1 + mo.d :] / z[0, 0]))] for z in sums]
    n_fit = [int(z[0, 0]) for z in sums]
    sets = labelled.withColumn("_sets", F.transform("_asked", lambda a: F.shiftright(a, 1)))
    picked = linear.picks_under(sets, "x", coefs, "_sets").select("sample_id", "score", *uncertainty, "_asked", "slots")
    if entropy is not None:
        picked = picked.join(entropy, "sample_id")
    each = picked.select("uncertainty", "score", F.explode(F.arrays_zip(F.col("_asked").alias("a"), F.col("slots").alias("slot"))).alias("p"))
    k = F.shiftright("p.a", 1)
    fallback = F.array(*[F.lit(models.index(m) + 1) for m in safe])
    ready = each.select(
        k.alias("_k"),
        (F.col("p.a").bitwiseAND(F.lit(1)) == 1).alias("test"),
        "uncertainty",
        F.element_at("score", F.col("p.slot")).alias("router_score"),
        F.element_at("score", fallback[k]).alias("fallback_score"),
        F.array_max("score").alias("oracle"),
    ).persist()
    chosen = selective.select_threshold(ready.where("not test"), min_coverage, grid_size, ("_k",))
    chosen = chosen.select("_k", "threshold", F.col("coverage").alias("calibration_coverage"), F.col("score").alias("calibration_score"))
    sizes = ready.where("not test").groupBy("_k").agg(F.count("*").alias("n_calibration"))
    routed = F.col("uncertainty") <= F.col("threshold")
    final = routing.route_or_abstain(F.col("uncertainty"), F.col("threshold"), F.col("router_score"), F.col("fallback_score"))
    # One threshold per domain.
    test = ready.where("test").join(F.broadcast(chosen), "_k")
    fixed = [F.array(*[F.lit(v) for v in values])[F.col("_k")].alias(c) for c, values in (("domain", domains), ("safe_model", safe))]
    fits = F.array(*[F.lit(n).cast("long") for n in n_fit])[F.col("_k")].alias("n_fit")
    columns = ["threshold", "calibration_coverage", "calibration_score"]
    scored = test.groupBy("_k", *columns).agg(
        F.avg(routed.cast("double")).alias("test_coverage"),
        F.avg(final).alias("test_score"),
        F.avg("router_score").alias("router_only_score"),
        F.avg("fallback_score").alias("best_single_score"),
        F.avg("oracle").alias("oracle_score"),
        F.count("*").alias("n_test"),
    ).join(sizes, "_k")
    scores = ["test_coverage", "test_score", "router_only_score", "best_single_score", "oracle_score", "n_test", "n_calibration"]
    return scored.select(*fixed, fits, *columns, *scores)


def selective_curves(picks: DataFrame, entropy: DataFrame | None) -> DataFrame:
    """(signal, coverage, risk, n) for semantic entropy and for the router margin. Without `entropy`, the picks have the uncertainty."""
    rows = (picks if entropy is None else picks.join(entropy, "sample_id")).withColumn("doubt", -F.col("prediction_margin")).persist()
    named = [("semantic_entropy", "uncertainty"), ("router_margin", "doubt")]
    curves = [selective.risk_coverage_curve(rows, c).withColumn("signal", F.lit(n)) for n, c in named]
    return curves[0].unionByName(curves[1])


def _cost_coefs(mo: linear.Moments, cells: list[int], m: int):
    """Quality (penalty 1) and cost (penalty 2) coefficients of each candidate on its observed rows."""
    both = linear.fit(mo, [1.0] * m + [2.0] * m, include=cells)
    return both[:m], both[m:]


def _with_cost_predictions(rows: DataFrame, coefs) -> DataFrame:
    quality, money = coefs
    out = linear.score(rows, "x", quality, out="pred")
    return linear.score(out, "x", money, out="pred_cost", floor=0.0)


def _cost_moments(rows: DataFrame, labels: list[str]) -> linear.Moments:
    cell = F.array_position(F.array(*[F.lit(v) for v in labels]), F.col("partition")) - 1
    cells = F.when(cell >= 0, F.array(cell.cast("int"))).otherwise(F.array().cast("array<int>"))
    return linear.moments(rows.withColumn("_y", F.concat("score", "cost")).withColumn("_cells", cells), "x", "_y", "_cells", masked=True)


def _cost_fit(frame: DataFrame, labels: list[str], cells: list[list[int]], m: int, learner: str, params: dict):
    """For every list of cells (positions in `labels`), a function that adds `pred` and `pred_cost` fitted on those rows.

    The cost model is linear; the quality model is linear (`ridge`) or boosted trees, one per candidate on its observed rows (`gbt`).
    """
    mo = _cost_moments(frame, labels)
    coefs = [_cost_coefs(mo, c, m) for c in cells]
    if learner == "ridge":
        return [lambda rows, c=c: _with_cost_predictions(rows, c) for c in coefs]
    if learner != "gbt":
        raise ValueError(f"unknown quality learner: {learner}")
    sets = [F.col("partition").isin([labels[i] for i in c]) for c in cells]
    model = boosting.fit(frame, sets=sets, shared=False, **params)
    money = lambda rows, k: linear.score(rows, "x", coefs[k][1], out="pred_cost", floor=0.0)
    return [lambda rows, k=k: money(boosting.predict(rows, model, which=F.lit(k)), k) for k in range(len(cells))]


def perf_cost_eval(
    frame: DataFrame, models: list[str], baseline: str | None = None, lambdas: list[float] = cost.LAMBDAS, learner: str = "ridge", **params
) -> tuple[DataFrame, DataFrame]:
    """(metrics, sweep) of a frame with `partition` train or test; lambda is chosen on the test rows.

    Rows where the named baseline is unobserved are left out of the evaluation.
    """
    frame = written(frame, "cost-frame")
    predicted = _cost_fit(frame, ["train"], [[0]], len(models), learner, params)[0]
    test = frame.where("partition = 'test'")
    if baseline is not None:
        test = cost.baseline_supported(test, models, baseline).where("supported").drop("supported")
    rows = predicted(test).persist()
    bounds = routing.global_bounds(rows, ["pred", "pred_cost"])
    # A sweep has a row per lambda and a baseline one row.
    sweep = summary(cost.sweep_metrics(cost.sweep_picks(rows, models, bounds, lambdas)))
    sweep = summary(cost.pareto_flags(sweep))
    base = summary(cost.select_baseline(rows, models, baseline))
    return operating_points(sweep, sweep, base, base), sweep


def operating_points(selection: DataFrame, test: DataFrame, selection_base: DataFrame, test_base: DataFrame) -> DataFrame:
    """One row: star and dagger chosen on `selection`, measured on `test`. Every input is a sweep or one row."""
    sb = selection_base.first()
    star = cost.theta_star(selection).select(F.col("lambda").alias("theta_star_lambda"))
    dagger = cost.theta_dagger(selection, F.lit(sb.baseline_acc)).select(F.col("lambda").alias("theta_dagger_lambda"))
    one = test_base.join(F.broadcast(star)).join(F.broadcast(dagger), F.lit(True), "left")
    at = test.select("lambda", "AvgAcc", "total_cost")
    s = at.select(F.col("lambda").alias("theta_star_lambda"), F.col("AvgAcc").alias("star_acc"), F.col("total_cost").alias("theta_star_total_cost"))
    d = at.select(F.col("lambda").alias("theta_dagger_lambda"), F.col("AvgAcc").alias("dagger_acc"), F.col("total_cost").alias("theta_dagger_total_cost"))
    one = one.join(s, "theta_star_lambda", "left").join(d, "theta_dagger_lambda", "left")
    raw = cost.cost_save(F.col("theta_dagger_total_cost"), F.col("baseline_cost"))
    meets = F.col("dagger_acc") >= F.col("baseline_acc") - numeric.TINY
    return one.select(
        "baseline_model",
        (F.col("baseline_acc") * 100.0).alias("baseline_AvgAcc"),
        F.col("baseline_cost").alias("baseline_total_cost"),
        cost.perf_gain(F.col("star_acc"), F.col("baseline_acc")).alias("PerfGain_pct"),
        F.when(meets, raw).alias("CostSave_pct"),
        raw.alias("CostSave_raw_pct"),
        "theta_star_lambda",
        (F.col("star_acc") * 100.0).alias("theta_star_AvgAcc"),
        "theta_star_total_cost",
        "theta_dagger_lambda",
        (F.col("dagger_acc") * 100.0).alias("theta_dagger_AvgAcc"),
        "theta_dagger_total_cost",
        meets.alias("theta_dagger_test_meets_baseline"),
    )


def perf_cost_eval_validated(
    frame: DataFrame, models: list[str], baseline: str | None = None, lambdas: list[float] = cost.LAMBDAS, learner: str = "ridge", **params
) -> tuple[DataFrame, DataFrame]:
    """(metrics, test sweep) of a frame with `partition` inner_fit, validation or test.

    Lambda is chosen on the validation rows; the final model adds their sums to the inner
    ones instead of reading the training rows again.
    """
    frame = written(frame, "cost-frame")
    inner, outer = _cost_fit(frame, ["inner_fit", "validation"], [[0], [0, 1]], len(models), learner, params)

    def sweep(label: str, fit_labels: list[str], predicted) -> tuple[DataFrame, DataFrame]:
        fitted = predicted(frame.where(F.col("partition").isin(fit_labels)))
        bounds = routing.global_bounds(fitted, ["pred", "pred_cost"])
        rows = frame.where(F.col("partition") == label)
        if baseline is not None:
            rows = cost.baseline_supported(rows, models, baseline).where("supported").drop("supported")
        rows = predicted(rows).persist()
        # A sweep has a row per lambda and a baseline one row.
        table = summary(cost.sweep_metrics(cost.sweep_picks(rows, models, bounds, lambdas)))
        return summary(cost.pareto_flags(table)), summary(cost.select_baseline(rows, models, baseline))

    val_sweep, val_base = sweep("validation", ["inner_fit"], inner)
    test_sweep, test_base = sweep("test", ["inner_fit", "validation"], outer)
    return operating_points(val_sweep, test_sweep, val_base, test_base), test_sweep


def main_table(rows: DataFrame, models: list[str], runs: Runs, first_system: str) -> dict[str, DataFrame]:
    """runs, summary, baselines and support of (seed, system) picks in `slots`.

    Systems of a seed that do not cover the same samples are an error, which lists the first of them.
    """
    support = summary(metrics.slot_supports(rows, runs))
    # One row per run.
    if support.where("n_mismatches > 0").count():
        raise ValueError(f"{metrics.UNEQUAL}: {metrics.slot_mismatches(rows, runs)}")
    found = metrics.slot_metrics(rows, models, runs).persist()
    return {
        "runs": found,
        "summary": metrics.seed_summary(found),
        "baselines": metrics.baseline_summary(found.where(F.col("system") == first_system)),
        "support": support,
    }


def grouped_rerun(
    frame: DataFrame,
    fs: FeatureSet,
    models: list[str],
    backend: str,
    seeds=SEEDS,
    others: dict[str, tuple[DataFrame, str, dict]] | None = None,
) -> dict[str, DataFrame]:
    """The main grouped protocol: six representations and the task family alone under every seed, to the main table.

    `frame` has the samples with their score array, `fs` all features. All linear systems and
    seeds are solved from one scan. `others` maps a further system to its frame (texts or
    embeddings, same samples), learner and settings; it is fitted once per seed on the same splits and
    joined once. A system that does not cover the support of the others fails the job.
    """
    wide, systems = representation_systems(fs, backend)
    family = fs.take(features.feature_set_names(fs.names, "domain_only", backend))
    systems["domain_only"] = list(range(len(wide.names), len(wide.names) + len(family.names)))
    wide = FeatureSet(
        wide.df.join(family.df.withColumnRenamed("x", "_d"), "sample_id").select("sample_id", F.concat("x", "_d").alias("x")),
        [*wide.names, *family.names],
    )
    labelled, parts = with_partitions(frame, seeds)
    labelled = labelled.persist()
    rows, runs = linear_slots(features.join_features(labelled, wide), models, systems, parts)
    for system, (own, learner, params) in (others or {}).items():
        split = labelled.select("sample_id", *parts.values())
        more, extra = learner_slots(own.join(split, "sample_id").persist(), models, parts, {learner: params})
        more = written(more.select("sample_id", F.col("slots").alias("_more")), "further-picks")
        none = F.array(*[F.lit(None).cast("int")] * len(extra.names))
        rows = rows.join(more, "sample_id", "left").withColumn("slots", F.concat("slots", F.coalesce("_more", none))).drop("_more")
        runs = Runs([*runs.names, *[(s, system) for s, _ in extra.names]], runs.keys)
    return main_table(written(rows.select("sample_id", "dataset", "score", "slots"), "grouped-picks"), models, runs, "probability_mass")


def ood_suite(
    frames: dict[str, tuple[DataFrame, str, dict]], models: list[str], protocols: tuple[str, ...] = ("dataset", "domain")
) -> DataFrame:
    """Metrics of every system under leave-one-dataset-out and leave-one-domain-out.

    `frames` maps a system to its training frame, learner and learner parameters.
    """
    out = None
    for column in protocols:
        for system, (frame, learner, params) in frames.items():
            picks = ood(frame, models, column, learner, **params)
            one = metrics.benchmark_metrics(frame, picks, models).select(
                F.lit(f"{column}-ood").alias("protocol"), F.lit(system).alias("system"), "*"
            )
            out = one if out is None else out.unionByName(one)
    return out


def headline(rows: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """(experiment, metric, value) rows of a one-row table."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])).alias("m")
    return rows.select(F.lit(group).alias("experiment"), each).select("experiment", "m.*")


def reproduce_all(
    samples: DataFrame,
    outcomes: DataFrame,
    feature_sets: dict[str, FeatureSet],
    models: list[str],
    seeds=SEEDS,
    n_bootstrap: int = 10_000,
    n_permutations: int = 20_000,
    learner: str = "ridge",
    **params,
) -> DataFrame:
    """The main grouped protocol for every backend, as (experiment, metric, value) rows.

    Representation suite over seeds, out-of-fold probability mass and hard picks, their
    paired test, nested probe selection, selective curves and calibrated domain holdouts.
    """
    backends = list(feature_sets)
    first = backends[0]
    # Samples, outcomes and features of all backends are joined once; representations, folds, picks and tests are made inside the row.
    base = matrix.require_dense(matrix.sample_frame(samples, outcomes, models), models)
    for i, b in enumerate(backends):
        base = base.join(feature_sets[b].df.select("sample_id", F.col("x").alias(f"_x{i}")), "sample_id", "left")
    base = written(base, "reproduce-frame")
    twice = base.groupBy("sample_id").count().where("count > 1").first()
    if twice is not None:
        raise ValueError(f"two predictions of a sample: {twice.sample_id}")
    meta = [c for c in samples.columns if c in ("dataset", "domain", "query")]

    def of(rows: DataFrame, backend: str) -> FeatureSet:
        return FeatureSet(rows.withColumn("x", F.col(f"_x{backends.index(backend)}")), feature_sets[backend].names)

    def represented(rows: DataFrame, backend: str, mode: str) -> DataFrame:
        return features.with_features(features.representation(of(rows, backend), mode, backend).df)

    full = features.representation(of(base, first), "full", first)
    hard = features.representation(of(full.df.withColumnRenamed("x", "_full"), first), "hard", first)
    wide = FeatureSet(hard.df.withColumn("x", F.concat("_full", "x")), [*full.names, *hard.names])
    frame, parts = with_partitions(features.with_features(wide.df).select("sample_id", *meta, "score", "x"), seeds)
    runs = metrics.slot_metrics(*_slot_args(linear_slots(frame, models, representation_slots(full.names, hard.names, first), parts), models))
    means = metrics.seed_summary(runs)
    label = F.concat(F.lit("representation/"), F.col("system"))
    parts_out = [means.select(label.alias("experiment"), F.lit("AvgAcc_mean").alias("metric"), F.col("AvgAcc_mean").alias("value"))]
    picks = splits.stratified_folds(base, 5, 3407, True)
    named = [("pm", first, "probability_mass"), ("hard", first, "hard")] + [(f"pm_{b}", b, "probability_mass") for b in backends[1:]]
    for name, backend, mode in named:
        picks = held_out(represented(picks, backend, mode), models, F.col("fold"), 5, learner, **params)
        picks = picks.withColumn(f"_slot_{name}", routing.first_best(F.col("pred"))).withColumn(f"_margin_{name}", routing.margin(F.col("pred"))).drop("pred")
    picks = features.semantic_entropy(of(picks, first), first, *meta, "score", *[f"_slot_{n}" for n, *_ in named], "_margin_pm")
    picks = picks.withColumn("slots", F.array(*[f"_slot_{n}" for n, *_ in named]))
    picks = written(picks.select("sample_id", *meta, "score", "uncertainty", "slots", F.col("_margin_pm").alias("prediction_margin")), "reproduce-picks")
    names = [n for n, *_ in named]
    oof_metrics = summary(metrics.slot_metrics(picks, models, Runs([(n,) for n in names], ("system",), support=0)))
    for name in names:
        parts_out.append(headline(oof_metrics.where(F.col("system") == name), f"oof/{name}", list(metrics.METRICS)))
    against = [("pm", "hard")] + [(n, "pm") for n in names if n.startswith("pm_")]
    for a, b in against:
        test = paired.slot_test(picks, names.index(a), names.index(b), n_bootstrap=n_bootstrap, n_permutations=n_permutations, grouped=True)
        cols = ["macro_diff_pp", "bootstrap_ci_low_pp", "bootstrap_ci_high_pp", "permutation_p_two_sided"]
        parts_out.append(headline(test, f"paired/{a}-{b}", cols))
    pm_names = features.representation_names(feature_sets[first].names, "probability_mass", first)
    pm_frame = represented(base, first, "probability_mass").select("sample_id", *meta, "score", "x")
    _, nested, both = nested_probe_selection(pm_frame, pm_names, models, first)
    nested_runs = metrics.slot_metrics(nested, models, both)
    tag = F.concat(F.lit("nested/"), F.col("system"))
    parts_out.append(nested_runs.select(tag.alias("experiment"), F.lit("AvgAcc").alias("metric"), F.col("AvgAcc").alias("value")))
    regret = F.array_max("score") - F.element_at("score", F.col("slots")[0])
    curves = selective_curves(picks.select("sample_id", "prediction_margin", regret.alias("regret"), "uncertainty"), None)
    area = selective.aurc(curves, ("signal",))
    parts_out.append(area.select(F.concat(F.lit("selective/"), F.col("signal")).alias("experiment"), F.lit("aurc").alias("metric"), F.col("aurc").alias("value")))
    domains = matrix.few_values(samples, "domain")
    manual = represented(features.semantic_entropy(of(base, first), first, *meta, "score", *[f"_x{i}" for i in range(len(backends))]), first, "full")
    ood_rows = selective.domain_macro(calibrated_domain_ood(manual, None, models, domains))
    parts_out.append(headline(ood_rows, "calibrated_domain_ood", ["macro_test_score", "macro_router_only_score", "macro_test_coverage"]))
    out = parts_out[0]
    for p in parts_out[1:]:
        out = out.unionByName(p)
    return out
