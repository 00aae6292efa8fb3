"""One model per candidate: MLlib's boosted trees, or forests of this library.

MLlib fits each model on the whole distributed table. The trees are Spark's own, so they
differ from those of other libraries with the same settings. Forests of all candidates grow together
(`forests`), since MLlib's sums per node are far larger than the rows of a small node.
"""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointsman.functions import numeric
from pointsman.operators import forests


def gbt(max_iter: int = 500, depth: int = 6, step: float = 0.05, seed: int = 3407, **_):
    return GBTRegressor(
        featuresCol="v", labelCol="label", predictionCol="out", maxIter=max_iter, maxDepth=depth, stepSize=step, seed=seed
    )


FAMILIES = {"gbt": gbt}


def as_vector(x: str) -> Column:
    return array_to_vector(F.transform(x, numeric.clean_numeric))


def fit_per_candidate(
    train: DataFrame, models: list[str], family: str = "gbt", x: str = "x", y: str = "score", parallelism: int = 2, **params
) -> list:
    """One fitted model per candidate, on the rows that observe it. `y` is the output array."""
    if family == "random_forest":
        return forests.fit(train, models, x, y, **params)
    rows = train.select(as_vector(x).alias("v"), F.col(y).alias("_y")).persist()

    def one(i: int):
        seen = rows.select("v", F.col("_y")[i].alias("label")).where(numeric.is_finite(F.col("label")))
        if len(seen.limit(2).collect()) < 2:
            raise ValueError(f"candidate {models[i]!r} has fewer than two observed training rows")
        return FAMILIES[family](**params).fit(seen)

    pool = ThreadPool(parallelism)
    try:
        # Small jobs of several candidates overlap, so executors stay busy.
        return pool.map(inheritable_thread_target(train.sparkSession)(one), range(len(models)))
    finally:
        pool.close()
        rows.unpersist()


def predict(rows: DataFrame, fitted: list, x: str = "x", out: str = "pred") -> DataFrame:
    """Add the array of predictions, one per candidate."""
    if all(isinstance(f, forests.Forest) for f in fitted):
        return forests.predict(rows, fitted, x, out)
    cur = rows.withColumn("v", as_vector(x))
    names = []
    for i, model in enumerate(fitted):
        cur = model.transform(cur)
        names.append(f"_p{i}")
        cur = cur.withColumnRenamed("out", names[-1])
    return cur.withColumn(out, F.array(*names)).drop("v", *names)


def importances(spark, fitted: list, names: list[str], models: list[str]) -> DataFrame:
    """(model, feature, importance), most important first."""
    data = [
        (m, n, float(v)) for m, f in zip(models, fitted)
        for n, v in zip(names, f.featureImportances if isinstance(f, forests.Forest) else f.featureImportances.toArray())
    ]
    table = spark.createDataFrame(data, "model string, feature string, importance double")
    return table.orderBy("model", F.desc("importance"), "feature")


def save_router(spark, path: str, fitted: list, names: list[str], models: list[str]) -> None:
    """The fitted models beside the feature and candidate order."""
    order = [("feature", i, n) for i, n in enumerate(names)] + [("model", i, m) for i, m in enumerate(models)]
    order += [("forest", i, models[i]) for i, f in enumerate(fitted) if isinstance(f, forests.Forest)]
    spark.createDataFrame(order, "kind string, pos int, name string").coalesce(1).write.parquet(f"{path}/order")
    for i, model in enumerate(fitted):
        if isinstance(model, forests.Forest):
            forests.save(spark, f"{path}/{i:05d}", model)
        else:
            PipelineModel([model]).write().save(f"{path}/{i:05d}")


def load_router(spark, path: str) -> tuple[list, list[str], list[str]]:
    """(fitted models, feature names, candidate names) in their saved order."""
    order = spark.read.parquet(f"{path}/order").orderBy("pos").collect()
    names, models = ([r.name for r in order if r.kind == kind] for kind in ("feature", "model"))
    own = {r.pos for r in order if r.kind == "forest"}
    load = lambda i: forests.load(spark, f"{path}/{i:05d}") if i in own else PipelineModel.load(f"{path}/{i:05d}")
    return [load(i) for i in range(len(models))], names, models
