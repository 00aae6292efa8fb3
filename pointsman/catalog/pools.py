"""Test pools derived from the given tables: samples, outcomes, features and predictions.

P is rectangular (parts and their order lines), O sparse (orders), D made of texts
(documents and labels). Features and predictions follow arithmetic or hash rules: they
stand in for judgments that the tables do not hold, so quality numbers mean nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointsman import schemas
from pointsman.catalog.sql import COST_SCALE, MODELS, SEEDS, SYSTEMS
from pointsman.functions import draws, numeric
from pointsman.operators import dedup, matrix
from pointsman.operators.features import (
    BINARY_PROBES,
    FAMILY_LABELS,
    FAMILY_PROBE,
    SCORE_LEVELS,
    SCORE_PROBES,
    FeatureSet,
    probe_feature_names,
)

BACKEND = "sem"
LABELS = ["quality", "toxic"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_id(c: str) -> Column:
    return F.col(c).cast("string").alias("sample_id")


def p_all_samples(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        text_id("p_partkey"),
        F.col("p_partkey").alias("key"),
        F.col("p_size").cast("long").alias("size"),
        F.col("p_brand").alias("dataset"),
        F.col("p_type").alias("domain"),
        F.col("p_name").alias("query"),
    )


def _cents(c: str) -> Column:
    return F.sum(F.round(F.col(c) * 100).cast("long"))


def p_raw_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Whole-number arithmetic up to the last division, so every engine gets the same doubles."""
    return (
        table(spark, sf, "lineitem")
        .groupBy("l_partkey", "l_linenumber")
        .agg(
            F.expr("sum(cast(round(l_discount * 100) as bigint)) * 100 div count(*)").alias("s"),
            F.expr("sum(cast(round(l_extendedprice * 100) as bigint)) div count(*)").alias("c"),
            F.sum(F.col("l_quantity").cast("long")).alias("tokens"),
        )
        .select(
            text_id("l_partkey"),
            F.concat(F.lit("m"), "l_linenumber").alias("model"),
            (F.col("s").cast("double") / 1000).alias("score"),
            (F.col("c").cast("double") / 100).alias("cost"),
            "tokens",
        )
    )


def p_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """Score and cost arrays of the samples that every candidate answered."""
    arrays = matrix.outcome_arrays(p_raw_outcomes(spark, sf), MODELS, ("score", "cost"))
    return arrays.where(F.size(matrix.observed(F.col("score"))) == len(MODELS))


def p_frame(spark: SparkSession, sf: str) -> DataFrame:
    """sample_id, key, size, dataset, domain, query, score, cost: complete samples of pool P."""
    # Stands in for stored sample and outcome tables, so it is computed once.
    return p_all_samples(spark, sf).join(p_arrays(spark, sf), "sample_id").persist()


def p_samples(spark: SparkSession, sf: str) -> DataFrame:
    return p_frame(spark, sf).drop("score", "cost")


def p_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Long outcomes of the complete samples."""
    both = F.arrays_zip(F.array(*[F.lit(m) for m in MODELS]).alias("model"), F.col("score").alias("score"), F.col("cost").alias("cost"))
    return p_frame(spark, sf).select("sample_id", "dataset", "domain", F.explode(both).alias("o")).select("sample_id", "dataset", "domain", "o.*")


def unit_array(*parts) -> Column:
    """One hash draw per candidate."""
    return F.transform(F.array(*[F.lit(m) for m in MODELS]), lambda m: draws.hash_unit(*parts, m))


def with_predictions(frame: DataFrame, seed: int = 1, system: str = "alpha") -> DataFrame:
    """Add predicted quality and cost arrays of one system and seed."""
    return frame.withColumn("pred", unit_array(seed, system, F.col("sample_id"))).withColumn(
        "pred_cost",
        F.transform(unit_array("cost", seed, system, F.col("sample_id")), lambda v: v * COST_SCALE),
    )


def all_predictions(frame: DataFrame) -> DataFrame:
    """The frame once per seed and system, with that run's `pred`."""
    runs = F.array(*[F.struct(F.lit(s).alias("seed"), F.lit(n).alias("system")) for s in SEEDS for n in SYSTEMS])
    rows = frame.withColumn("r", F.explode(runs)).select("*", "r.*").drop("r")
    return rows.withColumn("pred", unit_array(F.col("seed"), F.col("system"), F.col("sample_id")))


def _noul(j: int) -> Column:
    return ((F.col("key") * (2 * j + 3) + F.col("size") * (j + 1)) % 11).cast("double") / 10


def _weights(j: int) -> list[Column]:
    return [1 + (F.col("key") * (k + 3) + F.col("size") * (j + 1) + j * k) % 7 for k in range(len(SCORE_LEVELS))]


def _family() -> list[Column]:
    return [1 + (F.col("key") * (k + 2) + F.col("size")) % 5 for k in range(len(FAMILY_LABELS))]


def _shares(weights: list[Column]) -> Column:
    total = sum(weights[1:], weights[0])
    return F.array(*[w.cast("double") / total.cast("double") for w in weights])


def _confidence(j: int) -> Column:
    v = F.col("key") * (j + 1) % 10
    return F.when(v != 0, v.cast("double") / 10)


def _noul_array() -> Column:
    j = F.sequence(F.lit(0).cast("long"), F.lit(len(BINARY_PROBES) - 1).cast("long"))
    return F.transform(j, lambda v: ((F.col("key") * (2 * v + 3) + F.col("size") * (v + 1)) % 11).cast("double") / 10)


def _mass_arrays() -> Column:
    """One array of level shares per score probe."""
    j = F.sequence(F.lit(0).cast("long"), F.lit(len(SCORE_PROBES) - 1).cast("long"))
    k = F.sequence(F.lit(0).cast("long"), F.lit(len(SCORE_LEVELS) - 1).cast("long"))
    weights = F.transform(
        j, lambda v: F.transform(k, lambda w: (1 + (F.col("key") * (w + 3) + F.col("size") * (v + 1) + v * w) % 7).cast("double"))
    )
    return F.transform(weights, lambda ws: F.transform(ws, lambda w: w / numeric.total(ws)))


def p_features(samples: DataFrame, backend: str = BACKEND) -> FeatureSet:
    """The encoded features of the rule, without going through JSON."""
    levels = F.array(*[F.lit(float(v)) for v in SCORE_LEVELS])
    family = F.concat(F.array((1 + F.col("key") % 9).cast("double") / 10, numeric.entropy_norm(F.col("_f"))), F.col("_f"))
    binary = F.flatten(F.transform("_n", lambda p: F.array(p, numeric.binary_entropy(p))))

    def one(m: Column, j: Column) -> Column:
        c = F.col("key") * (j + 1) % 10
        head = F.array(F.when(c != 0, c.cast("double") / 10), numeric.entropy_norm(m))
        tail = F.array(((F.col("key") + j) % 4).cast("double"), numeric.moment(levels, m, 1), numeric.spread(levels, m))
        return F.concat(head, m, tail)

    graded = F.flatten(F.transform("_s", one))
    rows = samples.select("sample_id", "key", _shares(_family()).alias("_f"), _noul_array().alias("_n"), _mass_arrays().alias("_s"))
    # Stands in for a stored feature table, so it is computed once.
    return FeatureSet(rows.select("sample_id", F.concat(family, binary, graded).alias("x")).persist(), probe_feature_names(backend))


def p_mass(samples: DataFrame, backend: str = BACKEND) -> FeatureSet:
    """Only the 40 probability-mass features of the rule."""
    names = [f"{backend}_{n}__noul" for n in BINARY_PROBES]
    names += [f"{backend}_{n}__p__{v}" for n in SCORE_PROBES for v in SCORE_LEVELS]
    rows = samples.select("sample_id", F.concat(_noul_array(), F.flatten(_mass_arrays())).alias("x"))
    return FeatureSet(rows.persist(), names)


def _as_json(p: Column, names: list[str] | None) -> Column:
    """Probabilities as a JSON array, or as an object when the names are given."""
    if names is None:
        return F.to_json(p)
    return F.to_json(F.struct(*[p[i].alias(n) for i, n in enumerate(names)]))


def p_decisions(samples: DataFrame) -> DataFrame:
    """Typed decisions of the rule in the raw schema; probabilities alternate between both JSON forms."""
    null = F.lit(None).cast("double")

    def answer(kind, noul=null, score=null, confidence=null, probabilities=None) -> Column:
        return F.struct(
            F.lit(kind).alias("type"), noul.alias("noul"), score.alias("score"), confidence.alias("confidence"),
            (probabilities if probabilities is not None else F.lit(None).cast("string")).alias("probabilities"),
        )

    pairs = [F.lit(FAMILY_PROBE), answer("choice", confidence=(1 + F.col("key") % 9).cast("double") / 10, probabilities=_as_json(_shares(_family()), FAMILY_LABELS))]
    for j, n in enumerate(BINARY_PROBES):
        pairs += [F.lit(n), answer("noul", noul=_noul(j))]
    for j, n in enumerate(SCORE_PROBES):
        text = _as_json(_shares(_weights(j)), SCORE_LEVELS if j % 2 == 0 else None)
        pairs += [F.lit(n), answer("score", score=((F.col("key") + j) % 4).cast("double"), confidence=_confidence(j), probabilities=text)]
    return samples.select(
        "sample_id",
        F.sha2("query", 256).alias("query_hash"),
        F.lit("manual-v1").alias("probe_set_version"),
        F.lit(BACKEND).alias("backend"),
        F.lit("judge").alias("requested_model"),
        F.lit("judge").alias("resolved_model"),
        F.lit(None).cast("string").alias("resolved_revision"),
        F.create_map(*pairs).cast(schemas.DECISION["answers"].dataType).alias("answers"),
        F.struct((100 + F.col("key") % 500).alias("input_tokens"), F.lit(0).cast("long").alias("output_tokens")).alias("usage"),
        ((F.col("key") * 7 % 1000).cast("double") / 4).alias("latency_ms"),
        F.lit(False).alias("cached"),
    ).persist()


def o_samples(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        text_id("o_orderkey"), F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("dataset"), F.col("o_orderstatus").alias("domain")
    )


def o_raw(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        text_id("l_orderkey"),
        F.concat(F.lit("m"), "l_linenumber").alias("model"),
        (F.round(F.col("l_discount") * 100).cast("long").cast("double") / 10).alias("score"),
        F.col("l_extendedprice").alias("cost"),
        "l_shipdate",
        "l_partkey",
        "l_suppkey",
    )


O_ORDER = ("l_shipdate", "l_partkey", "l_suppkey", "cost", "score")


def o_latest(spark: SparkSession, sf: str) -> DataFrame:
    """The latest row per sample and candidate. Rows are spread by sample, so arrays and joins by sample stay in place."""
    raw = o_raw(spark, sf).repartition("sample_id")
    return dedup.keep_last(raw, ["sample_id", "model"], [F.col(c) for c in O_ORDER])


def o_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """The latest row per sample and candidate, with the sample's dataset and domain."""
    return o_latest(spark, sf).select("sample_id", "model", "score", "cost").join(
        o_samples(spark, sf).select("sample_id", "dataset", "domain"), "sample_id"
    )


def o_frame(spark: SparkSession, sf: str) -> DataFrame:
    """sample_id, key, dataset, domain, score, cost with nulls where unobserved."""
    return o_samples(spark, sf).join(matrix.outcome_arrays(o_latest(spark, sf), MODELS, ("score", "cost")), "sample_id")


def o_observed(frame: DataFrame) -> DataFrame:
    """The outcomes in the arrays of `o_frame`, one row each."""
    both = F.arrays_zip(F.array(*[F.lit(m) for m in MODELS]).alias("model"), F.col("score").alias("score"), F.col("cost").alias("cost"))
    rows = frame.select("sample_id", "dataset", "domain", F.explode(both).alias("o")).select("sample_id", "dataset", "domain", "o.*")
    return rows.where("score is not null or cost is not null")


def o_predicted(spark: SparkSession, sf: str) -> DataFrame:
    return o_frame(spark, sf).withColumn("pred", unit_array("q", F.col("sample_id"))).withColumn(
        "pred_cost", F.transform(unit_array("c", F.col("sample_id")), lambda v: v * COST_SCALE)
    )


def d_samples(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        text_id("doc_id"), F.col("doc_id").alias("key"), F.col("lang").alias("dataset"), F.col("source").alias("domain"), F.col("text").alias("query")
    )


def d_frame(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents with their score array."""
    labels = table(spark, sf, "labels").select(
        text_id("doc_id"), F.array(F.col("quality").cast("double"), F.col("toxic").cast("double")).alias("score")
    )
    return d_samples(spark, sf).join(labels, "sample_id")


def d_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(text_id("vec_id"), F.col("embedding").cast("array<double>").alias("x"))


def has_vector(spark: SparkSession, sf: str) -> Column:
    """Whether a document of pool D belongs to those that vectors were made for: ids up to the last vector's."""
    last = table(spark, sf, "embeddings").agg(F.max("vec_id")).first()[0]
    return F.col("key") <= F.lit(-1 if last is None else last)


def entropy_table(frame: DataFrame) -> DataFrame:
    from pointsman.operators.features import semantic_entropy

    return semantic_entropy(p_features(frame), BACKEND)
