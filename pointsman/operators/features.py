"""Semantic judgments as probability features.

A decision row carries a map of typed answers. They are encoded inside the row: either as
long rows (sample_id, probe, stat, level, value) or, with the probe list fixed, as one
array per sample in a fixed feature order, so that no pivot is needed for learning.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointsman.functions import numeric, text
from pointsman.operators import dedup

# The probes of the manual probe set, in its order.
FAMILY_PROBE = "task_family"
FAMILY_LABELS = [
    "mathematics", "code", "logic", "knowledge", "social_affective", "instruction_following", "tool_use", "other",
]
BINARY_PROBES = [
    "math_reasoning", "code_reasoning", "formal_logic", "factual_recall", "social_affective", "tool_interaction",
    "external_knowledge", "current_information",
]
SCORE_PROBES = [
    "domain_specialization", "reasoning_depth", "constraint_density", "context_integration", "decomposition_need",
    "ambiguity", "exactness", "answer_openness",
]
SCORE_LEVELS = ["0", "1", "2", "3"]

MODES = ("full", "probability_mass", "no_entropy", "primary", "primary_entropy", "hard")
FEATURE_SETS = (
    "all", "deterministic", "semantic", "semantic_manual", "semantic_all", "domain_only", "semantic_plus_deterministic",
)


@dataclass(frozen=True)
class Probe:
    name: str
    kind: str  # noul, score or choice
    levels: tuple[str, ...] = ()


MANUAL_PROBES = (
    Probe(FAMILY_PROBE, "choice", tuple(FAMILY_LABELS)),
    *[Probe(n, "noul") for n in BINARY_PROBES],
    *[Probe(n, "score", tuple(SCORE_LEVELS)) for n in SCORE_PROBES],
)


@dataclass(frozen=True)
class FeatureSet:
    """One row per sample: sample_id and `x`, an array of doubles in the order of `names`."""

    df: DataFrame
    names: list[str]

    def take(self, names: list[str]) -> "FeatureSet":
        at = {n: i for i, n in enumerate(self.names)}
        missing = [n for n in names if n not in at]
        if missing:
            raise ValueError(f"missing {len(missing)} features: {missing[:8]}")
        return self.replace(F.array(*[F.col("x")[at[n]] for n in names]), names)

    def replace(self, x: Column, names: list[str]) -> "FeatureSet":
        return FeatureSet(self.df.withColumn("x", x), names)

    def long(self) -> DataFrame:
        """(sample_id, feature, value) rows, nulls left out.

        The exploded input is an expression on purpose: for a plain column the optimizer
        adds a non-empty filter, which repeats the column's whole definition.
        """
        both = F.arrays_zip(F.array(*[F.lit(n) for n in self.names]).alias("feature"), F.col("x").alias("value"))
        return self.df.select("sample_id", F.explode(both).alias("f")).select("sample_id", "f.*").where("value is not null")


def parse_probabilities(raw: Column) -> Column:
    """Ordered (key, p) entries from an object or an array given as JSON text."""
    entry = "array<struct<key:string,value:double>>"
    as_list = F.transform(
        F.from_json(raw, T.ArrayType(T.DoubleType())),
        lambda v, i: F.struct(i.cast("string").alias("key"), v.alias("value")),
    )
    as_map = F.map_entries(F.from_json(raw, T.MapType(T.StringType(), T.DoubleType())))
    start = F.substring(F.ltrim(raw), 1, 1)
    return F.when(start == "[", as_list.cast(entry)).when(start == "{", as_map.cast(entry)).otherwise(F.array().cast(entry))


def levels_of(entries: Column) -> Column:
    """Numeric key, or the position for a key that is no number."""
    return F.transform(entries, lambda e, i: F.coalesce(e["key"].try_cast("double"), i.cast("double")))


def _masses(entries: Column) -> Column:
    return F.transform(entries, lambda e: e["value"])


def _stat(name: str, value: Column, level: Column | None = None) -> Column:
    return F.struct(
        F.lit(name).alias("stat"),
        (level if level is not None else F.lit(None).cast("string")).alias("level"),
        value.cast("double").alias("value"),
    )


def answer_stats(a: Column, entries: Column) -> Column:
    """All (stat, level, value) of one typed answer whose probabilities are `entries`."""
    p = F.coalesce(a["noul"], F.lit(0.5))
    binary = F.array(_stat("noul", p), _stat("entropy", numeric.binary_entropy(p)))
    some = F.size(entries) > 0
    is_score = (a["type"] == "score") | a["score"].isNotNull()
    levels = levels_of(entries)
    mean = numeric.moment(levels, _masses(entries), 1)
    graded = F.concat(
        F.array(_stat("confidence", a["confidence"]), _stat("entropy", F.when(some, numeric.entropy_norm(_masses(entries))))),
        F.transform(entries, lambda e: _stat("p", e["value"], text.sanitize_label(e["key"]))),
        F.array(
            _stat("score", F.when(is_score, F.coalesce(a["score"], F.lit(0.0)))),
            _stat("expected", F.when(is_score & some, mean)),
            _stat("spread", F.when(is_score & some, numeric.spread(levels, _masses(entries)))),
        ),
    )
    is_binary = F.coalesce(a["type"] == "noul", F.lit(False)) | a["noul"].isNotNull()
    return F.filter(F.when(is_binary, binary).otherwise(graded), lambda s: s["value"].isNotNull())


def encode_long(decisions: DataFrame) -> DataFrame:
    """(sample_id, probe, stat, level, value) for every answer of every decision."""
    rows = decisions.select("sample_id", F.explode("answers").alias("probe", "a"))
    # Parsed once per answer, then used by every statistic.
    parsed = rows.withColumn("e", parse_probabilities(F.col("a.probabilities")))
    return parsed.select("sample_id", "probe", F.explode(answer_stats(F.col("a"), F.col("e"))).alias("s")).select(
        "sample_id", "probe", "s.*"
    )


def feature_name(backend: str, probe: Column, stat: Column, level: Column) -> Column:
    return F.concat_ws("__", F.concat(F.lit(f"{backend.rstrip('_')}_"), probe), stat, level)


def encode_meta(decisions: DataFrame, backend: str) -> DataFrame:
    b = backend.rstrip("_")
    return decisions.select(
        "sample_id",
        F.col("usage.input_tokens").cast("double").alias(f"meta_{b}_input_tokens"),
        F.col("latency_ms").cast("double").alias(f"meta_{b}_latency_ms"),
    )


def latest_decisions(decisions: DataFrame, order: list[Column]) -> DataFrame:
    return dedup.keep_last(decisions, ["sample_id"], order)


def probe_feature_names(backend: str, probes: tuple[Probe, ...] = MANUAL_PROBES) -> list[str]:
    names = []
    for p in probes:
        base = f"{backend.rstrip('_')}_{p.name}"
        if p.kind == "noul":
            stats = ["noul", "entropy"]
        else:
            labels = [f"p__{v.replace(' ', '_').replace('/', '_')}" for v in p.levels]
            stats = ["confidence", "entropy", *labels]
            if p.kind == "score":
                stats += ["score", "expected", "spread"]
        names += [f"{base}__{s}" for s in stats]
    return names


def encode_vectors(decisions: DataFrame, backend: str, probes: tuple[Probe, ...] = MANUAL_PROBES) -> FeatureSet:
    """The same statistics as one array per sample, without exploding and pivoting.

    Probabilities are parsed in a projection of their own: the next one refers to them many
    times, so they are evaluated once per answer.
    """
    names = probe_feature_names(backend, probes)
    graded = [i for i, p in enumerate(probes) if p.kind != "noul"]
    a = [F.try_element_at("answers", F.lit(p.name)) for p in probes]
    parsed = decisions.select(
        "sample_id", "answers", *[parse_probabilities(a[i]["probabilities"]).alias(f"_e{i}") for i in graded]
    )
    split = parsed.select(
        "sample_id",
        "answers",
        *[_masses(F.col(f"_e{i}")).alias(f"_m{i}") for i in graded],
        *[levels_of(F.col(f"_e{i}")).alias(f"_l{i}") for i in graded],
        *[F.map_from_entries(f"_e{i}").alias(f"_k{i}") for i in graded],
    )
    cells: list[Column] = []
    for i, p in enumerate(probes):
        if p.kind == "noul":
            yes = F.when(a[i].isNotNull(), F.coalesce(a[i]["noul"], F.lit(0.5)))
            cells += [yes, numeric.binary_entropy(yes)]
            continue
        m, levels = F.col(f"_m{i}"), F.col(f"_l{i}")
        some = F.size(m) > 0
        cells += [a[i]["confidence"], F.when(some, numeric.entropy_norm(m))]
        cells += [F.try_element_at(f"_k{i}", F.lit(v)) for v in p.levels]
        if p.kind == "score":
            is_score = (a[i]["type"] == "score") | a[i]["score"].isNotNull()
            cells += [
                F.when(is_score, F.coalesce(a[i]["score"], F.lit(0.0))),
                F.when(is_score & some, numeric.moment(levels, m, 1)),
                F.when(is_score & some, numeric.spread(levels, m)),
            ]
    return FeatureSet(split.select("sample_id", F.array(*cells).alias("x")), names)


@dataclass(frozen=True)
class Part:
    """A feature name taken apart: `<backend>_<probe>__<stat>[__<level>]`."""

    name: str
    head: str
    probe: str
    stat: str
    level: str

    @classmethod
    def of(cls, name: str, backend: str) -> Part:
        head, _, rest = name.partition("__")
        stat, _, level = rest.partition("__")
        return cls(name, head, head.removeprefix(_prefix(backend)), stat, level)


def _prefix(backend: str) -> str:
    return backend.rstrip("_") + "_"


def judged_parts(names: list[str], backend: str) -> list[Part]:
    """The backend's judgments of the query: its features without the task family and the meta columns."""
    parts = [Part.of(n, backend) for n in names if n.startswith(_prefix(backend)) and not n.startswith("meta_")]
    return [p for p in parts if FAMILY_PROBE not in p.name]


def probe_name(name: str, backend: str) -> str:
    return Part.of(name, backend).probe


def probe_names(names: list[str], backend: str) -> list[str]:
    """Probes in order of first appearance."""
    return list(dict.fromkeys(probe_name(n, backend) for n in names))


#: The statistics a representation is made of; with a minus sign those it is made without.
STATS = {
    "full": (),
    "probability_mass": ("noul", "p"),
    "no_entropy": ("-entropy",),
    "primary": ("noul", "expected"),
    "primary_entropy": ("noul", "expected", "entropy"),
}


def representation_names(names: list[str], mode: str, backend: str) -> list[str]:
    if mode not in STATS:
        raise ValueError(f"unknown mode {mode}; expected one of {MODES}")
    out = {s[1:] for s in STATS[mode] if s.startswith("-")}
    only = {s for s in STATS[mode] if not s.startswith("-")}
    return [p.name for p in judged_parts(names, backend) if p.stat not in out and (not only or p.stat in only)]


def _hard(fs: FeatureSet, backend: str) -> FeatureSet:
    """One decision per probe: noul at 0.5 and above is 1; a score probe gives its likeliest level."""
    at = {n: F.col("x")[i] for i, n in enumerate(fs.names)}
    by_probe: dict[str, list[Part]] = {}
    for p in judged_parts(fs.names, backend):
        by_probe.setdefault(p.head, []).append(p)
    decisions = {}
    for head, parts in by_probe.items():
        stats = {p.stat: at[p.name] for p in parts if not p.level}
        # Levels in text order, as the columns are named; the first wins among equals.
        masses = sorted(((p.level, at[p.name]) for p in parts if p.stat == "p"), key=lambda m: m[0]) if all(p.stat != "noul" for p in parts) else []
        if "noul" in stats:
            decisions[head] = (stats["noul"] >= 0.5).cast("double")
        elif masses:
            share = F.array(*[c for _, c in masses])
            level = F.array(*[_level(label, i) for i, (label, _) in enumerate(masses)])
            decisions[head] = F.element_at(level, F.array_position(share, F.array_max(share)).cast("int"))
        elif "expected" in stats:
            decisions[head] = F.rint(stats["expected"])
    return fs.replace(F.array(*decisions.values()), [f"{head}__hard" for head in decisions])


def _level(label: str, position: int) -> Column:
    try:
        return F.lit(float(label))
    except ValueError:
        return F.lit(float(position))


def representation(fs: FeatureSet, mode: str, backend: str) -> FeatureSet:
    if mode == "hard":
        return _hard(fs, backend)
    return fs.take(representation_names(fs.names, mode, backend))


def drop_probes(fs: FeatureSet, probes: set[str], backend: str) -> FeatureSet:
    return fs.take([n for n in fs.names if probe_name(n, backend) not in probes])


def keep_probes(fs: FeatureSet, probes: set[str], backend: str) -> FeatureSet:
    return fs.take([n for n in fs.names if probe_name(n, backend) in probes])


def feature_set_names(names: list[str], feature_set: str, backend: str) -> list[str]:
    plain = [n for n in names if n != "sample_id" and not n.startswith("meta_")]
    b = f"{backend.rstrip('_')}_"
    rules = {
        "all": lambda n: True,
        "deterministic": lambda n: n.startswith("det_"),
        "semantic": lambda n: n.startswith(b) and FAMILY_PROBE not in n,
        "semantic_manual": lambda n: n.startswith(b) and FAMILY_PROBE not in n,
        "semantic_all": lambda n: n.startswith(b),
        "domain_only": lambda n: n.startswith(f"{b}{FAMILY_PROBE}__"),
        "semantic_plus_deterministic": lambda n: n.startswith((b, "det_")),
    }
    if feature_set not in rules:
        raise ValueError(f"unknown feature set {feature_set}")
    return [n for n in plain if rules[feature_set](n)]


def align(fs: FeatureSet, names: list[str]) -> FeatureSet:
    """Features in the router's order; a value that is not finite fails the job."""
    out = fs.take(names)
    bad = F.exists("x", lambda v: ~numeric.is_finite(v))
    message = F.concat(F.lit("features are not finite for sample "), F.col("sample_id"))
    return out.replace(F.when(bad, F.raise_error(message)).otherwise(F.col("x")), names)


def cleaned(fs: FeatureSet) -> FeatureSet:
    return fs.replace(F.transform("x", numeric.clean_numeric), fs.names)


def semantic_entropy(fs: FeatureSet, backend: str, *more: str) -> DataFrame:
    """(sample_id, `more`, uncertainty): mean over the entropy features that are present."""
    names = [p.name for p in judged_parts(fs.names, backend) if p.stat == "entropy"]
    if not names:
        raise ValueError("no semantic entropy features")
    out = fs.take(names).df.withColumn("_v", F.filter("x", lambda v: v.isNotNull()))
    fail = F.raise_error(F.concat(F.lit("no entropy for sample "), F.col("sample_id")))
    mean = numeric.total(F.col("_v")) / F.size("_v")
    return out.select("sample_id", *more, F.when(F.size("_v") == 0, fail).otherwise(mean).alias("uncertainty"))


def quality_check(fs: FeatureSet, backend: str) -> DataFrame:
    """One row: rows, distinct ids, feature count, non-finite and out-of-range cells of the probability mass."""
    pm = representation(fs, "probability_mass", backend)
    outside = F.filter("x", lambda v: (v < -1e-9) | (v > 1.0 + 1e-9))
    return pm.df.agg(
        F.count("*").alias("n_rows"),
        F.count_distinct("sample_id").alias("n_ids"),
        F.lit(len(pm.names)).cast("long").alias("n_features"),
        F.coalesce(F.sum(F.size(F.filter("x", lambda v: ~numeric.is_finite(v)))), F.lit(0)).alias("n_not_finite"),
        F.coalesce(F.sum(F.size(outside)), F.lit(0)).alias("n_out_of_range"),
    )


def join_features(ids: DataFrame, fs: FeatureSet, required: bool = True) -> DataFrame:
    """Left-align features to the ids; a sample without any value fails the job when required."""
    rows = ids.join(fs.df.select("sample_id", "x"), "sample_id", "left")
    return with_features(rows) if required else rows


def with_features(rows: DataFrame) -> DataFrame:
    """The same rows; one whose `x` holds no value fails the job."""
    empty = F.col("x").isNull() | ~F.exists("x", lambda v: v.isNotNull())
    fail = F.raise_error(F.concat(F.lit("missing feature row for sample "), F.col("sample_id")))
    return rows.withColumn("x", F.when(F.coalesce(empty, F.lit(True)), fail).otherwise(F.col("x")))


def probe_view(fs: FeatureSet, backend: str) -> DataFrame:
    """(sample_id, probe, kind, probability_yes, probabilities): one row per probe of the probability mass."""
    pm = representation(fs, "probability_mass", backend)
    at = {n: i for i, n in enumerate(pm.names)}
    structs = []
    empty = F.create_map().cast("map<int,double>")
    for probe in probe_names(pm.names, backend):
        own = [n for n in pm.names if probe_name(n, backend) == probe]
        binary = own[0].endswith("__noul")
        pairs = [v for n in own if not binary for v in (F.lit(int(n.split("__p__")[1])), F.col("x")[at[n]])]
        structs.append(
            F.struct(
                F.lit(probe).alias("probe"),
                F.lit("binary" if binary else "score").alias("kind"),
                (F.col("x")[at[own[0]]] if binary else F.lit(None).cast("double")).alias("probability_yes"),
                (F.create_map(*pairs) if pairs else empty).alias("probabilities"),
            )
        )
    return pm.df.select("sample_id", F.explode(F.array(*structs)).alias("v")).select("sample_id", "v.*")


def profile_usage(meta: DataFrame, backend: str, input_price_per_million: float = 0.0) -> DataFrame:
    """One row: sample count, token and latency means and quantiles, token total and its price."""
    from pointsman.operators.ranking import exact_quantiles

    b = backend.rstrip("_")
    cols = {"input_tokens": f"meta_{b}_input_tokens", "latency_ms": f"meta_{b}_latency_ms"}
    tokens = cols["input_tokens"]
    price = input_price_per_million / 1_000_000.0
    one = meta.agg(
        F.count("*").alias("n_samples"),
        *[F.avg(c).alias(f"{k}_mean") for k, c in cols.items()],
        F.sum(tokens).alias("input_tokens_total"),
        (F.sum(tokens) * price).alias("estimated_input_cost_total"),
        (F.avg(tokens) * price).alias("estimated_input_cost_per_query"),
    )
    for k, c in cols.items():
        q = exact_quantiles(meta, c, [0.5, 0.95]).agg(
            F.max(F.when(F.col("share") == 0.5, F.col("value"))).alias(f"{k}_p50"),
            F.max(F.when(F.col("share") == 0.95, F.col("value"))).alias(f"{k}_p95"),
        )
        one = one.join(F.broadcast(q))
    return one
