"""Scalar columns on hand-made edge cases."""

import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from pointsman.functions import draws, numeric, text
from pointsman.operators import dedup, features, routing


def one(spark, column, **values):
    types = {str: "string", float: "double", int: "long"}
    schema = ", ".join(f"{k} {types[type(v)]}" for k, v in values.items()) or "z long"
    return spark.createDataFrame([tuple(values.values()) or (0,)], schema).select(column.alias("v")).first().v


def array(values):
    return F.array(*[F.lit(float(v)) for v in values]) if values else F.array().cast("array<double>")


@pytest.mark.parametrize(
    "p, want", [([1, 0, 0, 0], 0.0), ([0.25] * 4, 1.0), ([0.5, 0.5, 0, 0], 0.5), ([], 0.0), ([0], 0.0), ([1.0], 0.0)]
)
def test_entropy(spark, p, want):
    assert one(spark, numeric.entropy_norm(array(p))) == pytest.approx(want)


def test_binary_entropy(spark):
    assert one(spark, numeric.binary_entropy(F.col("p")), p=0.5) == pytest.approx(1.0)
    assert one(spark, numeric.binary_entropy(F.col("p")), p=0.0) == 0.0
    assert one(spark, numeric.binary_entropy(F.lit(None).cast("double"))) is None


def test_half_even(spark):
    rows = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (3.5,)], "x double")
    assert [r.v for r in rows.select(numeric.half_even(F.col("x")).alias("v")).collect()] == [0, 2, 2, 4]


@pytest.mark.parametrize("n, want", [(1, 1), (2, 1), (5, 2), (3, 2)])
def test_clamped_share(spark, n, want):
    assert one(spark, numeric.clamped_share(F.col("n"), 0.5), n=n) == want


@pytest.mark.parametrize("raw", ["  a\tb \r\n c ", "a\xa0b", "a\x1cb", " a ", "\xa0 ", "", "x　 y"])
def test_white_space_matches_python(spark, raw):
    row = spark.createDataFrame([(raw,)], "q string").select(
        text.collapse_ws(F.col("q")).alias("c"), text.query_hash(F.col("q")).alias("h"), text.is_blank(F.col("q")).alias("b")
    ).first()
    assert row.c == " ".join(raw.split())
    assert row.h == hashlib.sha256(" ".join(raw.split()).encode()).hexdigest()
    assert row.b == (not raw.strip())


def test_leakage_group_has_a_null_byte(spark):
    want = hashlib.sha256("d\0a b".encode()).hexdigest()
    assert one(spark, text.leakage_group(F.col("d"), F.col("q")), d="d", q=" a  b ") == want


def test_identity_text_keeps_the_text_as_it_is(spark):
    col = text.identity_text(F.col("p"), F.col("o"), "prompt")
    assert one(spark, col, p=" \n", o=" x ") == " x "
    assert one(spark, col, p=" p ", o="x") == " p "
    assert one(spark, col, p=" ", o="") is None


@pytest.mark.parametrize(
    "name, want", [("SWE-bench", "swe_bench"), (" Tau² Bench", "tau2"), ("MMLU-Pro", "mmlupro"), ("_A  b--C_", "a_b_c"), ("aime", "aime")]
)
def test_normalize_name(spark, name, want):
    assert one(spark, text.normalize_name(F.col("n")), n=name) == want


def test_filename_timestamp(spark):
    assert one(spark, text.filename_timestamp(F.col("p")), p="/a/x_20250102_030405.json") == 20250102030405
    assert one(spark, text.filename_timestamp(F.col("p")), p="/a/x.json") == 0


def test_stable_seed(spark):
    payload = json.dumps([7, "x é", 3], ensure_ascii=False, separators=(",", ":")).encode()
    want = int.from_bytes(hashlib.sha256(payload).digest()[:8], "big") % 2_147_483_647
    assert one(spark, draws.stable_seed(7, F.col("s"), F.col("k")), s="x é", k=3) == want


@pytest.mark.parametrize(
    "raw, want", [('{"b": 0.1, "10": 0.9}', [("b", 0.1), ("10", 0.9)]), ("[0.5, 0.25]", [("0", 0.5), ("1", 0.25)]), ("7", []), ("", [])]
)
def test_parse_probabilities(spark, raw, want):
    got = one(spark, features.parse_probabilities(F.col("r")), r=raw)
    assert [(e["key"], e["value"]) for e in got] == want


def test_levels_fall_back_to_position(spark):
    entries = features.parse_probabilities(F.col("r"))
    assert one(spark, features.levels_of(entries), r='{"low": 0.1, "7": 0.2, "high": 0.7}') == [0.0, 7.0, 2.0]


def test_relative_with_zero_is_null(spark):
    assert one(spark, numeric.safe_relative(F.col("a"), F.col("b")), a=1.0, b=0.0) is None
    assert one(spark, numeric.safe_relative(F.col("a"), F.col("b"), one_minus=True), a=1.0, b=2.0) == 0.5


def test_ties_go_to_the_first_candidate_in_code_point_order(spark):
    models = sorted(["cogito", "Qwen", "gemma"])
    assert models[0] == "Qwen"
    slot = routing.first_best(array([0.5, 0.2, 0.5]))
    assert one(spark, routing.name_at(models, slot)) == "Qwen"


def test_masked_candidate_is_never_picked_at_the_ends_of_the_grid(spark):
    quality = routing.masked(array([0.9, 0.1]), F.array(F.lit(None).cast("double"), F.lit(1.0)), array([1, 1]))
    for lam in (0.0, 1.0):
        value = routing.utilities(quality, array([0.0, 1.0]), F.lit(lam))
        assert one(spark, routing.first_best(value)) == 2


def test_margin_of_one_candidate_is_infinite(spark):
    assert one(spark, routing.margin(array([0.3]))) == math.inf


def test_same_priority_keeps_first_sample_and_last_outcome(spark):
    rows = spark.createDataFrame(
        [("a", "v1", 1), ("a", "v1", 2), ("a", "test", 3), ("b", "zzz", 4), ("b", "test", 5)], "k string, split string, seq long"
    )
    first = {r.k: r.seq for r in dedup.samples_by_priority(rows, ["k"], [F.col("seq")]).collect()}
    last = {r.k: r.seq for r in dedup.outcomes_by_priority(rows, ["k"], [F.col("seq")]).collect()}
    assert first == {"a": 1, "b": 5} and last == {"a": 2, "b": 5}


def test_hashes_of_many_texts_are_those_of_the_columns(spark):
    """Texts of every length around a block, empty and null ones, in any company."""
    texts = [None, b"", b"7", "äö".encode(), *(b"x" * n for n in (3, 40, 41, 42, 43, 44, 45, 55, 64, 200))]
    heads = [b"3407:0", b"3407:17", b"3407:999", b"seed:1"]
    for some in (texts, texts[:1], texts[1:2], [b"abc"] * 3, []):
        rows = [(i, None if t is None else t.decode()) for i, t in enumerate(some)]
        frame = spark.createDataFrame(rows, "i int, t string")
        for head, got in zip(heads, draws.hash_ints(heads, some), strict=True):
            rows = frame.orderBy("i").select(draws.hash_text(head.decode(), F.col("t")).alias("h"), draws.hash_int(head.decode(), F.col("t")).alias("n")).collect()
            assert got.tolist() == [r.n for r in rows]
            assert [draws.md5_digest(head, t).hex() for t in some] == [r.h for r in rows]
