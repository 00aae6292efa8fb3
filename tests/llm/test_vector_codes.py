"""Active-entry rounds beside full ones, in plain integers."""

import math
import random

import numpy as np
import pytest

from pointsman.llm import queries, vector_codes
from tests.oracle import connect, difference


def brute(rows, parts, entries, rounds, scale):
    """Codes, errors and codebooks by full scans of Python integers."""
    kept = [(v, lab, [math.floor(scale * float(np.float32(x))) for x in e]) for v, lab, e in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    w = -(-max(len(e) for *_, e in kept) // parts)
    kept = [(v, lab, e + [0] * (parts * w - len(e))) for v, lab, e in kept]
    cut = lambda e, p: e[p * w : (p + 1) * w]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0))[:entries]
    books = [[cut(e, p) for *_, e in first] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = [[] for _ in books[p]]
            for *_, e in kept:
                own[near(cut(e, p), books[p])[1]].append(cut(e, p))
            books[p] = [[sum(c) // len(o) for c in zip(*o)] if o else b for o, b in zip(own, books[p])]
    out = []
    for v, lab, e in kept:
        best = [near(cut(e, p), books[p]) for p in range(parts)]
        out.append((v, lab, [k for _, k in best], sum(d for d, _ in best)))
    return out, books


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    vector = lambda: [rng.choice([-1.5, 0.25, rng.gauss(0, 1), rng.gauss(0, 0.01)]) for _ in range(8)]
    out = [(i, rng.choice([None, 1, 1, 2]), vector()) for i in range(300)]
    out += [(300 + i, 7, out[5][2]) for i in range(60)]  # a hot vector
    out += [(400, 1, None), (401, 1, [None] * 8), (402, 1, [float("nan"), *[0.0] * 7]), (403, 2, [float("inf"), *[0.0] * 7]), (404, None, [0.5] * 6), (405, 3, []), (None, None, vector()), out[9]]
    return out


@pytest.fixture(scope="module")
def vectors(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, label int, embedding array<float>, codes string, error int").repartition(5)


@pytest.mark.parametrize("parts, entries, rounds", [(4, 8, 3), (4, 64, 2), (1, 5, 4), (2, 1000, 1), (4, 8, 0)])
def test_codes(vectors, rows, parts, entries, rounds):
    found = vector_codes.compressed(vectors, parts=parts, entries=entries, rounds=rounds)
    want, books = brute(rows, parts, entries, rounds, 256)
    assert found.codebooks.tolist() == books
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or 0, r[2])
    assert sorted(((r.vec_id, r.label, r.codes, r.error) for r in found.rows.collect()), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("limit", [vector_codes.BROADCAST_ROWS, 0])
def test_label_errors(vectors, limit, monkeypatch):
    monkeypatch.setattr(vector_codes, "BROADCAST_ROWS", limit)
    rows = vector_codes.compressed(vectors, parts=4, entries=8).rows
    got = vector_codes.with_label_error(rows).collect()
    each = rows.collect()
    assert len(got) == len(each)
    for r in got:
        assert r.label_error == sum(x.error for x in each if x.label == r.label)


def test_active_entries_give_the_codes_of_full_scans():
    """Coarse integers with many ties; every set of moved entries."""
    rng = np.random.default_rng(2)
    for _ in range(200):
        x, a = rng.integers(-3, 4, (50, 2)), rng.integers(-3, 4, (9, 2))
        moved = np.nonzero(rng.random(9) < rng.random())[0]
        b = a.copy()
        b[moved] = rng.integers(-3, 4, (len(moved), 2))
        code, error = vector_codes.reassigned(x, b, moved, *vector_codes.nearest(x, a))
        want = vector_codes.nearest(x, b)
        assert (code == want[0]).all() and (error == want[1]).all()


def test_large_components_are_exact(spark):
    rng = random.Random(8)
    rows = [(i, 0, [rng.choice([-1, 1]) * rng.random() * 5e5 for _ in range(8)]) for i in range(40)]
    found = vector_codes.compressed(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>"), parts=2, entries=6)
    want, books = brute(rows, 2, 6, 2, 256)
    assert found.codebooks.tolist() == books and sorted(r.error for r in found.rows.collect()) == sorted(w[3] for w in want)
    huge = spark.createDataFrame([(1, 0, [3e38, -3e38]), (2, 0, [0.0, 1.0])], "vec_id long, label int, embedding array<float>")
    assert vector_codes.compressed(huge, parts=1, entries=1, rounds=0).rows.where("vec_id = 1").first().error == 0


def test_no_vectors(vectors):
    for v in (vectors.limit(0), vectors.where("embedding is null")):
        found = vector_codes.compressed(v)
        assert found.codebooks.shape[:2] == (16, 0) and vector_codes.with_label_error(found.rows).count() == 0


def test_decoding(vectors):
    found = vector_codes.compressed(vectors, parts=4, entries=8)
    for r in vector_codes.decoded(found.rows, found.codebooks).join(found.rows.select("vec_id", "codes"), "vec_id").collect():
        assert r.vector == [x / 256 for p, c in enumerate(r.codes) for x in found.codebooks[p, c].tolist()]


def test_query(spark):
    got = queries.op11_vector_codes(spark, "/root/testdata/sf0.001").toPandas()
    assert difference(got, connect("/root/testdata/sf0.001").execute(queries.SQL["op11_vector_codes"]).df()) is None
    assert got["code"].str.len().eq(32).all()
