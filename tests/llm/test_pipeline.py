"""The corpus pipeline, every stage beside brute force on its own input, over tables with planted cases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from pointsman.llm import packing, simhash_trie
from pointsman.llm.queries import tokenizer_path

SOURCE = "/root/testdata/sf0.001"


def words_of(t):
    return (t or "").lower().split()


def shingles(t, k=5):
    w = words_of(t)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def similar(a, b):
    return len(a & b) >= 0.8 * len(a | b)


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """Real rows with nulls, letterless, exact and near copies (many of one text), leaks, a long text and a clashing column."""
    rng = random.Random(11)
    at = tmp_path_factory.mktemp("sf")
    docs = pd.read_parquet(f"{SOURCE}/documents.parquet")
    bench = pd.read_parquet(f"{SOURCE}/benchmark.parquet")
    base = [t for t in docs["text"] if t and len(t.split()) > 80][:12]
    add = [None, "", "   ", "12 34 -- 5", base[0], base[0], base[1]]
    for k in range(40):  # one group of near copies
        w = base[2].split()
        w[rng.randrange(len(w))] = f"changed{k}"
        add.append(" ".join(w))
    for k in range(3, 9):
        w = base[k].split()
        add.append(" ".join(w[:-3] + ["another", "end"]))
        add.append(" ".join(w[: len(w) // 2]))  # half a text is no near copy
    leak = next(t for t in bench["text"] if len(t.split()) > 14)
    add += [f"some words before {leak} and after", " ".join(rng.choice("stone river walks bright field".split()) + str(k) for k in range(6000))]
    more = pd.DataFrame({"doc_id": range(10_000, 10_000 + len(add)), "text": add, "lang": "en", "source": "planted", "n_chars": 0})
    docs = pd.concat([docs, more], ignore_index=True)
    docs["i"], docs["fp"] = "clash", 1
    docs.to_parquet(f"{at}/documents.parquet")
    bench.to_parquet(f"{at}/benchmark.parquet")
    return str(at), docs, bench


@pytest.fixture(scope="module")
def stages(spark, tables, tmp_path_factory):
    """Rows of every stage's output, by name, each made of the one before."""
    at, docs, _ = tables
    out, name, rows = {"documents": docs}, "documents", spark.read.parquet(f"{at}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, rows, at).write.parquet(path)
        rows = spark.read.parquet(path)
        out[name] = rows.toPandas()
    return out


def test_language_drops_texts_without_letters(stages):
    want = {d for d, t in zip(stages["documents"]["doc_id"], stages["documents"]["text"]) if t and any(c.isalpha() for c in t)}
    assert set(stages["language"]["doc_id"]) == want


def test_columns_are_those_of_documents(stages):
    for name in ("language", "exact", "near", "leaks"):
        assert list(stages[name].columns) == list(stages["documents"].columns)


def test_of_equal_texts_the_largest_id_stays(stages):
    want = stages["language"].groupby("text")["doc_id"].max()
    assert sorted(stages["exact"]["doc_id"]) == sorted(want)


def test_one_of_similar_texts_stays(stages):
    sets = {d: shingles(t) for d, t in zip(stages["exact"]["doc_id"], stages["exact"]["text"])}
    kept = set(stages["near"]["doc_id"])
    links = {(a, b) for a in sets for b in sets if a < b and similar(sets[a], sets[b])}
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    assert len(links) > 40
    # Candidates come from fingerprints: pairs whose fingerprints differ in more bits than the budget may both stay.
    assert len([x for x in links if kept.issuperset(x)]) <= 0.1 * len(links)
    assert len(kept & set(range(10_007, 10_047))) <= 1
    assert all(near[d] & kept for d in set(sets) - kept)


def test_leaks_go_and_clean_texts_stay(stages, tables):
    words = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or "")) if w]
    spans = set()
    for t in tables[2]["text"]:
        w = words(t)
        spans |= {tuple(w[i : i + min(10, len(w))]) for i in range(len(w) - min(10, len(w)) + 1)} if w else set()
    sizes = {len(s) for s in spans}
    bad = {d for d, t in zip(stages["near"]["doc_id"], stages["near"]["text"]) if any(tuple(w[i : i + n]) in spans for w in [words(t)] for n in sizes for i in range(len(w) - n + 1))}
    assert bad and set(stages["leaks"]["doc_id"]) == set(stages["near"]["doc_id"]) - bad


def test_packing_covers_every_token_once(stages):
    tokens = packing._Tokens(tokenizer_path())
    pieces, rest = stages["packing"], stages["leaks"]
    want = {d: len(tokens.ids(t)) // 4 + 1 for d, t in zip(rest["doc_id"], rest["text"])}
    by_doc = defaultdict(list)
    for p in pieces.itertuples():
        by_doc[p.doc_id].append((p.start, p.length))
        assert p.doc_tokens == want[p.doc_id]
    assert set(by_doc) == set(want)
    for d, parts in by_doc.items():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(parts[-1]) == want[d]
    filled = Counter()
    for p in pieces.itertuples():
        filled[p.sequence_id] += p.length
    assert max(filled.values()) <= 1024


def test_run_is_its_stages(spark, tables, stages):
    got = corpus_pipeline.run(spark, tables[0]).toPandas()
    key = ["doc_id", "start", "length", "ids_crc32"]
    assert got.groupby("doc_id")["length"].sum().equals(stages["packing"].groupby("doc_id")["length"].sum())
    assert set(got["doc_id"]) == set(stages["leaks"]["doc_id"]) and set(key) <= set(got.columns)


def test_empty_documents(spark, tables, tmp_path):
    at, docs, bench = tables
    docs[docs["source"] == "planted"].head(4).to_parquet(f"{tmp_path}/documents.parquet")
    bench.to_parquet(f"{tmp_path}/benchmark.parquet")
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, rows.limit(0), str(tmp_path)).count() == 0, name


def test_dense_group_of_near_fingerprints(spark):
    """Rows of a dense group leave once they have found the first one; brute force over whole pairs."""
    rng = np.random.default_rng(3)
    centre = int(rng.integers(0, 1 << 63))
    fps = [centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(300)] + [int(x) for x in rng.integers(0, 1 << 63, 300)]
    fps = [f - (1 << 64) if f >= 1 << 63 else f for f in fps]
    sizes = [int(rng.integers(50, 60)) for _ in fps]
    rows = spark.createDataFrame([(i, f, int(np.log(s) / np.log(1.25))) for i, (f, s) in enumerate(zip(fps, sizes))], "i long, fp long, class long")
    bits = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1")
    want = {}
    for i, f in enumerate(fps):
        near = [j for j in range(i) if bits(f, fps[j]) <= 12]
        if near:
            want[i] = near[0]
    for leaf in (100_000, 60):  # with a small leaf, prefixes of several bits
        assert {r.i: r.m for r in simhash_trie._first_neighbours(rows, 12, leaf).collect()} == want
        marked = rows.selectExpr("*", "i % 7 = 0 as asks")
        got = {(r.i, r.hub) for r in simhash_trie._asked(marked, 12, leaf).collect()}
        assert got == {(i, j) for i in range(600) for j in range(0, 600, 7) if i % 7 and bits(fps[i], fps[j]) <= 12}


def test_rounds_keep_what_taking_rows_in_order_keeps(spark, stages, monkeypatch):
    docs = spark.createDataFrame(stages["exact"][["doc_id", "text"]])
    whole = sorted(r.doc_id for r in simhash_trie.one_of_each(docs).collect())
    monkeypatch.setattr(simhash_trie, "LAST", 0)
    assert sorted(r.doc_id for r in simhash_trie.one_of_each(docs).collect()) == whole


def test_pairs_are_searched_in_little_memory():
    """What waits to be compared is a few megabytes, whatever the number of fingerprints."""
    import tracemalloc

    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 12_000, dtype=np.uint64)
    v = np.sort(np.concatenate([base, base[:4000] ^ (np.uint64(1) << rng.integers(0, 64, 4000).astype(np.uint64))]))
    tracemalloc.start()
    pairs = {(int(i), int(j)) for x, y in simhash_trie.quarter_pairs(v, v, 15) for i, j in zip(x, y, strict=True) if i != j}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6
    # All that differ in one bit are among them if it is in the leading quarter or none is.
    one = {(i, j) for i, j in pairs if int(v[i] ^ v[j]).bit_count() == 1}
    assert len(one) == 8000


def test_sketches_never_rule_out_similar_sets():
    rng = np.random.default_rng(2)
    ruled_out = 0
    for _ in range(3000):
        n = int(rng.integers(0, 400))
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) << np.uint64(1))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < rng.random()], rng.integers(0, 1 << 63, int(rng.integers(0, 60))).astype(np.uint64)]))
        may = simhash_trie.may_be_alike(simhash_trie.sketch(x), simhash_trie.sketch(y), len(x), len(y), 0.8)
        assert may or not simhash_trie._alike(x, y, 0.8)
        ruled_out += not may
    assert ruled_out > 1000
    many = np.arange(1000, dtype=np.uint64)  # all in one range: no sketch, so nothing is ruled out
    assert simhash_trie.sketch(many) == b"" and simhash_trie.may_be_alike(b"", simhash_trie.sketch(x), 1000, len(x), 0.8)


def test_near_stage_makes_sets_of_candidates_only(spark, stages, monkeypatch):
    docs = spark.createDataFrame(stages["exact"][["doc_id", "text"]])
    sets, keep = [], simhash_trie.written

    def watched(df, name):
        out = keep(df, name)
        if "set" in out.columns:
            sets.append(out.count())
        return out

    monkeypatch.setattr(simhash_trie, "written", watched)
    monkeypatch.setattr(simhash_trie, "LAST", 0)
    kept = {r.doc_id for r in simhash_trie.one_of_each(docs).collect()}
    assert kept == set(stages["near"]["doc_id"])
    assert sets and max(sets) < docs.count() / 2
