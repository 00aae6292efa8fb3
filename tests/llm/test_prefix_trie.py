"""The trie of conversation prefixes beside dictionaries of tuples."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from pointsman.llm import prefix_trie, queries
from tests.oracle import connect, difference

SCHEMA = "conv_id long, turn long, role string, text string, name string, depth int"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    own = {c: [x[3] for x in sorted(t)] for c, t in own.items()}
    seqs = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        seqs[c] = t if c % 5 == 0 else own.get(c - c % 5, [])[:h] + t[h:]
    return nodes_of(seqs)


def nodes_of(seqs):
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(seqs):
        s = tuple(seqs[c])
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
        ends[s].append(str(c))
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    digest = lambda p: hashlib.sha256(",".join(ends[p]).encode()).hexdigest()
    return sorted((m[0], len(p), members[p[:-1]][0] if p else -1, len(m), kids[p], leaves[p], saved[p], digest(p)) for p, m in members.items())


def result(df):
    rows = df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()
    return sorted(tuple(-1 if x is None else x for x in r) for r in rows)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    say = lambda: (rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "ö", "", None]))
    out = []
    for c in [*range(0, 120), 203, 204, 1000, 1001]:
        out += [(c, t, *say(), "x", 1) for t in range(rng.randint(1, 12))]
    for c in range(300, 340):  # copies
        out += [(c, t, "user", f"same {t}", "x", 1) for t in range(5)]
    for c, n in ((400, 70), (401, 131), (402, 64), (405, 300), (406, 300), (410, 128)):  # long ones that share most of their turns
        out += [(c, t, "user", f"long {t if t < 60 + c % 7 * 9 else (t, c)}", "x", 1) for t in range(n)]
    out += [(501, 0, "user", "one", "x", 1), (7, None, "system", "null turn", "x", 1), (None, 1, "user", "no id", "x", 1), out[3], out[3], (9, 2, "user", "tie", "x", 1), (9, 2, "user", "tie 2", "x", 1)]
    return out


@pytest.fixture(scope="module")
def conversations(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.mark.parametrize("chunk", [64, 8])
def test_trie(conversations, rows, chunk):
    """Chunks of 8 turns make several levels of chunk names."""
    assert result(prefix_trie.conversation_trie(conversations, chunk)) == brute(rows)


def test_names_are_those_of_prefixes():
    keys = [str(i % 3) for i in range(40)]
    whole = prefix_trie.prefixes("r", keys, 64)
    assert len(set(whole)) == 40
    for n in range(41):
        assert prefix_trie.prefixes("r", keys[:n], 64) == whole[:n]
    assert prefix_trie.prefixes("r", keys[:16], 32)[-1] == whole[15]


def test_a_conversation_with_most_turns(spark):
    """One conversation spans many ranges and chunks; no task gets it whole."""
    rows = [(0, t, "user", "again", "x", 1) for t in range(700)] + [(c, t, "user", "again", "x", 1) for c in range(1, 20) for t in range(c)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = prefix_trie.conversation_trie(df, 16)
    assert result(got) == brute(rows)


def test_first_turn_of_most(spark):
    rows = [(c, t, "system", "hot" if t == 0 else f"{c % 50}", "x", 1) for c in range(0, 3000, 5) for t in range(3)]
    assert result(prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_without_turns(spark):
    """Conversation 7 takes nothing from an absent one and has no turn after its first h."""
    c = next(c for c in range(6, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    rows = [(c, 0, "user", "lost", "x", 1)]
    assert result(prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows) == [(c, 0, -1, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
    assert prefix_trie.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_lists_of_ends(spark, monkeypatch):
    df = spark.range(40_000).selectExpr("'n' as name", "id").unionByName(spark.createDataFrame([("m", 5)], "name string, id long"))
    got = {r.name: r.ends_sha256 for r in prefix_trie.listed_ends(df).collect()}
    assert got == {"n": hashlib.sha256(",".join(map(str, range(40_000))).encode()).hexdigest(), "m": hashlib.sha256(b"5").hexdigest()}


def test_query(spark):
    got = queries.op13_prefix_trie(spark, "/root/testdata/sf0.001").toPandas()
    assert difference(got, connect("/root/testdata/sf0.001").execute(queries.SQL["op13_prefix_trie"]).df()) is None
