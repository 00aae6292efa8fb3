"""A trie of conversation prefixes, built by a van Emde Boas recursion.

A trie of depth 2^k is cut at half its depth: the upper trie holds the first halves of all sequences,
and below every cut prefix hangs a lower trie of the second halves, a forest whose roots are the names of
the cut prefixes. Both halves are cut again, all tries of a depth in parallel, down to single turns. A
prefix of d turns thus ends a chain of cuts, one for each bit of d: its name is made of the name of the
cut it hangs below (d without its lowest bit) and the name of the whole block of turns between. A block's
name is made of those of its halves. Names are 128-bit digests, so equal prefixes of different
conversations get equal names in tasks that never meet.

Going up again, totals are grafted: what the lower tries of a level hold in all is added to their root
and to the nodes between it and the top of the upper trie, for one level after the other. Each level is one
aggregation by parent and one by name; a cut prefix reaches at most half the depth of nodes, so a level
has at most half as many additions as there are turns.

Sequences are dealt in chunks of 64 turns, which a task cuts by itself. Longer sequences give a sequence
of chunk names, which is dealt in chunks in its turn, so no task ever holds a whole long conversation.
Positions come from a global sort by ranges; a conversation may span many of them. Parents with many
children and conversations with many turns are joined by broadcast (`attach`). The members that end in
a node are sorted by ranges and joined to texts before those of a node meet, and are hashed as a stream.

Defined cases: a null role or text is empty; turns are ordered with null first, equal ones by a digest of
role and text, and repeated rows count as turns of their own; rows with a null conv_id are left out; a
conversation without turns is a member of the root; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from binascii import b2a_base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointsman.llm.common import attach
from pointsman.session import join_checked, written

#: Turns of a chunk, a power of two.
CHUNK = 64
#: Most original turns that a conversation takes from another one.
HEAD = 8
ROOT = "root"


# ---- names within a chunk -------------------------------------------------------------------


def _name(a: str, b: str) -> str:
    return b2a_base64(hashlib.blake2b(f"{a} {b}".encode(), digest_size=16).digest(), newline=False)[:22].decode()


def block(keys: list[str]) -> str:
    """The name of a whole block of 2^k keys, of the names of its halves."""
    if len(keys) == 1:
        return keys[0]
    half = len(keys) // 2
    return _name(block(keys[:half]), block(keys[half:]))


def prefixes(root: str, keys: list[str], size: int) -> list[str]:
    """Names of all prefixes of `keys` below `root`, in a trie of depth `size` (a power of two): cut at half, name the cut, recur above and below."""
    if not keys:
        return []
    if size == 1:
        return [_name(root, keys[0])]
    half = size // 2
    if len(keys) < half:
        return prefixes(root, keys, half)
    cut = _name(root, block(keys[:half]))
    return prefixes(root, keys[: half - 1], half) + [cut] + prefixes(cut, keys[half:], half)


# ---- sequences ------------------------------------------------------------------------------


def _bounded(turns: Column) -> Column:
    return F.array_sort(F.collect_list(turns))


def named(items: DataFrame, kind: str, chunk: int = CHUNK) -> DataFrame:
    """(id, chunk, root, keys, names): chunks of the sequences in `items` (id, i, key), the name each chunk hangs below and those of its prefixes."""
    if chunk < 2:
        raise ValueError("a chunk has two turns at least")
    grouped = items.groupBy("id", F.floor(F.col("i") / chunk).alias("chunk")).agg(_bounded(F.struct("i", "key")).alias("s"))
    chunks = written(grouped.select("id", "chunk", F.col("s.key").alias("keys")), "trie-chunks")
    text = F.lit(None).cast("string")
    if (chunks.agg(F.max("chunk")).first()[0] or 0) > 0:

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                names = [block(k) for k in b.column("keys").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("chunk"), pa.array(names, pa.string())], ["id", "i", "key"])

        full = chunks.where(F.size("keys") == chunk)
        above = named(full.mapInArrow(whole, f"id {kind}, i long, key string"), kind, chunk)
        # A whole chunk hangs below the name before its own, and its last prefix has its own; after the last whole one there may be a rest.
        each = above.select("id", "chunk", "root", "names", F.explode(F.sequence(F.lit(0), F.size("names"))).alias("k"))
        before = F.when(F.col("k") == 0, F.col("root")).otherwise(F.element_at("names", F.greatest(F.col("k"), F.lit(1))))
        own = F.when(F.col("k") < F.size("names"), F.element_at("names", F.least(F.col("k") + 1, F.size("names"))))
        each = each.select("id", (F.col("chunk") * chunk + F.col("k")).alias("chunk"), before.alias("root"), own.alias("last"))
        ends = each.groupBy("id", "chunk").agg(F.max("root").alias("root"), F.max("last").alias("last"))
        chunks = chunks.join(ends, ["id", "chunk"], "left").withColumn("root", F.coalesce("root", F.lit(ROOT)))
    else:
        chunks = chunks.withColumn("root", F.lit(ROOT)).withColumn("last", text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for root, last, keys in zip(*(b.column(c).to_pylist() for c in ("root", "last", "keys")), strict=True):
                names = prefixes(root, keys, 2 * chunk)
                if last:
                    names[-1] = last
                out.append(names)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("id", "chunk", "root", "keys")], pa.array(out, pa.list_(pa.string()))], ["id", "chunk", "root", "keys", "names"])

    return chunks.select("id", "chunk", "root", "last", "keys").mapInArrow(run, f"id {kind}, chunk long, root string, keys array<string>, names array<string>")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, i, key, size): every turn of the rebuilt conversations with its place from 0, a digest of role and text and its text's bytes; (id, depth) of all conversations.

    Each conversation takes the first h turns (crc32 of its decimal id, modulo 9) of the one of its five with the smallest id,
    and goes on with its own turns after its first h.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    key = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").alias("id"), "turn", key.alias("key"), F.octet_length(text).cast("long").alias("size"), F.monotonically_increasing_id().alias("row")
    )
    order = [F.col("id"), F.col("turn").asc_nulls_first(), F.col("key"), F.col("row")]
    # Only numbers and digests are sorted, and equal turns may part: no range grows with one conversation.
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    placed = written(dealt.select("id", "key", "size", F.shiftright(at, 33).alias("part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "trie-sorted")
    # One row for each range.
    total, starts = 0, []
    for part, n in sorted((r["part"], r["count"]) for r in placed.groupBy("part").count().collect()):
        starts.append((part, total))
        total += n
    offsets = placed.sparkSession.createDataFrame(starts, "part long, before long")
    ranked = join_checked(placed, offsets, "part").select("id", "key", "size", (F.col("before") + F.col("at")).alias("rank"))

    base = F.col("id") - F.col("id") % 5
    h = F.crc32(F.col("id").cast("string").cast("binary")) % (HEAD + 1)
    known = written(ranked.groupBy("id").agg(F.min("rank").alias("first"), F.count("*").alias("n")).select("*", base.alias("base"), h.alias("h")), "trie-conversations")
    given = known.where("id = base").select("base", F.col("n").alias("most"))
    known = known.join(given, "base", "left").withColumn("has", F.least(F.coalesce("most", F.lit(0).cast("long")), F.col("h"))).drop("most")
    known = written(known, "trie-rebuilt")
    depth = F.when(F.col("id") == F.col("base"), F.col("n")).otherwise(F.col("has") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))

    turns = attach(ranked, known, "id", "n", total, F.col("rank")).withColumn("i", F.col("rank") - F.col("first"))
    turns = written(turns.select("id", "i", "key", "size", "base", "h", "has"), "trie-turns")
    whole = turns.where("id = base")
    own = turns.where("id != base and i >= h").withColumn("i", F.col("i") - F.col("h") + F.col("has"))
    heads = whole.where(F.col("i") < HEAD).select("base", "i", "key", "size")
    heads = heads.join(known.where("id != base").select("id", "base", "has"), "base").where("i < has")
    columns = ["id", "i", "key", "size"]
    return whole.select(*columns).unionByName(heads.select(*columns)).unionByName(own.select(*columns)), known.select("id", depth.alias("depth"))


# ---- totals ---------------------------------------------------------------------------------


def grafted(nodes: DataFrame, paths: DataFrame, deepest: int, chunk: int = CHUNK) -> DataFrame:
    """(name, leaves, saved): additions to the nodes' own leaf and saved tokens, which sum up to the totals of their subtrees.

    `nodes`: name, parent, depth, id (a member), leaves, saved; `paths`: id, chunk, root, names.
    """
    found = nodes.select("name", "parent", "depth", "id", "leaves", "saved")
    half = 1
    while half < deepest:
        # Tops of the lower tries of this level: one turn below a cut.
        tops = found.where(F.col("depth") % (2 * half) == (half + 1) % (2 * half))
        below = tops.groupBy("parent").agg(F.min("id").alias("id"), F.min("depth").alias("depth"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        cuts = below.select("id", (F.col("depth") - 1).alias("cut"), "leaves", "saved").where("leaves > 0 or saved > 0")
        if half <= chunk:
            cuts = cuts.withColumn("chunk", F.floor((F.col("cut") - 1) / chunk))
        else:
            cuts = cuts.withColumn("chunk", F.explode(F.sequence(F.floor((F.col("cut") - half) / chunk), F.floor((F.col("cut") - 1) / chunk))))
        span = min(half, chunk)
        # In a chunk, the nodes above the cut: the last `span` names up to it.
        last = F.when(F.lit(half <= chunk), (F.col("cut") - 1) % chunk).otherwise(F.lit(chunk - 1)).cast("int")
        joined = cuts.join(paths.select("id", "chunk", "root", "names"), ["id", "chunk"])
        steps = joined.select("id", "chunk", "leaves", "saved", "root", "names", F.explode(F.sequence(last - (span - 1), last)).alias("k"))
        parent = F.when(F.col("k") == 0, F.col("root")).otherwise(F.element_at("names", F.greatest(F.col("k"), F.lit(1))))
        steps = steps.select(F.element_at("names", F.col("k") + 1).alias("name"), parent.alias("parent"), (F.col("chunk") * chunk + F.col("k") + 1).alias("depth"), "id", "leaves", "saved")
        added = steps.groupBy("name").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("id").alias("id"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        found = found.unionByName(written(added.select(*found.columns), "trie-grafts"))
        half *= 2
    # The whole is the lower forest of the root.
    tops = found.where("depth = 1").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    totals = found.groupBy("name").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    return totals.unionByName(tops.where("leaves is not null").select(F.lit(ROOT).alias("name"), "leaves", "saved"))


def listed_ends(ends: DataFrame) -> DataFrame:
    """(name, ends_sha256): the digest of the decimal ids of (name, id), ascending, joined with commas."""
    dealt = ends.repartitionByRange("name", "id").sortWithinPartitions("name", "id")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sorted rows: the ids of a name become texts of up to 16,384 ids.
        name, first, ids, out = None, None, [], []
        for b in batches:
            for n, i in zip(b.column("name").to_pylist(), b.column("id").to_pylist(), strict=True):
                if n != name or len(ids) >= 1 << 14:
                    if ids:
                        out.append((name, first, ",".join(ids)))
                    name, first, ids = n, i, []
                ids.append(str(i))
            if out:
                yield _pieces(out)
                out = []
        if ids:
            yield _pieces([(name, first, ",".join(ids))])

    def _pieces(rows: list[tuple]) -> pa.RecordBatch:
        n, i, t = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(n, pa.string()), pa.array(i, kind), pa.array(t, pa.string())], ["name", "id", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state, out = None, None, []
        for b in batches:
            for n, t in zip(b.column("name").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if n != name:
                    if name is not None:
                        out.append((name, state.hexdigest()))
                    name, state = n, hashlib.sha256()
                    state.update(t.encode())
                else:
                    state.update(b"," + t.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], ["name", "ends_sha256"])
                out = []
        if name is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([state.hexdigest()])], ["name", "ends_sha256"])

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(ends.schema["id"].dataType)
    pieces = dealt.select("name", "id").mapInArrow(join, f"name string, id {ends.schema['id'].dataType.simpleString()}, ids string")
    met = pieces.repartition("name").sortWithinPartitions("name", "id")
    return met.select("name", "ids").mapInArrow(digest, "name string, ends_sha256 string")


def trie(sequences: DataFrame, depths: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per node of the trie of `sequences` (id, i, key, size), `depths` (id, depth) naming all members.

    name, parent, depth, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    kind = depths.schema["id"].dataType.simpleString()
    items = sequences.select("id", "i", F.concat_ws(":", F.col("size").cast("string"), "key").alias("key"))
    paths = written(named(items, kind, chunk), "trie-paths")
    bare = paths.select("id", "chunk", "root", "names", F.posexplode("names").alias("k", "name"), "keys")
    parent = F.when(F.col("k") == 0, F.col("root")).otherwise(F.element_at("names", F.greatest(F.col("k"), F.lit(1))))
    size = F.substring_index(F.element_at("keys", F.col("k") + 1), ":", 1).cast("long")
    steps = bare.select("name", parent.alias("parent"), (F.col("chunk") * chunk + F.col("k") + 1).alias("depth"), "id", size.alias("size"))
    nodes = steps.groupBy("name").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("id").alias("id"), F.count("*").alias("n_convs"), F.first("size").alias("size"))
    nodes = written(nodes, "trie-nodes")
    children = nodes.groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "name", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = nodes.withColumn("leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("size"))
    nodes = written(nodes, "trie-counted")
    count, deepest = nodes.agg(F.count("*"), F.coalesce(F.max("depth"), F.lit(0))).first()
    totals = grafted(nodes, paths, deepest, chunk)

    # Ends: the last name of a sequence, the root for one without turns.
    at = depths.select("id", "depth", F.floor((F.col("depth") - 1) / chunk).alias("chunk"))
    ends = at.where("depth > 0").join(paths.select("id", "chunk", "names"), ["id", "chunk"]).select(F.element_at("names", ((F.col("depth") - 1) % chunk + 1).cast("int")).alias("name"), "id")
    ends = ends.unionByName(at.where("depth = 0").select(F.lit(ROOT).alias("name"), "id"))

    tops = nodes.where("depth = 1").agg(F.count("*").alias("n_children"))
    members = depths.agg(F.min("id").alias("id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    zero = F.lit(0).cast("long")
    root = members.crossJoin(tops).select(  # one row each
        F.lit(ROOT).alias("name"), F.lit(None).cast("string").alias("parent"), zero.alias("depth"), "id", "n_convs", zero.alias("size"), "n_children",
        (F.col("n_children") == 0).cast("long").alias("leaves"), zero.alias("saved"),
    )
    every = nodes.unionByName(root)
    parents = every.where("n_children > 0").select(F.col("name").alias("parent"), F.col("id").alias("parent_conv_id"), "n_children")
    below = attach(every.where("parent is not null").withColumnRenamed("n_children", "_own"), parents, "parent", "n_children", count, F.xxhash64("name"))
    below = below.drop("n_children").withColumnRenamed("_own", "n_children")
    every = below.unionByName(every.where("parent is null").withColumn("parent_conv_id", F.lit(None).cast(kind)))
    sums = totals.select("name", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    out = every.drop("size").join(sums, "name", "left").join(listed_ends(ends), "name", "left")
    return out.select(
        "name", "parent", "depth", F.col("id").alias("conv_id"), "parent_conv_id", "n_convs", "n_children",
        F.coalesce("n_leaves", "leaves").alias("n_leaves"), F.coalesce("saved_tokens", "saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The trie of the rebuilt conversations of (conv_id, turn, role, text)."""
    sequences, depths = rebuilt(conversations)
    return trie(sequences, depths, chunk)
