"""One query per operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointsman.llm import (
    byte_bpe, exact_stream, language, line_join, packing, prefix_trie, sharding, simhash_trie, suffix_runs, surrogates, toxicity, vector_codes, winnowing,
)
from pointsman.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with personal data replaced."""
    out = surrogates.pseudonymized(table(spark, sf_dir, "documents"), key="op1")
    return out.select("doc_id", "text", F.size("entities").alias("n_entities"), "entities")


@_query
def op2_max_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; learned from labels outside the held-out fold."""
    out = toxicity.toxic_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted", "n_tokens", "evidence", F.size("passages").alias("n_passages"))


@_query
def op3_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents dealt into 40 shards; law `rows`: counts differ by one at most."""
    out = sharding.interleave(table(spark, sf_dir, "documents"), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@_query
def op4_line_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents, of any length, within two edits of an earlier line are dropped."""
    return line_join.without_near_lines(table(spark, sf_dir, "documents"), threshold=2, shortest=0)


def tokenizer_path() -> str:
    """The vocabulary file of the packing query, of the public tokenizers installed beside the library."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@_query
def op5_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), window=1024)


@_query
def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against the benchmark, spans of ten words."""
    out = winnowing.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), span=10)
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


SQL["op6_winnowing"] = r"""
WITH tok AS (SELECT item_id::VARCHAR AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s
        FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM tok WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win), keys AS (SELECT n, s, list(DISTINCT item) AS items FROM win GROUP BY n, s),
doc AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
pos AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, lens)),
hit AS (SELECT doc_id, p.n, i, items FROM pos p JOIN keys k ON p.n = k.n AND p.s = k.s),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hit) GROUP BY doc_id),
names AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM (SELECT doc_id, unnest(items) AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN names USING (doc_id)
"""


@_query
def op7_exact_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts by keyed state; the largest doc_id of a group stays."""
    return exact_stream.exact_copies(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL["op7_exact_stream"] = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


@_query
def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(~language.held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    out = language.predict(docs, model)
    return out.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@_query
def op9_suffix_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of documents under 100-byte strings that start earlier are removed."""
    out = suffix_runs.without_repeats(table(spark, sf_dir, "documents"), width=100)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


@_query
def op10_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of three-word shingles, linked at three differing bits or fewer."""
    out = simhash_trie.near_copies(table(spark, sf_dir, "documents"), shingle=3, budget=3)
    return out.select("doc_id", simhash_trie.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


@_query
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings in 16 parts of 64 entries, after two rounds."""
    found = vector_codes.compressed(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2, scale=256)
    return vector_codes.with_label_error(found.rows).select(
        "vec_id", vector_codes.hexadecimal(F.col("codes")).alias("code"), "error", "label_error",
        F.sha2(F.lit(vector_codes.listed(found.codebooks)), 256).alias("codebooks_sha256"),
    )


_ROUND = """
a{k} AS (SELECT r, p, any_value(x) AS x, min(d * 64 + e) AS best FROM
         (SELECT r, part.p, part.x, e, list_sum(list_transform(range(1, len(part.x) + 1), lambda i: (part.x[i] - c.x[i]) * (part.x[i] - c.x[i])))::BIGINT AS d
          FROM part JOIN c{k} c ON part.p = c.p) GROUP BY r, p),
"""
_MEANS = """
c{n} AS (SELECT p, e, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN
         (SELECT p, e, list(mean ORDER BY i) AS x FROM
          (SELECT p, best % 64 AS e, i, floor(sum(x[i]) / count(*))::BIGINT AS mean FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM a{k}) GROUP BY p, best % 64, i)
          GROUP BY p, e) m USING (p, e)),
"""
SQL["op11_vector_codes"] = (
    """
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v, row_number() OVER (ORDER BY vec_id) AS r
              FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS (SELECT r, p, v[p * len(v) // 16 + 1:(p + 1) * len(v) // 16] AS x FROM kept, range(16) t(p)),
c0 AS (SELECT p, r - 1 AS e, x FROM part WHERE r <= 64),
"""
    + _ROUND.format(k=0) + _MEANS.format(k=0, n=1) + _ROUND.format(k=1) + _MEANS.format(k=1, n=2) + _ROUND.format(k=2)
    + """
coded AS (SELECT r, string_agg(lower(printf('%02x', best % 64)), '' ORDER BY p) AS code, sum(best // 64)::BIGINT AS error FROM a2 GROUP BY r),
books AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (r), books
"""
)


@_query
def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with a vocabulary for many languages and decoded again."""
    import public_tokenizers

    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@_query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of the prefixes of all rebuilt conversations."""
    out = prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


SQL["op13_prefix_trie"] = """
WITH turns AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS t FROM turns GROUP BY c),
checks AS (SELECT c, t, xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length(c::VARCHAR) + 1), lambda i: ascii(substr(c::VARCHAR, i, 1))::BIGINT),
           lambda a, b: list_reduce([xor(a, b)] || range(8), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) % 9 AS h FROM own),
seqs AS (SELECT a.c, CASE WHEN a.c % 5 = 0 THEN a.t ELSE coalesce(b.t, [])[1:a.h] || a.t[a.h + 1:] END AS s FROM checks a LEFT JOIN own b ON b.c = a.c - a.c % 5),
steps AS (SELECT c, d, s[1:d] AS p, d = len(s) AS ends FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM seqs)),
nodes AS (SELECT p, d, min(c) AS c, count(*) AS n, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '') AS e,
          CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * strlen(p[d].text) END AS saved FROM steps GROUP BY p, d),
kids AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS k FROM nodes WHERE d > 0 GROUP BY ALL),
full_nodes AS (SELECT nodes.*, coalesce(k, 0) AS k FROM nodes LEFT JOIN kids USING (p, d)),
totals AS (SELECT p[1:a] AS p, a AS d, count(*) FILTER (WHERE k = 0) AS leaves, sum(saved) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM full_nodes) GROUP BY ALL)
SELECT n.c AS conv_id, n.d AS depth, up.c AS parent_conv_id, n.n AS n_convs, n.k::BIGINT AS n_children, t.leaves AS n_leaves, t.saved::BIGINT AS saved_tokens, sha256(n.e) AS ends_sha256
FROM full_nodes n JOIN totals t ON t.p = n.p AND t.d = n.d LEFT JOIN nodes up ON n.d > 0 AND up.d = n.d - 1 AND up.p = n.p[1:n.d - 1]
"""
