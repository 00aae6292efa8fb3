"""Byte-level BPE encoding and decoding with two tiers of lookup.

A text is cut into pre-tokens by a pattern. The first tier is a minimal perfect hash over the
vocabulary: one multiplication and one displacement give the only slot a pre-token can have, and a
comparison of its bytes tells whether it is there. Pre-tokens that are no token go to the second
tier: their bytes are a linked list, a heap holds the rank of every neighbouring pair (leftmost
first among equal ranks), and the least is merged until no pair is a token.

Work is by Arrow batches. The pre-tokens of a run of texts are told apart first, so each distinct
one is looked up once a run; merges of up to `KEPT` pre-tokens are remembered in a worker. Runs hold at
most `RUN` pre-tokens: a text of any length is read as a stream of them, and its ids are hashed run by run.

The pattern is matched by another library than the one whose ids are to be met. Characters that only one
of the two takes for a letter, number or space (their Unicode tables differ in age) are found once by asking
both about all characters, and are replaced for the match by a character of the right kind.

Defined cases: a null or empty text has no ids; repeated rows are rows of their own; an empty table
gives an empty result; other columns are ignored. Decoding takes any ids of the vocabulary, others
are an error.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

#: Pre-tokens of one run, remembered merges of a worker, and characters of a text that is cut at once.
RUN, KEPT, WHOLE = 1 << 17, 1 << 19, 1 << 20
#: Classes of the pattern, and a character of each that no literal part of a pattern names (the last: none of them).
KINDS = {r"\p{L}": "\u0294", r"\p{N}": "\u0663", r"\s": "\u2003", "": "\u00a7"}
#: Texts that are turned into Python strings together.
SLICE = 1024
#: Keys of a bucket of the perfect hash, on average.
LOAD = 4
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: One per Python worker, vocabulary file and pattern.
_CODECS: dict[tuple[str, str], Codec] = {}


def _digest(key: bytes) -> int:
    return xxhash.xxh3_64_intdigest(key)


class PerfectHash:
    """A minimal perfect hash: n different keys to the slots 0 to n - 1 (hash and displace).

    Keys are put in buckets by their digest. Buckets are placed from the largest down, each with the
    first displacement that sends all its keys to free slots.
    """

    def __init__(self, keys: list[bytes]):
        self.n = len(keys)
        self.buckets = max(1, -(-self.n // LOAD))
        digests = np.array([_digest(k) for k in keys], np.uint64)
        if len(np.unique(digests)) < self.n:
            raise ValueError("keys must differ")
        self.displacement = np.zeros(self.buckets, np.uint64)
        bucket = self._bucket(digests)
        order = np.argsort(bucket, kind="stable")
        begin = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        free = np.ones(self.n, bool)
        for b in np.argsort(begin[:-1] - begin[1:], kind="stable"):
            own = digests[order[begin[b] : begin[b + 1]]]
            if not len(own):
                break
            self.displacement[b] = self._place(own, free)

    def _bucket(self, digests: np.ndarray) -> np.ndarray:
        return (digests % np.uint64(self.buckets)).astype(np.int64)

    def _slot(self, digests: np.ndarray, displacement: np.ndarray) -> np.ndarray:
        x = (digests ^ (displacement * _MIX)) * _STEP
        return ((x ^ (x >> np.uint64(29))) % np.uint64(self.n)).astype(np.int64)

    def _place(self, own: np.ndarray, free: np.ndarray) -> int:
        tries = 64
        for first in range(0, 1 << 40, tries):
            d = np.arange(first, first + tries, dtype=np.uint64)
            at = self._slot(own[None, :], d[:, None])
            ok = free[at].all(axis=1)
            for k in np.nonzero(ok)[0]:
                if len(set(at[k].tolist())) == len(own):
                    free[at[k]] = False
                    return int(d[k])
        raise ValueError("no displacement")

    def slots(self, keys: list[bytes]) -> np.ndarray:
        """The slot each key has if it is one of the hashed keys; any slot otherwise."""
        digests = np.fromiter(map(_digest, keys), np.uint64, len(keys))
        return self._slot(digests, self.displacement[self._bucket(digests)])


class Vocabulary:
    """Tokens by rank: ranks of byte strings through the perfect hash, byte strings of ranks by place."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = list(ranks)
        self.hash = PerfectHash(tokens)
        slots = self.hash.slots(tokens).tolist()
        self.token: list[bytes] = [b""] * len(tokens)
        self.rank: list[int] = [0] * len(tokens)
        for t, s in zip(tokens, slots, strict=True):
            self.token[s], self.rank[s] = t, ranks[t]
        self.bytes_of = {r: t for t, r in ranks.items()}
        # What two neighbouring parts make together, one at a time: a plain table.
        self._pair = ranks
        # Ranks of all byte strings of one and two bytes, which every merge starts from.
        self._one = self.ranks([bytes([a]) for a in range(256)])
        self._two = self.ranks([bytes([a, b]) for a in range(256) for b in range(256)])

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        """From a file of lines: base64 of the token, a space, its rank."""
        with open(path, "rb") as f:
            return cls({base64.b64decode(t): int(r) for t, r in map(bytes.split, f) if t})

    def ranks(self, keys: list[bytes]) -> list[int]:
        """Ranks of byte strings, -1 where one is no token."""
        token, rank = self.token, self.rank
        return [rank[s] if token[s] == k else -1 for k, s in zip(keys, self.hash.slots(keys).tolist(), strict=True)]

    def merged(self, piece: bytes) -> list[int]:
        """Ids of a byte string by merges: a heap over the pairs of a linked list of its parts."""
        n = len(piece)
        pair, two = self._pair.get, self._two
        # Part i begins at byte i and ends where its successor begins; ids of parts that were merged away are stale.
        after, before = list(range(1, n + 1)), list(range(-1, n))
        ids = [self._one[b] for b in piece]
        if -1 in ids:
            raise ValueError("the vocabulary lacks a single byte")
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := two[piece[i] << 8 | piece[i + 1]]) >= 0]
        heapify(heap)
        while heap:
            r, i, end = heappop(heap)
            j = after[i]
            # A pair counts only as it stands now: both parts there, ending where the pair ended when it was put in.
            if not alive[i] or j >= n or after[j] != end:
                continue
            ids[i], alive[j], after[i] = r, False, end
            if end < n:
                before[end] = i
                if (x := pair(piece[i : after[end]])) is not None:
                    heappush(heap, (x, i, after[end]))
            if (p := before[i]) >= 0 and (x := pair(piece[p:end])) is not None:
                heappush(heap, (x, p, end))
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out


def stand_ins() -> dict[int, str]:
    """For every character that the two libraries put in different classes, one both put where the encoder puts it."""
    import tiktoken

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    single = {bytes([b]): b for b in range(256)}
    kind: dict[str, list[str]] = {}
    for name in [k for k in KINDS if k]:
        # The encoder's ids of single bytes are the text its pattern matches.
        meant = set(bytes(tiktoken.Encoding(name, pat_str=name, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)).decode())
        seen = set(regex.findall(name, every))
        for c in meant ^ seen:
            kind.setdefault(c, [])
        for c in meant:
            if c in kind:
                kind[c] = [name]
    return {ord(c): KINDS[k[0] if k else ""] for c, k in kind.items()}


class Codec:
    def __init__(self, vocabulary: Vocabulary, pattern: str, instead: dict[int, str]):
        self.vocabulary = vocabulary
        self.pattern = regex.compile(pattern)
        self.instead = instead
        self.odd = frozenset(map(chr, instead))
        self.known: dict[bytes, list[int]] = {}

    def pieces(self, text: str) -> Iterator[str]:
        if not text.isascii() and not self.odd.isdisjoint(text):
            return (text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.instead)))
        if len(text) <= WHOLE:
            return iter(self.pattern.findall(text))
        return (m.group() for m in self.pattern.finditer(text))

    def merged(self, piece: bytes) -> list[int]:
        if (ids := self.known.get(piece)) is None:
            ids = self.vocabulary.merged(piece)
            if len(piece) <= 64:
                if len(self.known) >= KEPT:
                    self.known.clear()
                self.known[piece] = ids
        return ids

    def lookup(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of different pre-tokens: the perfect hash first, merges for those that are no token."""
        found = self.vocabulary.ranks(pieces)
        return [[r] if r >= 0 else self.merged(p) for p, r in zip(pieces, found, strict=True)]

    def ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a run of pre-tokens, and the number of ids of each."""
        words = pa.array(pieces, pa.large_string()).dictionary_encode()
        own = self.lookup([w.encode() for w in words.dictionary.to_pylist()])
        size = np.fromiter(map(len, own), np.int64, len(own))
        flat = np.fromiter((i for ids in own for i in ids), np.uint32, int(size.sum()))
        begin = np.cumsum(size) - size
        which = words.indices.to_numpy()
        n = size[which]
        at = np.repeat(begin[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return flat[at], n

    def runs(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
        """(position of the text, ids) in order; a text may come in several runs, or in none."""
        pieces, owners = [], []

        def done():
            ids, n = self.ids(pieces)
            ends = np.cumsum(n)
            stops = np.cumsum([k for _, k in owners])
            start = 0
            for (t, _), stop in zip(owners, stops, strict=True):
                end = int(ends[stop - 1])
                yield t, ids[start:end]
                start = end
            pieces.clear()
            owners.clear()

        for t, text in enumerate(texts):
            stream = self.pieces(text or "")
            while part := list(islice(stream, RUN - len(pieces))):
                pieces += part
                owners.append((t, len(part)))
                if len(pieces) >= RUN:
                    yield from done()
        if pieces:
            yield from done()

    def encode(self, text: str | None) -> np.ndarray:
        """All ids of a text."""
        return np.concatenate([np.zeros(0, np.uint32), *(ids for _, ids in self.runs([text]))])

    def decode(self, ids) -> bytes:
        known = self.vocabulary.bytes_of
        return b"".join([known[i] for i in (ids.tolist() if isinstance(ids, np.ndarray) else ids)])


def codec(path: str, pattern: str) -> Codec:
    """The codec of a vocabulary file, made once in a Python worker."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(Vocabulary.read(path), pattern, stand_ins())
    return _CODECS[path, pattern]


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the ids (array of integers) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in batches:
            for s in range(0, b.num_rows, SLICE):
                part = b.slice(s, SLICE)
                texts = part.column("text").to_pylist()
                ids: list[list[np.ndarray]] = [[] for _ in texts]
                for t, x in own.runs(texts):
                    ids[t].append(x)
                lists = [np.concatenate(x) if x else np.zeros(0, np.uint32) for x in ids]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lists, pa.list_(pa.int32()))], ["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decoded(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the bytes of every row's ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in batches:
            data = [own.decode(x or []) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(data, pa.binary())], ["doc_id", "data"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, data binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, SHA-256 of the ids (little-endian, 32 bits) and of the bytes they decode to, of every row; no ids leave the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in batches:
            for s in range(0, b.num_rows, SLICE):
                part = b.slice(s, SLICE)
                texts = part.column("text").to_pylist()
                count = [0] * len(texts)
                hashes = [(hashlib.sha256(), hashlib.sha256()) for _ in texts]
                for t, ids in own.runs(texts):
                    count[t] += len(ids)
                    hashes[t][0].update(ids.astype("<u4", copy=False).tobytes())
                    hashes[t][1].update(own.decode(ids))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(count, pa.int64()), pa.array([a.hexdigest() for a, _ in hashes]), pa.array([d.hexdigest() for _, d in hashes])],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
