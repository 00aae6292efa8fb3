"""Reproducible pseudo-random draws from hashes, so a lost task redraws the same values."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TWO32 = 4294967296


def _col(part) -> Column:
    return part if isinstance(part, Column) else F.lit(str(part))


def hash_text(*parts) -> Column:
    """32 hex digits that depend on every part; ordering by it shuffles rows."""
    return F.md5(F.concat_ws(":", *[_col(p) for p in parts]))


def _hex8(text: Column, start: int) -> Column:
    return F.conv(F.substring(text, start, 8), 16, 10).cast("long")


def hash_int(*parts) -> Column:
    """Whole number in [0, 2^32)."""
    return _hex8(hash_text(*parts), 1)


def hash_unit(*parts) -> Column:
    """Number in [0, 1)."""
    return hash_int(*parts) / F.lit(float(TWO32))


#: Units that `mixed` can tell apart; draws among more of them would be uneven.
MIX_BITS = 31
MIX_LIMIT = 1 << 26


def mixed(key: Column, i: Column) -> Column:
    """Whole number in [0, 2^31) that depends on a 32-bit key and a counter below 2^31, in plain 64-bit arithmetic.

    One `hash_int` per key and a few multiplications per counter, where a digest per draw would cost a hundred times as much.
    """
    mask = F.lit((1 << MIX_BITS) - 1)
    x = (i * F.lit(2654435761) + key).bitwiseAND(mask)
    x = (x.bitwiseXOR(F.shiftright(x, 15)) * F.lit(739982445)).bitwiseAND(mask)
    x = (x.bitwiseXOR(F.shiftright(x, 12)) * F.lit(695872825)).bitwiseAND(mask)
    return x.bitwiseXOR(F.shiftright(x, 15))


#: Draws made at a time; small enough for a core's cache.
DRAWS_AT_ONCE = 1 << 16


def drawn_sums(keys: np.ndarray, n: int, low: int, values: np.ndarray) -> np.ndarray:
    """(values, keys): per key the sums of `values` over n draws of slots, `mixed(key, i) % n` for i below n.

    `values` holds the slots from `low` on, and one more that takes the draws of all others. Only the low 31 bits
    of each product count, so 32-bit arithmetic that wraps around gives the same numbers as `mixed`.
    """
    mask, last = np.uint32((1 << MIX_BITS) - 1), np.uint32(values.shape[1] - 1)
    out = np.zeros((len(values), len(keys)))
    for start in range(0, n, DRAWS_AT_ONCE):
        i = np.arange(start, min(n, start + DRAWS_AT_ONCE), dtype=np.uint32) * np.uint32(2654435761)
        step = max(1, DRAWS_AT_ONCE // len(i))
        for at in range(0, len(keys), step):
            x = (i + keys[at : at + step, None]) & mask
            x = ((x ^ (x >> np.uint32(15))) * np.uint32(739982445)) & mask
            x = ((x ^ (x >> np.uint32(12))) * np.uint32(695872825)) & mask
            x ^= x >> np.uint32(15)
            x -= x // np.uint32(n) * np.uint32(n)
            # Slots below `low` wrap around to large numbers.
            x = np.minimum(x - np.uint32(low), last)
            for k, v in enumerate(values):
                out[k, at : at + step] += v[x].sum(axis=1)
    return out


def stable_seed(*parts, modulo: int = 2_147_483_647) -> Column:
    """Seed from the first 64 bits of the SHA-256 of the parts as a JSON list, mod `modulo`."""
    if modulo <= 1:
        raise ValueError("modulo must be > 1")
    texts = []
    for p in parts:
        c = p if isinstance(p, Column) else F.lit(p)
        one = F.to_json(F.array(c))
        texts.append(F.substring(one, F.lit(2), F.length(one) - 2))
    digest = F.sha2(F.concat(F.lit("["), F.concat_ws(",", *texts), F.lit("]")), 256)
    high, low = _hex8(digest, 1), _hex8(digest, 9)
    return (high % modulo * (TWO32 % modulo) + low) % modulo


_MD5_TURNS = [t for turns in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in turns * 4]
_MD5_ADDED = [int(abs(np.sin(i + 1)) * TWO32) for i in range(64)]
#: Bytes that one block of MD5 holds beside its end mark and length.
MD5_BLOCK = 55


def _md5_first(words: list) -> np.ndarray:
    """The first digest word of one-block messages, whose 16 words are arrays or whole numbers; three of the 64 steps do not reach it."""
    n = next(len(w) for w in words if isinstance(w, np.ndarray))
    a, b, c, d = (np.full(n, v, np.uint32) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(61):
        if i < 16:
            k = i
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            k = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            k = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            k = 7 * i % 16
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        added = _MD5_ADDED[i]
        if isinstance(words[k], np.ndarray):
            np.add(f, words[k], out=f)
        else:
            added = (added + words[k]) % TWO32
        np.add(f, a, out=f)
        np.add(f, np.uint32(added), out=f)
        np.right_shift(f, np.uint32(32 - _MD5_TURNS[i]), out=t)
        np.left_shift(f, np.uint32(_MD5_TURNS[i]), out=f)
        np.bitwise_or(f, t, out=f)
        np.add(f, b, out=f)
        # What was `a` is not needed any more: its place takes the next sum.
        a, b, c, d, f = d, f, b, c, a
    return b + np.uint32(0x67452301)


def hash_ints(heads: list[bytes], texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """For each head `hash_int(head, text)` of all texts, as 32-bit numbers.

    Texts that fit into one block are hashed together, a step of the digest for all of them at a time; others one by one.
    """
    lengths = np.array([-1 if t is None else len(t) for t in texts], np.int64)
    # The longest of several heads decides which texts fit.
    room = MD5_BLOCK - 1 - max((len(h) for h in heads), default=0)
    short = np.flatnonzero((lengths >= 0) & (lengths <= room))
    others = np.flatnonzero((lengths < 0) | (lengths > room))
    laid: dict[int, list] = {}
    sizes = lengths[short]
    wide = int(sizes.max(initial=0)) + 1
    ends = np.cumsum(sizes)
    flat = np.frombuffer(b"".join(texts[i] for i in short), np.uint8)
    row, place = np.repeat(np.arange(len(short)), sizes), np.arange(len(flat)) - np.repeat(ends - sizes, sizes)
    own = np.zeros((len(short), wide), np.uint8)
    own[row, place] = flat
    own[np.arange(len(short)), sizes] = 0x80
    for head in heads:
        out = np.empty(len(texts), np.uint32)
        if len(short):
            at = len(head) + 1
            if at not in laid:
                block = np.zeros((len(short), 64), np.uint8)
                block[:, at : at + wide] = own
                words = block.view("<u4")
                words[:, 14] = 8 * (at + sizes)
                # Words that are the same in all messages are numbers.
                laid[at] = [int(w[0]) if (w == w[0]).all() else w for w in np.ascontiguousarray(words.T).astype(np.uint32)]
                if not any(isinstance(w, np.ndarray) for w in laid[at]):
                    laid[at][0] = np.full(len(short), laid[at][0], np.uint32)
            front = np.frombuffer((head + b":").ljust(64, b"\0"), "<u4").tolist()
            words = [w | np.uint32(v) if isinstance(w, np.ndarray) else w | v for w, v in zip(laid[at], front, strict=True)]
            out[short] = _md5_first(words).byteswap()
        for i in others:
            out[i] = int.from_bytes(md5_digest(head, texts[i])[:4], "big")
        yield out


def md5_digest(head: bytes, text: bytes | None) -> bytes:
    """The digest whose hex digits `hash_text(head, text)` gives; a null text is left out."""
    return hashlib.md5(head if text is None else b"%b:%b" % (head, text), usedforsecurity=False).digest()
