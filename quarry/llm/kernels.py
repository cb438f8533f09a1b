"""Numpy kernels over many texts at once: words, rolling hashes, windows, minima."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_MULT = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INV = pow(_MULT, -1, 1 << 64)
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
#: space and \x09-\x0D
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}
KEPT = 1 << 20


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; tables of up to KEPT numbers are kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=U64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=U64)
        if len(have) <= KEPT:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: all bits of the input reach all bits of the output."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = hash of buf[i:j] times MULT**i, modulo 2**64."""
    out = np.zeros(len(buf) + 1, dtype=U64)
    np.cumsum(_BYTES[buf] * powers(_MULT, len(buf)), out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of buf[start:end], equal for equal bytes wherever they stand."""
    inv = powers(_INV, len(prefix))
    return mix((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(U64))


def joined(texts: list[bytes], gap: bytes = b"\n") -> tuple[np.ndarray, np.ndarray]:
    """One buffer of all texts, each followed by a gap byte, and where each starts."""
    sizes = np.fromiter((len(t) + len(gap) for t in texts), dtype=np.int64, count=len(texts))
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(sizes, out=starts[1:])
    return np.frombuffer(gap.join([*texts, b""]), dtype=np.uint8), starts


def words(buf: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that are no separators."""
    edge = np.zeros(len(buf) + 2, dtype=np.int8)
    edge[1:-1] = ~separator[buf]
    step = np.diff(edge)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, first, starts): of each word its hash and place in the joined
    buffer; words of text i are first[i]:first[i+1]; starts as joined() gives them."""
    buf, starts = joined(texts)
    if lower:
        buf = LOWER[buf]
    s, e = words(buf)
    return range_hash(prefix_hash(buf), s, e), s, e, np.searchsorted(s, starts), starts


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive items, across text borders too (the caller masks)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=U64)
    out = hashes[:m].copy()
    for j in range(1, n):
        out *= U64(0xD6E8FEB86659FD93)
        out += hashes[j : j + m]
    return mix(out)


def text_ids(first: np.ndarray) -> np.ndarray:
    """For each item the number of its text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def shingle_sets(texts: list[bytes], n: int, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of all word n-shingles; a text of fewer words gives its whole
    sequence as one shingle, and a text without words none."""
    h, _, _, first, _ = word_hashes(texts, lower)
    count = np.diff(first)
    grams = ngrams(h, n)
    full = np.maximum(count - n + 1, 0)
    at = np.repeat(first[:-1], full) + spread(full)
    ids, out = np.repeat(np.arange(len(count)), full), grams[at]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        extra = np.array([int(ngrams(h[first[i] : first[i + 1]], int(count[i]))[0]) ^ int(count[i]) for i in short], dtype=U64)
        ids, out = np.concatenate([ids, short]), np.concatenate([out, mix(extra)])
        order = np.argsort(ids, kind="stable")
        ids, out = ids[order], out[order]
    return ids, out


def spread(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, one after another."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def window_argmin(values: np.ndarray, w: int) -> np.ndarray:
    """Of each w consecutive values the place of the least, the rightmost on a tie."""
    m = len(values) - w + 1
    if m <= 0:
        return np.zeros(0, dtype=np.int64)
    best, place, span = values.copy(), np.arange(len(values)), 1
    while span * 2 <= w:
        k = len(best) - span
        right = best[span:] <= best[:k]
        place = np.where(right, place[span:], place[:k])
        best = np.where(right, best[span:], best[:k])
        span *= 2
    off = w - span
    if off:
        right = best[off : off + m] <= best[:m]
        return np.where(right, place[off : off + m], place[:m])
    return place[:m]
