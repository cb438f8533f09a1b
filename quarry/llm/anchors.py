"""Content-chosen anchors: how equal stretches of text find each other without all windows.

A window is L consecutive items (bytes or words). Of the k-grams inside a window the one
with the least hash (the rightmost on a tie) is its anchor, so equal windows have equal
anchors at equal offsets. Consecutive windows mostly share an anchor; an anchor owns those
windows, and its context is all they cover. One row per anchor instead of one per window
then carries everything: contexts that are equal settle all their windows at once, and
only different contexts of one anchor need a closer look.
"""

from __future__ import annotations

import numpy as np

from quarry.llm import kernels

_PLACE = 24
_MASK = np.uint64((1 << _PLACE) - 1)


def argmin_windows(values: np.ndarray, w: int) -> np.ndarray:
    """Places of the least of each w consecutive values by their upper bits, rightmost first."""
    n = len(values)
    if n < w:
        return np.zeros(0, dtype=np.int64)
    if n > 1 << _PLACE:
        return kernels.window_argmin(values >> np.uint64(_PLACE), w)
    best = (values & ~_MASK) | (_MASK - np.arange(n, dtype=np.uint64))
    span = 1
    while span * 2 <= w:
        best = np.minimum(best[span:], best[:-span])
        span *= 2
    off, m = w - span, n - w + 1
    if off:
        best = np.minimum(best[off : off + m], best[:m])
    return (_MASK - (best[:m] & _MASK)).astype(np.int64)


def owned(grams: np.ndarray, first: np.ndarray, size: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """grams: hash of the k items from each place on; first: where each text starts (and
    the end). Returns for each anchor its text's number, its place and the first and last
    window start that it owns, as places in the joined items."""
    count = np.maximum(np.diff(first) - size + 1, 0)
    text = np.repeat(np.arange(len(count)), count)
    starts = np.repeat(first[:-1], count) + kernels.spread(count)
    if not len(starts):
        z = np.zeros(0, dtype=np.int64)
        return z, z, z, z
    at = argmin_windows(grams, size - k + 1)[starts]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])]))
    last = np.concatenate([new[1:], [len(starts)]]) - 1
    return text[new], at[new], starts[new], starts[last]


def token_prefix(tokens: np.ndarray) -> np.ndarray:
    """prefix_hash for items that are hashes themselves."""
    out = np.zeros(len(tokens) + 1, dtype=np.uint64)
    np.cumsum(tokens * kernels.powers(kernels._MULT, len(tokens)), out=out[1:])
    return out


class Items:
    """Texts as joined items with their rolling hashes: bytes, or words."""

    def __init__(self, texts: list[bytes], unit: str, size: int, k: int):
        self.size, self.k = size, k
        if unit == "bytes":
            buf, starts = kernels.joined(texts)
            self.buf = buf
            self.prefix = kernels.prefix_hash(buf)
            self.base = starts[:-1]
            # the gap byte belongs to no text: windows end before it
            lengths = np.diff(starts) - 1
            self.first = starts
            self.lengths = lengths
        else:
            h, _, _, first, _ = kernels.word_hashes(texts)
            self.prefix = token_prefix(h)
            self.first, self.base, self.lengths = first, first[:-1], np.diff(first)

    def anchors(self) -> dict[str, np.ndarray]:
        """text, h, c, lo, hi for each anchor; lo and hi count from the text's start."""
        n = len(self.prefix) - 1
        m = n - self.k + 1
        if m <= 0:
            z = np.zeros(0, dtype=np.int64)
            return {"text": z, "h": z.astype(np.uint64), "c": z.astype(np.uint64), "lo": z, "hi": z}
        at = np.arange(m)
        grams = kernels.range_hash(self.prefix, at, at + self.k)
        ends = self.base + self.lengths
        first = np.concatenate([self.base, ends[-1:]]) if len(self.base) else self.base
        text, place, lo, hi = owned(grams, first, self.size, self.k)
        # windows must not run into the next text (bytes keep a gap byte between texts)
        good = hi + self.size <= ends[text]
        clip = np.minimum(hi, ends[text] - self.size)
        hi = np.where(good, hi, clip)
        ok = hi >= lo
        text, place, lo, hi = text[ok], place[ok], lo[ok], hi[ok]
        c = kernels.mix(kernels.range_hash(self.prefix, lo, hi + self.size) + (place - lo).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
        base = self.base[text]
        return {"text": text, "h": grams[place], "c": c, "lo": lo - base, "hi": hi - base}

    def windows(self, text: int, lo: int, hi: int) -> np.ndarray:
        """Hashes of the windows that start at lo..hi of a text."""
        s = np.arange(lo, hi + 1) + self.base[text]
        return kernels.range_hash(self.prefix, s, s + self.size)

    def all_windows(self, text: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, start, hash) of all windows that the rows own."""
        n = hi - lo + 1
        row = np.repeat(np.arange(len(n)), n)
        s = lo[row] + kernels.spread(n)
        at = s + self.base[text[row]]
        return row, s, kernels.range_hash(self.prefix, at, at + self.size)
