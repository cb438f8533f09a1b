"""Finding benchmark passages in documents by q-gram lemma filtering.

Texts are compared lower-cased, with every run of ASCII characters that are neither
letters nor digits as one space. An item of m bytes that stands in a document with at
most e = floor(RATE * m) edits shares at least m - q + 1 - q * e of its q-grams with that
place, and their diagonals (place in the document less place in the item) lie within e of
each other. Shared q-grams are counted in overlapping diagonal bands of width 2e. Where
the bound is reached, the same lemma is asked again with grams of SHORT bytes, which e edits
leave many more of, over the bytes that the band reaches; only what passes both is aligned
(bit-parallel, a row of distances as one number) and kept if it needs no more than e edits.

The benchmark is broadcast in blocks of at most BLOCK_BYTES of text; documents stream by.

Defined cases: a null or empty text matches nothing; items shorter than q after
normalising match exactly, as whole words (an item without letters and digits matches
nothing); items whose bound would fall below MIN_SHARED take fewer edits, so that it does
not; equal items and repeated documents match each on their own, documents of a null doc_id
too; an empty table gives an empty result; other columns are ignored by matches() and kept by
clean().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import kernels
from quarry.llm.common import as_bytes, bound_batches, passes, tidy

Q = 8
RATE = 0.12
MIN_SHARED = 4
#: length of the shorter grams that a second count takes, and its table
SHORT = 5
BLOCK_BYTES = 16 << 20
_BITS = 22
PASS = 1 << 18
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], dtype=np.uint8)
_MULT = np.uint64(0x9E3779B97F4A7C15)


def folded(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The normalised bytes and, for each, its place in buf."""
    low = _FOLD[buf]
    space = low == 32
    keep = np.ones(len(low), dtype=bool)
    keep[1:] = ~(space[1:] & space[:-1])
    at = np.flatnonzero(keep)
    return low[at], at


def grams(text: np.ndarray) -> np.ndarray:
    """Each Q consecutive bytes as one number."""
    n = len(text) - Q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    return np.ndarray((n,), dtype="<u8", buffer=np.ascontiguousarray(text), strides=(1,)).copy()


def edits_of(size: int) -> int:
    """The edits that an item of so many bytes may have."""
    return max(0, min(int(RATE * size), (size - Q + 1 - MIN_SHARED) // Q))


class Items:
    """The index of a block of benchmark items."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.ids, self.texts = [], []
        brief: dict[bytes, list[int]] = {}
        for i, t in items:
            text = bytes(folded(np.frombuffer(t, dtype=np.uint8))[0].tobytes()).strip()
            if len(text) >= Q:
                self.ids.append(i)
                self.texts.append(text)
            elif text:
                brief.setdefault(text, []).append(i)
        #: short items by their text, between spaces
        self.brief = {b" " + t + b" ": ids for t, ids in brief.items()}
        self.size = np.array([len(t) for t in self.texts], dtype=np.int64)
        self.edits = np.array([edits_of(n) for n in self.size.tolist()], dtype=np.int64)
        self.need = np.maximum(1, self.size - Q + 1 - Q * self.edits)
        parts = [grams(np.frombuffer(t, dtype=np.uint8)) for t in self.texts]
        gram = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
        item = np.repeat(np.arange(len(parts)), [len(p) for p in parts]) if parts else np.zeros(0, dtype=np.int64)
        place = kernels.spread(np.array([len(p) for p in parts], dtype=np.int64)) if parts else item
        order = np.argsort(gram, kind="stable")
        self.gram, self.item, self.place = gram[order], item[order], place[order]
        self.seen = np.zeros(1 << _BITS, dtype=bool)
        self.seen[self._cell(self.gram)] = True
        # (item, short gram): the cells may hold others too, which only raises a count
        short = [grams(np.frombuffer(t + bytes(Q - SHORT), dtype=np.uint8)) for t in self.texts]
        self.short = np.zeros(1 << _BITS, dtype=bool)
        for i, g in enumerate(short):
            self.short[self._short_cell(g, np.uint64(i))] = True
        self.need_short = self.size - SHORT + 1 - SHORT * self.edits

    @staticmethod
    def _cell(g: np.ndarray) -> np.ndarray:
        return (g * _MULT) >> np.uint64(64 - _BITS)

    @staticmethod
    def _short_cell(g: np.ndarray, item) -> np.ndarray:
        return (((g << np.uint64(8 * (Q - SHORT))) + item) * _MULT) >> np.uint64(64 - _BITS)

    def enough_short(self, g: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Whether places lo..hi-1 hold as many of the item's short grams as the lemma asks."""
        out = np.zeros(len(item), dtype=bool)
        lo, hi = np.maximum(lo, 0), np.minimum(hi, len(g))
        for k in range(0, len(item), 512):
            n = np.maximum(hi[k : k + 512] - lo[k : k + 512], 0)
            at = np.repeat(lo[k : k + 512], n) + kernels.spread(n)
            hit = np.concatenate([[0], np.cumsum(self.short[self._short_cell(g[at], np.repeat(item[k : k + 512], n).astype(np.uint64))])])
            end = np.cumsum(n)
            out[k : k + 512] = hit[end] - hit[end - n] >= self.need_short[item[k : k + 512]]
        return out

    def candidates(self, text: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text number, item, least and greatest diagonal) of bands that reach the bound."""
        g = grams(text)
        if not len(g) or not len(self.gram):
            return []
        at = np.flatnonzero(self.seen[self._cell(g)])
        lo = np.searchsorted(self.gram, g[at], side="left")
        n = np.searchsorted(self.gram, g[at], side="right") - lo
        some = n > 0
        at, lo, n = at[some], lo[some], n[some]
        row = np.repeat(np.arange(len(at)), n)
        post = lo[row] + kernels.spread(n)
        pos, item = at[row], self.item[post]
        doc = (np.searchsorted(starts, at, side="right") - 1)[row]
        # diagonals from 0 up within the text
        diagonal = pos - starts[doc] - self.place[post] + self.size[item]
        band = diagonal // np.maximum(self.edits[item], 1)
        # hits without enough others in their cell and a next one go before any sort
        # (what shares a counter raises it)
        pair = (doc * len(self.ids) + item).astype(np.uint64) * _MULT
        near = [((pair + (band + k).astype(np.uint64)) * _MULT >> np.uint64(64 - 18)).astype(np.int64) for k in (-1, 0, 1)]
        hits = np.bincount(near[1], minlength=1 << 18)
        some = hits[near[1]] + np.maximum(hits[near[0]], hits[near[2]]) >= self.need[item]
        band, pos, item, doc, place = band[some], pos[some], item[some], doc[some], self.place[post[some]]
        if not len(pos):
            return []
        order = np.lexsort((pos, band, item, doc))
        d, i, b, p = doc[order], item[order], band[order], pos[order]
        new = np.concatenate([[True], (d[1:] != d[:-1]) | (i[1:] != i[:-1]) | (b[1:] != b[:-1])])
        run = np.cumsum(new) - 1
        # a q-gram of the document counts once in a cell, and so does one of the item
        once = new | np.concatenate([[True], p[1:] != p[:-1]])
        q = place[np.lexsort((place, band, item, doc))]
        also = new | np.concatenate([[True], q[1:] != q[:-1]])
        count = np.minimum(np.bincount(run, weights=once), np.bincount(run, weights=also))
        found = [(d[new], i[new], b[new] - shift, count) for shift in (0, 1)]
        # a band of width 2w is the two cells b and b + 1
        d, i, b, c = (np.concatenate([x[k] for x in found]) for k in range(4))
        order = np.lexsort((b, i, d))
        d, i, b, c = d[order], i[order], b[order], c[order]
        new = np.concatenate([[True], (d[1:] != d[:-1]) | (i[1:] != i[:-1]) | (b[1:] != b[:-1])])
        total = np.add.reduceat(c, np.flatnonzero(new))
        d, i, b = d[new], i[new], b[new]
        ok = total >= self.need[i]
        d, i, b = d[ok], i[ok], b[ok]
        w = np.maximum(self.edits[i], 1)
        lo_d, hi_d = b * w - self.size[i], (b + 2) * w - 1 - self.size[i]
        ok = self.enough_short(g, i, starts[d] + lo_d, starts[d] + hi_d + self.size[i])
        return list(zip(d[ok].tolist(), i[ok].tolist(), lo_d[ok].tolist(), hi_d[ok].tolist(), strict=True))

    def whole_words(self, text: bytes) -> Iterator[tuple[int, int, int]]:
        """(item_id, start, end) of short items in a normalised text, each at its first place."""
        if not self.brief:
            return
        if not hasattr(self, "words"):
            import ahocorasick

            self.words = ahocorasick.Automaton()
            for key in self.brief:
                self.words.add_word(key.decode("latin-1"), key)
            self.words.make_automaton()
        seen = set()
        for last, key in self.words.iter(" " + text.decode("latin-1") + " "):
            if key not in seen:
                seen.add(key)
                for i in self.brief[key]:
                    yield i, last + 1 - len(key), last - 1

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "words"}

    def align(self, item: int, text: np.ndarray, lo: int, hi: int) -> tuple[int, int, int] | None:
        """(edits, start, end) of the item in text with start diagonal in lo..hi, or None."""
        pattern, most = self.texts[item], int(self.edits[item])
        a = max(0, lo - most)
        zone = text[a : max(0, hi + len(pattern) + most)].tobytes()
        exact = zone.find(pattern)
        if exact >= 0:
            return 0, a + exact, a + exact + len(pattern)
        if not most:
            return None
        # (the item's grams that stand in the zone, a stricter count than enough_short)
        have = {zone[k : k + SHORT] for k in range(len(zone) - SHORT + 1)}
        if sum(pattern[k : k + SHORT] in have for k in range(len(pattern) - SHORT + 1)) < self.need_short[item]:
            return None
        got = placed(pattern, zone, most)
        return None if got is None else (got[0], a + got[1], a + got[2])


def distances(pattern: bytes, zone: bytes, fixed: bool) -> Iterator[int]:
    """For each prefix of zone, the empty one first, the edits between the pattern and the
    whole prefix (fixed) or its best suffix (Myers' bit vectors: bit i of up and down is
    whether the distance rises or falls from the pattern's prefix i to i + 1)."""
    m = len(pattern)
    at: dict[int, int] = {}
    for i, c in enumerate(pattern):
        at[c] = at.get(c, 0) | 1 << i
    every, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = every, 0, m
    yield score
    for c in zone:
        same = at.get(c, 0)
        x = (((same & up) + up) ^ up) | same
        rise, fall = (down | ~(x | up)) & every, up & x
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
        rise, fall = (rise << 1 | fixed) & every, (fall << 1) & every
        same |= down
        up, down = (fall | ~(same | rise)) & every, rise & same
        yield score


def placed(pattern: bytes, zone: bytes, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the pattern's best place in zone, if that needs no more than
    `most` edits; of equal ones the first start, then the first end."""
    least = min(distances(pattern, zone, False))
    if least > most:
        return None
    back = list(distances(pattern[::-1], zone[::-1], False))
    start = len(zone) - max(k for k, e in enumerate(back) if e == least)
    ends = distances(pattern, zone[start : start + len(pattern) + least], True)
    return least, start, start + next(k for k, e in enumerate(ends) if e == least)


def blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The benchmark in blocks whose text is bounded."""
    rows = benchmark.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(F.col("item_id").cast("long"), "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-2 * int(total) // BLOCK_BYTES) or 1
    for b in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        got = sorted((r["item_id"], r["text"].encode()) for r in part.collect())
        if got:
            yield Items(got)


def _found(items: Items, batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(row, item_id, start, end, edits, item size): bytes of the text as it is."""
    for i, j in passes(batch, "text", PASS):
        texts = as_bytes(batch.slice(i, j - i).column("text")).to_pylist()
        buf, begin = kernels.joined(texts, b"\0\xff\0")  # a border that no item crosses
        text, at = folded(buf)
        starts = np.searchsorted(at, begin)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for d, item, lo, hi in items.candidates(text, starts[:-1]):
            key = (d, item)
            if key in best and best[key][0] == 0:
                continue
            got = items.align(item, text[starts[d] : starts[d + 1]], lo, hi)
            if got is not None and (key not in best or got < best[key]):
                best[key] = got
        for (d, item), (edits, a, b) in sorted(best.items()):
            place = at[starts[d] : starts[d + 1]] - begin[d]
            yield i + d, items.ids[item], int(place[a]), int(place[b - 1]) + 1, edits, int(items.size[item])
        if items.brief:
            for d in range(j - i):
                for item_id, a, b in items.whole_words(text[starts[d] : starts[d + 1]].tobytes()):
                    place = at[starts[d] : starts[d + 1]] - begin[d]
                    yield i + d, item_id, int(place[a]), int(place[b - 1]) + 1, 0, b - a


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start, end (bytes of the text), edits, similarity: each item that
    a document holds, at its best place."""
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int64()), ("similarity", pa.float64())])
    spark = docs.sparkSession
    bound_batches(spark)
    out = spark.createDataFrame([], "doc_id long, item_id long, start long, end long, edits long, similarity double")
    for block in blocks(benchmark):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in batches:
                doc = batch.column("doc_id").to_pylist()
                rows = [{"doc_id": doc[r], "item_id": i, "start": a, "end": b, "edits": e, "similarity": 1 - e / size} for r, i, a, b, e, size in _found(items, batch)]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

        out = out.unionByName(docs.select("doc_id", "text").mapInArrow(tidy(run), out.schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item of the benchmark, with their columns."""
    bound_batches(docs.sparkSession)
    for block in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                gone = {x[0] for x in _found(shared.value, batch)}
                keep = pa.array([i not in gone for i in range(batch.num_rows)], pa.bool_())
                yield batch.filter(keep)

        docs = docs.mapInArrow(tidy(run), docs.schema)
    return docs
