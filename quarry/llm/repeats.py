"""Distributed search for repeated windows over anchors; shared by two operators.

1. A sketch of all anchors (count_min) tells which may repeat; the others' windows are
   unique. Only anchors that may repeat are shuffled, one narrow row each.
2. Rows meet by anchor. Where whole contexts are equal all their windows are settled.
   Equal contexts are settled within a map task already and only one row of them moves
   on, so a passage that a third of all documents share sends a row per task, not per
   document. An anchor that the sketch calls hot is dealt by context instead of anchor.
3. Of each context one representative is compared further, if its anchor has others.

What a repeat is: mode "anywhere" (the window starts at any other place) or "earlier"
(it starts in a document with a smaller doc_id).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import count_min, kernels
from quarry.llm.anchors import Items
from quarry.llm.common import as_bytes, passes, stash, tidy

PASS = 1 << 18
#: anchors that a map task settles among each other at once
SEEN = 1 << 19
#: bytes that a word and its space are taken to have, where the sketch's size is chosen
WORD_BYTES = 6
MARK, ANCHOR, HOT_ANCHOR = 0, 1, 2
ROW = "g long, kind int, h long, c long, doc long, lo int, hi int, n int"
_ARROW = pa.schema([("g", pa.int64()), ("kind", pa.int32()), ("h", pa.int64()), ("c", pa.int64()), ("doc", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("n", pa.int32())])


def rows(kind, h, c, doc, lo, hi, n, g) -> pa.RecordBatch:
    size = len(doc)

    def col(x, t):
        x = np.broadcast_to(np.asarray(x), (size,))
        return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(t))

    return pa.RecordBatch.from_arrays([col(g, np.int64), col(kind, np.int32), col(h, np.int64), col(c, np.int64), col(doc, np.int64), col(lo, np.int32), col(hi, np.int32), col(n, np.int32)], schema=_ARROW)


def marks(doc: np.ndarray, lo: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """Items lo..end-1 of a document are covered."""
    spread_by = kernels.mix(doc.astype(np.int64).view(np.uint64) + lo.astype(np.uint64))
    return rows(MARK, 0, 0, doc, lo, end, 0, spread_by)


def settle(h, c, doc, lo, n, mode: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For rows sorted by (h, c, doc, lo): which are covered, which represent their (h, c),
    the number of rows behind each representative (2 for more), and where (h, c) begin."""
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])]) if len(h) else np.zeros(0, dtype=bool)
    run = np.cumsum(new) - 1
    total = np.bincount(run, weights=n) if len(h) else np.zeros(0)
    if mode == "anywhere":
        return total[run] >= 2, new, np.minimum(total[run], 2).astype(np.int32), new
    first = doc[np.flatnonzero(new)][run] if len(h) else doc
    return doc > first, doc == first, n, new


def collapse(h, c, doc, lo, hi, mode: str):
    """Settle what a map task sees: (mark rows' index, representatives' index, their n)."""
    order = np.lexsort((lo, doc, c, h))
    covered, rep, n, _ = settle(h[order], c[order], doc[order], lo[order], np.ones(len(order)), mode)
    return order[covered], order[rep], n[rep]


def texts_of(batch: pa.RecordBatch, unit: str, size: int, k: int) -> Iterator[tuple[np.ndarray, Items]]:
    for i, j in passes(batch, "text", PASS):
        part = batch.slice(i, j - i)
        yield part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64), Items(as_bytes(part.column("text")).to_pylist(), unit, size, k)


def find(docs: DataFrame, unit: str, size: int, k: int, mode: str) -> DataFrame:
    """The written table of step 2: marks (kind MARK: doc, lo, hi = end) and the contexts
    to compare (ANCHOR, HOT_ANCHOR: h, doc, lo, hi = first and last window start)."""
    docs = docs.select("doc_id", "text").where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())

    def keys_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, items in texts_of(batch, unit, size, k):
            yield items.anchors()["h"]

    # a window of so many k-grams changes its anchor every half window or so
    items = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / (WORD_BYTES if unit == "words" else 1)
    width = count_min.width_for(items * 2 / (size - k + 2))
    shared = docs.sparkSession.sparkContext.broadcast(count_min.build(docs, keys_of, width))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = shared.value
        got: list[tuple] = []

        def done() -> Iterator[pa.RecordBatch]:
            h, c, doc, lo, hi = (np.concatenate(x) for x in zip(*got, strict=True))
            covered, rep, n = collapse(h, c, doc, lo, hi, mode)
            if len(covered):
                yield marks(doc[covered], lo[covered], hi[covered] + size)
            if len(rep):
                hot = sketch.is_hot(h[rep])
                g = kernels.mix(np.where(hot, h[rep] * np.uint64(3) ^ c[rep], h[rep]))
                yield rows(np.where(hot, HOT_ANCHOR, ANCHOR), h[rep], c[rep], doc[rep], lo[rep], hi[rep], n, g)

        for batch in batches:
            for ids, items in texts_of(batch, unit, size, k):
                a = items.anchors()
                keep = sketch.repeated(a["h"])
                got.append((a["h"][keep], a["c"][keep], ids[a["text"][keep]], a["lo"][keep], a["hi"][keep]))
                if sum(len(x[0]) for x in got) >= SEEN:
                    yield from done()
                    got.clear()
        if got:
            yield from done()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in whole_runs(batches):
            is_mark = x["kind"] == MARK
            if is_mark.any():
                m = {f: v[is_mark] for f, v in x.items()}
                yield rows(MARK, 0, 0, m["doc"], m["lo"], m["hi"], 0, 0)
            x = {f: v[~is_mark] for f, v in x.items()}
            if not len(x["h"]):
                continue
            covered, rep, n, new = settle(x["h"], x["c"], x["doc"], x["lo"], x["n"], mode)
            # rows that stood for several were marked in their map task
            covered = covered & (x["n"] < 2)
            if covered.any():
                yield rows(MARK, 0, 0, x["doc"][covered], x["lo"][covered], x["hi"][covered] + size, 0, 0)
            group = np.cumsum(np.concatenate([[True], (x["h"][1:] != x["h"][:-1]) | (x["g"][1:] != x["g"][:-1])])) - 1
            different = np.bincount(group, weights=new)[group] >= 2
            rep = rep & (different | (x["kind"] == HOT_ANCHOR))
            if rep.any():
                yield rows(x["kind"][rep], x["h"][rep], x["c"][rep], x["doc"][rep], x["lo"][rep], x["hi"][rep], n[rep], 0)

    dealt = docs.mapInArrow(tidy(emit), ROW).repartition("g").sortWithinPartitions("g", "h", "c", "doc", "lo")
    return stash(dealt.mapInArrow(tidy(meet), ROW), "repeats")


def whole_runs(batches: Iterator[pa.RecordBatch], by: str = "g") -> Iterator[dict[str, np.ndarray]]:
    """Sorted batches regrouped so that no run of equal `by` is divided; what is kept back
    is one run. Columns as numpy arrays, hashes unsigned."""

    def arrays(tables: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
        t = pa.Table.from_batches(tables)
        out = {}
        for f in t.schema.names:
            v = t.column(f)
            if pa.types.is_integer(v.type):
                v = v.to_numpy()
                out[f] = v.astype(np.int64, copy=False).view(np.uint64) if f in ("h", "c", "g", "w") else v.astype(np.int64, copy=False)
            else:
                out[f] = v
        return out

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(by).to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(keys != keys[-1])
        head = int(cut[-1]) + 1 if len(cut) else 0
        if head or (held and held[-1].column(by)[-1].as_py() != keys[-1]):
            if head:
                held.append(batch.slice(0, head))
            if held:
                yield arrays(held)
            held = []
        held.append(batch.slice(head))
    if held:
        yield arrays(held)


def packed(docs: DataFrame) -> DataFrame:
    """doc_id and its text, compressed for the shuffle (z is null where the text is)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for i, j in passes(batch, "text"):
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array([z.compress(t) for t in as_bytes(part.column("text")).to_pylist()], pa.binary())], ["doc_id", "z"])

    return docs.select("doc_id", "text").mapInArrow(pack, "doc_id long, z binary")


def unpacked(batch: pa.RecordBatch) -> list[bytes]:
    z = zstandard.ZstdDecompressor()
    return [z.decompress(x) for x in batch.column("z").to_pylist()]


def z_passes(batch: pa.RecordBatch, limit: int = PASS) -> Iterator[pa.RecordBatch]:
    for i, j in passes(batch, "z", limit // 3):
        yield batch.slice(i, j - i)


def listed(rows_: DataFrame, *fields: str) -> DataFrame:
    """doc and all its rows as arrays, one for each field (in the same order)."""
    every = rows_.groupBy("doc").agg(F.collect_list(F.struct(*fields)).alias("items"))
    return every.select("doc", *[F.col(f"items.{f}").alias(f) for f in fields])


def attach(packs: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    return packs.join(lists.hint("shuffle_hash"), packs["doc_id"] == lists["doc"], how).drop("doc")


def union_marks(*parts: DataFrame) -> DataFrame:
    out = None
    for p in parts:
        p = p.where(F.col("kind") == MARK).select("doc", "lo", "hi")
        out = p if out is None else out.unionByName(p)
    return out


def cover(size: int, lo: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of size items lie in any of the ranges (cut off at the end: rows that share a
    doc_id share ranges)."""
    lo, end = np.minimum(lo, size), np.minimum(end, size)
    step = np.zeros(size + 1, dtype=np.int64)
    np.add.at(step, lo, 1)
    np.add.at(step, end, -1)
    return np.cumsum(step[:-1]) > 0


def ranges(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for lo, hi in zip(batch.column("lo"), batch.column("hi"), strict=True):
        if lo.is_valid and hi.is_valid:
            yield lo.values.to_numpy(zero_copy_only=False), hi.values.to_numpy(zero_copy_only=False)
        else:
            yield np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)


