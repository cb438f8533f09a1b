"""Removing long repeated byte strings with a run-length index.

Contexts of anchors that repeat (see repeats) are gathered by anchor; equal contexts are
settled there. The remaining different contexts of an anchor are indexed together with a
run-compressed Burrows-Wheeler transform (runlength_index); matching statistics streamed
over the index mark every stretch that a match of at least SIZE bytes covers. Indexes are
built in batches of BATCH_BYTES and forgotten, so memory is bounded; a context holds SIZE
bytes around an anchor, and an anchor with too many different contexts for one batch (a
hot one: a short passage in very many surroundings) is grouped exactly, window by window.

Defined cases: a null or empty text has 0 bytes (kept_sha256 is that of the empty string);
rows that share a doc_id share what is removed; repeated rows are copies of one another;
a null doc_id loses nothing; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import kernels, repeats, substring_dedup
from quarry.llm.common import tidy
from quarry.llm.runlength_index import RunIndex

SIZE = 200
K = 50
BATCH_BYTES = 1 << 20
CONTEXT = 3
_ROW = repeats.ROW + ", bytes binary"
_ARROW = pa.schema([*repeats._ARROW, ("bytes", pa.binary())])


def _with_bytes(batch: pa.RecordBatch, data: list[bytes] | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary()) if data else pa.nulls(batch.num_rows, pa.binary())], schema=_ARROW)


def merged(text: np.ndarray, h: np.ndarray, lo: np.ndarray, hi: np.ndarray, size: int):
    """Contexts of one anchor in one text that share bytes become one, so that no byte of
    a text stands twice among the strings that are compared."""
    order = np.lexsort((lo, h, text))
    text, h, lo, hi = text[order], h[order], lo[order], hi[order]
    if not len(text):
        return text, h, lo, hi
    same = (text[1:] == text[:-1]) & (h[1:] == h[:-1])
    new = np.concatenate([[True], ~(same & (lo[1:] < hi[:-1] + size))])
    first = np.flatnonzero(new)
    return text[first], h[first], lo[first], np.maximum.reduceat(hi, first)


def compared(packs: DataFrame, contexts: DataFrame, size: int = SIZE, k: int = K) -> DataFrame:
    """Marks from comparing the contexts of each anchor."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in repeats.z_passes(batch):
                texts = repeats.unpacked(part)
                ids = part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
                text = np.repeat(np.arange(len(ids)), pc.list_value_length(part.column("h")).to_numpy(zero_copy_only=False))
                h, lo, hi, kind = (pc.list_flatten(part.column(f)).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("h", "lo", "hi", "kind"))
                h = h.view(np.uint64)
                hot = kind == repeats.HOT_ANCHOR
                if hot.any():
                    for out in substring_dedup.window_rows((text[hot], ids), h[hot], lo[hot], hi[hot], texts, "bytes", size, k, "anywhere"):
                        yield _with_bytes(out)
                t, hh, a, b = merged(text[~hot], h[~hot], lo[~hot], hi[~hot], size)
                if len(t):
                    data = [texts[i][x : y + size] for i, x, y in zip(t.tolist(), a.tolist(), b.tolist(), strict=True)]
                    yield _with_bytes(repeats.rows(CONTEXT, hh, 0, ids[t], a, b, 0, kernels.mix(hh)), data)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]] = []
        total = 0

        def done() -> Iterator[pa.RecordBatch]:
            h, doc, lo = (np.concatenate([x[i] for x in held]) for i in range(3))
            data = [s for x in held for s in x[3]]
            _, group = np.unique(h, return_inverse=True)
            own, a, b = RunIndex(data, group).repeated(size)
            if len(own):
                yield repeats.rows(repeats.MARK, 0, 0, doc[own], lo[own] + a, lo[own] + b, 0, 0)

        def runs() -> Iterator[dict]:
            for x in repeats.whole_runs(batches):
                yield x

        for x in runs():
            context = x["kind"] == CONTEXT
            plain = {f: v[~context] for f, v in x.items() if f != "bytes"}
            if len(plain["h"]):
                is_mark = plain["kind"] == repeats.MARK
                if is_mark.any():
                    yield repeats.rows(repeats.MARK, 0, 0, plain["doc"][is_mark], plain["lo"][is_mark], plain["hi"][is_mark], 0, 0)
                w = {f: v[~is_mark] for f, v in plain.items()}
                covered, _, _, _ = repeats.settle(w["h"], w["c"], w["doc"], w["lo"], w["n"], "anywhere")
                covered = covered & (w["n"] < 2)
                if covered.any():
                    yield repeats.rows(repeats.MARK, 0, 0, w["doc"][covered], w["lo"][covered], w["lo"][covered] + size, 0, 0)
            if context.any():
                at = np.flatnonzero(context)
                data = x["bytes"].take(pa.array(at)).to_pylist()
                h, doc, lo = x["h"][at], x["doc"][at], x["lo"][at]
                # whole anchors, BATCH_BYTES at a time
                sizes = np.cumsum([len(s) for s in data])
                border = np.concatenate([np.flatnonzero(h[1:] != h[:-1]) + 1, [len(h)]])
                i = 0
                for j in border.tolist():
                    held.append((h[i:j], doc[i:j], lo[i:j], data[i:j]))
                    total += int(sizes[j - 1] - (sizes[i - 1] if i else 0))
                    i = j
                    if total >= BATCH_BYTES:
                        yield from done()
                        held, total = [], 0
        if held:
            yield from done()

    joined = repeats.attach(packs, repeats.listed(contexts, "h", "lo", "hi", "kind"), "inner")
    dealt = joined.mapInArrow(tidy(gather), _ROW).repartition("g").sortWithinPartitions("g", "h", "c", "doc", "lo")
    return dealt.mapInArrow(tidy(index), repeats.ROW)


def removed(docs: DataFrame, size: int = SIZE, k: int = K) -> DataFrame:
    """doc, lo, hi: bytes lo..hi-1 of a document that repeated strings cover (ranges may
    overlap)."""
    found = repeats.find(docs, "bytes", size, k, "anywhere")
    again = compared(repeats.packed(docs), found.where(F.col("kind") != repeats.MARK), size, k)
    return repeats.union_marks(found, again)


def dedup(docs: DataFrame, size: int = SIZE, k: int = K) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept: the remaining bytes."""
    joined = repeats.attach(repeats.packed(docs), repeats.listed(removed(docs, size, k), "lo", "hi"), "left")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in repeats.z_passes(batch):
                n_bytes, n_removed, n_spans, kept = [], [], [], []
                for text, (lo, end) in zip(repeats.unpacked(part), repeats.ranges(part), strict=True):
                    n_bytes.append(len(text))
                    out = repeats.cover(len(text), lo, end) if len(lo) else np.zeros(0, dtype=bool)
                    n_removed.append(int(out.sum()))
                    n_spans.append(int(np.count_nonzero(out[1:] & ~out[:-1]) + (len(out) > 0 and out[0])))
                    kept.append(np.frombuffer(text, dtype=np.uint8)[~out].tobytes() if len(lo) else text)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)], pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return joined.mapInArrow(tidy(keep), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def digest(docs: DataFrame) -> DataFrame:
    return dedup(docs).drop("kept")
