"""Removing word windows that an earlier document has: count-min prefilter, exact groups.

A window is SIZE consecutive words. First pass: every partition sketches the anchors of
its windows (a window is counted through its anchor, so an anchor's estimate is at least
the count of each of its windows), and the sketches are merged. Second pass: only windows
whose estimate says repeated are grouped, exactly; see repeats for how equal contexts
settle their windows together and how the rest are grouped window by window here.

Defined cases: a null or empty text has no words (kept_sha256 is that of the empty
string); rows that share a doc_id share what is removed and are none earlier than the
other; a null doc_id loses nothing; an empty table gives an empty result; other columns
are ignored. Groups are told apart by 128 bits of two hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import kernels, repeats
from quarry.llm.anchors import Items
from quarry.llm.common import tidy

SIZE = 13
K = 5


def window_rows(doc, h, lo, hi, texts: list[bytes], unit: str, size: int, k: int, mode: str) -> Iterator[pa.RecordBatch]:
    """Rows per window of the given contexts: (text number in doc[0], ...) settled within
    the task as far as it sees."""
    text, ids = doc
    items = Items(texts, unit, size, k)
    fits = hi + size <= items.lengths[text]  # not so where rows share a doc_id
    text, h, lo, hi = text[fits], h[fits], lo[fits], hi[fits]
    row, start, w = items.all_windows(text, lo, hi)
    hh, dd = h[row], ids[text[row]]
    covered, rep, n = repeats.collapse(hh, w, dd, start, start, mode)
    if len(covered):
        yield repeats.marks(dd[covered], start[covered], start[covered] + size)
    if len(rep):
        yield repeats.rows(repeats.ANCHOR, hh[rep], w[rep], dd[rep], start[rep], start[rep], n, kernels.mix(hh[rep] * np.uint64(5) ^ w[rep]))


def settle_windows(batches: Iterator[pa.RecordBatch], size: int, mode: str) -> Iterator[pa.RecordBatch]:
    for x in repeats.whole_runs(batches):
        is_mark = x["kind"] == repeats.MARK
        if is_mark.any():
            yield repeats.rows(repeats.MARK, 0, 0, x["doc"][is_mark], x["lo"][is_mark], x["hi"][is_mark], 0, 0)
        x = {f: v[~is_mark] for f, v in x.items()}
        if len(x["h"]):
            covered, _, _, _ = repeats.settle(x["h"], x["c"], x["doc"], x["lo"], x["n"], mode)
            covered = covered & (x["n"] < 2)
            if covered.any():
                yield repeats.rows(repeats.MARK, 0, 0, x["doc"][covered], x["lo"][covered], x["lo"][covered] + size, 0, 0)


def exact_windows(packs: DataFrame, contexts: DataFrame, unit: str, size: int, k: int, mode: str) -> DataFrame:
    """Marks from grouping the windows of the contexts (h, doc, lo, hi) one by one."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in repeats.z_passes(batch):
                ids = part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
                flat = {f: pc.list_flatten(part.column(f)).to_numpy(zero_copy_only=False) for f in ("h", "lo", "hi")}
                text = np.repeat(np.arange(len(ids)), pc.list_value_length(part.column("h")).to_numpy(zero_copy_only=False))
                yield from window_rows((text, ids), flat["h"].astype(np.int64).view(np.uint64), flat["lo"].astype(np.int64), flat["hi"].astype(np.int64), repeats.unpacked(part), unit, size, k, mode)

    joined = repeats.attach(packs, repeats.listed(contexts, "h", "lo", "hi"), "inner")
    dealt = joined.mapInArrow(tidy(windows), repeats.ROW).repartition("g").sortWithinPartitions("g", "h", "c", "doc", "lo")
    return dealt.mapInArrow(lambda b: settle_windows(b, size, mode), repeats.ROW)


def removed(docs: DataFrame, size: int = SIZE, k: int = K) -> DataFrame:
    """doc, lo, hi: words lo..hi-1 of a document that stand in an earlier one (ranges may
    overlap)."""
    found = repeats.find(docs, "words", size, k, "earlier")
    again = exact_windows(repeats.packed(docs), found.where(F.col("kind") != repeats.MARK), "words", size, k, "earlier")
    return repeats.union_marks(found, again)


def dedup(docs: DataFrame, size: int = SIZE, k: int = K) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept: the remaining words of each
    document, joined by one space."""
    joined = repeats.attach(repeats.packed(docs), repeats.listed(removed(docs, size, k), "lo", "hi"), "left")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in repeats.z_passes(batch):
                n_words, n_removed, kept = [], [], []
                for text, (lo, end) in zip(repeats.unpacked(part), repeats.ranges(part), strict=True):
                    words = text.split()  # ASCII white space, as the contract's words
                    n_words.append(len(words))
                    if len(lo):
                        out = repeats.cover(len(words), lo, end)
                        n_removed.append(int(out.sum()))
                        words = [words[i] for i in np.flatnonzero(~out)]
                    else:
                        n_removed.append(0)
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array([x.decode() for x in kept], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return joined.mapInArrow(tidy(keep), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def digest(docs: DataFrame) -> DataFrame:
    return dedup(docs).drop("kept")


#: the same result in DuckDB SQL (for tables whose windows fit in memory)
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT rid, doc_id, i, array_to_string(w[i:i + {SIZE - 1}], ' ') AS s FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - {SIZE - 2})) AS i FROM d)),
first AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + {SIZE})) AS p FROM win JOIN first USING (s) WHERE doc_id > m),
words AS (SELECT rid, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT rid, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (rid, p) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)"""
