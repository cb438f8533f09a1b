"""Document fingerprints: one-permutation MinHash with optimal densification.

Each word shingle is hashed once; its high bits name a bin and the rest compete for the
bin's minimum. A bin that stays empty takes the value of the bin that a fixed random order
of its own (see probes) names first among those with a value of their own.
The low-order bits of the values are packed to a hex string; likeness() corrects for
values that agree by chance.

Texts are paired with their neighbours in a range sort by doc_id; a text is shuffled once.

Defined cases: a null text is empty; a text without words has the fingerprint "" (likeness
1 to another such text, 0 to others); fewer words than a shingle form one shingle; rows
with equal doc_id are ordered by text, so that reruns agree; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import kernels
from quarry.llm.common import as_bytes, passes, ranges, stash, tidy

WORDS = 5
BINS = 256
BITS = 4


@lru_cache(maxsize=4)
def probes(bins: int) -> np.ndarray:
    """For each bin the order in which others are asked: a random function of bin and
    attempt that asks no bin twice."""
    return np.argsort(np.random.default_rng(bins).random((bins, bins)), axis=1)


def densify(values: np.ndarray, empty: np.ndarray) -> np.ndarray:
    """values, empty: texts x bins; texts without any value are left alone."""
    order, some = probes(values.shape[1]), ~empty
    t, b = np.nonzero(empty & some.any(axis=1)[:, None])
    out = values.copy()
    for attempt in range(4):  # mostly enough; then all attempts at once for what is left
        source = order[b, attempt]
        ok = some[t, source]
        out[t[ok], b[ok]] = values[t[ok], source[ok]]
        t, b = t[~ok], b[~ok]
    for i in range(0, len(t), 8192):
        x, y = t[i : i + 8192], b[i : i + 8192]
        first = some[x[:, None], order[y]].argmax(axis=1)
        out[x, y] = values[x, order[y, first]]
    return out


def signatures(texts: list[bytes], words: int = WORDS, bins: int = BINS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(texts x bins low-order values, whether the text has any shingle)."""
    shift = np.uint64(64 - bins.bit_length() + 1)
    ids, hashes = kernels.shingle_sets(texts, words, lower=False)
    table = np.full(len(texts) * bins, np.iinfo(np.uint64).max, dtype=np.uint64)
    np.minimum.at(table, ids * bins + (hashes >> shift).astype(np.int64), hashes)
    table = table.reshape(len(texts), bins)
    empty = table == np.iinfo(np.uint64).max
    low = (kernels.mix(densify(table, empty)) & np.uint64((1 << bits) - 1)).astype(np.uint8)
    return low, ~empty.all(axis=1)


def packed(low: np.ndarray, some: np.ndarray, bits: int = BITS) -> list[str]:
    """Hex strings of the values, bits each; "" where the text has no shingle."""
    every = np.unpackbits(low[:, :, None], axis=2, bitorder="big")[:, :, 8 - bits :].reshape(len(low), -1)
    return [r.tobytes().hex() if ok else "" for r, ok in zip(np.packbits(every, axis=1), some, strict=True)]


def likeness(a: np.ndarray, a_some: np.ndarray, b: np.ndarray, b_some: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Estimated share of common shingles: agreement less what chance agrees on."""
    chance = 2.0**-bits
    got = np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0.0, 1.0)
    return np.where(a_some & b_some, got, (a_some == b_some).astype(float))


def _rows(ids: list, texts: list[str], after: list[str]) -> dict[str, list]:
    """Result columns for texts whose following text is known."""
    edited = []
    for t, n in zip(texts, after, strict=True):
        half = len(t) // 2
        edited.append((t[: len(t) - half] + n[:half]).encode())
    own, some = signatures([t.encode() for t in texts])
    new, new_some = signatures(edited)
    nxt, nxt_some = signatures([n.encode() for n in after[-1:]])
    nxt, nxt_some = np.concatenate([own[1:], nxt]), np.concatenate([some[1:], nxt_some])
    return {
        "doc_id": ids, "n_chars": [len(t) for t in texts], "edited_sha256": [hashlib.sha256(e).hexdigest() for e in edited], "fingerprint": packed(own, some), "edited_fingerprint": packed(new, new_some),
        "near_edited": likeness(own, some, new, new_some), "near_next": likeness(own, some, nxt, nxt_some),
    }


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("head", pa.string()), ("tail", pa.string())])


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted partition: results of all rows but the last; of the first row that comes
    out, which is the partition's first, also its text as head, and of the last row, which
    has no neighbour here, its text as tail."""
    held_id = held_text = None
    held = False
    begun = False

    def out(columns: dict, head: list, tail: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(columns | {"head": head, "tail": tail}, schema=_ARROW)

    for batch in batches:
        for i, j in passes(batch, "text"):
            part = batch.slice(i, j - i)
            ids = part.column("doc_id").to_pylist()
            texts = [t.decode() for t in as_bytes(part.column("text")).to_pylist()]
            if held:
                ids, texts = [held_id, *ids], [held_text, *texts]
            head = [None] * (len(ids) - 1)
            if len(ids) > 1:
                if not begun:
                    head[0], begun = texts[0], True
                yield out(_rows(ids[:-1], texts[:-1], texts[1:]), head, [None] * (len(ids) - 1))
            held, held_id, held_text = True, ids[-1], texts[-1]
    if held:
        blank = {c.name: [None] for c in _ARROW if c.name not in ("head", "tail", "doc_id")}
        yield out({"doc_id": [held_id], **blank}, [None if begun else held_text], [held_text])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j in passes(batch, "tail"):
            part = batch.slice(i, j - i)
            for d, t, n in zip(part.column("doc_id").to_pylist(), part.column("tail").to_pylist(), part.column("after").to_pylist(), strict=True):
                row = _rows([d], [t], [n])
                yield pa.RecordBatch.from_pydict(row, schema=pa.schema(list(_ARROW)[:7]))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next:
    each document against its edited text and the next document by descending doc_id."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(ranges(docs), F.col("doc_id").desc_nulls_last()).sortWithinPartitions(F.col("doc_id").desc_nulls_last(), "text")
    done = stash(ordered.mapInArrow(tidy(_stream), _SCHEMA + ", head string, tail string").withColumn("part", F.spark_partition_id()), "fingerprints")
    # two texts of each partition; the partitions are a few, whatever the documents are
    heads = done.where(F.col("head").isNotNull()).select("part", "head")
    tails = done.where(F.col("tail").isNotNull()).select("part", "doc_id", "tail")
    # (Window over the partitions' numbers alone; the last wraps round to the first)
    around = Window.partitionBy()
    numbers = heads.select("part")
    after = numbers.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(around)).alias("next"))
    pairs = tails.join(after, "part").join(heads.select(F.col("part").alias("next"), F.col("head").alias("after")), "next").select("doc_id", "tail", "after")
    cols = [c.split()[0] for c in _SCHEMA.split(", ")]
    return done.where(F.col("tail").isNull()).select(*cols).unionByName(pairs.mapInArrow(_finish, _SCHEMA))
