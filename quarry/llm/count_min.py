"""Count-min sketches: one per partition, merged, and read as bitmaps.

A partition counts its keys in the cells of ROWS hash functions. Counts add up, so merging
partitions gives a sketch of all rows; the least of a key's cells never falls below its
true count. Readers only ask whether a key may occur twice and whether it may be hot, so the
merged sketch is broadcast as one bit for each cell, and a list of the hot cells.

There are 2**width cells in a row, chosen from the input's size: four for each key that is
expected (of 100 single keys five then pass as repeated), up to 2**MOST_WIDTH, which is what
a broadcast of 64 MB holds. Beyond, with more keys than cells, more and more single keys pass;
none is lost, and what passes is grouped exactly. A cell is hot if it holds HOT keys more than
four times what cells hold on average, so that a fuller sketch calls no more keys hot.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from quarry.llm import kernels
from quarry.llm.common import tidy

LEAST_WIDTH, MOST_WIDTH = 20, 28
CELLS_A_KEY = 4
ROWS = 2
#: A key that may occur this often (above what its cells hold anyway) is hot.
HOT = 200
#: keys that a task counts at a time
HELD = 1 << 22
_PIECE = 16
_SALT = (np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0x1F83D9ABFB41BD6B))


def width_for(keys: float) -> int:
    """The width of a sketch for so many keys."""
    return max(LEAST_WIDTH, min(MOST_WIDTH, math.ceil(math.log2(max(1.0, keys * CELLS_A_KEY)))))


def cells(keys: np.ndarray, row: int, width: int) -> np.ndarray:
    return (kernels.mix(keys ^ _SALT[row]) >> np.uint64(64 - width)).astype(np.uint32)


class Sketch:
    """The merged bitmaps, packed, and the hot cells in order."""

    def __init__(self, width: int, twice: list[bytes], hot: list[np.ndarray]):
        self.width, self.twice, self.hot = width, twice, hot

    def repeated(self, keys: np.ndarray) -> np.ndarray:
        """Which keys may occur more than once: every key that does is among them."""
        yes = np.ones(len(keys), dtype=bool)
        for r in range(ROWS):
            at = cells(keys, r, self.width)
            bits = np.frombuffer(self.twice[r], dtype=np.uint8)
            yes &= (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return yes

    def is_hot(self, keys: np.ndarray) -> np.ndarray:
        yes = np.ones(len(keys), dtype=bool)
        for r in range(ROWS):
            yes &= np.isin(cells(keys, r, self.width), self.hot[r])
        return yes


def build(docs: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterable[np.ndarray]], width: int) -> Sketch:
    """The sketch of all keys that keys_of finds in the batches of docs."""
    rare = HOT

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            keys = np.concatenate(held)
            held.clear()
            for r in range(ROWS):
                at, n = np.unique(cells(keys, r, width), return_counts=True)
                n = np.minimum(n, 65535).astype(np.uint16)
                piece = at >> _PIECE
                cut = np.concatenate([[0], np.flatnonzero(piece[1:] != piece[:-1]) + 1, [len(at)]]).tolist()
                low = (at & np.uint32((1 << _PIECE) - 1)).astype(np.uint16)
                parts = [pack.compress(np.diff(low[i:j], prepend=np.uint16(0)).tobytes() + n[i:j].tobytes()) for i, j in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_pydict({"r": pa.array(np.full(len(parts), r, np.int32)), "piece": pa.array(piece[cut[:-1]].astype(np.int32)), "counts": pa.array(parts, pa.binary())})

        size = 0
        for batch in batches:
            for keys in keys_of(batch):
                held.append(keys)
                size += len(keys)
                if size >= HELD:
                    yield from flush()
                    size = 0
        if size:
            yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        at, total = None, np.zeros(1 << _PIECE, np.int64)

        def done() -> pa.RecordBatch:
            twice = np.packbits(total >= 2, bitorder="little").tobytes()
            hot = np.flatnonzero(total >= rare + 4 * total.mean()).astype(np.uint32) + np.uint32(at[1] << _PIECE)
            return pa.RecordBatch.from_pydict({"r": pa.array([at[0]], pa.int32()), "piece": pa.array([at[1]], pa.int32()), "twice": [pack.compress(twice)], "hot": [hot.tobytes()]})

        for batch in batches:
            for r, i, z in zip(*(batch.column(k).to_pylist() for k in ("r", "piece", "counts")), strict=True):
                if (r, i) != at:
                    if at is not None:
                        yield done()
                    at = (r, i)
                    total[:] = 0
                both = np.frombuffer(unpack.decompress(z), dtype=np.uint16)
                low = np.cumsum(both[: len(both) // 2], dtype=np.int64)
                total[low] += both[len(both) // 2 :]
        if at is not None:
            yield done()

    counted = docs.mapInArrow(tidy(count), "r int, piece int, counts binary")
    merged = counted.repartition("r", "piece").sortWithinPartitions("r", "piece").mapInArrow(merge, "r int, piece int, twice binary, hot binary")
    size = (1 << _PIECE) // 8
    twice = [bytearray(max(1 << width, 1 << _PIECE) // 8) for _ in range(ROWS)]
    hot: list[list[np.ndarray]] = [[] for _ in range(ROWS)]
    unpack = zstandard.ZstdDecompressor()
    for row in merged.toLocalIterator():  # at most ROWS * 2**(MOST_WIDTH - _PIECE) rows of 8 KB
        twice[row["r"]][row["piece"] * size : (row["piece"] + 1) * size] = unpack.decompress(bytes(row["twice"]))
        hot[row["r"]].append(np.frombuffer(bytes(row["hot"]), np.uint32))
    return Sketch(width, [bytes(x) for x in twice], [np.sort(np.concatenate([np.zeros(0, np.uint32), *x])) for x in hot])
