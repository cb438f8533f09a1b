"""N-gram Jaccard join: which documents are linked, directly or through others.

A Rule says how many words a shingle has and from which similarity sets are linked; block
counts, size rule, parity bound and verification follow from it. OP8 is the rule of op8.

Sets are laid out by hash position and cut into position blocks; each set puts in the index
one block more than it can differ in from a linked set, so linked sets share a whole
block. The index has a list for each block's content; a list's entries carry the set's size
and the block's position in it. The part of a list that sizes and positions rule out is
skipped as a block (index-level skipping). Answers are derived from those of similar sets
(answer-level skipping): equal sets are one set; in a list, sets are first compared with
the list's leader only, and a set that is linked to it takes over its answers; then a list's
components are compared through one set each. Only after that, sets of one list that are
still in different components are compared with each other, so no link between components
is missed, and the pairs inside a component are never formed.

Pairs are checked by parities of the sets (a bound on how far they differ), and what passes by
the shingle sets of the two whole texts. Only texts in such pairs are shuffled.

Defined cases: a null or empty text, or one without words, has an empty set and is linked
with nothing; fewer words than a shingle form one shingle; rows that share a doc_id are
one node; a null doc_id is its own component (null); an empty table gives an empty result;
other columns are ignored. Shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import kernels, repeats
from quarry.llm.common import BATCH_BYTES, as_bytes, discard, passes, stash, tidy
from quarry.llm.components import components

#: bits of a key of the index, and entries that a map task packs at a time
KEY_BITS, HELD = 48, 1 << 20
#: bits of a set's parities: a bound on how far two sets differ
PARITY = 512
#: members that one copy of a leader's text is compared with
MEMBERS = 256
#: sets that a map task remembers at most, and bits, at most, of the bitmap of needed texts
KNOWN, BITS = 1_000_000, 25
#: bits, at most, of the bitmaps of documents that go and that stay (8 MB each)
KEPT_BITS = 26
#: cells of a bitmap for each document, until it has all its bits
CELLS = 64


def _enough(least: int, differ: int) -> int:
    """Blocks of which `least` shingles fill more than `differ` but for one set in many
    thousands (by four standard deviations)."""
    m = differ + 1
    while True:
        free = (1 - 1 / m) ** least
        var = m * (m - 1) * max(0.0, 1 - 2 / m) ** least + m * free - (m * free) ** 2
        if m - m * free - 4 * max(var, 0.0) ** 0.5 >= differ + 1:
            return m
        m += -(-m // 50)


@dataclass(frozen=True)
class Rule:
    """Sets of shingles of so many words are linked from a similarity of num / den, 3 / 4 at
    least: sets that may differ in more cannot fill the blocks that their links need."""

    words: int
    num: int
    den: int

    def __post_init__(self):
        if not 3 * self.den <= 4 * self.num < 4 * self.den:
            raise ValueError("similarities from 3/4 to below 1 can be joined")

    @cached_property
    def bounds(self) -> np.ndarray:
        """Where bands of sizes begin; below the second only equal sets are linked. A set's
        least partner is in its own band or the one before."""
        out = [1, self.num // (self.den - self.num)]
        while out[-1] < 1 << 40:
            out.append(-(-out[-1] * 3 // 2))
        return np.array(out, dtype=np.int64)

    @cached_property
    def differ(self) -> np.ndarray:
        """In how many shingles linked sets differ at most, the smaller being of the band."""
        most = self.bounds[1:] - 1
        return (most + most * self.den // self.num) * (self.den - self.num) // (self.den + self.num)

    @cached_property
    def spare(self) -> np.ndarray:
        """Blocks in place of empty ones. Where a block holds few shingles many are empty."""
        out = (self.differ + 1) // 20
        for b, (least, d) in enumerate(zip(self.bounds[:-1].tolist(), self.differ.tolist(), strict=True)):
            if d and least < 4 * (d + 1):
                out[b] = max(out[b], _enough(least, d) - d - 1)
        return out

    @cached_property
    def blocks(self) -> np.ndarray:
        return self.differ + 1 + self.spare

    def least(self, n):
        """Size of the smallest set that a set of n can be linked with."""
        return -(-self.num * n // self.den)

    def apart(self, na, nb):
        """In how many shingles linked sets of these sizes differ at most."""
        return (na + nb) * (self.den - self.num) // (self.den + self.num)

    def sizes(self, na, nb):
        """Whether sizes leave a link possible."""
        return self.den * np.minimum(na, nb) >= self.num * np.maximum(na, nb)

    def near(self, differ, na, nb):
        """Whether sets that differ in so many shingles can be linked."""
        return (self.den + self.num) * differ <= (self.den - self.num) * (na + nb)

    def linked(self, common: int, union: int) -> bool:
        return self.den * common >= self.num * union


OP8 = Rule(words=3, num=9, den=10)


def shingles(texts: list[bytes], rule: Rule = OP8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hash) of the distinct shingles, sorted, and how many each text has."""
    ids, h = kernels.shingle_sets(texts, rule.words, lower=True)
    order = np.lexsort((h, ids))
    ids, h = ids[order], h[order]
    if len(ids):
        keep = np.concatenate([[True], (ids[1:] != ids[:-1]) | (h[1:] != h[:-1])])
        ids, h = ids[keep], h[keep]
    return ids, h, np.bincount(ids, minlength=len(texts))


def blocks(ids: np.ndarray, h: np.ndarray, n: np.ndarray, rule: Rule = OP8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, key, shingles in the blocks before) of the position blocks that a set
    puts in the index: of its band's, in order, one filled block more than it can differ in
    from a linked set. (The shorter of two such beginnings holds a block that both share.)
    A set that does not fill so many puts all in, the empty ones too."""
    out = []
    own = np.searchsorted(rule.bounds, n, side="right") - 1
    low = np.searchsorted(rule.bounds, rule.least(n), side="right") - 1
    for band, use in ((own, n > 0), (low, (n > 0) & (low < own))):
        at = use[ids]
        i, x = ids[at], h[at]
        if not len(i):
            continue
        b = np.maximum(band, 0)
        # own band: with a larger set; the one before: with a set of that band
        differ = rule.apart(n, np.where(band == own, n * rule.den // rule.num, np.minimum(n, rule.bounds[b + 1] - 1)))
        m = np.where(use, rule.blocks[b], 0)
        first = np.cumsum(m) - m
        salt = kernels.mix((b[i] + 77).astype(np.uint64))
        cell = first[i] + (kernels.mix(x ^ salt) % m[i].astype(np.uint64)).astype(np.int64)
        total = np.zeros(int(m.sum()), dtype=np.uint64)
        np.add.at(total, cell, kernels.mix(x + np.uint64(0x632BE59BD9B4E019)))
        count = np.bincount(cell, minlength=len(total))
        filled = count > 0
        owner = np.repeat(np.arange(len(n)), m)
        place = np.arange(len(total)) - first[owner]
        rank, before = _within(filled, first, owner) + filled, _within(count, first, owner)
        some = np.bincount(owner[filled], minlength=len(n))
        keep = np.where((some > differ)[owner], filled & (rank <= differ[owner] + 1), True)
        key = kernels.mix(total + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + kernels.mix((b[owner] + 1000).astype(np.uint64)))
        out.append((owner[keep], key[keep], before[keep]))
    if not out:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _within(x: np.ndarray, first: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Sums of what stands before each place among its owner's."""
    total = np.concatenate([[0], np.cumsum(x)])
    return total[:-1] - total[first][owner]


def parities(ids: np.ndarray, h: np.ndarray, texts: int) -> list[bytes]:
    """For each text PARITY bits: whether an odd number of its shingles fall in a cell. A
    shingle that only one of two sets has flips one bit, so the bits that differ are at
    most the shingles that differ."""
    cell = (kernels.mix(h ^ np.uint64(0xD1B54A32D192ED03)) >> np.uint64(64 - PARITY.bit_length() + 1)).astype(np.int64)
    odd = (np.bincount(ids * PARITY + cell, minlength=PARITY * texts) & 1).astype(np.uint8).reshape(texts, PARITY)
    return [r.tobytes() for r in np.packbits(odd, axis=1)]


_SETS = "doc long, n long, first long, s long, t long, odd binary"
_LISTED = "kind int, g long, a long, b long"
LIST, PAIR = 0, 1


def _sets(docs: DataFrame, rule: Rule) -> DataFrame:
    """The written table of sets: doc, size, two sums over the shingles, parities, and the
    document of an equal set that the same map task saw first (itself, if none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, int, int], int] = {}
        for batch in batches:
            for i, j in passes(batch, "text", repeats.PASS):
                part = batch.slice(i, j - i)
                doc = part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
                ids, h, n = shingles(as_bytes(part.column("text")).to_pylist(), rule)
                s, t = _sums(ids, h, len(doc))
                first = _first_seen(known, s, t, n, doc)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc, n.astype(np.int64), first, s.view(np.int64), t.view(np.int64), parities(ids, h, len(doc)))], ["doc", "n", "first", "s", "t", "odd"])

    return stash(docs.mapInArrow(tidy(run), _SETS), "jaccard-sets")


def _sums(ids: np.ndarray, h: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    out = np.zeros((2, texts), dtype=np.uint64)
    np.add.at(out[0], ids, kernels.mix(h ^ np.uint64(0xA24BAED4963EE407)))
    np.add.at(out[1], ids, kernels.mix(h ^ np.uint64(0x9FB21C651E98DF25)))
    return out[0], out[1]


def _first_seen(known: dict, s: np.ndarray, t: np.ndarray, n: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each set the document that had an equal one first; empty sets stand alone."""
    if len(known) > KNOWN:  # what is forgotten meets its equals later
        known.clear()
    return np.array([known.setdefault(key, d) if key[2] else d for key, d in zip(zip(s.tolist(), t.tolist(), n.tolist(), strict=True), doc.tolist(), strict=True)], dtype=np.int64)


def _copies(sets: DataFrame) -> DataFrame:
    """Links (u, v) that join all documents of equal sets: those of one map task with its
    first, and the first ones with the least (a row per task for a hot set)."""
    firsts = sets.where((F.col("n") > 0) & (F.col("first") == F.col("doc")))
    least = firsts.groupBy("s", "t", "n").agg(F.min("doc").alias("v"))
    return sets.where(F.col("first") != F.col("doc")).select(F.col("doc").alias("u"), F.col("first").alias("v")).unionByName(firsts.join(least, ["s", "t", "n"]).where("doc <> v").select(F.col("doc").alias("u"), "v"))


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers as their lowest bytes, then their next ones, and so on: what a sorted or a
    narrow column has in common lies together."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(8, -1).T).reshape(-1).view("<i8")


def _bundles(held: list, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, z): the entries (key, document, size and place) of held, sorted by key and
    packed: keys as their distances, documents by their number in a list of the bundle's."""
    if not held or not sum(len(x[0]) for x in held):
        return
    g, doc, at = (np.concatenate(x) for x in zip(*held, strict=True))
    held.clear()
    bucket = ((g >> np.uint64(KEY_BITS - 32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
    order = np.argsort(g)  # buckets are ranges of keys
    g, doc, at, bucket = g[order], doc[order], at[order], bucket[order]
    border = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(g)]])
    pack = zstandard.ZstdCompressor(level=1)
    names, z, size = [], [], 0
    for i, j in zip(border[:-1].tolist(), border[1:].tolist(), strict=True):
        own, number = np.unique(doc[i:j], return_inverse=True)
        size_of = np.zeros(len(own), dtype=np.int64)
        size_of[number] = at[i:j] >> 32
        same = (size_of[number] == at[i:j] >> 32).all()
        columns = (np.diff(g[i:j], prepend=np.uint64(0)), number, at[i:j] & 0xFFFFFFFF if same else at[i:j])
        head = np.array([j - i, len(own), same], dtype="<i8").tobytes()
        names.append(bucket[i])
        z.append(pack.compress(head + own.astype("<i8").tobytes() + size_of.astype("<i8").tobytes() + b"".join(_planes(x) for x in columns)))
        size += len(z[-1])
        if size > BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(z, pa.binary())], ["bucket", "z"])
            names, z, size = [], [], 0
    if names:
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(z, pa.binary())], ["bucket", "z"])


def _unbundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries (g, doc, at) of bundles."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for z in batch.column("z"):
            raw = unpack.decompress(z.as_py())
            n, docs, same = np.frombuffer(raw, dtype="<i8", count=3).tolist()
            own, size_of = np.frombuffer(raw, dtype="<i8", count=2 * docs, offset=24).reshape(2, docs)
            begin = 24 + 16 * docs
            gap, number, at = (_numbers(raw[begin + i * 8 * n : begin + (i + 1) * 8 * n]) for i in range(3))
            at = size_of[number] << 32 | at if same else at
            yield pa.RecordBatch.from_arrays([pa.array(np.cumsum(gap)), pa.array(own[number]), pa.array(at)], ["g", "doc", "at"])


def _lists(docs: DataFrame, rule: Rule) -> DataFrame:
    """The written index without lists of one document: LIST rows (g, a: doc, b: size and
    shingles before the block) and PAIR rows (a: a list's leader, b: a set near it).

    Nearly all entries stand alone in their lists but must meet the others to be told so: they
    are shuffled in bundles, of which an entry takes half the bytes of a row."""
    buckets = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, int, int], int] = {}
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            for i, j in passes(batch, "text", repeats.PASS):
                part = batch.slice(i, j - i)
                doc = part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
                ids, h, n = shingles(as_bytes(part.column("text")).to_pylist(), rule)
                fresh = _first_seen(known, *_sums(ids, h, len(doc)), n, doc) == doc
                keep = fresh[ids]  # of equal sets in a task one is indexed
                owner, key, before = blocks(ids[keep], h[keep], np.where(fresh, n, 0), rule)
                held.append((key >> np.uint64(64 - KEY_BITS), doc[owner], n[owner] << 32 | before))
                if sum(len(x[0]) for x in held) > HELD:
                    yield from _bundles(held, buckets)
        yield from _bundles(held, buckets)

    dealt = docs.mapInArrow(tidy(emit), "bucket int, z binary").repartition("bucket").select("z").mapInArrow(tidy(_unbundled), "g long, doc long, at long").sortWithinPartitions("g", "doc")
    return stash(dealt.mapInArrow(tidy(partial(_led, rule=rule)), _LISTED), "jaccard-lists")


def _listed(kind: int, g: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, dtype=np.int32)), *[pa.array(np.ascontiguousarray(x)) for x in (g, a, b)]], ["kind", "g", "a", "b"])


def _near(rule: Rule, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether sizes and positions leave a link possible: two sets that share a block differ
    at least by what stands before it in one and not in the other, and behind it likewise."""
    nx, ny, ix, iy = x >> 32, y >> 32, x & 0xFFFFFFFF, y & 0xFFFFFFFF
    return rule.sizes(nx, ny) & rule.near(np.abs(ix - iy) + np.abs((nx - ix) - (ny - iy)), nx, ny)


def _led(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """Rows (g, doc, at) sorted by g and doc. A list's first set leads; sets that sizes and
    positions rule out skip, as a block, to a leader of their own. (The least doc_id leads in
    most of a group's lists, so a group has few leaders.) Lists of two sets, and those in which
    no set is near another, have nothing else to tell and end here. Of a list that goes on in
    the next batch only its leaders are held (and all of it, while that is two sets)."""
    held = {k: np.zeros(0, dtype=np.int64) for k in ("g", "doc", "at", "sent")}
    for batch in batches:
        if not batch.num_rows:
            continue
        g, doc, at = (np.concatenate([held[k], batch.column(k).to_numpy(zero_copy_only=False)]) for k in ("g", "doc", "at"))
        old = np.arange(len(g)) < len(held["g"])
        sent = np.concatenate([held["sent"], np.zeros(batch.num_rows, dtype=np.int64)])
        new_list = np.concatenate([[True], g[1:] != g[:-1]])
        run = np.cumsum(new_list) - 1
        n_docs = np.bincount(run, weights=np.concatenate([[True], doc[1:] != doc[:-1]]) | new_list)
        leads = np.zeros(len(g), dtype=bool)
        left = np.flatnonzero(n_docs[run] > 1)
        pairs = []
        while len(left):
            lead = np.concatenate([[True], g[left][1:] != g[left][:-1]])
            own = left[np.flatnonzero(lead)][np.cumsum(lead) - 1]
            leads[own] = True
            near = _near(rule, at[left], at[own])
            other = near & ~old[left] & (doc[left] != doc[own])
            pairs.append((doc[own[other]], doc[left[other]]))
            left = left[~near]
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (doc[:0], doc[:0])
        if len(a):
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            yield _listed(PAIR, np.zeros(int(new.sum()), dtype=np.int64), a[new], b[new])
        # the last list may go on: what is known of it so far decides only if it is told already
        known = np.bincount(run, weights=sent) > 0
        followed = np.bincount(run, weights=~leads) > 0
        tell = known | ((n_docs > 2) & followed)
        last = run == run[-1]
        out = tell[run] & (sent == 0)
        if out.any():
            yield _listed(LIST, g[out], doc[out], at[out])
        # lists that are not told yet are held whole: they have two sets, or leaders alone
        keep = last & (leads | ~tell[run])
        held = {"g": g[keep], "doc": doc[keep], "at": at[keep], "sent": tell[run[keep]].astype(np.int64)}


_PAIR = "a long, b long"


def _paired(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in (a, b)], ["a", "b"])


def _bridges(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """Lists sorted by component: one set of each further component with the first one's."""
    held = None
    for batch in batches:
        g, comp, doc, at = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("g", "root", "a", "b"))
        if not len(g):
            continue
        if held is not None:
            g, comp, doc, at = (np.concatenate([h, x]) for h, x in zip(held, (g, comp, doc, at), strict=True))
        new_list = np.concatenate([[True], g[1:] != g[:-1]])
        new = new_list | np.concatenate([[True], comp[1:] != comp[:-1]])
        own = np.flatnonzero(new_list)[np.cumsum(new_list) - 1]
        other = np.flatnonzero(new & ~new_list)
        ok = other[_near(rule, at[other], at[own[other]])]
        if len(ok):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[own[ok]], doc[ok], np.ones(len(ok), dtype=np.int64))], ["a", "b", "w"])
        # the last list goes on with its first set and the last component's
        keep = np.unique([own[-1], np.flatnonzero(new)[-1]])
        held = tuple(x[keep] for x in (g, comp, doc, at))


def _across(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """Pairs of one list in different components that sizes, positions and parities leave
    possible; lists sorted by size."""
    for x in repeats.whole_runs(batches):
        g, doc, comp, at = x["g"], x["a"], x["root"], x["b"]
        odd = np.frombuffer(b"".join(x["odd"].to_pylist()), dtype=np.uint64).reshape(-1, PARITY // 64)
        border = np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1, [len(g)]])
        mixed = np.minimum.reduceat(comp, border[:-1]) != np.maximum.reduceat(comp, border[:-1])
        found: tuple[list, list] = ([], [])
        for i, j in zip(border[:-1][mixed].tolist(), border[1:][mixed].tolist(), strict=True):
            # sizes within reach are a block behind each set
            n = at[i:j] >> 32
            reach = np.searchsorted(n, n * rule.den // rule.num, side="right") + i
            for k in range(i, j - 1):
                b = np.arange(k + 1, reach[k - i])
                b = b[(comp[b] != comp[k])]
                b = b[_near(rule, at[b], at[k])]
                if len(b):
                    differ = np.bitwise_count(odd[b] ^ odd[k]).sum(axis=1, dtype=np.int64)
                    b = b[rule.near(differ, at[b] >> 32, at[k] >> 32)]
                if len(b):
                    found[0].append(np.full(len(b), doc[k]))
                    found[1].append(doc[b])
        if found[0]:
            a, b = np.concatenate(found[0]), np.concatenate(found[1])
            # the set of more pairs leads
            names, where, many = np.unique(np.concatenate([a, b]), return_inverse=True, return_counts=True)
            swap = many[where[len(a) :]] > many[where[: len(a)]]
            a, b = np.where(swap, b, a), np.where(swap, a, b)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a, b, many[np.searchsorted(names, a)])], ["a", "b", "w"])


def _dealt(pairs: DataFrame) -> DataFrame:
    """Rows (a, salt, role, doc): pairs in groups of at most MEMBERS of one leader, which is
    the row of role 0. A leader's pairs may lie in many ranges, and so in many tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        last, seen = None, 0
        for batch in batches:
            a, b = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("a", "b"))
            if not len(a):
                continue
            new = np.concatenate([[a[0] != last], a[1:] != a[:-1]])
            begin = np.maximum.accumulate(np.where(new, np.arange(len(a)), -1))
            place = np.where(begin >= 0, np.arange(len(a)) - begin, np.arange(len(a)) + seen)
            salt = part + place // MEMBERS
            lead = np.flatnonzero(place % MEMBERS == 0)
            last, seen = a[-1], int(place[-1]) + 1
            rows = (np.concatenate([a, a[lead]]), np.concatenate([salt, salt[lead]]), np.concatenate([np.ones(len(a), dtype=np.int32), np.zeros(len(lead), dtype=np.int32)]), np.concatenate([b, a[lead]]))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], ["a", "salt", "role", "doc"])

    return pairs.repartitionByRange("a", "b").sortWithinPartitions("a", "b").mapInArrow(run, "a long, salt long, role int, doc long")


def _groups(rows: DataFrame, step: Callable, rule: Rule) -> DataFrame:
    return rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "role", "doc").mapInArrow(tidy(partial(step, rule=rule)), _PAIR)


def _possible(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """Pairs that sizes and parities leave possible. Rows (a, salt, role, doc, n, odd)."""
    held = None
    for batch in batches:
        a, salt, role, doc, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("a", "salt", "role", "doc", "n"))
        if not len(a):
            continue
        odd = np.frombuffer(b"".join(batch.column("odd").to_pylist()), dtype=np.uint64).reshape(-1, PARITY // 64)
        if held is not None:
            a, salt, role, doc, n, odd = (np.concatenate([h, x]) for h, x in zip(held, (a, salt, role, doc, n, odd), strict=True))
        lead = np.maximum.accumulate(np.where(role == 0, np.arange(len(a)), 0))
        differ = np.bitwise_count(odd ^ odd[lead]).sum(axis=1, dtype=np.int64)
        ok = (role == 1) & rule.sizes(n, n[lead]) & rule.near(differ, n, n[lead])
        if ok.any():
            yield _paired(a[ok], doc[ok])
        held = tuple(x[lead[-1] : lead[-1] + 1] for x in (a, salt, role, doc, n, odd))


def _verify(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """Pairs whose texts are linked. Rows (a, salt, role, doc, z)."""
    lead_set = None
    for batch in batches:
        for part in repeats.z_passes(batch):
            ids, h, n = shingles(repeats.unpacked(part), rule)
            first = np.searchsorted(ids, np.arange(len(n) + 1))
            a, b = [], []
            for t, (x, role, doc) in enumerate(zip(*(part.column(f).to_pylist() for f in ("a", "role", "doc")), strict=True)):
                own = h[first[t] : first[t + 1]]
                if role == 0:
                    lead_set = own
                else:
                    at = np.searchsorted(lead_set, own)
                    common = int((lead_set[np.minimum(at, len(lead_set) - 1)] == own).sum())
                    if rule.linked(common, len(own) + len(lead_set) - common):
                        a.append(x)
                        b.append(doc)
            if a:
                yield _paired(np.array(a, dtype=np.int64), np.array(b, dtype=np.int64))


def _bits(n: int, most: int) -> int:
    """Bits of a bitmap for n documents: a broadcast stands in the driver several times over,
    so few documents get a small one."""
    return min(most, (CELLS * max(n, 1) - 1).bit_length())


def _bitmap(docs: DataFrame, bits: int) -> DataFrame:
    """bucket, bits: a bitmap of 2**bits bits in which the cells of doc are set."""
    cell = F.pmod(F.xxhash64(F.col("doc")), F.lit(1 << bits))
    return docs.select("doc").withColumn("cell", cell).groupBy(F.bitmap_bucket_number("cell").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits"))


def _told(docs: DataFrame, key: str, maps: DataFrame, name: str, bits: int) -> DataFrame:
    """docs with a column `name`: whether the bitmap has the cell of their key."""
    cell = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << bits))
    maps = maps.select(F.col("bucket").alias("__q_bucket"), F.col("bits").alias("__q_bits"))
    joined = docs.withColumn("__q_cell", cell).join(F.broadcast(maps), F.bitmap_bucket_number("__q_cell") == F.col("__q_bucket"), "left")
    joined = joined.withColumn("__q_bit", F.bitmap_bit_position("__q_cell").cast("int"))
    byte = F.conv(F.hex(F.expr("substring(__q_bits, __q_bit div 8 + 1, 1)")), 16, 10).cast("int")
    joined = joined.withColumn("__q_byte", byte).withColumn(name, F.coalesce(F.expr("shiftright(__q_byte, __q_bit % 8) & 1 = 1"), F.lit(False)))
    return joined.drop("__q_cell", "__q_bucket", "__q_bits", "__q_bit", "__q_byte")


def _texts(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """doc and packed text of the documents in needed (written), and of few others: a bitmap of
    2**BITS bits at most (4 MB) drops most of the rest before texts are shuffled."""
    bits = _bits(needed.count(), BITS)
    held = _told(docs.select("doc_id", "text"), "doc_id", _bitmap(needed, bits), "__q_held", bits).where("__q_held")
    return repeats.packed(held.select("doc_id", "text")).select(F.col("doc_id").alias("doc"), "z").dropDuplicates(["doc"])


def _linked(pairs: DataFrame, docs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The written pairs (a, b) whose texts are linked."""
    maybe = stash(_groups(_dealt(pairs).join(sets.select("doc", "n", "odd").dropDuplicates(["doc"]), "doc"), _possible, rule), "jaccard-maybe")
    rows = stash(_dealt(maybe), "jaccard-rows")
    out = stash(_groups(rows.join(_texts(docs, rows.select("doc")), "doc"), _verify, rule), "jaccard-links")
    discard(maybe, rows)
    return out


def classes(docs: DataFrame, rule: Rule = OP8) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable by links)."""
    nulls = docs.where(F.col("doc_id").isNull()).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    docs = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sets = _sets(docs, rule)
    index = _lists(docs, rule)
    lists = index.where(F.col("kind") == LIST)
    pairs = stash(index.where(F.col("kind") == PAIR).select("a", "b").distinct(), "jaccard-pairs")
    links = _linked(pairs, docs, sets, rule)
    edges = lambda links: links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    comps = components(edges(links).unionByName(_copies(sets)))
    done = [index, pairs, links]

    def rooted() -> DataFrame:
        rows = lists.select("g", "a", "b").join(comps, F.col("a") == F.col("doc"), "left")
        return rows.select("g", "a", "b", F.coalesce("root", "a").alias("root"))

    tried = pairs
    # components meet through one set each before sets are compared one by one
    for step, order in ((_bridges, ("root", "a")), (_across, ("b",))):
        rows = rooted()
        if step is _across:  # of the lists that hold several components still
            several = rows.groupBy("g").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("g")
            rows = rows.join(several, "g").join(sets.select(F.col("doc").alias("a"), "odd").dropDuplicates(["a"]), "a")
        found = rows.repartition("g").sortWithinPartitions("g", *order).mapInArrow(tidy(partial(step, rule=rule)), _PAIR + ", w long")
        # each pair once, led by the set that leads most
        found = found.groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.max_by("a", "w").alias("a"))
        known = tried.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
        fresh = found.join(known, ["u", "v"], "left_anti")
        pairs = stash(fresh.select("a", F.when(F.col("a") == F.col("u"), F.col("v")).otherwise(F.col("u")).alias("b")), "jaccard-pairs")
        links = _linked(pairs, docs, sets, rule)
        tried = tried.unionByName(pairs)
        done += [pairs, links]
        if links.take(1):
            comps = components(comps.select(F.col("doc").alias("u"), F.col("root").alias("v")).unionByName(edges(links)))
    sizes = sets.select("doc", "n")
    out = sizes.join(comps, "doc", "left").select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("root", "doc").alias("component_id"))
    discard(*done)
    return out.unionByName(nulls)


def representatives(docs: DataFrame, rule: Rule = OP8) -> DataFrame:
    """docs without those that are not the first of their component; all columns stay.
    Rows that share the kept doc_id stay."""
    found = classes(docs, rule).where(F.col("doc_id").isNotNull())
    found = stash(found.select(F.col("doc_id").alias("doc"), (F.col("doc_id") == F.col("component_id")).alias("first")), "jaccard-found")
    return _kept(docs, found)


def _kept(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs without those that found (doc, first) tells to be no first ones. Two bitmaps, of the
    documents that go and of those that stay, settle nearly all where they lie; only rows with
    cells in both are shuffled, to be told exactly."""
    both = _judged(docs, found)
    gone = found.where(~F.col("first")).select(F.col("doc").alias("__q_doc")).distinct()
    unsure = both.where(F.col("__q_gone") & F.col("__q_stays")).select(*docs.columns)
    unsure = unsure.join(gone, unsure["doc_id"] == gone["__q_doc"], "left_anti")
    return both.where(~F.col("__q_gone")).select(*docs.columns).unionByName(unsure)


def _judged(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with __q_gone, __q_stays: whether either bitmap has their cell."""
    out = docs.withColumn("__q_id", F.col("doc_id").cast("long"))
    bits = _bits(found.count(), KEPT_BITS)
    for name, rows in (("__q_gone", found.where(~F.col("first"))), ("__q_stays", found.where("first"))):
        out = _told(out, "__q_id", _bitmap(rows, bits), name, bits)
    # a null doc_id is nobody's copy
    return out.withColumn("__q_gone", F.col("__q_gone") & F.col("doc_id").isNotNull())


#: the result of classes() with OP8 in DuckDB SQL (for tables whose pairs fit in memory)
ORACLE = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
either AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a, b FROM either UNION SELECT reach.a, either.b FROM reach JOIN either ON reach.b = either.a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, least(doc_id, coalesce((SELECT min(b) FROM reach WHERE a = doc_id), doc_id)) AS component_id FROM d LEFT JOIN n USING (doc_id)"""
