"""A stored inverted index: postings by term in aligned blocks, top-k without reading them all.

A segment holds the postings of the documents that were appended together. Its documents
lie in slices of about SLICE_DOCS that are alike in length; a block is one term's postings
of one slice, with the largest frequency and the least length in it. Blocks are
partitioned by a checksum of the term and sorted by term, so a query reads its words'
partitions, and of those first the blocks' heads alone:

1. the heads bound what a slice's documents can score (BM25 rises with the frequency and
   falls with the length, so the bound holds whatever the collection's averages become);
2. the PROBE slices of the highest bounds are scored, and their k-th score is a threshold;
3. slices whose bound reaches the threshold are scored, all others are never read.

Appending writes a new segment, deleting a list of keys; merging writes one segment of what
is left. `_META` names what counts and is replaced in one step, so a reader sees all of a
change or nothing of it. Files that are no longer named are deleted by vacuum().
"""

from __future__ import annotations

import json
import math
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators import search
from quarry.sources import files

LAYOUT = 1
SLICE_DOCS = 1024
PROBE = 4
#: Partitions by term of a segment: one for so many words, within these bounds.
BUCKET_WORDS, BUCKETS = 1 << 22, (16, 4096)
#: Words of the documents whose blocks are sorted and written by one task: their tokens are
#: divided among tasks, and the postings of a token by so many documents.
TASK_WORDS, SPREAD_DOCS = 1 << 20, 1 << 18
#: Documents whose postings are listed together on their way to the blocks.
LIST_DOCS = 4096
#: scores are rounded to six digits; bounds give way by as much
SLACK = 2e-6


@dataclass
class Segment:
    name: str
    docs: int
    words: int
    buckets: int


@dataclass
class Meta:
    """What counts: segments, lists of deleted keys, and how words are read."""

    key: str
    key_type: str
    weights: dict[str, float]
    stem: bool
    segments: list[Segment] = field(default_factory=list)
    deleted: list[str] = field(default_factory=list)
    deleted_docs: int = 0
    deleted_words: int = 0
    layout: int = LAYOUT


@dataclass(frozen=True)
class Shape:
    """Of a segment: slices of each class of lengths, and how many tasks a token's postings are
    divided among."""

    parts: dict[int, int]
    spread: int

    def place_of(self, doc: Column, dl: Column) -> Column:
        """The number of a document's slice, counted over the classes."""
        cls, first = _length_class(dl), np.cumsum([0, *self.parts.values()]).tolist()
        of = lambda values: F.element_at(F.create_map(*[F.lit(x) for p in zip(self.parts, values, strict=False) for x in p]), cls)
        return (of(first) + F.pmod(F.xxhash64(doc), of(self.parts.values()))).cast("int")

    def slices(self, place: np.ndarray) -> np.ndarray:
        """Slices by their numbers: the class, and the number in it."""
        first = np.cumsum([0, *self.parts.values()])
        at = np.searchsorted(first, place, side="right") - 1
        return (np.array([*self.parts, 0])[at] << 32) + place - first[at]


class InvertedIndex:
    """Postings under a path. A document that is appended again replaces the one that is there;
    the keys of one call must be unique, and rows of a null key are ignored."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # ---- the list of what counts

    def exists(self) -> bool:
        return files.exists(self.spark, f"{self.path}/_META")

    def meta(self) -> Meta:
        got = json.loads(files.read_text(self.spark, f"{self.path}/_META"))
        if got.get("layout") != LAYOUT:
            raise ValueError(f"the index at {self.path} has another layout")
        return Meta(**{**got, "segments": [Segment(**s) for s in got["segments"]]})

    def _put(self, meta: Meta) -> None:
        files.write_text(self.spark, f"{self.path}/_META", json.dumps(asdict(meta)))

    def create(self, docs: DataFrame, key: str, weights: dict[str, float], stem: bool = False) -> InvertedIndex:
        """A new index of docs in place of what is there."""
        self._put(Meta(key, docs.schema[key].dataType.simpleString(), {f: w for f, w in weights.items() if f in docs.columns}, stem))
        self.append(docs)
        return self

    # ---- writing

    def append(self, docs: DataFrame) -> None:
        meta = self.meta()
        docs = docs.where(F.col(meta.key).isNotNull()).select(F.col(meta.key).alias("doc"), *[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in meta.weights])
        if not docs.groupBy("doc").count().where("count > 1").isEmpty():
            raise ValueError("the documents have keys that repeat")
        if meta.segments:
            self._delete(meta, docs.select("doc"))
        words = [_words(F.col(f)) for f in meta.weights]
        size = reduce(lambda a, b: a + b, [F.size(w) for w in words]).cast("long").alias("dl")
        meta.segments.append(self._write(meta, docs.select("doc", size), lambda shape: _counts(docs.select("doc", size, *[w.alias(f"w{i}") for i, w in enumerate(words)]), meta, shape)))
        self._put(meta)

    def _write(self, meta: Meta, lengths: DataFrame, lists: Callable[[Shape], DataFrame]) -> Segment:
        """A segment of documents (doc, dl: all of them) and of the lists made for its shape: salt,
        token, and doc, tf, dl, place of some of its postings in arrays. Lists are shuffled once,
        as they are; a task then joins a token's."""
        name = f"segment-{uuid.uuid4().hex}"
        lengths.write.parquet(f"{self.path}/{name}/lengths")
        lengths = self.spark.read.schema(f"doc {meta.key_type}, dl long").parquet(f"{self.path}/{name}/lengths")
        classes = lengths.groupBy(_length_class(F.col("dl")).alias("c")).agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("words")).collect()  # a row for each half power of two
        docs, words = sum(r["n"] for r in classes), sum(r["words"] or 0 for r in classes)
        buckets = max(BUCKETS[0], min(BUCKETS[1], words // BUCKET_WORDS))
        shape = Shape({r["c"]: -(-r["n"] // SLICE_DOCS) for r in classes} or {0: 1}, -(-max(docs, 1) // SPREAD_DOCS))
        # each task takes one share of one bucket's tokens, so that none meets another by chance
        shares = buckets * max(1, -(-words // (TASK_WORDS * buckets * shape.spread)))
        x = lists(shape).withColumn("share", (F.crc32(F.col("token").cast("binary")) % shares).cast("int"))
        x = x.repartitionById(shares * shape.spread, F.col("share") + F.col("salt") * shares)
        x = x.select((F.col("share") % buckets).alias("bucket"), "token", "doc", "tf", "dl", "place").sortWithinPartitions("bucket", "token")
        blocks = x.mapInArrow(partial(_blocked, shape=shape), f"bucket int, token string, slice long, n long, max_tf double, min_dl long, docs array<struct<doc: {meta.key_type}, tf: double, dl: bigint>>")
        blocks.sortWithinPartitions("bucket", "token", "slice").write.partitionBy("bucket").parquet(f"{self.path}/{name}/blocks")
        return Segment(name, docs, words, buckets)

    def _lengths(self, meta: Meta) -> DataFrame:
        """name, doc, dl of the documents that count."""
        every = [self.spark.read.schema(f"doc {meta.key_type}, dl long").parquet(f"{self.path}/{s.name}/lengths").withColumn("name", F.lit(s.name)) for s in meta.segments]
        return self._alive(meta, reduce(DataFrame.unionByName, every))

    def _alive(self, meta: Meta, rows: DataFrame) -> DataFrame:
        """rows (name, doc, ...) without deleted documents."""
        if not meta.deleted:
            return rows
        dead = self.spark.read.schema(f"name string, doc {meta.key_type}").parquet(*[f"{self.path}/{d}" for d in meta.deleted])
        return rows.join(dead, ["name", "doc"], "left_anti")

    def _delete(self, meta: Meta, keys: DataFrame) -> None:
        gone = self._lengths(meta).join(keys.select("doc").distinct(), "doc", "left_semi")
        name = f"deleted-{uuid.uuid4().hex}"
        gone.select("name", "doc", "dl").write.parquet(f"{self.path}/{name}")
        n, words = self.spark.read.parquet(f"{self.path}/{name}").agg(F.count(F.lit(1)), F.sum("dl")).first()
        if n:
            meta.deleted.append(name)
            meta.deleted_docs += n
            meta.deleted_words += words
        else:
            files.delete(self.spark, f"{self.path}/{name}")

    def delete(self, keys: DataFrame) -> None:
        """Forget the documents of keys (the index's key column, or the only one)."""
        meta = self.meta()
        if meta.segments:
            self._delete(meta, keys.select(F.col(meta.key if meta.key in keys.columns else keys.columns[0]).alias("doc")))
            self._put(meta)

    def merge(self) -> None:
        """One segment of all that counts."""
        meta = self.meta()
        if len(meta.segments) < 2 and not meta.deleted:
            return
        blocks = self._read(meta, None).select("name", "token", *[F.col(f"docs.{c}").alias(c) for c in ("doc", "tf", "dl")])
        if meta.deleted:
            one = blocks.select("name", "token", F.explode(F.arrays_zip("doc", "tf", "dl")).alias("d")).select("name", "token", "d.*")
            blocks = self._alive(meta, one).select("token", *[F.array(c).alias(c) for c in ("doc", "tf", "dl")])
        meta.segments = [self._write(meta, self._lengths(meta).select("doc", "dl"), lambda shape: _relisted(blocks, meta, shape))]
        meta.deleted, meta.deleted_docs, meta.deleted_words = [], 0, 0
        self._put(meta)

    def vacuum(self) -> list[str]:
        """Delete what no reader of the present index needs; the names of what went."""
        meta = self.meta()
        used = {s.name for s in meta.segments} | set(meta.deleted)
        gone = [n for n in files.names(self.spark, self.path) if n.startswith(("segment-", "deleted-")) and n not in used]
        for n in gone:
            files.delete(self.spark, f"{self.path}/{n}")
        return gone

    # ---- reading

    def words_of(self, query: str) -> list[str]:
        plain = search.plain_words(query)
        return sorted({search.porter(w) for w in plain} if self.meta().stem else set(plain))

    def _read(self, meta: Meta, words: list[str] | None) -> DataFrame:
        """name, token, slice, n, max_tf, min_dl, docs: the blocks of words, from their
        partitions alone (of all words for None)."""
        schema = f"token string, slice long, n long, max_tf double, min_dl long, docs array<struct<doc: {meta.key_type}, tf: double, dl: bigint>>, bucket int"
        out = []
        for s in meta.segments:
            x = self.spark.read.schema(schema).parquet(f"{self.path}/{s.name}/blocks")
            if words is not None:
                x = x.where(F.col("bucket").isin(sorted({zlib.crc32(w.encode()) % s.buckets for w in words})) & F.col("token").isin(words))
            out.append(x.withColumn("name", F.lit(s.name)))
        return reduce(DataFrame.unionByName, out)

    def _terms(self, meta: Meta, blocks: DataFrame) -> dict[str, float]:
        """The words' inverse frequencies."""
        n = sum(s.docs for s in meta.segments) - meta.deleted_docs
        if meta.deleted:
            df = self._alive(meta, blocks.select("name", "token", F.explode("docs.doc").alias("doc"))).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
        else:
            df = blocks.groupBy("token").agg(F.sum("n").alias("df"))
        return {r["token"]: math.log((n - r["df"] + 0.5) / (r["df"] + 0.5) + 1) for r in df.collect()}  # a row for each word of the query

    def _part(self, meta: Meta, idf: dict[str, float], tf: Column, dl: Column) -> Column:
        n, words = sum(s.docs for s in meta.segments) - meta.deleted_docs, sum(s.words for s in meta.segments) - meta.deleted_words
        weight = F.element_at(F.create_map(*[F.lit(x) for t in idf.items() for x in t]), F.col("token"))
        return weight * tf * (search.K1 + 1) / (tf + search.K1 * (1 - search.B + search.B * dl * n / F.lit(words)))

    def _scored(self, meta: Meta, idf: dict[str, float], blocks: DataFrame, allowed: DataFrame | None) -> DataFrame:
        hits = self._alive(meta, blocks.select("name", "token", F.explode("docs").alias("d")).select("name", "token", "d.*"))
        if allowed is not None:
            hits = hits.join(allowed.select(F.col(meta.key if meta.key in allowed.columns else allowed.columns[0]).alias("doc")), "doc", "left_semi")
        return hits.groupBy("doc").agg(F.round(F.sum(self._part(meta, idf, F.col("tf"), F.col("dl"))), 6).alias("score"))

    def _nothing(self, meta: Meta) -> DataFrame:
        return self.spark.createDataFrame([], f"{meta.key} {meta.key_type}, score double")

    def scores(self, query: str) -> DataFrame:
        """key, score of every document with any word of the query."""
        meta, words = self.meta(), self.words_of(query)
        if not words or not meta.segments:
            return self._nothing(meta)
        blocks = self._read(meta, words)
        idf = self._terms(meta, blocks)
        return self._scored(meta, idf, blocks, None).withColumnRenamed("doc", meta.key) if idf else self._nothing(meta)

    def bounds(self, query: str) -> DataFrame:
        """name, slice, bound: what the documents of a slice can score at most."""
        meta, words = self.meta(), self.words_of(query)
        blocks = self._read(meta, words)
        return self._bounds(meta, self._terms(meta, blocks), blocks)

    def _bounds(self, meta: Meta, idf: dict[str, float], blocks: DataFrame) -> DataFrame:
        return blocks.groupBy("name", "slice").agg(F.sum(self._part(meta, idf, F.col("max_tf"), F.col("min_dl"))).alias("bound"))

    def top(self, query: str, k: int = 10, allowed: DataFrame | None = None) -> DataFrame:
        """key, score, rank of the k best documents (of those of `allowed`, if it is given); ties
        by key."""
        meta, words = self.meta(), self.words_of(query)
        blocks = self._read(meta, words) if words and meta.segments else None
        idf = self._terms(meta, blocks) if blocks is not None else {}
        if not idf:
            return self._nothing(meta).withColumn("rank", F.lit(0))
        slices = self._bounds(meta, idf, blocks)
        first = slices.orderBy(F.desc("bound"), "name", "slice").limit(PROBE)
        probed = self._scored(meta, idf, blocks.join(first.select("name", "slice"), ["name", "slice"], "left_semi"), allowed)
        least = [r["score"] for r in probed.orderBy(F.desc("score")).limit(k).collect()]  # k numbers
        wanted = slices.where(F.col("bound") >= least[-1] - SLACK) if len(least) == k else slices
        hits = self._scored(meta, idf, blocks.join(wanted.select("name", "slice"), ["name", "slice"], "left_semi"), allowed)
        hits = hits.orderBy(F.desc("score"), "doc").limit(k).withColumnRenamed("doc", meta.key)
        return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), meta.key)))


def _words(text: Column) -> Column:
    return F.filter(F.split(search.folded(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def _length_class(dl: Column) -> Column:
    """Half powers of two."""
    return F.floor(F.log2(F.greatest(dl, F.lit(1)).cast("double")) * 2).cast("int")


def _lists_schema(meta: Meta) -> str:
    return f"salt int, token string, doc array<{meta.key_type}>, tf array<double>, dl array<int>, place array<int>"


def _counts(docs: DataFrame, meta: Meta, shape: Shape) -> DataFrame:
    """The lists of documents (doc, dl, and the words of each field in w0, w1, ...)."""
    docs = docs.withColumns({"place": shape.place_of(F.col("doc"), F.col("dl")), "dl": F.col("dl").cast("int")})
    return docs.mapInArrow(partial(_counted, weights=list(meta.weights.values()), stem=meta.stem, spread=shape.spread), _lists_schema(meta))


def _relisted(blocks: DataFrame, meta: Meta, shape: Shape) -> DataFrame:
    """The lists of blocks (token, and doc, tf, dl in arrays)."""
    places = F.transform(F.arrays_zip("doc", "dl"), lambda d: shape.place_of(d["doc"], d["dl"]))
    lists = blocks.select("token", "doc", "tf", F.col("dl").cast("array<int>").alias("dl"), places.alias("place"))
    return lists.mapInArrow(partial(_joined, spread=shape.spread), _lists_schema(meta))


def _salt(place: np.ndarray, spread: int) -> np.ndarray:
    return ((place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(spread)).astype(np.int32)


def _listed(spread: int, group: np.ndarray, names: pa.Array, doc: pa.Array, tf: np.ndarray, dl: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """A row for each group and salt; names has the groups' tokens."""
    salt = _salt(place, spread)
    order = np.lexsort((salt, group))
    salt, group = salt[order], group[order]
    first = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (salt[1:] != salt[:-1])]))
    ends = pa.array(np.append(first, len(group)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(ends, v) for v in (doc.take(pa.array(order)), pa.array(tf[order]), pa.array(dl[order]), pa.array(place[order]))]
    return pa.RecordBatch.from_arrays([pa.array(salt[first]), names.take(pa.array(group[first])), *lists], ["salt", "token", "doc", "tf", "dl", "place"])


def _counted(batches: Iterator[pa.RecordBatch], weights: list[float], stem: bool, spread: int) -> Iterator[pa.RecordBatch]:
    """Keys are unique, so a document's words are counted where it lies. Postings of LIST_DOCS
    documents are listed by token."""
    known: dict[str, str] = {}
    for batch in batches:
        for i in range(0, batch.num_rows, LIST_DOCS):
            part = batch.slice(i, LIST_DOCS)
            fields = [part.column(f"w{f}") for f in range(len(weights))]
            sizes = [pc.fill_null(pc.list_value_length(w), 0).to_numpy(zero_copy_only=False) for w in fields]
            told = pa.concat_arrays([w.flatten() for w in fields]).dictionary_encode()
            if not len(told):
                continue
            code, names = told.indices.to_numpy().astype(np.int64), told.dictionary
            if stem:
                stems = pa.array([known.setdefault(w, search.porter(w)) for w in names.to_pylist()], pa.string()).dictionary_encode()
                code, names = stems.indices.to_numpy().astype(np.int64)[code], stems.dictionary
            owner = np.concatenate([np.repeat(np.arange(part.num_rows), n) for n in sizes])
            weight = np.repeat(weights, [int(n.sum()) for n in sizes])
            posting, at = np.unique(code * part.num_rows + owner, return_inverse=True)
            group, row = posting // part.num_rows, posting % part.num_rows
            dl, place = (part.column(c).to_numpy(zero_copy_only=False)[row] for c in ("dl", "place"))
            yield _listed(spread, group, names, part.column("doc").take(pa.array(row)), np.bincount(at, weights=weight), dl, place)


def _flat(lists: pa.RecordBatch) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The row of each posting, doc, tf, dl, place."""
    row = np.repeat(np.arange(lists.num_rows), pc.list_value_length(lists.column("doc")).to_numpy(zero_copy_only=False))
    return row, lists.column("doc").flatten(), *[lists.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("tf", "dl", "place")]


def _joined(batches: Iterator[pa.RecordBatch], spread: int) -> Iterator[pa.RecordBatch]:
    """The lists of one token in a batch become one for each salt; files are sorted by token."""
    for batch in batches:
        row, *values = _flat(batch)
        if len(row):
            told = batch.column("token").dictionary_encode()
            yield _listed(spread, told.indices.to_numpy()[row], told.dictionary, *values)


def _blocked(batches: Iterator[pa.RecordBatch], shape: Shape) -> Iterator[pa.RecordBatch]:
    """Lists sorted by token become blocks; of a batch the last token's wait for the next."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        token = batch.column("token")
        if held and held[-1].column("token")[0] != token[0]:
            yield _blocks(held, shape)
            held = []
        last = pc.index(token, token[-1]).as_py()
        if last:
            yield _blocks([*held, batch.slice(0, last)], shape)
            held = []
        held.append(batch.slice(last))
    if held:
        yield _blocks(held, shape)


def _blocks(lists: list[pa.RecordBatch], shape: Shape) -> pa.RecordBatch:
    """The blocks of whole tokens' lists."""
    x = pa.Table.from_batches(lists).combine_chunks().to_batches()[0]
    row, doc, tf, dl, place = _flat(x)
    slices = shape.slices(place)
    group = x.column("token").dictionary_encode().indices.to_numpy()[row]
    rank = np.empty(len(doc), dtype=np.int64)
    rank[pc.array_sort_indices(doc).to_numpy()] = np.arange(len(doc))
    order = np.lexsort((rank, slices, group))
    row, tf, dl, slices, group = (v[order] for v in (row, tf, dl, slices, group))
    first = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (slices[1:] != slices[:-1])]))
    ends = np.append(first, len(group))
    docs = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays([doc.take(pa.array(order)), pa.array(tf), pa.array(dl.astype(np.int64))], ["doc", "tf", "dl"]))
    heads = x.select(["bucket", "token"]).take(pa.array(row[first]))
    made = [pa.array(slices[first]), pa.array(np.diff(ends)), pa.array(np.maximum.reduceat(tf, first)), pa.array(np.minimum.reduceat(dl, first).astype(np.int64)), docs]
    return pa.RecordBatch.from_arrays([*heads.columns, *made], ["bucket", "token", "slice", "n", "max_tf", "min_dl", "docs"])
