"""Token ids as Parquet list columns, in document order, and back.

Format: one row per document in ascending doc_id: doc_id, n_tokens, ids (list of int).
Spark's Parquet writer makes dictionary pages for the ids (delta encoding where a
dictionary would not pay, as pages of version 2 do), row groups and pages of set sizes,
and page indexes; so a reader of a few documents or of the metadata alone touches those
pages only. Files are dealt by range of doc_id, so their order is the documents'.

The ids are those that the unchanged tokenizers library gives (its special tokens are
found in a text), but each distinct piece of a text is encoded once (see Encoder).

Defined cases: a null text is empty and gives the end id alone; rows with equal doc_id
(null ones first) are ordered by a hash of the text; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import kernels
from quarry.llm.common import bound_batches, passes, ranges, shared_dir, tidy

END_ID = 0
#: parts that a worker's cache holds at most and that go to the model in one call, lists that
#: are gathered at once, and bytes of text that are encoded together
CACHE_PARTS, CALL, STEP, PASS = 200_000, 2048, 1 << 16, 4 << 20
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10


def _byte_symbols() -> dict[int, str]:
    """The symbol that byte-level models write for each byte: printable bytes stand for
    themselves, the others, in order, for the characters from 256 on (fixed values)."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_SYMBOLS = _byte_symbols()
_WHITE = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Texts with a space between white space and white space (or the end) are not cut at spaces.
_ROUGH = rf"[{_WHITE}] (?:[{_WHITE}]|\z)"
#: Pieces of characters that every version of Unicode classes alike, without white space at
#: the end, and the splitter's pattern.
_SURE = r"^(?:[\t\n\r -~\x{a1}-\x{24f}]*[!-~\x{a1}-\x{24f}])\z"
_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _splits_alone(spec: str) -> bool:
    """Whether pieces of a text can be encoded alone: a byte-level splitter, nothing else."""
    import json

    x = json.loads(spec)
    pre = x.get("pre_tokenizer") or {}
    return x.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True) and x.get("truncation") is None


class Lists:
    """Lists of ids, one after another."""

    def __init__(self, sizes: np.ndarray, values: np.ndarray):
        self.sizes, self.values = sizes, values

    @classmethod
    def empty(cls) -> Lists:
        return cls(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32))

    @classmethod
    def chained(cls, parts: list[Lists]) -> Lists:
        parts = [cls.empty(), *parts]
        return cls(np.concatenate([x.sizes for x in parts]), np.concatenate([x.values for x in parts]))

    def take(self, at: np.ndarray) -> Lists:
        start, sizes = np.cumsum(self.sizes) - self.sizes, self.sizes[at]
        out = np.empty(int(sizes.sum()), dtype=np.int32)
        ends = np.cumsum(sizes)
        for i in range(0, len(at), STEP):  # the places are wider than the ids
            n = sizes[i : i + STEP]
            out[ends[i] - n[0] : ends[min(i + STEP, len(at)) - 1]] = self.values[np.repeat(start[at[i : i + STEP]], n) + kernels.spread(n)]
        return Lists(sizes, out)


class Encoder:
    """Texts to the library's ids.

    Where a space follows a character that is no white space, or stands before one, the
    byte-level pattern always cuts before that space; so texts are cut there. Distinct
    pieces are cut further at the pattern's own borders, and their distinct parts go to
    the library's model directly, many in one call. Parts stay known for later passes
    while there is room. Everything but that is lookups and gathering in Arrow and numpy.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.alone = _splits_alone(self.tok.to_str())
        self.model = Tokenizer(self.tok.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()  # symbols hold no white space
        self.parts = pa.array([], pa.string())  # known parts and, of each, its ids
        self.ids = Lists.empty()

    def library(self, texts: list[str]) -> Lists:
        made = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        return Lists(np.array([len(x) for x in made], dtype=np.int64), np.fromiter(chain.from_iterable(made), dtype=np.int32))

    def _modelled(self, parts: list[str]) -> Lists:
        """The model's ids of parts that the pattern does not cut."""
        out = []
        for i in range(0, len(parts), CALL):
            some = parts[i : i + CALL]
            symbols = "\n".join(some).encode().decode("latin-1").translate(_SYMBOLS).replace(_SYMBOLS[10], "\n")
            if symbols.count("\n") != len(some) - 1:  # a part holds a line feed itself
                symbols = "\n".join(p.encode().decode("latin-1").translate(_SYMBOLS) for p in some)
            made = self.model.encode(symbols, add_special_tokens=False)
            out.append(Lists(np.bincount(np.array(made.word_ids, dtype=np.int64), minlength=len(some)), np.array(made.ids, dtype=np.int32)))
        return Lists.chained(out)

    def _of_parts(self, parts: pa.Array) -> Lists:
        """The ids of distinct parts."""
        at = pc.fill_null(pc.index_in(parts, value_set=self.parts), -1).to_numpy()
        fresh = np.flatnonzero(at < 0)
        made = self._modelled(parts.take(pa.array(fresh)).to_pylist())
        every = Lists.chained([self.ids, made])
        slots = at.astype(np.int64)
        slots[fresh] = len(self.parts) + np.arange(len(fresh))
        out = every.take(slots)
        if len(every.sizes) <= CACHE_PARTS:
            self.parts, self.ids = pa.concat_arrays([self.parts, parts.take(pa.array(fresh))]), every
        else:
            self.parts, self.ids = parts, out
        return out

    def _of_pieces(self, pieces: pa.Array) -> Lists:
        """The ids of distinct pieces, each behind a space."""
        sure = pc.match_substring_regex(pieces, _SURE).to_numpy(zero_copy_only=False)
        alpha = pc.utf8_is_alpha(pieces).to_numpy(zero_copy_only=False) & sure
        cut, odd = np.flatnonzero(sure & ~alpha), np.flatnonzero(~sure)
        # a part that begins with the space begins a piece: no piece holds another
        found = _PATTERN.findall(" " + " ".join(pieces.take(pa.array(cut)).to_pylist())) if len(cut) else []
        words = pc.binary_join_element_wise(pa.scalar(""), pieces.take(pa.array(np.flatnonzero(alpha))), " ")
        coded = pa.concat_arrays([words, pa.array(found, pa.string())]).dictionary_encode()
        known = self._of_parts(coded.dictionary)
        code = coded.indices.to_numpy().astype(np.int64)
        n = len(words)
        begins = pc.starts_with(coded.dictionary, " ").to_numpy(zero_copy_only=False)[code[n:]]
        per = np.ones(len(pieces), dtype=np.int64)
        per[cut] = np.diff(np.concatenate([np.flatnonzero(begins), [len(found)]]))
        # parts in the order of the pieces; an odd piece is a part of its own, behind the others
        first = np.cumsum(per) - per
        order = np.zeros(int(per.sum()), dtype=np.int64)
        order[first[alpha]] = code[:n]
        order[np.repeat(first[cut], per[cut]) + kernels.spread(per[cut])] = code[n:]
        order[first[odd]] = len(known.sizes) + np.arange(len(odd))
        if len(odd):
            known = Lists.chained([known, self.library([" " + p for p in pieces.take(pa.array(odd)).to_pylist()])])
        got = known.take(order)
        return Lists(np.add.reduceat(got.sizes, first) if len(first) else got.sizes, got.values)

    def encode(self, texts: pa.Array) -> Lists:
        whole = np.ones(len(texts), dtype=bool)
        if self.alone:
            rough = pc.match_substring_regex(texts, _ROUGH)
            for t in self.added:
                rough = pc.or_(rough, pc.match_substring(texts, t))
            whole = rough.to_numpy(zero_copy_only=False)
        parts = []
        if not whole.all():
            cut = pc.split_pattern(texts.filter(pa.array(~whole)), " ")
            offsets = cut.offsets.to_numpy().astype(np.int64)
            coded = cut.values.dictionary_encode()
            slots = coded.indices.to_numpy().astype(np.int64)
            heads = self.library(cut.values.take(pa.array(offsets[:-1])).to_pylist())
            known = self._of_pieces(coded.dictionary)
            slots[offsets[:-1]] = len(known.sizes) + np.arange(len(heads.sizes))
            got = Lists.chained([known, heads]).take(slots)
            parts.append(Lists(np.add.reduceat(got.sizes, offsets[:-1]), got.values))
        if whole.any():
            parts.append(self.library(texts.filter(pa.array(whole)).to_pylist()))
        if len(parts) != 2:
            return parts[0] if parts else Lists.empty()
        return Lists.chained(parts).take(np.argsort(np.argsort(whole, kind="stable"), kind="stable"))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """doc_id, n_tokens, ids (array<int>, the end id last) of every whole text."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for i, j in passes(batch, "text", PASS):
                part = batch.slice(i, j - i)
                got = enc.encode(pc.fill_null(part.column("text"), ""))
                # the end id behind each text's
                ends = np.cumsum(got.sizes)
                offsets = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])
                ids = pa.array(np.insert(got.values, ends, end_id), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), ids)], ["doc_id", "n_tokens", "ids"])

    bound_batches(docs.sparkSession)
    return docs.mapInArrow(tidy(run), "doc_id long, n_tokens long, ids array<int>")


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, files: int | None = None) -> None:
    """Encode docs (doc_id, text) and write the files under path, in ascending doc_id."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # the hash parts many rows of one doc_id (null, say) among files
    order = ["doc_id", F.xxhash64("text")]
    ordered = rows.repartitionByRange(files or ranges(docs), *order).sortWithinPartitions(*order, "text")
    (encode(ordered, tokenizer, end_id).write.option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.page.size", PAGE_BYTES)
        .option("parquet.writer.version", "v2").option("parquet.enable.dictionary", "true").option("compression", "zstd").parquet(path))


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids, from the files at path."""
    rows = spark.read.schema("doc_id long, n_tokens long, ids array<int>").parquet(path).select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    return rows.join(starts(spark, path).select("file", "row", "start"), ["file", "row"]).select("doc_id", "start", "n_tokens", "ids")


def starts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens: from the two metadata columns alone; ids are not read.

    A file holds a range of doc_id: totals of the files, then sums within each file.
    """
    meta = spark.read.schema("doc_id long, n_tokens long").parquet(path).select("doc_id", "n_tokens", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    files = meta.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    # part-N of a range sort; N has five digits at least, so names do not sort as numbers do
    number = F.regexp_extract("file", r"part-(\d+)", 1).cast("long")
    offsets = files.select("file", F.coalesce(F.sum("total").over(Window.orderBy(number, "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    within = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return meta.withColumn("inner", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(offsets, "file").select("file", "row", "doc_id", "n_tokens", (F.col("offset") + F.col("inner")).alias("start"))


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        flat, offsets = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), ids.offsets.to_numpy()
        crc = [zlib.crc32(memoryview(flat[a:b])) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("file"), batch.column("row"), pc.cast(pc.list_value_length(ids), pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "file", "row", "n_read", "ids_crc32"])


def round_trip(docs: DataFrame, path: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """Write docs at path, read the files back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    write(docs, path, tokenizer)
    rows = spark.read.schema("doc_id long, n_tokens long, ids array<int>").parquet(path).select("doc_id", "ids", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    crc = rows.mapInArrow(_checked, "doc_id long, file string, row long, n_read long, ids_crc32 long")
    return crc.join(starts(spark, path).drop("doc_id"), ["file", "row"]).select("doc_id", "start", F.col("n_read").alias("n_tokens"), "ids_crc32")
