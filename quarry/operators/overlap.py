"""Which columns hold the values of which others: sketches find candidates, exact sets decide.

A column's sketch is the SKETCH least hashes of its distinct values. Sketches of parts merge
by taking the least of both, so a task hands on SKETCH hashes for each column and nothing
else; hashes above what one task alone already has SKETCH of are dropped before the merge.
Below the lower of two sketches' greatest hashes both are whole samples of their columns, so
the share of the one's hashes there that the other has estimates containment. An inverted
index (hash to columns) gives the pairs that share one. A pair whose sample is too small to
judge is a candidate if types and ranges agree; candidates are counted exactly.

Values are compared as text; texts of more than LONG characters by their SHA-256. Nulls are
no values; a column without values is in nothing and holds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import scalars as S
from quarry.operators.reach import checkpointed

SKETCH = 1024
#: hashes that a sample has at least, and how far an estimate may lie below what is asked for
SAMPLE, MARGIN = 64, 0.25
LONG = 64


def _text(name: str) -> Column:
    value = F.col(f"`{name}`").cast("string")
    return F.when(F.length(value) > LONG, F.sha2(value.cast("binary"), 256)).otherwise(value)


def simple_columns(tables: dict[str, DataFrame]) -> dict[str, list[str]]:
    """The columns of single values."""
    return {t: [f.name for f in df.schema.fields if f.dataType.typeName() not in ("array", "map", "struct", "binary", "variant")] for t, df in tables.items()}


def _least(names: list[str], k: int):
    """For each task: the k least distinct hashes of each column, and whether there were k."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64) for _ in names]
        for batch in batches:
            for i in range(len(names)):
                new = batch.column(i).drop_null().to_numpy(zero_copy_only=False)
                if len(held[i]) >= k:
                    new = new[new < held[i][k - 1]]
                if len(new):
                    held[i] = np.unique(np.concatenate([held[i], new]))[:k]
        for name, hashes in zip(names, held, strict=True):
            if len(hashes):
                bound = hashes[-1] if len(hashes) >= k else np.iinfo(np.int64).max
                yield pa.RecordBatch.from_pydict({"column_name": [name] * len(hashes), "hash": pa.array(hashes), "bound": pa.array(np.full(len(hashes), bound))})

    return step


def sketches(tables: dict[str, DataFrame], k: int = SKETCH, columns: dict[str, list[str]] | None = None) -> DataFrame:
    """table_name, column_name, hash: the k least hashes of each column's distinct values."""
    parts = []
    for t, names in (columns or simple_columns(tables)).items():
        if names:
            hashed = tables[t].select(*[F.when(F.col(f"`{c}`").isNotNull(), F.xxhash64(_text(c))).alias(f"h{i}") for i, c in enumerate(names)])
            parts.append(hashed.mapInArrow(_least(names, k), "column_name string, hash long, bound long").select(F.lit(t).alias("table_name"), "*"))
    return merged(reduce(DataFrame.unionByName, parts), k)


def merged(parts: DataFrame, k: int = SKETCH) -> DataFrame:
    """One sketch for each column, of the sketches of its parts: table_name, column_name, hash,
    bound (a hash that at least k of the part's lie up to)."""
    parts = checkpointed(parts)
    key = ["table_name", "column_name"]
    bound = parts.groupBy(*key).agg(F.min("bound").alias("bound"))
    live = parts.drop("bound").join(bound, key).where("hash <= bound").select(*key, "hash").distinct()
    order = Window.partitionBy(*key).orderBy("hash")
    return live.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def facts(tables: dict[str, DataFrame], columns: dict[str, list[str]] | None = None) -> DataFrame:
    """table_name, column_name, family, low, high: the bounds as numbers, null for texts."""
    out = []
    for t, names in (columns or simple_columns(tables)).items():
        kinds = dict(tables[t].dtypes)
        number = {c: F.unix_micros(F.col(f"`{c}`").cast("timestamp")).cast("double") if kinds[c].startswith(("date", "timestamp")) else F.col(f"`{c}`").cast("double") if kinds[c] not in ("string", "boolean") else None for c in names}
        asked = [f(number[c]).alias(f"{tag}{i}") for i, c in enumerate(names) if number[c] is not None for tag, f in (("l", F.min), ("h", F.max))]
        one = tables[t].agg(F.count(F.lit(1)).alias("rows"), *asked)
        rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(kinds[c]).alias("data_type"), *[(F.col(f"{tag}{i}") if number[c] is not None else F.lit(None).cast("double")).alias(n) for tag, n in (("l", "low"), ("h", "high"))]) for i, c in enumerate(names)])
        out.append(one.select(F.lit(t).alias("table_name"), F.explode(rows).alias("x")).select("table_name", "x.*"))
    every = reduce(DataFrame.unionByName, out)
    return every.select("table_name", "column_name", S.type_family(F.col("data_type")).alias("family"), "low", "high")


def candidates(sketch: DataFrame, fact: DataFrame, least: float, k: int = SKETCH) -> DataFrame:
    """src_table, src_column, dst_table, dst_column of columns of one family whose containment may
    be `least` or more."""
    key = ["table_name", "column_name"]
    top = sketch.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.max("hash").alias("top"))
    whole = F.lit(int(np.iinfo(np.int64).max))
    known = fact.join(top, key).select(F.concat_ws(".", *key).alias("id"), *key, "family", "low", "high", F.when(F.col("n") < k, whole).otherwise(F.col("top")).alias("top"))
    known = checkpointed(known)
    side = lambda p: known.select(*[F.col(c).alias(f"{p}_{c}") for c in known.columns])
    a, b = side("a"), side("b")
    h = checkpointed(sketch.select(F.concat_ws(".", *key).alias("id"), "hash"))
    tops = known.select("id", "top")
    # shared hashes below both tops, by the inverted index
    left = h.join(tops, "id").select(F.col("id").alias("a_id"), "hash", F.col("top").alias("a_top"))
    right = h.join(tops, "id").select(F.col("id").alias("b_id"), "hash", F.col("top").alias("b_top"))
    both = left.join(right, "hash").where((F.col("a_id") != F.col("b_id")) & (F.col("hash") <= F.least("a_top", "b_top"))).groupBy("a_id", "b_id").agg(F.count(F.lit(1)).alias("shared"))
    # columns of one family; how many of a's hashes lie below both tops
    pairs = a.join(b, (F.col("a_family") == F.col("b_family")) & (F.col("a_id") != F.col("b_id")))
    spots = h.groupBy("id").agg(F.sort_array(F.collect_list("hash")).alias("hashes"))  # k of a column
    size = F.size(F.filter("hashes", lambda x: x <= F.least("a_top", "b_top")))
    pairs = pairs.join(spots.withColumnRenamed("id", "a_id"), "a_id").withColumn("sample", size).drop("hashes").join(both, ["a_id", "b_id"], "left")
    inside = F.coalesce((F.col("a_low") >= F.col("b_low")) | (least < 1), F.lit(True)) & F.coalesce((F.col("a_high") >= F.col("b_low")) & (F.col("a_low") <= F.col("b_high")), F.lit(True))
    judged = F.coalesce("shared", F.lit(0)) >= F.col("sample") * (least - MARGIN)
    return pairs.where(F.when(F.col("sample") >= SAMPLE, judged).otherwise(inside)).select(F.col("a_table_name").alias("src_table"), F.col("a_column_name").alias("src_column"), F.col("b_table_name").alias("dst_table"), F.col("b_column_name").alias("dst_column"))


def measure(tables: dict[str, DataFrame], pairs: DataFrame) -> DataFrame:
    """pairs (src_*, dst_*) with n_left, n_right, n_both (distinct values), containment, jaccard.
    Every column that is asked for is read and reduced to its distinct values once."""
    pairs = checkpointed(pairs.select("src_table", "src_column", "dst_table", "dst_column").distinct())
    src, dst = F.concat_ws(".", "src_table", "src_column"), F.concat_ws(".", "dst_table", "dst_column")
    ends = pairs.select(F.col("src_table").alias("t"), F.col("src_column").alias("c")).union(pairs.select("dst_table", "dst_column")).distinct().collect()  # columns of the catalog
    cells = []
    for t in sorted({r["t"] for r in ends}):
        names = sorted(r["c"] for r in ends if r["t"] == t and t in tables and r["c"] in tables[t].columns)
        if names:
            told = F.array(*[F.struct(F.lit(f"{t}.{c}").alias("id"), _text(c).alias("value")) for c in names])
            cells.append(tables[t].select(F.explode(told).alias("x")).select("x.*").where("value is not null"))
    if not cells:
        return pairs.limit(0).selectExpr("*", "0L AS n_left", "0L AS n_right", "0L AS n_both", "0D AS containment", "0D AS jaccard")
    distinct = checkpointed(reduce(DataFrame.unionByName, cells).distinct())
    sizes = distinct.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    holders = distinct.groupBy("value").agg(F.collect_set("id").alias("ids"))
    asked = pairs.groupBy(src.alias("id")).agg(F.collect_list(dst).alias("others"))
    hit = holders.select(F.explode("ids").alias("id"), "ids").join(asked, "id").select("id", F.explode(F.array_intersect("others", "ids")).alias("other"))
    both = hit.groupBy("id", "other").agg(F.count(F.lit(1)).alias("n_both"))
    out = pairs.withColumns({"id": src, "other": dst}).join(both, ["id", "other"], "left")
    for name, column in (("n_left", "id"), ("n_right", "other")):
        out = out.join(sizes.select(F.col("id").alias(f"_{name}"), F.col("n").alias(name)), F.col(column) == F.col(f"_{name}"), "left")
    zero = F.lit(0).cast("long")
    out = out.select("src_table", "src_column", "dst_table", "dst_column", *[F.coalesce(c, zero).alias(c) for c in ("n_left", "n_right", "n_both")])
    share = lambda n: F.round(F.coalesce(F.col("n_both") / F.nullif(n, zero), F.lit(0.0)), 6)
    return out.select("*", share(F.col("n_left")).alias("containment"), share(F.col("n_left") + F.col("n_right") - F.col("n_both")).alias("jaccard"))


def contained(tables: dict[str, DataFrame], least: float = 0.5, k: int = SKETCH) -> DataFrame:
    """All pairs of columns of one family with a containment of `least` or more, measured."""
    names = simple_columns(tables)
    found = candidates(sketches(tables, k, names), facts(tables, names), least, k)
    return measure(tables, found).where((F.col("containment") >= least) & (F.col("n_left") > 0))
