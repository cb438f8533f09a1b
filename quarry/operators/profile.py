"""Profiles of tables: one aggregation over all columns, exact unless asked otherwise."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from quarry.operators.reach import checkpointed

LOW_CARDINALITY = 50
MOST_COMMON = 20


def _plain(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, (ArrayType, MapType, StructType))]


def flattened(df: DataFrame) -> DataFrame:
    """df with its nested columns as JSON text, so that they are profiled like others."""
    nested = [f.name for f in df.schema.fields if isinstance(f.dataType, (ArrayType, MapType, StructType))]
    return df.withColumns({c: F.to_json(F.col(f"`{c}`")) for c in nested}) if nested else df


def column_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """One row per column: column_name, row_count, null_count, distinct_count, min_value,
    max_value, null_pct. Values are compared in their type and then shown as text.

    A single pass computes counts and bounds of all columns. Exact distinct counts come
    from one more pass over (column, value) pairs, whose duplicates are combined before
    the shuffle, so no task holds a column's values.
    """
    df = flattened(df)
    cols = _plain(df)
    aggs = []
    for i, c in enumerate(cols):
        v = F.col(f"`{c}`")
        aggs += [F.count(v).alias(f"n{i}"), F.min(v).cast("string").alias(f"lo{i}"), F.max(v).cast("string").alias(f"hi{i}")]
        if approximate:
            aggs.append(F.approx_count_distinct(v).alias(f"d{i}"))
    one = df.agg(F.count(F.lit(1)).alias("rows"), *aggs)
    parts = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("n"), F.col(f"lo{i}").alias("lo"), F.col(f"hi{i}").alias("hi"), (F.col(f"d{i}") if approximate else F.lit(None).cast("long")).alias("d")) for i, c in enumerate(cols)])
    out = one.select("rows", F.explode(parts).alias("p")).select(F.col("p.column_name"), F.col("rows").alias("row_count"), (F.col("rows") - F.col("p.n")).alias("null_count"), F.col("p.d").alias("distinct_count"), F.col("p.lo").alias("min_value"), F.col("p.hi").alias("max_value"))
    if not approximate:
        d = distinct_counts(df, cols)
        out = out.drop("distinct_count").join(d, "column_name", "left").withColumn("distinct_count", F.coalesce("distinct_count", F.lit(0)))
    return out.select("column_name", "row_count", "null_count", "distinct_count", "min_value", "max_value", F.round(F.lit(100.0) * F.col("null_count") / F.greatest(F.col("row_count"), F.lit(1)), 2).alias("null_pct"))


def values(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """column_name, value (text) of every non-null cell."""
    df = flattened(df)
    cols = cols or _plain(df)
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in cols])
    return df.select(F.explode(cells).alias("x")).select("x.column_name", "x.value").where(F.col("value").isNotNull())


#: types whose values are told apart as they are; equal ones are equal as text
_NATIVE = ("tinyint", "smallint", "int", "bigint", "boolean", "date", "timestamp_ntz", "decimal")


def told(kind: str, c: str) -> tuple[list[Column], Column]:
    """What tells the values of a column of a type apart (k0, and k1 of the two zeros of floating
    numbers), and the text of a value by these. Long texts have their SHA-256 in their place."""
    v = F.col(f"`{c}`")
    if kind.startswith(_NATIVE):
        return [v.alias("k0")], F.col("k0").cast("string")
    if kind == "timestamp":  # as text it is the time of day in the session's zone
        return [v.cast("timestamp_ntz").alias("k0")], F.col("k0").cast("string")
    if kind in ("float", "double"):
        return [v.alias("k0"), F.when(v == 0, v.cast("string")).alias("k1")], F.coalesce("k1", F.col("k0").cast("string"))
    text = v.cast("string")
    return [F.when(F.length(text) > 64, F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))).otherwise(text).alias("k0")], F.col("k0")


def distinct_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """column_name, distinct_count, of values that differ as text. A column is read by itself, and
    its values are brought together in their own type."""
    df = flattened(df)
    kinds, out = dict(df.dtypes), []
    for c in cols or _plain(df):
        keys, _ = told(kinds[c], c)
        out.append(df.select(*keys).where(F.col("k0").isNotNull()).distinct().agg(F.lit(c).alias("column_name"), F.count(F.lit(1)).alias("distinct_count")))
    return reduce(DataFrame.unionByName, out)


def _few(cols: list[str], most: int):
    """A task's distinct values of each column, until there are more than `most`: then a row
    with a null value alone."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[set | None] = [set() for _ in cols]
        for batch in batches:
            for i in range(len(cols)):
                if held[i] is not None:
                    held[i].update(pc.unique(batch.column(i)).drop_null().to_pylist())
                    if len(held[i]) > most:
                        held[i] = None
        for name, found in zip(cols, held, strict=True):
            told = [None] if found is None else list(found)
            if told:
                yield pa.RecordBatch.from_pydict({"column_name": [name] * len(told), "value": pa.array(told, pa.string())})

    return step


def low_cardinality_values(df: DataFrame, most: int = LOW_CARDINALITY) -> DataFrame:
    """column_name, sample_values: the sorted values of columns with at most `most`. A task
    hands on `most` values of a column, or that it has more."""
    df = flattened(df)
    cols = _plain(df)
    texts = df.select(*[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(cols)])
    found = texts.mapInArrow(_few(cols, most), "column_name string, value string").distinct()
    per = found.groupBy("column_name").agg(F.count_if(F.col("value").isNull()).alias("many"), F.count("value").alias("n"))
    few = per.where((F.col("many") == 0) & (F.col("n") <= most)).select("column_name")
    return found.join(few, "column_name").groupBy("column_name").agg(F.array_join(F.sort_array(F.collect_list("value")), "|").alias("sample_values"))


def most_common_values(df: DataFrame, cols: list[str], most: int = MOST_COMMON) -> DataFrame:
    """column_name, value, frequency, rank; ties by value."""
    counts = values(df, cols).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("frequency"))
    rank = F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("frequency"), "value"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= most)


def histogram(df: DataFrame, column: str, buckets: int = 10, accuracy: int = 10000) -> DataFrame:
    """bucket, bound: quantile bounds of a numeric column."""
    steps = [i / buckets for i in range(buckets + 1)]
    one = df.agg(F.percentile_approx(column, F.array(*[F.lit(s) for s in steps]), accuracy).alias("bounds"))
    return one.select(F.posexplode("bounds").alias("bucket", "bound"))


def places(df: DataFrame, column: str) -> DataFrame:
    """v, n, first, total: each value of a column (null ones left out), how many rows have it,
    how many rows have less, and how many rows there are. Values are counted before they are
    sorted by range, so a value that most rows share is one row; places are running sums in a
    range and the sizes of the ranges before it."""
    counts = df.select(F.col(column).alias("v")).where(F.col("v").isNotNull()).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    counts = checkpointed(counts.repartitionByRange("v").withColumn("p", F.spark_partition_id()))
    sizes = counts.groupBy("p").agg(F.sum("n").alias("size"))  # a row for each range
    before = F.sum("size").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("p", F.coalesce(before, F.lit(0)).alias("before"), F.sum("size").over(Window.partitionBy()).alias("total"))
    inner = F.sum("n").over(Window.partitionBy("p").orderBy("v").rowsBetween(Window.unboundedPreceding, -1))
    return counts.withColumn("inner", F.coalesce(inner, F.lit(0))).join(sizes, "p").select("v", "n", (F.col("before") + F.col("inner")).alias("first"), "total")


def exact_quantiles(df: DataFrame, column: str, buckets: int = 10) -> DataFrame:
    """bucket, bound: the exact quantiles 0, 1/buckets, ..., 1, between neighbours where a rank
    falls between two values."""
    ranked = places(df.select(F.col(column).cast("double").alias(column)), column)
    q = F.array(*[F.struct(F.lit(i).alias("bucket"), F.lit(i / buckets).alias("q")) for i in range(buckets + 1)])
    x = ranked.select("v", "n", "first", "total", F.explode(q).alias("x")).withColumn("at", F.col("x.q") * (F.col("total") - 1))
    part = F.col("at") - F.floor("at")
    # the ranks that a quantile lies between, and how much each counts
    ends = F.array(F.struct(F.floor("at").alias("rank"), (1 - part).alias("weight")), F.struct(F.ceil("at").alias("rank"), part.alias("weight")))
    hit = x.select("v", "n", "first", F.col("x.bucket").alias("bucket"), F.explode(ends).alias("e")).where((F.col("e.weight") > 0) & (F.col("e.rank") >= F.col("first")) & (F.col("e.rank") < F.col("first") + F.col("n")))
    return hit.groupBy("bucket").agg(F.sum(F.col("v") * F.col("e.weight")).alias("bound"))


#: types whose equal values are equal as text, so that they need not be shown as text
_AS_IS = ("tinyint", "smallint", "int", "bigint", "boolean", "date", "timestamp")


def _compared(df: DataFrame, cols: list[str]) -> list[Column]:
    """c0, c1, ...: what tells the values of columns apart."""
    kinds, out = dict(df.dtypes), []
    for i, c in enumerate(cols):
        v = F.col(f"`{c}`")
        if kinds[c] not in _AS_IS:
            v = v.cast("string")
            v = F.when(F.length(v) > 64, F.sha2(v.cast("binary"), 256)).otherwise(v)
        out.append(v.alias(f"c{i}"))
    return out


def _no_keys(cols: list[str]):
    """column_name: the columns of which a batch has a null, or a value twice."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = set(range(len(cols)))
        for batch in batches:
            for i in sorted(left):
                c = batch.column(i)
                if c.null_count or len(pc.unique(c)) < len(c):
                    left.discard(i)
                    yield pa.RecordBatch.from_pydict({"column_name": [cols[i]]})

    return step


def key_candidates(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, column_name of columns without nulls whose values are all different.

    Most columns show a null or a value twice among a few thousand rows and are ruled out
    by that; only values of the others are brought together."""
    tables = {t: flattened(df) for t, df in tables.items()}
    seen = []
    for t, df in tables.items():
        cols = _plain(df)
        ruled = df.select(*_compared(df, cols)).mapInArrow(_no_keys(cols), "column_name string")
        seen.append(ruled.select(F.lit(t).alias("table_name"), "column_name").distinct())
    out = {(r.table_name, r.column_name) for r in reduce(DataFrame.unionByName, seen).collect()}  # names of columns
    found = []
    for t, df in tables.items():
        left = [c for c in _plain(df) if (t, c) not in out]
        if not left:
            continue
        p = column_profile(df.select(*[F.col(f"`{c}`") for c in left]))
        found.append(p.where((F.col("null_count") == 0) & (F.col("distinct_count") == F.col("row_count")) & (F.col("row_count") > 0)).select(F.lit(t).alias("table_name"), "column_name"))
    nothing = next(iter(tables.values())).sparkSession.createDataFrame([], "table_name string, column_name string")
    return reduce(DataFrame.unionByName, found, nothing)


def key_integrity(spark: SparkSession, tables: dict[str, DataFrame], keys: list[tuple[str, str, str, str]]) -> DataFrame:
    """Orphans of each declared key: src_table, src_column, dst_table, dst_column, n_rows,
    n_orphans. Both sides are reduced to distinct values before they meet."""
    out = None
    for st, sc, dt, dc in keys:
        src = tables[st].select(F.col(sc).cast("string").alias("v")).where(F.col("v").isNotNull()).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        dst = tables[dt].select(F.col(dc).cast("string").alias("v")).distinct().withColumn("hit", F.lit(1))
        one = src.join(dst, "v", "left").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.when(F.col("hit").isNull(), F.col("n"))), F.lit(0)).alias("n_orphans"))
        one = one.select(F.lit(st).alias("src_table"), F.lit(sc).alias("src_column"), F.lit(dt).alias("dst_table"), F.lit(dc).alias("dst_column"), "n_rows", "n_orphans")
        out = one if out is None else out.unionByName(one)
    return out


def value_overlap(left: DataFrame, left_column: str, right: DataFrame, right_column: str) -> DataFrame:
    """n_left, n_right, n_both, jaccard, containment of the distinct values."""
    side = lambda d, c, f: d.select(F.col(c).cast("string").alias("v")).where(F.col("v").isNotNull()).distinct().withColumn(f, F.lit(1))
    both = side(left, left_column, "a").join(side(right, right_column, "b"), "v", "full")
    one = both.agg(F.count("a").alias("n_left"), F.count("b").alias("n_right"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n_both"))
    union = F.col("n_left") + F.col("n_right") - F.col("n_both")
    return one.select("n_left", "n_right", "n_both", F.round(F.coalesce(F.col("n_both") / F.nullif(union, F.lit(0)), F.lit(0.0)), 6).alias("jaccard"), F.round(F.coalesce(F.col("n_both") / F.nullif(F.col("n_left"), F.lit(0)), F.lit(0.0)), 6).alias("containment"))


def rank_correlation(df: DataFrame, column: str, order: str) -> DataFrame:
    """Correlation of the ranks of a column's values with the ranks of the rows' order (as a
    clustered table has); equal values have the rank of the first of them."""
    both = df.select(F.col(column).alias("x"), F.col(order).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    pairs = checkpointed(both.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")))
    for c in ("x", "y"):
        place = places(both, c).select(F.col("v").alias(c), F.col("first").cast("double").alias(f"r{c}"))
        pairs = pairs.join(place, c)
    n, x, y = F.col("n"), F.col("rx"), F.col("ry")
    s = pairs.agg(F.sum(n).alias("n"), F.sum(n * x).alias("x"), F.sum(n * y).alias("y"), F.sum(n * x * x).alias("xx"), F.sum(n * y * y).alias("yy"), F.sum(n * x * y).alias("xy"))
    cov, vx, vy = F.expr("n * xy - x * y"), F.expr("n * xx - x * x"), F.expr("n * yy - y * y")
    return s.select(F.round(F.when((vx > 0) & (vy > 0), cov / F.sqrt(vx) / F.sqrt(vy)), 6).alias("correlation"))
