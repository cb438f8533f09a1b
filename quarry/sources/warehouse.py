"""Warehouse catalogs as frames: access history, indexes, statistics, object lineage.

The frames come from a warehouse's own connector (or JDBC); these functions are the
joins and aggregates over them, so they also run on recorded catalogs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.scalars import staleness_days

STALE_DAYS = 90
MOST_COMMON = 20


def access(reads: DataFrame, writes: DataFrame, tables: DataFrame, now: Column, stale_days: int = STALE_DAYS, include_unread: bool = False) -> DataFrame:
    """reads(fq_name, at), writes(fq_name): one row per access; tables(table_name) ->
    table_name, access_read_count, access_write_count, days_since_last_access,
    potentially_unused (never read, or not for stale_days). A list of accessed objects is
    exploded by the caller; each side is counted before the full outer join. With
    include_unread, tables that nobody touched have their row too."""
    r = reads.groupBy("fq_name").agg(F.count(F.lit(1)).alias("rc"), F.max("at").alias("last"))
    w = writes.groupBy("fq_name").agg(F.count(F.lit(1)).alias("wc"))
    x = r.join(w, "fq_name", "full")
    days = staleness_days(F.col("last"), now)
    x = tables.join(x, F.col("fq_name") == F.col("table_name"), "left" if include_unread else "inner")
    return x.select("table_name", F.coalesce("rc", F.lit(0)).alias("access_read_count"), F.coalesce("wc", F.lit(0)).alias("access_write_count"), days.alias("days_since_last_access"), (F.col("rc").isNull() | (days >= stale_days)).alias("potentially_unused"))


def exploded_access(history: DataFrame, objects: str) -> DataFrame:
    """history(query_start_time, objects array<struct<objectName>>) -> fq_name, at."""
    return history.select(F.explode(objects).alias("o"), F.col("query_start_time").alias("at")).select(F.col("o.objectName").alias("fq_name"), "at")


def overlay(columns: DataFrame, statistics: DataFrame) -> DataFrame:
    """Profile values where the catalog has none: the catalog's own value wins when it is
    not null. statistics has the key and any of the columns' fields."""
    key = ["table_name", "column_name"]
    more = [c for c in statistics.columns if c not in key]
    s = statistics.select(*key, *[F.col(c).alias(f"__s_{c}") for c in more])
    x = columns.join(s, key, "left")
    for c in more:
        x = x.withColumn(c, F.coalesce(c, f"__s_{c}") if c in columns.columns else F.col(f"__s_{c}"))
    return x.drop(*[f"__s_{c}" for c in more])


def catalog_statistics(stats: DataFrame, row_counts: DataFrame) -> DataFrame:
    """stats(table_name, column_name, n_distinct, null_frac, mcv array<string>) with the
    distinct count (a negative n_distinct is a share of the rows), the null percentage and
    at most MOST_COMMON values."""
    x = stats.join(row_counts, "table_name", "left")
    distinct = F.when(F.col("n_distinct") < 0, F.round(-F.col("n_distinct") * F.col("row_count"))).otherwise(F.col("n_distinct")).cast("long")
    return x.select("table_name", "column_name", distinct.alias("distinct_count"), F.round(F.col("null_frac") * 100, 2).alias("null_pct"), F.slice("mcv", 1, MOST_COMMON).alias("mcv"))


def object_lineage(dependencies: DataFrame, view_sql: DataFrame, streams: DataFrame, task_reads: DataFrame, task_writes: DataFrame) -> DataFrame:
    """src_table, dst_table, lineage_type, confidence: recorded dependencies (1.0), view
    texts for what they lack (0.85), streams (1.0), and each task's reads times its writes
    (0.85; a task names a handful of tables)."""
    pair = ["src_table", "dst_table"]
    tag = lambda df, kind, c: df.select(*pair, F.lit(kind).alias("lineage_type"), F.lit(c).alias("confidence")).where("src_table <> dst_table")
    own = tag(dependencies, "VIEW", 1.0)
    text = tag(view_sql.join(dependencies, pair, "left_anti"), "VIEW", 0.85)
    task = task_reads.join(task_writes, "task").select(*pair)
    return own.unionByName(text).unionByName(tag(streams, "STREAM", 1.0)).unionByName(tag(task, "TASK", 0.85)).distinct()


def merge_grants(profiles: dict[str, dict], grants: dict[str, list[str]], roles: set[str] | None = None) -> dict[str, dict]:
    """Visibility profiles with allowed_tables from grants. Profiles that held nothing but
    allowed_tables go with their grants; other settings stay. With roles, only those."""
    out = {k: dict(v) for k, v in profiles.items()}
    if roles is None:
        out = {k: v for k, v in out.items() if k in grants or set(v) != {"allowed_tables"}}
    for name in sorted(grants if roles is None else roles):
        body = {k: v for k, v in out.get(name, {}).items() if k != "allowed_tables"}
        if grants.get(name):
            body["allowed_tables"] = list(grants[name])
        if body:
            out[name] = body
        else:
            out.pop(name, None)
    return out
