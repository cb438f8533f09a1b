"""Snapshots of a catalog: differences, what they touch, and patching a graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators import graph

# The fields that are compared, in the order in which they are told.
COLUMN_FIELDS = ("data_type", "nullable", "is_primary_key", "is_foreign_key", "default_value", "comment", "is_indexed", "check_constraints", "ordinal_position", "most_common_values", "histogram_bounds", "stats_correlation")
TABLE_FIELDS = (
    "comment", "table_type", "row_count", "seq_scan_count", "idx_scan_count", "insert_count", "update_count", "delete_count", "is_partitioned", "partition_key", "grants",
    "access_read_count", "access_write_count", "days_since_last_access", "potentially_unused", "table_bytes", "clustering_key",
)


def _details(fields: list[str]) -> Column:
    shown = lambda c: F.coalesce(c.cast("string"), F.lit("none"))
    each = [F.when(~F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}")), F.concat(F.lit(f"{f}: "), shown(F.col(f"o.{f}")), F.lit(" -> "), shown(F.col(f"n.{f}")))) for f in fields]
    return F.array_join(F.array_compact(F.array(*each)), "; ") if each else F.lit("")


def _diff(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str], target: str) -> DataFrame:
    o, n = old.withColumn("there", F.lit(True)).alias("o"), new.withColumn("there", F.lit(True)).alias("n")
    cond = None
    for k in keys:
        c = F.col(f"o.{k}") == F.col(f"n.{k}")
        cond = c if cond is None else cond & c
    x = o.join(n, cond, "full")
    change = F.when(F.col("o.there").isNull(), "added").when(F.col("n.there").isNull(), "removed").otherwise("modified")
    out = x.select(F.lit(target).alias("target"), change.alias("change_type"), *[F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in keys], F.when(change == "modified", _details(fields)).otherwise("").alias("details"))
    return out.where((F.col("change_type") != "modified") | (F.col("details") != ""))


def diff_snapshots(old_tables: DataFrame, new_tables: DataFrame, old_columns: DataFrame, new_columns: DataFrame) -> DataFrame:
    """target, change_type, table_name, column_name, details. Columns are compared within
    tables that both snapshots have; null fields are equal to null."""
    both = lambda a, b, names: [f for f in names if f in a.columns and f in b.columns]
    tables = _diff(old_tables, new_tables, ["table_name"], both(old_tables, new_tables, TABLE_FIELDS), "table").withColumn("column_name", F.lit(None).cast("string"))
    kept = old_tables.select("table_name").intersect(new_tables.select("table_name"))
    columns = _diff(old_columns.join(kept, "table_name", "left_semi"), new_columns.join(kept, "table_name", "left_semi"), ["table_name", "column_name"], both(old_columns, new_columns, COLUMN_FIELDS), "column")
    return tables.unionByName(columns)


def diff_lineage(old: DataFrame, new: DataFrame) -> DataFrame:
    """target, change_type, src_table, dst_table."""
    keys = ["src_table", "dst_table"]
    added = new.join(old, keys, "left_anti").select(F.lit("lineage").alias("target"), F.lit("added").alias("change_type"), *keys)
    return added.unionByName(old.join(new, keys, "left_anti").select(F.lit("lineage").alias("target"), F.lit("removed").alias("change_type"), *keys)).distinct()


def affected_paths(paths: DataFrame, changes: DataFrame) -> DataFrame:
    """Paths (from_table, to_table, path as tables joined by >) that pass a changed table."""
    changed = changes.select(F.col("table_name").alias("t")).distinct()
    hops = paths.select("from_table", "to_table", "path", F.explode(F.split("path", ">")).alias("t"))
    return hops.join(changed, "t").groupBy("from_table", "to_table", "path").agg(F.array_join(F.sort_array(F.collect_set("t")), ",").alias("changed_tables"))


def diff(old, new) -> DataFrame:
    """target, change_type, table_name, column_name, details of two snapshots: tables, columns
    and lineage (table_name is the table that is fed, column_name null)."""
    place = lambda df: df.withColumnRenamed("ordinal", "ordinal_position")
    both = diff_snapshots(old.tables, new.tables, place(old.columns), place(new.columns))
    fed = diff_lineage(old.lineage, new.lineage).select("target", "change_type", F.col("dst_table").alias("table_name"), F.lit(None).cast("string").alias("column_name"), F.concat("src_table", F.lit(" -> "), "dst_table").alias("details"))
    return both.unionByName(fed)


def affected_clusters(members: DataFrame, clusters: DataFrame, changes: DataFrame) -> DataFrame:
    """Clusters (cluster, label) with a changed table, and which."""
    changed = changes.select("table_name").distinct()
    hit = members.join(changed, "table_name").groupBy("cluster").agg(F.array_join(F.sort_array(F.collect_set("table_name")), ",").alias("changed_tables"))
    return clusters.select("cluster", "label").join(hit, "cluster")


def summary(changes: DataFrame) -> str:
    """One line of counts."""
    n = {(r.target, r.change_type): r.n for r in changes.groupBy("target", "change_type").agg(F.count(F.lit(1)).alias("n")).collect()}
    told = [f"{k[0]}s {k[1]}: {n[k]}" for k in sorted(n)]
    return "; ".join(told) if told else "no changes"


# What patch_graph counts, as its results name it.
COUNTERS = (
    "tables_added", "tables_removed", "columns_added", "columns_removed", "columns_updated", "fk_edges_removed", "inferred_joins_removed",
    "join_paths_marked_stale", "cluster_memberships_removed", "clusters_marked_stale", "foreign_keys_synced",
)


def patch_graph(stored: dict[str, DataFrame], snapshot, changes: DataFrame, dry_run: bool = False) -> tuple[dict[str, DataFrame], dict[str, int]]:
    """(the graph after the changes, counts by COUNTERS). Added and modified tables and columns
    are upserted from the new snapshot, removed ones go with their edges and the joins over
    them; paths and clusters that touch a changed table become stale, and the declared keys
    are those of the snapshot. A dry run counts alone."""
    connection = snapshot.connection
    fresh = graph.build(connection, snapshot.tables, snapshot.columns, snapshot.foreign_keys, snapshot.lineage)
    of = lambda target, *kinds: changes.where((F.col("target") == target) & F.col("change_type").isin(*kinds))
    table_ids = lambda df: df.select(graph.node_of(connection, "table_name").alias("node_id")).distinct()
    column_ids = lambda df: df.select(F.concat_ws("::", graph.node_of(connection, "table_name"), "column_name").alias("node_id")).distinct()
    gone_t, new_t, gone_c = table_ids(of("table", "removed")), table_ids(of("table", "added")), column_ids(of("column", "removed"))
    touched = table_ids(changes.where(~((F.col("target") == "table") & (F.col("change_type") == "modified"))))
    with_table = lambda ids: fresh["SchemaColumn"].select("node_id", graph.node_of(connection, "table_name").alias("t")).join(ids.withColumnRenamed("node_id", "t"), "t", "left_semi").select("node_id")
    new_c, changed_c = column_ids(of("column", "added")).unionByName(with_table(new_t)).distinct(), column_ids(of("column", "modified"))
    # joins over a removed column, or of a removed table
    over = lambda df, side, c: df.select("edge_id", side, F.explode(F.split(c, ",")).alias("_c")).select("edge_id", F.concat_ws("::", F.col(side), F.col("_c")).alias("node_id")).join(gone_c, "node_id", "left_semi").select("edge_id")
    of_table = lambda df, side: df.select("edge_id", F.col(side).alias("node_id")).join(gone_t, "node_id", "left_semi").select("edge_id")

    def lost(df: DataFrame) -> DataFrame:
        return over(df, "src", "source_column").unionByName(over(df, "dst", "target_column")).unionByName(of_table(df, "src")).unionByName(of_table(df, "dst")).distinct()

    empty = changes.limit(0).select(F.lit("").alias("edge_id"))
    fk, inferred = stored.get("FK_REFERENCES"), stored.get("INFERRED_JOIN")
    fk_lost, inferred_lost = lost(fk) if fk is not None else empty, lost(inferred) if inferred is not None else empty
    synced = fresh["FK_REFERENCES"].join(fk.select("edge_id"), "edge_id", "left_anti") if fk is not None else fresh["FK_REFERENCES"]
    paths_hit = stored["JoinPath"].select("node_id", F.explode("tables").alias("t")).join(touched.withColumnRenamed("node_id", "t"), "t", "left_semi").select("node_id").distinct() if "JoinPath" in stored else empty
    left = stored["IN_CLUSTER"].join(touched.withColumnRenamed("node_id", "src"), "src", "left_semi") if "IN_CLUSTER" in stored else None
    counted = {
        "tables_added": new_t, "tables_removed": gone_t, "columns_added": new_c, "columns_removed": gone_c, "columns_updated": changed_c, "fk_edges_removed": fk_lost, "inferred_joins_removed": inferred_lost,
        "join_paths_marked_stale": paths_hit, "cluster_memberships_removed": left if left is not None else empty, "clusters_marked_stale": left.select("dst").distinct() if left is not None else empty, "foreign_keys_synced": synced,
    }
    # one job: a row for each thing counted, under its counter's name
    every = reduce(DataFrame.unionByName, [counted[k].select(F.lit(k).alias("counter")) for k in COUNTERS])
    counts = dict.fromkeys(COUNTERS, 0) | {r["counter"]: r["n"] for r in every.groupBy("counter").agg(F.count(F.lit(1)).alias("n")).collect()}
    if dry_run:
        return dict(stored), counts
    out = dict(stored)
    derived = [c for c in graph.DERIVED_FIELDS if c in stored["SchemaTable"].columns]
    tables = stored["SchemaTable"].join(gone_t, "node_id", "left_anti").select(*stored["SchemaTable"].columns)
    more = fresh["SchemaTable"].withColumns({c: F.lit(None).cast(tables.schema[c].dataType) for c in tables.columns if c not in fresh["SchemaTable"].columns})
    out["SchemaTable"] = graph.upsert(tables, more.select(*tables.columns), "node_id", tuple(derived + [c for c in ("description", "tags", "test_count", "has_external_consumers") if c in tables.columns]))
    gone_below = lambda df, c: df.join(gone_t.select(F.col("node_id").alias("_t")), F.startswith(F.col(c), F.concat("_t", F.lit("::"))), "left_anti").join(gone_c.withColumnRenamed("node_id", c), c, "left_anti").select(*df.columns)
    columns = gone_below(stored["SchemaColumn"], "node_id")
    more = fresh["SchemaColumn"].withColumns({c: F.lit(None).cast(columns.schema[c].dataType) for c in columns.columns if c not in fresh["SchemaColumn"].columns})
    out["SchemaColumn"] = graph.upsert(columns, more.select(*columns.columns), "node_id")
    for label in ("HAS_COLUMN", "HAS_SUBCOLUMN", "FK_REFERENCES", "LINEAGE"):
        if label in fresh:
            out[label] = fresh[label]
    if inferred is not None:
        out["INFERRED_JOIN"] = graph.connected_only(inferred.join(inferred_lost, "edge_id", "left_anti").select(*inferred.columns), out["SchemaTable"])
    if "JoinPath" in out:
        kept = out["JoinPath"].join(out["JoinPath"].select("node_id", F.explode("tables").alias("t")).join(gone_t.withColumnRenamed("node_id", "t"), "t", "left_semi").select("node_id").distinct(), "node_id", "left_anti").select(*out["JoinPath"].columns)
        out["JoinPath"] = graph.mark_stale(kept, touched)
    return graph.remove_from_clusters(out, touched), counts


def patch(old: DataFrame, new: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(the patched frame, counts by action): rows of `new` replace those of `old` with the
    same keys, `old` without a counterpart go. The counts are the dry run."""
    gone, fresh = old.join(new, keys, "left_anti"), new.join(old, keys, "left_anti")
    both = old.select(*[F.col(c).alias(f"o_{c}") for c in old.columns]).join(new, [F.col(f"o_{k}") == F.col(k) for k in keys])
    more = [c for c in new.columns if c not in keys]
    differs = F.lit(False)
    for c in more:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"o_{c}"))
    count = lambda df, action: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(action).alias("action"), "n")
    counts = count(gone, "deleted").unionByName(count(fresh, "inserted")).unionByName(count(both.where(differs), "updated"))
    kept = old.join(new, keys, "left_semi").select(*old.columns)
    out = kept
    for k in more:
        out = out.drop(k)
    out = out.join(new, keys).select(*new.columns).unionByName(fresh.select(*new.columns))
    return out, counts
