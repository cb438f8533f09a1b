"""The questions a client asks, each answered as a plain document (dict).

A Workspace holds the frames of one connection: of a source read now, or of a stored graph.
Every tool returns its result or {"error": ...} with suggestions; what a profile hides
never appears.
"""

from __future__ import annotations

import difflib
import json
import threading
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry import lifecycle
from quarry.config import Config
from quarry.functions import scalars as S
from quarry.operators import classify, cluster, cypher, discover, drift, entities, graph, paths, profile, reach, search, semantic
from quarry.operators.reach import checkpointed
from quarry.operators.visibility import Profile, column_visible, redact, table_visible
from quarry.plans import sql_walk
from quarry.sources import snapshot

#: days without an access after which an unused table without inbound lineage is called so
DEPRECATED_DAYS = 90


def _schema(table):
    return F.when(table.contains("."), F.substring_index(table, ".", 1)).otherwise(F.lit("main"))


def _bare(table):
    return F.when(table.contains("."), F.regexp_replace(table, r"^[^.]*\.", "")).otherwise(table)


class Workspace:
    """Catalog frames of one connection; from a source, or (see stored) from a state folder."""

    def __init__(self, spark: SparkSession, name: str, source=None, layer: semantic.Layer | None = None, profile: Profile | None = None, snap: snapshot.Snapshot | None = None, frames: dict[str, DataFrame] | None = None, entry: dict | None = None, config: Config | None = None):
        self.spark, self.name, self.source = spark, name, source
        self.layer, self.profile, self.config = layer or semantic.Layer(()), profile or Profile(), config or Config()
        self.entry = entry or {}
        snap = snap or snapshot.inspect(source, name, statistics=False)
        kind = F.coalesce("table_type", F.lit("table"))
        seen = table_visible(self.profile, F.lit(name), _schema(F.col("table_name")), _bare(F.col("table_name")), kind)
        self.everything = snap
        snap = snap.restricted(snap.tables.where(seen))
        self.tables = checkpointed(snap.tables)
        t = F.col("table_name")
        self.columns = checkpointed(snap.columns.where(column_visible(self.profile, _schema(t), _bare(t), F.col("column_name"))))
        self.keys = checkpointed(snap.foreign_keys)
        self.lineage, self.dialect = checkpointed(snap.lineage), snap.dialect
        self.aliases = checkpointed(classify.shadow_aliases(self.tables, self.lineage, self.config.graph.alias_sources))
        flat = self.keys.select("src_table", "src_column", "dst_table", "dst_column")
        if frames and "INFERRED_JOIN" in frames:
            self.inferred = checkpointed(self._named_joins(frames))
        else:
            rows = self.tables.select("table_name", "row_count")
            self.inferred = checkpointed(discover.discover(discover.signal_defaults(self.columns.where("parent IS NULL").join(rows, "table_name", "left")), flat, self.aliases))
        self.edges = checkpointed(paths.edges(flat, self.inferred, self.aliases if self.config.graph.collapse_aliases else None))
        self.frames = frames

    @classmethod
    def stored(cls, state: lifecycle.State, connection: str, profile: Profile | None = None, version: int | None = None, config: Config | None = None) -> Workspace:
        entry = state.registry().get(connection)
        if entry is None:
            raise KeyError(f"connection {connection!r} is not indexed")
        frames = state.store(connection).read(version or entry["version"])
        return cls(state.spark, connection, None, state.layer(connection), profile, state.snapshot(connection), frames, entry, config)

    def _named_joins(self, frames: dict[str, DataFrame]) -> DataFrame:
        names = frames["SchemaTable"].select("node_id", "table_name").join(self.tables.select("table_name"), "table_name", "left_semi")
        end = lambda node, to: names.select(F.col("node_id").alias(node), F.col("table_name").alias(to))
        x = frames["INFERRED_JOIN"].join(end("src", "src_table"), "src").join(end("dst", "dst_table"), "dst")
        return x.select(F.col("source").alias("kind"), "src_table", F.col("source_column").alias("src_column"), "dst_table", F.col("target_column").alias("dst_column"), "confidence", "reasoning")

    def roles(self) -> DataFrame:
        return lifecycle.classified(self.tables, self.columns, self.keys)

    def graph(self) -> dict[str, DataFrame]:
        """The labels, with what is hidden left out."""
        if self.frames is None:
            return graph.build(self.name, self.tables, self.columns, self.keys, self.lineage, self.inferred)
        out, tables = {}, graph.node_of(self.name, "table_name")
        seen = self.tables.select(tables.alias("node_id"))
        below = self.columns.select(F.concat_ws("::", tables, "column_name").alias("node_id"))
        for label, df in self.frames.items():
            if label in ("SchemaTable", "SchemaColumn"):
                out[label] = df.join(seen if label == "SchemaTable" else below, "node_id", "left_semi")
            elif label == "JoinPath":
                hidden = df.select("node_id", F.explode("tables").alias("t")).join(seen.withColumnRenamed("node_id", "t"), "t", "left_anti").select("node_id").distinct()
                out[label] = df.join(hidden, "node_id", "left_anti")
            else:
                out[label] = df
        ids = None
        for label in graph.NODES:
            if label in out:
                ids = out[label].select("node_id") if ids is None else ids.unionByName(out[label].select("node_id"))
        return {k: graph.connected_only(v, ids) if k in graph.EDGES else v for k, v in out.items()}

    def names(self) -> list[str]:
        return sorted(r[0] for r in self.tables.select("table_name").collect())

    def resolve(self, table: str) -> tuple[str | None, dict | None]:
        """The table's own name: exact first, then by its bare name, then whatever the case."""
        names, plain = self.names(), table.removeprefix("main.")
        for hit in ([n for n in names if n == plain], [n for n in names if n.split(".")[-1] == plain], [n for n in names if n.lower() == plain.lower()], [n for n in names if n.split(".")[-1].lower() == plain.split(".")[-1].lower() and "." not in plain]):
            if len(hit) == 1:
                return hit[0], None
            if hit:
                return None, {"error": f"table {table!r} is ambiguous", "suggestions": hit[:5]}
        return None, {"error": f"table {table!r} is unknown", "suggestions": difflib.get_close_matches(plain, names, 5, 0.5)}

    def days_old(self) -> int | None:
        at = self.entry.get("indexed_at")
        return None if not at else max(0, (datetime.now(timezone.utc) - datetime.strptime(at, "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=timezone.utc)).days)

    def warning(self) -> str | None:
        days, most = self.days_old(), self.config.graph.stale_after_days
        return f"the index is {days} days old (more than {most}); run reindex" if days is not None and days > most else None


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def list_databases(w: Workspace) -> dict:
    n = w.tables.agg(F.count(F.lit(1)).alias("tables"), F.sum(F.greatest("row_count", F.lit(0))).alias("rows"), F.array_sort(F.collect_set(_schema(F.col("table_name")))).alias("schemas")).first()
    outside = None if w.frames is None or "has_external_consumers" not in w.frames["SchemaTable"].columns else bool(w.graph()["SchemaTable"].agg(F.max("has_external_consumers")).first()[0])
    # three states: there, not there, or the source cannot tell
    state = lambda df, known: "available" if df.limit(1).count() else "none" if known else "unknown"
    told = {"lineage": state(w.lineage, w.dialect != "parquet" or w.lineage.limit(1).count() > 0), "usage": state(w.tables.where("seq_scan_count IS NOT NULL OR access_read_count IS NOT NULL"), False), "statistics": state(w.columns.where("distinct_count IS NOT NULL"), False)}
    return {"databases": [{"name": w.name, "dialect": w.dialect, "tables": n["tables"], "rows": n["rows"], "schemas": n["schemas"], "columns": w.columns.count(), "declared_joins": w.keys.count(), "inferred_joins": w.inferred.count(), "has_external_consumers": outside, "capabilities": told, "indexed_at": w.entry.get("indexed_at"), "staleness_warning": w.warning()}]}


def schema(w: Workspace) -> dict:
    g = w.graph()
    return {"nodes": list(graph.NODES), "edges": list(graph.EDGES), "labels": {k: v.columns for k, v in g.items()}, "summary": graph_summary(g)}


def graph_summary(g: dict[str, DataFrame]) -> str:
    """The labels and their properties as text."""
    lines = []
    for kind, names in (("Nodes", graph.NODES), ("Edges", graph.EDGES)):
        lines.append(f"{kind}:")
        lines += [f"  {n}({', '.join(f'{f.name} {f.dataType.simpleString()}' for f in g[n].schema.fields)})" for n in names if n in g]
    return "\n".join(lines)


def documents(w: Workspace) -> DataFrame:
    return search.catalog_documents(w.tables, w.columns)


def query(w: Workspace, q: str, limit: int = 10) -> dict:
    hits = search.search(documents(w), "table_name", q, limit, stem=True).join(documents(w), "table_name").orderBy("rank")
    return {"query": q, "hits": _rows(hits.select(F.lit("SchemaTable").alias("node_type"), "table_name", F.col("table_name").alias("name"), F.lit(w.name).alias("connection_name"), F.lit(w.name).alias("database_name"), "description", S.snippet(F.col("description"), 160).alias("snippet"), "score", "rank"))}


def relationships(w: Workspace, table: str) -> DataFrame:
    """Outgoing joins of a table, the columns of one constraint together and in order."""
    k = w.keys.where(F.col("src_table") == table)
    one = F.struct("position", "src_column", "dst_column")
    declared = k.groupBy("dst_table", "constraint_name").agg(F.array_sort(F.collect_list(one)).alias("p"))
    declared = declared.select(F.col("dst_table").alias("target_table"), F.lit("FK_REFERENCES").alias("rel_type"), F.col("p.src_column").alias("source_columns"), F.col("p.dst_column").alias("target_columns"), "constraint_name", F.lit("declared").alias("source"), F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("reasoning"))
    guessed = w.inferred.where(F.col("src_table") == table).select(F.col("dst_table").alias("target_table"), F.lit("INFERRED_JOIN").alias("rel_type"), F.array("src_column").alias("source_columns"), F.array("dst_column").alias("target_columns"), F.lit(None).cast("string").alias("constraint_name"), F.col("kind").alias("source"), "confidence", "reasoning")
    both = declared.unionByName(guessed)
    if w.config.graph.collapse_aliases:
        both = both.join(w.aliases.select(F.col("table_name").alias("target_table")), "target_table", "left_anti").select(*declared.columns)
    return both.orderBy("rel_type", F.desc("confidence"), "target_table", F.array_join("source_columns", ","))


def lineage_of(w: Workspace, table: str) -> tuple[list[dict], list[dict]]:
    """(what feeds the table, what it feeds)."""
    one = lambda mine, other: _rows(w.lineage.where(F.col(mine) == table).select(F.col(other).alias("table"), "lineage_type", "confidence").distinct().orderBy("table", "lineage_type"))
    return one("dst_table", "src_table"), one("src_table", "dst_table")


def lineage_page(into: list[dict], out: list[dict]) -> str:
    lines = []
    for title, rows in (("Fed by", into), ("Feeds", out)):
        if rows:
            lines += [f"### {title}", "", *[f"- {r['table']} ({r['lineage_type']}, {r['confidence']:g})" for r in rows], ""]
    return "\n".join(lines)


def aliases_of(w: Workspace, table: str) -> list[str]:
    """The shadow aliases of a base table."""
    return [r[0] for r in w.lineage.where(F.col("src_table") == table).join(w.aliases.withColumnRenamed("table_name", "dst_table"), "dst_table", "left_semi").select("dst_table").distinct().orderBy("dst_table").collect()]


def base_of(w: Workspace, table: str) -> str | None:
    """The table behind a shadow alias."""
    got = w.lineage.where(F.col("dst_table") == table).join(w.aliases.withColumnRenamed("table_name", "dst_table"), "dst_table", "left_semi").select("src_table").distinct().orderBy("src_table").first()
    return got[0] if got else None


def cluster_of(w: Workspace, table: str) -> dict | None:
    g = w.graph()
    if "Cluster" not in g:
        return None
    at = w.tables.where(F.col("table_name") == table).select(graph.node_of(w.name, "table_name").alias("table"))
    got = _rows(graph.best_cluster(g).join(at, "table").select(F.col("node_id").alias("cluster_id"), "label", "description", "cohesion_score", "schema_pattern", "stale"))
    return got[0] if got else None


def entity_of(w: Workspace, table: str) -> dict | None:
    g = w.graph()
    if "Entity" not in g:
        return None
    at = w.tables.where(F.col("table_name") == table).select(graph.node_of(w.name, "table_name").alias("table"))
    got = _rows(entities.entity_of_table(g["Entity"], g["REPRESENTS"]).join(at, "table"))
    return got[0] if got else None


def column_info(w: Workspace, table: str) -> list[dict]:
    described = F.col("description") if "description" in w.columns.columns else F.lit(None).cast("string")
    x = w.columns.where(F.col("table_name") == table)
    return _rows(x.orderBy("ordinal", "column_name").select(
        "column_name", "data_type", "nullable", "parent", "is_primary_key", "is_foreign_key", F.coalesce(F.nullif(F.trim(described), F.lit("")), "comment").alias("description"), "default_value", "is_indexed", "index_type", "index_unique",
        S.json_to_list(F.col("check_constraints")).alias("check_constraints"), S.json_to_list(F.col("most_common_values")).alias("most_common_values"), S.json_to_list(F.col("histogram_bounds")).alias("histogram_bounds"), "stats_correlation", "distinct_count", "null_pct"))


def context(w: Workspace, table: str, detail: str = "standard") -> dict:
    """Everything known of one table, at three levels of detail."""
    name, error = w.resolve(table)
    if error:
        return error
    row = _rows(w.tables.where(F.col("table_name") == name))[0]
    node = _rows(w.graph()["SchemaTable"].where(F.col("table_name") == name))[0]
    role = _rows(w.roles().where(F.col("table_name") == name))[0]
    into, fed = lineage_of(w, name)
    cols, rels, group, entity = column_info(w, name), _rows(relationships(w, name)), cluster_of(w, name), entity_of(w, name)
    description = (node.get("description") or "").strip() or row.get("comment") or ""
    unused = row["potentially_unused"] and (row["days_since_last_access"] or 0) > DEPRECATED_DAYS and not into
    deprecated = f"no inbound lineage and no access in {row['days_since_last_access']} days: probably deprecated" if unused else None
    if detail == "summary":
        short = {"table": name, "description": description if len(description) <= 120 else description[:117] + "...", "column_count": len(cols), "relationship_count": len(rels), "lineage_in_count": len(into), "lineage_out_count": len(fed), "entity_name": entity and entity["entity"], "role": role["role"], "deprecation_signal": deprecated}
        return {"table": name, "summary": {k: v for k, v in short.items() if v is not None}, "staleness_warning": w.warning()}
    pretty = role["role"].replace("_", " ").title()
    pattern = (group or {}).get("schema_pattern")
    out: dict = {
        "table": name, "connection_name": w.name, "table_type": row["table_type"], "description": description, "row_count": row["row_count"], "entity_name": entity and entity["entity"], "entity_description": entity and entity["description"], "role": role,
        "cluster": group, "columns": cols, "relationships": rels, "joins": _rows(w.edges.where(F.col("src_table") == name).orderBy("kind", "dst_table", "src_column")), "deprecation_signal": deprecated, "staleness_warning": w.warning(), "detail": detail,
        "classification_summary": f"This is a {pretty} table (confidence: {role['confidence']:.2f})" + (f" in a {pattern.title()} cluster." if pattern else "."),
    }
    more = {
        "lineage_in": into, "lineage_out": fed, "lineage_markdown": lineage_page(into, fed), "aliases": aliases_of(w, name), "shadow_of": base_of(w, name), "tags": node.get("tags"), "has_external_consumers": node.get("has_external_consumers") or None,
        "test_count": node.get("test_count"), "staleness_status": node.get("staleness_status"), "staleness_as_of": node.get("staleness_as_of"),
        "usage_stats": {k: row[k] for k in ("seq_scan_count", "idx_scan_count", "insert_count", "update_count", "delete_count") if row[k] is not None},
        "partition": {"is_partitioned": bool(row["is_partitioned"]), "partition_key": row["partition_key"]} if row["is_partitioned"] or row["partition_key"] else None,
        "grants": json.loads(row["grants"]) if row["grants"] else None,
        "access_patterns": {k: row[k] for k in ("access_read_count", "access_write_count", "days_since_last_access", "potentially_unused", "table_bytes", "clustering_key") if row[k] is not None},
    }
    out |= {k: v for k, v in more.items() if v}
    if detail == "full":
        out["classification_signals"] = role["signals"]
        if w.source is not None and hasattr(w.source, "read"):
            out["profile"] = _rows(profile.column_profile(w.source.read(name)))
    return out


def _stored_paths(w: Workspace, a: str, b: str, kinds: tuple[str, ...], max_depth: int, max_inferred: int) -> list[dict]:
    """Stored paths within the limits, whose inferred steps stay among what may be seen."""
    if w.frames is None or "JoinPath" not in w.frames:
        return []
    seen = [r[0] for r in w.tables.select(graph.node_of(w.name, "table_name")).collect()]
    x = w.frames["JoinPath"].where((F.col("from_table") == a) & (F.col("to_table") == b) & (F.col("depth") <= max_depth))
    x = x.where(F.forall("steps", lambda s: s["kind"].isin(*kinds)) & (F.size(F.filter("steps", lambda s: s["kind"] == "inferred")) <= max_inferred))
    x = x.where(paths.visible_steps(F.col("steps"), F.array(*[F.lit(s) for s in seen]) if seen else F.array().cast("array<string>")))
    low = F.array_min(F.transform("steps", lambda s: s["conf"]))
    return _rows(x.orderBy("rank").select("rank", "depth", "cost", "confidence", low.alias("min_confidence"), F.col("ambiguous").alias("tied"), "label", "sql_hint", "stale", "steps"))


def _searched(w: Workspace, a: str, b: str, top_k: int, max_depth: int, max_inferred: int, kinds: tuple[str, ...]) -> list[dict]:
    every = paths.enumerate_paths(w.edges, max_depth, max_inferred, kinds, a, b)
    best = paths.ranked(every, top_k).orderBy("rank")
    return _rows(best.select("rank", "depth", "cost", "confidence", "min_confidence", "path", "tied", "several", paths.label(F.col("from_table"), F.col("to_table"), F.col("depth")).alias("label"), paths.sql_hint(F.col("steps")).alias("sql_hint"), F.lit(False).alias("stale"), "steps"))


def traverse(w: Workspace, from_table: str, to_table: str, top_k: int = 3, max_depth: int = paths.MAX_DEPTH, max_inferred: int = paths.MAX_INFERRED, kinds: tuple[str, ...] = ("fk", "inferred"), other: Workspace | None = None, links: DataFrame | None = None) -> dict:
    """Join paths. Stored ones first; a chain of declared keys goes before stored paths with
    guesses; of tied ones all are told; and what is not stored is searched. With another
    workspace, paths cross to it over confirmed links."""
    if other is not None:
        return _across(w, other, links, from_table, to_table, max_depth)
    a, error = w.resolve(from_table)
    b, error = (None, error) if error else w.resolve(to_table)
    if error:
        return error
    top_k, max_depth, max_inferred = min(max(top_k, 1), 10), min(max(max_depth, 1), 8), min(max(max_inferred, 0), 8)
    found, stored = _stored_paths(w, a, b, kinds, max_depth, max_inferred), True
    if found and any(p["tied"] for p in found):
        tied = _searched(w, a, b, top_k, max_depth, max_inferred, kinds)
        found, stored = (tied, False) if len(tied) > 1 else (found, True)
    if found and "fk" in kinds and all(any(s["kind"] == "inferred" for s in p["steps"]) for p in found):
        chain = _searched(w, a, b, 1, max_depth, 0, ("fk",))
        if chain:
            found, stored = [chain[0] | {"label": chain[0]["label"] + ", declared keys"}, *found], False
    if not found:
        found, stored = _searched(w, a, b, top_k, max_depth, max_inferred, kinds), False
    if not found:
        return {"error": f"no path from {a} to {b} within {max_depth} joins"}
    return {"from": a, "to": b, "database": w.name, "paths": found[:top_k], "used_precomputed": stored, "staleness_warning": w.warning()}


def _across(w: Workspace, other: Workspace, links: DataFrame | None, from_table: str, to_table: str, max_depth: int) -> dict:
    a, error = w.resolve(from_table)
    b, error = (None, error) if error else other.resolve(to_table)
    if error:
        return error
    if links is None:
        return {"error": "no links between the databases"}
    every = w.graph()["REPRESENTS"].unionByName(other.graph()["REPRESENTS"])
    side = lambda x: x.tables.select(graph.node_of(x.name, "table_name").alias("id"), "table_name", F.lit(x.name).alias("db"))
    names = side(w).unionByName(side(other))
    two = entities.bridges(links, every)
    end = lambda c: names.select(F.col("id").alias(c), F.col("table_name").alias(f"{c}_name"), F.col("db").alias(f"{c}_db"))
    two = two.join(end("a_table"), "a_table").join(end("b_table"), "b_table").where("a_table_db <> b_table_db")
    here = F.when(F.col("a_table_db") == w.name, F.col("a_table_name")).otherwise(F.col("b_table_name"))
    there = F.when(F.col("a_table_db") == w.name, F.col("b_table_name")).otherwise(F.col("a_table_name"))
    two = two.select(here.alias("a_table"), there.alias("b_table"), "score").distinct()

    def reach_of(x: Workspace, start: str | None, goal: str | None, stay: str) -> DataFrame:
        # a path of no step stays at the table itself
        none = x.spark.createDataFrame([(stay, stay, 1.0, 0)], "from_table string, to_table string, min_confidence double, depth int")
        got = paths.ranked(paths.enumerate_paths(x.edges, max_depth, start=start, goal=goal), 1).select("from_table", "to_table", F.col("min_confidence").cast("double").alias("min_confidence"), "depth")
        return none.unionByName(got)

    x = paths.across(reach_of(w, a, None, a), two, reach_of(other, None, b, b))
    found = _rows(x.where((F.col("from_table") == a) & (F.col("to_table") == b)).orderBy(F.desc("confidence"), "depth", "via").limit(3))
    return {"from": a, "to": b, "database": w.name, "to_database": other.name, "paths": found} if found else {"error": f"no path from {w.name}.{a} to {other.name}.{b} over confirmed links"}


def impact(w: Workspace, table: str, column: str | None = None, max_depth: int = 3) -> dict:
    name, error = w.resolve(table)
    if error:
        return error
    rows = _rows(reach.impact(w.edges, name, column, max_depth).orderBy("hop", "table_name"))
    buckets = {b: [r for r in rows if r["bucket"] == b] for b in ("direct", "two_hop", "three_hop", "low_confidence")}
    return {"target": {"table": name, "column": column}, "impact": buckets, "total_affected": len(rows), "metrics": w.layer.affected(name, column)}


def detect_changes(w: Workspace, before: Workspace) -> dict:
    """What differs between two states of a connection, and what that touches. Tables that
    either profile hides are not told."""
    changes = checkpointed(drift.diff(before.everything, w.everything))
    seen = before.tables.select("table_name").unionByName(w.tables.select("table_name")).distinct()
    changes = changes.join(seen, "table_name", "left_semi")
    ends = F.split("details", " -> ")
    line = changes.where("target = 'lineage'").withColumn("s", ends[0]).join(seen.withColumnRenamed("table_name", "s"), "s", "left_anti").select("table_name", "details")
    changes = changes.join(line.withColumn("target", F.lit("lineage")), ["target", "table_name", "details"], "left_anti")
    stale = drift.affected_paths(paths.enumerate_paths(before.edges, 3), changes.select("table_name"))
    labels = []
    g = before.graph()
    if "Cluster" in g:
        members = g["IN_CLUSTER"].join(g["SchemaTable"].select(F.col("node_id").alias("src"), "table_name"), "src").select(F.col("dst").alias("cluster"), "table_name")
        labels = [r.label for r in drift.affected_clusters(members, g["Cluster"].withColumnRenamed("node_id", "cluster"), changes).orderBy("label").collect()]
    told = _rows(changes.select("target", "change_type", "table_name", "column_name", "details").orderBy("target", "table_name", "column_name", "details"))
    broken = sorted({m for c in told if c["change_type"] != "added" for m in w.layer.affected(c["table_name"], c["column_name"])})
    return {"changes": told, "summary": drift.summary(changes), "stale_paths": stale.count(), "affected_clusters": labels, "broken_metrics": broken, "staleness_warning": before.warning()}


def compile_metric(w: Workspace, metric: str) -> dict:
    joins = {(r[0], r[1]) for r in w.edges.select("src_table", "dst_table").distinct().collect()}
    try:
        got = semantic.compiled(w.spark, w.layer, metric, w.names(), joins)
    except (KeyError, ValueError) as e:
        return {"error": str(e.args[0])}
    return {"metric": metric, "entity": got.entity, "sql": got.sql, "dialect": got.dialect, "warnings": list(got.warnings), "validation": validate_sql(w, got.sql)}


def validate_sql(w: Workspace, sql: str) -> dict:
    cols: dict[str, list[str]] = {}
    for r in w.columns.where("parent IS NULL").select("table_name", "column_name").collect():
        cols.setdefault(r[0], []).append(r[1])
    joins = {(r[0], r[1]) for r in w.edges.select("src_table", "dst_table").distinct().collect()}
    return sql_walk.validate(w.spark, sql, cols, joins).__dict__


def run_cypher(w: Workspace, text: str, parameters: dict | None = None, limit: int = 1000, timeout: float = 5.0) -> dict:
    """Cancelled after timeout seconds (120 at most). `truncated` tells whether there were more
    than limit rows. Identifiers of hidden tables never come out, however they got in."""
    sc, group = w.spark.sparkContext, f"cypher-{id(text)}"
    sc.setJobGroup(group, "graph query", interruptOnCancel=True)
    late = threading.Event()
    timer = threading.Timer(min(timeout, 120.0), lambda: (late.set(), sc.cancelJobGroup(group)))
    timer.start()
    try:
        got = cypher.query(w.graph(), text, parameters)
        hidden = w.everything.tables.join(w.tables.select("table_name"), "table_name", "left_anti")
        ids = hidden.select(graph.node_of(w.name, "table_name").alias("node_id")).unionByName(hidden.select(F.concat_ws(".", _schema(F.col("table_name")), _bare(F.col("table_name"))).alias("node_id")))
        rows = _rows(redact(got, ids, [c for c in got.columns if c in ("node_id", "src", "dst")]).limit(limit + 1))
        return {"rows": rows[:limit], "truncated": len(rows) > limit}
    except Exception as e:  # the answer to a client is always a document
        if late.is_set():
            return {"error": f"the query took more than {min(timeout, 120.0):g} seconds"}
        said = str(e).splitlines()[0][:300]
        unknown = [n for n in graph.NODES + graph.EDGES if n.lower() in said.lower()]
        return {"error": said} | ({"suggestions": unknown} if unknown else {})
    finally:
        timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)


TOOLS: dict[str, Callable[..., dict]] = {
    "list_databases": list_databases, "schema": schema, "query": query, "context": context, "traverse": traverse, "impact": impact,
    "detect_changes": detect_changes, "compile_metric": compile_metric, "validate_sql": validate_sql, "cypher": run_cypher,
}


def register_tool(name: str, tool: Callable[..., dict]) -> None:
    if name in TOOLS:
        raise ValueError(f"tool {name!r} is registered already")
    TOOLS[name] = tool


def call(w: Workspace, tool: str, **arguments) -> dict:
    if tool not in TOOLS:
        return {"error": f"unknown tool {tool!r}", "suggestions": difflib.get_close_matches(tool, TOOLS, 3, 0.4)}
    try:
        return TOOLS[tool](w, **arguments)
    except TypeError as e:
        return {"error": str(e)}


# ---- pages of markdown --------------------------------------------------------------------


def top_joins(w: Workspace, most: int = 12) -> DataFrame:
    """Eight declared and eight inferred joins at most, `most` together, in a fixed order."""
    order = Window.partitionBy("kind").orderBy(F.desc("confidence"), "src_table", "src_column", "dst_table")
    x = w.edges.withColumn("r", F.row_number().over(order)).where("r <= 8")
    return x.orderBy("kind", "r").limit(most)


def overview(w: Workspace) -> str:
    """Tables by role, joins, clusters, entities, metrics."""
    n = list_databases(w)["databases"][0]
    lines = [f"# {w.name}", "", f"{n['tables']} tables, {n['columns']} columns, {n['rows']} rows; {n['declared_joins']} declared and {n['inferred_joins']} inferred joins.", "", "| Table | Rows | Role |", "|---|---|---|"]
    for r in w.tables.join(w.roles(), "table_name").orderBy("table_name").collect():
        lines.append(f"| {r.table_name} | {r.row_count} | {r.role} |")
    lines += ["", "## Joins", ""]
    lines += [f"- {r.src_table}.{r.src_column} = {r.dst_table}.{r.dst_column} ({r.kind}, {r.confidence:g})" for r in top_joins(w).collect()]
    g = w.graph()
    lines += ["", "## Clusters", ""]
    if "Cluster" in g:
        lines += [f"- {r.label} ({r.schema_pattern})" for r in g["Cluster"].orderBy("label").collect()]
    else:
        members = cluster.communities(w.tables.select(F.lit(w.name).alias("database"), "table_name"), cluster.weighted_pairs(w.edges).withColumn("database", F.lit(w.name)))
        lines += [f"- {r.cluster}: {r.t}" for r in members.groupBy("cluster").agg(F.array_join(F.array_sort(F.collect_list("table_name")), ", ").alias("t")).orderBy("cluster").collect()]
    if "Entity" in g:
        lines += ["", "## Entities", "", *[f"- {r['name']}: {r.table_name}" for r in entities.primary_tables(g["Entity"], g["REPRESENTS"], g["SchemaTable"]).orderBy("name").collect()]]
    return "\n".join([*lines, "", metrics_page(w)])


def clusters_page(w: Workspace) -> str:
    """Each cluster with its tables."""
    g, lines = w.graph(), [f"# Clusters of {w.name}", ""]
    if "Cluster" in g:
        names = g["IN_CLUSTER"].join(g["SchemaTable"].select(F.col("node_id").alias("src"), "table_name"), "src").groupBy(F.col("dst").alias("node_id")).agg(F.array_sort(F.collect_set("table_name")).alias("t"))
        for r in g["Cluster"].join(names, "node_id").orderBy(F.desc(F.size("t")), "label").collect():
            lines += [f"## {r.label}", "", f"{r.description}. Cohesion {r.cohesion_score:g}, pattern {r.schema_pattern}{', stale' if r.stale else ''}.", "", *[f"- {t}" for t in r.t], ""]
    return "\n".join(lines)


def databases_page(state: lifecycle.State) -> str:
    lines = ["# Databases", "", "| Connection | Database | Dialect | Tables | Indexed |", "|---|---|---|---|---|"]
    return "\n".join([*lines, *[f"| {k} | {e.get('database') or ''} | {e.get('dialect') or ''} | {e.get('tables', '')} | {e.get('indexed_at', '')} |" for k, e in state.registry().list()], ""])


def metrics_page(w: Workspace) -> str:
    lines = ["## Metrics", ""]
    for e in w.layer.entities:
        lines += [f"- {m.name} ({m.kind} of {e.name}){': ' + m.description if m.description else ''}" for m in e.metrics]
    return "\n".join([*lines, ""])


def cross_database_page(state: lifecycle.State, k: int = 10) -> str:
    """Links between entities by status, and the best confirmed ones."""
    rows, every = lifecycle.links(state), None
    for name, e in state.registry().list():
        g = state.store(name).read(e["version"])
        if "Entity" in g:
            one = g["Entity"].select("node_id", "name", "connection_name")
            every = one if every is None else every.unionByName(one)
    lines = ["# Entities across databases", ""]
    if every is not None:
        lines += [f"- {r.status}: {r.n}" for r in entities.count_links(rows).orderBy("status").collect()]
        lines += ["", *[f"- {r.src_connection}.{r.src_name} = {r.dst_connection}.{r.dst_name} ({r.score:g})" for r in entities.top_links(rows, every, k).collect()]]
    return "\n".join([*lines, ""])


def skill_page(w: Workspace) -> str:
    """What a client should know before it asks: counts, entities, the joins that matter."""
    lines = [f"# How to ask about {w.name}", "", "Ask `query` for tables by words, `context` for one table, `traverse` for the way between two, `impact` before a change, `validate_sql` before running a text.", ""]
    return "\n".join([*lines, overview(w)])


def to_json(document: dict) -> str:
    return json.dumps(document, default=str, sort_keys=True)


def node_id(w: Workspace, table: str) -> str:
    return w.spark.range(1).select(S.table_id(F.lit(w.name), F.lit("main"), F.lit(table))).first()[0]

