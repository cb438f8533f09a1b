"""The metadata graph as frames: labels and edges, upserts, deletes, cascades, a store.

A frame is never changed in place; operations return the new frame, and GraphStore writes
versions beside each other so that readers of the old one are not disturbed.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.operators.reach import checkpointed
from quarry.sources import files

#: the description of clusters that nobody has described
HEURISTIC = "Tables that join each other"
# The labels of nodes and edges.
NODES = ("SchemaTable", "SchemaColumn", "Entity", "Cluster", "JoinPath", "MetricTemplate", "Metric", "Dimension", "BusinessRule")
EDGES = ("HAS_COLUMN", "HAS_SUBCOLUMN", "REPRESENTS", "FK_REFERENCES", "INFERRED_JOIN", "LINEAGE", "SAME_ENTITY", "IN_CLUSTER", "METRIC_DEPENDS", "METRIC_DEPENDS_ON", "DIMENSION_LEVEL", "RULE_APPLIES_TO")


def latest(frame: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    return frame.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_r = 1").drop("_r")


def upsert(old: DataFrame, new: DataFrame, key: str, keep_if_null: tuple[str, ...] = ()) -> DataFrame:
    """Rows of new replace those of old with the same key; where a field of keep_if_null is
    null in new, the old value stays."""
    o, n = old.alias("o"), new.withColumn("_new", F.lit(True)).alias("n")
    x = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    fresh = F.coalesce("n._new", F.lit(False))
    cols = []
    for c in old.columns:
        if c not in new.columns:
            cols.append(F.col(f"o.{c}").alias(c))
        elif c in keep_if_null:
            cols.append(F.when(fresh, F.coalesce(f"n.{c}", f"o.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        else:
            cols.append(F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return x.select(*cols)


def _touches(c: str, node: str):
    """Whether a node id is the node or lies below it."""
    return (F.col(c) == node) | F.startswith(F.col(c), F.lit(node + "::"))


def _without_edges(graph: dict[str, DataFrame], node: str) -> dict[str, DataFrame]:
    out = dict(graph)
    for e in EDGES:
        if e in out:
            out[e] = out[e].where(~_touches("src", node) & ~_touches("dst", node))
    return out


def delete_table(graph: dict[str, DataFrame], table_id: str) -> dict[str, DataFrame]:
    """The graph without a table, its columns, its edges and the paths that touch it."""
    out = _without_edges(graph, table_id)
    if "SchemaTable" in out:
        out["SchemaTable"] = out["SchemaTable"].where(F.col("node_id") != table_id)
    if "SchemaColumn" in out:
        out["SchemaColumn"] = out["SchemaColumn"].where(~F.startswith(F.col("node_id"), F.lit(table_id + "::")))
    return delete_paths(out, table_id)


def delete_paths(graph: dict[str, DataFrame], table_id: str) -> dict[str, DataFrame]:
    """The graph without the stored paths that begin, end or pass at a table."""
    if "JoinPath" not in graph:
        return dict(graph)
    return graph | {"JoinPath": graph["JoinPath"].where(~F.array_contains("tables", table_id))}


def delete_column(graph: dict[str, DataFrame], column_id: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """(the graph without a column, the keys and inferred joins over it, and the paths that
    use those; counts by label)."""
    table_id, _, column = column_id.rpartition("::")
    out, counts = _without_edges(graph, column_id), []
    if "SchemaColumn" in out:
        out["SchemaColumn"] = out["SchemaColumn"].where(~_touches("node_id", column_id))
    for label in ("FK_REFERENCES", "INFERRED_JOIN"):
        if label in out:
            over = ((F.col("src") == table_id) & F.array_contains(F.split("source_column", ","), column)) | ((F.col("dst") == table_id) & F.array_contains(F.split("target_column", ","), column))
            counts.append(out[label].where(over).agg(F.count(F.lit(1)).alias("n")).select(F.lit(label).alias("label"), "n"))
            out[label] = out[label].where(~over)
    if "JoinPath" in out:
        uses = F.exists("steps", lambda x: ((x["a"] == table_id) & F.array_contains(F.split(x["ac"], ","), column)) | ((x["b"] == table_id) & F.array_contains(F.split(x["bc"], ","), column)))
        counts.append(out["JoinPath"].where(uses).agg(F.count(F.lit(1)).alias("n")).select(F.lit("JoinPath").alias("label"), "n"))
        out["JoinPath"] = out["JoinPath"].where(~uses)
    total = None
    for c in counts:
        total = c if total is None else total.unionByName(c)
    return out, total


def delete_foreign_key(graph: dict[str, DataFrame], edge_id: str) -> dict[str, DataFrame]:
    return graph | {"FK_REFERENCES": graph["FK_REFERENCES"].where(F.col("edge_id") != edge_id)}


def mark_stale(paths: DataFrame, changed: DataFrame) -> DataFrame:
    """JoinPath rows (node_id, tables array) that pass a changed table (node_id) are stale."""
    hit = paths.select("node_id", F.explode("tables").alias("t")).join(changed.select(F.col("node_id").alias("t")).distinct(), "t", "left_semi").select("node_id").distinct().withColumn("_hit", F.lit(True))
    return paths.join(hit, "node_id", "left").withColumn("stale", F.coalesce("stale", F.lit(False)) | F.coalesce("_hit", F.lit(False))).select(*paths.columns)


def remove_from_clusters(graph: dict[str, DataFrame], changed: DataFrame) -> dict[str, DataFrame]:
    """Changed tables (node_id) leave their clusters, which become stale."""
    if "IN_CLUSTER" not in graph:
        return dict(graph)
    ids = changed.select(F.col("node_id").alias("src")).distinct()
    member, cluster = graph["IN_CLUSTER"], graph["Cluster"]
    hit = member.join(ids, "src", "left_semi").select(F.col("dst").alias("node_id")).distinct().withColumn("_hit", F.lit(True))
    stale = cluster.join(hit, "node_id", "left").withColumn("stale", F.coalesce("stale", F.lit(False)) | F.coalesce("_hit", F.lit(False))).select(*cluster.columns)
    return graph | {"IN_CLUSTER": member.join(ids, "src", "left_anti").select(*member.columns), "Cluster": stale}


def clear_connection(graph: dict[str, DataFrame], connection: str) -> dict[str, DataFrame]:
    """The graph without one connection's nodes and their edges."""
    out = {k: v.where((F.col("connection_name") != connection) | F.col("connection_name").isNull()) if k in NODES and "connection_name" in v.columns else v for k, v in graph.items()}
    gone = None
    for k, v in graph.items():
        if k in NODES and "connection_name" in v.columns:
            ids = v.where(F.col("connection_name") == connection).select("node_id")
            gone = ids if gone is None else gone.unionByName(ids)
    if gone is not None:
        for e in EDGES:
            for end in ("src", "dst"):
                if e in out:
                    out[e] = out[e].join(gone.select(F.col("node_id").alias(end)).distinct(), end, "left_anti").select(*graph[e].columns)
    return out


#: What discovery and the steps add to a graph, and the fields that they fill.
DERIVED = ("INFERRED_JOIN", "Cluster", "IN_CLUSTER", "JoinPath", "MetricTemplate", "METRIC_DEPENDS", "Entity", "REPRESENTS")
DERIVED_FIELDS = ("role", "role_confidence", "signals", "entity_type")


def clear_intelligence(graph: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The graph without anything derived: no inferred joins, clusters, paths, templates,
    entities or roles."""
    out = {k: v.limit(0) if k in DERIVED else v for k, v in graph.items()}
    if "SchemaTable" in out:
        t = out["SchemaTable"]
        out["SchemaTable"] = t.withColumns({c: F.lit(None).cast(t.schema[c].dataType) for c in DERIVED_FIELDS if c in t.columns})
    return out


def clear_lineage(graph: dict[str, DataFrame], connection: str, kinds: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Without the lineage of a connection's tables (of some kinds only, if any are named)."""
    if "LINEAGE" not in graph:
        return dict(graph)
    own = F.startswith(F.col("dst"), F.lit(connection + "::"))
    if kinds:
        own = own & F.col("lineage_type").isin(*kinds)
    return graph | {"LINEAGE": graph["LINEAGE"].where(~own)}


def columns_of(graph: dict[str, DataFrame], table_id: str) -> DataFrame:
    has = graph["HAS_COLUMN"].where(F.col("src") == table_id).select(F.col("dst").alias("node_id"))
    return graph["SchemaColumn"].join(has, "node_id", "left_semi").orderBy("ordinal", "column_name")


def shown_name(nodes: DataFrame) -> DataFrame:
    """nodes with `qualified`: schema.table of the node, or the id where it has none."""
    return nodes.withColumn("qualified", F.coalesce(F.when(F.col("table_name").contains("."), F.col("table_name")), F.concat_ws(".", F.col("schema_name"), F.col("table_name")), F.col("node_id")))


def cluster_nodes(connection: str, clusters: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """clusters(cluster, label, description, cohesion, pattern, n_tables) and members(cluster,
    table_name) as Cluster nodes and IN_CLUSTER edges (src, dst)."""
    node = F.concat_ws("::", F.lit(connection), F.lit("cluster"), F.col("cluster").cast("string"))
    nodes = clusters.select(node.alias("node_id"), F.lit(connection).alias("connection_name"), "label", "description", F.col("cohesion").alias("cohesion_score"), F.col("pattern").alias("schema_pattern"), F.col("n_tables").alias("table_count"), F.lit(False).alias("stale"))
    return nodes, members.select(node_of(connection, "table_name").alias("src"), node.alias("dst"))


def node_of(connection: str, table: str):
    """The id of a table by its name (schema.table, or a bare name of the main schema)."""
    t = F.col(table)
    return F.concat_ws("::", F.lit(connection), F.when(t.contains("."), F.substring_index(t, ".", 1)).otherwise(F.lit("main")), F.when(t.contains("."), F.expr(f"substring({table}, instr({table}, '.') + 1)")).otherwise(t))


def best_cluster(graph: dict[str, DataFrame]) -> DataFrame:
    """table (node_id), cluster fields: of a table's clusters one with a description of its
    own before others, then the most cohesive."""
    x = graph["IN_CLUSTER"].select(F.col("src").alias("table"), F.col("dst").alias("node_id")).join(graph["Cluster"], "node_id")
    own = F.coalesce(F.col("description") != HEURISTIC, F.lit(False)).cast("int")
    order = Window.partitionBy("table").orderBy(own.desc(), F.desc("cohesion_score"), "node_id")
    return x.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def node_visible(ids: DataFrame, allowed: DataFrame) -> DataFrame:
    """ids(node_id) of tables (three parts) that are among allowed(node_id)."""
    return ids.where(F.size(F.split("node_id", "::")) == 3).join(allowed.select("node_id"), "node_id", "left_semi")


def connected_only(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    ids = nodes.select("node_id").distinct()
    return edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi").select(*edges.columns)


def build(connection: str, tables: DataFrame, columns: DataFrame, foreign_keys: DataFrame, lineage: DataFrame | None = None, inferred: DataFrame | None = None) -> dict[str, DataFrame]:
    """tables(table_name, ...), columns(table_name, column_name, ordinal, parent, ...), keys,
    lineage(src_table, dst_table, confidence) and inferred joins as nodes and edges. A nested
    column hangs on its parent. Keys with an unknown end are left out, of a repeated edge_id
    the last constraint stays; of repeated lineage the most confident."""
    tid = lambda c: node_of(connection, c)
    cid = lambda t, c: F.concat_ws("::", tid(t), F.col(c))
    nodes = tables.select(tid("table_name").alias("node_id"), F.lit(connection).alias("connection_name"), *tables.columns).dropDuplicates(["node_id"])
    cols = columns.select(cid("table_name", "column_name").alias("node_id"), F.lit(connection).alias("connection_name"), *columns.columns)
    parent = F.col("parent") if "parent" in columns.columns else F.lit(None).cast("string")
    has = columns.where(parent.isNull()).select(tid("table_name").alias("src"), cid("table_name", "column_name").alias("dst"), "ordinal")
    name = lambda t, c: F.concat(F.when(F.col(t).contains("."), F.col(t)).otherwise(F.concat(F.lit("main."), F.col(t))), F.lit("."), F.col(c))
    constraint = F.col("constraint_name") if "constraint_name" in foreign_keys.columns else F.lit(None).cast("string")
    fks = foreign_keys.select(F.concat(name("src_table", "src_column"), F.lit("->"), name("dst_table", "dst_column")).alias("edge_id"), tid("src_table").alias("src"), tid("dst_table").alias("dst"), F.col("src_column").alias("source_column"), F.col("dst_column").alias("target_column"), constraint.alias("constraint_name"))
    out = {"SchemaTable": nodes, "SchemaColumn": cols, "HAS_COLUMN": has, "FK_REFERENCES": connected_only(latest(fks, "edge_id", "constraint_name"), nodes)}
    if "parent" in columns.columns:
        out["HAS_SUBCOLUMN"] = connected_only(columns.where(parent.isNotNull()).select(cid("table_name", "parent").alias("src"), cid("table_name", "column_name").alias("dst"), "ordinal"), cols)
    if lineage is not None:
        kind = F.col("lineage_type") if "lineage_type" in lineage.columns else F.lit("VIEW")
        edge = F.concat_ws("::", F.lit(connection), F.left(F.sha2(F.concat_ws("\0", "src_table", "dst_table", "lineage_type"), 256), F.lit(16)))
        best = lineage.withColumn("lineage_type", kind).groupBy("src_table", "dst_table", "lineage_type").agg(F.max("confidence").alias("confidence"))
        out["LINEAGE"] = connected_only(best.select(edge.alias("edge_id"), tid("src_table").alias("src"), tid("dst_table").alias("dst"), "lineage_type", "confidence"), nodes)
    if inferred is not None:
        out["INFERRED_JOIN"] = connected_only(inferred_edges(connection, inferred), nodes)
    return out


def inferred_edges(connection: str, inferred: DataFrame) -> DataFrame:
    """INFERRED_JOIN rows, one for each edge_id (a second run replaces the first's)."""
    edge = F.concat_ws("|", "src_table", "src_column", "dst_table", "dst_column")
    why = F.col("reasoning") if "reasoning" in inferred.columns else F.lit(None).cast("string")
    x = inferred.select(edge.alias("edge_id"), node_of(connection, "src_table").alias("src"), node_of(connection, "dst_table").alias("dst"), F.col("src_column").alias("source_column"), F.col("dst_column").alias("target_column"), F.col("kind").alias("source"), "confidence", why.alias("reasoning"))
    return latest(x, "edge_id", "confidence")


def export(graph: dict[str, DataFrame], connection: str, database: str | None = None) -> DataFrame:
    """kind, label, id, json: nodes of one connection (by connection, else database, else
    database key, whichever a label has) and the edges among them, in order."""
    parts, ids = [], None
    for label in NODES:
        if label in graph:
            df = graph[label]
            scope = {"connection_name": connection, "database": database, "database_key": database}
            by = next((c for c in scope if c in df.columns and scope[c] is not None), None)
            df = df.where(F.col(by) == scope[by]) if by else df
            parts.append(df.select(F.lit("node").alias("kind"), F.lit(label).alias("label"), F.col("node_id").alias("id"), F.to_json(F.struct(*df.columns)).alias("json")))
            ids = df.select("node_id") if ids is None else ids.unionByName(df.select("node_id"))
    for label in EDGES:
        if label in graph and ids is not None:
            df = connected_only(graph[label], ids)
            parts.append(df.select(F.lit("edge").alias("kind"), F.lit(label).alias("label"), F.concat("src", F.lit("->"), "dst").alias("id"), F.to_json(F.struct(*df.columns)).alias("json")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy(F.desc("kind"), "label", "id", "json")


#: changes on top of a whole frame after which the next write is whole again
MOST_DELTAS = 8


def key_of(frame: DataFrame) -> list[str]:
    """The columns that tell the rows of a label apart."""
    return ["node_id"] if "node_id" in frame.columns else ["edge_id"] if "edge_id" in frame.columns else ["src", "dst"]


class GraphStore:
    """Frames by label under a folder (any store that Spark reads), a new version each time.
    A version is there once its mark is written, so readers never see half of one. The mark
    names the parts of each label: a whole frame, and changes (rows by key, or that a key is
    gone) of later versions on top of it, the last of which counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.open: set[str] = set()

    def versions(self) -> list[int]:
        found = (n.removeprefix("v=") for n in files.names(self.spark, self.path) if n.startswith("v="))
        return sorted(int(n) for n in found if n.isdigit() and files.exists(self.spark, f"{self.path}/v={n}/_DONE"))

    def parts(self, version: int) -> dict[str, list[str]]:
        """The parts of each label of a version, the whole frame first."""
        told = json.loads(files.read_text(self.spark, f"{self.path}/v={version}/_DONE"))
        return told if isinstance(told, dict) else {x: [f"v={version}/{x}"] for x in told}

    def write(self, graph: dict[str, DataFrame], version: int | None = None, since: int | None = None) -> int:
        """Write a version. With `since`, a label that is there in that version is written as
        what has changed of it, unless that is most of it or there are many changes already."""
        version = max(self.versions(), default=0) + 1 if version is None else version
        before = self.parts(since) if since is not None else {}
        done = {}
        for label, df in graph.items():
            done[label] = self._changes(df, before[label], f"v={version}/{label}.delta") if label in before else None
            if done[label] is None:
                df.write.mode("overwrite").parquet(f"{self.path}/v={version}/{label}")
                done[label] = [f"v={version}/{label}"]
        files.write_text(self.spark, f"{self.path}/v={version}/_DONE", json.dumps(done, sort_keys=True))
        return version

    def _changes(self, new: DataFrame, parts: list[str], at: str) -> list[str] | None:
        """The parts with what differs in new; None if new should be written whole."""
        old = self._merged(parts)
        same = {f.name: f.dataType for f in old.schema.fields} == {f.name: f.dataType for f in new.schema.fields}
        if not same or len(parts) > MOST_DELTAS or any("map<" in t for _, t in old.dtypes):
            return None
        new, key = checkpointed(new.select(*old.columns)), key_of(old)
        if not new.groupBy(*key).count().where("count > 1").isEmpty():
            return None  # rows that no key tells apart
        changed = new.exceptAll(old).withColumn("__gone", F.lit(False))
        gone = old.join(new, key, "left_anti").select(*key).distinct().withColumn("__gone", F.lit(True))
        changed.unionByName(gone, allowMissingColumns=True).write.mode("overwrite").parquet(f"{self.path}/{at}")
        n, whole = self.spark.read.parquet(f"{self.path}/{at}").count(), new.count()
        if 0 < n <= whole / 2:
            return [*parts, at]
        files.delete(self.spark, f"{self.path}/{at}")
        return None if n else parts

    def _merged(self, parts: list[str]) -> DataFrame:
        """A label from its parts: rows of the whole frame whose keys no change names, and of the
        changes the last of each key. Changes are few, so that Spark broadcasts their keys where
        its size limit allows, and the whole frame is not shuffled."""
        whole = self.spark.read.parquet(f"{self.path}/{parts[0]}")
        if len(parts) == 1:
            return whole
        key = key_of(whole)
        deltas = [self.spark.read.parquet(f"{self.path}/{p}").withColumn("__seq", F.lit(i)) for i, p in enumerate(parts[1:])]
        every = reduce(lambda a, b: a.unionByName(b), deltas)
        last = every.groupBy(*key).agg(F.max_by(F.struct(*[c for c in every.columns if c not in key]), "__seq").alias("r")).select(*key, "r.*")
        kept = whole.join(last.select(*key), key, "left_anti").select(*whole.columns)
        return kept.unionByName(last.where("NOT __gone").select(*whole.columns))

    def read(self, version: int | None = None, labels: tuple[str, ...] | None = None) -> dict[str, DataFrame]:
        """Labels of a version (the last one, all of them); each is a view too."""
        if version is None:
            version = max(self.versions(), default=0)
            if not version:
                raise FileNotFoundError(f"no graph at {self.path}")
        parts = self.parts(version)
        out = {x: self._merged(parts[x]) for x in (parts if labels is None else labels)}
        for label, df in out.items():
            df.createOrReplaceTempView(label)
        self.open |= set(out)
        return out

    def keep(self, last: int) -> None:
        """Forget all but the last versions, and delete the parts that none of these has."""
        versions = self.versions()
        gone, kept = versions[: -last or None], versions[-last:] if last else []
        used = {p for v in kept for parts in self.parts(v).values() for p in parts}
        for v in gone:
            files.delete(self.spark, f"{self.path}/v={v}/_DONE")
            for name in files.names(self.spark, f"{self.path}/v={v}"):
                if f"v={v}/{name}" not in used:
                    files.delete(self.spark, f"{self.path}/v={v}/{name}")
            if not files.names(self.spark, f"{self.path}/v={v}"):
                files.delete(self.spark, f"{self.path}/v={v}")

    def close(self) -> None:
        for label in self.open:
            self.spark.catalog.dropTempView(label)
        self.open = set()

    def save_snapshot(self, name: str, frame: DataFrame) -> None:
        frame.write.mode("overwrite").json(f"{self.path}/snapshots/{name}")

    def load_snapshot(self, name: str, schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).json(f"{self.path}/snapshots/{name}")


class Registry:
    """Connections by name, as one JSON document."""

    def __init__(self, text: str = "{}"):
        self.entries: dict[str, dict] = json.loads(text)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Registry:
        return cls(files.read_text(spark, path)) if files.exists(spark, path) else cls()

    def save(self, spark: SparkSession, path: str) -> None:
        files.write_text(spark, path, self.dumps())

    def upsert(self, name: str, **fields) -> None:
        self.entries[name] = self.entries.get(name, {}) | fields

    def update(self, name: str, **fields) -> bool:
        """Change an entry that is there."""
        if name in self.entries:
            self.entries[name] |= fields
        return name in self.entries

    def remove(self, name: str) -> bool:
        return self.entries.pop(name, None) is not None

    def get(self, name: str) -> dict | None:
        """By connection name, else by the database's, if only one has it."""
        if name in self.entries:
            return self.entries[name]
        near = [e for e in self.entries.values() if e.get("database") == name]
        return near[0] if len(near) == 1 else None

    def list(self) -> list[tuple[str, dict]]:
        return sorted(self.entries.items())

    def dumps(self) -> str:
        return json.dumps(self.entries, sort_keys=True)
