"""A connection's life: indexed into a stored graph, refreshed by what changed, read back.

A state folder (in any store that Spark reads) holds registry.json, snapshots/, graphs/,
search/, visibility.yml and semantic/, all written so that a reader never sees half of one.
"""

from __future__ import annotations

from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.config import Config
from quarry.operators import classify, cluster, dbt, discover, drift, entities, graph, overlap, paths, search, semantic
from quarry.operators.profile_store import ProfileStore
from quarry.operators.reach import checkpointed
from quarry.operators.steps import Runner, Step
from quarry.sources import files, snapshot, warehouse
from quarry.sources.reader import no_rows


class State:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def registry(self) -> graph.Registry:
        return graph.Registry.load(self.spark, f"{self.path}/registry.json")

    def save_registry(self, registry: graph.Registry) -> None:
        registry.save(self.spark, f"{self.path}/registry.json")

    def store(self, connection: str) -> graph.GraphStore:
        return graph.GraphStore(self.spark, f"{self.path}/graphs/{connection}")

    def index(self, config: Config | None = None):
        return (config or Config()).search_index(self.spark, f"{self.path}/search")

    def layer(self, connection: str) -> semantic.Layer:
        return semantic.load_layer(self.spark, f"{self.path}/semantic/{connection}.yml")

    def profiles(self, connection: str, config: Config) -> ProfileStore | None:
        """Where the sketches of a connection's files are, if it merges them."""
        return ProfileStore(self.spark, f"{self.path}/profiles/{connection}") if config.graph.merge_profiles else None

    def visibility(self) -> dict:
        at = f"{self.path}/visibility.yml"
        return files.read_yaml(self.spark, at) if files.exists(self.spark, at) else {}

    def snapshot(self, connection: str) -> snapshot.Snapshot:
        entry = self.registry().entries[connection]
        return snapshot.load(self.spark, f"{self.path}/snapshots/{connection}/v={entry['version']}", connection, entry.get("database", ""), entry.get("dialect", ""))


# ---- the steps that make a graph useful -----------------------------------------------


def _ordered_names(columns: DataFrame) -> DataFrame:
    one = F.struct(F.coalesce("ordinal", F.lit(0)).alias("o"), F.col("column_name").alias("c"))
    return columns.groupBy("table_name").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["c"]).alias("columns"))


def classified(tables: DataFrame, columns: DataFrame, keys: DataFrame) -> DataFrame:
    """Roles of all tables from their names, columns, degrees and usage."""
    x = tables.join(_ordered_names(columns), "table_name", "left").withColumn("columns", F.coalesce("columns", F.array().cast("array<string>"))).join(classify.degrees(tables, keys), "table_name")
    use = {"seq_scans": "seq_scan_count", "idx_scans": "idx_scan_count", "inserts": "insert_count", "updates": "update_count"}
    return classify.classify(x.withColumns({k: F.col(v) if v in x.columns else F.lit(None).cast("long") for k, v in use.items()}))


def _classify(c: dict[str, Any]) -> dict:
    c["roles"] = checkpointed(classified(c["tables"], c["columns"], c["keys"]))
    t = c["graph"]["SchemaTable"].drop("role", "role_confidence", "signals")
    c["graph"]["SchemaTable"] = t.join(c["roles"].select("table_name", "role", F.col("confidence").alias("role_confidence"), "signals"), "table_name", "left").select(*t.columns, "role", "role_confidence", "signals")
    return {r.role: r.n for r in c["roles"].groupBy("role").agg(F.count(F.lit(1)).alias("n")).collect()}


def _cluster(c: dict[str, Any]) -> dict:
    pairs = cluster.weighted_pairs(c["edges"])
    known = c["tables"].select("table_name")
    for end in ("a", "b"):
        pairs = pairs.join(known.withColumnRenamed("table_name", end), end, "left_semi")
    c["pairs"] = checkpointed(pairs)
    nodes = known if c.get("aliases") is None else known.join(c["aliases"], "table_name", "left_anti")
    name = F.lit(c["connection"]).alias("database")
    c["members"] = checkpointed(cluster.communities(nodes.select(name, "table_name"), c["pairs"].select(name, "*"), c["config"].graph.least_cluster, c["config"].graph.resolution))
    return {"clusters": c["members"].select("cluster").distinct().count()}


def _label(c: dict[str, Any]) -> dict:
    told = cluster.labels(c["members"], c["pairs"], c["roles"], c["tables"])
    known = cluster.cohesion(c["members"], c["pairs"]).join(classify.schema_patterns(c["members"], c["roles"], c["keys"]), "cluster").join(told, "cluster")
    rows = known.select("cluster", "label", F.lit(graph.HEURISTIC).alias("description"), "cohesion", "pattern", "n_tables")
    rows = checkpointed(rows)
    c["clusters"] = rows
    c["graph"]["Cluster"], c["graph"]["IN_CLUSTER"] = graph.cluster_nodes(c["connection"], rows, c["members"])
    return {}


def stored_paths(connection: str, best: DataFrame) -> DataFrame:
    """JoinPath rows of precomputed best paths, in both directions. Steps name node ids."""
    turned = best.select(F.col("to_table").alias("from_table"), F.col("from_table").alias("to_table"), "rank", "depth", "cost", "confidence", paths.label(F.col("to_table"), F.col("from_table"), F.col("depth")).alias("label"), "ambiguous", paths.reverse_steps(F.col("steps")).alias("steps"))
    # the pairs i < j alone are searched; what comes back is the other direction
    both = best.where("from_table < to_table")
    both = both.select(*turned.columns).unionByName(turned.where("to_table < from_table"))

    def node(t):
        return F.concat_ws("::", F.lit(connection), F.when(t.contains("."), F.substring_index(t, ".", 1)).otherwise(F.lit("main")), F.when(t.contains("."), F.regexp_replace(t, r"^[^.]*\\.", "")).otherwise(t))

    step = F.transform("steps", lambda x: F.struct(node(x["a"]).alias("a"), x["ac"].alias("ac"), node(x["b"]).alias("b"), x["bc"].alias("bc"), x["kind"].alias("kind"), x["conf"].alias("conf")))
    tables = F.concat(F.array(node(F.get("steps", F.lit(0))["a"])), F.transform("steps", lambda x: node(x["b"])))
    return both.select(paths.path_id(F.col("from_table"), F.col("to_table"), F.col("steps")).alias("node_id"), F.lit(connection).alias("connection_name"), "from_table", "to_table", "rank", "depth", "cost", "confidence", "label", "ambiguous", F.lit(False).alias("stale"), paths.sql_hint(F.col("steps")).alias("sql_hint"), tables.alias("tables"), step.alias("steps"))


def _join_paths(c: dict[str, Any]) -> dict:
    best = checkpointed(paths.precompute(c["edges"], c["config"].graph.path_depth))
    c["graph"]["JoinPath"] = stored_paths(c["connection"], best)
    return {}


def default_steps() -> Runner:
    return Runner().add(Step("classify", _classify)).add(Step("cluster", _cluster)).add(Step("label", _label, ("classify", "cluster"))).add(Step("join_paths", _join_paths, ("cluster",)))


# ---- index and reindex ---------------------------------------------------------------


def _now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def _measured(inferred: DataFrame, source) -> DataFrame:
    """Guesses blended with what the values show, where the source's tables can be read."""
    names = sorted({t for r in inferred.select("src_table", "dst_table").distinct().collect() for t in r})  # tables of the catalog
    found = overlap.measure({t: source.read(t) for t in names}, inferred)
    seen = found.where("n_left > 0").select("src_table", "src_column", "dst_table", "dst_column", F.col("containment").alias("overlap"))
    return discover.blend_overlap(inferred, seen)


def _context(snap: snapshot.Snapshot, config: Config, frames: dict[str, DataFrame], source=None) -> dict[str, Any]:
    keys = snap.foreign_keys.select("src_table", "src_column", "dst_table", "dst_column")
    aliases = checkpointed(classify.shadow_aliases(snap.tables, snap.lineage, config.graph.alias_sources)) if config.graph.collapse_aliases else None
    rows = snap.tables.select("table_name", "row_count")
    inferred = checkpointed(discover.discover(discover.signal_defaults(snap.columns.where("parent IS NULL").join(rows, "table_name", "left")), keys, aliases, scorers=config.every_scorer(), combine=config.combine))
    if config.graph.measure_overlaps and hasattr(source, "read"):
        inferred = checkpointed(_measured(inferred, source))
    edges = checkpointed(paths.edges(keys, inferred, aliases))
    return {"connection": snap.connection, "config": config, "graph": frames, "tables": snap.tables, "columns": snap.columns, "keys": keys, "aliases": aliases, "inferred": inferred, "edges": edges}


def index(state: State, source, connection: str, database: str = "", config: Config | None = None, steps: Runner | None = None, manifest: str | None = None, freshness: str | None = None, entity_rows: DataFrame | None = None, profiles: bool = True, address: str = "") -> dict[str, Any]:
    """Introspect a source and store its graph; what the connection had before is replaced."""
    config = config or Config()
    snap = snapshot.inspect(source, connection, database, profiles, state.profiles(connection, config))
    return _store(state, snap, config, steps or default_steps(), manifest, freshness, entity_rows, address, source)


def _store(state: State, snap: snapshot.Snapshot, config: Config, steps: Runner, manifest: str | None, freshness: str | None, entity_rows: DataFrame | None, address: str, source=None) -> dict[str, Any]:
    spark, registry = state.spark, state.registry()
    store = state.store(snap.connection)
    version = max(store.versions(), default=0) + 1
    tables, columns, lineage, told = snap.tables, snap.columns, snap.lineage, None
    if manifest:
        m = dbt.Manifest.load(spark, manifest)
        tables, columns, lineage, told = dbt.run(m, tables, columns, lineage, dbt.read_sources(spark, freshness) if freshness else None)
    at = f"{state.path}/snapshots/{snap.connection}/v={version}"
    snapshot.save(snap, at)  # the questions below read the written rows
    kept = snapshot.load(spark, at, snap.connection, snap.database, snap.dialect)
    if manifest:
        columns, kept.lineage = checkpointed(columns), checkpointed(lineage)
    else:
        columns = kept.columns
    c = _context(kept, config, {}, source)
    c["tables"] = checkpointed(tables) if manifest else kept.tables
    c["graph"] = graph.build(snap.connection, c["tables"], columns, kept.foreign_keys, kept.lineage, c["inferred"])
    summary = {"tables": c["tables"].count(), "columns": columns.count(), "foreign_keys": kept.foreign_keys.count(), "inferred_joins": c["inferred"].count(), "steps": steps.run(c), "notes": list(snap.notes)}
    if told is not None:
        summary["dbt"] = told
    rows = entity_rows if entity_rows is not None else entities.from_roles(c["roles"]) if "roles" in c else None
    if rows is not None:
        nodes, edges = entities.build(snap.connection, rows, c["tables"])
        c["graph"]["Entity"] = nodes
        c["graph"]["REPRESENTS"] = edges.select("src", graph.node_of(snap.connection, "table_name").alias("dst"))
    store.write(c["graph"], version)
    registry.upsert(snap.connection, version=version, database=snap.database, dialect=snap.dialect, indexed_at=_now(), address=address, tables=summary["tables"])
    state.save_registry(registry)
    refresh_search(state, config)
    return summary | {"version": version}


def refresh_search(state: State, config: Config | None = None) -> bool:
    """Build the search index anew if a graph is newer than it."""
    versions = {k: e["version"] for k, e in state.registry().list() if "version" in e}
    found = state.index(config)
    if not versions or not found.needs_rebuild(versions):
        return False
    docs = {}
    for name in versions:
        g = state.store(name).read(versions[name])
        names = g["SchemaTable"].select(F.col("node_id").alias("src"), "table_name")
        clusters = g["IN_CLUSTER"].join(names, "src").join(g["Cluster"].select(F.col("node_id").alias("dst"), "label", "description"), "dst") if "Cluster" in g else None
        ents = g["Entity"].select(F.col("node_id").alias("src"), "name", "description").join(g["REPRESENTS"], "src").join(names.withColumnRenamed("src", "dst"), "dst") if "Entity" in g else None
        docs[name] = search.catalog_documents(g["SchemaTable"], g["SchemaColumn"], clusters, ents)
    found.build(docs, versions)
    return True


def reindex(state: State, source, connection: str, config: Config | None = None, dry_run: bool = False, full: bool = False, steps: Runner | None = None) -> dict[str, Any]:
    """Bring a stored graph up to date: differences to the stored snapshot, the patch, and
    the steps again. With full, everything is indexed anew; a dry run tells what would be."""
    registry, config = state.registry(), config or Config()
    entry = registry.get(connection)
    if entry is None:
        raise KeyError(f"connection {connection!r} is not indexed")
    if full:
        return index(state, source, connection, entry.get("database", ""), config, steps, address=entry.get("address", ""))
    old = state.snapshot(connection)
    new = snapshot.inspect(source, connection, entry.get("database", ""), store=state.profiles(connection, config))
    version = entry["version"] + 1
    at = f"{state.path}/snapshots/{connection}/v={version}"
    snapshot.save(new, at)
    new = snapshot.load(state.spark, at, connection, entry.get("database", ""), entry.get("dialect", ""))
    changes = checkpointed(drift.diff(old, new))
    store = state.store(connection)
    patched, counts = drift.patch_graph(store.read(entry["version"]), new, changes, dry_run)
    out = {"changes": [r.asDict() for r in changes.orderBy("target", "table_name", "column_name").collect()], "summary": drift.summary(changes), "patch": counts, "dry_run": dry_run}
    if dry_run:
        files.delete(state.spark, at)
        return out
    structural = any(counts[k] for k in ("tables_added", "tables_removed", "columns_added", "columns_removed", "columns_updated", "foreign_keys_synced"))
    if structural:  # what is stale is made again
        c = _context(new, config, {k: checkpointed(v) for k, v in patched.items() if k not in ("Cluster", "IN_CLUSTER", "JoinPath")}, source)
        c["graph"]["INFERRED_JOIN"] = graph.connected_only(graph.inferred_edges(connection, c["inferred"]), c["graph"]["SchemaTable"])
        out["steps"] = (steps or default_steps()).run(c)
        patched = c["graph"]
    store.write(patched, version, since=entry["version"])
    registry.upsert(connection, version=version, indexed_at=_now(), tables=new.tables.count())
    state.save_registry(registry)
    refresh_search(state, config)
    return out | {"version": version}


# ---- the rest of a connection's life -------------------------------------------------------


def remove(state: State, connection: str) -> bool:
    registry = state.registry()
    known = registry.remove(connection)
    if known:
        state.save_registry(registry)
        for part in ("graphs", "snapshots"):
            files.delete(state.spark, f"{state.path}/{part}/{connection}")
    return known


def export(state: State, connection: str) -> DataFrame:
    entry = state.registry().get(connection)
    if entry is None:
        raise KeyError(f"connection {connection!r} is not indexed")
    return graph.export(state.store(connection).read(entry["version"]), connection, entry.get("database"))


def sync_grants(state: State, connection: str, roles: set[str] | None = None, dry_run: bool = False) -> dict:
    """The visibility document with a profile per role, of what the source grants it."""
    got = state.snapshot(connection).grants
    name = F.concat(F.lit(f"{connection}::"), F.when(F.col("table_name").contains("."), F.col("table_name")).otherwise(F.concat(F.lit("main."), F.col("table_name"))))
    by_role = {r.grantee: sorted(r.t) for r in got.groupBy("grantee").agg(F.collect_set(name).alias("t")).collect()}
    document = state.visibility()
    document["profiles"] = warehouse.merge_grants(document.get("profiles") or {}, by_role, roles)
    if not dry_run:
        files.write_yaml(state.spark, f"{state.path}/visibility.yml", document)
    return document


def validate(state: State, connection: str) -> list[str]:
    """What is wrong with a stored connection: missing files, edges without ends, a semantic
    layer that names what there is not."""
    entry = state.registry().get(connection)
    if entry is None:
        return [f"connection {connection!r} is not indexed"]
    store = state.store(connection)
    if entry.get("version") not in store.versions():
        return [f"graph version {entry.get('version')} is missing"]
    g, out, ids = store.read(entry["version"]), [], None
    for label in graph.NODES:
        if label in g:
            n = g[label].groupBy("node_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").count()
            out += [f"{label}: {n} ids stand twice"] if n else []
            ids = g[label].select("node_id") if ids is None else ids.unionByName(g[label].select("node_id"))
    for label in graph.EDGES:
        if label in g and ids is not None:
            lost = g[label].count() - graph.connected_only(g[label], ids).count()
            out += [f"{label}: {lost} edges lack an end"] if lost else []
    columns: dict[str, set[str]] = {}
    for r in g["SchemaColumn"].select("table_name", "column_name").collect():  # a catalog's names
        columns.setdefault(r[0], set()).add(r[1])
    return out + state.layer(connection).validate(columns)


def same_entities(state: State, a: str, b: str, least: float = 0.55) -> DataFrame:
    """Suggested links between two connections' entities, by their names and columns."""

    def described(connection: str) -> DataFrame:
        g = state.store(connection).read(state.registry().entries[connection]["version"])
        cols = g["SchemaColumn"].join(g["HAS_COLUMN"].select(F.col("src").alias("t"), F.col("dst").alias("node_id")), "node_id").groupBy("t").agg(F.collect_set("column_name").alias("cs"))
        return g["Entity"].join(g["REPRESENTS"].select(F.col("src").alias("node_id"), F.col("dst").alias("t")), "node_id").join(cols, "t").groupBy("node_id", "name").agg(F.flatten(F.collect_list("cs")).alias("columns"))

    got = entities.similar_pairs(described(a), described(b), least)
    return got.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("suggested").alias("status"), "score", F.lit("names of columns and entities").alias("reasoning"), F.lit(_now()).alias("created_at"), F.lit(None).cast("string").alias("confirmed_at"), F.lit(None).cast("string").alias("confirmed_by"))


LINKS = "edge_id string, src string, dst string, status string, score double, reasoning string, created_at string, confirmed_at string, confirmed_by string"


def links(state: State) -> DataFrame:
    """The stored links between entities of different connections."""
    store = state.store("_links")
    return store.read(None, ("SAME_ENTITY",))["SAME_ENTITY"] if store.versions() else no_rows(state.spark, LINKS)


def save_links(state: State, rows: DataFrame) -> None:
    state.store("_links").write({"SAME_ENTITY": rows})
