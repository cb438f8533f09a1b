"""Queries over the catalog that the supplied tables themselves make, and its stored graph."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import lifecycle, tools
from quarry.functions import scalars as S
from quarry.operators import cluster, cypher, dbt, discover, drift, entities, graph, paths, reach, search
from quarry.queries import _EDGES, _FK, _NAMES, _WALK, COLUMNS, FK_ROWS, _edges, _literal, _values, confirmed_keys, query
from quarry.sources import catalog, postgres, reader, snapshot

_COLS = f"cat AS (SELECT table_name AS t, column_name AS c, column_index::INT AS i, data_type AS typ FROM duckdb_columns() WHERE table_name IN ({_NAMES}))"


def _whole(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The graph of all tables, columns and keys."""
    src = catalog.ParquetSource(spark, sf_dir, catalog.TABLES)
    return graph.build("db", src.tables(), src.columns(), src.foreign_keys(), None, discover.discover(discover.signal_defaults(src.columns()), src.foreign_keys()))


# ---- discovery over the real catalog ------------------------------------------------------

_BORING = ", ".join(f"'{n}'" for n in discover.BORING_NAMES)


@query("WITH " + _FK + ", " + _COLS + f""", sh AS (SELECT t, c, count(*) OVER (PARTITION BY c) AS n FROM cat WHERE lower(c) NOT IN ({_BORING})),
 pr AS (SELECT a.t AS s, b.t AS d, a.c, row_number() OVER (PARTITION BY a.t, b.t ORDER BY 1.0 / a.n DESC, a.c) AS r FROM sh a JOIN sh b ON a.c = b.c AND a.t <> b.t)
 SELECT s AS src_table, c AS src_column, d AS dst_table, c AS dst_column, 0.25::DOUBLE AS confidence FROM pr WHERE r <= 3 AND (s, c, d, c) NOT IN (SELECT (src_table, src_column, dst_table, dst_column) FROM fk)""")  # fmt: skip
def catalog_same_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared column names of all supplied tables, without the declared joins."""
    src = catalog.ParquetSource(spark, sf_dir, catalog.TABLES)
    return discover.without_declared(discover.same_name_candidates(src.columns()), src.foreign_keys()).select("src_table", "src_column", "dst_table", "dst_column", "confidence")


@query("WITH RECURSIVE " + _FK + ", up AS (SELECT src_table AS child, dst_table AS ancestor FROM fk UNION SELECT child, dst_table FROM up JOIN fk ON ancestor = src_table) SELECT * FROM up WHERE child <> ancestor")
def key_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tables that each table leads to over declared keys, however far."""
    return reach.closure(confirmed_keys(spark, sf_dir).select(F.col("src_table").alias("child"), F.col("dst_table").alias("parent")))


@query("SELECT count(*) AS n, max(depth) AS longest, sum(ancestor) AS total FROM (WITH RECURSIVE up AS (SELECT c_custkey AS child, c_custkey // 2 AS ancestor, 1 AS depth FROM customer WHERE c_custkey // 2 > 0 UNION ALL SELECT child, ancestor // 2, depth + 1 FROM up WHERE ancestor // 2 > 0) SELECT * FROM up)")
def role_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memberships as a binary tree over the customers (k belongs to k // 2): every pair that
    the closure finds, and how far the farthest is."""
    c = catalog.read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("child"), F.expr("c_custkey div 2").alias("parent")).where("parent > 0")
    up = reach.closure(c)
    depth = F.floor(F.log2("child") + 1e-12) - F.floor(F.log2("ancestor") + 1e-12)
    return up.agg(F.count(F.lit(1)).alias("n"), F.max(depth).cast("int").alias("longest"), F.sum("ancestor").alias("total"))


# ---- graph queries ---------------------------------------------------------------------


@query("WITH " + _FK + ", " + _COLS + " SELECT t AS name, count(*) AS n FROM cat WHERE t IN (SELECT src_table FROM fk) AND t NOT IN (SELECT dst_table FROM fk) GROUP BY t HAVING count(*) > 3")
def cypher_pattern_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of tables that refer to others and that nothing refers to."""
    text = """MATCH (t:SchemaTable)-[:HAS_COLUMN]->(c:SchemaColumn) WHERE (t)-[:FK_REFERENCES]->(:SchemaTable) AND NOT (:SchemaTable)-[:FK_REFERENCES]->(t)
              WITH t.table_name AS name, count(*) AS n WHERE n > 3 RETURN name, n"""
    return cypher.query(_whole(spark, sf_dir), text)


@query("WITH " + _FK + f", t AS (SELECT unnest([{_NAMES}]) AS t) SELECT t AS name, CASE WHEN count(dst_table) > 1 THEN 'many' WHEN count(dst_table) = 1 THEN 'one' ELSE 'none' END AS refs, coalesce(string_agg(DISTINCT dst_table, ',' ORDER BY dst_table), '') AS targets FROM t LEFT JOIN fk ON src_table = t WHERE t LIKE '%e%' AND t NOT IN ('events', 'pages') GROUP BY t")
def cypher_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = """MATCH (t:SchemaTable) WHERE t.table_name CONTAINS 'e' AND NOT t.table_name IN ['events', 'pages'] OPTIONAL MATCH (t)-[r:FK_REFERENCES]->(u:SchemaTable)
              WITH t.table_name AS name, count(u.table_name) AS n, collect(DISTINCT u.table_name) AS found RETURN name, CASE WHEN n > 1 THEN 'many' WHEN n = 1 THEN 'one' ELSE 'none' END AS refs, found AS targets"""
    return cypher.query(_whole(spark, sf_dir), text).withColumn("targets", F.array_join("targets", ","))


@query("WITH " + _COLS + ", x AS (SELECT t, count(*) AS n FROM cat GROUP BY t) SELECT t AS table_name, n FROM x ORDER BY n DESC, t LIMIT 5")
def graph_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read-only SQL over the labels."""
    return cypher.run_sql(spark, _whole(spark, sf_dir), "SELECT t.table_name, count(*) AS n FROM SchemaTable t JOIN HAS_COLUMN h ON h.src = t.node_id GROUP BY t.table_name ORDER BY n DESC, table_name LIMIT 5")


@query("WITH " + _FK + ", " + _COLS + """, e AS (SELECT 'FK_REFERENCES' AS label, count(*) AS n FROM fk WHERE NOT ((src_table = 'lineitem' AND src_column = 'l_orderkey'))
 UNION ALL SELECT 'SchemaColumn', count(*) - 1 FROM cat UNION ALL SELECT 'HAS_COLUMN', count(*) - 1 FROM cat) SELECT * FROM e""")  # fmt: skip
def graph_column_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays when lineitem.l_orderkey goes, with the key over it."""
    g, _ = graph.delete_column(_whole(spark, sf_dir), "db::main::lineitem::l_orderkey")
    count = lambda k: g[k].agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("label"), "n")
    return count("FK_REFERENCES").unionByName(count("SchemaColumn")).unionByName(count("HAS_COLUMN"))


# ---- stored paths and a whole index ------------------------------------------------------


@query("WITH RECURSIVE " + _WALK + """, best AS (SELECT f, t, depth, round(cost, 6) AS cost, hint FROM walk WHERE f < t QUALIFY row_number() OVER (PARTITION BY f, t ORDER BY round(cost, 6), depth, sig) = 1)
 SELECT f AS from_table, t AS to_table, depth, cost FROM best UNION ALL SELECT t, f, depth, cost FROM best""")  # fmt: skip
def stored_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best path of each pair, found once and stored in both directions."""
    return lifecycle.stored_paths("db", paths.precompute(_edges(spark, sf_dir))).select("from_table", "to_table", "depth", "cost")


def _state(spark: SparkSession) -> lifecycle.State:
    """A state folder of its own, where the session's checkpoints are."""
    return lifecycle.State(spark, f"{reach.checkpoint_folder(spark)}/state-{uuid.uuid4().hex}")


@query("WITH " + _FK + ", " + _COLS + f""" SELECT 'FK_REFERENCES' AS label, count(*) AS n, string_agg(src_table || '.' || src_column, ',' ORDER BY src_table, src_column) AS told FROM fk
 UNION ALL SELECT 'HAS_COLUMN', count(*), '' FROM cat UNION ALL SELECT 'SchemaColumn', count(*), string_agg(t || '.' || c, ',' ORDER BY t, c) FROM cat UNION ALL SELECT 'SchemaTable', count(DISTINCT t), string_agg(DISTINCT t, ',' ORDER BY t) FROM cat
 UNION ALL SELECT 'IN_CLUSTER', count(DISTINCT t), '' FROM cat""")  # fmt: skip
def index_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All supplied tables indexed into a stored graph, and what is read back from it."""
    state = _state(spark)
    lifecycle.index(state, catalog.ParquetSource(spark, sf_dir, catalog.TABLES), "db", profiles=False)
    g = state.store("db").read()
    named = lambda df, *c: df.select(F.concat_ws(".", *c).alias("x")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("x")), ",").alias("told"))
    fk = g["FK_REFERENCES"].join(g["SchemaTable"].select(F.col("node_id").alias("src"), "table_name"), "src")
    rows = {"FK_REFERENCES": named(fk, "table_name", "source_column"), "SchemaColumn": named(g["SchemaColumn"], "table_name", "column_name"), "SchemaTable": named(g["SchemaTable"], "table_name")}
    plain = {k: g[k].agg(F.count(F.lit(1)).alias("n"), F.lit("").alias("told")) for k in ("HAS_COLUMN", "IN_CLUSTER")}
    out = None
    for k, df in (rows | plain).items():
        one = df.select(F.lit(k).alias("label"), "n", "told")
        out = one if out is None else out.unionByName(one)
    return out


@query("WITH " + _FK + ", " + _COLS + """, gone AS (SELECT count(*) AS n FROM fk WHERE src_table = 'region' OR dst_table = 'region')
 SELECT 'tables_removed' AS counter, 1::BIGINT AS n UNION ALL SELECT 'tables_added', 1 UNION ALL SELECT 'columns_added', (SELECT count(*) FROM cat WHERE t = 'benchmark') + 1 UNION ALL SELECT 'columns_removed', 1 UNION ALL SELECT 'columns_updated', 1
 UNION ALL SELECT 'fk_edges_removed', n FROM gone UNION ALL SELECT 'foreign_keys_synced', 0""")  # fmt: skip
def drift_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph patched from a snapshot: region gone, benchmark new, one column each gone from,
    new in and changed in customer."""
    src = catalog.ParquetSource(spark, sf_dir, catalog.TABLES)
    whole = snapshot.inspect(src, "db", statistics=False)
    old = whole.restricted(whole.tables.where("table_name <> 'benchmark'"))
    new = whole.restricted(whole.tables.where("table_name <> 'region'"))
    old.columns = old.columns.where("NOT (table_name = 'customer' AND column_name = 'c_name')")
    new.columns = new.columns.where("NOT (table_name = 'customer' AND column_name = 'c_acctbal')").withColumn("data_type", F.when((F.col("table_name") == "customer") & (F.col("column_name") == "c_mktsegment"), "int").otherwise(F.col("data_type")))
    stored = graph.build("db", old.tables, old.columns, old.foreign_keys, old.lineage)
    _, counts = drift.patch_graph(stored, new, drift.diff(old, new))
    kept = ("tables_removed", "tables_added", "columns_added", "columns_removed", "columns_updated", "fk_edges_removed", "foreign_keys_synced")
    return spark.createDataFrame([(k, counts[k]) for k in kept], "counter string, n long")


@query("WITH " + _FK + " SELECT dst_table AS target_table, 'FK_REFERENCES' AS rel_type, src_column AS source_columns, dst_column AS target_columns, 1.0::DOUBLE AS confidence FROM fk WHERE src_table = 'lineitem'")
def table_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = tools.Workspace(spark, "db", catalog.ParquetSource(spark, sf_dir, ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")))
    x = tools.relationships(w, "lineitem").where("rel_type = 'FK_REFERENCES'")
    return x.select("target_table", "rel_type", F.array_join("source_columns", ",").alias("source_columns"), F.array_join("target_columns", ",").alias("target_columns"), "confidence")


@query("WITH " + _COLS + " SELECT t AS table_name, string_agg(c, ',' ORDER BY i) AS columns FROM cat GROUP BY t")
def ordered_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle._ordered_names(catalog.columns(spark, sf_dir).where("parent IS NULL")).select("table_name", F.array_join("columns", ",").alias("columns"))


# ---- clusters, entities, links -----------------------------------------------------------

_CLUSTERED = [("sales", "orders", "Sales", 0.4), ("all", "orders", graph.HEURISTIC, 0.9), ("geo", "nation", graph.HEURISTIC, 0.2), ("all", "nation", graph.HEURISTIC, 0.9), ("geo", "region", graph.HEURISTIC, 0.9), ("all", "region", graph.HEURISTIC, 0.9)]


@query("WITH " + _values("m", "c, t, d, s", _CLUSTERED) + f" SELECT t AS table_name, c AS cluster FROM m QUALIFY row_number() OVER (PARTITION BY t ORDER BY (d <> '{graph.HEURISTIC}') DESC, s DESC, 'db::cluster::' || c) = 1")
def best_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = spark.createDataFrame(_CLUSTERED, "cluster string, table_name string, description string, cohesion double")
    nodes, edge = graph.cluster_nodes("db", x.select("cluster", F.col("cluster").alias("label"), "description", "cohesion", F.lit("erd").alias("pattern"), F.lit(1).alias("n_tables")).distinct(), x.select("cluster", "table_name"))
    got = graph.best_cluster({"Cluster": nodes, "IN_CLUSTER": edge})
    return got.select(F.substring_index("table", "::", -1).alias("table_name"), F.substring_index("node_id", "::", -1).alias("cluster"))


_ENTITIES = [("Customer", "who buys", ["customer", "main.nope"]), ("Place", "where", ["region", "nation"]), ("Ghost", "nothing", ["gone"])]


@query("WITH " + _values("e", "name, description, tables", _ENTITIES) + f", r AS (SELECT name, description, unnest(tables) AS t FROM e), k AS (SELECT * FROM r WHERE t IN ({_NAMES})) SELECT name, description, min(t) AS table_name FROM k GROUP BY 1, 2")
def entity_primary_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with the first of their tables; references to nothing go."""
    tables = catalog.table_counts(spark, sf_dir)
    nodes, edge = entities.build("db", spark.createDataFrame(_ENTITIES, "name string, description string, tables array<string>"), tables)
    ids = tables.select(graph.node_of("db", "table_name").alias("node_id"), "table_name")
    return entities.primary_tables(nodes, edge.select("src", graph.node_of("db", "table_name").alias("dst")), ids).select("name", "description", "table_name")


_LINKS = [(f"a{i}", f"b{i % 7}", "confirmed" if i % 3 else "suggested", round(0.5 + (i * 37 % 50) / 100, 2)) for i in range(30)]


@query("WITH " + _values("l", "src, dst, status, score", _LINKS) + " SELECT src, dst, score::DOUBLE AS score FROM l WHERE status = 'confirmed' ORDER BY score DESC, src || '~' || dst LIMIT 10")
def top_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best confirmed links between entities of two databases."""
    x = spark.createDataFrame(_LINKS, "src string, dst string, status string, score double").withColumn("edge_id", entities.link_id(F.col("src"), F.col("dst")))
    names = x.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct().select("node_id", F.col("node_id").alias("name"), F.lit("db").alias("connection_name"))
    return entities.top_links(x, names).select("src", "dst", "score")


_SIDES = [("l", "customer", ["c_custkey", "c_name", "c_nationkey"]), ("l", "orders", ["o_orderkey", "total"]), ("r", "customers", ["c_custkey", "c_name", "phone"]), ("r", "orders", ["o_orderkey", "total"]), ("r", "film", ["title"])]


@query("WITH " + _values("x", "side, name, cols", _SIDES) + """, p AS (SELECT a.name AS a, b.name AS b, len(list_intersect(a.cols, b.cols)) AS s, len(list_distinct(list_concat(a.cols, b.cols))) AS n, levenshtein(a.name, b.name) AS d, greatest(length(a.name), length(b.name)) AS m FROM x a JOIN x b ON a.side = 'l' AND b.side = 'r')
 SELECT a, b, round(0.5 * s / n + 0.5 * (1 - d / m), 6)::DOUBLE AS score FROM p WHERE s > 0 AND 0.5 * s / n + 0.5 * (1 - d / m) >= 0.55""")  # fmt: skip
def entity_candidates_across(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = spark.createDataFrame(_SIDES, "side string, name string, columns array<string>").withColumn("node_id", F.concat("side", F.lit("::"), "name"))
    got = entities.similar_pairs(x.where("side = 'l'"), x.where("side = 'r'"))
    return got.select(F.substring_index("a", "::", -1).alias("a"), F.substring_index("b", "::", -1).alias("b"), "score")


_MEMBERS = [("s", t) for t in ("orders", "lineitem", "customer", "part")] + [("g", t) for t in ("nation", "region")]
_LABEL_ROLES = [("orders", "fact"), ("lineitem", "bridge"), ("customer", "dimension"), ("part", "dimension"), ("nation", "dimension"), ("region", "unknown")]


@query("WITH " + _EDGES + ", " + _values("m", "c, t", _MEMBERS) + ", " + _values("r", "t, role", _LABEL_ROLES) + ", n AS (" + " UNION ALL ".join(f"SELECT '{t}' AS t, count(*) AS k FROM {t}" for _, t in _MEMBERS) + """),
 p AS (SELECT least(src_table, dst_table) AS a, greatest(src_table, dst_table) AS b FROM edge GROUP BY 1, 2), q AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
 d AS (SELECT x.t, x.c, count(y.t) AS deg FROM m x LEFT JOIN q ON q.a = x.t LEFT JOIN m y ON y.t = q.b AND y.c = x.c GROUP BY 1, 2),
 w AS (SELECT d.*, k, CASE role WHEN 'dimension' THEN 1.5 WHEN 'fact' THEN 1.25 WHEN 'bridge' THEN 0.4 WHEN 'link' THEN 0.4 ELSE 1.0 END::DOUBLE AS f FROM d JOIN r USING (t) JOIN n USING (t)),
 an AS (SELECT c, t FROM w QUALIFY row_number() OVER (PARTITION BY c ORDER BY deg * f DESC, k DESC, t) = 1),
 v AS (SELECT c, CASE WHEN length(t) > 3 AND t LIKE '%s' THEN left(t, length(t) - 1) ELSE t END AS stem, t AS word, (deg + 1) * log10(k + 10) * f AS p FROM w),
 hd AS (SELECT c, word FROM v QUALIFY row_number() OVER (PARTITION BY c ORDER BY round(p, 9) DESC, stem) = 1)
 SELECT c AS cluster, an.t AS anchor, 'main.' || an.t || ' · ' || upper(left(word, 1)) || substr(word, 2) || ' cluster (' || (SELECT count(*) FROM m WHERE m.c = an.c) || ' tables)' AS label FROM an JOIN hd USING (c)""")  # fmt: skip
def cluster_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of clusters from degrees, rows and roles."""
    members = spark.createDataFrame(_MEMBERS, "cluster string, table_name string")
    return cluster.labels(members, cluster.weighted_pairs(_edges(spark, sf_dir)), spark.createDataFrame(_LABEL_ROLES, "table_name string, role string"), catalog.table_counts(spark, sf_dir, [t for _, t in _MEMBERS]))


# ---- names, lists, documents ---------------------------------------------------------------

_WORDS = [(1, ["Order", "order", " ", "Line", "ORDER", "line", "x"]), (2, []), (3, ["a", "A", "b"])]


@query("WITH " + _values("x", "id, w", _WORDS) + " SELECT id, coalesce((SELECT string_agg(v, ',' ORDER BY p) FROM (SELECT v, p FROM (SELECT unnest(w) AS v, unnest(range(len(w))) AS p) WHERE trim(v) <> '' QUALIFY row_number() OVER (PARTITION BY lower(v) ORDER BY p) = 1)), '') AS words FROM x")
def distinct_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word once, whatever its case: the first spelling stays, in order."""
    return spark.createDataFrame(_WORDS, "id int, w array<string>").select("id", F.array_join(S.distinct_words(F.col("w")), ",").alias("words"))


_JSONS = [(1, '["a", "b"]'), (2, "no json"), (3, None), (4, "[]"), (5, '{"a": 1}')]


@query("WITH " + _values("x", "id, j", _JSONS) + " SELECT id, CASE WHEN json_valid(coalesce(j, '')) AND json_type(j) = 'ARRAY' THEN array_to_string(from_json(j, '[\"VARCHAR\"]'), '|') ELSE '' END AS items FROM x")
def json_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List columns as JSON and back; what is no list is an empty one."""
    return spark.createDataFrame(_JSONS, "id int, j string").select("id", F.array_join(S.json_to_list(F.col("j")), "|").alias("items"))


@query("WITH d AS (SELECT doc_id AS id, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: w <> '')) AS ws, lang FROM documents) SELECT lang, count(*) AS n FROM d WHERE list_has_any(ws, ['the', 'river', 'license']) GROUP BY lang")
def search_any_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with any of the query's words, by language."""
    docs = catalog.read_table(spark, sf_dir, "documents")
    ascii_only = docs.withColumn("text", F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "))
    hits = search.bm25(ascii_only, "doc_id", "The RIVER license", {"text": 1.0})
    return hits.join(docs.select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


# ---- dbt ------------------------------------------------------------------------------

#: a manifest of many models over the supplied names: model k selects from k // 2 and k // 3
_MODELS = 1500


def big_manifest(models: int = _MODELS) -> str:
    nodes = {f"model.p.m{k}": {"resource_type": "model", "name": f"m{k}", "schema": "marts", "tags": [f"t{k % 7}"], "description": f"Model {k}" if k % 5 else ""} for k in range(1, models + 1)}
    tests = {f"test.p.t{k}": {"resource_type": "test", "name": f"t{k}", "attached_node": f"model.p.m{k * 11}"} for k in range(1, models // 30 + 1)}
    parents = {f"model.p.m{k}": [f"model.p.m{k // 2}", f"model.p.m{k // 3}"] if k > 2 else ["source.p.raw.s"] for k in range(1, models + 1)}
    exposures = {f"exposure.p.e{k}": {"name": f"e{k}", "depends_on": {"nodes": [f"model.p.m{models - 7 * k}"]}} for k in range(12)}
    return json.dumps({"metadata": {"dbt_schema_version": "https://schemas.getdbt.com/dbt/manifest/v10.json"}, "nodes": nodes | tests, "sources": {"source.p.raw.s": {"name": "s", "source_name": "raw", "schema": "raw"}}, "exposures": exposures, "parent_map": parents})


@query(f"""WITH RECURSIVE k AS (SELECT unnest(range(1, {_MODELS + 1})) AS k), par AS (SELECT k, k // 2 AS p FROM k WHERE k > 2 UNION SELECT k, k // 3 FROM k WHERE k > 2),
 up AS (SELECT {_MODELS} - 7 * unnest(range(12)) AS k UNION SELECT p FROM up JOIN par USING (k))
 SELECT 'lineage_edges' AS counter, (SELECT count(*) FROM par WHERE k <> p AND p > 0) + 2 AS n UNION ALL SELECT 'external_consumers', (SELECT count(*) FROM up WHERE k > 0) + 1 UNION ALL SELECT 'tested_models', count(*) FROM k WHERE k % 11 = 0 AND k // 11 <= {_MODELS // 30}
 UNION ALL SELECT 'tags_added', count(*) FROM k UNION ALL SELECT 'descriptions_added', count(*) FROM k WHERE k % 5 > 0 UNION ALL SELECT 'sources_fresh', 1""")  # fmt: skip
def dbt_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that a manifest of 1 500 models tells of a catalog."""
    m = dbt.Manifest.parse(spark, big_manifest())
    tables = m.tables().select(F.concat_ws(".", "schema_name", "table_name").alias("table_name"))
    columns = tables.select("table_name", F.lit("id").alias("column_name"))
    empty = spark.createDataFrame([], snapshot.LINEAGE)
    fresh = dbt.source_results(spark.createDataFrame([(json.dumps({"results": [{"unique_id": "source.p.raw.s", "status": "warn", "max_loaded_at": "2024-01-01"}]}),)], "t string"))
    got = dbt.run(m, tables, columns, empty, fresh)[3]
    keys = ("lineage_edges", "external_consumers", "tested_models", "tags_added", "descriptions_added", "sources_fresh")
    return spark.createDataFrame([(k, int(got[k])) for k in keys], "counter string, n long")


_FRESH = {"list": {"results": [{"unique_id": "a", "status": "pass", "max_loaded_at": "1"}, {"unique_id": "b", "status": "Warn"}]}, "map": {"sources": {"c": {"state": "error", "max_loaded_at": "2"}, "d": {"unique_id": "e", "status": "pass"}}}}


@query(f"""WITH l AS (SELECT {_literal(json.dumps(_FRESH['list']))}::JSON AS j), m AS (SELECT {_literal(json.dumps(_FRESH['map']))}::JSON AS j), r AS (SELECT unnest(from_json(j->'results', '["JSON"]')) AS r FROM l), q AS (SELECT k, j->'sources'->k AS r FROM (SELECT j, unnest(json_keys(j->'sources')) AS k FROM m))
 SELECT r->>'unique_id' AS unique_id, lower(coalesce(r->>'status', r->>'state')) AS status, r->>'max_loaded_at' AS max_loaded_at FROM r UNION ALL SELECT coalesce(r->>'unique_id', k), lower(coalesce(r->>'status', r->>'state')), r->>'max_loaded_at' FROM q""")  # fmt: skip
def dbt_source_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Freshness files as a list and as the older map."""
    raw = spark.createDataFrame([(json.dumps(x),) for x in _FRESH.values()], "t string")
    return dbt.source_results(raw)


# ---- a recorded PostgreSQL catalog, made of the supplied tables ------------------------------


def recorded_postgres(spark: SparkSession, sf_dir: str) -> reader.RecordedReader:
    """System views as a PostgreSQL database with the supplied tables would show them."""
    f, names = spark.createDataFrame, list(COLUMNS)
    oid = {t: 100 + i for i, t in enumerate(names)}
    cols = [(t, c, i + 1) for t in names for i, c in enumerate(COLUMNS[t])]
    place = {(t, c): i for t, c, i in cols}
    keys = [k for k in FK_ROWS if k[0] in oid and k[2] in oid]
    pks = [("region", "r_regionkey"), ("nation", "n_nationkey"), ("customer", "c_custkey"), ("orders", "o_orderkey"), ("part", "p_partkey"), ("supplier", "s_suppkey"), ("documents", "doc_id")]
    literal = lambda values: "{" + ",".join(f'"{v}"' if "," in v else v for v in values) + "}"
    # what the statements of the source answer, under the names that they give
    told = {
        "relations": f([(oid[t], "public", t, "p" if t == "events" else "r", 1000.0, 0) for t in names] + [(500 + i, "public", f"{t}_pk", "i", 0.0, 403) for i, (t, _) in enumerate(pks)] + [(600, "pg_catalog", "pg_class", "r", 1.0, 0)], "oid long, schema_name string, table_name string, relkind string, reltuples double, relam long"),
        "attributes": f([(oid[t], i, c) for t, c, i in cols], "oid long, attnum int, column_name string"),
        "comments": f([(oid["region"], 0, "parts of the world"), (oid["nation"], place["nation", "n_name"], "as people say it")], "oid long, attnum int, description string"),
        "index_columns": f([(oid[t], 500 + i, True, place[t, c]) for i, (t, c) in enumerate(pks)], "oid long, indexrelid long, indisunique boolean, attnum int"),
        "methods": f([(403, "btree")], "relam long, amname string"),
        "checks": f([(oid["part"], place["part", "p_size"], "CHECK (p_size > 0)"), (oid["part"], place["part", "p_size"], "CHECK (p_size < p_retailprice)"), (oid["part"], place["part", "p_retailprice"], "CHECK (p_size < p_retailprice)")], "oid long, attnum int, check_def string"),
        "usage": f([("public", "orders", 7, 9, 100, 5, 1)], "schema_name string, table_name string, seq_scan long, idx_scan long, n_tup_ins long, n_tup_upd long, n_tup_del long"),
        "partitions": f([(oid["events"], "RANGE (ts)")], "oid long, partition_key string"),
        "stats": f([("public", "orders", "o_orderstatus", 3.0, 0.0, 0.5, literal(["O", "F", "P"]), None), ("public", "orders", "o_custkey", -0.1, 0.25, 0.1, None, literal(["1", "9", "a, b"]))], "schema_name string, table_name string, column_name string, n_distinct double, null_frac double, correlation double, mcv_text string, histogram_text string"),
        "views": f([("public", "v_orders", "SELECT * FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey;")], "schema_name string, name string, definition string"),
        "matviews": f([("public", "m_geo", "SELECT n_name FROM public.nation")], "schema_name string, name string, definition string"),
        "triggers": f([(oid["orders"], "INSERT INTO events SELECT * FROM orders WHERE o_orderstatus = 'a;b'; DELETE FROM labels WHERE 1 = 1", "sql"), (oid["part"], "EXECUTE 'INSERT INTO labels'", "sql"), (oid["part"], "BEGIN INSERT INTO pages SELECT 1; END", "plpgsql")], "oid long, prosrc string, lanname string"),
        "memberships": f([("alice", "readers"), ("readers", "staff")], "child string, parent string"),
    }
    views = {
        "information_schema.tables": f([("public", t, "BASE TABLE") for t in names] + [("pg_catalog", "pg_class", "BASE TABLE")], "table_schema string, table_name string, table_type string"),
        "information_schema.columns": f([("public", t, c, "USER-DEFINED" if c == "o_orderstatus" else "text", "status" if c == "o_orderstatus" else "text", "YES" if i > 1 else "NO", None, i) for t, c, i in cols], "table_schema string, table_name string, column_name string, data_type string, udt_name string, is_nullable string, column_default string, ordinal_position int"),
        "information_schema.table_constraints": f([("public", f"{t}_pk", t, "PRIMARY KEY") for t, _ in pks], "constraint_schema string, constraint_name string, table_name string, constraint_type string"),
        "information_schema.key_column_usage": f([("public", f"{t}_pk", "public", t, c, 1, None) for t, c in pks] + [("public", f"{k[0]}_{k[1]}_fk", "public", k[0], k[1], 1, 1) for k in keys], "constraint_schema string, constraint_name string, table_schema string, table_name string, column_name string, ordinal_position int, position_in_unique_constraint int"),
        "information_schema.referential_constraints": f([("public", f"{k[0]}_{k[1]}_fk", "public", f"{k[2]}_pk") for k in keys], "constraint_schema string, constraint_name string, unique_constraint_schema string, unique_constraint_name string"),
        "information_schema.table_privileges": f([("public", "orders", "readers", "SELECT"), ("public", "part", "staff", "SELECT"), ("public", "part", "PUBLIC", "SELECT"), ("public", "labels", "alice", "INSERT")], "table_schema string, table_name string, grantee string, privilege_type string"),
    }
    views |= {f"public.{t}": catalog.read_table(spark, sf_dir, t) for t in names}
    return reader.RecordedReader(spark, views, {postgres.STATEMENTS[k]: v for k, v in told.items()})


_SINGLE = ", ".join(f"'{t}'" for t in COLUMNS)


@query("WITH " + _FK + f" SELECT src_table, src_column, dst_table, dst_column FROM fk WHERE src_table IN ({_SINGLE}) AND dst_table IN ({_SINGLE})")
def postgres_foreign_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared keys as the system views of a database tell them."""
    return postgres.PostgresSource(recorded_postgres(spark, sf_dir)).foreign_keys().select("src_table", "src_column", "dst_table", "dst_column")


@query(f"""WITH c AS (SELECT table_name AS t, column_name AS c, column_index AS i FROM duckdb_columns() WHERE table_name IN ({_SINGLE})),
 pk(t, c) AS (VALUES ('region', 'r_regionkey'), ('nation', 'n_nationkey'), ('customer', 'c_custkey'), ('orders', 'o_orderkey'), ('part', 'p_partkey'), ('supplier', 's_suppkey'), ('documents', 'doc_id'))
 SELECT t AS table_name, c AS column_name, CASE WHEN c = 'o_orderstatus' THEN 'status' ELSE 'text' END AS data_type, i > 1 AS nullable, i::INT AS ordinal, (t, c) IN (SELECT (t, c) FROM pk) AS is_primary_key, (t, c) IN (SELECT (t, c) FROM pk) AS is_indexed,
   CASE WHEN c = 'p_size' THEN 2 WHEN c = 'p_retailprice' THEN 1 ELSE 0 END AS n_checks FROM c""")  # fmt: skip
def postgres_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = postgres.PostgresSource(recorded_postgres(spark, sf_dir)).columns()
    return x.select("table_name", "column_name", "data_type", "nullable", "ordinal", "is_primary_key", "is_indexed", F.size("check_constraints").alias("n_checks"))


@query("SELECT * FROM (VALUES ('alice', 'public.orders'), ('alice', 'public.part'), ('readers', 'public.orders'), ('readers', 'public.part'), ('staff', 'public.part')) AS x(grantee, table_name)")
def postgres_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What roles may read, through their memberships; PUBLIC and other privileges do not count."""
    return postgres.PostgresSource(recorded_postgres(spark, sf_dir)).select_grants()


@query("WITH " + _COLS + " SELECT t AS table_name, count(*) AS n, count(*) FILTER (typ LIKE '%[]') AS arrays FROM cat GROUP BY t")
def snapshot_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of a snapshot of all tables, nested ones marked."""
    snap = snapshot.inspect(catalog.ParquetSource(spark, sf_dir, catalog.TABLES), "db", statistics=False)
    return snap.columns.where("parent IS NULL").groupBy("table_name").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_array").alias("arrays"))


@query("WITH " + _FK + " SELECT src_table AS table_name, src_column AS column_name FROM fk")
def foreign_key_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that a snapshot marks as foreign keys."""
    snap = snapshot.inspect(catalog.ParquetSource(spark, sf_dir, catalog.TABLES), "db", statistics=False)
    return snap.columns.where("is_foreign_key").select("table_name", "column_name")


@query("WITH " + _FK + f", t AS (SELECT unnest([{_NAMES}]) AS table_name), x AS (SELECT table_name, (SELECT count(DISTINCT dst_table) FROM fk WHERE src_table = table_name) AS o, (SELECT count(DISTINCT src_table) FROM fk WHERE dst_table = table_name) AS i FROM t) SELECT table_name, list_filter([CASE WHEN o > 0 THEN 'FK out-degree ' || o END, CASE WHEN i > 0 THEN 'FK in-degree ' || i END], lambda s: s IS NOT NULL) AS facts FROM x WHERE o + i > 0")
def role_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The degrees that speak for the roles of the supplied tables."""
    src = catalog.ParquetSource(spark, sf_dir, catalog.TABLES)
    got = lifecycle.classified(src.tables(), src.columns(), src.foreign_keys())
    return got.select("table_name", F.filter("signals", lambda s: s.startswith("FK ")).alias("facts")).where(F.size("facts") > 0)

