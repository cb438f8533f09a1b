"""Indexing a folder into a stored graph, refreshing it, and asking about it."""

import json

import pytest
from pyspark.sql import functions as F

from quarry import __main__ as cli
from quarry import config, lifecycle, tools
from quarry.operators import entities, steps
from quarry.operators.visibility import Profile
from quarry.sources import catalog, dsn, files

KEYS = [("trip", "boat_id", "boat", "id"), ("boat", "owner_id", "owner", "id"), ("catch", "trip_id", "trip", "id")]
VIEWS = {"v_boat": "SELECT * FROM boat", "v_all": "SELECT * FROM boat b JOIN owner o ON b.owner_id = o.id"}


def tables(spark, at, extra=False, without=()):
    frames = {
        "owner": [(1, "Ann"), (2, "Bo")], "boat": [(10, 1, "Gull"), (11, 2, "Tern")], "trip": [(100, 10, 3.5), (101, 11, 2.0)], "catch": [(1000, 100, 55.5, "cod")], "v_boat": [(10, 1, "Gull")], "v_all": [(10, 1, "Gull", "Ann")],
        "price_list": [("cod", 4.0)],
    }
    names = {"owner": "id int, name string", "boat": "id int, owner_id int, label string", "trip": "id int, boat_id int, hours double", "catch": "id int, trip_id int, amount double, species string", "v_boat": "id int, owner_id int, label string", "v_all": "id int, owner_id int, label string, name string", "price_list": "species string, price double"}
    for t, rows in frames.items():
        if t not in without:
            df = spark.createDataFrame(rows, names[t])
            df = df.withColumn("captain", F.lit("x")) if extra and t == "trip" else df
            df.write.mode("overwrite").parquet(f"{at}/{t}.parquet")
    return at


class Fleet(catalog.ParquetSource):
    """A folder whose views are known."""

    def __init__(self, spark, at):
        super().__init__(spark, at, keys=KEYS, views=VIEWS)

    def tables(self):
        return super().tables().withColumn("table_type", F.when(F.col("table_name").startswith("v_"), "view").otherwise("table")).withColumn("comment", F.when(F.col("table_name") == "boat", "what sails"))


@pytest.fixture(scope="module")
def state(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("fleet")
    s = lifecycle.State(spark, f"file://{at}/state")
    s.folder = tables(spark, f"file://{at}/data")
    layer = {"entities": [{"name": "catch", "source_table": "catch", "dimensions": [{"name": "species", "column": "species"}], "metrics": [{"name": "landed", "type": "sum", "column": "amount"}, {"name": "odd", "type": "derived", "expression": "SELECT count(*) AS odd FROM owner JOIN price_list ON owner.name = price_list.species"}]}]}
    files.write_yaml(spark, f"{s.path}/semantic/fleet.yml", layer)
    s.summary = lifecycle.index(s, Fleet(spark, s.folder), "fleet", "harbour", address="file:///x")
    return s


@pytest.fixture(scope="module")
def w(state):
    return tools.Workspace.stored(state, "fleet")


def test_index_stores_everything(state):
    assert state.summary["tables"] == 7 and state.summary["foreign_keys"] == 3 and state.summary["notes"] == []
    assert set(state.summary["steps"]) == {"classify", "cluster", "label", "join_paths"}
    g = state.store("fleet").read()
    assert {"SchemaTable", "SchemaColumn", "HAS_COLUMN", "FK_REFERENCES", "INFERRED_JOIN", "LINEAGE", "Cluster", "IN_CLUSTER", "JoinPath", "Entity", "REPRESENTS"} <= set(g)
    assert {r.role for r in g["SchemaTable"].collect()} and g["LINEAGE"].count() == 3
    assert lifecycle.validate(state, "fleet") == []
    assert state.registry().get("harbour")["version"] == 1


def test_shadow_aliases_stay_out_of_joins(w):
    assert [r[0] for r in w.aliases.collect()] == ["v_boat"]
    assert "v_boat" not in {t for r in w.edges.collect() for t in (r.src_table, r.dst_table)}
    got = tools.context(w, "boat")
    assert got["aliases"] == ["v_boat"] and [x["table"] for x in got["lineage_out"]] == ["v_all", "v_boat"] and "v_boat (VIEW, 1)" in got["lineage_markdown"]
    assert tools.context(w, "v_boat")["shadow_of"] == "boat"


def test_context_levels(w):
    short, plain, full = (tools.context(w, "BOAT", d) for d in ("summary", "standard", "full"))
    assert short["summary"]["column_count"] == 3 and short["summary"]["description"] == "what sails" and "columns" not in short
    assert plain["relationships"][0] == {"target_table": "owner", "rel_type": "FK_REFERENCES", "source_columns": ["owner_id"], "target_columns": ["id"], "constraint_name": "boat_owner_id_fk", "source": "declared", "confidence": 1.0, "reasoning": None}
    assert plain["cluster"]["label"].startswith("main.") and plain["classification_summary"].startswith("This is a ") and plain["role"]["role"]
    assert [c["column_name"] for c in plain["columns"] if c["is_foreign_key"]] == ["owner_id"] and {c["distinct_count"] for c in plain["columns"]} == {2}
    assert full["classification_signals"] and tools.context(w, "boats")["suggestions"][0] == "boat"
    assert tools.to_json(full)


def test_traverse_policy(w, spark):
    got = tools.traverse(w, "catch", "owner")
    assert got["used_precomputed"] and got["paths"][0]["depth"] == 3 and got["paths"][0]["sql_hint"].startswith("FROM catch JOIN trip ON")
    back = tools.traverse(w, "owner", "catch")
    assert back["used_precomputed"] and back["paths"][0]["depth"] == 3
    assert "error" in tools.traverse(w, "price_list", "owner", kinds=("fk",))
    assert "error" in tools.traverse(w, "catch", "owner", max_depth=2)


def test_a_declared_chain_goes_before_a_stored_guess(state, spark):
    w = tools.Workspace.stored(state, "fleet")
    p = w.frames["JoinPath"]
    guessed = p.withColumn("steps", F.when((F.col("from_table") == "catch") & (F.col("to_table") == "owner"), F.transform("steps", lambda s: s.withField("kind", F.lit("inferred")))).otherwise(F.col("steps")))
    w.frames = w.frames | {"JoinPath": guessed}
    got = tools.traverse(w, "catch", "owner", max_inferred=4)
    assert not got["used_precomputed"] and got["paths"][0]["label"].endswith("declared keys") and len(got["paths"]) == 2


def test_search_index(state):
    found = state.index()
    versions = {"fleet": 1}
    assert not found.needs_rebuild(versions) and found.needs_rebuild({"fleet": 2}) and not lifecycle.refresh_search(state)
    assert found.search("sails").first().table_name == "boat" and found.search("species price").first().table_name == "price_list"
    assert "boat" not in [r.table_name for r in found.similar("boat").collect()]


def test_pages(w, state):
    page = tools.overview(w)
    assert "| boat |" in page and "## Clusters" in page and "trip.boat_id = boat.id (fk, 1)" in page and "landed" in page
    assert "- boat" in tools.clusters_page(w) and "| fleet | harbour | parquet | 7 |" in tools.databases_page(state) and "traverse" in tools.skill_page(w)


def test_metrics(w):
    assert tools.compile_metric(w, "landed")["sql"] == "SELECT sum(`amount`) AS `landed` FROM `catch`"
    odd = tools.compile_metric(w, "odd")
    assert odd["warnings"] == ["no known join between owner and price_list"] and not odd["validation"]["valid"]
    assert "error" in tools.compile_metric(w, "none") and tools.impact(w, "catch")["metrics"] == ["landed", "odd"]


def test_hidden_tables_never_come_out(state):
    w = tools.Workspace.stored(state, "fleet", Profile(hidden_tables=("own*",), hidden_columns=("boat.label",)))
    assert "owner" not in w.names() and "error" in tools.traverse(w, "catch", "owner")
    rows = tools.run_cypher(w, "MATCH (t:SchemaTable) RETURN t.table_name AS n, t.node_id AS id", timeout=100)["rows"]
    assert {r["n"] for r in rows} == set(w.names())
    assert [c["column_name"] for c in tools.context(w, "boat")["columns"]] == ["id", "owner_id"]
    paths_ = tools.run_cypher(w, "MATCH (p:JoinPath) RETURN p.from_table AS a, p.to_table AS b", timeout=100)["rows"]
    assert paths_ and all("owner" not in (r["a"], r["b"]) for r in paths_)
    assert tools.run_cypher(w, "MATCH (t:SchemaTable) RETURN t.table_name AS n", limit=2, timeout=100)["truncated"]


def test_reindex(spark, tmp_path):
    s = lifecycle.State(spark, f"file://{tmp_path}/state")
    at = tables(spark, f"file://{tmp_path}/data")
    lifecycle.index(s, Fleet(spark, at), "fleet")
    before = tools.Workspace.stored(s, "fleet")
    same = lifecycle.reindex(s, Fleet(spark, at), "fleet", dry_run=True)
    assert same["changes"] == [] and same["summary"] == "no changes" and s.registry().get("fleet")["version"] == 1
    files.delete(spark, f"{at}/price_list.parquet")
    tables(spark, at, extra=True, without=("price_list",))
    dry = lifecycle.reindex(s, Fleet(spark, at), "fleet", dry_run=True)
    assert dry["patch"]["tables_removed"] == 1 and dry["patch"]["columns_added"] == 1 and dry["patch"]["cluster_memberships_removed"] >= 1 and s.store("fleet").versions() == [1]
    done = lifecycle.reindex(s, Fleet(spark, at), "fleet")
    assert done["version"] == 2 and {(c["change_type"], c["table_name"], c["column_name"]) for c in done["changes"]} >= {("removed", "price_list", None), ("added", "trip", "captain")}
    after = tools.Workspace.stored(s, "fleet")
    assert "price_list" not in after.names() and lifecycle.validate(s, "fleet") == []
    told = tools.detect_changes(after, before)
    assert told["stale_paths"] > 0 and told["affected_clusters"] and "tables removed: 1" in told["summary"]
    full = lifecycle.reindex(s, Fleet(spark, at), "fleet", full=True)
    assert full["version"] == 3 and full["tables"] == 6
    assert lifecycle.export(s, "fleet").where("kind = 'node' AND label = 'SchemaTable'").count() == 6
    assert lifecycle.remove(s, "fleet") and not lifecycle.remove(s, "fleet") and s.store("fleet").versions() == []
    with pytest.raises(KeyError):
        lifecycle.reindex(s, Fleet(spark, at), "fleet")


def test_paths_across_two_databases(spark, tmp_path, state):
    s = lifecycle.State(spark, state.path)
    other = tables(spark, f"file://{tmp_path}/other", without=("trip", "catch", "v_boat", "v_all", "price_list"))
    named = lambda rows: spark.createDataFrame(rows, "name string, description string, tables array<string>")
    lifecycle.index(s, catalog.ParquetSource(spark, other, keys=KEYS[1:2]), "club", entity_rows=named([("Owner", "a member", ["owner"]), ("Boat", "a boat", ["boat"])]), profiles=False)
    lifecycle.index(s, Fleet(spark, state.folder), "fleet", "harbour", entity_rows=named([("Owner", "who owns", ["owner"]), ("Trip", "a trip", ["trip"])]), profiles=False)
    found = lifecycle.same_entities(s, "fleet", "club")
    links = entities.merge_links(lifecycle.links(s), found)
    assert {r.edge_id for r in links.collect()} >= {"club::entity::owner~fleet::entity::owner"}
    lifecycle.save_links(s, entities.decide_link(links, "club::entity::owner~fleet::entity::owner", "confirmed", "me", "2024-01-01"))
    a, b = tools.Workspace.stored(s, "fleet"), tools.Workspace.stored(s, "club")
    got = tools.traverse(a, "trip", "boat", other=b, links=lifecycle.links(s))
    assert [(p["via"], p["depth"]) for p in got["paths"]] == [("owner~owner", 4)]
    assert "error" in tools.traverse(a, "trip", "boat", other=b)
    page = tools.cross_database_page(s)
    assert "confirmed: 1" in page and "Owner" in page


def test_dbt_over_an_index(spark, tmp_path):
    manifest = {"metadata": {"dbt_schema_version": "x/v10.json"}, "nodes": {"model.p.boat": {"resource_type": "model", "name": "boat", "schema": "main", "description": "Every boat", "tags": ["core"], "columns": {"LABEL": {"description": "its name"}}}}, "sources": {}, "exposures": {"e": {"name": "e", "depends_on": {"nodes": ["model.p.boat"]}}}, "parent_map": {}}
    at = f"file://{tmp_path}/manifest.json"
    files.write_text(spark, at, json.dumps(manifest))
    s = lifecycle.State(spark, f"file://{tmp_path}/state")
    data = tables(spark, f"file://{tmp_path}/data")
    # dbt names schema.table; the folder's tables are of the schema main, named by it here
    class Named(Fleet):
        def tables(self):
            return super().tables()

    got = lifecycle.index(s, Named(spark, data), "fleet", manifest=at, profiles=False)
    assert got["dbt"]["warnings"] == [] and got["dbt"]["tables"] == 7


def test_command_line(spark, state, tmp_path, monkeypatch, capsys):
    run = lambda *a: cli.run(spark, list(a))
    text, code = run("index", f"file://{tmp_path}/s", "fleet", state.folder, "--profiles=no")
    assert code == 0 and json.loads(text)["tables"] == 7
    assert json.loads(run("list", f"file://{tmp_path}/s")[0])["fleet"]["version"] == 1
    assert json.loads(run("ask", f"file://{tmp_path}/s", "fleet", "context", "--table=boat", "--detail=summary")[0])["table"] == "boat"
    assert run("validate", f"file://{tmp_path}/s", "fleet") == ('{"problems": []}', 0)
    assert json.loads(run("reindex", f"file://{tmp_path}/s", "fleet", state.folder, "--dry-run")[0])["dry_run"]
    assert run("export", f"file://{tmp_path}/s", "fleet", f"file://{tmp_path}/out.jsonl")[1] == 0 and '"table_name":"boat"' in files.read_text(spark, f"file://{tmp_path}/out.jsonl")
    assert "| boat |" in run("overview", state.folder)[0] and json.loads(run("query", state.folder, "--q=boat")[0])["hits"]
    files.write_yaml(spark, f"file://{tmp_path}/s/visibility.yml", {"hidden_tables": ["catch"], "profiles": {"small": {"allowed_tables": ["boat", "owner"]}}})
    monkeypatch.setenv("QUARRY_PROFILE", "small")
    assert json.loads(run("ask", f"file://{tmp_path}/s", "fleet", "list_databases")[0])["databases"][0]["tables"] == 2
    assert run("page", f"file://{tmp_path}/s", "fleet", "overview")[0].startswith("# fleet")
    assert json.loads(run("remove", f"file://{tmp_path}/s", "fleet")[0]) == {"removed": True}
    assert cli.main([]) == 2 and cli.main(["index", "only"]) == 2 and "index STATE" in capsys.readouterr().err


def test_grants_become_profiles(spark, state):
    s = lifecycle.State(spark, state.path)
    at = f"{s.path}/snapshots/fleet/v={s.registry().get('fleet')['version']}/grants"
    spark.createDataFrame([("crew", "boat"), ("crew", "sales.x"), ("boss", "owner")], "grantee string, table_name string").write.mode("overwrite").parquet(at)
    doc = lifecycle.sync_grants(s, "fleet", dry_run=True)
    assert doc["profiles"] == {"boss": {"allowed_tables": ["fleet::main.owner"]}, "crew": {"allowed_tables": ["fleet::main.boat", "fleet::sales.x"]}} and s.visibility() == {}
    lifecycle.sync_grants(s, "fleet", {"crew"})
    assert list(s.visibility()["profiles"]) == ["crew"]


def test_config_and_plugins(spark, state):
    class Model(config.NoRelationships):
        pass

    class Guess:
        def infer(self, columns):
            return columns.limit(1).select(F.lit("price_list").alias("src_table"), F.lit("species").alias("src_column"), F.lit("catch").alias("dst_table"), F.lit("species").alias("dst_column"), F.lit(3.0).alias("confidence"), F.lit("the model says so").alias("reasoning"))

    assert config.model_scorer(Model()) is None
    c = config.Config(relationships=Guess()).with_graph(path_depth=2)
    ctx = lifecycle._context(state.snapshot("fleet"), c, {})
    assert ("llm", 1.0) in {(r.kind, r.confidence) for r in ctx["inferred"].collect()} and c.graph.path_depth == 2
    assert isinstance(config.plugins(), dict)
    with pytest.raises(ValueError, match="registered"):
        tools.register_tool("context", tools.context)
    assert steps.Runner().run({}) == {}


def test_sealed_addresses(spark):
    a = dsn.sealed(spark, "postgres://me:pw@h/d", "key")
    assert "pw" not in a and dsn.opened(spark, a, "key") == "postgres://me:pw@h/d"
    with pytest.raises(Exception):
        dsn.opened(spark, a, "other")


def test_files(spark, tmp_path):
    at = f"file://{tmp_path}/d/x.yml"
    files.write_yaml(spark, at, {"a": ["é", 1]})
    files.write_yaml(spark, at, {"a": ["ö", 2]})
    assert files.read_yaml(spark, at) == {"a": ["ö", 2]} and files.names(spark, f"file://{tmp_path}/d") == ["x.yml"] and files.modified(spark, at) > 0
    assert files.names(spark, f"file://{tmp_path}/none") == [] and files.delete(spark, at) and not files.exists(spark, at)
