"""Entities, clusters, links, cascades and steps on small graphs."""

import pytest
from pyspark.sql import functions as F

from quarry.functions import scalars as S
from quarry.operators import cluster, drift, entities, graph, steps
from quarry.operators.visibility import redact
from quarry.sources import snapshot

FK = "src_table string, src_column string, dst_table string, dst_column string"


@pytest.fixture(scope="module")
def g(spark):
    tables = spark.createDataFrame([("a", "says a"), ("b", None), ("s.c", None)], "table_name string, comment string")
    columns = spark.createDataFrame([("a", "id", 1, None), ("a", "b_id", 2, None), ("b", "id", 1, None), ("b", "j", 2, None), ("b", "j.x", 1, "j"), ("s.c", "id", 1, None)], "table_name string, column_name string, ordinal int, parent string")
    keys = spark.createDataFrame([("a", "b_id", "b", "id")], FK)
    inferred = spark.createDataFrame([("heuristic_id", "b", "j", "s.c", "id", 0.5, "why"), ("heuristic_id", "b", "j", "s.c", "id", 0.7, "more")], "kind string, " + FK + ", confidence double, reasoning string")
    lineage = spark.createDataFrame([("a", "b", "VIEW", 0.85), ("a", "b", "VIEW", 1.0), ("a", "gone", "VIEW", 1.0)], "src_table string, dst_table string, lineage_type string, confidence double")
    out = graph.build("c", tables, columns, keys, lineage, inferred)
    out["JoinPath"] = spark.createDataFrame([("p1", ["c::main::a", "c::main::b"], [("c::main::a", "b_id", "c::main::b", "id", "fk", 1.0)], False), ("p2", ["c::main::b", "c::s::c"], [("c::main::b", "j", "c::s::c", "id", "inferred", 0.7)], False)], "node_id string, tables array<string>, steps array<struct<a:string,ac:string,b:string,bc:string,kind:string,conf:double>>, stale boolean")
    out["Cluster"], out["IN_CLUSTER"] = graph.cluster_nodes("c", spark.createDataFrame([("k", "K", graph.HEURISTIC, 0.5, "erd", 2)], "cluster string, label string, description string, cohesion double, pattern string, n_tables long"), spark.createDataFrame([("k", "a"), ("k", "b")], "cluster string, table_name string"))
    return out


def test_nested_columns_hang_on_their_parents(g):
    assert g["HAS_COLUMN"].count() == 5 and [(r.src, r.dst) for r in g["HAS_SUBCOLUMN"].collect()] == [("c::main::b::j", "c::main::b::j.x")]
    assert [r.column_name for r in graph.columns_of(g, "c::main::b").collect()] == ["id", "j"]


def test_one_edge_for_each_id(g):
    assert [(r.confidence, r.reasoning) for r in g["INFERRED_JOIN"].collect()] == [(0.7, "more")]
    assert [(r.src, r.dst, r.confidence) for r in g["LINEAGE"].collect()] == [("c::main::a", "c::main::b", 1.0)]
    assert {r.node_id for r in g["SchemaTable"].collect()} == {"c::main::a", "c::main::b", "c::s::c"}


def test_deleting_a_column_takes_what_is_over_it(g):
    out, counts = graph.delete_column(g, "c::main::b::j")
    assert {r.label: r.n for r in counts.collect()} == {"FK_REFERENCES": 0, "INFERRED_JOIN": 1, "JoinPath": 1}
    assert out["INFERRED_JOIN"].count() == 0 and out["JoinPath"].count() == 1 and out["HAS_SUBCOLUMN"].count() == 0
    assert "j.x" not in [r.column_name for r in out["SchemaColumn"].collect()] or out["SchemaColumn"].where("column_name = 'j'").count() == 0


def test_deleting_a_table_takes_its_paths(g):
    out = graph.delete_table(g, "c::s::c")
    assert out["JoinPath"].count() == 1 and out["SchemaTable"].count() == 2 and out["INFERRED_JOIN"].count() == 0
    assert graph.delete_foreign_key(g, g["FK_REFERENCES"].first().edge_id)["FK_REFERENCES"].count() == 0


def test_changes_make_paths_and_clusters_stale(g, spark):
    changed = spark.createDataFrame([("c::main::a",)], "node_id string")
    assert {r.node_id: r.stale for r in graph.mark_stale(g["JoinPath"], changed).collect()} == {"p1": True, "p2": False}
    out = graph.remove_from_clusters(g, changed)
    assert [r.src for r in out["IN_CLUSTER"].collect()] == ["c::main::b"] and out["Cluster"].first().stale


def test_clearing(g):
    left = graph.clear_intelligence(g)
    assert left["INFERRED_JOIN"].count() == left["Cluster"].count() == left["JoinPath"].count() == 0 and left["SchemaTable"].count() == 3
    assert graph.clear_lineage(g, "c", ("VIEW",))["LINEAGE"].count() == 0 and graph.clear_lineage(g, "other")["LINEAGE"].count() == 1
    none = graph.clear_connection(g, "c")
    assert none["SchemaTable"].count() == none["FK_REFERENCES"].count() == none["HAS_COLUMN"].count() == 0
    assert graph.clear_connection(g, "d")["SchemaTable"].count() == 3


def test_names_and_visible_nodes(g, spark):
    assert sorted(r.qualified for r in graph.shown_name(g["SchemaTable"].withColumn("schema_name", F.lit("main"))).collect()) == ["main.a", "main.b", "s.c"]
    ids = spark.createDataFrame([("c::main::a",), ("c::main::a::id",), ("c::x::y",)], "node_id string")
    assert [r.node_id for r in graph.node_visible(ids, g["SchemaTable"]).collect()] == ["c::main::a"]


def test_store_versions(g, spark, tmp_path):
    store = graph.GraphStore(spark, f"file://{tmp_path}/g")
    assert store.versions() == []
    with pytest.raises(FileNotFoundError):
        store.read()
    assert store.write(g) == 1 and store.write({"SchemaTable": g["SchemaTable"]}) == 2 and store.versions() == [1, 2]
    assert list(store.read()) == ["SchemaTable"] and set(store.read(1)) == set(g)
    store.keep(1)
    assert store.versions() == [2]
    store.close()
    assert not spark.catalog.tableExists("SchemaTable")


def test_registry(spark, tmp_path):
    at = f"file://{tmp_path}/registry.json"
    r = graph.Registry.load(spark, at)
    r.upsert("one", database="d", version=1)
    r.upsert("two", database="e")
    assert not r.update("three", version=2) and r.update("two", version=5)
    r.save(spark, at)
    back = graph.Registry.load(spark, at)
    assert back.get("d") == {"database": "d", "version": 1} and back.get("nope") is None and [k for k, _ in back.list()] == ["one", "two"]


def test_links_keep_decisions(spark):
    kind = "edge_id string, src string, dst string, status string, score double, confirmed_by string, confirmed_at string"
    old = spark.createDataFrame([("a~b", "a", "b", "suggested", 0.6, None, None)], kind)
    old = entities.decide_link(old, "a~b", "confirmed", "me", "now")
    new = spark.createDataFrame([("b", "a", "suggested", 0.9, None, None), ("c", "d", "suggested", 0.7, None, None)], "src string, dst string, status string, score double, confirmed_by string, confirmed_at string")
    got = {r.edge_id: (r.status, r.score, r.confirmed_by) for r in entities.merge_links(old, new).collect()}
    assert got == {"a~b": ("confirmed", 0.6, "me"), "c~d": ("suggested", 0.7, None)}
    assert entities.delete_link(old, "a~b").count() == 0
    names = spark.createDataFrame([("a", "A", "x"), ("b", "B", "y")], "node_id string, name string, connection_name string")
    assert [(r.src_name, r.dst_connection) for r in entities.top_links(old, names).collect()] == [("A", "y")]
    assert {r.status: r.n for r in entities.count_links(old).collect()} == {"confirmed": 1}


def test_entities_from_roles(spark):
    roles = spark.createDataFrame([("dim_shop_floor", "dimension"), ("tmp_x", "staging")], "table_name string, role string")
    nodes, edges = entities.build("c", entities.from_roles(roles), roles.select("table_name"))
    assert [(r.node_id, r["name"]) for r in nodes.collect()] == [("c::entity::shop floor", "Shop Floor")] and edges.count() == 1
    refs = spark.createDataFrame([("e", "T"), ("e", "S.T"), ("e", "nope")], "entity string, ref string")
    found = {r.ref: r.table_name for r in entities.resolved(refs, spark.createDataFrame([("r.t",), ("s.t",)], "table_name string")).collect()}
    assert found == {"T": "r.t", "S.T": "s.t"}
    assert spark.range(1).select(entities.entity_text(F.lit("Shop"), F.array(F.lit("a"), F.lit("b")))).first()[0] == "Shop: a, b"


def test_steps_run_in_order():
    seen = []
    step = lambda n, *after: steps.Step(n, lambda c: seen.append(n), tuple(after))
    r = steps.Runner().add(step("d", "b", "c")).add(step("b", "a")).add(step("c", "a")).add(step("a"))
    r.run({})
    assert seen == ["a", "b", "c", "d"]
    seen.clear()
    r.run({}, only=["c"])
    assert seen == ["c"]
    with pytest.raises(steps.StepError, match="unknown"):
        steps.Runner().add(step("x", "y")).order()
    with pytest.raises(steps.StepError, match="each other"):
        steps.Runner().add(step("x", "y")).add(step("y", "x")).order()
    with pytest.raises(steps.StepError, match="already"):
        steps.Runner().add(step("x")).add(step("x"))


def test_communities_are_better_than_one_and_than_none():
    import itertools

    cliques = [[f"{c}{i}" for i in range(5)] for c in "abc"]
    pairs = [(x, y, 1.0) for c in cliques for x, y in itertools.combinations(c, 2)] + [("a0", "b0", 0.2), ("b1", "c1", 0.2)]
    names = [n for c in cliques for n in c]
    got = cluster.communities_of(names, pairs)
    groups = [{n for n in names if got[n] == k} for k in set(got.values())]
    assert sorted(map(sorted, groups)) == sorted(map(sorted, cliques))
    q = cluster.modularity(groups, pairs)
    assert q > cluster.modularity([set(names)], pairs) and q > cluster.modularity([{n} for n in names], pairs)
    assert cluster.communities_of(["x", "y"], []) == {"x": 0, "y": 0}


def test_redaction_reaches_lists_and_structs(spark):
    df = spark.createDataFrame([("n", ["h", "x"], ("h", 1)), ("h", ["x"], ("x", 2))], "node_id string, l array<string>, s struct<a:string,b:int>")
    got = redact(df, spark.createDataFrame([("h",)], "node_id string"), ["node_id"]).collect()
    assert [(r.node_id, r.l, r.s.a, r.s.b) for r in got] == [("n", [None, "x"], None, 1)]


def test_patched_graph(spark):
    T, C = "table_name string, table_type string, row_count long", "table_name string, column_name string, data_type string, nullable boolean, ordinal int, parent string"
    none = lambda s: spark.createDataFrame([], s)

    def snap(tables, columns, keys):
        f = {"tables": spark.createDataFrame(tables, T), "columns": spark.createDataFrame(columns, C), "foreign_keys": spark.createDataFrame(keys, FK) if keys else none(FK), "lineage": none(snapshot.LINEAGE), "grants": none(snapshot.GRANTS)}
        return snapshot.Snapshot("c", "", "parquet", **{k: snapshot.shaped(v, snapshot.SHAPES[k]) for k, v in f.items()})

    old = snap([("a", "table", 1), ("b", "table", 2)], [("a", "id", "int", False, 1, None), ("a", "b_id", "int", True, 2, None), ("b", "id", "int", False, 1, None)], [("a", "b_id", "b", "id")])
    new = snap([("a", "table", 9), ("d", "table", 3)], [("a", "id", "long", False, 1, None), ("a", "x", "int", True, 2, None), ("d", "id", "int", False, 1, None)], [("d", "id", "a", "id")])
    changes = drift.diff(old, new)
    assert {(r.target, r.change_type, r.table_name, r.column_name) for r in changes.collect()} == {("table", "modified", "a", None), ("table", "removed", "b", None), ("table", "added", "d", None), ("column", "modified", "a", "id"), ("column", "added", "a", "x"), ("column", "removed", "a", "b_id")}
    stored = graph.build("c", old.tables, old.columns, old.foreign_keys, old.lineage)
    stored["SchemaTable"] = stored["SchemaTable"].withColumn("role", F.lit("fact"))
    same, counts = drift.patch_graph(stored, new, changes, dry_run=True)
    assert set(same) == set(stored) and counts["tables_added"] == counts["tables_removed"] == counts["columns_removed"] == counts["columns_updated"] == counts["fk_edges_removed"] == counts["foreign_keys_synced"] == 1 and counts["columns_added"] == 2
    out, _ = drift.patch_graph(stored, new, changes)
    assert {(r.table_name, r.row_count, r.role) for r in out["SchemaTable"].collect()} == {("a", 9, "fact"), ("d", 3, None)}
    assert {r.node_id for r in out["SchemaColumn"].collect()} == {"c::main::a::id", "c::main::a::x", "c::main::d::id"}
    assert [(r.src, r.dst) for r in out["FK_REFERENCES"].collect()] == [("c::main::d", "c::main::a")]
    assert drift.summary(changes) == "columns added: 1; columns modified: 1; columns removed: 1; tables added: 1; tables modified: 1; tables removed: 1"


def test_more_scalars(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(S.identifier_terms(F.lit("Sales"), F.lit("OrderLines"))) == "Sales.OrderLines Sales OrderLines order lines"
    assert one(S.first_tokens(F.lit(" a b  c d"), 3)) == "a b c"
    assert one(S.without_fence(F.lit("```json\n[1]\n```"))) == "[1]"
    assert [r.x for r in one(S.answered_rows(F.lit('Sure: ```[{"x": 1}, {"x": 2}]``` done'), "struct<x:int>"))] == [1, 2] and one(S.answered_rows(F.lit("none"), "struct<x:int>")) == []
    assert one(S.title_case(F.lit("order_lines"))) == "Order Lines"
    assert one(S.iso_time(F.lit("2024-05-06 07:08:09").cast("timestamp"))) == "2024-05-06T07:08:09Z"
    with pytest.raises(Exception, match="vectors of 1 and 2"):
        one(S.cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0))))


def node_frame(spark, rows):
    return spark.createDataFrame(rows, "node_id string, name string, tags array<string>")


def test_an_upsert_writes_what_has_changed(spark, tmp_path):
    rows = [(f"n{i:04}", f"name {i}", [str(i % 3)]) for i in range(1000)]
    edges = spark.createDataFrame([(f"n{i:04}", f"n{i + 1:04}") for i in range(999)], "src string, dst string")
    store = graph.GraphStore(spark, str(tmp_path / "g"))
    store.write({"SchemaTable": node_frame(spark, rows), "HAS_COLUMN": edges})
    now = {r[0]: r for r in rows}
    for step in range(1, 4):
        now |= {f"n{i:04}": (f"n{i:04}", f"changed {step}", None) for i in range(step * 7, step * 7 + 8)}
        now[f"new{step}"] = (f"new{step}", "x", [])
        now.pop(f"n{900 + step:04}")
        new = graph.upsert(store.read()["SchemaTable"], node_frame(spark, list(now.values())), "node_id").join(node_frame(spark, list(now.values())).select("node_id"), "node_id", "left_semi")
        v = store.write({"SchemaTable": new, "HAS_COLUMN": edges}, since=step)
        parts = store.parts(v)
        assert parts["HAS_COLUMN"] == ["v=1/HAS_COLUMN"] and len(parts["SchemaTable"]) == step + 1
        assert spark.read.parquet(f"{store.path}/{parts['SchemaTable'][-1]}").count() == 10
        got = {r.node_id: tuple(r) for r in store.read()["SchemaTable"].collect()}
        assert got == now and store.read()["HAS_COLUMN"].count() == 999
    assert store.read(1)["SchemaTable"].count() == 1000 and {r.name for r in store.read(2)["SchemaTable"].where("node_id = 'n0007'").collect()} == {"changed 1"}
    store.keep(1)
    assert store.versions() == [4] and {r.node_id: tuple(r) for r in store.read()["SchemaTable"].collect()} == now


def test_large_changes_other_columns_and_repeated_keys_are_written_whole(spark, tmp_path, monkeypatch):
    store = graph.GraphStore(spark, str(tmp_path / "g"))
    rows = [(f"n{i}", "a", []) for i in range(20)]
    store.write({"Entity": node_frame(spark, rows)})
    most = store.write({"Entity": node_frame(spark, [(k, "b", t) for k, _, t in rows[:15]])}, since=1)
    assert store.parts(most)["Entity"] == ["v=2/Entity"]
    other = store.write({"Entity": node_frame(spark, rows).withColumn("more", F.lit(1))}, since=most)
    assert store.parts(other)["Entity"] == ["v=3/Entity"]
    twice = store.write({"Entity": node_frame(spark, rows + rows[:1]).withColumn("more", F.lit(1))}, since=other)
    assert store.parts(twice)["Entity"] == ["v=4/Entity"] and store.read()["Entity"].count() == 21
    monkeypatch.setattr(graph, "MOST_DELTAS", 2)
    for i in range(4):
        store.write({"Cluster": node_frame(spark, [(f"n{k}", f"x{i}" if k == i else "a", []) for k in range(20)])}, since=max(store.versions()) if i else None)
    assert [len(store.parts(v)["Cluster"]) for v in store.versions()[-4:]] == [1, 2, 3, 1]
    store.keep(0)
    assert store.versions() == []
