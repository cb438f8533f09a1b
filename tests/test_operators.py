"""Small cases whose results are known."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quarry.functions import scalars as S
from quarry.operators import classify, cluster, cypher, dbt, discover, drift, graph, paths, reach, search, semantic, visibility
from quarry.plans import sql_walk
from quarry.queries import LAYER, MANIFEST, PATTERN_KEYS
from quarry.sources import catalog

FK = "src_table string, src_column string, dst_table string, dst_column string"


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_scalars(spark):
    lit = F.lit
    assert one(spark, S.type_family(lit("VARCHAR(20)")), S.type_family(lit("timestamp_ntz")), S.type_family(lit("geometry"))) == ("string", "temporal", None)
    assert one(spark, S.types_compatible(lit("int"), lit("bigint")), S.types_compatible(lit("int"), lit("text")), S.types_compatible(lit("int"), lit("geometry"))) == (True, False, True)
    assert sorted(one(spark, S.plural_forms(lit("City")))[0]) == ["cities", "city", "citys"]
    assert sorted(one(spark, S.plural_forms(lit("box")))[0]) == ["box", "boxes", "boxs"]
    assert one(spark, S.identifier_tokens(lit("orderLine_Item_order")))[0] == ["order", "line", "item"]
    assert one(spark, S.snippet(lit("abcdefgh"), 6), S.snippet(lit("abc"), 6), S.quote_identifier(lit('a"b'))) == ("abc...", "abc", '"a""b"')
    assert one(spark, *S.split_qualified(lit("s.t.u")), *S.split_qualified(lit("t"))) == ("s", "t.u", None, "t")
    assert one(spark, S.edge_cost(lit(False), lit(1.0)), F.round(S.edge_cost(lit(True), lit(0.9)), 6), F.round(S.edge_cost(lit(True), lit(0.4)), 6)) == (1.0, 2.5, 2.8)
    assert one(spark, S.cosine(F.array(lit(1.0), lit(0.0)), F.array(lit(0.0), lit(0.0))))[0] == 0.0
    assert one(spark, S.slug(lit("Main"), lit("Order Lines"), lit("amt$")))[0] == "main_order_lines_amt"


@pytest.mark.parametrize(("pattern", "text", "hit"), [("a*", "abc", True), ("a?c", "abc", True), ("a.c", "abc", False), ("[ab]x", "bx", True), ("[!ab]x", "bx", False), ("*_tmp", "x_tmp2", False)])
def test_globs(spark, pattern, text, hit):
    assert one(spark, S.matches_glob(F.lit(text), [pattern]))[0] is hit


def edge_frame(spark, fks, inferred=()):
    f = catalog.foreign_keys(spark, fks) if fks else spark.createDataFrame([], FK)
    return paths.edges(f, spark.createDataFrame(list(inferred), FK + ", confidence double") if inferred else None)


def test_diamond_has_two_tied_paths(spark):
    e = edge_frame(spark, [("t0", "a", "t1", "id"), ("t0", "b", "t2", "id"), ("t1", "c", "t3", "id"), ("t2", "d", "t3", "id")])
    best = paths.ranked(paths.enumerate_paths(e, start="t0", goal="t3")).collect()
    assert [r.depth for r in best] == [2, 2] and all(r.tied and r.several for r in best)


def test_a_longer_declared_chain_beats_weak_guesses(spark):
    e = edge_frame(spark, [("a", "x", "b", "id"), ("b", "x", "c", "id"), ("c", "x", "d", "id")], [("a", "y", "m", "id", 0.4), ("m", "y", "d", "id", 0.4)])
    best = paths.ranked(paths.enumerate_paths(e, start="a", goal="d")).first()
    assert best.path == "a>b>c>d" and best.confidence == 1.0


def test_limits_on_kinds_and_guesses(spark):
    e = edge_frame(spark, [("z", "k", "y", "id")], [("a", "x", "b", "id", 0.9), ("b", "x", "c", "id", 0.9)])
    assert paths.enumerate_paths(e, start="a", goal="c", max_inferred=0).count() == 0
    assert paths.enumerate_paths(e, start="a", goal="c", kinds=("fk",)).count() == 0
    assert paths.enumerate_paths(e, start="a", goal="c").count() == 1


def test_top_k_in_order(spark):
    e = edge_frame(spark, [(s, c, t, "id") for c in "abc" for s, t in (("s", c), (c, "g"))])
    got = [r.path for r in paths.ranked(paths.enumerate_paths(e, start="s", goal="g"), 3).orderBy("rank").collect()]
    assert got == ["s>a>g", "s>b>g", "s>c>g"]


def test_reversed_steps_and_precomputed_pairs(spark):
    e = edge_frame(spark, [("a", "x", "b", "id")])
    r = paths.precompute(e).where("from_table = 'a'").select("hint", "path_id", "ambiguous", paths.sql_hint(paths.reverse_steps(F.col("steps"))).alias("back")).first()
    assert r.hint == "FROM a JOIN b ON a.x = b.id" and r.back == "FROM b JOIN a ON b.id = a.x" and r.path_id.startswith("a::b::") and not r.ambiguous


def test_composite_keys_give_one_edge_with_all_conditions(spark):
    k = paths.collapse_composite(spark.createDataFrame([("k", 2, "l", "s", "p", "s2"), ("k", 1, "l", "p", "p", "p2")], "constraint_name string, position int, " + FK))
    hint = paths.enumerate_paths(paths.edges(k), start="l", goal="p").select(paths.sql_hint(F.col("steps"))).first()[0]
    assert hint == "FROM l JOIN p ON l.p = p.p2 AND l.s = p.s2"


def test_paths_across_databases(spark):
    left = paths.enumerate_paths(edge_frame(spark, [("orders", "c", "customer", "id")]), start="orders", goal="customer")
    right = paths.enumerate_paths(edge_frame(spark, [("client", "r", "region", "id")]), start="client", goal="region")
    got = paths.across(left, spark.createDataFrame([("client", "customer", 0.8)], "a_table string, b_table string, score double"), right).first()
    assert tuple(got) == ("orders", "region", "customer~client", 3, 0.8)


def test_impact_buckets(spark):
    e = edge_frame(spark, [("a", "r", "root", "id")], [("b", "x", "a", "id", 0.3), ("c", "x", "b", "id", 0.2)])
    got = {r.table_name: (r.hop, r.bucket) for r in reach.impact(e, "root").collect()}
    assert got == {"a": (1, "direct"), "b": (2, "low_confidence"), "c": (3, "low_confidence")}
    assert reach.impact(e, "root", column="other").count() == 0


def test_discovery_rules(spark):
    rows = [("users", "id", "int", 1, True), ("orders", "id", "int", 1, True), ("orders", "user_id", "int", 2, False), ("orders", "ord_fk", "int", 3, False), ("users", "tenant_key", "int", 2, False), ("orders", "tenant_key", "text", 4, False)]
    c = discover.signal_defaults(spark.createDataFrame(rows, "table_name string, column_name string, data_type string, ordinal int, is_primary_key boolean"))
    got = {(r.src_table, r.src_column, r.dst_table): r.confidence for r in discover.discover(c, spark.createDataFrame([], FK)).collect()}
    assert got == {("orders", "user_id", "users"): 0.85}  # another type family, and never itself
    same = discover.same_name_candidates(c)
    assert {(r.src_table, r.dst_table) for r in same.collect()} == {("users", "orders"), ("orders", "users")}


def test_prefix_join_equals_the_naive_one(spark):
    """All words of the supplied documents as names of tables, and as stems."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    words = sorted({w.lower() for r in docs.select("text").collect() for w in (r.text or "").split() if w.isalpha() and w.isascii()})[::7][:1500]
    stems = sorted({w[:n] for w in words[::9] for n in (2, 3, len(w))})
    columns = [(w, "id", "long", 1, True) for w in words] + [(words[i % len(words)], f"{s}_id", "long", 2 + i, False) for i, s in enumerate(stems)]
    found = discover.naming_candidates(spark.createDataFrame(columns, "table_name string, column_name string, data_type string, ordinal int, is_primary_key boolean"))
    got = {(r.src_table, r.src_column): r.dst_table for r in found.where("confidence = 0.55").collect()}
    exact = {(r.src_table, r.src_column) for r in found.where("confidence = 0.85").collect()}
    want = {}
    for i, s in enumerate(stems):
        own = words[i % len(words)]
        hits = [w for w in words if w.startswith(s) and w != own] if len(s) > 1 else []
        if hits and (own, f"{s}_id") not in exact:
            want[own, f"{s}_id"] = min(hits, key=lambda w: (len(w), w))
    assert got == want and len(want) > 50


def test_scorers_have_unique_names():
    with pytest.raises(ValueError, match="registered"):
        discover.register_scorer("naming", discover.naming_candidates)


def test_shadow_aliases_and_degrees(spark):
    t = spark.createDataFrame([("v", "view"), ("w", "view"), ("a", "table"), ("b", "table")], "table_name string, table_type string")
    lineage = spark.createDataFrame([("a", "v"), ("a", "w"), ("b", "w")], "src_table string, dst_table string")
    assert [r[0] for r in classify.shadow_aliases(t, lineage).collect()] == ["v"]


def test_communities_are_a_partition_without_small_rests(spark):
    names = [f"t{i}" for i in range(8)]
    pairs = [("t0", "t1", 1.0), ("t1", "t2", 1.0), ("t0", "t2", 1.0), ("t3", "t4", 1.0), ("t4", "t5", 1.0), ("t3", "t5", 1.0), ("t5", "t6", 0.3)]
    got = cluster.communities_of(names, pairs)
    assert set(got) == set(names) and got["t0"] == got["t1"] == got["t2"] and got["t3"] == got["t4"] == got["t5"] != got["t0"]
    assert min(list(got.values()).count(c) for c in set(got.values())) >= 3
    m = spark.createDataFrame([(c, t) for t, c in got.items()], "cluster long, table_name string")
    p = spark.createDataFrame(pairs, "a string, b string, weight double")
    roles = spark.createDataFrame([("t1", "fact")], "table_name string, role string")
    assert "t1" in {r.anchor for r in cluster.labels(m, p, roles).collect()}
    assert all(0 <= r.cohesion <= 1 for r in cluster.cohesion(m, p).collect())


def test_diff_of_a_snapshot_with_itself_is_empty(spark):
    t = spark.createDataFrame([("a", None, 1)], "table_name string, comment string, row_count long")
    c = spark.createDataFrame([("a", "x", "int")], "table_name string, column_name string, data_type string")
    assert drift.diff_snapshots(t, t, c, c).count() == 0
    new = spark.createDataFrame([("a", "x", "text"), ("a", "y", "int")], "table_name string, column_name string, data_type string")
    assert {(r.change_type, r.column_name) for r in drift.diff_snapshots(t, t, c, new).collect()} == {("modified", "x"), ("added", "y")}
    patched, counts = drift.patch(c, new, ["table_name", "column_name"])
    assert sorted(map(tuple, patched.collect())) == sorted(map(tuple, new.collect()))
    assert {r.action: r.n for r in counts.collect()} == {"deleted": 0, "inserted": 1, "updated": 1}


def test_search_prefers_names_and_columns_of_the_query(spark):
    rows = [("berth", "berth", "where a ship lies", "harbour id berth number depth"), ("vessel", "vessel", "", "vessel id flag tonnage owner id"), ("owner", "owner", "", "owner id company name"), ("crew_list", "crew list", "who sails", "vessel id sailor id rank")]
    docs = spark.createDataFrame(rows, "table_name string, name string, description string, table_text string")
    for stem in (True, False):
        best = lambda q: search.search(docs, "table_name", q, 4, stem=stem).orderBy("rank").first().table_name  # noqa: B023, E731
        assert [best(q) for q in ("tonnage", "company owner", "sailor rank", "harbour depth")] == ["vessel", "owner", "crew_list", "berth"]
    assert search.search(docs, "table_name", "sailing", 4, stem=True).first().table_name == "crew_list"  # sails
    near = [r.table_name for r in search.similar(docs, "table_name", "vessel").collect()]
    assert "vessel" not in near and "crew_list" in near


@pytest.mark.parametrize(("word", "stem"), [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("hopping", "hop"), ("relating", "relat"), ("generalizations", "gener"), ("sized", "size"), ("electrical", "electr"), ("hopefulness", "hope"), ("controlling", "control"), ("happy", "happi"), ("sky", "sky")])
def test_stemmer(word, stem):
    assert search.porter(word) == stem


def test_semantic_layer():
    assert semantic.compile_metric(LAYER, "returned") == "SELECT count(*) AS `returned` FROM `lineitem` WHERE (l_returnflag = 'R') AND (l_quantity > 10)"
    assert LAYER.affected("orders") == ["customers", "net"] and LAYER.affected("lineitem", "l_quantity") == ["avg_quantity", "returned"]
    assert LAYER.validate({"lineitem": {"l_extendedprice", "l_quantity"}}) == ["order: no table orders"]
    with pytest.raises(KeyError):
        semantic.compile_metric(LAYER, "none")
    assert [m.name for m in semantic.metric_templates({"f": [("fee_amount", "double"), ("subtotal", "int"), ("note", "text"), ("weight", "double")], "d": [("amount", "int")]}, {"f": "fact", "d": "dimension"})] == ["sum_f_fee_amount", "sum_f_subtotal"]


def test_sql_walk(spark):
    assert sql_walk.table_references(spark, "WITH c AS (SELECT * FROM a) SELECT * FROM c JOIN s.b ON c.x = b.x WHERE EXISTS (SELECT 1 FROM d)", "main") == ["main.a", "main.d", "s.b"]
    assert sql_walk.write_targets(spark, "INSERT INTO t SELECT * FROM u") == ["t"]
    assert sql_walk.write_targets(spark, "DELETE FROM t WHERE x = 1") == ["t"]
    assert sql_walk.table_references(spark, "SELECT ((") == []
    r = sql_walk.validate(spark, "SELECT o.amont FROM orders o", {"orders": ["id", "amount"]}, set())
    assert not r.valid and r.missing_columns == ["o.amont"] and r.suggestions == ["o.amont: amount"]


def test_cypher(spark):
    g = graph.build("c", spark.createDataFrame([("a",), ("b",), ("x",)], "table_name string"), spark.createDataFrame([("a", "id", 1)], "table_name string, column_name string, ordinal int"), spark.createDataFrame([("a", "b_id", "b", "id"), ("a", "q", "gone", "id")], FK))
    assert g["FK_REFERENCES"].count() == 1  # the other end is not known
    left = cypher.query(g, "MATCH (t:SchemaTable) OPTIONAL MATCH (t)-[r:FK_REFERENCES]->(u:SchemaTable) RETURN t.table_name AS t, count(u.node_id) AS n ORDER BY n DESC, t LIMIT 2")
    assert [tuple(r) for r in left.collect()] == [("a", 1), ("b", 0)]
    either = cypher.query(g, "MATCH (t:SchemaTable {table_name: 'b'})-[:FK_REFERENCES|HAS_COLUMN]-(u:SchemaTable) RETURN u.table_name AS u")
    assert [r.u for r in either.collect()] == ["a"]
    for bad in ("MATCH (t:SchemaTable) DELETE t", "CREATE (t:SchemaTable)", "RETURN 1", "MATCH (t:Nope) RETURN t"):
        with pytest.raises(cypher.CypherError):
            cypher.query(g, bad).collect()
    for bad in ("CREATE TABLE z AS SELECT 1", "WITH x AS (SELECT 1 AS a) INSERT INTO t SELECT * FROM x", "FROM SchemaTable INSERT INTO a SELECT node_id INSERT INTO b SELECT node_id", "LOAD DATA INPATH '/x' INTO TABLE t", "CACHE TABLE t", "ANALYZE TABLE t COMPUTE STATISTICS", "REFRESH TABLE t", "DROP VIEW SchemaTable", "SET a = b", "TRUNCATE TABLE t", "ADD JAR '/x'", "USE other", "MERGE INTO t USING u ON t.a = u.a WHEN MATCHED THEN DELETE", "EXPLAIN SELECT 1"):
        with pytest.raises(cypher.CypherError):
            cypher.run_sql(spark, g, bad)
    fine = "WITH x AS (SELECT node_id, row_number() OVER (ORDER BY node_id) AS r FROM SchemaTable) SELECT count(*) AS n FROM x WHERE r IN (SELECT 1) OR EXISTS (SELECT 1 FROM HAS_COLUMN h WHERE h.src = x.node_id) UNION ALL SELECT explode(array(5)) AS n ORDER BY n LIMIT 3"
    assert [r.n for r in cypher.run_sql(spark, g, fine).collect()] == [1, 5]
    assert cypher.run_sql(spark, g, "SELECT count(*) AS n FROM SchemaTable").first().n == 3


def test_cypher_predicates_with_and_calls(spark):
    t = spark.createDataFrame([(x,) for x in "abcd"], "table_name string")
    g = graph.build("c", t, spark.createDataFrame([("a", "id", 1)], "table_name string, column_name string, ordinal int"), spark.createDataFrame([("a", "x", "b", "id"), ("a", "y", "c", "id"), ("b", "z", "c", "id")], FK))
    ask = lambda q, **p: [tuple(r) for r in cypher.query(g, q, p).collect()]
    assert ask("MATCH (t:SchemaTable) WHERE (t)-[:FK_REFERENCES]->() RETURN t.table_name AS n ORDER BY n") == [("a",), ("b",)]
    assert ask("MATCH (t:SchemaTable) WHERE NOT (t)-[:FK_REFERENCES]-(:SchemaTable) AND t.table_name <> 'z' RETURN t.table_name AS n") == [("d",)]
    assert ask("MATCH (s:SchemaTable)-[:FK_REFERENCES]->(m:SchemaTable) WHERE (m)-[:FK_REFERENCES]->(:SchemaTable {table_name: 'c'}) RETURN s.table_name AS s, m.table_name AS m") == [("a", "b")]
    assert ask("MATCH (s:SchemaTable)-[:FK_REFERENCES]->(m:SchemaTable) WITH s.table_name AS s, count(*) AS n WHERE n > 1 RETURN s, n") == [("a", 2)]
    assert ask("MATCH (s:SchemaTable)-[:FK_REFERENCES]->(m:SchemaTable) WITH s.table_name AS s, collect(m.table_name) AS ms RETURN s, list_distinct(list_concat(ms, ms)) AS both ORDER BY s LIMIT 1") == [("a", ["b", "c"])]
    assert ask("MATCH (t:SchemaTable) WHERE t.table_name STARTS WITH 'a' OR t.table_name IN ['b'] RETURN CASE WHEN t.table_name = $x THEN 1 ELSE 0 END AS f, COALESCE(t.table_name, '') AS n, CAST(1 AS STRING) AS one ORDER BY n", x="a") == [(1, "a", "1"), (0, "b", "1")]
    assert ("FK_REFERENCES", "REL") in ask("CALL show_tables() RETURN *") and (0, "node_id", "string") in ask("CALL table_info('SchemaTable')")
    with pytest.raises(cypher.CypherError):
        ask("CALL table_info('Nope')")


def test_closure_of_lattices_and_cycles(spark):
    rungs = [(f"{x}{i}", f"{y}{i + 1}") for i in range(40) for x in "ab" for y in "ab"]
    got = reach.closure(spark.createDataFrame([*rungs, ("a40", "a0"), ("a40", "a40")], "child string, parent string"))
    pairs = {tuple(r) for r in got.collect()}
    assert ("b0", "a40") in pairs and ("a3", "b2") in pairs and all(x != y for x, y in pairs)
    long = reach.closure(spark.createDataFrame([(i, i + 1) for i in range(90)], "child long, parent long"))
    assert long.where("child = 0").count() == 90


def test_closure_takes_rounds_by_the_digits_of_the_longest_way(spark, monkeypatch):
    written, write = [], reach.checkpointed
    monkeypatch.setattr(reach, "checkpointed", lambda df: written.append(1) or write(df))
    chain = [(i, i + 1) for i in range(20)]
    got = {tuple(r) for r in reach.closure(spark.createDataFrame([*chain, (3, 9), (9, 4)], "child long, parent long")).collect()}
    assert {(0, 20), (9, 4), (9, 3), (8, 4)} - got == {(9, 3)} and len(written) <= 7


def test_graph_store_cascade_and_registry(spark, tmp_path):
    g = graph.build("c", spark.createDataFrame([("a",), ("b",)], "table_name string"), spark.createDataFrame([("a", "id", 1), ("b", "id", 1)], "table_name string, column_name string, ordinal int"), spark.createDataFrame([("a", "b_id", "b", "id")], FK))
    store = graph.GraphStore(spark, f"file://{tmp_path}/g")
    store.write(g, 1)
    back = store.read(1, tuple(g))
    assert {k: v.count() for k, v in back.items()} == {"SchemaTable": 2, "SchemaColumn": 2, "HAS_COLUMN": 2, "FK_REFERENCES": 1}
    left = graph.delete_table(back, "c::main::a")
    assert {k: v.count() for k, v in left.items()} == {"SchemaTable": 1, "SchemaColumn": 1, "HAS_COLUMN": 1, "FK_REFERENCES": 0}
    p = spark.createDataFrame([("p1", ["x", "y"], None), ("p2", ["z"], None)], "node_id string, tables array<string>, stale boolean")
    assert sorted(r.stale for r in graph.mark_stale(p, spark.createDataFrame([("y",)], "node_id string")).collect()) == [False, True]
    r = graph.Registry()
    r.upsert("one", dialect="parquet")
    assert graph.Registry(r.dumps()).get("one") == {"dialect": "parquet"} and r.remove("one") and not r.remove("one")


def test_dbt(spark):
    m = dbt.Manifest.parse(spark, MANIFEST)
    t = spark.createDataFrame([("marts.fct_orders", "", ["x"]), ("raw.raw_orders", "kept", None)], "table_name string, description string, tags array<string>")
    got = {r.table_name: (r.description, r.tags) for r in dbt.enrich(t, m).collect()}
    assert got == {"marts.fct_orders": ("Orders", ["core", "x"]), "raw.raw_orders": ("kept", [])}
    f = dbt.freshness(spark.createDataFrame([("source.p.raw.o", "warn"), ("source.p.raw.o", "skipped")], "unique_id string, status string"), m)
    assert [tuple(r) for r in f.collect()] == [("raw.raw_orders", "warn", None)]


def test_visibility(spark):
    rows = spark.createDataFrame([("c", "s", "users", "id"), ("c", "s", "users_tmp", "id"), ("c", "t", "users", "id")], "connection string, schema_name string, table_name string, column_name string")
    see = lambda **k: sorted((r.schema_name, r.table_name) for r in visibility.visible_columns(visibility.Profile(**k), rows).collect())
    assert see(allowed_tables=("c::s::users",)) == [("s", "users")] and see(hidden_tables=("s.*",)) == [("t", "users")]
    assert see(allowed_schemas=("s",), hidden_tables=("*_tmp",)) == [("s", "users")] and see(hidden_columns=("s.users.id", "users_tmp.id")) == [("t", "users")]
    hidden = spark.createDataFrame([("c::s::users",)], "node_id string")
    out = visibility.redact(spark.createDataFrame([("c::s::users", "x"), ("c::t::users", "c::s::users"), ("c::t::users", "y")], "node_id string, seen string"), hidden, ["node_id"])
    assert sorted((r.seen is None, r.seen) for r in out.collect()) == [(False, "y"), (True, None)]


def test_catalog_walks_nested_fields(spark):
    df = spark.createDataFrame([], "a int, s struct<x:int, y:array<struct<z:string>>>")
    assert [(c[0], c[4], c[5]) for c in catalog.walk(df.schema)] == [("a", None, False), ("s", None, False), ("s.x", "s", False), ("s.y", "s", True), ("s.y.z", "s.y", False)]
    with pytest.raises(ValueError, match="unknown dialect"):
        catalog.get_source("oracle7", spark, "")


def test_patterns_and_entry(spark):
    assert len(PATTERN_KEYS) == 7
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
