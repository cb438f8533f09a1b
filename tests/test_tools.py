import pytest

from quarry import tools
from quarry.operators.visibility import Profile
from quarry.queries import LAYER
from quarry.sources import catalog, dsn, warehouse

DATA = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "orders", "lineitem")


@pytest.fixture(scope="module")
def w(spark):
    return tools.Workspace(spark, "db", catalog.ParquetSource(spark, DATA, TABLES), LAYER)


def test_every_tool_answers(w, spark):
    assert tools.call(w, "list_databases")["databases"][0]["tables"] == 5
    assert "FK_REFERENCES" in tools.call(w, "schema")["labels"]
    assert tools.call(w, "query", q="nation name")["hits"][0]["table_name"] == "nation"
    full = tools.call(w, "context", table="NATION", detail="full")
    assert full["table"] == "nation" and [c["column_name"] for c in full["columns"]][0] == "n_nationkey" and full["profile"]
    best = tools.call(w, "traverse", from_table="lineitem", to_table="region")["paths"][0]
    assert best["path"] == "lineitem>orders>customer>nation>region" and best["sql_hint"].startswith("FROM lineitem JOIN orders ON")
    assert tools.call(w, "impact", table="region")["total_affected"] == 3
    assert tools.call(w, "compile_metric", metric="customers")["validation"]["valid"]
    assert tools.call(w, "cypher", text="MATCH (t:SchemaTable) RETURN count(*) AS n", timeout=60)["rows"] == [{"n": 5}]
    assert "error" in tools.call(w, "cypher", text="MATCH (t:SchemaTable) DELETE t")
    assert tools.call(w, "travers")["suggestions"] == ["traverse"]
    assert tools.call(w, "context", table="natoin") == {"error": "table 'natoin' is unknown", "suggestions": ["nation"]}
    less = tools.Workspace(spark, "db", catalog.ParquetSource(spark, DATA, TABLES[1:]))
    got = tools.call(w, "detect_changes", before=less)
    # without region, nation's column is no foreign key
    assert [(c["target"], c["change_type"], c["table_name"]) for c in got["changes"]] == [("column", "modified", "nation"), ("table", "added", "region")]
    assert "| nation |" in tools.overview(w)


def test_hidden_tables_never_appear(spark):
    w = tools.Workspace(spark, "db", catalog.ParquetSource(spark, DATA, TABLES), profile=Profile(hidden_tables=("nat*",)))
    assert "nation" not in w.names() and "error" in tools.call(w, "context", table="nation")
    assert "error" in tools.call(w, "traverse", from_table="customer", to_table="region")


def test_addresses():
    a = dsn.parse("postgresql://me:p%40w@host/db?sslmode=on")
    assert (a.dialect, a.host, a.port, a.database, a.user, a.password) == ("postgres", "host", 5432, "db", "me", "p@w")
    assert a.jdbc() == "jdbc:postgresql://host:5432/db" and "p%40w" not in a.text() and dsn.parse(a.text(True)) == a
    s = dsn.parse("snowflake://u:p@acct/DB/PUBLIC?warehouse=w")
    assert (s.database, s.schema, s.options) == ("DB", "PUBLIC", (("warehouse", "w"),))
    assert dsn.parse("bigquery://proj/data").schema == "data" and dsn.parse("/a/b").dialect == "parquet"
    for bad in ("", "mysql://h/d", "postgres://h"):
        with pytest.raises(ValueError):
            dsn.parse(bad)
    assert dsn.interpolate("${A}-${B:-x}", {"A": "1"}) == "1-x"
    with pytest.raises(KeyError):
        dsn.interpolate("${NOPE}", {})


def test_literals():
    assert dsn.parse_array_literal('{a,"b,c","d\\"e",NULL,}') == ["a", "b,c", 'd"e', None]
    assert dsn.parse_array_literal(None) == dsn.parse_array_literal("{}") == []
    assert dsn.parse_qualified('"DB"."S"."T.x"', "db") == ("S", "T.x") and dsn.parse_qualified("db.s.t", "other") is None


def test_merged_grants_keep_other_settings():
    before = {"old": {"allowed_tables": ["x"]}, "mixed": {"allowed_tables": ["x"], "hidden_columns": ["c"]}, "new": {"hidden_tables": ["h"]}}
    got = warehouse.merge_grants(before, {"new": ["a", "b"], "empty": []})
    assert got == {"mixed": before["mixed"], "new": {"hidden_tables": ["h"], "allowed_tables": ["a", "b"]}}
    assert warehouse.merge_grants(before, {"new": ["a"]}, {"mixed"}) == before | {"mixed": {"hidden_columns": ["c"]}}


def test_overlay_prefers_the_catalog(spark):
    c = spark.createDataFrame([("a", "x", None, 5), ("a", "y", 1.5, None)], "table_name string, column_name string, null_pct double, distinct_count long")
    s = spark.createDataFrame([("a", "x", 9.0, 7, "m"), ("a", "y", 9.0, 7, "n")], "table_name string, column_name string, null_pct double, distinct_count long, top string")
    got = {r.column_name: (r.null_pct, r.distinct_count, r.top) for r in warehouse.overlay(c, s).collect()}
    assert got == {"x": (9.0, 5, "m"), "y": (1.5, 7, "n")}
