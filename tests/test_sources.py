"""Live catalogs over recorded system views."""

import re

import pytest
from pyspark.sql import functions as F

from quarry import catalog_queries
from quarry.plans import sql_walk
from quarry.sources import bigquery, postgres, reader, snapshot, snowflake

DATA = "/root/testdata/sf0.001"
T = "timestamp"


@pytest.fixture(scope="module")
def pg(spark):
    return postgres.PostgresSource(catalog_queries.recorded_postgres(spark, DATA))


def test_postgres_tables_and_keys(pg):
    got = {r.table_name: (r.table_type, r.comment, r.row_count) for r in pg.tables().collect()}
    assert got["region"] == ("table", "parts of the world", 1000) and got["events"][0] == "partitioned_table" and "pg_class" not in got
    assert {(r.table_name, r.column_name) for r in pg.primary_keys().collect()} >= {("region", "r_regionkey"), ("orders", "o_orderkey")}
    checks = {(r.table_name, r.column_name): r.check_constraints for r in pg.check_constraints().collect()}
    assert checks == {("part", "p_size"): ["CHECK (p_size < p_retailprice)", "CHECK (p_size > 0)"], ("part", "p_retailprice"): ["CHECK (p_size < p_retailprice)"]}
    assert {r.comment for r in pg.columns().where("comment IS NOT NULL").collect()} == {"as people say it"}
    assert {(r.table_name, r.index_type, r.index_unique) for r in pg.best_indexes().where("table_name = 'part'").collect()} == {("part", "btree", True)}


def test_postgres_facts_and_statistics(pg):
    facts = {r.table_name: r for r in pg.table_facts().collect()}
    assert (facts["orders"].seq_scan_count, facts["orders"].delete_count) == (7, 1) and facts["region"].seq_scan_count is None
    assert facts["events"].is_partitioned and facts["events"].partition_key == "RANGE (ts)" and [g.grantee for g in facts["part"].grants] == ["PUBLIC", "staff"]
    stats = {(r.table_name, r.column_name): r for r in pg.column_statistics().collect()}
    assert stats["orders", "o_custkey"].distinct_count == 100 and stats["orders", "o_custkey"].null_pct == 25.0 and stats["orders", "o_orderstatus"].mcv == ["O", "F", "P"]
    assert stats["region", "r_regionkey"].index_unique


def test_postgres_lineage(pg):
    got = {(r.src_table, r.dst_table, r.lineage_type, r.confidence) for r in pg.lineage().collect()}
    assert got == {("public.orders", "public.v_orders", "VIEW", 1.0), ("public.customer", "public.v_orders", "VIEW", 1.0), ("public.nation", "public.m_geo", "MATERIALIZED_VIEW", 1.0), ("public.orders", "public.events", "TRIGGER", 0.85), ("public.orders", "public.labels", "TRIGGER", 0.85)}


def test_postgres_view_counts(pg, spark):
    assert pg.count_view("public", "region") == (5, None)
    n, why = pg.count_view("public", "gone")
    assert n == -1 and why.startswith("view_error")

    class Slow(reader.RecordedReader):
        def view(self, name):
            from pyspark.sql.functions import udf

            nap = udf(lambda x: __import__("time").sleep(2) or x, "long")
            return spark.range(0, 40, 1, 4).select(nap("id").alias("id")).where("id >= 0")

    assert postgres.PostgresSource(Slow(spark, {})).count_view("public", "x", 300) == (-1, "view_timeout")


def test_postgres_schemas(spark):
    r = catalog_queries.recorded_postgres(spark, DATA)
    assert postgres.PostgresSource(r, include=("other",)).tables().count() == 0 and postgres.PostgresSource(r, exclude=("public",)).tables().count() == 0


def test_snapshot_of_a_database(pg):
    snap = snapshot.inspect(pg, "db", "shop")
    row = {r.table_name: r for r in snap.tables.collect()}["public.orders"]
    assert row.seq_scan_count == 7 and row.row_count == 1000 and snap.notes == []
    cols = {(r.table_name, r.column_name): r for r in snap.columns.collect()}
    assert cols["public.orders", "o_custkey"].is_foreign_key and cols["public.orders", "o_custkey"].distinct_count == 100 and cols["public.region", "r_regionkey"].index_unique
    assert snap.foreign_keys.where("src_table = 'public.orders' AND dst_table = 'public.customer'").count() == 1 and snap.grants.count() == 5


# Columns of PostgreSQL's system catalogs and views, as its manual lists them.
SYSTEM_COLUMNS = {
    "pg_class": "oid relname relnamespace reltype relowner relam reltuples relpages relkind relispartition", "pg_namespace": "oid nspname nspowner nspacl",
    "pg_attribute": "attrelid attname atttypid attnum attnotnull attisdropped", "pg_description": "objoid classoid objsubid description",
    "pg_index": "indexrelid indrelid indnatts indisunique indisprimary indisvalid indkey indclass", "pg_am": "oid amname amhandler amtype",
    "pg_constraint": "oid conname connamespace contype conrelid confrelid conkey confkey conbin", "pg_stat_user_tables": "relid schemaname relname seq_scan seq_tup_read idx_scan idx_tup_fetch n_tup_ins n_tup_upd n_tup_del n_live_tup",
    "pg_partitioned_table": "partrelid partstrat partnatts partdefid partattrs partclass partexprs", "pg_stats": "schemaname tablename attname inherited null_frac avg_width n_distinct most_common_vals most_common_freqs histogram_bounds correlation",
    "pg_views": "schemaname viewname viewowner definition", "pg_matviews": "schemaname matviewname matviewowner definition", "pg_trigger": "oid tgrelid tgname tgfoid tgtype tgenabled tgisinternal",
    "pg_proc": "oid proname pronamespace prolang prosrc", "pg_language": "oid lanname lanowner", "pg_roles": "oid rolname rolsuper", "pg_auth_members": "roleid member grantor admin_option",
}


@pytest.mark.parametrize("name", sorted(postgres.STATEMENTS))
def test_statements_name_real_columns_only(name):
    text = postgres.STATEMENTS[name]
    views = {alias: view for view, alias in re.findall(r"pg_catalog\.(pg_\w+) (\w+)", text) if view in SYSTEM_COLUMNS}
    assert views
    used = {(a, c) for a, c in re.findall(r"\b([a-z])\.(\w+)", text)}
    assert used and all(c in SYSTEM_COLUMNS[views[a]].split() if a in views else (a, c) == ("k", "attnum") for a, c in used)


def test_recorded_answers_have_the_columns_of_their_statements(spark):
    r = catalog_queries.recorded_postgres(spark, DATA)
    for text in postgres.STATEMENTS.values():
        # the last word of each item of the select list
        head = text[len("SELECT ") : text.index(" FROM ")]
        assert r.sql(text).columns == [re.search(r"AS (\w+)$", item).group(1) for item in re.split(r", (?![^(]*\))", head)]


def test_array_texts(pg):
    stats = {r.column_name: r for r in pg.column_statistics().where("table_name = 'orders'").collect()}
    assert stats["o_custkey"].histogram == ["1", "9", "a, b"] and stats["o_custkey"].mcv is None


def test_every_part_that_fails_is_noted(spark):
    r = catalog_queries.recorded_postgres(spark, DATA)
    for gone in ("checks", "comments", "index_columns", "partitions"):
        del r.answers[postgres.STATEMENTS[gone]]
    del r.views["information_schema.referential_constraints"]
    snap = snapshot.inspect(postgres.PostgresSource(r), "db", statistics=False)
    assert snap.columns.count() > 40 and snap.foreign_keys.count() == 0 and not snap.columns.where("is_foreign_key").count()
    assert {n.split(":")[0] for n in snap.notes} >= {"check constraints", "column comments", "indexed columns", "partition keys", "foreign keys"}


def test_tables_of_a_database_are_read_in_parts(spark, tmp_path):
    """Over JDBC, from a database that the test itself runs."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    data = spark.range(0, 5000).selectExpr("id AS id", "id % 7 AS k", "concat('t', id) AS t")
    data.write.format("jdbc").options(url=url, dbtable="APP.SHIPS", driver="org.apache.derby.jdbc.EmbeddedDriver").save()
    db = reader.JdbcReader(spark, url, driver="org.apache.derby.jdbc.EmbeddedDriver")
    parts = db.table("APP.SHIPS")
    assert parts.count() == 5000 and parts.rdd.getNumPartitions() == 1
    quoted = db.table("(SELECT \"id\" AS ID, \"k\" AS K, \"t\" AS T FROM APP.SHIPS) S", "ID", 1000)
    assert quoted.rdd.getNumPartitions() == 5 and quoted.count() == 5000 and quoted.distinct().count() == 5000
    assert {r.n for r in quoted.groupBy("K").count().withColumnRenamed("count", "n").collect()} <= {714, 715}
    assert db.table("(SELECT \"t\" AS T FROM APP.SHIPS) S", "T", 10).rdd.getNumPartitions() == 1


@pytest.mark.parametrize(("script", "n"), [("a; b", 2), ("SELECT ';'; SELECT 1;", 2), ("INSERT INTO x VALUES ('it''s; so')", 1), ("-- a; b\nSELECT 1; /* ; */ SELECT 2", 2), ("SELECT \"a;b\" FROM t", 1), ("DO $x$ a; b $x$; c", 2), (" ; ", 0), ("SELECT 'open; text", 2)])
def test_scripts_are_cut_at_their_own_semicolons(script, n):
    assert len(sql_walk.statements(script)) == n


def test_a_failing_view_hides_nothing_else(spark):
    r = catalog_queries.recorded_postgres(spark, DATA)
    for gone in ("stats", "matviews", "memberships"):
        del r.answers[postgres.STATEMENTS[gone]]
    snap = snapshot.inspect(postgres.PostgresSource(r), "db", statistics=False)
    assert snap.tables.count() == 13 and snap.lineage.count() == 0 and sorted(n.split(":")[0] for n in snap.notes) == ["column statistics", "grants", "lineage"]


@pytest.fixture(scope="module")
def snow(spark):
    f = spark.createDataFrame
    views = {
        "INFORMATION_SCHEMA.TABLES": f([("PUB", "A", "BASE TABLE", "aa", 5, 100, "LINEAR(x)"), ("PUB", "V", "VIEW", None, None, None, None), ("PUB", "B", "EXTERNAL TABLE", None, 0, 0, None), ("INFORMATION_SCHEMA", "Z", "VIEW", None, None, None, None)], "TABLE_SCHEMA string, TABLE_NAME string, TABLE_TYPE string, COMMENT string, ROW_COUNT long, BYTES long, CLUSTERING_KEY string"),
        "INFORMATION_SCHEMA.COLUMNS": f([("PUB", "A", "ID", "NUMBER", "NO", None, 1, "the id"), ("PUB", "B", "A_ID", "NUMBER", "YES", None, 1, None)], "TABLE_SCHEMA string, TABLE_NAME string, COLUMN_NAME string, DATA_TYPE string, IS_NULLABLE string, COLUMN_DEFAULT string, ORDINAL_POSITION int, COMMENT string"),
        "INFORMATION_SCHEMA.VIEWS": f([("PUB", "V", "CREATE VIEW V AS SELECT * FROM A JOIN PUB.B ON 1 = 1"), ("PUB", "X", None)], "TABLE_SCHEMA string, TABLE_NAME string, VIEW_DEFINITION string"),
        "SNOWFLAKE.ACCOUNT_USAGE.ACCESS_HISTORY": f([("2024-06-01", ["DB.PUB.A", "OTHER.PUB.A"], []), ("2024-06-20", ["db.PUB.A"], ["DB.PUB.B"]), ("2022-01-01", ["DB.PUB.B"], [])], "at string, r array<string>, w array<string>").select(F.col("at").cast(T).alias("QUERY_START_TIME"), F.transform("r", lambda x: F.struct(x.alias("objectName"))).alias("BASE_OBJECTS_ACCESSED"), F.transform("w", lambda x: F.struct(x.alias("objectName"))).alias("OBJECTS_MODIFIED")),
        "SNOWFLAKE.ACCOUNT_USAGE.OBJECT_DEPENDENCIES": f([("DB", "PUB", "A", "DB", "PUB", "V"), ("X", "PUB", "Q", "DB", "PUB", "V")], "REFERENCED_DATABASE string, REFERENCED_SCHEMA string, REFERENCED_OBJECT_NAME string, REFERENCING_DATABASE string, REFERENCING_SCHEMA string, REFERENCING_OBJECT_NAME string"),
        "SNOWFLAKE.ACCOUNT_USAGE.GRANTS_TO_ROLES": f([("SELECT", "TABLE", "DB", "PUB", "A", "R", None), ("SELECT", "TABLE", "DB", "PUB", "A", "OLD", "2024"), ("INSERT", "TABLE", "DB", "PUB", "A", "W", None), ("SELECT", "TABLE", "X", "PUB", "A", "R", None)], "PRIVILEGE string, GRANTED_ON string, TABLE_CATALOG string, TABLE_SCHEMA string, NAME string, GRANTEE_NAME string, DELETED_ON string"),
        "INFORMATION_SCHEMA.REFERENTIAL_CONSTRAINTS": f([("PUB", "FK", "PUB", "PK")], "CONSTRAINT_SCHEMA string, CONSTRAINT_NAME string, UNIQUE_CONSTRAINT_SCHEMA string, UNIQUE_CONSTRAINT_NAME string"),
        "INFORMATION_SCHEMA.KEY_COLUMN_USAGE": f([("PUB", "FK", "PUB", "B", "A_ID", 1), ("PUB", "PK", "PUB", "A", "ID", 1)], "CONSTRAINT_SCHEMA string, CONSTRAINT_NAME string, TABLE_SCHEMA string, TABLE_NAME string, COLUMN_NAME string, ORDINAL_POSITION int"),
    }
    answers = {
        "SHOW PRIMARY KEYS IN DATABASE": f([("PUB", "A", "ID")], "schema_name string, table_name string, column_name string"),
        "SHOW IMPORTED KEYS IN DATABASE": f([("K", 2, "PUB", "B", "Y", "PUB", "A", "YY"), ("K", 1, "PUB", "B", "X", "PUB", "A", "XX")], "fk_name string, key_sequence int, fk_schema_name string, fk_table_name string, fk_column_name string, pk_schema_name string, pk_table_name string, pk_column_name string"),
        "SHOW STREAMS IN DATABASE": f([("S", "PUB", "DB.PUB.A")], "name string, schema_name string, table_name string"),
        "SHOW TASKS IN DATABASE": f([("T", "PUB", "INSERT INTO B SELECT * FROM A")], "name string, schema_name string, definition string"),
    }
    return reader.RecordedReader(spark, views, answers)


def test_snowflake(snow):
    s = snowflake.SnowflakeSource(snow, "DB")
    assert {r.table_name: r.table_type for r in s.tables().collect()} == {"A": "table", "V": "view", "B": "foreign_table"}
    assert {r.column_name: r.is_primary_key for r in s.columns().collect()} == {"ID": True, "A_ID": False}
    assert [(r.position, r.src_column, r.dst_column) for r in s.foreign_keys().orderBy("position").collect()] == [(1, "X", "XX"), (2, "Y", "YY")]
    facts = {r.table_name: r for r in s.table_facts(F.lit("2024-07-01").cast(T)).collect()}
    assert (facts["A"].access_read_count, facts["A"].days_since_last_access, facts["A"].potentially_unused) == (2, 11, False)
    assert (facts["B"].access_read_count, facts["B"].access_write_count, facts["B"].potentially_unused) == (0, 1, True) and facts["V"].potentially_unused
    got = {(r.src_table, r.dst_table, r.lineage_type, r.confidence) for r in s.lineage().collect()}
    assert got == {("PUB.A", "PUB.V", "VIEW", 1.0), ("PUB.B", "PUB.V", "VIEW", 0.85), ("PUB.A", "PUB.S", "STREAM", 1.0), ("PUB.A", "PUB.B", "TASK", 0.85)}
    assert [tuple(r) for r in s.select_grants().collect()] == [("R", "PUB.A")] and s.failures == []


def test_snowflake_without_rights(snow, spark):
    less = reader.RecordedReader(spark, {k: v for k, v in snow.views.items() if "DEPENDENCIES" not in k}, {})
    s = snowflake.SnowflakeSource(less, "DB")
    assert [(r.src_column, r.dst_column) for r in s.foreign_keys().collect()] == [("A_ID", "ID")] and s.columns().where("is_primary_key").count() == 0
    assert {(r.src_table, r.confidence) for r in s.lineage().collect()} == {("PUB.A", 0.85), ("PUB.B", 0.85)}
    assert {f.split(":")[0] for f in s.failures} == {"imported keys", "primary keys", "object dependencies", "streams", "tasks"}


def test_bigquery(spark):
    f = spark.createDataFrame
    p = "`region-eu`.INFORMATION_SCHEMA."
    views = {
        p + "TABLES": f([("d", "a", "BASE TABLE"), ("d", "v", "VIEW")], "table_schema string, table_name string, table_type string"),
        p + "TABLE_STORAGE": f([("d", "a", 7, 1000)], "table_schema string, table_name string, total_rows long, total_logical_bytes long"),
        p + "COLUMNS": f([("d", "a", "id", 1, "NO", 2, "NO"), ("d", "a", "day", 2, "YES", 1, "YES"), ("d", "a", "s", 3, "YES", None, "NO")], "table_schema string, table_name string, column_name string, ordinal_position int, is_nullable string, clustering_ordinal_position int, is_partitioning_column string"),
        p + "COLUMN_FIELD_PATHS": f([("d", "a", "id", "id", "INT64", None), ("d", "a", "s", "s", "ARRAY<STRUCT<x INT64, y STRUCT<z INT64>>>", None), ("d", "a", "s", "s.y", "STRUCT<z INT64>", "deep"), ("d", "a", "s", "s.y.z", "INT64", None)], "table_schema string, table_name string, column_name string, field_path string, data_type string, description string"),
        p + "JOBS": f([("2024-06-20", "DONE", [("proj", "d", "a"), ("other", "d", "v")]), ("2024-01-01", "DONE", [("proj", "d", "v")])], "at string, state string, referenced_tables array<struct<project_id:string,dataset_id:string,table_id:string>>").withColumn("creation_time", F.col("at").cast(T)),
        p + "VIEWS": f([("d", "v", "SELECT * FROM d.a")], "table_schema string, table_name string, view_definition string"),
    }
    s = bigquery.BigQuerySource(reader.RecordedReader(spark, views), "proj", "EU")
    assert {r.table_name: (r.table_type, r.row_count) for r in s.tables().collect()} == {"a": ("table", 7), "v": ("view", None)}
    cols = {r.column_name: r for r in s.columns().collect()}
    assert cols["s.y.z"].parent == "s.y" and cols["s.y"].parent == "s" and cols["s"].is_array and cols["s"].parent is None and cols["s.y"].comment == "deep" and not cols["id"].nullable
    facts = {r.table_name: r for r in s.table_facts(F.lit("2024-07-01").cast(T)).collect()}
    assert (facts["a"].clustering_key, facts["a"].partition_key, facts["a"].access_read_count, facts["a"].days_since_last_access, facts["a"].potentially_unused) == ("day,id", "day", 1, 11, False) and facts["v"].potentially_unused
    assert [(r.src_table, r.dst_table) for r in s.lineage().collect()] == [("d.a", "d.v")] and s.foreign_keys().count() == 0
    snap = snapshot.inspect(s, "bq")
    assert snap.columns.where("parent IS NOT NULL").count() == 2
    blind = bigquery.BigQuerySource(reader.RecordedReader(spark, {k: v for k, v in views.items() if "JOBS" not in k}), "proj", "EU")
    assert {r.potentially_unused for r in blind.table_facts().collect()} == {None} and blind.failures
    assert bigquery.region_qualifier(None) == "`region-us`" and bigquery.region_qualifier("region-x") == "`region-x`"
