"""PostgreSQL: tables, columns, keys, indexes, checks, statistics, usage, lineage, grants.

What stands in pg_catalog is asked for by statements: its columns have types that JDBC does
not know (names, object ids, vectors of column numbers, arrays of any type), and some of it
only the server's functions tell. The information_schema's views are read by name."""

from __future__ import annotations

import threading
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quarry.operators.classify import best_per
from quarry.operators.reach import grants_of_roles
from quarry.plans import sql_walk
from quarry.sources import dsn, warehouse
from quarry.sources.reader import attempted, in_schemas, no_rows

SYSTEM_SCHEMAS = ("pg_catalog", "information_schema")
VIEW_TIMEOUT_MS = 2000
# What the letters of pg_class.relkind stand for.
RELKINDS = {"r": "table", "p": "partitioned_table", "v": "view", "m": "materialized_view", "f": "foreign_table"}

#: statements over pg_catalog
STATEMENTS = {
    "relations": "SELECT c.oid::bigint AS oid, n.nspname::text AS schema_name, c.relname::text AS table_name, c.relkind::text AS relkind, c.reltuples::float8 AS reltuples, c.relam::bigint AS relam FROM pg_catalog.pg_class c JOIN pg_catalog.pg_namespace n ON n.oid = c.relnamespace",
    "attributes": "SELECT a.attrelid::bigint AS oid, a.attnum::int AS attnum, a.attname::text AS column_name FROM pg_catalog.pg_attribute a WHERE a.attnum > 0 AND NOT a.attisdropped",
    "comments": "SELECT d.objoid::bigint AS oid, d.objsubid::int AS attnum, d.description AS description FROM pg_catalog.pg_description d WHERE d.classoid = 'pg_catalog.pg_class'::regclass",
    "index_columns": "SELECT i.indrelid::bigint AS oid, i.indexrelid::bigint AS indexrelid, i.indisunique AS indisunique, k.attnum::int AS attnum FROM pg_catalog.pg_index i CROSS JOIN LATERAL unnest(i.indkey::smallint[]) AS k(attnum) WHERE i.indisvalid",
    "methods": "SELECT m.oid::bigint AS relam, m.amname::text AS amname FROM pg_catalog.pg_am m",
    "checks": "SELECT c.conrelid::bigint AS oid, k.attnum::int AS attnum, pg_catalog.pg_get_constraintdef(c.oid, true) AS check_def FROM pg_catalog.pg_constraint c CROSS JOIN LATERAL unnest(c.conkey) AS k(attnum) WHERE c.contype = 'c'",
    "usage": "SELECT u.schemaname::text AS schema_name, u.relname::text AS table_name, u.seq_scan AS seq_scan, u.idx_scan AS idx_scan, u.n_tup_ins AS n_tup_ins, u.n_tup_upd AS n_tup_upd, u.n_tup_del AS n_tup_del FROM pg_catalog.pg_stat_user_tables u",
    "partitions": "SELECT p.partrelid::bigint AS oid, pg_catalog.pg_get_partkeydef(p.partrelid) AS partition_key FROM pg_catalog.pg_partitioned_table p",
    "stats": "SELECT s.schemaname::text AS schema_name, s.tablename::text AS table_name, s.attname::text AS column_name, s.n_distinct::float8 AS n_distinct, s.null_frac::float8 AS null_frac, s.correlation::float8 AS correlation, s.most_common_vals::text AS mcv_text, s.histogram_bounds::text AS histogram_text FROM pg_catalog.pg_stats s",
    "views": "SELECT v.schemaname::text AS schema_name, v.viewname::text AS name, v.definition AS definition FROM pg_catalog.pg_views v",
    "matviews": "SELECT v.schemaname::text AS schema_name, v.matviewname::text AS name, v.definition AS definition FROM pg_catalog.pg_matviews v",
    "triggers": "SELECT t.tgrelid::bigint AS oid, p.prosrc AS prosrc, l.lanname::text AS lanname FROM pg_catalog.pg_trigger t JOIN pg_catalog.pg_proc p ON p.oid = t.tgfoid JOIN pg_catalog.pg_language l ON l.oid = p.prolang WHERE NOT t.tgisinternal",
    "memberships": "SELECT m.rolname::text AS child, r.rolname::text AS parent FROM pg_catalog.pg_auth_members a JOIN pg_catalog.pg_roles m ON m.oid = a.member JOIN pg_catalog.pg_roles r ON r.oid = a.roleid",
}


@F.udf(ArrayType(StringType()), useArrow=True)
def array_values(text):
    """The elements of an array in its text form; null for null."""
    return None if text is None else dsn.parse_array_literal(text)


#: rows that one part of a table's read is made for
PART_ROWS = 1_000_000


class PostgresSource:
    dialect = "postgres"

    def __init__(self, reader, include: Iterable[str] = (), exclude: Iterable[str] = ()):
        self.reader, self.include, self.exclude = reader, tuple(include), tuple(exclude)
        self.failures: list[str] = []

    def _seen(self, schema: str | Column) -> Column:
        schema = F.col(schema) if isinstance(schema, str) else schema
        return in_schemas(schema, self.include, (*SYSTEM_SCHEMAS, *self.exclude))

    def _ask(self, what: str) -> DataFrame:
        return self.reader.sql(STATEMENTS[what])

    def _relations(self) -> DataFrame:
        """oid, schema_name, table_name, relkind, relam, approximate rows."""
        x = self._ask("relations").where(self._seen("schema_name"))
        return x.select("oid", "schema_name", "table_name", "relkind", "relam", F.col("reltuples").cast("long").alias("row_count"))

    def _attributes(self) -> DataFrame:
        return self._ask("attributes")

    def _optional(self, read, schema: str, what: str) -> DataFrame:
        """What read gives, or nothing, with a note, where the server does not answer."""
        return attempted(read, no_rows(self.reader.spark, schema), self.failures, what)

    def tables(self) -> DataFrame:
        """schema_name, table_name, table_type, comment, row_count (estimated; null for views)."""
        info = self.reader.view("information_schema.tables").where(self._seen("table_schema")).select(F.col("table_schema").alias("schema_name"), "table_name", F.col("table_type").alias("said"))
        rel = self._relations()
        notes = self._optional(lambda: self._ask("comments"), "oid long, attnum int, description string", "comments").where("attnum = 0").select("oid", F.col("description").alias("comment"))
        kind = F.coalesce(
            *[F.when(F.col("relkind") == k, v) for k, v in RELKINDS.items()],
            F.when(F.col("said") == "VIEW", "view"), F.when(F.col("said") == "FOREIGN TABLE", "foreign_table"), F.lit("table"),
        )
        x = info.join(rel, ["schema_name", "table_name"], "left").join(notes, "oid", "left")
        rows = F.when(kind.isin("view", "materialized_view"), F.lit(None)).otherwise(F.greatest("row_count", F.lit(0)))
        return x.select("schema_name", "table_name", kind.alias("table_type"), "comment", rows.cast("long").alias("row_count"))

    def count_view(self, schema: str, view: str, timeout_ms: int = VIEW_TIMEOUT_MS) -> tuple[int, str | None]:
        """(exact rows, None), or (-1, what happened) where the count takes longer or fails."""
        spark = self.reader.spark
        sc, group, late = spark.sparkContext, f"view-{schema}.{view}", threading.Event()

        def stop() -> None:
            late.set()
            sc.cancelJobGroup(group)

        timer = threading.Timer(timeout_ms / 1000, stop)
        sc.setJobGroup(group, "row count of a view", interruptOnCancel=True)
        timer.start()
        try:
            return self.row_count(schema, view), None
        except Exception as e:  # whatever the database says
            return -1, "view_timeout" if late.is_set() else f"view_error: {str(e).splitlines()[0][:200]}"
        finally:
            timer.cancel()
            sc.setLocalProperty("spark.jobGroup.id", None)

    def row_count(self, schema: str, table: str) -> int:
        return self.reader.view(f"{schema}.{table}").count()

    def columns(self) -> DataFrame:
        """schema_name, table_name, column_name, data_type, nullable, default_value, ordinal,
        comment, is_primary_key, is_indexed, check_constraints."""
        key = ["schema_name", "table_name", "column_name"]
        user = F.when(F.col("data_type") == "USER-DEFINED", F.col("udt_name")).otherwise(F.col("data_type"))
        c = self.reader.view("information_schema.columns").where(self._seen("table_schema"))
        c = c.select(F.col("table_schema").alias("schema_name"), "table_name", "column_name", user.alias("data_type"), (F.col("is_nullable") == "YES").alias("nullable"), F.col("column_default").alias("default_value"), F.col("ordinal_position").alias("ordinal"))
        pk = self.primary_keys().select(*key, F.lit(True).alias("is_primary_key"))
        plain = "schema_name string, table_name string, column_name string"
        said = self._optional(self.column_comments, plain + ", comment string", "column comments")
        indexed = self._optional(self.indexed_columns, plain, "indexed columns").withColumn("is_indexed", F.lit(True))
        checks = self._optional(self.check_constraints, plain + ", check_constraints array<string>", "check constraints")
        x = c.join(pk, key, "left").join(indexed, key, "left").join(checks, key, "left").join(said, key, "left")
        return x.select(*c.columns, "comment", *[F.coalesce(f, F.lit(False)).alias(f) for f in ("is_primary_key", "is_indexed")], F.coalesce("check_constraints", F.array().cast("array<string>")).alias("check_constraints"))

    def primary_keys(self) -> DataFrame:
        """schema_name, table_name, column_name, position."""
        t = self.reader.view("information_schema.table_constraints").where("constraint_type = 'PRIMARY KEY'").select("constraint_schema", "constraint_name", "table_name")
        k = self.reader.view("information_schema.key_column_usage").select("constraint_schema", "constraint_name", "table_schema", "table_name", "column_name", "ordinal_position")
        x = k.join(t, ["constraint_schema", "constraint_name", "table_name"]).where(self._seen("table_schema"))
        return x.select(F.col("table_schema").alias("schema_name"), "table_name", "column_name", F.col("ordinal_position").alias("position"))

    def _named(self, x: DataFrame) -> DataFrame:
        """Rows of x (oid, attnum, ...) with the names of their columns."""
        return x.join(self._attributes(), ["oid", "attnum"]).join(self._relations().select("oid", "schema_name", "table_name"), "oid")

    def column_comments(self) -> DataFrame:
        x = self._ask("comments").where("attnum > 0").withColumnRenamed("description", "comment")
        return self._named(x).select("schema_name", "table_name", "column_name", "comment")

    def indexed_columns(self) -> DataFrame:
        return self._named(self._ask("index_columns")).select("schema_name", "table_name", "column_name").distinct()

    def check_constraints(self) -> DataFrame:
        """schema_name, table_name, column_name, check_constraints (sorted definitions)."""
        return self._named(self._ask("checks")).groupBy("schema_name", "table_name", "column_name").agg(F.array_sort(F.collect_set("check_def")).alias("check_constraints"))

    def best_indexes(self) -> DataFrame:
        """The index that tells most of a column: unique ones first, then btree."""
        cls = self._relations().select(F.col("oid").alias("indexrelid"), "relam", F.col("table_name").alias("index_name"))
        i = self._ask("index_columns").withColumnRenamed("indisunique", "index_unique").join(cls, "indexrelid").join(self._ask("methods").withColumnRenamed("amname", "index_type"), "relam")
        x = self._named(i).withColumn("_k", F.concat_ws("\0", "schema_name", "table_name", "column_name"))
        return best_per(x, "_k", F.desc("index_unique"), (F.col("index_type") == "btree").desc(), F.col("index_name")).select("schema_name", "table_name", "column_name", "index_name", "index_type", "index_unique")

    def foreign_keys(self) -> DataFrame:
        """One row per column pair; columns of composite keys are paired by position."""
        keys = ["constraint_schema", "constraint_name"]
        refs = self.reader.view("information_schema.referential_constraints").select(*keys, "unique_constraint_schema", "unique_constraint_name")
        own = self.reader.view("information_schema.key_column_usage")
        near = own.select(*keys, "table_schema", "table_name", "column_name", "ordinal_position", F.col("position_in_unique_constraint").alias("at"))
        far = own.select(F.col("constraint_schema").alias("unique_constraint_schema"), F.col("constraint_name").alias("unique_constraint_name"), F.col("ordinal_position").alias("at"), F.col("table_schema").alias("dst_schema"), F.col("table_name").alias("dst_table"), F.col("column_name").alias("dst_column"))
        x = refs.join(near, keys).join(far, ["unique_constraint_schema", "unique_constraint_name", "at"]).where(self._seen("table_schema"))
        return x.select("constraint_name", F.col("ordinal_position").alias("position"), F.col("table_schema").alias("src_schema"), F.col("table_name").alias("src_table"), F.col("column_name").alias("src_column"), "dst_schema", "dst_table", "dst_column")

    def query(self, sql: str) -> DataFrame:
        return self.reader.sql(sql)

    def read(self, table: str) -> DataFrame:
        """The rows of schema.table, in parts by ranges of its key where that is one number, so
        that no task reads a large table alone."""
        schema, _, name = table.rpartition(".")
        schema = schema or "public"
        keys = self.primary_keys().where((F.col("schema_name") == schema) & (F.col("table_name") == name)).select("column_name").limit(2).collect()
        return self.reader.table(f"{schema}.{name}", keys[0][0] if len(keys) == 1 else None, PART_ROWS)

    def table_facts(self) -> DataFrame:
        """Usage counters, partition keys and grants of each table (left joins: a table
        without any keeps its row)."""
        u = self._ask("usage").select("schema_name", "table_name", F.col("seq_scan").alias("seq_scan_count"), F.col("idx_scan").alias("idx_scan_count"), F.col("n_tup_ins").alias("insert_count"), F.col("n_tup_upd").alias("update_count"), F.col("n_tup_del").alias("delete_count"))
        p = self._optional(lambda: self._ask("partitions"), "oid long, partition_key string", "partition keys")
        g = self.grants().groupBy("schema_name", "table_name").agg(F.array_sort(F.collect_set(F.struct("grantee", "privilege"))).alias("grants"))
        key = ["schema_name", "table_name"]
        x = self._relations().where(F.col("relkind") != "i").join(u, key, "left").join(p, "oid", "left").join(g, key, "left")
        return x.select(*key, "seq_scan_count", "idx_scan_count", "insert_count", "update_count", "delete_count", (F.col("relkind") == "p").alias("is_partitioned"), "partition_key", "grants")

    def column_statistics(self) -> DataFrame:
        """distinct_count, null_pct, mcv, histogram, correlation from pg_stats, and the best
        index of each column."""
        key = ["schema_name", "table_name", "column_name"]
        s = self._ask("stats").where(self._seen("schema_name"))
        s = s.select(*key, "n_distinct", "null_frac", array_values("mcv_text").alias("mcv"), array_values("histogram_text").alias("histogram"), "correlation")
        rows = self._relations().select("schema_name", "table_name", "row_count")
        distinct = F.when(F.col("n_distinct") < 0, F.round(-F.col("n_distinct") * F.col("row_count"))).otherwise(F.col("n_distinct")).cast("long")
        x = s.join(rows, ["schema_name", "table_name"], "left").select(*key, distinct.alias("distinct_count"), F.round(F.col("null_frac") * 100, 2).alias("null_pct"), F.slice("mcv", 1, warehouse.MOST_COMMON).alias("mcv"), "histogram", "correlation")
        return x.join(self.best_indexes(), key, "full")

    def view_lineage(self) -> DataFrame:
        """src_table, dst_table, lineage_type, confidence of views and materialized views, by
        their texts; a text that names itself or cannot be parsed gives nothing for that."""
        texts = lambda what, kind: self._ask(what).where(self._seen("schema_name")).select(F.col("schema_name").alias("s"), F.col("name").alias("v"), F.col("definition").alias("sql"), F.lit(kind).alias("kind"))
        v, m = texts("views", "VIEW"), texts("matviews", "MATERIALIZED_VIEW")
        spark, out = self.reader.spark, []
        # a catalog's view texts; Spark's parser lives on the driver
        for r in v.unionByName(m).toLocalIterator():
            name = f"{r.s}.{r.v}"
            out += [(t, name, r.kind, 1.0) for t in sql_walk.table_references(spark, r.sql.rstrip("; \n"), r.s) if t != name]
        return spark.createDataFrame(out, "src_table string, dst_table string, lineage_type string, confidence double").distinct()

    def trigger_lineage(self) -> DataFrame:
        """Tables that a trigger's function writes, from the trigger's table (0.85). Functions
        in another language than SQL, and such as build statements with EXECUTE, tell nothing."""
        t = self._ask("triggers").where((F.lower("lanname") == "sql") & ~F.upper("prosrc").contains("EXECUTE"))
        x = t.join(self._relations(), "oid")
        spark, out = self.reader.spark, []
        for r in x.select("schema_name", "table_name", "prosrc").toLocalIterator():
            src = f"{r.schema_name}.{r.table_name}"
            for part in sql_walk.statements(r.prosrc):
                out += [(src, w, "TRIGGER", 0.85) for w in sql_walk.write_targets(spark, part, r.schema_name) if w != src] if part.strip() else []
        return spark.createDataFrame(out, "src_table string, dst_table string, lineage_type string, confidence double").distinct()

    def lineage(self) -> DataFrame:
        return self.view_lineage().unionByName(self.trigger_lineage())

    def grants(self) -> DataFrame:
        """schema_name, table_name, grantee, privilege as granted directly."""
        g = self.reader.view("information_schema.table_privileges").where(self._seen("table_schema"))
        return g.select(F.col("table_schema").alias("schema_name"), "table_name", "grantee", F.col("privilege_type").alias("privilege"))

    def select_grants(self) -> DataFrame:
        """grantee, table_name (schema.table): what each role may read, through the roles that
        it is a member of too."""
        members = self._ask("memberships").select("child", "parent")
        direct = self.grants().select("grantee", F.concat_ws(".", "schema_name", "table_name").alias("table_name"), "privilege")
        return grants_of_roles(direct, members)
