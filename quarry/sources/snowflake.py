"""Snowflake: tables, columns, keys by SHOW, access history, lineage, grants."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.plans import sql_walk
from quarry.sources import warehouse
from quarry.sources.reader import attempted, in_schemas, no_rows

HISTORY_DAYS = 365
# Kinds of objects.
KINDS = {"BASE TABLE": "table", "TABLE": "table", "VIEW": "view", "MATERIALIZED VIEW": "materialized_view", "EXTERNAL TABLE": "foreign_table", "EVENT TABLE": "table", "TEMPORARY TABLE": "table"}


class SnowflakeSource:
    dialect = "snowflake"

    def __init__(self, reader, database: str, include: Iterable[str] = (), exclude: Iterable[str] = ()):
        self.reader, self.database, self.include, self.exclude = reader, database, tuple(include), tuple(exclude)
        self.failures: list[str] = []

    def _seen(self, schema: str) -> Column:
        return in_schemas(F.col(schema), self.include, ("INFORMATION_SCHEMA", *self.exclude))

    def tables(self) -> DataFrame:
        t = self.reader.view("INFORMATION_SCHEMA.TABLES").where(self._seen("table_schema"))
        kind = F.coalesce(*[F.when(F.upper("table_type") == k, v) for k, v in KINDS.items()], F.lit("table"))
        return t.select(F.col("table_schema").alias("schema_name"), "table_name", kind.alias("table_type"), "comment", F.col("row_count").cast("long").alias("row_count"), F.col("bytes").cast("long").alias("table_bytes"), "clustering_key")

    def primary_keys(self) -> DataFrame:
        none = no_rows(self.reader.spark, "schema_name string, table_name string, column_name string")
        got = attempted(lambda: self.reader.sql("SHOW PRIMARY KEYS IN DATABASE"), None, self.failures, "primary keys")
        return none if got is None else got.where(self._seen("schema_name")).select("schema_name", "table_name", "column_name")

    def columns(self) -> DataFrame:
        key = ["schema_name", "table_name", "column_name"]
        c = self.reader.view("INFORMATION_SCHEMA.COLUMNS").where(self._seen("table_schema"))
        c = c.select(F.col("table_schema").alias("schema_name"), "table_name", "column_name", "data_type", (F.col("is_nullable") == "YES").alias("nullable"), F.col("column_default").alias("default_value"), F.col("ordinal_position").alias("ordinal"), "comment")
        pk = self.primary_keys().distinct().withColumn("is_primary_key", F.lit(True))
        return c.join(pk, key, "left").withColumn("is_primary_key", F.coalesce("is_primary_key", F.lit(False)))

    def foreign_keys(self) -> DataFrame:
        """From SHOW IMPORTED KEYS, in the keys' own order; from the information schema where
        that may not be asked."""
        got = attempted(lambda: self.reader.sql("SHOW IMPORTED KEYS IN DATABASE"), None, self.failures, "imported keys")
        if got is not None:
            return got.where(self._seen("fk_schema_name")).select(F.col("fk_name").alias("constraint_name"), F.col("key_sequence").cast("int").alias("position"), F.col("fk_schema_name").alias("src_schema"), F.col("fk_table_name").alias("src_table"), F.col("fk_column_name").alias("src_column"), F.col("pk_schema_name").alias("dst_schema"), F.col("pk_table_name").alias("dst_table"), F.col("pk_column_name").alias("dst_column"))
        refs = self.reader.view("INFORMATION_SCHEMA.REFERENTIAL_CONSTRAINTS").select("constraint_schema", "constraint_name", "unique_constraint_schema", "unique_constraint_name")
        use = self.reader.view("INFORMATION_SCHEMA.KEY_COLUMN_USAGE")
        near = use.select("constraint_schema", "constraint_name", "table_schema", "table_name", "column_name", F.col("ordinal_position").alias("position"))
        far = use.select(F.col("constraint_schema").alias("unique_constraint_schema"), F.col("constraint_name").alias("unique_constraint_name"), F.col("ordinal_position").alias("position"), F.col("table_schema").alias("dst_schema"), F.col("table_name").alias("dst_table"), F.col("column_name").alias("dst_column"))
        x = refs.join(near, ["constraint_schema", "constraint_name"]).join(far, ["unique_constraint_schema", "unique_constraint_name", "position"]).where(self._seen("table_schema"))
        return x.select("constraint_name", F.col("position").cast("int").alias("position"), F.col("table_schema").alias("src_schema"), F.col("table_name").alias("src_table"), F.col("column_name").alias("src_column"), "dst_schema", "dst_table", "dst_column")

    def query(self, sql: str) -> DataFrame:
        return self.reader.sql(sql)

    def _own(self, name: Column) -> Column:
        """schema.table of a three-part name of this database, else null."""
        parts = F.split(F.replace(name, F.lit('"'), F.lit("")), r"\.")
        return F.when((F.size(parts) == 3) & (F.lower(F.get(parts, F.lit(0))) == self.database.lower()), F.concat_ws(".", F.get(parts, F.lit(1)), F.get(parts, F.lit(2))))

    def table_facts(self, now: Column | None = None) -> DataFrame:
        """Reads and writes of a year from the access history, and whether a table is unused."""
        now = F.current_timestamp() if now is None else now
        h = self.reader.view("SNOWFLAKE.ACCOUNT_USAGE.ACCESS_HISTORY").where(F.col("query_start_time") >= now - F.expr(f"INTERVAL {HISTORY_DAYS} DAYS"))
        side = lambda c: warehouse.exploded_access(h, c).withColumn("fq_name", self._own(F.col("fq_name"))).where("fq_name IS NOT NULL")
        names = self.tables().select(F.concat_ws(".", "schema_name", "table_name").alias("table_name"))
        x = warehouse.access(side("base_objects_accessed"), side("objects_modified"), names, now, include_unread=True)
        return x.withColumn("schema_name", F.split("table_name", r"\.")[0]).withColumn("table_name", F.split("table_name", r"\.")[1])

    def lineage(self) -> DataFrame:
        """Recorded dependencies, view texts for what they lack, streams, tasks."""
        spark = self.reader.spark
        pair = no_rows(spark, "src_table string, dst_table string")

        def dependencies() -> DataFrame:
            d = self.reader.view("SNOWFLAKE.ACCOUNT_USAGE.OBJECT_DEPENDENCIES")
            own = (F.lower("referenced_database") == self.database.lower()) & (F.lower("referencing_database") == self.database.lower())
            return d.where(own).select(F.concat_ws(".", "referenced_schema", "referenced_object_name").alias("src_table"), F.concat_ws(".", "referencing_schema", "referencing_object_name").alias("dst_table"))

        def texts() -> DataFrame:
            v = self.reader.view("INFORMATION_SCHEMA.VIEWS").where(self._seen("table_schema") & F.col("view_definition").isNotNull())
            out = []
            for r in v.select("table_schema", "table_name", "view_definition").toLocalIterator():
                body = r.view_definition.split(" AS ", 1)[-1] if r.view_definition.lstrip().upper().startswith("CREATE") else r.view_definition
                out += [(t, f"{r.table_schema}.{r.table_name}") for t in sql_walk.table_references(spark, body.rstrip("; \n"), r.table_schema)]
            return spark.createDataFrame(out, pair.schema)

        def streams() -> DataFrame:
            s = self.reader.sql("SHOW STREAMS IN DATABASE")
            return s.select(self._own(F.col("table_name")).alias("src_table"), F.concat_ws(".", "schema_name", "name").alias("dst_table")).where("src_table IS NOT NULL")

        def tasks() -> tuple[DataFrame, DataFrame]:
            reads, writes = [], []
            for r in self.reader.sql("SHOW TASKS IN DATABASE").toLocalIterator():
                task = f"{r.schema_name}.{r.name}"
                reads += [(task, t) for t in sql_walk.table_references(spark, r.definition.rstrip("; \n"), r.schema_name)]
                writes += [(task, t) for t in sql_walk.write_targets(spark, r.definition.rstrip("; \n"), r.schema_name)]
            return spark.createDataFrame(reads, "task string, src_table string"), spark.createDataFrame(writes, "task string, dst_table string")

        found: list[DataFrame] = []

        def both() -> DataFrame:
            found.extend(tasks())
            return found[0]

        own = attempted(dependencies, pair, self.failures, "object dependencies")
        text = attempted(texts, pair, self.failures, "view texts")
        stream = attempted(streams, pair, self.failures, "streams")
        attempted(both, None, self.failures, "tasks")
        read, write = found if found else (no_rows(spark, "task string, src_table string"), no_rows(spark, "task string, dst_table string"))
        return warehouse.object_lineage(own, text, stream, read, write)

    def select_grants(self) -> DataFrame:
        """grantee, table_name: what is granted directly (roles are not followed)."""
        g = self.reader.view("SNOWFLAKE.ACCOUNT_USAGE.GRANTS_TO_ROLES")
        g = g.where((F.upper("privilege") == "SELECT") & F.upper("granted_on").isin("TABLE", "VIEW", "MATERIALIZED VIEW") & F.col("deleted_on").isNull() & (F.lower("table_catalog") == self.database.lower()) & self._seen("table_schema"))
        return g.select(F.col("grantee_name").alias("grantee"), F.concat_ws(".", "table_schema", "name").alias("table_name")).distinct()
