"""BigQuery: tables, nested columns, clustering and partition keys, reads from the jobs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.scalars import staleness_days
from quarry.plans import sql_walk
from quarry.sources.reader import attempted, in_schemas, no_rows

JOB_DAYS = 90
# Kinds of objects.
KINDS = {"BASE TABLE": "table", "VIEW": "view", "MATERIALIZED VIEW": "materialized_view", "EXTERNAL": "foreign_table", "SNAPSHOT": "table", "CLONE": "table"}


def region_qualifier(location: str | None) -> str:
    """The prefix of a region's system views; the default is the multi-region US."""
    place = (location or "US").strip().lower()
    return f"`{place}`" if place.startswith("region-") else f"`region-{place}`"


class BigQuerySource:
    dialect = "bigquery"

    def __init__(self, reader, project: str, location: str | None = None, include: Iterable[str] = (), exclude: Iterable[str] = ()):
        self.reader, self.project, self.region = reader, project, region_qualifier(location)
        self.include, self.exclude = tuple(include), tuple(exclude)
        self.failures: list[str] = []

    def _seen(self, schema: str) -> Column:
        return in_schemas(F.col(schema), self.include, ("INFORMATION_SCHEMA", *self.exclude))

    def _view(self, name: str) -> DataFrame:
        return self.reader.view(f"{self.region}.INFORMATION_SCHEMA.{name}")

    def tables(self) -> DataFrame:
        kind = F.coalesce(*[F.when(F.upper("table_type") == k, v) for k, v in KINDS.items()], F.lit("table"))
        t = self._view("TABLES").where(self._seen("table_schema")).select(F.col("table_schema").alias("schema_name"), "table_name", kind.alias("table_type"))
        rows = self._view("TABLE_STORAGE").select(F.col("table_schema").alias("schema_name"), "table_name", F.col("total_rows").cast("long").alias("row_count"), F.col("total_logical_bytes").cast("long").alias("table_bytes"))
        return t.join(rows, ["schema_name", "table_name"], "left")

    def columns(self) -> DataFrame:
        """Every field path is a column; a nested one names its parent. Fields of arrays of
        structs are nested too."""
        p = self._view("COLUMN_FIELD_PATHS").where(self._seen("table_schema"))
        top = self._view("COLUMNS").where(self._seen("table_schema")).select("table_schema", "table_name", "column_name", F.col("ordinal_position").alias("ordinal"), (F.col("is_nullable") == "YES").alias("nullable"))
        parent = F.when(F.col("field_path").contains("."), F.regexp_replace("field_path", r"\.[^.]*$", ""))
        x = p.join(top, ["table_schema", "table_name", "column_name"], "left")
        return x.select(F.col("table_schema").alias("schema_name"), "table_name", F.col("field_path").alias("column_name"), "data_type", F.when(parent.isNull(), F.col("nullable")).otherwise(F.lit(True)).alias("nullable"), "ordinal", parent.alias("parent"), F.upper("data_type").startswith("ARRAY").alias("is_array"), F.col("description").alias("comment"))

    def foreign_keys(self) -> DataFrame:
        """The warehouse keeps none."""
        return no_rows(self.reader.spark, "constraint_name string, position int, src_schema string, src_table string, src_column string, dst_schema string, dst_table string, dst_column string")

    def query(self, sql: str) -> DataFrame:
        return self.reader.sql(sql)

    def table_facts(self, now: Column | None = None) -> DataFrame:
        """Clustering key (in its order), partition key, and the reads of JOB_DAYS days."""
        now = F.current_timestamp() if now is None else now
        key = ["schema_name", "table_name"]
        c = self._view("COLUMNS").where(self._seen("table_schema")).select(F.col("table_schema").alias("schema_name"), "table_name", "column_name", "clustering_ordinal_position", "is_partitioning_column")
        order = F.array_sort(F.collect_list(F.when(F.col("clustering_ordinal_position").isNotNull(), F.struct("clustering_ordinal_position", "column_name"))))
        keys = c.groupBy(*key).agg(F.nullif(F.array_join(order["column_name"], ","), F.lit("")).alias("clustering_key"), F.max(F.when(F.col("is_partitioning_column") == "YES", F.col("column_name"))).alias("partition_key"))

        def reads() -> DataFrame:
            j = self._view("JOBS").where((F.col("creation_time") >= now - F.expr(f"INTERVAL {JOB_DAYS} DAYS")) & (F.col("state") == "DONE"))
            t = j.select("creation_time", F.explode("referenced_tables").alias("t")).where(F.col("t.project_id") == self.project)
            return t.groupBy(F.col("t.dataset_id").alias("schema_name"), F.col("t.table_id").alias("table_name")).agg(F.count(F.lit(1)).alias("rc"), F.max("creation_time").alias("last"))

        none = no_rows(self.reader.spark, "schema_name string, table_name string, rc bigint, last timestamp")
        seen = attempted(reads, none, self.failures, "jobs")
        known = seen is not none
        x = self.tables().select(*key, "table_bytes").join(keys, key, "left").join(seen, key, "left")
        return x.select(*key, "table_bytes", "clustering_key", "partition_key", F.coalesce("rc", F.lit(0)).alias("access_read_count") if known else F.lit(None).cast("long").alias("access_read_count"), staleness_days(F.col("last"), now).alias("days_since_last_access"), (F.col("rc").isNull() if known else F.lit(None).cast("boolean")).alias("potentially_unused"))

    def lineage(self) -> DataFrame:
        """From the texts of views."""
        spark, out = self.reader.spark, []
        v = self._view("VIEWS").where(self._seen("table_schema"))
        for r in v.select("table_schema", "table_name", "view_definition").toLocalIterator():
            name = f"{r.table_schema}.{r.table_name}"
            for t in sql_walk.table_references(spark, r.view_definition.rstrip("; \n"), r.table_schema):
                t = ".".join(t.split(".")[-2:])
                out += [(t, name, "VIEW", 1.0)] if t != name else []
        return spark.createDataFrame(out, "src_table string, dst_table string, lineage_type string, confidence double").distinct()
