"""One connection's catalog as frames of fixed shapes, from any source.

Tables are named as schema.table, or by their bare name in the schema "main". A source that
lacks something (statistics, usage, lineage, grants), or may not read it, leaves nulls and a
note: one failure never hides the rest.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.operators import profile
from quarry.operators.profile_store import ProfileStore
from quarry.sources.reader import attempted, no_rows

MAIN = "main"
#: Profiles are taken of tables with fewer rows, and of columns whose type can be compared.
MOST_ROWS = 10_000_000
PROFILED = r"(?i)int|numeric|decimal|double|float|real|number|char|text|string|date|time|bool|uuid"

TABLES = (
    "schema_name string, table_name string, table_type string, comment string, row_count bigint, seq_scan_count bigint, idx_scan_count bigint, insert_count bigint, update_count bigint, delete_count bigint, "
    "is_partitioned boolean, partition_key string, grants string, access_read_count bigint, access_write_count bigint, days_since_last_access bigint, potentially_unused boolean, table_bytes bigint, clustering_key string"
)
COLUMNS = (
    "table_name string, column_name string, data_type string, nullable boolean, ordinal int, parent string, is_array boolean, is_primary_key boolean, is_foreign_key boolean, default_value string, comment string, is_indexed boolean, "
    "check_constraints string, most_common_values string, histogram_bounds string, stats_correlation double, distinct_count bigint, null_pct double, index_type string, index_unique boolean"
)
KEYS = "constraint_name string, position int, src_table string, src_column string, dst_table string, dst_column string"
LINEAGE = "src_table string, dst_table string, lineage_type string, confidence double"
GRANTS = "grantee string, table_name string"
SHAPES = {"tables": TABLES, "columns": COLUMNS, "foreign_keys": KEYS, "lineage": LINEAGE, "grants": GRANTS}


@dataclass
class Snapshot:
    connection: str
    database: str
    dialect: str
    tables: DataFrame
    columns: DataFrame
    foreign_keys: DataFrame
    lineage: DataFrame
    grants: DataFrame
    notes: list[str] = field(default_factory=list)

    def frames(self) -> dict[str, DataFrame]:
        return {k: getattr(self, k) for k in SHAPES}

    def restricted(self, keep: DataFrame) -> Snapshot:
        """Only the tables of keep(table_name), and what lies among them."""
        names = keep.select("table_name").distinct()
        ends = lambda df: reduce(lambda x, s: x.join(names.select(F.col("table_name").alias(s)), s, "left_semi"), ("src_table", "dst_table"), df).select(*df.columns)
        own = lambda df: df.join(names, "table_name", "left_semi").select(*df.columns)
        return Snapshot(self.connection, self.database, self.dialect, own(self.tables), own(self.columns), ends(self.foreign_keys), ends(self.lineage), own(self.grants), list(self.notes))


def shaped(df: DataFrame, shape: str) -> DataFrame:
    """df in a shape: missing columns are null, lists become JSON text, the rest goes."""
    schema = StructType.fromDDL(shape)

    def one(f) -> Column:
        if f.name not in df.columns:
            return F.lit(None).cast(f.dataType).alias(f.name)
        c = F.col(f.name)
        return (F.to_json(c) if df.schema[f.name].dataType.typeName() in ("array", "struct", "map") else c).cast(f.dataType).alias(f.name)

    return df.select(*[one(f) for f in schema.fields])


def list_of(text: Column) -> Column:
    """A list that shaped() wrote; empty where the text is none or no list."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def _named(df: DataFrame, schema: str = "schema_name", table: str = "table_name") -> DataFrame:
    """df with its table as one name."""
    if schema not in df.columns:
        return df
    return df.withColumn(table, F.when((F.col(schema) == MAIN) | F.col(schema).isNull(), F.col(table)).otherwise(F.concat_ws(".", schema, table)))


def _overlaid(base: DataFrame, more: DataFrame | None, key: list[str]) -> DataFrame:
    """The values of more where they are not null, else those of base."""
    if more is None:
        return base
    extra = [c for c in more.columns if c not in key]
    x = base.join(more.select(*key, *[F.col(c).alias(f"__m_{c}") for c in extra]), key, "left")
    for c in extra:
        x = x.withColumn(c, F.coalesce(f"__m_{c}", c) if c in base.columns else F.col(f"__m_{c}"))
    return x.drop(*[f"__m_{c}" for c in extra])


def _profiles(source, tables: DataFrame, columns: DataFrame, notes: list[str]) -> DataFrame | None:
    """table_name, column_name, distinct_count, null_pct of the tables that are not too large."""
    if not hasattr(source, "read"):
        return None
    out = []
    rows = tables.where((F.col("row_count") > 0) & (F.col("row_count") < MOST_ROWS)).select("table_name").collect()  # the catalog's names
    cols = columns.where(F.col("parent").isNull() & F.col("data_type").rlike(PROFILED) & ~F.col("data_type").rlike("(?i)^(array|struct|map)")) if "parent" in columns.columns else columns.where(F.col("data_type").rlike(PROFILED))
    by_table: dict[str, list[str]] = {}
    for r in cols.select("table_name", "column_name").collect():
        by_table.setdefault(r[0], []).append(r[1])
    for (name,) in rows:
        if by_table.get(name):
            try:
                one = profile.column_profile(source.read(name).select(*[F.col(f"`{c}`") for c in by_table[name]]))
                out.append(one.select(F.lit(name).alias("table_name"), "column_name", "distinct_count", "null_pct"))
            except PySparkException as e:
                notes.append(f"profile of {name}: {str(e).splitlines()[0]}")
    return reduce(DataFrame.unionByName, out) if out else None


def _merged_profiles(source, tables: DataFrame, store: ProfileStore, notes: list[str]) -> DataFrame | None:
    """Estimates of a store that reads new and changed files alone; sources of files only."""
    out = []
    for (name,) in tables.where("row_count > 0").select("table_name").collect():  # the catalog's names
        try:
            done = store.refresh(name, f"{source.location}/{name}.parquet")
            notes.append(f"profile of {name}: {done['new']} files read, {done['kept']} known")
            out.append(store.profile(name).select(F.lit(name).alias("table_name"), "column_name", "distinct_count", "null_pct"))
        except PySparkException as e:
            notes.append(f"profile of {name}: {str(e).splitlines()[0]}")
    return reduce(DataFrame.unionByName, out) if out else None


def inspect(source, connection: str, database: str = "", statistics: bool = True, store: ProfileStore | None = None) -> Snapshot:
    """The snapshot of a source. Catalog statistics win over profiles. With a store, files are
    profiled once each, by sketches that merge."""
    spark, notes = source.spark if hasattr(source, "spark") else source.reader.spark, []
    tables = source.tables()
    columns = attempted(source.columns, no_rows(spark, "schema_name string, table_name string, column_name string, data_type string, nullable boolean, ordinal int"), notes, "columns")
    if "schema_name" not in tables.columns:
        tables = tables.withColumn("schema_name", F.lit(MAIN))
    facts = attempted(source.table_facts, None, notes, "table facts") if hasattr(source, "table_facts") else None
    tables = _named(_overlaid(tables, facts, ["schema_name", "table_name"]))
    if "table_type" not in tables.columns:
        tables = tables.withColumn("table_type", F.lit("table"))
    columns = _named(columns).drop("schema_name")
    keys = attempted(source.foreign_keys, no_rows(spark, "src_table string, src_column string, dst_table string, dst_column string"), notes, "foreign keys")
    if "src_schema" in keys.columns:
        keys = _named(_named(keys, "src_schema", "src_table"), "dst_schema", "dst_table").drop("src_schema", "dst_schema")
    if "constraint_name" not in keys.columns:
        keys = keys.withColumn("constraint_name", F.concat_ws("_", "src_table", "src_column", F.lit("fk"))).withColumn("position", F.lit(1))
    own = attempted(source.column_statistics, None, notes, "column statistics") if hasattr(source, "column_statistics") else None
    if statistics:
        measured = _merged_profiles(source, tables, store, notes) if store is not None and hasattr(source, "location") else _profiles(source, tables, columns, notes)
        columns = _overlaid(columns, measured, ["table_name", "column_name"])
    if own is not None:
        own = _named(own).drop("schema_name").withColumnsRenamed({"mcv": "most_common_values", "histogram": "histogram_bounds", "correlation": "stats_correlation"})
        columns = _overlaid(columns, own, ["table_name", "column_name"])
    linked = keys.select(F.col("src_table").alias("table_name"), F.col("src_column").alias("column_name")).distinct().withColumn("is_foreign_key", F.lit(True))
    columns = columns.drop("is_foreign_key").join(linked, ["table_name", "column_name"], "left").withColumn("is_foreign_key", F.coalesce("is_foreign_key", F.lit(False)))
    lineage = attempted(source.lineage, no_rows(spark, LINEAGE), notes, "lineage") if hasattr(source, "lineage") else no_rows(spark, LINEAGE)
    grants = attempted(source.select_grants, no_rows(spark, GRANTS), notes, "grants") if hasattr(source, "select_grants") else no_rows(spark, GRANTS)
    frames = {"tables": tables, "columns": columns, "foreign_keys": keys, "lineage": lineage, "grants": grants}
    notes += [n for n in getattr(source, "failures", []) if n not in notes]
    return Snapshot(connection, database, source.dialect, **{k: shaped(v, SHAPES[k]) for k, v in frames.items()}, notes=notes)


def save(snapshot: Snapshot, path: str) -> None:
    for name, df in snapshot.frames().items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str, connection: str, database: str = "", dialect: str = "parquet") -> Snapshot:
    return Snapshot(connection, database, dialect, **{k: spark.read.schema(v).parquet(f"{path}/{k}") for k, v in SHAPES.items()})
