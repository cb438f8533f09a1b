"""Catalog frames of a set of Parquet tables: tables, columns, declared keys."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from quarry.plans import sql_walk
from quarry.sources import dsn, files
from quarry.sources.bigquery import BigQuerySource
from quarry.sources.postgres import PostgresSource
from quarry.sources.reader import JdbcReader
from quarry.sources.snowflake import SnowflakeSource

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: table.column -> table.column, as the supplied star schema joins.
FOREIGN_KEYS = (
    ("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("labels", "doc_id", "documents", "doc_id"),
    ("events", "user_id", "customer", "c_custkey"),
)
FK_SCHEMA = "src_table string, src_column string, dst_table string, dst_column string"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def foreign_keys(spark: SparkSession, rows: Iterable[tuple] = FOREIGN_KEYS) -> DataFrame:
    return spark.createDataFrame(list(rows), FK_SCHEMA)


def walk(schema: StructType, prefix: str = "", parent: str | None = None) -> Iterator[tuple]:
    """(name, type, nullable, ordinal, parent, is_array) of columns and, as dotted names,
    of the fields of structs and arrays of structs, however deep."""

    def inner(kind: DataType) -> tuple[StructType | None, bool]:
        array = isinstance(kind, ArrayType)
        kind = kind.elementType if array else kind.valueType if isinstance(kind, MapType) else kind
        return (kind if isinstance(kind, StructType) else None), array

    for i, f in enumerate(schema.fields):
        name = prefix + f.name
        fields, array = inner(f.dataType)
        yield name, f.dataType.simpleString(), f.nullable, i + 1, parent, array
        if fields is not None:
            yield from walk(fields, name + ".", name)


def columns(spark: SparkSession, sf_dir: str, tables: Iterable[str] = TABLES) -> DataFrame:
    """table_name, column_name, data_type, nullable, ordinal, parent, is_array; only the
    files' footers are read."""
    rows = [(t, *c) for t in tables for c in walk(read_table(spark, sf_dir, t).schema)]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string, nullable boolean, ordinal int, parent string, is_array boolean")


def table_counts(spark: SparkSession, sf_dir: str, tables: Iterable[str] = TABLES) -> DataFrame:
    """table_name, row_count; the counts come from the files' metadata."""
    out = None
    for t in tables:
        one = read_table(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(t).alias("table_name"), "row_count")
        out = one if out is None else out.unionByName(one)
    return out


def tables_in(spark: SparkSession, folder: str) -> tuple[str, ...]:
    """The Parquet tables of a folder: files or folders named NAME.parquet."""
    return tuple(n.removesuffix(".parquet") for n in files.names(spark, folder) if n.endswith(".parquet"))


class ParquetSource:
    """The catalog protocol over a folder of Parquet tables: those that are named, or all.
    Files declare no keys; keys are the caller's, and, for the supplied tables, known."""

    dialect = "parquet"

    def __init__(self, spark: SparkSession, location: str, tables: Iterable[str] | None = None, keys: Iterable[tuple] | None = None, views: dict[str, str] | None = None):
        self.spark, self.location, self.views = spark, location, dict(views or {})
        self.names = tables_in(spark, location) if tables is None else tuple(tables)
        if keys is None:
            keys = [k for k in FOREIGN_KEYS if k[0] in self.names and k[2] in self.names and k[1] in read_table(spark, location, k[0]).columns and k[3] in read_table(spark, location, k[2]).columns]
        self.keys = [k for k in keys if k[0] in self.names and k[2] in self.names]

    def read(self, table: str) -> DataFrame:
        return read_table(self.spark, self.location, table)

    def tables(self) -> DataFrame:
        return table_counts(self.spark, self.location, self.names)

    def columns(self) -> DataFrame:
        return columns(self.spark, self.location, self.names)

    def foreign_keys(self) -> DataFrame:
        return foreign_keys(self.spark, self.keys) if self.keys else self.spark.createDataFrame([], FK_SCHEMA)

    def lineage(self) -> DataFrame:
        """What views (name -> SQL text), where the caller gives some, read."""
        rows = [(src, dst, "VIEW", c) for src, dst, _, c in sql_walk.lineage(self.spark, sorted(self.views.items()))]
        return self.spark.createDataFrame(rows, "src_table string, dst_table string, lineage_type string, confidence double")

    def row_count(self, table: str) -> int:
        return self.read(table).count()

    def query(self, sql: str) -> DataFrame:
        for t in self.names:
            self.read(t).createOrReplaceTempView(t)
        return self.spark.sql(sql)


class JdbcSource(PostgresSource):
    """Any database with an information_schema, over JDBC: what PostgreSQL has besides is
    asked for and noted where it lacks."""

    dialect = "jdbc"

    def tables(self) -> DataFrame:
        kind = F.when(F.col("table_type") == "BASE TABLE", "table").when(F.col("table_type") == "VIEW", "view").otherwise("foreign_table")
        t = self.reader.view("information_schema.tables").where(self._seen("table_schema"))
        return t.select(F.col("table_schema").alias("schema_name"), "table_name", kind.alias("table_type"))

    def columns(self) -> DataFrame:
        key = ["schema_name", "table_name", "column_name"]
        c = self.reader.view("information_schema.columns").where(self._seen("table_schema"))
        c = c.select(F.col("table_schema").alias("schema_name"), "table_name", "column_name", "data_type", (F.col("is_nullable") == "YES").alias("nullable"), F.col("ordinal_position").alias("ordinal"))
        pk = self.primary_keys().select(*key, F.lit(True).alias("is_primary_key"))
        return c.join(pk, key, "left").withColumn("is_primary_key", F.coalesce("is_primary_key", F.lit(False)))


def _live(kind: type):
    def make(spark: SparkSession, location: str, database: str = "", include: Iterable[str] = (), exclude: Iterable[str] = (), **options: str):
        reader = JdbcReader(spark, location, **options)
        if kind in (SnowflakeSource, BigQuerySource):
            return kind(reader, database, include=include, exclude=exclude)
        return kind(reader, include, exclude)

    return make


SOURCES = {"parquet": ParquetSource, "postgres": _live(PostgresSource), "snowflake": _live(SnowflakeSource), "bigquery": _live(BigQuerySource), "jdbc": _live(JdbcSource)}


def get_source(dialect: str, spark: SparkSession, location: str, **options):
    if dialect not in SOURCES:
        raise ValueError(f"unknown dialect {dialect!r}; known: {', '.join(sorted(SOURCES))}")
    return SOURCES[dialect](spark, location, **options)


def source_at(spark: SparkSession, address: str, **options):
    """The source behind an address: a folder, or a database whose JDBC driver Spark has."""
    a = dsn.parse(address)
    if a.dialect == "parquet":
        return get_source("parquet", spark, a.database, **options)
    login = {k: v for k, v in (("user", a.user), ("password", a.password)) if v}
    return get_source(a.dialect, spark, a.jdbc(), database=a.database, **login, **options)
