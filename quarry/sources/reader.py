"""How a live catalog is read: frames of its system views by name, and SQL passed through.

The connectors are joins and aggregates over what a reader gives, so they run alike over
JDBC (filters and columns are pushed down) and over recorded frames.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class JdbcReader:
    """Views and queries of a database behind a JDBC address."""

    def __init__(self, spark: SparkSession, url: str, **options: str):
        self.spark, self.url, self.options = spark, url, options

    def view(self, name: str) -> DataFrame:
        return lowered(self.spark.read.format("jdbc").options(url=self.url, dbtable=name, **self.options).load())

    def sql(self, text: str) -> DataFrame:
        return lowered(self.spark.read.format("jdbc").options(url=self.url, query=text, **self.options).load())

    def table(self, name: str, key: str | None = None, part_rows: int = 1_000_000) -> DataFrame:
        """A table's rows. With a key of whole numbers it is read in parts, by ranges of the key
        that hold about part_rows each."""
        whole = self.spark.read.format("jdbc").options(url=self.url, dbtable=name, **self.options)
        if key is None:
            return whole.load()
        kind = next((f.dataType.typeName() for f in whole.load().schema.fields if f.name.lower() == key.lower()), "")
        if kind not in ("long", "integer", "short", "byte"):
            return whole.load()
        low, high, n = self.sql(f"SELECT min({key}) AS low, max({key}) AS high, count(*) AS n FROM {name}").first()
        parts = -(-(n or 0) // part_rows)
        if parts < 2 or low == high:
            return whole.load()
        return whole.options(partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts)).load()


class RecordedReader:
    """Recorded views, and answers to statements; what is not there raises KeyError."""

    def __init__(self, spark: SparkSession, views: dict[str, DataFrame], answers: dict[str, DataFrame | Callable[[], DataFrame]] | None = None):
        self.spark, self.views, self.answers = spark, views, answers or {}

    def view(self, name: str) -> DataFrame:
        if name not in self.views:
            raise KeyError(f"no recorded view {name}")
        return lowered(self.views[name])

    def table(self, name: str, key: str | None = None, part_rows: int = 0) -> DataFrame:
        return self.view(name)

    def sql(self, text: str) -> DataFrame:
        if text not in self.answers:
            raise KeyError(f"no recorded answer to {text}")
        got = self.answers[text]
        return lowered(got() if callable(got) else got)


def lowered(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def no_rows(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def in_schemas(schema: Column, include: Iterable[str] = (), exclude: Iterable[str] = ()) -> Column:
    """Of the included schemas (all, if none is named), without the excluded ones."""
    include, exclude = tuple(include), tuple(exclude)
    keep = schema.isin(*include) if include else F.lit(True)
    return keep & ~schema.isin(*exclude) if exclude else keep


def attempted(read: Callable[[], DataFrame], otherwise: DataFrame | None, failures: list[str], what: str) -> DataFrame | None:
    """What read gives, or otherwise with a note of the failure: a catalog without some view
    (or without the right to it) still answers the rest."""
    try:
        got = read()
        got.schema  # a missing view shows here
        return got
    except (PySparkException, KeyError) as e:
        failures.append(f"{what}: {str(e).splitlines()[0]}")
        return otherwise
