"""What a profile may see: glob rules over tables and columns, and redaction."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType

from quarry.functions import scalars as S
from quarry.operators.reach import checkpointed


@dataclass(frozen=True)
class Profile:
    """Patterns are shell globs; a.b names a table of a schema, c::a.b or c::a::b one of a
    connection, a bare name a table of any schema."""

    hidden_schemas: tuple[str, ...] = ()
    allowed_schemas: tuple[str, ...] = ()
    hidden_tables: tuple[str, ...] = ()
    allowed_tables: tuple[str, ...] = ()
    hidden_columns: tuple[str, ...] = ()
    hidden_table_types: tuple[str, ...] = ()
    more: dict = field(default_factory=dict)

    def merged(self, other: Profile) -> Profile:
        """Both profiles' patterns; other settings are the other's where both have them."""
        names = [n for n in self.__dataclass_fields__ if n != "more"]
        return Profile(**{n: (*getattr(self, n), *(x for x in getattr(other, n) if x not in getattr(self, n))) for n in names}, more=self.more | other.more)


def _table_matches(patterns: tuple[str, ...], connection: Column, schema: Column, table: Column) -> Column:
    out = F.lit(False)
    for p in patterns:
        name = F.concat_ws("::", connection, schema, table) if p.count("::") == 2 else F.concat(connection, F.lit("::"), schema, F.lit("."), table) if "::" in p else F.concat_ws(".", schema, table) if "." in p else table
        out = out | S.matches_glob(name, [p])
    return out


def table_visible(p: Profile, connection: Column, schema: Column, table: Column, table_type: Column | None = None) -> Column:
    """Hidden schemas, then allowed schemas, allowed tables, hidden tables."""
    out = ~S.matches_glob(schema, p.hidden_schemas)
    if p.allowed_schemas:
        out = out & S.matches_glob(schema, p.allowed_schemas)
    if p.allowed_tables:
        out = out & _table_matches(p.allowed_tables, connection, schema, table)
    out = out & ~_table_matches(p.hidden_tables, connection, schema, table)
    if p.hidden_table_types and table_type is not None:
        out = out & ~F.coalesce(table_type.isin(*p.hidden_table_types), F.lit(False))
    return out


def column_visible(p: Profile, schema: Column, table: Column, column: Column) -> Column:
    """By schema.table.column, table.column or column patterns."""
    out = F.lit(False)
    for x in p.hidden_columns:
        name = {2: F.concat_ws(".", schema, table, column), 1: F.concat_ws(".", table, column)}.get(x.count("."), column)
        out = out | S.matches_glob(name, [x])
    return ~out


def visible_columns(p: Profile, columns: DataFrame) -> DataFrame:
    """columns(connection, schema_name, table_name, column_name) that the profile may see."""
    c = [F.col(x) for x in ("connection", "schema_name", "table_name", "column_name")]
    return columns.where(table_visible(p, *c[:3]) & column_visible(p, *c[1:]))


def redact(result: DataFrame, hidden_ids: DataFrame, id_columns: list[str]) -> DataFrame:
    """Rows whose identifier is hidden go; hidden identifiers elsewhere become null, in texts,
    in lists and in structs alike. hidden_ids(node_id)."""
    ids = hidden_ids.select("node_id").distinct()
    for c in id_columns:
        result = result.join(ids.withColumnRenamed("node_id", c), c, "left_anti").select(*result.columns)
    more = [f for f in result.schema.fields if f.name not in id_columns and _has_text(f.dataType)]
    if not more:
        return result
    # the hidden ones among each row's own texts
    rows = checkpointed(result.withColumn("__row", F.monotonically_increasing_id()))
    seen = F.array_distinct(F.flatten(F.array(*[_texts(F.col(f"`{f.name}`"), f.dataType) for f in more])))
    found = rows.select("__row", F.explode(seen).alias("node_id")).join(ids, "node_id", "left_semi").groupBy("__row").agg(F.collect_set("node_id").alias("__hidden"))
    x = rows.join(found, "__row", "left").withColumn("__hidden", F.coalesce("__hidden", F.array().cast("array<string>")))
    for f in more:
        x = x.withColumn(f.name, _cleared(F.col(f"`{f.name}`"), f.dataType, F.col("__hidden")))
    return x.select(*[F.col(f"`{c}`") for c in result.columns])


def _texts(value: Column, kind: DataType) -> Column:
    """The texts in a value, in lists and structs too."""
    none = F.array().cast("array<string>")
    if isinstance(kind, StringType):
        return F.when(value.isNotNull(), F.array(value)).otherwise(none)
    if isinstance(kind, ArrayType) and _has_text(kind):
        return F.coalesce(F.flatten(F.transform(value, lambda x: _texts(x, kind.elementType))), none)
    if isinstance(kind, StructType) and _has_text(kind):
        inner = [_texts(value[f.name], f.dataType) for f in kind.fields if _has_text(f.dataType)]
        return F.coalesce(F.concat(*inner), none)
    return none


def _has_text(kind: DataType) -> bool:
    if isinstance(kind, ArrayType):
        return _has_text(kind.elementType)
    if isinstance(kind, StructType):
        return any(_has_text(f.dataType) for f in kind.fields)
    return isinstance(kind, StringType)


def _cleared(value: Column, kind: DataType, hidden: Column) -> Column:
    """The value with null for each hidden name in it."""
    if isinstance(kind, StringType):
        return F.when(~F.coalesce(F.array_contains(hidden, value), F.lit(False)), value)
    if isinstance(kind, ArrayType) and _has_text(kind):
        return F.transform(value, lambda x: _cleared(x, kind.elementType, hidden))
    if isinstance(kind, StructType) and _has_text(kind):
        return F.when(value.isNotNull(), F.struct(*[_cleared(value[f.name], f.dataType, hidden).alias(f.name) for f in kind.fields]))
    return value
