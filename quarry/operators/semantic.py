"""A semantic layer of metrics, compiled to SQL that Spark runs."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from quarry.plans import sql_walk
from quarry.sources import files

KINDS = ("count", "count_distinct", "sum", "average", "derived")


def quoted(name: str) -> str:
    """An identifier in backticks; parts of a dotted name on their own."""
    return ".".join("`" + p.replace("`", "``") + "`" for p in name.split("."))


@dataclass(frozen=True)
class Metric:
    name: str
    kind: str
    column: str | None = None
    filters: tuple[str, ...] = ()
    expression: str | None = None
    description: str = ""


@dataclass(frozen=True)
class Attribute:
    name: str
    column: str
    role: str = "dimension"  # dimension, time or identifier


@dataclass(frozen=True)
class Entity:
    name: str
    source: str
    attributes: tuple[Attribute, ...] = ()
    metrics: tuple[Metric, ...] = ()


@dataclass(frozen=True)
class Layer:
    entities: tuple[Entity, ...]
    domains: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def find(self, metric: str) -> tuple[Entity, Metric]:
        found = [(e, m) for e in self.entities for m in e.metrics if m.name == metric]
        if not found:
            raise KeyError(f"no metric {metric!r}; known: {', '.join(sorted(m.name for e in self.entities for m in e.metrics))}")
        if len(found) > 1:
            raise ValueError(f"metric {metric!r} is defined by {', '.join(e.name for e, _ in found)}")
        return found[0]

    def dimensions(self, entity: str) -> list[Attribute]:
        return [a for e in self.entities if e.name == entity for a in e.attributes if a.role in ("dimension", "time", "identifier")]

    def validate(self, columns: dict[str, set[str]]) -> list[str]:
        """What names a table or column that there is not."""
        out = []
        for e in self.entities:
            if e.source not in columns:
                out.append(f"{e.name}: no table {e.source}")
                continue
            out += [f"{e.name}.{a.name}: no column {a.column}" for a in e.attributes if a.column not in columns[e.source]]
            out += [f"{e.name}.{m.name}: no column {m.column}" for m in e.metrics if m.column and m.column not in columns[e.source]]
            out += [f"{e.name}.{m.name}: unknown kind {m.kind}" for m in e.metrics if m.kind not in KINDS]
        return out

    def affected(self, table: str, column: str | None = None) -> list[str]:
        """Metrics that own or mention a table (and column)."""
        out = []
        for e in self.entities:
            for m in e.metrics:
                text = " ".join((*m.filters, m.expression or "", m.column or ""))
                if (e.source == table and (column is None or column in text)) or (table in text and (column is None or column in text)):
                    out.append(m.name)
        return sorted(set(out))


def compile_metric(layer: Layer, name: str, group_by: tuple[str, ...] = ()) -> str:
    """The SQL of a metric; filters are joined by AND, each in parentheses."""
    entity, m = layer.find(name)
    if m.kind == "derived":
        if not m.expression:
            raise ValueError(f"derived metric {name!r} has no expression")
        return m.expression
    value = {"count": "count(*)", "count_distinct": f"count(DISTINCT {quoted(m.column or '*')})", "sum": f"sum({quoted(m.column or '')})", "average": f"avg({quoted(m.column or '')})"}[m.kind]
    keys = "".join(quoted(g) + ", " for g in group_by)
    where = f" WHERE {' AND '.join(f'({f})' for f in m.filters)}" if m.filters else ""
    tail = f" GROUP BY {', '.join(quoted(g) for g in group_by)}" if group_by else ""
    return f"SELECT {keys}{value} AS {quoted(m.name)} FROM {quoted(entity.source)}{where}{tail}"


def run_metric(spark: SparkSession, layer: Layer, name: str, tables: dict[str, DataFrame], group_by: tuple[str, ...] = ()) -> DataFrame:
    for t, df in tables.items():
        df.createOrReplaceTempView(t)
    return spark.sql(compile_metric(layer, name, group_by))


# Parts of names that sound like measures, and of types that are numbers.
MEASURES = ("amount", "total", "price", "cost", "revenue", "qty", "quantity", "count", "fee", "fees", "tax", "payment", "payments", "subtotal", "discount")
NUMBERS = ("int", "numeric", "decimal", "float", "double", "real", "money", "smallserial", "serial", "bigserial")


def metric_slug(*parts: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", "_".join(parts).lower()).strip("_")


def metric_templates(tables: dict[str, list[tuple[str, str]]], roles: dict[str, str]) -> list[Metric]:
    """SUM templates for number columns of fact tables whose names sound like measures."""
    out = []
    for t in sorted(tables):
        if roles.get(t) == "fact":
            for c, kind in tables[t]:
                if any(x in c.lower() for x in MEASURES) and any(x in kind.lower() for x in (*NUMBERS, "long")):
                    out.append(Metric(metric_slug("sum", *t.split("."), c), "sum", c, description=f"Sum of {c} over {t}", expression=f"SELECT sum({quoted(c)}) AS {quoted(metric_slug('sum', c))} FROM {quoted(t)}"))
    return out


def resolve_source(name: str, tables: Sequence[str]) -> str:
    """The table that an entity's source names: itself, or the only one of that bare name."""
    if name in tables:
        return name
    near = sorted(t for t in tables if t.split(".")[-1].lower() == name.split(".")[-1].lower() and ("." not in name or t.lower() == name.lower()))
    if not near:
        raise KeyError(f"no table {name!r}")
    if len(near) > 1:
        raise ValueError(f"table {name!r} is ambiguous: {', '.join(near)}")
    return near[0]


@dataclass(frozen=True)
class Compiled:
    metric: str
    entity: str
    sql: str
    dialect: str = "spark"
    warnings: tuple[str, ...] = ()


def compiled(spark: SparkSession, layer: Layer, name: str, tables: Sequence[str], joins: set[tuple[str, str]], group_by: tuple[str, ...] = ()) -> Compiled:
    """A metric's SQL over known tables. Pairs of a derived metric's tables that no edge joins
    give a warning, tables that there are not an error."""
    entity, m = layer.find(name)
    if m.kind != "derived":
        source = resolve_source(entity.source, tables)
        fixed = Layer((Entity(entity.name, source, entity.attributes, entity.metrics),))
        return Compiled(name, entity.name, compile_metric(fixed, name, group_by))
    sql = compile_metric(layer, name)
    used = sorted({resolve_source(t, tables) for t in sql_walk.table_references(spark, sql)})
    if not used:
        raise ValueError(f"derived metric {name!r} names no table or cannot be parsed")
    known = {frozenset(p) for p in joins}
    warnings = tuple(f"no known join between {a} and {b}" for i, a in enumerate(used) for b in used[i + 1 :] if frozenset((a, b)) not in known)
    return Compiled(name, entity.name, sql, warnings=warnings)


def layer_of(document: dict) -> Layer:
    """A layer from its document (as YAML gives it): entities with source, dimensions and
    metrics; domains with their entities."""
    entities = []
    for e in document.get("entities") or []:
        attributes = tuple(Attribute(a["name"], a.get("column", a["name"]), a.get("type", a.get("role", "dimension"))) for a in e.get("dimensions") or [])
        metrics = tuple(Metric(m["name"], m.get("type", m.get("kind", "sum")), m.get("column"), tuple(m.get("filters") or ()), m.get("expression"), m.get("description", "")) for m in e.get("metrics") or [])
        entities.append(Entity(e["name"], e.get("source_table", e.get("source", "")), attributes, metrics))
    return Layer(tuple(entities), {d["name"]: tuple(d.get("entities") or ()) for d in document.get("domains") or []})


def load_layer(spark: SparkSession, path: str) -> Layer:
    """The layer at path; an empty one where there is none."""
    return layer_of(files.read_yaml(spark, path)) if files.exists(spark, path) else Layer(())
