"""Column expressions for names, types, scores and texts of a catalog."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Which type names belong to which family.
TYPE_FAMILY = {
    "numeric": ("int", "integer", "bigint", "smallint", "tinyint", "serial", "bigserial", "number", "numeric", "decimal", "float", "double", "real", "money"),
    "string": ("varchar", "text", "char", "character", "string", "nvarchar", "nchar", "ntext", "clob", "bpchar", "character varying"),
    "temporal": ("date", "timestamp", "datetime", "timestamptz", "timestamp without time zone", "timestamp with time zone", "time", "interval"),
    "boolean": ("bool", "boolean", "bit"),
    "uuid": ("uuid", "uniqueidentifier"),
    "binary": ("bytea", "blob", "binary", "varbinary", "image"),
}
#: Names that Spark gives types and that the families above lack.
SPARK_TYPES = {"long": "numeric", "short": "numeric", "byte": "numeric", "timestamp_ntz": "temporal", "timestamp_ltz": "temporal"}


def type_family(data_type: Column) -> Column:
    """Family of a type name without its arguments; null where unknown."""
    base = F.trim(F.get(F.split(F.lower(F.trim(data_type)), r"\("), F.lit(0)))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for family, names in TYPE_FAMILY.items():
        out = out.when(base.isin(*names, *[k for k, v in SPARK_TYPES.items() if v == family]), family)
    return out


def types_compatible(a: Column, b: Column) -> Column:
    """An unknown family goes with every other."""
    return F.coalesce(type_family(a) == type_family(b), F.lit(True))


def plural_forms(stem: Column) -> Column:
    s = F.lower(stem)
    forms = F.array(
        s,
        F.concat(s, F.lit("s")),
        F.when(s.endswith("y") & (F.length(s) > 1), F.concat(F.regexp_replace(s, "y$", ""), F.lit("ies"))),
        F.when(s.rlike("(ch|sh|s|x)$"), F.concat(s, F.lit("es"))),
    )
    return F.when(F.length(s) > 0, F.array_distinct(F.array_compact(forms))).otherwise(F.array().cast("array<string>"))


def stem(name: Column, suffix: str) -> Column:
    """The name without the suffix, in its own case."""
    return F.regexp_replace(name, f"(?i){re.escape(suffix)}$", "")


def camel_to_space(x: Column) -> Column:
    return F.regexp_replace(x, "([a-z0-9])([A-Z])", "$1 $2")


def identifier_tokens(x: Column) -> Column:
    """Lower-cased tokens of an identifier, each once, in order."""
    parts = F.split(F.lower(camel_to_space(x)), "[^a-z0-9]+")
    return F.array_distinct(F.filter(parts, lambda t: t != ""))


def query_tokens(x: Column) -> Column:
    return F.filter(F.split(F.lower(F.regexp_replace(x, r"[^A-Za-z0-9]+", " ")), " +"), lambda t: t != "")


def quote_identifier(x: Column, quote: str = '"') -> Column:
    return F.concat(F.lit(quote), F.replace(x, F.lit(quote), F.lit(quote * 2)), F.lit(quote))


def slug(*parts: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.concat_ws("_", *parts)), "[^a-z0-9]+", "_"), F.lit("_"))


def snippet(x: Column, n: int) -> Column:
    return F.when(F.length(x) <= n, x).otherwise(F.concat(F.substring(x, 1, n - 3), F.lit("...")))


def split_qualified(x: Column) -> tuple[Column, Column]:
    """(schema or null, table) of `schema.table`, at the first dot."""
    dot = F.instr(x, ".")
    return F.when(dot > 0, F.substring_index(x, ".", 1)), F.when(dot > 0, F.substr(x, dot + 1)).otherwise(x)


def glob_regex(pattern: str) -> str:
    """A shell pattern as an anchored regular expression (case-sensitive)."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif end > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body) + "]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def matches_glob(x: Column, patterns) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | x.rlike(glob_regex(p))
    return out


def edge_cost(inferred: Column, confidence: Column) -> Column:
    """1 for a declared edge; an inferred one costs more the less sure it is."""
    return F.when(inferred, F.lit(2.5) + F.greatest(F.lit(0.0), F.lit(0.7) - confidence)).otherwise(F.lit(1.0))


def overlap_blend(prior: Column, overlap: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), prior * 0.35 + overlap * 0.65))


def role_confidence(raw: Column, margin: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - F.exp(-raw / 1.4) + F.least(F.lit(0.35), margin * 0.45)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two double arrays; 0 where either has no length, an error where their sizes
    differ."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    na = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    nb = F.sqrt(F.aggregate(b, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unlike = F.raise_error(F.concat(F.lit("vectors of "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string"), F.lit(" numbers"))).cast("double")
    return F.when(F.size(a) != F.size(b), unlike).when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot / (na * nb))


def staleness_days(then: Column, now: Column) -> Column:
    """Whole days, at least 0; null where there is no time."""
    days = F.floor((F.unix_timestamp(now) - F.unix_timestamp(then)) / 86400)
    return F.when(days < 0, 0).otherwise(days).cast("long")


def table_id(connection: Column, schema: Column, table: Column) -> Column:
    return F.concat_ws("::", connection, schema, table)


def short_hash(x: Column, n: int) -> Column:
    return F.left(F.sha2(x.cast("binary"), 256), F.lit(n))


def numeric_type_name(data_type: Column) -> Column:
    return F.lower(data_type).rlike("int|numeric|decimal|double|float|real|money|number")


def distinct_words(x: Column) -> Column:
    """An array's texts, trimmed, without empty ones, each once whatever its case: the first
    spelling stays, in order."""
    words = F.filter(F.transform(x, lambda t: F.trim(t)), lambda t: t.isNotNull() & (t != ""))
    low = F.transform(words, lambda t: F.lower(t))
    return F.filter(words, lambda t, i: F.array_position(low, F.lower(t)) == i + 1)


def name_tokens(x: Column) -> Column:
    """Tokens of an identifier as it is and with its humps parted, each once, in order."""
    low = lambda t: F.split(F.lower(t), "[^a-z0-9]+")
    return distinct_words(F.concat(low(x), low(camel_to_space(x))))


def identifier_terms(schema: Column, table: Column) -> Column:
    """What an index holds of a table's name: the whole name, its parts, their tokens."""
    return F.array_join(distinct_words(F.concat(F.array(F.concat_ws(".", schema, table), schema, table), name_tokens(schema), name_tokens(table))), " ")


def first_tokens(x: Column, most: int = 16) -> Column:
    """At most so many words of a text."""
    return F.array_join(F.slice(F.filter(F.split(x, r"\s+"), lambda t: t != ""), 1, most), " ")


def list_to_json(x: Column) -> Column:
    return F.to_json(x)


def json_to_list(x: Column) -> Column:
    """A JSON array of texts; empty where it is anything else."""
    return F.coalesce(F.from_json(x, "array<string>", {"mode": "PERMISSIVE"}), F.array().cast("array<string>"))


def without_fence(x: Column) -> Column:
    """A text without the code fence around it (three backticks, a language's name)."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(x), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))


def answered_rows(x: Column, schema: str) -> Column:
    """The rows of a JSON array in a text, whatever stands around it; none where it has none."""
    body = F.regexp_extract(without_fence(x), r"(?s)\[.*\]", 0)
    return F.coalesce(F.from_json(body, f"array<{schema}>", {"mode": "PERMISSIVE"}), F.array().cast(f"array<{schema}>"))


def title_case(x: Column) -> Column:
    """A label of words from a name: order_lines becomes Order Lines."""
    return F.initcap(F.regexp_replace(x, "_+", " "))


def iso_time(x: Column) -> Column:
    return F.date_format(F.to_utc_timestamp(x, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
