"""Join discovery: naming rules, shared names, catalog signals, value overlap.

Frames: columns(table_name, column_name, data_type, ordinal, is_primary_key, distinct_count,
null_pct, index_type, index_unique, row_count); tables are told by table_name. Candidates:
kind, src_table, src_column, dst_table, dst_column, confidence, reasoning.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import scalars as S

HIGH, MEDIUM, LOW = 0.85, 0.55, 0.25
SAME_NAME_CAP = 3
# Shared names that are no join keys.
BORING_NAMES = (
    "active", "amount", "category", "class", "code", "color", "comments", "count", "created_at", "deleted_at",
    "description", "due_date", "duedate", "end_date", "enddate", "flag", "group", "height", "id", "label",
    "last_update", "lastupdate", "length", "level", "modified_at", "modifieddate", "name", "notes", "order", "position",
    "price", "qty", "quantity", "rank", "rating", "rowguid", "score", "size", "start_date", "startdate",
    "status", "style", "title", "total", "type", "updated_at", "version", "weight", "width",
)
LARGE_ROWS, LOW_CARDINALITY, HIGH_NULLS = 10_000, 50, 80.0


def naming_candidates(columns: DataFrame) -> DataFrame:
    """*_fk and *_id columns whose stem names a table (exactly, in the plural, or as the
    start of its name) that has an `id` column or a primary key."""
    c = columns.select("table_name", "column_name", "ordinal")
    fk, own = F.lower("column_name").endswith("_fk"), F.lower("column_name").endswith("_id")
    c = c.where(fk | (own & (F.lower("column_name") != "id"))).withColumn("kind", F.when(fk, "heuristic_fk").otherwise("heuristic_id"))
    c = c.withColumn("stem", F.when(fk, S.stem(F.col("column_name"), "_fk")).otherwise(S.stem(F.col("column_name"), "_id"))).where(F.length("stem") > 0)
    # the column a join would target: `id`, else the first of the primary key
    id_first = F.struct(F.when(F.col("column_name") == "id", 0).otherwise(1), "ordinal")
    targets = columns.where((F.col("column_name") == "id") | F.coalesce("is_primary_key", F.lit(False))).groupBy("table_name").agg(F.min_by("column_name", id_first).alias("dst_column"))
    tables = columns.groupBy("table_name").agg(F.min("ordinal")).select(F.col("table_name").alias("dst_table"))
    shape = ["table_name", "column_name", "kind", "stem", "dst_table"]
    # exact or plural: an equi-join on the forms of the stem
    forms = c.withColumn("form", F.explode(S.plural_forms(F.col("stem"))))
    exact = forms.join(tables, F.lower("dst_table") == F.col("form")).where(F.col("dst_table") != F.col("table_name")).select(*shape)
    per = Window.partitionBy("table_name", "column_name")
    best = per.orderBy(F.when(F.col("is_exact") & (F.col("n_exact") == 1), 0).otherwise(1), F.length("dst_table"), "dst_table")
    exact = exact.withColumn("is_exact", F.lower("dst_table") == F.lower("stem")).withColumn("n_exact", F.count_if("is_exact").over(per))
    exact = exact.withColumn("r", F.row_number().over(best)).where("r = 1").select(*shape, F.lit(HIGH).alias("confidence"))
    # starts of names, for stems that nothing names: every start of a name is a key, with the two
    # best names that it starts (one may be the column's own table)
    rest = c.join(exact.select("table_name", "column_name"), ["table_name", "column_name"], "left_anti").where(F.length("stem") >= 2)
    cuts = F.when(F.length("dst_table") >= 2, F.sequence(F.lit(2), F.length("dst_table"))).otherwise(F.array().cast("array<int>"))
    starts = tables.select("dst_table", F.explode(F.transform(cuts, lambda n: F.lower(F.substring("dst_table", F.lit(1), n)))).alias("start"))
    place = F.row_number().over(Window.partitionBy("start").orderBy(F.length("dst_table"), "dst_table"))
    starts = starts.withColumn("place", place).where("place <= 2")
    prefix = rest.join(starts, F.lower("stem") == F.col("start")).where(F.col("dst_table") != F.col("table_name"))
    prefix = prefix.withColumn("r", F.row_number().over(per.orderBy("place"))).where("r = 1").select(*shape, F.lit(MEDIUM).alias("confidence"))
    found = exact.unionByName(prefix).join(targets.withColumnRenamed("table_name", "dst_table"), "dst_table")
    reason = F.concat(F.lit("column '"), F.col("column_name"), F.when(F.col("confidence") == HIGH, F.lit("' names table ")).otherwise(F.lit("' starts the name of table ")), F.col("dst_table"))
    return found.select("kind", F.col("table_name").alias("src_table"), F.col("column_name").alias("src_column"), "dst_table", "dst_column", "confidence", reason.alias("reasoning"))


def same_name_candidates(columns: DataFrame, cap: int = SAME_NAME_CAP) -> DataFrame:
    """Columns of the same name on different tables, both ways, at most `cap` of a pair."""
    c = columns.select("table_name", "column_name").where(~F.lower("column_name").isin(*BORING_NAMES)).distinct()
    shared = c.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("column_name"))).where("n >= 2")
    other = shared.select(F.col("table_name").alias("dst_table"), "column_name")
    pairs = shared.join(other, "column_name").where(F.col("table_name") != F.col("dst_table"))
    order = Window.partitionBy("table_name", "dst_table").orderBy((F.lit(1.0) / F.col("n")).desc(), "column_name")
    pairs = pairs.withColumn("r", F.row_number().over(order)).where(F.col("r") <= cap)
    return pairs.select(F.lit("heuristic_same_name").alias("kind"), F.col("table_name").alias("src_table"), F.col("column_name").alias("src_column"), "dst_table", F.col("column_name").alias("dst_column"), F.lit(LOW).alias("confidence"), F.concat(F.lit("shared column name '"), F.col("column_name"), F.lit("'")).alias("reasoning"))


def apply_catalog_signals(candidates: DataFrame, columns: DataFrame) -> DataFrame:
    """Vetoes, then penalties and boosts, then 0..1."""
    side = lambda p: columns.select(F.col("table_name").alias(f"{p}_table"), F.col("column_name").alias(f"{p}_column"), *[F.col(x).alias(f"{p}_{x}") for x in ("data_type", "distinct_count", "null_pct", "index_type", "index_unique", "row_count")])
    x = candidates.join(side("src"), ["src_table", "src_column"], "left").join(side("dst"), ["dst_table", "dst_column"], "left")
    same = F.col("kind") == "heuristic_same_name"
    poor_index = F.coalesce(F.lower("src_index_type").isin("gin", "brin"), F.lit(False))
    low = F.coalesce((F.col("src_row_count") > LARGE_ROWS) & (F.col("src_distinct_count") >= 0) & (F.col("src_distinct_count") < LOW_CARDINALITY), F.lit(False))
    x = x.where(~(same & (poor_index | low)) & S.types_compatible(F.col("src_data_type"), F.col("dst_data_type")))
    less = lambda cond, v: F.when(F.coalesce(cond, F.lit(False)), F.lit(v)).otherwise(F.lit(0.0))
    conf = F.col("confidence") + less(poor_index & ~same, -0.30) + less(low & (F.col("kind") == "heuristic_id"), -0.20) + less(F.col("dst_index_unique"), 0.15) + less(F.col("src_null_pct") > HIGH_NULLS, -0.15) + less(F.col("dst_null_pct") > HIGH_NULLS, -0.15)
    return x.select("kind", "src_table", "src_column", "dst_table", "dst_column", F.greatest(F.lit(0.0), F.least(F.lit(1.0), conf)).alias("confidence"), "reasoning")


def without_declared(candidates: DataFrame, foreign_keys: DataFrame) -> DataFrame:
    """Without the directed joins that are declared."""
    return candidates.join(foreign_keys, ["src_table", "src_column", "dst_table", "dst_column"], "left_anti")


def strongest(candidates: DataFrame) -> DataFrame:
    """One candidate for each directed column pair: the most confident, by kind on ties."""
    order = Window.partitionBy("src_table", "src_column", "dst_table", "dst_column").orderBy(F.desc("confidence"), "kind")
    return candidates.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def blend_overlap(candidates: DataFrame, overlaps: DataFrame) -> DataFrame:
    """Confidence blended with measured overlap (src_*, dst_*, overlap) where there is one."""
    x = candidates.join(overlaps, ["src_table", "src_column", "dst_table", "dst_column"], "left")
    some = F.col("overlap").isNotNull()
    return x.select(F.when(some, "statistical").otherwise(F.col("kind")).alias("kind"), "src_table", "src_column", "dst_table", "dst_column", F.when(some, S.overlap_blend(F.col("confidence"), F.col("overlap"))).otherwise(F.col("confidence")).alias("confidence"), F.when(some, F.concat(F.lit("statistical: "), "reasoning")).otherwise(F.col("reasoning")).alias("reasoning"))


Scorer = Callable[[DataFrame], DataFrame]
SCORERS: dict[str, Scorer] = {"naming": naming_candidates, "same_name": same_name_candidates}


def register_scorer(name: str, scorer: Scorer) -> None:
    if name in SCORERS:
        raise ValueError(f"scorer {name!r} is registered already")
    SCORERS[name] = scorer


def discover(columns: DataFrame, foreign_keys: DataFrame, aliases: DataFrame | None = None, overlaps: DataFrame | None = None, scorers: dict[str, Scorer] | None = None, combine: Callable[[DataFrame], DataFrame] = strongest) -> DataFrame:
    """All scorers, signals, without declared joins and shadow aliases, strongest first."""
    found = reduce(DataFrame.unionByName, [s(columns) for s in (SCORERS if scorers is None else scorers).values()])
    found = combine(without_declared(apply_catalog_signals(found, columns), foreign_keys))
    if aliases is not None:
        for side in ("src_table", "dst_table"):
            found = found.join(aliases.select(F.col("table_name").alias(side)), side, "left_anti")
    return blend_overlap(found, overlaps) if overlaps is not None else found


def signal_defaults(columns: DataFrame) -> DataFrame:
    """columns with the optional fields that it lacks, as nulls."""
    kinds = {"is_primary_key": "boolean", "distinct_count": "bigint", "null_pct": "double", "index_type": "string", "index_unique": "boolean", "row_count": "bigint"}
    none: dict[str, Column] = {k: F.lit(None).cast(t) for k, t in kinds.items() if k not in columns.columns}
    return columns.withColumns(none) if none else columns
