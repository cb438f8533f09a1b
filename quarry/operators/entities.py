"""Business entities over tables, and which entities of different databases are the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.classify import ENTITY_ROLES, best_per


def candidates(roles: DataFrame) -> DataFrame:
    """Tables that may stand for an entity, by their role."""
    return roles.where(F.col("role").isin(*ENTITY_ROLES))


def entity_text(name: Column, columns: Column) -> Column:
    """What an embedding is made of: "name: column, column"."""
    return F.concat(name, F.lit(": "), F.array_join(columns, ", "))


def resolved(references: DataFrame, tables: DataFrame) -> DataFrame:
    """references(entity, ref) with the table that ref names: schema.table before a bare
    name, the first by name where several tables share it. References to nothing go."""
    bare = F.substring_index(F.col("table_name"), ".", -1)
    t = tables.select("table_name", bare.alias("bare"))
    full = references.join(t, F.lower("ref") == F.lower("table_name")).select("entity", "ref", "table_name", F.lit(0).alias("rank"))
    short = references.join(t, F.lower("ref") == F.lower("bare")).select("entity", "ref", "table_name", F.lit(1).alias("rank"))
    x = full.unionByName(short).withColumn("_k", F.concat_ws("\0", "entity", "ref"))
    return best_per(x, "_k", F.col("rank"), F.col("table_name")).select("entity", "ref", "table_name")


def build(connection: str, entities: DataFrame, tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """entities(name, description, tables array<string>) as Entity nodes and REPRESENTS edges
    (src, dst by table_name). An entity without any known table is left out."""
    refs = resolved(entities.select(F.col("name").alias("entity"), F.explode("tables").alias("ref")), tables)
    node = F.concat_ws("::", F.lit(connection), F.lit("entity"), F.lower(F.col("name")))
    nodes = entities.join(refs.select(F.col("entity").alias("name")).distinct(), "name", "left_semi").select(node.alias("node_id"), F.lit(connection).alias("connection_name"), "name", "description").dropDuplicates(["node_id"])
    edges = refs.select(F.concat_ws("::", F.lit(connection), F.lit("entity"), F.lower("entity")).alias("src"), "table_name").distinct()
    return nodes, edges


def from_roles(roles: DataFrame) -> DataFrame:
    """An entity for each candidate table, named after it (what a language model would group
    is the caller's)."""
    words = F.split(F.regexp_replace(F.substring_index("table_name", ".", -1), "^(dim|fact|fct)_", ""), "_")
    return candidates(roles).select(F.initcap(F.array_join(words, " ")).alias("name"), F.concat(F.lit("Rows of "), F.col("table_name")).alias("description"), F.array("table_name").alias("tables"))


def similar_pairs(left: DataFrame, right: DataFrame, least: float = 0.55) -> DataFrame:
    """left and right (node_id, name, columns array<string>) -> a, b, score: likeness of the
    columns' names and of the entities' names. Only entities that share a column name meet."""
    side = lambda df, p: df.select(F.col("node_id").alias(f"{p}_id"), F.lower("name").alias(f"{p}_name"), F.array_distinct(F.transform("columns", lambda c: F.lower(c))).alias(f"{p}_cols"))
    a, b = side(left, "a"), side(right, "b")
    hits = a.select("a_id", F.explode("a_cols").alias("c")).join(b.select("b_id", F.explode("b_cols").alias("c")), "c").select("a_id", "b_id").distinct().where("a_id <> b_id")
    x = hits.join(a, "a_id").join(b, "b_id")
    shared, every = F.size(F.array_intersect("a_cols", "b_cols")), F.size(F.array_union("a_cols", "b_cols"))
    close = 1 - F.levenshtein("a_name", "b_name") / F.greatest(F.length("a_name"), F.length("b_name"), F.lit(1))
    score = F.round(0.5 * shared / every + 0.5 * close, 6)
    return x.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), score.alias("score")).where(F.col("score") >= least)


def link_id(a: Column, b: Column) -> Column:
    """One name for a pair, whichever comes first."""
    return F.concat_ws("~", F.least(a, b), F.greatest(a, b))


def merge_links(old: DataFrame, new: DataFrame) -> DataFrame:
    """SAME_ENTITY rows (edge_id, src, dst, status, score, ...): a confirmed or rejected link
    keeps its status when it is suggested again; otherwise the new row replaces the old."""
    decided = old.where(F.col("status").isin("confirmed", "rejected"))
    fresh = new.withColumn("edge_id", link_id(F.col("src"), F.col("dst"))).join(decided.select("edge_id"), "edge_id", "left_anti").dropDuplicates(["edge_id"]).select(*old.columns)
    return old.join(fresh.select("edge_id"), "edge_id", "left_anti").select(*old.columns).unionByName(fresh)


def decide_link(links: DataFrame, edge_id: str, status: str, by: str, at: str) -> DataFrame:
    here = F.col("edge_id") == edge_id
    out = links.withColumn("status", F.when(here, status).otherwise(F.col("status")))
    if status == "confirmed":
        out = out.withColumn("confirmed_by", F.when(here, by).otherwise(F.col("confirmed_by"))).withColumn("confirmed_at", F.when(here, at).otherwise(F.col("confirmed_at")))
    return out


def delete_link(links: DataFrame, edge_id: str) -> DataFrame:
    return links.where(F.col("edge_id") != edge_id)


def list_links(links: DataFrame, entities: DataFrame, status: str | None = None) -> DataFrame:
    """Links with the names and connections of both ends, best first; each link once."""
    end = lambda p: entities.select(F.col("node_id").alias(p), F.col("name").alias(f"{p}_name"), F.col("connection_name").alias(f"{p}_connection"))
    x = links if status is None else links.where(F.col("status") == status)
    return x.join(end("src"), "src", "left").join(end("dst"), "dst", "left").dropDuplicates(["edge_id"]).orderBy(F.desc("score"), "edge_id")


def count_links(links: DataFrame) -> DataFrame:
    return links.groupBy("status").agg(F.countDistinct("edge_id").alias("n"))


def top_links(links: DataFrame, entities: DataFrame, k: int = 10) -> DataFrame:
    """The k confirmed links of the greatest score."""
    return list_links(links, entities, "confirmed").limit(k)


def primary_tables(entities: DataFrame, represents: DataFrame, tables: DataFrame) -> DataFrame:
    """node_id, name, description, table_name: each entity with the first of its tables."""
    t = tables.select(F.col("node_id").alias("dst"), "table_name")
    x = entities.join(represents, entities["node_id"] == represents["src"]).join(t, "dst")
    return best_per(x.select("node_id", "name", "description", "table_name"), "node_id", F.col("table_name"))


def entity_of_table(entities: DataFrame, represents: DataFrame) -> DataFrame:
    """table (node_id), entity, description: the first entity of each table by name."""
    x = represents.join(entities.select(F.col("node_id").alias("src"), F.col("name").alias("entity"), "description"), "src")
    r = F.row_number().over(Window.partitionBy("dst").orderBy("entity", "src"))
    return x.withColumn("_r", r).where("_r = 1").select(F.col("dst").alias("table"), "entity", "description")


def bridges(links: DataFrame, represents: DataFrame) -> DataFrame:
    """a_table, b_table, score: tables that confirmed links join across databases."""
    side = lambda p, c: represents.select(F.col("src").alias(p), F.col("dst").alias(c))
    return links.where("status = 'confirmed'").select("src", "dst", "score").join(side("src", "a_table"), "src").join(side("dst", "b_table"), "dst").select("a_table", "b_table", "score").distinct()
