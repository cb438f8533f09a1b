"""Queries of stored and measured structures over the supplied tables: the inverted index,
value overlap by sketches, paths over large graphs."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import kshortest, overlap, paths, profile, reach
from quarry.operators.postings import InvertedIndex
from quarry.operators.profile_store import ProfileStore
from quarry.queries import _BM25, _FAMILY_SQL, _NAMES, COLUMNS, query
from quarry.sources import catalog


def _folder(spark: SparkSession, tag: str) -> str:
    return f"{reach.checkpoint_folder(spark)}/{tag}-{uuid.uuid4().hex}"


# ---- the stored inverted index ---------------------------------------------------------------


def _document_index(spark: SparkSession, sf_dir: str) -> InvertedIndex:
    """All documents in two segments: those in English, and the others appended."""
    docs = catalog.read_table(spark, sf_dir, "documents")
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    index = InvertedIndex(spark, _folder(spark, "index")).create(docs.where(english), "doc_id", {"text": 1.0})
    index.append(docs.where(~english))
    return index


@query("WITH " + _BM25 + " SELECT doc_id, score FROM sc")
def indexed_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scores, from two segments merged into one."""
    index = _document_index(spark, sf_dir)
    index.merge()
    return index.scores("the MIT license")


@query("WITH " + _BM25 + " SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank FROM sc ORDER BY score DESC, doc_id LIMIT 10")
def indexed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents, reading only the blocks that can hold them."""
    return _document_index(spark, sf_dir).top("the MIT license", 10)


# ---- profiles that merge ----------------------------------------------------------------------


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count, true AS distinct_close FROM {t}" for t in ("lineitem", "orders", "customer", "documents") for c in COLUMNS[t]))
def profile_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of tables from their files' sketches; their distinct counts are held against the
    exact ones (five standard deviations)."""
    store, out = ProfileStore(spark, _folder(spark, "profiles")), []
    for t in ("lineitem", "orders", "customer", "documents"):
        store.refresh(t, f"{sf_dir}/{t}.parquet")
        exact = profile.distinct_counts(catalog.read_table(spark, sf_dir, t), COLUMNS[t]).withColumnRenamed("distinct_count", "exact")
        close = F.abs(F.col("distinct_count") - F.col("exact")) <= 5 * 0.0163 * F.col("exact")
        out.append(store.profile(t).join(exact, "column_name").select(F.lit(t).alias("table_name"), "column_name", "row_count", "null_count", close.alias("distinct_close")))
    return reduce(DataFrame.unionByName, out)


# ---- columns that hold the values of others ---------------------------------------------------

_CELLS = "cells AS (" + " UNION ALL ".join(f"SELECT DISTINCT '{t}' AS t, '{c}' AS c, {c}::VARCHAR AS v FROM {t} WHERE {c} IS NOT NULL" for t, cs in COLUMNS.items() for c in cs) + f"""),
 fam AS (SELECT table_name AS t, column_name AS c, {_FAMILY_SQL} AS family FROM duckdb_columns() WHERE table_name IN ({_NAMES})),
 d AS (SELECT cells.*, family FROM cells JOIN fam USING (t, c) WHERE family IS NOT NULL), n AS (SELECT t, c, count(*) AS n FROM d GROUP BY ALL),
 b AS (SELECT x.t AS src_table, x.c AS src_column, y.t AS dst_table, y.c AS dst_column, count(*) AS n_both FROM d x JOIN d y ON x.v = y.v AND x.family = y.family WHERE x.t <> y.t OR x.c <> y.c GROUP BY ALL)"""


@query("WITH " + _CELLS + " SELECT b.src_table, src_column, dst_table, dst_column, x.n AS n_left, y.n AS n_right, n_both, round(n_both / x.n, 6)::DOUBLE AS containment FROM b JOIN n x ON x.t = src_table AND x.c = src_column JOIN n y ON y.t = dst_table AND y.c = dst_column WHERE round(n_both / x.n, 6) >= 0.5")
def column_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of supplied columns of one type family of which the one holds half of the
    other's values: found by sketches, then counted."""
    tables = {t: catalog.read_table(spark, sf_dir, t).select(*c) for t, c in COLUMNS.items()}
    return overlap.contained(tables, 0.5).drop("jaccard")


# ---- paths over a graph of thousands of tables -----------------------------------------------

#: a table for each customer and each user; purchases declare a key from the customer to the user,
#: and two urgent orders in a row suggest one between their customers
_LARGE = """le AS (SELECT DISTINCT 'c' || o_custkey AS src_table, 'k' AS src_column, 'u' || user_id AS dst_table, 'id' AS dst_column, 'fk' AS kind, 1.0::DOUBLE AS confidence
   FROM orders JOIN events ON event_id = o_orderkey WHERE event_type = 'purchase'
   UNION SELECT 'c' || a.o_custkey, 'k', 'c' || b.o_custkey, 'k', 'inferred', round(0.2 + 0.1 * (a.o_orderkey % 7), 2)::DOUBLE
   FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1 WHERE a.o_orderpriority = '1-URGENT' AND b.o_orderpriority = '1-URGENT' AND a.o_custkey <> b.o_custkey),
 adj AS (SELECT * FROM le UNION SELECT dst_table, dst_column, src_table, src_column, kind, confidence FROM le)"""
_LARGE_WALK = """walk AS (SELECT src_table AS f, dst_table AS t, 1 AS depth, [src_table, dst_table] AS tables, CASE kind WHEN 'fk' THEN 1.0::DOUBLE ELSE 2.5 + greatest(0, 0.7 - confidence) END AS cost,
     (kind = 'inferred')::INT AS ninf, src_table || '.' || src_column || '=' || dst_table || '.' || dst_column || ':' || kind AS sig FROM adj {start}
   UNION ALL SELECT f, dst_table, depth + 1, list_append(tables, dst_table), cost + CASE kind WHEN 'fk' THEN 1.0::DOUBLE ELSE 2.5 + greatest(0, 0.7 - confidence) END,
     ninf + (kind = 'inferred')::INT, sig || '|' || src_table || '.' || src_column || '=' || dst_table || '.' || dst_column || ':' || kind
   FROM walk JOIN adj ON t = src_table WHERE depth < 4 AND NOT list_contains(tables, dst_table) AND ninf + (kind = 'inferred')::INT <= 2)"""
_RICH = "SELECT 'c' || c_custkey FROM customer WHERE c_acctbal > 9000"
_RANKED = "SELECT f AS from_table, t AS to_table, rank::INT AS rank, depth, cost, array_to_string(tables, '>') AS path FROM (SELECT *, round(cost, 6) AS cost, row_number() OVER (PARTITION BY f, t ORDER BY round(cost, 6), depth, sig) AS rank FROM walk{goal})"


def large_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, events = catalog.read_table(spark, sf_dir, "orders"), catalog.read_table(spark, sf_dir, "events")
    cust = lambda c: F.concat(F.lit("c"), F.col(c))
    bought = orders.join(events.where("event_type = 'purchase'"), F.col("event_id") == F.col("o_orderkey"))
    declared = bought.select(cust("o_custkey").alias("src_table"), F.lit("k").alias("src_column"), F.concat(F.lit("u"), F.col("user_id")).alias("dst_table"), F.lit("id").alias("dst_column")).distinct()
    urgent = orders.where("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey")
    after = urgent.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("o_custkey").alias("other"))
    guess = urgent.join(after, "o_orderkey").where("o_custkey <> other").select(cust("o_custkey").alias("src_table"), F.lit("k").alias("src_column"), cust("other").alias("dst_table"), F.lit("k").alias("dst_column"), F.round(0.2 + 0.1 * (F.col("o_orderkey") % 7), 2).alias("confidence")).distinct()
    return paths.edges(declared, guess)


@query("WITH RECURSIVE " + _LARGE + ", " + _LARGE_WALK.format(start="") + " " + _RANKED.format(goal="") + " WHERE rank = 1")
def large_best_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest path between any two tables of the large graph."""
    return kshortest.best_paths(large_edges(spark, sf_dir)).select("from_table", "to_table", "rank", "depth", "cost", "path")


@query("WITH RECURSIVE " + _LARGE + f", rich AS ({_RICH}), " + _LARGE_WALK.format(start="WHERE src_table IN (FROM rich)") + " " + _RANKED.format(goal=" WHERE t IN (FROM rich)") + " WHERE rank <= 3")
def large_path_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three cheapest paths between any two customers of large balance."""
    # a stated query set: every customer above the balance with every other
    rich = catalog.read_table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("table_name"))
    return kshortest.k_shortest(large_edges(spark, sf_dir), among=rich).select("from_table", "to_table", "rank", "depth", "cost", "path")
