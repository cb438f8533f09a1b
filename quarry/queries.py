"""The engine's registered queries and, for each that SQL can express, DuckDB's version."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import scalars as S
from quarry.operators import classify, cluster, cypher, dbt, discover, drift, graph, overlap, paths, profile, reach, search, semantic, visibility
from quarry.plans import sql_walk
from quarry.sources import catalog, warehouse

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (int, float)):
        return repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(_literal(x) for x in v) + "]"
    return "'" + str(v).replace("'", "''") + "'"


def _values(name: str, columns: str, rows) -> str:
    """A CTE of literal rows."""
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(_literal(v) for v in r) + ')' for r in rows)})"


FK_ROWS = list(catalog.FOREIGN_KEYS)
#: guesses of joins, and how sure each is before it is measured
GUESSES = [("documents", "source", "pages", "url", 0.4), ("conversations", "conv_id", "events", "event_id", 0.9), ("benchmark", "item_id", "documents", "doc_id", 0.6)]


def _contained_sql(a: str, b: str, c: str, d: str) -> str:
    """The share of a.b's distinct values that c.d has."""
    side = lambda t, k: f"(SELECT DISTINCT {k}::VARCHAR AS v FROM {t} WHERE {k} IS NOT NULL)"
    return f"(SELECT round(count(y.v) / count(*), 6)::DOUBLE FROM {side(a, b)} x LEFT JOIN {side(c, d)} y ON x.v = y.v)"


#: the declared keys that the data confirm: all values of the one column are in the other
_FK = "fk AS (SELECT src_table, src_column, dst_table, dst_column FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS src_table, '{b}' AS src_column, '{c}' AS dst_table, '{d}' AS dst_column, {_contained_sql(a, b, c, d)} AS share" for a, b, c, d in FK_ROWS) + ") WHERE share = 1)"


def measured(spark: SparkSession, sf_dir: str, pairs: list[tuple]) -> DataFrame:
    """src_*, dst_*, containment of column pairs, from the tables' values."""
    names = {t for p in pairs for t in (p[0], p[2])}
    return reach.checkpointed(overlap.measure({t: catalog.read_table(spark, sf_dir, t) for t in names}, catalog.foreign_keys(spark, [p[:4] for p in pairs])))


def _keys_in(rows: DataFrame) -> DataFrame:
    return rows.where("containment = 1 AND n_left > 0").select("src_table", "src_column", "dst_table", "dst_column")


def confirmed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The declared keys that the data confirm."""
    return _keys_in(measured(spark, sf_dir, FK_ROWS))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed keys, and guesses blended with the containment that the data show."""
    found = measured(spark, sf_dir, FK_ROWS + GUESSES)
    guess = spark.createDataFrame([("guess", *g, "") for g in GUESSES], "kind string, src_table string, src_column string, dst_table string, dst_column string, confidence double, reasoning string")
    keys = found.join(catalog.foreign_keys(spark), ["src_table", "src_column", "dst_table", "dst_column"], "left_semi")
    told = discover.blend_overlap(guess, found.select("src_table", "src_column", "dst_table", "dst_column", F.col("containment").alias("overlap")))
    return paths.edges(_keys_in(keys), told.withColumn("confidence", F.round("confidence", 6)))


_EDGES = _FK + ", inf AS (" + " UNION ALL ".join(f"SELECT '{a}' AS src_table, '{b}' AS src_column, '{c}' AS dst_table, '{d}' AS dst_column, round(0.35 * {p}::DOUBLE + 0.65 * {_contained_sql(a, b, c, d)}, 6)::DOUBLE AS confidence" for a, b, c, d, p in GUESSES) + """),
 edge AS (SELECT src_table, src_column, dst_table, dst_column, 'fk' AS kind, 1.0::DOUBLE AS confidence FROM fk
          UNION ALL SELECT src_table, src_column, dst_table, dst_column, 'inferred', confidence FROM inf),
 adj AS (SELECT * FROM edge UNION SELECT dst_table, dst_column, src_table, src_column, kind, confidence FROM edge)"""
_WALK = _EDGES + """,
 walk AS (
   SELECT src_table AS f, dst_table AS t, 1 AS depth, [src_table, dst_table] AS tables,
     CASE kind WHEN 'fk' THEN 1.0::DOUBLE ELSE 2.5 + greatest(0, 0.7 - confidence) END AS cost, confidence AS conf, confidence AS low,
     (kind = 'inferred')::INT AS ninf,
     src_table || '.' || src_column || '=' || dst_table || '.' || dst_column || ':' || kind AS sig,
     'JOIN ' || dst_table || ' ON ' || src_table || '.' || src_column || ' = ' || dst_table || '.' || dst_column AS hint
   FROM adj
   UNION ALL
   SELECT f, dst_table, depth + 1, list_append(tables, dst_table),
     cost + CASE kind WHEN 'fk' THEN 1.0::DOUBLE ELSE 2.5 + greatest(0, 0.7 - confidence) END, conf * confidence, least(low, confidence),
     ninf + (kind = 'inferred')::INT,
     sig || '|' || src_table || '.' || src_column || '=' || dst_table || '.' || dst_column || ':' || kind,
     hint || ' JOIN ' || dst_table || ' ON ' || src_table || '.' || src_column || ' = ' || dst_table || '.' || dst_column
   FROM walk JOIN adj ON t = src_table
   WHERE depth < 4 AND NOT list_contains(tables, dst_table) AND ninf + (kind = 'inferred')::INT <= 2)"""


# ---- sources and profiles --------------------------------------------------------

_FAMILY_SQL = "CASE WHEN data_type IN ('INTEGER', 'BIGINT', 'DOUBLE') THEN 'numeric' WHEN data_type = 'VARCHAR' THEN 'string' WHEN data_type = 'TIMESTAMP' THEN 'temporal' END"
_NAMES = ", ".join(f"'{t}'" for t in catalog.TABLES)


@query(f"SELECT table_name, column_name, column_index::INT AS ordinal, {_FAMILY_SQL} AS family FROM duckdb_columns() WHERE table_name IN ({_NAMES})")
def catalog_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.columns(spark, sf_dir).where("parent IS NULL").select("table_name", "column_name", "ordinal", S.type_family(F.col("data_type")).alias("family"))


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in catalog.TABLES))
def catalog_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.table_counts(spark, sf_dir)


def _profile_sql(table: str, cols: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS distinct_count, round(100.0 * (count(*) - count({c})) / greatest(count(*), 1), 2)::DOUBLE AS null_pct FROM {table}" for c in cols)


def _profiled(table: str, cols: list[str]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return profile.column_profile(catalog.read_table(spark, sf_dir, table).select(*cols)).select("column_name", "row_count", "null_count", "distinct_count", "null_pct")

    run.__name__ = f"profile_{table}"
    query(_profile_sql(table, cols))(run)


#: every column of the supplied tables that holds single values
COLUMNS = {
    "region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_name", "n_regionkey"], "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"], "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"], "documents": ["doc_id", "text", "lang", "source", "n_chars"], "pages": ["page_id", "url", "html"], "benchmark": ["item_id", "text"], "labels": ["doc_id", "quality", "toxic"], "conversations": ["conv_id", "turn", "role", "text"],
}
for _t in ("lineitem", "orders", "customer", "part", "supplier", "events", "documents", "pages", "labels", "conversations"):
    _profiled(_t, COLUMNS[_t])


_BOUNDED = [c for c in COLUMNS["orders"] if c != "o_orderdate"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, min({c})::VARCHAR AS min_value, max({c})::VARCHAR AS max_value FROM orders" for c in _BOUNDED) + " UNION ALL SELECT 'o_orderdate', strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S'), strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') FROM orders")
def profile_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds are taken in the column's type and then shown as text."""
    return profile.column_profile(catalog.read_table(spark, sf_dir, "orders")).select("column_name", "min_value", "max_value")


_LOW = [c for c in COLUMNS["lineitem"] if c != "l_shipdate"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, string_agg(v, '|' ORDER BY v) AS sample_values FROM (SELECT DISTINCT {c}::VARCHAR AS v FROM lineitem WHERE {c} IS NOT NULL) HAVING count(*) BETWEEN 1 AND 50" for c in _LOW) + " UNION ALL SELECT 'l_shipdate', string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS v FROM lineitem WHERE l_shipdate IS NOT NULL) HAVING count(*) BETWEEN 1 AND 50")
def low_cardinality_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.low_cardinality_values(catalog.read_table(spark, sf_dir, "lineitem"))


_MCV = {"orders": [c for c in COLUMNS["orders"] if c not in ("o_orderdate", "o_totalprice")]}


@query(" UNION ALL ".join(f"SELECT * FROM (SELECT '{c}' AS column_name, {c}::VARCHAR AS value, count(*) AS frequency, (row_number() OVER (ORDER BY count(*) DESC, {c}::VARCHAR))::INT AS rank FROM orders WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rank <= 20" for c in _MCV["orders"]))
def most_common_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.most_common_values(catalog.read_table(spark, sf_dir, "orders"), _MCV["orders"])


@query("SELECT i::INT AS bucket, b AS bound FROM (SELECT unnest(quantile_cont(o_totalprice, [0.0, 0.25, 0.5, 0.75, 1.0])) AS b, unnest(range(5)) AS i FROM orders)")
def histogram_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.exact_quantiles(catalog.read_table(spark, sf_dir, "orders"), "o_totalprice", 4)


_PK_TABLES = COLUMNS


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name FROM {t} HAVING count(*) = count(DISTINCT {c}) AND count(*) > 0" for t, cs in _PK_TABLES.items() for c in cs))
def key_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.key_candidates({t: catalog.read_table(spark, sf_dir, t).select(*c) for t, c in _PK_TABLES.items()})


@query(" UNION ALL ".join(f"SELECT '{a}' AS src_table, '{b}' AS src_column, '{c}' AS dst_table, '{d}' AS dst_column, (SELECT count({b}) FROM {a}) AS n_rows, (SELECT count(*) FROM {a} WHERE {b} IS NOT NULL AND {b} NOT IN (SELECT {d} FROM {c} WHERE {d} IS NOT NULL)) AS n_orphans" for a, b, c, d in FK_ROWS))
def key_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {t for k in FK_ROWS for t in (k[0], k[2])}
    return profile.key_integrity(spark, {t: catalog.read_table(spark, sf_dir, t) for t in names}, FK_ROWS)


_OVERLAPS = [("events", "user_id", "customer", "c_custkey"), ("labels", "doc_id", "documents", "doc_id"), ("part", "p_size", "supplier", "s_suppkey")]


@query("WITH " + ", ".join(f"a{i} AS (SELECT DISTINCT {b}::VARCHAR AS v FROM {a} WHERE {b} IS NOT NULL), b{i} AS (SELECT DISTINCT {d}::VARCHAR AS v FROM {c} WHERE {d} IS NOT NULL)" for i, (a, b, c, d) in enumerate(_OVERLAPS)) + " " + " UNION ALL ".join(f"SELECT '{a}.{b}' AS src, '{c}.{d}' AS dst, na AS n_left, nb AS n_right, nab AS n_both, round(nab / (na + nb - nab), 6)::DOUBLE AS jaccard, round(nab / na, 6)::DOUBLE AS containment FROM (SELECT (SELECT count(*) FROM a{i}) AS na, (SELECT count(*) FROM b{i}) AS nb, (SELECT count(*) FROM a{i} JOIN b{i} USING (v)) AS nab)" for i, (a, b, c, d) in enumerate(_OVERLAPS)))
def value_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for a, b, c, d in _OVERLAPS:
        one = profile.value_overlap(catalog.read_table(spark, sf_dir, a), b, catalog.read_table(spark, sf_dir, c), d).select(F.lit(f"{a}.{b}").alias("src"), F.lit(f"{c}.{d}").alias("dst"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT user_id, count(*) AS n_access, max(ts) AS last_access, date_diff('day', max(ts), (SELECT max(ts) FROM events))::BIGINT AS days_unused FROM events GROUP BY user_id")
def access_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accesses of each object, the last one, and the days since (calendar days)."""
    ev = catalog.read_table(spark, sf_dir, "events")
    last = ev.agg(F.max("ts").alias("now"))
    return ev.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_access"), F.max("ts").alias("last_access")).crossJoin(F.broadcast(last)).select("user_id", "n_access", "last_access", F.datediff("now", "last_access").cast("long").alias("days_unused"))


@query("SELECT coalesce(r.user_id, w.user_id) AS user_id, coalesce(nr, 0) AS n_reads, coalesce(nw, 0) AS n_writes FROM (SELECT user_id, count(*) AS nr FROM events WHERE event_type IN ('view', 'click') GROUP BY 1) r FULL JOIN (SELECT user_id, count(*) AS nw FROM events WHERE event_type NOT IN ('view', 'click') GROUP BY 1) w ON r.user_id = w.user_id")
def access_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads and writes of each object, each counted before the full outer join."""
    ev = catalog.read_table(spark, sf_dir, "events")
    read = F.col("event_type").isin("view", "click")
    r, w = ev.where(read).groupBy("user_id").agg(F.count(F.lit(1)).alias("nr")), ev.where(~read).groupBy("user_id").agg(F.count(F.lit(1)).alias("nw"))
    return r.join(w, "user_id", "full").select("user_id", F.coalesce("nr", F.lit(0)).alias("n_reads"), F.coalesce("nw", F.lit(0)).alias("n_writes"))


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS nations FROM nation GROUP BY n_regionkey")
def ordered_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))
    return catalog.read_table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(n["n_name"], ",").alias("nations"))


INDEXES = [("orders", "id", "orders_pk", "btree", True), ("orders", "customer_id", "orders_c", "btree", False), ("orders", "customer_id", "orders_c_u", "hash", True), ("orders", "tags", "orders_g", "gin", False), ("orders", "tags", "orders_t", "btree", False)]


@query("WITH " + _values("x", "table_name, column_name, index_name, index_type, is_unique", INDEXES) + " SELECT table_name, column_name, index_name, index_type FROM (SELECT *, row_number() OVER (PARTITION BY table_name, column_name ORDER BY is_unique DESC, (index_type = 'btree') DESC, index_name) AS r FROM x) WHERE r = 1")
def best_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best index of each column: unique first, then btree."""
    x = spark.createDataFrame(INDEXES, "table_name string, column_name string, index_name string, index_type string, is_unique boolean")
    return classify.best_per(x.withColumn("k", F.concat_ws(".", "table_name", "column_name")), "k", F.desc("is_unique"), (F.col("index_type") == "btree").desc(), F.col("index_name")).select("table_name", "column_name", "index_name", "index_type")


# ---- joins between tables --------------------------------------------------------

#: the supplied columns with what their values show; a column whose values all differ is a key
_SHOP = "measured AS (" + " UNION ALL ".join(f"SELECT '{t}' AS t, '{c}' AS col, {i + 1} AS ord, count(*) AS n, count(DISTINCT {c}) AS dc, round(100.0 * (count(*) - count({c})) / greatest(count(*), 1), 2)::DOUBLE AS nulls FROM {t}" for t, cs in COLUMNS.items() for i, c in enumerate(cs)) + """),
 c AS (SELECT m.*, CASE WHEN data_type IN ('INTEGER', 'BIGINT', 'DOUBLE') THEN 'numeric' WHEN data_type = 'VARCHAR' THEN 'varchar' WHEN data_type LIKE 'TIMESTAMP%' THEN 'timestamp' END AS typ,
   n > 0 AND dc = n AS pk, NULL::VARCHAR AS idx, n > 0 AND dc = n AS uniq FROM measured m JOIN duckdb_columns() k ON k.table_name = t AND k.column_name = col)"""


def measured_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplied columns with counts, distinct values and null shares measured."""
    out = None
    for t, cs in COLUMNS.items():
        df = catalog.read_table(spark, sf_dir, t).select(*cs)
        kinds = spark.createDataFrame([(c, k, i + 1) for i, (c, k) in enumerate(df.dtypes)], "column_name string, data_type string, ordinal int")
        key = (F.col("row_count") > 0) & (F.col("distinct_count") == F.col("row_count"))
        one = profile.column_profile(df).join(kinds, "column_name").select(F.lit(t).alias("table_name"), "column_name", "data_type", "ordinal", key.alias("is_primary_key"), "distinct_count", "null_pct", F.lit(None).cast("string").alias("index_type"), key.alias("index_unique"), "row_count")
        out = one if out is None else out.unionByName(one)
    return reach.checkpointed(out)


_NAMING = _SHOP + """,
 s AS (SELECT t, col, ord, CASE WHEN lower(col) LIKE '%\\_fk' ESCAPE '\\' THEN 'heuristic_fk' ELSE 'heuristic_id' END AS kind, left(col, length(col) - 3) AS stem FROM c
       WHERE lower(col) LIKE '%\\_fk' ESCAPE '\\' OR (lower(col) LIKE '%\\_id' ESCAPE '\\' AND lower(col) <> 'id')),
 tabs AS (SELECT DISTINCT t AS dt FROM c),
 tgt AS (SELECT t AS dt, arg_min(col, ord + CASE WHEN col = 'id' THEN 0 ELSE 1000 END) AS dcol FROM c WHERE col = 'id' OR pk GROUP BY t),
 hit AS (SELECT s.*, dt, CASE WHEN lower(dt) IN (lower(stem), lower(stem) || 's') OR (lower(stem) LIKE '%y' AND lower(dt) = left(lower(stem), length(stem) - 1) || 'ies')
                 OR (regexp_matches(lower(stem), '(ch|sh|s|x)$') AND lower(dt) = lower(stem) || 'es') THEN 0.85
              WHEN starts_with(lower(dt), lower(stem)) AND length(stem) >= 2 THEN 0.55 END AS confidence
         FROM s JOIN tabs ON dt <> t),
 best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t, col ORDER BY confidence DESC, (lower(dt) = lower(stem)) DESC, length(dt), dt) AS r FROM hit WHERE confidence IS NOT NULL) WHERE r = 1),
 naming AS (SELECT kind, t AS src_table, col AS src_column, best.dt AS dst_table, dcol AS dst_column, confidence FROM best JOIN tgt USING (dt))"""


@query("WITH " + _NAMING + " SELECT * REPLACE (confidence::DOUBLE AS confidence) FROM naming")
def infer_joins_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover.naming_candidates(measured_catalog(spark, sf_dir)).drop("reasoning")


_BORING = ", ".join(f"'{n}'" for n in discover.BORING_NAMES)
_SAME = f"""sh AS (SELECT t, col, count(*) OVER (PARTITION BY col) AS n FROM (SELECT DISTINCT t, col FROM c WHERE lower(col) NOT IN ({_BORING}))),
 pr AS (SELECT a.t AS s, b.t AS d, a.col AS cn, row_number() OVER (PARTITION BY a.t, b.t ORDER BY 1.0 / a.n DESC, a.col) AS r FROM sh a JOIN sh b ON a.col = b.col AND a.t <> b.t WHERE a.n >= 2),
 same AS (SELECT 'heuristic_same_name' AS kind, s AS src_table, cn AS src_column, d AS dst_table, cn AS dst_column, 0.25 AS confidence FROM pr WHERE r <= 3)"""


@query("WITH " + _SHOP + ", " + _SAME + " SELECT * REPLACE (confidence::DOUBLE AS confidence) FROM same")
def infer_joins_same_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover.same_name_candidates(measured_catalog(spark, sf_dir)).drop("reasoning")


_FAM = lambda x: f"CASE split_part({x}.typ, '(', 1) WHEN 'integer' THEN 'numeric' WHEN 'numeric' THEN 'numeric' WHEN 'varchar' THEN 'string' WHEN 'timestamp' THEN 'temporal' END"


@query("WITH " + _FK + ", " + _NAMING + ", " + _SAME + f""", every AS (SELECT * FROM naming UNION ALL SELECT * FROM same),
 sig AS (SELECT e.kind, src_table, src_column, dst_table, dst_column, greatest(0, least(1, e.confidence::DOUBLE
     - CASE WHEN a.idx IN ('gin', 'brin') AND e.kind <> 'heuristic_same_name' THEN 0.3::DOUBLE ELSE 0 END
     - CASE WHEN a.n > 10000 AND a.dc < 50 AND e.kind = 'heuristic_id' THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN b.uniq THEN 0.15::DOUBLE ELSE 0 END
     - CASE WHEN a.nulls > 80 THEN 0.15::DOUBLE ELSE 0 END - CASE WHEN b.nulls > 80 THEN 0.15::DOUBLE ELSE 0 END)) AS confidence
   FROM every e JOIN c a ON a.t = src_table AND a.col = src_column JOIN c b ON b.t = dst_table AND b.col = dst_column
   WHERE {_FAM('a')} = {_FAM('b')} AND NOT (e.kind = 'heuristic_same_name' AND (coalesce(a.idx IN ('gin', 'brin'), false) OR (a.n > 10000 AND a.dc < 50))))
 SELECT kind, src_table, src_column, dst_table, dst_column, round(confidence, 6) AS confidence FROM sig
 WHERE (src_table, src_column, dst_table, dst_column) NOT IN (SELECT (src_table, src_column, dst_table, dst_column) FROM fk)""")  # fmt: skip
def infer_joins_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both rules with catalog signals, without declared joins, the strongest of each."""
    return discover.discover(measured_catalog(spark, sf_dir), confirmed_keys(spark, sf_dir)).select("kind", "src_table", "src_column", "dst_table", "dst_column", F.round("confidence", 6).alias("confidence"))


@query("""WITH a AS (SELECT DISTINCT user_id::VARCHAR AS v FROM events WHERE user_id IS NOT NULL), b AS (SELECT DISTINCT c_custkey::VARCHAR AS v FROM customer),
 o AS (SELECT (SELECT count(*) FROM a JOIN b USING (v)) / (SELECT count(*) FROM a) AS overlap)
 SELECT 'events' AS src_table, 'customer' AS dst_table, round(0.35 * 0.55::DOUBLE + 0.65 * round(overlap, 6), 6)::DOUBLE AS confidence FROM o""")  # fmt: skip
def infer_joins_measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A naming guess blended with the containment that the data show."""
    guess = spark.createDataFrame([("heuristic_id", "events", "user_id", "customer", "c_custkey", 0.55, "")], "kind string, src_table string, src_column string, dst_table string, dst_column string, confidence double, reasoning string")
    seen = profile.value_overlap(catalog.read_table(spark, sf_dir, "events"), "user_id", catalog.read_table(spark, sf_dir, "customer"), "c_custkey").select(F.lit("events").alias("src_table"), F.lit("user_id").alias("src_column"), F.lit("customer").alias("dst_table"), F.lit("c_custkey").alias("dst_column"), F.col("containment").alias("overlap"))
    return discover.blend_overlap(guess, seen).select("src_table", "dst_table", F.round("confidence", 6).alias("confidence"))


@query("WITH " + _FK + f", t AS (SELECT unnest([{_NAMES}]) AS table_name) SELECT table_name, (SELECT count(DISTINCT dst_table) FROM fk WHERE src_table = table_name) AS fk_out, (SELECT count(DISTINCT src_table) FROM fk WHERE dst_table = table_name) AS fk_in FROM t")
def fk_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = spark.createDataFrame([(t,) for t in catalog.TABLES], "table_name string")
    return classify.degrees(tables, confirmed_keys(spark, sf_dir))


#: own cases: name, columns, fk_out, fk_in, rows, sequential and index scans, inserts, updates
ROLE_ROWS = [
    ("tmp_upload", ["line", "raw"], 0, 0, 40, None, None, None, None), ("raw_clicks", ["at", "url", "agent"], 0, 0, 90_000, 950, 10, None, None), ("price_history", ["price_id", "valid_from_date", "valid_to_date"], 1, 0, None, None, None, None, None),
    ("schema_migrations", ["version"], 0, 0, None, None, None, None, None), ("pg_buffers", ["a"], 0, 0, None, None, None, None, None), ("actor_film", ["actor_id", "film_id"], 2, 0, 5000, None, None, None, None),
    ("fct_shipments", ["shipment_id", "order_id", "carrier_id", "day_date", "weight"], 3, 0, 700_000, 5000, 10, 9000, 100), ("lineitem", COLUMNS["lineitem"], 3, 0, 6_000_000, None, None, None, None), ("dim_store", ["store_id", "city"], 0, 3, 200, None, None, None, None),
    ("nation", COLUMNS["nation"], 1, 2, 25, None, None, None, None), ("region", COLUMNS["region"], 0, 1, 5, None, None, None, None), ("bridge_accounts", ["account_id", "owner_id", "since"], 2, 2, 800, None, None, None, None), ("hub", ["id", "a", "b", "c", "d"], 4, 4, 800, None, None, None, None),
    ("summary_week", ["week", "sum_net", "avg_tax"], 0, 0, 52, None, None, None, None), ("invoices", ["invoice_id", "total_due", "customer_id"], 1, 1, 3000, None, None, None, None), ("snap_stock", ["sku", "taken_date", "until_date"], 1, 0, 90, None, None, None, None), ("notes", ["body"], 0, 0, None, None, None, None, None), ("x", [], 0, 0, None, None, None, None, None),
]
_ROLE_SQL = "WITH " + _values("x", "t, cols, o, i, n, ss, xs, ins, upd", ROLE_ROWS) + r""",
 y AS (SELECT *, lower(trim(t)) AS lt, len(cols) AS k, coalesce(ins, 0) + coalesce(upd, 0) AS wr, coalesce(ss, 0) AS rd, coalesce(ss, 0) + coalesce(xs, 0) AS sc,
   len(list_filter(cols, lambda c: regexp_matches(c, '(?i)_id$'))) AS fkc, len(list_filter(cols, lambda c: regexp_matches(c, '(?i)(^|_)(date|time|timestamp|day|month|year)($|_)'))) AS dc,
   len(list_filter(cols, lambda c: lower(c) = 'id')) > 0 AS has_id, len(list_filter(cols, lambda c: regexp_matches(c, '(?i)^(id|[a-z][a-z0-9_]*_id)$'))) > 0 AS sur,
   len(list_filter(cols, lambda c: contains(lower(c), 'total') OR regexp_matches(lower(c), '^(sum_|avg_|count_)'))) > 0 AS tot FROM x),
 z AS (SELECT *, coalesce(sc > 0 AND n > 10000 AND rd / sc > 0.9, false) AS seq FROM y),
 s AS (SELECT t, [
   CASE WHEN lt IN ('migrations', 'schema_migrations') OR regexp_matches(lt, '^(ar_internal_|pg_)') THEN 2.5 ELSE 0 END,
   CASE WHEN regexp_matches(lt, '^(stg_|raw_|tmp_|staging_)') THEN 2.2 ELSE 0 END + CASE WHEN seq THEN 0.15 ELSE 0 END,
   CASE WHEN regexp_matches(lt, '(_audit|_log|_history|_changelog)$') THEN 2.0 ELSE 0 END,
   CASE WHEN NOT regexp_matches(lt, '^(dim_|fact_)') AND regexp_matches(trim(t), '^[a-z][a-z0-9]*_[a-z][a-z0-9]*$') AND NOT has_id AND k BETWEEN 2 AND 3 THEN 1.8 ELSE 0 END,
   CASE WHEN o >= 3 THEN 0.55 + least(0.45, (o - 3) * 0.12) ELSE 0 END + CASE WHEN o = 2 THEN 0.25 ELSE 0 END + CASE WHEN fkc >= 3 AND o >= 2 THEN 0.15 ELSE 0 END + CASE WHEN n > 500000 AND o >= 2 THEN 0.2 ELSE 0 END
     + CASE WHEN coalesce(ss, ins, upd) IS NOT NULL AND wr > 500 AND rd > 0 AND wr > rd * 0.15 THEN least(0.35::DOUBLE, ln(1 + wr) / 25) ELSE 0 END + CASE WHEN seq THEN 0.15 ELSE 0 END
     + CASE WHEN regexp_matches(lt, '^(fact_|fct_)') THEN 1.1 WHEN regexp_matches(lt, '(_fact$|_fact_)') THEN 0.85 ELSE 0 END,
   CASE WHEN i >= 2 AND o <= 1 THEN 0.4 + least(0.35, (i - 2) * 0.12) ELSE 0 END + CASE WHEN k >= 2 AND fkc <= 1 AND o <= 1 THEN 0.2 ELSE 0 END + CASE WHEN n < 50000 AND i >= 1 AND o <= 1 THEN 0.12 ELSE 0 END + CASE WHEN regexp_matches(lt, '(^dim_|_dim$|_dim_)') THEN 1.1 ELSE 0 END,
   CASE WHEN o >= 2 AND i >= 2 THEN 0.85 + least(0.4, (least(o, i) - 2) * 0.1) ELSE 0 END + CASE WHEN regexp_matches(lt, '(^bridge_|_bridge_|_bridge$)') THEN 1.0 ELSE 0 END,
   CASE WHEN tot THEN 0.55 ELSE 0 END + CASE WHEN regexp_matches(lt, '^(agg_|aggregate_|summary_|rollup_)') THEN 1.2 ELSE 0 END,
   CASE WHEN dc >= 2 AND o >= 1 THEN 0.5 ELSE 0 END + CASE WHEN regexp_matches(lt, '(snapshot|^snap_|_scd)') THEN 1.0 ELSE 0 END,
   least(k, 8) * 0.08 / 8.0 + CASE WHEN sur THEN 0.35 ELSE 0.05 END]::DOUBLE[] AS v FROM z),
 u AS (SELECT t, list_append(v, CASE WHEN list_max(v) < 0.15 THEN 0.25 ELSE 0 END::DOUBLE) AS v FROM s)
 SELECT t AS table_name, ['system', 'staging', 'audit', 'junction', 'fact', 'dimension', 'bridge', 'aggregate', 'snapshot_scd', 'entity_candidate', 'unknown'][list_position(v, list_max(v))] AS role, round(list_max(v), 4) AS score,
   round(greatest(0, least(1, 1 - exp(-list_max(v) / 1.4) + least(0.35, 0.45 * (list_max(v) - list_sort(v, 'DESC')[2])))), 4) AS confidence FROM u"""


@query(_ROLE_SQL)
def table_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = spark.createDataFrame(ROLE_ROWS, "table_name string, columns array<string>, fk_out bigint, fk_in bigint, row_count bigint, seq_scans bigint, idx_scans bigint, inserts bigint, updates bigint")
    return classify.classify(x).select("table_name", "role", F.round("score", 4).alias("score"), F.round("confidence", 4).alias("confidence"))


@query("WITH RECURSIVE " + _WALK + " SELECT f AS from_table, t AS to_table, depth, round(cost, 6) AS cost, round(conf, 6) AS confidence, low AS min_confidence, ninf AS n_inferred, array_to_string(tables, '>') AS path FROM walk")
def join_paths_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.enumerate_paths(_edges(spark, sf_dir)).drop("steps")


@query("WITH RECURSIVE " + _WALK + " SELECT from_table, to_table, rank::INT AS rank, depth, cost, path, tied FROM (SELECT *, cost = best AS at_best, count(*) FILTER (cost = best) OVER (PARTITION BY from_table, to_table) > 1 AS tied FROM (SELECT f AS from_table, t AS to_table, depth, round(cost, 6) AS cost, array_to_string(tables, '>') AS path, row_number() OVER (PARTITION BY f, t ORDER BY round(cost, 6), depth, sig) AS rank, min(round(cost, 6)) OVER (PARTITION BY f, t) AS best FROM walk)) WHERE rank <= 3")
def join_path_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.ranked(paths.enumerate_paths(_edges(spark, sf_dir))).select("from_table", "to_table", "rank", "depth", "cost", "path", "tied")


@query("WITH RECURSIVE " + _WALK + " SELECT f || ' -> ' || t || ' (' || depth || ' hop)' AS label, 'FROM ' || f || ' ' || hint AS hint FROM walk WHERE f = 'lineitem' AND t = 'region' QUALIFY row_number() OVER (ORDER BY round(cost, 6), depth, sig) <= 3")
def join_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = paths.ranked(paths.enumerate_paths(_edges(spark, sf_dir), start="lineitem", goal="region"))
    return best.select(paths.label(F.col("from_table"), F.col("to_table"), F.col("depth")).alias("label"), paths.sql_hint(F.col("steps")).alias("hint"))


COMPOSITE = [("li_ps", 1, "lineitem", "l_partkey", "partsupp", "ps_partkey"), ("li_ps", 2, "lineitem", "l_suppkey", "partsupp", "ps_suppkey"), ("li_o", 1, "lineitem", "l_orderkey", "orders", "o_orderkey")]


@query("WITH " + _values("k", "constraint_name, position, src_table, src_column, dst_table, dst_column", COMPOSITE) + " SELECT constraint_name, src_table, string_agg(src_column, ',' ORDER BY position) AS src_column, dst_table, string_agg(dst_column, ',' ORDER BY position) AS dst_column FROM k GROUP BY constraint_name, src_table, dst_table")
def composite_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.collapse_composite(spark.createDataFrame(COMPOSITE, "constraint_name string, position int, src_table string, src_column string, dst_table string, dst_column string"))


_IMPACT = """walk2 AS (SELECT src_table AS t, 1 AS hop, confidence AS conf, src_table || '.' || src_column AS via FROM edge WHERE dst_table = 'region'
   UNION ALL SELECT src_table, hop + 1, least(conf, confidence), via || ' > ' || src_table || '.' || src_column FROM walk2 JOIN edge ON dst_table = t WHERE hop < 3)"""


@query("WITH RECURSIVE " + _EDGES + ", " + _IMPACT + " SELECT t AS table_name, hop, conf AS confidence, via, CASE WHEN conf < 0.5 THEN 'low_confidence' WHEN hop = 1 THEN 'direct' WHEN hop = 2 THEN 'two_hop' WHEN hop = 3 THEN 'three_hop' END AS bucket FROM walk2 QUALIFY row_number() OVER (PARTITION BY t ORDER BY hop, via) = 1")
def impact_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reach.impact(_edges(spark, sf_dir), "region")


# ---- clusters --------------------------------------------------------------------

MEMBERS = [("sales", t) for t in ("customer", "orders", "lineitem", "part", "supplier")] + [("places", t) for t in ("nation", "region")] + [("texts", t) for t in ("documents", "labels", "benchmark")]


@query("WITH " + _EDGES + ", " + _values("m", "cluster, table_name", MEMBERS) + """, p AS (SELECT least(src_table, dst_table) AS a, greatest(src_table, dst_table) AS b, max(confidence) AS w FROM edge GROUP BY 1, 2),
 n AS (SELECT cluster, count(*) AS k FROM m GROUP BY 1), i AS (SELECT x.cluster, sum(w) AS w FROM p JOIN m x ON x.table_name = a JOIN m y ON y.table_name = b WHERE x.cluster = y.cluster GROUP BY 1)
 SELECT cluster, k AS n_tables, round(CASE WHEN k < 2 THEN 0 ELSE coalesce(w, 0) / (k * (k - 1) / 2.0) END, 6)::DOUBLE AS cohesion FROM n LEFT JOIN i USING (cluster)""")  # fmt: skip
def cluster_cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.cohesion(spark.createDataFrame(MEMBERS, "cluster string, table_name string"), cluster.weighted_pairs(_edges(spark, sf_dir)))


@query("SELECT n_name AS table_name, (dense_rank() OVER (ORDER BY -k, least_name) - 1)::BIGINT AS cluster FROM (SELECT n_name, count(*) OVER (PARTITION BY n_regionkey) AS k, min(n_name) OVER (PARTITION BY n_regionkey) AS least_name FROM nation)")
def communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of one region are all joined, regions by one weak edge: regions are found."""
    n = catalog.read_table(spark, sf_dir, "nation")
    a, b = (n.select(F.col("n_name").alias(c), F.col("n_regionkey").alias(f"r{c}")) for c in "ab")
    inner = a.join(b, (F.col("ra") == F.col("rb")) & (F.col("a") < F.col("b"))).select("a", "b", F.lit(1.0).alias("weight"))
    first = n.groupBy("n_regionkey").agg(F.min("n_name").alias("f"))
    weak = first.select(F.col("f").alias("a"), F.col("n_regionkey").alias("r")).join(first.select(F.col("f").alias("b"), (F.col("n_regionkey") - 1).alias("r")), "r").select("a", "b", F.lit(0.1).alias("weight"))
    name = F.lit("db").alias("database")
    return cluster.communities(n.select(name, F.col("n_name").alias("table_name")), inner.unionByName(weak).select(name, "*")).select("table_name", "cluster")


PATTERN_ROWS = [("s", "fact_a", "fact"), ("s", "dim_x", "dimension"), ("s", "dim_y", "dimension"), ("f", "fact_b", "fact"), ("f", "dim_p", "dimension"), ("f", "dim_q", "dimension"), ("c", "fact_c", "fact"), ("c", "fact_d", "fact"), ("c", "dim_z", "dimension"), ("e", "t1", "entity_candidate"), ("e", "t2", "entity_candidate"), ("u", "lone", "unknown")]
PATTERN_KEYS = [("fact_a", "x", "dim_x", "id"), ("fact_a", "y", "dim_y", "id"), ("fact_b", "p", "dim_p", "id"), ("dim_p", "q", "dim_q", "id"), ("fact_c", "z", "dim_z", "id"), ("fact_d", "z", "dim_z", "id"), ("t1", "k", "t2", "id")]


@query("WITH " + _values("m", "c, t, role", PATTERN_ROWS) + ", " + _values("k", "s, sc, d, dc", PATTERN_KEYS) + """, e AS (SELECT DISTINCT a.c, a.t AS s, b.t AS d, a.role AS sr, b.role AS dr FROM k JOIN m a ON a.t = s JOIN m b ON b.t = d AND b.c = a.c),
 f AS (SELECT c, count(*) FILTER (role = 'fact') AS nf, count(*) FILTER (role = 'dimension') AS nd FROM m GROUP BY c),
 g AS (SELECT c, max(n) AS shared FROM (SELECT c, d, count(DISTINCT s) AS n FROM e WHERE sr = 'fact' AND dr = 'dimension' GROUP BY c, d) GROUP BY c), h AS (SELECT c, count(*) AS ne, count(*) FILTER (sr = 'dimension' AND dr = 'dimension') AS dd FROM e GROUP BY c)
 SELECT c AS cluster, nf AS n_fact, nd AS n_dim, CASE WHEN nf >= 2 AND shared >= 2 THEN 'constellation' WHEN nf >= 1 AND nd >= 1 AND dd > 0 THEN 'snowflake' WHEN nf >= 1 AND nd >= 1 THEN 'star' WHEN ne > 0 THEN 'erd' ELSE 'unknown' END AS pattern
 FROM f LEFT JOIN g USING (c) LEFT JOIN h USING (c)""")
def schema_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = spark.createDataFrame(PATTERN_ROWS, "cluster string, table_name string, role string")
    return classify.schema_patterns(x.select("cluster", "table_name"), x.select("table_name", "role"), catalog.foreign_keys(spark, PATTERN_KEYS))


# ---- snapshots and the graph -----------------------------------------------------

OLD_T = [("a", "table", 10, None), ("b", "table", 5, "old"), ("c", "view", None, None)]
NEW_T = [("a", "table", 12, None), ("c", "view", None, None), ("d", "table", 1, None)]
OLD_C = [("a", "id", "int", False), ("a", "x", "text", True), ("b", "id", "int", False), ("c", "v", "int", True)]
NEW_C = [("a", "id", "bigint", False), ("a", "y", "text", True), ("c", "v", "int", True), ("d", "id", "int", False)]
_T, _C = "table_name string, table_type string, row_count bigint, comment string", "table_name string, column_name string, data_type string, nullable boolean"


@query("WITH " + ", ".join((_values("ot", "t, k, n, c", OLD_T), _values("nt", "t, k, n, c", NEW_T), _values("oc", "t, col, typ, nul", OLD_C), _values("nc", "t, col, typ, nul", NEW_C))) + """,
 tt AS (SELECT 'table' AS target, CASE WHEN ot.t IS NULL THEN 'added' WHEN nt.t IS NULL THEN 'removed' ELSE 'modified' END AS change_type, coalesce(ot.t, nt.t) AS table_name, NULL::VARCHAR AS column_name,
   CASE WHEN ot.t IS NULL OR nt.t IS NULL THEN '' ELSE concat_ws('; ', CASE WHEN ot.c IS DISTINCT FROM nt.c THEN 'comment: ' || coalesce(ot.c, 'none') || ' -> ' || coalesce(nt.c, 'none') END, CASE WHEN ot.k IS DISTINCT FROM nt.k THEN 'table_type: ' || ot.k || ' -> ' || nt.k END, CASE WHEN ot.n IS DISTINCT FROM nt.n THEN 'row_count: ' || coalesce(ot.n::VARCHAR, 'none') || ' -> ' || coalesce(nt.n::VARCHAR, 'none') END) END AS details FROM ot FULL JOIN nt ON ot.t = nt.t),
 both_t AS (SELECT t FROM ot INTERSECT SELECT t FROM nt),
 cc AS (SELECT 'column' AS target, CASE WHEN o.col IS NULL THEN 'added' WHEN n.col IS NULL THEN 'removed' ELSE 'modified' END AS change_type, coalesce(o.t, n.t) AS table_name, coalesce(o.col, n.col) AS column_name,
   CASE WHEN o.col IS NULL OR n.col IS NULL THEN '' ELSE concat_ws('; ', CASE WHEN o.typ <> n.typ THEN 'data_type: ' || o.typ || ' -> ' || n.typ END, CASE WHEN o.nul <> n.nul THEN 'nullable' END) END AS details
   FROM (SELECT * FROM oc WHERE t IN (SELECT t FROM both_t)) o FULL JOIN (SELECT * FROM nc WHERE t IN (SELECT t FROM both_t)) n ON o.t = n.t AND o.col = n.col)
 SELECT * FROM (SELECT * FROM tt UNION ALL SELECT * FROM cc) WHERE change_type <> 'modified' OR details <> ''""")  # fmt: skip
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = spark.createDataFrame
    return drift.diff_snapshots(f(OLD_T, _T), f(NEW_T, _T), f(OLD_C, _C), f(NEW_C, _C))


@query("WITH " + _values("o", "t, k, n, c", OLD_T) + ", " + _values("w", "t, k, n, c", NEW_T) + " SELECT CASE WHEN w.t IS NULL THEN 'deleted' WHEN o.t IS NULL THEN 'inserted' ELSE 'updated' END AS action, count(*) AS n FROM o FULL JOIN w ON o.t = w.t WHERE o.t IS NULL OR w.t IS NULL OR (o.k, o.n, o.c) IS DISTINCT FROM (w.k, w.n, w.c) GROUP BY 1")
def graph_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = spark.createDataFrame
    return drift.patch(f(OLD_T, _T), f(NEW_T, _T), ["table_name"])[1]


@query("WITH RECURSIVE " + _WALK + " SELECT f AS from_table, t AS to_table, array_to_string(tables, '>') AS path, array_to_string(list_sort(list_intersect(tables, ['nation', 'events'])), ',') AS changed_tables FROM walk WHERE list_has_any(tables, ['nation', 'events'])")
def drift_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored paths that a change of nation or events makes stale, at any step."""
    changed = spark.createDataFrame([("nation",), ("events",)], "table_name string")
    return drift.affected_paths(paths.enumerate_paths(_edges(spark, sf_dir)), changed)


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN 'new' ELSE c_mktsegment END AS seg, c_name AS name FROM customer UNION ALL SELECT max(c_custkey) + 1, 'new', 'added' FROM customer")
def graph_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New values where given, old ones where the new is null, new keys added."""
    old = catalog.read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("seg"), F.col("c_name").alias("name"))
    new = old.where("k % 7 = 0").select("k", F.lit("new").alias("seg"), F.lit(None).cast("string").alias("name"))
    new = new.unionByName(old.agg((F.max("k") + 1).alias("k")).select("k", F.lit("new").alias("seg"), F.lit("added").alias("name")))
    return graph.upsert(old, new, "k", keep_if_null=("name",))


def _graph(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    tables = spark.createDataFrame([(t,) for t in catalog.TABLES], "table_name string")
    keys = reach.checkpointed(confirmed_keys(spark, sf_dir))
    return graph.build("db", tables, keys.select(F.col("src_table").alias("table_name"), F.col("src_column").alias("column_name"), F.lit(1).alias("ordinal")), keys)


@query("WITH " + _FK + " SELECT dst_table AS target, count(*) AS n, string_agg(DISTINCT src_table, ',' ORDER BY src_table) AS users FROM fk WHERE dst_table <> 'documents' GROUP BY 1 HAVING true")
def cypher_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cypher.query(_graph(spark, sf_dir), "MATCH (a:SchemaTable)-[r:FK_REFERENCES]->(b:SchemaTable) WHERE b.table_name <> $t RETURN b.table_name AS target, count(*) AS n, collect(DISTINCT a.table_name) AS users", {"t": "documents"}).withColumn("users", F.array_join("users", ","))


@query("WITH " + _FK + ", u AS (SELECT src_table AS a, dst_table AS b FROM fk UNION ALL SELECT dst_table, src_table FROM fk) SELECT DISTINCT y.b AS through_table FROM u y JOIN u z ON y.b = z.a WHERE y.a = 'customer' AND z.b = 'region'")
def cypher_two_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies between two tables, edges taken either way."""
    return cypher.query(_graph(spark, sf_dir), "MATCH (a:SchemaTable {table_name: 'customer'})-[:FK_REFERENCES]-(m:SchemaTable)-[:FK_REFERENCES]-(b:SchemaTable {table_name: 'region'}) RETURN DISTINCT m.table_name AS through_table")


@query("WITH " + _FK + f""", x AS (SELECT 'edge' AS kind, 'FK_REFERENCES' AS label, 'db::main::' || src_table || '->db::main::' || dst_table AS id, src_column || '=' || dst_column AS told FROM fk
 UNION ALL SELECT 'edge', 'HAS_COLUMN', 'db::main::' || src_table || '->db::main::' || src_table || '::' || src_column, NULL FROM fk UNION ALL SELECT 'node', 'SchemaColumn', 'db::main::' || src_table || '::' || src_column, src_column FROM fk
 UNION ALL SELECT 'node', 'SchemaTable', 'db::main::' || t, t FROM (SELECT unnest([{_NAMES}]) AS t)) SELECT * FROM x""")
def graph_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and edges with what their JSON tells."""
    x = graph.export(_graph(spark, sf_dir), "db")
    field = lambda name: F.get_json_object("json", f"$.{name}")
    told = F.when(F.col("label") == "FK_REFERENCES", F.concat(field("source_column"), F.lit("="), field("target_column"))).when(F.col("label") == "SchemaColumn", field("column_name")).when(F.col("label") == "SchemaTable", field("table_name"))
    return x.select("kind", "label", "id", told.alias("told"))


# ---- search ----------------------------------------------------------------------

_BM25 = """tok AS (SELECT doc_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+')) AS w FROM documents),
 t AS (SELECT * FROM tok WHERE w <> ''), dl AS (SELECT doc_id, count(*) AS dl FROM t GROUP BY 1), s AS (SELECT (SELECT count(*) FROM documents)::DOUBLE AS n, sum(dl)::DOUBLE AS total FROM dl),
 tf AS (SELECT doc_id, w, count(*)::DOUBLE AS tf FROM t WHERE w IN ('license', 'the', 'mit') GROUP BY 1, 2), df AS (SELECT w, count(*)::DOUBLE AS df FROM tf GROUP BY 1),
 sc AS (SELECT doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl * n / total))), 6) AS score FROM tf JOIN df USING (w) JOIN dl USING (doc_id), s GROUP BY 1)"""


@query("WITH " + _BM25 + " SELECT doc_id, score FROM sc")
def search_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25(catalog.read_table(spark, sf_dir, "documents"), "doc_id", "the MIT license", {"text": 1.0})


@query("WITH " + _BM25 + " SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank FROM sc ORDER BY score DESC, doc_id LIMIT 10")
def search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(catalog.read_table(spark, sf_dir, "documents"), "doc_id", "the MIT license", 10, fields={"text": 1.0})


@query("WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q.e), 5) AS similarity FROM embeddings, q WHERE vec_id <> 0 ORDER BY similarity DESC, vec_id LIMIT 20")
def embedding_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = catalog.read_table(spark, sf_dir, "embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q")).limit(1)
    return e.where("vec_id <> 0").crossJoin(F.broadcast(q)).select("vec_id", F.round(S.cosine(F.col("embedding"), F.col("q")), 5).alias("similarity")).orderBy(F.desc("similarity"), "vec_id").limit(20)


# ---- metrics and SQL -------------------------------------------------------------

LAYER = semantic.Layer((
    semantic.Entity("line", "lineitem", metrics=(
        semantic.Metric("revenue", "sum", "l_extendedprice"), semantic.Metric("avg_quantity", "average", "l_quantity"),
        semantic.Metric("returned", "count", filters=("l_returnflag = 'R'", "l_quantity > 10")),
        semantic.Metric("net", "derived", expression="SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) AS net FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE o.o_orderstatus = 'F'"))),
    semantic.Entity("order", "orders", metrics=(semantic.Metric("customers", "count_distinct", "o_custkey"),)),
))


def _metric(name: str, sql: str, rounded: bool, group_by: tuple[str, ...] = ()) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = {t: catalog.read_table(spark, sf_dir, t) for t in ("lineitem", "orders")}
        out = semantic.run_metric(spark, LAYER, name, tables, group_by)
        return out.withColumn(name, F.round(name, 2)) if rounded else out

    run.__name__ = f"metric_{name}"
    query(sql)(run)


_metric("revenue", "SELECT l_returnflag, round(sum(l_extendedprice), 2) AS revenue FROM lineitem GROUP BY 1", True, ("l_returnflag",))
_metric("avg_quantity", "SELECT round(avg(l_quantity), 2) AS avg_quantity FROM lineitem", True)
_metric("returned", "SELECT count(*) AS returned FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 10", False)
_metric("customers", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1", False, ("o_orderstatus",))
_metric("net", "SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) AS net FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'", True)

VIEWS = [("v_sales", "WITH x AS (SELECT * FROM orders) SELECT * FROM x JOIN lineitem l ON x.o_orderkey = l.l_orderkey"), ("v_geo", "SELECT n_name FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region)"), ("v_bad", "SELECT FROM WHERE ((")]


@query("WITH " + _values("v", "name, body", VIEWS) + f", r AS (SELECT name, unnest(regexp_extract_all(body, '(?:FROM|JOIN)\\s+(\\w+)', 1)) AS t FROM v) SELECT DISTINCT t AS src_table, name AS dst_table, 'view_sql' AS lineage_type, 1.0::DOUBLE AS confidence FROM r WHERE t IN ({_NAMES})")
def view_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(sql_walk.lineage(spark, VIEWS), "src_table string, dst_table string, lineage_type string, confidence double")


CHECKS = ["SELECT o.o_orderkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey", "SELECT x FROM order", "SELECT o.o_total FROM orders o", "SELECT 1 FROM orders o JOIN region r ON o.o_orderkey = r.r_regionkey", "SELECT ((("]


@query("WITH x(n, valid, missing_tables, missing_columns, invalid_joins) AS (VALUES (0, true, '', '', ''), (1, false, 'order', '', ''), (2, false, '', 'o.o_total', ''), (3, false, '', '', 'orders - region'), (4, false, '', '', '')) SELECT n::BIGINT AS n, valid, missing_tables, missing_columns, invalid_joins FROM x")
def sql_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {t: [f.name for f in catalog.read_table(spark, sf_dir, t).schema.fields] for t in ("orders", "customer", "nation", "region")}
    joins = {(k[0], k[2]) for k in FK_ROWS}
    rows = []
    for n, sql in enumerate(CHECKS):
        r = sql_walk.validate(spark, sql, columns, joins)
        rows.append((n, r.valid, ",".join(r.missing_tables), ",".join(r.missing_columns), ",".join(r.invalid_joins)))
    return spark.createDataFrame(rows, "n long, valid boolean, missing_tables string, missing_columns string, invalid_joins string")


# ---- visibility, grants, dbt -----------------------------------------------------

SEEN = [("db", s, t, c) for s, t, c in (("public", "users", "id"), ("public", "users", "email"), ("public", "secret_keys", "k"), ("staff", "payroll", "salary"), ("public", "orders", "email"))]


@query("WITH " + _values("x", "connection, schema_name, table_name, column_name", SEEN) + " SELECT * FROM x WHERE schema_name <> 'staff' AND NOT table_name LIKE 'secret%' AND NOT (table_name = 'users' AND column_name LIKE 'e%l')")
def visible_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = visibility.Profile(hidden_schemas=("sta*",), hidden_tables=("public.secret_*",), hidden_columns=("users.e*l",))
    return visibility.visible_columns(p, spark.createDataFrame(SEEN, "connection string, schema_name string, table_name string, column_name string"))


GRANTS = [("reader", "a", "SELECT"), ("writer", "b", "INSERT"), ("base", "c", "SELECT"), ("PUBLIC", "z", "SELECT"), ("reader", "c", "SELECT")]
ROLES = [("alice", "reader"), ("reader", "base"), ("bob", "base"), ("writer", "reader")]


@query("WITH RECURSIVE " + _values("g", "grantee, table_name, privilege", GRANTS) + ", " + _values("m", "child, parent", ROLES) + ", up AS (SELECT child, parent FROM m UNION SELECT u.child, m.parent FROM up u JOIN m ON u.parent = m.child), s AS (SELECT grantee, table_name FROM g WHERE privilege = 'SELECT'), e AS (SELECT * FROM s UNION SELECT child, table_name FROM up JOIN s ON parent = grantee) SELECT grantee, string_agg(table_name, ',' ORDER BY table_name) AS patterns FROM e WHERE grantee <> 'PUBLIC' GROUP BY 1")
def grant_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = spark.createDataFrame
    return reach.allowed_patterns(reach.grants_of_roles(f(GRANTS, "grantee string, table_name string, privilege string"), f(ROLES, "child string, parent string")))


MANIFEST = json.dumps({
    "metadata": {"dbt_schema_version": "https://schemas.getdbt.com/dbt/manifest/v10.json"},
    "nodes": {"model.p.orders": {"resource_type": "model", "name": "orders", "schema": "marts", "alias": "fct_orders", "tags": ["core"], "description": "Orders"}, "model.p.stg": {"resource_type": "model", "name": "stg", "schema": "stage"}, "model.p.lone": {"resource_type": "model", "name": "lone", "schema": "marts"},
              "test.1": {"resource_type": "test", "name": "t1", "attached_node": "model.p.orders"}, "test.2": {"resource_type": "test", "name": "t2", "attached_node": "model.p.orders"}, "test.3": {"resource_type": "test", "name": "t3", "attached_node": "source.p.raw.o"}},
    "sources": {"source.p.raw.o": {"name": "o", "source_name": "raw", "schema": "raw", "identifier": "raw_orders"}},
    "exposures": {"exposure.p.dash": {"name": "dash", "depends_on": {"nodes": ["model.p.orders"]}}},
    "parent_map": {"model.p.orders": ["model.p.stg", "model.p.gone"], "model.p.stg": ["source.p.raw.o"]},
})


_DBT = f"""WITH RECURSIVE m AS (SELECT {_literal(MANIFEST)}::JSON AS j),
 n AS (SELECT k AS id, j->'nodes'->k AS o FROM (SELECT j, unnest(json_keys(j->'nodes')) AS k FROM m)), s AS (SELECT k AS id, j->'sources'->k AS o FROM (SELECT j, unnest(json_keys(j->'sources')) AS k FROM m)),
 tabs AS (SELECT id, (o->>'schema') || '.' || coalesce(nullif(o->>'alias', ''), o->>'name') AS t FROM n WHERE o->>'resource_type' = 'model' UNION ALL SELECT id, (o->>'schema') || '.' || coalesce(nullif(o->>'identifier', ''), o->>'name') FROM s),
 par AS (SELECT k AS child, unnest(from_json(j->'parent_map'->k, '["VARCHAR"]')) AS parent FROM (SELECT j, unnest(json_keys(j->'parent_map')) AS k FROM m)),
 seed AS (SELECT unnest(from_json(j->'exposures'->k->'depends_on'->'nodes', '["VARCHAR"]')) AS id FROM (SELECT j, unnest(json_keys(j->'exposures')) AS k FROM m)),
 up AS (SELECT id FROM seed UNION SELECT parent FROM up JOIN par ON child = id)"""


@query(_DBT + " SELECT DISTINCT t AS table_name FROM up JOIN tabs USING (id)")
def dbt_external_consumers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dbt.external_consumers(dbt.Manifest.parse(spark, MANIFEST))


@query(_DBT + " SELECT t AS table_name, count(*) AS n_tests FROM n JOIN tabs ON tabs.id = o->>'attached_node' WHERE o->>'resource_type' = 'test' AND starts_with(o->>'attached_node', 'model.') GROUP BY t")
def dbt_test_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dbt.test_counts(dbt.Manifest.parse(spark, MANIFEST))


@query(_DBT + " SELECT DISTINCT a.t AS src_table, b.t AS dst_table FROM par JOIN tabs a ON a.id = parent JOIN tabs b ON b.id = child WHERE a.t <> b.t")
def dbt_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dbt.lineage(dbt.Manifest.parse(spark, MANIFEST))


PAIRS = [("customer", "clients", 0.7, True), ("orders", "purchases", 0.5, True), ("part", "product", 0.62, True), ("nation", "film", 0.58, False), ("region", "actor", 0.2, False)]


@query("WITH " + _values("p", "a, b, score, is_match", PAIRS) + ", t AS (SELECT round(0.4 + 0.05 * i, 2) AS threshold FROM range(9) r(i)), c AS (SELECT threshold, count(*) FILTER (score >= threshold AND is_match) AS tp, count(*) FILTER (score >= threshold AND NOT is_match) AS fp, count(*) FILTER (score < threshold AND is_match) AS fn FROM t, p GROUP BY 1) SELECT threshold::DOUBLE AS threshold, round(coalesce(tp / nullif(tp + fp, 0), 0), 6)::DOUBLE AS matched_precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6)::DOUBLE AS recall, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6)::DOUBLE AS f1 FROM c")
def entity_pair_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of labelled entity pairs over a sweep of thresholds."""
    p = spark.createDataFrame(PAIRS, "a string, b string, score double, is_match boolean")
    t = spark.range(9).select(F.round(F.col("id") * 0.05 + 0.4, 2).alias("threshold"))
    hit = F.col("score") >= F.col("threshold")
    c = t.crossJoin(F.broadcast(p)).groupBy("threshold").agg(F.count_if(hit & F.col("is_match")).alias("tp"), F.count_if(hit & ~F.col("is_match")).alias("fp"), F.count_if(~hit & F.col("is_match")).alias("fn"))
    share = lambda a, b: F.round(F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)), 6)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select("threshold", share(tp, tp + fp).alias("matched_precision"), share(tp, tp + fn).alias("recall"), share(tp * 2, tp * 2 + fp + fn).alias("f1"))


# ---- warehouse catalogs ----------------------------------------------------------

READS = [("a", "2024-05-01 10:00:00"), ("a", "2024-06-20 10:00:00"), ("b", "2024-01-01 00:00:00"), ("gone", "2024-06-01 00:00:00")]
WRITES = [("a",), ("c",), ("c",)]


@query("WITH " + _values("r", "t, ts", READS) + ", " + _values("w", "t", WRITES) + """, x AS (SELECT coalesce(r.t, w.t) AS table_name, rc, wc, last FROM (SELECT t, count(*) AS rc, max(ts::TIMESTAMP) AS last FROM r GROUP BY 1) r FULL JOIN (SELECT t, count(*) AS wc FROM w GROUP BY 1) w ON r.t = w.t)
 SELECT table_name, coalesce(rc, 0) AS access_read_count, coalesce(wc, 0) AS access_write_count, floor(epoch(TIMESTAMP '2024-07-01' - last) / 86400)::BIGINT AS days_since_last_access, rc IS NULL OR floor(epoch(TIMESTAMP '2024-07-01' - last) / 86400) >= 90 AS potentially_unused FROM x WHERE table_name IN ('a', 'b', 'c')""")  # fmt: skip
def warehouse_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = spark.createDataFrame(READS, "fq_name string, at string").withColumn("at", F.to_timestamp("at"))
    tables = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "table_name string")
    return warehouse.access(reads, spark.createDataFrame(WRITES, "fq_name string"), tables, F.lit("2024-07-01 00:00:00").cast("timestamp"))


DEPS, TEXTS, STREAMS = [("t1", "v1")], [("t1", "v1"), ("t2", "v1"), ("v1", "v1")], [("t1", "s1")]
TASK_READS, TASK_WRITES = [("k", "t1"), ("k", "t3")], [("k", "t3"), ("k", "t4")]


@query("WITH " + ", ".join((_values("d", "s, t", DEPS), _values("x", "s, t", TEXTS), _values("st", "s, t", STREAMS), _values("r", "k, s", TASK_READS), _values("w", "k, t", TASK_WRITES))) + """, e AS (SELECT s, t, 'VIEW' AS kind, 1.0 AS c FROM d UNION SELECT s, t, 'VIEW', 0.85 FROM x WHERE (s, t) NOT IN (SELECT (s, t) FROM d) UNION SELECT s, t, 'STREAM', 1.0 FROM st UNION SELECT s, t, 'TASK', 0.85 FROM r JOIN w USING (k))
 SELECT s AS src_table, t AS dst_table, kind AS lineage_type, c::DOUBLE AS confidence FROM e WHERE s <> t""")
def warehouse_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = lambda rows: spark.createDataFrame(rows, "src_table string, dst_table string")
    return warehouse.object_lineage(pair(DEPS), pair(TEXTS), pair(STREAMS), spark.createDataFrame(TASK_READS, "task string, src_table string"), spark.createDataFrame(TASK_WRITES, "task string, dst_table string"))


STATS = [("a", "x", -0.5, 0.1234, ["p", "q"]), ("a", "y", 7.0, 0.0, None), ("b", "z", 3.0, 1.0, [])]


@query("WITH " + _values("s", "t, c, nd, nf, mcv", STATS) + ", n(t, k) AS (VALUES ('a', 100)) SELECT t AS table_name, c AS column_name, CASE WHEN nd < 0 THEN round(-nd * k) ELSE nd END::BIGINT AS distinct_count, round(nf * 100, 2)::DOUBLE AS null_pct, array_to_string(mcv[1:20], ',') AS mcv FROM s LEFT JOIN n USING (t)")
def warehouse_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = spark.createDataFrame([("a", 100)], "table_name string, row_count long")
    x = warehouse.catalog_statistics(spark.createDataFrame(STATS, "table_name string, column_name string, n_distinct double, null_frac double, mcv array<string>"), counts)
    return x.withColumn("mcv", F.array_join("mcv", ","))


from quarry import catalog_queries, data_queries  # noqa: E402, F401
