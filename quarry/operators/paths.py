"""Join paths: bounded enumeration of simple paths over the join edges, ranked by cost.

Edges: src_table, src_column, dst_table, dst_column, kind ("fk" or "inferred"), confidence.
Paths of up to max_depth edges are enumerated by one join per hop (depth is small, the
graph of tables is small, and the limits cut every hop), so limits on depth and inferred
hops never hide a feasible path. Several columns of one composite key are one edge with
arrays (collapse_composite), so hints carry the whole condition.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import scalars as S

MAX_DEPTH, MAX_INFERRED, TOP_K = 4, 2, 3


def collapse_composite(keys: DataFrame) -> DataFrame:
    """keys(constraint_name, position, src_*, dst_*) -> one row per constraint, columns
    joined by commas in the key's order."""
    pair = F.array_sort(F.collect_list(F.struct("position", "src_column", "dst_column")))
    g = keys.groupBy("constraint_name", "src_table", "dst_table").agg(pair.alias("p"))
    return g.select("constraint_name", "src_table", F.array_join("p.src_column", ",").alias("src_column"), "dst_table", F.array_join("p.dst_column", ",").alias("dst_column"))


def edges(foreign_keys: DataFrame, inferred: DataFrame | None = None, aliases: DataFrame | None = None) -> DataFrame:
    cols = ["src_table", "src_column", "dst_table", "dst_column"]
    out = foreign_keys.select(*cols, F.lit("fk").alias("kind"), F.lit(1.0).alias("confidence"))
    if inferred is not None:
        out = out.unionByName(inferred.select(*cols, F.lit("inferred").alias("kind"), F.coalesce("confidence", F.lit(0.5)).alias("confidence")))
    if aliases is not None:
        for side in ("src_table", "dst_table"):
            out = out.join(aliases.select(F.col("table_name").alias(side)), side, "left_anti")
    return out


def adjacency(edge: DataFrame) -> DataFrame:
    """Both directions of every edge, columns swapped."""
    back = edge.select(F.col("dst_table").alias("src_table"), F.col("dst_column").alias("src_column"), F.col("src_table").alias("dst_table"), F.col("src_column").alias("dst_column"), "kind", "confidence")
    return edge.unionByName(back).distinct()


def enumerate_paths(edge: DataFrame, max_depth: int = MAX_DEPTH, max_inferred: int = MAX_INFERRED, kinds: tuple[str, ...] = ("fk", "inferred"), start: str | None = None, goal: str | None = None) -> DataFrame:
    """from_table, to_table, depth, cost, confidence (product), min_confidence, n_inferred,
    path (tables joined by >), steps."""
    adj = adjacency(edge.where(F.col("kind").isin(*kinds)))
    step = F.struct(F.col("src_table").alias("a"), F.col("src_column").alias("ac"), F.col("dst_table").alias("b"), F.col("dst_column").alias("bc"), "kind", F.col("confidence").alias("conf"))
    hop = adj.select(F.col("src_table").alias("at"), F.col("dst_table").alias("next"), step.alias("step"), (F.col("kind") == "inferred").cast("int").alias("inf"))
    now = hop.where(F.col("inf") <= max_inferred) if start is None else hop.where((F.col("at") == start) & (F.col("inf") <= max_inferred))
    now = now.select(F.col("at").alias("from_table"), F.col("next").alias("to_table"), F.array("at", "next").alias("tables"), F.array("step").alias("steps"), F.col("inf").alias("n_inferred"))
    levels = [now]
    for _ in range(max_depth - 1):
        # a path that has arrived goes no further
        open_ = now if goal is None else now.where(F.col("to_table") != goal)
        now = open_.join(hop, open_["to_table"] == hop["at"]).where(~F.array_contains("tables", F.col("next")) & (F.col("n_inferred") + F.col("inf") <= max_inferred))
        now = now.select("from_table", F.col("next").alias("to_table"), F.array_append("tables", F.col("next")).alias("tables"), F.array_append("steps", F.col("step")).alias("steps"), (F.col("n_inferred") + F.col("inf")).alias("n_inferred"))
        levels.append(now)
    every = reduce(DataFrame.unionByName, levels)
    if goal is not None:
        every = every.where(F.col("to_table") == goal)
    cost = F.aggregate("steps", F.lit(0.0), lambda s, x: s + S.edge_cost(x["kind"] == "inferred", x["conf"]))
    product = F.aggregate("steps", F.lit(1.0), lambda s, x: s * x["conf"])
    return every.select("from_table", "to_table", F.size("steps").alias("depth"), F.round(cost, 6).alias("cost"), F.round(product, 6).alias("confidence"), F.array_min(F.transform("steps", lambda x: x["conf"])).alias("min_confidence"), "n_inferred", F.array_join("tables", ">").alias("path"), "steps")


def signature(steps: Column) -> Column:
    return F.array_join(F.transform(steps, lambda x: F.concat(x["a"], F.lit("."), x["ac"], F.lit("="), x["b"], F.lit("."), x["bc"], F.lit(":"), x["kind"])), "|")


def ranked(paths: DataFrame, k: int = TOP_K) -> DataFrame:
    """The k cheapest paths of each pair: rank by cost, depth, signature; `tied` tells
    whether another path of the pair costs as little as the best, `several` whether more
    than one path is ranked."""
    pair = Window.partitionBy("from_table", "to_table")
    x = paths.withColumn("signature", signature(F.col("steps"))).withColumn("rank", F.row_number().over(pair.orderBy("cost", "depth", "signature")))
    x = x.withColumn("best", F.min("cost").over(pair)).withColumn("n", F.count(F.lit(1)).over(pair))
    x = x.withColumn("tied", F.count_if(F.col("cost") == F.col("best")).over(pair) > 1)
    return x.where(F.col("rank") <= k).select("from_table", "to_table", "rank", "depth", "cost", "confidence", "min_confidence", "n_inferred", "path", "signature", "tied", (F.least("n", F.lit(k)) > 1).alias("several"), "steps")


def path_id(start: Column, goal: Column, steps: Column) -> Column:
    return F.concat_ws("::", start, goal, S.short_hash(F.to_json(steps), 16))


def label(start: Column, goal: Column, depth: Column) -> Column:
    return F.concat(start, F.lit(" -> "), goal, F.lit(" ("), depth.cast("string"), F.lit(" hop)"))


def sql_hint(steps: Column) -> Column:
    """FROM a JOIN b ON a.x = b.y [AND ...] JOIN ..."""

    def condition(x: Column) -> Column:
        pair = F.zip_with(F.split(x["ac"], ","), F.split(x["bc"], ","), lambda p, q: F.concat(x["a"], F.lit("."), p, F.lit(" = "), x["b"], F.lit("."), q))
        return F.concat(F.lit("JOIN "), x["b"], F.lit(" ON "), F.array_join(pair, " AND "))

    return F.concat(F.lit("FROM "), F.get(steps, F.lit(0))["a"], F.lit(" "), F.array_join(F.transform(steps, condition), " "))


def visible_steps(steps: Column, visible: Column) -> Column:
    """Whether every inferred step stays within the tables of the array visible."""
    return F.forall(steps, lambda x: (x["kind"] == "fk") | (F.array_contains(visible, x["a"]) & F.array_contains(visible, x["b"])))


def reverse_steps(steps: Column) -> Column:
    """The same path from the other end."""
    turn = lambda x: F.struct(x["b"].alias("a"), x["bc"].alias("ac"), x["a"].alias("b"), x["ac"].alias("bc"), x["kind"].alias("kind"), x["conf"].alias("conf"))
    return F.reverse(F.transform(steps, turn))


def precompute(edge: DataFrame, max_depth: int = MAX_DEPTH, k: int = 1) -> DataFrame:
    """Best paths of all pairs, with identifiers, labels and hints."""
    best = ranked(enumerate_paths(edge, max_depth), k)
    start, goal = F.col("from_table"), F.col("to_table")
    return best.select(path_id(start, goal, F.col("steps")).alias("path_id"), start, goal, "rank", "depth", "cost", "confidence", label(start, goal, F.col("depth")).alias("label"), sql_hint(F.col("steps")).alias("hint"), F.col("tied").alias("ambiguous"), "steps")


def across(left: DataFrame, bridges: DataFrame, right: DataFrame) -> DataFrame:
    """Paths that cross databases: left(from_table, to_table, min_confidence) ends where a
    confirmed bridge (a_table, b_table, score) begins; confidence is the least of three."""
    both = bridges.unionByName(bridges.select(F.col("b_table").alias("a_table"), F.col("a_table").alias("b_table"), "score")).distinct()
    l_ = left.select("from_table", F.col("to_table").alias("a_table"), F.col("min_confidence").alias("lc"), F.col("depth").alias("ld"))
    r_ = right.select(F.col("from_table").alias("b_table"), "to_table", F.col("min_confidence").alias("rc"), F.col("depth").alias("rd"))
    x = l_.join(both, "a_table").join(r_, "b_table")
    return x.select("from_table", "to_table", F.concat("a_table", F.lit("~"), "b_table").alias("via"), (F.col("ld") + F.col("rd") + 1).alias("depth"), F.least("lc", "rc", "score").alias("confidence"))
