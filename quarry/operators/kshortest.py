"""Cheapest join paths under limits, without listing all paths.

Edges are those of paths.py. A search is a task: a start, maybe a goal, tables and first
steps that it must avoid, and how many hops and inferred hops it may take. All tasks
advance together, a hop at a time: labels (task, table, hops, inferred hops) keep the
cheapest way only, and a label is dropped once another of its task and table costs no more
with no more inferred hops and fewer hops, or fewer inferred ones. Costs are positive (and whole
millionths), so a cheapest way under limits never visits a table twice.

best_paths() and k_shortest() search for a group of starts in one task, by the edges near them
(nearby.py). Where these are too many for a task, labels are shuffled instead: one search for each
start, and k_shortest() adds Yen's detours: each further
path of a pair leaves an accepted one at some table, avoids the tables before it and the steps
that accepted paths take there, and is cheapest. Detours that many pairs share are searched
once, and a way that cannot reach its goal within its limits, by the distances from the
goals, is not followed. Ranks are those of paths.ranked: by cost, depth, signature.

Edges are numbered in the order of their signatures. A label holds the numbers of its way, so
ways compare like signatures, and steps are looked up for the ways that are chosen alone.

Each hop of each round is checkpointed, so that a lost executor costs that hop.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import scalars as S
from quarry.operators import nearby, paths
from quarry.operators.reach import written

#: starts of a group at first, and edges near them that a task takes
STARTS, MOST = 1 << 15, 1 << 22
#: starts of a group at least, while there are cores without one
FEWEST = 128
#: edges that are joined by a broadcast
FEW = 1 << 17


def _steps_of(edge: DataFrame, blocked_tables: DataFrame | None = None, blocked_edges: DataFrame | None = None, kinds: tuple[str, ...] = ("fk", "inferred")) -> DataFrame:
    """at, next, step, sig, cost, inf: both directions of every edge that may be used.
    blocked_tables: table_name; blocked_edges: src_table, src_column, dst_table, dst_column,
    either way round."""
    edge = edge.where(F.col("kind").isin(*kinds))
    adj = paths.adjacency(edge)
    if blocked_edges is not None:
        both = paths.adjacency(blocked_edges.withColumns({"kind": F.lit(""), "confidence": F.lit(0.0)})).drop("kind", "confidence")
        adj = adj.join(both, ["src_table", "src_column", "dst_table", "dst_column"], "left_anti")
    if blocked_tables is not None:
        for side in ("src_table", "dst_table"):
            adj = adj.join(blocked_tables.select(F.col("table_name").alias(side)), side, "left_anti")
    adj = adj.where("src_table <> dst_table")
    step = F.struct(F.col("src_table").alias("a"), F.col("src_column").alias("ac"), F.col("dst_table").alias("b"), F.col("dst_column").alias("bc"), F.col("kind").alias("kind"), F.col("confidence").cast("double").alias("conf"))
    sig = paths.signature(F.array(step))
    return adj.select(F.col("src_table").alias("at"), F.col("dst_table").alias("next"), step.alias("step"), sig.alias("sig"), _units(F.col("kind"), F.col("confidence")).alias("cost"), (F.col("kind") == "inferred").cast("int").alias("inf"))


def hops_of(edge: DataFrame, **how) -> DataFrame:
    """_steps_of() with num, numbers in the order of signatures."""
    # numbered in ranges of signatures
    hop = written(_steps_of(edge, **how).repartitionByRange("sig").withColumn("p", F.spark_partition_id()))
    sizes = hop.groupBy("p").agg(F.count(F.lit(1)).alias("size"))  # a row for each range
    before = F.coalesce(F.sum("size").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("p").orderBy("sig", "step"))
    hop = written(hop.withColumn("num", within).join(F.broadcast(sizes.select("p", before.alias("before"))), "p").withColumn("num", F.col("num") + F.col("before")).drop("p", "before"))
    return F.broadcast(hop) if hop.count() <= FEW else hop


def _units(kind: Column, confidence: Column) -> Column:
    """An edge's cost in millionths, so that sums are exact and ties are ties."""
    return F.round(S.edge_cost(kind == "inferred", confidence) * 1_000_000).cast("long")


_TASK = ("goal", "avoid", "skip", "hops_left", "inf_left")


def relax(hop: DataFrame, tasks: DataFrame, max_depth: int, within: DataFrame | None = None, max_inferred: int | None = None) -> DataFrame:
    """task, node, hops, inf, cost, way (numbers of edges): labels that no other makes useless.
    tasks: task, start, goal (null: every table), avoid (tables), skip (first steps as
    JSON), hops_left, inf_left; with max_inferred, all go from their own name to every table.
    within: node, goal, least (hops between them): ways that it rules out are left."""
    alike = max_inferred is not None
    held = [] if alike else ["start", *_TASK]
    # `new` stays in written labels: a union of them as they are fails in Spark 4.1's constraints
    front = written(tasks.select("task", F.col("start").alias("node"), F.lit(0).alias("hops"), F.lit(0).alias("inf"), F.lit(0).cast("long").alias("cost"), F.array().cast("array<bigint>").alias("way"), F.lit(1).alias("new"), *held))
    labels = [front]
    for h in range(max_depth):
        h_ = hop.select("num", "at", "next", F.to_json("step").alias("step_told"), F.col("cost").alias("step_cost"), F.col("inf").alias("step_inf"))
        inferred = F.col("inf") + F.col("step_inf")
        if alike:
            x = front.join(h_, front["node"] == h_["at"]).where((F.col("next") != F.col("task")) & (inferred <= max_inferred))
        else:
            open_ = front.where(F.col("goal").isNull() | (F.col("node") != F.col("goal")))
            x = open_.join(h_, open_["node"] == h_["at"]).where(~F.array_contains("avoid", F.col("next")) & (F.col("next") != F.col("start")) & (inferred <= F.col("inf_left")) & (F.lit(h + 1) <= F.col("hops_left")))
            if h == 0:
                x = x.where(~F.array_contains("skip", F.col("step_told")))
        if within is not None:
            w = within.select(F.col("node").alias("w_node"), F.col("goal").alias("w_goal"), "least")
            x = x.join(w, (x["next"] == w["w_node"]) & (x["goal"] == w["w_goal"])).where(F.col("least") + h + 1 <= F.col("hops_left"))
        way = F.struct((F.col("cost") + F.col("step_cost")).alias("cost"), F.array_append("way", F.col("num")).alias("way"))
        new = x.select("task", F.col("next").alias("node"), inferred.alias("inf"), F.lit(1).alias("new"), way.alias("way"), *held)
        # older labels stand before new ones, so that the least cost so far tells what is useless
        old = [f.select("task", "node", "inf", F.lit(0).alias("new"), F.struct("cost", F.lit(None).cast("array<bigint>").alias("way")).alias("way"), *[F.lit(None).cast(f.schema[c].dataType).alias(c) for c in held]) for f in labels]
        rows = reduce(DataFrame.unionByName, [*old, new]).repartition("task", "node")
        rows = rows.groupBy("task", "node", "inf", "new").agg(F.min("way").alias("way"), *[F.first(c).alias(c) for c in held])
        least = F.min("way.cost").over(Window.partitionBy("task", "node").orderBy("inf", "new").rowsBetween(Window.unboundedPreceding, -1))
        rows = rows.withColumn("least", least).where((F.col("new") == 1) & (F.col("least").isNull() | (F.col("least") > F.col("way.cost"))))
        front = written(rows.select("task", "node", F.lit(h + 1).alias("hops"), "inf", "way.*", "new", *held))
        labels.append(front)
        if front.isEmpty():
            break
    return reduce(DataFrame.unionByName, [f.select("task", "node", "hops", "inf", "cost", "way") for f in labels]).where("hops > 0")


def _best(labels: DataFrame, *keys: str, by: str = "way") -> DataFrame:
    """The first label of each key by cost, hops, signature."""
    told = [c for c in ("hops", "inf", "cost", "way", "sig", "steps") if c in labels.columns]
    return labels.groupBy(*keys).agg(F.min_by(F.struct(*told), F.struct("cost", "hops", by)).alias("b")).select(*keys, "b.*")


def _told(rows: DataFrame, hop: DataFrame, max_depth: int) -> DataFrame:
    """rows with sig and steps in place of way."""
    for i in range(max_depth):
        # places behind a way's end are dealt out, too
        num = F.coalesce(F.get("way", F.lit(i)), -1 - F.pmod(F.hash("way"), F.lit(1 << 16)))
        rows = rows.withColumn("n", num).join(hop.select(F.col("num").alias("n"), F.col("step").alias(f"s{i}")), "n", "left").drop("n")
    steps = F.filter(F.array(*[F.col(f"s{i}") for i in range(max_depth)]), lambda x: x.isNotNull())
    return rows.withColumn("steps", steps).drop("way", *[f"s{i}" for i in range(max_depth)]).withColumn("sig", paths.signature(F.col("steps")))


def _from(starts: DataFrame, max_depth: int, max_inferred: int) -> DataFrame:
    """A task for each table of starts(start), to every table."""
    none = F.array().cast("array<string>")
    return starts.select("start").distinct().select(F.col("start").alias("task"), "start", F.lit(None).cast("string").alias("goal"), none.alias("avoid"), none.alias("skip"), F.lit(max_depth).alias("hops_left"), F.lit(max_inferred).alias("inf_left"))


def _shown(rows: DataFrame) -> DataFrame:
    product = F.aggregate("steps", F.lit(1.0), lambda s, x: s * x["conf"])
    tables = F.concat(F.array(F.get("steps", F.lit(0))["a"]), F.transform("steps", lambda x: x["b"]))
    return rows.select("from_table", "to_table", "rank", F.col("hops").alias("depth"), F.round(F.col("cost") / 1_000_000, 6).alias("cost"), F.round(product, 6).alias("confidence"), F.array_min(F.transform("steps", lambda x: x["conf"])).alias("min_confidence"), F.col("inf").alias("n_inferred"), F.array_join(tables, ">").alias("path"), F.col("sig").alias("signature"), "steps")


def _near_groups(hop: DataFrame, starts: DataFrame, max_depth: int, many: int) -> tuple[int, DataFrame, DataFrame, DataFrame]:
    """(number of groups, starts with their group p; at, w, bits: the groups 64 * w + bit that may leave a table;
    p: groups that these edges are too many for)."""
    count = starts.count()
    # few starts are dealt to all cores
    groups = max(1, -(-count // many), min(2 * hop.sparkSession.sparkContext.defaultParallelism, -(-count // FEWEST)))
    grouped = written(starts.withColumn("p", F.pmod(F.xxhash64("start"), F.lit(groups)).cast("int")))
    bit = F.expr("shiftleft(1L, p % 64)")
    gone = lambda rows: rows.groupBy("at", "w").agg(F.bit_or("bits").alias("bits"))
    reach = written(gone(grouped.select(F.col("start").alias("at"), F.expr("p div 64").alias("w"), bit.alias("bits"))))
    way = hop.select("at", "next").distinct()
    told = None
    for _ in range(max_depth - 1):
        reach = written(gone(reach.unionByName(reach.join(way, "at").select(F.col("next").alias("at"), "w", "bits"))))
        last, told = told, reach.agg(F.sum(F.bit_count("bits"))).first()[0]
        if told == last:
            break
    size = _each_group(reach.join(hop.groupBy("at").count(), "at")).groupBy("p").agg(F.sum("count").alias("size"))
    return groups, grouped, reach, written(size.where(F.col("size") > MOST).select("p"))


def _each_group(reach: DataFrame) -> DataFrame:
    groups = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.call_function("getbit", F.col("bits"), b) == 1)
    return reach.withColumn("p", F.explode(groups)).withColumn("p", (F.col("w") * 64 + F.col("p")).cast("int")).drop("w", "bits")


def _nearby(hop: DataFrame, wanted: DataFrame, limits: nearby.Limits, many: int) -> tuple[DataFrame, DataFrame]:
    """(nearby.FOUND for wanted(start, goal: null for all or marked tables), what of wanted has
    too many edges near it). hop: at, next, step, cost, marked."""
    starts = wanted.select("start").distinct()
    groups, grouped, reach, big = _near_groups(hop, starts, limits.depth, many)
    none = [F.lit(None).cast("double" if c == "conf" else "string").alias(c) for c in nearby.STEP if c not in "ab"]
    first = wanted.join(grouped, "start").select("p", F.lit(0).alias("role"), F.col("start").alias("a"), F.col("goal").alias("b"), *none, F.lit(None).cast("long").alias("cost"), F.lit(None).cast("boolean").alias("marked"))
    edges = _each_group(hop.join(reach, "at")).select("p", F.lit(1).alias("role"), "step.*", "cost", "marked")
    rows = first.unionByName(edges).join(F.broadcast(big), "p", "left_anti")
    found = rows.repartitionById(groups, F.col("p")).sortWithinPartitions("p").mapInArrow(partial(nearby.searched, limits=limits), nearby.FOUND)
    return found, wanted.join(grouped.join(big, "p", "left_semi"), "start", "left_semi")


def _searched(edge: DataFrame, wanted: DataFrame | None, limits: nearby.Limits, among: DataFrame | None, rest: Callable[[DataFrame], DataFrame], blocked: dict) -> DataFrame:
    """Groups of starts are searched where the edges near them are; groups with too many
    are cut into eighths twice, and what is left goes to rest(starts)."""
    hop = _steps_of(edge, **blocked).select("at", "next", "step", "cost")
    if among is None:
        hop = hop.withColumn("marked", F.lit(False))
    else:
        hop = hop.join(among.select(F.col("start").alias("next"), F.lit(True).alias("marked")), "next", "left").withColumn("marked", F.coalesce("marked", F.lit(False)))
    hop = written(hop)
    if wanted is None:
        wanted = hop.select(F.col("at").alias("start"), F.lit(None).cast("string").alias("goal")).distinct()
    out = []
    for many in (STARTS, STARTS >> 3, STARTS >> 6):
        found, wanted = _nearby(hop, wanted, limits, many)
        out.append(_shown(found.withColumn("sig", paths.signature(F.col("steps")))))
        wanted = written(wanted)
        if wanted.isEmpty():
            return reduce(DataFrame.unionByName, out)
    return reduce(DataFrame.unionByName, [*out, rest(wanted)])


def best_paths(edge: DataFrame, starts: DataFrame | None = None, max_depth: int = paths.MAX_DEPTH, max_inferred: int = paths.MAX_INFERRED, **blocked) -> DataFrame:
    """The cheapest path from each table of starts(start) (all tables without it) to every
    table it reaches, in the columns of k_shortest."""
    wanted = None if starts is None else starts.select("start", F.lit(None).cast("string").alias("goal")).distinct()
    return _searched(edge, wanted, nearby.Limits(1, max_depth, max_inferred, False), None, lambda left: _best_paths(edge, left, max_depth, max_inferred, **blocked), blocked)


def _best_paths(edge: DataFrame, starts: DataFrame, max_depth: int, max_inferred: int, **blocked) -> DataFrame:
    """best_paths() by shuffled labels, of starts with very many edges near them."""
    hop = hops_of(edge, **blocked)
    found = relax(hop, _from(starts, max_depth, max_inferred), max_depth, max_inferred=max_inferred)
    return _shown(_told(_best(found, "task", "node"), hop, max_depth).withColumnsRenamed({"task": "from_table", "node": "to_table"}).withColumn("rank", F.lit(1)))


def _detours(accepted: DataFrame, last: DataFrame, max_depth: int, max_inferred: int) -> DataFrame:
    """A row for each table of the last paths but their ends: what is taken over up to there
    (root) and the search for another way on."""
    i = F.col("i")
    root = F.slice("steps", F.lit(1), i)
    spur = last.select("from_table", "to_table", "steps", F.explode(F.sequence(F.lit(0), F.col("hops") - 1)).alias("i")).select("from_table", "to_table", "i", root.alias("root"), F.get("steps", i)["a"].alias("start"))
    spur = spur.withColumn("root_sig", paths.signature(F.col("root")))
    a = accepted.select(F.col("from_table").alias("f"), F.col("to_table").alias("t"), F.col("steps").alias("a_steps"))
    same = (spur["from_table"] == a["f"]) & (spur["to_table"] == a["t"]) & (F.size("a_steps") > F.col("i")) & F.slice("a_steps", F.lit(1), F.col("i")).eqNullSafe(F.col("root"))
    taken = F.sort_array(F.collect_set(F.to_json(F.get("a_steps", F.col("i")))))
    x = spur.join(a, same).groupBy("from_table", "to_table", "i", "start", "root", "root_sig").agg(taken.alias("skip"))
    inferred = F.size(F.filter("root", lambda s: s["kind"] == "inferred"))
    x = x.select("from_table", F.col("to_table"), F.col("to_table").alias("goal"), "root", "root_sig", "start", "skip", F.sort_array(F.transform("root", lambda s: s["a"])).alias("avoid"), (F.lit(max_depth) - i).alias("hops_left"), (F.lit(max_inferred) - inferred).alias("inf_left"))
    return x.withColumn("task", F.to_json(F.struct("start", "goal", "avoid", "skip", "hops_left", "inf_left")))


def k_shortest(edge: DataFrame, pairs: DataFrame | None = None, k: int = paths.TOP_K, max_depth: int = paths.MAX_DEPTH, max_inferred: int = paths.MAX_INFERRED, among: DataFrame | None = None, **blocked) -> DataFrame:
    """from_table, to_table, rank, depth, cost, confidence, min_confidence, n_inferred, path,
    signature, steps: the k cheapest paths of each of the pairs(from_table, to_table), or of
    each two tables of among(table_name), whose pairs are never listed."""
    limits = nearby.Limits(k, max_depth, max_inferred, True)
    if among is not None:
        ends = written(among.select(F.col("table_name").alias("start")).distinct())
        wanted = ends.withColumn("goal", F.lit(None).cast("string"))
        rest = lambda left: _k_shortest(edge, None, k, max_depth, max_inferred, ends, left.select("start"), **blocked)
    else:
        ends, wanted = None, written(pairs.select(F.col("from_table").alias("start"), F.col("to_table").alias("goal")).where("start <> goal").distinct())
        rest = lambda left: _k_shortest(edge, left.withColumnsRenamed({"start": "from_table", "goal": "to_table"}), k, max_depth, max_inferred, None, None, **blocked)
    return _searched(edge, wanted, limits, ends, rest, blocked)


def _k_shortest(edge: DataFrame, pairs: DataFrame | None, k: int, max_depth: int, max_inferred: int, ends: DataFrame | None, starts: DataFrame | None, **blocked) -> DataFrame:
    """k_shortest() by shuffled labels, of pairs or of starts (with all of ends) with very many
    edges near them."""
    hop = hops_of(edge, **blocked)
    if ends is not None:
        found = relax(hop, _from(starts, max_depth, max_inferred), max_depth, max_inferred=max_inferred).withColumnsRenamed({"task": "from_table", "node": "to_table"})
        first = found.join(ends.select(F.col("start").alias("to_table")), "to_table", "left_semi")
    else:
        pairs = written(pairs.select("from_table", "to_table").where("from_table <> to_table").distinct())
        found = relax(hop, _from(pairs.select(F.col("from_table").alias("start")), max_depth, max_inferred), max_depth, max_inferred=max_inferred).withColumnsRenamed({"task": "from_table", "node": "to_table"})
        first = found.join(pairs, ["from_table", "to_table"], "left_semi")
    first = _told(_best(first, "from_table", "to_table"), hop, max_depth)
    last = written(first.withColumn("rank", F.lit(1)))
    accepted, waiting = last, None
    if k > 1:
        goals = last.select(F.col("to_table").alias("start")).distinct()
        near = relax(hop, _from(goals, max_depth - 1, max_inferred), max_depth - 1, max_inferred=max_inferred).groupBy(F.col("task").alias("goal"), "node").agg(F.min("hops").alias("least"))
        near = written(near.unionByName(goals.select(F.col("start").alias("goal"), F.col("start").alias("node"), F.lit(0).alias("least"))))
    for rank in range(2, k + 1):
        spur = written(_detours(accepted, last, max_depth, max_inferred))
        tasks = spur.select("task", "start", *_TASK).dropDuplicates(["task"])
        found = relax(hop, tasks, max_depth, near).join(tasks.select("task", "goal"), "task").where("node = goal")
        found = _told(_best(found, "task"), hop, max_depth).withColumnsRenamed({c: f"x_{c}" for c in ("hops", "inf", "cost", "sig", "steps")})
        steps = F.concat("root", "x_steps")
        root_cost = F.aggregate("root", F.lit(0).cast("long"), lambda s, x: s + _units(x["kind"], x["conf"]))
        sig = F.when(F.col("root_sig") == "", F.col("x_sig")).otherwise(F.concat_ws("|", "root_sig", "x_sig"))
        inferred = F.size(F.filter(steps, lambda s: s["kind"] == "inferred"))
        new = spur.join(found, "task").select("from_table", "to_table", F.size(steps).alias("hops"), inferred.alias("inf"), (root_cost + F.col("x_cost")).alias("cost"), sig.alias("sig"), steps.alias("steps"))
        waiting = new if waiting is None else waiting.unionByName(new)
        waiting = written(waiting.join(accepted.select("from_table", "to_table", "steps"), ["from_table", "to_table", "steps"], "left_anti").dropDuplicates(["from_table", "to_table", "steps"]).select(*new.columns))
        last = written(_best(waiting, "from_table", "to_table", by="sig").withColumn("rank", F.lit(rank)))
        if last.isEmpty():
            break
        accepted = accepted.unionByName(last)
    return _shown(accepted)
