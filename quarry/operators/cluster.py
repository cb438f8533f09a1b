"""Communities of tables, their cohesion and their labels.

The graph of tables of one database fits in one task by nature; data never goes here.
Several databases are clustered side by side, one group each.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import scalars as S

LEAST = 3
# Weights of roles when a cluster is named (1 for others), words and endings
# that do not name one.
ROLE_WEIGHT = {"dimension": 1.5, "fact": 1.25, "bridge": 0.4, "link": 0.4}
STOP_WORDS = ("tbl", "table", "tables", "fk", "id", "ids", "ref", "refs", "rel", "rels", "map", "maps", "link", "links", "detail", "details", "log", "logs")
DENIED_ENDINGS = ("entity", "history", "type")


def weighted_pairs(edge: DataFrame) -> DataFrame:
    """a, b, weight: undirected pairs with the greatest weight of parallel edges."""
    a, b = F.least("src_table", "dst_table"), F.greatest("src_table", "dst_table")
    return edge.where("src_table <> dst_table").groupBy(a.alias("a"), b.alias("b")).agg(F.max(F.coalesce("confidence", F.lit(0.5))).alias("weight"))


def resolution(tables: int) -> float:
    return 0.5 + tables / 200


def _moved(nodes: list, near: dict, loops: dict, gamma: float, total: float) -> dict:
    """Each node moves to the neighbouring community of the greatest gain, in order, until
    nothing improves."""
    degree = {n: sum(near[n].values()) + 2 * loops.get(n, 0.0) for n in nodes}
    own = {n: i for i, n in enumerate(nodes)}
    volume = {i: degree[n] for n, i in own.items()}
    moved = True
    while moved:
        moved = False
        for n in nodes:
            links: dict[int, float] = defaultdict(float)
            for m, w in near[n].items():
                links[own[m]] += w
            here = own[n]
            volume[here] -= degree[n]
            gain = lambda c: links.get(c, 0.0) - gamma * degree[n] * volume[c] / (2 * total)  # noqa: B023, E731
            best = max([here, *sorted(links)], key=lambda c: (round(gain(c), 12), c == here, -c))  # noqa: B023
            volume[best] += degree[n]
            if best != here:
                own[n], moved = best, True
    return own


def modularity(groups: list[set[str]], pairs: list[tuple[str, str, float]], gamma: float = 1.0) -> float:
    total = sum(w for _, _, w in pairs)
    if not total:
        return 0.0
    at = {n: i for i, g in enumerate(groups) for n in g}
    inner, volume = defaultdict(float), defaultdict(float)
    for a, b, w in pairs:
        volume[at[a]] += w
        volume[at[b]] += w
        if at[a] == at[b]:
            inner[at[a]] += w
    return sum(inner[c] / total - gamma * (volume[c] / (2 * total)) ** 2 for c in volume)


def communities_of(nodes: list[str], pairs: list[tuple[str, str, float]], least: int = LEAST, gamma: float | None = None) -> dict[str, int]:
    """Louvain's method in name order: nodes move, communities become the nodes of the next
    level, until a level changes nothing. Then small clusters merge into the neighbour with
    the greatest weight (then size, then name)."""
    near: dict[str, dict[str, float]] = defaultdict(dict)
    for a, b, w in pairs:
        near[a][b] = near[b][a] = w
    names, total = sorted(nodes), sum(w for _, _, w in pairs)
    groups: dict[int, set[str]] = {i: {n} for i, n in enumerate(names)}
    if total:
        gamma = resolution(len(names)) if gamma is None else gamma
        at = {n: i for i, n in enumerate(names)}
        level = {at[n]: {at[m]: w for m, w in near[n].items()} for n in names}
        loops: dict[int, float] = {}
        while True:
            own = _moved(sorted(level), level, loops, gamma, total)
            if len(set(own.values())) == len(level):
                break
            merged: dict[int, set[str]] = defaultdict(set)
            up: dict[int, dict[int, float]] = {c: defaultdict(float) for c in set(own.values())}
            inner: dict[int, float] = defaultdict(float)
            for n, c in own.items():
                merged[c] |= groups[n]
                inner[c] += loops.get(n, 0.0)
                for m, w in level[n].items():
                    if own[m] == c:
                        inner[c] += w / 2
                    else:
                        up[c][own[m]] += w
            groups, level, loops = merged, up, inner
    while len(groups) > 1:
        small = sorted((c for c in groups if len(groups[c]) < least), key=lambda c: (len(groups[c]), min(groups[c])))
        if not small:
            break
        c = small[0]
        weight = {d: sum(near[n].get(m, 0.0) for n in groups[c] for m in groups[d]) for d in groups if d != c}
        to = min(weight, key=lambda d: (-weight[d], -len(groups[d]), min(groups[d])))
        groups[to] |= groups.pop(c)
    order = sorted(groups.values(), key=lambda g: (-len(g), min(g)))
    return {n: i for i, g in enumerate(order) for n in g}


def communities(nodes: DataFrame, pairs: DataFrame, least: int = LEAST, gamma: float | None = None) -> DataFrame:
    """nodes(database, table_name), pairs(database, a, b, weight) -> database, table_name,
    cluster."""
    rows = nodes.select("database", F.col("table_name").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(0.0).alias("weight")).unionByName(pairs.select("database", "a", "b", "weight"))

    def run(x: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(x.loc[x.b.isna(), "a"]))
        edge = x[x.b.notna()].sort_values(["a", "b"])
        got = communities_of(names, list(edge[["a", "b", "weight"]].itertuples(index=False, name=None)), least, gamma)
        return pd.DataFrame({"database": x.database.iloc[0], "table_name": list(got), "cluster": list(got.values())})

    return rows.groupBy("database").applyInPandas(run, "database string, table_name string, cluster long")


def cohesion(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """cluster, n_tables, cohesion: inner weight over the number of possible pairs."""
    side = lambda c: members.select(F.col("table_name").alias(c), F.col("cluster").alias(f"c{c}"))
    inner = pairs.join(side("a"), "a").join(side("b"), "b").where("ca = cb").groupBy(F.col("ca").alias("cluster")).agg(F.sum("weight").alias("w"))
    n = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_tables"))
    k = F.col("n_tables")
    return n.join(inner, "cluster", "left").select("cluster", "n_tables", F.round(F.when(k < 2, 0.0).otherwise(F.coalesce("w", F.lit(0.0)) / (k * (k - 1) / 2)), 6).alias("cohesion"))


def labels(members: DataFrame, pairs: DataFrame, roles: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """cluster, anchor, label. The anchor has the greatest role-weighted degree inside the
    cluster (then rows, then name). The head noun is the name token of the greatest sum of
    (degree + 1) * log10(rows + 10) * role weight, in how many tables, then by letters; a
    final s, schema names, stop words and denied endings do not count."""
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    side = lambda c: members.select(F.col("table_name").alias(c), F.col("cluster").alias(f"c{c}"))
    degree = both.join(side("a"), "a").join(side("b"), "b").where("ca = cb").groupBy(F.col("a").alias("table_name")).agg(F.count(F.lit(1)).alias("degree"))
    role = F.coalesce(F.element_at(F.create_map(*[x for r, w in ROLE_WEIGHT.items() for x in (F.lit(r), F.lit(w))]), F.col("role")), F.lit(1.0))
    x = members.join(degree, "table_name", "left").join(roles.select("table_name", "role"), "table_name", "left")
    x = x.join(rows.select("table_name", "row_count"), "table_name", "left") if rows is not None else x.withColumn("row_count", F.lit(0).cast("long"))
    n = F.greatest(F.coalesce("row_count", F.lit(0)), F.lit(0))
    x = x.withColumn("degree", F.coalesce("degree", F.lit(0))).withColumn("power", F.col("degree") * role).withColumn("weight", (F.col("degree") + 1) * F.log10(n + 10) * role).withColumn("n_rows", n)
    order = Window.partitionBy("cluster").orderBy(F.desc("power"), F.desc("n_rows"), F.lower("table_name"))
    anchor = x.withColumn("r", F.row_number().over(order)).where("r = 1").select("cluster", F.col("table_name").alias("anchor"))
    size = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    bare = F.regexp_replace(F.substring_index("table_name", ".", -1), "(?i)(_fk|_id)$", "")
    schema = F.when(F.col("table_name").contains("."), F.lower(F.substring_index("table_name", ".", 1)))
    token = x.select("cluster", "weight", schema.alias("schema"), F.explode(S.identifier_tokens(bare)).alias("t"))
    named = members.select("cluster", F.lower(F.substring_index("table_name", ".", -1)).alias("t")).distinct()
    schemas = token.where("schema IS NOT NULL").select("cluster", F.col("schema").alias("t")).distinct().join(named, ["cluster", "t"], "left_anti")
    token = token.where((F.length("t") > 1) & ~F.col("t").isin(*STOP_WORDS) & ~F.col("t").rlike("^[0-9]+$")).join(schemas, ["cluster", "t"], "left_anti")
    stem = F.when((F.length("t") > 3) & F.col("t").endswith("s"), F.expr("left(t, length(t) - 1)")).otherwise(F.col("t"))
    token = token.withColumn("stem", stem).where(~F.col("stem").rlike(f"({'|'.join(DENIED_ENDINGS)})$"))
    vote = token.groupBy("cluster", "stem").agg(F.round(F.sum("weight"), 9).alias("v"), F.count(F.lit(1)).alias("k"), F.max_by("t", F.length("t")).alias("word"))
    vote = vote.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("v"), F.desc("k"), "stem"))).where("r = 1").select("cluster", F.initcap("word").alias("head"))
    full = F.when(F.col("anchor").contains("."), F.col("anchor")).otherwise(F.concat(F.lit("main."), F.col("anchor")))
    tail = F.when(F.col("n") > 1, F.concat(F.lit(" cluster ("), F.col("n").cast("string"), F.lit(" tables)"))).otherwise("")
    y = anchor.join(vote, "cluster", "left").join(size, "cluster")
    return y.select("cluster", "anchor", F.concat(full, F.lit(" · "), F.coalesce("head", F.regexp_replace(F.substring_index("anchor", ".", -1), "_", " ")), tail).alias("label"))
