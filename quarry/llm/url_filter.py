"""URL filters: rules decide what they fit, a tree of path templates decides the rest.

A rule is `host/path`: it fits its host and all subdomains where the path starts with its
own; the longest one that fits wins. What rules (or given labels) say of some pages is
learned for the others, host by host:

1. Templates. From the host down, segment by segment, a node's children are the segments
   that hold at least 1 / LITERALS of its pages (and SUPPORT pages); all others are one
   wildcard, so that a node has at most LITERALS + 1 children however many values there are.
2. Merging. Two branches are similar if neither the share of blocked among their labelled
   pages nor the share of paths that end there differs by a two-proportion test (Z2 is the
   square of its bound). A child that is similar to the rest of its node goes into the wildcard;
   of the others (in the order of these shares) neighbours that are similar become one branch,
   which is written `{a|b}`.
3. Purity. A template's share of blocked pages is smoothed by that of its parent, as if M
   more labelled pages were like the parent; the host's is smoothed by that of all hosts, and
   that by one page of each kind. A template above THRESHOLD is rejected.

Paths count to DEPTH segments; what lies deeper is '**'. Only DataFrame functions run here:
a level is two aggregations (combined before they are shuffled) and a join with the few
children that stay, whose hot keys adaptive execution splits. The rules are held by the plan.

Defined cases: a null url or one without '://' has an empty host and path; empty segments
do not count; a segment that looks like a wildcard or a branch of several is a wildcard; a
rule listed twice counts once, blocking; repeated rows are judged alike and all count;
without labels nothing is rejected; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import discard, stash

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
DEPTH = 4
LITERALS = 20
SUPPORT = 3
Z2 = 3.84
M = 4.0
THRESHOLD = 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts_of(url: Column) -> tuple[Column, Column]:
    """(host, path)"""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*+", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*+", 0)
    empty = F.lit("")
    return F.coalesce(F.translate(host, _UPPER, _LOWER), empty), F.coalesce(path, empty)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); null where none does."""
    fits = []
    for verdict, rule in rules:
        name, slash, rest = rule.partition("/")
        here = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        fits.append(F.when(here, F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    if not fits:
        return F.lit(None).cast("struct<size: int, rule: string, verdict: string>")
    return F.array_max(F.array_compact(F.array(*fits)))


def _segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def _differ(a: Column, of_a: Column, b: Column, of_b: Column) -> Column:
    """Whether a of of_a and b of of_b are different shares by the two-proportion test."""
    a, of_a, b, of_b = (c.cast("double") for c in (a, of_a, b, of_b))
    gap, yes, whole = a * of_b - b * of_a, a + b, of_a + of_b
    return gap * gap * whole > F.lit(Z2) * yes * (whole - yes) * of_a * of_b


_SUMS = ("n", "labelled", "blocked", "ends")


def _children(rows: DataFrame) -> DataFrame:
    """host, node, segment, branch of the children that stay apart (LITERALS of a node at
    most). rows: host, node, segment, and what is summed."""
    total = lambda prefix: [F.sum(c).alias(prefix + c) for c in _SUMS]
    rows = rows.where(F.col("segment").isNotNull())
    whole = rows.groupBy("host", "node").agg(*total("all_"))
    plain = ~F.col("segment").isin("*", "**") & ~F.col("segment").startswith("{")
    each = rows.groupBy("host", "node", "segment").agg(*total("")).where((F.col("n") >= SUPPORT) & plain)

    def unlike(other: dict[str, Column]) -> Column:
        return _differ(F.col("blocked"), F.col("labelled"), other["blocked"], other["labelled"]) | _differ(F.col("ends"), F.col("n"), other["ends"], other["n"])

    rest = {c: F.col(f"all_{c}") - F.col(c) for c in _SUMS}
    each = each.join(whole, ["host", "node"]).where((F.col("n") * LITERALS >= F.col("all_n")) & unlike(rest))
    bad = F.when(F.col("labelled") > 0, F.col("blocked") / F.col("labelled")).otherwise(F.lit(-1.0))
    line = Window.partitionBy("host", "node").orderBy("bad", "short", "segment")
    each = each.withColumns({"bad": bad, "short": F.col("ends") / F.col("n")})
    new = F.coalesce(unlike({c: F.lag(c).over(line) for c in _SUMS}), F.lit(False)).cast("int")
    each = each.withColumn("new", new).withColumn("number", F.sum("new").over(line))
    members = F.array_sort(F.collect_list("segment").over(Window.partitionBy("host", "node", "number")))
    branch = F.when(F.size(members) > 1, F.concat(F.lit("{"), F.array_join(members, "|"), F.lit("}"))).otherwise(F.col("segment"))
    return each.select("host", "node", "segment", branch.alias("branch"))


def templates(rows: DataFrame) -> DataFrame:
    """rows (host, path, labelled, blocked, ...) with node, their template; written level by
    level, so that a lost executor costs one level at most."""
    rows = rows.withColumn("node", F.lit(""))
    last = None
    for level in range(DEPTH):
        found = _segments(F.col("path"))
        rows = rows.withColumn("segment", F.get(found, F.lit(level)))
        kept = _children(rows.withColumns({"n": F.lit(1), "ends": (F.size(found) == level + 1).cast("int")}))
        node = F.when(F.col("segment").isNull(), F.col("node")).otherwise(F.concat("node", F.lit("/"), F.coalesce("branch", F.lit("*"))))
        rows = stash(rows.join(kept, ["host", "node", "segment"], "left").withColumn("node", node).drop("segment", "branch"), "templates")
        if last is not None:
            discard(last)
        last = rows
    return rows.withColumn("node", F.when(F.size(_segments(F.col("path"))) > DEPTH, F.concat("node", F.lit("/**"))).otherwise(F.col("node")))


def purities(rows: DataFrame) -> DataFrame:
    """host, node, n, labelled, blocked, purity of every template. rows: host, node, labelled,
    blocked."""
    tree = stash(rows.groupBy("host", "node").agg(F.count(F.lit(1)).alias("n"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")), "tree")
    # a node's ways down: '', '/a', '/a/*'
    steps = F.filter(F.split("node", "/"), lambda s: s != "")
    above = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.array_join(F.transform(F.slice(steps, F.lit(1), k), lambda s: F.concat(F.lit("/"), s)), ""))
    ways = tree.select("host", "node", "labelled", "blocked", F.posexplode(above).alias("depth", "over"))
    sums = ways.groupBy("host", "over").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    chain = ways.select("host", "node", "depth", "over").join(sums, ["host", "over"]).groupBy("host", "node").agg(F.array_sort(F.collect_list(F.struct("depth", "labelled", "blocked"))).alias("chain"))
    whole = tree.agg(F.sum("labelled"), F.sum("blocked")).first()
    prior = ((whole[1] or 0) + 1.0) / ((whole[0] or 0) + 2.0)
    purity = F.aggregate("chain", F.lit(prior), lambda p, x: (x["blocked"] + p * M) / (x["labelled"] + F.lit(M)))
    return tree.join(chain.select("host", "node", purity.alias("purity")), ["host", "node"])


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, labels: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity (the smoothed share of blocked
    pages of the template). labels: page_id and blocked (0 or 1), where there are more than
    the rules give; a page that a rule fits is labelled by the rule."""
    host, path = parts_of(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    rows = rows.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("said"))
    told = F.col("said") == "block"
    if labels is not None:
        rows = rows.join(labels.where("page_id is not null and blocked is not null").groupBy("page_id").agg((F.max("blocked") > 0).alias("marked")), "page_id", "left")
        told = F.coalesce(told, F.col("marked"))
    rows = rows.withColumns({"labelled": told.isNotNull().cast("int"), "blocked": F.coalesce(told, F.lit(False)).cast("int")})
    rows = templates(rows)
    tree = purities(rows).select("host", "node", "purity")
    verdict = F.coalesce("said", F.when(F.col("purity") > THRESHOLD, F.lit("block")).otherwise(F.lit("allow")))
    return rows.join(tree, ["host", "node"]).select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.col("node").alias("template"), "purity")


def _differ_sql(a: str, of_a: str, b: str, of_b: str) -> str:
    gap = f"({a}::DOUBLE * ({of_b}) - ({b}) * {of_a}::DOUBLE)"
    whole, yes = f"({of_a}::DOUBLE + ({of_b}))", f"({a}::DOUBLE + ({b}))"
    return f"{gap} * {gap} * {whole} > {Z2}::DOUBLE * {yes} * ({whole} - {yes}) * {of_a}::DOUBLE * ({of_b})"


def oracle() -> str:
    """The operator's SQL, a level after the other."""
    fits = ", ".join(
        f"CASE WHEN (host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}') THEN {{'size': {len(r)}, 'rule': '{r}', 'said': '{v}'}} END" for v, r in RULES)
    sums = "sum(n) AS n, sum(labelled) AS labelled, sum(blocked) AS blocked, sum(ends) AS ends"
    levels = []
    for d in range(DEPTH):
        levels.append(f"""
s{d} AS (SELECT *, segments[{d + 1}] AS segment, 1 AS n, (len(segments) = {d + 1})::INT AS ends FROM t{d}),
w{d} AS (SELECT host, node, {sums} FROM s{d} WHERE segment IS NOT NULL GROUP BY ALL),
e{d} AS (SELECT e.*, CASE WHEN e.labelled > 0 THEN e.blocked / e.labelled ELSE -1.0 END::DOUBLE AS bad, (e.ends / e.n)::DOUBLE AS short
         FROM (SELECT host, node, segment, {sums} FROM s{d} WHERE segment IS NOT NULL AND segment NOT IN ('*', '**') AND NOT starts_with(segment, '{{') GROUP BY ALL) e
         JOIN w{d} w ON w.host = e.host AND w.node = e.node
         WHERE e.n >= {SUPPORT} AND e.n * {LITERALS} >= w.n AND ({_differ_sql('e.blocked', 'e.labelled', 'w.blocked - e.blocked', 'w.labelled - e.labelled')} OR {_differ_sql('e.ends', 'e.n', 'w.ends - e.ends', 'w.n - e.n')})),
l{d} AS (SELECT *, lag(n) OVER x AS pn, lag(labelled) OVER x AS pl, lag(blocked) OVER x AS pb, lag(ends) OVER x AS pe FROM e{d} WINDOW x AS (PARTITION BY host, node ORDER BY bad, short, segment)),
g{d} AS (SELECT *, sum(coalesce({_differ_sql('blocked', 'labelled', 'pb', 'pl')} OR {_differ_sql('ends', 'n', 'pe', 'pn')}, false)::INT) OVER (PARTITION BY host, node ORDER BY bad, short, segment) AS number FROM l{d}),
c{d} AS (SELECT host, node, unnest(list(segment)) AS segment, CASE WHEN count(*) > 1 THEN '{{' || string_agg(segment, '|' ORDER BY segment) || '}}' ELSE any_value(segment) END AS branch FROM g{d} GROUP BY host, node, number),
t{d + 1} AS (SELECT s.* EXCLUDE (node, segment, n, ends), CASE WHEN s.segment IS NULL THEN s.node ELSE s.node || '/' || coalesce(c.branch, '*') END AS node
         FROM s{d} s LEFT JOIN c{d} c ON c.host = s.host AND c.node = s.node AND c.segment = s.segment),""")
    return rf"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
f AS (SELECT *, list_max(list_filter([{fits}], lambda x: x IS NOT NULL)) AS fit FROM h),
t0 AS (SELECT page_id, host, path, fit.rule AS rule, fit.said AS said, (fit IS NOT NULL)::INT AS labelled, coalesce(fit.said = 'block', false)::INT AS blocked,
         list_filter(string_split(path, '/'), lambda s: s <> '') AS segments, '' AS node FROM f),{''.join(levels)}
t AS (SELECT * EXCLUDE (node), node || CASE WHEN len(segments) > {DEPTH} THEN '/**' ELSE '' END AS node FROM t{DEPTH}),
tree AS (SELECT host, node, sum(labelled) AS labelled, sum(blocked) AS blocked, list_filter(string_split(node, '/'), lambda s: s <> '') AS steps FROM t GROUP BY host, node),
ways AS (SELECT host, node, labelled, blocked, k AS depth, list_aggregate(list_prepend('', list_transform(steps[1:k], lambda s: '/' || s)), 'string_agg', '') AS over
         FROM (SELECT *, unnest(range(len(steps) + 1)) AS k FROM tree)),
sums AS (SELECT host, over, sum(labelled) AS labelled, sum(blocked) AS blocked FROM ways GROUP BY ALL),
prior AS (SELECT (sum(blocked) + 1)::DOUBLE / (sum(labelled) + 2)::DOUBLE AS p FROM tree),
chains AS (SELECT w.host, w.node, list({{'l': s.labelled::DOUBLE, 'b': s.blocked::DOUBLE}} ORDER BY depth) AS chain FROM ways w JOIN sums s ON s.host = w.host AND s.over = w.over GROUP BY ALL),
pure AS (SELECT host, node, list_reduce(list_prepend({{'l': 0::DOUBLE, 'b': p}}, chain), lambda a, x: {{'l': 0::DOUBLE, 'b': (x.b + a.b * {M}) / (x.l + {M})}}).b AS purity FROM chains, prior)
SELECT page_id, t.host, path, rule, coalesce(said, CASE WHEN purity > {THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict, t.node AS template, purity
FROM t JOIN pure ON pure.host = t.host AND pure.node = t.node"""
