"""Read-only graph queries: a subset of Cypher, compiled to frames over the graph's labels.

MATCH (a:Label {p: 'v'})-[r:TYPE|TYPE2]->(b:Label) [WHERE ...] [WITH ... [WHERE ...]] RETURN
expr [AS name], ... [ORDER BY ...] [LIMIT n], with undirected edges -[...]-, several hops,
OPTIONAL MATCH, count/sum/min/max/avg/collect with DISTINCT, and $parameters. WHERE, WITH and
RETURN are Spark SQL expressions over a.property; a term of WHERE may be a pattern over known
variables, with NOT in front or not (a semi or anti join). CALL show_tables() and CALL
table_info('Label') tell the labels and their properties. Anything that writes is refused.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITES = re.compile(r"\b(create|merge|set|delete|detach|drop|remove|alter|copy|load|call)\b", re.I)
_CALL = re.compile(r"\s*call\s+(show_tables|table_info)\s*\(\s*(?:'(\w+)')?\s*\)\s*(?:return\s+\*)?\s*;?\s*", re.I)
_CLAUSE = re.compile(r"\b(OPTIONAL\s+MATCH|MATCH|WHERE|(?<!STARTS )(?<!ENDS )WITH|RETURN|ORDER\s+BY|LIMIT)\b", re.I)
_NODE = re.compile(r"\(\s*(\w+)?\s*(?::\s*(\w+))?\s*(?:\{([^}]*)\})?\s*\)")
_EDGE = re.compile(r"(<)?-(?:\[\s*(\w+)?\s*(?::\s*([\w|:\s]+))?\s*\])?-(>)?")
_AGG = re.compile(r"^\s*(count|sum|min|max|avg|collect)\s*\(", re.I)


class CypherError(ValueError):
    pass


def _clauses(text: str) -> list[tuple[str, str]]:
    hits = list(_CLAUSE.finditer(text))
    if not hits or text[: hits[0].start()].strip() or not hits[0].group(1).upper().endswith("MATCH"):
        raise CypherError("a query begins with MATCH")
    ends = [*[h.start() for h in hits[1:]], len(text)]
    return [(re.sub(r"\s+", " ", h.group(1).upper()), text[h.end() : e].strip()) for h, e in zip(hits, ends, strict=True)]


def _split(text: str) -> list[str]:
    out, depth, cur = [], 0, ""
    for c in text:
        depth += c in "([{"
        depth -= c in ")]}"
        if c == "," and depth == 0:
            out.append(cur.strip())
            cur = ""
        else:
            cur += c
    return [*out, cur.strip()] if cur.strip() else out


def _frame(df: DataFrame, var: str) -> DataFrame:
    return df.select(F.struct(*df.columns).alias(var))


def _pattern(graph: dict[str, DataFrame], text: str, bound: DataFrame | None, optional: bool) -> DataFrame:
    out, n = bound, 0
    for part in _split(text):
        pos, last = 0, None
        while pos < len(part):
            edge = _EDGE.match(part, pos) if last else None
            types, ev, left, right = None, None, False, False
            if edge:
                ev, left, right = edge.group(2), bool(edge.group(1)), bool(edge.group(4))
                types = [t.strip() for t in re.split(r"\|:?", edge.group(3) or "") if t.strip()] or [k for k in graph if k.isupper()]
                pos = edge.end()
            node = _NODE.match(part, pos)
            if not node:
                raise CypherError(f"not a pattern: {part[pos:]!r}")
            pos = node.end()
            n += 1
            var, label = node.group(1) or f"__n{n}", node.group(2)
            if label is None and (out is None or var not in out.columns):
                raise CypherError(f"node {var!r} needs a label")
            known = out is not None and var in out.columns
            if not known:
                if label not in graph:
                    raise CypherError(f"unknown label {label!r}")
                nodes = _frame(graph[label], var)
                for pair in _split(node.group(3) or ""):
                    k, _, v = pair.partition(":")
                    nodes = nodes.where(F.expr(f"{var}.{k.strip()} = {v.strip()}"))
            if edge is None:
                out = nodes if out is None else out if known else out.crossJoin(nodes)
            else:
                ev = ev or f"__e{n}"
                edges = None
                for t in types:
                    if t not in graph:
                        raise CypherError(f"unknown edge {t!r}")
                    e = graph[t].select("src", "dst", F.lit(t).alias("type"), F.struct(*graph[t].columns).alias("p"))
                    e = e.select("src", "dst", F.to_json("p").alias("json"), "type") if len(types) > 1 else e.select("src", "dst", "p", "type")
                    edges = e if edges is None else edges.unionByName(e)
                turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])
                edges = turned if left and not right else edges if right and not left else edges.unionByName(turned)
                body = F.col("p") if len(types) == 1 else F.struct("src", "dst", "type", "json")
                edges = edges.select(F.col("src").alias(f"__s{n}"), F.col("dst").alias(f"__d{n}"), body.alias(ev))
                how = "left" if optional else "inner"
                if known:
                    out = out.join(edges, (F.col(f"{last}.node_id") == F.col(f"__s{n}")) & (F.col(f"{var}.node_id") == F.col(f"__d{n}")), how)
                else:
                    hop = edges.join(nodes, F.col(f"__d{n}") == F.col(f"{var}.node_id"))
                    out = out.join(hop, F.col(f"{last}.node_id") == F.col(f"__s{n}"), how)
                out = out.drop(f"__s{n}", f"__d{n}")
            last = var
    return out


def _terms(text: str) -> list[str]:
    """The terms that AND joins at the top level."""
    out, depth, cur = [], 0, ""
    for part in re.split(r"('[^']*'|\"[^\"]*\"|[()\[\]{}]|\bAND\b)", text, flags=re.I):
        depth += part in ("(", "[", "{")
        depth -= part in (")", "]", "}")
        if depth == 0 and part.upper() == "AND":
            out.append(cur.strip())
            cur = ""
        else:
            cur += part
    return [*out, cur.strip()]


def _spark(text: str) -> str:
    """A Cypher expression in Spark's words."""
    text = re.sub(r"([\w.]+)\s+STARTS\s+WITH\s+('[^']*')", r"startswith(\1, \2)", text, flags=re.I)
    text = re.sub(r"([\w.]+)\s+ENDS\s+WITH\s+('[^']*')", r"endswith(\1, \2)", text, flags=re.I)
    text = re.sub(r"([\w.]+)\s+CONTAINS\s+('[^']*')", r"contains(\1, \2)", text, flags=re.I)
    text = re.sub(r"\bIN\s*\[([^\]]*)\]", r"IN (\1)", text, flags=re.I)
    text = re.sub(r"(?i)\blist_distinct\s*\(", "array_distinct(", text)
    return re.sub(r"(?i)\blist_concat\s*\(", "concat(", text).replace("<>", "!=")


def _where(graph: dict[str, DataFrame], out: DataFrame, body: str) -> DataFrame:
    for term in _terms(body):
        m = re.match(r"(NOT\s+)?(\(\s*\w*\s*(?::\s*\w+\s*)?(?:\{[^}]*\}\s*)?\)\s*<?-.*)$", term, re.I | re.S)
        out = out.where(F.expr(_spark(term))) if m is None else _matching(graph, out, m.group(2).strip(), "left_anti" if m.group(1) else "left_semi")
    return out


def _matching(graph: dict[str, DataFrame], out: DataFrame, text: str, how: str) -> DataFrame:
    """Rows for which the pattern is there (or is not): known variables join by node."""
    known = [v for v in re.findall(r"\(\s*(\w+)", text) if v in out.columns]
    if not known:
        raise CypherError(f"the pattern {text!r} has no known variable")
    every = None
    for label, df in graph.items():  # a known node may be of any label
        if "node_id" in df.columns:
            every = df.select("node_id") if every is None else every.unionByName(df.select("node_id"))
    inner = re.sub(r"\(\s*(\w+)\s*\)", lambda m: f"({m[1]}:__any)" if m[1] in known else m[0], text)
    inner = re.sub(r"\(\s*\)", "(:__any)", inner)
    found = _pattern(graph | {"__any": every}, inner, None, False)
    names = dict.fromkeys(known)
    pairs = found.select(*[F.col(f"{v}.node_id").alias(f"__k_{v}") for v in names]).distinct()
    on = [F.col(f"{v}.node_id") == F.col(f"__k_{v}") for v in names]
    return out.join(pairs, on, how)


def _aggregate(text: str):
    m = _AGG.match(text)
    inner = _spark(text[m.end() : text.rindex(")")].strip())
    distinct = re.match(r"distinct\s+", inner, re.I)
    inner = inner[distinct.end() :] if distinct else inner
    name = m.group(1).lower()
    if name == "collect":
        return F.array_sort(F.collect_set(F.expr(inner)) if distinct else F.collect_list(F.expr(inner)))
    if name == "count":
        return F.count(F.lit(1)) if inner == "*" else F.count_distinct(F.expr(inner)) if distinct else F.count(F.expr(inner))
    return F.expr(f"{name}({'distinct ' if distinct else ''}{inner})")


def _projected(out: DataFrame, body: str) -> DataFrame:
    """The items of WITH or RETURN; those without an aggregate are the groups' keys."""
    distinct = re.match(r"distinct\s+", body, re.I)
    body = body[distinct.end() :] if distinct else body
    keys, aggs, names = [], [], []
    for item in _split(body):
        expr, _, name = _named(item)
        names.append(name)
        (aggs if _AGG.match(expr) else keys).append((expr, name))
    if aggs:
        out = out.groupBy(*[F.expr(_spark(e)).alias(a) for e, a in keys]).agg(*[_aggregate(e).alias(a) for e, a in aggs]).select(*names)
    else:
        out = out.select(*[F.expr(_spark(e)).alias(a) for e, a in keys])
    return out.distinct() if distinct else out


def _called(graph: dict[str, DataFrame], procedure: str, label: str | None) -> DataFrame:
    spark = next(iter(graph.values())).sparkSession
    if procedure == "show_tables":
        return spark.createDataFrame(sorted((k, "REL" if k.isupper() else "NODE") for k in graph), "name string, type string")
    if label not in graph:
        raise CypherError(f"unknown label {label!r}")
    return spark.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(graph[label].schema.fields)], "property_id int, name string, type string")


def query(graph: dict[str, DataFrame], text: str, parameters: dict | None = None) -> DataFrame:
    """The result of a read-only query; raises CypherError on what it does not know."""
    call = _CALL.fullmatch(text)
    if call:
        return _called(graph, call.group(1).lower(), call.group(2))
    bare = re.sub(r"'[^']*'|\"[^\"]*\"", "''", text)
    if _WRITES.search(bare):
        raise CypherError("only reading queries are allowed")
    for k, v in (parameters or {}).items():
        literal = "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"
        text = re.sub(rf"\${k}\b", lambda _, s=literal: s, text)
    out: DataFrame | None = None
    for clause, body in _clauses(text):
        if clause in ("MATCH", "OPTIONAL MATCH"):
            out = _pattern(graph, body, out, clause == "OPTIONAL MATCH")
        elif clause == "WHERE":
            out = _where(graph, out, body)
        elif clause in ("WITH", "RETURN"):
            out = _projected(out, body)
        elif clause == "ORDER BY":
            order = [F.expr(_spark(re.sub(r"(?i)\s+(asc|desc)$", "", x))).desc() if re.search(r"(?i)\sdesc$", x) else F.expr(_spark(re.sub(r"(?i)\s+asc$", "", x))) for x in _split(body)]
            out = out.orderBy(*order)
        elif clause == "LIMIT":
            out = out.limit(int(body))
    if out is None:
        raise CypherError("nothing is returned")
    return out


def _named(item: str) -> tuple[str, str, str]:
    m = re.search(r"(?i)\s+as\s+(\w+)$", item)
    return (item[: m.start()], "", m.group(1)) if m else (item, "", item.replace(".", "_") if re.fullmatch(r"[\w.]+", item) else item)


#: Nodes of a parsed plan that only read. Whatever else stands in a plan is refused.
_READING = re.compile(
    r"Unresolved(Relation|With|Having|Hint|SubqueryColumnAliases|InlineTable|TableValuedFunction|OrdinalInOrderBy|Pivot|Unpivot|Qualify)?|Project|Filter|Aggregate|Sort|GlobalLimit|LocalLimit|Limit\w*|Offset|Tail|Distinct|Deduplicate\w*|Join|AsOfJoin|Union|UnionLoop\w*|Except|Intersect|"
    r"SubqueryAlias|CTERelation\w*|WithCTE|WithWindowDefinition|Window|Generate|Expand|Sample|LocalRelation|OneRowRelation|Range|Values|LateralJoin|Pivot|Unpivot|View|TableValuedFunction\w*|ParameterizedQuery|NameParameterizedQuery|PosParameterizedQuery|ResolvedHint|BaseEvalPython|Transpose|PipeOperator|PipeExpression"
)


def writing_nodes(spark: SparkSession, sql: str) -> list[str]:
    """Names of the nodes in a statement's plan (subqueries and CTEs included) that do more
    than read."""
    found: list[str] = []

    def expression(e) -> None:
        if e.nodeName() in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"):
            node(e.plan())
        for i in range(e.children().size()):
            expression(e.children().apply(i))

    def node(x) -> None:
        if not _READING.fullmatch(x.nodeName()):
            found.append(x.nodeName())
            return
        if x.nodeName() == "UnresolvedWith":
            for i in range(x.cteRelations().size()):
                node(x.cteRelations().apply(i)._2())
        for i in range(x.children().size()):
            node(x.children().apply(i))
        for i in range(x.expressions().size()):
            expression(x.expressions().apply(i))

    node(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql))
    return found


def run_sql(spark: SparkSession, graph: dict[str, DataFrame], sql: str) -> DataFrame:
    """SQL over the labels as views; only queries: every node of the parsed plan must read."""
    writes = writing_nodes(spark, sql)
    if writes:
        raise CypherError(f"only queries are allowed, not {', '.join(writes)}")
    for label, df in graph.items():
        df.createOrReplaceTempView(label)
    return spark.sql(sql)
