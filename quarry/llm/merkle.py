"""A Merkle manifest of a dataset: one digest for all rows, and a proof for each.

A row's leaf is the digest of its columns. The leaves of a language, by doc_id, form a tree
in which every ARITY consecutive nodes (the last run may have fewer) become the digest of
their concatenation; the languages' subroots form the upper tree in the same way.

Leaves lie in ranges of (lang, doc_id). A range knows from counts where its leaves stand in
their tree, and folds them into a sparse forest: the nodes, keyed by tree, level and index,
whose sibling run is not complete yet - a few for each level. Forests are an associative
monoid: merging adds the nodes of one to the other, and wherever that completes a run (its
length is known from the tree's width) the run becomes its parent. A tree reduction merges
the ranges' forests: neighbouring ranges first, in written rounds of FAN, so that a node
goes up as soon as it can, then treeReduce over the few forests left. Nodes that a merge
settles are kept, as other ranges' proofs need them; of its inner nodes a range needs none
but its own, so each is handed the siblings at its edges and folds its rows' proofs by
itself. The driver sees the last FAN forests' edges and the root only.

Defined cases: null columns are written as '-'; null languages come first, null doc_ids
first within a language; rows of one doc_id stand in the order of their leaves, and equal
rows are leaves of their own; an empty text is '0:'; an empty table has no root and gives an
empty result; other columns are ignored. The table of languages is ranked in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import discard, stash

ARITY = 2
#: Rows of a range, and forests that one merge of a round takes.
RANGE_ROWS = 16384
FAN = 64
#: The number of the upper tree, whose leaves are the subroots.
UPPER = -1
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

#: a node's key: tree, width of the tree's lowest level, level, index in the level
Key = tuple[int, int, int, int]
_NODE = "part long, tree long, width long, level int, idx long, digest string, open boolean, born boolean"
_PROOF = "leaf string, subroot string, proof array<string>, folded_root string"


def digest_of(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(columns: dict[str, Column], names: Iterable[str] = COLUMNS) -> Column:
    """The leaf of a row: each column as its UTF-8 length, ':' and its value, or '-' for null."""
    said = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (columns[n].cast("string") for n in names)]
    return F.sha2(F.concat(*said), 256)


def width_at(width: int, level: int) -> int:
    return -(-width // ARITY**level)


def height(width: int) -> int:
    """The level of a tree's only top node."""
    level = 0
    while width_at(width, level) > 1:
        level += 1
    return level


def run_of(index: int, width: int) -> range:
    """The sibling run of a node in a level of so many nodes."""
    first = index - index % ARITY
    return range(first, min(first + ARITY, width))


@dataclass
class Forest:
    """Unresolved nodes by key, and the nodes that merging made (in the order made)."""

    trees: int
    nodes: dict[Key, str]
    born: list[tuple[Key, str]]

    def add(self, key: Key, digest: str) -> None:
        """Put a node in, and each parent that it completes."""
        while True:
            tree, width, level, index = key
            wide = width_at(width, level)
            if wide == 1:
                if tree == UPPER:
                    self.nodes[key] = digest
                    return
                key = (UPPER, self.trees, 0, tree)
            else:
                run = run_of(index, wide)
                others = [(tree, width, level, i) for i in run if i != index]
                if any(k not in self.nodes for k in others):
                    self.nodes[key] = digest
                    return
                self.nodes[key] = digest
                digest = digest_of(*[self.nodes.pop((tree, width, level, i)) for i in run])
                key = (tree, width, level + 1, index // ARITY)
            self.born.append((key, digest))

    def merge(self, other: Forest) -> Forest:
        """Both forests in one; associative, and the order does not change the outcome."""
        self.born += other.born
        for key, digest in other.nodes.items():
            self.add(key, digest)
        return self


def _rows(part: int, forest: Forest, told: Iterable[tuple[Key, str]]) -> pa.Table:
    """The open nodes, and those that are to be told to ranges that ask (born), open or not."""
    told = dict(told)
    nodes = [(*k, d, True, k in told) for k, d in forest.nodes.items()] + [(*k, d, False, True) for k, d in told.items() if k not in forest.nodes]
    names = ("tree", "width", "level", "idx", "digest", "open", "born")
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_(), pa.bool_())
    return pa.table({"part": pa.array([part] * len(nodes), pa.int64())} | {n: pa.array([r[i] for r in nodes], t) for i, (n, t) in enumerate(zip(names, types, strict=True))})


def _in_order(table: pa.Table) -> pa.Table:
    return table.sort_by("pos")


def _fold(trees: int):
    """A range's leaves into its forest. Its open nodes are told, and made nodes of the upper
    tree: a range that holds whole languages may settle them before others could see them."""

    def step(rows: pa.Table, runs: pa.Table) -> pa.Table:
        leaves = _in_order(rows).column("leaf").to_pylist()
        forest, at = Forest(trees, {}, []), 0
        for run in runs.sort_by("tree").to_pylist():
            for i in range(run["n"]):
                forest.add((run["tree"], run["width"], 0, run["first"] + i), leaves[at + i])
            at += run["n"]
        return _rows(runs.column("part")[0].as_py(), forest, [*forest.nodes.items(), *(x for x in forest.born if x[0][0] == UPPER)])

    return step


def _merge(trees: int, fan: int):
    """Forests of `fan` neighbours into one; the nodes that this makes are told."""

    def step(table: pa.Table) -> pa.Table:
        forest = Forest(trees, {}, [])
        for r in table.to_pylist():
            forest.add((r["tree"], r["width"], r["level"], r["idx"]), r["digest"])
        return _rows(table.column("part")[0].as_py() // fan, forest, forest.born)

    return step


def _edges(first: int, n: int, width: int) -> Iterator[tuple[int, int]]:
    """(level, index) of the siblings beside the leaves [first, first + n) on every level."""
    low, high = first, first + n - 1
    for level in range(height(width)):
        wide = width_at(width, level)
        yield from ((level, i) for i in run_of(low, wide) if i < low)
        yield from ((level, i) for i in run_of(high, wide) if i > high)
        low, high = low // ARITY, high // ARITY


def _wanted(trees: int):
    """Which nodes a range needs from others: edges, and its languages' ways to the root."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[tuple[int, int, int, int], None] = {}
            for r in batch.to_pylist():
                out |= dict.fromkeys((r["part"], r["tree"], level, i) for level, i in _edges(r["first"], r["n"], r["width"]))
                out |= dict.fromkeys((r["part"], UPPER, level, i) for level, i in _edges(r["tree"], 1, trees))
                out[r["part"], UPPER, 0, r["tree"]] = None
            yield pa.RecordBatch.from_pydict({n: pa.array([k[i] for k in out], pa.int32() if n == "level" else pa.int64()) for i, n in enumerate(("part", "tree", "level", "idx"))})

    return step


def _prove(trees: int, kept: list[str]):
    """A range's rows with their proofs. Beside the rows comes its guide: the runs of leaves
    (digest null) and the wanted nodes."""

    def step(rows: pa.Table, guide: pa.Table) -> pa.Table:
        rows = _in_order(rows)
        leaves, shown = rows.column("leaf").to_pylist(), rows.column("shown").to_pylist()
        given = guide.to_pylist()
        node = {(g["tree"], g["level"], g["idx"]): g["digest"] for g in given if g["digest"] is not None}
        out: dict[str, list] = {"subroot": [], "proof": [], "folded_root": []}
        at = 0
        for run in sorted((g for g in given if g["digest"] is None), key=lambda g: g["tree"]):
            tree, first, n = run["tree"], run["first"], run["n"]
            levels = [(first, leaves[at : at + n])]
            for level in range(height(run["width"])):
                wide = width_at(run["width"], level)
                low, own = levels[-1]
                left = run_of(low, wide).start
                high = low + len(own)
                own = [node[tree, level, i] for i in range(left, low)] + own + [node[tree, level, i] for i in range(high, run_of(high - 1, wide).stop)]
                levels[-1] = (left, own)
                levels.append((left // ARITY, [digest_of(*own[i : i + ARITY]) for i in range(0, len(own), ARITY)]))
            levels.pop()
            ways = []
            for level in range(height(trees)):
                index = tree // ARITY**level
                siblings = run_of(index, width_at(trees, level))
                ways.append(([node[UPPER, level, i] for i in siblings if i < index], [node[UPPER, level, i] for i in siblings if i > index]))
            subroot = node[UPPER, 0, tree]
            for i in range(n):
                index, digest, proof = first + i, shown[at + i], []
                for low, own in levels:
                    run_at = index - index % ARITY - low
                    before, after = own[run_at : index - low], own[index - low + 1 : run_at + ARITY]
                    proof += before + after
                    digest = digest_of(*before, digest, *after)
                    index //= ARITY
                for before, after in ways:
                    proof += before + after
                    digest = digest_of(*before, digest, *after)
                out["subroot"].append(subroot)
                out["proof"].append(proof)
                out["folded_root"].append(digest)
            at += n
        made = {"subroot": pa.array(out["subroot"], pa.string()), "proof": pa.array(out["proof"], pa.list_(pa.string())), "folded_root": pa.array(out["folded_root"], pa.string())}
        return pa.table({c: rows.column(c) for c in kept} | {"leaf": rows.column("leaf")} | made)

    return step


@dataclass
class Manifest:
    """root (None for an empty table); rows: lang, doc_id, leaf, shown, and where each lies;
    runs: which leaves of which tree a range holds; nodes: those that ranges may ask for."""

    root: str | None
    trees: int
    rows: DataFrame
    runs: DataFrame
    nodes: DataFrame

    def subroots(self) -> DataFrame:
        """lang, n (leaves), subroot"""
        per = self.runs.groupBy("lang", "tree").agg(F.sum("n").alias("n"))
        tops = self.nodes.where((F.col("tree") == UPPER) & (F.col("level") == 0)).select(F.col("idx").alias("tree"), F.col("digest").alias("subroot"))
        return per.join(tops, "tree").select("lang", "n", "subroot")

    def proofs(self) -> DataFrame:
        """doc_id, leaf, subroot, proof (siblings level by level up to the root, left to right)
        and folded_root: what `shown` and the proof fold to."""
        runs = self.runs.select("part", "tree", "width", "first", "n")
        wanted = runs.mapInArrow(_wanted(self.trees), "part long, tree long, level int, idx long").join(self.nodes.select("tree", "level", "idx", "digest"), ["tree", "level", "idx"])
        guide = runs.unionByName(wanted, allowMissingColumns=True)
        kept = ["doc_id"]
        schema = f"doc_id {self.rows.schema['doc_id'].dataType.simpleString()}, {_PROOF}"
        return self.rows.groupBy("part").cogroup(guide.groupBy("part")).applyInArrow(_prove(self.trees, kept), schema)


def build(leaves: DataFrame) -> Manifest:
    """The manifest of leaves: lang, doc_id, leaf, shown (the leaf that proofs() will fold)."""
    spark = leaves.sparkSession
    # the number makes equal rows differ, so that they can lie in several ranges
    written = stash(leaves.select("lang", "doc_id", "leaf", "shown").withColumn("seq", F.monotonically_increasing_id()), "leaves")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-written.count() // RANGE_ROWS))
    order = ["lang", "doc_id", "leaf", "seq"]
    sorted_rows = written.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    rows = stash(sorted_rows.withColumns({"part": F.shiftright(place, 33), "pos": place}).drop("seq"), "leaf-ranges")
    discard(written)
    held = rows.groupBy("part", "lang").agg(F.count(F.lit(1)).alias("n"))
    per = held.groupBy("lang").agg(F.sum("n").alias("width")).withColumn("tree", (F.row_number().over(Window.orderBy("lang")) - 1).cast("long"))
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    held = held.withColumn("first", F.coalesce(before, F.lit(0))).withColumnRenamed("lang", "held_lang")
    runs = stash(held.join(per, F.col("held_lang").eqNullSafe(F.col("lang"))).select("part", "lang", "tree", "width", "first", "n"), "runs")
    sizes = runs.agg(F.count_distinct("tree"), F.max("part") + 1).first()
    trees, parts = sizes[0], sizes[1] or 0
    cut = runs.select("part", "tree", "width", "first", "n")
    told = stash(rows.select("part", "pos", "leaf").groupBy("part").cogroup(cut.groupBy("part")).applyInArrow(_fold(trees), _NODE), "forests")
    nodes, live = told.where("born"), told.where("open")
    while parts > FAN:
        told = stash(live.groupBy(F.floor(F.col("part") / FAN)).applyInArrow(_merge(trees, FAN), _NODE), "forests")
        nodes, live = nodes.unionByName(told.where("born")), told.where("open")
        parts = -(-parts // FAN)
    root, last = reduce_forests(live, trees, parts)
    if last:
        nodes = nodes.unionByName(spark.createDataFrame([(0, *k, d, False, True) for k, d in last], _NODE))
    return Manifest(root, trees, rows, runs, nodes)


def reduce_forests(live: DataFrame, trees: int, forests: int) -> tuple[str | None, list[tuple[Key, str]]]:
    """The root over the open nodes of at most FAN forests, and the nodes that this made."""

    def own(rows: Iterator) -> Iterator[Forest]:
        forest = Forest(trees, {}, [])
        for r in rows:
            forest.add((r["tree"], r["width"], r["level"], r["idx"]), r["digest"])
        yield forest

    depth = max(2, math.ceil(math.log2(forests + 1) / 3))
    whole = live.repartition(max(1, min(forests, FAN)), "part").rdd.mapPartitions(own).treeReduce(Forest.merge, depth)
    tops = [d for (tree, width, level, _), d in whole.nodes.items() if tree == UPPER and width_at(width, level) == 1]
    return (tops[0] if tops else None), whole.born


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: every row's leaf and
    proof, and what its proof says where 7 divides the row's checksum and n_chars is one more
    than in the manifest."""
    columns = {c: F.col(c) for c in COLUMNS}
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    leaf = leaf_of(columns)
    shown = F.when(changed & F.col("n_chars").isNotNull(), leaf_of(columns | {"n_chars": F.col("n_chars") + 1})).otherwise(leaf)
    made = build(docs.select("lang", "doc_id", leaf.alias("leaf"), shown.alias("shown")))
    root = F.lit(made.root).cast("string")
    proof = F.sha2(F.array_join("proof", "").cast("binary"), 256)
    return made.proofs().select("doc_id", "leaf", "subroot", root.alias("root"), proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == root).alias("verified"))


_CRC = "list_reduce(list_prepend(4294967295, [ascii(c) for c in string_split(doc_id::VARCHAR, '')]), lambda crc, b: list_reduce(list_prepend(xor(crc, b::BIGINT), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda r, _: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END))"
_SAID = {c: f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}, '-')" for c in COLUMNS}


def _leaf_sql(**other: str) -> str:
    return f"sha256({' || '.join((_SAID | other)[c] for c in COLUMNS)})"


ORACLE = f"""
WITH RECURSIVE leaves AS (SELECT row_number() OVER () AS id, doc_id, lang, {_leaf_sql()} AS leaf,
    CASE WHEN xor({_CRC}, 4294967295) % 7 = 0 AND n_chars IS NOT NULL THEN {_leaf_sql(n_chars="octet_length(encode((n_chars + 1)::VARCHAR)) || ':' || (n_chars + 1)")}
         ELSE {_leaf_sql()} END AS shown FROM documents),
langs AS (SELECT lang, count(*) AS n, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM leaves GROUP BY lang),
placed AS (SELECT l.*, tree, n, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM leaves l JOIN langs ON l.lang IS NOT DISTINCT FROM langs.lang),
low AS (SELECT tree, 0 AS level, idx, n AS wide, leaf AS digest FROM placed
        UNION ALL
        SELECT tree, level + 1, idx // 2, (wide + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx)) FROM low WHERE wide > 1 GROUP BY tree, level, idx // 2, wide),
subs AS (SELECT tree, digest FROM low WHERE wide = 1),
up AS (SELECT 0 AS level, tree AS idx, (SELECT count(*) FROM langs) AS wide, digest FROM subs
       UNION ALL
       SELECT level + 1, idx // 2, (wide + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx)) FROM up WHERE wide > 1 GROUP BY level, idx // 2, wide),
steps AS (SELECT p.id, low.level, low.idx % 2 = 0 AS sibling_left, low.digest FROM placed p JOIN low ON low.tree = p.tree AND low.wide > 1 AND low.idx = xor(p.idx >> low.level, 1)
          UNION ALL
          SELECT p.id, 1000 + up.level, up.idx % 2 = 0, up.digest FROM placed p JOIN up ON up.wide > 1 AND up.idx = xor(p.tree >> up.level, 1)),
levels AS (SELECT DISTINCT tree, level FROM low WHERE wide > 1), upper AS (SELECT DISTINCT level FROM up WHERE wide > 1),
walk AS (SELECT p.id, l.level FROM placed p JOIN levels l USING (tree) UNION ALL SELECT p.id, 1000 + u.level FROM placed p, upper u),
ways AS (SELECT id, list({{'l': CASE WHEN sibling_left THEN digest ELSE '' END, 'r': CASE WHEN NOT sibling_left THEN digest ELSE '' END}} ORDER BY level) AS way, string_agg(coalesce(digest, ''), '' ORDER BY level) AS proof
         FROM (SELECT w.id, w.level, coalesce(s.sibling_left, false) AS sibling_left, coalesce(s.digest, '') AS digest FROM walk w LEFT JOIN steps s USING (id, level)) GROUP BY id),
top AS (SELECT digest AS root FROM up WHERE wide = 1),
told AS (SELECT p.doc_id, p.leaf, subs.digest AS subroot, root, sha256(coalesce(proof, '')) AS proof_sha256,
           list_reduce(list_prepend({{'l': '', 'r': p.shown}}, coalesce(way, [])), lambda d, s: {{'l': '', 'r': sha256(s.l || d.r || s.r)}}).r AS folded_root
         FROM placed p JOIN subs USING (tree) LEFT JOIN ways USING (id), top)
SELECT *, folded_root = root AS verified FROM told"""
