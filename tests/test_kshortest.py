"""Cheapest paths against the listing of all paths, with limits, ties, parallel and blocked edges."""

import random

import pyarrow as pa
import pytest

from quarry.operators import kshortest, nearby, paths

EDGE = "src_table string, src_column string, dst_table string, dst_column string, kind string, confidence double"


def graph(n, m, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(m):
        a, b = rng.sample(range(n), 2)
        kind = rng.choice(["fk", "fk", "inferred"])
        rows.append((f"t{a}", f"c{i % 3}", f"t{b}", rng.choice(["id", "x"]), kind, 1.0 if kind == "fk" else rng.choice([0.2, 0.55, 0.85])))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, EDGE).distinct()


def every_pair(spark, rows):
    names = sorted({t for r in rows for t in (r[0], r[2])})
    return spark.createDataFrame([(a, b) for a in names for b in names], "from_table string, to_table string")


def shown(df, k=None):
    rows = df.select("from_table", "to_table", "rank", "depth", "cost", "confidence", "min_confidence", "n_inferred", "path", "signature").collect()
    return sorted(tuple(r) for r in rows if k is None or r["rank"] <= k)


@pytest.mark.parametrize(("n", "m", "depth", "inferred", "k"), [(6, 9, 4, 2, 3), (8, 16, 3, 1, 4), (9, 14, 4, 0, 2), (5, 14, 5, 2, 6), (7, 3, 4, 2, 3)])
def test_equals_the_listing_of_all_paths(spark, n, m, depth, inferred, k):
    rows = graph(n, m, seed=n * m)
    edge = frame(spark, rows)
    want = shown(paths.ranked(paths.enumerate_paths(edge, depth, inferred), k))
    assert shown(kshortest.k_shortest(edge, every_pair(spark, rows), k, depth, inferred)) == want
    assert shown(kshortest.best_paths(edge, None, depth, inferred)) == [w for w in want if w[2] == 1]


def test_blocked_tables_and_edges(spark):
    rows = [("a", "x", "m", "id", "fk", 1.0), ("m", "y", "b", "id", "fk", 1.0), ("a", "p", "n", "id", "fk", 1.0), ("n", "q", "b", "id", "fk", 1.0), ("a", "g", "b", "id", "inferred", 0.9)]
    edge = frame(spark, rows)
    pair = spark.createDataFrame([("a", "b")], "from_table string, to_table string")
    found = lambda **how: [r.path for r in kshortest.k_shortest(edge, pair, 3, **how).orderBy("rank").collect()]
    assert found() == ["a>n>b", "a>m>b", "a>b"]  # a.p before a.x
    assert found(blocked_tables=spark.createDataFrame([("m",)], "table_name string")) == ["a>n>b", "a>b"]
    turned = spark.createDataFrame([("b", "id", "n", "q")], "src_table string, src_column string, dst_table string, dst_column string")
    assert found(blocked_edges=turned) == ["a>m>b", "a>b"]
    assert found(kinds=("fk",)) == ["a>n>b", "a>m>b"] and found(max_depth=1) == ["a>b"] and found(max_inferred=0) == ["a>n>b", "a>m>b"]


def test_a_longer_declared_chain_beats_a_guess_and_limits_hide_nothing(spark):
    chain = [(f"t{i}", "n", f"t{i + 1}", "id", "fk", 1.0) for i in range(4)]
    rows = [*chain, ("t0", "g", "t4", "id", "inferred", 0.1), ("t0", "h", "t2", "id", "inferred", 0.9)]
    pair = spark.createDataFrame([("t0", "t4")], "from_table string, to_table string")
    found = [(r.path, r.cost) for r in kshortest.k_shortest(frame(spark, rows), pair, 5).orderBy("rank").collect()]
    assert found == [("t0>t4", 3.1), ("t0>t1>t2>t3>t4", 4.0), ("t0>t2>t3>t4", 4.5)]


def test_parallel_edges_are_paths_of_their_own(spark):
    rows = [("a", "x", "b", "id", "fk", 1.0), ("a", "y", "b", "id", "fk", 1.0), ("b", "z", "c", "id", "fk", 1.0)]
    pair = spark.createDataFrame([("c", "a"), ("a", "a"), ("a", "lost")], "from_table string, to_table string")
    found = [r.signature for r in kshortest.k_shortest(frame(spark, rows), pair, 3).orderBy("rank").collect()]
    assert found == ["c.id=b.z:fk|b.id=a.x:fk", "c.id=b.z:fk|b.id=a.y:fk"]


def test_labels_do_not_list_paths(spark):
    """A ladder of diamonds has 2^n paths, and a label for each table and number of hops."""
    rows = []
    for i in range(7):
        for side in "lr":
            rows += [(f"s{i}", side, f"{side}{i}", "id", "fk", 1.0), (f"{side}{i}", "n", f"s{i + 1}", "id", "fk", 1.0)]
    hop = kshortest.hops_of(frame(spark, rows))
    start = spark.createDataFrame([("s0",)], "start string")
    labels = kshortest.relax(hop, kshortest._from(start, 14, 0), 14)
    assert labels.count() == 3 * 7
    assert kshortest.best_paths(frame(spark, rows), start, 14, 0).where("to_table = 's7'").first().depth == 14


def test_pairs_among_tables_are_not_listed(spark):
    rows = graph(6, 12, seed=3)
    some = spark.createDataFrame([("t0",), ("t2",), ("t5",), ("lost",)], "table_name string")
    pairs = [(a, b) for a in ("t0", "t2", "t5") for b in ("t0", "t2", "t5")]
    edge = frame(spark, rows)
    want = shown(kshortest.k_shortest(edge, spark.createDataFrame(pairs, "from_table string, to_table string"), 1))
    assert want and shown(kshortest.k_shortest(edge, k=1, among=some)) == want


def test_labels_hold_numbers_of_edges_alone(spark):
    """No names of steps are written for labels; numbers stand in the order of signatures."""
    hop = kshortest.hops_of(frame(spark, graph(6, 12, seed=3)))
    start = spark.createDataFrame([("t0",)], "start string")
    labels = kshortest.relax(hop, kshortest._from(start, 2, 2), 2, max_inferred=2)
    assert labels.columns == ["task", "node", "hops", "inf", "cost", "way"] and labels.schema["way"].dataType.simpleString() == "array<bigint>"
    by_sig = [r.num for r in hop.orderBy("sig").collect()]
    assert by_sig == list(range(1, len(by_sig) + 1))


@pytest.mark.parametrize("changes", [{"MOST": 0}, {"STARTS": 2, "MOST": 1 << 20}, {"STARTS": 1 << 7, "FEWEST": 1, "MOST": 22}])
def test_groups_large_and_small_find_the_same(spark, monkeypatch, changes):
    """Starts in few or many groups, and those whose groups have too many edges, by shuffled labels."""
    rows = graph(8, 16, seed=5)
    edge, some = frame(spark, rows), spark.createDataFrame([("t0",), ("t3",), ("t4",), ("t7",), ("lost",)], "table_name string")
    want = shown(paths.ranked(paths.enumerate_paths(edge, 4, 2), 3))
    for name, value in changes.items():
        monkeypatch.setattr(kshortest, name, value)
    assert shown(kshortest.best_paths(edge)) == [w for w in want if w[2] == 1]
    assert shown(kshortest.k_shortest(edge, among=some)) == [w for w in want if {w[0], w[1]} <= {"t0", "t3", "t4", "t7"}]


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_edges_that_differ_in_confidence_alone_are_paths_of_their_own(spark, monkeypatch, most):
    monkeypatch.setattr(kshortest, "MOST", most)
    rows = [("a", "x", "b", "id", "inferred", 0.2), ("a", "x", "b", "id", "inferred", 0.5), ("b", "z", "c", "id", "fk", 1.0)]
    pair = spark.createDataFrame([("a", "c")], "from_table string, to_table string")
    found = shown(kshortest.k_shortest(frame(spark, rows), pair, 3))
    assert [(r[2], r[4]) for r in found] == [(1, 3.7), (2, 4.0)]
    assert found == [r for r in shown(paths.ranked(paths.enumerate_paths(frame(spark, rows), 4, 2), 3)) if r[:2] == ("a", "c")]


def test_paths_found_are_not_shuffled(spark):
    """They are told where they are found: nothing is joined or dealt out above the search."""
    edge = frame(spark, graph(8, 16, seed=5))
    for found in (kshortest.best_paths(edge), kshortest.k_shortest(edge, among=edge.select(edge.src_table.alias("table_name")))):
        above = found._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
        assert not any(x in above for x in ("Join", "Repartition", "Aggregate", "Sort"))


def test_batches_with_too_many_ways_are_halved(spark, monkeypatch):
    rows = graph(8, 16, seed=5)
    want = shown(kshortest.k_shortest(frame(spark, rows), every_pair(spark, rows), 2))
    near, told = nearby.Near(table(rows)), []
    monkeypatch.setattr(nearby, "ROOM", 20)
    batch = pa.RecordBatch.from_pylist([{"p": 0, "role": 0, "a": f"t{i}", "b": f"t{j}"} | dict.fromkeys(["ac", "bc", "kind", "conf", "cost", "marked"]) for i in range(8) for j in range(8) if i != j], GROUP)
    edges = table(rows).append_column("p", pa.array([0] * near.dst.size, pa.int32())).append_column("role", pa.array([1] * near.dst.size, pa.int32())).select(GROUP.names)
    for out in nearby.searched(iter([batch, *edges.to_batches(max_chunksize=3)]), nearby.Limits(2, 4, 2, True)):
        told += out.to_pylist()
    assert sorted((r["from_table"], r["to_table"], r["rank"], r["hops"], r["cost"] / 1e6) for r in told) == [(w[0], w[1], w[2], w[3], w[4]) for w in want]


GROUP = pa.schema([("p", pa.int32()), ("role", pa.int32()), *[(c, pa.float64() if c == "conf" else pa.string()) for c in nearby.STEP], ("cost", pa.int64()), ("marked", pa.bool_())])


def table(rows):
    both = sorted({x for a, ac, b, bc, kind, conf in rows for x in ((a, ac, b, bc, kind, conf), (b, bc, a, ac, kind, conf))})
    units = [1_000_000 if r[4] == "fk" else round((2.5 + max(0, 0.7 - r[5])) * 1e6) for r in both]
    return pa.table({c: [r[i] for r in both] for i, c in enumerate(nearby.STEP)} | {"cost": pa.array(units, pa.int64()), "marked": [False] * len(both)})
