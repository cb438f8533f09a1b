"""Sketches and measured overlap against plain sets."""

import random

import pytest

from quarry.operators import overlap


def tables(spark, seed=1, n=600):
    rng = random.Random(seed)
    a = [(i, rng.randrange(40), f"name {rng.randrange(n)}", None if i % 3 else rng.random(), "x" * 100 + str(i % 5)) for i in range(n)]
    b = [(rng.randrange(n), rng.randrange(20, 60), f"name {rng.randrange(2 * n)}") for _ in range(2 * n)]
    return {
        "a": spark.createDataFrame(a, "id long, small int, word string, part double, long string").repartition(5),
        "b": spark.createDataFrame(b, "a_id long, other int, word string").repartition(3),
        "c": spark.createDataFrame([(7, "x" * 100 + "3", None)], "id int, text string, nothing string"),
    }


def sets(data):
    """(table, column) -> (family, values)"""
    family = {"bigint": "n", "int": "n", "double": "n", "string": "s"}
    return {(t, c): (family[k], {str(r[0]) for r in df.select(c).collect() if r[0] is not None}) for t, df in data.items() for c, k in df.dtypes}


def by_hand(data, least):
    every, out = sets(data), {}
    for x, (fx, vx) in every.items():
        for y, (fy, vy) in every.items():
            if x != y and fx == fy and vx and round(len(vx & vy) / len(vx), 6) >= least:
                out[(*x, *y)] = (len(vx), len(vy), len(vx & vy))
    return out


@pytest.mark.parametrize(("k", "least"), [(1024, 0.5), (1024, 1.0), (128, 0.5), (128, 0.9), (16, 0.6)])
def test_all_contained_pairs_are_found(spark, monkeypatch, k, least):
    data = tables(spark)
    found = {tuple(r[:4]): (r.n_left, r.n_right, r.n_both) for r in overlap.contained(data, least, k).collect()}
    assert found == by_hand(data, least)


def test_sketches_of_parts_merge_into_that_of_the_whole(spark):
    data = tables(spark)["b"]
    whole = {(r.column_name, r.hash) for r in overlap.sketches({"t": data}, 50).collect()}
    for parts in (1, 2, 9):
        assert {(r.column_name, r.hash) for r in overlap.sketches({"t": data.repartition(parts)}, 50).collect()} == whole
    per = {c: sorted(h for n, h in whole if n == c) for c in data.columns}
    hashes = {c: sorted({r[0] for r in data.selectExpr(f"xxhash64(cast({c} as string))").collect()})[:50] for c in data.columns}
    assert per == hashes


def test_sketches_spare_the_exact_check(spark):
    """Of columns in one range, those without common values are no candidates."""
    rng = random.Random(3)
    data = {f"t{i}": spark.createDataFrame([(rng.randrange(10**6) * 8 + i,) for _ in range(800)] + [(0,), (8 * 10**6 + 8,)], "v long") for i in range(8)}
    data["all"] = data["t0"].unionByName(data["t1"])
    names = overlap.simple_columns(data)
    found = overlap.candidates(overlap.sketches(data, 256, names), overlap.facts(data, names), 0.5, 256).collect()
    assert {(r.src_table, r.dst_table) for r in found if r.src_table in ("t0", "t1")} == {("t0", "all"), ("t1", "all")}
    assert all(r.src_table == "all" for r in found if r.src_table not in ("t0", "t1"))


def test_measure_gives_every_pair_that_is_asked_for(spark):
    data = tables(spark)
    asked = [("a", "id", "b", "a_id"), ("b", "a_id", "a", "id"), ("c", "nothing", "a", "word"), ("a", "word", "c", "nothing"), ("a", "long", "c", "text")]
    got = {tuple(r[:4]): r for r in overlap.measure(data, spark.createDataFrame(asked * 2, "src_table string, src_column string, dst_table string, dst_column string")).collect()}
    every = sets(data)
    assert set(got) == set(asked)
    for key, r in got.items():
        left, right = every[key[:2]][1], every[key[2:]][1]
        assert (r.n_left, r.n_right, r.n_both) == (len(left), len(right), len(left & right))
        assert r.containment == (round(len(left & right) / len(left), 6) if left else 0.0)
        assert r.jaccard == (round(len(left & right) / len(left | right), 6) if left | right else 0.0)


def test_index_blends_guesses_with_the_values(spark, tmp_path):
    from quarry import lifecycle
    from quarry.sources import catalog

    folder = str(tmp_path / "in")
    spark.createDataFrame([(i, "x") for i in range(50)], "id long, label string").write.parquet(f"{folder}/ship.parquet")
    spark.createDataFrame([(i, i % 30, 1000 + i) for i in range(90)], "id long, ship_id long, crew_id long").write.parquet(f"{folder}/voyage.parquet")
    spark.createDataFrame([(i,) for i in range(10)], "id long").write.parquet(f"{folder}/crew.parquet")
    state = lifecycle.State(spark, str(tmp_path / "state"))
    lifecycle.index(state, catalog.ParquetSource(spark, folder), "fleet")
    graph = state.store("fleet").read()
    found = {r.source_column: (r.confidence, r.source) for r in graph["INFERRED_JOIN"].selectExpr("*").collect() if r.source_column in ("ship_id", "crew_id")}
    assert found["ship_id"][0] > 0.9 and found["crew_id"][0] < 0.4
