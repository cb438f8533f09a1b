"""Sketched and exact profiles against plain Python."""

import datetime
import decimal
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry import lifecycle
from quarry.config import Config, GraphConfig
from quarry.operators import profile, visibility
from quarry.operators.profile_store import ProfileStore
from quarry.sources import catalog, snapshot


def rows(n, seed):
    rng = random.Random(seed)
    day = datetime.datetime(2024, 1, 1)
    return [(seed * n + i, rng.choice(["red", "green", "blue"]) if rng.random() < 0.8 else f"c{rng.randrange(900)}", rng.gauss(0, 10) if rng.random() < 0.9 else None, day + datetime.timedelta(hours=rng.randrange(5000)), [rng.randrange(3)]) for i in range(n)]


SCHEMA = "id long, color string, size double, at timestamp, list array<int>"


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """Four files, and the path of their folder."""
    path = str(tmp_path_factory.mktemp("t") / "t.parquet")
    data = []
    for seed in range(4):
        data += rows(3000, seed)
        spark.createDataFrame(rows(3000, seed), SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path, data


def test_merged_profiles_are_close_to_exact_ones(spark, table, tmp_path):
    path, _ = table
    store = ProfileStore(spark, str(tmp_path))
    assert store.refresh("t", path) == {"new": 4, "kept": 0, "gone": 0}
    got = {r.column_name: r for r in store.profile("t").collect()}
    want = {r.column_name: r for r in profile.column_profile(spark.read.parquet(path)).collect()}
    assert got.keys() == want.keys()
    for c, w in want.items():
        g = got[c]
        assert (g.row_count, g.null_count, g.null_pct, g.min_value, g.max_value) == (w.row_count, w.null_count, w.null_pct, w.min_value, w.max_value)
        assert abs(g.distinct_count - w.distinct_count) <= 0.08 * w.distinct_count


def test_quantiles_are_within_their_rank_error(spark, table, tmp_path):
    path, data = table
    store = ProfileStore(spark, str(tmp_path))
    store.refresh("t", path)
    found = {(r.column_name, r.bucket): r.bound for r in store.quantiles("t", 4).collect()}
    assert {c for c, _ in found} == {"id", "size", "at"}
    for i, c in ((0, "id"), (2, "size")):
        values = sorted(r[i] for r in data if r[i] is not None)
        for b in range(5):
            below = sum(v <= found[c, b] for v in values) / len(values)
            assert abs(below - b / 4) < 0.04


def test_common_values_lie_between_their_bounds(spark, table, tmp_path, monkeypatch):
    path, data = table
    monkeypatch.setattr("quarry.operators.profile_store.HEAVY", 200)
    store = ProfileStore(spark, str(tmp_path))
    store.refresh("t", path)
    counts = Counter(r[1] for r in data)
    top = [r for r in store.common("t", 20).where("column_name = 'color'").orderBy("rank").collect()]
    assert [r.value for r in top[:3]] == [v for v, _ in counts.most_common(3)]
    assert all(r.least <= counts[r.value] <= r.greatest for r in top)
    assert all(r.least == counts[r.value] for r in top[:3])


def test_only_new_and_changed_files_are_read(spark, table, tmp_path):
    path, _ = table
    copy = str(tmp_path / "c.parquet")
    spark.read.parquet(path).repartition(3).write.parquet(copy)
    store = ProfileStore(spark, str(tmp_path / "p"))
    assert store.refresh("t", copy)["new"] == 3 and store.refresh("t", copy) == {"new": 0, "kept": 3, "gone": 0}
    spark.createDataFrame(rows(100, 9), SCHEMA).coalesce(1).write.mode("append").parquet(copy)
    assert store.refresh("t", copy) == {"new": 1, "kept": 3, "gone": 0}
    assert store.profile("t").where("column_name = 'id'").first().row_count == 12_100
    first = sorted(f for f in os.listdir(copy) if f.startswith("part-"))[0]
    os.remove(f"{copy}/{first}")
    spark.catalog.refreshByPath(copy)
    assert store.refresh("t", copy) == {"new": 0, "kept": 3, "gone": 1}
    assert store.profile("t").where("column_name = 'id'").first().row_count == spark.read.parquet(copy).count()
    with pytest.raises(KeyError):
        store.profile("other")


def test_reindexing_reads_new_files_alone(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([(i, f"n{i % 7}") for i in range(300)], "id long, name string").coalesce(1).write.parquet(f"{folder}/ship.parquet")
    config = Config(graph=GraphConfig(merge_profiles=True))
    store = lifecycle.State(spark, str(tmp_path / "state")).profiles("fleet", config)
    source = catalog.ParquetSource(spark, folder)
    snap = snapshot.inspect(source, "fleet", store=store)
    assert {r.column_name: r.distinct_count for r in snap.columns.collect()} == {"id": pytest.approx(300, rel=0.05), "name": 7}
    spark.createDataFrame([(300, "new")], "id long, name string").coalesce(1).write.mode("append").parquet(f"{folder}/ship.parquet")
    again = snapshot.inspect(source, "fleet", store=store)
    assert "profile of ship: 1 files read, 1 known" in again.notes


def test_low_cardinality_over_many_parts(spark):
    data = [(i % 50, i % 51, None, "x" * 100 if i % 2 else "y", i) for i in range(3000)]
    df = spark.createDataFrame(data, "few int, many int, none string, long string, id int").repartition(7)
    found = {r.column_name: r.sample_values.split("|") for r in profile.low_cardinality_values(df).collect()}
    assert set(found) == {"few", "long"} and found["few"] == sorted(str(i) for i in range(50)) and found["long"] == ["x" * 100, "y"]


def test_quantiles_and_ranks_with_a_value_that_most_rows_share(spark):
    rng = random.Random(4)
    data = [7.0] * 4000 + [rng.random() * 20 for _ in range(501)] + [None] * 10
    df = spark.createDataFrame([(v, i) for i, v in enumerate(data)], "v double, i long").repartition(6)
    values = sorted(v for v in data if v is not None)
    for r in profile.exact_quantiles(df, "v", 8).collect():
        at = r.bucket / 8 * (len(values) - 1)
        low, part = int(at), at - int(at)
        assert r.bound == pytest.approx(values[low] * (1 - part) + (values[low + 1] * part if part else 0))
    some = [(v, i) for i, v in enumerate(data) if v is not None]
    rank = {v: sum(x < v for x in values) for v in set(values)}
    x, y = [rank[v] for v, _ in some], list(range(len(some)))
    mean = lambda s: sum(s) / len(s)
    mx, my = mean(x), mean(y)
    want = sum((a - mx) * (b - my) for a, b in zip(x, y)) / (sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y)) ** 0.5
    assert profile.rank_correlation(df, "v", "i").first()[0] == pytest.approx(want, abs=1e-5)
    cube = spark.createDataFrame([(i**3, i) for i in range(50)], "v long, i long")
    assert profile.rank_correlation(cube, "v", "i").first()[0] == 1.0
    assert profile.rank_correlation(cube.selectExpr("1 AS v", "i"), "v", "i").first()[0] is None


def test_redaction_looks_up_each_rows_own_names(spark):
    hidden = spark.createDataFrame([(f"h{i}",) for i in range(500)], "node_id string")
    data = [(i, f"h{i}" if i % 2 else f"v{i}", [f"h{i}", "v", None], (f"h{i}", i)) for i in range(40)] + [(99, None, None, None)]
    df = spark.createDataFrame(data, "n int, seen string, list array<string>, s struct<a: string, b: int>")
    out = {r.n: r for r in visibility.redact(df, hidden, []).collect()}
    assert len(out) == 41 and out[99].seen is None and out[99].list is None and out[99].s is None
    for i in range(40):
        assert out[i].seen == (None if i % 2 else f"v{i}") and out[i].list == [None, "v", None] and out[i].s.a is None and out[i].s.b == i


def test_only_possible_keys_are_counted_exactly(spark, monkeypatch):
    """Columns with a null or a repeated value among the rows of a batch are ruled out there."""
    n = 4000
    data = [(i, i % 7, None if i == 5 else i, i // 2 if i > 10 else -i, f"{i:070d}", [i], i / 8, i if i < n - 1 else 0) for i in range(n)]
    df = spark.createDataFrame(data, "id long, few int, gap long, twice long, text string, list array<long>, ratio double, far long").repartitionByRange(8, "id")
    asked, plain = [], profile.column_profile
    monkeypatch.setattr(profile, "column_profile", lambda d, **k: asked.append(d.columns) or plain(d, **k))
    found = {(r.table_name, r.column_name) for r in profile.key_candidates({"t": df, "none": df.limit(0), "same": df.select("few")}).collect()}
    assert found == {("t", c) for c in ("id", "text", "list", "ratio")}
    assert asked[0] == ["id", "text", "list", "ratio", "far"]


def odd(spark):
    noon = datetime.datetime(2024, 1, 1, 12)
    data = [(i, [0.0, -0.0, 1.5, float("nan"), None][i % 5], [0.0, -0.0, 0.1][i % 3], decimal.Decimal(i % 4) / 10, noon + datetime.timedelta(days=i % 6), i % 2 == 0, ["x" * 70, "x" * 71, "y", None][i % 4], [i % 3], None, str(i % 9).encode()) for i in range(600)]
    return spark.createDataFrame(data, "id long, d double, f float, dec decimal(8,2), at timestamp, b boolean, s string, list array<int>, none int, raw binary").coalesce(3)


def test_distinct_values_are_brought_together_in_their_own_type(spark):
    df = odd(spark)
    found = profile.distinct_counts(df)
    got = {r.column_name: r.distinct_count for r in found.collect()}
    assert got == {"id": 600, "d": 4, "f": 3, "dec": 4, "at": 6, "b": 2, "s": 3, "list": 3, "none": 0, "raw": 9}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "cast(id" not in plan


def test_profiles_are_made_of_values_counted_once(spark, tmp_path):
    path, parts = str(tmp_path / "odd.parquet"), str(tmp_path / "p")
    odd(spark).repartition(3, "id").write.parquet(path)
    store = ProfileStore(spark, parts)
    assert store.refresh("t", path)["new"] == 3
    got = {r.column_name: (r.distinct_count, r.null_count, r.min_value, r.max_value) for r in store.profile("t").collect()}
    assert {c: g[:2] for c, g in got.items() if c != "id"} == {"d": (4, 120), "f": (3, 0), "dec": (4, 0), "at": (6, 0), "b": (2, 0), "s": (3, 150), "list": (3, 0), "none": (0, 600)}
    assert got["d"][2:] == ("-0.0", "NaN") and got["f"][2:] == ("-0.0", "0.1") and got["b"][2:] == ("false", "true") and got["s"][2:] == ("x" * 70, "y") and got["none"][2:] == (None, None)
    cells = odd(spark).drop("raw", "none")
    for c in cells.columns:
        text = F.to_json(c) if c == "list" else F.col(c).cast("string")
        text = F.when(F.length(text) > 64, F.concat(F.lit("sha256:"), F.sha2(text, 256))).otherwise(text)
        counts = Counter(r[0] for r in cells.select(text).collect() if r[0] is not None)
        found = store.common("t", 1000).where(F.col("column_name") == c).collect()
        assert all(r.least <= counts[r.value] <= r.greatest for r in found)
        assert c == "id" or {r.value: r.least for r in found} == counts
    assert {n for part in os.listdir(f"{parts}/t") if part.startswith("part-") for n in os.listdir(f"{parts}/t/{part}")} == {"sketches", "heavy"}
