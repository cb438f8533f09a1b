"""The sketch under small and large loads: what passes, what is hot, and that none is lost."""

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import count_min, kernels


def keys(n, seed=0):
    return kernels.mix(np.arange(n, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 40))


def sketch(spark, every, width, parts=4):
    df = spark.createDataFrame(pa.table({"k": pa.array(every.view(np.int64))})).repartition(parts)
    return count_min.build(df, lambda batch: [batch.column("k").to_numpy(zero_copy_only=False).view(np.uint64)], width)


def test_width_follows_the_keys():
    assert count_min.width_for(0) == count_min.LEAST_WIDTH and count_min.width_for(1e15) == count_min.MOST_WIDTH
    assert [count_min.width_for(n) for n in (1 << 20, 1 << 22, 5_000_000)] == [22, 24, 25]


@pytest.mark.parametrize(("load", "least", "most"), [(0.25, 0.0, 0.06), (1, 0.3, 0.45), (2, 0.7, 0.78), (6, 0.98, 1.0)])
def test_what_passes_at_a_load(spark, load, least, most):
    """Of single keys (1 - e^-load)^2 pass; all repeated ones do."""
    width = 17
    n = int(load * (1 << width))
    single, twice = keys(n, 1), keys(n // 10, 2)
    s = sketch(spark, np.concatenate([single, twice, twice]), width)
    assert s.repeated(twice).all()
    assert least <= s.repeated(single).mean() <= most + 0.15 * load
    if load <= 1:
        assert s.repeated(single).mean() < 0.55


@pytest.mark.parametrize("load", [0.5, 20, 300])
def test_a_full_sketch_calls_no_more_keys_hot(spark, load):
    width = 16
    n = int(load * (1 << width))
    single, hot = keys(n, 3), keys(3, 4)
    every = np.concatenate([single, np.repeat(hot, 400 + int(5 * load))])
    s = sketch(spark, every, width)
    assert s.is_hot(hot).all()
    assert s.is_hot(single[:200_000]).mean() < 0.001


def test_counts_of_parts_add_up(spark, monkeypatch):
    rng = np.random.default_rng(5)
    every = keys(500)[rng.integers(0, 500, 30_000)]
    for parts in (1, 7):
        s = sketch(spark, every, 20, parts)
        assert s.repeated(keys(500)).all() and not s.is_hot(keys(500)).any()
    assert not sketch(spark, every[:0], 20).repeated(keys(10)).any()
