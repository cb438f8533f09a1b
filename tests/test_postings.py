"""The stored index against search over the documents themselves, and what it reads."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import postings, search
from quarry.operators.postings import InvertedIndex

WORDS = [f"word{i}" for i in range(60)] + ["Über", "née", "漢字", "running", "runs"]
WEIGHTS = {"title": 2.0, "text": 1.0}


def rows(n, seed=1, start=0):
    rng = random.Random(seed)
    pick = lambda k: " ".join(rng.choice(WORDS[: rng.choice([3, 20, 65])]) for _ in range(k))
    return [(start + i, pick(rng.randint(0, 3)), rng.choice([None, "", pick(rng.randint(1, 80)), pick(5) + "!"])) for i in range(n)]


def frame(spark, data):
    return spark.createDataFrame(data, "id long, title string, text string").repartition(3)


def pairs(df):
    return {r.id: r.score for r in df.collect()}


def same(index, data, query, stem=False):
    want = pairs(search.bm25(data, "id", query, WEIGHTS, stem=stem))
    got = pairs(index.scores(query))
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 3e-6 for k in want)
    best = sorted(want.items(), key=lambda x: (-x[1], x[0]))[:7]
    top = [(r.id, r.score, r["rank"]) for r in index.top(query, 7).orderBy("rank").collect()]
    assert [t[2] for t in top] == list(range(1, len(best) + 1))
    assert [round(t[1], 4) for t in top] == [round(b[1], 4) for b in best]


@pytest.mark.parametrize("stem", [False, True])
def test_equals_search_over_the_documents(spark, tmp_path, monkeypatch, stem):
    monkeypatch.setattr(postings, "SLICE_DOCS", 16)
    data = frame(spark, rows(400))
    index = InvertedIndex(spark, str(tmp_path / "i")).create(data, "id", WEIGHTS, stem)
    for q in ("word1", "word2 word50 WORD2", "uber née", "run 漢字 absent"):
        same(index, data, q, stem)
    for q in ("absent", "", "!?"):
        assert index.scores(q).count() == 0 and index.top(q).count() == 0


def test_appending_replacing_deleting_and_merging(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "SLICE_DOCS", 16)
    one, two, three = rows(120), rows(90, 2, 100), rows(30, 3, 300)
    index = InvertedIndex(spark, str(tmp_path / "i")).create(frame(spark, one), "id", WEIGHTS)
    index.append(frame(spark, two))
    now = [r for r in one if r[0] < 100] + two
    same(index, frame(spark, now), "word1 word40")
    index.append(frame(spark, three))
    index.delete(spark.createDataFrame([(5,), (105,), (301,), (999,)], "id long"))
    now = [r for r in now + three if r[0] not in (5, 105, 301)]
    same(index, frame(spark, now), "word1 word40 word3")
    assert len(index.meta().segments) == 3 and index.vacuum() == []
    index.merge()
    assert len(index.meta().segments) == 1 and index.meta().segments[0].docs == len(now)
    same(index, frame(spark, now), "word1 word40 word3")
    assert len(index.vacuum()) >= 4
    same(index, frame(spark, now), "word2")


def test_only_partitions_of_the_words_are_read(spark, tmp_path):
    index = InvertedIndex(spark, str(tmp_path / "i")).create(frame(spark, rows(300)), "id", WEIGHTS)
    plan = index.scores("word7")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    read = index._read(index.meta(), ["word7"]).select(F.input_file_name().alias("f")).distinct().collect()
    bucket = {r.f.split("bucket=")[1].split("/")[0] for r in read}
    assert len(bucket) == 1
    heads = index.bounds("word7")._jdf.queryExecution().executedPlan().toString()
    assert "max_tf" in heads and "docs" not in heads.split("ReadSchema")[-1]


def test_blocks_that_cannot_reach_the_top_are_not_scored(spark, tmp_path, monkeypatch):
    """Short texts with a word often beat long ones with it once, by the heads alone."""
    monkeypatch.setattr(postings, "SLICE_DOCS", 8)
    data = [(i, "", ("ship " * 6 if i < 40 else "ship " + "water " * (20 + i % 400))) for i in range(900)]
    index = InvertedIndex(spark, str(tmp_path / "i")).create(frame(spark, data), "id", WEIGHTS)
    bounds = [r.bound for r in index.bounds("ship").collect()]
    top = index.top("ship", 10).collect()
    least = min(r.score for r in top)
    assert sum(b >= least - postings.SLACK for b in bounds) < len(bounds) / 5
    assert sorted(r.id for r in top) == list(range(10))
    allowed = spark.createDataFrame([(i,) for i in range(300, 320)], "id long")
    assert {r.id for r in index.top("ship", 5, allowed).collect()} <= set(range(300, 320))


def test_bounds_hold_for_every_document(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "SLICE_DOCS", 8)
    index = InvertedIndex(spark, str(tmp_path / "i")).create(frame(spark, rows(200)), "id", WEIGHTS)
    index.append(frame(spark, rows(50, 4, 1000)))
    q = "word1 word9 word30"
    bound = {(r["name"], r["slice"]): r.bound for r in index.bounds(q).collect()}
    where = index._read(index.meta(), index.words_of(q)).select("name", "slice", F.explode("docs.doc").alias("id")).distinct()
    for r in where.join(index.scores(q), "id").collect():
        assert r.score <= bound[r["name"], r["slice"]] + postings.SLACK


def test_repeated_keys_are_refused_and_null_keys_ignored(spark, tmp_path):
    index = InvertedIndex(spark, str(tmp_path / "i"))
    with pytest.raises(ValueError, match="repeat"):
        index.create(frame(spark, [(1, "a", "b"), (1, "c", "d")]), "id", WEIGHTS)
    index.create(frame(spark, [(1, "a", "b"), (None, "c", "d"), (None, "c", "d")]), "id", WEIGHTS)
    assert index.scores("c").count() == 0 and index.meta().segments[0].docs == 1
    empty = InvertedIndex(spark, str(tmp_path / "e")).create(frame(spark, [(1, "a", "b")]).limit(0), "id", WEIGHTS)
    assert empty.top("a").count() == 0
    empty.append(frame(spark, [(7, "a", None)]))
    assert [r.id for r in empty.top("a").collect()] == [7]


def test_postings_are_shuffled_once_and_as_lists(spark, tmp_path, monkeypatch):
    """Words are counted where their document lies, and a token's postings travel together."""
    made, plain = [], InvertedIndex._write
    monkeypatch.setattr(InvertedIndex, "_write", lambda self, meta, lengths, lists: plain(self, meta, lengths, lambda shape: made.append(lists(shape)) or made[-1]))
    index = InvertedIndex(spark, str(tmp_path / "i")).create(frame(spark, rows(200)), "id", WEIGHTS)
    index.append(frame(spark, rows(200, 2, 1000)))
    index.merge()
    for lists in made:
        assert "hashpartitioning" not in lists._jdf.queryExecution().executedPlan().toString()
        assert lists.count() <= 3 * 2 * len(WORDS) < lists.select(F.explode("doc")).count()


def test_a_tokens_documents_over_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "SLICE_DOCS", 4)
    monkeypatch.setattr(postings, "SPREAD_DOCS", 40)
    index = InvertedIndex(spark, str(tmp_path / "i")).create(frame(spark, rows(150)), "id", WEIGHTS)
    index.append(frame(spark, rows(90, 2, 1000)))
    index.merge()
    same(index, frame(spark, rows(150) + rows(90, 2, 1000)), "word1 word40 word3")
    heads = index._read(index.meta(), None)
    assert heads.count() == heads.select("token", "slice").distinct().count()
    assert heads.where("n <> size(docs) OR docs <> sort_array(docs)").count() == 0


def test_a_task_writes_a_share_of_one_partition(spark, tmp_path, monkeypatch):
    """More words are more tasks, and none takes several partitions while another has none."""
    monkeypatch.setattr(postings, "TASK_WORDS", 200, raising=False)
    data = frame(spark, rows(400))
    index = InvertedIndex(spark, str(tmp_path / "i")).create(data, "id", WEIGHTS)
    read = index._read(index.meta(), None).select("token", F.regexp_extract(F.input_file_name(), "part-([0-9]+)", 1).alias("task"), "bucket").distinct()
    tasks = read.groupBy("task").agg(F.countDistinct("bucket").alias("buckets"), F.countDistinct("token").alias("tokens")).collect()
    assert max(t.buckets for t in tasks) == 1 and len(tasks) > postings.BUCKETS[0] and max(t.tokens for t in tasks) <= 8
    assert read.count() == read.select("token").distinct().count()
    same(index, data, "word1 word40")
