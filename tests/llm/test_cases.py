"""Nulls in any column, repeated rows, empty and long texts, empty tables, clashing columns."""

import hashlib
import random
import zlib

import pytest
from llm_frames import SCHEMA, frame
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import decontam, fingerprint, jaccard, license_scan, mixing, pii, quality, substring_dedup, suffix_dedup, token_io

BENCH = [(1, "the quick brown fox jumps over the lazy dog near the river bank"), (None, "x y z"), (2, None)]
LABELS = [(i, int(i % 2), 0) for i in range(40)] + [(None, 1, 0), (3, None, None)]


def strange(spark):
    """Rows (doc_id, text): null ids, a row three times, empties, a long text."""
    rng = random.Random(2)
    word = lambda: rng.choice(["river", "stone", "cloud", "the", "a", "of", "tree", "mail"])
    text = lambda n: " ".join(word() for _ in range(n))
    same = text(80)
    rows = [(i, text(rng.randint(1, 120))) for i in range(30)]
    rows += [(None, text(30)), (None, None), (None, ""), (50, same), (50, same), (50, same), (51, same), (52, ""), (53, None), (54, " \n\t "), (55, text(60_000)), (56, "x" * 300_000), (57, BENCH[0][1].upper())]
    return rows


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame(BENCH, "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def test_row_by_row_operators_give_a_row_for_each(spark, labels):
    rows = strange(spark)
    docs = frame(spark, rows)
    for f in (pii.digest, license_scan.digest, token_io.round_trip, mixing.mix, fingerprint.fingerprints, lambda d: quality.digest(d, labels)):
        got = f(docs).collect()
        assert len(got) == len(rows)
        assert sorted(str(r.doc_id) for r in got) == sorted(str(d) for d, _ in rows)
        same = [tuple(r) for r in got if r.doc_id == 50]
        assert len(same) == 3


def test_repeated_rows_have_equal_results(spark, labels):
    docs = frame(spark, strange(spark))
    for f in (pii.digest, license_scan.digest, lambda d: quality.digest(d, labels), lambda d: fingerprint.fingerprints(d).select("doc_id", "n_chars", "fingerprint")):
        assert len({tuple(r) for r in f(docs).where("doc_id = 50").collect()}) == 1
    ids = token_io.round_trip(docs).where("doc_id = 50").collect()
    assert len({r.ids_crc32 for r in ids}) == 1 and len({r.start for r in ids}) == 3


def test_whole_long_texts_are_read(spark, labels):
    rows = dict(r for r in strange(spark) if r[0] in (55, 56))
    docs = frame(spark, list(rows.items()))
    tail = frame(spark, [(d, t + " mail me@long.example.org under the mit license") for d, t in rows.items()])
    assert [r.n_email for r in pii.digest(tail).collect()] == [1, 1] and [r.n_email for r in pii.digest(docs).collect()] == [0, 0]
    assert {r.base_labels for r in license_scan.digest(tail).collect()} == {"mit"}
    assert {r.doc_id: r.n_shingles for r in jaccard.classes(docs).collect()}[56] == 1
    got = {r.doc_id: r.n_tokens for r in token_io.round_trip(docs).collect()}
    more = {r.doc_id: r.n_tokens for r in token_io.round_trip(tail).collect()}
    assert all(more[d] > got[d] for d in rows)
    scores = [{r.doc_id: r.score for r in quality.score(x, quality.Network.start()).collect()} for x in (docs, tail)]
    assert all(scores[0][d] != scores[1][d] for d in rows)
    a, b = ({r.doc_id: r.fingerprint for r in fingerprint.fingerprints(x).collect()} for x in (docs, tail))
    assert a[56] != b[56]


def test_decontamination_of_strange_rows(spark, benchmark):
    rows = strange(spark) + [(None, "and " + BENCH[0][1])]
    got = decontam.matches(frame(spark, rows), benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(57, 1), (None, 1)}
    clean = decontam.clean(frame(spark, rows), benchmark)
    assert clean.count() == len(rows) - 2 and clean.columns == frame(spark, rows).columns


def test_empty_tables_give_empty_results(spark, benchmark, labels):
    none = spark.createDataFrame([], SCHEMA)
    for f in (pii.digest, suffix_dedup.digest, substring_dedup.digest, lambda d: quality.digest(d, labels), mixing.mix, license_scan.digest, lambda d: decontam.matches(d, benchmark), jaccard.classes, token_io.round_trip, fingerprint.fingerprints):
        assert f(none).count() == 0


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, benchmark, labels):
    at = str(tmp_path_factory.mktemp("tables"))
    benchmark.write.parquet(f"{at}/benchmark.parquet")
    labels.write.parquet(f"{at}/labels.parquet")
    return at


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_stages_take_strange_rows_and_empty_tables(spark, folder, stage):
    f = dict(corpus_pipeline.STAGES)[stage]
    docs = frame(spark, strange(spark))
    got = f(spark, docs, folder)
    if stage != corpus_pipeline.STAGES[-1][0]:
        assert got.columns == docs.columns and [x.dataType for x in got.schema] == [x.dataType for x in docs.schema]
    rows = got.collect()
    empty = f(spark, spark.createDataFrame([], SCHEMA), folder)
    assert empty.count() == 0 and empty.columns == got.columns
    if stage == "n-gram Jaccard join":
        ids = [r.doc_id for r in rows]
        assert ids.count(50) == 3 and 51 not in ids and ids.count(None) == 3 and 52 in ids and 53 in ids
    if stage == "benchmark decontamination":
        assert 57 not in [r.doc_id for r in rows] and len(rows) == len(strange(spark)) - 1
    if stage == "mixing sources":
        assert {r.doc_id for r in rows} <= {d for d, t in strange(spark) if t and t.split()}
    if stage == "token ids":
        assert len(rows) == len(strange(spark))


def test_texts_with_special_characters(spark):
    rows = [(1, "\x00a\x00b"), (2, "\ufffd\u2028line"), (3, "e\u0301 \U0001f600" * 50)]
    docs = frame(spark, rows)
    got = {r.doc_id: r for r in suffix_dedup.digest(docs).collect()}
    assert {d: got[d].n_bytes for d, _ in rows} == {d: len(t.encode()) for d, t in rows}
    assert got[1].kept_sha256 == hashlib.sha256(rows[0][1].encode()).hexdigest()
    held = {r.doc_id: r.held_out for r in quality.digest(docs, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")).collect()}
    assert held == {d: zlib.crc32(str(d).encode()) % 3 == 1 for d, _ in rows}
    assert fingerprint.fingerprints(docs).where(F.col("n_chars") > 0).count() == 3
