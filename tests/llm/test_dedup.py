import hashlib
import random
import re

import numpy as np
import pytest
from llm_frames import frame
from pyspark.sql import functions as F

from quarry.llm import jaccard, substring_dedup, suffix_dedup
from quarry.llm.common import discard, stash
from quarry.llm.runlength_index import RunIndex

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def kept_bytes(rows, size):
    texts = {d: (t or "").encode() for d, t in rows}
    count = {}
    for t in texts.values():
        for i in range(len(t) - size + 1):
            count[t[i : i + size]] = count.get(t[i : i + size], 0) + 1
    out = {}
    for d, t in texts.items():
        step = np.zeros(len(t) + 1, int)
        for i in range(len(t) - size + 1):
            if count[t[i : i + size]] > 1:
                step[i] += 1
                step[i + size] -= 1
        gone = np.cumsum(step[:-1]) > 0
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(len(gone) > 0 and gone[0])
        out[d] = (len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def kept_words(rows, size):
    words = {d: WORD.findall(t or "") for d, t in rows}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - size + 1):
            first.setdefault(tuple(words[d][i : i + size]), d)
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < d:
                gone[i : i + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def components(rows):
    sets = {}
    for d, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + 3]) for i in range(len(w) - 2)} or ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= 90 * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def as_dict(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_suffix_dedup_equals_brute_force(spark, mixed):
    assert as_dict(suffix_dedup.digest(frame(spark, mixed))) == kept_bytes(mixed, 200)


def test_substring_dedup_equals_brute_force(spark, mixed):
    assert as_dict(substring_dedup.digest(frame(spark, mixed))) == kept_words(mixed, 13)


def test_hot_anchors_take_another_way_with_equal_results(spark, mixed, monkeypatch):
    monkeypatch.setattr("quarry.llm.count_min.HOT", 3)
    rows = mixed[:60]
    assert as_dict(suffix_dedup.digest(frame(spark, rows))) == kept_bytes(rows, 200)
    assert as_dict(substring_dedup.digest(frame(spark, rows))) == kept_words(rows, 13)


def test_kept_text_is_returned(spark):
    p = " ".join(f"p{i}" for i in range(13))
    out = {r.doc_id: r.kept for r in substring_dedup.dedup(frame(spark, [(1, "a " + p), (2, p + " b")])).collect()}
    assert out == {1: "a " + p, 2: "b"}


def test_jaccard_classes_equal_brute_force(spark, mixed):
    rng = random.Random(2)
    rows = [(i, t) for i, (_, t) in enumerate(mixed[:40])]
    for base_words in (1, 2, 3, 9, 12, 20, 60, 200):
        base = [f"v{rng.randrange(500)}" for _ in range(base_words)]
        for _ in range(6):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, base_words // 25])):
                w[rng.randrange(len(w))] = f"v{rng.randrange(500)}"
            t = " ".join(w)
            rows.append((len(rows), t.upper() if rng.random() < 0.2 else t))
    rows += [(len(rows), None), (len(rows) + 1, "")]
    assert as_dict(jaccard.classes(frame(spark, rows))) == components(rows)


def test_representatives_keep_columns_and_one_of_each_group(spark):
    t = " ".join(f"u{i}" for i in range(50))
    out = jaccard.representatives(frame(spark, [(5, t), (3, t), (9, t + " more"), (1, "else where"), (7, None)]))
    assert out.columns == frame(spark, [(1, "a")]).columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 3, 7]


@pytest.mark.parametrize("bits", [15, 26])
def test_texts_of_told_documents_are_not_shuffled(spark, monkeypatch, bits):
    """Bitmaps tell which documents stay; those whose cells collide are told exactly."""
    monkeypatch.setattr(jaccard, "KEPT_BITS", bits)
    n = 20_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("a text").alias("text")).unionByName(frame(spark, [(None, "x"), (5, "again"), (6, "again")]).select("doc_id", "text"))
    found = spark.range(n).select(F.col("id").alias("doc"), (F.col("id") % 3 == 0).alias("first"))
    kept = sorted((r.doc_id is None, r.doc_id) for r in jaccard._kept(docs, found).collect())
    assert kept == sorted([*((False, i) for i in range(0, n, 3)), (False, 6), (True, None)])
    unsure = jaccard._judged(docs, found).where("__q_gone AND __q_stays").count()
    assert unsure < n / 100 if bits == 26 else unsure > 0


def test_few_documents_have_small_bitmaps(spark, monkeypatch):
    """A broadcast stands in the driver several times over: it follows the documents."""
    made, plain = [], jaccard._bitmap
    monkeypatch.setattr(jaccard, "_bitmap", lambda docs, bits: made.append(plain(docs, bits)) or made[-1])
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("a text").alias("text"))
    found = spark.range(500).select(F.col("id").alias("doc"), (F.col("id") % 3 == 0).alias("first"))
    assert jaccard._kept(docs, found).count() == 167
    assert jaccard._texts(docs, found.where("first").select("doc")).count() >= 167
    assert len(made) == 3 and all(m.agg(F.sum(F.length("bits"))).first()[0] <= 1 << 13 for m in made)


def test_null_and_repeated_ids_and_empty_tables(spark):
    t = "z" * 400
    rows = [(None, t), (1, t), (1, t), (2, "short"), (2, t)]
    assert suffix_dedup.digest(frame(spark, rows)).count() == 5
    assert substring_dedup.digest(frame(spark, rows)).count() == 5
    assert jaccard.classes(frame(spark, rows)).count() == 5
    none = frame(spark, rows).where(F.lit(False))
    for f in (suffix_dedup.digest, substring_dedup.digest, jaccard.classes):
        assert f(none).count() == 0


def test_run_index_statistics_equal_brute_force():
    rng = random.Random(1)
    for _ in range(40):
        strings = [bytes(rng.choice(b"ab\0c" if rng.random() < 0.9 else b"xyz") for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 8))]
        group = np.array([rng.randint(0, 2) for _ in strings])
        x = RunIndex(strings, group)
        got = x.statistics()
        suffixes = [(g, s[i:], int(x.start[k]) + i) for k, (s, g) in enumerate(zip(strings, group, strict=True)) for i in range(len(s))]
        for g, s, at in suffixes:
            best = 0
            for h, u, other in suffixes:
                if h == g and other != at:
                    n = 0
                    while n < min(len(s), len(u)) and s[n] == u[n]:
                        n += 1
                    best = max(best, n)
            assert got[at] == best
        assert x.runs <= x.n


def test_index_entries_are_shuffled_in_bundles():
    """Bundles give the entries back, in less than 12 bytes for each; the documents of one bucket stay together."""
    rng = np.random.default_rng(5)
    n = 200_000
    doc = np.sort(rng.integers(0, 1500, n)) * 977 - 5
    g = rng.integers(0, 1 << jaccard.KEY_BITS, n).astype(np.uint64)
    at = (doc + 5) // 977 % 900 + 100 << 32 | rng.integers(0, 900, n)
    batches = list(jaccard._bundles([(g[:90_000], doc[:90_000], at[:90_000]), (g[90_000:], doc[90_000:], at[90_000:])], 40))
    assert sum(b.column("z").nbytes for b in batches) < 12 * n
    back = [np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in jaccard._unbundled(iter(batches))]) for c in ("g", "doc", "at")]
    assert sorted(zip(*(x.tolist() for x in back), strict=True)) == sorted(zip(g.tolist(), doc.tolist(), at.tolist(), strict=True))
    assert sum(b.num_rows for b in batches) == 40
    # sets of one document that differ in size (rows that share a doc_id)
    odd = [(g[:3], np.array([7, 7, 7]), np.array([3 << 32, 4 << 32 | 1, 3 << 32 | 2]))]
    (one,) = jaccard._unbundled(jaccard._bundles(odd, 1))
    assert sorted(one.column("at").to_pylist()) == [3 << 32, 3 << 32 | 2, 4 << 32 | 1]
    assert list(jaccard._bundles([], 4)) == []


def test_shuffle_files_go_with_the_write(spark):
    def kept():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))

    before = kept()
    out = stash(spark.range(1000).repartition(5, "id").groupBy((F.col("id") % 7).alias("k")).count(), "freed")
    assert kept() <= before and out.count() == 7
    discard(out)
