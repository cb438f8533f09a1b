import random
import re

import numpy as np
from llm_frames import frame
from pyspark.sql import functions as F
from test_dedup import components

import __spark_entry__
import corpus_pipeline
from quarry.llm import mixing, quality, token_io

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_pipeline_equals_stages_by_hand(spark, tmp_path):
    rng = random.Random(12)
    good = lambda n: " ".join(rng.choice(["the", "of", "river", "stone", "walked", "evening.", "and", "tree", "cloud"]) + rng.choice("abcdefg") for _ in range(n))
    bad = lambda n: " ".join(rng.choice(["BUY!!", "NOW!!", "CLICK!!"]) for _ in range(n))
    items = [(i, good(30)) for i in range(3)]
    rows = [(i, bad(60) if i % 5 == 0 else good(rng.randint(20, 120))) for i in range(150)]
    rows += [(200 + i, rows[i + 1][1] + (" more" if i % 2 else "")) for i in range(10)]
    rows += [(300 + i, good(20) + " " + t.upper() + " " + good(20)) for i, t in items]
    rows += [(400, None), (401, "")]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(d, 0 if d % 5 == 0 else 1, 0) for d, _ in rows[:150]], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    # each stage by hand, on what its predecessor keeps
    net = quality.fit(docs, labels)
    kept = [(d, t) for d, t in rows if net.scores([(t or "").encode()])[0] >= 0.5]
    assert not any(d < 150 and d % 5 == 0 for d, _ in kept) and sum(d < 150 for d, _ in kept) == 120
    root = components(kept)
    kept = [(d, t) for d, t in kept if root[d][1] == d]
    fold = lambda s: re.sub("[^0-9a-z]+", " ", (s or "").lower())
    kept = [(d, t) for d, t in kept if not any(fold(b) in fold(t) for _, b in items)]
    assert not any(200 <= d < 310 for d, _ in kept)
    chosen = docs.where(F.col("doc_id").isin([d for d, _ in kept]))
    taken = {r.doc_id: (r["size"], r.taken) for r in mixing.mix(chosen).collect()}
    want = sorted(d for d, (size, n) in taken.items() if size for _ in range(-(-n // size)))

    out = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert sorted(r.doc_id for r in out) == want
    enc = token_io.encoder(token_io.default_tokenizer())
    whole = {d: int(enc.library([t]).sizes[0]) + 1 for d, t in kept if t}
    assert all(r.n_tokens <= whole[r.doc_id] for r in out)
    assert sum(r.n_tokens == whole[r.doc_id] for r in out) >= len(out) - 4
    by_start = sorted(out, key=lambda r: r.start)
    assert [r.doc_id for r in by_start] == want
    assert np.array_equal(np.cumsum([0, *[r.n_tokens for r in by_start]])[:-1], [r.start for r in by_start])


def test_stages_are_registered():
    assert [n for n, _ in corpus_pipeline.STAGES][1] == "n-gram Jaccard join" and len(corpus_pipeline.STAGES) == 5
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
