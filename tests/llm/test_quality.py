import random

import numpy as np
import pytest

from quarry.llm import quality


def plain_score(net, text):
    """The network by loops."""
    positions = max(1, -(-len(text) // quality.STRIDE))
    padded = text + bytes(64)
    z = [[sum(float(net.filters[j][padded[p * quality.STRIDE + j]][f]) for j in range(quality.WIDTH)) for f in range(quality.FILTERS)] for p in range(positions)]
    chunks, lo = [], 0
    while True:
        chunks.append([np.tanh(max(z[p][f] for p in range(lo, min(lo + quality.CHUNK, positions))) + net.bias[f]) for f in range(quality.FILTERS)])
        if lo + quality.CHUNK >= positions:
            break
        lo += quality.HOP
    mean = [sum(c[f] for c in chunks) / len(chunks) for f in range(quality.FILTERS)]
    most = [max(c[f] for c in chunks) for f in range(quality.FILTERS)]
    return 1 / (1 + np.exp(-(np.dot(mean + most, net.out) + net.offset)))


def test_forward_pass_equals_loops():
    rng = random.Random(3)
    net = quality.Network.start(5)
    net.offset, net.bias = 0.3, np.linspace(-1, 1, quality.FILTERS).astype(np.float32)
    texts = [bytes(rng.randrange(1, 256) for _ in range(n)) for n in (0, 1, 2, 7, 300, 511, 512, 513, 514, 961, 2300)]
    assert net.scores(texts) == pytest.approx([plain_score(net, t) for t in texts], abs=1e-5)


def test_gradient_equals_differences():
    rng = random.Random(4)
    net = quality.Network.start(6)
    net.filters, net.bias, net.out = (x.astype(np.float64) for x in (net.filters, net.bias, net.out))
    texts = [bytes(rng.randrange(97, 107) for _ in range(n)) for n in (3, 400, 1500, 3000)]
    data, room = zip(*(quality.chunks_of(t) for t in texts), strict=True)
    labels, weight = np.array([1.0, 0.0, 1.0, 0.0]), np.array([1.0, 0.7, 1.0, 0.7])
    loss = lambda: quality.gradients(net, list(data), list(room), labels, weight)[0]
    grads = quality.gradients(net, list(data), list(room), labels, weight)[1]
    for param, grad in zip((net.filters, net.bias, net.out), grads, strict=False):
        for _ in range(12):
            at = tuple(rng.randrange(k) if k != 256 else rng.randrange(97, 107) for k in param.shape)
            was = param[at]
            param[at] = was + 1e-6
            up = loss()
            param[at] = was - 1e-6
            down = loss()
            param[at] = was
            assert grad[at] == pytest.approx((up - down) / 2e-6, rel=1e-3, abs=1e-7)


def test_training_takes_whole_texts():
    """Only the end of long texts tells them apart."""
    rng = random.Random(9)
    text = lambda end: b"".join(rng.choice([b"abc ", b"de "]) for _ in range(2000)) + end
    texts = [text(b"### ###" if i % 2 else b"xy xyzz") for i in range(60)]
    labels = np.array([float(i % 2) for i in range(60)])
    net = quality.train(texts, labels)
    assert ((net.scores(texts) >= 0.5) == (labels > 0)).mean() > 0.9


def test_long_texts_in_blocks_equal_one_pass(monkeypatch):
    rng = np.random.default_rng(5)
    net = quality.Network.start(5)
    texts = [rng.integers(1, 256, n, dtype=np.uint8).tobytes() for n in (1, 449, 512, 513, 5000, 100_001, 250_000)]
    whole = net.scores(texts)
    monkeypatch.setattr(quality, "HELD", 7)
    monkeypatch.setattr(quality, "LONG", 448)
    assert net.scores(texts) == pytest.approx(whole, abs=1e-6)


def test_a_text_scores_alike_at_every_place_of_a_batch():
    rng = random.Random(8)
    net = quality.Network.start(5)
    text = bytes(rng.randrange(256) for _ in range(900))
    rest = [bytes(rng.randrange(256) for _ in range(rng.randrange(400))) for _ in range(37)]
    found = {float(net.scores([*rest[:i], text, *rest[i : i + j]])[i]) for i in range(9) for j in range(9)}
    assert len(found) == 1


def test_memory_of_a_long_text_is_bounded():
    import tracemalloc

    net, text = quality.Network.start(5), b"some words " * 3_000_000
    tracemalloc.start()
    net.scores([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20 < 97 * len(text)


def test_an_oversize_labelled_text_changes_nothing_else(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["good", "fine"] if i % 2 else ["###", "xx"]) for _ in range(40))) for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(140)] + [(3, 1, 0)], "doc_id long, quality int, toxic int")
    docs = lambda more=(): spark.createDataFrame([*rows, *more], "doc_id long, text string")
    plain = quality.fit(docs(), labels, size=40_000)
    for big in range(120, 140):
        net = quality.fit(docs([(big, "y" * 50_000)] * 2), labels, size=40_000)
        assert np.array_equal(net.filters, plain.filters) and np.array_equal(net.out, plain.out)
        if big > 123:
            break
    assert quality.fit(docs([(rows[0][0], "z")] * 3), labels, rows=50) is not None


def test_held_out_accuracy_on_supplied_rows(spark):
    """Learned from the other rows, the network tells the held-out ones apart."""
    data = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    got = quality.digest(docs, labels).where("held_out").join(labels.where("quality is not null"), "doc_id").select("predicted", "quality").collect()
    accuracy = sum(r.predicted == r.quality for r in got) / len(got)
    print(f"held-out accuracy {accuracy:.3f} of {len(got)}")
    assert len(got) > 50 and accuracy > 0.8
