"""A byte-level convolutional network in numpy that scores text quality.

Filters of WIDTH bytes run over the whole document at every second byte. Overlapping
chunks (CHUNK positions, a new one every HOP) keep each filter's maximum; the chunks'
maxima are averaged and maximised over the document and combined into one probability.
Weights are learned by back-propagation (the gradient of a maximum goes to the place
that reached it) on a bounded sample of labelled documents: in hash order, at most
TRAIN_ROWS that together hold at most TRAIN_BYTES. Training and scoring cover whole texts,
long ones in blocks of chunks.

Defined cases: a null or empty text is scored as one empty chunk; without any usable
label the score is 0.5 everywhere; a doc_id labelled twice counts twice, with each
label; of several texts of one labelled doc_id one is an example; a text that no longer fits
into the training sample is passed over, and those behind it are not; repeated documents get
equal scores; an empty table gives an empty result;
score() keeps all other columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quarry.llm.common import as_bytes, bound_batches, discard, passes, stash, tidy

FILTERS, WIDTH, STRIDE = 24, 7, 2
CHUNK, HOP = 256, 224  # positions, each STRIDE bytes
GAP = 8
#: Bounds of the training sample of labelled documents; all documents are scored.
TRAIN_ROWS, TRAIN_BYTES = 1600, 32 << 20
#: chunks whose filters' responses are held at once
HELD = 1024
EPOCHS, BATCH, RATE, DECAY = 14, 40, 0.02, 1e-4
PASS = 1 << 17
#: A text of more bytes is scored by itself, HELD chunks at a time.
LONG = 1 << 20


def chunk_count(size: int) -> int:
    positions = max(1, -(-size // STRIDE))
    return max(1, -(-(positions - (CHUNK - HOP)) // HOP))


class Network:
    def __init__(self, filters: np.ndarray, bias: np.ndarray, out: np.ndarray, offset: float):
        """filters: WIDTH x 256 x FILTERS; out: weights of the mean and of the maximum."""
        self.filters, self.bias, self.out, self.offset = filters, bias, out, offset

    @classmethod
    def start(cls, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        filters = rng.normal(0, 0.15, (WIDTH, 256, FILTERS)).astype(np.float32)
        return cls(filters, np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32), 0.0)

    def responses(self, buf: np.ndarray, positions: int) -> np.ndarray:
        z = self.filters[0][buf[0 : positions * STRIDE : STRIDE]]
        for j in range(1, WIDTH):
            z += self.filters[j][buf[j : j + positions * STRIDE : STRIDE]]
        return z

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """The probability of each whole text."""
        feature = np.zeros((len(texts), 2 * FILTERS), np.float32)
        short = [i for i, t in enumerate(texts) if len(t) <= LONG]
        if short:
            feature[short] = self._features([texts[i] for i in short])
        for i, t in enumerate(texts):
            if len(t) > LONG:
                feature[i] = self._feature_of_long(t)
        # row by row: a product of matrices rounds a row by its place in the batch
        logit = (feature.astype(np.float64) * self.out).sum(axis=1) + self.offset
        return 1 / (1 + np.exp(-logit))

    def _feature_of_long(self, text: bytes) -> np.ndarray:
        spans, chunks = -(-len(text) // STRIDE), chunk_count(len(text))
        total, most = np.zeros(FILTERS), np.full(FILTERS, -np.inf, np.float32)
        for k in range(0, chunks, HELD):
            n = min(HELD, chunks - k)
            begin, end = k * HOP, min((k + n - 1) * HOP + CHUNK, spans)
            part = np.frombuffer(text[begin * STRIDE : end * STRIDE + WIDTH].ljust((end - begin + 1) * STRIDE + WIDTH, b"\0"), dtype=np.uint8)
            z = self.responses(part, end - begin + 1)
            lo = np.arange(n) * HOP
            hi = np.minimum(lo + CHUNK, end - begin)
            top = np.tanh(np.maximum.reduceat(z, np.stack([lo, hi], axis=1).ravel(), axis=0)[::2] + self.bias)
            total += top.sum(axis=0)
            most = np.maximum(most, top.max(axis=0))
        return np.concatenate([total / chunks, most])

    def _features(self, texts: list[bytes]) -> np.ndarray:
        """Mean and maximum of the chunks' maxima, of each text."""
        padded = b"".join([t + b"\0" * (GAP + len(t) % STRIDE) for t in texts]) + b"\0" * (2 * GAP)
        buf = np.frombuffer(padded, dtype=np.uint8)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes + GAP + sizes % STRIDE)]) // STRIDE
        z = self.responses(buf, int(starts[-1]) + 1)
        spans = np.maximum(1, -(-sizes // STRIDE))
        chunks = np.maximum(1, -(-(spans - (CHUNK - HOP)) // HOP))
        text = np.repeat(np.arange(len(texts)), chunks)
        first = np.cumsum(chunks) - chunks
        lo = starts[text] + (np.arange(len(text)) - first[text]) * HOP
        hi = np.minimum(lo + CHUNK, starts[text] + spans[text])
        top = np.tanh(np.maximum.reduceat(z, np.stack([lo, hi], axis=1).ravel(), axis=0)[::2] + self.bias)
        mean = np.add.reduceat(top, first, axis=0) / chunks[:, None]
        most = np.maximum.reduceat(top, first, axis=0)
        return np.concatenate([mean, most], axis=1)


def chunks_of(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All chunks of a text, CHUNK * STRIDE + WIDTH bytes each, and the positions in them."""
    n, size = chunk_count(len(text)), CHUNK * STRIDE + WIDTH
    buf = np.frombuffer(text.ljust((n - 1) * HOP * STRIDE + size, b"\0"), dtype=np.uint8)
    data = np.stack([buf[k * HOP * STRIDE :][:size] for k in range(n)])
    left = np.maximum(1, -(-len(text) // STRIDE)) - np.arange(n) * HOP
    return data, np.minimum(left, CHUNK)


def gradients(net: Network, data: list[np.ndarray], room: list[np.ndarray], labels: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """The weighted mean loss of some documents, and its gradient by filters, bias, out and
    offset."""
    x, rest = np.concatenate(data), np.concatenate(room)
    n = np.array([len(d) for d in data])
    first = np.cumsum(n) - n
    text = np.repeat(np.arange(len(data)), n)
    at = np.empty((len(x), FILTERS), dtype=np.int64)
    top = np.empty((len(x), FILTERS), dtype=net.filters.dtype)
    for i in range(0, len(x), HELD):
        part = x[i : i + HELD]
        z = net.filters[0][part[:, 0 : CHUNK * STRIDE : STRIDE]]
        for j in range(1, WIDTH):
            z += net.filters[j][part[:, j : j + CHUNK * STRIDE : STRIDE]]
        z[np.arange(CHUNK)[None, :] >= rest[i : i + HELD, None]] = -1e9
        at[i : i + HELD] = z.argmax(axis=1)
        top[i : i + HELD] = np.take_along_axis(z, at[i : i + HELD, None, :], axis=1)[:, 0]
    top = np.tanh(top + net.bias)
    mean = np.add.reduceat(top, first, axis=0) / n[:, None]
    most = np.maximum.reduceat(top, first, axis=0)
    feature = np.concatenate([mean, most], axis=1)
    logit = feature @ net.out + net.offset
    p = 1 / (1 + np.exp(-logit))
    loss = float(np.mean(weight * (np.logaddexp(0, logit) - labels * logit)))
    d = ((p - labels) * weight / len(data)).astype(net.filters.dtype)
    d_feature = d[:, None] * net.out[None, :]
    # of equal maxima the first chunk takes the gradient
    is_top = np.where(top == most[text], np.arange(len(x))[:, None], len(x))
    is_top = is_top == np.minimum.reduceat(is_top, first, axis=0)[text]
    d_top = (d_feature[:, :FILTERS] / n[:, None])[text] + np.where(is_top, d_feature[:, FILTERS:][text], 0)
    d_z = d_top * (1 - top * top)
    g_filters = np.zeros_like(net.filters)
    cols, rows = np.broadcast_to(np.arange(FILTERS), at.shape), np.arange(len(x))[:, None]
    for j in range(WIDTH):
        np.add.at(g_filters[j], (x[rows, at * STRIDE + j], cols), d_z)
    return loss, [g_filters, d_z.sum(axis=0), feature.T @ d, np.array([d.sum()])]


def train(texts: list[bytes], labels: np.ndarray, seed: int = 7) -> Network:
    net = Network.start(seed)
    rng = np.random.default_rng(seed + 1)
    data, room = zip(*(chunks_of(t) for t in texts), strict=True)
    share = float(np.clip(labels.mean(), 0.05, 0.95))
    weight = np.where(labels > 0, (0.5 / share) ** 0.5, (0.5 / (1 - share)) ** 0.5)
    params = [net.filters, net.bias, net.out, np.zeros(1, np.float32)]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(data))
        for i in range(0, len(order), BATCH):
            part = order[i : i + BATCH]
            net.offset = float(params[3][0])
            _, grads = gradients(net, [data[k] for k in part], [room[k] for k in part], labels[part], weight[part])
            grads[0] += DECAY * net.filters
            grads[2] += DECAY * net.out
            step += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for q, (a, g) in enumerate(zip(params, grads, strict=True)):
                m[q] += 0.1 * (g - m[q])
                v[q] += 0.01 * (g * g - v[q])
                a -= rate * (m[q] / (1 - 0.9**step)) / (np.sqrt(v[q] / (1 - 0.99**step)) + 1e-8)
    net.offset = float(params[3][0])
    return net


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES, seed: int = 7) -> Network | None:
    """The network learned from labelled documents that are not held out: the first `rows`
    by hash order whose whole texts hold `size` bytes together; one that does not fit is
    passed over."""
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("__q_doc"), F.col("quality").cast("int").alias("quality"))
    # documents that are not there give no example
    chosen = usable.join(docs.select(F.col("doc_id").alias("__q_doc")).distinct(), "__q_doc", "left_semi").orderBy(F.xxhash64("__q_doc"), "__q_doc", "quality").limit(rows)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("__q_doc"))
    examples = stash(found.groupBy("doc_id", "quality").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")), "examples")
    # at most 2 * rows rows without their texts (a document may have both labels)
    taken, total = [], 0
    for r in examples.select("doc_id", "quality", F.octet_length("text").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").collect():
        if total + r["n"] <= size:
            taken.append((r["doc_id"], r["quality"]))
            total += r["n"]
    got = examples.where(F.col("doc_id").isin([d for d, _ in taken])).collect() if taken else []
    got = sorted((r for r in got if (r["doc_id"], r["quality"]) in set(taken)), key=lambda r: (r["doc_id"], r["quality"], r["text"]))
    discard(examples)
    if len({r["quality"] for r in got}) < 2:
        return None
    return train([r["text"].encode() for r in got], np.array([float(r["quality"] > 0) for r in got]), seed)


def score(docs: DataFrame, net: Network | None, column: str = "score") -> DataFrame:
    """docs with each whole text's score as the last column (in place of one so named)."""
    docs = docs.drop(column)
    if net is None:
        return docs.withColumn(column, F.lit(0.5))
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((net.filters, net.bias, net.out, net.offset))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network(*shared.value)
        for batch in batches:
            parts = []
            for i, j in passes(batch, "text", PASS):
                parts.append(own.scores(as_bytes(batch.slice(i, j - i).column("text")).to_pylist()))
            made = pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, column])

    return docs.mapInArrow(tidy(run), StructType([*docs.schema.fields, StructField(column, DoubleType())]))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the network does not reject, with their columns."""
    return score(docs, fit(docs, labels), "__q_score").where(F.col("__q_score") >= 0.5).drop("__q_score")
