"""A quality classifier of supervised subword embeddings.

A document is the mean of learned vectors: of its words, their character
n-grams and the pairs of neighbouring words, each found in a table by a hash.
A softmax layer on the mean gives the probability of quality 1.  Vectors and
layer are trained together by stochastic gradient descent in numpy, on a
bounded sample of labelled rows (TRAIN_ROWS) whose crc32(doc_id) mod 5 isn't 0.
As the layer is linear, a table of one number for each vector suffices to score.

Words are runs of bytes other than ASCII white space, in their own case.

Cases: a null or empty text has no features and scores as the layer's bias;
with labels of one kind only, or none, every score is that kind's rate (0.5
without any); rows with equal ids are scored one by one, and the least of their
texts is trained on; rows with a null doc_id are scored and not held out; a text
of any length is scored whole; further columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmat.llm.common import table
from sparkmat.llm.features import WordSums, labelled_sample, pair_features, word_features

TRAIN_ROWS = 4000
BITS, DIM = 18, 8
NGRAMS = (3, 4, 5)
EPOCHS, RATE = 8, 0.5
THRESHOLD = 0.3


@dataclass
class Model:
    """What scoring needs: the layer's output on each vector, and its bias."""

    outputs: np.ndarray
    bias: float


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of the table that a text uses, and how often."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    numbers = {w: k for k, w in enumerate(dict.fromkeys(words))}
    rows, count, hashes = word_features(list(numbers), NGRAMS, BITS)
    at = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    times = np.repeat(np.bincount(at, minlength=len(numbers)), count)
    total = np.bincount(np.concatenate([rows, pair_features(hashes[at], BITS)]), weights=np.concatenate([times, np.ones(len(at) - 1)]))
    used = np.flatnonzero(total)
    return used, (total[used] / total.sum()).astype(np.float32)


def train(docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int = 0) -> Model:
    """A model from the features of texts and their labels."""
    n, n_pos = len(y), int(y.sum()) if len(y) else 0
    if n_pos in (0, n):
        rate = n_pos / n if n else 0.5
        return Model(np.zeros(1 << BITS, np.float32), float(np.log((rate + 1e-6) / (1 - rate + 1e-6))))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    layer, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    step, steps = 0, EPOCHS * n
    for _ in range(EPOCHS):
        for k in rng.permutation(n):
            rows, share = docs[k]
            rate = RATE * (1 - step / steps)
            step += 1
            mean = share @ vectors[rows] if len(rows) else np.zeros(DIM, np.float32)
            z = layer @ mean + bias
            p = np.exp(z - z.max())
            g = p / p.sum()
            g[int(y[k])] -= 1
            down = layer.T @ g
            layer -= rate * np.outer(g, mean)
            bias -= 0.1 * rate * g
            if len(rows):
                # the gradient of a mean is spread over very many rows; it is scaled up by their number
                vectors[rows] -= rate * np.minimum(share * len(rows), 5.0)[:, None] * down
    return Model((vectors @ (layer[1] - layer[0])).astype(np.float32), float(bias[1] - bias[0]))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score, the probability of label 1, for every whole text."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        sums = WordSums(model.outputs, NGRAMS, BITS)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                texts = [words_of(t.as_py()) for t in part.column("text")]
                words = [w for own in texts for w in own]
                length = np.fromiter(map(len, texts), np.int64, len(texts))
                at = sums.places(words)
                ends = np.cumsum(length)
                total, count = (np.concatenate([[0], np.cumsum(x[at].astype(np.float64))]) for x in (sums.total, sums.count))
                total, count = total[ends] - total[ends - length], count[ends] - count[ends - length]
                if len(words) > 1:
                    pairs = model.outputs[pair_features(sums.hashes[at], BITS)].astype(np.float64)
                    inner = np.ones(len(pairs), bool)
                    inner[ends[(ends > 0) & (ends < len(words))] - 1] = False  # the last word of a text and the first of the next
                    summed = np.concatenate([[0], np.cumsum(pairs * inner)])
                    first, last = np.minimum(ends - length, len(pairs)), np.maximum(ends - 1, 0)
                    total += np.where(length > 1, summed[last] - summed[first], 0)
                    count += np.maximum(length - 1, 0)
                z = model.bias + total / np.maximum(count, 1)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "score": pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))})

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def fit(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> Model:
    def encode(text: str | None) -> bytes:
        used, share = features(text)
        return used.astype("<u4").tobytes() + share.astype("<f4").tobytes()

    def decode(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        half = len(raw) // 2
        return np.frombuffer(raw, "<u4", half // 4), np.frombuffer(raw, "<f4", offset=half)

    rows = labelled_sample(docs, labels, ["quality"], limit, encode)
    return train([decode(r.features) for r in rows], np.array([float(r.quality == 1) for r in rows]))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        F.coalesce(F.expr("crc32(CAST(CAST(doc_id AS string) AS binary)) % 5 = 0"), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
