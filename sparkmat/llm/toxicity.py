"""Toxicity by a classifier chain.

Categories are predicted one after another by linear models; each later model
also gets the probabilities of the earlier categories.  In training these are
out-of-fold: each row's earlier probabilities come from models that didn't see
it, so a later model learns how far to trust them.  A model is logistic over
hashed presence features, the distinct words of a document and their
beginnings, each scaled by its naive-Bayes log ratio (features under MIN_DOCS
documents or MIN_RATIO carry nothing), trained by AdaGrad steps in numpy on a
bounded sample of labelled rows (TRAIN_ROWS).  The threshold of the last
category is the one of best F1 on the out-of-fold probabilities.

The query's chain is made of the categories that ``labels`` has: low quality
(quality = 0), then toxic.

Cases: a null or empty text has no features and gets the models' base rates; a
category without examples of either kind has the constant probability of its
rate (0 without any rows); rows with equal ids are scored one by one, and the
least of their texts is trained on; labels with nulls aren't used; a text of any
length is scored whole; further columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sparkmat.llm.common import table
from sparkmat.llm.decontam import words_of
from sparkmat.llm.features import CACHED_WORDS, labelled_sample, prefix_features

TRAIN_ROWS = 6000
BITS = 20
PREFIXES = (3, 4, 5, 6, 7, 8, 9, 10)
MIN_DOCS, MIN_RATIO = 3, 1.5
EPOCHS, RATE, FOLDS = 8, 0.1, 3


def features(text: str | None) -> np.ndarray:
    words = list(set(words_of(text)))
    if not words:
        return np.zeros(0, np.int64)
    return np.unique(prefix_features(words, PREFIXES, BITS)[0])


@dataclass
class Link:
    """One linear model: weights by feature row, weights of the earlier probabilities, bias."""

    weights: np.ndarray
    earlier: np.ndarray
    bias: float

    def probability(self, total: float, earlier: np.ndarray) -> float:
        return 1 / (1 + float(np.exp(-np.clip(self.bias + total + (self.earlier * earlier).sum(), -30, 30))))

    def score(self, rows: list[np.ndarray], earlier: np.ndarray) -> np.ndarray:
        return np.array([self.probability(self.weights[f].sum(), e) for f, e in zip(rows, earlier, strict=True)])


def train_link(rows: list[np.ndarray], earlier: np.ndarray, y: np.ndarray, seed: int = 0) -> Link:
    size = 1 << BITS
    n_pos, n = int(y.sum()), len(y)
    none = Link(np.zeros(size, np.float32), np.zeros(earlier.shape[1]), -30.0)
    if n_pos in (0, n):
        none.bias = 30.0 if n and n_pos == n else -30.0
        return none
    counts = [np.zeros(size), np.zeros(size)]
    for f, label in zip(rows, y, strict=True):
        counts[int(label)][f] += 1
    ratio = np.log((counts[1] + 0.5) / (n_pos + 1) / ((counts[0] + 0.5) / (n - n_pos + 1)))
    ratio[(counts[0] + counts[1] < MIN_DOCS) | (np.abs(ratio) < MIN_RATIO)] = 0
    kept = [f[ratio[f] != 0] for f in rows]
    w, squares = np.zeros(size), np.full(size, 0.1)
    u, u_squares, bias = np.zeros(earlier.shape[1]), np.full(earlier.shape[1], 0.1), float(np.log(n_pos / (n - n_pos)))
    order = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for k in order.permutation(n):
            f = kept[k]
            x = ratio[f]
            z = bias + (w[f] * x).sum() + (u * earlier[k]).sum()
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[k]
            step = g * x
            squares[f] += step * step
            w[f] -= RATE * step / np.sqrt(squares[f])
            step = g * earlier[k]
            u_squares += step * step
            u -= RATE * step / np.sqrt(u_squares)
            bias -= 0.02 * g
    return Link((w * ratio).astype(np.float32), u, bias)


@dataclass
class Chain:
    categories: list[str]
    links: list[Link]
    threshold: float


def train_chain(rows: list[np.ndarray], labels: dict[str, np.ndarray]) -> Chain:
    """A chain in the order of ``labels`` (category to 0/1 by row) from the features of texts."""
    n = len(rows)
    fold = np.random.default_rng(1).permutation(n) % FOLDS
    earlier = np.zeros((n, 0))
    links, out = [], np.zeros(n)
    for y in labels.values():
        links.append(train_link(rows, earlier, y))
        out = np.zeros(n)
        for k in range(FOLDS):
            seen, unseen = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            link = train_link([rows[i] for i in seen], earlier[seen], y[seen])
            out[unseen] = link.score([rows[i] for i in unseen], earlier[unseen])
        earlier = np.column_stack([earlier, out])
    return Chain(list(labels), links, _best_threshold(out, y) if n else 0.5)


def _best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Of best F1; among equals the one nearest 0.5."""
    grid = np.linspace(0.1, 0.9, 33)
    f1 = [2 * ((p >= t) & (y > 0)).sum() / max(1, (p >= t).sum() + y.sum()) for t in grid]
    return float(max(zip(f1, -np.abs(grid - 0.5), grid, strict=True))[2])


def score_documents(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, ``p_<category>`` of each category, and ``flagged`` by the last one's threshold, for every whole text."""
    held = docs.sparkSession.sparkContext.broadcast(chain)  # 2**BITS weights a category

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = held.value
        active = np.zeros(1 << BITS, bool)
        for link in chain.links:
            active |= link.weights != 0
        cache: dict[bytes, tuple] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                texts = [set(words_of(t.as_py())) for t in part.column("text")]
                if len(cache) > CACHED_WORDS:
                    cache.clear()
                new = list(set().union(*texts).difference(cache))
                if new:
                    rows, owner = prefix_features(new, PREFIXES, BITS)
                    own = active[rows]
                    cache.update(dict.fromkeys(new, ()))
                    for r, o in zip(rows[own].tolist(), owner[own].tolist(), strict=True):
                        cache[new[o]] += (r,)
                found = [np.fromiter(set().union(*map(cache.__getitem__, words)), np.int64) for words in texts]
                earlier = np.zeros((len(found), 0))
                for link in chain.links:
                    earlier = np.column_stack([earlier, link.score(found, earlier)])
                columns = {f"p_{c}": pa.array(earlier[:, k]) for k, c in enumerate(chain.categories)}
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), **columns, "flagged": pa.array(earlier[:, -1] >= chain.threshold)})

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, " + "".join(f"p_{c} double, " for c in chain.categories) + "flagged boolean"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> Chain:
    rows = labelled_sample(docs, labels, ["quality", "toxic"], limit, lambda text: features(text).astype("<u4").tobytes())
    return train_chain([np.frombuffer(r.features, "<u4") for r in rows], {
        "low_quality": np.array([float(r.quality == 0) for r in rows]),
        "toxic": np.array([float(r.toxic == 1) for r in rows]),
    })


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.withColumnRenamed("flagged", "toxic")
