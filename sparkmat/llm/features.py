"""Hashed features of words: the word itself and its character n-grams, as rows of one table.

All work is on UTF-8 bytes.  A word is framed by two marks, so that an n-gram
at its beginning or end differs from the same bytes inside.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Words whose sums a worker keeps before it starts anew (memory, not results, depends on it).
CACHED_WORDS = 200_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_features(words: list[bytes], sizes: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: features (rows below 2**bits, one word after another), how many there are, and its 64-bit hash."""
    raw = np.frombuffer(b"\x02" + b"\x03\x02".join(words) + b"\x03", np.uint8).astype(np.uint64)
    length = np.fromiter(map(len, words), np.int64, len(words)) + 2
    begin = np.cumsum(length) - length
    word = np.repeat(np.arange(len(words)), length)
    end = begin[word] + length[word]
    place = np.arange(len(raw))
    out, owner = [], []
    with np.errstate(over="ignore"):
        # the whole word: a sum over its bytes, each multiplied by a power for its place
        powers = FACTOR ** np.arange(1, int(length.max()) + 1, dtype=np.uint64)
        whole = _mixed(np.add.reduceat((raw + np.uint64(1)) * powers[place - begin[word]], begin))
        out.append(whole)
        owner.append(np.arange(len(words)))
        for n in sizes:
            kept = np.flatnonzero(place + n <= end)
            total = np.full(len(kept), n, np.uint64)
            for k in range(n):
                total = total * FACTOR + raw[kept + k]
            out.append(_mixed(total))
            owner.append(word[kept])
    rows = (np.concatenate(out) >> np.uint64(64 - bits)).astype(np.int64)
    owners = np.concatenate(owner)
    order = np.argsort(owners, kind="stable")
    return rows[order], np.bincount(owners, minlength=len(words)), whole


def pair_features(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Rows of the pairs of words that follow each other, from the words' hashes; all pairs of a word with itself share row 0."""
    with np.errstate(over="ignore"):
        rows = (_mixed(hashes[:-1] * FACTOR + hashes[1:]) >> np.uint64(64 - bits)).astype(np.int64)
    rows[hashes[:-1] == hashes[1:]] = 0
    return rows


class WordSums:
    """Sums of a vector of weights over the features of words; a worker keeps them from batch to batch."""

    def __init__(self, weights: np.ndarray, sizes: tuple[int, ...], bits: int):
        self.weights, self.sizes, self.bits = weights, sizes, bits
        self._clear()

    def _clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.total, self.count, self.hashes = np.zeros(0, np.float32), np.zeros(0, np.int32), np.zeros(0, np.uint64)

    def places(self, words: list[bytes]) -> np.ndarray:
        """Where each word's total, count and hash stand."""
        if len(self.index) > CACHED_WORDS:
            self._clear()
        new = list(set(words).difference(self.index))
        for k in range(0, len(new), 20_000):
            part = new[k : k + 20_000]
            rows, count, hashes = word_features(part, self.sizes, self.bits)
            at = len(self.index)
            self.index.update(zip(part, range(at, at + len(part)), strict=True))
            sums = np.add.reduceat(self.weights[rows].astype(np.float64), np.cumsum(count) - count)
            self.total = np.concatenate([self.total, sums.astype(np.float32)])
            self.count = np.concatenate([self.count, count.astype(np.int32)])
            self.hashes = np.concatenate([self.hashes, hashes])
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))


def held_out(doc_id: int | None, folds: int = 5) -> bool:
    """Whether crc32 of the id as text leaves no remainder."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == 0


def prefix_features(words: list[bytes], sizes: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each word: rows of the whole word and of its beginnings of ``sizes`` bytes (ascending), and whose row each is."""
    length = np.fromiter(map(len, words), np.int64, len(words))
    raw = np.frombuffer(b"".join(words), np.uint8).astype(np.uint64)
    begin = np.cumsum(length) - length
    longest = int(length.max())
    out, owner = [], []
    with np.errstate(over="ignore"):
        powers = FACTOR ** np.arange(1, longest + 1, dtype=np.uint64)
        place = np.arange(len(raw)) - np.repeat(begin, length)
        out.append(_mixed(np.add.reduceat((raw + np.uint64(1)) * powers[place], begin)))
        owner.append(np.arange(len(words)))
        total = np.full(len(words), 7, np.uint64)
        for n in range(1, max(sizes, default=0) + 1):
            kept = np.flatnonzero(length >= n)
            total[kept] = total[kept] * FACTOR + raw[begin[kept] + n - 1]
            if n in sizes and len(kept):
                out.append(_mixed(total[kept] + np.uint64(n)))
                owner.append(kept)
    return (np.concatenate(out) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate(owner)


def labelled_sample(docs: DataFrame, labels: DataFrame, columns: list[str], limit: int, encode: Callable[[str | None], bytes], folds: int = 5) -> list:
    """Up to ``limit`` rows (doc_id, features, *columns) with all labels given and the id's crc32 not a multiple of ``folds``.

    The rows come in the order of a hash of the id, so the sample is the same
    on every run; one row for each labelled id, where an id is repeated that of
    its least text.  Only these rows reach the driver, as what ``encode`` makes
    of the texts on the executors: at most a number for each row of the table of features.
    """
    given = labels.dropna(subset=["doc_id", *columns]).where(F.expr(f"crc32(CAST(CAST(doc_id AS string) AS binary)) % {folds} <> 0"))
    few = given.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in columns]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").groupBy("doc_id", *columns).agg(F.min("text").alias("text"))  # at most ``limit`` labels are broadcast

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [encode(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_pydict({"features": pa.array(found, pa.binary()), **{c: batch.column(c) for c in ("doc_id", *columns)}})

    kinds = dict(rows.dtypes)
    schema = "features binary, " + ", ".join(f"{c} {kinds[c]}" for c in ("doc_id", *columns))
    found = rows.mapInArrow(run, schema).toArrow().to_pylist()
    return sorted((Row(**r) for r in found), key=lambda r: r.doc_id)
