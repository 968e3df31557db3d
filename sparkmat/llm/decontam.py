"""Benchmark decontamination over a distributed positional inverted index.

``build_index`` stores the postings of every word of every whole text.  The
index is partitioned by documents: each row is a segment of about
SEGMENT_WORDS words (a longer text makes a longer segment of its own) with its
terms, their counts and their ascending positions, written into the shared
folder.  A query is answered in every segment by itself: a phrase's candidates
are the postings of the term that is rarest in the segment, moved back by the
term's offset, and each further term, by rising count, keeps those whose
offset-adjusted position is in its own list.  A proximity match asks for all
words of a window within NEAR consecutive words of one document, in any order:
from the rarest term's postings, those stay that have every other term near, and
the places around them are tried.

The benchmark becomes a table of blocks of about BLOCK_WORDS words, built by the
executors (items longer than PIECE_WORDS in pieces that overlap by a window, so
that no window is lost).  One block after the other is broadcast, all segments
are searched for it, what is found is written, and the block is given up: the
driver and the executors hold one block at a time, whatever the benchmark's
size.  No group is keyed by a word, source or id, so a frequent word or passage
loads no task more than another.

Cases: null and empty texts have no words; items without words have no window;
an item whose id is null marks words as hit but is not listed; items with equal
ids are listed once; rows of documents with equal ids are judged one by one; a
word between two windows is hit once; matches never cross documents.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmat.llm.common import drop_tables, small_batches, table, write_table

SEGMENT_WORDS = 40_000
BLOCK_WORDS = 200_000
PIECE_WORDS = 20_000
WINDOW, NEAR = 10, 20
#: Candidates looked at together.
CANDIDATES = 1_000_000
#: ASCII letters in lower case and digits stay, other ASCII characters end a word; bytes over 127 belong to words.
TO_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256)
)
INDEX_SCHEMA = "seg long, docs array<long>, hashes array<long>, n_words array<int>, terms binary, counts binary, postings binary"


def words_of(text: str | None) -> list[bytes]:
    """The lower-cased words, in UTF-8."""
    return (text or "").encode("utf-8", "replace").translate(TO_WORDS).split()


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _segment(seg: int, docs: list, hashes: list, words: list[list[bytes]]) -> dict:
    """Positions count the segment's words in order, with one left out between documents."""
    n_words = np.fromiter(map(len, words), np.int64, len(words))
    numbers = _Numbers()
    number = numbers.__getitem__
    ids = np.concatenate([np.fromiter(map(number, own), np.int32, len(own)) for own in words])
    positions = np.arange(len(ids)) + np.repeat(np.arange(len(words)), n_words)
    order = np.argsort(ids, kind="stable")
    counts = np.bincount(ids, minlength=len(numbers)).astype("<u4")
    postings = positions[order]
    steps = np.diff(postings, prepend=0)
    if len(counts):
        first = np.cumsum(counts) - counts
        steps[first] = postings[first]  # the first of each term is whole, the others are steps
    return {"seg": seg, "docs": docs, "hashes": hashes, "n_words": n_words, "terms": b" ".join(numbers), "counts": counts.tobytes(), "postings": steps.astype("<u4").tobytes()}


def build_index(docs: DataFrame) -> DataFrame:
    """The stored index of the whole texts of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = TaskContext.get().partitionId() << 32
        ids: list = []
        hashes: list[int] = []
        words: list[list[bytes]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal seg, held
            row = _segment(seg, ids.copy(), hashes.copy(), words)
            seg, held = seg + 1, 0
            ids.clear()
            hashes.clear()
            words.clear()
            return pa.RecordBatch.from_pydict({
                "seg": pa.array([row["seg"]], pa.int64()),
                "docs": pa.array([row["docs"]], pa.list_(pa.int64())),
                "hashes": pa.array([row["hashes"]], pa.list_(pa.int64())),
                "n_words": pa.array([row["n_words"]], pa.list_(pa.int32())),
                **{k: pa.array([row[k]], pa.binary()) for k in ("terms", "counts", "postings")},
            })

        for batch in batches:
            for doc, text, text_hash in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("text_hash").to_pylist(), strict=True):
                own = words_of(text.as_py())
                if words and held + len(own) > SEGMENT_WORDS:
                    yield flush()
                ids.append(doc)
                hashes.append(text_hash)
                words.append(own)
                held += len(own)
        if words:
            yield flush()

    small_batches(docs.sparkSession)
    return write_table(docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, INDEX_SCHEMA), "postings")


def _pieces(items: DataFrame, window: int | None) -> DataFrame:
    """item_id, n and words (joined by spaces) of the distinct items that have words; long ones in pieces, unless they count as a whole (no window)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, pieces = [], []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text"), strict=True):
                words = words_of(text.as_py())
                step = PIECE_WORDS if window else max(1, len(words))
                for k in range(0, len(words), step):
                    own = words[k : k + step + (window or 1) - 1]
                    if k == 0 or len(own) >= (window or 1):  # a shorter rest has no window of its own
                        ids.append(item)
                        pieces.append(own)
            yield pa.RecordBatch.from_pydict({"item_id": pa.array(ids, pa.int64()), "n": pa.array(map(len, pieces), pa.int64()), "words": pa.array([b" ".join(p) for p in pieces], pa.binary())})

    return items.select(F.col("item_id").cast("long"), "text").mapInArrow(run, "item_id long, n long, words binary").distinct()


def _block(ids: list, pieces: list[bytes], window: int | None) -> dict:
    """Windows of items by length, as rows of numbers of the block's own terms; without a window an item's distinct words are one."""
    vocabulary, items = _Numbers(), {}
    by_length: dict[int, list[tuple[int, list[int]]]] = {}
    for item, piece in zip(ids, pieces, strict=True):
        words = bytes(piece).split(b" ")
        number = items.setdefault(item, len(items))
        terms = [vocabulary[w] for w in (words if window else dict.fromkeys(words))]
        size = min(window or len(terms), len(terms))
        by_length.setdefault(size, []).extend((number, terms[k : k + size]) for k in range(len(terms) - size + 1))
    return {
        "vocabulary": dict(vocabulary),
        "items": list(items),
        "windows": [(np.array([w[0] for w in own]), np.array([w[1] for w in own], np.int64)) for own in by_length.values()],
    }


def blocks_of(items: DataFrame, window: int | None) -> tuple[DataFrame, int]:
    """The items (item_id, text) as a table of blocks (block, data) and the number of blocks."""
    pieces = write_table(_pieces(items, window), "pieces")
    n_blocks = max(1, math.ceil((pieces.agg(F.sum("n")).first()[0] or 0) / BLOCK_WORDS))

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["item_id", "words"])
        ids = [None if pd.isna(i) else int(i) for i in rows["item_id"]]
        return pd.DataFrame({"block": [key[0]], "data": [pickle.dumps(_block(ids, rows["words"].tolist(), window))]})

    # ids as text: a null id would turn the others into floating point numbers
    dealt = pieces.select(F.expr(f"pmod(xxhash64(item_id, words), {n_blocks})").alias("block"), F.col("item_id").cast("string"), "words")
    return write_table(dealt.groupBy("block").applyInPandas(build, "block long, data binary"), "blocks"), n_blocks


def _in_rounds(index: DataFrame, items: DataFrame, window: int | None, scan: Callable[[DataFrame, dict], DataFrame], name: str) -> list[DataFrame]:
    """The tables of what ``scan`` finds for each block, one after another."""
    blocks, n_blocks = blocks_of(items, window)
    found = []
    for k in range(n_blocks):
        row = blocks.where(F.col("block") == k).first()  # one block
        block = pickle.loads(row["data"]) if row else _block([], [], window)
        held = index.sparkSession.sparkContext.broadcast(block)
        found.append(write_table(scan(index, held), name))
        held.unpersist()
    drop_tables(blocks)
    return found


def _lists(terms: bytes, counts: bytes, postings: bytes, vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the wanted terms in a segment: counts by number, where each list begins, and all lists as ``number << 32 | position``, ascending."""
    get = vocabulary.get
    names = terms.split(b" ") if terms else []
    number = np.fromiter((get(t, -1) for t in names), np.int64, len(names))
    n = np.frombuffer(counts, "<u4").astype(np.int64)
    steps = np.frombuffer(postings, "<u4").astype(np.int64)
    begin = np.cumsum(n) - n
    total = np.cumsum(steps)
    before = total[begin] - steps[begin] if len(n) else total[:0]
    wanted = np.flatnonzero(number >= 0)
    wanted = wanted[np.argsort(number[wanted])]
    size = n[wanted]
    at = np.repeat(begin[wanted] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    keys = (np.repeat(number[wanted], size) << 32) + total[at] - np.repeat(before[wanted], size)
    df = np.zeros(len(vocabulary), np.int64)
    df[number[wanted]] = size
    return df, np.cumsum(df) - df, keys


def _phrases(df: np.ndarray, start: np.ndarray, keys: np.ndarray, windows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of windows (rows of terms) with the positions at which they occur."""
    counts = df[windows]
    alive = np.flatnonzero((counts > 0).all(axis=1))
    order = np.argsort(counts[alive], axis=1, kind="stable")
    least = np.take_along_axis(counts[alive], order[:, :1], axis=1)[:, 0]
    ends = np.cumsum(least)
    low = 0
    while low < len(alive):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + CANDIDATES, "right")))
        size = least[low:high]
        own = np.repeat(np.arange(low, high), size)
        off = order[own, 0]
        lists = start[windows[alive[own], off]]
        at = keys[lists + np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)] & 0xFFFFFFFF
        at -= off
        for k in range(1, windows.shape[1]):
            off = order[own, k]
            key = (windows[alive[own], off] << 32) + at + off
            found = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            kept = (keys[found] == key) & (at >= 0)
            own, at = own[kept], at[kept]
            if not len(own):
                break
        kept = at >= 0
        yield alive[own[kept]], at[kept]
        low = high


def _near(lists: tuple, windows: np.ndarray, within: int, begin: np.ndarray, n_words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of windows with the documents in which all of their terms stand within so many consecutive words."""
    df, start, keys = lists
    counts = df[windows]
    alive = np.flatnonzero((counts > 0).all(axis=1))
    order = np.argsort(counts[alive], axis=1, kind="stable")
    least = np.take_along_axis(counts[alive], order[:, :1], axis=1)[:, 0]
    ends = np.cumsum(least)

    def holds(rows: np.ndarray, column: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        term = windows[alive[rows], column] << 32
        found = np.searchsorted(keys, term + np.maximum(low, 0))
        return (found < len(keys)) & (keys[np.minimum(found, len(keys) - 1)] < term + high)

    first = 0
    while first < len(alive):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + CANDIDATES, "right")))
        size = least[first:last]
        own = np.repeat(np.arange(first, last), size)
        at = keys[start[windows[alive[own], order[own, 0]]] + np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)] & 0xFFFFFFFF
        for k in range(1, windows.shape[1]):
            kept = holds(own, order[own, k], at - within + 1, at + within)
            own, at = own[kept], at[kept]
        doc = np.searchsorted(begin, at, "right") - 1
        for shift in range(within):  # places of ``within`` words around what is left
            if not len(own):
                break
            low, high = np.maximum(at - shift, begin[doc]), np.minimum(at - shift + within, begin[doc] + n_words[doc])
            whole = np.ones(len(own), bool)
            for k in range(1, windows.shape[1]):
                whole[whole] = holds(own[whole], order[own[whole], k], low[whole], high[whole])
            yield alive[own[whole]], doc[whole]
            own, at, doc = own[~whole], at[~whole], doc[~whole]
        first = last


def _matches(n_words: np.ndarray, lists: tuple, block: dict, near: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hit flags by position, where each document begins, and the distinct pairs (document, item) as ``document * items + item``: by phrase, and by proximity."""
    begin = np.cumsum(n_words + 1) - (n_words + 1)
    length = int((n_words + 1).sum())
    edge = np.zeros(length + 1, np.int64)
    n_items = len(block["items"])
    pairs, close = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for item, windows in block["windows"]:
        for own, at in _phrases(*lists, windows):
            edge += np.bincount(at, minlength=length + 1)[: length + 1]
            edge -= np.bincount(at + windows.shape[1], minlength=length + 1)[: length + 1]
            doc = np.searchsorted(begin, at, "right") - 1
            pairs.append(np.unique(doc * n_items + item[own]))
        close += [] if not near else [np.unique(doc * n_items + item[own]) for own, doc in _near(lists, windows, near, begin, n_words)]
    return np.cumsum(edge)[:length] > 0, begin, np.unique(np.concatenate(pairs)), np.unique(np.concatenate(close))


def _digest(items: list) -> str:
    return hashlib.sha256(",".join(sorted(str(i) for i in set(items) if i is not None)).encode()).hexdigest()


def _scan(index: DataFrame, held, near: int) -> DataFrame:
    """Documents of the index (seg, row) with what the block of ``held`` has in them: spans hit (start and end in words, alternating), items, items nearby."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = held.value
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                n_words = np.array(row["n_words"], np.int64)
                lists = _lists(row["terms"], row["counts"], row["postings"], block["vocabulary"])
                hit, begin, pairs, close = _matches(n_words, lists, block, near)
                turn = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0))  # spans end within their document: the place after it is never hit
                spans = np.split(turn, np.searchsorted(turn, begin[1:]))
                items: list[list] = [[] for _ in n_words]
                nearby: list[list] = [[] for _ in n_words]
                for out, found in ((items, pairs), (nearby, close)):
                    doc, item = np.divmod(found, max(1, len(block["items"])))
                    for d, i in zip(doc.tolist(), item.tolist(), strict=True):
                        out[d].append(block["items"][i])
                kept = [d for d in range(len(n_words)) if items[d] or nearby[d]]
                yield pa.RecordBatch.from_pydict({
                    "seg": pa.array([row["seg"]] * len(kept), pa.int64()),
                    "row": pa.array(kept, pa.int32()),
                    "spans": pa.array([spans[d] - begin[d] for d in kept], pa.list_(pa.int64())),
                    "items": pa.array([items[d] for d in kept], pa.list_(pa.int64())),
                    "near": pa.array([nearby[d] for d in kept], pa.list_(pa.int64())),
                })

    return index.select("seg", "n_words", "terms", "counts", "postings").mapInArrow(run, "seg long, row int, spans array<long>, items array<long>, near array<long>")


def _summary(found: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = _digest([])
        for batch in batches:
            n_hit, digests, spans_out, items_out, near_out = [], [], [], [], []
            for parts in zip(*(batch.column(c).to_pylist() for c in ("spans", "items", "near")), strict=True):
                spans, items, near = (x or () for x in parts)
                total, end, merged = 0, -1, []
                for a, b in sorted(zip(spans[::2], spans[1::2], strict=True)):
                    if a <= end:
                        merged[-1][1] = max(end, b)
                    else:
                        merged.append([a, b])
                    total += max(0, b - max(a, end))
                    end = max(end, b)
                own = sorted({i for i in items if i is not None}, key=str)
                n_hit.append(total)
                digests.append(_digest(own) if own else none)
                spans_out.append([{"start": a, "end": b} for a, b in merged])
                items_out.append(own)
                near_out.append(sorted({i for i in near if i is not None}, key=str))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                "text_hash": batch.column("text_hash"),
                "n_words": batch.column("n_words"),
                "n_hit": pa.array(n_hit, pa.int64()),
                "n_items": pa.array(map(len, items_out), pa.int64()),
                "items_sha256": pa.array(digests, pa.string()),
                "contaminated": pa.array([n > 0 for n in n_hit], pa.bool_()),
                "n_near": pa.array(map(len, near_out), pa.int64()),
                "spans": pa.array(spans_out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                "items": pa.array(items_out, pa.list_(pa.int64())),
                "near": pa.array(near_out, pa.list_(pa.int64())),
            })

    schema = "doc_id long, text_hash long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, n_near long, spans array<struct<start:long,end:long>>, items array<long>, near array<long>"
    return found.select("doc_id", "text_hash", "n_words", "spans", "items", "near").mapInArrow(run, schema)


def find_contamination(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, near: int = NEAR, hashes: bool = False) -> DataFrame:
    """Matches of all windows of ``benchmark`` (item_id, text) in every document of the index.

    Returns doc_id, n_words, n_hit, n_items, items_sha256, contaminated, the
    merged hit ``spans`` (in words) and the sorted ``items`` of exact matches;
    n_near and ``near`` are the items with a window whose words stand within
    ``near`` consecutive words (0: none are looked for).  With ``hashes`` there
    is text_hash too, the xxhash64 of the text, which tells rows of one id apart.
    """
    rounds = _in_rounds(index, benchmark, window, lambda index, held: _scan(index, held, near), "found")
    found = rounds[0]
    for other in rounds[1:]:
        found = found.unionByName(other)
    found = found.groupBy("seg", "row").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "items", "near")])
    every = index.select("seg", F.posexplode(F.arrays_zip("docs", "hashes", "n_words")).alias("row", "d")).select("seg", "row", F.col("d.docs").alias("doc_id"), F.col("d.hashes").alias("text_hash"), F.col("d.n_words").cast("long").alias("n_words"))
    summary = _summary(every.join(found, ["seg", "row"], "left"))
    return summary if hashes else summary.drop("text_hash")


def find_proximity(index: DataFrame, queries: DataFrame, within: int) -> DataFrame:
    """Places where all words of a query stand, in any order, within ``within`` consecutive words.

    ``queries`` has item_id and text.  Returns doc_id, query_id, and start and
    end (in words, end excluded) of every least such place that begins with a
    word of the query.  Queries without words match nothing.
    """

    def scan(index: DataFrame, held) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = held.value
            for batch in batches:
                out: list[tuple] = []
                for k in range(batch.num_rows):
                    row = batch.slice(k, 1).to_pylist()[0]
                    n_words = np.array(row["n_words"], np.int64)
                    begin = np.cumsum(n_words + 1) - (n_words + 1)
                    df, start, keys = _lists(row["terms"], row["counts"], row["postings"], block["vocabulary"])
                    for item, windows in block["windows"]:
                        for number in np.flatnonzero((df[windows] > 0).all(axis=1)).tolist():
                            lists = sorted((keys[start[t] : start[t] + df[t]] & 0xFFFFFFFF for t in windows[number]), key=len)
                            near = lists[0]  # from the rarest term, keep positions with every other term near
                            for other in lists[1:]:
                                at = np.searchsorted(other, near - within + 1)
                                near = near[(at < len(other)) & (other[np.minimum(at, len(other) - 1)] < near + within)]
                            firsts = np.unique(np.concatenate([p[(np.searchsorted(near, p) < len(near))] for p in lists])) if len(near) else near
                            ends = firsts.copy()
                            for other in lists:
                                at = np.searchsorted(other, firsts)
                                ends = np.maximum(ends, np.where(at < len(other), other[np.minimum(at, len(other) - 1)], 2**40))
                            doc = np.searchsorted(begin, firsts, "right") - 1
                            kept = (ends - firsts < within) & (ends < begin[doc] + n_words[doc])
                            query = block["items"][item[number]]
                            out += [(row["docs"][d], query, int(a - begin[d]), int(b - begin[d]) + 1) for d, a, b in zip(doc[kept], firsts[kept], ends[kept], strict=True)]
                yield pa.RecordBatch.from_pydict({k: pa.array([o[n] for o in out], pa.int64()) for n, k in enumerate(("doc_id", "query_id", "start", "end"))})

        return index.mapInArrow(run, "doc_id long, query_id long, start long, end long")

    rounds = _in_rounds(index, queries, None, scan, "places")
    found = rounds[0]
    for other in rounds[1:]:
        found = found.unionByName(other)
    return found


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(table(spark, sf_dir, "documents"))
    found = find_contamination(index, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near")
