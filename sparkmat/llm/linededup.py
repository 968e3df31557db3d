"""Reversible line dedup: sharded cuckoo filters backed by an exact reference-count table.

The exact table has a row for each key and document that holds it, with the
number of lines (references).  From it follow the shared keys, those of two
documents or more, with the keeper, the smallest doc_id.  In front stand cuckoo
filters of the shared keys, one for each shard of the key space: they tell that
a line surely isn't shared, so that only the few others are joined with the
exact table, which decides.  References and filters meet by shard: a partition
is sorted, each filter before its references, and passes through one task as a
stream that holds one filter; a shard of very many references (a line that is
everywhere) is dealt over several parts, each with a copy of its filter.  No
filter is collected or broadcast, so any number of them works the same way.

``insert_documents`` and ``delete_documents`` change the table and the filters,
so a dedup can be taken back document by document; the outcome is always that
of a fresh build.  Once shards have grown to twice their size, they are split
anew.

A key (128-bit digest) is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z
lower-cased; keys under MIN_CHARS code points are never dropped.

Cases: a null or empty text is one empty line; a key that occurs again within
one document doesn't make it shared, and its lines all go or all stay; rows
with equal doc_id are one document; rows with a null doc_id hold no keys and
keep all lines; further columns of the documents pass through unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmat.llm.common import packed, small_batches, table, unpacked, write_table

MIN_CHARS = 10
#: Shared keys meant for one shard's filter.
SHARD_KEYS = 20_000
#: References of one shard that one task takes, about.
PART_ROWS = 500_000
SLOTS, KICKS = 4, 500


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; a key may stand in two buckets, each found from the other."""

    def __init__(self, buckets: int, slots: np.ndarray | None = None):
        self.buckets = buckets
        self.slots = np.zeros((buckets, SLOTS), np.uint16) if slots is None else slots

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        return cls(1 << max(2, int(np.ceil(np.log2(max(1, keys) / SLOTS / 0.8)))))

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        """A filter of these keys, larger if they don't fit at first."""
        made = cls.sized(len(keys))
        while not all(made.insert(*x) for x in zip(*(a.tolist() for a in made._places(keys)[:2]), strict=True)):
            made = cls(made.buckets * 2)
        return made

    def to_bytes(self) -> bytes:
        return self.slots.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        slots = np.frombuffer(raw, np.uint16).reshape(-1, SLOTS)
        return cls(len(slots), slots.copy())

    def _other(self, bucket, mark):
        return bucket ^ (mark * 0x5BD1E995 & (self.buckets - 1))

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = keys.view(np.uint64)
        mark = (raw >> np.uint64(48)).astype(np.int64)
        mark[mark == 0] = 1
        first = ((raw >> np.uint64(16)) & np.uint64(self.buckets - 1)).astype(np.int64)
        return mark, first, self._other(first, mark)

    def insert(self, mark: int, bucket: int) -> bool:
        """False if it found no place; the filter must then be made anew, as a displaced key is lost."""
        for b in (bucket, self._other(bucket, mark)):
            free = np.flatnonzero(self.slots[b] == 0)
            if len(free):
                self.slots[b, free[0]] = mark
                return True
        for k in range(KICKS):
            s = (mark + k) % SLOTS
            mark, self.slots[b, s] = int(self.slots[b, s]), mark
            b = self._other(b, mark)
            free = np.flatnonzero(self.slots[b] == 0)
            if len(free):
                self.slots[b, free[0]] = mark
                return True
        return False

    def delete(self, mark: int, bucket: int) -> bool:
        for b in (bucket, self._other(bucket, mark)):
            held = np.flatnonzero(self.slots[b] == mark)
            if len(held):
                self.slots[b, held[0]] = 0
                return True
        return False

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, first, second = self._places(keys)
        return (self.slots[first] == mark[:, None]).any(axis=1) | (self.slots[second] == mark[:, None]).any(axis=1)


@dataclass
class LineIndex:
    """references: k1, k2, doc_id, refs; shared: k1, k2, keeper; filters: shard, slots."""

    references: DataFrame
    shared: DataFrame
    filters: DataFrame
    n_shards: int


def line_keys(text: str | None) -> list[bytes | None]:
    """The digest of each line's key, or None for keys that are never dropped."""
    out: list[bytes | None] = []
    for line in (text or "").encode("utf-8", "replace").split(b"\n"):
        key = line.strip().lower()
        n = len(key)
        long_enough = n >= MIN_CHARS and (n >= 4 * MIN_CHARS or len(key.decode("utf-8")) >= MIN_CHARS)
        out.append(hashlib.blake2b(key, digest_size=16).digest() if long_enough else None)
    return out


def references_of(docs: DataFrame) -> DataFrame:
    """A row for each document row and key: k1, k2, doc_id and refs, the number of its lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids: list[int] = []
            keys: list[bytes] = []
            refs: list[int] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                if doc is None:
                    continue
                own: dict[bytes, int] = {}
                for key in line_keys(text.as_py()):
                    if key is not None:
                        own[key] = own.get(key, 0) + 1
                ids += [doc] * len(own)
                keys += own
                refs += own.values()
            halves = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(halves[:, 0])), pa.array(np.ascontiguousarray(halves[:, 1])), pa.array(ids, pa.int64()), pa.array(refs, pa.int64())], names=["k1", "k2", "doc_id", "refs"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "k1 long, k2 long, doc_id long, refs long")


def _shared(references: DataFrame) -> DataFrame:
    ends = references.groupBy("k1", "k2").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last"))
    return ends.where("keeper < last").select("k1", "k2", "keeper")


def _shard(n_shards: int):
    return F.expr(f"shiftrightunsigned(k2, 8) & {n_shards - 1}").alias("shard")


def _filters(shared: DataFrame, n_shards: int) -> DataFrame:
    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": [key[0]], "slots": [CuckooFilter.of(rows["k1"].to_numpy()).to_bytes()]})

    return shared.select("k1", _shard(n_shards)).groupBy("shard").applyInPandas(build, "shard long, slots binary")


def build_index(docs: DataFrame) -> LineIndex:
    small_batches(docs.sparkSession)
    return _index(write_table(references_of(docs), "references"))


def _shards(keys: int) -> int:
    """How many shards, a power of two, make at most SHARD_KEYS keys each on average."""
    return 1 << (max(0, keys - 1) // SHARD_KEYS).bit_length()


def _index(references: DataFrame) -> LineIndex:
    shared = write_table(_shared(references), "shared")
    n_shards = _shards(shared.count())
    return LineIndex(references, shared, write_table(_filters(shared, n_shards), "filters"), n_shards)


def insert_documents(index: LineIndex, docs: DataFrame) -> LineIndex:
    """The index with these documents added; their ids must be new to it."""
    return _changed(index, write_table(index.references.unionByName(references_of(docs)), "references"))


def delete_documents(index: LineIndex, ids: DataFrame) -> LineIndex:
    """The index without the documents of ``ids`` (doc_id)."""
    return _changed(index, write_table(index.references.join(ids.select("doc_id"), "doc_id", "left_anti").select("k1", "k2", "doc_id", "refs"), "references"))


def _changed(index: LineIndex, references: DataFrame) -> LineIndex:
    """Brings the filters up to date by inserting and deleting the keys that became or ceased to be shared."""
    shared = write_table(_shared(references), "shared")
    wanted = _shards(shared.count())
    if wanted > 2 * index.n_shards:
        return LineIndex(references, shared, write_table(_filters(shared, wanted), "filters"), wanted)
    keys = ["k1", "k2"]
    changes = shared.join(index.shared, keys, "left_anti").select(*keys, F.lit(True).alias("added")).unionByName(
        index.shared.join(shared, keys, "left_anti").select(*keys, F.lit(False).alias("added")))

    def update(key: tuple, held: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        made = CuckooFilter.from_bytes(held["slots"].iloc[0]) if len(held) else CuckooFilter.sized(len(rows))
        mark, first, _ = made._places(rows["k1"].to_numpy(np.int64)) if len(rows) else (np.zeros(0, np.int64),) * 3
        fits = True
        for m, b, added in zip(mark.tolist(), first.tolist(), rows["added"].tolist(), strict=True):
            if not added:
                made.delete(m, b)
        for m, b, added in zip(mark.tolist(), first.tolist(), rows["added"].tolist(), strict=True):
            fits = fits and (not added or made.insert(m, b))
        return pd.DataFrame({"shard": [key[0]], "slots": [made.to_bytes() if fits else None]})

    by_shard = changes.select("k1", "added", _shard(index.n_shards)).groupBy("shard")
    filters = write_table(index.filters.groupBy("shard").cogroup(by_shard).applyInPandas(update, "shard long, slots binary"), "filters")
    full = filters.where("slots IS NULL").select("shard")
    if full.limit(1).count():  # a shard outgrew its filter: it is made anew from the exact table
        again = _filters(shared.withColumn("shard", _shard(index.n_shards)).join(full, "shard", "left_semi"), index.n_shards)
        filters = write_table(filters.where("slots IS NOT NULL").unionByName(again), "filters")
    return LineIndex(references, shared, filters, index.n_shards)


def _maybe_shared(index: LineIndex) -> DataFrame:
    """The references (k1, k2, doc_id) whose keys pass their shard's filter."""
    rows = index.references.select("k1", "k2", "doc_id", _shard(index.n_shards))
    parts = write_table(rows.groupBy("shard").agg(F.expr(f"1 + count(*) div {PART_ROWS}").alias("parts")).where("parts > 1"), "parts")
    dealt = rows.join(parts, "shard", "left").select("shard", F.expr("pmod(xxhash64(doc_id), coalesce(parts, 1L))").alias("part"), F.lit(None).cast("binary").alias("slots"), "k1", "k2", "doc_id")
    none = [F.lit(None).cast("long").alias(c) for c in ("k1", "k2", "doc_id")]
    copies = index.filters.join(parts, "shard", "left").select("shard", F.explode(F.expr("sequence(0L, coalesce(parts, 1L) - 1L)")).alias("part"), "slots", *none)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own = None, -1  # the filter at hand and its shard
        for batch in batches:
            if not batch.num_rows:
                continue
            shards = batch.column("shard").to_numpy()
            slots = batch.column("slots")
            is_filter = slots.is_valid().to_numpy(zero_copy_only=False)
            k1 = batch.column("k1").fill_null(0).to_numpy()
            passed = np.zeros(len(shards), bool)
            turns = np.flatnonzero(is_filter | np.diff(shards, prepend=-1).astype(bool))
            for start, end in zip(turns.tolist(), [*turns[1:].tolist(), len(shards)], strict=True):
                if is_filter[start]:
                    held, own, start = CuckooFilter.from_bytes(slots[start].as_py()), shards[start], start + 1
                if own == shards[end - 1] and start < end:
                    passed[start:end] = held.contains(k1[start:end])
            yield batch.select(["k1", "k2", "doc_id"]).filter(pa.array(passed))

    together = copies.unionByName(dealt).repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("slots").isNull())
    return together.mapInArrow(run, "k1 long, k2 long, doc_id long")


def dedup_lines(docs: DataFrame, index: LineIndex) -> DataFrame:
    """``docs`` with ``text`` freed of lines that a smaller doc_id of the index holds; n_lines and n_dropped are added.

    Where ``docs`` has columns of these names, they are replaced; all others come
    out as they are, whatever their names.
    """
    found = _maybe_shared(index).join(index.shared, ["k1", "k2"]).where("doc_id <> keeper")
    drops = found.groupBy(F.col("doc_id").alias("_doc")).agg(F.flatten(F.collect_set(F.array("k1", "k2"))).alias("_drop"))
    docs = docs.drop("n_lines", "n_dropped")
    carried = packed(docs, ["doc_id", "text"], ("doc_id", "text"))
    joined = carried.join(drops, F.col("doc_id").cast("long") == F.col("_doc"), "left").drop("_doc")
    names = carried.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, drop in zip(batch.column("text"), batch.column("_drop"), strict=True):
                whole, gone = text.as_py(), drop.as_py()
                lines = (whole or "").split("\n")
                n_lines.append(len(lines))
                if gone:
                    marks = np.array(gone, "<i8").tobytes()
                    marks = {marks[k : k + 16] for k in range(0, len(marks), 16)}
                    kept = [line for line, key in zip(lines, line_keys(whole), strict=True) if key is None or key not in marks]
                    n_dropped.append(len(lines) - len(kept))
                    whole = "\n".join(kept)
                else:
                    n_dropped.append(0)
                texts.append(whole)
            columns = {n: pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names}
            yield pa.RecordBatch.from_pydict(columns | {"n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())})

    schema = carried.withColumns({"n_lines": F.lit(0).cast("long"), "n_dropped": F.lit(0).cast("long")}).schema
    kept = joined.mapInArrow(run, schema)
    return kept.select(*unpacked(docs.columns, doc_id=F.col("doc_id"), text=F.col("text")), "n_lines", "n_dropped")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = dedup_lines(docs, build_index(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), shared AS (
  SELECT key, min(doc_id) AS keeper FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), judged AS (
  SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND s.keeper <> k.doc_id AS gone
  FROM keyed k LEFT JOIN shared s ON s.key = k.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
