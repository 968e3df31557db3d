"""Near-duplicate documents by SetSketch registers.

A document's set holds its distinct five-word shingles.  A SetSketch of M
registers keeps, for each of M hash functions, the least of exponentially
distributed hash values of the set's elements, rounded down on a scale that is
exponentially spaced with base BASE and truncated to 0..LIMIT; a register of a
union is the larger of the two registers, so sketches merge.  Registers are
equal with a probability near the Jaccard similarity J, so bands of ROWS
registers find candidates: a pair at J = 0.75 escapes all bands once in 190,000
times.  Candidates whose registers, taken jointly by likelihood with the known
set sizes, make J >= 0.75 implausible are dropped (log-likelihood ratio above
MARGIN: beyond five standard deviations); all others are confirmed on the full
sets.

Copies with equal sets form a class first, with a number of its own and its
smallest doc_id as representative; only the class goes into bands.  Within a band's bucket each member is compared with the
bucket's leader (its least class).  Buckets whose members then still lie in
different components are cut by set size and compared block by block, across
components only, by their registers; what these don't rule out is confirmed on
the full sets of the block.  So no candidate pair between different components stays
unchecked, and a large group of copies costs one comparison a member.  Components come from alternating large-star and
small-star steps over tables in the shared folder; no links, sketches or
components pass the driver.

Cases: without words (null, empty or blank text) a document has an empty set
and is linked with nothing; with fewer than five words the whole sequence is
its one shingle; a row with a null doc_id is linked with nothing, has no
component and is kept; rows with equal doc_id are judged by their own texts,
and each gets its text's component, even where one doc_id is the representative
of several classes; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmat.llm.common import drop_tables, small_batches, table, write_table

SHINGLE = 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 75
M, ROWS = 128, 4
BASE, RATE, LIMIT = 1.001, 20.0, 2**16 - 1
MARGIN = 12.5
#: Members compared with one leader in a group, and their shingles together, about; members of a block.
GROUP, GROUP_SHINGLES, BLOCK = 128, 500_000, 1024
#: Shingles of a block's members together, about.
BLOCK_SHINGLES = 500_000
#: Equal registers without which J >= 0.75 is beyond seven standard deviations.
LEAST_EQUAL = 60

FACTORS = np.random.Generator(np.random.PCG64(20)).integers(0, 2**63, M, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None) -> np.ndarray:
    """The set, as ascending 64-bit hashes of the shingles."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    size = min(SHINGLE, len(words))
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(w) - size + 1
    total = np.full(n, size, np.uint64)
    for k in range(size):
        total = total * STEP + w[k : k + n]
    return np.unique(_mixed(total))


def registers(own: np.ndarray) -> np.ndarray:
    """The sketch of a non-empty set."""
    top = np.zeros(M, np.uint64)
    for k in range(0, len(own), 1024):
        np.maximum(top, np.multiply.outer(own[k : k + 1024], FACTORS).max(axis=0), out=top)
    least = -np.log((top.astype(np.float64) + 0.5) / 2.0**64) / RATE  # the least of exponential values
    with np.errstate(divide="ignore"):
        return np.clip(np.floor(1 - np.log(least) / np.log(BASE)), 0, LIMIT).astype("<u2")


def likely(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of registers and set sizes: the likeliest J, and whether J >= PERCENT / 100 is plausible."""
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    most = np.minimum(u / v, v / u)
    plus, minus = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    same = M - plus - minus
    prob = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def log_likelihood(j: np.ndarray) -> np.ndarray:
        p, q = prob(u - v * j), prob(v - u * j)
        tiny = 1e-12
        return plus * np.log(p + tiny) + minus * np.log(q + tiny) + same * np.log(np.maximum(1 - p - q, 0) + tiny)

    grid = np.linspace(0, 1, 101)[None, :] * most
    values = log_likelihood(grid)
    best = np.take_along_axis(grid, values.argmax(axis=1)[:, None], axis=1)
    least = PERCENT / 100
    high = np.where(grid >= least, values, -np.inf).max(axis=1)
    at = log_likelihood(np.full_like(u, least))[:, 0]
    possible = 100 * np.minimum(n_a, n_b) >= PERCENT * np.maximum(n_a, n_b)
    return best[:, 0], possible & (values.max(axis=1) - np.maximum(high, at) <= MARGIN)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, and for sets that aren't empty their digest ``h`` and ``registers``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, h, regs = [], [], []
            for text in batch.column("text"):
                own = shingles(text.as_py())
                n.append(len(own))
                h.append(_digest(own) if len(own) else None)
                regs.append(registers(own).tobytes() if len(own) else None)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "n_shingles": pa.array(n, pa.int64()), "h": pa.array(h, pa.binary()), "registers": pa.array(regs, pa.binary())})

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, "doc_id long, text_hash long, n_shingles long, h binary, registers binary")


def _bands(classes: DataFrame) -> DataFrame:
    """A row (cid, key, band) for each class and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = np.arange(1, M // ROWS + 1, dtype=np.uint64) * STEP
        for batch in batches:
            regs = np.frombuffer(b"".join(batch.column("registers").to_pylist()), "<u8").reshape(-1, M // ROWS)
            keys = _mixed(regs ^ salts).view(np.int64)
            cid = np.repeat(batch.column("cid").to_numpy(), M // ROWS)
            band = np.tile(np.arange(M // ROWS), batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(cid), pa.array(keys.ravel()), pa.array(band)], names=["cid", "key", "band"])

    return classes.select("cid", "registers").mapInArrow(run, "cid long, key long, band long")


def _plausible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that the registers don't rule out, with the shingles ``n`` of b."""
    side = lambda x: classes.select(F.col("cid").alias(x), F.col("registers").alias(f"r{x}"), F.col("n_shingles").alias(f"n{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                a, b = (np.frombuffer(b"".join(part.column(c).to_pylist()), "<u2").reshape(-1, M) for c in ("ra", "rb"))
                _, kept = likely(a, b, part.column("na").to_numpy().astype(float), part.column("nb").to_numpy().astype(float))
                yield part.select(["a", "b", "nb"]).rename_columns(["a", "b", "n"]).filter(pa.array(kept))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ra", "rb", "na", "nb").mapInArrow(run, "a long, b long, n long")


def _digest(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def _texts(reps: DataFrame, docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """(rep, text) of the doc_ids in ``reps``; of ids in ``repeated`` a row for each different text, of which only that of the class's digest counts."""
    ids = write_table(reps.select("rep").distinct(), "ids")
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(ids, "rep", "left_semi")
    often = texts.join(repeated, "rep", "left_semi").groupBy("rep", F.xxhash64("text")).agg(F.first("text").alias("text")).select("rep", "text")
    return texts.join(repeated, "rep", "left_anti").unionByName(often)


def _confirmed(pairs: DataFrame, docs: DataFrame, repeated: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are linked, from (a, b, n).

    The members b of a leader a come in groups of about GROUP members and
    GROUP_SHINGLES shingles, each with the leader's text, so a leader of very
    many members is spread over many tasks.
    """
    sizes = pairs.groupBy("a").agg(F.expr(f"1 + greatest(count(*) div {GROUP}, sum(n) div {GROUP_SHINGLES})").alias("_parts"))
    dealt = pairs.join(sizes, "a").withColumn("part", F.expr("pmod(xxhash64(b), _parts)"))
    wanted = dealt.select("a", "part", F.col("b").alias("id")).unionByName(dealt.select("a", "part", F.col("a").alias("id")).distinct())

    def verify(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        sets = {i: own for i, text, h in zip(group["id"], group["text"], group["h"], strict=True) if _digest(own := shingles(text)) == bytes(h)}
        lead = sets.pop(key[0])
        out = sorted(i for i, own in sets.items() if linked(lead, own))
        return pd.DataFrame({"a": [key[0]] * len(out), "b": out}, dtype="int64")

    wanted = write_table(wanted.join(classes.select(F.col("cid").alias("id"), "rep", "h"), "id"), "wanted")
    return wanted.join(_texts(wanted, docs, repeated), "rep").select("a", "part", "id", "h", "text").groupBy("a", "part").applyInPandas(verify, "a long, b long")


class _Block:
    """The members of two blocks of a bucket, and the pairs between them that are to be looked at."""

    def __init__(self, t: int, low: int, high: int, group: list[pa.RecordBatch]):
        self.rows = pa.Table.from_batches(group).combine_chunks()
        self.cid, self.component, self.size, n, block, band = (self.rows.column(c).to_numpy() for c in ("cid", "component", "size", "n_shingles", "block", "band"))
        self.n, self.t, self.low, self.high, self.band = n.astype(float), t, low, high, int(band[0])
        self.regs = np.frombuffer(b"".join(self.rows.column("registers").to_pylist()), "<u2").reshape(-1, M)
        self.keys = self.regs.view("<u8")
        self.first, self.second = np.flatnonzero(block == low), np.flatnonzero(block == high)

    def partners(self, x: int, roots: np.ndarray) -> np.ndarray:
        """Members of other roots that the registers don't rule out.

        A pair belongs to the lower of its size classes, to the first band that
        it shares, and within one block to its lesser id: so to one block only.
        """
        y = self.second[(roots[self.second] != roots[x]) & (np.minimum(self.size[self.second], self.size[x]) == self.t)]
        if self.low == self.high:
            y = y[self.cid[y] > self.cid[x]]
        y = y[(self.regs[y] == self.regs[x]).sum(axis=1) >= LEAST_EQUAL]
        y = y[(self.keys[y] == self.keys[x]).argmax(axis=1) == self.band]
        if len(y):
            y = y[likely(np.repeat(self.regs[x][None], len(y), axis=0), self.regs[y], np.full(len(y), self.n[x]), self.n[y])[1]]
        return y

    def involved(self) -> np.ndarray:
        out = np.zeros(len(self.cid), bool)
        for x in self.first:
            y = self.partners(x, self.component)
            out[y] = True
            out[x] |= len(y) > 0
        return out

    def links(self, sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        """Confirmed links that join components; what they join is not looked at again."""
        roots = self.component.copy()
        length = np.fromiter(map(len, sets), np.int64, len(sets))
        for x in self.first:
            y = self.partners(x, roots)
            if not len(y):
                continue
            other = np.concatenate([sets[k] for k in y])
            at = np.minimum(np.searchsorted(sets[x], other), length[x] - 1)
            common = np.add.reduceat((sets[x][at] == other).astype(np.int64), np.cumsum(length[y]) - length[y])
            for k in y[100 * common >= PERCENT * (length[x] + length[y] - common)]:
                if roots[k] != roots[x]:
                    roots[roots == roots[k]] = roots[x]
                    yield int(min(self.cid[x], self.cid[k])), int(max(self.cid[x], self.cid[k]))


def _crossed(members: DataFrame, labels: DataFrame, classes: DataFrame, docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """Links (a, b) between members (cid, key, band) of one bucket that lie in different components.

    A bucket is cut by size: a member of size class t (a factor of 4/3 each)
    can only be linked with members of classes t - 1 to t + 1.  What is left is
    compared in blocks of about BLOCK members, two blocks a group, so groups
    stay small.  Members that have a partner their registers don't rule out
    meet again with their texts; pairs are never emitted, only links.
    """
    names = ["key", "t", "low", "high"]
    named = write_table(_labelled(members, labels, "cid", "component"), "members")
    mixed = named.groupBy("key").agg(F.min("component").alias("_c"), F.max("component").alias("_d")).where("_c < _d").select("key")
    size = F.floor(F.log(F.col("n_shingles")) / F.log(F.lit(100 / PERCENT))).alias("size")
    rows = named.join(mixed, "key", "left_semi").join(classes.select("cid", "rep", "n_shingles", "registers", "h", size), "cid")
    rows = write_table(rows.withColumn("t", F.explode(F.array("size", F.col("size") - 1))), "members")
    counts = rows.groupBy("key", "t").agg(F.min("component").alias("_c"), F.max("component").alias("_d"), F.expr(f"1 + greatest(count(*) div {BLOCK}, sum(n_shingles) div {BLOCK_SHINGLES})").alias("blocks")).where("_c < _d")
    dealt = (
        rows.join(counts.select("key", "t", "blocks"), ["key", "t"])
        .withColumn("block", F.expr("pmod(xxhash64(cid), blocks)"))
        .withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
        .select("key", "t", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "band", "cid", "rep", "component", "size", "n_shingles", "registers", "h")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, low, high, group in _groups(batches, names):
            block = _Block(t, low, high, group)
            kept = block.involved()
            if kept.any():
                yield from block.rows.filter(pa.array(kept)).to_batches()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, low, high, group in _groups(batches, names):
            texts = [x for g in group for x in g.column("text").to_pylist()]
            sets = [shingles(x) for x in texts]
            own = [_digest(s) == h for s, h in zip(sets, (h for g in group for h in g.column("h").to_pylist()), strict=True)]
            rows = pa.Table.from_batches(group).filter(pa.array(own)).combine_chunks()
            if rows.num_rows:
                found = list(_Block(t, low, high, rows.to_batches()).links([s for s, o in zip(sets, own, strict=True) if o]))
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    involved = write_table(dealt.repartition(*names).sortWithinPartitions(*names).mapInArrow(compare, dealt.schema), "involved")
    together = involved.join(_texts(involved, docs, repeated), "rep").repartition(*names).sortWithinPartitions(*names)
    return write_table(together.mapInArrow(verify, "a long, b long").distinct(), "links")


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[int, int, int, list[pa.RecordBatch]]]:
    """From rows sorted by the names: the last three of them, and the group's rows."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        columns = [batch.column(k).to_numpy() for k in names]
        if not batch.num_rows:
            continue
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for start, end in zip([0, *change], [*change, batch.num_rows], strict=True):
            key = tuple(int(c[start]) for c in columns)
            if held and key != last:
                yield *last[1:], held
                held = []
            held.append(batch.slice(start, end - start))
            last = key
    if held:
        yield *last[1:], held


def components(edges: DataFrame) -> DataFrame:
    """From links (a, b), a row (id, component) for each id that isn't its component's least."""
    edges = write_table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        before, edges = edges, write_table(small, "links")
        drop_tables(before)
        now = tuple(edges.agg(F.count("*"), F.sum(F.expr("CAST(xxhash64(u, v) AS decimal(20, 0))"))).first())
        if now == seen:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        seen = now


def _labelled(rows: DataFrame, labels: DataFrame, of: str, name: str) -> DataFrame:
    return rows.join(labels.select(F.col("id").alias(of), F.col("component").alias(name)), of, "left").withColumn(name, F.coalesce(name, of))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash (xxhash64), n_shingles, component_id and kept for each row of ``docs`` (doc_id, text)."""
    small_batches(docs.sparkSession)
    sketches = write_table(sketch(docs), "sketches")
    whole = "h IS NOT NULL AND doc_id IS NOT NULL"
    classes = sketches.where(whole).groupBy("h").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n_shingles"), F.max("registers").alias("registers"))
    classes = write_table(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")  # the numbers hold from here on
    repeated = write_table(sketches.where(whole).groupBy(F.col("doc_id").alias("rep")).agg(F.count("*").alias("n")).where("n > 1").select("rep"), "repeated")
    bands = _bands(classes)
    leaders = bands.groupBy("key").agg(F.min("cid").alias("a"), F.max("cid").alias("_last")).where("a < _last").drop("_last")
    members = bands.join(leaders, "key").where("cid <> a")
    pairs = write_table(members.select("a", F.col("cid").alias("b")).distinct(), "pairs")
    links = write_table(_confirmed(write_table(_plausible(pairs, classes), "pairs"), docs, repeated, classes), "links")
    labels = components(links)

    # what lies in one bucket but in different components
    more = _crossed(bands.join(leaders.select("key"), "key", "left_semi"), labels, classes, docs, repeated)
    labels = components(links.unionByName(more))

    of_class = _labelled(classes.select("h", "rep", "cid"), labels, "cid", "_component")
    least = of_class.groupBy("_component").agg(F.min("rep").alias("component_id"))
    of_class = of_class.join(least, "_component").select("h", "component_id")
    known = sketches.where(whole).select("doc_id", "text_hash", "n_shingles", "h").join(of_class, "h", "left").drop("h")
    alone = sketches.where(f"NOT ({whole})").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"))
    return known.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text_hash")
