"""Byte-level BPE encoding and decoding.

Each match of the split pattern is merged on its own.  A segment tree over the
byte positions of the piece holds, at the leaf of position p, the rank of the
pair that starts with the live token at p; an inner node holds the least rank
below it, and the descent prefers the left child, so the root leads to the
leftmost pair of least rank.  A merge changes three leaves: that of the merged
token, that of its left live neighbour, and that of the token swallowed (which
becomes infinite); each is a point update of logarithmic cost.

The trees of many pieces of like length are held as the columns of one numpy
array and advanced together; a very long piece, or a few of a size, have trees
of their own.  A worker keeps the ids of short chunks of text (CACHED_CHUNKS of
CACHED_CHARS characters at most), never those of long ones.

Cases: a null text is encoded as the empty text (no ids); rows are independent,
so repeated rows and ids are encoded alike; a text of any length is encoded
whole; ids outside the vocabulary raise KeyError on decoding.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from sparkmat.llm.common import small_batches

INF = np.int32(2**31 - 1)
#: Pieces longer than this get a tree of their own, and so do those over SHORT_BYTES of a size that has fewer than MANY pieces.
BATCHED_BYTES, SHORT_BYTES, MANY = 16_384, 64, 24
#: Bytes of the pieces that are advanced together.
TOGETHER_BYTES = 262_144
#: Chunks whose ids a worker keeps before it starts anew, and the longest of them (memory, not results, depends on it).
CACHED_CHUNKS, CACHED_CHARS = 100_000, 64
#: Longer texts are encoded in sections, longer chunks by this many matches at a time.
SECTION_CHARS, LONG_CHARS, MATCHES = 1_000_000, 4096, 20_000
#: The fixed value of the pattern for which SAFE_SPLIT and the shortcut for ASCII letters hold; by any other, texts are split as a whole.
KNOWN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A single space between two characters that aren't white space always begins a match of the known pattern.
SAFE_SPLIT = re.compile(r"(?<=\S) (?=\S)")
DOUBLE_SPACE = re.compile(r"\s\s")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def pair_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys ``left << 32 | right`` of all pairs of tokens that make a token, and its rank."""
    pairs = [
        (ranks[t[:k]] << 32 | ranks[t[k:]], r)
        for t, r in ranks.items()
        for k in range(1, len(t))
        if t[:k] in ranks and t[k:] in ranks
    ]
    pairs.sort()
    return np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int32)


class Bpe:
    """An encoder and decoder for one vocabulary; a worker keeps one for all its tasks."""

    def __init__(self, ranks: dict[bytes, int], pairs: tuple[np.ndarray, np.ndarray], pattern: str):
        self.ranks, self.pattern, self.known = ranks, regex.compile(pattern), pattern == KNOWN_PATTERN
        self.keys, self.values = pairs
        self.pairs = dict(zip(self.keys.tolist(), self.values.tolist(), strict=True))
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        #: The ids of chunks by key; what was in use before the last renewal is looked up in ``old``.
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(left.shape, INF, np.int32)
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], INF)

    def _merge_alone(self, piece: bytes) -> list[int]:
        """One segment tree, for long pieces: 28 to 44 bytes for each of the piece."""
        n, inf, pairs = len(piece), int(INF), self.pairs
        first = self.of_byte[np.frombuffer(piece, np.uint8)]
        size = 1 << max(1, (n - 1).bit_length())
        whole = np.full(2 * size, inf, np.int32)
        for k in range(0, n - 1, 1 << 20):
            part = first[k : k + (1 << 20) + 1]
            whole[size + k : size + k + len(part) - 1] = self._pair_ranks(part[:-1], part[1:])
        level = size
        while level > 1:
            level >>= 1
            whole[level : 2 * level] = np.minimum(whole[2 * level : 4 * level : 2], whole[2 * level + 1 : 4 * level : 2])
        tree, tok = array("i", whole.tobytes()), array("i", first.astype(np.int32).tobytes())
        del whole, first
        nxt, prv = array("i", range(1, n + 1)), array("i", range(-1, n - 1))

        def put(p: int, value: int) -> None:
            x = size + p
            tree[x] = value
            while x > 1:
                x >>= 1
                least = min(tree[2 * x], tree[2 * x + 1])
                if tree[x] == least:
                    break
                tree[x] = least

        while (rank := tree[1]) < inf:
            x = 1
            while x < size:
                x = 2 * x if tree[2 * x] == rank else 2 * x + 1
            p = x - size
            q = nxt[p]
            after, before = nxt[q], prv[p]
            tok[p], tok[q], nxt[p] = rank, -1, after
            put(q, inf)
            if after < n:
                prv[after] = p
                put(p, pairs.get(rank << 32 | tok[after], inf))
            else:
                put(p, inf)
            if before >= 0:
                put(before, pairs.get(tok[before] << 32 | rank, inf))
        return [t for t in tok if t >= 0]

    def _merge_together(self, pieces: list[bytes], size: int) -> np.ndarray:
        """The tokens left at each byte position, -1 where none begins; the trees of all pieces (of at most ``size`` bytes, a power of two) side by side."""
        count, levels = len(pieces), size.bit_length() - 1
        length = np.fromiter(map(len, pieces), np.int64, count)
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(count, size)
        place = np.arange(size)
        inside = place < length[:, None]
        tok = np.full((count, size + 1), -1, np.int64)
        tok[:, :size] = np.where(inside, self.of_byte[raw], -1)
        tree = np.full((count, 2 * size), INF, np.int32)
        tree[:, size : 2 * size - 1] = np.where(inside[:, 1:], self._pair_ranks(tok[:, : size - 1], tok[:, 1:size]), INF)
        for level in range(levels - 1, -1, -1):
            a = 1 << level
            tree[:, a : 2 * a] = np.minimum(tree[:, 2 * a : 4 * a : 2], tree[:, 2 * a + 1 : 4 * a : 2])
        nxt = np.broadcast_to(place + 1, (count, size)).copy()
        prv = np.broadcast_to(np.arange(-1, size), (count, size + 1)).copy()
        flat, width = tree.reshape(-1), 2 * size

        def put(rows: np.ndarray, p: np.ndarray, value: np.ndarray) -> None:
            base, x = rows * width, p + size
            flat[base + x] = value
            for _ in range(levels):
                x >>= 1
                at = base + 2 * x
                flat[base + x] = np.minimum(flat[at], flat[at + 1])

        rows = np.flatnonzero(tree[:, 1] < INF)
        while len(rows):
            base = rows * width
            rank = flat[base + 1]
            x = np.ones(len(rows), np.int64)
            for _ in range(levels):
                x *= 2
                x += flat[base + x] != rank
            p = x - size
            q = nxt[rows, p]
            after, before = nxt[rows, q], prv[rows, p]
            tok[rows, p] = rank
            tok[rows, q] = -1
            nxt[rows, p] = after
            prv[rows, after] = p
            put(rows, q, INF)
            more = after < length[rows]
            put(rows, p, np.where(more, self._pair_ranks(rank.astype(np.int64), tok[rows, after]), INF))
            has = before >= 0
            if has.any():
                r, b = rows[has], before[has]
                put(r, b, self._pair_ranks(tok[r, b], rank[has].astype(np.int64)))
            rows = rows[flat[base + 1] < INF]
        return tok

    def encode_pieces(self, pieces: Iterable[bytes]) -> dict[bytes, bytes]:
        """The ids of each piece as little-endian unsigned 32-bit integers."""
        out: dict[bytes, bytes] = {}
        groups: dict[int, list[bytes]] = {}
        for piece in set(pieces):
            if piece in self.ranks:
                out[piece] = self.ranks[piece].to_bytes(4, "little")
            else:
                groups.setdefault(1 << max(1, (len(piece) - 1).bit_length()), []).append(piece)
        for size, group in groups.items():
            if size > BATCHED_BYTES or size > SHORT_BYTES and len(group) < MANY:
                out.update((piece, np.array(self._merge_alone(piece), "<u4").tobytes()) for piece in group)
                continue
            count = max(MANY, TOGETHER_BYTES // size)
            for k in range(0, len(group), count):
                part = group[k : k + count]
                tok = self._merge_together(part, size)
                live = tok >= 0
                ids, ends = tok[live].astype("<u4").tobytes(), (4 * np.cumsum(live.sum(axis=1))).tolist()
                out.update(zip(part, map(ids.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each whole text, as bytes of little-endian unsigned 32-bit integers.

        A text falls into chunks, each a space and what follows it up to the
        next; a chunk's key is the chunk without that space.  The first chunk
        has no space before it: its key is a space and the chunk, which no
        other key can equal, as none begins with a space.
        """
        if len(self.cache) > CACHED_CHUNKS:
            self.old, self.cache = self.cache, {}
        cache, old, chunked = self.cache, self.old, []
        unseen: set[str] = set()
        for text in texts:
            plain = not DOUBLE_SPACE.search(text) and not text[:1].isspace() and not text[-1:].isspace()
            keys = [text] if not self.known else text.split(" ") if plain else SAFE_SPLIT.split(text)
            keys[0] = " " + keys[0]
            chunked.append(keys)
            unseen.update(set(keys).difference(cache))
        wanted: dict[str, list[bytes]] = {}
        long: dict[str, bytes] = {}  # what isn't kept
        for key in unseen:
            if key in old:
                cache[key] = old[key]
            elif self.known and key.isascii() and key.isalpha():  # one match of the pattern
                wanted[key] = [b" " + key.encode()]
            elif len(key) > LONG_CHARS:
                long[key] = self._encode_long(key[1:] if key[0] == " " else " " + key)
            else:
                chunk = key[1:] if key[0] == " " else " " + key
                wanted[key] = [m.encode("utf-8", "replace") for m in self.pattern.findall(chunk)]
        merged = self.encode_pieces(p for own in wanted.values() for p in own)
        for key, own in wanted.items():
            ids = merged[own[0]] if len(own) == 1 else b"".join([merged[p] for p in own])
            (cache if len(key) <= CACHED_CHARS else long)[key] = ids
        if not long:
            return [b"".join(map(cache.__getitem__, keys)) for keys in chunked]
        return [b"".join([cache[k] if k in cache else long[k] for k in keys]) for keys in chunked]

    def _encode_long(self, chunk: str) -> bytes:
        """The ids of a long chunk, whose matches aren't held all at once."""
        out, own = [], []
        for m in self.pattern.finditer(chunk):
            own.append(m[0].encode("utf-8", "replace"))
            if len(own) == MATCHES:
                merged = self.encode_pieces(own)
                out.append(b"".join(map(merged.__getitem__, own)))
                own = []
        merged = self.encode_pieces(own)
        return b"".join([*out, *map(merged.__getitem__, own)])

    def encode(self, text: str) -> bytes:
        """The ids of one text of any length, by sections that begin where a match begins."""
        out, at = [], 0
        while self.known and len(text) - at > SECTION_CHARS and (m := SAFE_SPLIT.search(text, at + SECTION_CHARS)):
            out += self.encode_batch([text[at : m.start()]])
            at = m.start()
        return b"".join([*out, *self.encode_batch([text[at:]])])

    def decode(self, ids: bytes) -> bytes:
        of, whole = self.bytes_of.__getitem__, np.frombuffer(ids, "<u4")
        return b"".join([b"".join(map(of, whole[k : k + SECTION_CHARS].tolist())) for k in range(0, len(whole), SECTION_CHARS)])


_HELD: dict[int, Bpe] = {}


def _bpe(key: int, value: tuple) -> Bpe:
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Bpe(*value)
    return _HELD[key]


def _slices(batch: pa.RecordBatch, bytes_at_once: int = 800_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Row ranges of about so many characters, with their texts."""
    texts = [t or "" for t in batch.column("text").to_pylist()]
    start = held = 0
    for k, t in enumerate(texts):
        held += len(t)
        if held >= bytes_at_once or k == len(texts) - 1:
            yield batch.slice(start, k + 1 - start), texts[start : k + 1]
            start, held = k + 1, 0


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, digests: bool = True, id_column: str = "doc_id") -> DataFrame:
    """Encode the whole ``text`` of each row by the vocabulary file, decode the ids again.

    Returns ``id_column`` and n_tokens with, for ``digests``, ids_sha256 and
    decoded_sha256; otherwise ids (array of long) and decoded (binary).  Other
    columns of ``docs`` are not read.  A narrow map: no shuffle, and a lost
    task is simply run again.
    """
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    ranks = load_ranks(vocabulary)  # on the driver, whose path it is
    held = spark.sparkContext.broadcast((ranks, pair_table(ranks), pattern))  # the vocabulary: about 50,000 tokens
    key = hash((vocabulary, pattern, len(ranks)))
    kind = dict(docs.dtypes)[id_column]
    schema = f"{id_column} {kind}, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<long>, decoded binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(key, held.value)
        for whole in batches:
            for batch, texts in _slices(whole):
                ids = bpe.encode_batch(texts) if len(texts) > 1 else [bpe.encode(texts[0])]
                decoded = [bpe.decode(i) for i in ids]
                columns = {id_column: batch.column(id_column), "n_tokens": pa.array([len(i) // 4 for i in ids], pa.int64())}
                if digests:
                    columns["ids_sha256"] = pa.array([hashlib.sha256(i).hexdigest() for i in ids])
                    columns["decoded_sha256"] = pa.array([hashlib.sha256(d).hexdigest() for d in decoded])
                else:
                    columns["ids"] = pa.array([np.frombuffer(i, "<u4").astype(np.int64) for i in ids], pa.list_(pa.int64()))
                    columns["decoded"] = pa.array(decoded, pa.binary())
                yield pa.RecordBatch.from_pydict(columns)
        bpe.old = {}  # an idle worker keeps one generation only

    return docs.select(id_column, "text").mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, vocabulary: str, id_column: str = "doc_id") -> DataFrame:
    """From rows with ``ids`` (array of long; null: none) the rows' bytes, as column ``decoded``."""
    held = encoded.sparkSession.sparkContext.broadcast({r: t for t, r in load_ranks(vocabulary).items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [b"".join([held.value[i] for i in ids or ()]) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({id_column: batch.column(id_column), "decoded": pa.array(out, pa.binary())})

    return encoded.select(id_column, "ids").mapInArrow(run, f"{id_column} {dict(encoded.dtypes)[id_column]}, decoded binary")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
