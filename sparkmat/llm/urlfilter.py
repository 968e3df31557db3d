"""URL filter: rules first, then the ratio of two character language models.

Rules allow or block a host with all its subdomains under a path prefix; the
longest that fits wins.  URLs under no rule are judged by two smoothed
variable-order Markov models over characters, one of the URLs that the rules
accept and one of those they reject.  Counts of ORDER-grams over SYMBOLS
symbols are summed over all ruled URLs; shorter contexts follow as marginals,
and each order is smoothed towards the next shorter one in proportion to how
rarely its context was seen.  The score is the mean log-likelihood difference
per character; the threshold is calibrated on the ruled URLs of the held-out
fold (crc32 of page_id), by models counted without it, where the sum of both error rates is least.

SYMBOLS ** ORDER bounds what reaches the driver and is broadcast (about 5.8
million numbers), however many URLs there are; a URL's counts are summed in its
task first, so a host that holds a third of all pages loads no task.

Cases: a null URL or one without ``://`` has an empty host and path, fits no
rule, and is scored as text (null: empty, score 0); without accepted or without
rejected URLs every score is 0; a score at the threshold is allowed; equal
longest rules: block wins; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmat.llm.common import table, write_table

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
ORDER = 4
#: Symbol 0 fills the places before the first character, 1 ends a URL, 2 is any character not listed; a rule may turn on one digit, so each is a symbol.
LISTED = "abcdefghijklmnopqrstuvwxyz0123456789/.-_?=&%#:"
SYMBOLS = 49
#: Weight of the shorter context, in observations.
SHORTER = 2.0
BINS, REACH = 4001, 10.0


def _symbols() -> np.ndarray:
    out = np.full(256, 2, np.int64)
    for k, c in enumerate(LISTED):
        out[ord(c)] = 3 + k
    for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        out[ord(c)] = out[ord(c.lower())]
    return out


SYMBOL_OF = _symbols()


def grams(url: str | None) -> np.ndarray:
    """The ORDER-grams that end at each character of the URL and at its end, as numbers below SYMBOLS ** ORDER."""
    raw = SYMBOL_OF[np.frombuffer((url or "").encode("utf-8", "replace"), np.uint8)]
    padded = np.concatenate([np.zeros(ORDER - 1, np.int64), raw, [1]])
    total = np.zeros(len(raw) + 1, np.int64)
    for k in range(ORDER):
        total = total * SYMBOLS + padded[k : k + len(total)]
    return total


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """ln P(last symbol | those before) for every ORDER-gram, from the ORDER-gram counts."""
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for k in range(1, ORDER + 1):
        n = counts.reshape(-1, SYMBOLS**k).sum(axis=0).reshape(-1, SYMBOLS)  # contexts of k - 1 symbols
        shorter = np.tile(p.reshape(-1, SYMBOLS), (SYMBOLS if k > 1 else 1, 1))  # rows: the context without its first symbol
        p = ((n + SHORTER * shorter) / (n.sum(axis=1, keepdims=True) + SHORTER)).ravel()
    return np.log(p)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    host, path = rest[:end], rest[end:]
    return host.encode("utf-8", "replace").lower().decode(), path.split("?", 1)[0].split("#", 1)[0]


class Rules:
    """Rules by host; a URL looks up its host and each parent domain."""

    def __init__(self, rules: list[tuple[str, str]]):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[0] != "block")):
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host, []).append((slash + path, rule, verdict))

    def longest(self, host: str, path: str) -> tuple[str | None, str | None]:
        best: tuple[str | None, str | None] = (None, None)
        name = host
        while name:
            for prefix, rule, verdict in self.by_host.get(name, ()):
                if path.startswith(prefix):
                    if best[0] is None or len(rule) > len(best[0]):
                        best = (rule, verdict)
                    break
            name = name.partition(".")[2]
        return best


@dataclass
class UrlModel:
    """The log-likelihood difference of every ORDER-gram, and the least score that is allowed."""

    difference: np.ndarray
    threshold: float

    def score(self, url: str | None) -> float:
        own = grams(url)
        return float(self.difference[own].mean()) if url else 0.0


def split_and_rule(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """page_id, url, host, path, rule and verdict (both null where no rule fits)."""
    held = Rules(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [split_url(u) for u in batch.column("url").to_pylist()]
            found = [held.longest(*p) for p in parts]
            columns = {"host": [p[0] for p in parts], "path": [p[1] for p in parts], "rule": [f[0] for f in found], "verdict": [f[1] for f in found]}
            yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "url": batch.column("url"), **{k: pa.array(v, pa.string()) for k, v in columns.items()}})

    return pages.select("page_id", "url").mapInArrow(run, f"page_id {dict(pages.dtypes)['page_id']}, url string, host string, path string, rule string, verdict string")


#: Grams of a block of counts.
BLOCK = 2**16
HELD_OUT = "coalesce(crc32(CAST(CAST(page_id AS string) AS binary)) % 5 = 0, false)"


def fit(ruled: DataFrame) -> UrlModel:
    """The models of the URLs with a verdict, from all of them; the threshold is that of models without the held-out fold, on that fold."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: dict[tuple[str, bool], list[np.ndarray]] = {}
            for url, *fold in zip(*(batch.column(c).to_pylist() for c in ("url", "verdict", "held")), strict=True):
                own.setdefault(tuple(fold), []).append(grams(url))
            for (verdict, held), found in own.items():
                gram, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_pydict({"verdict": pa.array([verdict] * len(gram)), "held": pa.array([held] * len(gram)), "gram": pa.array(gram), "n": pa.array(n)})

    known = ruled.where("verdict IS NOT NULL").withColumn("held", F.expr(HELD_OUT))
    summed = known.select("url", "verdict", "held").mapInArrow(count, "verdict string, held boolean, gram long, n long").groupBy("verdict", "held", "gram").agg(F.sum("n").alias("n"))

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"verdict": [key[0]], "held": [key[1]], "block": [key[2]], "grams": [(rows["gram"].to_numpy(np.int64) % BLOCK).astype("<u2").tobytes()], "counts": [rows["n"].to_numpy("<i8").tobytes()]})

    # ten bytes for each gram that occurs, so at most 4 * 10 * SYMBOLS ** ORDER bytes (231 MB) ever reach the driver, a block at a time
    blocks = summed.withColumn("block", F.expr(f"gram div {BLOCK}")).groupBy("verdict", "held", "block").applyInPandas(pack, "verdict string, held boolean, block long, grams binary, counts binary")
    totals: dict[tuple[str, bool], np.ndarray] = {}
    for row in write_table(blocks, "grams").toLocalIterator():
        own = totals.setdefault((row["verdict"], row["held"]), np.zeros(SYMBOLS**ORDER, np.int64))
        own[row["block"] * BLOCK + np.frombuffer(row["grams"], "<u2").astype(np.int64)] += np.frombuffer(row["counts"], "<i8")

    def difference(folds: tuple[bool, ...]) -> np.ndarray | None:
        probabilities = []
        for verdict in ("allow", "block"):
            own = [totals[verdict, held] for held in folds if (verdict, held) in totals]
            if not own:
                return None
            probabilities.append(log_probabilities(sum(own[1:], own[0]).astype(float)))
        return (probabilities[0] - probabilities[1]).astype(np.float32)

    whole, part = difference((False, True)), difference((False,))
    if whole is None:
        return UrlModel(np.zeros(SYMBOLS**ORDER, np.float32), 0.0)
    if part is None:  # a verdict is in the held-out fold only: nothing to calibrate with
        return UrlModel(whole, 0.0)
    width = 2 * REACH / (BINS - 1)
    scored = score_urls(known.where("held"), UrlModel(part, 0.0))
    bins = scored.groupBy("verdict", F.round((F.greatest(F.lit(-REACH), F.least(F.lit(REACH), "score")) + REACH) / width).cast("int").alias("bin")).count().toPandas()
    hist = {v: np.zeros(BINS) for v in ("allow", "block")}
    for row in bins.itertuples():
        hist[row.verdict][row.bin] += row.count
    return UrlModel(whole, _threshold(hist["allow"], hist["block"]) * width - REACH)


def _threshold(allow: np.ndarray, block: np.ndarray) -> float:
    """The bin from which on scores are allowed: least sum of error rates, the middle of the bins that are equally good."""
    if not allow.sum() or not block.sum():
        return (BINS - 1) / 2
    wrong = np.concatenate([[0], np.cumsum(allow)])[:BINS] / allow.sum() + 1 - np.concatenate([[0], np.cumsum(block)])[:BINS] / block.sum()
    good = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    return float((good[0] + good[-1]) / 2)


def score_urls(rows: DataFrame, model: UrlModel) -> DataFrame:
    """``rows`` with ``score``, the mean log-likelihood difference of ``url``."""
    held = rows.sparkSession.sparkContext.broadcast(model)  # SYMBOLS ** ORDER numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [held.value.score(u) for u in batch.column("url").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])

    return rows.mapInArrow(run, rows.withColumn("score", F.lit(0.0)).schema)


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """page_id, url, host, path, rule, verdict and score of every page (page_id, url)."""
    ruled = write_table(split_and_rule(pages, rules), "ruled")  # read by the fit, its calibration and the scores
    model = fit(ruled)
    judged = F.when(F.col("score") >= model.threshold, "allow").otherwise("block")
    return score_urls(ruled, model).withColumn("verdict", F.coalesce("verdict", judged))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")
