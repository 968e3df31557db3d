"""The registered queries themselves: SQL, brute force on sf0.001, and floors on held-out labels."""

import glob
import hashlib
import os
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from sparkmat.llm import bpe, neardup, registry, subword, toxicity, urlfilter

from tests.llm.test_edges import brute_components

SF = "/root/testdata/sf0.001"


def rows_of(spark, name, *columns, sf=SF):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/{name}.parquet").select(*columns).collect()]


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).split('.')[0]} AS SELECT * FROM '{path}'")
    got = registry.QUERIES[name](spark, SF)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.ORACLE_SQL[name]})").fetchall()
    assert Counter(map(tuple, got.collect())) == Counter(want) and want


def test_op4(spark):
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = []
    for i, text in rows_of(spark, "documents", "doc_id", "text"):
        ids = np.array(library.encode_ordinary(text or ""), "<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, registry.QUERIES["op4_bpe"](spark, SF).collect())) == sorted(want)


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_op7(spark, sf):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.op7_near_duplicates(spark, sf).collect()}
    assert got == brute_components(rows_of(spark, "documents", "doc_id", "text", sf=sf))
    assert any(not kept for _, _, kept in got.values())


def test_op8(spark):
    """Every verdict from counts, likelihoods and a threshold worked out without Spark."""
    pages = rows_of(spark, "pages", "page_id", "url")

    def rule_of(host, path):
        fits = [(len(r), v == "block", r, v) for v, r in urlfilter.RULES for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        return max(fits)[2:] if fits else (None, None)

    judged = [(i, u, *urlfilter.split_url(u), *rule_of(*urlfilter.split_url(u))) for i, u in pages]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0

    def difference(rows):
        tables = []
        for verdict in ("allow", "block"):
            counts = np.zeros(urlfilter.SYMBOLS**urlfilter.ORDER)
            for r in rows:
                if r[5] == verdict:
                    np.add.at(counts, urlfilter.grams(r[1]), 1)
            tables.append(urlfilter.log_probabilities(counts))
        return (tables[0] - tables[1]).astype(np.float32)

    whole, part = difference(judged), difference([r for r in judged if not held(r[0])])
    width = 2 * urlfilter.REACH / (urlfilter.BINS - 1)
    scores = [(r[5], round((float(part[urlfilter.grams(r[1])].mean()) + urlfilter.REACH) / width)) for r in judged if r[5] and held(r[0])]
    wrong = [sum(v == "allow" and b < t for v, b in scores) / max(1, sum(v == "allow" for v, _ in scores)) + sum(v == "block" and b >= t for v, b in scores) / max(1, sum(v == "block" for v, _ in scores)) for t in range(urlfilter.BINS)]
    good = [t for t, w in enumerate(wrong) if w <= min(wrong) + 1e-12]
    two_sided = {v for v, _ in scores} == {"allow", "block"}
    threshold = (good[0] + good[-1]) / 2 * width - urlfilter.REACH if two_sided else 0.0
    want = {i: (host, path, rule, verdict or ("allow" if float(whole[urlfilter.grams(u)].mean()) >= threshold else "block")) for i, u, host, path, rule, verdict in judged}
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.op8_url_filter(spark, SF).collect()} == want
    assert {w[2] is None for w in want.values()} == {True, False}


def test_op8_ties_long_urls_and_repeated_rows(spark):
    rules = urlfilter.Rules([("allow", "a.org/x"), ("block", "a.org/x"), ("allow", "org/aaaaa")])
    assert rules.longest("a.org", "/xy") == ("a.org/x", "block")
    long = "http://a.org/" + "x/" * 500_000
    rows = [(1, long), (1, long), (2, "http://b.com/de/1"), (None, "http://c.net/"), (3, None)]
    got = urlfilter.filter_urls(spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, host string"), urlfilter.RULES).collect()
    assert Counter((r.page_id, r.rule) for r in got) == Counter([(1, "org/"), (1, "org/"), (2, "com/de/"), (None, None), (3, None)])


@pytest.fixture(scope="module")
def known(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r[0]: r[1:] for r in rows_of(spark, "labels", "doc_id", "quality", "toxic", sf=sf)}
    return sf, labels, {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in labels}


def test_op1(spark, known):
    sf, labels, held = known
    docs, table = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in toxicity.op1_toxicity(spark, sf).collect()}
    toxic, clean = ([i for i in labels if held[i] and labels[i][1] == y] for y in (1, 0))
    assert sum(got[i].toxic for i in toxic) >= 0.6 * len(toxic) and sum(got[i].toxic for i in clean) <= 0.02 * len(clean)
    # toxic texts of good quality hold toxic words
    assert np.mean([got[i].toxic for i in labels if labels[i] == (1, 1)]) >= 0.9
    chain = toxicity.fit(docs, table)
    for i, text in rows_of(spark, "documents", "doc_id", "text", sf=sf)[:150]:  # the chain, link by link
        used, earlier = toxicity.features(text), []
        for link in chain.links:
            z = link.bias + float(link.weights[used].sum()) + sum(w * p for w, p in zip(link.earlier, earlier, strict=True))
            earlier.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        assert (got[i].p_low_quality, got[i].p_toxic) == pytest.approx(earlier, abs=1e-4) and got[i].toxic == (earlier[-1] >= chain.threshold)


def test_op6(spark, known):
    sf, labels, held = known
    got = {r.doc_id: r for r in subword.op6_quality_classifier(spark, sf).collect()}
    assert all(got[i].held_out == held[i] for i in labels)
    right = [got[i].predicted == labels[i][0] for i in labels if held[i]]
    assert np.mean(right) >= 0.97
    model = subword.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    for i, text in rows_of(spark, "documents", "doc_id", "text", sf=sf)[:300]:
        used, share = subword.features(text)
        score = 1 / (1 + np.exp(-(model.bias + float((model.outputs[used] * share).sum()))))
        assert got[i].score == pytest.approx(score, abs=1e-3) and got[i].predicted == (got[i].score >= 0.3)
