"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from sparkmat.llm import bpe, chat, decontam, htmltext, linededup, neardup, quality, subword, toxicity, urlfilter

P = pytest.importorskip("public_tokenizers")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "the quick brown fox jumps over the lazy dog and runs to the river of stones with a bird in its mouth"


def random_text(rng, n):
    return " ".join(rng.choice(["alpha", "Beta", "the", "of", "x1", "éa", "--", "a.b", "ß"]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = [random_text(rng, n) for n in (1, 3, 5, 12, 40, 60, 90)]
    long = random_text(rng, 6000)
    lined = "\n".join([base[4], "Same line here!", "  same LINE here! ", "", base[5]])
    return [(1, base[0]), (2, None), (3, ""), (4, " \n\t "), (5, base[4]), (6, base[4]), (6, base[4]), (None, base[5]), (8, long), (9, lined), (10, base[6] + " " + base[4]),
            (11, "Same line here!\nother words that stand alone"), (12, long.replace("alpha", "omega", 3)), (13, "漢字かな交じり文 😀 a\x00b")]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def key(row):
    return tuple((v is not None, v) for v in row)


def test_bpe(docs, texts, none):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    got = bpe.encode_documents(docs, path, P.PATTERN, digests=False).collect()
    want = [(i, library.encode_ordinary(t or "")) for i, t in texts]
    assert sorted(((r.doc_id, list(r.ids)) for r in got), key=key) == sorted(want, key=key)
    assert all(bytes(r.decoded) in {(t or "").encode() for _, t in texts} for r in got)
    assert bpe.encode_documents(none, path, P.PATTERN).collect() == []


def test_bpe_pieces_like_the_library():
    import tiktoken

    ranks = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    own = bpe.Bpe(ranks, bpe.pair_table(ranks), P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(5)
    alphabet = "ab '  \n\t\r\x0b\x1c\x1f\x85\xa0éß1٣²中😀slld.,!-‍﻿"
    for text in ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(400)] + ["a" * 700, "ab" * 300, " " * 90]:
        ids = own.encode_batch([text])[0]
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_bpe_of_long_texts(monkeypatch):
    """Sections, long chunks, many long pieces at once, other patterns; and what a worker keeps of text without spaces."""
    import tiktoken

    ranks = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    pairs = bpe.pair_table(ranks)
    rng = random.Random(6)
    prose = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 9))) for _ in range(3000))
    unspaced = ["".join(rng.choice("etaoinshrdlué漢") for _ in range(n)) for n in [700] * 40 + [3000] * 3 + [40_000]]
    dotted = "".join(rng.choice(["ab", "cd", ".", "1", "漢字"]) for _ in range(9000))
    texts = [prose, " ".join(unspaced[:44]), dotted, prose + unspaced[-1] + " " + prose, "x" * 70_000]
    for pattern in (P.PATTERN, r"\p{L}+|[^\p{L}]+"):
        library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        own = bpe.Bpe(ranks, pairs, pattern)
        for size in (1_000_000, 500):
            monkeypatch.setattr(bpe, "SECTION_CHARS", size)
            monkeypatch.setattr(bpe, "MATCHES", size)
            for text in texts:
                ids = own.encode(text)
                assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
                assert own.decode(ids) == text.encode()
    assert P.PATTERN == bpe.KNOWN_PATTERN
    monkeypatch.undo()
    own = bpe.Bpe(ranks, pairs, P.PATTERN)
    for k in range(20):
        own.encode_batch([" ".join("".join(rng.choice("abcdefgh") for _ in range(2000)) for _ in range(20))])
    assert sum(map(len, own.cache)) < 1000


def test_bpe_decodes_what_it_encodes(spark, docs, texts, none):
    path = P.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode_documents(docs, path, P.PATTERN, digests=False).drop("decoded")
    got = Counter((r.doc_id, bytes(r.decoded)) for r in bpe.decode_documents(encoded, path).collect())
    assert got == Counter((i, (t or "").encode()) for i, t in texts)
    null = spark.createDataFrame([(1, None, "x"), (2, [], "y")], "doc_id long, ids array<long>, decoded string")
    assert [bytes(r.decoded) for r in bpe.decode_documents(null, path).collect()] == [b"", b""]
    assert bpe.decode_documents(encoded.limit(0), path).collect() == []


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute_contamination(texts, items, window=10):
    windows = defaultdict(set)
    for item, text in items:
        words = WORD.findall(lower(text))
        size = min(window, len(words))
        for k in range(len(words) - size + 1) if words else ():
            windows[tuple(words[k : k + size])].add(item)
    out = []
    for doc, text in texts:
        words, hit, found = WORD.findall(lower(text)), set(), set()
        for size in {len(w) for w in windows}:
            for k in range(len(words) - size + 1):
                if own := windows.get(tuple(words[k : k + size])):
                    found |= own
                    hit |= set(range(k, k + size))
        ids = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(words), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


def brute_near(text, items, window=10, near=20):
    """The number of items with a window whose words stand within ``near`` words."""
    words, found = WORD.findall(lower(text)), set()
    whole = set(words)
    spans = [frozenset(words[k : k + near]) for k in range(max(1, len(words) - near + 1))]
    for item, own in items:
        own = WORD.findall(lower(own))
        size = min(window, len(own))
        wanted = [w for k in range(len(own) - size + 1) if (w := set(own[k : k + size])) and w <= whole]
        if item is not None and any(w <= s for w in wanted for s in spans):
            found.add(item)
    return len(found)


@pytest.mark.parametrize("sizes", [(40_000, 200_000, 20_000), (50, 60, 25)])
def test_decontamination(spark, docs, texts, none, monkeypatch, sizes):
    """By one block, and by many with items in pieces."""
    monkeypatch.setattr(decontam, "SEGMENT_WORDS", sizes[0])
    monkeypatch.setattr(decontam, "BLOCK_WORDS", sizes[1])
    monkeypatch.setattr(decontam, "PIECE_WORDS", sizes[2])
    items = [(1, texts[4][1]), (2, "éa"), (2, "x1 the"), (None, "beta beta"), (7, None), (8, "..."), (9, texts[8][1][100:400]), (9, texts[8][1][100:400])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    shuffled = texts[4][1].split()
    shuffled = " ".join([*shuffled[9::-1], "omega", *shuffled[10:]])
    items.append((10, shuffled))
    assert decontam.blocks_of(bench, 10)[1] == 1 or sizes[1] == 60
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.find_contamination(decontam.build_index(docs), bench).drop("spans", "items", "near").collect()
    want = [(*w, brute_near(t, items)) for w, (_, t) in zip(brute_contamination(texts, items), texts, strict=True)]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert any(r.n_near > r.n_items for r in got)
    assert decontam.find_contamination(decontam.build_index(none), bench).collect() == []
    clean = decontam.find_contamination(decontam.build_index(docs), bench.limit(0))
    assert not any(r.contaminated for r in clean.collect())


def test_decontamination_of_the_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = [tuple(r) for r in decontam.op2_decontamination(spark, sf).collect()]
    want = [(*w, brute_near(t, items)) for w, (_, t) in zip(brute_contamination(rows, items), rows, strict=True)]
    assert sorted(got) == sorted(want) and any(r[5] for r in got)


@pytest.mark.parametrize("block", [200_000, 1])
def test_proximity(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_WORDS", block)
    texts = [(1, "a b c d e f a"), (2, "c x x x x a"), (3, None), (4, "b a")]
    index = decontam.build_index(spark.createDataFrame(texts, "doc_id long, text string"))
    got = {(r.doc_id, r.query_id, r.start, r.end) for r in decontam.find_proximity(index, spark.createDataFrame([(1, "a c"), (2, "zz"), (3, "")], "item_id long, text string"), 3).collect()}
    want = set()
    for doc, text in texts:
        words = (text or "").split()
        for k, w in enumerate(words):
            if w in ("a", "c"):
                rest = [i for i in range(k, min(len(words), k + 3)) if {"a", "c"} <= set(words[k : i + 1])]
                if rest:
                    want.add((doc, 1, k, rest[0] + 1))
    assert got == want


def test_quality(spark, docs, texts, none):
    got = quality.judge(docs.withColumn("kept", docs.text).withColumn("n_words", docs.text)).collect()
    words = re.compile(r"[^\x20\x09-\x0D]+")
    want = []
    for _, text in texts:
        own = words.findall(text or "")
        grams = list(zip(own, own[1:], own[2:]))  # noqa: B905
        n = Counter(grams)
        covered = {k + o for k, g in enumerate(grams) if n[g] > 1 for o in range(3)}
        lines = [x for x in (text or "").split("\n") if words.search(x)]
        failed = len(own) < 50 or 100 * len(covered) > 50 * len(own)
        want.append((len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed))
    assert sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == sorted(want)
    assert all(not r.kept for r in got if r.base_failed)
    assert quality.judge(none).collect() == []


def test_quality_rejects_what_diverges(spark):
    rng = random.Random(7)
    common = quality.COMMON_WORDS["en"]

    def prose():
        return " ".join(rng.choice(common) if rng.random() < 0.3 else "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 9))) for _ in range(150))

    rows = [(k, prose(), "en") for k in range(60)]
    rows += [(100, prose().upper(), "en"), (101, " ".join(f"{w}%%%%%%" for w in prose().split()), "en"), (102, prose(), None)]
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[k] for k in range(60)) and not got[100] and not got[101]


def test_line_dedup_and_its_reversal(spark, docs, texts, none):
    con = duckdb.connect()
    import pandas as pd

    documents = pd.DataFrame([t for t in texts if t[0] is not None and t[0] != 6] + [(6, texts[5][1])], columns=["doc_id", "text"])  # noqa: F841  DuckDB reads it
    want = {r[0]: r[1:] for r in con.execute(linededup.OP9_SQL).fetchall()}
    frame = spark.createDataFrame([(i, t) for i, t in texts if i != 6] + [(6, texts[5][1])], "doc_id long, text string")
    whole = linededup.build_index(frame)

    def outcome(index, rows=frame):
        return {r.doc_id: (r.n_lines, r.n_dropped, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in linededup.dedup_lines(rows, index).collect() if r.doc_id is not None}

    assert outcome(whole) == want
    first = frame.where("doc_id < 9")
    grown = linededup.insert_documents(linededup.build_index(first), frame.where("doc_id >= 9"))
    assert outcome(grown) == want
    back = linededup.delete_documents(grown, frame.where("doc_id >= 9"))
    assert outcome(back, first) == outcome(linededup.build_index(first), first)
    assert linededup.dedup_lines(none, linededup.build_index(none)).collect() == []
    kept = linededup.dedup_lines(docs.withColumn("n_lines", docs.lang), linededup.build_index(docs))
    assert kept.count() == docs.count() and set(kept.columns) == {*docs.columns, "n_lines", "n_dropped"}


def test_line_dedup_of_many_shards_that_grow(spark, monkeypatch):
    """Shards of few keys, in parts; inserts that outgrow the filters and then the shards; all by way of filters."""
    rng = random.Random(5)
    lines = [f"a line of text number {k}" for k in range(400)]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(12)) + "\na line found in every one") for i in range(120)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(linededup, "SHARD_KEYS", 8)
    monkeypatch.setattr(linededup, "PART_ROWS", 20)
    first = linededup.build_index(frame.where("doc_id < 10"))
    some = linededup.insert_documents(first, frame.where("doc_id >= 10 AND doc_id < 14"))
    grown = linededup.insert_documents(some, frame.where("doc_id >= 14"))
    assert first.n_shards <= some.n_shards < grown.n_shards
    con = duckdb.connect()
    documents = frame.toPandas()  # noqa: F841  DuckDB reads it
    want = {r[0]: r[1:] for r in con.execute(linededup.OP9_SQL).fetchall()}

    def outcome(index):
        return {r.doc_id: (r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in linededup.dedup_lines(frame, index).collect()}

    assert outcome(grown) == want == outcome(linededup.build_index(frame))
    passed = {(r.k1, r.k2) for r in linededup._maybe_shared(grown).collect()}
    shared = {(r.k1, r.k2) for r in grown.shared.collect()}
    assert shared <= passed and len(passed) < grown.references.select("k1", "k2").distinct().count()


def test_cuckoo_filter():
    keys = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 5000)
    made = linededup.CuckooFilter.of(keys)
    assert made.contains(keys).all()
    other = np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 5000)
    assert made.contains(other).mean() < 0.01
    mark, first, _ = made._places(keys[:2500])
    assert all(made.delete(m, b) for m, b in zip(mark.tolist(), first.tolist(), strict=True))
    assert made.contains(keys[2500:]).all() and made.contains(keys[:2500]).mean() < 0.05


def brute_components(texts):
    sets = {}
    for i, text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        k = min(5, len(words))
        sets[i] = frozenset(tuple(words[x : x + k]) for x in range(len(words) - k + 1)) if words else frozenset()
    links = []
    for a in sets:
        for b in sets:
            few, many = sorted((len(sets[a]), len(sets[b])))
            if a < b and few and 100 * few >= 75 * many:
                common = len(sets[a] & sets[b])
                if 100 * common >= 75 * (few + many - common):
                    links.append((a, b))
    least, changed = {i: i for i in sets}, True
    while changed:
        changed = False
        for a, b in links:
            if least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                changed = True
    return {i: (len(sets[i]), least[i], least[i] == i) for i in sets}


def test_near_duplicates(spark, docs, texts, none, monkeypatch):
    rng = random.Random(11)
    family = []
    core = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
    for k in range(60):  # copies with few and many edits, and texts that share half
        words = core.copy() if k % 3 else core[:60] + [f"v{rng.randint(0, 10**6)}" for _ in range(60)]
        for _ in range(k % 7):
            words[rng.randrange(120)] = f"u{rng.randint(0, 10**6)}"
        family.append((100 + k, " ".join(words)))
    rows = [t for t in texts if t[0] is not None and t[0] != 6] + [(6, texts[5][1]), *family]
    for block in (1024, 4):
        monkeypatch.setattr(neardup, "BLOCK", block)
        frame = spark.createDataFrame(rows + [(None, "x")], "doc_id long, text string")
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(frame).collect()}
        assert got.pop(None) == (1, None, True)
        assert got == brute_components(rows)
    assert neardup.near_duplicates(none).collect() == []


def test_near_duplicates_with_one_id_for_two_texts(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    rows = [(5, a), (5, b), (5, a), (3, a + " more"), (4, "some " + b), (7, a), (8, b)]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, h string, component_id int")
    got = Counter((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(frame).collect())
    assert got == Counter([(5, 3, False), (5, 4, False), (5, 3, False), (3, 3, True), (4, 4, True), (7, 3, False), (8, 4, False)])


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(3)
    for overlap in (0.3, 0.6, 0.9):
        pool = rng.integers(0, 2**63, 4000, dtype=np.uint64)
        n = int(2000 * 2 * overlap / (1 + overlap))
        a, b = np.unique(pool[:2000]), np.unique(pool[2000 - n : 4000 - n])
        ra, rb = neardup.registers(a), neardup.registers(b)
        assert (np.maximum(ra, rb) == neardup.registers(np.union1d(a, b))).all()
        j, _ = neardup.likely(ra[None], rb[None], np.array([2000.0]), np.array([2000.0]))
        assert abs(j[0] - overlap) < 0.2


def test_toxicity(spark, none):
    rng = random.Random(2)
    words = [f"word{k}" for k in range(300)]
    texts, toxic = [], []
    for k in range(500):
        own = rng.choices(words, k=60)
        toxic.append(float(k % 5 == 0))
        if toxic[-1]:
            own[5], own[30] = rng.choice(["vileness", "vilest", "scumbag"]), "vileword"
        texts.append(" ".join(own))
    quality_low = np.array([float(k % 7 == 0) for k in range(500)])
    chain = toxicity.train_chain([toxicity.features(t) for t in texts], {"low_quality": quality_low, "toxic": np.array(toxic)})
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(900, None), (901, ""), (None, texts[0]), (902, " ".join(texts) * 20), (903, texts[1]), (903, texts[0])], "doc_id long, text string")
    clashing = frame.withColumns({"flagged": frame.text, "p_toxic": frame.text})
    rows = toxicity.score_documents(clashing, chain).collect()
    got = {r.doc_id: r.flagged for r in rows}
    assert got[902] and sorted(r.flagged for r in rows if r.doc_id == 903) == [False, True]
    assert np.mean([got[k] == bool(toxic[k]) for k in range(500)]) > 0.98
    assert got[None] and not got[900] and not got[901]
    labels = spark.createDataFrame([(k, 1, int(toxic[k]), "x") for k in range(500)] + [(903, 1, 1, "x"), (None, 1, 1, "x"), (904, None, 1, "x")], "doc_id long, quality int, toxic int, text string")
    fitted = toxicity.fit(clashing.unionByName(clashing), labels)  # repeated ids are trained on once
    once = toxicity.fit(frame, labels)
    assert fitted.threshold == once.threshold and all((x.weights == y.weights).all() for x, y in zip(fitted.links, once.links, strict=True))
    empty = toxicity.fit(none, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert not any(r.flagged for r in toxicity.score_documents(frame, empty).collect())
    assert toxicity.score_documents(none, chain).collect() == []


def test_subword_scores_agree(spark, none):
    rng = random.Random(4)
    good = [" ".join(rng.choices(["plain", "prose", "reads", "well", "enough"], k=40)) for _ in range(120)]
    bad = [" ".join(w + "***" for w in rng.choices(["junk", "noise", "spam"], k=40)) for _ in range(120)]
    model = subword.train([subword.features(t) for t in good + bad], np.array([1.0] * 120 + [0.0] * 120))
    rows = [(0, good[0]), (1, bad[0]), (2, None), (3, ""), (4, "one"), (5, good[1] + " " + bad[1]), (6, " ".join(good + bad) * 10), (None, "plain")]
    frame = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, score string")
    got = {r.doc_id: r.score for r in subword.score_documents(frame, model).collect()}
    labels = spark.createDataFrame([(0, 1), (1, 0), (5, 1), (5, 1), (6, None)], "doc_id long, quality int")
    once, twice = (subword.fit(f, labels) for f in (frame, frame.unionByName(frame)))
    assert once.bias == twice.bias and (once.outputs == twice.outputs).all()
    for i, text in rows:
        used, share = subword.features(text)
        assert got[i] == pytest.approx(1 / (1 + np.exp(-(model.bias + (model.outputs[used] * share).sum()))), abs=1e-4)
    assert got[0] > 0.9 and got[1] < 0.1
    assert subword.score_documents(none, model).collect() == []
    assert subword.train([], np.array([])).bias == pytest.approx(0, abs=1e-5)


def test_url_rules_and_models(spark):
    cases = {
        None: ("", "", None), "nothing": ("", "", None), "http://Example.ORG/es/x?q#f": ("example.org", "/es/x", "example.org/es/"), "https://a.org/": ("a.org", "/", "org/"),
        "http://a.org": ("a.org", "", None), "http://forg/": ("forg", "/", None), "http://m.example.org/en/12": ("m.example.org", "/en/12", "example.org/en/1"),
        "http://x.com/de/#y": ("x.com", "/de/", "com/de/"), "http://x.net?u=://org/": ("x.net", "", None),
    }
    rules = urlfilter.Rules(urlfilter.RULES)
    for url, (host, path, rule) in cases.items():
        assert urlfilter.split_url(url) == (host, path) and rules.longest(host, path)[0] == rule
    rng = random.Random(6)
    urls = [f"http://{'good' if k % 2 else 'spam'}{rng.randint(0, 99)}.{'org' if k % 2 else 'com'}/{'' if k % 2 else 'de/'}{'read' if k % 2 else 'buy'}{k}" for k in range(300)]
    urls += ["http://n.net/read1", "http://n.net/de/buy2", None, "x"]
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)], "page_id long, url string, score string")
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.filter_urls(pages, urlfilter.RULES).collect()}
    assert len(got) == len(urls) and got[300] == (None, "allow") and got[301] == (None, "block")
    assert all(got[k][1] == ("allow" if k % 2 else "block") for k in range(300))
    assert urlfilter.filter_urls(pages.limit(0), urlfilter.RULES).collect() == []


def test_url_model_tells_digits_apart(spark):
    """A rule that only a digit tells from its neighbours is learned for hosts under no rule."""
    urls = [f"http://example.org/en/{k % 9 + 1}" for k in range(900)] + [f"http://example.net/en/{d}" for d in range(1, 10)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.url: r.verdict for r in urlfilter.filter_urls(pages, urlfilter.RULES).where("rule IS NULL").collect()}
    assert got == {f"http://example.net/en/{d}": "block" if d == 1 else "allow" for d in range(1, 10)}


def test_url_model_counts_all_ruled_urls(spark):
    urls = [f"http://{'a.org/' if k % 2 else 'b.com/de/'}{k}" for k in range(60)]
    ruled = urlfilter.split_and_rule(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), urlfilter.RULES)
    tables = [urlfilter.log_probabilities(np.bincount(np.concatenate([urlfilter.grams(u) for u in urls[k::2]]), minlength=urlfilter.SYMBOLS**urlfilter.ORDER).astype(float)) for k in (1, 0)]
    assert np.allclose(urlfilter.fit(ruled).difference, tables[0] - tables[1], atol=1e-5)


def test_character_model_by_brute_force():
    urls = ["http://a.b/c1", "ab", "ba/ab"]
    counts = np.bincount(np.concatenate([urlfilter.grams(u) for u in urls]), minlength=urlfilter.SYMBOLS**urlfilter.ORDER).astype(float)
    table = urlfilter.log_probabilities(counts)
    seen = Counter()
    for u in urls:
        symbols = [0] * (urlfilter.ORDER - 1) + [int(urlfilter.SYMBOL_OF[b]) for b in u.encode()] + [1]
        for k in range(urlfilter.ORDER - 1, len(symbols)):
            for n in range(urlfilter.ORDER):
                seen[tuple(symbols[k - n : k + 1])] += 1
                seen["context", tuple(symbols[k - n : k])] += 1

    def p(context, x):
        shorter = p(context[1:], x) if context else 1 / urlfilter.SYMBOLS
        return (seen[(*context, x)] + urlfilter.SHORTER * shorter) / (seen["context", context] + urlfilter.SHORTER)

    for u in ("ab", "zz", "http"):
        symbols = [0] * 3 + [int(urlfilter.SYMBOL_OF[b]) for b in u.encode()] + [1]
        for gram, k in zip(urlfilter.grams(u), range(3, len(symbols)), strict=True):
            assert table[gram] == pytest.approx(np.log(p(tuple(symbols[k - 3 : k]), symbols[k])))


def html_texts(pages):
    return {r.page_id: r.text for r in htmltext.extract(pages, htmltext.induce(pages)).collect()}


def page_rows(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_html(spark):
    def page(k, body):
        return (k, f"http://host.example/{k}", f"<html><head><title>t</title></head><body><div class=top>Welcome to our site</div><div class=body>{body}</div></body></html>")

    rows = [page(k, f"<p>Story {k} &amp; more<br>of it<p>Second   {k}") for k in range(8)]
    rows += [(50, None, None), (51, "http://x/1", ""), (52, "http://y/1", "<p>alone</p><script>var a='<p>no</p>'</script><!-- <p>no --><nav>menu</nav>")]
    rows += [(53, "http://z/1", "<header><h1>Site</h1></header><main><article><header><h1>Title</h1>by me</header><p>x<span hidden>no</span>y</p><div class='comments'>hi</div></article></main><aside>s</aside>" + "<div>" * 500 + "deep")]
    rows += [(54, "http://w/1", "<ul><li>a<p>b<li>c</ul><table><tr><td>d<td>e<tr><td>f</table><p>g</i> h</b> 1 < 2 <3")]
    pages = page_rows(spark, rows)
    got = html_texts(pages)
    assert all(got[k] == f"Story {k} & more of it\n\nSecond {k}" for k in range(8))  # the constant greeting is template
    assert got[50] == got[51] == "" and got[52] == "alone" and got[53] == "Title\n\nxy"
    assert got[54] == "a\n\nb\n\nc\n\nd\n\ne\n\nf\n\ng h 1 < 2 <3"
    assert html_texts(pages.limit(0)) == {}
    extra = pages.withColumns({"host": pages.url, "text": pages.html, "content": pages.html})
    twice = htmltext.extract(extra.union(extra), htmltext.induce(extra.union(extra)))
    assert Counter((r.page_id, r.text) for r in twice.collect()) == Counter([*got.items()] * 2)  # repeated rows and clashing columns


def test_html_comes_through_the_wrapper(spark):
    """Without template nodes there is no text; without constant leaves the greeting stays; menus without marks are known by the host's links."""
    def page(k):
        return (k, "http://h/x", f"<div>Welcome</div><div class=m1><ul><li><a href=1>one {k}</a><li><a href=2>two {k}</a></ul></div><div class=t><p>Story {k} with a <a href=3>link {k}</a> inside</div>")

    pages = page_rows(spark, [page(k) for k in range(6)])
    wrappers = htmltext.induce(pages)
    texts = lambda w: {r.page_id: r.text for r in htmltext.extract(pages, w).collect()}
    assert texts(wrappers) == {k: f"Story {k} with a link {k} inside" for k in range(6)}
    assert set(texts(wrappers.limit(0)).values()) == {""}
    from pyspark.sql import functions as F

    assert texts(wrappers.withColumn("constant", F.expr("CAST(array() AS array<bigint>)")))[3].startswith("Welcome\n\nStory 3")


def test_html_template_inside_articles(spark):
    def page(k, text):
        return (k, "http://h/x", f"<div class=top>Welcome</div><article><h2>Title {text}</h2><p>Read our paper every day</p><p>Story {text}</p></article>")

    rows = [page(k, k) for k in range(6)] + [(k, "http://copies/x", "<article><p>all of it</p></article>") for k in range(10, 13)]
    rows += [(k, "http://two/x", f"<article><p>a paragraph of both versions</p><p>version {k}</p></article>") for k in (20, 21)]
    got = html_texts(page_rows(spark, rows))
    assert got == {k: f"Title {k}\n\nStory {k}" for k in range(6)} | {k: "all of it" for k in range(10, 13)} | {k: f"a paragraph of both versions\n\nversion {k}" for k in (20, 21)}


@pytest.mark.parametrize("first", [None, "", "<h1>Error</h1><p>try again</p>"])
def test_html_template_whatever_the_first_page(spark, first):
    """Two layouts share the greeting; neither the empty nor the error pages, nor their copies, hide it."""
    greeting = "<div class=top>Welcome</div>"
    rows = [(k, "http://h/x", first) for k in range(20)]
    rows += [(k, "http://h/x", f"{greeting}<p>text {k}</p>" if k % 2 else f"<ul><li>item {k}</ul>{greeting}<section><p>text {k}</section>") for k in range(20, 30)]
    got = html_texts(page_rows(spark, rows))
    assert all(got[k] == (f"text {k}" if k % 2 else f"item {k}\n\ntext {k}") for k in range(20, 30))


def test_html_hosts_have_one_rule(spark):
    """Upper case, user names, new lines and letters that only full lower-casing would change."""
    rows = [(k, f"{'HTTP' if k % 2 else 'http'}://H\u0130\nx{'?' if k % 3 else '#'}{k}", f"<div>same</div><p>text {k}</p>") for k in range(6)]
    rows += [(k, f"http://h\u0130\nX/{k}", f"<div>same</div><p>text {k}</p>") for k in range(6, 9)]
    assert html_texts(page_rows(spark, rows)) == {k: f"text {k}" for k in range(9)}


def test_html_of_test_pages_against_a_parser(spark):
    """Every page of the table marks its article: the query's text is that of Python's own parser."""
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.inside, self.run, self.blocks = False, [], []

        def end(self):
            text = " ".join("".join(self.run).split())
            self.blocks += [text] if text else []
            self.run = []

        def handle_starttag(self, tag, attrs):
            if tag in ("article", "h1", "p"):
                self.end()
            self.inside = self.inside or tag == "article"
            self.run += [" "] * (tag == "br")

        def handle_endtag(self, tag):
            if tag in ("article", "h1", "p"):
                self.end()
            self.inside = self.inside and tag != "article"

        def handle_data(self, data):
            self.run += [data] * self.inside

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = {}
    for r in pages.collect():
        parser = Article()
        parser.feed(r.html or "")
        parser.close()
        want[r.page_id] = (r.url, "\n\n".join(parser.blocks))
    got = {r.page_id: (r.url, r.text) for r in htmltext.op5_html_text(spark, "/root/testdata/sf0.001").collect()}
    assert got == want and len(want) > 20
    # all of these pages mark their article, so tags and class words give the text: the wrappers' places and constant leaves change none of them
    wrappers = htmltext.induce(pages)
    everything = wrappers.selectExpr("host", "array_union(content, other) AS content", "CAST(array() AS array<bigint>) AS other", "CAST(array() AS array<bigint>) AS constant")
    assert {r.page_id: r.text for r in htmltext.extract(pages, everything).collect()} == {i: text for i, (_, text) in want.items()}


LONG_PAGES = {
    "siblings": "<p>a</p><h2>b</h2>" * 50_000,
    "levels": "<div>" * 10_000 + "deep",
    "articles": "<article>" * 10_000 + "deep",
    "sections and stray ends": "<section>" * 10_000 + "<p>x</em></li>" * 10_000,
    "unclosed ends": "</p" * 300_000,
    "unclosed scripts": "<script " * 130_000,
    "open quotes": "<a href=\"x>" * 90_000,
    "unclosed paragraphs": "<p>" * 340_000,
    "comments": "<!-- x" * 160_000,
    "declarations": "<!x" * 300_000 + ">",
}


@pytest.mark.parametrize("name", list(LONG_PAGES))
def test_html_of_long_pages(name):
    import time

    page = LONG_PAGES[name]
    began = time.process_time()
    items = htmltext.parse(page)
    tree = htmltext.pruned([(i.depth, i.code, i.text is not None) for i in items], {i.code for i in items if i.text is not None})
    if tree is not None:
        found = htmltext.match(tree, tree)[0]
        assert found > 0
    htmltext.blocks_of(items, htmltext.Wrapper(frozenset({0}), frozenset(), frozenset()))
    assert time.process_time() - began < 6  # about 2 on an idle machine


def test_html_alignment_of_long_lists():
    import time

    x = (1, [(2, [7]) if k % 2 else (3, [8]) for k in range(60_000)])
    y = (1, [(3, [9]), *x[1][:-40], (2, [7])])
    began = time.process_time()
    found, leaves = htmltext.match(x, y)
    assert time.process_time() - began < 12
    # the root; the first heading without its text; what both share, two places on; the last paragraph
    assert found == 1 + 1 + 2 * (60_000 - 40) + 2 and len(leaves) == 60_000 - 40 + 1


def brute_match(a, b):
    if isinstance(a, int) or isinstance(b, int):
        return int(a == b)
    if a[0] != b[0]:
        return 0
    m = [[0] * (len(b[1]) + 1) for _ in range(len(a[1]) + 1)]
    for i, x in enumerate(a[1]):
        for j, y in enumerate(b[1]):
            m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + brute_match(x, y))
    return m[-1][-1] + 1


@pytest.mark.parametrize(("cells", "band"), [(1_000_000, 16_000_000), (3, 16_000_000), (3, 0)])
def test_tree_matching(monkeypatch, cells, band):
    monkeypatch.setattr(htmltext, "TABLE_CELLS", cells)
    monkeypatch.setattr(htmltext, "BAND_CELLS", band)
    rng = random.Random(9)

    def tree(depth):
        return rng.randint(1, 4) if depth == 0 or rng.random() < 0.3 else (rng.choice([11, 12]), [tree(depth - 1) for _ in range(rng.randint(0, 5))])

    for _ in range(300):
        a, b = (10, [tree(2) for _ in range(5)]), (10, [tree(2) for _ in range(6)])
        found, leaves = htmltext.match(a, b)
        assert found == brute_match(a, b) == htmltext.match(b, a)[0] and len(leaves) < found
    for _ in range(100):  # wide lists, where the band is narrower than the table
        xs = [rng.randint(1, 6) for _ in range(150)]
        ys = [y for y in xs if rng.random() < 0.95] + [rng.randint(1, 6) for _ in range(5)]
        assert htmltext.match((10, xs), (10, ys))[0] == brute_match((10, xs), (10, ys))


def test_tree_matching_keeps_constant_paragraphs(spark):
    rows = [(k, "http://h/x", "".join(f"<p>text {k} {n}</p>" for n in range(2 + k)) + "<p>Read on</p>" + "<p>last</p>" * (k % 2)) for k in range(8)]
    assert html_texts(page_rows(spark, rows)) == {k: "\n\n".join(f"text {k} {n}" for n in range(2 + k)) for k in range(8)}


def test_chat_of_a_long_conversation(spark):
    """100,000 turns, and a snapshot that lacks the last of them."""
    import time

    from pyspark.sql import functions as F

    long = spark.range(100_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.expr("concat('turn ', id)").alias("text"))
    frame = long.unionByName(long.where("turn < 99999").withColumn("conv_id", F.lit(2)))
    began = time.perf_counter()
    got = [(r.conv_id, r.n_turns, r.n_copies) for r in chat.render(chat.collapse_snapshots(frame)).select("conv_id", "n_turns", "n_copies").collect()]
    assert got == [(1, 100_000, 1)] and time.perf_counter() - began < 30


def test_chat_of_the_table(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.001/conversations.parquet'")
    got = chat.op10_chat(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(f"SELECT {', '.join(got.columns)} FROM ({chat.OP10_SQL})").fetchall())


def test_chat(spark):
    turns = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (2, 2, "user", "c"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (3, 2, "user", "c"),
             (4, 0, None, None), (5, 0, "", ""), (6, 0, None, None), (6, 1, "user", None), (None, 0, "user", "lost"), (7, 1, "user", "late"), (7, 0, "user", "early"), (7, 0, "user", "early")]
    frame = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, digest string")
    got = {r.conv_id: (r.n_copies, r.n_turns, r.rendered) for r in chat.render(chat.collapse_snapshots(frame)).collect()}
    assert set(got) == {2, 5, 6, 7}
    assert got[2] == (2, 3, "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n<|im_start|>user\nc<|im_end|>\n")
    assert got[7][1] == 3
    con = duckdb.connect()
    conversations = frame.toPandas()  # noqa: F841
    assert {r[0] for r in con.execute(chat.OP10_SQL).fetchall()} == set(got)
    assert chat.collapse_snapshots(frame.limit(0)).collect() == []
