"""run() against the brute-force composition of its stages on a small table."""

import hashlib

import duckdb
import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline
import public_tokenizers as P
from sparkmat.llm import bpe, linededup, quality

from tests.llm.test_edges import brute_components, brute_contamination

SF = "/root/testdata/sf0.001"


def test_pipeline(spark, tmp_path):
    import tiktoken

    source = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "s", 0)], source.schema)
    (tmp_path / "sf").mkdir()
    source.unionByName(extra).coalesce(1).write.parquet(str(tmp_path / "sf" / "documents.parquet"))
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    bench.write.parquet(str(tmp_path / "sf" / "benchmark.parquet"))

    con = duckdb.connect()
    con.execute(f"CREATE TABLE documents AS SELECT * FROM '{SF}/documents.parquet'")
    kept = {r[0] for r in con.execute(f"SELECT doc_id FROM ({quality.OP3_SQL}) WHERE kept").fetchall()}
    con.execute("CREATE TABLE all_documents AS SELECT * FROM documents")
    con.execute("DELETE FROM documents WHERE doc_id NOT IN (" + ",".join(map(str, kept)) + ")")
    lines = linededup.OP9_SQL.replace("sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), ''))", "coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')")
    texts = {r[0]: r[1] for r in con.execute(f"SELECT doc_id, kept_sha256 FROM ({lines})").fetchall()}
    texts = {i: t for i, t in texts.items() if brute[i][2]} if (brute := brute_components(sorted(texts.items()))) else {}
    dirty = {r[0] for r in brute_contamination(sorted(texts.items()), [(r.item_id, r.text) for r in bench.collect()]) if r[5]}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = {i: (len(library.encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest()) for i, t in texts.items() if i not in dirty}
    got = {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path / "sf")).collect()}
    assert got == want and dirty


def test_stages_keep_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and docs.count() == 0


def test_rows_that_share_an_id_or_have_none(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    clean, other = " ".join(f"w{k}" for k in range(40)), " ".join(f"v{k}" for k in range(40))
    stages = dict(corpus_pipeline.STAGES)

    def left(name, rows):
        docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], schema)
        return sorted(((r.doc_id, r.text) for r in stages[name](spark, docs, SF).collect()), key=str)

    rows = [(5, clean), (5, f"{other} {item}"), (None, f"{clean} {item}"), (None, clean), (6, None), (None, None)]
    assert left("benchmark decontamination", rows) == sorted([(5, clean), (None, clean), (6, None), (None, None)], key=str)
    rows = [(3, clean), (5, f"{clean} x"), (5, other), (None, clean), (7, clean), (7, clean)]
    assert left("near duplicates", rows) == sorted([(3, clean), (5, other), (None, clean)], key=str)


def test_foreign_columns_pass_through(spark):
    """Names of figures and of the operators' helpers, of other types; very long, tied and null texts."""
    from pyspark.sql import functions as F

    names = ["n_words", "word_chars", "n_lines", "n_dropped", "kept", "base_failed", "_lang", "_doc", "_text", "_gone", "_drop", "_words", "_hashes", "_id", "_hash", "text_hash", "other_columns", "_", "a.b", "h", "rep", "cid", "component_id"]
    rng = __import__("random").Random(1)
    words = [f"{a}{b}" for a in "bcdfgh" for b in ("ane", "ilo", "ur", "este")]
    prose = lambda n: " ".join(rng.choice([*words, "the", "of", "and", "to"]) for _ in range(n))
    tied = prose(80)
    texts = [(1, prose(80)), (2, tied), (3, tied), (4, f"{prose(70)}\nA line of both texts.\n{prose(30)}"), (5, f"{prose(70)}\nA line of both texts.\n{prose(30)}"), (6, prose(60_000)), (7, None), (8, ""), (None, prose(90))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({n: F.concat(F.lit(f"mine {n} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for n in names})
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs, plain = stage(spark, docs, SF), stage(spark, plain, SF)
        rows = docs.collect()
        assert docs.columns[5:] == names and all(r[n] == f"mine {n} {'-' if r.doc_id is None else r.doc_id}" for r in rows for n in names)
        assert sorted(map(str, (tuple(r)[:5] for r in rows))) == sorted(map(str, map(tuple, plain.collect()))) and rows
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert tokens.count() == len(rows)
