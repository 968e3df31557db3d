"""The corpus pipeline: from documents to token ids.

STAGES are (name, function) in order; each function takes (spark, docs, sf_dir)
and returns a DataFrame, which is written as Parquet and read again as the next
one's docs.  All but the last return the columns of documents.

1. quality rules: documents that the rules reject go;
2. line dedup: lines that a smaller doc_id holds go, n_chars follows the text;
3. near-duplicates: the least doc_id of each group stays;
4. decontamination: documents with words inside a benchmark window go;
5. byte-level BPE: token counts and digests of the ids and of the decoded bytes.

Rows are judged by their own texts, also where they share a doc_id or have none;
only near-duplicates links rows without doc_id with nothing and keeps them.  An
empty table passes through.  Further columns, whatever their names, pass through
all stages but the last as they are, but for n_chars where line dedup changes it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmat.llm import bpe, decontam, linededup, neardup, quality
from sparkmat.llm.common import drop_tables, packed, scratch, table, unpacked, write_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality.judge(packed(docs, ["text", "lang"]), keep_text=False)
    return judged.where("kept").select(*unpacked(docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(packed(docs, ["doc_id", "text"], ("text",)), linededup.build_index(docs))
    return kept.select(*unpacked(docs.columns, text=F.col("text"), n_chars=F.length("text").cast("long")))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows whose doc_id (null is one of its own) and text aren't those of a row (doc_id, text_hash) in ``gone``."""
    gone = write_table(gone.select(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_text")).distinct(), "gone")
    rows = packed(docs, [F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash")])
    same = rows["_id"].eqNullSafe(gone["_gone"]) & (rows["_hash"] == gone["_text"])
    return rows.join(gone, same, "left_anti").select(*unpacked(docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, neardup.near_duplicates(docs.select("doc_id", "text")).where("NOT kept"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontam.find_contamination(decontam.build_index(docs.select("doc_id", "text")), table(spark, sf_dir, "benchmark"), near=0, hashes=True)
    return _without(docs, found.where("contaminated"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", byte_bpe),
]
#: Connected components of near-duplicates and byte-pair merges have no plain SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        with scratch() as keep:  # a stage's own tables go with it, its predecessor's output once it is written
            docs = keep(write_table(stage(spark, docs, sf_dir), name.replace(" ", "_")))
        drop_tables(before)
    return STAGES[-1][1](spark, docs, sf_dir)
