"""Chat formatting after the collapse of cumulative snapshots.

A log often holds one conversation many times, each snapshot a few turns longer
than the one before.  A rolling hash gives each prefix of a conversation a
digest: the running exclusive-or of two 64-bit hashes of every turn (its place,
role and text), together with the number of turns; so each turn costs the same,
however long the conversation is.  The digests of proper prefixes form a table;
conversations whose own digest is in it are anti-joined away, so only maximal
conversations are collected and rendered.  Equal conversations are reduced to
that of the least conv_id first, by an aggregate, so neither a very common
conversation nor a very common first turn meets in one task.  A conversation's
turns do come together: a rendered chat is one row.  (Two of a billion different
prefixes have equal digests with a probability of 1e-21.)

Turns are taken in the order of ``turn``, ties in the order of role and text
(nulls first).  A null role or text equals only a null, and is rendered as
empty.  Rows that repeat (turn, role, text) within a conversation are turns of
their own.  Rows with a null conv_id belong to no conversation and are left out.
An empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkmat.llm.common import table, write_table

#: The mark-up of one turn; {role} and {text} are put in.
TEMPLATE = "<|im_start|>{role}\n{text}<|im_end|>\n"
DIGEST = ["place", "h1", "h2"]


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """Every turn (conv_id, turn, role, text) with its ``place`` from 1, the digest (place, h1, h2) of the prefix that it ends, and whether it is the ``last``."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    part = "role IS NULL, coalesce(role, ''), text IS NULL, coalesce(text, '')"
    hashed = turns.where("conv_id IS NOT NULL").select("conv_id", "turn", "role", "text").withColumn("place", F.row_number().over(order))
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    for k in (1, 2):
        hashed = hashed.withColumn(f"h{k}", F.expr(f"xxhash64({k}, place, {part})")).withColumn(f"h{k}", F.bit_xor(f"h{k}").over(running))
    return hashed.withColumn("last", F.lead("place").over(order).isNull())


def collapse_snapshots(turns: DataFrame) -> DataFrame:
    """conv_id, messages, digest and n_copies of each maximal conversation (conv_id, turn, role, text).

    n_copies counts the equal conversations, of which the least conv_id stays.
    """
    hashed = write_table(prefix_hashes(turns), "turns")
    distinct = hashed.where("last").groupBy(*DIGEST).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    prefixes = hashed.where("NOT last").select(*DIGEST).distinct()
    maximal = distinct.join(prefixes, DIGEST, "left_anti").select("conv_id", "n_copies", F.concat(F.hex("h1"), F.hex("h2")).alias("digest"))
    kept = hashed.select("conv_id", "place", "turn", "role", "text").join(maximal, "conv_id")
    whole = kept.groupBy("conv_id", "n_copies", "digest").agg(F.sort_array(F.collect_list(F.struct("place", "turn", "role", "text"))).alias("messages"))
    return whole.select("conv_id", "messages", "digest", "n_copies")


def render(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """``conversations`` with ``n_turns`` and ``rendered``, the marked-up chat, from ``messages``."""
    before, between, after = _parts(template)
    return conversations.withColumns({
        "n_turns": F.size("messages").cast("long"),
        "rendered": F.array_join(
            F.transform("messages", lambda m: F.concat(F.lit(before), F.coalesce(m["role"], F.lit("")), F.lit(between), F.coalesce(m["text"], F.lit("")), F.lit(after))), ""
        ),
    })


def _parts(template: str) -> tuple[str, str, str]:
    before, rest = template.split("{role}")
    between, after = rest.split("{text}")
    return before, between, after


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = render(collapse_snapshots(table(spark, sf_dir, "conversations")))
    return chats.select("conv_id", "n_turns", "n_copies", F.length("rendered").cast("long").alias("n_chars"), F.sha2("rendered", 256).alias("rendered_sha256"))


OP10_SQL = r"""
WITH convs AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS messages
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), uniq AS (
  SELECT messages, min(conv_id) AS conv_id, count(*) AS n_copies FROM convs GROUP BY messages
), prefixes AS (
  SELECT DISTINCT messages[:k] AS messages
  FROM (SELECT messages, unnest(range(1, len(messages))) AS k FROM uniq)
), maximal AS (
  SELECT * FROM uniq ANTI JOIN prefixes USING (messages)
), rendered AS (
  SELECT conv_id, len(messages) AS n_turns, n_copies,
         array_to_string(list_transform(messages, lambda m: '<|im_start|>' || coalesce(m.role, '') || chr(10)
           || coalesce(m.text, '') || '<|im_end|>' || chr(10)), '') AS chat
  FROM maximal
)
SELECT conv_id, n_turns::BIGINT AS n_turns, n_copies, length(chat) AS n_chars, sha256(chat) AS rendered_sha256 FROM rendered
"""
