"""The prefix trie of conversations that share their first turns.

Every conversation is rebuilt first: it takes over the opening of an earlier
one (``openings``), then its own later turns.  A node of the trie is a distinct
sequence of first turns (role and text); its members are the conversations that
begin with it, its owner the least conv_id of them.

Each turn is hashed where its text is read, so texts are never shuffled.  Two
running exclusive-ors of hashes (depth, role, text) give each prefix a 128-bit
digest, and one aggregate gives each digest its owner and its count.  Who owns
a prefix owns every longer one of its conversation, so the first owned depth is
found by binary search: each round looks the middle prefixes of all undecided
conversations up at once, in two tables bucketed by the lookup's keys, which are
read but not shuffled again.  The owned depths of a conversation form a chain,
and a chain hangs below the node that its first prefix extends.  Totals rise
from chains to the chains above them by pointer doubling, in as many rounds as
the logarithm of the greatest number of chains on a path; suffix sums within a
chain then give each node its subtree.

Running sums are made in two passes over ranges, so a very long conversation is
split, and very common openings meet only in aggregates.  The list of members
that end in one node is never held: it is hashed as a sorted stream.

Cases: a null role or text counts as empty; rows with equal ``turn`` (null
first) are taken in the order of role, then of the text's MD5; repeated rows are
turns of their own; rows with a null conv_id belong to no conversation and are
left out; a conversation that has no turns once rebuilt is a member of the root
and ends there; an empty table gives no nodes.  Further columns are not read.
(Two of a billion different prefixes get one digest with a probability of 1e-21.)
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmat.llm.common import drop_tables, running, table, write_bucketed, write_table

#: A conversation takes over at most OPENING - 1 turns of the first of its FAMILY neighbours by number.
FAMILY, OPENING = 5, 9
NODE = ["depth", "h1", "h2"]


def hashed_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, place from 1, t1, t2, bytes): the turns in order, without their texts."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    light = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"), "turn", role.alias("role"), F.unhex(F.md5(text.cast("binary"))).alias("tie"),
        F.xxhash64(F.lit(1), role, text).alias("t1"), F.xxhash64(F.lit(2), role, text).alias("t2"), F.octet_length(text).cast("long").alias("bytes"), F.lit(1).cast("long").alias("place"),
    )
    return running(light, "conv_id", ["turn", "role", "tie"], {"place": F.sum}).select("conv_id", "place", "t1", "t2", "bytes")


def openings(convs: DataFrame) -> DataFrame:
    """(conv_id, base, h) for conv_ids: the first h turns of ``base`` replace the conversation's own first h."""
    return convs.select("conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % OPENING).alias("h"))


def rebuilt(hashed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, len) and their turns (conv_id, depth, t1, t2, bytes) after the change of openings.

    A base serves at most twice FAMILY conversations with fewer than OPENING turns each.
    """
    lengths = write_table(hashed.groupBy("conv_id").agg(F.count("*").alias("n")), "lengths")
    of_base = lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("_n"))
    plan = openings(lengths).join(of_base, "base", "left").withColumn("taken", F.least("h", F.coalesce("_n", F.lit(0))))
    plan = write_table(plan.join(lengths, "conv_id").select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")), "plan")
    head = hashed.where(F.col("place") < OPENING).withColumnRenamed("conv_id", "base").join(plan.select("conv_id", "base", "taken"), "base").where("place <= taken")
    tail = hashed.join(plan.select("conv_id", "h", "taken"), "conv_id").where("place > h").withColumn("place", F.expr("place - h + taken"))
    columns = ["conv_id", F.col("place").alias("depth"), "t1", "t2", "bytes"]
    return plan.select("conv_id", "len"), head.select(*columns).unionByName(tail.select(*columns))


def prefix_digests(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, h1, h2, bytes) from rebuilt turns: the digest of the prefix that each turn ends."""
    tagged = turns.withColumns({f"h{k}": F.xxhash64(F.lit(k), "depth", "t1", "t2") for k in (1, 2)}).drop("t1", "t2")
    return running(tagged, "conv_id", ["depth"], {"h1": F.bit_xor, "h2": F.bit_xor}).select("conv_id", *NODE, "bytes")


def first_owned(convs: DataFrame, prefixes: DataFrame, minima: DataFrame) -> DataFrame:
    """(conv_id, len, first): the least depth from 1 whose prefix the conversation owns, len + 1 if none."""
    state = write_table(convs.select("conv_id", "len", F.lit(1).cast("long").alias("low"), (F.col("len") + 1).alias("high")), "search")
    while not state.where("low < high").isEmpty():
        probes = state.where("low < high").select("conv_id", "len", "low", "high", F.expr("(low + high) div 2").alias("depth"))
        owned = probes.join(prefixes.drop("bytes"), ["conv_id", "depth"]).join(minima.select(*NODE, "owner"), NODE).withColumn("_own", F.col("owner") == F.col("conv_id"))
        decided = owned.select("conv_id", "len", F.when(F.col("_own"), F.col("low")).otherwise(F.col("depth") + 1).alias("low"), F.when(F.col("_own"), F.col("depth")).otherwise(F.col("high")).alias("high"))
        before, state = state, write_table(state.where("low >= high").unionByName(decided), "search")
        drop_tables(before)
    return state.select("conv_id", "len", F.col("low").alias("first"))


def _owner_at(at: DataFrame, prefixes: DataFrame, minima: DataFrame, root: DataFrame) -> DataFrame:
    """``at`` (conv_id, depth, ..) with ``owner``, of the root where the depth is 0."""
    deep = at.where("depth > 0").join(prefixes.drop("bytes"), ["conv_id", "depth"]).join(minima.select(*NODE, "owner"), NODE).select(*at.columns, "owner")
    return deep.unionByName(at.where("depth = 0").crossJoin(F.broadcast(root.select("owner"))).select(*at.columns, "owner"))  # one row


def _risen(chains: DataFrame) -> DataFrame:
    """(conv_id, parent, depth, leaves, saved): each chain's own figures and those of all chains below it, by pointer doubling."""
    state = write_table(chains.select("conv_id", F.col("parent").alias("up"), "leaves", "saved"), "rising")
    while not state.where("up IS NOT NULL").isEmpty():
        below = state.where("up IS NOT NULL").groupBy(F.col("up").alias("conv_id")).agg(F.sum("leaves").alias("_l"), F.sum("saved").alias("_s"))
        over = state.select(F.col("conv_id").alias("up"), F.col("up").alias("_up"))
        more = {"leaves": F.expr("leaves + coalesce(_l, 0)"), "saved": F.expr("saved + coalesce(_s, 0)")}
        after = state.join(below, "conv_id", "left").join(over, "up", "left").select("conv_id", F.col("_up").alias("up"), *(v.alias(k) for k, v in more.items()))
        before, state = state, write_table(after, "rising")
        drop_tables(before)
    return chains.select("conv_id", "parent", "depth").join(state.select("conv_id", "leaves", "saved"), "conv_id")


def _ends(members: DataFrame) -> DataFrame:
    """(owner, depth, ends_sha256) from (owner, depth, conv_id): conv_ids ascending, joined by commas, hashed as they stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest, out = None, None, []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["owner", "depth", "ends_sha256"])

        for batch in batches:
            for owner, depth, conv in zip(*(batch.column(c).to_pylist() for c in ("owner", "depth", "conv_id")), strict=True):
                if (owner, depth) == last:
                    digest.update(b",%d" % conv)
                    continue
                if last is not None:
                    out.append((*last, digest.hexdigest()))
                last, digest = (owner, depth), hashlib.sha256(b"%d" % conv)
            if len(out) >= 4096:
                yield flush()
                out = []
        if last is not None:
            out.append((*last, digest.hexdigest()))
        yield flush()

    by = ["owner", "depth"]
    return members.select(*by, "conv_id").repartition(*by).sortWithinPartitions(*by, "conv_id").mapInArrow(run, "owner long, depth long, ends_sha256 string")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row for each node: conv_id (its owner), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    convs, tail = rebuilt(write_table(hashed_turns(turns), "turns"))
    prefixes = write_bucketed(prefix_digests(tail), "prefixes", ["conv_id", "depth"])
    minima = write_bucketed(prefixes.groupBy(*NODE).agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes")), "minima", NODE)
    root = write_table(convs.agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs")).where("n_convs > 0"), "root")
    found = write_table(first_owned(convs, prefixes, minima), "found")

    # chains: the depths first .. len of their owner, the root before the first of its own
    tops = _owner_at(found.where("first <= len").select("conv_id", (F.col("first") - 1).alias("depth")), prefixes, minima, root)
    tops = tops.where("owner <> conv_id").select("conv_id", F.col("owner").alias("parent"), "depth")
    top = root.select(F.col("owner").alias("conv_id"), F.lit(None).cast("long").alias("parent"), F.lit(None).cast("long").alias("depth"))
    chains = write_table(tops.unionByName(top), "chains")
    nodes = minima.select(F.col("owner").alias("conv_id"), "depth", "n_convs", (F.expr("(n_convs - 1) * bytes")).alias("saved"))
    nodes = nodes.unionByName(root.select(F.col("owner").alias("conv_id"), F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(0).cast("long").alias("saved")))
    hung = chains.where("parent IS NOT NULL").groupBy(F.col("parent").alias("conv_id"), "depth").agg(F.count("*").alias("hung"))
    lens = found.select("conv_id", "len")
    nodes = write_table(nodes.join(hung, ["conv_id", "depth"], "left").join(lens, "conv_id").withColumn("n_children", F.expr("coalesce(hung, 0) + if(depth < len, 1, 0)")).drop("hung", "len"), "nodes")
    own = nodes.groupBy("conv_id").agg(F.count_if(F.col("n_children") == 0).alias("leaves"), F.sum("saved").alias("saved"))
    risen = write_table(_risen(write_table(chains.join(own, "conv_id"), "chains")), "risen")

    # subtrees: suffix sums along each chain of the nodes' own figures and of the chains hung at them
    added = risen.where("parent IS NOT NULL").groupBy(F.col("parent").alias("conv_id"), "depth").agg(F.sum("leaves").alias("_l"), F.sum("saved").alias("_s"))
    parts = nodes.join(added, ["conv_id", "depth"], "left").withColumns({
        "n_leaves": F.expr("if(n_children = 0, 1L, 0L) + coalesce(_l, 0L)"), "saved_tokens": F.expr("saved + coalesce(_s, 0L)"), "_back": F.expr("-depth"),
    })
    sums = running(parts.drop("_l", "_s", "saved"), "conv_id", ["_back"], {"n_leaves": F.sum, "saved_tokens": F.sum})
    above = chains.where("parent IS NOT NULL").select("conv_id", (F.col("depth") + 1).alias("_first"), "parent")
    parent = F.when(F.col("depth") == F.col("_first"), F.col("parent")).when(F.col("depth") > 0, F.col("conv_id"))
    sums = sums.join(above, "conv_id", "left").withColumn("parent_conv_id", parent)
    last = _owner_at(found.select("conv_id", F.col("len").alias("depth")), prefixes, minima, root)
    ends = _ends(last).withColumnRenamed("owner", "conv_id")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return sums.join(ends, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.col("n_children").cast("long").alias("n_children"), F.col("n_leaves").cast("long").alias("n_leaves"),
        F.col("saved_tokens").cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", empty).alias("ends_sha256"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


CRC32 = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({}, ''), lambda c: ord(c)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"
OP13_SQL = f"""
WITH own AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS turns,
         {CRC32.format("conv_id::VARCHAR")} % 9 AS h
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), convs AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns[:c.h], []), c.turns[c.h + 1:]) AS turns
  FROM own c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 5
), prefixes AS (
  SELECT conv_id, len(turns) AS n, turns[:d] AS turns, d FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM convs)
), nodes AS (
  SELECT turns, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256,
         (count(*) - 1) * coalesce(octet_length(encode(turns[d].text)), 0) AS saved
  FROM prefixes GROUP BY turns, d
), linked AS (
  SELECT n.*, p.conv_id AS parent_conv_id, p.turns AS parent_turns FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.turns = n.turns[:n.depth - 1]
), children AS (
  SELECT parent_turns AS turns, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY parent_turns
), below AS (
  SELECT turns[:d] AS turns, sum(saved)::BIGINT AS saved_tokens, sum(leaf)::BIGINT AS n_leaves
  FROM (SELECT n.turns, n.saved, (c.turns IS NULL)::BIGINT AS leaf, unnest(range(0, n.depth + 1)) AS d FROM nodes n LEFT JOIN children c ON c.turns = n.turns) GROUP BY 1
)
SELECT l.conv_id, l.depth, l.parent_conv_id, l.n_convs, coalesce(c.n_children, 0) AS n_children, b.n_leaves, b.saved_tokens, l.ends_sha256
FROM linked l LEFT JOIN children c ON c.turns = l.turns JOIN below b ON b.turns = l.turns
"""
