"""Repair of the turn structure of conversations at the least cost.

A conversation is well formed if the initials of its roles match
``(s?(ua)+)?``: nothing, or pairs of user and assistant after at most one system
turn.  Turns may be kept (0), given another role (2) or deleted (3), and empty
turns inserted (2); blank and repeated turns must be deleted, and a truncated
turn that stays costs 1 more.  The edits of a conversation are a path through
the lattice of (turn index, grammar state); the lattice is never built.
Dijkstra's search pops nodes by (cost, audit), the audit being the initials of
the edits so far, and stops at the first popped accepting end node.  So of the
cheapest repairs that with the least audit is found: two equally dear paths to
one node never have audits of which one begins the other, as the longer would
hold more insertions.

The turns of a conversation reach their task sorted and stream through it.
After every SEGMENT turns the search settles the (at most four) end nodes, whose
paths start the next segment; edits that all of them share are final, and their
turns are hashed and dropped.  So a very long conversation holds a segment and
what its paths don't agree on, besides its audit.  Whether a turn repeats one of
an earlier ``turn`` is found before by aggregates over 128-bit digests.

Cases: a null role or text counts as one space; null conv_ids are one
conversation; rows of equal ``turn`` (null first) are taken in the order of
role, then of the text's MD5; equal rows of one ``turn`` repeat each other; an
empty text is blank; an empty role fits nothing; an empty table gives no rows.
Further columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmat.llm.common import table, write_table

SPACE = " \t\n\x0b\x0c\r"
KEEP, RENAME, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
SEGMENT = 128
#: The states of the grammar: nothing yet, after system, after user, after assistant; where an initial leads.
START, SYSTEM, USER, ASSISTANT = range(4)
LEADS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
ACCEPTING = (START, ASSISTANT)
LEGAL = ("su", "ua", "au")
#: The faults of a turn, of which the first counts.
FINE, BLANK, DUPLICATE, CUT = range(4)
KEY = ["known", "conv"]
ORDER = ["placed", "at", "role", "tie"]
RESULT = "conv_id long, n_turns long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, n_repaired long, repaired_sha256 string, repaired array<struct<role: string, text: string>>"


def next_turn(state: int) -> tuple[int, str]:
    """Where a user or assistant turn leads from a state, and its role; only one of the two is possible."""
    return (ASSISTANT, "assistant") if state == USER else (USER, "user")


def cheapest(turns: list[tuple[str, int]], sources: dict[int, tuple[int, str]], final: bool) -> dict[int, tuple[int, str]]:
    """State -> (cost, audit) of the end nodes that are popped, from ``sources`` at the first turn.

    ``turns`` are (initial, fault).  If ``final``, the search stops at the first
    accepting end node; else when no end node is left.
    """
    heap = [(cost, audit, 0, state) for state, (cost, audit) in sources.items()]
    heapq.heapify(heap)
    done, ends, n = set(), {}, len(turns)
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n:
            if final and state in ACCEPTING:
                return {state: (cost, audit)}
            if not final:
                ends[state] = (cost, audit)
                if len(ends) == 4:
                    return ends
        onward = next_turn(state)[0]
        steps = [(INSERT, "I", i, onward)]
        if i < n:
            initial, fault = turns[i]
            steps.append((DELETE, "D", i + 1, state))
            if fault not in (BLANK, DUPLICATE):
                more = TRUNCATED if fault == CUT else 0
                steps.append((RENAME + more, "R", i + 1, onward))
                if (kept := LEADS.get((state, initial))) is not None:
                    steps.append((KEEP + more, "K", i + 1, kept))
        for dear, edit, j, after in steps:
            if (j, after) not in done:
                heapq.heappush(heap, (cost + dear, audit + edit, j, after))
    return ends


class Conversation:
    """One conversation as its turns stream by."""

    def __init__(self, conv: int | None, texts: bool):
        self.conv, self.texts = conv, [] if texts else None
        self.n = [0, 0, 0, 0]
        self.illegal, self.repaired, self.last, self.same = 0, 0, None, None
        self.fresh: list[tuple[str, int]] = []  # turns that the search has not seen
        self.open: list[tuple[str, str]] = []  # turns whose edit is not final
        self.frontier = {START: (0, "")}
        self.audit: list[str] = []
        self.state, self.digest = START, hashlib.sha256()

    def add(self, role: str, text: str, initial: str, fault: int) -> None:
        self.n[fault] += 1
        if self.last is not None and self.last + initial not in LEGAL:
            self.illegal += 1
        self.last = initial
        if len(self.fresh) == SEGMENT:
            self.search(final=False)
        self.fresh.append((initial, fault))
        self.open.append((role, text))

    def search(self, final: bool) -> None:
        self.frontier = cheapest(self.fresh, self.frontier, final)
        self.fresh = []
        shared = commonprefix([audit for _, audit in self.frontier.values()])
        self.frontier = {state: (cost, audit[len(shared) :]) for state, (cost, audit) in self.frontier.items()}
        self.settle(shared)

    def settle(self, edits: str) -> None:
        """Apply edits that are final."""
        self.audit.append(edits)
        used = 0
        for edit in edits:
            if edit == "I":
                self.state, role = next_turn(self.state)
                self.say(role, "")
                continue
            role, text = self.open[used]
            used += 1
            if edit == "R":
                self.state, role = next_turn(self.state)
            elif edit == "K":
                self.state = LEADS[self.state, role[0]]
            else:
                continue
            self.say(role, text)
        del self.open[:used]

    def say(self, role: str, text: str) -> None:
        self.digest.update(f"{chr(10) if self.repaired else ''}{role}:{text}".encode())
        self.repaired += 1
        if self.texts is not None:
            self.texts.append({"role": role, "text": text})

    def row(self) -> tuple:
        self.search(final=True)
        ((cost, _),) = self.frontier.values()
        return self.conv, sum(self.n), *self.n[1:], self.illegal, cost, "".join(self.audit), self.repaired, self.digest.hexdigest(), self.texts


def _stream(texts: bool):
    types = [pa.int64()] * 7 + [pa.string(), pa.int64(), pa.string(), pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))]
    names = [part.split()[0] for part in RESULT.split(", ")[:10]] + ["repaired"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(types)], names=names)

        marked = None
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in (*KEY, *ORDER, "kind", "text", "initial", "fault"))
            for known, conv, placed, at, role, tie, kind, text, initial, fault in zip(*columns, strict=True):
                if now is None or now[0] != (known, conv):
                    if now is not None:
                        out.append(now[1].row())
                    now = (known, conv), Conversation(conv if known else None, texts)
                    marked = None
                place = (placed, at, role, tie)
                if kind == 0:  # turns of this place repeat an earlier one
                    marked = place
                    continue
                repeats = place == marked
                marked = place  # what equals this turn repeats it
                now[1].add(role, text, initial, DUPLICATE if repeats and fault != BLANK else fault)
            if len(out) >= 1024:
                yield flush()
                out = []
        if now is not None:
            out.append(now[1].row())
        yield flush()

    return run


def repair(turns: DataFrame, texts: bool = True) -> DataFrame:
    """One row for each conversation of ``turns`` (conv_id, turn, role, text).

    Columns: conv_id, n_turns; blank, duplicate, truncated (turns by their first
    fault); illegal (neighbours that may not follow each other); cost, audit;
    n_repaired, repaired_sha256 (of ``role:text`` lines), and the ``repaired``
    turns themselves, null if ``texts`` is False.
    """
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    stripped = F.rtrim(text, F.lit(SPACE))
    rows = turns.select(
        F.col("conv_id").isNotNull().alias("known"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"), F.col("turn").isNotNull().alias("placed"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("at"),
        role.alias("role"), F.unhex(F.md5(text.cast("binary"))).alias("tie"), F.lit(1).alias("kind"), text.alias("text"), F.substring(role, 1, 1).alias("initial"),
        F.when(stripped == "", BLANK).when(F.right(stripped, F.lit(1)).isin(".", "!", "?"), FINE).otherwise(CUT).alias("fault"),
    )
    places = write_table(rows.select(*KEY, *ORDER).distinct(), "places")
    place = F.struct("placed", "at")
    first = places.groupBy(*KEY, "role", "tie").agg(F.min(place).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    later = places.join(first, [*KEY, "role", "tie"]).where(place > F.col("_first"))
    marks = later.select(*KEY, *ORDER, F.lit(0).alias("kind"), F.lit("").alias("text"), F.lit("").alias("initial"), F.lit(FINE).alias("fault"))
    dealt = rows.unionByName(marks).repartition(*KEY).sortWithinPartitions(*KEY, *ORDER, "kind")
    return dealt.mapInArrow(_stream(texts), RESULT)


def damage(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) with the faults that op11 plants, by crc32 of conv_id and turn."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), fate.alias("_fate")).where("_fate <> 0")
    rows = rows.withColumn("_copy", F.explode(F.expr("if(_fate = 3, array(1, 2), array(1))")))
    return rows.select("conv_id", "turn", F.expr("if(_fate = 4, 'user', role)").alias("role"), F.expr("CASE _fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END").alias("text"))


def gaps(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps): numbers missing between the least and the greatest ``turn``; nulls are ignored."""
    each = turns.groupBy("conv_id", "turn").agg(F.lit(1).alias("_"))  # distinct turns first, so no conversation's turns meet as a set
    return each.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    damaged = damage(turns)
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    found = repair(damaged, texts=False).drop("repaired", "n_turns", "n_repaired").withColumnRenamed("conv_id", "_conv")
    space = gaps(damaged).withColumnRenamed("conv_id", "_gap_conv")
    every = turns.select("conv_id").distinct()
    both = every.join(found, every["conv_id"].eqNullSafe(found["_conv"]), "left").join(space, every["conv_id"].eqNullSafe(space["_gap_conv"]), "left")
    return both.select(
        "conv_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )


def _sql() -> str:
    """DuckDB SQL of op11: the same lattice, turn by turn, as a recursion over strings of six digits of cost and the audit."""
    add = lambda x, cost, edit: f"lpad((left({x}, 6)::BIGINT + {cost})::VARCHAR, 6, '0') || substr({x}, 7) || '{edit}'"
    crc = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ord(c)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"
    before = "least(c0, c1, c3)"
    kept = lambda source, initial: f"CASE WHEN t.fault IN (0, 3) AND t.initial = '{initial}' THEN {add(source, '(t.fault // 3)', 'K')} END"
    renamed = lambda source: f"CASE WHEN t.fault IN (0, 3) THEN {add(source, '2 + t.fault // 3', 'R')} END"
    return f"""
WITH RECURSIVE fated AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS fate FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT *, unnest(CASE fate WHEN 3 THEN [1, 2] ELSE [1] END) FROM fated WHERE fate <> 0)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS place FROM damaged
), turns AS (
  SELECT conv_id, place, turn, role, text, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY place) AS before,
         CASE WHEN regexp_full_match(text, '[\\x20\\x09-\\x0D]*') THEN 1
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 2
              WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 3 ELSE 0 END AS fault
  FROM placed
), counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate,
         count(*) FILTER (WHERE fault = 3) AS truncated, count(*) FILTER (WHERE before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM turns GROUP BY conv_id
), walk AS (
  SELECT conv_id, n, 0 AS i, '000000' AS b0, NULL::VARCHAR AS b1, NULL::VARCHAR AS b2, NULL::VARCHAR AS b3 FROM counts
  UNION ALL
  SELECT w.conv_id, w.n, w.i + 1, {add("c0", 3, "D")}, least({add("c1", 3, "D")}, {kept("c0", "s")}), least({add("c2", 3, "D")}, {kept(before, "u")}, {renamed(before)}), least({add("c3", 3, "D")}, {kept("c2", "a")}, {renamed("c2")})
  FROM (SELECT *, least(b3, {add("c2", 2, "I")}) AS c3 FROM (SELECT *, b0 AS c0, b1 AS c1, least(b2, {add("least(b0, b1, b3)", 2, "I")}) AS c2 FROM walk)) w
  JOIN turns t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.place = w.i + 1
), best AS (
  SELECT conv_id, least(b0, b3, {add("least(b2, " + add("least(b0, b1, b3)", 2, "I") + ")", 2, "I")}) AS best FROM walk WHERE i = n
), edits AS (
  SELECT conv_id, k, substr(audit, k, 1) AS edit, length(regexp_replace(left(audit, k), 'I', '', 'g')) AS place
  FROM (SELECT conv_id, substr(best, 7) AS audit, unnest(range(1, length(best) - 5)) AS k FROM best)
), said AS (
  SELECT e.conv_id, e.k, e.edit, t.role, t.text, t.initial, row_number() OVER (PARTITION BY e.conv_id ORDER BY k) AS m, first_value(edit = 'K' AND t.initial = 's') OVER (PARTITION BY e.conv_id ORDER BY k) AS opened
  FROM edits e LEFT JOIN turns t ON t.conv_id IS NOT DISTINCT FROM e.conv_id AND t.place = e.place AND e.edit <> 'I' WHERE e.edit <> 'D'
), repaired AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (m - opened::BIGINT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY k) AS whole FROM said GROUP BY conv_id
)
SELECT o.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal,
       coalesce(left(b.best, 6)::BIGINT, 0) AS cost, coalesce(substr(b.best, 7), '') AS audit, sha256(coalesce(r.whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM o.conv_id
"""


OP11_SQL = _sql()
