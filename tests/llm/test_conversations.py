"""op11 and op13 against brute force: nulls, blank and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from sparkmat.llm import repair, trie

SCHEMA = "conv_id long, turn long, role string, text string"
CLASHING = f"{SCHEMA}, place long, depth long, h1 string, kind string, known string, conv string, fault string, owner long, _p long"


def with_clashes(spark, rows):
    return spark.createDataFrame([(*r, 7, 7, "x", "x", "x", "x", "x", 7, 7) for r in rows], CLASHING)


def tie(text):
    return hashlib.md5(text.encode()).digest()


def ordered(rows, blank):
    """The rows of each conversation in order, nulls as ``blank``."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn is not None, turn or 0, blank if role is None else role, blank if text is None else text))
    return {c: sorted(rs, key=lambda r: (r[0], r[1], r[2], tie(r[3]))) for c, rs in convs.items()}


def brute_repair(turns):
    """(counts, cost, audit, repaired) of (role, text) in order, over all states turn by turn."""
    faults, seen = [], set()
    for role, text in turns:
        inner = text.strip(repair.SPACE)
        faults.append(repair.BLANK if not inner else repair.DUPLICATE if (role, text) in seen else repair.FINE if inner[-1] in ".!?" else repair.CUT)
        seen.add((role, text))
    grammar = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    best = {"": (0, "", ())}

    def inserted(states):
        for _ in range(4):
            for state, (cost, audit, said) in list(states.items()):
                for role in ("user", "assistant"):
                    to = grammar.get((state, role[0]))
                    if to and (cost + 2, audit + "I", (*said, (role, ""))) < states.get(to, (10**9,)):
                        states[to] = (cost + 2, audit + "I", (*said, (role, "")))
        return states

    for (role, text), fault in zip(turns, faults, strict=True):
        after = {}
        for state, (cost, audit, said) in inserted(best).items():
            steps = [(state, cost + 3, audit + "D", said)]
            if fault in (repair.FINE, repair.CUT):
                more = int(fault == repair.CUT)
                steps += [(grammar[state, role[:1]], cost + more, audit + "K", (*said, (role, text)))] if (state, role[:1]) in grammar else []
                steps += [(grammar[state, r[0]], cost + 2 + more, audit + "R", (*said, (r, text))) for r in ("user", "assistant") if (state, r[0]) in grammar]
            for to, *path in steps:
                after[to] = min(after.get(to, (10**9,)), tuple(path))
        best = after
    cost, audit, said = min(v for k, v in inserted(best).items() if k in ("", "a"))
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
    return (faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit), list(said)


def some_turns(rng, n):
    return [(rng.choice(["user", "assistant", "assistant", "user", "system", "tool", "unknown", "", " "]), rng.choice(["Well.", "So", "What? ", "", " \t", "No!\n", f"t{rng.random()}."])) for _ in range(n)]


@pytest.mark.parametrize("segment", [1, 3, 128])
def test_repair_is_the_cheapest(monkeypatch, segment):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    rng = random.Random(segment)
    for n in [0, 1, 2, 3, 5, 9, 17, 40] * 12:
        turns = some_turns(rng, n)
        conv, seen = repair.Conversation(1, True), set()
        for role, text in turns:
            inner = text.strip(repair.SPACE)
            conv.add(role, text, role[:1], repair.BLANK if not inner else repair.DUPLICATE if (role, text) in seen else repair.FINE if inner[-1] in ".!?" else repair.CUT)
            seen.add((role, text))
        row = conv.row()
        want, said = brute_repair(turns)
        assert row[2:8] == want
        assert [(t["role"], t["text"]) for t in row[10]] == said
        assert row[9] == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()


def rows_with_cases():
    rng = random.Random(5)
    rows = [(1, k, role, text) for k, (role, text) in enumerate(some_turns(rng, 12))]
    rows += [(2, 0, "user", "Hi."), (2, 0, "user", "Hi."), (2, 3, "user", "Hi."), (2, None, "assistant", "First."), (2, 7, None, None), (2, 7, None, "x.")]
    rows += [(None, 1, "user", "Null."), (None, None, "assistant", "Conv."), (3, 5, "user", None), (4, 1, "system", "Only.")]
    rows += [(5, k, "assistant" if k % 2 else "user", f"turn {k}" + "." * (k % 3)) for k in range(400)]
    rows += [(6, 1, "user", "long " * 200_000), (6, 2, "assistant", " " * 100_000 + "end.")]
    return rows


def test_repair_of_rows(spark):
    rows = rows_with_cases()
    got = {r.conv_id: r for r in repair.repair(with_clashes(spark, rows)).collect()}
    want = {c: brute_repair([(r[2], r[3]) for r in rs]) for c, rs in ordered(rows, " ").items()}
    assert got.keys() == want.keys()
    for c, (figures, said) in want.items():
        r = got[c]
        assert (r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) == figures, c
        assert [(t.role, t.text) for t in r.repaired] == said and r.n_repaired == len(said)
    assert repair.repair(spark.createDataFrame([], SCHEMA)).collect() == []
    assert all(r.repaired is None for r in repair.repair(with_clashes(spark, rows), texts=False).collect())


def test_op11_returns_every_conversation(spark, tmp_path):
    lost = next(c for c in range(100, 999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [*rows_with_cases(), (lost, 0, "user", "Gone."), (-4, 9, "user", "a."), (-4, 2, "assistant", "b.")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    damaged = []
    for conv, turn, role, text in rows:
        role, text, conv_turn = " " if role is None else role, " " if text is None else text, f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate = zlib.crc32(conv_turn.encode()) % 20
        if fate:
            text = "" if fate == 1 else "".join(x for x in text if x not in ".!?") if fate == 2 else text
            damaged += [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    want = {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c, *_ in rows}
    for c, rs in ordered(damaged, " ").items():
        (blank, duplicate, cut, illegal, cost, audit), said = brute_repair([(r[2], r[3]) for r in rs])
        numbers = {r[1] for r in rs if r[0]}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        want[c] = (gaps, blank, duplicate, cut, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest())
    got = repair.op11_structure_repair(spark, str(tmp_path)).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == want and len(got) == len(want) and lost in want


def brute_trie(rows):
    own = {c: [(r[2], r[3]) for r in rs] for c, rs in ordered([r for r in rows if r[0] is not None], "").items()}
    convs = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        convs[c] = [*own.get(base, [])[:h], *turns[h:]]
    nodes = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    children = Counter(n[:-1] for n in nodes if n)
    saved, leaves = Counter(), Counter()
    for n, members in nodes.items():
        for d in range(len(n) + 1):
            saved[n[:d]] += (len(members) - 1) * len(n[-1][1].encode()) if n else 0
            leaves[n[:d]] += not children[n]
    out = set()
    for n, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(c for c in members if len(convs[c]) == len(n)))
        parent = min(nodes[n[:-1]]) if n else None
        out.add((min(members), len(n), parent, len(members), children[n], leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def test_trie(spark):
    rng = random.Random(9)
    rows = [r for r in rows_with_cases() if r[0] != 6]
    for c in [*range(20, 70), -7, -6, -5, 1000]:  # shared openings, copies, single turns
        words = [f"{rng.choice('ab')}é"] * rng.randint(0, 2) + [rng.choice("abc") for _ in range(rng.randint(1, 9))]
        rows += [(c, k, "user" if k % 2 == 0 else "assistant", w) for k, w in enumerate(words)]
    rows += [(c, k, "user", f"same {k}") for c in range(200, 230) for k in range(3)]
    got = trie.prefix_trie(with_clashes(spark, rows)).collect()
    assert {tuple(r) for r in got} == brute_trie(rows) and len(got) == len({tuple(r) for r in got})
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []


def test_trie_of_turnless_conversations(spark):
    rows = [(c, 0, "user", "x") for c in range(1, 40)]  # most openings come from conversations that aren't there
    got = {tuple(r) for r in trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute_trie(rows)
    only = [(c, 0, "user", "x") for c in (1, 2, 3)]
    assert {tuple(r) for r in trie.prefix_trie(spark.createDataFrame(only, SCHEMA)).collect()} == brute_trie(only)
