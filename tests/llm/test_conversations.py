"""Conversation repair against an exhaustive search over all edits."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from chronoweave.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string"
WHOLE, BEGUN = re.compile(r"(s?(ua)+)?"), re.compile(r"s?(ua)*u?|")


def plain_best(rows):
    """Least (cost, audit) and its lines by trying every edit of every row; rows: role, text, fault."""
    best = [(4 * len(rows), "D" * len(rows), [])]

    def go(k, initials, cost, audit, lines):
        if cost > best[0][0] or not BEGUN.fullmatch(initials):
            return
        if k == len(rows) and WHOLE.fullmatch(initials):
            best[0] = min(best[0], (cost, audit, lines))
        for i, name in (("u", "user"), ("a", "assistant")):
            go(k, initials + i, cost + 3, audit + "I", [*lines, name + ":"])
        if k < len(rows):
            role, text, fault = rows[k]
            go(k + 1, initials, cost + 4, audit + "D", lines)
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                go(k + 1, initials + (role[:1] or "?"), cost + more, audit + "K", [*lines, f"{role}:{text}"])
                for i, name in (("u", "user"), ("a", "assistant")):
                    go(k + 1, initials + i, cost + 3 + more, audit + "R", [*lines, f"{name}:{text}"])

    go(0, "", 0, "", [])
    return best[0]


def plain(table):
    """All columns of the query for {conv_id: rows of turn, role, text}."""
    out = []
    for conv in {r[0] for r in table}:
        rows = []
        for _, turn, role, text in (r for r in table if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
            at = zlib.crc32(key.encode()) % 20
            text = "" if at == 1 else re.sub("[.!?]", "", text) if at == 2 else text
            rows += [(turn, "user" if at == 4 else role, text)] * (0 if at == 0 else 2 if at == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults, judged = set(), dict.fromkeys(("blank", "duplicate", "truncated"), 0), []
        for _, role, text in rows:
            last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else None
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            judged.append((role, text, fault))
        turns = {t for t, _, _ in rows if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, lines = plain_best(judged)
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *faults.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def random_table(seed, n):
    r = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None]
    texts = ["Yes.", "What now?", "cut off", "", " \n", "Ünï çödé!", "a.b", None, "Go on...  ", "Same.", "Same."]
    out = []
    for conv in [None, *range(n)]:
        turns = [r.choice([None, *range(6)]) if r.random() < 0.2 else i for i in range(r.randint(1, 5))]
        out += [(conv, t, r.choice(roles), r.choice(texts)) for t in turns]
    return out


def frame(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def query(spark, tmp_path):
    def run(table, extra=False):
        df = spark.createDataFrame(table, SCHEMA).repartition(3)
        if extra:
            for c in ("key", "edit", "step", "fault", "copy", "at", "cost"):
                df = df.withColumn(c, F.lit("x"))
        path = str(tmp_path / f"t{random.random()}")
        df.write.parquet(f"{path}/conversations.parquet")
        return frame(C.op13_earley_conversation_repair(spark, path))

    return run


def test_equals_an_exhaustive_search(query):
    table = random_table(3, 250)
    assert query(table) == plain(table)


def test_empty_and_clashing(query):
    table = random_table(5, 20)
    assert query([]) == []
    assert query(table, extra=True) == plain(table)


def test_repeated_rows_and_lost_conversations(query):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    table = [(gone, 0, "user", "Hi.")] + [(7, 1, "user", "Hi.")] * 3
    got = query(table)
    assert got == plain(table)
    assert (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in got


def test_ties_are_ascii_least():
    turn = lambda i: C.Turn(i, False, False)
    r = random.Random(1)
    for _ in range(300):
        roles = [r.choice(["user", "assistant", "system", "x"]) for _ in range(r.randint(0, 5))]
        cost, edits = C.parse([turn(x[0] if x[0] in "sua" else "") for x in roles])
        assert (cost, "".join(e for e, _ in edits)) == plain_best([(x, ".", None) for x in roles])[:2]


def test_long_conversations_and_texts(spark, monkeypatch):
    """A conversation of 20,000 turns, and texts that wait in a file, give the same edits as short ones held in memory."""
    r = random.Random(2)
    rows = [(1, i, r.choice(["user", "assistant"]), f"turn {i}.") for i in range(20_000)]
    rows += [(2, 0, "user", "long " * 200_000 + "."), (2, 1, "assistant", "ok."), (2, 2, "user", "cut " * 100_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = frame(C.reports(C.repair_conversations(df)))
    monkeypatch.setattr(C, "HELD", 1000)
    held = C._Rows()
    for i in range(5000):
        held.add((i, "user", "x" * 10))
    assert [x[0] for x in held] == list(range(5000))
    cost = {x[0]: x[6] for x in whole}
    turns = [C.Turn(x[2][0], False, False) for x in rows[:20_000]]
    assert cost[1] == C.parse(turns)[0] and len(whole) == 2
    assert next(x[7] for x in whole if x[0] == 2) in ("KKD", "KKK", "DDD", "KKI") and cost[2] == 4


def test_edits_rebuild_the_conversation(spark):
    """The operator's own rows: string keys with a dot in the name, deleted rows told apart, inserted ones empty."""
    rows = [("c", 0, "assistant", "Hello."), ("c", 1, "assistant", "Hello."), ("c", 2, "user", "What?")]
    df = spark.createDataFrame(rows, "`a.b` string, turn int, role string, text string")
    got = [tuple(x) for x in C.repair_conversations(df, key="a.b").orderBy("step").collect()]
    kept = [(x[7], x[8]) for x in got if x[2] != "D"]
    assert [x[2] for x in got].count("D") == 1 and got[2][5] == "duplicate"
    assert re.fullmatch("s?(ua)+", "".join(x[0][0] for x in kept))
